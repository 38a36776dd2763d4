import pytest
from pyspark.sql import functions as F

from foliospark.llm import common


def test_salted_and_broadcast_joins_agree(spark, monkeypatch):
    left = spark.createDataFrame([(i, k) for i, k in enumerate(["a"] * 200 + ["b"] * 3 + [None] * 4 + ["z"])], "i int, key string")
    right = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "key string, n int")
    one = sorted(map(tuple, common.small_or_salted_join(left, right, ["key"]).collect()), key=repr)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    two = sorted(map(tuple, common.small_or_salted_join(left, right, ["key"], salts=4).collect()), key=repr)
    assert one == two and len(one) == 208 and (204, None, 3) in one and (207, "z", None) in one


def test_columns_are_found_by_position(spark):
    df = spark.createDataFrame([(1, "x", "y")], "Doc_ID int, text string, TEXT_ string")
    assert common.pick(df, "doc_id", "text").columns == ["doc_id", "text"]
    frame, (a, b) = common.numbered(df, "text", "doc_id")
    assert (a, b) == ("c1_", "c0_") and frame.columns == ["c0_", "c1_", "c2_"]
    with pytest.raises(ValueError, match="lang"):
        common.pick(df, "lang")


def test_tables_go_to_the_shared_folder(spark):
    path = common.shared_dir(spark)
    out = common.materialize(spark.range(3), "here")
    assert path == spark.conf.get("spark.checkpoint.dir") and all(f.startswith(path) for f in out.inputFiles())


def test_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    common.bounded_batches(spark)
    assert spark.conf.get(key) == "500"
    spark.conf.set(key, "100")
    common.bounded_batches(spark)
    assert spark.conf.get(key) == "100"
    spark.conf.unset(key)


def test_prefix_sums_by_levels(spark):
    rows = [(k, at, (at * 7 + k) % 5) for k in (1, 2) for at in range(0, 300, k)]
    df = spark.createDataFrame(rows, "sid int, at long, n long")
    want = sorted((k, at, sum(n for x, b, n in rows if x == k and b < at)) for k, at, _ in rows)
    for fan in (4, 17, 4096):
        assert sorted(map(tuple, common.prefix_sums(df, "sid", "at", "n", 300, fan).collect())) == want


def test_running_sums_by_ranges(spark):
    rows = [(None if i == 3 else f"s{i * 37 % 101:03d}", i) for i in range(101)]
    df = spark.createDataFrame(rows, "source string, n long")
    by = [F.col("source").asc_nulls_last()]
    one = common.running(df, by, {"nth": F.lit(1), "sum": F.col("n")})
    many = common.running(df, by, {"nth": F.lit(1), "sum": F.col("n")}, one_window=5)
    assert one.columns == many.columns and sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, many.collect()), key=repr)
    assert one.filter("source IS NULL").first()["nth"] == 101


def test_hot_join_is_a_join(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "fp long, x int")
    right = left.groupBy("fp").count().withColumnRenamed("count", "n").withColumn("root", F.col("fp") * 2)
    want = sorted((fp, x, fp * 2) for fp, x in left.collect())
    got = common.hot_join(left, right, "fp", "n", 300)
    assert got.columns == ["fp", "x", "root"] and sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert common.hot_join(left.limit(0), right.limit(0), "fp", "n", 0).count() == 0
