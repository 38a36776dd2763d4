"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word, in Java, Python and DuckDB syntax alike: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Those six characters, as a literal for trim() and translate().
SPACES = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by position.

    An exactly spelled column wins over one that differs in case; further columns, whatever their names, are pruned.
    """
    found = []
    for name in names:
        exact = [i for i, c in enumerate(df.columns) if c == name]
        loose = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not exact and not loose:
            raise ValueError(f"column {name} is missing; there are {df.columns}")
        found.append((exact or loose)[0])
    numbered = df.toDF(*[f"c{i}_" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"c{i}_").alias(name) for i, name in zip(found, names)])


def numbered(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The frame with columns c0_, c1_, ... and the new names of `names`: internal columns can then clash with none."""
    at = []
    for name in names:
        hits = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not hits:
            raise ValueError(f"column {name} is missing; there are {df.columns}")
        at.append(f"c{hits[0]}_")
    return df.toDF(*[f"c{i}_" for i in range(len(df.columns))]), at


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, only in local mode, one of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
    return place.rstrip("/")


#: Rows in an Arrow batch at most. A row may be a whole text, so Spark's default of 10,000 is too many for small executors.
ARROW_ROWS = 500


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ARROW_ROWS, if it is higher; Spark reads it when the action runs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write the frame as Parquet to the shared folder and read it back: lineage is cut, lost executors lose nothing.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # zstd frees its native buffers with each page, snappy's direct ones wait for garbage collection; small row groups bound the writers' heap
    df.write.option("compression", "zstd").option("parquet.block.size", 32 << 20).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a side is broadcast; each row here is a few hundred bytes at most, so 64 MB at the very most.
BROADCAST_ROWS = 100_000


def small_or_salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 32) -> DataFrame:
    """Left join of many rows to a materialised table with one row per key, null keys matching null keys.

    Up to BROADCAST_ROWS rows (counted, not guessed) the table is broadcast. Beyond that both sides are dealt by key and
    salt, the table once for each salt, so that a hot key spreads over `salts` tasks. The salt is seeded: over a left side
    that is read from files, as everywhere here, a repeated task deals its rows as before.
    """
    rows = right.count()
    renamed = right.toDF(*[f"r_{c}" if c in keys else c for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"r_{k}"])
    if rows <= BROADCAST_ROWS:
        return left.join(F.broadcast(renamed), same, "left").drop(*[f"r_{k}" for k in keys])
    salted = left.withColumn("salt_", (F.rand(7) * salts).cast("int"))
    copies = renamed.withColumn("r_salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = salted["salt_"] == copies["r_salt_"]
    for k in keys:
        same = same & salted[k].eqNullSafe(copies[f"r_{k}"])
    return salted.join(copies, same, "left").drop("salt_", "r_salt_", *[f"r_{k}" for k in keys])


#: A key is hot if it has more than one in so many of all rows, so there are fewer hot keys than that.
HOT = 512


def hot_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of rows to a materialised table with one row per key, null keys aside; without the table's key and n.

    The table says how many of the left rows have a key (n) and `total` how many rows there are. Keys with over one in HOT
    of them, fewer than HOT by that, are broadcast, so their rows stay where they are; the other rows are shuffled by key.
    """
    renamed = right.withColumnRenamed(key, "k_").withColumnRenamed(n, "n_")
    hot, cold = renamed.filter(F.col("n_") * HOT > total), renamed.filter(F.col("n_") * HOT <= total)
    stay = left.join(F.broadcast(hot), left[key] == hot["k_"])
    move = left.join(F.broadcast(hot.select("k_")), left[key] == F.col("k_"), "left_anti")
    return stay.unionByName(move.join(cold, move[key] == cold["k_"])).drop("k_", "n_")


def prefix_sums(totals: DataFrame, key: str, at: str, n: str, places: int, fan: int = 4096) -> DataFrame:
    """(key, at, before): the sum of n over smaller `at` (0 to places - 1) of the same key; `totals` has a row for each (key, at).

    Beyond `fan` places the sums go by levels, as in a scan, so that no window has more than `fan` rows.
    """
    if places <= fan:
        by = W.partitionBy(key).orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
        return totals.select(key, at, (F.sum(n).over(by) - F.col(n)).alias("before"))
    up = f"{at}_"
    low = totals.select(key, at, n, F.expr(f"{at} div {fan}L").alias(up))
    upper = prefix_sums(low.groupBy(key, up).agg(F.sum(n).alias(n)), key, up, n, -(-places // fan), fan)
    upper = upper.select(F.col(key).alias("k_"), F.col(up).alias("u_"), F.col("before").alias("base_"))
    by = W.partitionBy(key, up).orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = low.withColumn("in_", F.sum(n).over(by) - F.col(n))
    return inner.join(upper, (inner[key] == upper["k_"]) & (inner[up] == upper["u_"])).select(key, at, (F.col("in_") + F.col("base_")).alias("before"))


def running(table: DataFrame, order: list[Column], sums: dict[str, Column], one_window: int = BROADCAST_ROWS) -> DataFrame:
    """The table with inclusive running sums over an order without ties.

    Up to `one_window` rows (counted) one window does it. Beyond that rows are dealt by ranges of the order, summed within
    ranges of about 10,000 rows, and the ranges' totals are summed by themselves.
    """
    rows = table.count()
    if rows <= one_window:
        by = W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return table.select("*", *[F.sum(c).over(by).alias(name) for name, c in sums.items()])
    dealt = materialize(table.repartitionByRange(-(-rows // 10_000), *order).withColumn("part_", F.spark_partition_id()), "ranges")
    total = dealt.groupBy("part_").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    over = W.orderBy("part_").rowsBetween(W.unboundedPreceding, W.currentRow)
    base = total.select(F.col("part_").alias("p_"), *[(F.sum(name).over(over) - F.col(name)).alias(f"{name}_") for name in sums])
    by = W.partitionBy("part_").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = dealt.select("*", *[F.sum(c).over(by).alias(name) for name, c in sums.items()])
    out = inner.join(F.broadcast(base), inner["part_"] == base["p_"])
    return out.select(*table.columns, *[(F.col(name) + F.col(f"{name}_")).alias(name) for name in sums])


def bound(value: Column, body, name: str = "v") -> Column:
    """body(x) with x bound to the value once: a lambda over a one-element array keeps Catalyst from copying it."""
    return F.element_at(F.transform(F.array(value), body), 1)
