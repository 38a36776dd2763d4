import math
import random

import numpy as np

from foliospark.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, k=5):
    """Every row for every query."""
    whole = [(i, [math.floor(256 * x) for x in np.float32(v).astype(float)]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in whole if i % 50 == 0}):
        query = min(v for i, v in whole if i == q)
        scored = sorted((-sum(a * b for a, b in zip(v, query)), i) for i, v in whole if i != q)
        out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scored[:k])]
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 50 = 0"), **more).collect()))


def test_against_brute_force(spark):
    r = random.Random(0)
    vec = lambda d, s=0.2: [r.gauss(0, s) for _ in range(d)]
    rows = [(i, vec(16)) for i in range(600)]
    rows += [(700 + i, rows[0][1]) for i in range(60)]  # a common vector: ties
    rows += [rows[5], rows[50], (50, vec(16)), (1000, None), (None, vec(16)), (1001, [None] * 16), (1002, [float("nan")] * 16), (1050, [float("inf")] * 16)]
    rows += [(1100, vec(9)), (1103, vec(20)), (1150, []), (1200, [0.0] * 16), (1250, vec(16, 50)), (1251, vec(16, 1e5))]
    want = plain(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, block=100, query_block=3, bits=3) == want


def test_huge_components(spark):
    rows = [(0, [1e30, -1.0]), (1, [1e30, 2.0]), (2, [-3e30, 2.0]), (3, [5.0, 7.0])]
    got = run(spark, rows)
    assert [x[2] for x in got] == [1, 3, 2] and got[0][3] == 2**63 - 1 and got[2][3] == -(2**63)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (7, [0.5])]) == [(0, 1, 7, 128 * 256)]


def test_sums_are_scores_up_to_a_constant():
    r = np.random.default_rng(1)
    v = r.integers(-100, 100, (130, 8)).astype(float)
    index = topk.Slices(v, bits=8)
    q = r.integers(-90, 90, 8).astype(float)
    got = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << w for w, s in enumerate(index.sums(q)))
    assert len(set((got - v @ q).tolist())) == 1


def test_query_ignores_clashing_columns(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0]) for i in range(101)]
    spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], f"{SCHEMA}, rid_ int, query_id string, score int, b int, q int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, topk.op7_topk(spark, str(tmp_path)).collect())) == plain(rows)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert topk.op7_topk(spark, f"{tmp_path}/none").count() == 0
