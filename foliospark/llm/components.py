"""Connected components of a distributed edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import hot_join, materialize


#: Pairs up to which a plain join by node is small whatever the nodes: a hot one's pairs are 16 MB at most.
SMALL_PAIRS = 1_000_000


def _star(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v, m): every pair with the least node among u and its v's; there are `total` pairs.

    The minimum is combined before it is shuffled. Pairs are dealt by u; beyond SMALL_PAIRS those of a hot u stay in place.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    if total > SMALL_PAIRS:
        return hot_join(pairs, materialize(least, "least"), "u", "n", total).select("u", "v", "m")
    least = least.withColumnRenamed("u", "k")
    return pairs.join(least, pairs["u"] == least["k"]).select("u", "v", "m")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node that can be reached.

    Each round hangs a node's larger neighbours below its least neighbour, then its smaller ones; stars remain, after a
    number of rounds that grows with the square of the log of the input at most. Every half round is written to the
    shared folder, so an executor that is lost costs one half round at most. Loops (u = u) are kept as components of one
    node. No edge table is ever collected.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark, pairs = None, now.count()
    for _ in range(max_rounds):
        both = now.unionByName(now.filter("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_star(both, 2 * pairs).filter("v >= u OR m = u").select(F.greatest("u", "v").alias("u"), "m").toDF("u", "v").distinct(), "star")
        small = _star(large, 2 * pairs)
        now = materialize(small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").distinct(), "star")
        last, mark = mark, now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        pairs = mark[0]
        if mark == last:
            break
    else:
        raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
