"""Operator 7: exact top-k by integer inner product over a bit-sliced index.

Components become integers. Rows are dealt by hash into blocks of about BLOCK; in a block every attribute is quantised
to BITS bits and stored as bitmaps, one for each bit (slice). A query's score is added up from the slices and their
complements by carry-save adders on bitmaps, each non-zero signed digit of a query component adding one shifted
attribute. The k-th largest quantised sum is found from the most significant slice downward; quantisation is off by a
known bound at most, so only rows within that bound of the k-th can belong to the answer, and these boundary rows are
resolved by exact inner products. Blocks return k rows for each query; a ranking over blocks keeps the best k.

Queries are dealt into blocks too, and every pair of blocks is a unit of work: both sides are bounded.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither do rows without id;
vectors of different lengths are padded with zeros; equal scores go by the smaller vec_id; repeated rows are candidates
each, a repeated query id is asked once (with its least vector), and rows with the query's id are not its candidates;
scores beyond 64 bits are clamped; an empty table gives an empty result; further columns, also of
clashing names, are ignored by the query. There are no texts here, so no very long ones; a very long vector makes a block's
bitmaps longer, BITS bits a component and row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.common import materialize, pick, read_table

K = 5
SCALE = 256
BITS = 6
BLOCK = 8192
QUERY_BLOCK = 16384


def integers(vectors: pa.Array) -> np.ndarray:
    """Rows of floor(SCALE * x) as float64 (whole numbers), shorter vectors padded with zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    values = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def _pack(bits: np.ndarray) -> np.ndarray:
    """Booleans (..., n) as little-endian words (..., n / 64)."""
    n = bits.shape[-1]
    padded = np.zeros((*bits.shape[:-1], -(-n // 64) * 64), bool)
    padded[..., :n] = bits
    return np.packbits(padded, axis=-1, bitorder="little").view("<u8")


def _positions(words: np.ndarray, n: int) -> np.ndarray:
    return np.nonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])[0]


class Slices:
    """The bit-sliced index of one block of vectors (whole numbers, rows in order of id)."""

    def __init__(self, vectors: np.ndarray, bits: int = BITS):
        self.n, self.d = vectors.shape
        self.vectors, self.bits = vectors, bits
        base = vectors.min(0, initial=0)
        span = float((vectors - base).max(initial=0))
        self.shift = max(0, int(np.ceil(np.log2(span + 1))) - bits) if span else 0
        while span / 2.0**self.shift >= 2.0**bits:
            self.shift += 1
        u = np.floor((vectors - base) / 2.0**self.shift).astype(np.int64)
        self.loss = 2.0**self.shift - 1
        slices = _pack((u.T[:, None, :] >> np.arange(bits)[None, :, None] & 1).astype(bool))
        self.every = _pack(np.ones(self.n, bool))
        # [sign, attribute, bit]: the slice itself, then its complement
        self.slices = np.stack([slices, ~slices & self.every])

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the quantised score plus a constant."""
        levels: list[list[np.ndarray]] = []
        for sign, at, power in zip(*_digits(query[: self.d])):
            while len(levels) < power + self.bits:
                levels.append([])
            for b in range(self.bits):
                levels[power + b].append(self.slices[sign, at, b])
        out, carried = [], []
        for w in range(10_000):
            here = [*(levels[w] if w < len(levels) else []), *carried]
            if not here:
                if w >= len(levels):
                    break
                out.append(np.zeros_like(self.every))
                carried = []
                continue
            s, carried = np.stack(here), []
            while len(s) > 1:
                if len(s) == 2:
                    carried.append(s[0] & s[1])
                    s = (s[0] ^ s[1])[None]
                else:
                    t = len(s) // 3
                    a, b, c = s[:t], s[t : 2 * t], s[2 * t : 3 * t]
                    x = a ^ b
                    carried.extend((a & b) | (c & x))
                    s = np.concatenate([x ^ c, s[3 * t :]])
            out.append(s[0])
        return out

    def top(self, query: np.ndarray, k: int, allowed: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Rows and scores of the k best among the allowed ones (a bitmap), best first, ties by position."""
        width = max(len(query), self.d)
        sums = self.sums(query)
        undecided, chosen, kth = allowed, np.zeros_like(allowed), 0
        for w in range(len(sums) - 1, -1, -1):
            hit = chosen | (undecided & sums[w])
            if np.bitwise_count(hit).sum() >= k:
                undecided, kth = undecided & sums[w], kth | 1 << w
            else:
                chosen, undecided = hit, undecided & ~sums[w]
        # the loss of each component is from 0 to self.loss
        slack = float(np.abs(query[: self.d]).sum()) * self.loss / 2.0**self.shift
        floor = kth - int(np.ceil(slack)) - 1
        rows = _positions(_at_least(sums, floor, allowed), self.n) if floor > 0 else _positions(allowed, self.n)
        q = np.zeros(width)
        q[: len(query)] = query
        v = self.vectors[rows]
        if float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, width) < 2.0**53:
            scores = (v @ q[: self.d]).astype(np.int64)
            best = np.lexsort((rows, -scores))[:k]
            return rows[best], scores[best].tolist()
        exact = [sum(int(a) * int(b) for a, b in zip(x, q)) for x in v.tolist()]
        best = sorted(range(len(rows)), key=lambda i: (-exact[i], rows[i]))[:k]
        return rows[best], [max(-(1 << 63), min((1 << 63) - 1, exact[i])) for i in best]


def _digits(query: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Sign (1: negative), attribute and power of the non-zero digits of each component's non-adjacent form."""
    signs, places, powers = [], [], []
    for at, q in enumerate(query.tolist()):
        n, power = int(q), 0
        while n:
            if n & 1:
                digit = 2 - (n & 3)
                signs.append(int(digit < 0))
                places.append(at)
                powers.append(power)
                n -= digit
            n >>= 1
            power += 1
    return signs, places, powers


def _at_least(sums: list[np.ndarray], value: int, allowed: np.ndarray) -> np.ndarray:
    """Allowed rows whose bit-sliced sum is at least the value."""
    more, same = np.zeros_like(allowed), allowed
    if value >> len(sums):
        return more
    for w in range(len(sums) - 1, -1, -1):
        if value >> w & 1:
            same = same & sums[w]
        else:
            more = more | (same & sums[w])
            same = same & ~sums[w]
    return more | same


def valid(vector: str) -> Column:
    return F.expr(f"{vector} IS NOT NULL AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows of `vectors` for each row of `queries`, both (vec_id, embedding)."""
    rows = materialize(vectors.filter(valid("embedding")).filter("vec_id IS NOT NULL").withColumn("rid_", F.monotonically_increasing_id()), "vectors")
    asked = queries.filter(valid("embedding")).filter("vec_id IS NOT NULL").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
    asked = materialize(asked, "queries")
    blocks, query_blocks = max(1, -(-rows.count() // block)), max(1, -(-asked.count() // query_block))
    left = rows.withColumn("b", F.pmod(F.xxhash64("rid_"), F.lit(blocks))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).select("b", "q", "vec_id", "embedding")
    right = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))).select("b", "q", "query_id", "embedding")

    def unit(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        mine = mine.sort_by("vec_id").combine_chunks()
        out: tuple[list, list, list] = ([], [], [])
        if mine.num_rows and theirs.num_rows:
            ids = mine["vec_id"].to_numpy()
            index = Slices(integers(mine["embedding"].combine_chunks()), bits)
            theirs = theirs.combine_chunks()
            for query_id, query in zip(theirs["query_id"].to_pylist(), integers(theirs["embedding"].combine_chunks())):
                allowed = index.every
                a, b = np.searchsorted(ids, [query_id, query_id + 1])
                if a < b:
                    own = np.ones(index.n, bool)
                    own[a:b] = False
                    allowed = _pack(own)
                found, scores = index.top(query, k, allowed)
                out[0].extend([query_id] * len(found))
                out[1].extend(ids[found].tolist())
                out[2].extend(scores)
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    best = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(unit, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = pick(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLE = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT query_id, vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM q JOIN v ON v.vec_id <> q.query_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
