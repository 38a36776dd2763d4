"""Operator 5: packing documents into sequences by swap-based local search.

Documents are tokenised once; only pieces' lengths, places and checksums (a few dozen bytes each) go on, and are written
to the shared folder. Pieces of full length are sequences of their own. The others are dealt by hash into shards of about
SHARD pieces; each shard starts from the plain order of its hash-dealt rows, each piece put where it leaves least room,
and is then improved by local search: documents of the emptiest underfull bins are moved to fuller ones, exchanged
one-for-one or two-for-one (either way), each step increasing the sum of squared fills, until bins empty and no underfull
bin has such a step. A search that ends above the fewest bins possible breaks up some bins and goes on. Then the shards'
leftover underfull bins are dealt anew, the emptiest together, into groups of about SHARD pieces, and searched once more
from where they stand. Each piece says in which bin the search found it and how many steps moved it.

Defined cases: null text is empty and has the one closing token; a very long text is tokenised whole and cut into pieces;
repeated rows are packed one by one; an empty table gives an empty result; further columns, also of clashing names, are
ignored. Ties between bins go to the first.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import bounded_batches, materialize, pick, read_table

CAPACITY = 2048
SHARD = 10_000
#: Rounds of breaking bins up that save none, each over twice as many bins, after which a search ends.
PATIENCE = 4
#: UTF-8 bytes of ASCII and of the code points up to U+023F, whose classes no Unicode version changes.
_SETTLED = bytes([*range(0x80), *range(0x80, 0xC0), *range(0xC2, 0xC9)])


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """text bytes -> numpy ids as the tokenizers library gives them for `vocabulary`.json, without added tokens.

    The same vocabulary's ranks drive tiktoken, which is five times as fast. Texts with characters beyond U+023F, on
    whose classes the two libraries' Unicode versions might differ, go through tokenizers itself.
    """
    import base64

    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(P.path(f"{vocabulary}.json"))
    with open(P.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(raw: bytes) -> np.ndarray:
        text = raw.decode()
        if raw.translate(None, _SETTLED):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, allowed_special="all")

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, the first one shorter where n isn't a multiple."""
    starts = [0, *range(n % capacity or capacity, n, capacity)]
    return list(zip(starts, [b - a for a, b in zip(starts, [*starts[1:], n])]))


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, the ids of each piece."""
    bounded_batches(docs.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows, ids = [], []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                found = np.append(encode(raw.as_py() or b""), end_id).astype("<u4")
                for k, (start, length) in enumerate(cut(len(found), capacity)):
                    own = found[start : start + length]
                    rows.append((doc_id, k, start, length, zlib.crc32(own.tobytes())))
                    if with_ids:
                        ids.append(own.astype(np.int64))
            columns = list(zip(*rows)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(ids, pa.list_(pa.int64()))] if with_ids else [])], names=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    return pick(docs, "doc_id", "text").mapInArrow(split, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int, order: list[int]) -> list[list[int]]:
    """Bins of item indices: each item, in the given order, goes where it leaves least room."""
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: there are bins with gap g
    for i in order:
        n = int(lengths[i])
        fitting = gaps >> n
        if fitting:
            gap = n + (fitting & -fitting).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps &= ~(1 << gap)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if gap > n:
            by_gap[gap - n].append(b)
            gaps |= 1 << (gap - n)
    return bins


def largest_first(lengths: np.ndarray) -> list[int]:
    return np.argsort(-lengths, kind="stable").tolist()


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing undercuts: by volume, and by large documents that can't share a bin.

    For each small size k, documents over capacity - k are alone, others over half the capacity in a bin each, and those
    from k to half of it go into what room is left there, then into further bins.
    """
    count, size = (np.concatenate([[0], np.cumsum(np.bincount(lengths, w, capacity + 1))]).astype(np.int64) for w in (None, lengths))
    half, k = capacity // 2, np.arange(capacity // 2 + 1)
    large = count[-1] - count[half + 1]
    paired = size[capacity - k + 1] - size[half + 1]
    shared = (count[capacity - k + 1] - count[half + 1]) * capacity - paired
    rest = size[half + 1] - size[k]
    return int((large + np.maximum(0, -(-(rest - shared) // capacity))).max(initial=0))


class _Offers:
    """Sums of documents that bins could give in exchange; rows of a bin that has changed since are out of date."""

    def __init__(self) -> None:
        self.rows, self.n = np.zeros((3, 4096), np.int64), 0

    def add(self, b: int, version: int, sums: list[int]) -> None:
        while self.n + len(sums) > self.rows.shape[1]:
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], axis=1)
        self.rows[0, self.n : self.n + len(sums)] = sums
        self.rows[1:, self.n : self.n + len(sums)] = [[b], [version]]
        self.n += len(sums)

    def current(self, version: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sums, bins, of = self.rows[:, : self.n]
        good = version[bins] == of
        if 2 * good.sum() < self.n:
            self.rows[:, : good.sum()] = self.rows[:, : self.n][:, good]
            self.n = int(good.sum())
            return self.rows[0, : self.n], self.rows[1, : self.n]
        return sums[good], bins[good]


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int, steps: dict[str, int] | None = None, touched: np.ndarray | None = None) -> list[list[int]]:
    """Fewer or as many bins, none over capacity.

    Every underfull bin gives, the emptiest first: a document that fits into a fuller bin moves there; else one of its
    documents is exchanged for a smaller one of a fuller underfull bin with room for the difference, or two for one, or
    one for two. Every step raises the sum of squared fills, a bounded integer, so the search ends: when no underfull bin
    has an improving step, or at the fewest bins that there can be. `steps` counts the steps by kind, `touched` those of
    each document.
    """
    size = lengths.tolist()
    bins = [list(b) for b in bins]
    fill = np.array([sum(size[i] for i in b) for b in bins], np.int64)
    alive = np.ones(len(bins), bool)
    least = least_bins(lengths, capacity)
    steps = {} if steps is None else steps
    touched = np.zeros(len(lengths), np.int64) if touched is None else touched
    version = np.zeros(len(bins), np.int64)
    single: list[dict[int, tuple[int, ...]]] = [{} for _ in bins]
    double: list[dict[int, tuple[int, ...]]] = [{} for _ in bins]
    offers = (_Offers(), _Offers())
    changes: list[int] = []  # bins in the order in which they changed
    looked = np.full(len(bins), -1, np.int64)  # how many changes there were when a bin last had no improving step

    def enter(b: int) -> None:
        """What the bin can give now, by sum; a full bin takes no part any more."""
        version[b] += 1
        looked[b] = -1
        if fill[b] < capacity:
            single[b] = {size[i]: (i,) for i in bins[b]}
            double[b] = {size[i] + size[j]: (i, j) for k, i in enumerate(bins[b]) for j in bins[b][:k]}
            for pool, own in zip(offers, (single[b], double[b])):
                pool.add(b, version[b], list(own))

    def exchange(kind: str, a: int, b: int, gives: tuple[int, ...], takes: tuple[int, ...]) -> bool:
        for source, to, items in ((a, b, gives), (b, a, takes)):
            for i in items:
                bins[source].remove(i)
                bins[to].append(i)
                touched[i] += 1
        less = sum(size[i] for i in gives) - sum(size[i] for i in takes)
        fill[a] -= less
        fill[b] += less
        enter(a)
        enter(b)
        changes.extend((a, b))
        steps[kind] = steps.get(kind, 0) + 1
        return True

    def step(a: int) -> bool:
        """One improving step that takes from bin a, the largest of its kind.

        If bin a has had none and is as it was, only bins that have changed since can give it one.
        """
        fuller = alive & (fill >= fill[a]) & (fill < capacity)
        fuller[a] = False
        if looked[a] >= 0:
            seen = np.zeros(len(bins), bool)
            seen[changes[looked[a] :]] = True
            fuller &= seen
        near = np.nonzero(fuller)[0]
        if len(near):
            gap = capacity - fill[near]
            most = int(gap.max())
            if (n := max((n for n in single[a] if n <= most), default=0)) > 0:
                return exchange("move", a, int(near[np.argmin(np.where(gap >= n, gap, capacity + 1))]), single[a][n], ())
            for pool, kinds in zip(offers, ((("one for one", single[a]), ("two for one", double[a])), (("one for two", single[a]),))):
                sums, at = pool.current(version)
                usable = fuller[at]
                sums, at = sums[usable], at[usable]
                if not len(sums):
                    continue
                upto = sums + capacity - fill[at]  # the largest sum that each offer can be had for
                reach = np.zeros(capacity + 1, np.int64)
                np.maximum.at(reach, sums, upto)
                reach = np.maximum.accumulate(reach)
                for kind, own in kinds:
                    gives = np.array(sorted(own), np.int64)
                    takes = np.searchsorted(reach, gives)  # the least sum that can be had for each
                    gain = np.where(takes < gives, gives - takes, 0)
                    if gain.max(initial=0) > 0:
                        k = int(gain.argmax())
                        g, t = int(gives[k]), int(takes[k])
                        b = int(at[np.argmin(np.where((sums == t) & (upto >= g), upto, 2 * capacity + 1))])
                        return exchange(kind, a, b, own[g], (double if kind == "one for two" else single)[b][t])
        looked[a] = len(changes)
        return False

    for b in range(len(bins)):
        enter(b)
    improved = True
    while improved and alive.sum() > least:
        improved = False
        giving = np.nonzero(alive & (fill < capacity))[0]
        for a in giving[np.argsort(fill[giving], kind="stable")].tolist():
            while bins[a] and fill[a] < capacity and step(a):
                improved = True
            if not bins[a]:
                alive[a] = False
                version[a] += 1
                if alive.sum() == least:
                    break
    return [items for b, items in enumerate(bins) if alive[b]]


def search(lengths: np.ndarray, bins: list[list[int]], capacity: int, steps: dict[str, int] | None = None, touched: np.ndarray | None = None, patience: int = PATIENCE) -> list[list[int]]:
    """Local search, iterated: where it ends above the fewest bins, the underfull bins and as many full ones are broken up,
    filled anew, largest documents first, and searched again; the outcome stays if it has fewer bins or a higher squared
    fill. After a round that saves no bin, twice as many full bins are broken up; after `patience` of them it ends.
    """
    steps = {} if steps is None else steps
    touched = np.zeros(len(lengths), np.int64) if touched is None else touched
    bins, least = local_search(lengths, bins, capacity, steps, touched), least_bins(lengths, capacity)
    r, quiet = np.random.default_rng(0), 0
    while len(bins) > least and quiet < patience:
        fills = np.array([lengths[b].sum() for b in bins])
        full = r.permutation(np.nonzero(fills == capacity)[0])
        under = np.nonzero(fills < capacity)[0]
        broken = np.concatenate([under, full[: len(under) << quiet]])
        items = np.array([i for b in broken.tolist() for i in bins[b]])
        own, moves, count = lengths[items], np.zeros(len(items), np.int64), {}
        new = local_search(own, best_fit(own, capacity, largest_first(own)), capacity, count, moves)
        saved = len(broken) - len(new)
        if saved > 0 or saved == 0 and sum(int(own[b].sum()) ** 2 for b in new) > int((fills[broken] ** 2).sum()):
            keep = np.ones(len(bins), bool)
            keep[broken] = False
            bins = [b for b, k in zip(bins, keep) if k] + [items[b].tolist() for b in new]
            touched[items] += 1 + moves
            count["broken up"] = len(broken)
            for k, n in count.items():
                steps[k] = steps.get(k, 0) + n
        quiet = 0 if saved > 0 else quiet + 1
    return bins


def placed(lengths: np.ndarray, bins: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for b, items in enumerate(bins):
        where[items] = b
        offset[items] = np.cumsum(lengths[items]) - lengths[items]
    return where, offset


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, the bin that it began in, and the number of steps that it was part of."""
    begin, touched = best_fit(lengths, capacity, range(len(lengths))), np.zeros(len(lengths), np.int64)
    return (*placed(lengths, search(lengths, begin, capacity, touched=touched)), placed(lengths, begin)[0], touched)


def pack_pieces(cut_pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """The pieces' rows with sequence_id, offset, first_id (of the bin in which the search found the piece) and steps (that
    moved it). Full pieces have non-negative ids, packed bins negative ones."""
    rows = materialize(cut_pieces.withColumn("rid_", F.monotonically_increasing_id()), "pieces")
    columns = [c for c in rows.columns if c != "rid_"]
    full = rows.filter(F.col("length") >= capacity).select(*columns, F.col("rid_").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.col("rid_").alias("first_id"), F.lit(0).cast("bigint").alias("steps"))
    rest = rows.filter(F.col("length") < capacity)
    shards, names = max(1, -(-rest.count() // shard)), full.columns

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rid_", ignore_index=True)
        where, offset, first, steps = pack(pdf["length"].to_numpy(np.int64), capacity)
        base = -1 - (pdf["shard_"].to_numpy(np.int64) << 32)
        return pdf.assign(sequence_id=base - where, offset=offset, first_id=base - first, steps=steps)[names]

    dealt = rest.withColumn("shard_", F.pmod(F.xxhash64("rid_"), F.lit(shards)))
    packed = dealt.groupBy("shard_").applyInPandas(fill, full.schema)
    return full.unionByName(packed if shards == 1 else repack(materialize(packed, "packed"), capacity, shard))


def repack(packed: DataFrame, capacity: int, shard: int) -> DataFrame:
    """The packed pieces after a local search over the underfull bins of all shards, which keep their ids."""
    bins = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill_"), F.count("*").alias("n_")).filter(F.col("fill_") < capacity)
    bins = materialize(bins, "bins")
    # groups take ranges of fills, one row for each fill; a fill with many pieces has parts of its own
    first, at, pieces_ = [], 0, 0
    for fill_, n in sorted((x["fill_"], x["n"]) for x in bins.groupBy("fill_").agg(F.sum("n_").alias("n")).collect()):
        own = max(1, -(-n // shard))
        if pieces_ and pieces_ + n > shard:
            at, pieces_ = at + 1, 0
        first.append((fill_, at, own))
        at, pieces_ = (at + own, 0) if own > 1 else (at, pieces_ + n)
    if not first:
        return packed
    groups = packed.sparkSession.createDataFrame(first, "fill_ bigint, at_ bigint, parts_ bigint")
    bins = bins.join(F.broadcast(groups), "fill_").select(F.col("sequence_id").alias("bin_"), (F.col("at_") + F.pmod(F.xxhash64("sequence_id"), F.col("parts_"))).alias("group_"))
    columns = packed.columns
    both = packed.join(bins, packed["sequence_id"] == bins["bin_"], "left")

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sequence_id", "offset"], ignore_index=True)
        lengths, ids = pdf["length"].to_numpy(np.int64), pdf["sequence_id"].to_numpy(np.int64)
        at, touched = np.unique(ids, return_index=True)[1].tolist(), pdf["steps"].to_numpy(np.int64).copy()
        found = search(lengths, [list(range(a, b)) for a, b in zip(at, [*at[1:], len(ids)])], capacity, touched=touched)
        where, offset = placed(lengths, found)
        names = ids[at[: len(found)]]
        return pdf.assign(sequence_id=names[where], offset=offset, steps=touched)[columns]

    kept = both.filter(F.col("group_").isNull()).select(*columns)
    return kept.unionByName(both.filter(F.col("group_").isNotNull()).select(*columns, "group_").groupBy("group_").applyInPandas(again, packed.schema))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    return pack_pieces(pieces(docs, capacity), capacity, shard)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
