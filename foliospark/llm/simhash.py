"""Operator 6: SimHash near-duplicates by exact tiled comparison.

Fingerprints are the bitwise majority of the XXH64 (seed 42) of four-word shingles. Only distinct fingerprints are
compared. Two fingerprints at most 4 bits apart agree on at least one of five bit blocks (pigeonhole), so each
fingerprint goes to five buckets, one for each block's value. Buckets over PART rows are cut into parts by population
count, each pair of parts is a unit of work of its own, and a row goes only to units with parts whose population counts
are within the radius of its own. Within a unit, numpy compares tiles by exclusive-or and bit count, both sorted by
population count, and skips pairs of tiles whose population counts differ by more than the radius. All these prunings are
lossless. A unit reports a spanning forest of its links, never all pairs; stars over the forest give components.

Cost: with n distinct fingerprints, 5n rows are shuffled and n * n * 5 / 2**14 pairs stand in common buckets. Blocks prune
most; population counts spare about two in five of the rest, and only in buckets over a tile, so from millions of
distinct fingerprints on or among near copies.

Hot groups: rows are joined to their fingerprint's group, and fingerprints to their component, by hot_join, so copies and
near copies of one text don't meet in one task.

Defined cases: a very long text is hashed whole, in one task, 8 bytes a shingle in memory; equal texts tie, and the least
doc_id, then the first row, stays; null or wordless text has fingerprint zero and links like any other; under four words, the whole sequence
is the one shingle; repeated rows share a fingerprint; a null doc_id counts as larger than any other and is a
component's id only where no other is there; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.common import bounded_batches, hot_join, materialize, numbered, pick, read_table
from foliospark.llm.components import connected_components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Rows of a bucket that one unit of work takes from either side.
PART = 2048
#: Rows of a numpy tile.
TILE = 256
#: First bit and width of each block; RADIUS + 1 of them.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of UTF-8 text."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *(ends[:-SHINGLE]).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _add_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1).cast(pa.binary())
        found = np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for each row, fp as a signed bigint."""
    bounded_batches(docs.sparkSession)
    return pick(docs, "doc_id", "text").mapInArrow(_add_fingerprints, "doc_id bigint, fp bigint")


def local_forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root of each of n nodes, the least index of its component."""
    root = np.arange(n)
    for i, j in links:
        while len(i):
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    return root


def tiled_links(x: np.ndarray, y: np.ndarray | None, radius: int = RADIUS, tile: int = TILE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs at most `radius` bits apart, tile by tile: of x with itself if y is None, else of x with y.

    x and y must be sorted by population count. Indices into y start at len(x).
    """
    alone = y is None
    y = x if alone else y
    px, py = np.bitwise_count(x).astype(np.int64), np.bitwise_count(y).astype(np.int64)
    for a in range(0, len(x), tile):
        xs, low, high = x[a : a + tile], px[a], px[min(a + tile, len(x)) - 1]
        for b in range(a if alone else 0, len(y), tile):
            if py[b] > high + radius:
                break
            if py[min(b + tile, len(y)) - 1] < low - radius:
                continue
            i, j = np.nonzero(np.bitwise_count(xs[:, None] ^ y[None, b : b + tile]) <= radius)
            if alone and a == b:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i + a, j + b + (0 if alone else len(x))


def _unit(fp: np.ndarray, part: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges of one unit as signed fingerprints."""
    order = np.argsort(np.bitwise_count(fp), kind="stable")
    fp, part = fp[order], part[order]
    if a == b:
        nodes, links = fp, tiled_links(fp, None)
    else:
        left, right = fp[part == a], fp[part == b]
        nodes, links = np.concatenate([left, right]), tiled_links(left, right)
    root = local_forest(len(nodes), links)
    hung = np.nonzero(root != np.arange(len(nodes)))[0]
    return nodes[hung].view(np.int64), nodes[root[hung]].view(np.int64)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Units arrive as runs of rows with the same (block, value, a, b); a run may go on in the next batch."""
    held: list[np.ndarray] | None = None

    def edges(columns: list[np.ndarray]) -> tuple[list, list]:
        block, value, a, b, part, fp = columns
        cuts = np.nonzero((block[1:] != block[:-1]) | (value[1:] != value[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[0] + 1
        us, vs = [], []
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(fp)]):
            if e - s > 1:
                u, v = _unit(fp[s:e], part[s:e], a[s], b[s])
                if len(u):
                    us.append(u)
                    vs.append(v)
        return us, vs

    def out(us: list, vs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*us, np.empty(0, np.int64)]), pa.int64()), pa.array(np.concatenate([*vs, np.empty(0, np.int64)]), pa.int64())], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        columns[5] = columns[5].view(np.uint64)
        if held:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        last = len(columns[5]) - 1
        same = np.ones(last + 1, bool)
        for c in columns[:4]:
            same &= c == c[last]
        cut = last + 1 - (np.argmin(same[::-1]) if not same.all() else last + 1)
        if cut:
            yield out(*edges([c[:cut] for c in columns]))
        held = [c[cut:] for c in columns]
    if held:
        yield out(*edges(held))


def units(prints: DataFrame, part: int = PART) -> DataFrame:
    """(block, value, a, b, part, fp): the rows of every unit of work, which compares parts a and b of one bucket.

    `prints` has distinct fp.
    """
    blocks = F.explode(F.array(*[F.struct(F.lit(k).alias("block"), F.expr(f"CAST(shiftrightunsigned(fp, {at}) & {(1 << width) - 1} AS int)").alias("value")) for k, (at, width) in enumerate(BLOCKS)]))
    rows = prints.select("fp", blocks.alias("b")).select("fp", "b.block", "b.value")
    rows = rows.withColumn("pop", F.bit_count("fp"))
    cells = rows.groupBy("block", "value", "pop").agg(F.count("*").alias("n"))
    by = W.partitionBy("block", "value")
    upto = F.sum("n").over(by.orderBy("pop").rowsBetween(W.unboundedPreceding, W.currentRow))
    cells = cells.withColumn("total", F.sum("n").over(by)).filter("total > 1").withColumn("upto", upto)
    # the parts that a population count's rows are dealt to, and those that counts within the radius are dealt to
    cells = cells.withColumn("first", F.expr(f"CAST((upto - n) div {part} AS int)")).withColumn("last", F.expr(f"CAST((upto - 1) div {part} AS int)"))
    near = by.orderBy("pop").rangeBetween(-RADIUS, RADIUS)
    cells = cells.withColumn("from", F.min("first").over(near)).withColumn("to", F.max("last").over(near))
    # a row for each block value, 4 * 2**13 + 2**12 = 36,864 at most whatever the input; buckets of more than one part have
    # four arrays of 65 integers besides, about 1 KB
    names = ["first", "last", "from", "to"]
    table = F.map_from_entries(F.collect_list(F.struct("pop", F.struct(*names))))
    parts = cells.groupBy("block", "value").agg(F.when(F.max("total") > part, table).alias("m"))
    by_pop = lambda c: F.when(F.col("m").isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(64)), lambda p: F.try_element_at("m", p)[c])).alias(c)
    parts = parts.select("block", "value", *[by_pop(c) for c in names])
    one = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(F.get(c, F.col("pop"))).alias(c)
    dealt = rows.join(F.broadcast(parts), ["block", "value"]).select("fp", "block", "value", *[one(c) for c in names])
    dealt = dealt.withColumn("part", F.expr("CAST(first + pmod(xxhash64(fp), last - first + 1) AS int)"))
    return dealt.withColumn("other", F.expr("explode(sequence(from, to))")).select("block", "value", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "part", "fp")


def links(prints: DataFrame, part: int = PART) -> DataFrame:
    """A forest (u, v) over fingerprints (distinct fp) that has the same components as all links at most RADIUS bits apart."""
    keys = ["block", "value", "a", "b"]
    return units(prints, part).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare, "u bigint, v bigint")


def components(prints: DataFrame) -> DataFrame:
    """(fp, n, root, component_id) for each distinct fingerprint of (doc_id, fp); n: its rows. Materialised."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")), "fps")
    roots = connected_components(links(distinct.select("fp")))
    member = materialize(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "doc", "n", F.coalesce("root", "fp").alias("root")), "members")
    least = materialize(member.groupBy("root").agg(F.min("doc").alias("component_id"), F.count("*").alias("fps")), "components")
    return materialize(hot_join(member, least, "root", "fps", member.count()).select("fp", "n", "root", "component_id"), "grouped")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id for each row."""
    prints = materialize(fingerprints(docs), "prints")
    found = hot_join(prints, components(prints), "fp", "n", prints.count())
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns: the one with the least doc_id, then the first row.

    Documents are written once with their fingerprints and a row number, so that repeated ids stay apart.
    """
    bounded_batches(docs.sparkSession)
    frame, (doc_id, text) = numbered(docs, "doc_id", "text")
    rows = materialize(frame.withColumn("rid_", F.monotonically_increasing_id()), "dedup-rows")
    prints = materialize(rows.select("rid_", F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_add_fingerprints, "rid_ bigint, doc_id bigint, fp bigint"), "prints")
    # components have distinct least ids, but where ids are missing or repeated they may share one: the root tells them apart
    grouped = hot_join(prints, components(prints.select("doc_id", "fp")), "fp", "n", prints.count()).select("rid_", "doc_id", "root")
    stay = grouped.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid_")).alias("best")).select(F.col("best.rid_").alias("keep_"))
    return rows.join(stay, rows["rid_"] == stay["keep_"], "left_semi").select(*frame.columns).toDF(*docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(read_table(spark, sf_dir, "documents"))
