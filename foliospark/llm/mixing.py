"""Operator 8: mixing sources to target weights by a low-discrepancy schedule (built-in functions only).

Sources get targets in words: a share of the total by weight, capped at a multiple of the source's size, the excess
reshared among the others. Each source's documents are shuffled (ordered by a hash) and laid end to end, once for each
pass; the line is cut into blocks of BLOCK words, and a source needs as many blocks as its target fills. Slots of the
schedule map the golden-ratio sequence through the cumulative block counts to a source; the k-th slot of a source takes
its k-th block, and the last block is cut at the target. A source that has all its blocks steps aside, and the sequence
goes on until all have theirs, so that every source meets its target to the word and every prefix of the slots holds the
sources in about their shares. Every row that the mixture takes says in which slot it comes first.

Ranks and offsets are prefix sums by levels, each window bounded, so that a hot source is spread over many tasks; tables of
sources have a row for each source, and are summed by ranges if they are long.

Defined cases: null text has size 0 and is not taken; a null source is a source of its own, last in order; a very long text
spans many blocks and so many slots; rows that are repeated are laid one after the other; an empty table gives an empty
result; further columns, also of clashing names, are ignored by the report and kept by the mixture of documents. Ties in
the shuffled order are between rows of equal id and text, and go by row number; they share a bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.common import WORD, materialize, numbered, pick, prefix_sums, read_table, running, small_or_salted_join

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
BLOCK = 256
#: Slots in which ranks are counted by one window.
CHUNK = 512
#: Documents of the largest source in one bucket of the shuffled order, about.
BUCKET = 256
#: The golden ratio's fraction as an odd multiple of 2 ** -61, in two parts.
_GOLD = int(0.6180339887498949 * (1 << 61)) | 1
_G1, _G0 = _GOLD >> 31, _GOLD & ((1 << 31) - 1)


def word_count(text: str) -> str:
    pattern = WORD.replace("\\", "\\\\")
    return f"CAST(coalesce(regexp_count({text}, '{pattern}'), 0) AS bigint)"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, sid, source_size, weight, target of each source, from (source, source_size), materialised.

    With sources in order of cap over weight, the level (words for each unit of weight) of the k-th and later ones is
    what the caps of the earlier leave, over the weights left; the first k whose own cap lies above that level has it.
    """
    ordered = running(sizes, [F.col("source").asc_nulls_last()], {"nth": F.lit(1)}).withColumn("sid", F.col("nth") - 1)
    ordered = ordered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double"))
    ordered = ordered.withColumn("cap", F.col("source_size").cast("double") * cap).select("source", "sid", "source_size", "weight", "cap")
    whole = ordered.agg(F.sum("source_size").cast("double").alias("size"), F.sum("weight").alias("weight")).first()
    by = running(ordered, [F.col("cap") / F.col("weight"), F.col("sid")], {"caps": F.col("cap"), "weights": F.col("weight")})
    capped, rest = F.col("caps") - F.col("cap"), F.lit(whole["weight"] or 0.0) - F.col("weights") + F.col("weight")
    level = by.withColumn("level", (F.lit((whole["size"] or 0.0) * share) - capped) / rest)
    first = level.filter("level * weight <= cap").agg(F.min(F.struct(F.col("cap") / F.col("weight"), F.col("sid"), "level")).alias("m")).select("m.level").first()
    target = F.col("cap") if first is None or first[0] is None else F.least(F.col("cap"), F.lit(first[0]) * F.col("weight"))
    return level.select("source", "sid", "source_size", "weight", target.alias("target"))


def schedule(sources: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(slot, sid, rank): which source each slot takes its next block from; rank counts a source's slots from 0.

    A source has the first slots of the endless sequence that fall to it, as many as it has blocks; slots that fall to
    sources that have all theirs are left out. `sources` has sid and target, materialised.
    """
    quota = F.ceil(F.floor("target") / block).cast("bigint")
    spans = running(sources.select("sid", quota.alias("quota")).filter("quota > 0"), [F.col("sid")], {"hi": F.col("quota")}).withColumn("lo", F.col("hi") - F.col("quota"))
    spans = materialize(spans, "spans")
    slots = spans.agg(F.max("hi")).first()[0] or 0
    half = 1 << 31
    # i * _GOLD mod 2 ** 61 without leaving 63 bits, then scaled to a place among all blocks
    i1, i0 = "shiftright(id, 31)", f"(id & {half - 1})"
    point = f"((({i0} * {_G0}) + ((({i0} * {_G1}) + ({i1} * {_G0})) & {(1 << 30) - 1}) * {half}) & {(1 << 61) - 1})"
    place = f"least(CAST(floor({point} / {float(1 << 61)}D * {float(slots)}D) AS bigint), {max(slots - 1, 0)}L)"
    # range join by cells: a source takes part in each cell that its blocks reach, and a cell has a row for each of them
    cell = max(1, slots // 4096)

    def falling(begin: int, end: int, spans: DataFrame, *more: str) -> DataFrame:
        """(slot, sid, quota) of the slots from begin to end that fall to the sources."""
        points = sources.sparkSession.range(begin, end).selectExpr("id AS slot", f"{place} AS place").withColumn("cell_", F.expr(f"place div {cell}L"))
        cells = spans.selectExpr("sid", "lo", "hi", "quota", *more, f"explode(sequence(lo div {cell}L, (hi - 1) div {cell}L)) AS cell")
        return points.join(cells, F.expr("cell_ = cell AND place >= lo AND place < hi")).select("slot", "sid", "quota", *more)

    hit = materialize(falling(0, slots, spans).withColumn("chunk", F.expr(f"slot div {chunk}L")), "slots")
    totals = hit.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = prefix_sums(totals, "sid", "chunk", "n", -(-slots // chunk)).select(F.col("sid").alias("s_"), F.col("chunk").alias("c_"), "before")
    local = hit.withColumn("rank", F.row_number().over(W.partitionBy("sid", "chunk").orderBy("slot")) - 1)
    ranked = local.join(before, F.expr("sid = s_ AND chunk = c_")).select("slot", "sid", (F.col("rank") + F.col("before")).alias("rank"), "quota").filter("rank < quota").select("slot", "sid", "rank")
    had = totals.groupBy("sid").agg(F.sum("n").alias("had")).withColumnRenamed("sid", "s_")
    # a span of q of N places is met again within 2 * (N / q + 1) slots of a golden-ratio sequence, so these ends are far enough
    lacking = spans.join(had, F.expr("sid = s_"), "left").withColumn("had", F.coalesce("had", F.lit(0))).filter("had < quota")
    lacking = materialize(lacking.select("sid", "lo", "hi", "quota", "had", F.expr(f"{slots} + (quota - had) * 4 * ({slots} div quota + 1)").alias("upto")), "lacking")
    end = lacking.agg(F.max("upto")).first()[0] or slots
    further = falling(slots, end, lacking, "had", "upto").filter("slot < upto")
    further = further.withColumn("rank", F.col("had") + F.row_number().over(W.partitionBy("sid").orderBy("slot")) - 1).filter("rank < quota")
    return ranked.unionByName(further.select("slot", "sid", "rank"))


def layout(rows: DataFrame) -> DataFrame:
    """rid_, sid, size, source_size, target and at: the words of its source before the row in the shuffled order.

    `rows` has rid_, h (hex digest), sid, size, source_size and target.
    """
    most = rows.groupBy("sid").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    digits = 0
    while 16**digits * BUCKET < most and digits < 12:
        digits += 1
    dealt = rows.withColumn("bucket", F.expr(f"CAST(conv(substring(h, 1, {digits}), 16, 10) AS bigint)") if digits else F.lit(0).cast("bigint"))
    sums = dealt.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    before = prefix_sums(sums, "sid", "bucket", "n", 16**digits).select(F.col("sid").alias("s_"), F.col("bucket").alias("b_"), "before")
    by = W.partitionBy("sid", "bucket").orderBy("h", "rid_").rowsBetween(W.unboundedPreceding, 0)
    local = dealt.withColumn("upto", F.sum("size").over(by))
    return local.join(before, F.expr("sid = s_ AND bucket = b_")).select("rid_", "sid", "size", "source_size", "target", (F.col("before") + F.col("upto") - F.col("size")).alias("at"))


def mixture(rows: DataFrame, sources: DataFrame, block: int = BLOCK, cap: int = CAP) -> DataFrame:
    """(slot, sid, rank, rid_, pass, from_word, to_word): what each slot takes, in schedule order by slot."""
    passes = layout(rows.filter("size > 0")).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(cap - 1)))).withColumn("a", F.col("at") + F.col("pass") * F.col("source_size"))
    reached = passes.withColumn("b", F.least(F.col("a") + F.col("size"), F.floor("target"))).filter("a < b")
    cut = reached.withColumn("k", F.expr(f"explode(sequence(a div {block}L, (b - 1) div {block}L))")).selectExpr(
        "sid AS s_", "k", "rid_", "pass", f"greatest(k * {block} - a, 0) AS from_word", f"least((k + 1) * {block}, b) - a AS to_word")
    slots = schedule(sources, block)
    return slots.join(cut, F.expr("sid = s_ AND rank = k")).select("slot", "sid", "rank", "rid_", "pass", "from_word", "to_word")


def _measured(docs: DataFrame, doc_id: str, source: str, text: str, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with the kept columns, rid_, source, h and size; the same without texts but with targets; the sources."""
    digest = f"md5(concat(coalesce(CAST({doc_id} AS string), ''), ':', coalesce({text}, '')))"
    rows = materialize(docs.select(*keep, F.monotonically_increasing_id().alias("rid_"), F.col(source).alias("source"), F.expr(digest).alias("h"), F.expr(word_count(text)).alias("size")), "mix-rows")
    sizes = materialize(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sizes")
    sources = materialize(targets(sizes), "mix-sources")
    light = rows.select("rid_", *[c for c in keep if c == "doc_id"], "source", "h", "size")
    return rows, small_or_salted_join(light, sources, ["source"]), sources


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot (null: not taken) and pieces (block pieces taken) for each row."""
    _, light, sources = _measured(pick(docs, "doc_id", "source", "text"), "doc_id", "source", "text", ["doc_id"])
    taken = mixture(light, sources).groupBy(F.col("rid_").alias("r_")).agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("pieces"))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return light.join(taken, F.expr("rid_ = r_"), "left").select("doc_id", "size", "source_size", "target", none("taken"), "first_slot", none("pieces"))


def mix_documents(docs: DataFrame, slot: str | None = None) -> DataFrame:
    """The mixture as documents: a row for each pass in which a document is taken, with all its columns.

    A document taken in part (where its source meets its target) has the taken words, joined by single spaces; n_chars,
    if there, counts anew. Rows of each partition are in schedule order, so every partition is a slice of the mixture,
    dealt by hash, that follows the schedule. With `slot` a column of that name says where the row begins in it.
    """
    frame, (doc_id, source, text) = numbered(docs, "doc_id", "source", "text")
    rows, light, sources = _measured(frame, doc_id, source, text, frame.columns)
    taken = mixture(light, sources).groupBy(F.col("rid_").alias("r_"), "pass").agg(F.min("from_word").alias("from_"), F.max("to_word").alias("to_"), F.min("slot").alias("slot_"))
    out = rows.join(taken, F.expr("rid_ = r_"))
    whole = F.expr("from_ = 0 AND to_ = size")
    part = F.expr(f"array_join(slice(split(trim(BOTH ' \\t\\n\\u000b\\u000c\\r' FROM {text}), '[ \\\\t-\\\\r]+'), CAST(from_ + 1 AS int), CAST(to_ - from_ AS int)), ' ')")
    out = out.withColumn(text, F.when(whole, F.col(text)).otherwise(part))
    if "n_chars" in docs.columns:
        n = f"c{docs.columns.index('n_chars')}_"
        out = out.withColumn(n, F.when(whole, F.col(n)).otherwise(F.length(text).cast(frame.schema[n].dataType)))
    out = out.sortWithinPartitions("slot_", "rid_", "pass")
    return out.select(*frame.columns, *(["slot_"] if slot else [])).toDF(*docs.columns, *([slot] if slot else []))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(read_table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, CAST([{', '.join(map(str, WEIGHTS))}][sid % {len(WEIGHTS)} + 1] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * {CAP} AS cap FROM s),
l AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * {SHARE} - coalesce(sum(cap) OVER (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, row_number() OVER (ORDER BY cap / weight, sid) AS k FROM w),
f AS (SELECT arg_min(level, k) AS found FROM l WHERE level * weight <= cap),
t AS (SELECT sid, source, source_size, least(cap, coalesce(found * weight, cap)) AS target FROM l, f),
q AS (SELECT sid, CAST(ceil(floor(target) / {BLOCK}) AS BIGINT) AS quota FROM t),
c AS (SELECT sid, quota, sum(quota) OVER (ORDER BY sid) AS hi FROM q WHERE quota > 0),
n AS (SELECT CAST(coalesce(max(hi), 0) AS BIGINT) AS slots FROM c),
g AS (SELECT i AS slot, least(CAST(floor(CAST(CAST((CAST(i AS HUGEINT) * {_GOLD}) % {1 << 61} AS BIGINT) AS DOUBLE) / {float(1 << 61)} * slots) AS BIGINT), slots - 1) AS place
  FROM (SELECT unnest(range(4 * slots + 16)) AS i, slots FROM n)),
r AS (SELECT slot, sid, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank, quota FROM g JOIN c ON place >= hi - quota AND place < hi),
x AS (SELECT d.*, sid, source_size, target, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT rn, sid, a, CAST(least(a + size, floor(target)) AS BIGINT) AS b FROM (SELECT rn, sid, size, target, unnest([pos + p * source_size for p in range({CAP})]) AS a FROM x WHERE size > 0)),
z AS (SELECT rn, sid, a, b, unnest(range(a // {BLOCK}, (b - 1) // {BLOCK} + 1)) AS k FROM y WHERE a < b),
m AS (SELECT rn, CAST(sum(least((k + 1) * {BLOCK}, b) - greatest(k * {BLOCK}, a)) AS BIGINT) AS taken, min(slot) AS first_slot, count(*) AS pieces
  FROM z JOIN r ON z.sid = r.sid AND z.k = r.rank WHERE rank < quota GROUP BY rn)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, first_slot, coalesce(pieces, 0) AS pieces FROM x LEFT JOIN m USING (rn)
"""
