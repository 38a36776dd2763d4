"""Operator 4: quality rules whose thresholds come from mergeable quantile sketches (built-in functions only).

Each document gets integer metrics. Every metric of every (lang, source) group is summarised by a sketch of log-linear
buckets with counts: two sketches merge by adding counts, so they are plain hash aggregations with map-side combining,
give the same result in any order, and have at most a few hundred buckets whatever the input. Sketches of small groups
are merged into those of their language, and those into the whole. Tukey fences (quartiles plus or minus a multiple of
the quartile distance) read from the sketches replace fixed cutoffs; documents join their group's fences and are kept
if every metric is inside.

Lines are those between line feeds of the text as it stands: a carriage return or white space at a line's edges belongs to
it, so lines that differ there are different lines. Windows of words are compared word by word.

Defined cases: null text counts as empty and fails the base rule; a null lang or source is a group of its own; a very long
text is measured whole, in one task, which holds its words and one hash and index for each; a value on a fence is inside,
and equal values share a bucket, so ties are judged alike; repeated rows are judged one by one; an empty table gives an
empty result; further columns, also of clashing names, are ignored by the rules and kept by the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import SPACES, materialize, numbered, pick, read_table, small_or_salted_join

#: Fence width in quartile distances.
FENCE = 3
#: Groups with fewer documents use their language's merged sketch, and languages with fewer the whole corpus's.
MIN_GROUP = 200
#: Metric: (least distance of a fence from its quartile, whether there is a lower fence too). Rates are per 10,000.
METRICS = {"word_length": (200, True), "symbol_rate": (500, False), "upper_rate": (3000, False), "dup_line_rate": (6000, False), "repeat_rate": (3000, False)}
SUB_BITS = 5


def repeat_words(words: str) -> str:
    """SQL for the number of words that stand in a three-word window found twice or more in the array `words`.

    A 64-bit hash finds the texts that may have one: equal windows have equal hashes. Only those take the sorting branch,
    which orders windows by hash, then words, and compares the words themselves.
    """

    def same(x: str, y: str) -> str:
        return "(" + " AND ".join(f"{x}.{c} = {y}.{c}" for c in "habc") + ")"

    return f"""
    CASE WHEN size({words}) < 3 THEN 0 ELSE
      transform(array(transform(sequence(0, size({words}) - 3), i -> xxhash64({words}[i], {words}[i + 1], {words}[i + 2]))), hs ->
        CASE WHEN size(array_distinct(hs)) = size(hs) THEN 0 ELSE
          transform(array(sort_array(transform(hs, (h, i) -> struct(h AS h, {words}[i] AS a, {words}[i + 1] AS b, {words}[i + 2] AS c, i AS i)))), s ->
            size(array_distinct(flatten(transform(
              filter(s, (x, j) -> {same("x", "get(s, j - 1)")} OR {same("x", "get(s, j + 1)")}),
              x -> array(x.i, x.i + 1, x.i + 2)))))
          )[0]
        END
      )[0]
    END"""


def metrics(df: DataFrame, text: str) -> DataFrame:
    """The frame with n_words, word_chars, n_symbols, n_upper, n_lines, n_dup_lines and n_repeat_words of column `text`."""
    spaces = "".join({" ": " ", "\t": "\\t", "\n": "\\n", "\r": "\\r"}.get(c, f"\\u{ord(c):04x}") for c in SPACES)
    t = f"coalesce({text}, '')"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    per_text = f"""
    transform(array({t}), t ->
      transform(array(filter(split(t, '[ \\\\t-\\\\r]+'), v -> v <> '')), w ->
        transform(array(filter(split(t, '\\\\n'), l -> l RLIKE '[^ \\\\t-\\\\r]')), ls -> named_struct(
          'n_words', CAST(size(w) AS bigint),
          'word_chars', CAST(length(translate(t, '{spaces}', '')) AS bigint),
          'n_symbols', CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS bigint),
          'n_upper', CAST(length(t) - length(translate(t, '{upper}', '')) AS bigint),
          'n_lines', CAST(size(ls) AS bigint),
          'n_dup_lines', CAST(size(ls) - size(array_distinct(ls)) AS bigint),
          'n_repeat_words', CAST({repeat_words('w')} AS bigint)))[0]
      )[0]
    )[0]"""
    return df.withColumn("m_", F.expr(per_text)).select("*", "m_.*").drop("m_")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def rates() -> dict[str, str]:
    """SQL of each metric as a non-negative integer, null where it doesn't apply."""
    return {
        "word_length": "word_chars * 100 div nullif(n_words, 0)",
        "symbol_rate": "n_symbols * 10000 div nullif(word_chars, 0)",
        "upper_rate": "n_upper * 10000 div nullif(word_chars, 0)",
        "dup_line_rate": "n_dup_lines * 10000 div nullif(n_lines, 0)",
        "repeat_rate": "n_repeat_words * 10000 div nullif(n_words, 0)",
    }


def bucket(value: Column) -> Column:
    """Index of the log-linear bucket of a non-negative integer: exact below 64, then 32 buckets for each doubling."""
    shift = F.greatest(F.length(F.bin(value)) - (SUB_BITS + 1), F.lit(0))
    return (shift * (1 << SUB_BITS) + F.call_function("shiftright", value, shift.cast("int")).cast("int")).cast("int")


def bucket_value(index: Column) -> Column:
    """The least value of a bucket."""
    shift = F.greatest(F.floor(index / (1 << SUB_BITS)).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (index - shift * (1 << SUB_BITS)).cast("bigint"), shift)


def sketch(docs: DataFrame) -> DataFrame:
    """Mergeable sketches of all metrics: lang, source, metric, bucket, n. To merge, sum n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(sql).alias("value")) for m, sql in rates().items()]))
    return (
        docs.select("lang", "source", pairs.alias("p")).select("lang", "source", "p.metric", bucket(F.col("p.value")).alias("bucket"))
        .filter("bucket IS NOT NULL").groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))
    )


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Count and quartiles of each sketch, read from counts summed in bucket order.

    A window holds one sketch's buckets, a few hundred rows at most whatever the input.
    """
    from pyspark.sql import Window as W

    by = W.partitionBy(*keys, "metric")
    merged = sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    run = merged.withColumn("upto", F.sum("n").over(by.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(by))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    return run.groupBy(*keys, "metric").agg(F.max("total").alias("total"), bucket_value(at(1)).alias("q1"), bucket_value(at(3)).alias("q3"))


def fences(sketches: DataFrame, min_group: int = MIN_GROUP, fence: int = FENCE) -> DataFrame:
    """lang, source and, for each metric, lo_<metric> and hi_<metric>; one row for each group of documents."""
    spark = sketches.sparkSession
    own = quantiles(sketches, ["lang", "source"])
    lang = quantiles(sketches, ["lang"]).toDF("l_lang", "l_metric", "l_total", "l_q1", "l_q3")
    whole = quantiles(sketches, []).toDF("w_metric", "w_total", "w_q1", "w_q3")
    slack = spark.createDataFrame([(m, s, low) for m, (s, low) in METRICS.items()], "s_metric string, slack int, low boolean")
    x = own.join(lang, own["lang"].eqNullSafe(lang["l_lang"]) & (own["metric"] == lang["l_metric"])).join(F.broadcast(whole), F.col("metric") == F.col("w_metric")).join(F.broadcast(slack), F.col("metric") == F.col("s_metric"))
    for q in ("q1", "q3"):
        x = x.withColumn(q, F.when(F.col("total") >= min_group, F.col(q)).when(F.col("l_total") >= min_group, F.col(f"l_{q}")).otherwise(F.col(f"w_{q}")))
    width = F.greatest((F.col("q3") - F.col("q1")) * fence, F.col("slack"))
    x = x.withColumn("lo", F.when(F.col("low"), F.col("q1") - width)).withColumn("hi", F.col("q3") + width)
    pick_of = lambda m, c: F.max(F.when(F.col("metric") == m, F.col(c)))
    return x.groupBy("lang", "source").agg(*[pick_of(m, c).alias(f"{c}_{m}") for m in METRICS for c in ("lo", "hi")])


def verdict() -> Column:
    """Whether every metric is inside its fences; a metric that doesn't apply or has no fence passes."""
    ok = ~base_failed()
    for m, sql in rates().items():
        v = F.expr(sql)
        ok = ok & F.coalesce(v <= F.col(f"hi_{m}"), F.lit(True)) & F.coalesce(v >= F.col(f"lo_{m}"), F.lit(True))
    return ok


def quality_rules(docs: DataFrame, min_group: int = MIN_GROUP, fence: int = FENCE) -> DataFrame:
    """doc_id, the metrics, base_failed and kept for each document.

    The metrics (a few dozen bytes a document, without texts) are written to the shared folder, as both the sketches
    and the joined filtering read them.
    """
    measured = materialize(metrics(pick(docs, "doc_id", "lang", "source", "text"), "text").drop("text"), "quality")
    limits = materialize(fences(sketch(measured), min_group, fence), "fences")
    judged = small_or_salted_join(measured, limits, ["lang", "source"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), verdict().alias("kept"), "lang", "source", "n_upper", "n_lines")


def quality_filter(docs: DataFrame, min_group: int = MIN_GROUP, fence: int = FENCE) -> DataFrame:
    """The documents that are kept, with all their columns.

    Documents and metrics are written together once, so that texts are measured once and rows need no key.
    """
    frame, (lang, source, text) = numbered(docs, "lang", "source", "text")
    measured = materialize(metrics(frame, text), "quality-docs")
    renamed = measured.withColumn("lang", F.col(lang)).withColumn("source", F.col(source))
    limits = materialize(fences(sketch(renamed), min_group, fence), "fences")
    kept = small_or_salted_join(renamed, limits, ["lang", "source"]).filter(verdict())
    return kept.select(*frame.columns).toDF(*docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _measured_sql(table: str = "documents") -> str:
    """DuckDB SQL of the metrics, row by row with the row's number, so that repeated rows stay apart."""
    return f"""
rows_ AS (SELECT row_number() OVER () AS rn, doc_id, lang, source, coalesce(text, '') AS t FROM {table}),
words_ AS (SELECT rn, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w FROM rows_),
win_ AS (SELECT rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM words_ WHERE len(w) >= 3)),
dup_ AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, s) AS c FROM win_) WHERE c > 1),
rep_ AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest([i, i + 1, i + 2]) AS p FROM dup_) GROUP BY rn),
lines_ AS (SELECT rn, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT rn, unnest(string_split(t, chr(10))) AS l FROM rows_) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rn),
measured_ AS (SELECT r.rn, doc_id, lang, source, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM rows_ r JOIN words_ USING (rn) LEFT JOIN rep_ USING (rn) LEFT JOIN lines_ USING (rn))"""


def _judged_sql(min_group: int = MIN_GROUP, fence: int = FENCE) -> str:
    rate = {m: s.replace(" div ", " // ") for m, s in rates().items()}
    long = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {s} AS v FROM measured_" for m, s in rate.items())
    values = ", ".join(f"('{m}', {s}, {str(low).lower()})" for m, (s, low) in METRICS.items())

    def quant(name: str, keys: str) -> str:
        part, lead = (f"PARTITION BY {keys}, metric", f"{keys}, ") if keys else ("PARTITION BY metric", "")
        shift = "greatest(b // 32 - 1, 0)"
        return f"""
{name} AS (SELECT {lead}metric, max(total) AS total, min(CASE WHEN upto * 4 >= total THEN e END) AS q1, min(CASE WHEN upto * 4 >= total * 3 THEN e END) AS q3 FROM (
  SELECT {lead}metric, (b - {shift} * 32) << {shift} AS e, sum(n) OVER ({part} ORDER BY b) AS upto, sum(n) OVER ({part}) AS total
  FROM (SELECT {lead}metric, b, sum(n) AS n FROM sketch_ GROUP BY ALL)) GROUP BY {lead}metric)"""

    inside = " AND ".join(f"coalesce({s} <= hi_{m}, true) AND coalesce({s} >= lo_{m}, true)" for m, s in rate.items())
    columns = ", ".join(f"max(CASE WHEN metric = '{m}' THEN {c} END) AS {c}_{m}" for m in METRICS for c in ("lo", "hi"))
    return f"""
long_ AS ({long}),
sketch_ AS (SELECT lang, source, metric, greatest(length(bin(v)) - 6, 0) * 32 + (v >> greatest(length(bin(v)) - 6, 0)) AS b, count(*) AS n FROM long_ WHERE v IS NOT NULL GROUP BY ALL),
{quant('own_', 'lang, source')},{quant('lang_', 'lang')},{quant('whole_', '')},
slack_ AS (SELECT * FROM (VALUES {values}) AS x(metric, slack, low)),
best_ AS (SELECT o.lang, o.source, o.metric, slack, low,
  CASE WHEN o.total >= {min_group} THEN o.q1 WHEN l.total >= {min_group} THEN l.q1 ELSE w.q1 END AS q1,
  CASE WHEN o.total >= {min_group} THEN o.q3 WHEN l.total >= {min_group} THEN l.q3 ELSE w.q3 END AS q3
  FROM own_ o JOIN lang_ l ON o.lang IS NOT DISTINCT FROM l.lang AND o.metric = l.metric JOIN whole_ w ON o.metric = w.metric JOIN slack_ s ON o.metric = s.metric),
edge_ AS (SELECT lang, source, metric, CASE WHEN low THEN q1 - greatest((q3 - q1) * {fence}, slack) END AS lo, q3 + greatest((q3 - q1) * {fence}, slack) AS hi FROM best_),
fences_ AS (SELECT lang, source, {columns} FROM edge_ GROUP BY lang, source),
judged_ AS (SELECT m.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {inside} AS kept
  FROM measured_ m LEFT JOIN fences_ f ON m.lang IS NOT DISTINCT FROM f.lang AND m.source IS NOT DISTINCT FROM f.source)"""


ORACLE = f"WITH {_measured_sql()},{_judged_sql()}\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged_"
