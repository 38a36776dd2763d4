"""Judging answers against references, and the aggregates of a report."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text, words

# Relative tolerance of numbers, and the score for each band of the blend.
TOLERANCE = 0.06
BANDS = ((0.70, 10), (0.55, 9), (0.40, 8), (0.28, 7), (0.18, 6), (0.10, 5), (0.04, 3))


def _plain(s: Column) -> Column:
    """Without commas, and without spaces before groups of three digits."""
    return F.regexp_replace(F.replace(s, F.lit(","), F.lit("")), r"(?<=\d)\s+(?=\d{3}\b)", "")


def _numbers(s: Column) -> Column:
    return F.regexp_extract_all(_plain(s), F.lit(r"(\b\d[\d.]*)"), 1)


def _close(a: Column, b: Column) -> Column:
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) / F.greatest(F.abs(x), F.lit(0.001)) < TOLERANCE).otherwise(a == b)


def _ratio(hits: Column, n: Column) -> Column:
    return hits / F.greatest(n, F.lit(1)).cast("double")


def local_scores(answers: DataFrame) -> DataFrame:
    """Adds num_ratio, kw_ratio, phrase_ratio and score (0 to 10) to rows with candidate and reference."""
    clean = lambda c: F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"^\s+|\s+$", "")
    rows = answers.withColumn("c_", clean("candidate")).withColumn("r_", clean("reference"))
    rows = rows.withColumn("rn_", _numbers(F.regexp_replace("r_", r"§\s*[\d.]+|\bsection\s+[\d.]+", " "))).withColumn("cn_", _numbers(F.col("c_")))
    recall = _ratio(F.size(F.filter("rn_", lambda a: F.exists("cn_", lambda b: _close(a, b)))), F.size("rn_"))
    result = F.regexp_extract("r_", r"=\s*([\d][\d, ]*\d|\d)", 1)
    result_hit = (result != "") & F.exists("cn_", lambda b: _close(_plain(result), b))
    tokens = lambda c: F.filter(F.split(F.regexp_replace(c, "[^a-z0-9]", " "), " +"), lambda w: w != "")
    wanted = F.array_distinct(F.filter(tokens(F.col("r_")), lambda w: (F.length(w) > 2) & ~F.array_contains(text.strings(words.RETRIEVAL_STOP), w)))
    phrases = F.filter(F.transform(F.split("r_", r"[;|:\-–]", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: (F.length(p) > 4) & (F.length(p) < 60))
    rows = rows.withColumn("num_ratio", F.greatest(recall, F.when(result_hit, 1.0).otherwise(0.0)))
    rows = rows.withColumn("kw_ratio", _ratio(F.size(F.array_intersect(wanted, tokens(F.col("c_")))), F.size(wanted)))
    rows = rows.withColumn("phrase_ratio", _ratio(F.size(F.filter(phrases, lambda p: F.contains(F.col("c_"), p))), F.size(phrases)))
    blend = 0.50 * F.col("num_ratio") + 0.30 * F.col("kw_ratio") + 0.20 * F.col("phrase_ratio")
    band = F.lit(0)
    for least, score in reversed(BANDS):
        band = F.when(blend >= least, score).otherwise(band)
    missed = (F.col("c_") == "") | F.col("c_").startswith("not found in context") | F.col("c_").startswith("not found in the context")
    score = (
        F.when(missed, 0).when((F.col("num_ratio") >= 0.75) & (F.col("kw_ratio") >= 0.45), 10).when((F.size("rn_") == 0) & (F.col("kw_ratio") >= 0.60), 10)
        .when((F.size("rn_") == 0) & (F.col("kw_ratio") >= 0.40), 9).otherwise(band)
    )
    return rows.withColumn("score", score).drop("c_", "r_", "rn_", "cn_")


def parse_verdict(reply: Column) -> Column:
    """struct(score, reason) of a model's reply: the last SCORE line with a number from 0 to 10, 5 without any."""
    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), r"[\r\n]", -1), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    scores = F.filter(F.transform(F.filter(lines, lambda s: F.upper(s).startswith("SCORE")), lambda s: F.regexp_extract(s, r"\b([0-9]|10)\b", 1)), lambda s: s != "")
    reasons = F.filter(lines, lambda s: F.upper(s).startswith("REASONING"))
    last = F.try_element_at(reasons, F.lit(-1))
    reason = F.when(F.contains(last, F.lit(":")), F.trim(F.regexp_replace(last, r"^[^:]*:", ""))).otherwise(last)
    return F.struct(F.coalesce(F.try_element_at(scores, F.lit(-1)).cast("int"), F.lit(5)).alias("score"), F.coalesce(reason, F.lit("parse error")).alias("reason"))


PROMPT = """Compare an answer with the true one and grade its facts from 0 to 10.
Be generous with rounded numbers and with wording; 10 is right in full, 8 or 9 misses little, 6 misses key facts, 4 or less is mostly wrong, 0 is made up.

Question: {question}
True answer: {reference}
Answer: {candidate}

Reply with two lines:
SCORE: <0 to 10>
REASONING: <one sentence>"""


def model_scores(answers: DataFrame, complete) -> DataFrame:
    """Adds score and reason by a model (prompt -> text) to rows with question, candidate and reference."""

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return prompts.map(complete)

    filled = F.lit(PROMPT)
    for name in ("question", "reference", "candidate"):
        filled = F.replace(filled, F.lit("{" + name + "}"), F.coalesce(F.col(name), F.lit("")))
    verdict = parse_verdict(ask(filled))
    return answers.withColumn("v_", verdict).select("*", "v_.score", "v_.reason").drop("v_")


def report(scores: DataFrame) -> DataFrame:
    """(phase, file, n, avg_score, hit_rate): for each file, each phase and all; a hit scores 7 or more."""
    rows = scores.rollup("phase", "file").agg(F.count("*").alias("n"), F.avg(F.coalesce("score", F.lit(0))).alias("avg_score"), F.avg((F.coalesce("score", F.lit(0)) >= 7).cast("double")).alias("hit_rate"))
    return rows


def render_report(rows: list) -> str:
    """Markdown of collected report rows: one table, phases in bold."""
    shown = ["| Phase | File | Questions | Average | Hits |", "|---|---|---|---|---|"]
    for r in sorted(rows, key=lambda r: (r["phase"] is None, r["phase"] or "", r["file"] is None, r["file"] or "")):
        name = r["file"] or ("**overall**" if r["phase"] else "**all**")
        shown.append(f"| {r['phase'] or ''} | {name} | {r['n']} | {r['avg_score']:.1f}/10 | {r['hit_rate']:.0%} |")
    return "\n".join(shown)
