"""Labelled figures in text lines, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text, words

# Figures, most specific first, and the shapes around them.
MONEY = r"\$\s?\d[\d,]*(?:\.\d+)?\s?(?:million|billion|trillion|M|B|K|k)?"
PERCENT = r"\d+(?:\.\d+)?\s?%"
DURATION = r"\d+(?:\.\d+)?\s?(?:ms|seconds?|secs?|minutes?|mins?|hours?|hrs?|days?|weeks?|months?|years?)\b"
RATIO = r"\d+(?:\.\d+)?\s?[x×]\b"
COUNT = r"\b\d[\d,]*(?:\.\d+)?\b"
FIGURE = f"{MONEY}|{PERCENT}|{DURATION}|{RATIO}|{COUNT}"
LIST_MARKER = r"^\s*\d+[.)]\s"
INLINE_LABEL = r"([A-Za-z][A-Za-z0-9 \-/&]{1,40}?)\s*:\s*\**\s*$"
LABEL_WORD = r"([A-Za-z][A-Za-z\-/&]+)"
MARK = "\x01"


def parse_number(raw: Column) -> Column:
    """The value of a figure: number words and a k multiply, other suffixes don't; null without digits."""
    s = F.lower(F.trim(raw))
    factor, rest = F.lit(1.0), s
    for word, by in reversed((("trillion", 1e12), ("billion", 1e9), ("million", 1e6), ("thousand", 1e3))):
        hit = s.rlike(rf"\b{word}\b")
        factor, rest = F.when(hit, F.lit(by)).otherwise(factor), F.when(hit, F.regexp_replace(s, rf"\b{word}\b", " ")).otherwise(rest)
    clean = F.replace(rest, F.lit(","), F.lit(""))
    number = F.regexp_extract(clean, r"(-?\d+(?:\.\d+)?)", 1)
    thousand = F.regexp_extract(clean, r"-?\d+(?:\.\d+)?(k?)", 1) == "k"
    return F.when(number != "", number.try_cast("double") * factor * F.when(thousand, 1e3).otherwise(1.0))


def kind(raw: Column) -> Column:
    """Which alternative a figure is, from its own form."""
    return (
        F.when(raw.startswith("$"), "money").when(raw.rlike(f"^{PERCENT}$"), "percent").when(raw.rlike(f"^(?:{DURATION})$"), "duration")
        .when(raw.rlike(r"[x×]$"), "ratio").otherwise("count")
    )


def figures(sections: DataFrame) -> DataFrame:
    """(doc_id, sec_idx, line, pos, raw, kind, label) of all figures that pass the filters, from (doc_id, sec_idx, text)."""
    line = sections.select("doc_id", "sec_idx", F.posexplode(text.lines(F.col("text"))).alias("line", "s"))
    line = line.filter(F.col("s").rlike(r"\d"))
    # the marks cut each line into text, figure, text, figure, ...: a figure's left context is all pieces before it
    cut = F.split(F.regexp_replace(F.replace(F.col("s"), F.lit(MARK), F.lit(" ")), f"({FIGURE})", f"{MARK}$1{MARK}"), MARK, -1)
    pieces = line.withColumn("p", cut)
    one = pieces.select("doc_id", "sec_idx", "line", "s", "p", F.explode(F.sequence(F.lit(1), F.greatest(F.size("p") - 1, F.lit(1)), F.lit(2))).alias("i")).filter(F.col("i") < F.size("p"))
    one = one.select("doc_id", "sec_idx", "line", "s", F.array_join(F.slice("p", F.lit(1), F.col("i")), "").alias("left"), F.trim(F.get("p", F.col("i"))).alias("raw"))
    one = one.withColumn("pos", F.length("left"))
    # filters are pushed below projections and their inputs computed again there, so they use the cheapest forms
    bare = F.col("raw").rlike(r"^[0-9,.]+$")
    listed = F.length(F.regexp_extract("s", f"({LIST_MARKER})", 1)) > F.col("pos")
    last_word = F.element_at(F.split(F.rtrim(F.col("left")), r"\s+"), -1)
    acronym = F.regexp_replace(last_word, "^[.,]+|[.,]+$", "").rlike("^[A-Z]{2,}$")
    value = F.replace("raw", F.lit(","), F.lit("")).try_cast("double")
    year = bare & F.coalesce((value >= 1900) & (value <= 2099), F.lit(False)) & ~F.contains("raw", F.lit("."))
    one = one.filter(~listed & ~F.col("left").rlike("[A-Za-z]-?$") & ~acronym & ~year)
    # the label's pattern retries at every letter, so it only runs where a colon ends the left context
    inline = F.when(F.col("left").rlike(r":\s*\**\s*$"), F.regexp_extract(F.regexp_replace(F.col("left"), r"\s+$", ""), INLINE_LABEL, 1)).otherwise(F.lit(""))
    every = F.regexp_extract_all("left", F.lit(LABEL_WORD), 1)
    own = F.filter(every, lambda w: ~F.array_contains(text.strings(words.LABEL_FILLERS), F.lower(w)))
    spelled = F.array_join(F.slice(own, F.greatest(F.size(own) - 3, F.lit(1)), F.lit(4)), " ")
    label = F.when(inline != "", F.regexp_replace(inline, r"^[ *(]+|[ *(]+$", "")).otherwise(F.trim(spelled))
    one = one.withColumn("label", label).withColumn("inline", inline != "").withColumn("words", every).filter(F.col("label") != "")
    reference = F.array_contains(text.strings(words.REFERENCE_WORDS), F.lower(F.coalesce(F.try_element_at("words", F.lit(-1)), F.lit(""))))
    name = ~F.contains("label", F.lit(" ")) & F.col("label").rlike(r"^\p{Lu}")
    noise = bare & ~F.col("inline") & (reference | name)
    return one.filter(~noise).select("doc_id", "sec_idx", "line", "pos", "raw", kind(F.col("raw")).alias("kind"), "label")


def key_numbers(sections: DataFrame, limit: int = 64) -> DataFrame:
    """(doc_id, kn_idx, sec_idx, label, value, unit): the first of each label and figure in a section, `limit` a document.

    The limit is the feature: it bounds what a document shows. Ranks are by document; figures are few beside text.
    """
    found = figures(sections).withColumn("low", F.lower("label"))
    first = found.groupBy("doc_id", "sec_idx", "low", "raw").agg(F.min(F.struct("line", "pos", "label", "kind")).alias("m"))
    unit = F.when(F.col("m.kind") == "percent", "%").when(F.col("raw").startswith("$"), "USD")
    rows = first.select("doc_id", "sec_idx", "m.line", "m.pos", "m.label", F.col("raw").alias("value"), unit.alias("unit"))
    rank = F.row_number().over(W.partitionBy("doc_id").orderBy("sec_idx", "line", "pos"))
    return rows.withColumn("n_", rank).filter(F.col("n_") <= limit).select("doc_id", (F.col("n_") - 1).alias("kn_idx"), "sec_idx", "label", "value", "unit")
