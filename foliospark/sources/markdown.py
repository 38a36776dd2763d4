"""Markdown: ATX headings outside fences. As a table function with windows, and for single files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text as T
from foliospark.sources import names

HEADING = r"^(#{1,6})\s+(.+?)\s*$"
FENCE = r"^\s*(```|~~~)"
LINE_END = re.compile(r"\r\n|[\r\n\f\x85  ]")


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, sec_idx, title, level, text) from (doc_id, text, fallback, preamble): the titles of a document without
    headings and of text before the first one.

    A running count of fence lines tells whether a line is inside a fence, a running count of headings its section.
    """
    line = docs.select("doc_id", "fallback", "preamble", F.posexplode(F.when(F.size(T.lines(F.col("text"))) > 0, T.lines(F.col("text"))).otherwise(F.array(F.lit("")))).alias("n", "s"))
    upto = W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    is_fence = F.col("s").rlike(FENCE)
    line = line.withColumn("fences", F.sum(is_fence.cast("int")).over(upto))
    head = ~is_fence & (F.col("fences") % 2 == 0) & F.col("s").rlike(HEADING)
    line = line.withColumn("head", head).withColumn("sec", F.sum(head.cast("int")).over(upto))
    ordered = lambda c: F.array_sort(F.collect_list(F.struct("n", c)))
    grouped = line.groupBy("doc_id", "sec").agg(
        F.first("fallback").alias("fallback"), F.first("preamble").alias("preamble"), F.max(F.when(F.col("head"), F.col("s"))).alias("h"), ordered(F.when(~F.col("head"), F.col("s")).alias("s")).alias("body"),
    )
    body = F.regexp_replace(F.array_join(F.transform("body", lambda x: x["s"]), "\n"), r"^\s+|\s+$", "")
    rows = grouped.select("doc_id", "sec", "fallback", "preamble", body.alias("text"), F.regexp_extract("h", HEADING, 2).alias("title"), F.length(F.regexp_extract("h", HEADING, 1)).alias("level"))
    every = W.partitionBy("doc_id")
    rows = rows.withColumn("headings", F.max("sec").over(every))
    keep = (F.col("sec") > 0) | (F.col("text") != "") | (F.col("headings") == 0)
    rows = rows.filter(keep).withColumn("sec_idx", F.row_number().over(every.orderBy("sec")) - 1)
    title = F.when(F.col("sec") > 0, F.col("title")).when(F.col("headings") == 0, F.col("fallback")).otherwise(F.col("preamble"))
    return rows.select("doc_id", "sec_idx", title.alias("title"), F.when(F.col("sec") > 0, F.col("level")).otherwise(1).alias("level"), "text")


def parse(path: str, content: bytes) -> tuple[str, str, list[dict]]:
    """Title, format and sections of one file."""
    stem = names.stem(path)
    found: list[tuple[str, int]] = []
    bodies: list[list[str]] = [[]]
    fenced = False
    for line in LINE_END.split(content.decode("utf-8-sig", "replace")):
        if re.match(FENCE, line):
            fenced = not fenced
        elif not fenced and (m := re.match(HEADING, line)):
            found.append((m[2], len(m[1])))
            bodies.append([])
            continue
        bodies[-1].append(line)
    texts = ["\n".join(b).strip() for b in bodies]
    out = [{"title": t, "level": n, "text": x} for (t, n), x in zip(found, texts[1:])]
    if texts[0] or not found:
        lead = names.title_case(names.slug(path).replace("-", " ")) if found else stem
        out.insert(0, {"title": lead, "level": 1, "text": texts[0]})
    return next((t for t, n in found if n == 1), stem), "md", out
