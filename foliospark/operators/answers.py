"""Layered answers: what can be said without a language model first, prompts for what can't.

Joins are by question or document, whose tables may all be large, and Spark guesses them from the sizes of compressed files
as far too small. So they are hinted as merge joins; none is broadcast through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text, words
from foliospark.shared import shared_path

# Gates and prompt sizes.
L1, L2 = 0.6, 0.2
SECTION_CHARS, MULTI, MULTI_CHARS, FALLBACK, FALLBACK_CHARS, DOCUMENT_CHARS = 2500, 5, 1400, 8, 1600, 12000

#: What a model is told in layers 2, 3 and 4; {top} is the id of the best section.
TELL2 = "Answer from this section only; if it doesn't say, reply 'Not found in {top}'.\n\nSection {top}:\n"
TELL3 = "Answer from these sections of one document, taking them together; say that it is unavailable only if none of them tells."
TELL4 = "Answer from this part of a document as well as it allows; say that it is unavailable only if it truly can't be found."
ENUMERATE = " This question asks for a list: name every matching item that the sections hold and leave none out."


def confidence(question: Column, title: Column, keywords: Column, body: Column) -> Column:
    """Share of the question's content tokens that the section has; 0 without any."""
    long = lambda c: F.filter(text.alnum_tokens(c), lambda w: F.length(w) > 2)
    asked = text.content_tokens(question)
    have = F.concat(long(title), long(F.array_join(keywords, " ")), long(body))
    return F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(asked, have)) / F.size(asked).cast("double"))


def is_complex(question: Column) -> Column:
    return text.contains_any(F.trim(F.lower(question)), words.COMPLEX_MARKERS)


def is_refusal(answer: Column) -> Column:
    """Blank, or a marker of refusal among the first 160 characters."""
    head = F.lower(F.substring(F.coalesce(answer, F.lit("")), 1, 160))
    return F.coalesce(answer, F.lit("")).rlike(r"^\s*$") | text.contains_any(head, words.REFUSAL_MARKERS)


def enumeration_hint(question: Column) -> Column:
    return F.when(text.contains_any(F.trim(F.lower(question)), words.ENUMERATION_MARKERS), F.lit(ENUMERATE)).otherwise(F.lit(""))


def best_sentences(body: Column, question: Column, n: int = 2) -> Column:
    """The n sentences over 15 characters with most of the question's tokens, in text order; empty without any match."""
    sentences = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 15)
    score = lambda s, asked: F.size(F.filter(text.alnum_tokens(s), lambda w: F.array_contains(asked, w)))
    order = lambda asked: F.array_sort(F.transform(sentences, lambda s, i: F.struct((-score(s, asked)).alias("o"), i.alias("i"), s.alias("s"))))
    pick = lambda o: F.array_join(F.transform(F.array_sort(F.transform(F.slice(o, 1, n), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"]), " ")
    none = lambda o: (F.size(o) == 0) | (F.coalesce(F.get(o, F.lit(0))["o"], F.lit(0)) == 0)
    # arrays of one element hold what is used more than once: the question's tokens are not found again for every word
    ordered = F.transform(F.array(text.content_tokens(question)), order)
    return F.element_at(F.transform(ordered, lambda o: F.when(none(o), F.lit("")).otherwise(pick(o))), 1)


def match_key_numbers(questions: DataFrame, numbers: DataFrame) -> DataFrame:
    """(qid, label, value, unit, section) where one key number of the document answers the question.

    All core tokens of its label must be in the question; the most specific labels win; different values among them
    answer nothing. `numbers` has (doc_id, kn_idx, section, label, value, unit).
    """
    fillers, soft = text.strings(words.QUESTION_FILLERS), text.strings(words.SOFT_WORDS)
    plain = F.filter(text.singular_tokens(F.col("label")), lambda w: ~F.array_contains(fillers, w))
    hard = F.transform(F.array(plain), lambda p: F.struct(p.alias("p"), F.filter(p, lambda w: ~F.array_contains(soft, w)).alias("c")))
    # null without any token, which no question matches: a filter on the size would find the tokens once more
    core = F.element_at(F.transform(hard, lambda x: F.when(F.size(x["c"]) > 0, x["c"]).when(F.size(x["p"]) > 0, x["p"])), 1)
    labelled = numbers.withColumn("core", core)
    asked = questions.select("qid", F.col("doc_id").alias("d_"), text.singular_tokens(F.lower(F.col("question"))).alias("tokens"))
    both = labelled.join(asked.hint("merge"), F.expr("doc_id = d_")).filter(F.forall("core", lambda w: F.array_contains(F.col("tokens"), w)))
    top = F.rank().over(W.partitionBy("qid").orderBy(F.size("core").desc()))
    best = both.withColumn("r", top).filter("r = 1").groupBy("qid")
    one = best.agg(F.min("value").alias("a"), F.max("value").alias("b"), F.min(F.struct("kn_idx", "label", "value", "unit", "section")).alias("m"))
    return one.filter("a = b").select("qid", "m.label", "m.value", "m.unit", "m.section")


def layer0(questions: DataFrame, documents: DataFrame, numbers: DataFrame) -> DataFrame:
    """(qid, answer) from what a document already holds: summary, insights, then a key number.

    A question that names the summary or insights is not tried on what comes after. `documents` has (doc_id, summary,
    insights).
    """
    q = F.trim(F.lower(F.col("question")))
    docs = documents.select(F.col("doc_id").alias("d_"), "summary", "insights")
    rows = questions.join(docs.hint("merge"), F.expr("doc_id = d_"), "left").drop("d_")
    matched = match_key_numbers(questions.filter(~is_complex(F.col("question"))), numbers)
    shown = F.concat(F.col("label"), F.lit(": "), F.col("value"), F.when(F.coalesce(F.col("unit"), F.lit("")) != "", F.concat(F.lit(" "), F.col("unit"))).otherwise(F.lit("")), F.lit(" (source: "), F.col("section"), F.lit(")"))
    rows = rows.join(matched.select(F.col("qid").alias("q_"), shown.alias("number")).hint("merge"), F.expr("qid = q_"), "left")
    bullets = F.array_join(F.transform("insights", lambda i: F.concat(F.lit("• "), i)), "\n")
    answer = (
        F.when(text.contains_any(q, words.SUMMARY_MARKERS), F.when(F.col("summary") != "", F.col("summary")))
        .when(text.contains_any(q, words.INSIGHT_MARKERS), F.when(F.size("insights") > 0, bullets))
        .otherwise(F.col("number"))
    )
    return rows.select("qid", answer.alias("answer")).filter("answer IS NOT NULL")


def section_body(body: Column, tables: Column) -> Column:
    """The first SECTION_CHARS characters, then every table with bars between cells."""
    line = lambda r: F.concat(F.array_join(r, " | "), F.lit("\n"))
    shown = F.transform(tables, lambda t: F.concat(F.lit("\n\nTable "), t["table_id"], F.lit(":\n"), line(t["headers"]), F.array_join(F.transform(t["rows"], line), "")))
    return F.concat(F.substring(body, 1, SECTION_CHARS), F.coalesce(F.array_join(shown, ""), F.lit("")))


def prompts(hits: DataFrame, whole: DataFrame) -> DataFrame:
    """(qid, prompt2, prompt3, prompt4, cite2, cite3, cite4, confidence, n_hits) of every question.

    `hits` has (qid, question, rank, id, title, text, tables, confidence); `whole` (qid, question, full_text) has every
    question, for those without hits. At most FALLBACK rows of a question are gathered.
    """
    first = hits.filter(F.col("rank") < FALLBACK)
    part = lambda n: F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("title"), F.lit("\n"), F.substring("text", 1, n))
    listed = first.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", "id", part(MULTI_CHARS).alias("short"), part(FALLBACK_CHARS).alias("long")))).alias("h"),
        F.min_by(section_body(F.col("text"), F.col("tables")), "rank").alias("body"), F.min_by("id", "rank").alias("top"), F.min_by("confidence", "rank").alias("confidence"), F.count("*").alias("n_hits"),
    ).withColumnRenamed("qid", "q_")
    rows = whole.join(listed.hint("merge"), F.expr("qid = q_"), "left")
    question = F.concat(F.lit("\n\nQuestion: "), F.col("question"))
    joined = lambda n, field: F.array_join(F.transform(F.slice("h", 1, n), lambda x: x[field]), "\n\n")
    ids = lambda n: F.transform(F.slice("h", 1, n), lambda x: x["id"])
    hint = enumeration_hint(F.col("question"))
    two = F.concat(F.replace(F.lit(TELL2), F.lit("{top}"), F.col("top")), F.col("body"), question)
    three = F.concat(F.lit(TELL3), hint, F.lit("\n\n"), joined(MULTI, "short"), question)
    context = F.when(F.coalesce(F.col("n_hits"), F.lit(0)) > 0, joined(FALLBACK, "long")).otherwise(F.substring("full_text", 1, DOCUMENT_CHARS))
    four = F.concat(F.lit(TELL4), hint, F.lit("\n\n"), context, question)
    n = F.coalesce("n_hits", F.lit(0))
    return rows.select(
        "qid", F.when((n > 0) & (F.col("confidence") >= L2) & ~F.col("body").rlike(r"^\s*$"), two).alias("prompt2"), F.when(n >= 2, three).alias("prompt3"), four.alias("prompt4"),
        F.array("top").alias("cite2"), ids(MULTI).alias("cite3"), F.coalesce(ids(FALLBACK), F.array().cast("array<string>")).alias("cite4"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), n.alias("n_hits"),
    )


def layer1(hits: DataFrame) -> DataFrame:
    """(qid, answer, citations, confidence): the top section's summary or best sentences, where it is sure enough.

    `hits` has (qid, question, rank, id, text, summary, confidence).
    """
    top = hits.filter((F.col("rank") == 0) & (F.col("confidence") >= L1) & ~is_complex(F.col("question")))
    answer = F.when(F.coalesce("summary", F.lit("")) != "", F.col("summary")).otherwise(best_sentences(F.col("text"), F.col("question")))
    return top.select("qid", answer.alias("answer"), F.array("id").alias("citations"), "confidence").filter("answer <> ''")


def answer(questions: DataFrame, documents: DataFrame, numbers: DataFrame, hits: DataFrame, complete: Callable[[str], str] | None = None, whole: DataFrame | None = None) -> DataFrame:
    """(qid, answer, citations, layer_used, tokens_used, confidence) of every question.

    Layers 0 and 1 need no model. `complete` (prompt -> text) sees only the questions that they leave, in layers 2, 3
    and 4 as far as needed; without it those are layer -1. `whole` has (qid, question, full_text).
    """
    none = F.array().cast("array<string>")
    zero = layer0(questions, documents, numbers).select(F.col("qid").alias("z_"), F.col("answer").alias("a0"))
    one = layer1(hits).select(F.col("qid").alias("o_"), F.col("answer").alias("a1"), F.col("citations").alias("c1"), F.col("confidence").alias("f1"))
    # every question once, with what layers 0 and 1 say of it
    rows = questions.join(zero.hint("merge"), F.expr("qid = z_"), "left").join(one.hint("merge"), F.expr("qid = o_"), "left")
    by0, by1 = F.col("a0").isNotNull(), F.col("a1").isNotNull()
    told = rows.select(
        "qid", F.coalesce("a0", "a1", F.lit("")).alias("answer"), F.when(by0, none).when(by1, F.col("c1")).otherwise(none).alias("citations"),
        F.when(by0, 0).when(by1, 1).otherwise(-1).alias("layer_used"), F.lit(0).alias("tokens_used"), F.when(by0, 1.0).when(by1, F.col("f1")).otherwise(0.0).alias("confidence"), "question",
    )
    if complete is None:
        return told.drop("question")
    # layers 0 and 1 are read twice from here on, so they are written once
    path = shared_path(questions.sparkSession, "told")
    told.write.parquet(path)
    told = questions.sparkSession.read.schema(told.schema).parquet(path)
    done, left = told.filter("layer_used >= 0").drop("question"), told.filter("layer_used < 0").select("qid", "question")
    if whole is None:
        whole = left.select("qid", "question", F.lit("").alias("full_text"))
    asked = prompts(hits, whole.join(left.select(F.col("qid").alias("q_")).hint("merge"), F.expr("qid = q_"), "left_semi"))
    return done.unionByName(asked.mapInPandas(_ask(complete), done.schema))


def refused(reply: str) -> bool:
    head = reply[:160].lower()
    return not reply.strip() or any(m in head for m in words.REFUSAL_MARKERS)


def _ask(complete: Callable[[str], str]):
    """Layers 2 to 4 for batches of prompts; each is tried only if the one before refused."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                used = lambda prompt, reply: len(prompt.split()) + len(reply.split())
                if isinstance(r.prompt2, str):
                    reply = complete(r.prompt2)
                    if not (refused(reply) and r.n_hits >= 2):
                        out.append((r.qid, reply, list(r.cite2), 2, used(r.prompt2, reply), r.confidence))
                        continue
                if isinstance(r.prompt3, str):
                    reply = complete(r.prompt3)
                    if not refused(reply):
                        out.append((r.qid, reply, list(r.cite3), 3, used(r.prompt3, reply), 0.6))
                        continue
                reply = complete(r.prompt4)
                out.append((r.qid, reply, list(r.cite4), 4, used(r.prompt4, reply), 0.4))
            yield pd.DataFrame(out, columns=["qid", "answer", "citations", "layer_used", "tokens_used", "confidence"])

    return run
