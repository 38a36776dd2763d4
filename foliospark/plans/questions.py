"""Questions over documents end to end, and evaluation against true answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark import embedders, providers
from foliospark.functions import text
from foliospark.operators import answers, judge, search
from foliospark.operators.index import StoredIndex, semantic_edges, structural_edges


def retrieve(
    questions: DataFrame, sections: DataFrame, index: StoredIndex | None = None, embed: Callable | None = None, score: Callable | None = None, k: int = search.TOP_K
) -> DataFrame:
    """(qid, doc_id, sec_idx, rank, score) of the best sections of each question's document.

    BM25 over stems; with `embed` (texts -> vectors) dense ranks and semantic edges, too; with `score` (a cross-encoder:
    questions, passages -> scores) the first ones are ranked anew. A stored index gives postings, edges and vectors;
    without one they are made of the sections.
    """
    vectors = asked = None
    if embed is not None:
        vectors = index.vectors() if index is not None else embedders.embed_sections(sections, embed)
        asked = embedders.embed_sections(questions.select(F.col("qid").alias("doc_id"), F.lit(0).alias("sec_idx"), F.lit(None).cast("string").alias("title"), F.col("question").alias("text")), embed)
        asked = asked.select(F.col("doc_id").alias("q_"), "vec").join(questions.select("qid", "doc_id"), F.expr("qid = q_")).select("qid", "doc_id", "vec")
    if index is not None:
        edges = index.edges()
    else:
        edges = structural_edges(sections)
        if vectors is not None:
            edges = edges.unionByName(semantic_edges(vectors))
    most = k if score is None else max(k, search.RERANK_POOL)
    hits = search.hybrid(sections if index is None else index, questions, edges, vectors, asked, k=k, most=most)
    if score is None:
        return hits
    passage = sections.select(F.col("doc_id").alias("d_"), F.col("sec_idx").alias("s_"), F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("passage"))
    rows = hits.join(passage, F.expr("doc_id = d_ AND sec_idx = s_")).join(questions.select(F.col("qid").alias("q_"), "question"), F.expr("qid = q_")).drop("d_", "s_", "q_")
    return search.rerank(rows, score, k).select("qid", "doc_id", "sec_idx", "rank", "score")


def answer_questions(
    questions: DataFrame, documents: DataFrame, sections: DataFrame, numbers: DataFrame, complete: Callable[[str], str] | None = None, k: int = search.TOP_K,
    index: StoredIndex | None = None, embed: Callable | None = None, score: Callable | None = None,
) -> DataFrame:
    """(qid, answer, citations, layer_used, tokens_used, confidence) of questions (qid, doc_id, question).

    Retrieval is that of retrieve(). `sections` is read several times (index, graph, texts of the hits); pass a table or
    a cached frame.
    """
    hits = retrieve(questions, sections, index, embed, score, k)
    body = sections.select(F.col("doc_id").alias("d_"), F.col("sec_idx").alias("s_"), "id", "title", "text", "tables", "summary", "keywords")
    hits = hits.join(body, F.expr("doc_id = d_ AND sec_idx = s_")).join(questions.select(F.col("qid").alias("q_"), "question"), F.expr("qid = q_")).drop("d_", "s_", "q_")
    hits = hits.withColumn("confidence", answers.confidence(F.col("question"), F.col("title"), F.col("keywords"), F.col("text")))
    whole = None
    if complete is not None:
        part = F.struct("sec_idx", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), "text").alias("t"))
        joined = sections.filter(F.col("sec_idx") < answers.DOCUMENT_CHARS).groupBy(F.col("doc_id").alias("d_")).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n"), 1, answers.DOCUMENT_CHARS).alias("full_text"))
        whole = questions.join(joined, F.expr("doc_id = d_"), "left").select("qid", "question", F.coalesce("full_text", F.lit("")).alias("full_text"))
    return answers.answer(questions, documents, numbers, hits, complete, whole)


def evaluate(cases: DataFrame, documents: DataFrame, sections: DataFrame, numbers: DataFrame, complete: Callable[[str], str] | None = None, grade: Callable[[str], str] | None | bool = True, **retrieval) -> tuple[DataFrame, DataFrame]:
    """(scores, report) of cases (format, file, nth, question, truth): one row a question, and the rollup by format and file.

    A file's documents are found by its slug. `grade` is a model that judges; None: the local judge; True: as the settings
    say. `retrieval` goes to answer_questions.
    """
    grade = providers.judge_from_settings() if grade is True else grade
    asked = cases.withColumn("doc_id", text.doc_slug(F.col("file"))).withColumn("qid", F.xxhash64("file", "nth", "question"))
    questions = asked.select("qid", "doc_id", "question")
    got = answer_questions(questions, documents, sections, numbers, complete, **retrieval).withColumnRenamed("qid", "q_")
    rows = asked.join(got, F.expr("qid = q_"), "left").select(F.col("format").alias("phase"), "file", "nth", "question", F.col("truth").alias("reference"), F.coalesce("answer", F.lit("")).alias("candidate"), "layer_used", "tokens_used")
    scores = judge.local_scores(rows) if grade is None else judge.model_scores(rows, grade)
    return scores, judge.report(scores)
