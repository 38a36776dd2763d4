"""Command line: convert a folder to archives, show archives, ask questions of them.

    python -m foliospark.cli convert IN OUT | info PATH | query PATH "question" [--no-llm] [--models FOLDER]
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import embedders, providers
from foliospark.errors import FolioError
from foliospark.plans import pipeline
from foliospark.plans.questions import answer_questions
from foliospark.sources import archive
from foliospark.sources.registry import read_files


def convert(spark: SparkSession, source: str, target: str) -> list[str]:
    """Write an archive for every file that can be parsed; the messages of the others."""
    parsed, sections, numbers = pipeline.ingest(spark, source)
    parsed = parsed.cache()
    none = F.array().cast("array<string>")
    documents = parsed.filter("error IS NULL").select("doc_id", "title", "source", "format", F.lit(None).cast("string").alias("summary"), none.alias("insights"), F.lit(None).cast("struct<owner:string,department:string,tags:array<string>,access_roles:array<string>,version:string,last_updated:string>").alias("meta"), F.lit(datetime.now(timezone.utc).isoformat()).alias("created_at"))
    sections = sections.withColumn("summary", F.lit(None).cast("string"))
    archive.write(archive.pack(archive.parts(documents, sections, numbers)), target)
    return [r.error for r in parsed.filter("error IS NOT NULL").select("error").toLocalIterator()]


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, sections, key numbers) of archives, or of files parsed on the spot."""
    files = read_files(spark, path)
    packed = archive.unpack(files.filter(F.lower("path").endswith(".udf")))
    documents = archive.documents_of(packed)
    sections = archive.sections_of(packed)
    numbers = documents.select("doc_id", F.posexplode("key_numbers").alias("kn_idx", "k")).select("doc_id", "kn_idx", "k.*")
    parsed, more, more_numbers = pipeline.ingest(spark, path)
    also = parsed.filter("error IS NULL").select("doc_id", "title", F.lit(None).cast("string").alias("summary"), F.array().cast("array<string>").alias("insights"))
    columns = ["doc_id", "sec_idx", "id", "title", "level", "text", "tables", "parent_idx", "parent_id", "keywords", "summary"]
    own = sections.select("doc_id", F.col("sec_idx").alias("i_"), F.col("id").alias("p_"))
    sections = sections.join(own.withColumnRenamed("doc_id", "d_"), F.expr("doc_id = d_ AND parent_id = p_"), "left").withColumn("parent_idx", F.col("i_"))
    every = sections.select(*columns).unionByName(more.withColumn("summary", F.lit(None).cast("string")).select(*columns))
    return documents.select("doc_id", "title", "summary", "insights").unionByName(also), every, numbers.select("doc_id", "kn_idx", "section", "label", "value", "unit").unionByName(more_numbers)


def ask(spark: SparkSession, path: str, question: str, complete=None, models: str | None = None) -> DataFrame:
    """An answer for every document at the path; `models` is a folder that may hold embedder and reranker files."""
    documents, sections, numbers = load(spark, path)
    sections = sections.cache()
    questions = documents.select(F.xxhash64("doc_id").alias("qid"), "doc_id", F.lit(question).alias("question"))
    embed = embedders.onnx_embedder(*embedders.model_files(models, "embedder")) if models and embedders.model_present(models, "embedder") else None
    score = embedders.onnx_scorer(*embedders.model_files(models, "reranker")) if models and embedders.model_present(models, "reranker") else None
    out = answer_questions(questions, documents, sections, numbers, complete, embed=embed, score=score)
    names = questions.select(F.col("qid").alias("q_"), "doc_id")
    return out.join(names, F.expr("qid = q_")).select("doc_id", "answer", "citations", "layer_used", "tokens_used", "confidence")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="foliospark")
    sub = p.add_subparsers(dest="command", required=True)
    for name, *args in (("convert", "source", "target"), ("info", "path"), ("query", "path", "question")):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        if name == "query":
            c.add_argument("--no-llm", action="store_true")
            for a in ("--llm-url", "--llm-model", "--llm-key", "--models"):
                c.add_argument(a)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("foliospark").getOrCreate()
    try:
        if a.command == "convert":
            errors = convert(spark, a.source, a.target)
            print("\n".join(errors) or "done")
            return int(bool(errors))
        if a.command == "info":
            for r in archive.info(archive.unpack(read_files(spark, a.path))).toLocalIterator():
                print(f"{r.title} ({r.format}, version {r.version}): {r.n_sections} sections, {r.n_key_numbers} key numbers. {r.summary}")
            return 0
        complete = None if a.no_llm else providers.from_settings(a.llm_url, a.llm_model, a.llm_key)
        for r in ask(spark, a.path, a.question, complete, a.models).toLocalIterator():
            print(f"{r.doc_id}: {r.answer}\n[Layer {r.layer_used}, {r.tokens_used} tokens, confidence {r.confidence:.2f}] {' '.join(r.citations)}")
        return 0
    except FolioError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
