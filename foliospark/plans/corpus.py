"""The driver's tables as sections, questions and lines. Every adapter reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The questions that every document is asked.
QUESTIONS = (
    "What does the report say about thatin and rewh?",
    "How many ononst inoran hehely",
    "orantion keit lich ment",
    "sich-heit ther",
    "which of these",
    "zzzz qqqq xxxx",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section for each line of a document: level 1, 2, 3 in turn, the first three words as its title."""
    line = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("sec_idx", "text"))
    return line.select("doc_id", "sec_idx", F.array_join(F.slice(F.split("text", " ", -1), 1, 3), " ").alias("title"), (F.col("sec_idx") % 3 + 1).alias("level"), "text")


def questions(spark: SparkSession) -> DataFrame:
    """(qid, doc_id, question): QUESTIONS, of all documents."""
    return spark.createDataFrame([(i, None, q) for i, q in enumerate(QUESTIONS)], "qid bigint, doc_id bigint, question string")


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, question, answer): each user turn with the turn after it."""
    turns = table(spark, sf_dir, "conversations")
    reply = turns.select(F.col("conv_id").alias("c_"), (F.col("turn") - 1).alias("t_"), F.col("text").alias("answer"))
    return turns.filter("role = 'user'").join(reply, F.expr("conv_id = c_ AND turn = t_")).select("conv_id", "turn", F.col("text").alias("question"), "answer")


def figure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sec_idx, text): one text of several lines with figures for each part."""
    p = table(spark, sf_dir, "part")
    lines = F.concat_ws(
        "\n",
        F.concat(F.initcap("p_name"), F.lit(" price: $"), F.format_string("%d", F.floor("p_retailprice").cast("bigint"))),
        F.concat(F.lit("1. Size of "), F.col("p_name"), F.lit(" is "), F.col("p_size"), F.lit(" now, up 12.5% in 3 weeks")),
        F.concat(F.lit("Figure "), F.col("p_size"), F.lit(" shows revenue of $1.2 billion and Model 7 in 1999, Q"), F.col("p_size"), F.lit(" or rev-"), F.col("p_size")),
        F.concat(F.lit("Total stock: **"), F.col("p_partkey"), F.lit("** and SKU "), F.col("p_partkey"), F.lit(" with speed gain 2.5x over 40 days")),
    )
    return p.select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("sec_idx"), lines.alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sec_idx, vec): each label a document, its vectors the sections."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").cast("int").alias("sec_idx"), F.col("embedding").alias("vec"))
