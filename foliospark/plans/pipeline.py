"""From raw sections to enriched documents, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.key_numbers import key_numbers
from foliospark.operators.keywords import keywords
from foliospark.operators.tree import build_tree, children, fit_tables
from foliospark.shared import shared_path
from foliospark.sources.registry import ParserRegistry, raw_sections, read_files


def normalise(sections: DataFrame) -> DataFrame:
    """Tree, children, token counts and table widths of raw sections."""
    tree = build_tree(sections)
    if "tables" in tree.columns:
        tree = tree.withColumn("tables", fit_tables("tables"))
    below = children(tree).select(F.col("doc_id").alias("d_"), F.col("sec_idx").alias("s_"), "children")
    return tree.join(below, F.expr("doc_id = d_ AND sec_idx = s_")).drop("d_", "s_")


def enrich(sections: DataFrame, k: int = 8) -> DataFrame:
    """Adds keywords where a section has none yet."""
    found = keywords(F.col("title"), F.col("text"), k)
    if "keywords" in sections.columns:
        return sections.withColumn("keywords", F.when(F.size("keywords") > 0, F.col("keywords")).otherwise(found))
    return sections.withColumn("keywords", found)


def document_key_numbers(sections: DataFrame, limit: int = 64, present: DataFrame | None = None) -> DataFrame:
    """(doc_id, kn_idx, section, label, value, unit), section being the section's id.

    Documents that already have key numbers, in `present`, keep those, and no others are looked for.
    """
    if present is not None:
        have = present.select(F.col("doc_id").alias("h_")).distinct()
        rest = document_key_numbers(sections.join(have, F.expr("doc_id = h_"), "left_anti"), limit)
        return rest.unionByName(present.select(*rest.columns))
    ids = sections.select(F.col("doc_id").alias("d_"), F.col("sec_idx").alias("s_"), F.col("id").alias("section"))
    found = key_numbers(sections.select("doc_id", "sec_idx", "text"), limit)
    return found.join(ids, F.expr("doc_id = d_ AND sec_idx = s_")).select("doc_id", "kn_idx", "section", "label", "value", "unit")


def process(sections: DataFrame, present: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sections, key numbers) of raw sections; `present` has the key numbers of documents that come with some.

    The sections are written to the shared folder once, as files are not parsed again for everything that is read of them.
    """
    done = enrich(normalise(sections))
    path = shared_path(sections.sparkSession, "sections")
    done.write.parquet(path)
    done = sections.sparkSession.read.schema(done.schema).parquet(path)
    return done, document_key_numbers(done, present=present)


def ingest(spark: SparkSession, path: str, registry: ParserRegistry | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parsed files, sections, key numbers) of all files in a folder."""
    parsed = (registry or ParserRegistry()).parse_files(read_files(spark, path))
    return parsed, *process(raw_sections(parsed))
