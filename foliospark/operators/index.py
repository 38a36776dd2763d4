"""Inverted index, section graph and cache keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.functions.porter import stems

SIBLING_WEIGHT = 0.8


def _tokens(sections: DataFrame, stem=None, *keep: str) -> DataFrame:
    """(doc_id, sec_idx, t0, t1, length): tokens of title and text, and their number; stem: Column -> Column of an array."""
    tokens = lambda c: text.index_tokens(F.col(c)) if stem is None else stem(text.index_tokens(F.col(c)))
    rows = sections.select("doc_id", "sec_idx", *keep, tokens("title").alias("t0"), tokens("text").alias("t1"))
    return rows.withColumn("length", F.size("t0") + F.size("t1"))


def token_rows(sections: DataFrame, stem=None) -> DataFrame:
    """(doc_id, sec_idx, length, col, pos, term): every token of title (col 0) and text (col 1), with its section's length."""
    both = F.array(F.struct(F.lit(0).alias("col"), F.col("t0").alias("terms")), F.struct(F.lit(1).alias("col"), F.col("t1").alias("terms")))
    rows = _tokens(sections, stem).select("doc_id", "sec_idx", "length", F.explode(both).alias("c"))
    return rows.select("doc_id", "sec_idx", "length", "c.col", F.posexplode("c.terms").alias("pos", "term"))


def postings(sections: DataFrame, stem=None) -> DataFrame:
    """(term, doc_id, sec_idx, col, length, tf, positions): the index as a table. Tokens are combined before they move."""
    grouped = token_rows(sections, stem).groupBy("term", "doc_id", "sec_idx", "col", "length")
    return grouped.agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))


def document_frequency(sections: DataFrame) -> DataFrame:
    """(term, df, cf): sections with the term, and its occurrences."""
    per_section = token_rows(sections).groupBy("term", "doc_id", "sec_idx").agg(F.count("*").alias("tf"))
    return per_section.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def section_lengths(sections: DataFrame) -> DataFrame:
    """(doc_id, sec_idx, length): tokens of title and text; computed in the row, without a shuffle."""
    return _tokens(sections).select("doc_id", "sec_idx", "length")


class ScannedIndex:
    """An index of sections that is made as it is asked: tokens are cut out of the texts for each set of questions."""

    def __init__(self, sections: DataFrame, stem=None):
        self.sections, self.stem = sections, stem

    def tokens(self, terms: DataFrame) -> DataFrame:
        return token_rows(self.sections, self.stem)

    def documents(self) -> DataFrame:
        """(doc_id, n_sections, n_tokens)"""
        return section_lengths(self.sections).groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.sum("length").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """(n_sections, n_tokens) of all documents, in one row."""
        return section_lengths(self.sections).agg(F.count("*").alias("n_sections"), F.sum("length").alias("n_tokens"))


#: Terms up to which a scan of stored postings is given them as a filter that files and row groups are skipped by.
PUSHED_TERMS = 1000


class StoredIndex:
    """Postings, documents, edges and vectors in a folder, as segments that are only ever added.

    A document's rows count in its newest segment; a segment may also say that a document is gone. So one document is
    replaced without touching others, and reading joins the few rows that a question needs with the newest segments.
    `compact` makes one segment of all. Postings are sorted by term, so a term's rows lie in few row groups.
    """

    def __init__(self, spark: SparkSession, path: str, stem=stems):
        self.spark, self.path, self.stem = spark, path.rstrip("/"), stem

    def segments(self) -> list[int]:
        """Numbers of the segments that are written whole."""
        jvm = self.spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/documents")
        fs = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        done = [int(n.split("=")[1]) for n in names if n.startswith("segment=")]
        return sorted(n for n in done if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/documents/segment={n}/_SUCCESS")))

    def _read(self, name: str) -> DataFrame:
        found = self.segments()
        if not found:
            raise FileNotFoundError(f"there is no index at {self.path}")
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/segment={n}" for n in found])

    def _write(self, rows: DataFrame, name: str, segment: int) -> None:
        rows.write.mode("overwrite").option("parquet.block.size", 32 << 20).parquet(f"{self.path}/{name}/segment={segment}")

    def add(self, sections: DataFrame, edges: DataFrame | None = None, vectors: DataFrame | None = None, segment: int | None = None) -> int:
        """Index whole documents (rows of doc_id, sec_idx, id, title, text, parent_idx), replacing those that are there.

        Edges are structural ones, and `edges` (semantic ones, say) beside them; vectors (doc_id, sec_idx, vec). The
        documents are written last: a segment counts once they are there. The same segment written again is the same.
        """
        segment = max(self.segments(), default=-1) + 1 if segment is None else segment
        self._write(postings(sections, self.stem).repartitionByRange("term").sortWithinPartitions("term", "doc_id", "sec_idx"), "postings", segment)
        kind = sections.schema["doc_id"].dataType.simpleString()
        graph = structural_edges(sections) if "parent_idx" in sections.columns else self.spark.createDataFrame([], f"doc_id {kind}, from_idx int, to_idx int, edge_type string, weight double")
        self._write(graph if edges is None else graph.unionByName(edges), "edges", segment)
        self._write(vectors.select("doc_id", "sec_idx", "vec") if vectors is not None else self.spark.createDataFrame([], f"doc_id {kind}, sec_idx int, vec array<float>"), "vectors", segment)
        sizes = section_lengths(sections).groupBy(F.col("doc_id").alias("d_")).agg(F.sum("length").alias("n_tokens"))
        self._write(fingerprints(sections).join(sizes, F.expr("doc_id = d_")).select("doc_id", "n_sections", "n_tokens", "fingerprint"), "documents", segment)
        return segment

    def forget(self, documents: DataFrame) -> int:
        """From now on the documents (doc_id) aren't there, which also makes them stale."""
        segment = max(self.segments()) + 1
        for name in ("postings", "edges", "vectors"):
            self._write(self._read(name).drop("segment").limit(0), name, segment)
        none = F.lit(None)
        self._write(documents.select("doc_id", none.cast("bigint").alias("n_sections"), none.cast("bigint").alias("n_tokens"), none.cast("string").alias("fingerprint")), "documents", segment)
        return segment

    def registry(self) -> DataFrame:
        """(doc_id, n_sections, n_tokens, fingerprint, segment) of the documents that are there."""
        rows = F.max(F.struct("segment", "n_sections", "n_tokens", "fingerprint")).alias("m")
        return self._read("documents").groupBy("doc_id").agg(rows).select("doc_id", "m.n_sections", "m.n_tokens", "m.fingerprint", "m.segment").filter("n_sections IS NOT NULL")

    def _newest(self, rows: DataFrame) -> DataFrame:
        """Without rows that a later segment has replaced; with one segment all are the newest."""
        if len(self.segments()) == 1:
            return rows.drop("segment")
        newest = self.registry().select(F.col("doc_id").alias("d_"), F.col("segment").alias("g_"))
        return rows.join(newest, F.expr("doc_id = d_ AND segment = g_"), "left_semi").drop("segment")

    def tokens(self, terms: DataFrame) -> DataFrame:
        """Token rows (doc_id, sec_idx, length, col, pos, term) of the terms (term), from the postings."""
        asked = [r.term for r in terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        rows = self._read("postings")
        rows = rows.filter(F.col("term").isin(asked)) if len(asked) <= PUSHED_TERMS else rows.join(terms.select(F.col("term").alias("t_")).distinct(), F.expr("term = t_"), "left_semi")
        return self._newest(rows).select("doc_id", "sec_idx", "length", "col", F.explode("positions").alias("pos"), "term")

    def documents(self) -> DataFrame:
        return self.registry().select("doc_id", "n_sections", "n_tokens")

    def totals(self) -> DataFrame:
        return self.registry().agg(F.sum("n_sections").alias("n_sections"), F.sum("n_tokens").alias("n_tokens"))

    def edges(self) -> DataFrame:
        return self._newest(self._read("edges"))

    def vectors(self) -> DataFrame:
        return self._newest(self._read("vectors"))

    def compact(self, path: str) -> StoredIndex:
        """The same index in one segment at another place."""
        out = StoredIndex(self.spark, path, self.stem)
        out._write(self._newest(self._read("postings")).repartitionByRange("term").sortWithinPartitions("term", "doc_id", "sec_idx"), "postings", 0)
        out._write(self.edges(), "edges", 0)
        out._write(self.vectors(), "vectors", 0)
        out._write(self.registry().drop("segment"), "documents", 0)
        return out


def structural_edges(tree: DataFrame) -> DataFrame:
    """(doc_id, from_idx, to_idx, edge_type, weight): parent and child edges, and sibling edges below one parent."""
    up = tree.filter("parent_idx IS NOT NULL").select("doc_id", F.col("sec_idx").alias("a"), F.col("parent_idx").alias("b"))
    edge = lambda a, b, kind: F.struct(F.col(a).alias("from_idx"), F.col(b).alias("to_idx"), F.lit(kind).alias("edge_type"), F.lit(1.0).alias("weight"))
    pair = F.explode(F.array(edge("a", "b", "parent"), edge("b", "a", "child")))
    lineage = up.select("doc_id", pair.alias("e")).select("doc_id", "e.*")
    other = up.select(F.col("doc_id").alias("d_"), F.col("a").alias("to_idx"), F.col("b").alias("p_"))
    siblings = up.join(other, F.expr("doc_id = d_ AND b = p_ AND a <> to_idx")).select("doc_id", F.col("a").alias("from_idx"), "to_idx", F.lit("sibling").alias("edge_type"), F.lit(SIBLING_WEIGHT).alias("weight"))
    return lineage.unionByName(siblings)


def semantic_edges(vectors: DataFrame, threshold: float = 0.68, most: int = 1000) -> DataFrame:
    """Ordered pairs of one document's sections whose inner product reaches the threshold, weighted by it.

    `vectors` has (doc_id, sec_idx, vec). Documents with more than `most` sections have none, as building them is
    quadratic; that is the operator's rule. They are sorted out by a count before vectors move, so a group is bounded.
    """
    import numpy as np
    import pandas as pd

    sizes = vectors.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") <= most).select(F.col("doc_id").alias("d_"))
    fit = vectors.join(sizes, F.expr("doc_id = d_"), "left_semi")

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sec_idx", ignore_index=True)
        x = np.stack([np.asarray(v, np.float64) for v in pdf["vec"]])
        dots = x @ x.T
        np.fill_diagonal(dots, -np.inf)
        i, j = np.nonzero(dots >= threshold)
        at = pdf["sec_idx"].to_numpy()
        return pd.DataFrame({"doc_id": pdf["doc_id"].iloc[0], "from_idx": at[i], "to_idx": at[j], "edge_type": "semantic", "weight": dots[i, j]})

    kind = vectors.schema["doc_id"].dataType.simpleString()
    return fit.groupBy("doc_id").applyInPandas(pairs, f"doc_id {kind}, from_idx int, to_idx int, edge_type string, weight double")


def _be32(n) -> F.Column:
    return F.lpad(F.hex(n.cast("bigint")), 8, "0")


def _units(c: str) -> F.Column:
    """UTF-16 code units: characters, those beyond U+FFFF twice."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def fingerprints(sections: DataFrame) -> DataFrame:
    """(doc_id, n_sections, fingerprint): SHA-256 over id, section count and each section's id, length (in UTF-16 units) and
    first 200 characters.

    Titles are not part of it, nor is text beyond 200 characters unless its length changes.
    """
    size = _units("text")
    part = F.concat(F.hex(F.encode("id", "UTF-8")), _be32(size), F.hex(F.encode(F.substring("text", 1, 200), "UTF-8")))
    rows = sections.select("doc_id", F.struct("sec_idx", part.alias("h")).alias("s"))
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("s"), F.count("*").alias("n_sections"))
    whole = F.concat(F.hex(F.encode(F.col("doc_id").cast("string"), "UTF-8")), _be32(F.col("n_sections")), F.array_join(F.transform("s", lambda x: x["h"]), ""))
    return lists.select("doc_id", "n_sections", F.sha2(F.unhex(whole), 256).alias("fingerprint"))


def stale(current: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents of `current` (doc_id, fingerprint) that the registry lacks or has with another fingerprint."""
    known = registry.select(F.col("doc_id").alias("d_"), F.col("fingerprint").alias("f_"))
    return current.join(known, F.expr("doc_id = d_ AND fingerprint = f_"), "left_anti")


def index_stats(registry: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, n_sections, n_edges) of every indexed document."""
    n = edges.groupBy(F.col("doc_id").alias("d_")).agg(F.count("*").alias("n"))
    return registry.join(n, F.expr("doc_id = d_"), "left").select("doc_id", "n_sections", F.coalesce("n", F.lit(0)).alias("n_edges"))
