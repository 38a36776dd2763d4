"""Ranking: BM25, dense, fusion, one-hop expansion, reranking, top-k.

Questions are a table (qid, doc_id, question), so that many are ranked by one plan; a null doc_id asks all documents.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.functions.porter import stems
from foliospark.operators.index import ScannedIndex, StoredIndex, _tokens

# Constants of the ranking functions.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K, BM25_WEIGHT, DENSE_WEIGHT = 60, 2.0, 1.5
ALPHA = {"child": 0.15, "sibling": 0.10, "semantic": 0.12}
TOP_K, RERANK_POOL = 8, 12
PLACES = 12


def query_terms(questions: DataFrame, stem: Callable[[Column], Column] | None = stems) -> DataFrame:
    """(qid, only, unit, n_words, nth, term): a unit is a token or, where it has parts, a phrase; only: the question's document."""
    rows = _units(questions, stem).select("qid", F.col("doc_id").alias("only"), F.posexplode("units").alias("unit", "p"))
    return rows.select("qid", "only", "unit", F.size("p").alias("n_words"), F.posexplode("p").alias("nth", "term"))


def _units(questions: DataFrame, stem=stems) -> DataFrame:
    """(qid, doc_id, units): the token lists of a question's distinct units, none of them empty."""
    rows = questions.select("qid", "doc_id", F.transform(F.array_distinct(text.query_units(F.col("question"))), text.index_tokens).alias("units"))
    if stem is not None:  # a flat list for the stemmer, cut into units again
        rows = rows.withColumn("s_", stem(F.flatten("units"))).withColumn("n_", F.transform("units", F.size))
        upto = lambda i: F.aggregate(F.slice("n_", F.lit(1), i), F.lit(0), lambda a, x: a + x)
        rows = rows.withColumn("units", F.transform("n_", lambda n, i: F.slice("s_", upto(i) + 1, n)))
    return rows.select("qid", "doc_id", F.filter("units", lambda u: F.size(u) > 0).alias("units"))


def occurrences(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, unit, doc_id, sec_idx, length, f): occurrences of each unit in a section; phrases stay in one column.

    A phrase stands where all its words stand at the same start. Tokens without a question's term are dropped by the
    join.
    """
    hits = tokens.join(terms.withColumnRenamed("term", "t_"), F.expr("term = t_ AND (only IS NULL OR only = doc_id)"))
    hits = hits.withColumn("start", F.col("pos") - F.col("nth"))
    # a unit of one word and a phrase alike: all n_words words at one start
    whole = hits.groupBy("qid", "unit", "n_words", "doc_id", "sec_idx", "length", "col", "start").agg(F.count("*").alias("m")).filter("m = n_words")
    return whole.groupBy("qid", "unit", "doc_id", "sec_idx", "length").agg(F.count("*").alias("f"))


def _part(n_all: Column, n: Column, f: Column, length: Column, mean: Column) -> Column:
    """What one unit adds to a section's score."""
    idf = F.ln((n_all - n + 0.5) / (n + 0.5))
    idf = F.when(idf <= 0, F.lit(IDF_FLOOR)).otherwise(idf)
    return idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * length / mean))


def bm25(source: DataFrame | ScannedIndex | StoredIndex, questions: DataFrame, scope: str = "document", stem=stems) -> DataFrame:
    """(qid, doc_id, sec_idx, score) of every section with a unit of the question.

    source: an index, or sections, which are then scanned once for hits and once for lengths. scope: statistics over
    each `document`, or over the whole `corpus`. A question with a doc_id sees that document only. The stemmer is the
    index's.
    """
    index = ScannedIndex(source, stem) if isinstance(source, DataFrame) else source
    terms = query_terms(questions, index.stem)
    found = occurrences(index.tokens(terms), terms)
    keys = ["doc_id"] if scope == "document" else []
    with_n = found.groupBy("qid", "unit", *keys).agg(F.count("*").alias("n"))
    same = F.expr("qid = q_ AND unit = u_" + (" AND doc_id = d_" if keys else ""))
    found = found.join(with_n.select(F.col("qid").alias("q_"), F.col("unit").alias("u_"), *[F.col(k).alias("d_") for k in keys], "n"), same).drop("q_", "u_", "d_")
    if keys:
        found = found.join(index.documents().withColumnRenamed("doc_id", "d_"), F.expr("doc_id = d_")).drop("d_")
    else:
        whole = index.totals().select(F.struct("n_sections", "n_tokens")).scalar()
        found = found.withColumn("w_", whole).select("*", "w_.n_sections", "w_.n_tokens")
    part = _part(F.col("n_sections"), F.col("n"), F.col("f"), F.col("length"), F.col("n_tokens") / F.col("n_sections"))
    return found.withColumn("part", part).groupBy("qid", "doc_id", "sec_idx").agg(F.sum("part").alias("score"))


def bm25_within(sections: DataFrame, questions: DataFrame, stem=stems) -> DataFrame:
    """The scores of bm25() with statistics over each document, where every question has a doc_id.

    A section's row meets its document's questions and counts their units in its own tokens: no token leaves its row.
    Everything after that join is by document, so it moves nothing more.
    """
    asked = _units(questions, stem).select("qid", F.col("doc_id").alias("d_"), "units")
    # texts move, if a side is too large to be broadcast: their tokens would take more room
    met = sections.select("doc_id", "sec_idx", "title", "text").join(asked, F.expr("doc_id = d_"))
    rows = _tokens(met, stem, "qid", "units")
    # places where all words of the unit follow each other
    count = lambda t, u: F.when(F.size(t) < F.size(u), 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(t) - F.size(u) + 1, F.lit(1))), lambda i: F.slice(t, i, F.size(u)) == u)))
    single = lambda t, u: F.size(F.filter(t, lambda x: x == u[0]))
    times = lambda t, u: F.when(F.size(u) == 1, single(t, u)).otherwise(count(t, u))
    rows = rows.select("qid", "doc_id", "sec_idx", "length", F.transform("units", lambda u: times(F.col("t0"), u) + times(F.col("t1"), u)).alias("fs"))
    by = W.partitionBy("doc_id", "qid")
    rows = rows.withColumn("n_all", F.count("*").over(by)).withColumn("mean", F.avg("length").over(by))
    hit = rows.filter(F.exists("fs", lambda f: f > 0)).select("qid", "doc_id", "sec_idx", "length", "n_all", "mean", F.posexplode("fs").alias("unit", "f")).filter("f > 0")
    hit = hit.withColumn("n", F.count("*").over(W.partitionBy("doc_id", "qid", "unit")))
    part = _part(F.col("n_all"), F.col("n"), F.col("f"), F.col("length"), F.col("mean"))
    return hit.groupBy("doc_id", "qid", "sec_idx").agg(F.sum(part).alias("score")).select("qid", "doc_id", "sec_idx", "score")


def ranked(scores: DataFrame, k: int | None, *by: str) -> DataFrame:
    """Adds rank (0-based) in each group by score (rounded), then place; the first k. Few rows a group are shuffled."""
    keys = list(by) or ["qid"]
    order = W.partitionBy(*keys).orderBy(F.round("score", PLACES).desc(), *[c for c in ("doc_id", "sec_idx") if c not in keys])
    rows = scores.withColumn("n_", F.row_number().over(order))
    if k is not None:  # on the number itself: Spark then keeps k rows of each group before the shuffle
        rows = rows.filter(F.col("n_") <= k)
    return rows.withColumn("rank", F.col("n_") - 1).drop("n_")


def dense(section_vectors: DataFrame, question_vectors: DataFrame) -> DataFrame:
    """(qid, doc_id, sec_idx, score): inner products of a question's vector with all of its document's sections, in double.

    Pairs meet by a join, which adaptive execution splits where a document is hot; products are then taken batch by batch
    as one numpy operation over the shorter length, and not element by element.
    """
    import numpy as np

    @F.pandas_udf("double")
    def products(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        n, m = a.map(len).to_numpy(), b.map(len).to_numpy()
        least = np.minimum(n, m)
        pick = lambda s, size: np.concatenate(s.to_list()).astype(np.float64)[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) < np.repeat(least, size)]
        starts = np.cumsum(least) - least
        both = np.append(pick(a, n) * pick(b, m), 0.0)
        return pd.Series(np.where(least > 0, np.add.reduceat(both, np.minimum(starts, len(both) - 1)), 0.0), index=a.index)

    asked = question_vectors.filter("vec IS NOT NULL").select("qid", F.col("doc_id").alias("d_"), F.col("vec").alias("q_"))
    rows = section_vectors.filter("vec IS NOT NULL").join(asked, F.expr("doc_id = d_"))
    return rows.select("qid", "doc_id", "sec_idx", products("q_", "vec").alias("score"))


def fuse(lists: dict[float, DataFrame]) -> DataFrame:
    """(qid, doc_id, sec_idx, score): sum of weight / (60 + rank + 1) over the ranked lists; a full outer union."""
    parts = None
    for weight, ranks in lists.items():
        one = ranks.select("qid", "doc_id", "sec_idx", (F.lit(weight) / (F.col("rank") + (RRF_K + 1))).alias("s"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("qid", "doc_id", "sec_idx").agg(F.sum("s").alias("score"))


def expand(fused: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds alpha * weight * score of the original seeds along child, sibling and semantic edges, one hop."""
    alpha = F.create_map(*[F.lit(x) for pair in ALPHA.items() for x in pair])
    useful = edges.filter(F.col("edge_type").isin(*ALPHA)).select(F.col("doc_id").alias("d_"), "from_idx", "to_idx", (alpha[F.col("edge_type")] * F.col("weight")).alias("a"))
    gained = fused.join(useful, F.expr("doc_id = d_ AND sec_idx = from_idx")).select("qid", "doc_id", F.col("to_idx").alias("sec_idx"), (F.col("a") * F.col("score")).alias("score"))
    return fused.select("qid", "doc_id", "sec_idx", "score").unionByName(gained).groupBy("qid", "doc_id", "sec_idx").agg(F.sum("score").alias("score"))


def rerank(hits: DataFrame, score: Callable, k: int = TOP_K, pool: int = RERANK_POOL) -> DataFrame:
    """The first `pool` hits (qid, doc_id, sec_idx, rank, question, passage) by score(question, passage), the best k.

    score: a pandas function (Series, Series) -> Series. Questions with a single hit keep it and its score.
    """
    @F.pandas_udf("double")
    def judged(question: pd.Series, passage: pd.Series) -> pd.Series:
        return score(question, passage)

    few = hits.filter(F.col("rank") < pool).withColumn("many_", F.count("*").over(W.partitionBy("qid")) > 1)
    rows = few.withColumn("score", F.when(F.col("many_"), F.coalesce(judged("question", "passage"), F.lit(-1.7976931348623157e308))).otherwise(F.col("score")))
    order = W.partitionBy("qid").orderBy(F.col("score").desc(), "rank")
    best = rows.withColumn("n_", F.row_number().over(order)).filter(F.col("n_") <= k)
    return best.withColumn("rank", F.col("n_") - 1).drop("many_", "n_")


def hybrid(source: DataFrame | ScannedIndex | StoredIndex, questions: DataFrame, edges: DataFrame, section_vectors: DataFrame | None = None, question_vectors: DataFrame | None = None, k: int = TOP_K, scope: str = "document", stem=stems, most: int | None = None) -> DataFrame:
    """(qid, doc_id, sec_idx, rank, score): BM25 and, with vectors, dense ranks of 3k each, fused, expanded, the best k.

    Every question has a doc_id. source: sections or an index. most: how many are returned, if not k.
    """
    scores = bm25_within(source, questions, stem) if isinstance(source, DataFrame) and scope == "document" else bm25(source, questions, scope, stem)
    lists = {BM25_WEIGHT: ranked(scores, 3 * k)}
    if section_vectors is not None and question_vectors is not None:
        lists[DENSE_WEIGHT] = ranked(dense(section_vectors, question_vectors), 3 * k)
    return ranked(expand(fuse(lists), edges), most or k)
