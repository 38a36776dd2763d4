"""Section trees from heading levels, with windows only: no recursion, one shuffle by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import text

LEVELS = range(1, 7)


def build_tree(sections: DataFrame) -> DataFrame:
    """Adds level (1 to 6), parent_idx, depth, id, parent_id and token_count to (doc_id, sec_idx, level, text, ...).

    A section's parent is the nearest earlier one of a smaller level. The section last seen at a level is still open
    unless one of a smaller level came after it, so the open ones are compared by position. Ids count siblings: the
    number at each depth is that of the last section at the depth.
    """
    before = W.partitionBy("doc_id").orderBy("sec_idx").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("doc_id").orderBy("sec_idx").rowsBetween(W.unboundedPreceding, 0)
    rows = sections.withColumn("level", F.least(F.greatest("level", F.lit(1)), F.lit(6)))
    rows = rows.select("*", *[F.max(F.when(F.col("level") == l, F.col("sec_idx"))).over(before).alias(f"at{l}_") for l in LEVELS])
    place = lambda l: F.coalesce(F.col(f"at{l}_"), F.lit(-1))
    smaller = lambda l: F.greatest(F.lit(-1), *[place(k) for k in LEVELS if k < l], F.lit(-1))
    is_open = lambda l: (F.lit(l) < F.col("level")) & (place(l) > smaller(l))
    rows = rows.withColumn("depth", sum((is_open(l).cast("int") for l in LEVELS), F.lit(0)))
    parent = F.greatest(F.lit(-1), *[F.when(F.lit(l) < F.col("level"), place(l)).otherwise(F.lit(-1)) for l in LEVELS])
    rows = rows.withColumn("parent_idx", F.when(parent >= 0, parent)).drop(*[f"at{l}_" for l in LEVELS])
    rows = rows.withColumn("nth_", F.row_number().over(W.partitionBy("doc_id", "parent_idx").orderBy("sec_idx")))
    rows = rows.select("*", *[F.last(F.when(F.col("depth") == d, F.col("nth_")), ignorenulls=True).over(upto).alias(f"n{d}_") for d in range(6)])
    numbers = F.array(*[F.col(f"n{d}_").cast("string") for d in range(6)])
    rows = rows.withColumn("id", F.concat(F.lit("§"), F.array_join(F.slice(numbers, F.lit(1), F.col("depth") + 1), ".")))
    rows = rows.withColumn("parent_id", F.when(F.col("depth") > 0, F.concat(F.lit("§"), F.array_join(F.slice(numbers, F.lit(1), F.col("depth")), "."))))
    return rows.drop("nth_", *[f"n{d}_" for d in range(6)]).withColumn("token_count", text.token_count(F.col("text")))


def children(tree: DataFrame) -> DataFrame:
    """(doc_id, sec_idx, children): ids of the direct children in order; an empty array where there are none."""
    below = tree.filter("parent_idx IS NOT NULL").groupBy("doc_id", "parent_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("sec_idx", "id"))), lambda x: x["id"]).alias("children"))
    below = below.select(F.col("doc_id").alias("d_"), F.col("parent_idx").alias("p_"), "children")
    none = F.array().cast("array<string>")
    return tree.select("doc_id", "sec_idx").join(below, F.expr("doc_id = d_ AND sec_idx = p_"), "left").select("doc_id", "sec_idx", F.coalesce("children", none).alias("children"))


def fit_rows(rows, headers):
    """Rows padded or cut to the headers' width; without headers as they are."""
    width = F.size(headers)
    fit = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width)
    return F.when(width > 0, F.transform(rows, fit)).otherwise(rows)


def fit_tables(tables):
    """Every table's rows at its headers' width."""
    return F.transform(tables, lambda t: F.struct(t["table_id"].alias("table_id"), t["caption"].alias("caption"), t["headers"].alias("headers"), fit_rows(t["rows"], t["headers"]).alias("rows")))
