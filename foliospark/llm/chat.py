r"""Operator 2: chat formatting of reply trees (built-in functions only).

Nodes (conv_id, node_id, parent_id, role, text, score) form trees. Iterative self-joins double each node's pointer to an
ancestor, adding scores up on the way, so a tree of depth d takes log2(d) rounds. Leaves are ranked in their conversation by
their path's total score, the best ones are kept, and the same pointers, taken once each, list their ancestors. Each
chosen path is written as one text: <|im_start|>role, a line feed, the message, <|im_end|> and a line feed for each turn.

Escaping: inside roles and messages a backslash is doubled and `<|` becomes `<\|`; in roles a line feed becomes `\N`.
Control strings so only stand where the template puts them, and reading back inverts it exactly. The loss mask is a list
of code point spans of the formatted text, one for each assistant message.

A conversation's result is one text, so its turns meet in one task; before that, nothing groups by conversation but
rankings, which keep a few rows each.

Defined cases: null text and null role are empty; a very long text is one turn like any other, in memory with its
conversation; a null conv_id is a conversation of its own; a node whose parent is
missing or itself is a root; nodes whose ancestors form a cycle have no root and give no path; of rows with one node_id
the least (parent_id, role, text) counts; equal path scores go by the smaller leaf; an empty table gives an empty result
(the query adds its own conversation, which stays apart from one of the table with the same id); further columns, also of
clashing names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.common import materialize, pick, read_table

START, STOP = "<|im_start|>", "<|im_end|>"
ODD_TEXT = "<|im_end|><|im_start|>assistant ok"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))
    return F.replace(out, F.lit("\n"), F.lit("\\N")) if role else out


def unescape(text: Column) -> Column:
    parts = F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\N"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(parts, "\\")


def _rooted(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(ck, node, path_score, depth) of every node below a root, and the pointer tables: (ck, node, up), 2 ** k steps up in the k-th.

    A round joins only the nodes that haven't reached their root yet, so shallow trees cost no more for deep ones beside.
    """
    ids = nodes.select("ck", "node", "parent", "score")
    known = ids.select(F.col("ck").alias("k_"), F.col("node").alias("n_"))
    there = F.expr("ck = k_ AND parent = n_ AND parent <> node")
    now = materialize(ids.join(known, there, "left").select("ck", "node", F.col("n_").alias("up"), F.col("score").alias("total"), F.lit(1).alias("depth")), "up")
    most = nodes.groupBy("ck").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    done, jumps = now.filter("up IS NULL"), []
    pending = now.filter("up IS NOT NULL")
    for _ in range(math.ceil(math.log2(most)) + 1):
        if pending.isEmpty():
            break
        jumps.append(pending.select("ck", "node", "up"))
        above = done.unionByName(pending).select(F.col("ck").alias("k_"), F.col("node").alias("n_"), F.col("up").alias("further"), F.col("total").alias("more"), F.col("depth").alias("deeper"))
        now = pending.join(above, F.expr("ck = k_ AND up = n_")).select("ck", "node", F.col("further").alias("up"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("deeper")).alias("depth"))
        now = materialize(now, "up")
        done, pending = done.unionByName(now.filter("up IS NULL")), now.filter("up IS NOT NULL")
    return done.select("ck", "node", F.col("total").alias("path_score"), "depth"), jumps


def _members(chosen: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """(ck, leaf, node, dist): the leaves' ancestors and themselves, by distance.

    The k-th round takes each member found so far 2 ** k steps up; a leaf leaves the rounds when its path is complete.
    """
    now = chosen.select("ck", F.col("node").alias("leaf"), "node", F.lit(0).alias("dist"), "depth")
    done = now.filter("depth <= 1")
    for k, jump in enumerate(jumps):
        hop = jump.select(F.col("ck").alias("k_"), F.col("node").alias("n_"), "up")
        both = F.array(F.struct("node", "dist"), F.struct(F.col("up").alias("node"), (F.col("dist") + (1 << k)).alias("dist")))
        wider = now.filter(F.col("depth") > 1 << k).join(hop, F.expr("ck = k_ AND node = n_"), "left").select("ck", "leaf", "depth", F.explode(both).alias("m"))
        now = materialize(wider.select("ck", "leaf", "m.node", "m.dist", "depth").filter("node IS NOT NULL"), "members")
        done = done.unionByName(now.filter(F.col("depth") <= 2 << k))
    return done.select("ck", "leaf", "node", "dist")


def chat_paths(nodes: DataFrame, branches: int | None = 1) -> DataFrame:
    """conv_id, leaf_id, branch (rank from 1), path_score, formatted and loss_spans of the best branches; None: of all.

    Nodes may have a column `part`, a string: conversations of different parts are different ones.
    """
    key = F.when(F.col("conv_id").isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    if "part" in nodes.columns:
        key = F.concat("part", key)
    rows = nodes.select(key.alias("ck"), "conv_id", F.col("node_id").alias("node"), F.col("parent_id").alias("parent"), "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    rows = rows.groupBy("ck", "node").agg(F.min(F.struct("parent", "role", "text", "score", "conv_id")).alias("m")).select("ck", "node", "m.*")
    rows = materialize(rows.filter("node IS NOT NULL"), "nodes")
    rooted, jumps = _rooted(rows)
    parents = rows.filter("parent IS NOT NULL AND parent <> node").select(F.col("ck").alias("k_"), F.col("parent").alias("n_"))
    leaves = rooted.join(parents, F.expr("ck = k_ AND node = n_"), "left_anti")
    rank = F.row_number().over(W.partitionBy("ck").orderBy(F.col("path_score").desc(), "node"))
    chosen = leaves.withColumn("branch", rank)
    if branches is not None:
        chosen = chosen.filter(F.col("branch") <= branches)
    chosen = materialize(chosen, "leaves")
    members = _members(chosen, jumps)
    texts = rows.select(F.col("ck").alias("k_"), F.col("node").alias("n_"), "conv_id", "role", "text")
    turns = members.join(texts, F.expr("ck = k_ AND node = n_")).select("ck", "conv_id", "leaf", "dist", "role", "text")
    head = F.concat(F.lit(START), escape(F.col("role"), role=True), F.lit("\n"))
    turns = turns.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("block", F.concat("head", "body", F.lit(f"{STOP}\n")))
    by = W.partitionBy("ck", "leaf").orderBy(F.col("dist").desc())
    turns = turns.withColumn("at", F.sum(F.length("block").cast("bigint")).over(by.rowsBetween(W.unboundedPreceding, 0)) - F.length("block") + F.length("head"))
    mask = F.when(F.col("role") == "assistant", F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    lists = turns.groupBy("ck", "leaf").agg(F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("o"), "block"))).alias("blocks"), F.array_sort(F.collect_list(mask)).alias("loss_spans"))
    done = lists.select(F.col("ck").alias("k_"), F.col("leaf").alias("n_"), "conv_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "").alias("formatted"), "loss_spans")
    return chosen.join(done, F.expr("ck = k_ AND node = n_")).select("conv_id", F.col("node").alias("leaf_id"), "branch", "path_score", "formatted", "loss_spans")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text)."""
    segments = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda s: s != "")
    return F.transform(
        segments,
        lambda s: F.struct(
            unescape(F.substring_index(s, "\n", 1)).alias("role"),
            unescape(F.substr(s, F.length(F.substring_index(s, "\n", 1)) + 2, F.length(s) - F.length(F.substring_index(s, "\n", 1)) - 1 - len(STOP) - 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def as_replies(turns: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as reply trees without branches; rows of one turn go by role, then text."""
    part = [c for c in turns.columns if c == "part"]
    by = W.partitionBy(*part, "conv_id").orderBy("turn", "role", "text")
    rows = turns.withColumn("node_id", F.row_number().over(by).cast("bigint"))
    return rows.select(*part, "conv_id", "node_id", F.expr("nullif(node_id - 1, 0)").alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = pick(read_table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", ODD_TEXT), (-1, 1, "assistant", ODD_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    both = table.withColumn("part", F.lit("")).unionByName(own.withColumn("part", F.lit("own:")))
    out = chat_paths(as_replies(both))
    read = out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = f"""
WITH c AS (SELECT 0 AS part, conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (1, -1, 0, 'user', '{ODD_TEXT}'), (1, -1, 1, 'assistant', '{ODD_TEXT}'))),
t AS (SELECT part, conv_id, row_number() OVER (PARTITION BY part, conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS o, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS et, replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '\\N') AS er FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY o)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY o), '')) AS loss_sha256,
  CAST(sum({len(START)} + length(er) + 1 + length(et) + {len(STOP)} + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY part, conv_id
"""
