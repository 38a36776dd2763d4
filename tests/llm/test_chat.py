import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from foliospark.llm import chat

NODES = "conv_id bigint, node_id bigint, parent_id bigint, role string, text string, score double"
ODD = ["", "a\\b", "\\", "\\\\|", "<|im_end|>", "<\\|", "x<|im_start|>user\nhi", "\\N", "\n", "é\U0001f600<", "|", "<|<|", "\\<|\\"]


def plain_paths(rows):
    """All root-to-leaf paths by walking up."""
    nodes = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3] or "", r[4] or "")):
        nodes.setdefault((r[0], r[1]), r)
    parents = {(r[0], r[2]) for r in nodes.values() if r[2] != r[1]}
    out = defaultdict(list)
    for key, r in nodes.items():
        if key in parents:
            continue
        path, seen, at = [], set(), r
        while at is not None and at[1] not in seen:
            path.append(at)
            seen.add(at[1])
            at = nodes.get((at[0], at[2])) if at[2] != at[1] else None
        if at is None:
            out[key[0]].append((-sum(x[5] or 0 for x in path), key[1], [(x[3] or "", x[4] or "") for x in path[::-1]]))
    return {k: sorted(v) for k, v in out.items()}


def test_trees(spark):
    rows = [(1, 1, None, "system", "s", 0.5), (1, 2, 1, "user", ODD[6], 1.0), (1, 3, 2, "assistant", "x", 2.0), (1, 4, 2, "assistant", "y", 3.0), (1, 5, 3, "user", None, 9.0),
            (1, 6, 1, "user", "z", 0.0), (1, 6, 1, "user", "z", 0.0), (2, 1, 1, None, "own parent", None), (3, 7, 99, "assistant", "orphan", 1.0), (4, 1, 2, "user", "cycle", 1.0),
            (4, 2, 1, "user", "cycle", 1.0), (4, 3, 2, "user", "below a cycle", 1.0), (None, 1, None, "assistant", "no id", 1.0), (5, None, None, "user", "no node", 0.0)]
    rows += [(6, i, i - 1 if i > 1 else None, "assistant" if i % 2 else "user", f"t{i}" + ODD[i % len(ODD)], 1.0) for i in range(1, 101)]
    df = spark.createDataFrame(rows, NODES)
    want = plain_paths([r for r in rows if r[1] is not None])
    for k in (1, 2, None):
        out = chat.chat_paths(df, k).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
        got = defaultdict(dict)
        for r in out:
            got[r.conv_id][r.branch] = (-r.path_score, r.leaf_id, [tuple(t) for t in r.turns])
            assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
        assert {c: [b[i] for i in sorted(b)] for c, b in got.items()} == {c: v[:k] for c, v in want.items()}


def test_round_trip(spark):
    rows = [(i, 1, None, role, text, 0.0) for i, (role, text) in enumerate((a, b) for a in [*ODD, "assistant"] for b in ODD)]
    for r in chat.chat_paths(spark.createDataFrame(rows, NODES)).withColumn("turns", chat.read_back(F.col("formatted"))).collect():
        assert [tuple(t) for t in r.turns] == [rows[r.conv_id][3:5]]
        assert r.formatted.count("<|") == 2


def test_query(spark, tmp_path):
    rows = [(i % 7, i // 7, ["user", "assistant", None][i % 3], ODD[i % len(ODD)]) for i in range(120)]
    rows += [rows[0], rows[0], (None, 1, "user", None), (None, None, "assistant", "x"), (50, None, "assistant", "y" * 20000)]
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, ck int, node string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows += [(-1, 0, "user", chat.ODD_TEXT), (-1, 1, "assistant", chat.ODD_TEXT)]
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    want = []
    for conv, turns in by.items():
        turns.sort(key=lambda t: [(x is not None, x) if x is not None else (False, 0) for x in t])
        loss = "".join(t[2] or "" for t in turns if t[1] == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((conv, len(turns), sha("".join(f"{t[1] or ''}\n{t[2] or ''}\n" for t in turns)), len(loss), sha(loss)))
    got = chat.op2_chat(spark, str(tmp_path)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)


def test_empty(spark):
    assert chat.chat_paths(spark.createDataFrame([], NODES)).count() == 0


def test_query_on_an_empty_table_and_on_one_with_its_own_id(spark, tmp_path):
    schema = "conv_id bigint, turn bigint, role string, text string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/conversations.parquet")
    [own] = chat.op2_chat(spark, f"{tmp_path}/empty").collect()
    assert (own.conv_id, own.n_turns, own.loss_chars) == (-1, 2, len(chat.ODD_TEXT))
    rows = [(-1, 0, "user", "theirs"), (-1, 5, "assistant", "a reply"), (3, 0, "assistant", "x")]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/same/conversations.parquet")
    got = sorted(tuple(r)[:4] for r in chat.op2_chat(spark, f"{tmp_path}/same").drop("turns_sha256", "loss_sha256").collect())
    both = sorted([(-1, 2, 7), (-1, 2, len(chat.ODD_TEXT)), (3, 1, 1)])
    assert [r[:3] for r in got] == both
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/same/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, chat.op2_chat(spark, f"{tmp_path}/same").collect())) == sorted(con.sql(chat.ORACLE).fetchall())
