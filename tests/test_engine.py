"""Structure, enrichment, ranking, answers and judging on small tables with hand-computed results."""

import hashlib
import math
import random
import re
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.errors import QuantizationError
from foliospark.functions import porter, text, vectors
from foliospark.functions.wordpiece import WordPiece
from foliospark.operators import answers, index, judge, key_numbers, search, tree
from foliospark.operators.keywords import keywords
from foliospark.plans import pipeline

RAW = "doc_id string, sec_idx int, level int, title string, text string"


def value(spark, column, **inputs):
    df = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs)) if inputs else spark.range(1)
    return df.select(column.alias("v")).first().v


def stack_ids(levels):
    """The tree by a plain stack."""
    stack, counts, out = [], [0] * 10, []
    for i, level in enumerate(levels):
        level = min(max(level, 1), 6)
        while stack and stack[-1][1] >= level:
            stack.pop()
        depth = len(stack)
        counts[depth] += 1
        counts[depth + 1 :] = [0] * (9 - depth)
        out.append((stack[-1][0] if stack else None, "§" + ".".join(map(str, counts[: depth + 1]))))
        stack.append((i, level))
    return out


def test_tree_against_a_stack(spark):
    r = random.Random(0)
    docs = {f"d{n}": [r.randrange(0, 9) for _ in range(r.randrange(1, 25))] for n in range(60)} | {"a": [1, 2, 2, 1], "b": [1, 2, 3], "c": [1, 3], "d": [0, 9]}
    rows = [(d, i, l, "t", "") for d, ls in docs.items() for i, l in enumerate(ls)]
    got = tree.build_tree(spark.createDataFrame(rows, RAW))
    by = {(x.doc_id, x.sec_idx): x for x in got.collect()}
    for d, ls in docs.items():
        for i, (parent, own) in enumerate(stack_ids(ls)):
            assert (by[d, i].parent_idx, by[d, i].id) == (parent, own)
            assert by[d, i].parent_id == (by[d, parent].id if parent is not None else None)
    assert [by["c", i].id for i in range(2)] == ["§1", "§1.1"] and by["d", 1].level == 6
    below = {(x.doc_id, x.sec_idx): x.children for x in tree.children(got).collect()}
    assert below["a", 0] == ["§1.1", "§1.2"] and below["a", 1] == []


def test_token_counts_and_tables(spark):
    for words, n in (("", 0), ("a b c", 3), (" ".join("abcdefghij"), 13)):
        assert value(spark, text.token_count(F.col("t")), t=words) == n
    t = spark.sql("SELECT array('A', 'B') AS h, array(array('1'), array('1', '2', '3'), array('x', 'y')) AS r, CAST(array() AS array<string>) AS none")
    got = t.select(tree.fit_rows(F.col("r"), F.col("h")).alias("a"), tree.fit_rows(F.col("r"), F.col("none")).alias("b")).first()
    assert got.a == [["1", ""], ["1", "2"], ["x", "y"]] and got.b == [["1"], ["1", "2", "3"], ["x", "y"]]


def test_names(spark):
    for stem, slug in (("BlueHarbour", "blue-harbour"), ("Report2024", "report-2024"), ("sales_data 2024", "sales-data-2024"), ("__x__", "x"), ("2ndDraft", "2-nd-draft")):
        assert value(spark, text.doc_slug(F.col("p")), p=f"/a.b/{stem}.Docx") == slug
    for source, label in (("C:\\a\\b.md", "b.md"), ("/x/y/z.md/", "z.md"), ("z.md", "z.md"), ("https://h/p/", "https://h/p/"), ("///", "///")):
        assert value(spark, text.source_label(F.col("s")), s=source) == label
    assert value(spark, text.filename_title(F.col("s")), s="sales_data-2024 USA") == "Sales Data 2024 USA"


def found_numbers(spark, body):
    df = spark.createDataFrame([("d", 0, body)], "doc_id string, sec_idx int, text string")
    return {(r.label, r.value, r.unit) for r in key_numbers.key_numbers(df).collect()}


def test_key_numbers(spark):
    assert found_numbers(spark, "Total revenue: $1,200\nGrowth: 23%") == {("Total revenue", "$1,200", "USD"), ("Growth", "23%", "%")}
    assert found_numbers(spark, "The mean response time is 12.5 ms after 3 retries") == {("mean response time", "12.5 ms", None), ("mean response time retries", "3", None)} - {("mean response time retries", "3", None)} | {("mean response time ms", "3", None)}
    for line in ("1. 2024", "Figure 4", "Section 23", "Llama 2", "GPT-4", "Q3", "NASA 42", "in 1999", "12"):
        assert found_numbers(spark, line) == set(), line
    assert found_numbers(spark, "engineers: 24\nengineers: 24\nEngineers: 24") == {("engineers", "24", None)}
    assert found_numbers(spark, "speedup of 2.5x now") == {("speedup", "2.5x", None)}
    many = spark.createDataFrame([("d", 0, "\n".join(f"metric {chr(97 + i % 26)}{chr(97 + i // 26)} size: {i}" for i in range(100)))], "doc_id string, sec_idx int, text string")
    assert [r.kn_idx for r in key_numbers.key_numbers(many).orderBy("kn_idx").collect()] == list(range(64))


def test_parse_number(spark):
    for raw, n in (("$1.2 billion", 1.2e9), ("18,400", 18400), ("5k", 5000), ("23%", 23), ("$142M", 142), ("3 thousand", 3000), ("x", None)):
        got = value(spark, key_numbers.parse_number(F.col("r")), r=raw)
        assert got == n or math.isclose(got, n)


def plain_keywords(title, body, k=8):
    from foliospark.functions.words import KEYWORD_STOP

    tok = lambda s: [w for w in re.findall(r"[a-z0-9][a-z0-9-]{2,}", s.lower()) if w not in KEYWORD_STOP]
    ts = tok(body)
    ranked = sorted(dict.fromkeys(ts), key=lambda w: -(ts.count(w) + 0.1 * len(w)))
    return list(dict.fromkeys(tok(title) + ranked))[:k]


def test_keywords(spark):
    r = random.Random(1)
    words = "alpha beta gamma-ray delta the and of report x1y zz data data model".split()
    rows = [(" ".join(r.choices(words, k=r.randrange(4))), " ".join(r.choices(words, k=r.randrange(40)))) for _ in range(40)] + [(None, None), ("", "")]
    got = spark.createDataFrame(rows, "t string, b string").select("t", "b", keywords(F.col("t"), F.col("b"), 3).alias("k")).collect()
    assert all(x.k == plain_keywords(x.t or "", x.b or "", 3) for x in got)


SECTION = "doc_id string, sec_idx int, title string, text string"


def sqlite_ranks(rows, query, tokenize):
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE f USING fts5(i UNINDEXED, title, body, tokenize='{tokenize}')")
    db.executemany("INSERT INTO f VALUES (?, ?, ?)", [(i, t, b) for _, i, t, b in rows])
    return {int(i): -s for i, s in db.execute("SELECT i, bm25(f) FROM f WHERE f MATCH ?", (query,))}


def test_bm25_is_that_of_sqlite(spark):
    r = random.Random(2)
    words = "running runner ran relational hopping year over growth growing café market markets-share national".split()
    rows = [("d", i, " ".join(r.choices(words, k=3)), " ".join(r.choices(words, k=r.randrange(1, 30)))) for i in range(40)]
    df = spark.createDataFrame(rows, SECTION)
    for question, match in (("running growth", '"running" OR "growth"'), ("year-over market", '"year-over" OR "market"'), ("nothinghere", '"nothinghere"')):
        asked = spark.createDataFrame([(1, "d", question)], "qid bigint, doc_id string, question string")
        for stem, tokenize in ((None, "ascii"), (porter.stems, "porter ascii")):
            got = {x.sec_idx: x.score for x in search.bm25(df, asked, stem=stem).collect()}
            want = sqlite_ranks(rows, match, tokenize)
            assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)


def test_stems_are_those_of_sqlite():
    words = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll yes by the ionisation knowledge".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(w, tokenize='porter ascii')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    db.executemany("INSERT INTO f VALUES (?)", [(w,) for w in words])
    want = dict(db.execute("SELECT doc, term FROM v").fetchall())
    assert [porter.stem(w) for w in words] == [want[i + 1] for i in range(len(words))]


def test_fusion_and_expansion(spark):
    ranks = lambda ids: spark.createDataFrame([(1, "d", i, n) for n, i in enumerate(ids)], "qid bigint, doc_id string, sec_idx int, rank int")
    got = {r.sec_idx: r.score for r in search.fuse({2.0: ranks([5, 7]), 1.5: ranks([7, 9])}).collect()}
    assert got == pytest.approx({5: 2 / 61, 7: 2 / 62 + 1.5 / 61, 9: 1.5 / 62}, abs=1e-12)
    seed = spark.createDataFrame([(1, "d", 0, 1.0)], "qid bigint, doc_id string, sec_idx int, score double")
    edges = spark.createDataFrame([("d", 0, 1, "child", 1.0), ("d", 0, 2, "sibling", 1.0), ("d", 0, 3, "semantic", 1.0), ("d", 0, 4, "parent", 1.0), ("d", 1, 5, "child", 1.0)], "doc_id string, from_idx int, to_idx int, edge_type string, weight double")
    got = {r.sec_idx: r.score for r in search.expand(seed, edges).collect()}
    assert got == pytest.approx({0: 1.0, 1: 0.15, 2: 0.10, 3: 0.12})


def test_hybrid_with_vectors_and_rerank(spark):
    rows = [("d", 0, "Overview", "company overview"), ("d", 1, "Revenue", "revenue grew strongly"), ("d", 2, "Costs", "costs fell"), ("d", 3, "Detail", "breakdown by region")]
    sections = spark.createDataFrame([(*r, l) for r, l in zip(rows, (1, 1, 1, 2))], SECTION + ", level int")
    built = tree.build_tree(sections)
    asked = spark.createDataFrame([(1, "d", "what is revenue?")], "qid bigint, doc_id string, question string")
    vocabulary = ["revenue", "costs", "region"]
    vec = lambda s: [float(s.count(w)) for w in vocabulary]
    vecs = spark.createDataFrame([(d, i, vec(f"{t} {b}".lower())) for d, i, t, b in rows], "doc_id string, sec_idx int, vec array<float>")
    qvec = spark.createDataFrame([(1, "d", vec("revenue"))], "qid bigint, doc_id string, vec array<float>")
    hits = search.hybrid(built, asked, index.structural_edges(built), vecs, qvec, k=4)
    got = [r.sec_idx for r in hits.orderBy("rank").collect()]
    assert got[0] == 1 and sorted(got) == [0, 1, 2, 3]
    shown = hits.withColumn("question", F.lit("q")).withColumn("passage", F.col("sec_idx").cast("string"))
    best = search.rerank(shown, lambda q, p: p.astype(int).astype(float), k=2).orderBy("rank").collect()
    assert [r.sec_idx for r in best] == [3, 2] and best[0].score == 3.0
    hostile = spark.createDataFrame([(1, "d", "\"') OR * NEAR( --"), (2, "d", ""), (3, "d", None)], "qid bigint, doc_id string, question string")
    assert search.bm25(built, hostile).count() == 0


def test_semantic_edges_and_cache_keys(spark):
    v = [[1.0, 0.0], [0.9, 0.436], [0.0, 1.0]]
    df = spark.createDataFrame([("d", i, x) for i, x in enumerate(v)] + [("e", i, x) for i, x in enumerate(v)], "doc_id string, sec_idx int, vec array<float>")
    got = {(r.from_idx, r.to_idx) for r in index.semantic_edges(df).filter("doc_id = 'd'").collect()}
    assert got == {(0, 1), (1, 0)}
    assert index.semantic_edges(df, most=2).count() == 0
    rows = [("d", 0, "§1", "x" * 300), ("d", 1, "§2", "é")]
    key = lambda rs: index.fingerprints(spark.createDataFrame(rs, "doc_id string, sec_idx int, id string, text string")).first().fingerprint
    want = b"d" + (2).to_bytes(4, "big") + b"".join(i.encode() + len(t).to_bytes(4, "big") + t[:200].encode() for _, _, i, t in rows)
    assert key(rows) == hashlib.sha256(want).hexdigest()
    assert key([("d", 0, "§1", "x" * 299 + "y"), rows[1]]) == key(rows) != key([("d", 0, "§1", "x" * 301), rows[1]])


def test_index_is_kept_by_document(spark, tmp_path):
    stored = index.StoredIndex(spark, f"file://{tmp_path}/index")
    with pytest.raises(FileNotFoundError):
        stored.registry()
    schema = "doc_id string, sec_idx int, id string, title string, text string, parent_idx int"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    vecs = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0])], "doc_id string, sec_idx int, vec array<float>")
    stored.add(rows(("a", 0, "§1", "", "running dogs", None), ("a", 1, "§1.1", "", "two", 0), ("b", 0, "§1", "", "two dogs", None)), vectors=vecs)
    asked = spark.createDataFrame([(1, "a", "run dog"), (2, "b", "dogs"), (3, None, "two")], "qid bigint, doc_id string, question string")
    found = lambda i: sorted((r.qid, r.doc_id, r.sec_idx) for r in search.bm25(i, asked).collect())
    assert found(stored) == [(1, "a", 0), (2, "b", 0), (3, "a", 1), (3, "b", 0)]
    assert {(r.from_idx, r.to_idx, r.edge_type) for r in stored.edges().collect()} == {(1, 0, "parent"), (0, 1, "child")} and stored.vectors().count() == 2
    stored.add(rows(("a", 0, "§1", "", "cats", None)))
    assert found(stored) == [(2, "b", 0), (3, "b", 0)] and stored.edges().count() == 0 and stored.vectors().count() == 0
    assert {(r.doc_id, r.n_sections, r.n_tokens) for r in stored.registry().collect()} == {("a", 1, 1), ("b", 1, 2)}
    stored.forget(spark.createDataFrame([("b",)], "doc_id string"))
    assert found(stored) == [] and [r.doc_id for r in stored.registry().collect()] == ["a"]
    stored.add(rows(("b", 0, "§1", "", "dog", None)), segment=3)
    stored.add(rows(("b", 0, "§1", "", "dog two", None)), segment=3)
    assert found(stored) == [(2, "b", 0), (3, "b", 0)] and stored.segments() == [0, 1, 2, 3]
    small = stored.compact(f"file://{tmp_path}/compact")
    assert found(small) == found(stored) and small.segments() == [0] and small.registry().count() == 2
    registry = spark.createDataFrame([("a", "1"), ("b", "2")], "doc_id string, fingerprint string")
    now = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "doc_id string, fingerprint string")
    assert {r.doc_id for r in index.stale(now, registry).collect()} == {"b", "c"}


def test_in_row_scores_are_those_of_the_token_table(spark):
    texts = ["one two three", "two-two two two", "One. two; three one two", "", "running runs ran", "a b c a-b a b-c"]
    rows = spark.createDataFrame([(d, i, t.split(" ")[0], t) for d in (1, 2) for i, t in enumerate(texts[d - 1 :])], "doc_id bigint, sec_idx int, title string, text string")
    asked = spark.createDataFrame([(10, 1, "one two-three two-two"), (11, 1, "run"), (12, 2, "a-b b-c"), (13, 2, "of"), (14, 2, "one"), (15, 2, "")], "qid bigint, doc_id bigint, question string")
    scores = lambda df: sorted((r.qid, r.doc_id, r.sec_idx, round(r.score, 9)) for r in df.collect())
    for stem in (None, search.stems):
        want = scores(search.bm25(rows, asked, stem=stem))
        assert want and scores(search.bm25_within(rows, asked, stem=stem)) == want


def test_retrieval_with_a_stored_index_is_that_of_the_sections(spark, tmp_path):
    from foliospark import embedders
    from foliospark.plans.questions import retrieve

    rows = [(f"d{d}", i, f"§{i + 1}", t, f"{t} number {i} of {d}", None if i == 0 else 0) for d in range(3) for i, t in enumerate(["alpha report", "beta costs", "gamma costs", "delta"])]
    sections = spark.createDataFrame(rows, "doc_id string, sec_idx int, id string, title string, text string, parent_idx int")
    asked = spark.createDataFrame([(i, f"d{i}", q) for i, q in enumerate(["costs of beta", "reports", "delta numbers"])], "qid bigint, doc_id string, question string")
    embed = lambda texts: [[len(t), t.count("a"), t.count("e")] for t in texts]
    near = lambda q, p: p.str.len().astype("float64")
    stored = index.StoredIndex(spark, f"file://{tmp_path}/index")
    vecs = embedders.embed_sections(sections, embed)
    stored.add(sections, edges=index.semantic_edges(vecs), vectors=vecs)
    got = lambda **k: sorted((r.qid, r.sec_idx, r["rank"], round(r.score, 6)) for r in retrieve(asked, sections, **k).collect())
    plain = got()
    assert plain and got(index=stored, embed=embed) == got(embed=embed) != plain
    ranked = got(embed=embed, score=near)
    assert {q: [s for x, s, *_ in sorted(ranked, key=lambda r: r[2]) if x == q][0] for q in (0, 1, 2)} == {0: 0, 1: 0, 2: 0} and len(ranked) == 12


def test_settings_choose_the_judge_and_find_the_model(monkeypatch, tmp_path):
    from foliospark import embedders, providers

    for name in ("FOLIO_JUDGE_URL", "FOLIO_JUDGE_MODEL", "FOLIO_JUDGE_KEY"):
        monkeypatch.delenv(name, raising=False)
    assert providers.judge_from_settings() is None and providers.judge_from_settings("http://x", "m") is None
    monkeypatch.setenv("FOLIO_JUDGE_KEY", "k")
    assert providers.judge_from_settings("http://x", "m").inner.key == "k"
    assert not embedders.model_present(str(tmp_path))
    for path in embedders.model_files(str(tmp_path)):
        open(path, "w").close()
    assert embedders.model_present(str(tmp_path))


def test_stems_of_batches(spark):
    from foliospark.functions.porter import stem, stems

    rows = [(["running", "ran", "ponies"],), ([],), (None,), (["running", None, "x"],)]
    got = [r.s for r in spark.createDataFrame(rows[:3], "t array<string>").select(stems("t").alias("s")).collect()]
    assert got == [[stem(w) for w in rows[0][0]], [], None]


def test_quantisation(spark):
    v = [0.0, 1.0, -1.0, 0.5, -0.25, 0.1]
    df = spark.createDataFrame([(v,)], "v array<float>")
    native = df.select(vectors.int8(F.col("v")).alias("i"), vectors.binary_bits(F.col("v")).alias("b"), vectors.from_int8(vectors.int8(F.col("v"))).alias("f")).first()
    assert native.i == [0, 127, -127, 63, -31, 12] and native.b == "54" and native.f[1] == pytest.approx(1.0)
    for mode, size, tolerance in (("float32", 24, 0), ("float16", 12, 1e-3), ("int8", 6, 0.01)):
        q = df.select(vectors.quantizer(mode)("v").alias("q"))
        row = q.select("q", vectors.dequantizer(mode, 6)("q").alias("back")).first()
        assert len(row.q) == size and np.allclose(row.back, v, atol=tolerance)
    row = df.select(vectors.quantizer("binary")("v").alias("q")).select("q", vectors.dequantizer("binary", 6)("q").alias("back")).first()
    assert bytes(row.q) == b"\x54" and list(row.back) == [-1, 1, -1, 1, -1, 1]
    assert [value(spark, vectors.stride(F.lit(384), m)) for m in vectors.MODES] == [1536, 768, 384, 48]
    with pytest.raises(QuantizationError):
        vectors.stride(F.lit(1), "int4")
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert zero.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).first().c == 0.0


def test_wordpiece():
    t = WordPiece(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "play", "##ing", "!", "a"])
    assert t.encode("Playing a!", 10) == [2, 4, 5, 7, 6, 3] and t.encode("zebra", 10) == [2, 1, 3]
    assert t.encode("a a a a", 4) == [2, 7, 7, 3] and t.encode("a" * 201, 9) == [2, 1, 3]
    assert t.encode_pair("a a", "playing", 6) == ([2, 7, 7, 3, 4, 3], [0, 0, 0, 0, 1, 1])


NUMBERS = "doc_id string, kn_idx int, section string, label string, value string, unit string"
ASKED = "qid bigint, doc_id string, question string"


def test_key_number_match(spark):
    numbers = spark.createDataFrame([("d", 0, "§1", "Average response time", "12 ms", None), ("d", 1, "§1", "Revenue", "$5", "USD"), ("d", 2, "§2", "Revenue", "$6", "USD"), ("d", 3, "§2", "Total engineers", "24", None)], NUMBERS)
    asked = spark.createDataFrame([(1, "d", "what is the response time?"), (2, "d", "what was revenue"), (3, "d", "how many engineers?"), (4, "d", "weather")], ASKED)
    got = {r.qid: r.value for r in answers.match_key_numbers(asked, numbers).collect()}
    assert got == {1: "12 ms", 3: "24"}


def test_labels_without_a_token_match_nothing(spark):
    numbers = spark.createDataFrame([("d", 0, "§1", label, "5", None) for label in ("the of", "—", "", None)] + [("e", 0, "§1", "total", "7", None)], NUMBERS)
    asked = spark.createDataFrame([(1, "d", "what is the total of it"), (2, "e", "what is the total of it"), (3, "d", None)], ASKED)
    assert {r.qid: r.value for r in answers.match_key_numbers(asked, numbers).collect()} == {2: "7"}


def test_sentences_and_confidence(spark):
    body = "The company was founded long ago. Revenue grew by ten percent in 2023. Short. Costs were flat across regions."
    best = lambda q: value(spark, answers.best_sentences(F.col("b"), F.col("q")), b=body, q=q)
    assert best("How much did revenue grow in 2023?") == "The company was founded long ago. Revenue grew by ten percent in 2023."
    assert best("weather tomorrow") == "" and best("the of") == ""
    none = F.array().cast("array<string>")
    assert value(spark, answers.confidence(F.col("q"), F.lit("Revenue"), none, F.col("b")), q="revenue growth 2023", b="numbers for 2023") == pytest.approx(2 / 3)
    assert value(spark, answers.confidence(F.col("q"), F.lit(""), none, F.lit("x")), q="the of") == 0.0


HITS = "qid bigint, question string, rank int, id string, title string, text string, summary string, tables array<struct<table_id:string,caption:string,headers:array<string>,rows:array<array<string>>>>, confidence double"


def routed(spark, replies, hits, question="what is the margin", summary=None, insights=(), numbers=()):
    asked = spark.createDataFrame([(1, "d", question)], ASKED)
    docs = spark.createDataFrame([("d", summary, list(insights))], "doc_id string, summary string, insights array<string>")
    rows = [(1, question, n, i, "T", t, s, [("tbl_001", None, ["a", "b"], [["1", "2"]])], c) for n, (i, t, s, c) in enumerate(hits)]
    complete = None
    if replies is not None:
        def complete(prompt):
            return next(a for mark, a in replies if mark in prompt)
    whole = spark.createDataFrame([(1, question, "whole text")], "qid bigint, question string, full_text string")
    return answers.answer(asked, docs, spark.createDataFrame(list(numbers), NUMBERS), spark.createDataFrame(rows, HITS), complete, whole).first()


def test_layers(spark):
    weak, none = ("§1", "nothing to see in this text", None, 0.3), ("§2", "other words stand here", None, 0.1)
    sure = ("§1", "The gross margin is forty percent this year.", None, 0.9)
    number = ("d", 0, "§1", "Margin", "40%", "%")
    assert routed(spark, None, [sure], numbers=[number])[1:4] == ("Margin: 40% % (source: §1)", [], 0)
    assert routed(spark, None, [sure], question="give me a summary", summary="All well.").answer == "All well."
    assert routed(spark, None, [sure], question="an overview of the margin", numbers=[number]).layer_used != 0
    assert routed(spark, None, [sure], question="key insights?", insights=["a", "b"]).answer == "• a\n• b"
    assert routed(spark, None, [sure])[1:4] == ("The gross margin is forty percent this year.", ["§1"], 1)
    assert routed(spark, None, [("§1", "x", "A summary.", 0.9)]).answer == "A summary."
    assert routed(spark, None, [sure], question="list all margins").layer_used == -1
    assert tuple(routed(spark, None, [weak]))[1:] == ("", [], -1, 0, 0.0)
    two = routed(spark, [("Section §1", "forty")], [weak, none])
    assert (two.answer, two.citations, two.layer_used, two.confidence) == ("forty", ["§1"], 2, 0.3) and two.tokens_used > 10
    assert routed(spark, [("Section §1", "Not found in §1")], [weak]).layer_used == 2
    three = routed(spark, [("Section §1", "Not found in §1"), ("sections of one document", "both")], [weak, none])
    assert (three.answer, three.layer_used, three.confidence, three.citations) == ("both", 3, 0.6, ["§1", "§2"])
    four = routed(spark, [("sections of one document", ""), ("part of a document", "last")], [none, none])
    assert (four.answer, four.layer_used, four.confidence) == ("last", 4, 0.4)
    assert routed(spark, [("whole text", "all")], [])[1:4] == ("all", [], 4)


def test_judge(spark):
    rows = [("revenue was 102 million in the north", "revenue was 100 million in the north", 10), ("", "x", 0), ("Not found in context", "x y", 0), ("apples and pears", "apples, pears and plums", 10), ("nothing alike", "count: 5 things", 0), ("the answer is 1234", "sum of parts = 1 234", 8)]
    got = judge.local_scores(spark.createDataFrame([(i, c, r) for i, (c, r, _) in enumerate(rows)], "i int, candidate string, reference string")).orderBy("i").collect()
    assert [r.score for r in got][:5] == [x[2] for x in rows][:5] and got[5].num_ratio == 1.0
    for reply, want in (("SCORE: 8\nREASONING: good: yes", (8, "good: yes")), ("score: 9/10", (9, "parse error")), ("SCORE: 7 out of 10\r\nREASONING ok", (7, "REASONING ok")), ("none", (5, "parse error")), ("SCORE: eleven", (5, "parse error")), (None, (5, "parse error")), ("SCORE: 3\nSCORE: 4", (4, "parse error"))):
        assert tuple(value(spark, judge.parse_verdict(F.col("r")), r=reply) if reply is not None else spark.range(1).select(judge.parse_verdict(F.lit(None).cast("string")).alias("v")).first().v) == want
    report = judge.report(spark.createDataFrame([("p1", "a", 10), ("p1", "a", 4), ("p2", "b", None)], "phase string, file string, score int")).collect()
    by = {(r.phase, r.file): (r.n, r.avg_score, r.hit_rate) for r in report}
    assert by["p1", "a"] == (2, 7.0, 0.5) and by["p2", None] == (1, 0.0, 0.0) and by[None, None][0] == 3
    assert "| p1 | a | 2 | 7.0/10 | 50% |" in judge.render_report(report)


def test_pipeline_keeps_what_is_set(spark):
    rows = spark.createDataFrame([("d", 0, 1, "Sales", "Total sales: 40", ["own"]), ("d", 1, 2, "North", "north sales grew", [])], RAW + ", keywords array<string>")
    done, numbers = pipeline.process(rows)
    got = {r.sec_idx: r for r in done.collect()}
    assert got[0].keywords == ["own"] and got[1].keywords == ["north", "sales", "grew"] and got[0].children == ["§1.1"]
    assert [tuple(r)[2:] for r in numbers.collect()] == [("§1", "Total sales", "40", None)]
