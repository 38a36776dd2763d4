"""Stages against brute force, the whole run, and the ten queries against their SQL."""

import math
import random
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from foliospark.llm import catalog, quality, secrets
from tests.llm.helpers import SCHEMA, awkward, clashing, frame, registered
from tests.llm.test_mixing import plain_targets, size
from tests.llm.test_packing import held
from tests.llm.test_simhash import plain_fingerprint

DATA = "/root/testdata/sf0.001"


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


def against_sql(spark, con, name, folder):
    df = catalog.QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    want = con.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    got = sorted(repr(tuple(map(plain, r))) for r in df.select(columns).collect())
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_is_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    against_sql(spark, con, name, DATA)


@pytest.mark.parametrize("name", ["op4_quality_rules", "op8_mixing"])
@pytest.mark.parametrize("rows", ["awkward", "empty"])
def test_awkward_documents_are_their_sql(spark, tmp_path, name, rows):
    folder = registered(spark, tmp_path, awkward(80) if rows == "awkward" else [])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    against_sql(spark, con, name, folder)


def long_rows(n=160):
    """Documents long enough to pass the base rule, with near copies, junk and secrets."""
    r = random.Random(n)
    texts = [" ".join(f"{r.choice('abcdefgh')}{r.randrange(500)}word" for _ in range(r.randrange(60, 400))) for _ in range(n)]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), len(t)) for i, t in enumerate(texts)] + awkward(20)[20:]
    rows += [(9000 + k, texts[k] + " tail", "en", "a", len(texts[k]) + 5) for k in range(20)] + [(9100, *rows[3][1:]), rows[5]]
    rows += [(9500, " ".join(f"w{i} ###$$$%%%" for i in range(80)), "en", "a", 1), (9501, " ".join(f"uniq{i}" for i in range(90)) + " token = abcdef123456", "en", "a", 1)]
    return rows


def test_quality_filter_keeps_what_the_report_keeps(spark):
    rows = long_rows()
    kept = quality.quality_filter(clashing(spark, rows))
    report = defaultdict(int)
    for r in quality.quality_rules(frame(spark, rows)).collect():
        report[r.doc_id] += r.kept
    got = defaultdict(int)
    for r in kept.collect():
        got[r.doc_id] += 1
        assert len(r) == 16
    assert {k: v for k, v in report.items() if v} == dict(got) and 9500 not in got and 9501 in got


def test_adaptive_fences_follow_the_group(spark):
    """A source whose texts all have many bars keeps them; one such text among plain ones goes."""
    bars = lambda i: " ".join(f"a{i}b{k} |" for k in range(60))
    words = lambda i: " ".join(f"a{i}b{k} c" for k in range(60))
    rows = [(i, bars(i), "en", "tables", 1) for i in range(30)] + [(100 + i, words(i), "en", "prose", 1) for i in range(30)] + [(200, bars(999), "en", "prose", 1)]
    kept = {r.doc_id for r in quality.quality_rules(frame(spark, rows), min_group=20).filter("kept").collect()}
    assert kept == {r[0] for r in rows} - {200}


def test_run(spark, tmp_path):
    rows = long_rows()
    folder = registered(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        stages.append(docs.collect())
    kept, unique, clean, mixed, packed = stages
    fps = [plain_fingerprint(r.text) for r in kept]
    root = list(range(len(kept)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[max(top(i), top(j))] = min(top(i), top(j))
    assert len(unique) == len({top(i) for i in range(len(kept))})
    assert len(unique) < len(kept) and sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in unique)
    for a, b in zip(sorted(unique, key=lambda r: r.doc_id), sorted(clean, key=lambda r: r.doc_id)):
        assert b.text == secrets.redacted(a.text, secrets.find(a.text)[1])
    assert "[SECRET]" in next(r.text for r in clean if r.doc_id == 9501)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in clean:
        sizes[r.source] += size(r.text)
    for r in mixed:
        taken[r.source] += size(r.text)
    assert all(abs(taken[s] - t) < 1 for s, t in plain_targets(sizes).items())
    held([tuple(r) for r in mixed], packed, 2048)
    assert corpus_pipeline.run(spark, folder).count() == len(packed)


def test_empty(spark, tmp_path):
    folder = registered(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    assert spark.createDataFrame([], SCHEMA).count() == 0
