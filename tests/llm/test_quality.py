"""The quality rules against plain loops and, over awkward rows, against their SQL."""

import re
from collections import Counter

import duckdb

from foliospark.llm import quality
from tests.llm.helpers import SCHEMA, awkward, clashing, frame, registered

EDGES = [
    "alpha one\r\nbeta two\r\nalpha one\r\n", " alpha\nbeta\n alpha", "alpha \nbeta\nalpha", "a\n\na\n\n", "\t\n \n\t\n", "one two three one two three", "a b c\na b c",
    "\x0ba b\x0c c\r", "x " * 70, "a b a b a b", "#*$%&|<> AB " * 30, " \n lead\nlead", "same\nsame \nsame", " one two\n one two", "\u0085a b\n\u0085a b",
]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed


def rows():
    return [*awkward(60), *[(4000 + i, t, "en", "a", len(t)) for i, t in enumerate(EDGES)]]


def report(df):
    return quality.quality_rules(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_base_columns_are_those_of_plain_loops(spark):
    want = Counter((r[0], *plain(r[1])) for r in rows())
    assert Counter(map(tuple, report(frame(spark, rows())).collect())) == want
    assert Counter(map(tuple, report(clashing(spark, rows())).collect())) == want
    assert report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_are_those_of_the_text_as_it_stands():
    assert [plain(t)[3] for t in EDGES[:4]] == [1, 1, 0, 1]


def test_equal_hashes_do_not_make_equal_windows(spark):
    """With a hash that tells nothing, only the words decide."""
    sql = quality.repeat_words("w").replace("xxhash64(w[i], w[i + 1], w[i + 2])", "CAST(7 AS bigint)")
    assert "CAST(7" in sql
    texts = ["a b c d e f", "a b c x a b c", "a a a a", "a b c", "b a c a b c a c b a c"]
    df = spark.createDataFrame([(t.split(),) for t in texts], "w array<string>")
    assert [r.n for r in df.selectExpr(f"{sql} AS n").collect()] == [plain(t)[4] for t in texts]


def test_awkward_rows_by_sql(spark, tmp_path):
    folder = registered(spark, tmp_path, rows())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = quality.op4_quality_rules(spark, folder)
    want = con.sql(quality.ORACLE)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())
