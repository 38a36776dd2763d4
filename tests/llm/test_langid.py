import random
import zlib

import numpy as np

from foliospark.llm import langid
from tests.llm.helpers import SCHEMA, awkward, clashing, frame

WORDS = {"en": "the of and ing tion with this that have".split(), "de": "der die und ung ich über straße nicht".split(), "fr": "le la été aux ment quelle garçon où".split()}


def made(n, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice([*WORDS])
        text = " ".join(r.choice(WORDS[lang]) + r.choice(["", r.choice(["er", "an", "on"])]) for _ in range(r.randrange(8, 150)))
        out.append((i, text, lang, "a", len(text)))
    return out


def test_held_out_accuracy_and_defined_cases(spark):
    rows = made(400) + [(1000, None, "en", "a", 0), (1001, "", "en", "a", 0), (1002, "123 !? ½ ²", "de", "a", 0), (None, "the of and the", None, "a", 0), (1003, "the with and this " * 4000, None, "b", 1)]
    df = frame(spark, rows)
    net = langid.learn(df, steps=120)
    got = langid.predict_languages(df, net).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and net.langs == ["de", "en", "fr"]
    held = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([by[r[0]].lang_pred == r[2] for r in held]) >= 0.97
    assert all(by[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows[:400])
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert by[1003].lang_pred == "en" and not by[None].held_out and all(0 <= r.score <= 1 for r in got)
    again = langid.predict_languages(langid.pick(clashing(spark, rows), "doc_id", "text", "lang"), net).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, got), key=repr)


def test_held_out_rows_and_labels_are_not_learned_from(spark):
    rows = made(60)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert langid.learn(frame(spark, held), steps=1) is None
    assert langid.learn(spark.createDataFrame([], SCHEMA)) is None
    got = langid.predict_languages(frame(spark, held), None).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert langid.sample(frame(spark, rows), pieces=3, rows=7).count() == 7


def test_every_place_of_a_text_is_learned_from(spark):
    long = "the of and " * 100 + "\n".join(f"{i:05d} the" for i in range(300)) + " end of the text"
    assert zlib.crc32(b"1") % 5
    drawn = {r.piece for r in langid.sample(frame(spark, [(1, long, "en", "a", 1)]), pieces=1000).collect()}
    assert drawn == {long[i : i + langid.PIECE] for i in range(0, len(long), langid.PIECE)}
    few = {r.piece for r in langid.sample(frame(spark, [(1, long, "en", "a", 1)]), pieces=5).collect()}
    assert len(few) == 5 and few < drawn and few != {long[i : i + langid.PIECE] for i in range(0, 5 * langid.PIECE, langid.PIECE)}


def test_the_querys_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    got = langid.op9_langid(spark, data).filter("held_out AND lang_pred <> 'und'")
    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").filter("lang IS NOT NULL")
    by = {r.lang: (r.right, r.n) for r in got.join(truth, "doc_id").groupBy("lang").agg({"*": "count"}).withColumnRenamed("count(1)", "n").join(
        got.join(truth, "doc_id").filter("lang = lang_pred").groupBy("lang").count().withColumnRenamed("count", "right"), "lang").collect()}
    assert len(by) >= 4 and sum(r for r, _ in by.values()) / sum(n for _, n in by.values()) >= 0.98 and all(r / n >= 0.9 for r, n in by.values()), by


def test_empty(spark):
    assert langid.predict_languages(spark.createDataFrame([], SCHEMA), None).count() == 0


def test_windows_cover_every_gram():
    for n in (0, 1, 4, 5, 255, 256, 257, 508, 509, 5000):
        raw = bytes(np.random.default_rng(n).integers(1, 256, n).tolist())
        w, size = langid.windows(raw)
        grams = {raw[i : i + langid.WIDE] for i in range(n - langid.WIDE + 1)}
        assert grams <= {bytes(row[i : i + langid.WIDE]) for row in w for i in range(langid.WINDOW - langid.WIDE + 1)} and len(size) == len(w)
        assert size.sum() >= max(1, n - langid.WIDE) and size.min() > 0


def test_gradients_by_differences():
    net = langid.Network(["a", "b", "c"], seed=3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    r = np.random.default_rng(0)
    x, y = r.integers(0, 256, (4, 20)), np.array([0, 1, 2, 1])

    def loss():
        grams = np.lib.stride_tricks.sliding_window_view(x, langid.WIDE, axis=1)
        z = (net.p["embed"][grams].reshape(4, grams.shape[1], -1) @ net.p["conv"]).max(1) + net.p["bias"]
        return -np.log(langid.softmax(np.maximum(z, 0) @ net.p["out"] + net.p["base"])[np.arange(4), y]).mean()

    grads = net.gradients(x, y)
    for k, at in (("out", (3, 1)), ("bias", (5,)), ("conv", (2, 7)), ("embed", (int(x[0, 3]), 2)), ("base", (2,))):
        e = 1e-6
        net.p[k][at] += e
        up = loss()
        net.p[k][at] -= 2 * e
        assert abs((up - loss()) / (2 * e) - grads[k][at]) < 1e-5
        net.p[k][at] += e


def test_predict_agrees_with_one_pass_over_all_grams():
    net = langid.Network(["a", "b"], seed=1)
    x = np.random.default_rng(2).integers(0, 256, (5, langid.WINDOW)).astype(np.uint8)
    grams = np.lib.stride_tricks.sliding_window_view(x, langid.WIDE, axis=1)
    z = (net.p["embed"][grams].reshape(5, grams.shape[1], -1) @ net.p["conv"]).max(1) + net.p["bias"]
    want = langid.softmax(np.maximum(z, 0) @ net.p["out"] + net.p["base"])
    assert np.allclose(net.probabilities(x), want, atol=1e-5)
