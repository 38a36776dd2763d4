"""Operator 9: language identification by a byte convolutional network, trained in numpy.

Filters of several widths slide over byte embeddings; the maximum over a window, a rectifier and a softmax layer give the
window's language. The network is trained with Adam on the driver from a bounded, documented sample: of each language
about 2 * SAMPLE documents are drawn by hash, their whole texts are cut into pieces of PIECE code points, and of all these
up to PIECES are drawn by hash, SAMPLE_ROWS in all languages together. Every place of a text is as likely to be learned
from, and a long text gives more pieces than a short one. Prediction covers whole texts: every text is cut into overlapping windows of WINDOW bytes, windows
are run in batches, and their probabilities are averaged, weighted by their bytes.

Only documents with a language whose crc32(doc_id) mod 5 is not 0 are learned from; predictions see the text alone.

Defined cases: a very long text is predicted from all its windows, BATCH_WINDOWS at a time; text that is null or has no letter is `und` with score 0, and so is every text if there is nothing to
learn from; a null doc_id is not held out and not learned from; equal probabilities go by the smaller language name;
repeated rows are predicted one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.llm.common import bounded_batches, materialize, pick, read_table, small_or_salted_join

#: Bounds of the training sample: documents drawn of a language (about twice as many), pieces of a language, and of all together.
SAMPLE, PIECES, SAMPLE_ROWS = 500, 2000, 80_000
PIECE = 300
WINDOW = 256
EMBED = 8
#: (width, number of filters); narrower filters are padded with zeros to the widest.
FILTERS = ((3, 12), (4, 10), (5, 10))
WIDE = max(w for w, _ in FILTERS)
STEPS, BATCH, RATE = 300, 96, 0.01
BATCH_WINDOWS = 192


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(n, WINDOW) bytes of the whole text, consecutive windows sharing WIDE - 1 bytes, and the bytes that each adds."""
    step = WINDOW - (WIDE - 1)
    n = max(1, -(-(len(raw) - (WIDE - 1)) // step))
    padded = np.zeros((n - 1) * step + WINDOW, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    size = np.full(n, step)
    size[-1] = max(1, len(raw) - (n - 1) * step)
    return np.lib.stride_tricks.as_strided(padded, (n, WINDOW), (step, 1)), size


class Network:
    def __init__(self, langs: list[str], seed: int = 0):
        r = np.random.default_rng(seed)
        self.langs = langs
        filters = sum(n for _, n in FILTERS)
        self.mask = np.concatenate([np.repeat((np.arange(WIDE) < w).astype(np.float32), EMBED)[:, None].repeat(n, 1) for w, n in FILTERS], axis=1)
        normal = lambda s, *shape: r.normal(0, s, shape).astype(np.float32)
        self.p = {"embed": normal(0.5, 256, EMBED), "conv": normal(0.2, WIDE * EMBED, filters) * self.mask, "bias": np.zeros(filters, np.float32), "out": normal(0.2, filters, len(langs)), "base": np.zeros(len(langs), np.float32)}

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 0) -> Network:
        """Every step draws languages evenly, then windows at random, a third of them short."""
        r = np.random.default_rng(seed)
        of = [np.nonzero(labels == k)[0] for k in range(len(self.langs))]
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        for t in range(1, steps + 1):
            y = r.integers(0, len(self.langs), batch)
            x = np.zeros((batch, WINDOW), np.int64)
            for i, k in enumerate(y):
                raw = texts[of[k][r.integers(len(of[k]))]]
                size = int(r.integers(16, WINDOW)) if r.random() < 0.33 else WINDOW
                at = int(r.integers(0, max(1, len(raw) - size + 1)))
                own = np.frombuffer(raw[at : at + size], np.uint8)
                x[i, : len(own)] = own
            for k, g in self.gradients(x, y).items():
                a, b = m[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                self.p[k] -= rate * (0.1 if t > 0.8 * steps else 1) * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
            self.p["conv"] *= self.mask
        return self

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        grams = np.lib.stride_tricks.sliding_window_view(x, WIDE, axis=1)
        columns = p["embed"][grams].reshape(n, grams.shape[1], -1)
        z = columns @ p["conv"]
        at = z.argmax(1)
        pre = np.take_along_axis(z, at[:, None], 1)[:, 0] + p["bias"]
        h = np.maximum(pre, 0)
        e = softmax(h @ p["out"] + p["base"])
        e[np.arange(n), y] -= 1
        e /= n
        dh = (e @ p["out"].T) * (pre > 0)
        rows = np.arange(n)[:, None]
        chosen = columns[rows, at]
        spread = dh[..., None] * p["conv"].T[None]
        embed = np.zeros_like(p["embed"])
        np.add.at(embed, grams[rows, at], spread.reshape(n, -1, WIDE, EMBED))
        return {"embed": embed, "conv": np.einsum("nf,nfc->cf", dh, chosen), "bias": dh.sum(0), "out": h.T @ e, "base": e.sum(0)}

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Softmax for each window of (n, WINDOW) bytes."""
        p, out = self.p, []
        for at in range(0, len(x), BATCH_WINDOWS):
            part = x[at : at + BATCH_WINDOWS]
            best = None
            for phase in range(WIDE):  # grams that start at phase, phase + WIDE, ...: no overlap, so no copies
                m = (WINDOW - phase) // WIDE
                z = p["embed"][part[:, phase : phase + m * WIDE]].reshape(len(part) * m, WIDE * EMBED) @ p["conv"]
                z = z.reshape(len(part), m, -1).max(1)
                best = z if best is None else np.maximum(best, z)
            out.append(softmax(np.maximum(best + p["bias"], 0) @ p["out"] + p["base"]))
        return np.concatenate(out)

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """Language and mean probability of each text, over all its windows."""
        cut = [windows(t) for t in texts]
        every = self.probabilities(np.concatenate([w for w, _ in cut]))
        size = np.concatenate([s for _, s in cut]).astype(np.float64)
        starts = np.cumsum([0, *(len(s) for _, s in cut)])[:-1]
        mean = np.add.reduceat(every * size[:, None], starts, axis=0) / np.add.reduceat(size, starts)[:, None]
        return [(self.langs[k], min(1.0, float(row[k]))) for row, k in zip(mean, mean.argmax(1))]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, per_lang: int = SAMPLE, pieces: int = PIECES, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(lang, piece) to learn from, at most `pieces` of each language and `rows` in all.

    Languages are counted first, without reading texts; a document is drawn if its hash lies in the share of its
    language that holds twice per_lang documents, so few texts are cut however many there are.
    """
    usable = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out())
    counts = materialize(usable.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) / float(1 << 31) < F.lit(2.0 * per_lang) / F.col("n")
    drawn = small_or_salted_join(usable, counts, ["lang"]).filter(share)
    cut = drawn.select("lang", "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{PIECE}}})"), 1)).alias("at", "piece")).filter(F.col("piece").rlike(r"\p{L}"))
    keyed = cut.withColumn("h", F.xxhash64("doc_id", "at"))
    ranked = keyed.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id", "at", "piece"))).filter(F.col("rank") <= pieces)
    return ranked.orderBy("rank", "lang", "h").limit(rows).select("lang", "piece")


def learn(docs: DataFrame, per_lang: int = SAMPLE, pieces: int = PIECES, rows: int = SAMPLE_ROWS, steps: int = STEPS) -> Network | None:
    found = sorted((r.lang, r.piece) for r in sample(docs, per_lang, pieces, rows).collect())
    if not found:
        return None
    langs = sorted({lang for lang, _ in found})
    at = {lang: k for k, lang in enumerate(langs)}
    return Network(langs).train([p.encode() for _, p in found], np.array([at[lang] for lang, _ in found]), steps)


def predict_languages(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t if t is not None and network is not None and letter.search(t) else None for t in part.column(2).to_pylist()]
                known = [i for i, t in enumerate(texts) if t is not None]
                out: list[tuple[str, float]] = [("und", 0.0)] * part.num_rows
                if known:
                    for i, got in zip(known, network.predict([texts[i].encode() for i in known])):
                        out[i] = got
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", _held_out().alias("held_out"), "text").mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read_table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    return predict_languages(docs, learn(docs))
