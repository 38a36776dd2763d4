import json
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from foliospark.llm import tokencount
from tests.llm.helpers import SCHEMA, awkward, clashing, frame

ODD = [*"abcdefgstmrevl ' ' '\n\t!?.,09", *"éßÀÖñçÑ", "İ", "ſ", "K", "Å", "é", "́", "日", "本", "\U0001f600", "½", "²", "٣", " ", "　", "\x85", "\x1c", "\0",
       "<|endoftext|>", "<|startoftext|>", "<|", "ΑΣ", "Σ", "ǆ", "Ǆ", "ﬁ"]


def library_counts(texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def odd_texts(n=1500):
    r = random.Random(1)
    return [
        *("".join(r.choice(ODD) for _ in range(r.randrange(80))) for _ in range(n)),
        "".join(r.choice("abcdinthe") for _ in range(5000)), "x" * 3000, "", "  ", "a" * 700 + " b", "'s'tre've'll 're's's'",
    ]


def test_counts_are_the_librarys():
    texts = odd_texts()
    assert tokencount.counter().counts(texts) == library_counts(texts)


def test_recompiling_changes_nothing(monkeypatch):
    own = tokencount.Counter(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(tokencount, "MAX_CELLS", 1 << 17)
    monkeypatch.setattr(tokencount, "SLICE", 2000)
    texts = odd_texts(400)
    assert own.counts(texts) == library_counts(texts)


def test_chunk_size_changes_nothing():
    machine = tokencount.counter().machine
    r = np.random.default_rng(0)
    stream = r.choice([*b"aeinthsrd", 256], 5000).astype(np.int64)
    stream = np.concatenate([stream[:1000], r.choice([*b"aeinth"], 900), stream[1000:], [256]])
    stream = stream[np.concatenate([[stream[0] != 256], (stream[1:] != 256) | (stream[:-1] != 256)])]
    whole = machine.run(stream, len(stream))
    for chunk in (1, 2, 7, 64, 1000):
        assert (machine.run(stream, chunk) == whole).all()


def test_long_words_by_composed_maps(monkeypatch):
    """Long words of every kind: the prefix scan, few repeats of it, and following symbols where it is cut short."""
    machine = tokencount.counter().machine
    r = np.random.default_rng(3)
    words = [r.choice([*b"aeinthsrd"], 900), np.full(700, ord("a")), np.tile([*b"ab"], 300), np.tile([*b"the"], 200), np.tile([*b"ha"], 5), r.integers(97, 123, 800), np.full(300, ord("-"))]
    stream = np.concatenate([x for w in [*words, *words[::-1]] for x in (w, [256])]).astype(np.int64)
    whole = machine.run(stream, len(stream))
    for rounds, suspected in ((24, 2), (1, 0), (0, 0), (3, 1)):
        monkeypatch.setattr(tokencount, "ROUNDS", rounds)
        monkeypatch.setattr(tokencount, "SUSPECTED", suspected)
        for chunk in (7, 64):
            assert (machine.run(stream, chunk) == whole).all(), (rounds, suspected, chunk)


def test_pairs_are_compatible_just_if_they_encode_themselves():
    path = public_tokenizers.path("word_bpe_49k.json")
    machine = tokencount.counter().machine
    model = Tokenizer.from_file(path).model
    with open(path, encoding="utf-8") as f:
        names = list(json.load(f)["model"]["vocab"])
    r = random.Random(7)
    plain = [t for t in names if not t.endswith("</w>") and not t.startswith("<|")]
    for _ in range(4000):
        a, b = r.choice(plain), r.choice([t for t in (r.choice(names) for _ in range(50)) if t.endswith("</w>")])
        assert machine.compatible(a, b) == ([t.value for t in model.tokenize(a + b.removesuffix("</w>"))] == [a, b])


def test_frame(spark):
    rows = [*awkward(60), *((8000 + i, t, "en", "a", 1) for i, t in enumerate(odd_texts(60)) if "\0" not in t)]
    got = sorted(map(tuple, tokencount.token_counts(frame(spark, rows)).collect()), key=repr)
    n = library_counts([r[1] or "" for r in rows])
    assert got == sorted(((r[0], len((r[1] or "").encode()), k, k > 2048) for r, k in zip(rows, n)), key=repr)
    assert sorted(map(tuple, tokencount.token_counts(clashing(spark, rows)).collect()), key=repr) == got
    assert tokencount.token_counts(spark.createDataFrame([], SCHEMA)).count() == 0
