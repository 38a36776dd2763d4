import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from foliospark.llm import packing
from tests.llm.helpers import SCHEMA, awkward, clashing, frame


def whole_ids(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*t.encode(text or "", add_special_tokens=False).ids, 0]


def held(rows, out, capacity):
    """Every piece once, as the library's ids say; sequences gapless from 0 and within the capacity."""
    want = []
    for r in rows:
        ids = whole_ids(r[1])
        first = len(ids) % capacity or capacity
        at = [0, *range(first, len(ids), capacity)]
        for k, (a, b) in enumerate(zip(at, [*at[1:], len(ids)])):
            want.append((r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = [(x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for x in out:
        by[x.sequence_id].append((x.offset, x.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), sum(x.length for x in out)


def test_documents(spark):
    rows = awkward(120) + [(9000, "a <|endoftext|> b\x85c d \x1c e", "en", "a", 1), (9001, "日本語 ۱۲ é \U0001f600", "en", "a", 1)]
    for df, capacity, shard in ((frame(spark, rows), 256, 40), (clashing(spark, rows), 2048, 10_000)):
        sequences, total = held(rows, packing.pack_documents(df, capacity, shard).collect(), capacity)
        assert sequences <= -(-total // capacity) * 1.1 + 3
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ids_are_the_librarys():
    encode = packing.encoder("byte_bpe_50k")
    r = random.Random(3)
    chars = [*map(chr, range(1, 0x240)), *"    \n\n'''stredlm", " ", "　", "ſ", "\U0001f600", "ǆ", "<|endoftext|>"]
    for _ in range(400):
        text = "".join(r.choice(chars) for _ in range(r.randrange(60)))
        assert encode(text.encode()).tolist() == whole_ids(text)[:-1], text


def best_bins(lengths, capacity):
    """Fewest bins by exhaustive search."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                bins[k] += lengths[i]
                place(i + 1, bins)
                bins[k] -= lengths[i]
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


def least_bins(lengths, capacity):
    """The best lower bound from large items: those that share no bin, and what doesn't fit beside them."""
    best = -(-sum(lengths) // capacity)
    for k in range(0, capacity // 2 + 1, 16):
        alone = sum(x > capacity - k for x in lengths)
        large = [x for x in lengths if capacity / 2 < x <= capacity - k]
        small = sum(x for x in lengths if k <= x <= capacity / 2)
        best = max(best, alone + len(large) + max(0, -(-(small - sum(capacity - x for x in large)) // capacity)))
    return best


def test_local_search_against_exhaustive_search():
    r = random.Random(4)
    worse = improved = 0
    for _ in range(150):
        lengths = np.array([r.randrange(1, 60) for _ in range(r.randrange(1, 9))])
        start = packing.best_fit(lengths, 100, packing.largest_first(lengths))
        bins = packing.local_search(lengths, start, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(lengths[b].sum() <= 100 for b in bins)
        worse += len(bins) > best_bins(lengths.tolist(), 100)
        bad = [[i] for i in range(len(lengths))]  # from the worst start, too
        improved += len(packing.local_search(lengths, bad, 100)) - best_bins(lengths.tolist(), 100)
    assert worse <= 3 and improved <= 8
    big = np.random.default_rng(0).integers(1, 2048, 3000)
    start, steps, touched = packing.best_fit(big, 2048, range(3000)), {}, np.zeros(3000, np.int64)
    bins = packing.search(big, start, 2048, steps, touched)
    assert len(bins) < len(start) and len(bins) <= least_bins(big.tolist(), 2048) * 1.005 + 1
    assert min(steps[k] for k in ("move", "one for one", "two for one", "one for two")) > 0 and touched.sum() > 0


def test_least_bins_undercut_no_packing():
    r = random.Random(6)
    for _ in range(200):
        lengths = [r.randrange(1, r.choice([20, 60, 100])) for _ in range(r.randrange(0, 9))]
        bound = packing.least_bins(np.array(lengths, np.int64), 100)
        assert -(-sum(lengths) // 100) <= bound <= best_bins(lengths, 100)
    lengths = [r.randrange(1, 2048) for _ in range(500)]
    assert packing.least_bins(np.array(lengths), 2048) >= least_bins(lengths, 2048)


def test_cut():
    assert packing.cut(5, 2) == [(0, 1), (1, 2), (3, 2)] and packing.cut(4, 2) == [(0, 2), (2, 2)] and packing.cut(1, 2) == [(0, 1)]


def improves(lengths, bins, capacity):
    """Whether some bin has a step that raises the sum of squared fills, by trying them all."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    for a, own in enumerate(bins):
        gives = {int(lengths[i]) for i in own}
        pairs = {int(lengths[i] + lengths[j]) for k, i in enumerate(own) for j in own[k + 1 :]}
        for b, other in enumerate(bins):
            if a != b and fill[a] <= fill[b] < capacity:
                if any(lengths[i] + fill[b] <= capacity for i in own) or any(0 < g - lengths[j] <= capacity - fill[b] for g in gives | pairs for j in other):
                    return True
                if any(0 < g - lengths[i] - lengths[j] <= capacity - fill[b] for g in gives for k, i in enumerate(other) for j in other[k + 1 :]):
                    return True
    return False


def test_local_search_ends_where_no_step_improves():
    r = np.random.default_rng(5)
    for low, high, n, capacity in ((600, 800, 300, 2048), (30, 60, 400, 2048), (500, 1100, 300, 2048), (300, 420, 200, 1000)):
        for _ in range(3):
            lengths = r.integers(low, high, n)
            bins = packing.local_search(lengths, packing.best_fit(lengths, capacity, packing.largest_first(lengths)), capacity)
            assert len(bins) == packing.least_bins(lengths, capacity) or not improves(lengths, bins, capacity)


def test_leftover_bins_of_all_shards_are_searched(spark):
    rows = [(i, 0, 0, 60, i) for i in range(400)] + [(1000 + i, 0, 0, 35 + i % 8, i) for i in range(405)]
    df = spark.createDataFrame(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint").repartition(4)
    out = packing.pack_pieces(df, 100, 20).collect()
    assert sorted(r[:5] for r in out) == sorted(rows)
    by = defaultdict(list)
    for x in out:
        by[x.sequence_id].append((x.offset, x.length))
    for places in by.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 100
    fills = sorted(sum(n for _, n in places) for places in by.values())
    assert fills[0] + fills[1] > 100  # no shard has left a bin that another's could take


def test_the_search_saves_the_querys_sequences(spark):
    """From the plain order of rows, on the whole table: as few as the volume allows, by steps that are counted."""
    out = packing.op5_packing(spark, "/root/testdata/sf0.01").select("first_id", "sequence_id", "steps", "length").collect()
    begun, ended = len({x.first_id for x in out}), len({x.sequence_id for x in out})
    assert begun > ended and ended <= -(-sum(x.length for x in out) // 2048) + 1
    assert sum(x.steps > 0 for x in out) > 50
