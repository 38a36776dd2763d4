import re
from collections import defaultdict

from foliospark.llm import mixing
from tests.llm.helpers import SCHEMA, awkward, clashing, frame


def plain_targets(sizes):
    """Reshare the excess until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        w = sum(weight[s] for s in order if s not in capped)
        target = {s: 2 * sizes[s] if s in capped else rest * weight[s] / w for s in order}
        over = {s for s in order if target[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_report(spark):
    rows = awkward(150)
    got = mixing.mix_report(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_report(clashing(spark, rows)).collect()), key=repr)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    target = plain_targets(sizes)
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 4)) for r in got), key=repr) == sorted(((r[0], size(r[1]), sizes[r[3]], round(target[r[3]], 4)) for r in rows), key=repr)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.source_size] += r.taken
    for s in sizes:
        assert abs(taken[sizes[s]] - target[s]) < 1
    assert mixing.mix_report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_schedule(spark):
    sources = spark.createDataFrame([(0, 1000.0), (1, 100.5), (2, 0.0), (3, 3.0)], "sid int, target double")
    slots = sorted(mixing.schedule(sources, block=2, chunk=16).collect())
    ranks = defaultdict(list)
    for x in slots:
        ranks[x.sid].append(x.rank)
    assert {s: sorted(r) for s, r in ranks.items()} == {0: list(range(500)), 1: list(range(50)), 3: [0, 1]}
    assert all(r == sorted(r) for r in ranks.values()) and len({x.slot for x in slots}) == len(slots)
    # low discrepancy: every prefix and every run of slots holds a source in about its share
    for s, quota in ((0, 500), (1, 50), (3, 2)):
        n = 0
        for i, x in enumerate(slots):
            n += x.sid == s
            assert abs(n - (i + 1) * quota / len(slots)) <= 3
    for at in range(0, 500, 50):
        n = sum(x.sid == 1 for x in slots[at : at + 55])
        assert 2 <= n <= 8


def test_schedule_is_the_first_slots_of_the_endless_sequence(spark):
    gold = (int(0.6180339887498949 * (1 << 61)) | 1) / (1 << 61)
    for quotas in ([7], [1, 1], [1, 5000], [3, 0, 900, 1, 40], [1] * 30):
        sources = spark.createDataFrame([(i, float(q)) for i, q in enumerate(quotas)], "sid long, target double")
        got = sorted(tuple(x) for x in mixing.schedule(sources, block=1, chunk=8).collect())
        want, had, slot = [], [0] * len(quotas), 0
        owner = [i for i, q in enumerate(quotas) for _ in range(q)]
        while had != quotas:
            s = owner[int((slot * gold) % 1 * len(owner))]
            if had[s] < quotas[s]:
                want.append((slot, s, had[s]))
                had[s] += 1
            slot += 1
        assert got == want


def test_slots_order_the_mixture(spark):
    rows = awkward(150)
    first = {}
    for r in mixing.mix_report(frame(spark, rows)).collect():
        assert (r.first_slot is None) == (r.taken == 0) == (r.pieces == 0)
        first.setdefault(r.doc_id, []).append(r.first_slot)
    out = mixing.mix_documents(frame(spark, rows), slot="slot")
    assert out.columns[-1] == "slot"
    for part in out.rdd.glom().collect():
        assert [r.slot for r in part] == sorted(r.slot for r in part)
    for r in out.collect():
        assert r.slot >= min(x for x in first[r.doc_id] if x is not None)


def test_mixture_takes_each_word_range_once_a_pass(spark):
    rows = awkward(60)
    df = frame(spark, rows)
    _, light, sources = mixing._measured(mixing.pick(df, "doc_id", "source", "text"), "doc_id", "source", "text", ["doc_id"])
    spans = defaultdict(list)
    for x in mixing.mixture(light, sources, block=7).collect():
        spans[x.rid_, x["pass"]].append((x.from_word, x.to_word))
        assert 0 < x.to_word - x.from_word <= 7
    for pieces in spans.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))


def test_documents_of_the_mixture(spark):
    rows = awkward(60)
    out = mixing.mix_documents(clashing(spark, rows)).collect()
    taken, report = defaultdict(int), defaultdict(int)
    for r in out:
        taken[r.doc_id] += size(r.text)
        assert len(r) == 16
    for r in mixing.mix_report(frame(spark, rows)).collect():
        report[r.doc_id] += r.taken
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in report.items() if v}
