import random

import numpy as np
import xxhash

from foliospark.llm import simhash
from foliospark.llm.components import connected_components
from tests.llm.helpers import SCHEMA, awkward, clashing, frame


def plain_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(rows):
    """Brute force: (doc_id, fingerprint, component_id) over all pairs."""
    fps = [plain_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[top(i)] = top(j)
    out = []
    for i, r in enumerate(rows):
        ids = [x[0] for j, x in enumerate(rows) if top(j) == top(i) and x[0] is not None]
        out.append((r[0], f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rows = awkward(120)
    r = random.Random(5)
    for k in range(40):  # near copies: one word changed
        words = rows[k][1].split(" ")
        words[r.randrange(len(words))] = "changed"
        rows.append((5000 + k, " ".join(words), "en", "a", 1))
    got = sorted((tuple(x) for x in simhash.simhash_groups(frame(spark, rows)).collect()), key=repr)
    assert got == plain_groups(rows)
    again = sorted((tuple(x) for x in simhash.simhash_groups(clashing(spark, rows)).collect()), key=repr)
    assert again == got


def test_links_of_near_fingerprints_at_any_part_size(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(30)]
    near = [b ^ sum(1 << i for i in r.sample(range(64), r.randrange(0, 6))) for b in base for _ in range(20)]
    fps = sorted({*base, *near, 0, 15, 31})
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 4:
                root[max(top(a), top(b))] = min(top(a), top(b))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    prints = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    for part in (7, 4096):
        found = {x.node: x.root for x in connected_components(simhash.links(prints, part)).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(found.get(signed(f), signed(f)), set()).add(f)
        expected = {}
        for f in fps:
            expected.setdefault(top(f), set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_rows_go_to_parts_within_the_radius_only(spark):
    """All in one bucket: fingerprints that share their first block, of population counts from 0 to 51."""
    fps = [((1 << k) - 1) << 13 | (i << 40) & ((1 << 63) - 1) for k in range(0, 27) for i in range(8)]
    fps = sorted(set(fps))
    units = {}
    for r in simhash.units(spark.createDataFrame([(f,) for f in fps], "fp bigint"), 16).filter("block = 0 AND value = 0").collect():
        units.setdefault((r.a, r.b), {}).setdefault(r.part, []).append(r.fp.bit_count())
    parts = {p: (min(v), max(v)) for (a, b), u in units.items() if a == b for p, v in u.items()}
    assert len(parts) > 5
    for (a, b), u in units.items():
        if a != b and len(u) == 2:
            assert min(u[b]) - max(u[a]) <= 4 + max(parts[a][1] - parts[a][0], parts[b][1] - parts[b][0])
    assert len([u for u in units.values() if len(u) == 2]) < len(parts) * (len(parts) - 1) // 2


def test_components_with_hot_nodes_are_the_same(spark, monkeypatch):
    from foliospark.llm import common, components

    edges = [(1, i) for i in range(2, 400)] + [(i, i + 1) for i in range(500, 540)] + [(399, 540)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    want = {x.node: x.root for x in connected_components(df).collect()}
    monkeypatch.setattr(components, "SMALL_PAIRS", 0)
    monkeypatch.setattr(common, "HOT", 8)
    assert {x.node: x.root for x in connected_components(df).collect()} == want and set(want.values()) == {1}


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    random.Random(1).shuffle(edges)
    found = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(found[i] == 1 for i in range(1, 201)) and all(found[1000 + i] == 1000 for i in range(300)) and found[5000] == 5000


def test_empty(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert simhash.simhash_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dedup_keeps_one_row_of_each_group(spark):
    rows = awkward(40)
    kept = simhash.simhash_dedup(clashing(spark, rows)).collect()
    groups = {x[1:] for x in plain_groups(rows)}
    assert len(kept) == len({plain_groups(rows)[i][2] for i in range(len(rows))}) or len(kept) == len(groups)
    fps = [plain_fingerprint(r.text) for r in kept]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])
    assert len(kept[0]) == 16


def test_tiles_skip_nothing_that_links():
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = np.concatenate([x[:100] ^ np.uint64(5), x[100:140] ^ np.uint64(255)])
    x, y = (a[np.argsort(np.bitwise_count(a), kind="stable")] for a in (x, y))
    got = {(int(i), int(j)) for a, b in simhash.tiled_links(x, y, tile=16) for i, j in zip(a, b)}
    want = {(i, j + 300) for i in range(300) for j in range(len(y)) if int(x[i] ^ y[j]).bit_count() <= 4}
    assert got == want
