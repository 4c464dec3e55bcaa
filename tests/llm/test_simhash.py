import random
import re

import numpy as np
import pytest
import xxhash

from webloom.llm import simhash as S


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def by_hand(rows, radius=3):
    fps = [plain_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                root[a] = b
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, f"{fps[i]:016x}", least.get(top(i))) for i, (d, _) in enumerate(rows)), key=repr)


def got(df, **kw):
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component) for r in S.near_duplicates(df, **kw).collect()), key=repr)


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(docs) == by_hand(rows)
    out = S.op3_simhash(spark, sf).collect()
    assert sorted(map(tuple, out), key=repr) == by_hand(rows)


def test_odd_rows(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "a", "A b", "a B", "a b c", "É é x y", "w " * 70_000, "\x1c\x85 x"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a"), (None, "only null"), (3, "a")]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, component int")
    assert got(df) == by_hand(rows)
    assert S.near_duplicates(df.limit(0)).count() == 0


def chained(n, seed, flips=(0, 1, 2, 3, 4)):
    """Fingerprints in chains of few changed bits, some with many neighbours."""
    rnd = random.Random(seed)
    fps = []
    while len(fps) < n:
        f = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 40])):
            fps.append(f)
            for _ in range(rnd.choice(flips)):
                f ^= 1 << rnd.randrange(64)
    return sorted(set(fps))


@pytest.mark.parametrize(("radius", "tile", "block"), [(3, 4096, 1024), (3, 16, 1024), (2, 8, 1024), (7, 64, 1024), (0, 4, 1024)])
def test_links_connect_as_all_pairs_do(spark, radius, tile, block):
    fps = chained(600, radius * 100 + tile)
    fps += [f ^ (0xFFFF << 48) ^ i for i, f in enumerate([fps[0]] * 50)]  # many that share slices
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    root = {f: f for f in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = dict(map(tuple, S.connected(S.links(df, radius, tile)).collect()))
    assert found == {f: top(f) for f in fps if top(f) != f}


def test_one_of_each(spark):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long, "x"), (2, long, "y"), (7, long + " end", "z"), (7, "something else", "a"), (9, "more", "b"), (9, "more", "b"), (None, None, "c"), (11, "", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string")
    got = sorted(map(tuple, S.one_of_each(df).collect()), key=repr)
    assert got == sorted([(2, long, "y"), (7, "something else", "a"), (9, "more", "b"), (None, None, "c")], key=repr)


def roots_by_hand(fps, radius):
    root = {f: f for f in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {f: top(f) for f in fps if top(f) != f}


@pytest.mark.parametrize(("radius", "group", "large", "tile"), [(3, 64, 32, 8), (3, 10_000, 100, 16), (1, 4, 8192, 2), (5, 8, 16, 4), (3, 1, 8192, 16)])
def test_groups_and_tiles_of_any_size(spark, radius, group, large, tile):
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in chained(500, group + radius)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    assert dict(map(tuple, S.connected(S.links(df, radius, group, large, tile)).collect())) == roots_by_hand(fps, radius)


@pytest.mark.parametrize("n", [1, 2048, 10**5, 10**8, 10**10, 10**13])
@pytest.mark.parametrize("radius", [0, 1, 3, 6])
def test_a_mask_of_each_choice_of_bits(n, radius):
    """Whatever bits two fingerprints differ in, some mask has none of them."""
    rnd, found = random.Random(n), S.masks(n, radius)
    for _ in range(300):
        differ = sum(1 << b for b in rnd.sample(range(64), radius))
        assert any(not m & differ for m in found)
    assert len(found) <= 84 and (n > 2048) == (found != [0])


def test_tiles_that_documents_are_compared_in(spark, sf):
    """The links of a real table come from tiles: some pairs of tiles are compared, others skipped by their bit counts."""
    fps = S.fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).select("fp").distinct()
    groups = {}
    for g, fp in S.grouped(fps, group=256).collect():
        groups.setdefault(g, []).append(fp)
    pairs = [near for x in groups.values() for *_, near in S.tile_pairs(np.sort(np.bitwise_count(np.array(x).view(np.uint64))).astype(np.int64), 3, 16)]
    assert pairs.count(True) > 10 and pairs.count(False) > 10
    assert sum(len(x) for x in groups.values()) == fps.count() * len(S.masks(fps.count(), 3, 256)) and max(map(len, groups.values())) > 64
    assert dict(map(tuple, S.connected(S.links(fps)).collect())) == roots_by_hand(sorted(r.fp for r in fps.collect()), 3)
