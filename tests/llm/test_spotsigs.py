import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest

from webloom.llm import spotsigs as S


def by_hand(rows):
    """The query's rows from all documents in memory."""
    key = lambda r: (r[0] is not None, r[0] or 0)
    rows = sorted(((d, t or "") for d, t in rows), key=key)
    out = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        q = len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        a, b, c = (set(S.signatures(x).tolist()) for x in (t, e, nxt))
        like = lambda x, y: 1.0 if not x and not y else len(x & y) / len(x | y)
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), S.encoded(S.signatures(t)), S.encoded(S.signatures(e)), like(a, b), like(a, c)))
    return out


def got(df):
    return [tuple(r) for r in S.compared_to_next(df).collect()]


def test_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = got(docs)
    assert sorted(found) == sorted(by_hand(rows))
    # three quarters in common of one and a quarter: 0.6
    assert 0.5 < np.mean([r[5] for r in found]) < 0.7 and np.mean([r[6] for r in found]) < 0.1


@pytest.mark.parametrize("n", [1, 2, 3, 50])
def test_odd_rows(spark, n):
    odd = [None, "", "the", "x", "字字字 の 中", "the " * 50, "!!! ???", "a b c " * 20000, "Ünï the kódé of \U0001f600 x" * 3]
    rnd = random.Random(n)
    rows = [(i * 7 - 20, rnd.choice(odd)) for i in range(n)] + ([(None, "the null id row")] if n == 50 else [])
    rnd.shuffle(rows)
    df = spark.createDataFrame([(d, t, "z", 1) for d, t in rows], "doc_id long, text string, part string, k int")
    assert sorted(got(df), key=repr) == sorted(by_hand(rows), key=repr)


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "the one thing here"), (1, "the one thing here"), (1, "of another")], "doc_id long, text string")
    assert len(got(df)) == 3 and S.compared_to_next(df.limit(0)).count() == 0


def test_number_below(spark):
    for cuts in ([], [5], [1, 2, 3], list(range(0, 170, 10))):
        for r in spark.range(-5, 200, 3).select("id", S._number_below(cuts, S.F.col("id")).alias("p")).collect():
            assert r.p == sum(c < r.id for c in cuts)


def test_signatures():
    one = S.signatures("At a rally to kick off the weeklong campaign for the South Carolina primary")
    assert set(one) >= {S.xxhash.xxh32_intdigest(x) for x in ("rally kick", "weeklong campaign", "south carolina")}
    assert np.array_equal(S.signatures("THE weeklong, campaign!"), S.signatures("the weeklong campaign"))
    words = [f"w{i}" for i in range(40)]  # no anchors: every few words
    assert 4 <= len(S.signatures(" ".join(words))) <= 6
    assert len(S.signatures(None)) == len(S.signatures(" \n")) == 0 and len(S.signatures("?!")) == 1
    assert np.array_equal(S.decoded(S.encoded(one)), one)


def test_near_duplicates_against_all_pairs(spark):
    rnd = random.Random(4)
    words = ["the", "of", "and", *("".join(rnd.choices("abcdefg", k=5)) for _ in range(300))]
    texts = []
    for _ in range(40):
        t = [rnd.choice(words[:3] if rnd.random() < 0.3 else words) for _ in range(rnd.choice([3, 30, 120]))]
        for _ in range(rnd.choice([1, 1, 3, 6])):
            texts.append(" ".join(t))
            t[rnd.randrange(len(t))] = rnd.choice(words)
    texts += ["", None, " "]
    sigs = [set(S.signatures(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        return i if root[i] == i else top(root[i])

    for i in range(len(texts)):
        for j in range(i):
            u = len(sigs[i] | sigs[j])
            if (not u) or len(sigs[i] & sigs[j]) / u >= 0.8:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component for r in S.near_duplicates(df).collect()} == {i: top(i) for i in range(len(texts))}


def components_by_hand(rows, least=S.SIMILARITY):
    sets = [frozenset(S.signatures(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            u = len(sets[i] | sets[j])
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * u:
                root[max(top(i), top(j))] = min(top(i), top(j))
    of = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            of[top(i)] = min(d, of.get(top(i), d))
    return Counter((d, of.get(top(i))) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_the_query_has_the_components(spark, sf, monkeypatch, most):
    monkeypatch.setattr(S, "MOST_SETS", most)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = S.op2_spotsigs(spark, sf).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == components_by_hand(rows)
    assert sorted(tuple(r)[:7] for r in out) == sorted(by_hand(rows))


def test_components_of_odd_rows(spark):
    rows = [(3, "the one thing here and the other"), (1, "the one thing here and the other"), (1, "of another kind altogether"), (None, "of another kind altogether"), (None, "alone in the world"), (7, ""), (8, None), (-2, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.component_id) for r in S.compared_to_next(df, least=0.8).collect()) == components_by_hand(rows)


def test_many_variants_of_one_text(spark):
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(5000)}" if rnd.random() < 0.6 else "the" for _ in range(300)]
    rows = []
    for i in range(3000):
        v = list(base)
        for at in rnd.sample(range(300), rnd.randrange(1, 8)):
            v[at] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(v)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    took = time.perf_counter()
    got = S.near_duplicates(df).groupBy("component").count().collect()
    assert max(r["count"] for r in got) > 2900 and time.perf_counter() - took < 60


def test_sketches_leave_all_alike_pairs_and_few_others():
    from webloom.llm.sketches import may_be_alike, pair_may_be_alike, sketch

    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 1 << 32, n, dtype=np.uint64)).astype(np.uint32) for n in (1, 2, 5, 30, 60, 100, 130, 500, 9000) for _ in range(6)]
    for s in list(sets):  # edited by less and less
        for kept in (0.7, 0.88, 0.9, 0.97, 1.0):
            sets.append(np.unique(np.concatenate([s[rnd.random(len(s)) < kept], rnd.integers(0, 1 << 32, rnd.integers(0, 2 + len(s) // 9), dtype=np.uint64).astype(np.uint32)])))
    sketches, sizes = [sketch(s) for s in sets], np.array([len(s) for s in sets])
    for least in (0.5, 0.8, 1.0):
        alike = np.array([[S.likeness(a, b) >= least for b in sets] for a in sets])
        one = np.array([[pair_may_be_alike(x, n, y, m, least) for y, m in zip(sketches, sizes, strict=True)] for x, n in zip(sketches, sizes, strict=True)])
        assert not (alike & ~one).any() and not (alike & ~may_be_alike(sketches, sizes, least)).any()
        assert not (one & ~may_be_alike(sketches, sizes, least)).any()  # shorter sketches tell less
        if least >= 0.8:
            mid = np.flatnonzero((sizes >= 30) & (sizes <= 600))
            apart = np.array([[S.likeness(sets[a], sets[b]) < 0.3 for b in mid] for a in mid])
            assert (one[np.ix_(mid, mid)] & apart).sum() < 0.01 * apart.sum()


def test_only_sets_of_pairs_that_may_be_alike_are_moved(spark, monkeypatch):
    """Texts of few words share signatures, but hardly any two are alike: their sets stay where they are."""
    from webloom.llm import lines as L

    rnd = random.Random(21)
    texts = [" ".join(w for _ in range(60) for w in ("the", rnd.choice("abcdefghijklmno") * 3, rnd.choice("pqrstuvwxyz") * 3)) for _ in range(300)]
    texts += [t + " the end here" for t in texts[:20]]
    rows = list(enumerate(texts))
    counts, real = [], L._texts_of
    monkeypatch.setattr(L, "_texts_of", lambda lines, texts, tag: counts.append(lines.count()) or real(lines, texts, tag))
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.component) for r in got) == components_by_hand(rows)
    assert counts and max(counts) <= 60


def test_large_groups_of_several_components(spark, monkeypatch):
    """Bands that are compared whole, in tiles, beyond the broadcast limits too."""
    from webloom.llm import lines as L

    rnd = random.Random(22)
    common = " ".join(w for i in range(12) for w in ("the", f"c{i}", f"d{i}"))
    rows = []
    for i in range(150):
        own = " ".join(w for j in range(40) for w in ("of", f"k{rnd.randrange(10**6)}", f"l{j}"))
        rows.append((2 * i, f"{common} {own}"))
        if i % 3 == 0:
            rows.append((2 * i + 1, f"{common} {own} the x{i}"))
    want = None
    for few, tile, most in ((8, 512, 1_000_000), (2, 16, 1_000_000), (2, 16, 0)):
        monkeypatch.setattr(L, "FEW", few)
        monkeypatch.setattr(L, "TILE", tile)
        monkeypatch.setattr(L, "MOST_ROWS", most)
        monkeypatch.setattr(S, "MOST_SETS", most)
        got = Counter((r.doc_id, r.component) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
        want = want or components_by_hand(rows)
        assert got == want
