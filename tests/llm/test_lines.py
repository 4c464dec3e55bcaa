import random

import numpy as np
import pyarrow as pa

from webloom.llm import lines as L


def shingles(line, k=L.SHINGLE):
    return {line[i : i + k] for i in range(len(line) - k + 1)} or {line}


def roots_by_hand(lines, least=L.SIMILARITY):
    """Least index of each distinct line's component, all pairs compared."""
    sets = [shingles(x) for x in lines]
    root = list(range(len(lines)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(lines))]


def by_hand(rows):
    """rows (doc_id, text) in ascending order -> texts that are left."""
    distinct = sorted({x for _, t in rows for _, x in L.lines_of(t)})
    root = dict(zip(distinct, roots_by_hand(distinct), strict=True))
    first, out = {}, {}
    for d, t in rows:
        left = []
        for i, x in enumerate((t or "").split("\n")):
            s = x.strip()
            if not s or first.setdefault(root[s], (d, i)) == (d, i):
                left.append(x)
        out[d] = None if t is None else "\n".join(left)
    return out


def test_all_documents_of_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 120")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r.text for r in L.dedup_lines(docs).collect()}
    want = by_hand(rows)
    assert got == want


def edited(rnd, line, n):
    w = line.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = "".join(rnd.choices("abcdefgh", k=5))
    return " ".join(w)


def test_chains_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(L, "TILE", 16)
    rnd = random.Random(3)
    base = [" ".join("".join(rnd.choices("abcdefghijkl", k=rnd.randrange(2, 8))) for _ in range(rnd.choice([4, 30, 60]))) for _ in range(25)]
    rows, d = [], 0
    for b in base:
        x = b
        for _ in range(rnd.choice([1, 2, 5, 40])):
            rows.append((d, f"{x}\n\n  {rnd.choice(base)}  "))
            x, d = edited(rnd, x, rnd.choice([0, 1, 1])), d + 1
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == by_hand(rows)


def test_large_bands_that_hold_several_components_are_compared_whole(spark):
    run = L._compared(0.8)
    lines = ["the quick brown fox jumps over the lazy dog " + s for s in ("again", "agaim", "and then it sleeps for a very long time in the sun")]
    b = pa.RecordBatch.from_arrays([pa.array([1, 1, 1]), pa.array([5, 6, 7]), pa.array([5, 6, 7]), pa.array(lines)], ["g", "line", "root", "text"])
    out = [tuple(r.values()) for x in run([b]) for r in x.to_pylist()]
    assert out == [(6, 5)]


def test_alike_and_all_alike():
    rnd = random.Random(9)
    x = ["".join(rnd.choices("ab", k=rnd.randrange(1, 30))) for _ in range(60)]
    x += [edited(rnd, "one two three four five six seven eight nine ten eleven twelve", i % 3) for i in range(30)]
    sets, got = [shingles(s) for s in x], L.shingle_sets(x)
    assert [len(s) for s in got] == [len(s) for s in sets]
    for least in (0.5, 0.8, 1.0):
        want = {(i, j) for j in range(len(x)) for i in range(j) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])}
        assert set(zip(*map(list, L.all_alike(got, least)), strict=True)) == want
        assert {(i, j) for j in range(len(x)) for i in range(j) if L.alike(got[i], got[j], least)} == want


def test_recall_of_banding_at_the_threshold():
    rnd = random.Random(5)
    hit = total = 0
    while total < 300:
        a = " ".join("".join(rnd.choices("abcdefghijklmnop", k=rnd.randrange(2, 9))) for _ in range(rnd.randrange(8, 60)))
        b = edited(rnd, a, rnd.choice([1, 1, 2, 3]))
        x, y = shingles(a), shingles(b)
        if a != b and 0.8 <= len(x & y) / len(x | y) < 0.9:
            g = L.bands_of([a, b])
            hit, total = hit + bool((g[0] == g[1]).any()), total + 1
    assert hit >= 297


def test_bands_do_not_depend_on_the_batch():
    rnd = random.Random(2)
    x = ["".join(rnd.choices("abc é", k=rnd.choice([1, 3, 6, 7, 8, 50, 3000]))).strip() or "z" for _ in range(60)]
    all_ = L.bands_of(x)
    assert all(np.array_equal(L.bands_of([s])[0], all_[i]) for i, s in enumerate(x))


def test_odd_rows(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "a\n\na\r\n b\nb", "s"), (None, "zero line of text", "s"), (4, "zero line of text\nx" + "y" * 50_000, "s"), (4, "zero line of text\nx" + "y" * 50_000, "s"), (5, "a\na", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, line string")
    got = sorted(((r.doc_id, r.text, r.lines_dropped) for r in L.dedup_lines(df).collect()), key=repr)
    y = "x" + "y" * 50_000
    assert got == sorted([(1, None, 0), (2, "", 0), (3, "a\n\n b", 2), (None, "zero line of text", 0), (4, y, 1), (4, y, 1), (5, "", 2)], key=repr)
    assert L.dedup_lines(df.limit(0)).count() == 0


def test_the_query_over_a_whole_table(spark, sf):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert {r.doc_id: r.text for r in L.op5_lines(spark, sf).collect()} == by_hand(rows)


def test_shuffled_sides(spark, sf, monkeypatch):
    """The way beyond the broadcast limits gives the same."""
    monkeypatch.setattr(L, "MOST_ROWS", 0)
    monkeypatch.setattr(L, "FEW", 2)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    assert {r.doc_id: r.text for r in L.dedup_lines(docs).collect()} == by_hand(rows)


def test_numbers_that_clash(spark):
    """Different lines of one number are told apart by the rest of their digest."""
    rnd = random.Random(8)
    base = [" ".join("".join(rnd.choices("abcdefghijkl", k=5)) for _ in range(12)) for _ in range(30)]
    rows = [(i, "\n".join([b, edited(rnd, b, i % 2), rnd.choice(base), "short", f"n{i}"])) for i, b in enumerate(base)]
    few = lambda line: (L.line_id(line)[0] % 5, L.line_id(line)[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in L.dedup_lines(df, ids=few).collect()} == by_hand(rows)


def templates(n, seed, k=24):
    rnd = random.Random(seed)
    return ["the account of the harbour master for the month: " + "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=k)) for _ in range(n)]


def test_lines_of_one_template(spark):
    """Many lines that share a template but aren't alike, and some that are."""
    lines = templates(400, 1)
    lines += [x[:-1] + "!" for x in lines[:100]] + templates(60, 2, 7)
    rows = [(i, x) for i, x in enumerate(lines)]
    assert {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == by_hand(rows)


def test_prefixes_of_alike_sets_meet():
    rnd = random.Random(6)
    often = np.array([rnd.randrange(1, 9) for _ in range(64)])
    for _ in range(3000):
        n = rnd.randrange(1, 60)
        x = set(rnd.sample(range(200), n))
        y = set(x)
        for _ in range(rnd.randrange(1 + n // 5)):
            y.discard(rnd.choice(sorted(y))) if rnd.random() < 0.5 and len(y) > 1 else y.add(rnd.randrange(200))
        if len(x & y) < 0.8 * len(x | y):
            continue
        meet = []
        for s in (x, y):
            meet.append([(e, part, role) for xs, part, role in L.prefix(np.array(sorted(s), np.uint64), often, 0.8) for e in xs.tolist()])
        assert any(a[:2] == b[:2] and a[2] + b[2] < 2 for a in meet[0] for b in meet[1])


def test_bands_that_are_split(spark, monkeypatch):
    """The same lines with every large band split by rarest shingles."""
    monkeypatch.setattr(L, "SPLIT", 8)
    lines = templates(120, 1)
    lines += [x[:-1] + "!" for x in lines[:40]] + templates(40, 2, 7)
    assert {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()} == by_hand(list(enumerate(lines)))


def test_bands_are_dealt_out_in_a_few_rows_and_only_shared_ones_come_back(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    lines = sorted({x for r in docs.collect() for _, x in L.lines_of(r.text)})
    of = {}
    for x, bands in zip(lines, L.bands_of(lines).tolist(), strict=True):
        for b in bands:
            of.setdefault(b, set()).add(L.line_id(x)[0])
    told = lambda df: df
    told.any = False
    rows = L.banded(docs, "text", L.lines_of, L.SHINGLE, L._hashed, L.line_id, told, len(lines))
    got = {}
    for r in rows.collect():
        got.setdefault(r.band, set()).add(r.line)
    assert got == {b: x for b, x in of.items() if len(x) > 1}


def test_shared_bands_whatever_the_batches():
    rnd = random.Random(7)
    rows = [(rnd.randrange(-400, 400) if rnd.random() < 0.9 else 5, rnd.randrange(30)) for _ in range(3000)] + [(10**6 + i, i) for i in range(500)] * 2
    rnd.shuffle(rows)
    of = {}
    for b, x in rows:
        of.setdefault(b, set()).add(x)
    for parts, most, size in ((1, 10, 7), (3, 100, 1000), (5, 10**6, 50)):
        cut = [rows[i : i + size] for i in range(0, len(rows), size)]
        made = [pa.RecordBatch.from_arrays([pa.array([b for b, _ in c], pa.int64()), pa.array([x for _, x in c], pa.int64())], ["band", "line"]) for c in cut]
        packed = list(L._packed(iter, parts, most)(made))
        assert all(0 <= p < parts for b in packed for p in b.column(0).to_pylist())
        got = {}
        for out in L._shared(packed, most):
            for b, x in zip(*(out.column(i).to_pylist() for i in (0, 1)), strict=True):
                got.setdefault(b, set()).add(x)
        assert got == {b: x for b, x in of.items() if len(x) > 1}


def test_only_keys_with_many_rows_are_split_beyond_the_limit(spark, monkeypatch):
    from webloom.llm import common

    monkeypatch.setattr(common, "MANY", 50)
    rows = [(k, i) for k, n in (("a", 1), ("b", 50), ("c", 51), ("d", 700)) for i in range(n)] + [("z", 0)]
    left = spark.createDataFrame(rows, "key string, at int")
    right = left.where("key <> 'z'").groupBy("key").agg(L.F.count("*").alias("n"))
    both = common.spread(left, right, "key", "at", 0, many="n")
    assert sorted((r.key, r.at, r.n) for r in both.collect()) == sorted((k, i, {"a": 1, "b": 50, "c": 51, "d": 700}[k]) for k, i in rows if k != "z")
    few = common.spread(left, right.where("n <= 50"), "key", "at", 0, many="n")
    assert few.count() == 51 and "Generate" not in few._jdf.queryExecution().toString()  # no key, no copies of right's rows
    none = common.spread(left, right, "key", "at", 0, "left", many="n")
    assert none.count() == len(rows)


def test_shuffled_sides_with_split_keys(spark, sf, monkeypatch):
    from webloom.llm import common

    monkeypatch.setattr(L, "MOST_ROWS", 0)
    monkeypatch.setattr(common, "MANY", 3)
    monkeypatch.setattr(L, "BANDS_A_PART", 500)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    assert {r.doc_id: r.text for r in L.dedup_lines(docs).collect()} == by_hand(sorted((r.doc_id, r.text) for r in docs.collect()))


def test_near_copies_of_one_line_do_not_meet_by_their_rarest_shingles(spark, monkeypatch):
    """A large component and a few lines outside it: those are compared with it, however large it is."""
    monkeypatch.setattr(L, "SPLIT", 20)
    monkeypatch.setattr(L, "TILE", 16)
    monkeypatch.setattr(L, "rarest", lambda *a: 1 / 0)
    rnd = random.Random(8)
    base = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=240)).strip()
    lines = [base[:i] + "#" + base[i + 1 :] for i in range(1, 101)]  # one component
    lines += [base[:i] + "".join(rnd.choices("0123456789", k=60)) + base[i + 60 :] for i in range(3, 13)]  # outside it
    rows = [(i, x) for i, x in enumerate(lines)]
    want = by_hand(rows)
    assert sum(map(bool, want.values())) == 11
    assert {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_tiles_have_all_pairs_but_those_within_the_core(spark, monkeypatch):
    monkeypatch.setattr(L, "TILE", 4)
    rows = [(7, i, 1 if i < 30 else i, 42, 12, i < 30) for i in range(42)]
    schema = "large long, line long, root long, size long, outer long, core boolean, inner boolean"
    for inner in (True, False):
        tiles = {}
        for r in L._tiles(spark.createDataFrame([(*r, inner) for r in rows], schema)).collect():
            tiles.setdefault(r.g, set()).add(r.line)
        met = {(a, b) for t in tiles.values() for a in t for b in t if a < b}
        assert {(a, b) for a in range(30) for b in range(30, 42)} <= met
        assert not inner or {(a, b) for a in range(30, 42) for b in range(a + 1, 42)} <= met
        assert max(map(len, tiles.values())) < 30


def test_alike_of_some_sets():
    rnd = np.random.default_rng(4)
    sets = [np.unique(rnd.integers(0, 40, rnd.integers(1, 40)).astype(np.uint64)) for _ in range(60)]
    some = rnd.random(60) < 0.3
    pairs = lambda x: {tuple(sorted(p)) for p in zip(*map(np.ndarray.tolist, x), strict=True)}
    got = L.all_alike(sets, 0.5, some)
    assert len(got[0]) == len(pairs(got)) and pairs(got) == {p for p in pairs(L.all_alike(sets, 0.5)) if some[p[0]] or some[p[1]]}
