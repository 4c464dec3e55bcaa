import hashlib
import math
from collections import Counter

import pytest

from webloom.llm import mix as M


def copies_by_hand(doc_id, rate, seed=42):
    u = (int(hashlib.md5(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    k, p, total = 0, math.exp(-rate), 0.0
    while rate and total + p <= u:
        total, k = total + p, k + 1
        p *= rate / k
    return k


def test_copies_are_poisson_draws(spark):
    rows = [(i, "x" * (10 if s == "a" else 1), s) for i, s in enumerate(["a"] * 300 + ["b"] * 900 + [None] * 20)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, source string, copy string")
    size = {"a": 3000, "b": 900, None: 20}
    want_w = {"a": 0.5, "b": 0.5, None: 0}
    out = M.mix(df, weights={"a": 2, "b": 2}).collect()
    got = Counter(r.doc_id for r in out)
    for i, _, s in rows:
        assert got[i] == copies_by_hand(i, want_w[s] * 3920 / size[s])
    assert all({r["copy"] for r in out if r.doc_id == i} == set(range(1, n + 1)) for i, n in list(got.items())[:50])
    chars = Counter()
    for r in out:
        chars[r.source] += len(r.text)
    assert abs(chars["a"] / sum(chars.values()) - 0.5) < 0.08


def test_order_is_global_and_repeatable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = M.mix(docs).collect(), M.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r["copy"]) for r in a) == Counter((r.doc_id, r["copy"]) for r in b)
    ids = [r.doc_id for r in a]
    assert ids != sorted(ids) and len({r.shuffle_key for r in a}) == len(a)


@pytest.mark.parametrize("rate", [0.01, 1.0, 3.7, 40.0, 900.0])
def test_large_and_small_rates(spark, rate):
    n = 400
    df = spark.createDataFrame([(i, "x", "a") for i in range(n)], "doc_id long, text string, source string")
    got = M.mix(df, epochs=rate).count() / n
    assert abs(got - rate) < 5 * math.sqrt(rate / n) + 0.01


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "", "z"), (1, "", "z"), (2, "x" * 100_000, "big")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = M.mix(df, epochs=2.0).collect()
    assert len({sum(r.doc_id == 1 for r in out) % 2}) == 1 and out is not None
    assert M.mix(df.limit(0)).count() == 0 and M.mix(df, weights={}).count() == sum(r.source != "big" for r in M.mix(df, weights={"big": 0.0}).collect())


def test_odd_rows_by_hand(spark, monkeypatch):
    """Nulls, empty texts, repeated rows and clashing names: each row as often as its id says, all columns as they were."""
    rows = [(None, None, None, 1), (1, "", "z", 2), (1, "", "z", 2), (2, "x" * 100_000, "big", 3), (3, "yy", None, 4), (4, "é", "small", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, name long")
    total = 100_003
    w = {s: n**M.ALPHA for s, n in (("big", 100_000), (None, 2), ("small", 1))}
    rate = {s: w[s] / sum(w.values()) * 2.0 * total / n for s, n in (("big", 100_000), (None, 2), ("small", 1))} | {"z": 2.0}
    for most in (M.MOST_NUMBERS, 0):
        monkeypatch.setattr(M, "MOST_NUMBERS", most)
        got = Counter((r.doc_id, r.text, r.source, r.name) for r in M.mix(df, epochs=2.0).collect())
        want = Counter()
        for r in rows:
            n = copies_by_hand(r[0], rate[r[2]]) if rate[r[2]] <= M.LARGEST else None
            if n is None:
                assert abs(got[r] - rate[r[2]]) < 6 * math.sqrt(rate[r[2]])
                n = got[r]
            want[r] += n
        assert got == +want


def test_a_rate_of_a_million(spark):
    df = spark.createDataFrame([(i, "x", "a") for i in range(3)], "doc_id long, text string, source string")
    out = M.mix(df, epochs=1e6).groupBy("doc_id").agg(M.F.count("*").alias("n"), M.F.max("copy").alias("last"), M.F.count_distinct("copy").alias("each")).collect()
    assert len(out) == 3 and all(r.n == r.last == r.each and abs(r.n - 1e6) < 6e3 for r in out)
    assert len({r.n for r in out}) == 3
