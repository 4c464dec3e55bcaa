import os

import numpy as np

from webloom.llm import quality as Q


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.op4_quality(spark, sf).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert set(got) == set(docs)
    assert all(r.held_out == (Q.crc_fold(i) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    test = [i for i in labels if got[i].held_out]
    assert np.mean([got[i].predicted == labels[i] for i in test]) > 0.95
    # against the same model fitted by numpy
    train = [i for i in labels if not got[i].held_out]
    x, y = np.array([Q.features(docs[i]) for i in train]), np.array([labels[i] for i in train])
    mu, sd = x.mean(0), np.maximum(x.std(0), 1e-9**0.5)
    z = (x - mu) / sd
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * covs[k] for k in (0, 1))
    s = np.array([Q.features(docs[i]) for i in got])
    logs = []
    for k in (0, 1):
        c = 0.7 * covs[k] + 0.3 * pooled
        c = 0.95 * c + 0.05 * np.trace(c) / len(c) * np.eye(len(c))
        d = (s - mu) / sd - z[y == k].mean(0)
        logs.append(np.log((y == k).mean()) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    assert np.allclose([r.score for r in got.values()], want, atol=1e-6)


def test_inputs_of_a_score_are_the_text_alone(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a = {r.doc_id: r.score for r in Q.scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in Q.scores(docs.selectExpr("doc_id", "text", "'x' as lang", "'y' as source", "0L as quality", "1 as x"), labels).collect()}
    assert a.keys() == b.keys() and np.allclose([a[i] for i in a], [b[i] for i in a])


def test_odd_rows_and_labels(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a" * 500_000), (5, "plain words here. " * 50), (5, "!!! ### " * 90), (None, "x"), (8, "字 é ٣")]
    df = spark.createDataFrame([(d, t, 7.0) for d, t in rows], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in Q.scores(df, none).collect()} == {0.5}
    one = spark.createDataFrame([(5, 1), (2, None), (4, 9), (None, 0)], "doc_id long, quality int")
    assert {r.score for r in Q.scores(df, one).collect()} == {1.0}
    both = spark.createDataFrame([(1, 0), (5, 1), (5, 0), (3, 1), (4, 1), (8, 0)], "doc_id long, quality int")
    out = Q.scores(df, both).collect()
    assert len(out) == len(rows) and all(np.isfinite(r.score) and 0 <= r.score <= 1 for r in out)
    assert Q.scores(df.limit(0), both).count() == 0 and Q.accepted(df.limit(0), both).count() == 0
    kept = Q.accepted(df, both)
    assert kept.columns == df.columns and kept.count() == sum(r.predicted for r in out)


def test_features_are_finite_for_any_text():
    for t in (None, "", " ", "\n", "a", "\x00" * 10, os.urandom(64).decode("latin-1")):
        f = Q.features(t)
        assert len(f) == len(Q.FEATURES) and np.isfinite(f).all()
