"""run() against plain Python, stage by stage, and the stages on odd and empty tables."""

from collections import Counter, defaultdict

import corpus_pipeline as P
from pyspark.sql import functions as F

from tests.llm import test_lines, test_mix, test_pack, test_simhash
from webloom.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 150")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return docs


def test_run_against_plain_python(spark, sf, tmp_path):
    docs = tables(spark, tmp_path, sf)
    rows = {r.doc_id: r for r in docs.collect()}
    bad = {r.doc_id for r in Q.scores(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect() if r.score < 0.3}
    assert bad
    left = test_lines.by_hand(sorted((i, r.text) for i, r in rows.items() if i not in bad))
    near = test_simhash.by_hand(list(left.items()))
    left = {i: left[i] for i, _, c in near if i == c}
    size = Counter()
    for i, t in left.items():
        size[rows[i].source] += len(t)
    w = {s: n**0.7 for s, n in size.items()}
    rate = {s: w[s] / sum(w.values()) * sum(size.values()) / size[s] for s in size}
    want = Counter()
    for i, t in left.items():
        n = test_mix.copies_by_hand(i, rate[rows[i].source])
        if n:
            want[i, len(test_pack.ids_of(t))] = n
    got = P.run(spark, str(tmp_path)).collect()
    firsts = Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    assert firsts == want
    tokens, seqs = defaultdict(int), defaultdict(list)
    for r in got:
        tokens[r.doc_id, r.doc_tokens] += r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    assert tokens == {k: k[1] * n for k, n in want.items()}
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048


def test_stages_on_odd_and_empty_tables(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (3, "x " * 40_000, "en", "s", 1), (3, "x " * 40_000, "en", "s", 1), (4, "plain text of a page.\nplain text of a page.", "en", None, 3)]
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (spark.createDataFrame(rows, SCHEMA).withColumn("gone", F.lit(1)), spark.createDataFrame([], SCHEMA)):
        n = docs.count()
        for name, stage in P.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "pack":
                assert tuple(out.columns) == P.COLUMNS
            assert n or out.count() == 0
            if name in ("quality", "lines", "near"):
                assert out.count() <= n


def test_stages():
    assert [k for k, _ in P.STAGES] == ["quality", "lines", "near", "mix", "pack"]
