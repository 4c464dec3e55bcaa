import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from webloom.llm import exact as E


def by_hand(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    out = []
    for d, t in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((d, keep, len(g), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def check(spark, tmp_path, rows, digest=E.sha256, files=3):
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, digest string")
    df.repartition(files).write.parquet(f"{tmp_path}/t.parquet")
    got = E.deduplicate(spark, f"{tmp_path}/t.parquet", digest=digest).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == by_hand(rows)
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert sorted(r.text_sha256 for r in kept) == sorted({x[3] for x in by_hand(rows)})


ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b"), (5, "b"), (None, "a"), (None, "c"), (None, "c"), (6, "x" * 300_000), (7, "x" * 300_000), (8, "A"), (9, "é"), (10, "é")]


def test_odd_rows(spark, tmp_path):
    check(spark, tmp_path, ROWS)


@pytest.mark.parametrize("digest", [lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2)), lambda t: F.lit(b"\0")])
def test_digests_that_collide(spark, tmp_path, digest):
    check(spark, tmp_path, ROWS + [(100 + i, f"t{i % 40}") for i in range(80)], digest)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/t.parquet")
    assert E.deduplicate(spark, f"{tmp_path}/t.parquet").count() == 0


def test_state_goes_on_over_several_batches(spark, tmp_path):
    """What came in an earlier run of the stream is still known in a later one."""
    src, out, state = (f"{tmp_path}/{x}" for x in ("src", "out", "state"))
    for rows in ([(1, "a"), (2, "b")], [(3, "a")], [(0, "a"), (9, "c")]):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("doc_id long, text string").parquet(src)
        s = E.digest_state(stream, "doc_id", "text", lambda t: t.cast("binary"), out, state)
    assert {(bytes(r.digest), r.n, r["at"].id) for r in s.collect()} == {(b"a", 3, 3), (b"b", 1, 2), (b"c", 1, 9)}


def rows_of(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_three_arrivals_with_one_state(spark, tmp_path, monkeypatch, most):
    """Rows arrive three times, in several files; each call takes in the new ones only, and the result is that of all rows so far."""
    monkeypatch.setattr(E, "MOST_HITS", most)
    src, home, all_ = f"{tmp_path}/t.parquet", f"file://{tmp_path}/home", []
    for k in range(3):
        rows = [(100 * k + i, f"text {(i * (k + 1)) % 37}") for i in range(60)] + [(1000 - k, "once more"), (2000 + k, None)]
        all_ += rows
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.mode("append").parquet(src)
        assert rows_of(E.deduplicate(spark, src, home=home, batch_bytes=1)) == by_hand(all_)
    batches = spark.read.parquet(f"{home}/hits").select("batch").distinct().count()
    assert batches > 3  # several micro-batches an arrival
    kept = spark.read.format("statestore").load(f"{home}/state")
    assert kept.count() == len({t or "" for _, t in all_}) and kept.agg(F.sum("value.count")).first()[0] == len(all_)


def test_results_are_those_of_the_state(spark, tmp_path):
    """A home that knows a row which is not in the table any more says so: its count and identifier come back."""
    src, home = f"{tmp_path}/t.parquet", f"file://{tmp_path}/home"
    spark.createDataFrame([(1, "a"), (9, "a"), (2, "b")], "doc_id long, text string").coalesce(1).write.parquet(src)
    E.deduplicate(spark, src, home=home).collect()
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
    assert {(r.doc_id, r.keep_id, r.group_size) for r in E.deduplicate(spark, src, home=home).collect()} == {(1, 9, 3), (9, 9, 3), (2, 2, 2)}


@pytest.mark.parametrize("name", ["t.parquet", "odd [1]{a}*.parquet"])
@pytest.mark.parametrize("single", [True, False])
def test_what_lies_beside_the_table(spark, tmp_path, single, name):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string").coalesce(1)
    df.write.parquet(f"{tmp_path}/whole")
    part = next((tmp_path / "whole").glob("part-*"))
    if single:
        part.rename(tmp_path / name)
    else:
        (tmp_path / "whole").rename(tmp_path / name)
    (tmp_path / f"{name}.md5").write_text("not a table")
    spark.createDataFrame([(7, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/{name}.bak")
    if name == "t.parquet":
        got = E.deduplicate(spark, f"{tmp_path}/{name}")
        assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()} == {(1, 2, 2, False), (2, 2, 2, True)}
    else:  # Spark's own reader takes such a name for a pattern, so only the stream is tried
        assert E.arriving(spark, f"{tmp_path}/{name}", df.schema).isStreaming


def test_large_side_is_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(E, "MOST_HITS", 0)
    check(spark, tmp_path, ROWS + [(100 + i, f"t{i % 7}") for i in range(80)], lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 2)))
