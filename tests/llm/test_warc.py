import io
import struct

import pytest
import zstandard

from webloom.llm import warc as W


def brute(rows):
    """(page_id, bytes, digest, type, refers_to) of each row by the contract."""
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, h in rows:
        p, f = (h or "").encode(), first.get(h or "")
        own = i is None or f is None or f == i
        out.append((i, len(p), W.payload_digest(p), "response" if own else "revisit", None if own else f))
    return sorted(out, key=repr)


def back(spark, tmp_path, df, **kw):
    folder = f"file://{tmp_path}/a"
    m = W.write_archives(df, folder, **kw)
    return W.read_archives(spark, folder, m), m


def test_round_trip_with_odd_rows(spark, tmp_path):
    rows = [(i, h) for i, h in enumerate(["<p>a</p>", "", None, "<p>a</p>", "é" * 70000, "\r\n\r\nWARC/1.1\r\n", "<p>a</p>", "x", ""])] + [(None, "x"), (3, "<p>a</p>"), (-5, "x")]
    df = spark.createDataFrame([(i, "http://e/ö x\r\ny" if i else None, h, "clash") for i, h in rows], "page_id long, url string, html string, first string")
    got, m = back(spark, tmp_path, df)
    rs = got.collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rs), key=repr) == brute(rows)
    assert sorted(r.payload.decode() for r in rs if r.record_type == "response") == sorted((h or "") for (i, h) in rows if (i, len((h or "").encode()), "response") in {(r.page_id, r.payload_bytes, r.record_type) for r in rs})
    assert sum(r.records for r in m.collect()) == len(rows)


def test_min_bytes_and_rolling_archives(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "ab" if i % 2 else f"long payload {i % 4} " * 50) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    got, m = back(spark, tmp_path, df, min_bytes=3, most=2000)
    assert m.count() > 1
    assert {(r.record_type, r.payload_bytes) for r in got.collect() if r.page_id % 2} == {("response", 2)}
    assert sum(r.record_type == "revisit" for r in got.collect()) == 28


def test_empty_table(spark, tmp_path):
    got, m = back(spark, tmp_path, spark.createDataFrame([], "page_id long, url string, html string"))
    assert got.count() == 0


def test_all_pages(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got, _ = back(spark, tmp_path, pages)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=repr) == brute([(r.page_id, r.html) for r in pages.collect()])


def archive(dictionary, *data):
    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return (W.dictionary_frame(dictionary) if dictionary else b"") + b"".join(map(z.compress, data))


def test_reader_takes_plain_and_packed_dictionaries_and_none():
    d = W.train_dictionary([b"<html><body>%d words here</body></html>" % (i * i) * 20 for i in range(200)])
    assert d
    r = W.record("response", 1, "http://a", b"<html><body>x")
    raw = struct.pack("<II", W.DICT_MAGIC, len(d)) + d + archive(d, r)[len(W.dictionary_frame(d)) :]
    for a in (archive(d, r), raw, archive(b"", r), archive(b"", r, r)):
        assert {x["payload"] for _, x in W.records(io.BytesIO(a))} == {b"<html><body>x"}
    assert list(W.records(io.BytesIO(b""))) == []


@pytest.mark.parametrize(
    "bad",
    [
        lambda r: r.replace(b"WARC/1.1", b"XARC/1.1"),
        lambda r: r.replace(b"WARC-Date", b"WARC-Bate"),
        lambda r: r.replace(b"payload!", b"payload?!"),
        lambda r: r.replace(b"payload!", b"payload?"),
        lambda r: r[:-1],
        lambda r: r.replace(b"Content-Length: 8", b"Content-Length: 9"),
        lambda r: r.replace(b"HTTP/1.1 200", b"GTTP/1.1 200"),
    ],
)
def test_bad_records_are_told(bad):
    r = W.record("response", 1, "http://a", b"payload!")
    with pytest.raises(W.BadArchive):
        list(W.records(io.BytesIO(archive(b"", r, bad(r)))))


def test_cut_archives_are_told():
    a = archive(b"", W.record("response", 1, "http://a", bytes(range(256)) * 20))
    with pytest.raises(W.BadArchive):
        list(W.records(io.BytesIO(a[:-9])))


def test_a_second_attempt(spark, tmp_path):
    """A task that is run again (or twice at once) leaves the first one's files alone; the manifest of the attempt that counts is whole."""
    df = spark.createDataFrame([(i, f"http://e/{i}", "<p>text</p>" * i) for i in range(40)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/a"
    first, again = W.write_archives(df, folder), W.write_archives(df, folder)
    assert not {r.name for r in first.collect()} & {r.name for r in again.collect()}
    for m in (first, again):
        assert sorted(r.page_id for r in W.read_archives(spark, folder, m).collect()) == list(range(40))
