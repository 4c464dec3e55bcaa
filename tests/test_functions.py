"""Column functions on hand-made rows."""

import struct

import pytest
from pyspark.sql import functions as F

from webloom.functions import bf16, html, tokens, urls


def one(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").select("i", f(F.col("v")).alias("out")).collect()
    return [r.out for r in sorted(rows)]


URLS = {
    "httpbin.org": None,
    "http://a.com//": "a.com",
    "https://a.com/": "https://a.com",
    "https://a.com/b/?q#t": "https://a.com/b/?q#t",
    "//x.org/y/": "x.org/y",
    "ab": None,
    "http:///": None,
    "httpsx://q": None,
    "https": "https",
    "": None,
    None: None,
    "///": None,
    "é/": "é" if len("é".encode()) >= 3 else None,
}


def test_canonical_url(spark):
    assert one(spark, list(URLS), urls.canonical_url) == list(URLS.values())


def test_url_key(spark):
    a, b, c, d, e = one(spark, ["www.a.com", "a.com", "https://www.a.com", "////", "www."], urls.url_key)
    assert a == b != c and d == "0" * 32 and e not in (a, d)


def test_hosts(spark):
    hosts = {"a.b.com": "b.com", "www.foo.com.hk": "foo.com.hk", "bbc.co.uk": "co.uk", "x.company.de": "x.company.de", "localhost": "localhost", "a.b.ORG.uk": "b.ORG.uk", "com.com.hk": "com.com.hk", "": ""}
    assert one(spark, list(hosts), urls.host_suffix) == list(hosts.values())
    assert one(spark, ["http://h:80/x", "https://h?q", "h/p", None], urls.url_host) == ["h:80", "h?q", "h", None]
    assert one(spark, ["http://h/x/y?z", "h"], urls.url_path) == ["/x/y?z", ""]
    parts = one(spark, ["a.b.com", "c.b.com", "other.net"], lambda c: urls.host_partition(c, 2000))
    assert parts[0] == parts[1] and all(0 <= p < 2000 for p in parts)


def test_is_crawlable(spark):
    bad = ["ab.js", "abc", "x.com/y.css", "x.com/y.exe", "foo.jp/a", "a/bcd", "x" * 2049]
    good = ["a.js", "a.com", "x.com/y.JS", "foo.jp.com/a", "x.com/a.jpg?b", "x" * 2048]
    assert one(spark, bad, urls.is_crawlable) == [False] * len(bad) and one(spark, good, urls.is_crawlable) == [True] * len(good)


def test_ascii_lower(spark):
    assert one(spark, ["AbÉ", None], urls.ascii_lower) == ["abÉ", None]


def test_html(spark):
    page = '<!DOCTYPE x><h1 class="x">T</h1><a class=q href="/y z" id=r>l</a><meta name=a><img src="i" alt=b><!-- c --><script>z</script><style>p</style><br/>é'
    assert one(spark, [page, "", None], html.shorten) == ['<h1 >T</h1><a  href="/y z" >l</a><meta name=a><img src="i" alt=b><br/>é', "", None]
    assert one(spark, ["a<!-- x -->b<!-- never closed", "<!---->"], html.strip_comments) == ["ab", ""]
    titles = ["<title>  A\n b </title>", "<title x=1>" + "é" * 200 + "</title>", "none", "<title>open", None]
    assert one(spark, titles, html.page_title) == ["A b", "é" * 127, "", "open", None]


def test_page_links(spark):
    page = """<a href="/p/"><a href="//o.com/q"><a href="http://own.org/z"><a href="https://o.com/s/"><a href='/no'><a HREF="/no"><a href="rel"><a href="https://own.org?x">"""
    f = lambda u: lambda c: html.canonical_links(c, F.lit(u))
    assert one(spark, [page], f("https://own.org/a"))[0] == ["https://own.org/p", "o.com/q", "https://own.org/z", "https://o.com/s", "https://own.org?x"]
    assert one(spark, [page], f("own.org/a"))[0] == ["own.org/p", "o.com/q", "own.org/z", "https://o.com/s", "own.org?x"]


@pytest.mark.parametrize("x", [1.0, 100.0, 0.999, 1 / 3, 2**-20 * 1.99999, 65535.0, 1e-30, 255.99, 256.0, 127.5])
def test_bf16_is_the_upper_half_of_a_single(spark, x):
    (got,) = one(spark, [x], bf16.truncate, "double")
    single = struct.unpack("<I", struct.pack("<f", x))[0]
    rounded_up = struct.unpack("<f", struct.pack("<f", x))[0] > x
    want = struct.unpack("<f", struct.pack("<I", single & 0xFFFF0000))[0]
    assert got == want or (rounded_up and got < want)
    assert one(spark, [0.0, None, -1.5], bf16.truncate, "double") == [0.0, None, -1.5]


def phrases(spark, text):
    return one(spark, [text], lambda c: F.transform(tokens.phrases(c), urls.ascii_lower))[0]


def test_phrases(spark):
    assert phrases(spark, "Hong Kong. Weather") == ["hong kong weather", "kong weather", "weather"]
    assert phrases(spark, "für") == ["f", "ür", "r"]
    assert phrases(spark, "香港A b") == ["香港a", "港a", "a b", "b"]
    assert phrases(spark, "x" * 50) == ["x" * 24, "x" * 24, "xx"]
    assert phrases(spark, "a  ..b, c") == ["a.b", "b", "c"]
    assert phrases(spark, "one two three four five six") == ["one two three four five", "two three four five six", "three four five six", "four five six", "five six", "six"]
    assert phrases(spark, "字" * 9) == ["字" * 7] * 3 + ["字" * n for n in range(6, 0, -1)]
    assert phrases(spark, " .,!") == [] and phrases(spark, "") == []


def test_tokens(spark):
    page = '"http header" <title>Top</title><p>skip<body>a <b>Bold<h2>Head</h2> of the <!-- x -->end <script>no</script>tail</body>late'
    df = spark.createDataFrame([(1, "u.com/p", page), (2, None, None)], "page_index long, url string, html string")
    got = {r.term: (r.position, round(r.weight / 0.999**n, 6)) for n, r in enumerate(sorted(tokens.page_tokens(df).collect(), key=lambda r: r.position))}
    assert got["u.com"] == (1, 40.0) and got["top"] == (4, 400.0) and got["bold"] == (6, 8.0) and got["head"] == (7, 12.0)
    assert got["of the end"] == (8, 2.0) and got["the end"] == (9, 2.0) and got["tail"] == (11, 2.0) and "late" not in got and "skip" not in got and "a" not in got


def test_max_words(spark):
    df = spark.createDataFrame([(1, "", "<body>" + ", ".join(["x", "y", "x", "z", "y", "w"]) + "</body>")], "page_index long, url string, html string")
    assert [r.term for r in tokens.page_tokens(df, 3).orderBy("position").collect()] == ["x", "y", "x", "z"]


def test_small_word(spark):
    w = {"vox.com": "vox.com", "www.facebook.com": "www", "technology": "", "hong kong": "hong", "香港天气": "香港", "üabcéfghij": "üabcé", "exactly8": "exactly8", "a.b.c.d.e.f": "a.b.c.d"}
    assert one(spark, list(w), tokens.small_word) == list(w.values())
