import html
import random
import re
import time

import pytest

from webloom.llm import extract as X
from webloom.llm.html_labels import PAGES


@pytest.mark.parametrize("page", PAGES)
def test_labelled_pages(page):
    marked = re.findall(r"<(\w+) data-main>(.*?)</\1>", page, re.S)
    assert X.main_text(page) == "\n\n".join(" ".join(re.sub("<[^>]*>", "", t).split()) for _, t in marked)


def test_a_page_of_another_kind():
    page = """<!doctype html><body><div id="page"><div class="topbar">Log in or sign up to read more of our stories</div>
    <div class=hero><H1>Old &amp; new roads</H1></div><!-- <p>not this</p> --><p>First&nbsp;words   of
    the <a href="/x">long road</a> north<br>go on.</p><script>var a = "<p>nor this</p>";</script><div class="advert"><p>Buy ten get one, today only, in all our shops</p></div>
    <p>Second words of the road, and one more sentence.<p>Third, unclosed.</p><section id="comment-list" class="comments"><p>Joe: I walked it in one day, it was a very good day to be out</p></section>
    <form><p>Your comment here, please be kind to all</p></form></div><footer>All rights reserved by us</footer>"""
    assert X.main_text(page) == "Old & new roads\n\nFirst words of the long road north go on.\n\nSecond words of the road, and one more sentence.\n\nThird, unclosed."


def test_all_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", body))
        want[r.page_id] = "\n\n".join(t for t in texts if t)
    got = X.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_odd_rows(spark):
    odd = [None, "", "   ", "<", "<<<>>>", "</p></p>", "just words here", "<p>a", "<div " * 2000, "<p>" + "word " * 200_000, "<a href='x>y" * 500, '<p title="' * 3000, "<script>never closed <p>x</p>", "<!-- open <p>x</p>", "&#0;&#x110000;&bogus;&amp"]
    df = spark.createDataFrame([(i, "u", h, "n") for i, h in enumerate(odd)], "page_id long, url string, html string, n_chars string")
    got = {r.page_id: r.text for r in X.extract(df.union(df)).collect()}
    assert got[0] == got[1] == got[2] == got[5] == "" and got[6] == "just words here" and got[7] == "a" and len(got[9]) == 999_999 and got[12] == got[13] == ""
    assert X.extract(df.limit(0)).count() == 0 and X.extract(df.union(df)).count() == 2 * len(odd)
    assert X.extract(spark.createDataFrame([(None, None, None)], "page_id long, url string, html string")).first().text == ""


@pytest.mark.parametrize("seed", range(40))
def test_best_run_against_all_runs(seed):
    rnd = random.Random(seed)
    s = [rnd.randrange(-6, 7) for _ in range(rnd.randrange(40))]
    i, j = X.best_run(s)
    assert sum(s[i:j]) == max([0, *(sum(s[a:b]) for a in range(len(s)) for b in range(a, len(s) + 1))])


def test_time_is_in_proportion():
    def took(n):
        page = ("<div class=x><p>some words <b>here</b><li><td>" * n) + '<p a="' * n
        t = time.process_time()
        X.main_text(page)
        return time.process_time() - t

    took(100)
    assert took(8000) < 40 * max(took(500), 0.005)
