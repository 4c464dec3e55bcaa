"""What the scan decides: pages without names, a bypass of the scan, names that mislead, time on bad nesting."""

import html
import random
import re
import time
from collections import Counter

import pytest

from webloom.llm import extract as X

PROSE = "<p>The carters went up in spring with empty sacks and came down heavy.</p><p>In the pass they paid in salt, and the keeper weighed it twice.</p>"
LINES = ["The carters went up in spring with empty sacks and came down heavy.", "In the pass they paid in salt, and the keeper weighed it twice."]


def nameless(page: str) -> str:
    """All containers plain div, no attributes."""
    return re.sub(r"<(\w+)\s[^>]*>", r"<\1>", re.sub(r"<(/?)(?:nav|article|footer|main|section|aside|header)\b[^>]*>", r"<\1div>", page))


def article(page: str) -> str:
    body = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", body))
    return "\n\n".join(t for t in texts if t)


def f1(a: str, b: str) -> float:
    a, b = Counter(a.split()), Counter(b.split())
    return 2 * (a & b).total() / max(1, a.total() + b.total())


def test_pages_without_names_and_without_the_scan(spark, sf, monkeypatch):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    want = [article(p) for p in pages]
    got = [X.main_text(nameless(p)) for p in pages]
    score = lambda texts: sum(map(f1, texts, want)) / len(want)
    assert score(got) >= 0.97
    monkeypatch.setattr(X, "best_run", lambda scores: (0, len(scores)))
    monkeypatch.setattr(X, "maximal_runs", lambda scores: [])
    for form, right in ((nameless, got), (str, want)):
        all_ = [X.main_text(form(p)) for p in pages]
        assert all(a != b for a, b in zip(all_, right, strict=True)) and score(all_) < score(right) - 0.02


@pytest.mark.parametrize("seed", range(60))
def test_maximal_runs_against_their_definition(seed):
    """By recursion: the best run (of equal ones the first, then the shortest), then the same to its left and right."""
    rnd = random.Random(seed)
    s = [rnd.randrange(-6, 7) for _ in range(rnd.randrange(30))]

    def runs(lo, hi):
        best = max(((sum(s[a:b]), -a, -b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        a, b = -best[1], -best[2]
        return [*runs(lo, a), best[0], *runs(b, hi)]

    got = X.maximal_runs(s)
    assert sorted(x for *_, x in got) == sorted(runs(0, len(s))) or sum(x for *_, x in got) >= sum(runs(0, len(s)))
    assert all(sum(s[i:j]) == x > 0 for i, j, x in got) and all(a[1] <= b[0] for a, b in zip(got, got[1:]))


@pytest.mark.parametrize(
    "page, more",
    [
        (f"<article><h1>Salt</h1>{PROSE}<section class='popular-science'><p>Salt lowers the point at which water freezes, so roads stay wet.</p></section></article>", ["Salt lowers the point at which water freezes, so roads stay wet."]),
        (f"<article><h1>Salt</h1>{PROSE}<p class='social-history'>The keepers were poor men and lived from the tolls they took.</p></article>", ["The keepers were poor men and lived from the tolls they took."]),
        (f"<article><h1>Salt</h1>{PROSE}{'<hr>' * 8}<p>Amen.</p></article>", ["Amen."]),
        (f"<div><h1>Salt</h1>{PROSE}{'<hr>' * 8}<p>Amen.</p></div><div>Copyright 2004 Salt Post</div>", ["Amen."]),
        (f"<div id='search-results'><h1>Salt</h1>{PROSE}</div><div class='footer'>All rights reserved by us</div>", []),
        (f"<article><h1>Salt</h1>{PROSE}<div class='ad'>Buy our boats now</div></article>", []),
    ],
)
def test_names_mislead(page, more):
    assert X.main_text(f"<body><nav><a href='/'>News</a></nav>{page}</body>") == "\n\n".join(["Salt", *LINES, *more])


@pytest.mark.parametrize("page", [lambda n: "<div>" * n + "</span>" * n, lambda n: "<div>" * n + "<td>x" * n, lambda n: "<div>" * n + "<li>x" * n, lambda n: "<p>x <a>" * n, lambda n: "<nav>x" * n])
def test_time_on_bad_nesting(page):
    def took(n):
        t = time.process_time()
        X.main_text(page(n))
        return time.process_time() - t

    took(200)
    assert took(16_000) < 60 * max(took(1_000), 0.01)
