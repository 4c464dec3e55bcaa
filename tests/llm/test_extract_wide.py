"""Forms and unclosed elements around a page's content."""

import time

import pytest

from webloom.llm import extract as X

MENU = '<ul><li><a href="/a">News</a></li><li><a href="/b">Sport today</a></li></ul>'
TEXT = "<h1>Salt roads</h1><p>The carters went up in spring with empty sacks and came down heavy.</p><p>In the pass they paid in salt, and the keeper weighed it twice.</p>"
WANT = "Salt roads\n\nThe carters went up in spring with empty sacks and came down heavy.\n\nIn the pass they paid in salt, and the keeper weighed it twice."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><form id='aspnetForm'><nav>{MENU}</nav><article>{TEXT}</article><select><option>One of many</select><button>Send it now</button><textarea>Your words</textarea></form></body>",
        f"<body><form id='aspnetForm' class='search'><nav>{MENU}</nav><main>{TEXT}</main></form><footer>All rights reserved by us</footer></body>",
        f"<body><form method=post><nav>{MENU}</nav><div>{TEXT}</div><button>Send it now</button><footer>All rights reserved</footer></form></body>",
        f"<body><nav>{MENU}<article>{TEXT}</article></body>",
        f"<body><aside>{MENU}<div><article>{TEXT}</article></div></body>",
        f"<body><form><input name=q><article>{TEXT}</article></body>",
        f"<body><form><nav>{MENU}<article>{TEXT}</article></form></body>",
    ],
)
def test_content_in_a_container(page):
    assert X.main_text(page) == WANT


@pytest.mark.parametrize(
    "page",
    [
        f"<body><article>{TEXT}<form><p>{'Write a kind comment here please. ' * 20}</p></form></article></body>",
        f"<body><div>{TEXT}</div><form><p>Your name and your mail</p></form></body>",
        f"<body><article>{TEXT}</article><form hidden><article>Not to be seen by anybody at all here</article></form></body>",
        f"<body><article>{TEXT}</article><aside><p>Most read of all</p></body>",
        f"<body><nav>{'<p>A closed menu of many words stays out</p>' * 20}</nav><div>{TEXT}</div></body>",
    ],
)
def test_what_stays_out(page):
    assert X.main_text(page) == WANT


def test_time_with_unclosed_elements():
    def took(n):
        t = time.process_time()
        X.main_text("<nav><form><p>some words" * n)
        return time.process_time() - t

    took(100)
    assert took(8000) < 40 * max(took(500), 0.005)
