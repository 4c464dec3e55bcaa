"""Main text of web pages by the maximum-scoring subsequence.

A page becomes a sequence of words and tags. A word scores the log odds that it is content where these are above zero; a block that
is rather not content costs its log odds once, like a tag; and a tag costs what it tells against content. The weights, of tags, class
words, roles and the look of a block, are learned by logistic regressions on labelled pages, as is the sum from which a hole counts. One linear scan finds the maximal scoring runs (Ruzzo and Tompa, 1999); the best
one is the content region. The same scan of the region's negated scores finds the holes in it (adverts, lists of links).
"""

from __future__ import annotations

import html as entities
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import sliced, table
from webloom.llm.html_labels import PAGES, generated

# Names of HTML elements, by what they do here.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noframes", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Never content: menus, controls, what isn't text (and forms, but for those around the content).
NEVER = {"head", "nav", "menu", "dialog", "button", "select", "datalist", "svg", "math", "canvas", "object", "audio", "video", "map", "applet"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
}
#: Elements that group blocks.
CONTAINERS = {"article", "body", "center", "div", "footer", "form", "header", "main", "section", "td", "aside", "blockquote", "figure", "fieldset"}
#: Opening one of these ends an open one of its kind unless one of the second ones was opened since.
ENDS = {"li": ("li", ("ul", "ol", "dir")), "td": ("td", ("table", "tr")), "th": ("th", ("table", "tr")), "tr": ("tr", ("table",)), "a": ("a", ("td", "table")), "dd": ("dd", ("dl",)), "dt": ("dt", ("dl",)), "option": ("option", ("select",))}
#: What a block of few words says before readers' comments.
TALK = re.compile(r"\b(comments?|kommentare?|commentaires?|comentarios?|responses|replies|discussion|leave a (?:reply|comment))\b", re.I)

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
BINS = (0, 1, 2, 3, 5, 10, 20, 40, 80)


@cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I)


def _attributes(attrs: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}


def _hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I))


class Element:
    """An open or closed element: what it is called by, what is above it, and how many words and heads came before its start and its end."""

    __slots__ = ("name", "up", "tells", "never", "core", "words", "heads", "all_words", "all_heads", "mask", "marked", "credit", "closed", "may", "within_article", "out")

    def __init__(self, name, up, tells, never, words, heads, marked, may=False):
        self.name, self.up, self.tells, self.never, self.words, self.heads, self.marked, self.may = name, up, tells, never, words, heads, marked, may
        self.all_words = self.all_heads = self.credit = 0.0
        self.core, self.mask, self.closed, self.out = None, 0, False, False
        self.within_article = name in ("article", "main") or (up is not None and up.within_article)


class Page:
    """A page in order: events (kind, block, text or tag name, element), kind "word", "blank", "open" or "close"; elements; the block numbers' words."""

    def __init__(self, page: str):
        plain = self._read(page, frozenset())
        if plain:
            self._read(page, plain)
        half = self.elements[0].all_words / 2
        for e in self.elements[1:]:  # in order: what is above comes first
            e.never = e.never or e.up.never or (e.name == "form" and not _wide(e, half))
        self.events = [ev for ev in self.events if not ev[3].never]
        self._weigh()

    def _read(self, page: str, plain: frozenset[int]) -> frozenset[int]:
        """Fills in events and elements; returns where menus begin that aren't closed and hold an article, a main, a first heading or most words: they are plain containers, in a second reading."""
        root = Element("", None, (), False, 0, 0, False)
        self.events, self.elements = [], [root]
        stack, open_at, wide = [root], {}, []  # open_at: for each name the places in the stack
        at, block, n, words, heads = 0, 0, len(page), 0, 0

        def pop(to: int, closed: bool) -> None:
            while len(stack) > to:
                e = stack.pop()
                open_at[e.name].pop()
                e.all_words, e.all_heads, e.closed = words - e.words, heads - e.heads, closed and len(stack) == to
                if e.may and not e.closed:
                    wide.append((starts[id(e)], e))

        def last(name: str) -> int:
            places = open_at.get(name)
            return places[-1] if places else -1

        starts: dict[int, int] = {}
        put = self.events.append
        while at < n:
            m = TAG.search(page, at)
            end = m.start() if m else n
            if end > at:
                text, e = page[at:end], stack[-1]
                words += len(text.split())
                if not e.never:
                    put(("blank" if text.isspace() else "word", block, text, e))
            if not m:
                break
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing, attrs = m[1] or m[4], m[3] or m[6] or ""
            if name in BLOCKS:
                block += 1
            if closing:
                inner = stack[-1]
                if (i := last(name)) > 0:
                    inner = stack[i]
                    pop(i, True)
                if not inner.never and name not in RAW:
                    put(("close", block, name, inner))
                continue
            if name in RAW:
                e = _end_of(name).search(page, at)
                at = e.end() if e else n
                continue
            if name == "body":
                pop(1, False)
            if name in BLOCKS and (i := last("p")) > max(last("td"), last("th"), last("table"), last("button")):
                pop(i, False)
            if name in ENDS:
                own, until = ENDS[name]
                if (i := last(own)) > max(map(last, until)):
                    pop(i, False)
            up = stack[-1]
            heads += name in ("article", "main", "h1")
            found = _attributes(attrs) if attrs and not attrs.isspace() else {}
            if name == "br" and not up.never:
                put(("blank", block, " ", up))
            if name in VOID or attrs.endswith("/"):
                before = next((ev for ev in reversed(self.events[-2:]) if ev[0] != "blank"), None)
                if not up.never and not (before and before[:1] + before[2:] == ("open", name, up)):  # a row of them is one
                    put(("open", block, name, up))
                continue
            if not found and name not in BLOCKS and name not in NEVER and name != "a":  # an inline element that tells nothing
                if not up.never:
                    put(("open", block, name, up))
                continue
            hidden = bool(found) and _hidden(found)
            never = hidden or (name in NEVER and m.start() not in plain)
            tells = () if name in ("html", "body") else (*{w.lower() for w in PART.findall(f"{found.get('class', '')} {found.get('id', '')}")}, *(f"role {r}" for r in found.get("role", "").lower().split()))
            e = Element(name, up, tells, up.never or never, words, heads - (name in ("article", "main", "h1")), up.marked or "data-main" in found, name in NEVER and not hidden and not up.never and never)
            starts[id(e)] = m.start()
            self.elements.append(e)
            if not e.never:
                put(("open", block, name, e))
            open_at.setdefault(name, []).append(len(stack))
            stack.append(e)
        pop(1, False)
        root.all_words, root.all_heads = words, heads
        return frozenset(where for where, e in wide if e.all_heads or 2 * e.all_words > words)

    def _weigh(self) -> None:
        """Counts the words of blocks, and finds the core: the container with the most words of prose in it and, at half, in those right under it."""
        self.words, self.linked, self.tail, self.first, self.text = {}, {}, {}, {}, {}
        for kind, block, text, e in self.events:
            if kind != "word":
                continue
            ws = text.split()
            self.words[block] = self.words.get(block, 0) + len(ws)
            self.first.setdefault(block, e)
            self.tail[block] = ws[-1]
            if self.words[block] <= 60:
                self.text.setdefault(block, []).extend(ws)
            if _in_link(e):
                self.linked[block] = self.linked.get(block, 0) + len(ws)
        for e in self.elements[1:]:
            outside = e.name in ("aside", "footer", "nav", "header") and not e.all_heads
            e.out = e.up.out or outside
        for block, n in self.words.items():
            e = self.first[block]
            while e.name not in CONTAINERS and e.up is not None and e.name != "":
                e = e.up
            if 2 * self.linked.get(block, 0) < n and not e.out:
                n = n if n >= 5 else n / 5
                e.credit += n
                if e.up is not None:
                    up = e.up
                    while up.name not in CONTAINERS and up.up is not None:
                        up = up.up
                    up.credit += n / 2
        best = max(self.elements, key=lambda e: e.credit)
        above = best.up
        while above is not None and above.name not in CONTAINERS and above.up is not None:
            above = above.up
        for e in self.elements:
            up = e.up
            e.core = "far" if e.out else "core" if e is best or (up is not None and up.core == "core") else "beside" if (e is above and e.up is not None) or (up is not None and up.core == "beside") else "far"

    def blocks(self):
        """(block, names of its own features), in order."""
        after_h1, talk = any(e.name == "h1" and not e.never for e in self.elements), False
        told = any(e.name in ("article", "main") and not e.never and e.all_words for e in self.elements)
        state = "before h1" if after_h1 else "no h1"
        total = sum(self.words.values())
        for block, n in self.words.items():
            e = self.first[block]
            if state == "before h1" and _within(e, "h1"):
                state = "after h1"
            linked = self.linked.get(block, 0) / n
            text = self.text.get(block, ()) if n <= 25 else ()
            end = self.tail[block][-1:]
            yield block, (
                f"words {sum(n > b for b in BINS)}", f"share {4 * n // total}", f"linked {(linked > 0) + (linked > 0.3) + (linked > 0.7)}", f"end {end if end in '.!?:' else ''}", state, f"{'in' if e.within_article else 'beside' if told else 'no'} article", "talk" if talk else "no talk",
                *(f"first {entities.unescape(w).lower().strip('.,:;!?')}" for w in self.text.get(block, ())[:2]), "many capitals" if n <= 12 and 2 * sum(w[:1].isupper() for w in text) > len(text) > 2 else "", *({f"= {w.lower().strip('.,:;!?')}" for w in text} if n <= 12 or linked else ()),
            )
            talk = talk or (n <= 6 and linked < 1 and bool(TALK.search(" ".join(text))))


def _in_link(e: Element) -> bool:
    return e.name == "a" or (e.up is not None and e.name not in BLOCKS and _in_link(e.up)) if e is not None else False


def _within(e: Element, name: str) -> bool:
    while e is not None and e.name != name and e.name not in CONTAINERS:
        e = e.up
    return e is not None and e.name == name


def _wide(e: Element, half: float) -> bool:
    """Whether a form is around the page's content, and so a plain container: it holds a head, or most words and isn't in an article."""
    return bool(e.all_heads) or (e.all_words > half and not e.up.within_article)


def _own(e: Element) -> tuple[str, ...]:
    """Names of the features that an element adds to what it holds."""
    name = f"{e.name}, wide" if e.name in ("form", "aside", "footer", "header") and e.all_heads else f"{e.name} in article" if e.up.within_article and e.name in CONTAINERS else e.name
    return (f"< {name}", *(f". {w}" for w in e.tells), *(f". {w} in core" for w in e.tells if e.core == "core"))


class Weights:
    """Log odds of words and tags from the bits of their features."""

    def __init__(self, bits: dict[str, int], of_words: np.ndarray, of_tags: np.ndarray, hole: float):
        self.bits, self.of_words, self.of_tags, self.hole = bits, of_words.tolist(), of_tags.tolist(), hole
        self._word, self._tag = {}, {}

    def _sum(self, mask: int, w: list[float]) -> float:
        total, m = w[-1], mask
        while m:
            low = m & -m
            total += w[low.bit_length() - 1]
            m ^= low
        return total

    def word(self, mask: int) -> float:
        if mask not in self._word:
            if len(self._word) > 100_000:
                self._word.clear()
            self._word[mask] = self._sum(mask, self.of_words)
        return self._word[mask]

    def tag(self, mask: int) -> float:
        """What a tag costs: the log of how likely it is inside of content, so never above zero."""
        if mask not in self._tag:
            if len(self._tag) > 100_000:
                self._tag.clear()
            self._tag[mask] = -float(np.logaddexp(0.0, -self._sum(mask, self.of_tags)))
        return self._tag[mask]


def _masked(page: Page, bit) -> list[tuple]:
    """The events as (mask, words or 0 for a tag, event). bit: the bit of a feature's name, 0 if unknown."""
    core = {c: bit(f"in {c}") for c in ("core", "beside", "far")}
    for e in page.elements[1:]:
        own = core[e.core]
        for f in _own(e):
            own |= bit(f)
        inside = e.up.mask & ~(core["core"] | core["beside"] | core["far"])
        e.mask = inside | own
    page.elements[0].mask = core[page.elements[0].core]
    of_block = {}
    for block, names in page.blocks():
        m = 0
        for f in names:
            m |= bit(f) if f else 0
        of_block[block] = m
    out = []
    for ev in page.events:
        kind, block, value, e = ev
        if kind == "word":
            out.append((e.mask | of_block[block], len(value.split()), ev))
        elif kind != "blank":
            out.append((e.mask | bit(f"{kind} {value}"), 0, ev))
        else:
            out.append((0, -1, ev))
    return out


def maximal_runs(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring runs (i, j, sum), in order, by one linear scan: no longer run that holds one has a higher sum, and they don't meet."""
    runs: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum up to the end
    up: list[int] = []  # for each run the last one before it that starts lower
    total = 0.0
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        run = (k, k + 1, before, total)
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][2] >= run[2]:
                j = up[j]
            if j < 0 or runs[j][3] >= run[3]:
                runs.append(run)
                up.append(j)
                break
            run = (runs[j][0], run[1], runs[j][2], run[3])
            del runs[j:], up[j:]
    return [(i, j, b - a) for i, j, a, b in runs]


def best_run(scores: list[float]) -> tuple[int, int]:
    """The run [i, j) with the largest sum, the first of equal ones; (0, 0) if no sum is positive."""
    i, j, _ = max(maximal_runs(scores), key=lambda r: r[2], default=(0, 0, 0.0))
    return i, j


def _kept(masked: list[tuple], w: Weights) -> set[int]:
    """The blocks of the best run that aren't wholly in a hole of it."""
    scores, told = [], -1  # told: the last block whose words cost like a tag
    for m, n, ev in masked:
        s = w.word(m) if n > 0 else w.tag(m) if n == 0 else 0.0
        if n > 0 and s < 0:
            s, told = 0.0 if told == ev[1] else s, ev[1]
        scores.append(s * n if s > 0 else s)
    i, j = best_run(scores)
    inner = [-s for s in scores[i:j]]
    out = set()
    holes = [(a, b) for a, b, s in maximal_runs(inner) if s > w.hole]
    at = 0
    for k in range(i, j):
        while at < len(holes) and holes[at][1] <= k - i:
            at += 1
        if masked[k][1] > 0 and not (at < len(holes) and holes[at][0] <= k - i):
            out.add(masked[k][2][1])
    return out


def _regression(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float) -> np.ndarray:
    """Weights, the intercept last, of a logistic regression by Newton's steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (y - p)) - penalty * w
        h = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-4:
            break
    return w


def _grouped(rows: list[tuple[int, float, float]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (bits, y, weight) as matrix, y and weights, those with equal bits as one."""
    total: dict[int, list[float]] = {}
    for m, y, n in rows:
        t = total.setdefault(m, [0.0, 0.0])
        t[0] += y * n
        t[1] += n
    size = (width + 7) // 8
    raw = np.frombuffer(b"".join(m.to_bytes(size, "little") for m in total), np.uint8).reshape(len(total), size)
    y, n = np.array(list(total.values())).T
    return np.unpackbits(raw, axis=1, bitorder="little")[:, :width].astype(np.float64), y / n, n


def fit(pages=None, ridge: float = 3.0, least_pages: int = 10) -> Weights:
    """Learns all weights on three quarters of the labelled pages, and the least sum of a hole on the rest. Features of fewer pages than least_pages don't count."""
    parsed = [Page(p) for p in (*PAGES * 3, *generated())] if pages is None else [Page(p) for p in pages]
    learn = len(parsed) * 3 // 4  # the rest is for the holes
    seen: dict[str, int] = {}
    for p in parsed[:learn]:
        names = {f for _, fs in p.blocks() for f in fs if f} | {f for e in p.elements[1:] for f in _own(e)} | {f"{k} {v}" for k, _, v, _ in p.events if k in ("open", "close")}
        for f in names:
            seen[f] = seen.get(f, 0) + 1
    names = ["in core", "in beside", "in far", *sorted(f for f, n in seen.items() if n >= least_pages)]
    bits = {f: 1 << i for i, f in enumerate(names)}
    masked = [_masked(p, lambda f: bits.get(f, 0)) for p in parsed]
    words, tags = {}, []
    for k, seq in enumerate(masked):
        inside = [x[2][3].marked for x in seq if x[1] > 0]
        at = 0  # number of words' runs before
        for m, n, (_, block, _, e) in seq:
            if n > 0:
                a, b, _ = words.get((k, block), (0, 0, 0))
                words[k, block] = (a + n * e.marked, b + n, m if not b else words[k, block][2] & m)
                at += 1
            elif n == 0:
                tags += [(m, 0 < at < len(inside) and inside[at - 1] and inside[at])] * (k < learn)
    of_words = _regression(*_grouped([(m, float(2 * a > b), b**0.5) for (k, _), (a, b, m) in words.items() if k < learn], len(names)), ridge)
    of_tags = _regression(*_grouped([(m, float(y), 1.0) for m, y in tags], len(names)), ridge)
    truth = [{b for (k, b), (a, n, _) in words.items() if k == i and 2 * a > n} for i in range(len(parsed))]
    sizes = [{b: n for (k, b), (_, n, _) in words.items() if k == i} for i in range(len(parsed))]

    def f1(i: int, got: set[int]) -> float:
        of = lambda blocks: sum(sizes[i][b] for b in blocks)
        return 2 * of(got & truth[i]) / max(1, of(got) + of(truth[i]))

    best = None
    for hole in (1.0, 2.0, 4.0, 8.0, 16.0):
        w = Weights(bits, of_words, of_tags, hole)
        right = sum(f1(i, _kept(masked[i], w)) for i in range(learn, len(masked)))
        if best is None or right > best[0]:
            best = (right, w)
    return Weights(bits, of_words, of_tags, best[1].hole)  # without what it remembers


@cache
def weights() -> Weights:
    return fit()


def main_text(page: str | None, w: Weights | None = None) -> str:
    """The main text of a page: its blocks, white space in each made one space, joined by two line ends; empty if there is none."""
    w, p = w or weights(), Page(page or "")
    masked = _masked(p, lambda f: w.bits.get(f, 0))
    kept = _kept(masked, w)
    blocks: dict[int, list[str]] = {}
    for kind, block, text, _ in p.events:
        if kind in ("word", "blank") and block in kept:
            blocks.setdefault(block, []).append(text)
    texts = (" ".join(entities.unescape("".join(t)).split()) for t in blocks.values())
    return "\n\n".join(t for t in texts if t)


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Every row's (id, url, text, n_chars). Null and empty html, and pages without content: empty text.

    Nothing is capped: a page's time is in proportion to its length. Ties: the first run. Repeated rows come back as often; other
    columns are left out. Empty table: no rows. The weights are learned once, on the driver, and go out with the tasks.
    """
    kind, w = pages.schema[id].dataType.simpleString(), weights()

    def run(batches):
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h, w) for h in b.column(2).to_pylist()], pa.string())], [id, "url", "text"])

    out = pages.select(F.col(id), F.col(url).cast("string").alias("url"), html).mapInArrow(run, f"`{id}` {kind}, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_html(spark, sf_dir):
    """Every page's main text."""
    return extract(table(spark, sf_dir, "pages"))
