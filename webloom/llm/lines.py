"""Fuzzy line deduplication by MinHash over the lines of all documents.

1. Each distinct line gets a one-permutation MinHash signature of its character shingles, cut into bands.
2. Lines that share a band are candidates. In a band with few lines all are paired; in a large one (copies of one
   line with small changes) each is paired with the band's first line and with its neighbour, which is linear.
3. Pairs are verified by the exact Jaccard similarity of their shingle sets, and distributed union-find joins what is alike.
4. Large bands in which more than one component is left are compared, in tiles: the lines outside the band's largest component with those in it and
   with one another. Lines of the largest component are already joined. Where more than SPLIT lines are outside (a template that many different lines
   share), those meet one another on their rarest shingles
   instead: of a set of n only the first few in order of rarity can be where it meets another one that is alike, and only sets of near
   lengths do. That is exact, and shingles that everybody has aren't among them; copies of one line with small changes have hardly any others, but are
   one component. So each pair that shares a band is verified or already connected.
5. Of each component the first occurrence stays; all other occurrences, exact copies too, go.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from webloom.llm.common import dropped, sliced, small, spread, table, written
from webloom.llm.components import connected, forest
from webloom.llm.sketches import may_be_alike, pair_may_be_alike

SHINGLE, BANDS, ROWS, SIMILARITY = 7, 14, 4, 0.8
#: Bands with so many lines or fewer are paired whole.
FEW = 8
#: Large bands that are compared whole are cut into tiles of so many lines.
TILE = 512
#: Where more lines of a band are outside its largest component, those meet by their rarest shingles: the work for a line stays within so many others.
SPLIT = 2048
#: Counters of shingles, by which their rarity goes; several shingles may share one.
COUNTERS = 1 << 18
#: Bands by task of the pass that finds those of more than one line.
BANDS_A_PART = 1_000_000
#: Broadcast line ids or documents' lists of dropped lines up to this number, else join through a shuffle.
MOST_ROWS = 1_000_000

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Powers of _GOLD modulo 2**64, for joining hashes of neighbouring runs.
_POWERS = {i: np.uint64(pow(int(_GOLD), i, 1 << 64)) for i in range(1, 64)}
_ORDER = np.stack([np.random.default_rng(11 + i).permutation(BANDS * ROWS) for i in range(BANDS * ROWS)])


def _hashed(lines: list[str], k: int = SHINGLE):
    """(first line, hashes of all shingles, their lines' numbers counted from the first one) for runs of lines of some 30,000 characters.

    A line shorter than a shingle is one shingle, as if filled up with NUL.
    """
    n, at = len(lines), 0
    while at < n:
        end, total = at, 0
        while end < n and (end == at or total + len(lines[end]) < 1 << 15):  # what the processor's cache holds
            total += len(lines[end])
            end += 1
        pad = "\0" * (k - 1)
        c = np.frombuffer(pad.join([*lines[at:end], ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
        sizes = np.fromiter(map(len, lines[at:end]), np.int64, end - at)
        count = np.maximum(sizes - k + 1, 1)
        h, width = c, 1
        for bit in bin(k)[3:]:  # hashes of 1, 2 ... k characters, by doubling
            h = h[: len(h) - width] * _POWERS[width] + h[width:]
            width *= 2
            if bit == "1":
                h = h[: len(h) - 1] * _GOLD + c[width : width + len(h) - 1]
                width += 1
        start = np.concatenate([[0], np.cumsum(sizes + k - 1)[:-1]])
        owner = np.repeat(np.arange(end - at), count)
        where = np.arange(len(owner)) + np.repeat(start - (np.cumsum(count) - count), count)
        yield at, _mixed(h[where]), owner, count
        at = end


def bands_of(lines: list[str], k: int = SHINGLE, hashed=_hashed) -> np.ndarray:
    """(line, band) hashes. An empty bin takes the value of the first bin that isn't empty in a fixed random order of its own."""
    n, bins = len(lines), BANDS * ROWS
    low = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    for at, h, owner, _ in hashed(lines, k):
        slot = (owner + at) * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(low, slot, h & np.uint64(0xFFFFFFFF))
    low = low.reshape(n, bins)
    sig, full = low.copy(), low != np.iinfo(np.uint64).max
    row, bin_ = np.nonzero(~full)
    for t in range(bins):
        if not len(row):
            break
        src = _ORDER[bin_, t]
        ok = full[row, src]
        sig[row[ok], bin_[ok]] = low[row[ok], src[ok]] + (np.uint64(t + 1) << np.uint64(32))
        row, bin_ = row[~ok], bin_[~ok]
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLD, (n, 1))
    for r in range(ROWS):
        out = _mixed(out * _GOLD + sig[:, r::ROWS])
    return out.view(np.int64)


def shingle_sets(lines: list[str], k: int = SHINGLE, hashed=_hashed) -> list[np.ndarray]:
    """Each line's set of shingles, as sorted 64-bit hashes."""
    out = []
    for _, h, owner, count in hashed(lines, k):
        ends = np.cumsum(count)
        for s, e in zip((ends - count).tolist(), ends.tolist(), strict=True):
            h[s:e].sort()
        first = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]
        out += np.split(h[first], np.cumsum(np.add.reduceat(first, ends - count))[:-1])
    return out


def alike(x: np.ndarray, y: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sets is least or more; the sizes alone often tell that it isn't."""
    n, m = len(x), len(y)
    if min(n, m) < least * max(n, m):
        return False
    both = np.concatenate([x, y])
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return same >= least * (n + m - same)


def all_alike(sets: list[np.ndarray], least: float = SIMILARITY, of_sets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j) of sets that are alike, once each; with of_sets (bools) those of which it has one or both.

    Only elements of two sets or more count; their incidence matrix, in parts, times its own transpose has what pairs have in common."""
    some = np.arange(len(sets)) if of_sets is None else np.flatnonzero(of_sets)
    sizes = np.array([len(x) for x in sets], np.float32)
    elements, of, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    shared = count[of] > 1
    of, owner = (np.cumsum(count > 1) - 1)[of[shared]], owner[shared]
    same = np.zeros((len(some), len(sets)), np.float32)
    order = np.argsort(of, kind="stable")
    of, owner = of[order], owner[order]
    for lo in range(0, int(of[-1]) + 1 if len(of) else 0, 4096):
        s, e = np.searchsorted(of, (lo, lo + 4096))
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[s:e], of[s:e] - lo] = 1
        same += m[some] @ m.T
    i, j = np.nonzero(same >= least * (sizes[some, None] + sizes - same))
    i, rest = some[i], np.ones(len(sets), bool)
    rest[some] = False
    once = (i < j) | rest[j]
    return i[once], j[once]


def line_id(line: str) -> tuple[int, int]:
    """A line's identity: a number for joins, and one more that tells lines of the same number apart; together a 128-bit digest."""
    h = xxhash.xxh3_128_intdigest(line.encode("utf-8", "surrogatepass"))
    return (h & (1 << 64) - 1) - (1 << 63), (h >> 64) - (1 << 63)


def identified(seen: DataFrame, tag: str, *most):
    """seen(line, check, ...) -> (seen, one row a line with its number n and the aggregates most (a table of its own), told). Where different lines share a number,
    they get other ones; told() gives the same ones to the rows of any other table with line and check."""
    clashes = []

    def told(df: DataFrame) -> DataFrame:
        for c in clashes:
            df = df.join(c, "line", "left").withColumn("line", F.when(F.col("_clash"), F.xxhash64("line", "check")).otherwise(F.col("line"))).drop("_clash")
        return df

    while True:
        now = told(seen)
        per_line = written(now.groupBy("line").agg(F.count("*").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi"), *most), f"{tag}-per-line")
        clash = per_line.where("lo <> hi").select("line", F.lit(True).alias("_clash"))
        if not clash.take(1):
            told.any = bool(clashes)
            return now, per_line, told
        clashes.append(small(written(clash, f"{tag}-clash"), MOST_ROWS))
        dropped(per_line)


def lines_of(text: str | None):
    """(number, line) of the lines that aren't blank, without white space around them."""
    return [(i, s) for i, x in enumerate((text or "").split("\n")) if (s := x.strip())]


def _batch(names, *arrays):
    return pa.RecordBatch.from_arrays(list(arrays), names)


def _longs(values) -> pa.Array:
    return pa.array(values, pa.int64())


def _occurrences(ids):
    def run(batches):
        for b in sliced(batches):
            lines, nos, rows, known = [], [], [], {}
            for r, text in enumerate(b.column(2).to_pylist()):
                for no, line in lines_of(text):
                    if (i := known.get(line)) is None:
                        i = known[line] = ids(line)
                    lines.append(i)
                    nos.append(no)
                    rows.append(r)
            at = _longs(rows)
            yield _batch(["line", "check", "id", "dk", "no"], _longs([i for i, _ in lines]), _longs([c for _, c in lines]), b.column(0).take(at), b.column(1).take(at), pa.array(nos, pa.int32()))

    return run


def _distinct_lines(batches, units, ids):
    """The lines (or other units) of a few texts at a time, once each: line, check, text."""
    for b in sliced(batches, 1024):
        found = {}
        for text in b.column(0).to_pylist():
            for _, line in units(text):
                found.setdefault(line, None)
        lines = list(found)
        both = [ids(x) for x in lines]
        yield np.array([i for i, _ in both], np.int64), np.array([c for _, c in both], np.int64), lines


def _bands(units, k: int, hashed, ids, checks: bool):
    def run(batches):
        for line, check, lines in _distinct_lines(batches, units, ids):
            for i in range(0, len(lines), 4096):
                band, part = bands_of(lines[i : i + 4096], k, hashed), slice(i, i + 4096)
                yield _batch(["band", "line", "check"][: 2 + checks], pa.array(band.ravel()), pa.array(np.repeat(line[part], BANDS)), *[pa.array(np.repeat(check[part], BANDS))] * checks)

    return run


def _texts(units, ids):
    def run(batches):
        for line, check, lines in _distinct_lines(batches, units, ids):
            yield _batch(["line", "check", "text"], pa.array(line), pa.array(check), pa.array(lines, pa.string()))

    return run


def _packed(bands, parts: int, most: int = 1 << 19):
    """Batches (band, line) -> rows (part, rows): the bands, then the lines, of those rows whose band belongs to the part, as bytes. A row for very many of them,
    as most bands have one line only and needn't be told apart by the shuffle."""

    def run(batches):
        held, n = [], 0

        def out():
            band, line = (np.concatenate(x) for x in zip(*held, strict=True))
            part = ((band.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            band, line, part = band[order], line[order], part[order]
            cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
            rows = [band[s:e].tobytes() + line[s:e].tobytes() for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            return _batch(["part", "rows"], pa.array(part[cuts[:-1]]), pa.array(rows, pa.binary()))

        for b in bands(batches):
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
                n += b.num_rows
            if n >= most:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return run


def _shared(batches, most: int = 1 << 19):
    """Rows (part, rows) as of _packed -> (band, line) of all bands that more than one line has; a line may come several times.

    Of a band only its first line is held, so what is held goes by the number of bands, not by the size of any.
    """
    bands, firsts, said = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    held, n = [], 0

    def merged():
        nonlocal bands, firsts, said
        every = np.concatenate([bands, *(x[: len(x) // 2] for x in held)])
        order = np.argsort(every, kind="stable")  # what is held of a band comes first
        every, line = every[order], np.concatenate([firsts, *(x[len(x) // 2 :] for x in held)])[order]
        start = np.r_[True, every[1:] != every[:-1]]
        of = np.cumsum(start) - 1
        before = np.concatenate([said, np.zeros(len(every) - len(said), bool)])[order][start]
        bands, firsts = every[start], line[start]
        other = line != firsts[of]
        said = before.copy()
        said[of[other]] = True
        new = said & ~before
        return _batch(["band", "line"], pa.array(np.concatenate([bands[new], every[other]])), pa.array(np.concatenate([firsts[new], line[other]])))

    for b in batches:
        for x in b.column(1).to_pylist():
            held.append(np.frombuffer(x, np.int64))
            n += len(held[-1]) // 2
            if n >= max(most, len(bands)):
                yield merged()
                held, n = [], 0
    if held:
        yield merged()


def banded(docs: DataFrame, text: str, units, k: int, hashed, ids, told, lines: int) -> DataFrame:
    """(band, line) of the lines that share a band with another line, by MinHash. lines: how many there are, for the number of parts they are dealt to."""
    parts = max(math.ceil(lines * BANDS / BANDS_A_PART), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed, bands = "part int, rows binary", _bands(units, k, hashed, ids, told.any)
    if told.any:
        rows = told(docs.select(text).mapInArrow(bands, "band long, line long, check long")).select("band", "line").mapInArrow(_packed(iter, parts), packed)
    else:
        rows = docs.select(text).mapInArrow(_packed(bands, parts), packed)
    return rows.repartitionById(parts, "part").mapInArrow(_shared, "band long, line long")


def texts_of(docs: DataFrame, text: str, units, ids, told) -> DataFrame:
    """(line, text) of every line, maybe several times."""
    return told(docs.select(text).mapInArrow(_texts(units, ids), "line long, check long, text string")).select("line", "text")


# --- bands of the rarest elements -----------------------------------------------------------------------------------------


def _fresh(batches, most: int = 1_000_000):
    """(lines, texts) of rows (line, text), a few at a time, without those that the task has had a short while ago."""
    had: set[int] = set()
    for b in sliced(batches, 1024):
        new = {i: at for at, i in enumerate(b.column(0).to_pylist()) if i not in had}
        had = set(new) if len(had) > most else had
        had.update(new)
        if new:
            yield list(new), b.column(1).take(_longs(list(new.values()))).to_pylist()


def _counted(sets_of):
    """Rows (line, text) -> (slot, n): how many sets have an element that falls on each counter."""

    def run(batches):
        total = np.zeros(COUNTERS, np.int64)
        for _, texts in _fresh(batches):
            sets = sets_of(texts)
            if sets:
                total += np.bincount((np.concatenate(sets) % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        slots = np.flatnonzero(total)
        yield _batch(["slot", "n"], pa.array(slots.astype(np.int32)), pa.array(total[slots]))

    return run


def prefix(s: np.ndarray, often: np.ndarray, least: float) -> list[tuple[np.ndarray, int, int]]:
    """Where a set meets others that are alike: (elements, length class, role).

    In one order of all elements, rare ones first, two sets of Jaccard similarity least or more that aren't longer than one another by more than that
    share one of the first elements of each: of the shorter one's first n - ceil(2 least / (1 + least) n) + 1 (role 0) and of
    the longer one's first n - ceil(least n) + 1 (role 1 beyond the others). The longer one goes to its own
    class of lengths (powers of two) and, if a partner may be there, to the one below.
    """
    n = len(s)
    if not n:
        return []
    s = s[np.lexsort((s, often[(s % np.uint64(len(often))).astype(np.int64)]))]
    index, probe = n - math.ceil(2 * least / (1 + least) * n - 1e-9) + 1, n - math.ceil(least * n - 1e-9) + 1
    own, below = n.bit_length(), math.ceil(least * n - 1e-9).bit_length()
    out = [(s[:index], own, 0)]
    if probe > index:
        out.append((s[index:probe], own, 1))
    if below < own:
        out.append((s[:probe], below, 1))
    return out


def _rarest(sets_of, least: float, often):
    """Rows (line, text [, group]) -> (band, line, role)."""

    def fresh(batches):
        for ids, texts in _fresh(batches):
            yield ids, texts, np.zeros(len(ids), np.int64)

    def given(batches):
        for b in sliced(batches, 1024):
            yield b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy()

    def run(batches, source):
        table_ = often.value
        for ids, texts, groups in source(batches):
            bands, lines, roles = [], [], []
            for line, s, group in zip(ids, sets_of(texts), groups.view(np.uint64), strict=True):
                for x, part, role in prefix(s, table_, least):
                    bands.append(_mixed((x ^ group) + np.array([part], np.uint64) * _GOLD))
                    lines.append(np.full(len(x), line, np.int64))
                    roles.append(np.full(len(x), role, np.int8))
            if bands:
                yield _batch(["band", "line", "role"], *(pa.array(np.concatenate(x)) for x in ([y.view(np.int64) for y in bands], lines, roles)))

    return lambda batches: run(batches, fresh), lambda batches: run(batches, given)


def rarest(texts: DataFrame, sets_of, least: float) -> DataFrame:
    """texts(line, text [, group]) -> (band, line, role): where the sets that sets_of makes of the texts meet (in their group, if any). Exact: all pairs that are alike share a band."""
    spark = texts.sparkSession
    often = np.zeros(COUNTERS, np.int64)
    for slot, n in texts.select("line", "text").mapInArrow(_counted(sets_of), "slot int, n long").groupBy("slot").agg(F.sum("n")).collect():  # a row for each counter
        often[slot] = n
    fresh, given = _rarest(sets_of, least, spark.sparkContext.broadcast(often))
    return texts.mapInArrow(given if "group" in texts.columns else fresh, "band long, line long, role byte")


# --- pairs and links ------------------------------------------------------------------------------------------------------


def _groups(batches):
    """Rows sorted by their first column -> (columns of the rows of whole groups), as they come; a group may be large."""
    held = None
    for b in batches:
        now = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if cut:
            yield [x[:cut] for x in held]
            held = [x[cut:] for x in held]
    if held is not None and len(held[0]):
        yield held


def _paired(batches):
    """Rows (band, role, line) sorted -> candidate pairs (a, b), and large = the band where it has more than FEW lines of role 0 (else null).

    Lines of role 1 meet those of role 0 only. One pass with the band's first lines and the last one in memory, whatever the band's
    size. Only rows that share their band with a neighbour (or may, at a batch's ends) are looked at one by one.
    """
    band, seen, last, count = None, [], None, 0
    for batch in batches:
        gs, rs, ls = (batch.column(i).to_numpy() for i in range(3))
        if not len(gs):
            continue
        next_ = gs[1:] == gs[:-1]
        some = np.r_[True, next_] | np.r_[next_, True]
        a, c, large = [], [], []
        for g, role, line in zip(gs[some].tolist(), rs[some].tolist(), ls[some].tolist(), strict=True):
            if g != band:
                band, seen, last, count = g, [line] * (not role), line, 1 - role
                continue
            if line == last:
                continue
            count += not role
            if count <= FEW:
                for other in seen:
                    a.append(line)
                    c.append(other)
                    large.append(None)
                if not role:
                    seen.append(line)
            else:
                if not role and count == FEW + 1:  # the band turns out to be large: its first lines belong to it as well
                    for other in seen:
                        a.append(other)
                        c.append(seen[0])
                        large.append(g)
                for other in {seen[0], last}:
                    a.append(line)
                    c.append(other)
                    large.append(g)
            last = line
        if a:
            yield _batch(["a", "b", "large"], _longs(a), _longs(c), _longs(large))


def _verified(least: float, k: int = SHINGLE, hashed=_hashed):
    """Rows (a, b, text of a, text of b) -> the pairs that are alike."""

    def run(batches):
        kept: dict[int, np.ndarray] = {}
        held = 0
        for b in sliced(batches, 2048):
            a, c, ta, tc = (b.column(i).to_pylist() for i in range(4))
            new = {i: t for i, t in (*zip(a, ta, strict=True), *zip(c, tc, strict=True)) if i not in kept}
            if held > 4_000_000:
                kept, held = {}, 0
                new = dict(zip(a, ta, strict=True)) | dict(zip(c, tc, strict=True))
            kept.update(zip(new, shingle_sets(list(new.values()), k, hashed), strict=True))
            held += sum(map(len, new.values()))
            yield b.filter(pa.array([alike(kept[x], kept[y], least) for x, y in zip(a, c, strict=True)])).select(["a", "b"])

    return run


def _hopeful(least: float):
    """Rows (a, b, size and sketch of a, of b) -> the pairs that may be alike (see webloom.llm.sketches)."""

    def run(batches):
        for b in sliced(batches, 4096):
            sides = zip(*(b.column(i).to_pylist() for i in (3, 2, 5, 4)), strict=True)
            yield b.filter(pa.array([pair_may_be_alike(*x, least) for x in sides], pa.bool_())).select(["a", "b"])

    return run


def _hopeful_lines(least: float):
    """Rows (g, line, root, size, sketch) sorted by g -> (g, line, root) of the lines that may be like one of another root in their g."""

    def run(batches):
        for g, line, root, size, sketches in _groups(batches):
            some = np.zeros(len(g), bool)
            cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(g)], strict=True):
                own = root[s:e]
                if not (own == own[0]).all():
                    some[s:e] = (may_be_alike(list(sketches[s:e]), size[s:e], least) & (own[:, None] != own)).any(axis=0)
            if some.any():
                yield _batch(["g", "line", "root"], _longs(g[some]), _longs(line[some]), _longs(root[some]))

    return run


def _compared(least: float, k: int = SHINGLE, hashed=_hashed):
    """Rows (g, line, root, text [, core]) sorted by g -> links between lines of different roots; those of the core, which have one root, aren't compared with one another."""

    def run(batches):
        for g, line, root, text, *core in _groups(batches):
            out = []
            cuts = np.flatnonzero(g[1:] != g[:-1]) + 1
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(g)], strict=True):
                own = root[s:e]
                if e - s < 2 or (own == own[0]).all():
                    continue
                i, j = all_alike(shingle_sets(list(text[s:e]), k, hashed), least, ~core[0][s:e].astype(bool) if core else None)
                apart = own[i] != own[j]
                out.append(forest(own[i[apart]], own[j[apart]]))
            if out:
                a, b = (np.concatenate(x) for x in zip(*out, strict=True))
                yield _batch(["a", "b"], pa.array(a, pa.int64()), pa.array(b, pa.int64()))

    return run


def _pairs(rows: DataFrame, tag: str) -> DataFrame:
    """rows(band, line [, role]) -> (a, b, large), written."""
    rows = rows.select("band", F.col("role") if "role" in rows.columns else F.lit(0).cast("byte").alias("role"), "line")
    return written(rows.repartition("band").sortWithinPartitions("band", "role", "line").mapInArrow(_paired, "a long, b long, large long"), f"{tag}-pairs")


def _found(pairs: DataFrame, texts: DataFrame, least: float, k: int, hashed, tag: str) -> DataFrame:
    """The pairs (a, b) that are alike, written."""
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    return written(both.mapInArrow(_verified(least, k, hashed), "a long, b long"), f"{tag}-links")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """(large, line, root, size, outer, core) of the large bands of pairs in which more than one component is left. core: whether the line is
    in the band's largest component; outer: how many lines of the band aren't."""
    large = pairs.where("large is not null").select("large", F.col("a").alias("line")).distinct()
    large = large.join(roots.toDF("line", "root"), "line", "left").select("large", "line", F.coalesce("root", "line").alias("root"))
    mixed = large.groupBy("large", "root").agg(F.count("*").alias("n")).groupBy("large").agg(F.sum("n").alias("size"), F.max(F.struct("n", "root")).alias("most"))
    mixed = mixed.where("most.n < size").select("large", "size", (F.col("size") - F.col("most.n")).alias("outer"), F.col("most.root").alias("main"))
    mixed = written(mixed, "lines-mixed")
    out = spread(large, mixed, "large", "line", MOST_ROWS, many="size").withColumn("core", F.col("root") == F.col("main")).drop("main")
    out = written(out, "lines-apart")
    dropped(mixed)
    return out


def _tiles(whole: DataFrame) -> DataFrame:
    """(g, line, root, core) for the tiles in which the lines outside the largest component of a band meet those in it and, where inner is true, one another."""
    outer, core = (F.ceil(c / TILE).cast("int") for c in (F.col("outer"), F.col("size") - F.col("outer")))
    own = F.when(F.col("core"), outer + F.pmod(F.xxhash64("line"), core).cast("int")).otherwise(F.pmod(F.xxhash64("line"), outer).cast("int"))
    first = F.when(F.col("core") | F.col("inner"), F.lit(0)).otherwise(outer)
    last = F.when(F.col("core"), outer - 1).otherwise(outer + core - 1)
    pair = F.transform(F.sequence(first, last), lambda t: F.xxhash64("large", F.least(t, own), F.greatest(t, own)))
    return whole.select(F.explode(pair).alias("g"), "line", "root", "core")


def _texts_of(lines: DataFrame, texts: DataFrame, tag: str) -> DataFrame:
    """(line, text) of the lines, once each, written. texts has them and others."""
    texts = texts.join(small(lines, MOST_ROWS), "line", "left_semi")
    return written(texts.dropDuplicates(["line"]), f"{tag}-texts")  # copies are combined where they are read


def links(rows: DataFrame, texts: DataFrame, least: float, k: int = SHINGLE, hashed=_hashed, tag: str = "lines", sketches: DataFrame | None = None) -> DataFrame:
    """rows(band, line [, role]), texts(line, text) of those lines -> (node, root) of lines that are like others (see components.connected). hashed, k: how a text becomes a set.

    sketches: (line, size, sketch) of each line's set, as of webloom.llm.sketches; only pairs that those leave open are compared, and only their texts are moved.
    texts is read twice then. Only for rows with a role.
    """
    assert sketches is None or "role" in rows.columns
    pairs, all_texts = _pairs(rows, tag), texts
    once, open_ = pairs.select("a", "b").where("a <> b").distinct(), pairs
    if sketches is not None:
        sketches = small(sketches, MOST_ROWS, F.length("sketch") / 64 + 0.5)
        side = lambda c: sketches.toDF(c, f"n{c}", f"s{c}")
        once = open_ = written(once.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "sa", "nb", "sb").mapInArrow(_hopeful(least), "a long, b long"), f"{tag}-open")
    wanted = written(open_.select(F.col("a").alias("line")).union(open_.select("b")).distinct(), f"{tag}-wanted")
    texts = _texts_of(wanted, all_texts, tag)
    found = _found(once, texts, least, k, hashed, tag)
    roots = connected(found)
    whole = _apart(pairs, roots)
    large, inner = whole.where((F.col("outer") > SPLIT) & ~F.col("core")).select("line", F.col("large").alias("group")), F.lit(True)
    if "role" not in rows.columns and large.take(1):
        more = _pairs(rarest(large.join(texts, "line").select("line", "text", "group"), lambda lines: shingle_sets(lines, k, hashed), least), f"{tag}-rare")
        top = lambda c: roots.toDF(c, f"r{c}")
        new = more.select("a", "b").where("a <> b").distinct().join(top("a"), "a", "left").join(top("b"), "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
        again = _found(new, texts, least, k, hashed, f"{tag}-rare")
        before, roots = roots, connected(roots.toDF("a", "b").union(again))
        rest = _apart(more, roots)
        now = whole.drop("root").join(roots.toDF("line", "root"), "line", "left").withColumn("root", F.coalesce("root", "line"))
        both = written(rest.withColumn("inner", F.lit(True)).unionByName(now.withColumn("inner", F.col("outer") <= SPLIT)), f"{tag}-whole")
        dropped(again, before, more, rest, whole)
        whole, inner = both, F.col("inner")
    if whole.take(1):
        tiles = _tiles(whole.withColumn("inner", inner))
        if sketches is not None:
            tiles = tiles.join(sketches, "line").select("g", "line", "root", "size", "sketch").repartition("g").sortWithinPartitions("g")
            tiles = written(tiles.mapInArrow(_hopeful_lines(least), "g long, line long, root long"), f"{tag}-tiles")
            dropped(texts)
            texts = _texts_of(tiles.select("line").distinct(), all_texts, tag)
        core = F.col("core") if sketches is None else F.lit(False)
        rest = tiles.join(texts, "line").select("g", "line", "root", "text", core.alias("core"))
        rest = rest.repartition("g").sortWithinPartitions("g").mapInArrow(_compared(least, k, hashed), "a long, b long")
        before, roots = roots, connected(roots.toDF("a", "b").union(rest))
        dropped(before, *[tiles] * (sketches is not None))
    dropped(pairs, wanted, texts, found, whole, *[once] * (sketches is not None))
    return roots


def _without(at: int, names: list[str]):
    """Rows with the numbers of the lines to drop as their last column -> rows without those lines, and how many they are."""

    def one(text, gone):
        if not gone or text is None:
            return text
        gone = set(gone)
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

    def run(batches):
        for b in sliced(batches):
            gone = b.column(b.num_columns - 1).to_pylist()
            columns = [b.column(i) for i in range(b.num_columns - 1)]
            columns[at] = pa.array([one(t, g) for t, g in zip(columns[at].to_pylist(), gone, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([len(g or ()) for g in gone], pa.int32())], names)

    return run


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least: float = SIMILARITY, ids=line_id) -> DataFrame:
    """Every row of docs with its lines of which an earlier one (by id, then row, then place) is a copy or alike removed.

    All columns of docs; text is what is left, joined by line ends; then lines_dropped int. Lines are compared without the
    white space around them; blank lines always stay. Alike: in one component of the links of Jaccard similarity least or more
    over 7-character shingles. Null text stays null; a text that loses all lines becomes empty, the row stays. Rows with the
    same id and text are one (a line that stays in one stays in all); a null id is the least. A column named
    lines_dropped is replaced. Empty table: no rows. Lines are told apart by 128-bit digests (ids).
    """
    keyed = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("dk"), F.col(text).alias("text"))
    kind = docs.schema[id].dataType.simpleString()
    occurrences = written(keyed.mapInArrow(_occurrences(ids), f"line long, check long, id {kind}, dk long, no int"), "lines-seen")
    at = F.struct("id", "dk", "no")
    seen, per_line, told = identified(occurrences, "lines", F.min(at).alias("first"))
    found = links(banded(docs, text, lines_of, SHINGLE, _hashed, ids, told, per_line.count()), texts_of(docs, text, lines_of, ids, told), least)
    roots = found.toDF("line", "root")
    members = roots.union(roots.select("root", "root").distinct())
    known = written(per_line.join(members, "line", "left").where("n > 1 or root is not null").select("line", "root", "first", "n"), "lines-known")
    linked = known.where("root is not null")
    firsts = written(linked.groupBy("root").agg(F.min("first").alias("stays"), F.count("*").alias("lines")), "lines-least")
    stays = spread(linked.select("line", "root", "n"), firsts, "root", "line", MOST_ROWS, many="lines").select("line", "stays", "n")
    stays = written(stays.union(known.where("root is null").select("line", "first", "n")), "lines-stays")
    gone = spread(seen, stays, "line", ("id", "dk", "no"), MOST_ROWS, many="n").where(~at.eqNullSafe(F.col("stays"))).groupBy("id", "dk").agg(F.sort_array(F.collect_set("no")).alias("gone"))
    gone = written(gone, "lines-gone")
    dropped(occurrences, per_line, found, known, firsts, stays)
    gone = small(gone, MOST_ROWS, F.size("gone") / 8 + 1).toDF("_of_id", "_of_dk", "_gone")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    whole = whole.join(gone, F.col(f"row.`{id}`").eqNullSafe(F.col("_of_id")) & (F.xxhash64(f"row.`{text}`") == F.col("_of_dk")), "left")
    kept = [c for c in docs.columns if c != "lines_dropped"]
    schema = StructType([*(docs.schema[c] for c in kept), StructField("lines_dropped", IntegerType())])
    rows = whole.select(*(F.col(f"row.`{c}`") for c in kept), "_gone")
    return rows.mapInArrow(_without(kept.index(text), schema.names), schema)


def op5_lines(spark, sf_dir):
    """Every document with what is left of its text."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_dropped")
