"""Sequence packing by non-negative least squares.

A document's tokens (with the end token) are cut into whole windows, one piece of as many whole units as fit, and a tail
shorter than a unit. Counts of pieces by length in units form the histogram h. Every combination of at most `depth`
lengths that fills the window is a column of A; Lawson and Hanson's algorithm solves min |A x - h| with x >= 0, the counts
are rounded down, and what is left is packed greedily: laid end to end in order of length and cut at the windows'
ends, as are the tails. So only the last window of each of the two lines has padding.

The plan is a table of a few hundred rows, whatever the input. A piece finds its place by arithmetic on its rank among
the pieces of its length; ranks come from counts by task, so nothing but counts meets in one place.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import sliced, small, table, written

WINDOW, UNIT, DEPTH, END_ID = 2048, 64, 4, 1
TOKENIZER = "byte_bpe_50k.json"
#: Join the tasks' counts by broadcast up to this number of rows.
MOST_COUNTS = 1_000_000


# --- tokens -----------------------------------------------------------------------------------------------------------


def _byte_chars() -> dict[int, str]:
    """The byte-level BPE's character for each byte: printable ones of Latin-1 stand for themselves, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Kept(dict):
    """Ids by part of a text; what isn't there yet comes from the tokenizer's model. Emptied when it holds `most` parts."""

    CHARS = _byte_chars()

    def __init__(self, tokenizer, most: int):
        self.tokenize, self.most = tokenizer.model.tokenize, most

    def __missing__(self, part: str) -> bytes:
        ids = array("I", [t.id for t in self.tokenize(part.encode().decode("latin-1").translate(self.CHARS))]).tobytes()
        if len(self) >= self.most:
            self.clear()
        if len(part) <= 64:
            self[part] = ids
        return ids


class Encoder:
    """A text's ids by the tokenizer, as bytes (little-endian, 32 bits each).

    A byte-level BPE first splits a text by a fixed pattern and then encodes each part by itself, so the ids of a part
    are kept and used again. Texts with characters over which regular expression engines may differ, or with the string of an
    added token, go to the tokenizer whole.
    """

    # The pattern of the ByteLevel pre-tokenizer, and what it comes to on ASCII.
    PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
    ASCII = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+""", re.A)

    def __init__(self, path: str, keep: int = 400_000):
        self.tokenizer = tokenizer(path)
        self.kept = _Kept(self.tokenizer, keep)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = regex.compile(r"[\x1c-\x1f\x85\u180e\u200b-\u200d\u2060\ufeff\U000323b0-\U0010ffff]")

    def __call__(self, text: str) -> bytes:
        ascii_ = text.isascii()
        if any(a in text for a in self.added) or (not ascii_ and self.odd.search(text)) or (ascii_ and any(c in text for c in "\x1c\x1d\x1e\x1f")):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.kept.__getitem__, (self.ASCII if ascii_ else self.PATTERN).findall(text)))


@cache
def tokenizer(path: str):
    """A process reads the file once; the ids that an Encoder keeps go with its task."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


# --- crc32 of joined runs -----------------------------------------------------------------------------------------------


@cache
def _shift(n_bytes: int) -> tuple[int, ...]:
    """The CRC's linear map "followed by n zero bytes", as the images of the 32 bits."""
    if n_bytes == 0:
        return tuple(1 << i for i in range(32))
    if n_bytes == 1:
        one = []
        for i in range(32):
            c = 1 << i
            for _ in range(8):
                c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
            one.append(c)
        return tuple(one)
    half, rest = _shift(n_bytes // 2), _shift(n_bytes % 2)
    return tuple(_apply(rest, _apply(half, _apply(half, 1 << i))) for i in range(32))


def _apply(m: tuple[int, ...], v: int) -> int:
    out, i = 0, 0
    while v:
        if v & 1:
            out ^= m[i]
        v >>= 1
        i += 1
    return out


def crc_joined(crcs: list[int], n_bytes: int) -> int:
    """The CRC-32 of runs of n_bytes each, from the CRC-32 of each."""
    m, total = _shift(n_bytes), 0
    for c in crcs:
        total = _apply(m, total) ^ c
    return total


# --- the plan -----------------------------------------------------------------------------------------------------------


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All descending combinations of at most depth lengths from 1 to units that add up to units."""

    def parts(left: int, most: int, n: int):
        if left == 0:
            yield ()
        elif n:
            for k in range(min(left, most), 0, -1):
                if k * n < left:
                    break
                for rest in parts(left - k, k, n - 1):
                    yield (k, *rest)

    return list(parts(units, units, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 with the least |a x - b| (Lawson and Hanson, 1974)."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, np.abs(b).max(initial=0)) * a.shape[0]
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[used] = -np.inf
        if used.all() or w.max() <= tol:
            break
        used[np.argmax(w)] = True
        while True:
            s = np.zeros(n)
            s[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            if s[used].min() > 0:
                break
            bad = used & (s <= 0)
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            used &= x > 1e-12
            x[~used] = 0
            if not used.any():
                break
        x = s if used.any() else x
    return np.maximum(x, 0)


class Plan:
    """Where the k-th piece of each length goes.

    counts[c]: pieces of c units (1 to units). tail: tokens in tails. Sequences are numbered from 0: combinations first,
    then the line of whole units that are left, then the line of tails.
    """

    def __init__(self, counts: np.ndarray, tail: int, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH):
        self.window, self.unit, self.units = window, unit, window // unit
        combos = combinations(self.units, depth)
        a = np.zeros((self.units, len(combos)))
        for j, c in enumerate(combos):
            for k in c:
                a[k - 1, j] += 1
        left = np.asarray(counts[1:], np.int64).copy()
        slots = [[] for _ in range(self.units + 1)]  # of each length: (first rank, first sequence, per sequence, offsets)
        rank, seq = np.zeros(self.units + 1, np.int64), 0
        for j in np.argsort(-(x := nnls(a, left.astype(float))), kind="stable"):
            used = np.flatnonzero(a[:, j])
            n = int(min(np.floor(x[j] + 1e-6), (left[used] // a[used, j].astype(np.int64)).min()))
            if n <= 0:
                continue
            left[used] -= n * a[used, j].astype(np.int64)
            at = np.cumsum((0, *combos[j])) * unit
            for k in dict.fromkeys(combos[j]):
                offsets = [int(o) for o, c in zip(at, combos[j], strict=False) if c == k]
                slots[k].append((int(rank[k]), seq, len(offsets), offsets))
                rank[k] += n * len(offsets)
            seq += n
        self.slots, self.packed, self.line_seq = slots, rank, seq
        sizes = left * np.arange(1, self.units + 1)
        self.line_at = np.r_[0, sizes.sum() - np.cumsum(sizes)]  # where each length starts in the line, in units; longest first
        total = int(sizes.sum())
        self.tail_seq = seq + -(-total // self.units)
        self.sequences = self.tail_seq + -(-int(tail) // window)
        self.first = [np.array([s[0] for s in x]) for x in slots]

    def place(self, c: int, k: int) -> list[tuple[int, int, int, int]]:
        """(units before, units, sequence, offset) of each part of the k-th piece of c units."""
        if k < self.packed[c]:
            first, seq, per, offsets = self.slots[c][int(np.searchsorted(self.first[c], k, "right")) - 1]
            d, m = divmod(k - first, per)
            return [(0, c, seq + d, offsets[m])]
        at = int(self.line_at[c] + (k - self.packed[c]) * c)
        out, done = [], 0
        while done < c:
            s, o = divmod(at + done, self.units)
            n = min(c - done, self.units - o)
            out.append((done, n, self.line_seq + s, o * self.unit))
            done += n
        return out

    def cut_tail(self, at: int, length: int) -> list[tuple[int, int, int, int]]:
        """(tokens before, tokens, sequence, offset) of the parts of a tail at a token of the tails' line."""
        out, done = [], 0
        while done < length:
            s, o = divmod(at + done, self.window)
            n = min(length - done, self.window - o)
            out.append((done, n, self.tail_seq + s, o))
            done += n
        return out


# --- the operator -------------------------------------------------------------------------------------------------------


def _cut(path: str, end_id: int, window: int, unit: int, id: str):
    """Rows (id, text) -> pieces with their rank among this task's pieces of their length."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, task = Encoder(path), TaskContext.get().partitionId()
        seen = [0] * (window // unit + 1)
        for b in sliced(batches):
            out = {k: [] for k in ("id", "start", "length", "doc_tokens", "crc", "units", "tail", "c", "rank")}

            def add(*row, out=out):
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)

            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "") + end
                n, at = len(ids) // 4, 0
                while at < n:
                    c = min(n - at, window) // unit
                    length = c * unit or n - at
                    piece = ids[4 * at : 4 * (at + length)]
                    if c == 0:
                        crcs, tail, weight = b"", piece, length
                    else:
                        crcs, tail, weight = b"", b"", 1
                        if length < window:  # a whole window is never cut
                            crcs = np.array([zlib.crc32(piece[i : i + 4 * unit]) for i in range(0, len(piece), 4 * unit)], "<u4").tobytes()
                    add(doc, at, length, n, zlib.crc32(piece), crcs, tail, c, seen[c])
                    seen[c] += weight
                    at += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["id"], b.schema.field(0).type), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "doc_tokens", "crc")), *(pa.array(out[k], pa.binary()) for k in ("units", "tail")), pa.array(out["c"], pa.int32()), pa.array(out["rank"], pa.int64()), pa.array([task] * len(out["c"]), pa.int32())],
                [id, "start", "length", "doc_tokens", "crc", "units", "tail", "c", "rank", "task"],
            )

    return run


def _placed(plan: Plan, id: str):
    """Pieces with their rank among all of their length -> parts with their places."""

    def run(batches):
        unit = plan.unit
        for b in batches:
            out = [[] for _ in range(6)]
            ids = []
            for i, (start, length, n, crc, units, tail, c, rank) in enumerate(zip(*(b.column(k).to_pylist() for k in range(1, 9)), strict=True)):
                if c:
                    parts = [(u * unit, k * unit, s, o) for u, k, s, o in plan.place(c, rank)]
                else:
                    parts = plan.cut_tail(rank, length)
                for before, part, seq, offset in parts:
                    if part == length:
                        own = crc
                    elif c:
                        own = crc_joined(np.frombuffer(units, "<u4")[before // unit : (before + part) // unit].tolist(), 4 * unit)
                    else:
                        own = zlib.crc32(tail[4 * before : 4 * (before + part)])
                    ids.append(i)
                    for k, v in enumerate((start + before, part, own, n, seq, offset)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), *(pa.array(x, pa.int64()) for x in out)], [id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(df: DataFrame, path: str, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, end_id: int = END_ID, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Every row's text as pieces in sequences of at most window tokens.

    One row for each piece: id, start (the row's tokens before it), length, ids_crc32, doc_tokens, sequence_id, offset (in the
    sequence, gapless from 0). Null text is empty: one token, the end. Null ids are kept; rows with the same id
    are packed each for itself. Other columns are left out. path: of the tokenizer's file, on every machine.
    unit divides window. Empty table: no rows.
    """
    if window % unit:
        raise ValueError("unit must divide window")
    kind = df.schema[id].dataType.simpleString()
    schema = f"`{id}` {kind}, start long, length long, doc_tokens long, crc long, units binary, tail binary, c int, rank long, task int"
    pieces = written(df.select(id, text).mapInArrow(_cut(path, end_id, window, unit, id), schema), "pack-pieces")
    by_task = written(pieces.groupBy("task", "c").agg(F.sum(F.when(F.col("c") > 0, 1).otherwise(F.col("length"))).alias("n")), "pack-counts")
    counts = np.zeros(window // unit + 1, np.int64)
    for c, n in by_task.groupBy("c").agg(F.sum("n")).collect():  # a row for each length
        counts[c] = n
    plan = Plan(counts, counts[0], window, unit, depth)
    before = Window.partitionBy("c").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small(written(by_task.select("task", "c", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "pack-offsets"), MOST_COUNTS)
    ranked = pieces.join(offsets, ["task", "c"]).select(id, "start", "length", "doc_tokens", "crc", "units", "tail", "c", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_placed(plan, id), f"`{id}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op8_pack(spark, sf_dir):
    """All documents packed."""
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
