"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Distinct fingerprints are compared in tiles of TILE by numpy exclusive-or and bit counts. A group of them is sorted by the number of set
bits and cut into tiles; pairs of tiles whose bit counts differ by more than the radius are skipped. So that the work
grows with the input and not with its square, the fingerprints are first dealt out into groups of about GROUP: two within the radius r
agree on m of any r + m slices of their bits, so each goes into a group for every choice of m slices, told by as many bits of
them as make groups of that size; that loses no pair. A task yields a spanning forest of the links it finds, never all
pairs, and union-find joins the forests.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import sliced, small, written
from webloom.llm.components import connected, forest

SEED = 42
#: Fingerprints of a tile, of a group, and of a group from which it is spread over several tasks.
TILE, GROUP, LARGE = 256, 2048, 8192


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text: A-Z lower-cased, words between ASCII white space, shingles of so many words.

    Fewer words: the whole sequence is the one shingle; none (null, empty, blank): zero.
    A bit is set if it is set in over half the shingles' hashes; repeated shingles count each time.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(join(w), seed)
    total, n = np.zeros(64, np.int64), len(w) - words + 1
    for at in range(0, n, 1 << 16):  # a very long text in parts, for bounded memory
        part = w[at : min(at + (1 << 16), n) + words - 1]
        shingles = map(join, zip(*(part[i:] for i in range(words)), strict=False))
        h = np.fromiter((digest(s, seed) for s in shingles), np.uint64, len(part) - words + 1)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", id: str = "doc_id", words: int = 3) -> DataFrame:
    """(id, fp long) of every row, the fingerprint as a signed 64-bit number."""

    def run(batches):
        for batch in sliced(batches):
            fps = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [id, "fp"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(id, text).mapInArrow(run, f"`{id}` {kind}, fp long")


def tile_pairs(pops: np.ndarray, radius: int, tile: int = TILE):
    """(start of a tile, start of another or the same, whether they must be compared) for bit counts in ascending order."""
    for i in range(0, len(pops), tile):
        most = pops[min(i + tile, len(pops)) - 1] + radius
        for k in range(i, len(pops), tile):
            yield i, k, bool(pops[k] <= most)


def compared(fp: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among a group's fingerprints (unsigned), tile against tile."""
    pops = np.bitwise_count(fp)
    order = np.lexsort((fp, pops))
    fp, pops = fp[order], pops[order].astype(np.int64)
    found = [(np.empty(0, np.int64),) * 2]
    for i, k, near in tile_pairs(pops, radius, tile):
        if near:
            x, y = np.nonzero(np.bitwise_count(fp[i : i + tile, None] ^ fp[None, k : k + tile]) <= radius)
            off = i + x < k + y  # not with itself, nor twice
            found.append((fp[i + x[off]].view(np.int64), fp[k + y[off]].view(np.int64)))
            if sum(len(a) for a, _ in found) > 1 << 20:
                found = [forest(*(np.concatenate(z) for z in zip(*found, strict=True)))]
    return forest(*(np.concatenate(z) for z in zip(*found, strict=True)))


def _compared(radius: int, tile: int):
    """Rows (g, fp) sorted by g -> links found within each g."""

    def one(g, fp):
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        found = [compared(x, radius, tile) for x in np.split(fp.view(np.uint64), starts[1:])]
        return forest(*(np.concatenate(z) for z in zip(*found, strict=True)))

    def run(batches):
        held = []  # parts of the last group so far
        for last, batch in _with_last(batches):
            if batch is not None:
                g, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                if not len(g):
                    continue
                if held and held[0][0][0] == g[-1]:
                    held.append((g, fp))
                    continue
                cut = int(np.searchsorted(g, g[-1]))  # the last group may go on
                whole, held = [*held, (g[:cut], fp[:cut])], [(g[cut:], fp[cut:])]
            else:
                whole = held
            if whole and sum(len(g) for g, _ in whole):
                hi, lo = one(*(np.concatenate(z) for z in zip(*whole, strict=True)))
                if len(hi):
                    yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["a", "b"])

    return run


def _with_last(batches):
    """(False, each batch), then (True, None)."""
    for b in batches:
        yield False, b
    yield True, None


def masks(n: int, radius: int, group: int = GROUP) -> list[int]:
    """The bits on which a fingerprint is dealt out, for each choice of slices: as many as make groups of about group out of n. Two fingerprints within the radius agree on all bits of one mask at least."""
    need = max(0, math.ceil(math.log2(max(1, n) / group)))
    if not need:
        return [0]
    agree = next((m for m in range(1, 4) if m * (64 // (radius + m)) >= need), 3)
    width, out = 64 // (radius + agree), []
    bits = min(width, -(-need // agree))
    for slices in combinations(range(radius + agree), agree):
        out.append(sum(((1 << bits) - 1) << (j * width) for j in slices))
    return out


def grouped(fps: DataFrame, radius: int = 3, group: int = GROUP, large: int = LARGE) -> DataFrame:
    """Distinct fingerprints (fp long) -> (g, fp): any two within the radius of each other share a g. A group of over large is cut by bit counts and a
    hash, and each pair of parts whose bit counts are within the radius is a g of its own."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(fps.count(), radius, group)]
    keys = F.array(*(F.xxhash64(F.lit(j), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for j, m in enumerate(signed)))
    rows = fps.select("fp", F.explode(keys).alias("key"))
    parts = rows.groupBy("key", F.bit_count("fp").alias("pop")).count()
    parts = parts.groupBy("key").agg(F.sum("count").alias("n"), F.collect_list(F.struct("pop", F.ceil(F.col("count") / large).cast("int").alias("k"))).alias("parts")).where(F.col("n") > large)  # at most 65 bit counts a key
    pop = F.bit_count("fp")
    near = F.filter("parts", lambda t: F.abs(t["pop"] - pop) <= radius)
    own = F.struct(pop.alias("pop"), F.pmod(F.xxhash64("fp", F.lit(7)), F.element_at(F.filter("parts", lambda t: t["pop"] == pop), 1)["k"]).cast("int").alias("t"))
    others = F.flatten(F.transform(near, lambda t: F.transform(F.sequence(F.lit(0), t["k"] - 1), lambda i: F.struct(t["pop"].alias("pop"), i.alias("t")))))
    pairs = F.transform(others, lambda o: F.xxhash64("key", F.least(o, own), F.greatest(o, own)))
    return rows.join(parts.drop("n"), "key", "left").select(F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(pairs)).alias("g"), "fp")


def links(fps: DataFrame, radius: int = 3, group: int = GROUP, large: int = LARGE, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (a, b) that connect all of them at so many differing bits or fewer."""
    return grouped(fps, radius, group, large).repartition("g").sortWithinPartitions("g").mapInArrow(_compared(radius, tile), "a long, b long")


def near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", words: int = 3, radius: int = 3) -> DataFrame:
    """Every row's (id, fp long, component): component is the least id that links of so many bits or fewer reach.

    Null, empty and blank texts share the fingerprint zero and are linked like any other. A null id is kept but never is
    a component's id unless the component has no other (then null). Repeated rows come back as often. Empty table: no rows.
    """
    rows = written(fingerprints(df, text, id, words), "simhash")
    fps = written(rows.groupBy("fp").agg(F.min(id).alias("least")), "simhash-distinct")
    roots = connected(links(fps.select("fp"), radius))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    linked = roots.select("root").distinct()
    least = named.join(linked, "root", "left_semi").groupBy("root").agg(F.min("least").alias("of_root"))
    named = named.join(least, "root", "left").select("fp", F.coalesce("of_root", "least").alias("component"))
    return rows.join(named, "fp").select(id, "fp", "component")


def one_of_each(df: DataFrame, text: str = "text", id: str = "doc_id", words: int = 3, radius: int = 3, most: int = 1_000_000) -> DataFrame:
    """The rows of df, all columns: one for each group of near-duplicates, the one with the least id, then the least hash of its text.

    Rows with the same id but other texts are told apart; of repeated rows one stays. A null id is the least.
    most: broadcast the keys of the rows that go up to this number, else join them through a shuffle.
    """
    key = lambda c, t: F.struct(c.alias("id"), F.xxhash64(t).alias("th"))
    found = written(near_duplicates(df.select(key(F.col(id), F.col(text)).alias("key"), F.col(text).alias("text")), "text", "key", words, radius), "simhash-found")
    gone = small(written(found.where(~F.col("key").eqNullSafe(F.col("component"))).select("key").distinct(), "simhash-gone"), most)
    again = written(found.where(F.col("key").eqNullSafe(F.col("component"))).groupBy("key").count().where("count > 1").select("key"), "simhash-again")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")).withColumn("key", key(F.col(f"row.`{id}`"), F.col(f"row.`{text}`")))
    kept = rows.join(gone, rows.key.eqNullSafe(gone.key), "left_anti")
    if again.take(1):
        many = small(again, most)
        kept = kept.join(many, kept.key.eqNullSafe(many.key), "left_anti").union(kept.join(many, kept.key.eqNullSafe(many.key), "left_semi").dropDuplicates(["key"]))
    return kept.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns))


def op3_simhash(spark, sf_dir):
    """Every document with its fingerprint and component (see near_duplicates)."""
    from webloom.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
