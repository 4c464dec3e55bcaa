"""Distributed union-find over a table of links.

Links are contracted batch by batch with a vectorised union-find, then large-star and small-star rounds
(Kiveris et al., 2014) join what is left until every node hangs directly on the least node of its component.
Stars need a minimum by key, combined before the shuffle, and a plain join, so that a hub with very many
links never meets in one task. Each round is a table in the shared folder: no growing lineage, nothing on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import dropped, written

SCHEMA = "hi long, lo long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a[i], b[i]) as (node, least node of its component), for nodes that aren't the least themselves."""
    ids, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = np.arange(len(ids))
    while True:
        rx, ry = root[x], root[y]
        open_ = rx != ry
        if not open_.any():
            break
        x, y, rx, ry = x[open_], y[open_], rx[open_], ry[open_]
        low = np.minimum(rx, ry)
        np.minimum.at(root, rx, low)
        np.minimum.at(root, ry, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    child = root != np.arange(len(ids))
    return ids[child], ids[root[child]]


def _contract(batches):
    for batch in batches:
        hi, lo = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        if len(hi):
            yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["hi", "lo"])


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("hi", "lo")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def connected(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> (node long, root long): the least node that each node reaches.

    Nodes that are the least of their component are left out, as are nodes without links. The result is a table of its own (common.dropped deletes it). Repeated links,
    links of a node to itself, and links either way round are fine; rows with a null are left out. No links: no rows.
    """
    a, b = (F.col(c).cast("long") for c in links.columns[:2])
    edges = links.select(a.alias("a"), b.alias("b")).where("a is not null and b is not null and a <> b")
    edges = written(edges.mapInArrow(_contract, SCHEMA).distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.union(edges.select("lo", "hi")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        star = joined.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least.select("hi", F.col("m").alias("lo"))).distinct()
        new = written(star, "small")
        dropped(edges, large)
        edges, was, state = new, state, _state(new)
        if state == was:
            out = edges.toDF("node", "root")
            out._webloom_path = edges._webloom_path
            return out
