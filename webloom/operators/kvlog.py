"""Append-only key/value log: a later entry of a key replaces earlier ones; a deleted entry removes the key until it comes again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compacted(log: DataFrame, key: str = "key", seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """The last entry of each key, if it isn't a deletion; all columns but deleted. One shuffle, combined before it."""
    rest = [c for c in log.columns if c not in (key, deleted)]
    last = log.groupBy(key).agg(F.max_by(F.struct(deleted, *rest), seq).alias("e"))
    return last.where(~F.col(f"e.{deleted}")).select(key, *(F.col(f"e.{c}").alias(c) for c in rest))


def lookup(table: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """Entries of the given keys."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def random_entry(table: DataFrame, seed: int = 0, key: str = "key") -> DataFrame:
    """One entry, uniform over keys for a random seed."""
    return table.orderBy(F.xxhash64(F.lit(seed), key), key).limit(1)


def statistics(log: DataFrame, key: str = "key", seq: str = "seq", deleted: str = "deleted") -> DataFrame:
    """One row: entries, deletions, live keys, next sequence number."""
    live = compacted(log, key, seq, deleted).agg(F.count("*").alias("live"))
    return log.agg(F.count("*").alias("entries"), F.count_if(deleted).alias("deletions"), (F.max(seq) + 1).alias("next_seq")).crossJoin(live)
