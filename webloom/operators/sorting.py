"""Global sort with each row's place in the order."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.sources.tables import shared_dir

_IN_PART = (1 << 33) - 1


def with_position(df: DataFrame, *keys: str, name: str = "position") -> DataFrame:
    """df sorted by keys (nulls first), with places from 1.

    Ranges of all keys, so that one frequent first key spreads over several, are sorted each for itself and written once to the shared folder,
    each row with its range and its place in that; the ranges' sizes then give the offsets. The table in the shared folder is the result's source.
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/webloom/sorted-{uuid.uuid4().hex}"
    s = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    s.write.option("compression", "lz4").parquet(path)
    return placed(spark.read.schema(s.schema).parquet(path), name)


def placed(s: DataFrame, name: str = "position") -> DataFrame:
    """Rows written in sorted ranges, with _id, the monotonically increasing id they had then -> the rows with their places from 1 instead. s is read twice."""
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(_IN_PART)
    sizes, before, total = sorted(s.groupBy(part.alias("part")).count().collect()), [], 0  # a row for each range
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = F.broadcast(s.sparkSession.createDataFrame(before, "_part long, _before long"))
    columns = [c for c in s.columns if c != "_id"]
    return s.withColumn("_part", part).join(offsets, "_part").select(*columns, (F.col("_before") + at + 1).alias(name))
