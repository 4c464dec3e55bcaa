"""What the operators share: written intermediate tables in the folder all executors see."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="webloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/webloom/{tag}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB at most where the session has Spark's default of 64 MB: long texts come in few rows at a time."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) == f"{64 << 20}b":
        spark.conf.set(name, "4m")


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Queries run inside free their shuffle files as they end; by default those stay until the driver's JVM collects what refers to them.

    Only for queries that are run once, as writes are: until the end lost files can be made again, and then nothing reads them.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and survives the loss of any executor. Its shuffle files go once it is complete."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    small_batches(spark)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._webloom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in tables:
        drop_path(df.sparkSession, df._webloom_path)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sliced(batches, rows: int = 256):
    """Arrow batches cut into runs of so many rows, so that what a text becomes in Python is held for a few texts at a time.

    A worker process lives on after its task, so Arrow's free memory goes back to the system at the end.
    """
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()


def small(df: DataFrame, rows: int, weight=None) -> DataFrame:
    """df with a broadcast hint if it was counted to have at most so many rows; else df as it is, for a shuffled join.

    weight: what a row counts for, where rows may be long.
    """
    n = df.agg(F.sum(weight)).first()[0] or 0 if weight is not None else df.count()
    return F.broadcast(df) if n <= rows else df


#: Keys of more rows than this are split where spread() knows how many each has.
MANY = 10_000


def spread(left: DataFrame, right: DataFrame, key: str, by: str | tuple, rows: int, how: str = "inner", also=None, parts: int = 16, many: str | None = None) -> DataFrame:
    """left joined with right on key, where very many rows of left may share one: right is broadcast if it was counted to have at most so many rows,
    else each key is split in parts by a hash of left's column (or columns) by, and right's rows are there for each part. also: a further condition.

    many: right's column of how many rows of left have its key. Only keys of more than MANY are split then, each in as many parts as it needs.
    """
    other = right.withColumnRenamed(key, "_key")
    if right.count() <= rows:
        on = F.col(key) == F.col("_key")
        return left.join(F.broadcast(other), on if also is None else on & also, how).drop("_key")
    by = (by,) if isinstance(by, str) else by
    if many is None:
        left = left.withColumn("_part", F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int"))
        other = other.withColumn("_of", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    else:
        split = right.where(F.col(many) > MANY).select(F.col(key).alias("_split"), F.ceil(F.col(many) / MANY).cast("int").alias("_parts"))
        if not split.take(1):
            return left.join(other, F.col(key) == F.col("_key") if also is None else (F.col(key) == F.col("_key")) & also, how).drop("_key")
        left = left.join(small(split, rows), F.col(key) == F.col("_split"), "left")
        left = left.withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int"), F.lit(0))).drop("_split", "_parts")
        copies = F.when(F.col(many) > MANY, F.ceil(F.col(many) / MANY).cast("int")).otherwise(F.lit(1))
        other = other.withColumn("_of", F.explode(F.sequence(F.lit(0), copies - 1)))
    on = (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_of"))
    return left.join(other, on if also is None else on & also, how).drop("_key", "_part", "_of")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def string_of(name: str):
    """A text column with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))
