"""Helpers that several corpus operators share: scratch tables, skew-safe look-ups, distributed positions."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce, wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with at least a 1/HOT_SHARE share of all rows is hot; by counting there are at most HOT_SHARE such keys.
HOT_SHARE = 1000
#: Expected rows in one bucket of a two-level ordering.
BUCKET_ROWS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; in local mode a folder of our own if unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="stemmata-")
        spark.sparkContext.setCheckpointDir(found)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/stemmata-{label}-{uuid.uuid4().hex}"


#: Shuffle files of a write go when it is done, not when the driver's memory happens to be collected.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The tables written since each ``scratch`` that is open began.
_open: list[list[str]] = []


def materialise(df: DataFrame, label: str, *, lasting: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut and a lost executor loses nothing. Inside
    ``scratch`` the table goes when that ends, or with the one around it if the table is ``lasting``."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    if len(_open) > lasting:
        _open[-1 - lasting].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside are deleted at the end; what is used afterwards has to be ``lasting``."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            drop_scratch(spark, path)


#: Spark hands rows to Python by number unless bytes are bounded too; rows that hold whole sets can be long.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """What is planned inside hands Python batches of ``size`` at most, or single rows that are longer."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, size)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_BYTES) if before is None else spark.conf.set(BATCH_BYTES, before)


def hand_back() -> None:
    """Gives memory that this process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_python(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` whose tasks hand memory back when they end: workers live on beside the executor's own memory, and
    keep what their largest task took otherwise."""

    @wraps(run)
    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return df.mapInPandas(whole, schema)


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Deletes one scratch table whose readers have all been written out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lookup(big: DataFrame, small: DataFrame, key: str | list[str], weight: str, total: int) -> DataFrame:
    """Inner join of ``big`` with ``small``, which has one row per key and in ``weight`` the number of rows of
    ``big`` with it. Keys with ``weight * HOT_SHARE >= total`` number HOT_SHARE at most, so broadcasting them is
    bounded; every other key holds under 1/HOT_SHARE of the rows, so the shuffle join beyond it has no skew."""
    is_hot = F.col(weight) * HOT_SHARE >= total
    hot, cold = small.where(is_hot), small.where(~is_hot)
    return big.join(F.broadcast(hot), key).unionByName(
        big.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    )


def bucket_count(rows: int, per_bucket: int = BUCKET_ROWS) -> int:
    return max(1, -(-rows // per_bucket))


def running_start(df: DataFrame, group: list[str], bucket: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before this one in the order (group; bucket, order).
    Two levels keep every window small: a running sum in each (group, bucket), and one over the bucket totals."""
    keys = group + bucket
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    valued = df.withColumn("_v", value.cast("long"))
    totals = valued.groupBy(*keys).agg(F.sum("_v").alias("_sum"))
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    kept = reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys))
    local = valued.withColumn("_local", F.sum("_v").over(within) - F.col("_v"))
    joined = local.alias("l").join(offsets.alias("r"), kept)
    return joined.select("l.*", (F.col("l._local") + F.col("r._offset")).alias(name)).drop("_v", "_local")


def ranked(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """Adds ``name``, from 1 in ``order``, without a window over all rows: a global sort numbers the rows of each of
    its partitions, and the partitions before a row are counted."""
    held = materialise(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    parts = held.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    placed = held.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(offsets), "_part")  # a row a partition
    rank = F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn(name, rank.cast("long")).drop("_at", "_part", "_offset")


def in_range(df: DataFrame, position: str, ranges: DataFrame, number: int, total: int) -> DataFrame:
    """Inner join of ``df`` with the one of ``number`` disjoint ``ranges`` (start, length, ...) of 0..total-1 that
    ``position`` falls in. The places are cut into cells, which are the equality, and a cell lists only the ranges
    that reach into it."""
    cell = max(1, -(-total // max(1024, 8 * number)))
    reach = ranges.where("length > 0").withColumn("_cell", F.explode(F.expr(f"sequence(start div {cell}, (start + length - 1) div {cell})")))
    placed = df.withColumn("_cell", F.expr(f"{position} div {cell}")).join(reach, "_cell")
    return placed.where(F.col(position).between(F.col("start"), F.col("start") + F.col("length") - 1)).drop("_cell")
