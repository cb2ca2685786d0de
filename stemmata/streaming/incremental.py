"""New rows against a growing table, by batch or by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def unseen(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the finished table lacks."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def run(source: DataFrame, target: str, keys: list[str], work: Callable[[DataFrame], DataFrame], checkpoint: str, schema: str) -> StreamingQuery:
    """Works off a stream until it is empty: each micro-batch's unseen keys go through ``work`` and are appended to the
    table at ``target``. A batch that is run again after a failure writes over its own part."""
    spark = source.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        done = existing(spark, target, schema, but=number)
        work(unseen(batch.dropDuplicates(keys), done, keys)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def existing(spark: SparkSession, target: str, schema: str, but: int | None = None) -> DataFrame:
    """The table at ``target``, empty if there is none; without the part of batch ``but``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(f"{schema}, batch int").parquet(target)
    return (found if but is None else found.where(f"batch <> {but}")).drop("batch")
