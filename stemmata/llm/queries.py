"""The corpus operators as queries over the tables in a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, licenses, mixing, packing, quality, quartile_digest, sharding, simhash_dedup, token_rollups, warc
from .common import materialise, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))[0]


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents come in under one tokenizer; those not in English move to one for many
    languages; documents labelled toxic are taken down; and the first batch comes again, to no effect."""
    import public_tokenizers

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    loaded = materialise(token_rollups.counted(docs, "byte_bpe_50k", ranks_path()), "counts")
    foreign = docs.where(~F.col("lang").eqNullSafe("en"))
    moved = token_rollups.counted(foreign, "byte_bpe_multi_50k", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    moved = materialise(moved, "counts")
    nothing = F.lit(None).cast(loaded.schema["image"].dataType)
    before = loaded.where(~F.col("image.lang").eqNullSafe("en"))
    revised = before.select(F.col("image").alias("before"), nothing.alias("after")).unionByName(
        moved.select(nothing.alias("before"), F.col("image").alias("after"))
    )
    now = loaded.where(F.col("image.lang").eqNullSafe("en")).unionByName(moved)
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    taken_down = now.join(toxic, "doc_id", "left_semi").select(F.col("image").alias("before"), nothing.alias("after"))
    load = loaded.select(nothing.alias("before"), F.col("image").alias("after"))
    rollup = token_rollups.Rollup(spark, scratch_path(spark, "rollup"))
    for batch, changes in (("load", load), ("many languages", revised), ("takedown", taken_down), ("load", load)):
        rollup.commit(batch, changes)
    return rollup.totals()


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quartile_digest.fingerprints(_table(spark, sf_dir, "documents"))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.simhash_components(_table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(_table(spark, sf_dir, "documents"), ranks_path())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_mixing, op3_licenses, op4_token_counts, op5_quality, op6_sharding, op7_exact_dedup, op8_fingerprints, op9_simhash_dedup, op10_packing)
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op3_licenses": licenses.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
}
