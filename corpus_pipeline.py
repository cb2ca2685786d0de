"""The corpus pipeline: documents pass the stages one after the other, each written and read again.

Empty tables pass as empty tables; nulls, repeats and ties are treated as the operators' modules state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stemmata.llm import exact_dedup, mixing, packing, quality, simhash_near
from stemmata.llm.common import materialise
from stemmata.llm.queries import ranks_path


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it learns from the labels of the documents that came in."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one stays."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity of 0.8 or more) one stays: SimHash fingerprints
    by multi-index hashing, an exact check on the shingles, and an exact way for links that fingerprints don't show."""
    return simhash_near.one_of_each_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix of sources takes them, from not at all to three times."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1,024."""
    return packing.packed_documents(docs, ranks_path())


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources", mix),
    ("packing", pack),
]

#: SQL expresses neither the classifier nor the packing; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the table of documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
