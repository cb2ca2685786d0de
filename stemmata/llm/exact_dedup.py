"""Exact dedup by skew-safe combining (operator 7, DataFrame functions only).

Equal texts meet in three steps, each of which compares whole contents and not only digests: the map-side half of
the aggregation merges copies inside a task, hot digest groups are then merged under a salt, and the winners of the
salts are combined. Only then do the rows look up their group; where one digest covers several contents, which the
combining step would show, they are looked up by content instead.

Null texts count as empty, and empty texts form one group. Of equal texts the row with the most code points in its
original text stays, then the smallest doc_id, null ids last; of rows that repeat id and text exactly one stays.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, lookup, materialise, text_or_empty

SPACES = " \t\n\x0b\x0c\r"


def without_spaces(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _rank(length: Column, doc_id: Column) -> Column:
    """Larger is better: more code points, then the smaller id; fits a 38-digit decimal."""
    tail = F.coalesce(F.lit(Decimal(10**19)) - doc_id.cast("decimal(20,0)"), F.lit(Decimal(0)))
    return (length.cast("decimal(12,0)") * F.lit(Decimal(10**20)) + tail).cast("decimal(38,0)")


def exact_groups(docs: DataFrame, *, digest_chars: int = 64, salts: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest_chars`` shortens the digest that rows are dealt by (tests force collisions so); ``salts`` is the number
    of salts that share a hot digest. Empty input gives no rows."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        without_spaces(text_or_empty()).alias("content"),
        F.length(text_or_empty()).alias("n"),
    ).withColumn("sha", F.sha2("content", 256)).withColumn("digest", F.substring("sha", 1, digest_chars))
    narrow = materialise(
        rows.select("doc_id", "sha", "digest", _rank(F.col("n"), F.col("doc_id")).alias("rank"), F.monotonically_increasing_id().alias("row_key")),
        "digests",
    )
    total = narrow.count()
    by_digest = narrow.groupBy("digest").agg(F.count("*").alias("rows"), F.max_by("row_key", "rank").alias("keep_key"))
    is_hot = (F.col("rows") > 1) & (F.col("rows") * HOT_SHARE >= total)
    hot = materialise(by_digest.where(is_hot).select("digest").repartition(1), "hot")  # HOT_SHARE rows at most: one file

    # Salts are dealt by the row, since rows may repeat an id; which row gets which decides nothing.
    whole = rows.withColumn("rank", _rank(F.col("n"), F.col("doc_id"))).withColumn("row_number", F.monotonically_increasing_id())
    best = [F.max_by("doc_id", "rank").alias("keep_id"), F.max("rank").alias("rank"), F.count("*").alias("group_size")]
    cold = whole.join(F.broadcast(hot), "digest", "left_anti").groupBy("digest", "content").agg(*best)
    salted = (
        whole.join(F.broadcast(hot), "digest")
        .withColumn("salt", F.pmod("row_number", F.lit(salts)))
        .groupBy("digest", "salt", "content")
        .agg(*best)
    )
    combined = salted.groupBy("digest", "content").agg(
        F.max_by("keep_id", "rank").alias("keep_id"), F.max("rank").alias("rank"), F.sum("group_size").alias("group_size")
    )
    winners = materialise(cold.unionByName(combined).select("digest", "keep_id", "group_size"), "winners")
    contents = winners.groupBy("digest").agg(F.count("*").alias("contents")).where("contents > 1")
    out = ["doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256")]
    clash = not contents.isEmpty()
    collided = materialise(contents.select("digest"), "collided") if clash else None
    plain = winners.join(collided, "digest", "left_anti") if clash else winners
    single = plain.join(by_digest.select("digest", "keep_key"), "digest").withColumnRenamed("group_size", "size")
    found = (
        lookup(narrow, single, "digest", "size", total)
        .withColumn("group_size", F.col("size"))
        .withColumn("kept", F.col("row_key") == F.col("keep_key"))
        .select(*out)
    )
    if not clash:
        return found
    mixed = whole.join(collided, "digest").withColumn("row_key", F.monotonically_increasing_id())
    mixed = materialise(mixed, "collided-rows")
    by_content = mixed.groupBy("digest", "content").agg(*best, F.max_by("row_key", "rank").alias("keep_key")).drop("rank")
    again = mixed.drop("rank").join(by_content, ["digest", "content"]).withColumn("kept", F.col("row_key") == F.col("keep_key"))
    return found.unionByName(again.select(*out))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_groups(docs, **options).where("kept").select("doc_id", F.col("text_sha256").alias("sha")).distinct()
    rows = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own_id"), F.sha2(without_spaces(text_or_empty()), 256).alias("own_sha")
    )
    joined = rows.join(kept, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_sha") == F.col("sha")))
    return one_of_each(joined, ["own_id", "own_sha"]).select("row.*")


def one_of_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One of the rows (``row``: a struct) for each value of ``keys``, the first by its hash."""
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("row"))
    return rows.withColumn("number", F.row_number().over(order)).where("number = 1")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content FROM documents),
g AS (
  SELECT doc_id, content, first_value(doc_id) OVER (PARTITION BY content ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM g
"""
