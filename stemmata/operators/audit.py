"""Comparison of two editions of a dataset, and its summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.citations import APPLICATION, suspicious
from ..functions.similarity import seq_ratio


def compared(reference: DataFrame, local: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two editions of grouped diffs (keys, added, removed) with where a row stands and what differs."""
    sides = [df.select(*keys, *[F.coalesce(c, F.array().cast("array<string>")).alias(f"{c}_{s}") for c in ("added", "removed")], F.lit(True).alias(f"in_{s}")) for df, s in ((reference, "ref"), (local, "loc"))]
    both = sides[0].join(sides[1], keys, "full")
    equal = [F.array_sort(F.array_distinct(f"{c}_ref")) == F.array_sort(F.array_distinct(f"{c}_loc")) for c in ("added", "removed")]
    state = F.when(F.col("in_loc").isNull(), "reference_only").when(F.col("in_ref").isNull(), "local_only").when(equal[0] & equal[1], "exact").otherwise("changed")
    none = F.array().cast("array<string>")
    less = lambda a, b: F.array_sort(F.array_except(F.coalesce(a, none), F.coalesce(b, none)))
    return both.select(
        *keys, state.alias("state"),
        *[less(f"{c}_{a}", f"{c}_{b}").alias(f"{c}_only_{n}") for c in ("added", "removed") for a, b, n in (("ref", "loc", "reference"), ("loc", "ref", "local"))],
    )


def symmetric_difference(a: str, b: str):
    return F.array_union(F.array_except(a, b), F.array_except(b, a))


def similar_pairs(grouped: DataFrame, keys: list[str], least: float = 0.9) -> DataFrame:
    """Added and removed citations without application number that are all but equal, per diff. The equality of the
    diff carries the join; lengths that could not reach ``least`` are left out before similarities are worked out."""
    side = lambda c: grouped.select(*keys, F.explode(c).alias(c)).where(~F.col(c).rlike(APPLICATION))
    both = side("added").join(side("removed"), keys)
    a, b = F.length("added"), F.length("removed")
    near = both.where(2 * F.least(a, b) >= least * (a + b))
    scored = near.withColumn("score", seq_ratio(F.lower("added"), F.lower("removed")))
    return scored.where(F.col("score") >= least).withColumn("score", F.round("score", 3))


def summary(rows: DataFrame) -> DataFrame:
    """One row about flat changes (guide_id, change, citation): counts, guides, sides, suspicious rows."""
    return rows.agg(
        F.count("*").alias("rows"), F.count_distinct("guide_id").alias("guides"), F.count_if(F.col("change") == "added").alias("added"),
        F.count_if(F.col("change") == "removed").alias("removed"), F.count_if(F.size(suspicious("citation")) > 0).alias("suspicious"),
    )


def reasons(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(suspicious("citation")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def examples(rows: DataFrame, order: list[str], n: int = 25) -> DataFrame:
    """The first suspicious rows with their reasons."""
    return rows.withColumn("reasons", suspicious("citation")).where(F.size("reasons") > 0).orderBy(*order).limit(n)
