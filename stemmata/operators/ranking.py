"""Rankings and rank metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, group: list[str], *order: Column, top: int | None = None, name: str = "rank") -> DataFrame:
    """Numbers the rows of each group from 1; with ``top`` the rest go (Spark limits each group before the shuffle)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return out if top is None else out.where(F.col(name) <= top)


def by_score(scored: DataFrame, *, top: int | None = None, tie: str = "doc") -> DataFrame:
    """Rank by score, ties in the order of ``tie``."""
    return ranked(scored, ["query", "corpus"], F.desc("score"), F.asc(tie), top=top)


def shuffled(candidates: DataFrame, group: list[str], seed: int | Column = 42, key: str = "doc") -> DataFrame:
    """A pseudorandom ranking that reruns repeat: by the digest of key, group and seed."""
    seed = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return ranked(candidates, group, F.md5(F.concat_ws("|", *group, key, seed)), F.asc(key))


def hits(rows: DataFrame, group: list[str], gold: Column, cuts: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """Per group: reciprocal rank of the first gold row (0 if none) and whether one is within each cut. ``gold`` is a
    condition on the ranked rows."""
    first = F.min(F.when(gold, F.col("rank")))
    found = rows.groupBy(*group).agg(first.alias("_first"))
    at = {f"hit{k}": F.coalesce((F.col("_first") <= k).cast("int"), F.lit(0)) for k in cuts}
    return found.withColumns(at | {"rr": F.coalesce(1 / F.col("_first"), F.lit(0.0))}).drop("_first")


def boosted(scored: DataFrame, *features: str, group: tuple[str, ...] = ("query", "corpus"), tie: str = "doc", top: int | None = None) -> DataFrame:
    """Lexicographic ranking: features descending, then score, then ``tie``."""
    return ranked(scored, list(group), *[F.desc(f) for f in features], F.desc("score"), F.asc(tie), top=top)


def within(scored: DataFrame, groups: DataFrame, *, on: list[str], keep: int | None = None, group_rank: str = "group_rank", group: tuple[str, ...] = ("query", "corpus"), tie: str = "doc", top: int | None = None) -> DataFrame:
    """Ranking by the rank of a row's group, then score. With ``keep`` only the leading groups stay (two-stage ranking);
    without, rows of unranked groups come last."""
    if keep is not None:
        joined = scored.join(groups.where(F.col(group_rank) <= keep), on)
    else:
        joined = scored.join(groups, on, "left")
    return ranked(joined, list(group), F.col(group_rank).asc_nulls_last(), F.desc("score"), F.asc(tie), top=top)


def only(scored: DataFrame, gold: DataFrame, on: list[str], tie: str = "doc") -> DataFrame:
    """Ranking of the rows in gold groups alone: a ceiling for two-stage ranking."""
    return by_score(scored.join(gold.select(*on).distinct(), on, "left_semi"), tie=tie)


def sliced(rows: DataFrame, slices: dict[str, Column], metrics: list[str], places: int = 4) -> DataFrame:
    """Means of metrics over slices that may overlap: one pass over rows that each belong to several slices. Every
    slice is reported; an empty one has n 0 and null means."""
    labels = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in slices.items()]))
    spread = rows.select(F.explode(labels).alias("slice"), *metrics)
    means = [F.round(F.avg(m), places).alias(m) for m in metrics]
    found = spread.groupBy("slice").agg(F.count("*").alias("n"), *means)
    names = rows.sparkSession.createDataFrame([(k,) for k in slices], "slice string")
    return names.join(found, "slice", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
