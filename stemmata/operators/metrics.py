"""Binary-classifier metrics, distributions and agreement, per group, without collecting scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unpivoted(df: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    """Long form (keys, model, score) of score columns."""
    return df.unpivot(keys, scores, "model", "score")


def _by_score(df: DataFrame, group: list[str]) -> DataFrame:
    """Positives and negatives at each distinct score: what cumulative sums then run over."""
    return df.groupBy(*group, "score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))


def auroc(df: DataFrame, group: list[str], *, ties: str = "midrank") -> DataFrame:
    """``df``: group columns, score, label. ``ties``: midrank, or optimistic (positives first among equal scores) or
    pessimistic. Null where a class is missing."""
    above = Window.partitionBy(*group).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    share = {"midrank": 0.5, "optimistic": 1.0, "pessimistic": 0.0}[ties]
    # Each negative at a score counts the positives above it, and a share of those at its own score.
    step = F.col("neg") * (F.coalesce(F.sum("pos").over(above), F.lit(0)) + share * F.col("pos"))
    summed = _by_score(df, group).withColumn("area", step).groupBy(*group).agg(
        F.sum("area").alias("area"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    return summed.select(*group, F.try_divide(F.col("area"), F.col("pos") * F.col("neg")).alias("auroc"), "pos", "neg")


def _rates(tp: Column, fp: Column, pos: Column) -> dict[str, Column]:
    precision, recall = (F.coalesce(F.try_divide(tp, x), F.lit(0.0)) for x in (tp + fp, pos))
    return {"precision": precision, "recall": recall, "f1": F.coalesce(F.try_divide(2 * tp, tp + fp + pos), F.lit(0.0))}


def best_f1(df: DataFrame, group: list[str]) -> DataFrame:
    """The lowest of the thresholds (score >= threshold is a positive) with the largest F1, and its metrics."""
    down = Window.partitionBy(*group).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    swept = _by_score(df, group).select(
        *group, "score", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(whole).alias("all_pos")
    )
    rated = swept.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("all_pos")))
    first = F.row_number().over(whole.orderBy(F.desc("f1"), F.asc("score")))
    return rated.withColumn("_n", first).where("_n = 1").select(*group, F.col("score").alias("threshold"), "f1", "precision", "recall")


def at_threshold(df: DataFrame, group: list[str], threshold: Column) -> DataFrame:
    """Confusion counts and rates at a threshold, a literal or a column that is constant within the group."""
    hit, true = F.col("score") >= threshold, F.col("label") == 1
    counted = df.groupBy(*group).agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn")
    )
    accuracy = F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return counted.withColumns(_rates(F.col("tp"), F.col("fp"), F.col("tp") + F.col("fn")) | {"accuracy": accuracy})


def transferred(df: DataFrame, group: list[str], chosen_on: Column, applied_to: Column) -> DataFrame:
    """Metrics of one part of the rows at the best threshold of another."""
    chosen = best_f1(df.where(chosen_on), group).select(*group, "threshold")
    target = df.where(applied_to)
    joined = target.join(chosen, group) if group else target.crossJoin(F.broadcast(chosen))  # one row
    return at_threshold(joined, [*group, "threshold"], F.col("threshold"))


def evaluation(df: DataFrame, models: list[str], splits: dict[str, Column], *, ties: str = "midrank") -> DataFrame:
    """AUROC and best F1 of every model over every split (which may overlap). ``df``: label and a column per model."""
    labels = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in splits.items()]))
    spread = df.select(F.explode(labels).alias("split"), "label", *models)
    long = unpivoted(spread, ["split", "label"], models)
    group = ["split", "model"]
    return auroc(long, group, ties=ties).join(best_f1(long, group), group).withColumn("threshold_source", F.lit("oracle"))


def normalised(df: DataFrame, c: str, name: str) -> DataFrame:
    """Adds ``c`` divided by its maximum over all rows (0 if that isn't positive)."""
    top = df.agg(F.max(c).alias("_top"))
    scaled = F.when(F.col("_top") > 0, F.col(c) / F.col("_top")).otherwise(0.0)
    return df.crossJoin(F.broadcast(top)).withColumn(name, scaled).drop("_top")  # one row


def upper_median(df: DataFrame, group: list[str], c: str, name: str = "median") -> DataFrame:
    """Per group the element at half the count in sorted order, counted from 0: of an even number the upper middle
    one. It runs over the distinct values' counts, so that frequent values cost one row each."""
    counts = df.where(F.col(c).isNotNull()).groupBy(*group, c).agg(F.count("*").alias("_n"))
    part = Window.partitionBy(*group)
    upto = F.sum("_n").over(part.orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = counts.select(*group, c, upto.alias("_upto"), F.sum("_n").over(part).alias("_all"))
    return placed.where(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*group).agg(F.min(c).alias(name))


def value_counts(df: DataFrame, *cs: str) -> DataFrame:
    """Rows per value, most frequent first, then by value."""
    return df.groupBy(*cs).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *cs)


def agreement(a: Column, b: Column) -> Column:
    return F.avg(a.eqNullSafe(b).cast("double"))


def means(df: DataFrame, by: list[str], values: list[str], *, said: str, places: int = 4) -> DataFrame:
    """Per group the number of rows whose text ``said`` isn't empty and the means of ``values`` over those among them
    that aren't null; 0 where all are."""
    rows = df.where(F.coalesce(F.col(said), F.lit("")) != "")
    found = [F.coalesce(F.round(F.avg(v), places), F.lit(0.0)).alias(v) for v in values]
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *found)


def base_rate(label: Column) -> Column:
    """Aggregate: the share of positive labels."""
    return F.avg(label.cast("double"))


def gold_in_corpus_rate(gold: Column, held: Column, places: int = 4) -> Column:
    """Aggregate: the share of rows of whose ``gold`` one at least is among those ``held``; null lists hold nothing."""
    return F.round(F.avg(F.coalesce(F.arrays_overlap(gold, held), F.lit(False)).cast("double")), places)


def total_length(*lists: Column) -> Column:
    """Aggregate: how many elements the lists of all rows have; null lists have none."""
    return F.sum(sum((F.coalesce(F.array_size(x), F.lit(0)) for x in lists), F.lit(0)))
