"""Negatives by time window, and samples by stratum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FETCHED, KEPT = 200, 30


def in_windows(events: DataFrame, windows: DataFrame, at: str = "at", days: int = 64) -> DataFrame:
    """Interval join: each event with the windows (from_date, to_date, both days included) that it falls in. Both sides
    are cut into cells of ``days`` days, so the join has an equality to shuffle on: an event lies in one cell, a window
    reaches over a few."""
    cell = lambda d: F.floor(F.date_diff(d, F.lit("1970-01-01").cast("date")) / days)
    start, stop = F.col("from_date").cast("date"), F.col("to_date").cast("date")
    reach = windows.withColumn("_cell", F.explode(F.sequence(cell(start), cell(stop))))
    placed = events.withColumn("_cell", cell(F.col(at).cast("date")))
    day = F.col(at).cast("date")
    return placed.join(reach, "_cell").where((day >= start) & (day <= stop)).drop("_cell")


def negatives(candidates: DataFrame, transitions: DataFrame, positives: DataFrame, *, at: str = "at", keys: str = "apps",
              fetched: int | None = FETCHED, kept: int = KEPT) -> DataFrame:
    """For each transition (id, from_date, to_date) the newest ``kept`` candidates in its window that share no key with
    its positives (id, key). Windows that several transitions share are searched once; of each window the newest
    ``fetched`` candidates count. ``candidates``: item, ``at``, ``keys`` (array)."""
    windows = transitions.select("from_date", "to_date").distinct()
    found = in_windows(candidates, windows, at)
    newest = Window.partitionBy("from_date", "to_date").orderBy(F.desc(at), F.asc("item"))
    if fetched is not None:
        found = found.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= fetched).drop("_n")
    offered = transitions.join(found, ["from_date", "to_date"]).where(F.size(keys) > 0)
    taken = offered.select("id", "item", F.explode(keys).alias("key")).join(
        positives.select("id", F.lower("key").alias("_key")).distinct(), ["id"], "inner"
    ).where(F.lower("key") == F.col("_key")).select("id", "item").distinct()
    order = Window.partitionBy("id").orderBy(F.desc(at), F.asc("item"))
    free = offered.join(taken, ["id", "item"], "left_anti")
    return free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)


def mining_stats(mined: DataFrame, transitions: DataFrame, positives: DataFrame) -> DataFrame:
    got = mined.groupBy("id").agg(F.count("*").alias("negatives"))
    known = positives.groupBy("id").agg(F.count_distinct(F.lower("key")).alias("positive_keys"))
    out = transitions.select("id").distinct().join(got, "id", "left").join(known, "id", "left")
    return out.na.fill(0, ["negatives", "positive_keys"])


def _drawn(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def round_robin(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, taken from the strata in turn: the first of each, then the second of each, and so on, in an order that
    the digest of key and seed shuffles."""
    turn = F.row_number().over(Window.partitionBy(*strata).orderBy(_drawn(F.col(key), seed), key))
    name = F.concat_ws("|", *[F.col(s).cast("string") for s in strata])
    return df.withColumn("turn", turn).orderBy("turn", _drawn(name, seed), name).limit(n)


def stratified(df: DataFrame, strata: list[str], key: str, n: int, *, first: Column | None = None, floor: int = 10, least: int = 5, seed: int = 42) -> DataFrame:
    """``n`` rows at most: ``floor`` rows that meet ``first``, then from each stratum the larger of ``least`` and its
    share of ``n``, in shuffled order without repeats."""
    drawn = _drawn(F.col(key), seed)
    head = df.where(first).orderBy(drawn, key).limit(floor) if first is not None else df.limit(0)
    rest = df.join(head.select(key), key, "left_anti")
    total = rest.agg(F.count("*").alias("_all"))
    sizes = rest.groupBy(*strata).agg(F.count("*").alias("_size")).crossJoin(F.broadcast(total))  # one row
    budget = sizes.withColumn("_budget", F.greatest(F.lit(least), F.round(n * F.col("_size") / F.col("_all")).cast("int"))).drop("_size", "_all")
    placed = rest.withColumn("_n", F.row_number().over(Window.partitionBy(*strata).orderBy(drawn, key))).join(budget, strata)
    body = placed.where(F.col("_n") <= F.col("_budget")).drop("_n", "_budget")
    tagged = head.withColumn("_part", F.lit(0)).unionByName(body.withColumn("_part", F.lit(1)))
    return tagged.orderBy("_part", drawn, key).limit(n).drop("_part")


def random_scores(df: DataFrame, key: str, seed: int = 42, name: str = "score") -> DataFrame:
    """A pseudorandom score from 0 to 1 that depends on key and seed alone."""
    digits = F.substring(_drawn(F.col(key), seed), 1, 12)
    return df.withColumn(name, F.conv(digits, 16, 10).cast("double") / float(16**12))
