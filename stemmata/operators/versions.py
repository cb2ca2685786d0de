"""Snapshots of citation lists: diffs between versions, the moving baseline, list parsing, transitions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import APPLICATION, application_key, last_year, simple_case_name
from ..functions.similarity import ratio
from ..functions.text import folded, match_form


def consecutive(snapshots: DataFrame, group: str = "guide_id", order: str = "timestamp") -> DataFrame:
    """(group, from, to) of successive snapshots, unchanged ones included."""
    before = F.lag(order).over(Window.partitionBy(group).orderBy(order))
    return snapshots.select(group, order).distinct().select(group, before.alias("from_version"), F.col(order).alias("to_version")).where("from_version is not null")


def sticky_pairs(snapshots: DataFrame, group: str = "guide_id", order: str = "timestamp", content: str = "content") -> DataFrame:
    """(group, from, to) where the baseline moves on only when something has changed: a snapshot equal to its
    predecessor (``content``: a digest of its list; null if unreadable) is skipped, so the older one stays the base."""
    readable = snapshots.where(F.col(content).isNotNull())
    w = Window.partitionBy(group).orderBy(order)
    changed = readable.withColumn("_before", F.lag(content).over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col(content)))
    return changed.select(group, F.lag(order).over(w).alias("from_version"), F.col(order).alias("to_version")).where("from_version is not null")


def key_difference(base: DataFrame, current: DataFrame, keys: list[str], side: str = "change") -> DataFrame:
    """Rows of ``current`` without counterpart in ``base`` as added, and the reverse as removed."""
    return current.join(base, keys, "left_anti").withColumn(side, F.lit("added")).unionByName(
        base.join(current, keys, "left_anti").withColumn(side, F.lit("removed"))
    )


def _greedy(base: pd.DataFrame, current: pd.DataFrame, least: float) -> pd.DataFrame:
    """Pairs each base row in order with the first current row still free that means the same case."""
    free, out = list(range(len(current))), []
    for row in base.sort_values("pos").itertuples():
        for k in free:
            other = current.iloc[k]
            if not row.name or not other["name"] or (row.year and other["year"] and row.year != other["year"]):
                continue
            if row.name == other["name"] or ratio(row.name, other["name"]) >= least:
                free.remove(k)
                break
        else:
            out.append((row.pair, "removed", row.citation))
    out += [(current.iloc[k]["pair"], "added", current.iloc[k]["citation"]) for k in free]
    return pd.DataFrame(out, columns=["pair", "change", "citation"])


def snapshot_diff(base: DataFrame, current: DataFrame, *, least: float = 0.93, compat_year: bool = False) -> DataFrame:
    """``base`` and ``current``: pair, pos, citation (the lists of either side of each pair of versions). Citations with
    application numbers are compared by key (of equal keys the last counts), the others by a greedy one-to-one match
    in list order; a pair's unmatched citations without number are the only rows that go to Python. Returns (pair,
    change, citation)."""
    schema = "pair string, change string, citation string"

    def keyed(df: DataFrame) -> DataFrame:
        k = df.select(F.col("pair").cast("string").alias("pair"), "pos", "citation", application_key("citation").alias("key")).where("key is not null")
        return k.groupBy("pair", "key").agg(F.max_by("citation", "pos").alias("citation"))

    def named(df: DataFrame) -> DataFrame:
        n = df.where(~F.col("citation").rlike(APPLICATION))
        return n.select(
            F.col("pair").cast("string").alias("pair"), "pos", "citation",
            match_form(simple_case_name("citation")).alias("name"), last_year("citation", compat=compat_year).alias("year"),
        )

    def match(left: Iterable, right: Iterable) -> pd.DataFrame:
        b, c = left, right.sort_values("pos").reset_index(drop=True)
        return _greedy(b, c, least)

    exact = key_difference(keyed(base), keyed(current), ["pair", "key"]).select("pair", "change", "citation")
    fuzzy = named(base).groupBy("pair").cogroup(named(current).groupBy("pair")).applyInPandas(match, schema)
    return exact.unionByName(fuzzy)


def grouped_diffs(changes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per pair of versions with sorted arrays ``added`` and ``removed``."""
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("change") == s, F.col("citation")))).alias(s)
    return changes.groupBy(*keys).agg(side("added"), side("removed"))


def flattened(grouped: DataFrame, keys: list[str]) -> DataFrame:
    """One row per change; ``pos`` keeps the order within a pair: added first, then removed."""
    tagged = lambda s: F.transform(F.coalesce(s, F.array().cast("array<string>")), lambda c: F.struct(F.lit(s).alias("change"), c.alias("citation")))
    return grouped.select(*keys, F.posexplode(F.concat(tagged("added"), tagged("removed"))).alias("pos", "_c")).select(*keys, "pos", "_c.change", "_c.citation")


# What marks lines in a list of cited cases.
LIST_HEADER = "List of cited cases"
DIVIDER = r"^[—\-– ]+[A-Z][—\-– ]*$"
COUNTER = r"^\d+/\d+$"
GUIDE_HEADER = r"(?i)^(Guide (?:on|to)|Practical guide on)\b"
NOISE = (
    "The case-law cited in this Guide", "Unless otherwise indicated", "The abbreviation", "The hyperlinks", "The Court delivers its judgments",
    "HUDOC also contains", "language versions available", "Article 44 § 2", "Grand Chamber",
)
CAPITAL = "^[A-Z0-9ÁÀÂÄÆÇČĆĎĐÉÈÊËĚĞÍÎÏİŁĽÑŇÓÔÖØŘŚŠŞȚŤÚÛÜÝŽ]"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
COMPLETE = (
    rf"\b\d{{1,2}}\s+(?:{MONTHS})\s+\d{{4}}\*?\.?$|\bECHR\s+\d{{4}}(?:-[A-Z]+)?\b|Series A no\.|Reports of Judgments|Decisions and Reports|\bDR\s+\d+\b|Collection of decisions"
)
PROSE = ("The ", "Guide ", "European ")


#: Line numbers are dealt in cells of this width, so that no window holds more of a list than that.
CELL = 1 << 16


def _cell() -> Column:
    return F.floor(F.col("line_no") / CELL)


def list_lines(lines: DataFrame) -> DataFrame:
    """Lines of cited-case lists without noise, with the next line and the cell of their number. ``lines``: doc,
    line_no, text. The list begins at the first divider after the first header. The next line that is filled is looked
    for within a line's cell, then among the first filled lines of the cells after it."""
    t = F.trim("text")
    header = lines.where(F.contains("text", F.lit(LIST_HEADER))).groupBy("doc").agg(F.min("line_no").alias("header"))
    divider = lines.where(t.rlike(DIVIDER)).join(header, "doc").where(F.col("line_no") >= F.col("header")).groupBy("doc").agg(F.min("line_no").alias("start"))
    noise = t.isin("", LIST_HEADER) | t.rlike(DIVIDER) | t.rlike(COUNTER) | t.rlike(GUIDE_HEADER)
    noise = noise | t.startswith("European Court of Human Rights") | t.startswith("Updated:") | t.startswith("Last update:")
    for phrase in NOISE:
        noise = noise | F.contains(t, F.lit(phrase))
    body = lines.join(divider, "doc").where(F.col("line_no") >= F.col("start")).select("doc", "line_no", t.alias("text"), _cell().alias("cell"))
    filled = F.nullif("text", F.lit(""))
    # From the end on, since Spark works a frame that ends with the list out anew for every row.
    back = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    first = body.groupBy("doc", "cell").agg(F.min_by(filled, F.when(filled.isNotNull(), F.col("line_no"))).alias("_first"))
    after = first.select("doc", "cell", F.last("_first", ignorenulls=True).over(back("doc").orderBy(F.desc("cell"))).alias("_after"))
    within = F.last(filled, ignorenulls=True).over(back("doc", "cell").orderBy(F.desc("line_no")))
    placed = body.withColumn("_within", within).join(after, ["doc", "cell"])
    return placed.select("doc", "line_no", "text", "cell", F.coalesce("_within", "_after").alias("next_line")).where(~noise)


def _running(rows: DataFrame, count: Column, name: str) -> DataFrame:
    """Adds ``name``: how many of a document's rows up to this one ``count``, by cells and then within the cell."""
    counted = F.sum(count.cast("long"))
    before = Window.partitionBy("doc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    per = rows.groupBy("doc", "cell").agg(counted.alias("_n"))
    offsets = per.select("doc", "cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    upto = Window.partitionBy("doc", "cell").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_local", counted.over(upto)).join(offsets, ["doc", "cell"]).withColumn(name, F.col("_local") + F.col("_offset")).drop("_local", "_offset")


def opens_always(text: Column) -> Column:
    """Whether a line opens a citation whatever stands before and after it."""
    return text.startswith("Advisory opinion") | text.startswith("Case ") | (text.rlike(CAPITAL) & (F.contains(text, F.lit(" v. ")) | F.contains(text, F.lit(" c. "))))


def starts_citation(line: str, current: str | None, following: str | None) -> bool:
    """Whether a line opens a citation, given the one that is open and the line after."""
    if line.startswith(("Advisory opinion", "Case ")):
        return True
    if not re.match(CAPITAL, line):
        return False
    if " v. " in line or " c. " in line:
        return True
    if not current or not re.search(COMPLETE, current) or line.startswith(PROSE):
        return False
    return "," in line or bool(following and following.startswith(("v. ", "c. ")))


def _fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Citations of runs of lines that come in order; the one that is open is carried over from batch to batch."""
    run, pieces, began = None, [], None
    for frame in batches:
        done: list[tuple] = []
        for row in frame.itertuples(index=False):
            if (row.doc, row.run) != run:
                opens = True  # the first line of a run opens a citation always
            else:
                if len(pieces) > 1:
                    pieces = [" ".join(pieces)]
                opens = starts_citation(row.text, pieces[0], row.next_line)
            if opens:
                if pieces:
                    done.append((run[0], began, pieces[0] if len(pieces) == 1 else " ".join(pieces)))
                run, pieces, began = (row.doc, row.run), [row.text], row.line_no
            else:
                pieces.append(row.text)
        yield pd.DataFrame(done, columns=["doc", "line_no", "raw"])
    if pieces:
        yield pd.DataFrame([(run[0], began, " ".join(pieces))], columns=["doc", "line_no", "raw"])


def cited_lists(lines: DataFrame) -> DataFrame:
    """Citations of each document in list order: (doc, pos, citation). Whether a line opens a citation depends on the
    one open so far, but some lines open one always, and those cut a list into runs that don't depend on each other:
    they are folded in parallel, a line at a time. Lines before the first run belong to no citation."""
    rows = _running(list_lines(lines.withColumn("doc", F.col("doc").cast("string"))), opens_always(F.col("text")), "run").where("run > 0")
    dealt = rows.select("doc", "run", F.col("line_no").cast("long").alias("line_no"), "text", "next_line").repartition("doc", "run")
    entries = dealt.sortWithinPartitions("doc", "run", "line_no").mapInPandas(_fold, "doc string, line_no long, raw string")
    placed = _running(entries.withColumn("cell", _cell()).repartition("doc", "cell"), F.lit(1), "_upto")
    return placed.select("doc", (F.col("_upto") - 1).alias("pos"), folded("raw").alias("citation"))


def menu(rows: DataFrame, title: str, value: str, order: str) -> DataFrame:
    """Titles in order with the value that the last row of each has."""
    return rows.groupBy(title).agg(F.max_by(value, order).alias(value)).orderBy(title)
