"""Mentions of citations in documents, and what a viewer shows of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import search_terms
from ..functions.similarity import highlighted
from ..functions.text import first_filled, paragraphs, viewer_form
from .versions import LIST_HEADER

LEAST = 40


def body_pages(pages: DataFrame, header: str = LIST_HEADER) -> DataFrame:
    """Pages before the last one that carries the list's header; all pages of documents without one. ``pages``: doc,
    page, text."""
    last = pages.groupBy("doc").agg(F.max(F.when(F.contains("text", F.lit(header)), F.col("page"))).alias("_list"))
    return pages.join(last, "doc").where(F.col("_list").isNull() | (F.col("page") < F.col("_list"))).drop("_list")


def mentions(pages: DataFrame, citations: DataFrame, *, header: str = LIST_HEADER, least: int = LEAST) -> DataFrame:
    """Paragraphs of the body that name a citation of their document: (doc, citation, page, pos, paragraph).
    ``citations``: doc, citation. The document is the join's equality."""
    split = body_pages(pages, header).select("doc", "page", F.posexplode(paragraphs("text", least)).alias("pos", "paragraph"))
    formed = split.withColumn("_form", viewer_form("paragraph"))
    asked = citations.withColumn("_terms", F.transform(search_terms("citation"), viewer_form))
    met = formed.join(asked, "doc").where(F.exists("_terms", lambda t: F.contains("_form", t)))
    return met.select("doc", "citation", "page", "pos", "paragraph")


def summaries(found: DataFrame, keys: list[str], shown: int = 5) -> DataFrame:
    """One line per key: how many mentions there are and on which pages the first ones stand."""
    pages = F.transform(F.array_sort(F.collect_list(F.struct("page", "pos"))), lambda x: x["page"].cast("string"))
    grouped = found.groupBy(*keys).agg(F.count("*").alias("n"), pages.alias("_p"))
    more = F.when(F.col("n") > shown, ", ...").otherwise("")
    line = F.concat(F.col("n").cast("string"), F.lit(" body mention(s) found on page(s): "), F.array_join(F.slice("_p", 1, shown), ", "), more)
    return grouped.select(*keys, "n", line.alias("summary"))


def focus_page(change: Column, from_pages: Column, to_pages: Column) -> Column:
    """The first mention's page on the change's own side, else on the other, else 1."""
    head = lambda c: F.get(c, F.lit(0))
    return F.coalesce(F.when(change == "added", head(to_pages)).otherwise(head(from_pages)), head(to_pages), head(from_pages), F.lit(1))


def page_numbers(c: str) -> Column:
    """Distinct pages above 0 in order."""
    return F.array_sort(F.array_distinct(F.filter(c, lambda p: p > 0)))


def clamped(page: Column, pages: Column) -> Column:
    return F.greatest(F.lit(1), F.least(page, pages))


def marked(found: DataFrame) -> DataFrame:
    """Mentions with their terms marked for display."""
    return found.withColumn("html", highlighted("paragraph", search_terms("citation")))


def labels(diffs: DataFrame) -> DataFrame:
    """A diff's label, its token and the addresses of both sides. ``diffs``: guide_id, versions, snapshots, added,
    removed, and address columns where there are any."""
    count = lambda c: F.greatest(F.size(c), F.lit(0)).cast("string")
    address = lambda side: first_filled(*[c for c in (f"{side}_hf_url", f"{side}_wayback_url", f"{side}_url") if c in diffs.columns])
    out = diffs.withColumns({
        "label": F.concat("from_version", F.lit(" -> "), "to_version", F.lit(" (+"), count("added"), F.lit(" / -"), count("removed"), F.lit(")")),
        "token": F.concat_ws("|", "guide_id", "from_snapshot", "to_snapshot"),
    })
    sides = [s for s in ("from", "to") if any(c.startswith(f"{s}_") and c.endswith("url") for c in diffs.columns)]
    return out.withColumns({f"{s}_address": address(s) for s in sides}) if sides else out
