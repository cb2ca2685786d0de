"""Paragraphs of versioned documents: extraction from blocks, alignment of two versions, change classes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import application_numbers, case_name
from ..functions.labels import change_class
from ..functions.similarity import ratio, seq_ratio
from ..functions.text import collapsed, folded, heading, match_form, text_hash

# Header and noise marks, and the tolerances in points.
HEADER = r"(?i)^(Guide (?:on|to)|Practical guide on)\b"
COURT, UPDATE = "European Court of Human Rights", "Last update:"
HEADING_REACH, ANCHOR_SLACK = 42, 4
NUMBERED = r"(?s)^(\d+)\.\s+(.*)$"
#: (same number, same section, how far numbers may lie apart, similarity to exceed), in the order they are tried.
TIERS = ((True, True, 0, 0.82), (True, False, 0, 0.90), (False, True, 2, 0.92))


def is_header(text: Column, y: Column, height: Column) -> Column:
    footer = F.contains(text, F.lit(COURT)) | F.contains(text, F.lit(UPDATE))
    return (text == "") | ((y < 45) & text.rlike(HEADER)) | ((y > height - 55) & footer) | text.rlike(r"^\d+/\d+$")


def is_noise(text: Column) -> Column:
    return text.isin("", "Table of contents", "HUDOC keywords") | text.startswith(COURT) | F.contains(text, F.lit(UPDATE)) | text.rlike(r"\.{5,}")


def section_paths(toc: DataFrame) -> DataFrame:
    """Anchors from a table of contents. ``toc``: doc, pos (from 1), level, raw_title, page_number (from 1), y. The path
    joins the component of each level above: of every shallower level the latest entry, if no entry of a level
    between reset it."""
    named = toc.withColumn("raw_title", folded("raw_title")).withColumn("_h", heading("raw_title", "pos"))
    up = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.collect_list(F.struct("level", F.col("_h.component").alias("component"))).over(up)
    # A table of contents is short; the fold keeps the stack of levels: deeper ones go when a shallower one comes.
    stack = F.aggregate(
        before,
        F.array().cast("array<struct<level:int,component:string>>"),
        lambda held, x: F.concat(
            F.filter(held, lambda h: h["level"] < x["level"]),
            F.array(F.struct(x["level"].cast("int").alias("level"), x["component"].alias("component"))),
        ),
    )
    return named.select(
        "doc", "pos", F.greatest(F.col("page_number") - 1, F.lit(0)).alias("page"), F.coalesce("y", F.lit(0.0)).alias("y"), "level",
        F.array_join(F.transform(stack, lambda s: s["component"]), ".").alias("path"), F.col("_h.title").alias("title"), "raw_title",
    )


def extracted(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """Numbered paragraphs of documents. ``blocks``: doc, page, height, x, y, text; ``anchors``: as ``section_paths``
    gives them. A block belongs to the latest anchor at or above it (the first anchor before any), a block that repeats
    an anchor's title near it is a heading and switches to that section, a number opens a paragraph, other blocks go
    on with it, and what stands between a heading and the next number is left out."""
    text = folded(F.replace("text", F.lit("\n"), F.lit(" ")))
    kept = blocks.withColumn("text", text).where(~is_header(F.col("text"), F.col("y"), F.col("height")) & ~is_noise(F.col("text")))
    kept = kept.withColumn("form", match_form("text")).withColumn("key", F.monotonically_increasing_id())
    a = anchors.select(
        F.col("doc").alias("a_doc"), F.col("page").alias("a_page"), F.col("y").alias("a_y"), F.struct("path", "title", "level").alias("section"),
        match_form("title").alias("a_title"), match_form("raw_title").alias("a_raw"),
        F.row_number().over(Window.partitionBy("doc").orderBy("page", "y", "level", "pos")).alias("a_no"),
    )
    alike = lambda t: F.contains(t, F.col("form")) | F.contains(F.col("form"), t)
    near = kept.join(a, (F.col("doc") == F.col("a_doc")) & (F.col("page") == F.col("a_page")), "inner").where(
        (F.abs(F.col("a_y") - F.col("y")) <= HEADING_REACH) & (F.col("form") != "") & (alike(F.col("a_title")) | alike(F.col("a_raw")))
    )
    headings = near.groupBy("doc", "page", "y", "x", "text").agg(F.min_by("section", "a_no").alias("heading"))
    marked = kept.join(headings, ["doc", "page", "y", "x", "text"], "left")
    start = a.groupBy(F.col("a_doc").alias("doc")).agg(F.min_by("section", "a_no").alias("start"))
    switches = a.select(
        F.col("a_doc").alias("doc"), F.col("a_page").alias("page"), (F.col("a_y") - ANCHOR_SLACK).alias("y"), F.lit(-1.0).alias("x"),
        F.lit(0).alias("kind"), F.col("a_no").cast("long").alias("tie"), F.lit(None).cast("string").alias("text"), "section", F.lit(False).alias("is_heading"),
    )
    events = marked.select(
        "doc", "page", "y", F.col("x").cast("double").alias("x"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("tie"), "text",
        F.col("heading").alias("section"), F.col("heading").isNotNull().alias("is_heading"),
    ).unionByName(switches)
    order = Window.partitionBy("doc").orderBy("page", "y", "kind", "tie", "x", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    front = F.struct(F.lit("§0").alias("path"), F.lit("Front matter").alias("title"), F.lit(1).alias("level"))
    opens = (F.col("kind") == 1) & ~F.col("is_heading") & F.col("text").rlike(NUMBERED)
    placed = (
        events.join(start, "doc", "left")
        .withColumn("now", F.coalesce(F.last("section", ignorenulls=True).over(upto), F.col("start"), front))
        .withColumn("opens", opens)
        .withColumn("run", F.sum((F.col("opens") | F.col("is_heading")).cast("long")).over(upto))
        .withColumn("at", F.row_number().over(order))
        .where(F.col("kind") == 1)
    )
    piece = F.when(F.col("opens"), F.trim(F.regexp_extract("text", NUMBERED, 2))).otherwise(F.col("text"))
    runs = placed.where(~F.col("is_heading")).groupBy("doc", "run").agg(
        F.min("at").alias("at"), F.max(F.when(F.col("opens"), F.regexp_extract("text", NUMBERED, 1).cast("int"))).alias("para_num"),
        F.min_by("now", "at").alias("section"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", piece.alias("t")))), lambda x: x["t"]), " ").alias("text"),
    )
    return described(
        runs.where("para_num is not null").select(
            "doc", "para_num", F.col("section.path").alias("section_path"), F.col("section.title").alias("section_title"),
            F.col("section.level").alias("section_level"), collapsed("text").alias("text"),
            (F.row_number().over(Window.partitionBy("doc").orderBy("at")) - 1).alias("order"),
        ).where("text <> ''")
    )


def as_of(blocks: DataFrame, anchors: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """Each block with the ``value`` of the latest anchor at or before it (``order``: columns of both), the first
    anchor's before any; null in groups without anchors. One window over both sides, no join of every pair."""
    keys = [*group, *order]
    both = blocks.withColumn("_a", F.lit(None).cast("int")).unionByName(
        anchors.select(*keys, F.col(value).alias("_value")).withColumn("_a", F.lit(0)), allowMissingColumns=True
    )
    at = Window.partitionBy(*group).orderBy(*order, F.col("_a").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group).orderBy(*order, F.col("_a").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.first("_value", ignorenulls=True).over(whole)
    placed = both.withColumn(value, F.coalesce(F.last("_value", ignorenulls=True).over(at), first))
    return placed.where("_a is null").drop("_a", "_value")


def described(paragraphs: DataFrame) -> DataFrame:
    """Adds norm_text and char_hash."""
    return paragraphs.withColumns({"norm_text": match_form("text"), "char_hash": text_hash("text")})


def unique_text_pairs(a: DataFrame, b: DataFrame, keys: list[str], text: str = "norm_text", idx: str = "order") -> DataFrame:
    """(keys, a_order, b_order) of paragraphs whose text is filled, unique on either side and the same on both."""

    def unique(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col(text) != "").groupBy(*keys, text).agg(F.count("*").alias("_n"), F.min(idx).alias(name)).where("_n = 1").drop("_n")

    return unique(a, "a_order").join(unique(b, "b_order"), [*keys, text]).drop(text)


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs that a tier may match, with their similarity: by equal number, or by section and a number at most 2 off.
    ``a``, ``b``: pair, order, para_num, section_path, norm_text of the paragraphs that are still free."""
    left = a.select("pair", *[F.col(c).alias(f"a_{c}") for c in ("order", "para_num", "section_path", "norm_text")])
    right = b.select("pair", *[F.col(c).alias(f"b_{c}") for c in ("order", "para_num", "section_path", "norm_text")])
    same_number = left.join(right.withColumn("a_para_num", F.col("b_para_num")), ["pair", "a_para_num"])
    band = right.withColumn("a_para_num", F.explode(F.array(*[F.col("b_para_num") + d for d in (-2, -1, 1, 2)]))).withColumn("a_section_path", F.col("b_section_path"))
    near = left.join(band, ["pair", "a_section_path", "a_para_num"])
    cols = ["pair", "a_order", "b_order", "a_para_num", "b_para_num", "a_section_path", "b_section_path", "a_norm_text", "b_norm_text"]
    both = same_number.select(*cols).unionByName(near.select(*cols))
    return both.select(
        "pair", "a_order", "b_order", (F.col("a_para_num") == F.col("b_para_num")).alias("same_number"),
        (F.col("a_section_path") == F.col("b_section_path")).alias("same_section"), seq_ratio("a_norm_text", "b_norm_text").alias("score"),
    )


def _resolve(frame: pd.DataFrame) -> pd.DataFrame:
    """Takes the tiers in turn: each free paragraph of a in order gets the best free one of b above the threshold."""
    done: dict[int, int] = {}
    taken: set[int] = set()
    frame = frame.sort_values(["a_order", "b_order"])
    for number, section, reach, least in TIERS:
        tier = frame[(frame["score"] > least) & (frame["same_number"] if number else True) & (frame["same_section"] if section else True)]
        for a, options in tier.groupby("a_order", sort=True):
            if a in done:
                continue
            free = options[~options["b_order"].isin(taken)]
            if len(free):
                best = int(free.loc[free["score"].idxmax(), "b_order"])
                done[int(a)] = best
                taken.add(best)
    return pd.DataFrame({"pair": frame["pair"].iloc[0], "a_order": list(done), "b_order": list(done.values())})


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """(pair, a_order, b_order): one-to-one matches of two versions' paragraphs. Equal unique texts match by a join;
    similarities are worked out for blocked candidates only, in parallel; the greedy choice that is left runs per
    pair of versions over the candidates' scores."""
    a, b = (x.withColumn("pair", F.col("pair").cast("string")) for x in (a, b))
    exact = unique_text_pairs(a, b, ["pair"])
    rest_a = a.join(exact.select("pair", F.col("a_order").alias("order")), ["pair", "order"], "left_anti")
    rest_b = b.join(exact.select("pair", F.col("b_order").alias("order")), ["pair", "order"], "left_anti")
    likely = candidates(rest_a, rest_b).where(F.col("score") > min(t[-1] for t in TIERS))
    order = likely.schema["a_order"].dataType.simpleString()
    greedy = likely.groupBy("pair").applyInPandas(_resolve, f"pair string, a_order {order}, b_order {order}")
    return exact.unionByName(greedy)


def present(text: Column, form: Column, marker: Column) -> Column:
    """Whether a text (null: no) names a marker: struct of name_norm and apps."""
    named = (marker["name_norm"] != "") & F.contains(form, marker["name_norm"])
    return F.coalesce(named | F.exists(marker["apps"], lambda x: F.contains(text, x)), F.lit(False))


def markers(citations: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair of versions the arrays ``added`` and ``removed`` of markers. ``citations``: keys, change, citation."""
    made = citations.withColumn("m", F.struct("citation", match_form(case_name("citation")).alias("name_norm"), application_numbers("citation").alias("apps")))
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("change") == s, F.col("m")))).alias(s)
    return made.groupBy(*keys).agg(side("added"), side("removed"))


def changes(a: DataFrame, b: DataFrame, citations: DataFrame) -> DataFrame:
    """Every paragraph of either version once, with its change class. ``a``, ``b``: pair, order and the columns of
    ``described``; ``citations``: pair, change, citation. Deleted and added paragraphs are what the full outer join of
    the alignment leaves."""
    a, b, citations = (x.withColumn("pair", F.col("pair").cast("string")) for x in (a, b, citations))
    fields = ["order", "para_num", "section_path", "section_title", "section_level", "text", "norm_text", "char_hash"]
    left = a.select("pair", *[F.col(c).alias(f"a_{c}") for c in fields]).join(aligned(a, b), ["pair", "a_order"], "left")
    right = b.select("pair", *[F.col(c).alias(f"b_{c}") for c in fields])
    both = left.join(right, ["pair", "b_order"], "full").join(markers(citations, ["pair"]), "pair", "left")
    none = F.array().cast("array<string>")

    def delta(side: str, gained: str, lost: str) -> Column:
        new = F.filter(
            F.coalesce(side, F.array().cast("array<struct<citation:string,name_norm:string,apps:array<string>>>")),
            lambda m: present(F.col(f"{gained}_text"), F.col(f"{gained}_norm_text"), m) & ~present(F.col(f"{lost}_text"), F.col(f"{lost}_norm_text"), m),
        )
        return F.coalesce(F.transform(new, lambda m: m["citation"]), none)

    out = both.withColumns({"citations_added": delta("added", "b", "a"), "citations_removed": delta("removed", "a", "b")})
    matched = F.col("a_text").isNotNull() & F.col("b_text").isNotNull()
    same_text, same_section = F.col("a_norm_text") == F.col("b_norm_text"), F.col("a_section_path") == F.col("b_section_path")
    out = out.withColumn("similarity", F.round(seq_ratio(F.when(matched & ~same_text, F.col("a_norm_text")), F.col("b_norm_text")), 3))
    kind = change_class(same_text, same_section, F.size("citations_added") > 0, F.size("citations_removed") > 0, F.col("similarity"))
    moved = matched & ~same_section
    return out.select(
        "pair", F.col("a_order"), F.col("b_order"),
        F.when(matched, kind).when(F.col("a_text").isNotNull(), "paragraph_deleted").otherwise("paragraph_added").alias("change_type"),
        *[F.coalesce(f"b_{c}", f"a_{c}").alias(c) for c in ("section_path", "section_title", "section_level")],
        F.col("a_para_num").alias("para_num_a"), F.col("b_para_num").alias("para_num_b"), "similarity",
        F.col("a_text").alias("text_a"), F.col("b_text").alias("text_b"), F.col("a_char_hash").alias("char_hash_a"), F.col("b_char_hash").alias("char_hash_b"),
        "citations_added", "citations_removed",
        F.when(moved, F.col("a_section_path")).alias("moved_from"), F.when(moved, F.col("b_section_path")).alias("moved_to"),
    )


def section_events(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Sections that went, came or changed title. ``a``, ``b``: keys, path, title, level, one row per path."""
    left, right = (x.select(*keys, "path", F.col("title").alias(f"title_{s}"), F.col("level").alias(f"level_{s}"), F.lit(True).alias(f"in_{s}")) for x, s in ((a, "a"), (b, "b")))
    both = left.join(right, [*keys, "path"], "full")
    event = F.when(F.col("in_b").isNull(), "section_deleted").when(F.col("in_a").isNull(), "section_added").when(~F.col("title_a").eqNullSafe(F.col("title_b")), "section_title_changed")
    return both.withColumn("change_type", event).where("change_type is not null").select(
        *keys, "change_type", "path",
        F.when(F.col("change_type") != "section_title_changed", F.coalesce("title_a", "title_b")).alias("title"),
        F.coalesce("level_a", "level_b").alias("level"),
        *[F.when(F.col("change_type") == "section_title_changed", F.col(c)).alias(c) for c in ("title_a", "title_b")],
    )


def transition_summary(changed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per transition with totals and a map of counts per change class."""
    per = changed.groupBy(*keys, "change_type").agg(F.count("*").alias("n"))
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("change_type", "n"))))
    return per.groupBy(*keys).agg(F.sum("n").alias("total_para_changes"), entries.alias("paragraph_changes"))


def diff_documents(changed: DataFrame, events: DataFrame, citations: DataFrame, transitions: DataFrame) -> DataFrame:
    """One nested row per pair of versions, as diff files have them. ``transitions``: pair, guide_title, version_a,
    version_b (ISO dates)."""
    changed, events, citations, transitions = (x.withColumn("pair", F.col("pair").cast("string")) for x in (changed, events, citations, transitions))
    body = [c for c in changed.columns if c not in ("pair", "a_order", "b_order")]
    order = F.struct(F.col("a_order").isNull(), F.coalesce("a_order", "b_order"))
    paras = changed.groupBy("pair").agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(*body).alias("p")))), lambda x: x["p"]).alias("paragraph_changes"))
    event_cols = [c for c in events.columns if c != "pair"]
    sections = events.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct(*event_cols))).alias("section_events"))
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("change") == s, F.col("citation")))).alias(s)
    cited = citations.groupBy("pair").agg(F.struct(side("added"), side("removed")).alias("cited_cases_diff"))
    counts = transition_summary(changed, ["pair"]).withColumnRenamed("paragraph_changes", "_counts")
    days = F.date_diff(F.col("version_b").cast("date"), F.col("version_a").cast("date"))
    size = lambda c: F.size(F.coalesce(c, F.array())).alias(f"cited_cases_{c.rpartition('.')[2]}")
    summary = F.struct("total_para_changes", F.col("_counts").alias("paragraph_changes"), size("cited_cases_diff.added"), size("cited_cases_diff.removed"))
    joined = transitions
    for part in (counts, paras, sections, cited):
        joined = joined.join(part, "pair", "left")
    return joined.select(
        "pair", "guide_title", "version_a", "version_b", days.alias("delta_days"), summary.alias("summary"), "section_events", "paragraph_changes", "cited_cases_diff"
    )
