"""Links between citation changes and changed paragraphs, usability flags, edit types, the cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.citations import case_struct
from ..functions.labels import STRATEGIES, edit_type, legacy_edit_type
from ..functions.text import blank, first_filled, folded, match_form, parts

TRANSITION = ["guide_id", "from_date", "to_date"]


def strategies(change: Column, key: Column, name_norm: Column, apps: Column, cited: Column, text: Column, text_norm: Column) -> Column:
    """The rules that link a citation change to a paragraph, in order. ``cited``: array of structs (case_key, apps,
    name_norm) of the paragraph's citations on the change's side; ``text``: the paragraph's text on that side."""
    same = F.exists(cited, lambda c: c["case_key"] == key)
    # Citations after the one that equals the key are not looked at.
    until = F.array_position(F.transform(cited, lambda c: c["case_key"] == key), True)
    seen = F.when(until > 0, F.slice(cited, F.lit(1), (until - 1).cast("int"))).otherwise(cited)
    share = F.exists(seen, lambda c: F.arrays_overlap(c["apps"], apps))
    named = F.exists(seen, lambda c: (c["name_norm"] != "") & (F.contains(c["name_norm"], name_norm) | F.contains(name_norm, c["name_norm"])))
    in_text = F.exists(apps, lambda a: F.contains(text, a))
    tests = (same, share, (name_norm != "") & named, (name_norm != "") & F.contains(text_norm, name_norm), in_text)
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(s)) for t, s in zip(tests, STRATEGIES, strict=True)]))


def linked(changes: DataFrame, paragraphs: DataFrame, catalog: DataFrame, on: list[str] = TRANSITION) -> DataFrame:
    """One row per citation change and linked paragraph. ``changes``: row_id, transition, change, citation_text;
    ``paragraphs``: transition and the columns of a paragraph change. The transition is the equality that carries the
    join; the rules are its residue."""
    rows = changes.withColumn("case", case_struct("citation_text")).withColumn("name_norm", match_form("case.case_name"))
    cited = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(case_struct(x, ascii_only=True).alias("s")))
    both = rows.join(paragraphs, on)
    side = lambda added, removed: F.when(F.col("change") == "added", F.col(added)).otherwise(F.col(removed))
    structs = F.transform(
        cited(side("citations_added", "citations_removed")),
        lambda x: F.struct(x["s"]["case_key"].alias("case_key"), x["s"]["application_numbers"].alias("apps"), match_form(x["s"]["case_name"], ascii_only=True).alias("name_norm")),
    )
    text = F.coalesce(side("text_b", "text_a"), F.lit(""))
    found = both.withColumns({"_text": text, "_norm": match_form(text)}).withColumn(
        "strategies", strategies(F.col("change"), F.col("case.case_key"), F.col("name_norm"), F.col("case.application_numbers"), structs, F.col("_text"), F.col("_norm"))
    )
    order = Window.partitionBy("row_id").orderBy(F.coalesce("section_path", F.lit("")), F.coalesce("para_num_a", F.lit(0)), F.coalesce("para_num_b", F.lit(0)))
    kept = found.where(F.size("strategies") > 0).withColumn("paragraph_rank", F.row_number().over(order))
    named = kept.withColumn("case_key", F.col("case.case_key")).drop("_text", "_norm", "case", "name_norm")
    known = catalog.dropDuplicates(["case_key"])
    return named.join(known, "case_key", "left")


def distinct_in_order(value: Column, order: Column) -> Column:
    """Aggregate: values in order, empty ones left out, each at its first place."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"])
    return F.array_distinct(F.filter(listed, lambda v: v.isNotNull() & (v != "")))


def linked_rows(changes: DataFrame, links: DataFrame, diffs: DataFrame, on: list[str] = TRANSITION) -> DataFrame:
    """One row per citation change with its status and what its paragraphs say, in paragraph order. ``diffs``: the
    transitions that have a diff."""
    rank = F.col("paragraph_rank")
    title = F.when(blank("section_title"), F.col("section_path")).otherwise(F.concat_ws(": ", "section_path", "section_title"))
    refs = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("o"), F.struct("section_path", "para_num_a", "para_num_b").alias("v")))), lambda x: x["v"])
    said = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("o"), F.col("strategies").alias("v")))), lambda x: x["v"]))
    grouped = links.groupBy("row_id").agg(
        F.count("*").alias("linked_paragraphs"), distinct_in_order(title, rank).alias("linked_sections"),
        distinct_in_order(F.col("change_type"), rank).alias("linked_change_types"), F.array_distinct(refs).alias("linked_refs"),
        F.array_distinct(said).alias("match_strategies"),
        F.array_join(distinct_in_order(folded("text_a"), rank), "\n\n").alias("pre_text"),
        F.array_join(distinct_in_order(folded("text_b"), rank), "\n\n").alias("post_text"),
    )
    known = diffs.select(*on).distinct().withColumn("_has_diff", F.lit(True))
    status = F.when(F.col("_has_diff").isNull(), "diff_pair_missing").when(F.col("linked_paragraphs").isNotNull(), "linked_paragraphs").otherwise("no_paragraph_link")
    return changes.join(known, on, "left").join(grouped, "row_id", "left").withColumn("link_status", status).drop("_has_diff")


def strategy_counts(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode(F.array_distinct("match_strategies")).alias("strategy")).groupBy("strategy").agg(F.count("*").alias("n"))


def with_flags(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds what a linked row can be used for. ``texts``: itemid, status, path, chars of fetched texts."""
    ok = texts.where(F.lower("status") == "ok").select("itemid", F.col("path").alias("case_text_path"), F.col("chars").alias("case_text_chars")).dropDuplicates(["itemid"])
    filled = F.nullif(F.col("itemid"), F.lit(""))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    relevance = F.col("link_status") == "linked_paragraphs"
    location, edit = relevance & size("linked_sections"), relevance & size("linked_sections") & size("linked_change_types")
    joined = rows.withColumn("itemid", filled).join(ok, "itemid", "left")
    return joined.withColumns({
        "usable_for_relevance": relevance, "usable_for_location": location, "usable_for_edit_type": edit,
        "usable_for_generation": location & (F.col("change") == "added") & ~blank("post_text"),
        "strict_citation_field_match": F.coalesce(F.array_contains("match_strategies", STRATEGIES[0]), F.lit(False)),
        "case_text_available": F.col("case_text_path").isNotNull(),
    })


def paragraph_summary(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of linked paragraphs the struct that ``edit_type`` reads."""
    kind = F.col("change_type")
    pre, post = ~blank("text_a"), ~blank("text_b")
    of = lambda k: F.count_if(kind == k)
    grouped = paragraphs.groupBy(*keys).agg(
        F.array_sort(F.collect_set(F.nullif(kind, F.lit("")))).alias("types"), F.count("*").alias("n_paragraphs"),
        F.count_if(pre).alias("n_pre"), F.count_if(post).alias("n_post"), of("paragraph_added").alias("n_added"),
        F.count_if((kind == "paragraph_added") & ~pre).alias("n_added_empty_pre"), of("citation_added").alias("n_inserted"),
        F.count_if((kind == "citation_added") & pre & post).alias("n_insert_like"),
        of("paragraph_deleted").alias("n_deleted"), of("citation_updated").alias("n_updated"), of("minor_edit").alias("n_minor"),
        F.min(F.col("similarity").try_cast("double")).alias("min_similarity"), F.max(F.col("similarity").try_cast("double")).alias("max_similarity"),
    )
    fields = [c for c in grouped.columns if c not in keys]
    return grouped.select(*keys, F.struct(*fields).alias("summary"))


def edit_types(rows: DataFrame, paragraphs: DataFrame, keys: list[str], *, by_change: bool = False) -> DataFrame:
    """Adds edit_type, subtype, confidence and legacy_edit_type to rows with change, linked_change_types, pre_text and
    post_text. Groups ignore the change's direction unless ``by_change``."""
    keys = [*keys, "change"] if by_change else keys
    legacy = legacy_edit_type(F.col("change"), F.coalesce("linked_change_types", F.array().cast("array<string>")), F.col("pre_text"), F.col("post_text"))
    joined = rows.join(paragraph_summary(paragraphs, keys), keys, "left").withColumn("legacy_edit_type", legacy)
    return joined.withColumn("_e", edit_type(F.col("change"), F.col("summary"), F.col("legacy_edit_type"))).select("*", "_e.*").drop("_e")


def cascade(trigger: DataFrame, retrieval: DataFrame, edits: DataFrame, threshold: Column, keys: list[str]) -> DataFrame:
    """Trigger decisions with the retrieval and the edit type of the same change. Of several retrieval rows per key the
    last counts, of several edit rows the first (columns ``idx`` give the order)."""
    one = lambda df, order: df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n", "idx")
    out = trigger.join(one(retrieval, F.desc("idx")), keys, "left").join(one(edits, F.asc("idx")), keys, "left")
    predicted = F.col("score") >= threshold
    return out.withColumns({
        "predicted": predicted, "hit1": F.coalesce("hit1", F.lit(0)), "edit_type": F.coalesce("edit_type", F.lit("")),
        "trigger_correct": predicted == (F.col("label") == 1),
        "pipeline_hit1": (predicted & (F.col("label") == 1) & (F.coalesce("hit1", F.lit(0)) == 1)).cast("int"),
    })


def cascade_metrics(rows: DataFrame, group: list[str]) -> DataFrame:
    """Trigger rates, location given a correct trigger, location over all positives, and the joint hit."""
    positive, hit = F.col("label") == 1, F.col("predicted")
    tp, fp, fn = F.count_if(hit & positive), F.count_if(hit & ~positive), F.count_if(~hit & positive)
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 4)
    return rows.groupBy(*group).agg(
        F.count("*").alias("n"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"),
        rate(tp, tp + fp).alias("precision"), rate(tp, tp + fn).alias("recall"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"),
        rate(F.sum(F.when(hit & positive, F.col("hit1")).otherwise(0)), tp).alias("location_given_trigger"),
        rate(F.sum(F.when(positive, F.col("hit1")).otherwise(0)), tp + fn).alias("location_all"),
        rate(F.sum("pipeline_hit1"), tp + fn).alias("pipeline_hit1"),
    )


def threshold_of(report: DataFrame, model: str, fallback: float = 0.5) -> DataFrame:
    """One row ``threshold`` from a report of (split, model, threshold), the development split's; else the fallback."""
    chosen = report.where((F.col("split") == "dev") & (F.col("model") == model)).agg(F.first("threshold", ignorenulls=True).alias("t"))
    return chosen.select(F.coalesce("t", F.lit(fallback)).alias("threshold"))


def reference_parts(value: Column) -> Column:
    """(section_path, para_num_a, para_num_b) structs of ``path|a:1|b:2`` references joined by ``|``; None and empty
    numbers are null, so that references compare null-safely."""
    found = F.regexp_extract_all(value, F.lit(r"([^|]*)\|a:(?:\d+|None)?\|b:(?:\d+|None)?"), F.lit(0))
    piece = lambda x, p: F.nullif(F.regexp_extract(x, p, 1), F.lit("")).cast("int")
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^([^|]*)\|a:", 1).alias("section_path"), piece(x, r"\|a:(\d+)").alias("para_num_a"), piece(x, r"\|b:(\d+)$").alias("para_num_b")))


def paragraph_text(mode: str = "pre") -> Column:
    """The text that a paragraph corpus indexes: before the change, or after it where there was none before (which
    shows a ranker the text it is to find)."""
    return F.coalesce("text_a", F.lit("")) if mode == "pre" else F.coalesce(first_filled("text_a", "text_b"), F.lit(""))


def list_column(c: str) -> Column:
    return parts(c, "|")


def carried(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``rows`` with just ``fields``, as text; "" for nulls and for columns that aren't there."""
    return rows.select(*[(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) if f in rows.columns else F.lit("")).alias(f) for f in fields])


def with_subtype(rows: DataFrame, types: DataFrame, on: list[str], order: str, default: str = "unknown") -> DataFrame:
    """Adds ``subtype`` from ``types`` (keys, subtype, ``order``), of repeated keys the last; ``default`` without any."""
    last = types.groupBy(*on).agg(F.max_by("subtype", order).alias("subtype"))
    return rows.join(last, on, "left").withColumn("subtype", F.coalesce("subtype", F.lit(default)))


def labelled_union(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Both as rows with a label; a column that one of them lacks is null there."""
    label = lambda df, v: df.withColumn("label", F.lit(v))
    return label(positives, 1).unionByName(label(negatives, 0), allowMissingColumns=True)
