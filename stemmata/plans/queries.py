"""Every query of the library's own operators, by name.

The tables that the operators were made for are not among the test tables; each query states its stand-in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import citations as cite
from ..functions.labels import blend, length_ratio, split_label
from ..functions.similarity import alike_without_number, rouge_l
from ..functions.text import judgment_sections, match_form, query_tokens
from ..operators import audit, bm25, bm25_scan, catalog, linking, mentions as body, metrics, paragraphs, ranking, sampling, versions
from ..sources.documents import strip_tags
from .sql import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CUTS = (1, 3, 10)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- retrieval: a source is a corpus, a document a section, a benchmark passage a query -------------------------------


def _corpora(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("source").alias("corpus"), F.col("doc_id").alias("doc"), "text")


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")


def _leading(spark: SparkSession, sf: str, top: int, **how) -> DataFrame:
    """Scored rows among which are the ``top`` ones of every passage and corpus; all rows if passages are too many to be held."""
    docs, terms = _corpora(spark, sf), bm25.query_terms(_passages(spark, sf))
    model = bm25_scan.learned(docs, terms)
    return bm25.matches(terms, bm25.index(docs)) if model is None else bm25_scan.leading(docs, model, top, **how)


def _first_ranks(spark: SparkSession, sf: str, *distinct: bool) -> list[DataFrame]:
    """(query, corpus, rank) of the first section that contains the passage, if any is ranked; for passages as they are or with distinct terms."""
    docs, passages = _corpora(spark, sf), _passages(spark, sf)
    gold = bm25.containing(docs, passages)
    model = bm25_scan.learned(docs, bm25.query_terms(passages))
    if model is not None:
        gold = gold.persist()  # used up when the ranks are stated: the best of its rows are known by then
        try:
            return [bm25_scan.first_ranks(docs, model.distinct() if d else model, gold) for d in distinct]
        finally:
            gold.unpersist()
    index = bm25.index(docs)
    ranked = [ranking.by_score(bm25.scores(bm25.query_terms(passages, distinct=d), index, zeros=False)) for d in distinct]
    return [r.join(gold, ["query", "corpus", "doc"]).groupBy("query", "corpus").agg(F.min("rank").cast("long").alias("rank")) for r in ranked]


def _named(df: DataFrame, *more: str) -> DataFrame:
    score = [F.round("score", 6).alias("score")] if "score" in df.columns else []
    return df.select(F.col("query").alias("item_id"), F.col("corpus").alias("source"), F.col("doc").alias("doc_id"), *score, *more)


@query
def bm25_section_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The three best sections of every corpus for every passage."""
    return _named(ranking.by_score(_leading(spark, sf, 3), top=3), "rank")


@query
def retrieval_hit_mrr(spark: SparkSession, sf: str) -> DataFrame:
    """Hit rates and mean reciprocal rank over the corpora that contain a passage, by overlapping slices."""
    rows = ranking.hits(_first_ranks(spark, sf, False)[0], ["query", "corpus"], F.lit(True), CUTS)
    slices = {"all": F.lit(True), "large_source": F.col("corpus") == "src0", "other_source": F.col("corpus") != "src0", "first_half": F.col("query") < 20}
    return ranking.sliced(rows, slices, ["hit1", "hit3", "hit10", "rr"], places=6)


@query
def bm25_max_score(spark: SparkSession, sf: str) -> DataFrame:
    """Each passage's best score in each corpus."""
    best = _leading(spark, sf, 1).groupBy("query", "corpus").agg(F.max("score").alias("score"))
    return best.select(F.col("query").alias("item_id"), F.col("corpus").alias("source"), F.round("score", 6).alias("score"))


@query
def query_dedup_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Mean reciprocal rank with and without the query's repeated terms."""
    out = []
    for name, ranks in zip(("all_terms", "distinct_terms"), _first_ranks(spark, sf, False, True), strict=True):
        rows = ranking.hits(ranks, ["query", "corpus"], F.lit(True), CUTS)
        out.append(rows.agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in ("hit1", "hit3", "hit10", "rr")]).withColumn("variant", F.lit(name)))
    return out[0].unionByName(out[1])


@query
def two_stage_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Five best corpora of a passage by their best section, then the ten best sections in that order."""
    scored = _leading(spark, sf, 10)
    groups = scored.groupBy("query", "corpus").agg(F.max("score").alias("best"))
    groups = ranking.ranked(groups, ["query"], F.desc("best"), F.asc("corpus"), name="group_rank").select("query", "corpus", "group_rank")
    found = ranking.within(scored, groups, on=["query", "corpus"], keep=5, group=("query",), top=10)
    return _named(found, "group_rank", "rank")


@query
def boosted_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Sections ranked by how many of the passage's distinct terms they have, then by score."""
    matched = _leading(spark, sf, 5, order=("matched", "score"), by_corpus=False)
    return _named(ranking.boosted(matched, "matched", group=("query",), top=5), "matched", "rank")


@query
def oracle_section_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The five best sections of each passage within the corpora that contain it."""
    gold = bm25.containing(_corpora(spark, sf), _passages(spark, sf))
    return _named(ranking.only(_leading(spark, sf, 5), gold, ["query", "corpus"]).where("rank <= 5"), "rank")


@query
def random_rank(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded shuffle of every corpus: the first three sections."""
    docs = _corpora(spark, sf).select("corpus", "doc")
    return ranking.shuffled(docs, ["corpus"]).where("rank <= 3").select(F.col("corpus").alias("source"), F.col("doc").alias("doc_id"), "rank")


@query
def section_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of a conversation as paragraphs, roles as sections: one text per conversation and role."""
    rows = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("corpus"), F.col("turn").alias("pos"), F.col("role").alias("section_path"), F.upper("role").alias("section_title"), "text"
    )
    built = bm25.section_documents(rows, F.col("text"))
    return built.select(F.col("corpus").alias("conv_id"), F.col("doc").alias("role"), F.col("idx").cast("long").alias("idx"), "title", F.md5("text").alias("text_md5"))


@query
def containing_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that contain a passage whatever its case."""
    return _named(bm25.containing(_corpora(spark, sf), _passages(spark, sf), folded=True))


# --- classifiers: labels.quality is the label, sources from src5 on are the test split ---------------------------------

MODELS = ["length", "clean", "blend"]


def _trigger(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    rows = docs.join(table(spark, sf, "labels"), "doc_id")
    scaled = metrics.normalised(rows.withColumn("_n", F.least("n_chars", F.lit(4000))), "_n", "length").drop("_n")
    scored = scaled.withColumns({"clean": (1 - F.col("toxic")).cast("double"), "label": F.col("quality")})
    return scored.withColumn("blend", F.round(blend("length", "clean", 0.65), 9)).withColumn("split", split_label("source", "src5"))


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.unpivoted(_trigger(spark, sf).select("split", "label", *MODELS), ["split", "label"], MODELS)


@query
def trigger_auroc(spark: SparkSession, sf: str) -> DataFrame:
    """AUROC by split and model, ties counted half and counted in favour."""
    rows = _long(spark, sf)
    plain = metrics.auroc(rows, ["split", "model"]).select("split", "model", F.round("auroc", 6).alias("auroc"), "pos", "neg")
    best = metrics.auroc(rows, ["split", "model"], ties="optimistic").select("split", "model", F.round("auroc", 6).alias("auroc_optimistic"))
    return plain.join(best, ["split", "model"])


@query
def trigger_best_f1(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold with the best F1 by split and model."""
    cols = [F.round(c, 6).alias(c) for c in ("threshold", "f1", "precision", "recall")]
    return metrics.best_f1(_long(spark, sf), ["split", "model"]).select("split", "model", *cols)


@query
def trigger_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Every model over all rows and both splits."""
    splits = {"all": F.lit(True), "dev": F.col("split") == "dev", "test": F.col("split") == "test"}
    rows = metrics.evaluation(_trigger(spark, sf), MODELS, splits)
    return rows.select("split", "model", *[F.round(c, 6).alias(c) for c in ("auroc", "f1", "threshold")], "threshold_source")


@query
def trigger_fixed_thr(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion counts and rates at 0.5."""
    found = metrics.at_threshold(_long(spark, sf), ["split", "model"], F.lit(0.5))
    return found.select("split", "model", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


@query
def trigger_dev_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The test split at the development split's best threshold."""
    found = metrics.transferred(_long(spark, sf), ["model"], F.col("split") == "dev", F.col("split") == "test")
    return found.select("model", F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", "tn", F.round("f1", 6).alias("f1"))


@query
def random_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A score for every labelled document from its id and a seed."""
    return sampling.random_scores(table(spark, sf, "labels").select("doc_id"), "doc_id").select("doc_id", F.round("score", 9).alias("score"))


@query
def length_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Upper median, mean and extremes of the ratio of a document's length to its source's, by language."""
    rows = table(spark, sf, "documents").select("lang", length_ratio("source", "text").alias("ratio"))
    rest = rows.groupBy("lang").agg(F.count("ratio").alias("n"), F.round(F.avg("ratio"), 6).alias("mean"), F.min("ratio").alias("low"), F.max("ratio").alias("high"))
    return rest.join(metrics.upper_median(rows, ["lang"], "ratio"), "lang")


@query
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents per language and source, most frequent first."""
    return metrics.value_counts(table(spark, sf, "documents"), "lang", "source")


@query
def label_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How often a document's two labels agree, by source."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rows.groupBy("source").agg(F.round(metrics.agreement(F.col("quality"), F.col("toxic")), 6).alias("agreement"), F.count("*").alias("n"))


# --- citations: an order is a citation of its customer against the customer's nation -----------------------------------


def _cited(spark: SparkSession, sf: str) -> DataFrame:
    orders, customers, nations = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).join(nations, customers.c_nationkey == nations.n_nationkey)
    name = F.concat("c_name", F.lit(" v. "), "n_name")
    key, year = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yy")
    kind = F.substring("o_orderpriority", 1, 1)
    text = (
        F.when(kind == "1", F.concat(name, F.lit(", ECHR "), F.date_format("o_orderdate", "yyyy"), F.lit("-I")))
        .when(kind == "2", F.concat(name, F.lit(", nos. "), key, F.lit("/"), year, F.lit(" and "), key, F.lit("1/"), year, F.lit(", "), F.date_format("o_orderdate", "d MMMM yyyy")))
        .when(kind == "3", F.concat(name, F.lit(", judgment of "), F.date_format("o_orderdate", "d MMMM yyyy")))
        .otherwise(F.concat(name, F.lit(", no. "), key, F.lit("/"), year, F.lit(", "), F.date_format("o_orderdate", "d MMMM yyyy")))
    )
    return rows.select("o_orderkey", "o_orderdate", "o_custkey", "n_name", text.alias("citation"))


@query
def citation_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Name, numbers, year and key of every citation."""
    parsed = cite.with_case(_cited(spark, sf).select("o_orderkey", "citation"), "citation", ascii_only=True)
    return parsed.select(
        "o_orderkey", "case_name", F.array_join("application_numbers", "|").alias("application_numbers"), "judgment_year", "case_key", cite.is_case("case_name").alias("is_case")
    )


@query
def suspicious_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Reasons for which citations look damaged, counted."""
    return audit.reasons(_cited(spark, sf).unionByName(_cited(spark, sf).withColumn("citation", F.expr("substr(citation, 20)"))))


def _appearances(spark: SparkSession, sf: str) -> DataFrame:
    lines, parts, suppliers, nations = (table(spark, sf, t) for t in ("lineitem", "part", "supplier", "nation"))
    rows = (
        lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
        .join(suppliers, lines.l_suppkey == suppliers.s_suppkey).join(nations, suppliers.s_nationkey == nations.n_nationkey)
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "n_name").join(parts, F.col("l_partkey") == parts.p_partkey)  # last, so that lines lie by part
    )
    quarter = F.date_format(F.date_trunc("quarter", "l_shipdate"), "yyyyMMdd")
    return rows.select(
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("case_key"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("idx"),
        F.col("p_name").alias("case_name"), F.concat_ws(", ", "p_name", "p_brand").alias("citation"), F.col("n_name").alias("guide_id"),
        F.concat(F.lit("Guide "), "n_name").alias("guide_title"), quarter.alias("timestamp"), F.concat_ws("__", quarter, "n_name").alias("pdf_name"), F.col("l_partkey").alias("part"),
    )


@query
def case_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as cases, supplier nations as guides, quarters as snapshots: one row per part."""
    found = catalog.case_catalog(_appearances(spark, sf).withColumn("case_key", F.col("part")))
    return found.withColumns({"case_key": F.concat(F.lit("part:"), F.col("case_key").cast("string"))} | {c: F.array_join(c, "|") for c in ("guide_ids", "guide_titles")})


@query
def case_guides(spark: SparkSession, sf: str) -> DataFrame:
    """One row per part and supplier nation."""
    return catalog.case_guides(_appearances(spark, sf))


@query
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that a nation's list gained and lost from one quarter to the next."""
    lists = _appearances(spark, sf).select("guide_id", "timestamp", "part").distinct()
    pairs = versions.consecutive(lists)
    side = lambda c: lists.withColumnRenamed("timestamp", c).join(pairs, ["guide_id", c])
    changed = versions.key_difference(side("from_version"), side("to_version"), ["guide_id", "from_version", "to_version", "part"])
    return changed.groupBy("guide_id", "from_version", "to_version", "change").agg(
        F.count("*").alias("n"), F.min("part").alias("least"), F.max("part").alias("most"), F.sum("part").alias("total")
    )


@query
def sticky_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of quarters between which a nation's set of suppliers changed, with a base that stays while nothing does."""
    suppliers, lines, nations = (table(spark, sf, t) for t in ("supplier", "lineitem", "nation"))
    rows = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).join(nations, suppliers.s_nationkey == nations.n_nationkey)
    lists = rows.select(F.col("n_name").alias("guide_id"), F.date_format(F.date_trunc("quarter", "l_shipdate"), "yyyyMMdd").alias("timestamp"), "l_suppkey").distinct()
    content = lists.groupBy("guide_id", "timestamp").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l_suppkey")), lambda x: x.cast("string")), ",").alias("content"))
    return versions.sticky_pairs(content)


@query
def keyed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """First and last order of each customer by key."""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    first, last = (catalog.first_rows(rows, ["o_custkey"], "o_orderkey", last=x) for x in (False, True))
    return first.join(last.select("o_custkey", F.col("o_orderkey").alias("last_order"), F.col("o_orderpriority").alias("last_priority")), "o_custkey")


@query
def resolution_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of customers resolved against judgments made of every other kind of order."""
    cited = cite.with_case(_cited(spark, sf).select("o_orderkey", "citation"), "citation")
    rows = cited.select(F.col("o_orderkey").cast("string").alias("case_key"), "case_name", "application_numbers", "judgment_year", F.col("citation").alias("citation_example"))
    held = _cited(spark, sf).where("o_orderkey % 3 <> 1")
    judgments = held.select(
        F.concat(F.lit("001-"), F.col("o_orderkey").cast("string")).alias("itemid"), F.array_join(cite.application_numbers("citation"), ";").alias("appno"),
        F.concat(F.lit("CASE OF "), F.upper(cite.case_name("citation", ascii_only=True))).alias("docname"), F.when(F.col("o_orderkey") % 3 == 0, "HEJUD").otherwise("CLIN").alias("doctype"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("kpdate"), F.lit("ENG").alias("languageisocode"), F.lit("").alias("ecli"),
    )
    return catalog.resolved(rows, judgments).groupBy("match_status", "match_method").agg(F.count("*").alias("n"))


# --- links, flags, edit types, the cascade -------------------------------------------------------------------------------


@query
def link_theta_join(spark: SparkSession, sf: str) -> DataFrame:
    """Passages and the documents that contain them, with the rules that hold."""
    docs, passages = _corpora(spark, sf), _passages(spark, sf)
    exact = bm25.containing(docs, passages).withColumn("exact", F.lit("paragraph_text_exact"))
    loose = bm25.containing(docs, passages, folded=True)
    rows = loose.join(exact, ["query", "corpus", "doc"], "left")
    rules = F.array_compact(F.array("exact", F.lit("paragraph_text_folded")))
    order = Window.partitionBy("query").orderBy("corpus", "doc")
    out = rows.withColumn("strategies", F.array_join(rules, "|")).withColumn("paragraph_rank", F.row_number().over(order))
    return _named(out, "strategies", "paragraph_rank")


@query
def strategy_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per linking rule."""
    return linking.strategy_counts(link_theta_join(spark, sf).withColumn("match_strategies", F.split("strategies", r"\|")))


@query
def usable_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as linked rows: labelled ones are linked, long ones located, texts are at hand for English ones."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    one = lambda test, value: F.when(test, F.array(value)).otherwise(F.array().cast("array<string>"))
    rows = docs.join(labels, "doc_id", "left").select(
        "doc_id", F.col("doc_id").cast("string").alias("itemid"), F.when(F.col("quality").isNotNull(), "linked_paragraphs").otherwise("no_paragraph_link").alias("link_status"),
        one(F.col("n_chars") > 500, F.col("source")).alias("linked_sections"), one(F.col("lang") != "de", F.col("lang")).alias("linked_change_types"),
        F.when(F.col("quality") == 1, "added").otherwise("removed").alias("change"), F.col("text").alias("post_text"),
        one(F.coalesce(F.col("toxic") == 1, F.lit(False)), F.lit("citation_field_case_key")).alias("match_strategies"),
    )
    texts = docs.select(F.col("doc_id").cast("string").alias("itemid"), F.when(F.col("lang") == "en", "ok").otherwise("failed").alias("status"), F.concat(F.lit("texts/"), "doc_id").alias("path"), F.col("n_chars").alias("chars"))
    flags = [f"usable_for_{x}" for x in ("relevance", "location", "edit_type", "generation")] + ["strict_citation_field_match", "case_text_available"]
    return linking.with_flags(rows, texts).select("doc_id", *flags, "case_text_path", "case_text_chars")


def _paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.create_map(*[F.lit(x) for pair in {
        "RF": "citation_removed", "RO": "reformulation", "AF": "citation_updated", "AO": "paragraph_added", "NF": "citation_added", "NO": "minor_edit",
    }.items() for x in pair])
    flag = F.concat("l_returnflag", "l_linestatus")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), kind[flag].alias("change_type"), (1 - F.col("l_discount") * 2).alias("similarity"),
        F.when(F.col("l_quantity") > 25, F.lit("before")).otherwise(F.lit("")).alias("text_a"), F.when(F.col("l_tax") < 0.07, F.lit("after")).otherwise(F.lit(" ")).alias("text_b"),
    )


@query
def edit_type(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as rows and their lines as paragraphs; flags of the lines stand for change classes."""
    types = F.split(F.when(F.col("o_orderpriority") == "1-URGENT", "section_modified").when(F.col("o_orderpriority") == "2-HIGH", "section_removed").otherwise("paragraph_added"), ",")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "P", "removed").otherwise("added").alias("change"), types.alias("linked_change_types"),
        F.col("o_orderpriority").alias("pre_text"), F.repeat(F.lit("x"), (F.col("o_custkey") % 17).cast("int")).alias("post_text"),
    )
    found = linking.edit_types(rows, _paragraphs(spark, sf), ["o_orderkey"])
    return found.select("o_orderkey", "edit_type", "subtype", "confidence", "legacy_edit_type")


@query
def edit_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Edit types and subtypes, with how often the older rule agrees."""
    rows = edit_type(spark, sf)
    return rows.groupBy("edit_type", "subtype").agg(F.count("*").alias("n"), F.round(metrics.agreement(F.col("edit_type"), F.col("legacy_edit_type")), 6).alias("agreement"))


@query
def pipeline_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Trigger at the development threshold, then location, then edit type; of repeated keys the last and the first count."""
    rows = _trigger(spark, sf).select("doc_id", "split", "label", F.col("blend").alias("score"))
    report = metrics.best_f1(rows.where("split = 'dev'"), ["split"]).withColumn("model", F.lit("blend"))
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    retrieval = docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("idx"), "lang", "n_chars")
    retrieval = retrieval.select("doc_id", "idx", F.when(F.col("idx") == 1, 0).otherwise((F.col("lang") == "en").cast("int")).alias("hit1"))
    edits = docs.select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("idx"), "n_chars")
    edits = edits.select("doc_id", "idx", F.when(F.col("idx") == 2, "never").when(F.col("n_chars") > 1500, "revise_text").otherwise("add_citation").alias("edit_type"))
    threshold = linking.threshold_of(report, "blend")
    joined = rows.crossJoin(F.broadcast(threshold))  # one row
    return linking.cascade_metrics(linking.cascade(joined, retrieval, edits, F.col("threshold"), ["doc_id"]), ["split"])


# --- windows, negatives, samples ------------------------------------------------------------------------------------------


@query
def negatives_topk(spark: SparkSession, sf: str) -> DataFrame:
    """A nation's month is a transition, its customers that month are the positives; the newest orders of others."""
    cited = _cited(spark, sf).select("o_orderkey", "o_orderdate", "o_custkey", "n_name")
    month = F.date_trunc("month", "o_orderdate").cast("date")
    cited = cited.withColumns({"id": F.concat_ws("|", "n_name", month.cast("string")), "from_date": month, "to_date": F.last_day(month)})
    transitions = cited.select("id", "from_date", "to_date").distinct()
    candidates = cited.select(F.col("o_orderkey").alias("item"), F.col("o_orderdate").alias("at"), F.array(F.col("o_custkey").cast("string")).alias("apps"))
    positives = cited.select("id", F.col("o_custkey").cast("string").alias("key"))
    return sampling.negatives(candidates, transitions, positives).select("id", "item", "rank")


@query
def window_join(spark: SparkSession, sf: str) -> DataFrame:
    """Events per window of days, where windows begin at the days on which errors happened and overlap."""
    events = table(spark, sf, "events")
    days = events.where("event_type = 'error' and value > 40").select(F.to_date("ts").alias("from_date")).distinct()
    windows = days.withColumn("to_date", F.date_add("from_date", 2))
    return sampling.in_windows(events.select("event_id", "ts"), windows, "ts", days=4).groupBy(F.col("from_date").cast("string").alias("from_date")).agg(F.count("*").alias("n"), F.min("event_id").alias("least"))


@query
def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A hundred documents from languages and sources in turn."""
    return sampling.round_robin(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 100).select("doc_id", "lang", "source", F.col("turn").cast("long").alias("turn"))


@query
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Sixty documents by language in proportion, ten of them long ones."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return sampling.stratified(docs, ["lang"], "doc_id", 60, first=F.col("n_chars") > 4000).select("doc_id", "lang")


# --- versions of texts: turns of a conversation are versions ----------------------------------------------------------------


@query
def section_events(spark: SparkSession, sf: str) -> DataFrame:
    """Words of one turn against the next: gone, new, or written differently."""
    turns = table(spark, sf, "conversations")
    word = F.explode(F.split("text", r"\s+"))
    words = turns.select("conv_id", "turn", word.alias("w")).where("w <> ''").groupBy("conv_id", "turn", F.lower("w").alias("path")).agg(F.min("w").alias("title"), F.count("*").cast("int").alias("level"))
    known = turns.select("conv_id", "turn").distinct()
    a = words.join(known.select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"], "left_semi")
    b = words.withColumn("turn", F.col("turn") - 1).join(known, ["conv_id", "turn"], "left_semi")
    return paragraphs.section_events(a, b, ["conv_id", "turn"])


@query
def unique_text_align(spark: SparkSession, sf: str) -> DataFrame:
    """Words that stand once in a turn and once in the turn two later, at both places."""
    words = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", r"\s+")).alias("order", "w")).select("conv_id", "turn", "order", F.lower("w").alias("norm_text"))
    return paragraphs.unique_text_pairs(words, words.withColumn("turn", F.col("turn") - 2), ["conv_id", "turn"])


@query
def asof_section(spark: SparkSession, sf: str) -> DataFrame:
    """Each event of a user with the latest sign-up at or before it, the first one before any."""
    events = table(spark, sf, "events")
    anchors = events.where("event_type = 'signup'").select("user_id", "ts", "event_id", F.col("event_id").alias("section"))
    blocks = events.where("event_type <> 'signup'").select("user_id", "ts", "event_id")
    return paragraphs.as_of(blocks, anchors, ["user_id"], ["ts", "event_id"], "section").select("event_id", "section")


@query
def law_section_split(spark: SparkSession, sf: str) -> DataFrame:
    """Documents set between the headings of a judgment, with one heading missing in some languages."""
    head = F.when(F.col("lang") != "fr", "THE FACTS").otherwise("FACTS")
    stop = F.when(F.col("lang") != "es", "FOR THESE REASONS, THE COURT").otherwise("END")
    made = F.concat_ws("\n", head, "text", F.lit("The Law"), "source", "text", stop, "lang")
    parts = table(spark, sf, "documents").select("doc_id", judgment_sections(made).alias("s"))
    return parts.select("doc_id", *[F.md5(f"s.{x}").alias(x) for x in ("facts", "law", "operative", "first_half")])


@query
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of the JSON in events, by type of event."""
    props = F.from_json("props", "map<string,int>")
    rows = table(spark, sf, "events").select("event_type", F.explode(props).alias("key", "value"))
    return rows.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Visible text of pages."""
    text = strip_tags("html")
    return table(spark, sf, "pages").select("page_id", F.md5(text).alias("text_md5"), F.length(text).cast("long").alias("n_chars"))


@query
def dataset_reaudit(spark: SparkSession, sf: str) -> DataFrame:
    """Two editions of each source's list of documents: one without German, one without French ones."""
    docs = table(spark, sf, "documents")

    def edition(but: str) -> DataFrame:
        rows = docs.where(F.col("lang") != but).withColumn("id", F.col("doc_id").cast("string"))
        return rows.groupBy("source").agg(F.array_sort(F.collect_list("id")).alias("added"), F.array_sort(F.collect_set("lang")).alias("removed"))

    found = audit.compared(edition("de"), edition("fr").where("source <> 'src3'"), ["source"])
    lists = [f"{c}_only_{s}" for c in ("added", "removed") for s in ("reference", "local")]
    return found.select("source", "state", *[F.array_join(c, "|").alias(c) for c in lists])


@query
def mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of a source's documents that name the passage given to that source."""
    pages = table(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    cited = table(spark, sf, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("doc"), F.substring("text", 1, 12).alias("citation"))
    found = body.mentions(pages, cited)
    return found.select(F.col("doc").alias("source"), "citation", F.col("page").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.md5("paragraph").alias("paragraph_md5"))


@query
def mention_summary(spark: SparkSession, sf: str) -> DataFrame:
    """One line about the mentions of each passage."""
    pages = table(spark, sf, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text")
    cited = table(spark, sf, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("doc"), F.substring("text", 1, 12).alias("citation"))
    return body.summaries(body.mentions(pages, cited), ["doc", "citation"])


# --- order-dependent operators: no SQL says what they do -------------------------------------------------------------------


@query
def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    """Part names of one brand that mean the same but for spelling. A similarity of 0.93 leaves at most 7 in 100 of both
    forms' characters unmatched, so no pair with a larger edit distance is lost by not comparing it further."""
    parts = table(spark, sf, "part").select("p_brand", F.concat_ws(" ", "p_name", "p_type").alias("name"), "p_partkey")
    names = parts.select("p_brand", "name").distinct().withColumn("form", match_form(cite.simple_case_name("name")))
    # Different names are compared once, either way round since similarity isn't symmetric; parts of a name share the answer.
    both = names.alias("a").join(names.alias("b"), "p_brand").select("p_brand", F.col("a.name").alias("x"), F.col("b.name").alias("y"), F.col("a.form").alias("p"), F.col("b.form").alias("q"))
    close = both.where("100 * levenshtein(p, q) <= 7 * (length(p) + length(q)) + 1e-6").select("p_brand", "x", "y")
    alike = close.where(alike_without_number("x", "y"))
    side = lambda key, name: parts.select("p_brand", F.col("name").alias(name), F.col("p_partkey").alias(key))
    return side("a", "x").join(alike, ["p_brand", "x"]).join(side("b", "y"), ["p_brand", "y"]).where("a < b").select("a", "b")


@query
def paragraph_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of a conversation's turn against the turn two later, as numbered paragraphs."""
    piece = F.posexplode(F.split("text", r"\.\s*"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", piece.alias("order", "text")).where("trim(text) <> ''")
    rows = paragraphs.described(rows.select(
        F.concat_ws("|", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pair"), "order", (F.col("order") + 1).alias("para_num"),
        F.col("role").alias("section_path"), F.upper("role").alias("section_title"), F.lit(1).alias("section_level"), "text",
    )).persist()  # comparison forms are worked out in Python; either side's are used in several joins
    later = rows.withColumn("pair", F.concat_ws("|", F.substring_index("pair", "|", 1), (F.substring_index("pair", "|", -1).cast("long") - 2).cast("string")))
    later = later.join(rows.select("pair").distinct(), "pair", "left_semi")
    earlier = rows.join(later.select("pair").distinct(), "pair", "left_semi")
    none = spark.createDataFrame([], "pair string, change string, citation string")
    return paragraphs.changes(earlier, later, none).groupBy("change_type").agg(F.count("*").alias("n"), F.round(F.avg("similarity"), 3).alias("similarity"))


@query
def cited_list_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Citations wrapped over lines, put together again, in one list for each nation."""
    rows = _cited(spark, sf).withColumn("piece", F.split("citation", r"(?<=,) "))
    numbered = rows.select(F.col("n_name").alias("doc"), "o_orderkey", F.posexplode("piece").alias("k", "text"))
    lines = numbered.select("doc", (F.col("o_orderkey") * 10 + F.col("k") + 10).alias("line_no"), "text")
    opening = spark.createDataFrame([(-2, versions.LIST_HEADER), (-1, "— A —")], "line_no long, text string")
    head = table(spark, sf, "nation").select(F.col("n_name").alias("doc")).distinct().crossJoin(opening)
    return versions.cited_lists(head.unionByName(lines)).select("doc", "pos", "citation")


@query
def rouge_l_scores(spark: SparkSession, sf: str) -> DataFrame:
    """How alike each answer is to the question before it."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", rouge_l("text", "reference").alias("rouge_l"))


@query
def name_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison forms of names, by how many spellings share one."""
    rows = _cited(spark, sf).select(match_form(cite.case_name("citation")).alias("form"), "citation")
    return rows.groupBy("form").agg(F.count_distinct("citation").alias("spellings"))


# --- rows of evaluations: customers and documents stand in for them -------------------------------------------------------


@query
def query_builders(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as cases: the three orders in which searches put name, application numbers and citation."""
    rows = table(spark, sf, "customer").withColumn("apps", F.concat_ws("|", F.concat_ws("/", "c_custkey", "c_nationkey"), F.concat_ws("/", "c_nationkey", F.lit("01"))))
    built = {
        "apps_first": query_tokens("c_name", "apps", "c_mktsegment"), "citation_first": query_tokens("c_name", "apps", "c_mktsegment", citation_first=True),
        "base": query_tokens("c_name", "apps"),
    }
    return rows.select("c_custkey", *[F.array_join(v, " ").alias(k) for k, v in built.items()])


def _generated(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    types = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("subtype"), F.col("quality").alias("order"))
    rows = docs.join(labels.select("doc_id", "quality"), "doc_id", "left").withColumn("split", split_label("source", "src5"))
    return linking.with_subtype(rows.withColumn("said", F.when(F.col("lang") == "en", F.col("text")).otherwise("")), types, ["doc_id"], "order")


@query
def subtype_means(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as generated texts, empty unless English; labels give the subtype where there are any."""
    return metrics.means(_generated(spark, sf), ["split", "subtype"], ["quality", "n_chars"], said="said")


@query
def base_rates(spark: SparkSession, sf: str) -> DataFrame:
    """English documents as positives and the others as negatives: rate, and words of both lists, by source."""
    docs = table(spark, sf, "documents").select("source", "lang", F.split("text", " ").alias("words"))
    rows = linking.labelled_union(docs.where("lang = 'en'"), docs.where("not coalesce(lang = 'en', false)").drop("lang"))
    lists = metrics.total_length(F.col("words"), F.array(F.col("lang")))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.round(metrics.base_rate(F.col("label")), 6).alias("base_rate"), lists.alias("elements"))


@query
def gold_in_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's segment is gold; a nation's corpus holds the segments of its customers with over 9,000."""
    rows = table(spark, sf, "customer")
    held = rows.where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("held"))  # of few segments
    rate = metrics.gold_in_corpus_rate(F.array("c_mktsegment"), F.col("held"))
    return rows.join(held, "c_nationkey", "left").groupBy("c_nationkey").agg(F.count("*").alias("n"), rate.alias("rate"))


@query
def carried_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their labels, as text with "" for what is missing."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return linking.carried(rows, ["doc_id", "lang", "quality", "toxic", "importance"])


@query
def segment_menu(spark: SparkSession, sf: str) -> DataFrame:
    """Segments in order, each with its last customer."""
    return versions.menu(table(spark, sf, "customer"), "c_mktsegment", "c_custkey", "c_custkey")
