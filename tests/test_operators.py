import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from stemmata.operators import audit, bm25, catalog, linking, mentions, metrics, paragraphs, ranking, sampling, versions


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("k", 0, "a b b"), ("k", 1, "a c"), ("k", 2, "a d d d")], "corpus string, doc int, text string")
    index = bm25.index(docs)
    idf = {r.term: r.idf for r in index.terms.collect()}
    rare, common = math.log(2.5) - math.log(1.5), math.log(0.5) - math.log(3.5)
    assert idf["b"] == pytest.approx(rare)
    assert idf["a"] == pytest.approx(0.25 * (3 * rare + common) / 4)
    terms = bm25.query_terms(spark.createDataFrame([(1, "k", "b b a")], "query int, corpus string, text string"))
    got = {r.doc: r.score for r in bm25.scores(terms, index).collect()}
    want = 2 * rare * 2 * 2.5 / (2 + 1.5 * 1.0) + idf["a"] * 2.5 / (1 + 1.5)
    assert got[0] == pytest.approx(want, abs=1e-8) and got[2] != 0
    once = bm25.leading_terms(spark.createDataFrame([(1, "k", "b b zz"), (2, "k", "yy zz")], "query int, corpus string, text string"), index)
    assert {(r.query, r.term) for r in once.collect()} == {(1, "b"), (2, "yy"), (2, "zz")}
    asked = spark.createDataFrame([(1, "k", "b"), (2, "none", "b")], "query int, corpus string, text string")
    best = {r.query: r.score for r in bm25.max_scores(asked, bm25.query_terms(asked), index).collect()}
    assert best[1] > 0 and best[2] == 0


def test_rank_metrics(spark):
    rows = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "query int, rank int, gold boolean")
    got = {r.query: (r.hit1, r.hit3, r.rr) for r in ranking.hits(rows, ["query"], F.col("gold")).collect()}
    assert got == {1: (0, 1, 0.5), 2: (0, 0, 0.0)}
    out = {r.slice: (r.n, r.rr) for r in ranking.sliced(spark.createDataFrame([(1, 1.0), (2, 0.5)], "q int, rr double"), {"all": F.lit(True), "one": F.col("q") == 1, "none": F.col("q") > 9}, ["rr"]).collect()}
    assert out == {"all": (2, 0.75), "one": (1, 1.0), "none": (0, None)}


def test_auroc_modes(spark):
    rows = [(1, 1)] * 584 + [(0, 1)] * 221 + [(1, 0)] * 248 + [(0, 0)] * 2842
    df = spark.createDataFrame(rows, "score int, label int")
    got = {m: metrics.auroc(df, [], ties=m).first().auroc for m in ("midrank", "optimistic", "pessimistic")}
    assert got["optimistic"] == pytest.approx(0.97797, abs=1e-5) and got["midrank"] == pytest.approx(0.82260, abs=1e-5)
    assert got["midrank"] == pytest.approx((got["optimistic"] + got["pessimistic"]) / 2)


def test_best_f1_against_all_thresholds(spark):
    draw = random.Random(4)
    rows = [(draw.randrange(8) / 8, int(draw.random() < 0.4)) for _ in range(200)]
    got = metrics.best_f1(spark.createDataFrame(rows, "score double, label int"), []).first()

    def f1(t):
        tp = sum(s >= t and y for s, y in rows)
        return 2 * tp / (sum(s >= t for s, _ in rows) + sum(y for _, y in rows))

    best = max(f1(t) for t, _ in rows)
    assert got.f1 == pytest.approx(best) and got.threshold == min(t for t, _ in rows if f1(t) == best)


def test_upper_median(spark):
    for values in ([1.0, 2.0], [3.0, 1.0, 2.0], [5.0], [1.0, 1.0, 1.0, 9.0]):
        got = metrics.upper_median(spark.createDataFrame([(v,) for v in values], "v double"), [], "v").first().median
        assert got == sorted(values)[len(values) // 2]


def test_snapshot_diff(spark):
    base = ["A v. Malta, no. 1/02", "Old v. Italy, 1987", "Smithson v. Greece, 1990", "Gone v. Spain, no. 3/04"]
    now = ["A v. Malta, no. 1/02, 4 May 2010", "Smithsen v. Greece, 1990", "New v. France, 1999", "B v. Peru, no. 9/99"]
    df = lambda xs: spark.createDataFrame([("p", k, c) for k, c in enumerate(xs)], "pair string, pos int, citation string")
    got = sorted((r.change, r.citation) for r in versions.snapshot_diff(df(base), df(now)).collect())
    assert got == sorted([("added", now[2]), ("added", now[3]), ("removed", base[1]), ("removed", base[3])])
    grouped = versions.grouped_diffs(versions.snapshot_diff(df(base), df(now)), ["pair"])
    flat = versions.flattened(grouped, ["pair"]).orderBy("pos").collect()
    assert [r.change for r in flat] == ["added", "added", "removed", "removed"]


def test_sticky_baseline(spark):
    rows = [("g", "1", "a"), ("g", "2", "b"), ("g", "3", "b"), ("g", "4", None), ("g", "5", "c"), ("h", "1", "x")]
    got = versions.sticky_pairs(spark.createDataFrame(rows, "guide_id string, timestamp string, content string")).collect()
    assert sorted((r.from_version, r.to_version) for r in got) == [("1", "2"), ("2", "5")]


def test_cited_lists(spark):
    lines = [
        "Contents", "List of cited cases", "Updated: 1", "— A —", "Abc v. Malta, no. 1/02, 4 May 2010", "12/34", "Bcd and Others", "v. Italy, nos. 3/04 and", "5/06, ECHR 1999-II",
        "— C —", "Advisory opinion on x, request no.", "P16-2018-001", "Guide on Article 6", "",
    ]
    df = spark.createDataFrame([("d", k, t) for k, t in enumerate(lines)], "doc string, line_no int, text string")
    got = [r.citation for r in versions.cited_lists(df).orderBy("pos").collect()]
    assert got == ["Abc v. Malta, no. 1/02, 4 May 2010", "Bcd and Others v. Italy, nos. 3/04 and 5/06, ECHR 1999-II", "Advisory opinion on x, request no. P16-2018-001"]


def paras(spark, rows):
    return paragraphs.described(spark.createDataFrame([("p", k, n, s, "T" + s, 1, t) for k, (n, s, t) in enumerate(rows)], "pair string, order int, para_num int, section_path string, section_title string, section_level int, text string"))


def test_paragraph_changes(spark):
    long = "The Court has held in a long line of cases that the right must be effective and practical"
    a = [(1, "I", "Same text here."), (2, "I", "Moved along."), (3, "I", long + " in all circumstances of life."), (4, "I", long + " and so on until the end."), (5, "I", "Leaves for good, nothing like it."), (6, "I", long + " as the Grand Chamber said in its last word on this"), ]
    b = [(1, "I", "Same text here."), (2, "II", "Moved along."), (3, "I", long + " in all circumstances of life!?x"), (4, "I", long + " and so on until the end (A v. Malta)."), (6, "II", long + " as the Grand Chamber said in its last word on thiz"), (7, "II", "Comes in new with B v. Italy.")]
    cited = spark.createDataFrame([("p", "added", "A v. Malta, no. 1/02"), ("p", "added", "B v. Italy, 1990")], "pair string, change string, citation string")
    rows = paragraphs.changes(paras(spark, a), paras(spark, b), cited)
    got = {(r.para_num_a, r.para_num_b): (r.change_type, r.citations_added) for r in rows.collect()}
    assert got == {
        (1, 1): ("unchanged", []), (2, 2): ("section_moved", []), (3, 3): ("minor_edit", []), (4, 4): ("citation_added", ["A v. Malta, no. 1/02"]),
        (5, None): ("paragraph_deleted", []), (6, 6): ("section_moved_modified", []), (None, 7): ("paragraph_added", ["B v. Italy, 1990"]),
    }
    events = paragraphs.section_events(
        spark.createDataFrame([("p", "I", "One", 1), ("p", "II", "Two", 1)], "pair string, path string, title string, level int"),
        spark.createDataFrame([("p", "II", "Zwei", 1), ("p", "III", "Three", 1)], "pair string, path string, title string, level int"), ["pair"],
    )
    assert {(r.path, r.change_type) for r in events.collect()} == {("I", "section_deleted"), ("II", "section_title_changed"), ("III", "section_added")}
    whole = paragraphs.diff_documents(rows, events, cited, spark.createDataFrame([("p", "G", "2020-01-01", "2020-01-31")], "pair string, guide_title string, version_a string, version_b string")).first()
    assert whole.delta_days == 30 and whole.summary.total_para_changes == 7 and len(whole.paragraph_changes) == 7 and whole.summary.cited_cases_added == 2


def test_extraction(spark):
    toc = spark.createDataFrame([("d", 1, 1, "I. First", 1, 100.0), ("d", 2, 2, "A. Part", 1, 300.0), ("d", 3, 1, "Second", 2, 50.0)], "doc string, pos int, level int, raw_title string, page_number int, y double")
    anchors = paragraphs.section_paths(toc)
    assert [r.path for r in anchors.orderBy("pos").collect()] == ["I", "I.A", "§3"]
    blocks = [
        (0, 10, "Guide on Article 6"), (0, 90, "left out before a number"), (0, 101, "I. First"), (0, 120, "lost between"), (0, 140, "1. Opens here"), (0, 160, "and goes on"),
        (0, 301, "A. Part"), (0, 320, "2. Next one"), (0, 790, "European Court of Human Rights 3/9"), (1, 20, "across pages"), (1, 51, "Second"), (1, 70, "3. Last"),
    ]
    df = spark.createDataFrame([("d", p, 800.0, 50.0, float(y), t) for p, y, t in blocks], "doc string, page int, height double, x double, y double, text string")
    got = [(r.para_num, r.section_path, r.text) for r in paragraphs.extracted(df, anchors).orderBy("order").collect()]
    assert got == [(1, "I", "Opens here and goes on"), (2, "I.A", "Next one across pages"), (3, "§3", "Last")]


def test_as_of(spark):
    blocks = spark.createDataFrame([("u", 1), ("u", 5), ("u", 9), ("v", 1)], "g string, t int")
    anchors = spark.createDataFrame([("u", 5, "x"), ("u", 7, "y")], "g string, t int, s string")
    got = {(r.g, r.t): r.s for r in paragraphs.as_of(blocks, anchors, ["g"], ["t"], "s").collect()}
    assert got == {("u", 1): "x", ("u", 5): "x", ("u", 9): "y", ("v", 1): None}


def test_linking(spark):
    changes = spark.createDataFrame([(1, "g", "a", "b", "added", "A v. Malta, no. 1/02"), (2, "g", "a", "b", "removed", "B v. Italy, 1990"), (3, "g", "a", "z", "added", "C v. Spain, no. 9/99")], "row_id int, guide_id string, from_date string, to_date string, change string, citation_text string")
    paras_ = spark.createDataFrame([
        ("g", "a", "b", "I", "T", 1, 1, "citation_added", "old", "see A v. Malta, 1/02", ["A v. Malta, no. 1/02"], []),
        ("g", "a", "b", "I", "T", 2, 2, "reformulation", "cf. B v. Italy and 1/02", "nothing", [], []),
        ("g", "a", "b", "II", "", None, 4, "paragraph_added", None, "only 1/02 here", [], []),
    ], "guide_id string, from_date string, to_date string, section_path string, section_title string, para_num_a int, para_num_b int, change_type string, text_a string, text_b string, citations_added array<string>, citations_removed array<string>")
    known = spark.createDataFrame([("apps:1/02", "001-1")], "case_key string, itemid string")
    links = linking.linked(changes, paras_, known)
    got = {(r.row_id, r.para_num_b): r.strategies for r in links.collect()}
    assert got[1, 1] == ["citation_field_case_key", "paragraph_text_name_match", "paragraph_text_app_match"]
    assert got[1, 4] == ["paragraph_text_app_match"] and got[2, 2] == ["paragraph_text_name_match"] and len(got) == 3
    rows = {r.row_id: r for r in linking.linked_rows(changes, links, paras_).collect()}
    assert [rows[k].link_status for k in (1, 2, 3)] == ["linked_paragraphs", "linked_paragraphs", "diff_pair_missing"]
    assert rows[1].linked_sections == ["I: T", "II"] and rows[1].pre_text == "old" and rows[1].post_text.count("\n\n") == 1
    assert {r.strategy: r.n for r in linking.strategy_counts(linking.linked_rows(changes, links, paras_)).collect()}["paragraph_text_name_match"] == 2


def test_edit_types(spark):
    rows = spark.createDataFrame([(1, "added"), (2, "removed"), (3, "added"), (4, "added"), (5, "added")], "k int, change string").withColumns(
        {"linked_change_types": F.array().cast("array<string>"), "pre_text": F.lit(""), "post_text": F.lit("")})
    paras_ = spark.createDataFrame([
        (1, "paragraph_added", None, "", "x"), (3, "reformulation", "0.5", "a", "b"), (4, "citation_updated", "0.97", "a", "b"), (5, "citation_added", "0.96", "a", "b"),
    ], "k int, change_type string, similarity string, text_a string, text_b string")
    got = {r.k: (r.edit_type, r.subtype, r.confidence) for r in linking.edit_types(rows, paras_, ["k"]).collect()}
    assert got == {
        1: ("add_citation", "new_paragraph", "high"), 2: ("remove_citation", "citation_remove", "high"), 3: ("revise_text", "doctrinal_rewrite", "high"),
        4: ("revise_text", "citation_refresh", "medium"), 5: ("add_citation", "citation_insert", "high"),
    }


def test_references_compare_null_safely(spark):
    got = spark.createDataFrame([("I.A|a:None|b:3|II|a:4|b:",)], "x string").select(linking.reference_parts(F.col("x")).alias("r")).first().r
    assert [(r.section_path, r.para_num_a, r.para_num_b) for r in got] == [("I.A", None, 3), ("II", 4, None)]


def test_cascade_takes_last_and_first(spark):
    trigger = spark.createDataFrame([(1, 1, 0.9), (2, 1, 0.9), (3, 0, 0.1)], "k int, label int, score double")
    retrieval = spark.createDataFrame([(1, 1, 0), (1, 2, 1)], "k int, idx int, hit1 int")
    edits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, idx int, edit_type string")
    rows = linking.cascade(trigger, retrieval, edits, F.lit(0.5), ["k"])
    assert {r.k: (r.hit1, r.edit_type) for r in rows.collect()} == {1: (1, "a"), 2: (0, ""), 3: (0, "")}
    m = linking.cascade_metrics(rows, []).first()
    assert (m.tp, m.location_given_trigger, m.pipeline_hit1) == (2, 0.5, 0.5)
    assert linking.threshold_of(spark.createDataFrame([], "split string, model string, threshold double"), "x").first().threshold == 0.5


def test_resolution(spark):
    cases = spark.createDataFrame([
        ("k1", "A v. Malta", ["1/02"], "2010", "A v. Malta, no. 1/02, 4 May 2010"), ("k2", "B v. Italy", ["3/04"], "", "B v. Italy, no. 3/04"),
        ("k3", "C v. Spain", ["5/06"], "", "C v. Spain, no. 5/06"), ("k4", "D v. Greece", [], "1990", "D v. Greece, 1990"), ("k5", "E v. Peru", [], "1991", "E v. Peru, 1991"), ("k6", "F v. Chad", ["7/08"], "1999", "F v. Chad, no. 7/08"),
    ], "case_key string, case_name string, application_numbers array<string>, judgment_year string, citation_example string")
    docs = spark.createDataFrame([
        ("i1", "1/02", "CASE OF A v. MALTA", "HEJUD", "2010-05-04", "ENG", ""), ("i1f", "1/02", "AFFAIRE A c. MALTE", "HFJUD", "2010-05-04", "FRE", ""),
        ("i2", "3/04;4/05", "CASE OF B v. ITALY", "HEJUD", "2001-01-01", "ENG", ""), ("i3", "5/06", "C v. SPAIN", "XX", "2001-01-01", "ENG", ""),
        ("i4", "8/88", "D v. Greece", "CLIN", "1990-02-02", "ENG", ""), ("i4b", "8/88", "CASE OF D v. GREECE", "HEJUD", "1990-03-03", "ENG", ""), ("i6", "7/08", "CASE OF F v. CHAD", "HEJUD", "2000-01-01", "ENG", ""),
    ], "itemid string, appno string, docname string, doctype string, kpdate string, languageisocode string, ecli string")
    got = {r.case_key: (r.itemid, r.match_method) for r in catalog.resolved(cases, docs).collect()}
    assert got == {
        "k1": ("i1", "exact_application_set"), "k2": ("i2", "application_subset_name_year"), "k3": (None, "no_official_case_document"),
        "k4": ("i4b", "exact_name_and_year"), "k5": (None, "no_exact_name_match"), "k6": (None, "no_candidate_after_year_filter"),
    }


def test_negatives(spark):
    candidates = spark.createDataFrame([(k, date(2020, 1, 1 + k % 28), [f"{k}/20"] if k else []) for k in range(40)], "item int, at date, apps array<string>")
    windows = spark.createDataFrame([("t", date(2020, 1, 1), date(2020, 1, 20)), ("u", date(2020, 1, 20), date(2020, 1, 20))], "id string, from_date date, to_date date")
    positives = spark.createDataFrame([("t", "19/20"), ("t", "18/20")], "id string, key string")
    got = sampling.negatives(candidates, windows, positives, kept=5).collect()
    assert [r.item for r in sorted(got, key=lambda r: r["rank"]) if r.id == "t"] == [17, 16, 15, 14, 13]
    assert [r.item for r in got if r.id == "u"] == [19]
    stats = {r.id: (r.negatives, r.positive_keys) for r in sampling.mining_stats(spark.createDataFrame(got), windows, positives).collect()}
    assert stats == {"t": (5, 2), "u": (1, 0)}


def test_samples(spark):
    df = spark.createDataFrame([(k, "ab"[k % 10 == 0]) for k in range(100)], "k int, s string")
    got = sampling.round_robin(df, ["s"], "k", 10)
    assert {r.s: r.n for r in got.groupBy("s").agg(F.count("*").alias("n")).collect()} == {"a": 5, "b": 5}
    some = sampling.stratified(df, ["s"], "k", 30, first=F.col("k") < 20)
    assert some.count() == some.select("k").distinct().count() == 30 and some.where("k < 20").count() >= 10


def test_audit(spark):
    ref = spark.createDataFrame([("g", ["a", "b"], ["x"]), ("h", ["a"], []), ("i", ["q"], None)], "guide string, added array<string>, removed array<string>")
    loc = spark.createDataFrame([("g", ["b", "a"], ["x"]), ("h", ["c"], []), ("j", [], [])], "guide string, added array<string>, removed array<string>")
    got = {r.guide: r.state for r in audit.compared(ref, loc, ["guide"]).collect()}
    assert got == {"g": "exact", "h": "changed", "i": "reference_only", "j": "local_only"}
    near = spark.createDataFrame([("g", ["Smithson v. Malta, 1990", "x, no. 1/02"], ["Smithsen v. Malta, 1990", "unlike"])], "guide string, added array<string>, removed array<string>")
    assert [(r.removed, r.score) for r in audit.similar_pairs(near, ["guide"]).collect()] == [("Smithsen v. Malta, 1990", 0.957)]


def test_mentions(spark):
    pages = spark.createDataFrame([("d", 1, "Short.\n\nThe judgment in A v. Malta\nset out the test at some length."), ("d", 2, "A v. Malta is named once more on this second page."), ("d", 3, "List of cited cases\n\nA v. Malta, no. 1/02, which is not a mention at all.")], "doc string, page int, text string")
    cited = spark.createDataFrame([("d", "A v. Malta, no. 1/02")], "doc string, citation string")
    found = mentions.mentions(pages, cited)
    assert sorted(r.page for r in found.collect()) == [1, 2]
    assert mentions.summaries(found, ["citation"]).first().summary == "2 body mention(s) found on page(s): 1, 2"
    assert mentions.marked(found).where("html like '%<mark>A v. Malta</mark>%'").count() == 2


def test_cited_list_of_every_nation(spark):
    from stemmata.plans.queries import QUERIES, _cited

    sf = "/root/testdata/sf0.001"
    got = {(r.doc, r.n) for r in QUERIES["cited_list_fold"](spark, sf).groupBy("doc").agg(F.count("*").alias("n")).collect()}
    assert got == {(r.n_name, r.n) for r in _cited(spark, sf).groupBy("n_name").agg(F.count("*").alias("n")).collect()}


def test_short_and_foreign_passages_are_contained(spark):
    from stemmata.operators import bm25

    docs = spark.createDataFrame([("a", 1, "the quick brown fox jumps"), ("a", 2, "Съешь ещё этих мягких французских булок, да выпей чаю"), ("b", 3, "x"), ("b", 4, None), ("b", 5, "")], "corpus string, doc long, text string")
    asked = [(1, "quick brown"), (2, "этих мягких французских булок"), (3, "x"), (4, "brown fox jumps"), (5, " "), (6, ""), (7, None), (8, "QUICK"), (9, "этих мягких булок")]
    passages = spark.createDataFrame(asked, "query long, text string")
    want = sorted((q, d.doc) for q, t in asked for d in docs.collect() if t and t.strip() and t in (d.text or ""))
    assert sorted((r.query, r.doc) for r in bm25.containing(docs, passages).collect()) == want
    assert (8, 1) in [(r.query, r.doc) for r in bm25.containing(docs, passages, folded=True).collect()]


def test_evaluation_rows(spark):
    rows = spark.createDataFrame([(1, "a", "x", 1.0), (1, "b", "y", None), (2, "", "z", 5.0), (3, "d", "w", None)], "k int, said string, note string, v double")
    types = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "lost")], "k int, at int, subtype string")
    typed = linking.with_subtype(rows, types, ["k"], "at")
    assert {(r.k, r.subtype) for r in typed.collect()} == {(1, "new"), (2, "lost"), (3, "unknown")}
    assert sorted(tuple(r) for r in metrics.means(typed, ["subtype"], ["v"], said="said").collect()) == [("new", 2, 1.0), ("unknown", 1, 0.0)]
    assert sorted(tuple(r) for r in linking.carried(rows, ["k", "v", "none"]).collect()) == [("1", "", ""), ("1", "1.0", ""), ("2", "5.0", ""), ("3", "", "")]
    both = linking.labelled_union(rows.select("k"), rows.select("k", "note"))
    assert both.agg(metrics.base_rate(F.col("label"))).first()[0] == 0.5 and both.where("label = 1 and note is null").count() == 4
    lists = spark.createDataFrame([([1, 2], [2]), ([3], [4, 5]), (None, [1])], "a array<int>, b array<int>")
    assert tuple(lists.agg(metrics.gold_in_corpus_rate(F.col("a"), F.col("b")), metrics.total_length(F.col("a"), F.col("b"))).first()) == (0.3333, 7)
    assert [tuple(r) for r in versions.menu(rows, "k", "note", "note").collect()] == [(1, "y"), (2, "z"), (3, "w")]
