import pytest
from pyspark.sql import functions as F

from stemmata.functions import citations as cite
from stemmata.functions import labels, similarity, text


def one(spark, value, f, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(f("x").alias("y")).first().y


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Smith v. Malta , nos.  1/02 and 3 / 04 *", "Smith v. Malta, nos. 1/02 and 3/04"), ("a –‑b “c” ‘d’", "a --b \"c\" 'd'"),
        ("1996- 97", "1996-97"), ("ﬁle", "file"), (None, None), ("", ""),
    ],
)
def test_folded(spark, raw, want):
    assert one(spark, raw, text.folded) == want


def test_folded_compat_keeps_hyphen(spark):
    assert one(spark, "a‑b", lambda c: text.folded(c, compat=True)) == "a‐b"


def test_match_form(spark):
    assert one(spark, "Müller et Čapek v. France (no. 2), [GC]", text.match_form) == "muller and capek v france no 2 gc"


def test_tokens(spark):
    assert one(spark, "Ab-c Öl9 ab", text.tokens) == ["ab", "c", "l9", "ab"]
    assert one(spark, "Ab ab c", text.distinct_tokens) == ["ab", "c"]
    assert one(spark, None, text.tokens) == []


def test_small_helpers(spark):
    assert one(spark, "20200131123456__guide.pdf", text.iso_date) == "2020-01-31"
    assert one(spark, " a | |b", lambda c: text.parts(c, "|")) == ["a", "b"]
    assert one(spark, "I.A: Title: more", text.section_path) == "I.A"
    assert [one(spark, v, text.flag) for v in ("True", " true ", "0", None)] == [True, True, False, False]
    assert tuple(one(spark, "IV. Scope", lambda c: text.heading(c, F.lit(7)))) == ("IV", "Scope")
    assert tuple(one(spark, "Scope", lambda c: text.heading(c, F.lit(7)))) == ("§7", "Scope")
    assert one(spark, "a  b\n\n \nlonger text", lambda c: text.paragraphs(c, 4)) == ["longer text"]


JUDGMENT = "intro\nTHE FACTS\nf1\nf2\nThe Law\nl1\nl2\nFOR THESE REASONS, THE COURT\no1"


def test_judgment_sections(spark):
    s = one(spark, JUDGMENT, text.judgment_sections)
    assert (s.facts, s.law, s.operative) == ("THE FACTS\nf1\nf2", "The Law\nl1\nl2", "FOR THESE REASONS, THE COURT\no1")
    assert s.first_half == "intro\nTHE FACTS\nf1\nf2"
    s = one(spark, "The Law\nx\nTHE FACTS\ny", text.judgment_sections)
    assert (s.facts, s.law) == ("THE FACTS\ny", "")


def test_law_section(spark):
    assert one(spark, JUDGMENT, text.law_section) == "The Law\nl1\nl2"
    long = "THE LAW\n" + "\n".join(map(str, range(300)))
    assert len(one(spark, long, text.law_section).split("\n")) == 250
    assert len(one(spark, long, lambda c: text.law_section(c, "generation")).split("\n")) == 200
    assert one(spark, "no marks", text.law_section) == "" and one(spark, "no marks", lambda c: text.law_section(c, "location")) == "no marks"


@pytest.mark.parametrize(
    ("citation", "name", "apps", "year"),
    [
        ("A v. Malta, no. 12/03, 4 May 2010", "A v. Malta", ["12/03"], "2010"), ("B v. Italy (dec.), nos. 1/02 and 3/04, ECHR 1999-II", "B v. Italy (dec.)", ["1/02", "3/04"], "1999"),
        ("C v. Spain, 4 May 2010", "C v. Spain", [], "2010"), ("D v. Greece, Series A no. 12", "D v. Greece", [], None), ("E v. France, 1990", "E v. France", [], "1990"),
        ("Advisory opinion, request no. P16-2018-001", "Advisory opinion", ["P16-2018-001"], "2018"), ("F v. Peru, 1/2/3/4", "F v. Peru, 1/2/3/4", [], None),
    ],
)
def test_citations(spark, citation, name, apps, year):
    assert one(spark, citation, cite.case_name) == name
    assert one(spark, citation, cite.application_numbers) == apps
    assert one(spark, citation, cite.judgment_year) == year


def test_case_key_and_years(spark):
    s = one(spark, "C v. Spain, 4 May 2010", cite.case_struct)
    assert s.case_key == "name:c v spain::2010"
    assert one(spark, "x, no. 2/03 and 1/02", cite.application_key) == "2/03|1/02"
    assert one(spark, "1987 and 2001", cite.last_year) == "2001"
    assert one(spark, "1987 and 2001", lambda c: cite.last_year(c, compat=True)) == "20"
    assert one(spark, "v. Malta 1990-", cite.suspicious) == ["lowercase_start", "starts_with_v", "hanging_dash", "no_app_number"]
    assert one(spark, 'A v. the Netherlands ("B") [GC] (dec.)', cite.canonical_name) == "a v netherlands"
    assert one(spark, "CASE OF A v. MALTA - [French translation]", lambda c: cite.canonical_name(c, document=True)) == "a v malta"
    assert one(spark, "* A v. B, no. 1/02", cite.search_terms) == ["1/02", "A v. B", "* A v. B, no. 1/02"]


def test_similarity(spark):
    df = spark.createDataFrame([("A v. Maltha, 1990", "A v. Malta, 1990"), ("A v. Malta, 1987", "A v. Malta, 1990"), ("Smithson v. Malta, 1990", "Smithsen v. Malta")], "a string, b string")
    assert [r[0] for r in df.select(similarity.alike_without_number("a", "b")).collect()] == [True, False, True]
    assert df.select(similarity.alike_without_number("a", "b", compat_year=True)).collect()[1][0] is True
    assert similarity.common_length("a b c d".split(), "b x d a".split()) == 2
    pair = spark.createDataFrame([("the cat sat", "The cat ran far"), ("", "x"), (None, None)], "a string, b string")
    assert [r[0] for r in pair.select(similarity.rouge_l("a", "b")).collect()] == [round(4 / 7, 4), 0.0, 0.0]
    marked = spark.createDataFrame([("A & b a", ["a", "A & B"])], "t string, ts array<string>").select(similarity.highlighted("t", "ts")).first()[0]
    assert "<mark>" in marked and "&amp;" in marked
    assert one(spark, "abc", lambda c: similarity.seq_ratio(c, F.lit("abd"))) == pytest.approx(2 / 3)


def test_labels(spark):
    assert [one(spark, v, labels.article_roots) for v in ("6-1+13|P1-3-2", "", None)] == [["6", "13", "P1-3"], [], []]
    assert [one(spark, v, labels.guide_articles) for v in ("Article 34/35", "Article 3 Protocol 1", "Article 6 Civil", "Terrorism")] == [["34", "35"], ["P1-3"], ["6"], []]
    assert [one(spark, v, labels.importance_score) for v in ("1", "3", "", "9")] == [1.0, 0.3, 0.2, 0.2]
    kinds = spark.createDataFrame([("HEJUD", "ENG"), ("HFJUD", "FRE"), ("HEJUD", "FRE"), ("CLIN", "ENG"), ("X", None)], "d string, l string")
    assert [r[0] for r in kinds.select(labels.document_priority("d", "l")).collect()] == [0, 1, 2, 4, 9]
    hit = one(spark, "As in Handyside and 5493/72", lambda c: labels.citation_hit(c, F.lit("Handyside v. the United Kingdom"), F.lit("5493/72|1/02")))
    assert (hit.name_hit, hit.appno_hit) == (True, True)
    row = {k: F.lit(v) for k, v in {"case_name": "A v. B", "application_numbers": "1/02|3/04", "judgment_year": "2001", "citation_text": "c", "importance": "1", "conclusion": "", "pre_text": " old "}.items()}
    p = one(spark, "citation_refresh", lambda c: labels.prompt(row, F.col(c), F.lit("law")))
    assert "1/02, 3/04" in p and "old" in p and "law" not in p
    assert "law" in one(spark, "new_paragraph", lambda c: labels.prompt(row, F.col(c), F.lit("law")))


def test_queries_and_marked_terms(spark):
    row = spark.createDataFrame([("Doe v. X", "1/02|3/04", "§ 5", [" abcd ", "abc", None])], "n string, a string, c string, t array<string>")
    got = row.select(text.query_tokens("n", "a", "c"), text.query_tokens("n", "a", "c", citation_first=True), text.query_tokens("n", F.lit(None)), text.marked_terms("t")).first()
    assert list(got) == ["doe v x 1 02 3 04 5".split(), "doe v x 5 1 02 3 04".split(), ["doe", "v", "x"], ["abcd"]]
