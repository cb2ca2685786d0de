import io
import zipfile

from stemmata.sources import documents, readers, writers
from stemmata.streaming import incremental


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'says "x",\n\nand more', True, ["p", "q"], None), ("b", "", False, [], 1.5)], "k string, t string, f boolean, l array<string>, d double")
    assert writers.csv(df, str(tmp_path / "t"))
    back = {r.k: r for r in readers.csv(spark, str(tmp_path / "t")).collect()}
    assert back["a"].t == 'says "x",\n\nand more' and (back["a"].f, back["a"].l, back["a"].d) == ("true", "p|q", "")
    assert back["b"].t == "" and back["b"].d == "1.5"
    assert not writers.csv(df.limit(0), str(tmp_path / "none"))
    assert readers.csv_or_empty(spark, str(tmp_path / "none"), ["a", "b"]).count() == 0


def test_json_sources(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"g/1.pdf": ["a", "b"], "g/2.pdf": []}')
    got = {r.pdf_name: r.citations for r in readers.json_map(spark, str(tmp_path / "map.json")).collect()}
    assert got == {"1.pdf": ["a", "b"], "2.pdf": []}
    (tmp_path / "m.jsonl").write_text('{"guide_id": "g", "title": "T", "timestamp": "1", "local_path": "x/1.pdf"}\n\n{"guide_id": "g", "title": "U", "timestamp": "2", "local_path": "x/9.pdf"}\n')
    meta = readers.json_lines(spark, str(tmp_path / "m.jsonl")).withColumnRenamed("timestamp", "timestamp")
    assert meta.count() == 2
    present = spark.createDataFrame([("1.pdf",)], "name string")
    assert [r.pdf_name for r in readers.snapshots(meta, present, idx="timestamp").collect()] == ["1.pdf"]
    assert readers.guide_titles(meta, idx="timestamp").first().guide_title == "U"
    folder = tmp_path / "diffs" / "g"
    folder.mkdir(parents=True)
    (folder / "diff_2020-01-01__2020-02-01.json").write_text('{"guide_title": "T", "section_events": [{"change_type": "section_added", "path": "I", "title": "A", "level": 1}], "paragraph_changes": [{"change_type": "paragraph_added", "section_path": "I", "text_b": "x", "para_num_b": 3}]}')
    diffs = readers.diff_files(spark, str(tmp_path / "diffs"))
    row = readers.diff_paragraphs(diffs).first()
    assert (row.guide_id, row.from_date, row.to_date, row.para_num_b, row.para_num_a) == ("g", "2020-01-01", "2020-02-01", 3, None)
    assert readers.section_titles(diffs).first().title == "A"


def docx(text_xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{text_xml}</w:body></w:document>')
    return out.getvalue()


def test_documents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("<w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t><w:br/><w:t>three</w:t></w:r></w:p><w:p/>" "<w:p><w:r><w:t>Four</w:t></w:r></w:p>"))
    (tmp_path / "b.docx").write_bytes(b"broken")
    got = {r.path[-6:]: r for r in documents.read_texts(readers.files(spark, str(tmp_path), "*.docx")).collect()}
    assert got["a.docx"].text == "One\ttwo\nthree\nFour" and got["b.docx"].text is None and "BadZipFile" in got["b.docx"].error
    assert documents.html_text(b"<p>a &amp; b<script>x</script></p>c") == "a & b c"
    assert documents.is_docx(b"PK..") and not documents.is_docx(b"<html>")


def test_fetching(spark):
    calls = []

    class Answer(io.BytesIO):
        pass

    def opener(request, timeout):
        calls.append(request.full_url)
        if len(calls) < 3:
            raise documents.URLError("down")
        return Answer(b"body")

    assert documents.fetch("http://x", wait=0.0, opener=opener) == b"body" and len(calls) == 3
    wanted = spark.createDataFrame([("k", "u"), ("j", "v")], "key string, url string")
    assert {r.key: r.status for r in documents.fetched(wanted, lambda u: b"x" if u == "u" else 1 / 0).collect()} == {"k": "ok", "j": "failed"}
    body = '{"results": [{"columns": {"itemid": "1", "appno": "1/02;3/04", "kpdate": "2020-01-05T00:00:00", "docname": "CASE OF A v. B"}}]}'
    row = documents.api_negatives(documents.api_results(spark.createDataFrame([(body,)], "body string"))).first()
    assert (row.case_name, row.apps, row.year) == ("A v. B", ["1/02", "3/04"], "2020")
    kinds = spark.createDataFrame([("HEJUD",), ("HFDEC",), ("CLIN",), ("",), (None,)], "doctype string")
    assert [r.doctype for r in documents.of_doctypes(kinds).collect()] == ["HEJUD", "HFDEC"]


def test_version_dates(spark):
    pages = spark.createDataFrame([("d", 0, "Title"), ("d", 1, "Updated on 31.08.2022"), ("e", 0, "none")], "doc string, page int, text string")
    names = spark.createDataFrame([("d", "d.pdf"), ("e", "e.pdf")], "doc string, name string")
    assert {r.doc: r.version_date for r in documents.version_dates(pages, names).collect()} == {"d": "31 August 2022", "e": "unknown (e.pdf)"}
    assert documents.header_page(pages, "Title").first().page == 0


def test_incremental_stream(spark, tmp_path):
    source, target = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").write.parquet(str(source))

    def go():
        stream = spark.readStream.schema("k int, v string").parquet(str(source))
        incremental.run(stream, target, ["k"], lambda df: df, str(tmp_path / "c"), "k int, v string").awaitTermination()
        return sorted((r.k, r.v) for r in incremental.existing(spark, target, "k int, v string").collect())

    assert go() == [(1, "a"), (2, "b")]
    spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string").write.mode("append").parquet(str(source))
    assert go() == [(1, "a"), (2, "b"), (3, "c")]


def test_release(spark, tmp_path):
    import pytest

    df = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(ValueError, match="missing: c"):
        writers.release(df, str(tmp_path / "r"), ["a", "c"])
    assert "| 1 | x |" in writers.markdown(df, "T")
    assert writers.report(df).first().value == '{"a":1,"b":"x"}'
