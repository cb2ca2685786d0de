"""Binary documents: DOCX and HTML with the standard library, PDF where a reader is installed; addresses fetched once."""

from __future__ import annotations

import io
import random
import time
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.error import HTTPError, URLError
from urllib.request import Request, urlopen
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """Paragraph texts joined by line ends; tabs and breaks kept, empty paragraphs left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    mark = {f"{W}tab": "\t", f"{W}br": "\n"}
    out = []
    for paragraph in root.iter(f"{W}p"):
        piece = "".join((x.text or "") if x.tag == f"{W}t" else mark.get(x.tag, "") for x in paragraph.iter())
        if piece.strip():
            out.append(piece.strip())
    return "\n".join(out)


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.out.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0
        self.out.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_text(content: bytes) -> str:
    reader = _Visible()
    reader.feed(content.decode("utf-8", errors="replace"))
    return " ".join("".join(reader.out).split())


def strip_tags(c) -> F.Column:
    """Visible text of HTML by expressions alone: scripts, styles, comments and tags go, five entities are resolved."""
    text = F.col(c) if isinstance(c, str) else c
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def read_texts(files: DataFrame, reader: Callable[[bytes], str] = docx_text) -> DataFrame:
    """(path, text, error) of binary files; a file that can't be read has its error instead of a text."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, reader(bytes(content)), None))
                except Exception as e:  # a damaged file is a row, not the end of the job
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(read, "path string, text string, error string")


def pdf_blocks(files: DataFrame) -> DataFrame:
    """(doc, page, height, x, y, text) of PDF files, in reading order, by PyMuPDF, which must be installed."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                with fitz.open(stream=bytes(content), filetype="pdf") as pdf:
                    for n, page in enumerate(pdf):
                        rows += [(path, n, float(page.rect.height), float(b[0]), float(b[1]), str(b[4])) for b in page.get_text("blocks")]
                yield pd.DataFrame(rows, columns=["doc", "page", "height", "x", "y", "text"])

    return files.select("path", "content").mapInPandas(read, "doc string, page int, height double, x double, y double, text string")


def pdf_contents(files: DataFrame) -> DataFrame:
    """(doc, pos, level, raw_title, page_number, y) of the tables of contents of PDF files, by PyMuPDF."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                with fitz.open(stream=bytes(content), filetype="pdf") as pdf:
                    rows = [
                        (path, k + 1, int(e[0]), str(e[1]), int(e[2]), float(getattr((e[3] if len(e) > 3 else {}).get("to"), "y", 0.0) or 0.0))
                        for k, e in enumerate(pdf.get_toc(simple=False))
                    ]
                yield pd.DataFrame(rows, columns=["doc", "pos", "level", "raw_title", "page_number", "y"])

    return files.select("path", "content").mapInPandas(read, "doc string, pos int, level int, raw_title string, page_number int, y double")


def page_texts(blocks: DataFrame) -> DataFrame:
    """(doc, page, text) from blocks in reading order."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "text")))
    return blocks.groupBy("doc", "page").agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n").alias("text"))


def version_dates(pages: DataFrame, names: DataFrame, upto: int = 5) -> DataFrame:
    """(doc, version_date): the first date after ``Updated`` or ``Last update`` on the leading pages, spelled out; without
    one ``unknown (file)``. ``names``: doc, name."""
    pattern = r"(?i)(?:Updated|Last update)[^0-9]{0,20}(\d{2}\.\d{2}\.\d{4})"
    found = pages.where(F.col("page") < upto).withColumn("_d", F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))).where("_d is not null")
    first = found.groupBy("doc").agg(F.min_by("_d", "page").alias("_d"))
    spelled = F.date_format(F.to_date("_d", "dd.MM.yyyy"), "d MMMM yyyy")
    return names.join(first, "doc", "left").select("doc", F.coalesce(spelled, F.concat(F.lit("unknown ("), "name", F.lit(")"))).alias("version_date"))


def header_page(pages: DataFrame, header: str) -> DataFrame:
    """(doc, page) of the last page that carries a header."""
    return pages.where(F.contains("text", F.lit(header))).groupBy("doc").agg(F.max("page").alias("page"))


def fetch(url: str, tries: int = 3, wait: float = 1.0, timeout: float = 30.0, opener: Callable = urlopen) -> bytes:
    """The body at an address. A missing page isn't asked for again; other failures are, with growing pauses."""
    for k in range(tries):
        try:
            with opener(Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as r:
                return r.read()
        except HTTPError as e:
            if e.code == 404 or k == tries - 1:
                raise
        except URLError:
            if k == tries - 1:
                raise
        time.sleep(wait * 2**k + random.uniform(0, wait))
    raise ValueError("tries must be positive")


def is_docx(content: bytes, content_type: str = "") -> bool:
    return "wordprocessingml" in content_type or content[:2] == b"PK"


def fetched(wanted: DataFrame, getter: Callable[[str], bytes] = fetch) -> DataFrame:
    """(key, content, status, error) for rows (key, url): ``ok`` or ``failed``."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, url in zip(batch["key"], batch["url"], strict=True):
                try:
                    rows.append((key, getter(url), "ok", None))
                except Exception as e:  # the status table says what failed
                    rows.append((key, None, "failed", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "content", "status", "error"])

    return wanted.select("key", "url").mapInPandas(read, "key string, content binary, status string, error string")


def api_results(responses: DataFrame) -> DataFrame:
    """Rows from API answers: ``body`` holds {"results": [{"columns": {...}}]} with strings in the columns."""
    parsed = F.from_json("body", "results array<struct<columns:map<string,string>>>")
    rows = responses.select(F.explode(parsed["results"]).alias("r")).select(F.col("r.columns").alias("c"))
    names = ("itemid", "appno", "docname", "doctype", "kpdate", "importance", "article", "respondent", "ecli", "conclusion", "languageisocode")
    return rows.select(*[F.coalesce(F.col("c").getItem(n), F.lit("")).alias(n) for n in names])


def api_negatives(results: DataFrame) -> DataFrame:
    """Judgments as candidates: item, name without its prefix, year, day, application numbers."""
    apps = F.filter(F.transform(F.split("appno", ";"), lambda x: F.trim(x)), lambda x: x != "")
    return results.select(
        F.col("itemid").alias("item"), F.replace("docname", F.lit("CASE OF "), F.lit("")).alias("case_name"), F.substring("kpdate", 1, 4).alias("year"),
        F.to_date(F.substring("kpdate", 1, 10)).alias("at"), "doctype", "importance", apps.alias("apps"),
    )


# The document types that count as decisions.
DOCTYPES = ("HEJUD", "HEDEC", "HFDEC", "HFJUD")


def of_doctypes(results: DataFrame, doctypes: tuple[str, ...] = DOCTYPES) -> DataFrame:
    """Rows of ``api_results`` or ``api_negatives`` that have one of the document types."""
    return results.where(F.col("doctype").isin(*doctypes))


def query_text(kind: str, *values: str) -> str:
    """Search expression for application numbers, a name or a window of days."""
    if kind == "apps":
        return "(" + " OR ".join(f'appno:"{v}"' for v in values) + ")"
    if kind == "name":
        return f'(docname:"{values[0]}")'
    return f'kpdate>="{values[0]}T00:00:00.0Z" AND kpdate<="{values[1]}T23:59:59.0Z"'
