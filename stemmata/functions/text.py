"""Text normalisation, tokens and section slices."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _mapped(f) -> object:
    def of(values: pd.Series) -> pd.Series:
        seen: dict = {None: None}
        return pd.Series([seen[v] if v in seen else seen.setdefault(v, f(v)) for v in values], dtype="object")

    return F.pandas_udf(of, StringType())


def nfkc(c: ColumnOrName) -> Column:
    """Unicode compatibility composition, which Spark lacks."""
    return _mapped(lambda v: unicodedata.normalize("NFKC", v))(col(c))


def without_accents(c: ColumnOrName) -> Column:
    """Compatibility decomposition without combining marks."""
    return _mapped(lambda v: "".join(x for x in unicodedata.normalize("NFKD", v) if not unicodedata.combining(x)))(col(c))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it. No pandas function may be in ``use``."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def replaced(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def collapsed(c: ColumnOrName, strip: str = " ") -> Column:
    """White space runs become one space; ``strip`` goes from both ends."""
    return F.btrim(replaced(col(c), (r"(?U)\s+", " ")), F.lit(strip))


# Typographic dashes and quotes and what they are folded to.
DASHES = "‑‒–—−"
QUOTES = "‘’“”"


def folded(c: ColumnOrName, *, compat: bool = False, ascii_only: bool = False) -> Column:
    """Display form of a citation or paragraph. ``compat`` leaves U+2010, into which composition turns the
    non-breaking hyphen, alone; ``ascii_only`` spares the Unicode step where the text is known to need none."""
    text = col(c) if ascii_only else nfkc(c)
    hyphen = "" if compat else "‐"
    text = F.translate(text, " " + DASHES + hyphen + QUOTES, " " + "-" * len(DASHES + hyphen) + "''\"\"")
    text = replaced(
        text,
        (" ,", ","),
        (r"(?iU)\b((?:request no|nos?|no)\.?)\s+", "$1 "),
        (r"(?<=\d)-\s+(?=\d)", "-"),
        (r"(?U)\s+/\s+", "/"),
    )
    return collapsed(text, " *")


def match_form(c: ColumnOrName, *, ascii_only: bool = False) -> Column:
    """Comparison form: display form in lower case without accents, quotes, brackets and most punctuation."""
    text = F.lower(folded(c, ascii_only=ascii_only))
    text = F.translate(text if ascii_only else without_accents(text), "’`", "''")
    return F.trim(
        replaced(
            text,
            (r"(?U)\bet\b", "and"),
            (r"[\"'“”‘’()\[\]{}*]", ""),
            (r"[^a-z0-9/., -]+", " "),
            (r"[.,;:]+", " "),
            (r"\s+", " "),
        )
    )


def viewer_form(c: ColumnOrName) -> Column:
    """Lower case, dashes and quotes folded, white space collapsed."""
    return collapsed(F.translate(F.lower(col(c)), "‑‒–—" + QUOTES, "----''\"\""))


def tokens(c: ColumnOrName) -> Column:
    """Lower-cased runs of ASCII letters and digits; other letters separate tokens."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.transform(found, F.lower)


def distinct_tokens(c: ColumnOrName) -> Column:
    """Tokens at their first places."""
    return F.array_distinct(tokens(c))


def query_tokens(name: ColumnOrName, apps: ColumnOrName, citation: ColumnOrName | None = None, *, citation_first: bool = False) -> Column:
    """Tokens of a search for a case: name, application numbers (joined by "|") and citation, null ones left out.
    ``citation_first`` puts the citation before the numbers. The order decides no score, only the order of tokens."""
    numbers = F.replace(F.coalesce(col(apps), F.lit("")), F.lit("|"), F.lit(" "))
    said = [] if citation is None else [col(citation)]
    return tokens(F.concat_ws(" ", col(name), *([*said, numbers] if citation_first else [numbers, *said])))


def marked_terms(terms: ColumnOrName, shortest: int = 4) -> Column:
    """The terms long enough to be marked, without the space around them."""
    return F.filter(F.transform(col(terms), lambda t: F.trim(t)), lambda t: F.length(t) >= shortest)


def token_text(c: ColumnOrName) -> Column:
    return F.array_join(tokens(c), " ")


def parts(c: ColumnOrName, separator: str) -> Column:
    """A list in a string: pieces trimmed, empty ones left out."""
    pieces = F.split(F.coalesce(col(c), F.lit("")), f"\\Q{separator}\\E")
    return F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda x: x != "")


def joined(c: ColumnOrName, separator: str = "|") -> Column:
    return F.array_join(col(c), separator)


def section_path(c: ColumnOrName) -> Column:
    """What precedes the first ``: `` of ``path: title``; all of it if there is none."""
    return F.substring_index(col(c), ": ", 1)


def flag(c: ColumnOrName) -> Column:
    """Booleans in any spelling; null is false."""
    return F.lower(F.trim(F.coalesce(col(c).cast("string"), F.lit("")))) == "true"


def number(c: ColumnOrName) -> Column:
    return F.expr(f"try_cast({c} as double)") if isinstance(c, str) else c.try_cast("double")


def iso_date(timestamp: ColumnOrName) -> Column:
    """``yyyy-MM-dd`` of a 14-digit time stamp, with or without a file name after it."""
    c = col(timestamp)
    return F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))


def days_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    return F.date_diff(col(end).cast("date"), col(start).cast("date"))


def text_hash(c: ColumnOrName) -> Column:
    """16 hexadecimal digits of SHA-1 of the display form."""
    return F.substring(F.sha1(folded(c)), 1, 16)


def blank(c: ColumnOrName) -> Column:
    return F.trim(F.coalesce(col(c), F.lit(""))) == ""


def first_filled(*cs: ColumnOrName) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs])


def paragraphs(c: ColumnOrName, least: int = 0) -> Column:
    """Pieces between blank lines, white space collapsed, of at least ``least`` characters."""
    pieces = F.transform(F.split(col(c), r"\n\s*\n"), lambda x: collapsed(x))
    return F.filter(pieces, lambda x: F.length(x) >= least)


def heading(title: ColumnOrName, counter: ColumnOrName) -> Column:
    """(component, title) of ``IV. Title``; a heading without number is component ``§counter``."""
    pattern, c = r"(?s)^([IVXLCDM]+|[A-Z]|\d+|[a-z])\.\s+(.*)$", col(title)
    numbered = c.rlike(pattern)
    return F.struct(
        F.when(numbered, F.regexp_extract(c, pattern, 1)).otherwise(F.concat(F.lit("§"), col(counter).cast("string"))).alias("component"),
        F.when(numbered, F.trim(F.regexp_extract(c, pattern, 2))).otherwise(c).alias("title"),
    )


# The lines that open the sections of a judgment.
FACTS, LAW = "(?i)^THE FACTS$", "(?i)^THE LAW$"
OPERATIVE = "(?i)^(FOR THESE REASONS|OPERATIVE PROVISIONS)"


def _marks(lines: Column, pattern: str) -> Column:
    """Numbers (from 0) of the lines that match when trimmed."""
    return F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x).rlike(pattern), i)), lambda i: i.isNotNull())


def _next(marks: Column, after: Column) -> Column:
    return F.get(F.filter(marks, lambda i: i > after), F.lit(0))


def _lines(c: ColumnOrName) -> Column:
    return F.split(F.coalesce(col(c), F.lit("")), r"\R")


def _between(lines: Column, start: Column, stop: Column) -> Column:
    kept = F.slice(lines, start + 1, F.greatest(F.coalesce(stop, F.size(lines)) - start, F.lit(0)))
    return F.when(start.isNull(), "").otherwise(F.array_join(kept, "\n"))


def judgment_sections(c: ColumnOrName) -> Column:
    """Struct of full_text, facts, law, operative and two halves by lines; each section follows the one before it.
    Lines and places are worked out once for all of them."""

    def within(lines: Column) -> Column:
        half = F.floor(F.size(lines) / 2).cast("int")
        made = lambda facts, law, operative: F.struct(
            F.coalesce(col(c), F.lit("")).alias("full_text"),
            _between(lines, facts, law).alias("facts"),
            _between(lines, law, operative).alias("law"),
            _between(lines, operative, F.lit(None).cast("int")).alias("operative"),
            F.array_join(F.slice(lines, F.lit(1), half), "\n").alias("first_half"),
            F.array_join(F.slice(lines, half + 1, F.size(lines)), "\n").alias("second_half"),
        )
        with_law = lambda facts, law: once(_next(_marks(lines, OPERATIVE), law), lambda operative: made(facts, law, operative))
        with_facts = lambda facts: once(_next(_marks(lines, LAW), facts), lambda law: with_law(facts, law))
        return once(F.get(_marks(lines, FACTS), F.lit(0)), with_facts)

    return once(_lines(c), within)


#: Presets of law_section: (lines that are kept if no operative part follows, characters kept if there is no law part).
PRESETS = {"retrieval": (250, 0), "location": (250, 15_000), "generation": (200, 0)}


def law_section(c: ColumnOrName, preset: str = "retrieval") -> Column:
    """The law part of a judgment, up to its operative part."""
    cap, fallback = PRESETS[preset]
    lines = _lines(c)
    law = F.get(_marks(lines, LAW), F.lit(0))
    operative = _next(_marks(lines, OPERATIVE), law)
    found = _between(lines, law, F.coalesce(operative, F.least(law + cap, F.size(lines))))
    return F.when(law.isNull(), F.substring(F.coalesce(col(c), F.lit("")), 1, fallback)).otherwise(found)
