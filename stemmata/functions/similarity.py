"""Sequence similarity, ROUGE-L and highlighting: Arrow functions, since Spark has no counterpart."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from html import escape

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from .citations import last_year, simple_case_name
from .text import ColumnOrName, col, match_form


def ratio(a: str, b: str, autojunk: bool = True) -> float:
    return SequenceMatcher(None, a, b, autojunk).ratio()


def seq_ratio(a: ColumnOrName, b: ColumnOrName, *, autojunk: bool = True) -> Column:
    """Ratcliff-Obershelp similarity from 0 to 1. With ``autojunk``, as in the standard library, long texts' frequent
    characters don't count and the order of the arguments matters. Null if either text is null."""

    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        pairs = zip(x, y, strict=True)
        return pd.Series([None if p is None or q is None else ratio(p, q, autojunk) for p, q in pairs], dtype="float64")

    return F.pandas_udf(of, DoubleType())(col(a), col(b))


def alike_without_number(a: ColumnOrName, b: ColumnOrName, *, least: float = 0.93, compat_year: bool = False) -> Column:
    """Whether two citations without application number mean one case: years agree as far as both are known, and the
    names' comparison forms are equal or similar."""
    x, y = match_form(simple_case_name(a)), match_form(simple_case_name(b))
    p, q = last_year(a, compat=compat_year), last_year(b, compat=compat_year)
    years = F.coalesce(p == q, F.lit(True))
    return (x != "") & (y != "") & years & ((x == y) | (seq_ratio(x, y) >= least))


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time."""
    codes = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]))}
    y, row = np.array([codes[w] for w in b]), np.zeros(len(b) + 1, np.int64)
    for w in a:
        step = np.where(y == codes[w], row[:-1] + 1, row[1:])
        row[1:] = np.maximum.accumulate(np.maximum(step, row[1:]))
    return int(row[-1])


def rouge_l(predicted: ColumnOrName, reference: ColumnOrName) -> Column:
    """F1 of the longest common subsequence of lower-cased words, to 4 places; 0 if either has none."""

    def one(p: str | None, r: str | None) -> float:
        x, y = (p or "").lower().split(), (r or "").lower().split()
        n = common_length(x, y) if x and y else 0
        return round(2 * n / (len(x) + len(y)), 4) if n else 0.0

    def of(p: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(p, r, strict=True)], dtype="float64")

    return F.pandas_udf(of, DoubleType())(col(predicted), col(reference))


def highlighted(text: ColumnOrName, terms: ColumnOrName) -> Column:
    """HTML of the text with each term marked, longest terms first, whatever their case."""

    def one(t: str | None, ts) -> str | None:
        if t is None:
            return None
        wanted = sorted({escape(x) for x in ts if x and x.strip()} if ts is not None else (), key=len, reverse=True)
        if not wanted:
            return escape(t)
        # One pass, so that a term is never looked for in the marks or entities of another.
        pattern = "|".join([f"(?P<term>{'|'.join(map(re.escape, wanted))})", r"&(?:amp|lt|gt|quot|#x27);"])
        return re.sub(pattern, lambda m: f"<mark>{m[0]}</mark>" if m["term"] else m[0], escape(t), flags=re.IGNORECASE)

    def of(t: pd.Series, ts: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(t, ts, strict=True)], dtype="object")

    return F.pandas_udf(of, StringType())(col(text), col(terms))
