"""Quality classifier: regularised quadratic discriminant (operator 5).

Each text becomes a vector of transformed document statistics. Class means and covariances come from the moments of
all training rows, summed in Spark; covariances shrink towards the pooled covariance and that towards its diagonal.
A score is the logistic of the difference of the two classes' log densities (Mahalanobis distances by the cached
Cholesky factors, log determinants, log priors), divided by TEMPER so that it does not saturate; TEMPER leaves the
order and the threshold of 0.5 alone.

Null texts count as empty and get a score like any text. A label is 1 where the mean of a document's labels is 0.5 or
more; null labels don't count. Without training rows of both classes there is no evidence: every score is 0.5. A row
with a null doc_id is never held out. Rows that repeat an id are scored each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import in_python, materialise, text_or_empty

FOLDS = 3
HELD_OUT = 1
POOL = 0.3
DIAGONAL = 0.1
FLOOR = 1e-3
TEMPER = 4.0

LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
SIGNS = np.zeros(256, bool)
SIGNS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"-()?"]] = True
#: Words that end in two signs or more, or are signs alone.
SIGNED = re.compile(rb"[^\sA-Za-z0-9\x80-\xff.,;:'\"\-()?]{2,}(?=\s|$)|(?<!\S)[^\sA-Za-z0-9\x80-\xff](?=\s|$)")
NAMES = (
    "log_words", "word_length", "upper", "signs", "signed_words", "distinct_words", "repeats", "line_repeats",
    "line_length", "stops", "digits", "entropy", "bars",
)


def _share(part: float, whole: float) -> float:
    """Log odds of a share, drawn towards an even chance by half a case."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)))


def statistics(text: bytes) -> list[float]:
    """The vector of NAMES for a text in UTF-8."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    n, size = len(words), len(text)
    letters = int(counts[LETTERS].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    share = counts[counts > 0] / max(size, 1)
    return [
        float(np.log1p(n)),
        float(np.log1p(letters / max(n, 1))),
        _share(int(counts[65:91].sum()), letters),
        _share(int(counts[SIGNS].sum()), size),
        _share(len(SIGNED.findall(text)), n),
        _share(len(set(words)), n),
        _share(repeats, n),
        _share(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(n / max(len(lines), 1))),
        _share(int(counts[46]), n),
        _share(int(counts[48:58].sum()), size),
        float(-(share * np.log(share)).sum()) if size else 0.0,
        _share(int(counts[124]), n),
    ]


def statistics_column(text: Column) -> Column:
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t or b"") for t in texts], dtype="object")

    return F.pandas_udf(of, ArrayType(DoubleType()))(text.cast("binary"))


@dataclass(frozen=True)
class Discriminant:
    """Class means, Cholesky factors of the covariances, and what doesn't depend on the text: log prior less half the
    log determinant. Row 0 is for label 0."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray

    @cached_property
    def inverses(self) -> np.ndarray:
        """Of the factors, worked out once: lower triangles that make statistics white."""
        return np.array([np.linalg.inv(f) for f in self.factors])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of label 1 against label 0, for the rows of ``x``."""
        if not len(x):
            return np.zeros(0)
        per_class = []
        for mean, factor, constant in zip(self.means, self.inverses, self.constants, strict=True):
            z = factor @ (x - mean).T
            per_class.append(constant - 0.5 * (z * z).sum(axis=0))
        return per_class[1] - per_class[0]


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    d = len(NAMES)
    sums = np.zeros((2, 1 + d + d * d))
    for batch in batches:
        if len(batch):
            x, y = np.array(batch["stats"].tolist()), batch["label"].to_numpy()
            for label in (0, 1):
                own = x[y == label]
                sums[label] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
    label, k = np.indices(sums.shape)
    yield pd.DataFrame({"label": label.ravel(), "k": k.ravel(), "value": sums.ravel()})


def fit(train: DataFrame) -> Discriminant | None:
    """``train``: stats (array of doubles), label (0 or 1). None unless both classes have rows."""
    d = len(NAMES)
    parts = in_python(train.select("stats", F.col("label").cast("int")), _moments, "label int, k int, value double")
    sums = np.zeros((2, 1 + d + d * d))
    for row in parts.groupBy("label", "k").agg(F.sum("value").alias("value")).collect():  # two classes' moments
        sums[row.label, row.k] = row.value
    n = sums[:, 0]
    if (n < 1).any():
        return None
    means = sums[:, 1 : 1 + d] / n[:, None]
    own = sums[:, 1 + d :].reshape(2, d, d) / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * n[:, None, None]).sum(axis=0) / n.sum()
    mixed = (1 - POOL) * own + POOL * pooled
    diagonal = np.array([np.diag(np.diag(c)) for c in mixed])
    factors = np.linalg.cholesky((1 - DIAGONAL) * mixed + DIAGONAL * diagonal + FLOOR * np.eye(d))
    constants = np.log(n / n.sum()) - np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
    return Discriminant(means, factors, constants)


def score_column(stats: Column, model: Discriminant | None) -> Column:
    """The score, from 0 to 1, of an array of statistics."""
    if model is None:
        return F.lit(0.5)

    def of(rows: pd.Series) -> pd.Series:
        odds = model.log_odds(np.array(rows.tolist()).reshape(len(rows), len(NAMES)))
        return pd.Series(1 / (1 + np.exp(-np.clip(odds / TEMPER, -700, 700))))

    return F.pandas_udf(of, DoubleType())(stats)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def described(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, stats; written out, since text is read once for all that follows."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics_column(text_or_empty()).alias("stats"))
    return materialise(narrow.withColumn("held_out", held_out(F.col("doc_id"))), "stats")


def learn(stats: DataFrame, labels: DataFrame) -> Discriminant | None:
    """Fits on all rows of ``stats`` that have a label in ``labels`` (doc_id, quality) and are not held out."""
    label = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    return fit(stats.where(~F.col("held_out")).join(label.where("label is not null"), "doc_id"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    stats = described(docs)
    score = score_column(F.col("stats"), learn(stats, labels))
    scored = stats.select("doc_id", "held_out", score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, with all their columns."""
    model = learn(described(docs), labels)
    if model is None:
        return docs
    return docs.where(score_column(statistics_column(text_or_empty()), model) >= 0.5)
