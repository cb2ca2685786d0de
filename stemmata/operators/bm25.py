"""BM25 (Okapi) over many corpora at once.

A corpus is a column, not an object: one set of postings serves all corpora, and a query is a bag of terms joined with
them on (corpus, term). Weights are worked out once per posting, so a query costs a join and a sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distinct_tokens, tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Characters of a passage without inner tokens that carry the join.
CHUNK = 12
#: Passages that are sent to every task at most, with their words.
FEW = 20_000


@dataclass(frozen=True)
class Index:
    """``docs``: corpus, doc, length. ``weights``: corpus, term, doc, weight. ``terms``: corpus, term, idf."""

    docs: DataFrame
    weights: DataFrame
    terms: DataFrame


def index(docs: DataFrame, *, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> Index:
    """``docs``: corpus, doc, text. A negative idf becomes ``epsilon`` times the corpus's mean idf over its terms.
    A null text is a document without terms that the mean length leaves out."""
    split = docs.select("corpus", "doc", tokens("text").alias("w"))
    sized = docs.select("corpus", "doc", F.when(F.col("text").isNotNull(), F.size(tokens("text"))).alias("length"))
    postings = split.select("corpus", "doc", F.explode("w").alias("term")).groupBy("corpus", "term", "doc").agg(F.count("*").alias("tf"))
    corpora = sized.groupBy("corpus").agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))
    terms = postings.groupBy("corpus", "term").agg(F.count("*").alias("df")).join(corpora, "corpus")
    raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = terms.withColumn("raw", raw)
    means = terms.groupBy("corpus").agg(F.avg("raw").alias("mean_idf"))
    idf = F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw"))
    terms = terms.join(means, "corpus").select("corpus", "term", idf.alias("idf"), "mean_length")
    norm = k1 * (1 - b + b * F.col("length") / F.col("mean_length"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    weights = postings.join(terms, ["corpus", "term"]).join(sized, ["corpus", "doc"]).select("corpus", "term", "doc", weight.alias("weight"))
    return Index(sized, weights, terms.select("corpus", "term", "idf"))


def query_terms(queries: DataFrame, *, distinct: bool = False) -> DataFrame:
    """``queries``: query, corpus (if each asks one), text. One row per distinct term with its multiplicity ``qtf`` (1 if ``distinct``)."""
    words = distinct_tokens("text") if distinct else tokens("text")
    keys = [c for c in ("query", "corpus") if c in queries.columns]
    return queries.select(*keys, F.explode(words).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("qtf"))


def leading_terms(queries: DataFrame, index: Index, fallback: int = 50) -> DataFrame:
    """Distinct terms that the corpus knows; for a query with none, its first ``fallback`` terms."""
    places = queries.select("query", "corpus", F.posexplode(distinct_tokens("text")).alias("pos", "term"))
    known = places.join(index.terms.select("corpus", "term"), ["corpus", "term"], "left_semi").select("query", "corpus", "term")
    lost = places.join(known.select("query", "corpus").distinct(), ["query", "corpus"], "left_anti").where(F.col("pos") < fallback)
    return known.unionByName(lost.select("query", "corpus", "term")).withColumn("qtf", F.lit(1).cast("long"))


def scores(terms: DataFrame, index: Index, *, zeros: bool = True, places: int | None = 9) -> DataFrame:
    """(query, corpus, doc, score) of each query over its corpus (over every corpus if ``terms`` has no such column).
    With ``zeros``, documents without any term too.
    Scores are rounded to ``places`` so that the order in which terms are summed decides no rank."""
    total = F.sum(F.col("qtf") * F.col("weight"))
    on = [c for c in ("corpus", "term") if c in terms.columns]
    hits = terms.join(index.weights, on).groupBy("query", "corpus", "doc").agg((total if places is None else F.round(total, places)).alias("score"))
    if not zeros:
        return hits
    asked = terms.select("query", "corpus").distinct()
    every = asked.join(index.docs.select("corpus", "doc"), "corpus")
    return every.join(hits, ["query", "corpus", "doc"], "left").select("query", "corpus", "doc", F.coalesce("score", F.lit(0.0)).alias("score"))


def matches(terms: DataFrame, index: Index, places: int = 9) -> DataFrame:
    """(query, corpus, doc, score, matched): ``matched`` is how many of the query's distinct terms a document has."""
    on = [c for c in ("corpus", "term") if c in terms.columns]
    total = F.round(F.sum(F.col("qtf") * F.col("weight")), places)
    return terms.join(index.weights, on).groupBy("query", "corpus", "doc").agg(total.alias("score"), F.count("*").alias("matched"))


def max_scores(queries: DataFrame, terms: DataFrame, index: Index) -> DataFrame:
    """Each query's largest score over its corpus, 0 without hits or corpus."""
    best = scores(terms, index).groupBy("query", "corpus").agg(F.max("score").alias("score"))
    return queries.select("query", "corpus").distinct().join(best, ["query", "corpus"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def section_documents(paragraphs: DataFrame, text: Column, *, titled: bool = False) -> DataFrame:
    """Sections as documents. ``paragraphs``: corpus, pos, section_path, section_title. Sections are numbered in the
    order of their first paragraph; texts are joined with spaces in order; the first filled title leads the text
    (``titled``: path and title lead every paragraph, as a paragraph corpus has them)."""
    title = F.coalesce("section_title", F.lit(""))
    piece = F.concat_ws(" ", "section_path", title, text) if titled else F.coalesce(text, F.lit(""))
    grouped = paragraphs.withColumn("_t", piece).groupBy("corpus", F.col("section_path").alias("doc")).agg(
        F.min("pos").alias("first"),
        F.min_by(F.nullif(title, F.lit("")), F.when(title != "", F.col("pos"))).alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_t"))), lambda x: x["_t"]), " ").alias("body"),
    )
    whole = F.col("body") if titled else F.concat_ws(" ", "doc", "title", "body")
    order = Window.partitionBy("corpus").orderBy("first", "doc")
    return grouped.select("corpus", "doc", (F.row_number().over(order) - 1).alias("idx"), "title", whole.alias("text"))


def containing(docs: DataFrame, passages: DataFrame, *, folded: bool = False) -> DataFrame:
    """(query, corpus, doc) where a document contains a passage, upper and lower case alike if ``folded``. A passage's
    inner tokens must be tokens of the document; the rarest of them is the equality that carries the join, so that no
    document is compared with a passage that it shares nothing rare with. Passages without an inner token (short ones,
    those in other scripts) are joined by their first CHUNK characters instead, with those that begin at each place of
    a document; shorter ones yet by all they have. Blank passages match nothing."""
    terms = docs.select("corpus", "doc", F.explode(distinct_tokens("text")).alias("term"))
    w = tokens("text")
    split = passages.select("query", F.col("text").alias("passage"), F.array_distinct(F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0)))).alias("inner"))
    inner = split.select("query", "passage", F.explode("inner").alias("term"))
    few = passages.limit(FEW + 1).count() <= FEW
    held = F.broadcast if few else (lambda df: df)
    rarity = terms.join(held(inner.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rare = inner.join(rarity, "term").groupBy("query").agg(F.min_by(F.struct("passage", "term"), F.struct("df", "term")).alias("r"))
    rare = rare.select("query", "r.passage", "r.term")
    if few:  # one row a passage; the texts stay where they are
        hits = docs.select("corpus", "doc", "text", F.explode(distinct_tokens("text")).alias("term")).join(F.broadcast(rare), "term")
    else:
        hits = rare.join(terms, "term").join(docs.select("corpus", "doc", "text"), ["corpus", "doc"])
    plain = lambda c: F.lower(c) if folded else F.col(c)
    found = hits.where(F.contains(plain("text"), plain("passage"))).select("query", "corpus", "doc")
    short = split.where((F.size("inner") == 0) & (F.trim("passage") != "")).select("query", plain("passage").alias("passage"))
    short = short.withColumn("chunk", F.substring("passage", 1, CHUNK))
    lengths = [r.n for r in short.select(F.length("chunk").alias("n")).distinct().collect()]  # CHUNK numbers at most
    if not lengths:
        return found
    texts = docs.select("corpus", "doc", plain("text").alias("text"))
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("text") - n + 1, F.lit(1))), lambda k: F.substring(F.col("text"), k, F.lit(n)))
    starts = texts.select("corpus", "doc", F.explode(F.array_distinct(F.concat(*[pieces(n) for n in lengths]))).alias("chunk"))
    held = short.join(starts, "chunk").join(texts, ["corpus", "doc"]).where(F.contains("text", "passage"))
    return found.unionByName(held.select("query", "corpus", "doc"))
