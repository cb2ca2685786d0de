"""License scans by diagonal voting (operator 3, DataFrame functions only).

All runs of K words of a text are hashed and joined with the places of the same runs in the templates; the words are
compared as well, so a hash decides nothing. A hit of template place t at text place p votes for the diagonal p - t.
Votes are counted by (text, template, diagonal). A base phrase stands where one diagonal has all its runs. For the
templates of the method, diagonals at most GAP apart form a span (words may have been put in or left out), and a span
counts if it covers COVER of the template's words and is not longer than STRETCH times the template.

Words are lower-cased from A to Z only: the other letters that lower-casing would turn into ASCII (the Kelvin sign)
are set aside first, and words with other letters equal no template word either way. Null texts are empty; texts
without hits get 0 places, empty labels and score 0. Rows that repeat id and text get the same result each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

K = 3
GAP = 2
COVER = 0.75
STRETCH = 1.5
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The phrases of the base, and public licences' own words.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights"),
    ("proprietary", "all rights reserved"),
)


def words(text: Column) -> Column:
    aside = F.replace(text, F.lit("K"), F.lit("ĸ"))
    return F.regexp_extract_all(F.lower(aside), F.lit(WORD), F.lit(0))


def _grams() -> list[tuple]:
    """Template number, whether it is a base phrase, label, words of the template, place, and the K words there."""
    out = []
    for k, (base, (label, text)) in enumerate([(True, x) for x in BASE] + [(False, x) for x in TEMPLATES]):
        w = text.split()
        out += [(k, base, label, len(w), t, *w[t : t + K]) for t in range(len(w) - K + 1)]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    text = text_or_empty()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    grams = spark.createDataFrame(_grams(), "template int, base boolean, label string, n int, t int, x string, y string, z string")
    grams = grams.withColumn("h", F.xxhash64("x", "y", "z"))

    split = keyed.select("doc_id", "th", words(F.col("text")).alias("w"))
    runs = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"), F.slice("w", 3, F.greatest(F.size("w"), F.lit(1))).alias("c"))
    rolled = split.select("doc_id", "th", F.posexplode(runs).alias("p", "r")).where("r.c is not null")
    hashed = rolled.select("doc_id", "th", "p", F.col("r.a").alias("a"), F.col("r.b").alias("b"), F.col("r.c").alias("c"), F.xxhash64("r.a", "r.b", "r.c").alias("h"))
    hits = hashed.join(F.broadcast(grams), "h").where("a = x and b = y and c = z")  # as many as TEMPLATES and BASE have
    hits = materialise(hits.select("doc_id", "th", "template", "base", "label", "n", "t", "p").distinct(), "hits")

    key = ["doc_id", "th", "template", "base", "label", "n"]
    votes = hits.groupBy(*key, (F.col("p") - F.col("t")).alias("diagonal")).agg(
        F.collect_set("t").alias("ts"), F.min("p").alias("low"), (F.max("p") + K).alias("high")
    )
    places = votes.where(F.col("base") & (F.size("ts") == F.col("n") - K + 1))
    base = places.groupBy("doc_id", "th").agg(
        F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"),
        F.array_sort(F.collect_set("label")).alias("base_set"),
    )
    along = Window.partitionBy(*key).orderBy("diagonal")
    opens = F.col("diagonal") - F.lag("diagonal").over(along) > GAP
    merged = (
        votes.where(~F.col("base"))
        .withColumn("span", F.sum(F.coalesce(opens, F.lit(True)).cast("long")).over(along))
        .groupBy(*key, "span")
        .agg(F.array_distinct(F.flatten(F.collect_list("ts"))).alias("ts"), F.min("low").alias("low"), F.max("high").alias("high"))
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + K - 1)))))
    share = F.when(F.col("high") - F.col("low") <= F.col("n") * STRETCH, covered / F.col("n")).otherwise(0.0)
    spans = merged.withColumn("share", share)
    more = spans.groupBy("doc_id", "th").agg(
        F.collect_set(F.when(F.col("share") >= COVER, F.col("label"))).alias("more"), F.max("share").alias("best")
    )
    more = more.select(F.col("doc_id").alias("m_id"), F.col("th").alias("m_th"), "more", "best")
    found = base.join(more, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("th") == F.col("m_th")), "full").select(
        F.coalesce("doc_id", "m_id").alias("f_id"), F.coalesce("th", "m_th").alias("f_th"),
        "n_base", "first_word", "last_word", "base_set", "more", "best",
    )
    counted = keyed.select("doc_id", "th", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    base_set, more_set = F.coalesce("base_set", none), F.coalesce("more", none)
    return counted.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("th") == F.col("f_th")), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.array_join(base_set, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, more_set)), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _values() -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, str) else str(x) for x in g) + ")" for g in _grams())


ORACLE = rf"""
WITH grams(template, base, label, n, t, x, y, z) AS (VALUES {_values()}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
runs AS (SELECT doc_id, unnest(list_transform(range(0, greatest(len(w) - 2, 0)), lambda i: {{'p': i, 'a': w[i + 1], 'b': w[i + 2], 'c': w[i + 3]}})) AS r FROM d),
hits AS (SELECT doc_id, template, base, label, n, t, r.p AS p FROM runs JOIN grams ON r.a = x AND r.b = y AND r.c = z),
votes AS (SELECT doc_id, template, base, label, n, p - t AS diagonal, list(DISTINCT t) AS ts, min(p) AS low, max(p) + {K} AS high
  FROM hits GROUP BY doc_id, template, base, label, n, p - t),
based AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list(DISTINCT label) AS base_set
  FROM votes WHERE base AND len(ts) = n - {K - 1} GROUP BY doc_id),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {GAP} THEN 1 ELSE 0 END AS opens FROM votes WHERE NOT base),
spanned AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM marked),
merged AS (SELECT doc_id, template, label, n, span, list_distinct(flatten(list(ts))) AS ts, min(low) AS low, max(high) AS high FROM spanned GROUP BY doc_id, template, label, n, span),
shared AS (SELECT doc_id, label, CASE WHEN high - low <= n * {STRETCH} THEN len(list_distinct(flatten(list_transform(ts, lambda t: range(t, t + {K}))))) / n::DOUBLE ELSE 0 END AS share FROM merged),
more AS (SELECT doc_id, list(DISTINCT label) FILTER (share >= {COVER}) AS more, max(share) AS best FROM shared GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(base_set), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base_set, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN based USING (doc_id) LEFT JOIN more USING (doc_id)
"""
