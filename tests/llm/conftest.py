import pytest

#: Nulls in every column, empty and blank texts, a very long text, ties, repeated rows and columns whose names the
#: operators use inside.
CLASH = "key string, digest string, rank long, node long, fp string, size long, bucket long, _id long, content string, label int"


def rows():
    long = "word " * 30_000 + "end"
    base = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 68),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 68),
        (3, "The  quick brown fox jumps over the lazy dog near the river bank today ", "en", "b", 70),
        (4, None, "en", "b", None), (5, "", None, None, 0), (6, " \t\n", "de", None, 3), (None, "no id at all", "en", "a", 12), (None, None, None, None, None),
        (7, long, "en", "a", len(long)), (8, "Über straße İstanbul Kelvin \U0001f600 ünïcode", "de", "c", 40),
        (9, "Released under the MIT License. cc by-nc and more; Licensed under the Apache License, Version 2.0.", "en", "c", 96),
        (10, "x", "en", "c", 1), (10, "x", "en", "c", 1), (11, "ab", "en", "c", 2), (12, "a|b %%% !!! $$$", "en", "b", 15),
    ]
    return [r + ("k", "d", 1, 2, "f", 3, 4, 5, "c", 1) for r in base]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + CLASH


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
