"""SimHash near-dedup by multi-index hashing (operator 9).

A text's fingerprint has a bit for each bit that over half of its shingles' XXH64 hashes set. Two fingerprints link
when they differ in RADIUS = 2 bits or fewer. Each fingerprint has two 32-bit segments; of a linked pair's segments
the first differs in at most one bit or the second is equal, so the first table is asked for a Hamming ball of radius
1 and the second for equal segments (a pair that differs in one bit of the first is found from the side where the
bit is 0, once). What the tables return is verified over all 64 bits.

Segments that over BUCKET distinct fingerprints share are not paired: every fingerprint that holds or asks for such a
segment instead names the 65 values within one bit of itself, and two fingerprints differ in at most 2 bits exactly
when they name a common value. That way is exact too, and linear in the size of the group.

Null and empty texts have fingerprint zero and link like any other; texts of fewer words than a shingle hash as one
shingle. Rows that repeat an id are rows of their own. A null doc_id never is a component's id unless all are null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import lookup, materialise, text_or_empty
from .components import components

#: Distinct fingerprints that may share a segment and still be paired one by one.
BUCKET = 32
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def shingle_hashes(text: bytes, width: int) -> list[int]:
    """XXH64 of all shingles of ``width`` words in order, repeats included; of all words if they are fewer."""
    words = text.lower().split()  # of bytes: lowers A-Z only, splits at \\x20 and \\x09-\\x0D
    flat = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(flat, 42)] if words else []
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(flat)]
    digest = xxhash.xxh64_intdigest
    return [digest(flat[a:b], 42) for a, b in zip(starts, ends, strict=True)]


def fingerprint_of(hashes: list[int] | np.ndarray) -> int:
    """The fingerprint of shingles with these hashes, as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        block = np.array(hashes[k : k + BLOCK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The fingerprint of a text, as a signed 64-bit number."""
    return fingerprint_of(shingle_hashes(text or b"", width))


def fingerprint_column(text: Column, width: int = 3) -> Column:
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return F.pandas_udf(of, LongType())(text.cast("binary"))


def _first(fp: Column) -> Column:
    return F.shiftrightunsigned(fp, 32)


def _second(fp: Column) -> Column:
    return fp.bitwiseAND(F.lit(0xFFFFFFFF))


def _bit(i: Column) -> Column:
    """1 shifted left by ``i``; the shift is of a long."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _segments(fps: DataFrame) -> DataFrame:
    tables = F.array(F.struct(F.lit(0).alias("t"), _first(F.col("fp")).alias("key")), F.struct(F.lit(1).alias("t"), _second(F.col("fp")).alias("key")))
    return fps.select("fp", F.inline(tables))


def _probes(fps: DataFrame) -> DataFrame:
    """What each fingerprint asks the tables for; ``same``: for a segment equal to its own."""
    first = _first(F.col("fp"))
    flips = F.filter(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: first.bitwiseOR(_bit(i))), lambda v: v != first)
    asked = F.concat(
        F.array(F.struct(F.lit(0).alias("t"), first.alias("key"), F.lit(True).alias("same"))),
        F.array(F.struct(F.lit(1).alias("t"), _second(F.col("fp")).alias("key"), F.lit(True).alias("same"))),
        F.transform(flips, lambda v: F.struct(F.lit(0).alias("t"), v.alias("key"), F.lit(False).alias("same"))),
    )
    return fps.select("fp", F.inline(asked))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) over distinct fingerprints ``fp`` with the components of all pairs that differ in 2 bits or fewer;
    between fingerprints that crowd a bucket, edges go to the smallest that names a common value."""
    entries, probes = _segments(fps), _probes(fps)
    crowded = materialise(entries.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("t", "key"), "crowded")
    any_crowded = not crowded.isEmpty()
    sparse = entries.join(crowded, ["t", "key"], "left_anti") if any_crowded else entries
    pairs = (
        probes.join(sparse.withColumnRenamed("fp", "v"), ["t", "key"])
        .where(~F.col("same") | (F.col("fp") < F.col("v")))
        .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= 2)
        .select(F.col("fp").alias("u"), "v")
    )
    if not any_crowded:
        return pairs
    part = materialise(probes.join(crowded, ["t", "key"], "left_semi").select("fp").distinct(), "crowd")
    named = part.select(
        "fp",
        F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(_bit(i))))).alias("value"),
    )
    hub = named.groupBy("value").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    crowd = named.join(hub, "value").where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()
    return pairs.unionByName(crowd)


def simhash_components(docs: DataFrame, *, width: int = 3, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (signed), component_id (the smallest doc_id reachable)."""
    prints = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(text_or_empty(), width).alias("fp")), "prints"
    )
    fps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "fps")
    roots = components(links(fps.select("fp"), bucket))
    rooted = fps.join(roots, fps.fp == roots.node, "left").withColumn("root", F.coalesce("root", "fp")).drop("node")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    final = materialise(rooted.join(least, "root").select("fp", "rows", "component_id"), "classes")
    return lookup(prints, final, "fp", "rows", prints.count()).select("doc_id", "fp", "component_id")
