"""Document fingerprints as quartile bucket digests (operator 8).

Every three successive bytes of a text are hashed into one of BUCKETS counters. The digest has two hexadecimal digits
of a logarithmic length, two of the counters' mean on the same scale, and for each counter two bits: which quartile of
the counters its count is in. Two digests differ by the bodies' sum of quartile distances (steps of 1, 2 and, for
opposite quartiles, 6) and by what their lengths differ beyond one step; likeness is 1 less that, as a share of
BOUND, which no two digests exceed, and 0 at least.

Texts of under three bytes have counters of zero only: their digests differ by length alone. Null counts as empty.
The next document is the one of the next larger doc_id (nulls first; of equal ids by a hash of the text), that of the
last is the first; a document alone in its table is its own next. Rows that repeat an id are documents each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

BUCKETS = 256
BOUND = BUCKETS * 2.0
STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.float64)
BLOCK = 1 << 20
MAX_RANGES = 20_000
RANGE_ROWS = 2048
#: Stands for a null id when ranges are dealt.
NO_ID = int(np.iinfo(np.int64).min)


def counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit by the byte triplets of ``data``."""
    out = np.zeros(BUCKETS, np.int64)
    for k in range(0, len(data) - 2, BLOCK):
        b = np.frombuffer(data, np.uint8)[k : k + BLOCK + 2].astype(np.uint32)
        triplet = b[:-2] | b[1:-1] << 8 | b[2:] << 16
        out += np.bincount(triplet * np.uint32(0x9E3779B1) >> np.uint32(24), minlength=BUCKETS)
    return out


def digest(data: bytes) -> str:
    c = counts(data)
    low, middle, high = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    quartile = (c > low).astype(np.uint8) + (c > middle) + (c > high)
    body = np.packbits(np.stack([quartile >> 1, quartile & 1], axis=1).ravel())
    step = lambda x: min(255, round(8 * np.log1p(x)))
    return f"{step(len(data)):02x}{step(c.mean()):02x}{body.tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """From 0 to 1; 1 for equal digests."""
    if a == b:
        return 1.0
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(a[4:] + b[4:]), np.uint8)).reshape(2, BUCKETS, 2)
    q = bits[..., 0] * 2 + bits[..., 1]
    apart = STEP[q[0], q[1]].sum() + 4 * max(0, abs(int(a[:2], 16) - int(b[:2], 16)) - 1)
    return float(max(0.0, 1 - apart / BOUND))


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by the beginning of the next document."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (range, peek, doc_id, text_hash); each is compared with the one after it in its range. A
    range ends with peeks, the first of which is the document that follows its last."""
    held: tuple | None = None  # range, doc_id, text, digest
    closed = None
    for batch in batches:
        out = []
        for at, peek, doc, text in zip(batch["range"], batch["peek"], batch["doc_id"], batch["text"], strict=True):
            if closed == at:
                continue
            own = digest(text.encode())
            if held is not None and held[0] == at:
                changed = edited(held[2], text).encode()
                mark = digest(changed)
                out.append((held[1], len(held[2]), hashlib.sha256(changed).hexdigest(), held[3], mark, likeness(held[3], mark), likeness(held[3], own)))
            held = None if peek else (at, doc, text, own)
            closed = at if peek else None
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        yield frame.astype({"doc_id": "Int64"})


def fingerprints(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per row of ``docs``: OUT. Documents are dealt into ranges of doc_id, about ``range_rows`` rows each and
    MAX_RANGES at most; a range's first documents go to the range before it as well, as a peek. Ranges are read in
    order as a stream, so a long range costs no memory."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    spark = docs.sparkSession
    ids = rows.select("doc_id")
    n, least = ids.agg(F.count("*"), F.count("doc_id")).first()
    if not n:
        return spark.createDataFrame([], OUT)
    wanted = min(MAX_RANGES, max(1, n // range_rows))
    cuts = ids.where("doc_id is not null").stat.approxQuantile("doc_id", [k / wanted for k in range(wanted)], 0.2 / wanted) if least else []
    # Quantiles are doubles, which large ids don't survive: the ranges' smallest ids are the exact bounds.
    rough = np.unique(np.array(cuts, np.float64))
    nearest = np.clip(rough, -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
    marked = ids.where("doc_id is not null").mapInPandas(_ranged(nearest), "doc_id long, range long, first boolean")
    found = marked.groupBy("range").agg(F.min("doc_id").alias("least")).collect()  # MAX_RANGES rows at most
    bounds = np.array(sorted([r.least for r in found] + ([NO_ID] if least < n else [])), np.int64)  # nulls come first
    return _dealt(rows, _ranged(bounds), len(bounds), deal_keys(spark, len(bounds)))


def _ranged(bounds: np.ndarray):
    """Adds to rows with doc_id the range that they fall in, and whether they begin it."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch["doc_id"].astype("Int64").fillna(NO_ID).to_numpy(np.int64)
            k = np.maximum(np.searchsorted(bounds, at, side="right") - 1, 0)
            yield batch.assign(doc_id=batch["doc_id"].astype("Int64"), range=k, first=at == bounds[k])

    return deal


def deal_keys(spark: SparkSession, tasks: int) -> DataFrame:
    """(range, key): for each range a number whose hash sends it to a task of its own; MAX_RANGES rows at most."""
    tried = spark.range(tasks * (20 + tasks.bit_length())).select(F.col("id").cast("int").alias("key"))
    return tried.groupBy(F.pmod(F.hash("key"), F.lit(tasks)).cast("long").alias("range")).agg(F.min("key").alias("key"))


def _dealt(rows: DataFrame, deal, ranges: int, keys: DataFrame) -> DataFrame:
    hashed = rows.withColumn("text_hash", F.xxhash64("text"))
    dealt = hashed.mapInPandas(deal, "doc_id long, text string, text_hash long, range long, first boolean")
    before = F.pmod(F.col("range") - 1, F.lit(ranges))
    both = F.array(
        F.struct(F.col("range"), F.lit(0).alias("peek")),
        F.when(F.col("first"), F.struct(before.alias("range"), F.lit(1).alias("peek"))),
    )
    sent = dealt.select("doc_id", "text", "text_hash", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("to"))
    sent = sent.select("to.range", "to.peek", "doc_id", "text", "text_hash").join(F.broadcast(keys), "range", "left")
    # As many tasks as ranges, so that a task stays as small as it is however large the table.
    ordered = sent.repartition(max(1, ranges), F.coalesce("key", F.col("range").cast("int")).alias("key")).sortWithinPartitions("range", "peek", "doc_id", "text_hash")
    return ordered.select("range", "peek", "doc_id", "text").mapInPandas(_walk, OUT)
