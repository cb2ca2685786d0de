"""Token counts as delta-maintained rollups (operator 4).

A change to a document has an image before and an image after: inserts lack the first, deletes the second, revised
counts have both, and may move a document to another source, language or tokenizer version. Every image becomes a
signed row; a batch's signed rows are summed by (source, lang, tokenizer), and these sums are added to the totals that
the version before holds, which have one row a group. So a batch reads its own changes and the totals, never what
came before it, and a reader reads one version.

A version is a folder of totals and of the names of the batches in them. It counts from when its entry is in the log,
which names the folder; an entry is put there by a rename that fails if there is one of its number, so of two writers
one is the first and the other starts again from its version. A batch id that a version has already is left alone,
whatever it brings, and folders that a lost job left are named by no entry. Nulls in the grouping columns are groups
of their own, null counts are 0, groups that come to no documents and no tokens are not kept.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import materialise, text_or_empty
from .packing import encoder

GROUP = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


def count_tokens(text: Column, ranks_path: str) -> Column:
    """The number of byte-pair tokens of whole texts; null counts as empty."""

    def of(texts: pd.Series) -> pd.Series:
        encode = encoder(ranks_path)
        return pd.Series([len(encode(t or "")) for t in texts], dtype="int64")

    return F.pandas_udf(of, LongType())(text)


def signed(changes: DataFrame) -> DataFrame:
    """``changes``: ``before`` and ``after``, structs of source, lang, tokenizer and tokens, or null."""

    def image(name: str, sign: int) -> Column:
        tokens = F.coalesce(F.col(f"{name}.tokens"), F.lit(0)).cast("long") * sign
        kept = [F.col(f"{name}.{c}").cast("string").alias(c) for c in GROUP]
        return F.when(F.col(name).isNotNull(), F.struct(*kept, F.lit(sign).cast("long").alias("documents"), tokens.alias("tokens")))

    images = F.filter(F.array(image("before", -1), image("after", 1)), lambda x: x.isNotNull())
    return changes.select(F.inline(images))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*GROUP).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals kept under ``path``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self._fs = spark._jvm.org.apache.hadoop.fs
        at = self._fs.Path(path)
        self._store = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self._store.makeQualified(at).toString()

    def _at(self, *parts: str):
        return self._fs.Path("/".join([self.path, *parts]))

    def _entries(self) -> list[str]:
        log = self._at("log")
        return sorted(s.getPath().getName() for s in self._store.listStatus(log)) if self._store.exists(log) else []

    def _latest(self) -> tuple[int, str | None]:
        """The number and the folder of the version that counts."""
        entries = [e for e in self._entries() if not e.startswith(".")]
        if not entries:
            return 0, None
        stream = self._store.open(self._at("log", entries[-1]))
        try:
            said = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return int(entries[-1]), said["folder"]

    def _publish(self, number: int, batch: str, folder: str) -> bool:
        """Enters a version in the log; False if there is one of its number."""
        made, entry = self._at("log", f".{uuid.uuid4().hex}"), self._at("log", f"{number:012d}")
        stream = self._store.create(made, False)
        stream.write(json.dumps({"batch": batch, "folder": folder}).encode())
        stream.close()
        context = self._fs.FileContext.getFileContext(entry.toUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        try:
            context.rename(made, entry, no_options)
        except Exception as e:
            self._store.delete(made, False)
            if "AlreadyExists" not in str(e):
                raise
            return False
        return True

    def _totals(self, folder: str | None) -> DataFrame:
        if folder is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{folder}/totals")

    def _batches(self, folder: str | None) -> DataFrame:
        if folder is None:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(f"{self.path}/{folder}/batches")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch once; False if it had been applied before."""
        deltas = None
        while True:
            number, before = self._latest()
            if not self._batches(before).where(F.col("batch") == batch).isEmpty():
                return False
            if deltas is None:
                deltas = materialise(_summed(signed(changes)), "deltas")
            folder = f"versions/{number + 1:012d}-{uuid.uuid4().hex}"
            after = _summed(self._totals(before).unionByName(deltas)).where("documents <> 0 or tokens <> 0")
            after.write.parquet(f"{self.path}/{folder}/totals")
            named = self._batches(before).unionByName(self.spark.createDataFrame([(batch,)], "batch string"))
            named.write.parquet(f"{self.path}/{folder}/batches")
            if self._publish(number + 1, batch, folder):
                return True
            self._store.delete(self._at(folder), True)

    def totals(self) -> DataFrame:
        """One row per group that has documents or tokens."""
        return self._totals(self._latest()[1])

    def vacuum(self) -> None:
        """Deletes all versions but the one that counts; no one may be reading or committing."""
        number, folder = self._latest()
        if folder is None:
            return
        for entry in self._entries():
            if entry != f"{number:012d}":
                self._store.delete(self._at("log", entry), False)
        for held in self._store.listStatus(self._at("versions")):
            if f"versions/{held.getPath().getName()}" != folder:
                self._store.delete(held.getPath(), True)


def counted(docs: DataFrame, tokenizer: str, ranks_path: str) -> DataFrame:
    """doc_id, and ``image``: what a document adds to the totals under a tokenizer."""
    image = F.struct("source", "lang", F.lit(tokenizer).alias("tokenizer"), count_tokens(text_or_empty(), ranks_path).alias("tokens"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), image.alias("image"))
