"""Tables to CSV, JSON and Markdown. Lists become strings here and nowhere earlier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType


def flat(df: DataFrame, separator: str = "|") -> DataFrame:
    """Columns as CSV has them: booleans true and false, lists of strings joined, nulls empty."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, BooleanType):
            c = F.when(c, "true").otherwise("false")
        elif isinstance(f.dataType, ArrayType):
            c = F.array_join(c if isinstance(f.dataType.elementType, StringType) else F.transform(c, lambda x: F.to_json(x)), separator)
        elif not isinstance(f.dataType, StringType):
            c = c.cast("string")
        out.append(F.coalesce(c, F.lit("")).alias(f.name))
    return df.select(*out)


def csv(df: DataFrame, path: str, columns: list[str] | None = None, *, mode: str = "error") -> bool:
    """Writes CSV that ``readers.csv`` reads back; False and no file if there are no rows."""
    if df.isEmpty():
        return False
    chosen = flat(df.select(*columns) if columns else df)
    chosen.write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", True).option("emptyValue", "").csv(path)
    return True


def json_lines(df: DataFrame, path: str, *, mode: str = "error") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def per_transition(df: DataFrame, path: str, *, mode: str = "error") -> None:
    """One folder per guide; rows are a pair of versions each."""
    df.write.mode(mode).partitionBy("guide_id").json(path)


def report(df: DataFrame) -> DataFrame:
    """Rows of metrics as one JSON text each."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A report's rows, which are few, as a Markdown table."""
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in df.limit(limit).collect()]) + "\n"


def release(df: DataFrame, path: str, approved: list[str], *, mode: str = "error") -> None:
    """Writes the approved columns and fails if one is missing."""
    missing = [c for c in approved if c not in df.columns]
    if missing:
        raise ValueError(f"columns that were approved are missing: {', '.join(missing)}")
    df.select(*approved).write.mode(mode).parquet(path)
