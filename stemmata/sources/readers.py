"""Tables from CSV, JSON, text and binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

PARAGRAPH = (
    "change_type string, section_path string, section_title string, section_level int, para_num_a int, para_num_b int, similarity double, "
    "text_a string, text_b string, char_hash_a string, char_hash_b string, citations_added array<string>, citations_removed array<string>, "
    "moved_from string, moved_to string"
)
EVENT = "change_type string, path string, title string, level int, title_a string, title_b string"
#: The nested file of one pair of versions.
DIFF = (
    "version_a string, version_b string, delta_days int, guide_title string, "
    "summary struct<total_para_changes:int,paragraph_changes:map<string,int>,section_events:map<string,int>,cited_cases_added:int,cited_cases_removed:int>, "
    f"section_events array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>, "
    f"paragraph_changes array<struct<{PARAGRAPH.replace(', ', ',').replace(' ', ':')}>>, "
    "cited_cases_diff struct<added:array<string>,removed:array<string>>"
)
GROUPED = (
    "guide_id string, guide_title string, from_version string, to_version string, from_snapshot string, to_snapshot string, "
    "from_wayback_url string, to_wayback_url string, from_hf_url string, to_hf_url string, added array<string>, removed array<string>"
)
METADATA = "guide_id string, title string, timestamp string, local_path string, wayback_url string"
REPORT = "split string, model string, threshold double"
DIFF_NAME = r"diff_(\d{4}-\d{2}-\d{2})__(\d{4}-\d{2}-\d{2})\.json$"


def csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """CSV with a header; all columns are strings, empty cells are empty strings, quoted cells may span lines."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\0").option("emptyValue", "")
    if columns is not None:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns])).option("enforceSchema", False)
    return reader.csv(path).na.fill("")


def csv_or_empty(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The CSV, or no rows if there is none at that path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return csv(spark, path, columns)
    return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns]))


def numbered(df: DataFrame, name: str = "idx") -> DataFrame:
    """Adds each row's place in its input: by file, then by place in the file."""
    keyed = df.withColumn("_file", F.input_file_name()).withColumn("_at", F.monotonically_increasing_id())
    return keyed.withColumn(name, F.struct("_file", "_at")).drop("_file", "_at")


def keyed(df: DataFrame, keys: list[str], idx: str = "idx", *, last: bool = True) -> DataFrame:
    """One row per key: the last in the order of ``idx``, or the first."""
    order = F.desc(idx) if last else F.asc(idx)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def json_array(spark: SparkSession, path: str, schema: str = GROUPED) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of string lists: (key, citations); keys ``guide/file`` are split into guide_id and pdf_name."""
    whole = spark.read.option("wholetext", True).text(path)
    pairs = whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("key", "citations"))
    return pairs.select("key", F.substring_index("key", "/", 1).alias("guide_id"), F.substring_index("key", "/", -1).alias("pdf_name"), "citations")


def json_lines(spark: SparkSession, path: str | list[str], schema: str = METADATA) -> DataFrame:
    """One object per line; blank lines are no rows."""
    return spark.read.schema(schema).json(path)


def guide_titles(metadata: DataFrame, idx: str = "idx") -> DataFrame:
    """Each guide's title: that of its last line."""
    return metadata.groupBy("guide_id").agg(F.max_by("title", idx).alias("guide_title"))


def diff_files(spark: SparkSession, folder: str) -> DataFrame:
    """All diff files under ``folder/guide/diff_a__b.json`` with guide_id, from_date, to_date from their paths."""
    found = spark.read.schema(DIFF).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "diff_*.json").json(folder)
    path = F.col("_metadata.file_path")
    return found.select(
        F.element_at(F.split(path, "/"), -2).alias("guide_id"), F.regexp_extract(path, DIFF_NAME, 1).alias("from_date"),
        F.regexp_extract(path, DIFF_NAME, 2).alias("to_date"), "*",
    ).where("from_date <> ''")


def diff_paragraphs(diffs: DataFrame) -> DataFrame:
    """One row per changed paragraph of the nested rows, with its place ``pos``."""
    return diffs.select("guide_id", "from_date", "to_date", F.posexplode("paragraph_changes").alias("pos", "_p")).select("guide_id", "from_date", "to_date", "pos", "_p.*")


def section_titles(diffs: DataFrame) -> DataFrame:
    """Titles from section events: what a section without title in its paragraphs falls back on."""
    e = diffs.select("guide_id", "from_date", "to_date", F.explode("section_events").alias("e"))
    return e.select("guide_id", "from_date", "to_date", "e.path", F.coalesce("e.title", "e.title_b", "e.title_a").alias("title"))


def texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole text files: (path, text). Bytes that aren't UTF-8 become replacement marks."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, line_no, text) of text files."""
    return texts(spark, path).select("path", F.posexplode(F.split("text", r"\R")).alias("line_no", "text"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, content) of binary files; listing alone doesn't read the contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def snapshots(metadata: DataFrame, present: DataFrame, idx: str = "idx") -> DataFrame:
    """Metadata rows whose file is present (``present``: name), with the guide's id and title from its first row."""
    head = metadata.groupBy("guide_id").agg(F.min_by("title", idx).alias("guide_title"))
    named = metadata.withColumn("name", F.element_at(F.split("local_path", "/"), -1))
    return named.join(present.select("name").distinct(), "name", "left_semi").join(head, "guide_id").select("guide_id", "guide_title", "timestamp", F.col("name").alias("pdf_name"), "wayback_url")


def fetched_texts(index: DataFrame) -> DataFrame:
    return index.where(F.lower(F.trim("status")) == "ok")


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """What a table of cached responses lacks."""
    return wanted.join(cache.select(*keys).distinct(), keys, "left_anti")
