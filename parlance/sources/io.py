"""Sources and sinks: transcript files, result lines, maps, CSV, the event log, parked events, bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from parlance.operators.events import first_of
from parlance.plans.scratch import materialise


def scan_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> tuple[DataFrame, DataFrame]:
    """(texts, quarantine) of the files below ``path``: path and whole text; path and why for files that are no UTF-8 or can't be read.

    A bad file does not stop the rest; a file without a byte has no row.
    Folders are listed once and every file is opened once: what is read is written as a table.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).load(path)
    read = materialise(files.select("path", F.col("content").cast("string").alias("text")))
    good = F.is_valid_utf8("text")
    listed = files.select("path")  # names only: no content is read
    lost = listed.join(read.select("path"), "path", "left_anti").select("path", F.lit("unreadable").alias("error"))
    return read.where(good), read.where(~good).select("path", F.lit("not UTF-8").alias("error")).unionByName(lost)


def write_texts(texts: DataFrame, path: str, key: str, text: str) -> None:
    """One text file per key, below a folder named after it.

    Tasks put their files in place themselves (committer of version 2): else the driver moves them, one folder after another.
    """
    rows = texts.select(key, F.col(text).alias("value")).write.partitionBy(key).option("lineSep", "\n")
    rows.option("mapreduce.fileoutputcommitter.algorithm.version", "2").mode("overwrite").text(path)


def write_maps(rows: DataFrame, path: str, source: str) -> None:
    """Map rows as JSON lines, one folder per source; the folders of other sources stay."""
    rows.write.partitionBy(source).mode("overwrite").option("partitionOverwriteMode", "dynamic").json(path)


def read_result_lines(spark: SparkSession, path: str, schema: T.StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of JSON-lines files: blank lines are skipped, malformed or incomplete ones set apart."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value").where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", schema)))
    whole = F.lit(True)
    for name in required:
        whole = whole & F.col(f"r.{name}").isNotNull()
    whole = F.coalesce(whole, F.lit(False))
    return parsed.where(whole).select("file", "r.*"), parsed.where(~whole).select("file", "value")


def first_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def append_events(events: DataFrame, path: str, first: bool = False) -> None:
    """Append events to the log at ``path``; versions of an aggregate that it holds are refused, repeats in one call count once.

    first: whether the log is new.  Of two events with one version the first by position is kept.  One writer at a time: the check and the write are two steps.
    """
    e = first_of(events, ["aggregate_id", "version"])
    if not first:
        e = e.join(events.sparkSession.read.schema(events.schema).parquet(path).select("aggregate_id", "version"), ["aggregate_id", "version"], "left_anti")
    e.write.mode("append").parquet(path)


def park(events: DataFrame, path: str, error: str) -> None:
    """Append failed events with error type, message, retries and lane; the payload as JSON."""
    payload = F.to_json(F.struct(*[c for c in events.columns if c not in ("error_message", "retries", "lane")]))
    events.select(payload.alias("event"), F.lit(error).alias("error_type"), "error_message", "retries", "lane").write.mode("append").parquet(path)


def read_parked(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.parquet(path).select(F.from_json("event", schema).alias("e"), "error_type", "error_message", "retries", "lane").select("e.*", "error_type", "error_message", "retries", "lane")


def write_bundle(files: DataFrame, path: str) -> None:
    """(bundle, path, content) rows, partitioned by bundle."""
    files.write.mode("overwrite").partitionBy("bundle").parquet(path)
