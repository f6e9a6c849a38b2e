"""Sinks: exports, summaries and logs, written with Spark's own writers. Keyed updates are in streaming.state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def export_by_split(rows: DataFrame, path: str, *by: str) -> None:
    """Rows as CSV with a header, in a folder per value of `by`. Values go into folder names, not into the files."""
    rows.write.mode("overwrite").partitionBy(*by).option("header", True).csv(path)


def export_sorted(rows: DataFrame, path: str, *order: str) -> None:
    """Rows as CSV in global order: files by range, each sorted, so that names and lines follow the order."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_summary(row: DataFrame, path: str) -> None:
    """A summary of one row as one JSON object."""
    row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log of JSON lines that is never rewritten."""
    rows.write.mode("append").json(path)


def append_csv(rows: DataFrame, path: str) -> None:
    """Adds rows to a folder of CSV files, each with its header."""
    rows.write.mode("append").option("header", True).csv(path)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The columns that a CSV file or folder names in its first line; no rows are read for types."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


def read_manifest(spark: SparkSession, path: str, arrays: str, images: str) -> tuple[str, DataFrame]:
    """(kind, rows) of a CSV manifest: its header says whether it lists arrays (a column array_path) or images, and so
    which schema it is read with. Columns are found by their names."""
    columns = csv_header(spark, path)
    kind, schema = ("arrays", arrays) if "array_path" in columns else ("images", images)
    return kind, spark.read.option("header", True).csv(path).selectExpr(*(f"cast(`{n.split()[0]}` AS {n.split()[1]}) AS `{n.split()[0]}`" for n in schema.split(", ")))
