"""Table access and the shared folder."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or a ValueError that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_column(df: DataFrame, *names: str) -> str:
    """The first of the names that df has, for tables that call a column differently."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of the columns {', '.join(names)}")


@cache
def _own_folder() -> str:
    import tempfile

    return tempfile.mkdtemp(prefix="tamis-")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name in spark.checkpoint.dir, which driver and executors share.

    Where that is unset, a local session gets a temporary folder of its own; on a cluster it's an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _own_folder()

    import uuid

    return f"{root.rstrip('/')}/tamis-{label}-{uuid.uuid4().hex}"
