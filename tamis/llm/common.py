"""What the operators of this subpackage share: word splitting, scratch tables, Arrow helpers.

Conventions that hold for every operator here, unless its docstring says otherwise:

* a null text counts as an empty text; a null ``doc_id`` is carried through;
* every row of the input gives its row(s) of output, so repeated rows stay repeated;
* columns other than the ones an operator reads may have any name and are ignored or carried along;
* an empty table gives an empty table of the same schema.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are maximal runs of anything but these ASCII blanks; bytes.split() uses the same six.
BLANK = r"\x20\x09-\x0D"
#: A-Z to a-z, every other byte unchanged.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: As above, and every ASCII byte that is neither a digit nor a letter becomes a blank.
ALNUM_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in LOWER_BYTES)
U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_bytes(text: str = "text") -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below spark.checkpoint.dir, the folder that driver and executors share.

    Where that is unset, a local session gets a temporary folder of its own; on a cluster it's an error, for each
    machine would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="tamis-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/tamis-{label}-{uuid.uuid4().hex}"
    if (handed_out := _handed_out.get()) is not None:
        handed_out.append(path)
    return path


_handed_out: ContextVar[list[str] | None] = ContextVar("handed_out", default=None)


@contextmanager
def scratch_deleted() -> Iterator[None]:
    """Deletes, at the end, every folder that `scratch_dir` has named inside: for work whose result is stored elsewhere."""
    token = _handed_out.set([])
    try:
        yield
    finally:
        paths = _handed_out.get()
        _handed_out.reset(token)
    for path in paths:
        with suppress(FileNotFoundError):  # nothing was written there, or it is gone already
            deleted(path)


#: Has Spark delete an execution's shuffle files at its end rather than when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, path: str, compression: str | None = None, by: list[str] | None = None, dictionary: bool = True) -> DataFrame:
    """df, computed once into a Parquet table at `path`: cuts the lineage and survives lost executors.

    The columns `by`, if any, name folders of it. Without dictionary, as is right for long binary values, which seldom
    occur twice, none of them is hashed for one.

    What its plan shuffled is deleted when the table is written, so df isn't to be used again.
    """
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path, partitionBy=by, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """df, stored in a new folder of the shared one."""
    return stored(df, scratch_dir(df.sparkSession, label))


def file_system(uri: str):
    """(file system, path) of a folder; the scheme decides (file, hdfs, s3, ...)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def deleted(path: str) -> None:
    """Deletes a stored table that nothing reads any more."""
    files, root = file_system(path)
    files.delete_dir(root)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every input bit over the result."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all runs of n consecutive word hashes."""
    size = len(words) - n + 1
    if size <= 0:
        return np.empty(0, U64)
    out = np.full(size, n, U64)
    for i in range(n):
        out = mix(out * U64(0x9E3779B97F4A7C15) + words[i : i + size])
    return out


def numbered(rows: DataFrame, groups: list[str], order: list[Column], name: str, carried: DataFrame | None = None) -> DataFrame:
    """rows with their number, from 1, among those of their group in the given order; rows that tie may change places.

    Range partitions hold the rows in order. Each is counted, its rows are numbered within it, and all are moved on by
    what the partitions before hold, so a group of any size is dealt to many tasks. The counts are a row per partition
    and one more per group. `carried` has a row per group, whose columns are added. rows are stored once, for partitions
    must not change between the count and the numbers.
    """
    by = [F.col(g).asc_nulls_last() for g in groups]
    ranged = written(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), f"ranged-{name}")
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_part", *groups).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", *groups, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    if carried is not None:
        starts = same(starts, carried, groups)
    here = Window.partitionBy("_part", *groups).orderBy(*order)
    found = same(ranged.withColumn(name, F.row_number().over(here)), starts, ["_part", *groups])
    return found.withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The inner join on columns in which null equals null."""
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    found = left.join(right, [left[c].eqNullSafe(right[f"_right_{c}"]) for c in on])
    return found.drop(*(f"_right_{c}" for c in on))
