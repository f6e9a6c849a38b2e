"""State of a stream beside its checkpoint: tables of one row per key, dealt to hash buckets, of which a batch rewrites
those that it touches (Spark's dynamic partition overwrite). For use in foreachBatch: an update that is run again under
the same batch number gives the same table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.temporal import with_previous

BUCKETS = 64


class KeyedBuckets:
    """A Parquet table below `path` with a folder per bucket of the key's hash."""

    def __init__(self, path: str, key: str, schema: str, buckets: int = BUCKETS):
        self.path, self.key, self.buckets = path, key, buckets
        self.schema = f"{schema}, bucket int"

    def read(self, spark: SparkSession) -> DataFrame:
        spark.createDataFrame([], self.schema).write.mode("ignore").partitionBy("bucket").parquet(self.path)
        return spark.read.schema(self.schema).parquet(self.path)

    def update(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Puts merge(rows of the touched buckets, changes) in place of the touched buckets."""
        dealt = changes.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        touched = F.broadcast(dealt.select("bucket").distinct())  # at most as many rows as there are buckets
        old = self.read(changes.sparkSession).join(touched, "bucket", "left_semi")
        # Whole buckets go to one task each, so that a bucket is few files however often it is rewritten.
        new = merge(old, dealt).repartition("bucket")
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def upsert(self, changes: DataFrame, *order: str) -> None:
        """Of all rows of a key, those of the table and those of the changes, the one that is last in order stays. Run
        twice, in any order of batches, the result is the same."""
        rest = [c for c in changes.columns if c != self.key]

        def last(old: DataFrame, new: DataFrame) -> DataFrame:
            rows = old.unionByName(new).groupBy("bucket", self.key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
            return rows.select("bucket", self.key, "_last.*")

        self.update(changes, last)


class ChangeFollower:
    """Rows whose value differs from the one before it of the same key, batch by batch.

    A key's state is one row: the value after the last batch that had the key, and the one before that batch, so that a
    batch that is run again finds what it found the first time, also if it stopped half-way through its update. Within a
    batch, rows meet the one before them across buckets of time, so a key with a third of all rows is dealt to many tasks
    and none holds a key whole. From batch to batch rows have to come in the order of `order`.
    """

    def __init__(self, path: str, by: str, order: list[str], value: str, bucket: Column, kinds: dict[str, str]):
        self.by, self.order, self.value, self.bucket = by, order, value, bucket
        self.table = KeyedBuckets(path, by, f"{by} {kinds[by]}, batch bigint, before struct<value:{kinds[value]}>, after struct<value:{kinds[value]}>")

    def _known(self, spark: SparkSession, number: int) -> DataFrame:
        """Key and last value (a struct; null if there was none) as they were before the batch."""
        last = F.when(F.col("batch") == number, F.col("before")).otherwise(F.col("after"))
        return self.table.read(spark).select(F.col(self.by).alias("_by"), last.alias("_known"))

    def found(self, batch: DataFrame, number: int) -> DataFrame:
        rows = batch.select(self.by, *self.order, self.value)
        met = with_previous(rows, [self.by], self.order, [self.value], self.bucket, "_previous")
        value = F.col(self.value)
        later = met.filter(F.col("_previous").isNotNull() & ~value.eqNullSafe(F.col("_previous")[self.value]))
        first = met.filter("_previous IS NULL").join(self._known(batch.sparkSession, number), F.col(self.by).eqNullSafe(F.col("_by")), "left")  # a row per key
        first = first.filter(F.col("_known").isNull() | ~value.eqNullSafe(F.col("_known.value")))
        return first.select(rows.columns).unionByName(later.select(rows.columns))

    def update(self, batch: DataFrame, number: int) -> None:
        last = batch.groupBy(self.by).agg(F.struct(F.max_by(self.value, F.struct(*self.order)).alias("value")).alias("after"))

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            keys = new.select(F.col(self.by).alias("_by"))
            same = lambda rows: rows.join(keys, F.col(self.by).eqNullSafe(F.col("_by")), "left_anti")
            known = old.select(F.col(self.by).alias("_by"), F.when(F.col("batch") == number, F.col("before")).otherwise(F.col("after")).alias("before"))
            hit = new.join(known, F.col(self.by).eqNullSafe(F.col("_by")), "left").drop("_by").withColumn("batch", F.lit(number).cast("long"))
            return same(old).unionByName(hit.select(old.columns))

        self.table.update(last, merged)
