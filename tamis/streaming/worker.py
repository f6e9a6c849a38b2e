"""Streaming stages: source, deduplication, decision, change detection, sinks.

A restarted query goes on from its checkpoint, so no item is decided twice or lost. A run over what is there (`available`
trigger) takes all files in one batch unless told otherwise, and then holds the same rows as the batch query. In a
standing query what was handled is state: a watermark, given as `late`, or a time to live bounds it, at the price that
what comes later than that is dropped or starts anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import policy as pol
from ..operators.audit import eligible
from ..session import shared_dir, table
from .state import ChangeFollower, KeyedBuckets


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream; all its files in one batch unless limited."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema).option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a stream, with a timestamp that watermarks accept."""
    return table_stream(spark, sf_dir, "events", files_per_trigger).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, key: str, late: str | None = None) -> DataFrame:
    """Each key once. Without `late` every key is remembered, so the order and the batches of the input don't matter;
    with it, only keys of that long ago, and older events are dropped."""
    if late is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def decided(stream: DataFrame) -> DataFrame:
    """Action per item from its score; stateless."""
    score = F.least(F.col("value") / 500, F.lit(1.0))
    return stream.withColumn("action", pol.action(pol.level(score, pol.VIOLENCE_BAN, pol.VIOLENCE_BLUR)))


def daily_counts(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Tumbling days by type (an extension: the polling worker has no event-time windows)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


def changed(stream: DataFrame, spark: SparkSession, label: str, by: str = "user_id", value: str = "event_type", path: str | None = None) -> DataFrame:
    """Runs the stream and returns its events whose value differs from the one before it of the same key (see
    `state.ChangeFollower`): the same rows however the input is cut into batches, as long as these come in the order of ts."""
    path = path or shared_dir(spark, label)
    follower = ChangeFollower(f"{path}/state", by, ["ts", "event_id"], value, F.to_date("ts"), dict(stream.dtypes))
    found = run_available(stream.select(by, "ts", "event_id", value), spark, label, path=path, step=follower.found, after=follower.update)
    return found.select(by, "event_id", value)


def run_into(stream: DataFrame, path: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Hands each batch of what is there to `handle`, which has to bear being called again with the same number."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


class Moderation:
    """The worker's round as one flow: collect what is pending, apply its decisions to the documents, mark it processed.

    `media` are items with an id, a document, a level and what `audit.eligible` asks for. An item is handled once, however
    often it comes; a document's level only rises. Both tables are keyed and dealt to buckets, and a round that is run
    again collects the same items, for those it marked itself don't count as processed before it.
    """

    def __init__(self, path: str, document: str, kind: str, buckets: int = 64):
        self.document = document
        self.items = KeyedBuckets(f"{path}/items", "item", f"item string, {document} {kind}, level int, round bigint", buckets)
        self.documents = KeyedBuckets(f"{path}/documents", document, f"{document} {kind}, level int, status string", buckets)

    def collected(self, media: DataFrame, number: int) -> DataFrame:
        before = self.items.read(media.sparkSession).filter(F.col("round") < number).select("item")
        pending = eligible(media).select("item", self.document, F.col("level").cast("int").alias("level")).dropDuplicates(["item"])
        return pending.join(before, "item", "left_anti")

    def round(self, media: DataFrame, number: int) -> None:
        pending = self.collected(media, number)
        status = F.when(F.col("level") == 2, "banned").when(F.col("level") == 1, "sensitive").otherwise("active")
        self.documents.upsert(pending.groupBy(self.document).agg(F.max("level").alias("level")).withColumn("status", status), "level")
        marked = self.collected(media, number).withColumn("round", F.lit(number).cast("long"))
        self.items.upsert(marked, "round")

    def outcome(self, spark: SparkSession) -> DataFrame:
        """Documents with their status and how many of their items were handled."""
        handled = self.items.read(spark).groupBy(self.document).agg(F.count("*").alias("media"))
        return self.documents.read(spark).drop("bucket").join(handled, self.document)


def run_available(
    stream: DataFrame,
    spark: SparkSession,
    label: str,
    key: list[str] | None = None,
    path: str | None = None,
    step: Callable[[DataFrame, int], DataFrame] | None = None,
    after: Callable[[DataFrame, int], None] | None = None,
) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote.

    Each batch is written to a folder of its own number, so a batch that is run again replaces itself. With a key the
    stream is run in update mode, and of the rows of a key those of the last batch count. `step` makes of a batch what is
    written, `after` keeps what later batches need; a stream that is run again on the same `path` goes on where it stopped.
    """
    path = path or shared_dir(spark, label)
    schema = stream.schema if step is None else step(spark.createDataFrame([], stream.schema), -1).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/rows/batch=-1")  # so that there is a table at all

    def keep(batch: DataFrame, number: int) -> None:
        (step(batch, number) if step else batch).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        if after:
            after(batch, number)

    query = stream.writeStream.outputMode("update" if key else "append").foreachBatch(keep).option("checkpointLocation", path + "/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path + "/rows")
    if key:
        rest = [c for c in schema.names if c not in key]
        rows = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("last")).select(*key, "last.*")
    return rows.select(*schema.names)
