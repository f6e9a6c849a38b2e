"""Streaming queries, run over the whole table and held against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.views import as_media
from ..streaming import retries, worker
from ..streaming.state import KeyedBuckets
from .common import query, stated


@query("SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    """Every event is delivered twice and comes out once."""
    twice = worker.event_stream(spark, sf_dir).union(worker.event_stream(spark, sf_dir))
    return worker.run_available(worker.deduplicated(twice, "event_id").select("event_id", "user_id", "event_type"), spark, "dedup")


@query("SELECT event_id, CASE WHEN value / 500 >= 0.9 THEN 'ban' WHEN value / 500 >= 0.7 THEN 'blur' ELSE 'safe' END AS action FROM events")
def stream_apply(spark, sf_dir):
    return worker.run_available(worker.decided(worker.event_stream(spark, sf_dir)).select("event_id", "action"), spark, "apply")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE last IS DISTINCT FROM event_type")
def stream_changed_value(spark, sf_dir):
    return worker.changed(worker.event_stream(spark, sf_dir), spark, "changed")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily(spark, sf_dir):
    days = worker.daily_counts(worker.event_stream(spark, sf_dir))
    return worker.run_available(days, spark, "daily", ["day", "event_type"]).selectExpr("date_format(day, 'yyyy-MM-dd') AS day", "event_type", "n")


@query("SELECT conv_id AS doc_id, max(turn) AS last, CASE WHEN max(turn) % 2 = 0 THEN 'even' ELSE 'odd' END AS status FROM conversations GROUP BY 1")
def keyed_updates(spark, sf_dir):
    """Turns written under their conversation's key as they come; the last turn stays."""
    path = shared_dir(spark, "documents")
    store = KeyedBuckets(f"{path}/table", "doc_id", "doc_id long, last long, status string", 16)
    turn = F.col("turn").cast("long")
    turns = worker.table_stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), turn.alias("last"), F.when(turn % 2 == 0, "even").otherwise("odd").alias("status"))
    worker.run_into(turns, path, lambda batch, number: store.upsert(batch, "last"))
    return store.read(spark).drop("bucket")


_FAILS = {0: 9, 1: 1}  # attempts that fail, by event_id modulo 5


@query(f"""WITH e AS (SELECT event_id, (epoch_ms(ts) // {retries.WAIT_MS} + 2) * {retries.WAIT_MS} AS due, (SELECT epoch_ms(max(ts)) - 86400000 FROM events) AS now FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'dead' ELSE 'done' END AS state, CASE event_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS attempts FROM e
WHERE CASE event_id % 5 WHEN 0 THEN due + {retries.WAIT_MS} <= now WHEN 1 THEN due <= now ELSE true END""")
def dead_letters(spark, sf_dir):
    """Items that fail always, at first only, or never; what still waits a day before the last event has no row."""
    own = retries.stateful_session(spark)

    def attempt(items, number):
        return (number > items["event_id"].mod(5).map(_FAILS).fillna(0)).to_numpy()

    ended = retries.with_retries(worker.event_stream(own, sf_dir).select("event_id", "ts"), "event_id", attempt, late="1 day")
    return worker.run_available(ended, own, "retries")


@stated("""SELECT conv_id, max(level) AS level, CASE max(level) WHEN 2 THEN 'banned' WHEN 1 THEN 'sensitive' ELSE 'active' END AS status, count(*) AS media FROM {media_items}
WHERE status IN ('active', 'pending') AND NOT coalesce(is_moderated, false) AND NOT coalesce(is_sensitive, false) AND (mime LIKE 'image/%' OR mime LIKE 'video/%') GROUP BY conv_id""")
def stream_moderation(spark, sf_dir):
    """Messages delivered twice, moderated once."""
    path = shared_dir(spark, "moderation")
    flow = worker.Moderation(path, "conv_id", "bigint", 16)
    messages = worker.table_stream(spark, sf_dir, "conversations")
    media = as_media(messages.union(messages)).withColumn("item", F.concat_ws(":", F.col("conv_id").cast("string"), F.col("msg_id").cast("string")))
    worker.run_into(media, path, flow.round)
    return flow.outcome(spark)
