"""Derived relations the queries work on, each with the SQL that defines the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_split, sample_order, stable_id
from ..operators.curation import ranked
from ..session import table
from .listings import MEDIA_LISTING, media_listing


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame scores of videos: one row per event of a user, in time order. Events are numbered day by day, so a user with
    any share of all events is dealt to as many tasks as there are days."""
    events = table(spark, sf_dir, "events").select(
        "user_id",
        "ts",
        "event_id",
        F.least(F.col("value") / 500, F.lit(1.0)).alias("score"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("score2"),
    )
    placed = ranked(events, ["user_id"], "ts", "event_id", name="_place", bucket=F.to_date("ts"))
    return placed.select(F.col("user_id").alias("video_id"), (F.col("_place") - 1).alias("frame_idx"), "score", "score2")


FRAMES = """frames AS (SELECT user_id AS video_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame_idx,
  least(value / 500, 1.0::DOUBLE) AS score, json_extract_string(props, '$.k')::DOUBLE / 100 AS score2 FROM events)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score sequences of videos in frame order."""
    events = table(spark, sf_dir, "events")
    row = F.struct("ts", "event_id", F.least(F.col("value") / 500, F.lit(1.0)).alias("a"), (F.get_json_object("props", "$.k").cast("double") / 100).alias("b"))
    ordered = events.groupBy(F.col("user_id").alias("video_id")).agg(F.array_sort(F.collect_list(row)).alias("r"))
    return ordered.select("video_id", F.transform("r", lambda x: x["a"]).alias("x"), F.transform("r", lambda x: x["b"]).alias("y"))


SERIES = f"""{FRAMES}, series AS (SELECT video_id, list(score ORDER BY frame_idx) AS x, list(score2 ORDER BY frame_idx) AS y FROM frames GROUP BY 1)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media items: documents with their labels, group and hash split."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    key = F.col("doc_id").cast("string")
    path = F.concat_ws("/", "source", "lang", F.concat(key, F.lit(".txt")))
    return docs.select(
        "doc_id",
        stable_id(F.col("source"), path).alias("sample_id"),
        "source",
        "lang",
        path.alias("path"),
        F.md5("text").alias("md5"),
        F.concat(F.col("source"), F.lit(":"), F.md5("text")).alias("group_id"),
        F.coalesce("toxic", F.lit(0)).cast("int").alias("violence"),
        (1 - F.coalesce("quality", F.lit(1))).cast("int").alias("nsfw"),
        hash_split(key).alias("split"),
        F.when(F.col("doc_id") % 10 == 0, "test").otherwise("").alias("locked_split"),
        sample_order(42, F.col("doc_id")).alias("draw"),
    )


BUCKET = "((('0x' || substr(md5({0}), 1, 8))::BIGINT * 36 + ('0x' || substr(md5({0}), 9, 8))::BIGINT * 16 + ('0x' || substr(md5({0}), 17, 8))::BIGINT * 96 + ('0x' || substr(md5({0}), 25, 8))::BIGINT) % 100)"
_B = BUCKET.format("doc_id::VARCHAR")
MANIFEST = f"""manifest AS (SELECT doc_id, source || '_' || substr(sha1(source || '/' || lang || '/' || doc_id || '.txt'), 1, 12) AS sample_id, source, lang,
  source || '/' || lang || '/' || doc_id || '.txt' AS path, md5(text) AS md5, source || ':' || md5(text) AS group_id,
  coalesce(toxic, 0)::INT AS violence, (1 - coalesce(quality, 1))::INT AS nsfw,
  CASE WHEN {_B} < 80 THEN 'train' WHEN {_B} < 90 THEN 'val' ELSE 'test' END AS split,
  CASE WHEN doc_id % 10 = 0 THEN 'test' ELSE '' END AS locked_split, md5('42:' || doc_id) AS draw
  FROM documents LEFT JOIN labels USING (doc_id))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and a pseudo score for two labels of each labelled item."""
    noise = F.conv(F.substring(F.md5(F.concat("label", F.lit(":"), F.col("doc_id").cast("string"))), 1, 6), 16, 10).cast("double") / 16777215
    rows = table(spark, sf_dir, "labels").select("doc_id", F.explode(F.create_map(F.lit("violence"), F.col("toxic").cast("int"), F.lit("nsfw"), (1 - F.col("quality")).cast("int"))).alias("label", "y"))
    return rows.select("doc_id", "label", "y", F.round(0.35 * F.col("y") + 0.65 * noise, 2).alias("score"), F.concat(F.lit("bucket"), (F.col("doc_id") % 3).cast("string")).alias("bucket"))


PREDICTIONS = """long_labels AS (SELECT doc_id, 'violence' AS label, toxic::INT AS y FROM labels UNION ALL SELECT doc_id, 'nsfw', (1 - quality)::INT FROM labels),
predictions AS (SELECT doc_id, label, y, round(0.35::DOUBLE * y + 0.65::DOUBLE * (('0x' || substr(md5(label || ':' || doc_id), 1, 6))::BIGINT::DOUBLE / 16777215), 2) AS score,
  'bucket' || (doc_id % 3) AS bucket FROM long_labels)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label", hash_split(F.col("vec_id").cast("string")).alias("split"))


_V = BUCKET.format("vec_id::VARCHAR")
FEATURES = f"""features AS (SELECT vec_id, embedding::DOUBLE[] AS v, label, CASE WHEN {_V} < 80 THEN 'train' WHEN {_V} < 90 THEN 'val' ELSE 'test' END AS split FROM embeddings)"""


def media_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_media(table(spark, sf_dir, "conversations"))


def as_media(c: DataFrame) -> DataFrame:
    """Messages as moderation items."""
    size = F.length("text")
    return c.select(
        "conv_id", F.col("turn").alias("msg_id"), "role", size.alias("size"),
        F.when(size % 3 == 0, "video/mp4").when(size % 3 == 1, "image/png").otherwise("text/plain").alias("mime"),
        F.when(size % 7 == 0, "deleted").when(size % 7 == 1, "pending").otherwise("active").alias("status"),
        F.when(size % 5 == 0, F.lit(True)).when(size % 5 == 1, F.lit(False)).alias("is_moderated"),
        F.when(size % 11 == 0, F.lit(True)).when(size % 11 == 1, F.lit(False)).alias("is_sensitive"),
        (size % 3).alias("level"), F.concat(F.lit("reason "), (size % 4).cast("string")).alias("reason"),
    )


MEDIA = """media_items AS (SELECT conv_id, turn AS msg_id, role, length(text)::INT AS size,
  CASE length(text) % 3 WHEN 0 THEN 'video/mp4' WHEN 1 THEN 'image/png' ELSE 'text/plain' END AS mime,
  CASE length(text) % 7 WHEN 0 THEN 'deleted' WHEN 1 THEN 'pending' ELSE 'active' END AS status,
  CASE length(text) % 5 WHEN 0 THEN true WHEN 1 THEN false END AS is_moderated, CASE length(text) % 11 WHEN 0 THEN true WHEN 1 THEN false END AS is_sensitive,
  (length(text) % 3)::INT AS level, 'reason ' || (length(text) % 4) AS reason FROM conversations)"""

VIEWS = {
    "frames": (frames, FRAMES),
    "series": (series, SERIES),
    "manifest": (manifest, MANIFEST),
    "predictions": (predictions, PREDICTIONS),
    "features": (features, FEATURES),
    "media_items": (media_items, MEDIA),
    "media_listing": (media_listing, MEDIA_LISTING),
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def with_views(sql: str, *names: str) -> str:
    """The SQL with the definitions of the views it reads."""
    body = sql.strip()
    if "{views}" in body:  # a recursive query says itself where they go
        return body.replace("{views}", "".join(f"{VIEWS[n][1]},\n" for n in names))
    extra = body[4:].lstrip() if body.upper().startswith("WITH") else ""
    head = ",\n".join(VIEWS[n][1] for n in names if n in VIEWS)
    if not head:
        return body
    return f"WITH {head},\n{extra}" if extra else f"WITH {head}\n{body}"
