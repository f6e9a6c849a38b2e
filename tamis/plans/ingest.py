"""Parsing queries: lists, boxes, thresholds, scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.scoring import effective_rank, scored
from ..session import table
from ..sources import scans
from ..sources import scenes as scene_lists
from ..sources.views import frames
from .common import query, stated


@query("SELECT DISTINCT lower(name) AS name FROM (SELECT unnest(CASE WHEN len(f) > 0 THEN f ELSE [v] END) AS name FROM (SELECT trim(url) AS v, regexp_extract_all(trim(url), '[a-z]+[0-9]+') AS f FROM pages)) WHERE name <> ''")
def split_list_names(spark, sf_dir):
    return scans.split_list(table(spark, sf_dir, "pages").select(F.col("url").alias("value")), r"[a-z]+[0-9]+")


@query("""SELECT user_id, event_id, cls::INT AS cls, round(cx, 6) AS cx FROM (SELECT user_id, event_id, event_id % 9 AS cls, value / 500 AS cx FROM events WHERE event_id % 4 <> 0)""")
def box_label_rows(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat_ws(" ", (F.col("event_id") % 9).cast("string"), (F.col("value") / 500).cast("string"), F.lit("0.5 0.1 0.1"))
    text = F.concat(F.lit("\n"), F.when(F.col("event_id") % 4 == 0, F.lit("7 0.5")).otherwise(line), F.lit("\n"))
    boxes = e.select("user_id", "event_id", F.explode(scans.box_labels(text)).alias("b"))
    return boxes.select("user_id", "event_id", F.col("b.cls").alias("cls"), F.round("b.cx", 6).alias("cx"))


@query("SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events")
def threshold_json(spark, sf_dir):
    wrapped = F.concat(F.lit('{"recommended_thresholds": {"k": 0}, "thresholds": '), F.col("props"), F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", F.element_at(scans.thresholds(wrapped), "k").alias("k"))


@query("SELECT user_id AS video_id, event_id, round(2 * least(value / 500, 1.0::DOUBLE), 6) AS score FROM events WHERE event_type <> 'none'")
def scorer_contract(spark, sf_dir):
    """The batch scorer contract with a scorer that doubles a column."""
    rows = table(spark, sf_dir, "events").filter("event_type <> 'none'").select(F.col("user_id").alias("video_id"), "event_id", F.least(F.col("value") / 500, F.lit(1.0)).alias("s"))
    return scored(rows, lambda: lambda b: 2 * b["s"].to_numpy()).select("video_id", "event_id", F.round("score", 6).alias("score"))


@query(None)
def embedding_rank(spark, sf_dir):
    return effective_rank(table(spark, sf_dir, "embeddings"), "label", "embedding")


#: The forms that an element of a scene list takes, right ones and wrong ones; K is the number in an event's props.
SCENE_FORMS = [
    '{"start_time": K.5, "end_time": "K.9"}',
    "[K, 7]",
    "[K.1, K.7]",
    '{"shot_id": 9, "start_frame": K, "end_frame": 5}',
    '"K-12"',
    "[K]",
    "{}",
    "[K, K.5]",
    '{"end_time": "late"}',
    "[9, K]",
    "null",
    '{"start_frame": K.8, "end_frame": "70"}',
]
_N = len(SCENE_FORMS)


def _form(k):
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(SCENE_FORMS)) + " END"


@query(f"""WITH raw AS (SELECT event_id, CASE WHEN event_id % 40 = 3 THEN 'no list' WHEN event_id % 40 = 5 THEN '[]' ELSE
    '[' || replace({_form(f"event_id % {_N}")} || ', ' || {_form(f"(event_id // {_N}) % {_N}")}, 'K', json_extract_string(props, '$.k')) || ']' END AS list,
  [25, 30000.0::DOUBLE / 1001, 0][1 + event_id % 3]::DOUBLE AS fps, floor(value)::BIGINT AS frames FROM events),
item AS (SELECT event_id, fps, i - 1 AS place, j -> (i - 1)::INT AS e FROM (SELECT *, unnest(range(1, 1 + json_array_length(j)::BIGINT)) AS i FROM (SELECT *, list::JSON AS j FROM raw WHERE json_valid(list)))),
typed AS (SELECT *, json_type(e) AS kind, json_type(e, '$[0]') AS t0, json_type(e, '$[1]') AS t1, e ->> '$.start_time' AS st, e ->> '$.end_time' AS et, e ->> '$.start_frame' AS sf, e ->> '$.end_frame' AS ef, e ->> '$.shot_id' AS id,
  try_cast(e ->> '$[0]' AS DOUBLE) AS a, try_cast(e ->> '$[1]' AS DOUBLE) AS b FROM item),
timed AS (SELECT *, CASE WHEN st IS NULL THEN 0 ELSE try_cast(st AS DOUBLE) END AS s0, CASE WHEN et IS NULL THEN CASE WHEN st IS NULL THEN 0 ELSE try_cast(st AS DOUBLE) END ELSE try_cast(et AS DOUBLE) END AS s1 FROM typed),
forms AS (SELECT event_id, coalesce(id::BIGINT, place) AS shot_id, CASE WHEN sf IS NULL THEN round_even(s0 * fps, 0)::BIGINT ELSE trunc(sf::DOUBLE)::BIGINT END AS f0, CASE WHEN ef IS NULL THEN round_even(s1 * fps, 0)::BIGINT ELSE trunc(ef::DOUBLE)::BIGINT END AS f1, s0, s1, true AS clamp FROM timed WHERE kind = 'OBJECT'
  UNION ALL SELECT event_id, place, a::BIGINT, b::BIGINT, CASE WHEN fps > 0 THEN a / fps ELSE 0 END, CASE WHEN fps > 0 THEN b / fps ELSE 0 END, true FROM timed WHERE kind = 'ARRAY' AND t0 = 'UBIGINT' AND t1 = 'UBIGINT'
  UNION ALL SELECT event_id, place, CASE WHEN fps > 0 THEN round_even(a * fps, 0)::BIGINT ELSE 0 END, CASE WHEN fps > 0 THEN round_even(b * fps, 0)::BIGINT ELSE 0 END, a, b, false FROM timed WHERE kind = 'ARRAY' AND t1 IS NOT NULL AND NOT (t0 = 'UBIGINT' AND t1 = 'UBIGINT')),
good AS (SELECT * FROM forms WHERE event_id NOT IN (SELECT event_id FROM forms WHERE s0 IS NULL OR s1 IS NULL))
SELECT event_id, shot_id, f0 AS start_frame, CASE WHEN clamp THEN greatest(f0, f1) ELSE f1 END AS end_frame, round(s0, 6) AS start_time, round(s1, 6) AS end_time, true AS detected FROM good
UNION ALL SELECT event_id, 0, 0, greatest(frames - 1, 0), 0, CASE WHEN fps > 0 THEN round(frames / fps, 6) ELSE 0 END, false FROM raw WHERE event_id NOT IN (SELECT event_id FROM good)""")
def scenes(spark, sf_dir):
    """Two elements per event, every form beside every other."""
    e = table(spark, sf_dir, "events")
    forms, pick = F.array(*map(F.lit, SCENE_FORMS)), lambda k: F.element_at(forms, (k + 1).cast("int"))
    two = F.concat(F.lit("["), pick(F.col("event_id") % _N), F.lit(", "), pick(F.floor(F.col("event_id") / _N) % _N), F.lit("]"))
    text = F.when(F.col("event_id") % 40 == 3, "no list").when(F.col("event_id") % 40 == 5, "[]").otherwise(F.replace(two, F.lit("K"), F.get_json_object("props", "$.k")))
    fps = F.element_at(F.array(F.lit(25.0), F.lit(30000.0) / 1001, F.lit(0.0)), (F.col("event_id") % 3 + 1).cast("int"))
    found = scene_lists.scenes(e.select("event_id", text.alias("list"), fps.alias("fps"), F.floor("value").alias("frames")), "list", "fps", "frames")
    return found.select("event_id", "shot_id", "start_frame", "end_frame", *(F.round(c, 6).alias(c) for c in ("start_time", "end_time")), "detected")


@stated("SELECT DISTINCT lower(replace(replace(source, '-', ''), '_', '')) AS name FROM {documents} WHERE source NOT LIKE '%non%'")
def normalised_sources(spark, sf_dir):
    found = table(spark, sf_dir, "documents").filter(~F.contains(F.col("source"), F.lit("non")))
    return found.select(F.lower(F.regexp_replace("source", "[-_]", "")).alias("name")).distinct()
