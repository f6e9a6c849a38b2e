"""Posts, comments, messages and profiles after moderation; detector and context rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as pol
from ..operators import moderation as op
from ..operators.scoring import IMAGE_BATCH, VIDEO_BATCH, scored_media
from ..session import table
from ..sources.views import frames, media_items
from .common import query, stated

_TYPE = "CASE conv_id % 5 WHEN 0 THEN 'avatar_update' WHEN 1 THEN 'cover_update' ELSE 'regular' END"
_AUTHOR = "CASE WHEN conv_id % 7 <> 0 THEN conv_id * 10 END"
_PLACED = "placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY msg_id, role) - 1 AS i FROM media_items)"


def _documents(spark, sf_dir):
    """Conversations as documents with their messages as media; and a verdict on each medium of every other place."""
    row = F.struct("msg_id", "role", "mime", "is_moderated", "level", "reason")
    grouped = media_items(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    media = F.transform("rows", lambda m: F.struct(F.concat(F.lit("m"), m["msg_id"].cast("string")).alias("url"), m["mime"].alias("mime"), m["is_moderated"].alias("is_moderated"), F.lit(False).alias("is_sensitive"), F.lit(None).cast("string").alias("reason")))
    docs = grouped.select(F.col("conv_id").alias("doc_id"), F.expr(_TYPE).alias("type"), F.expr(_AUTHOR).alias("author_id"), (F.col("conv_id") + 1).alias("post_id"), media.alias("media"))
    places = grouped.select(F.col("conv_id").alias("doc_id"), F.posexplode("rows").alias("media_index", "m"))
    return docs, places.filter("media_index % 2 = 0").select("doc_id", "media_index", F.col("m.level").alias("level"), F.col("m.reason").alias("reason"))


_VERDICTS = f"{_PLACED}, v AS (SELECT conv_id, i, level, reason FROM placed WHERE i % 2 = 0)"


@query(f"""WITH {_VERDICTS}, t AS (SELECT conv_id, {_TYPE} AS type, {_AUTHOR} AS author_id FROM (SELECT DISTINCT conv_id FROM media_items)),
r AS (SELECT t.*, v.i, v.reason, CASE WHEN level = 1 AND type <> 'regular' THEN 2 ELSE level END AS level FROM t JOIN v ON v.conv_id = t.conv_id),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY level DESC, i) AS rn FROM r)
SELECT conv_id AS doc_id, type, level::INT AS level, CASE WHEN level = 2 THEN 'policy_violation' ELSE 'active' END AS status, CASE WHEN level = 2 THEN reason END AS reason,
  level = 2 AND author_id IS NOT NULL AND type = 'regular' AS notify FROM f WHERE rn = 1""", "media_items")
def post_status(spark, sf_dir):
    return op.applied_to_posts(*_documents(spark, sf_dir)).drop("media", "author_id")


@query(f"""WITH {_VERDICTS} SELECT p.conv_id AS doc_id, 'm' || p.msg_id AS url, coalesce(is_moderated, false) OR v.i IS NOT NULL AS is_moderated,
  coalesce(v.level > 0, false) AS is_sensitive, CASE WHEN v.level > 0 THEN v.reason END AS reason FROM placed p LEFT JOIN v ON v.conv_id = p.conv_id AND v.i = p.i""", "media_items")
def post_media_flags(spark, sf_dir):
    found = op.applied_to_posts(*_documents(spark, sf_dir)).select("doc_id", F.explode("media").alias("m"))
    return found.select("doc_id", "m.url", "m.is_moderated", "m.is_sensitive", "m.reason")


@query(f"""WITH {_VERDICTS}, c AS (SELECT conv_id, level, reason, row_number() OVER (PARTITION BY conv_id ORDER BY level DESC, reason DESC) AS rn FROM v)
SELECT conv_id AS doc_id, conv_id + 1 AS post_id, CASE WHEN level = 2 THEN 'policy_violation' ELSE 'active' END AS status, level > 0 AS is_sensitive,
  CASE WHEN level > 0 THEN reason END AS image_reason, level = 2 AND {_AUTHOR} IS NOT NULL AS notify FROM c WHERE rn = 1""", "media_items")
def comment_status(spark, sf_dir):
    docs, verdicts = _documents(spark, sf_dir)
    return op.applied_to_comments(docs, verdicts).select("doc_id", "post_id", "status", "is_sensitive", "image_reason", "notify")


@query(f"""WITH {_VERDICTS} SELECT conv_id AS doc_id, bool_or(level > 0) AS violation, count(*) FILTER (WHERE level > 0) AS sensitive FROM v GROUP BY 1""", "media_items")
def message_flags(spark, sf_dir):
    docs, verdicts = _documents(spark, sf_dir)
    clamped = verdicts.withColumn("level", op.chat_clamped(F.col("level"), F.lit("message")))
    found = op.applied_to_messages(docs, clamped)
    return found.select("doc_id", "violation", F.size(F.filter("media", lambda m: m["is_sensitive"])).cast("long").alias("sensitive"))


def _profiles(docs):
    return docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "avatar").otherwise("cover").alias("kind"), F.concat(F.lit("u"), F.col("doc_id").cast("string")).alias("url"))


@query(f"""WITH {_VERDICTS} SELECT conv_id AS doc_id, CASE WHEN conv_id % 2 = 0 THEN 'avatar' ELSE 'cover' END AS kind, CASE WHEN max(level) > 0 THEN '' ELSE 'u' || conv_id END AS url, max(level) > 0 AS notify FROM v GROUP BY conv_id""", "media_items")
def profile_images(spark, sf_dir):
    docs, verdicts = _documents(spark, sf_dir)
    return op.applied_to_profiles(_profiles(docs), verdicts).select("doc_id", "kind", "url", "notify")


@query(f"""WITH {_VERDICTS}, b AS (SELECT conv_id, {_TYPE} AS type, {_AUTHOR} AS author_id, max(level) AS level, max(CASE WHEN level > 0 THEN 1 ELSE 0 END) AS any_hit FROM v GROUP BY 1)
SELECT kind, count(*) AS n FROM (SELECT 'post' AS kind FROM b WHERE level = 2 AND type = 'regular' AND author_id IS NOT NULL UNION ALL SELECT 'comment' FROM b WHERE level = 2 AND author_id IS NOT NULL
  UNION ALL SELECT CASE WHEN conv_id % 2 = 0 THEN 'avatar' ELSE 'cover' END FROM b WHERE any_hit = 1) GROUP BY kind""", "media_items")
def notification_counts(spark, sf_dir):
    docs, v = _documents(spark, sf_dir)
    told = op.notifications(op.applied_to_posts(docs, v), op.applied_to_comments(docs, v), op.applied_to_profiles(_profiles(docs), v))
    return told.groupBy("kind").agg(F.count("*").alias("n"))


_PARTS = ["FEMALE_BREAST_EXPOSED", "MALE_GENITALIA_EXPOSED", "ANUS_EXPOSED", "FACE_FEMALE", "FEMALE_BREAST_COVERED"]
_BOX = "CASE (frame_idx + {k}) % 5 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PARTS)) + " END"


def _boxed(spark, sf_dir):
    part = lambda k: F.array(*map(F.lit, _PARTS))[((F.col("frame_idx") + k) % 5).cast("int")]
    boxes = F.array(F.struct(part(0).alias("cls"), F.col("score2").alias("conf")), F.struct(part(3).alias("cls"), F.col("score").alias("conf")))
    return frames(spark, sf_dir).withColumn("boxes", F.when(F.col("frame_idx") % 6 == 0, F.filter(boxes, lambda b: F.lit(False))).otherwise(boxes))


_BOXED = f"boxed AS (SELECT *, {_BOX.format(k=0)} AS c1, score2 AS s1, {_BOX.format(k=3)} AS c2, score AS s2, frame_idx % 6 <> 0 AS has FROM frames)"


@query(f"""WITH {_BOXED}, l AS (SELECT video_id, frame_idx, CASE WHEN score2 >= 0.9 THEN 2 WHEN score2 >= 0.8 THEN 1 ELSE 0 END AS level, score2,
  has AND (lower(c1) LIKE '%genitalia%' OR lower(c1) LIKE '%breast%' AND s1 >= 0.8 OR lower(c2) LIKE '%genitalia%' OR lower(c2) LIKE '%breast%' AND s2 >= 0.8) AS trigger FROM boxed)
SELECT video_id, frame_idx, CASE WHEN score2 >= 0.9 THEN CASE WHEN trigger THEN 'ban' ELSE 'blur' END WHEN level = 2 THEN 'ban' WHEN level = 1 THEN 'blur' ELSE 'safe' END AS action FROM l""", "frames")
def detector_override_single(spark, sf_dir):
    base = pol.action(pol.level(F.col("score2"), pol.NSFW_BAN, pol.NSFW_BLUR))
    return _boxed(spark, sf_dir).select("video_id", "frame_idx", pol.detector_override(F.col("score2"), base, pol.body_trigger(F.col("boxes"))).alias("action"))


@query(f"""WITH {_BOXED}, l AS (SELECT *, has AND (c1 IN ('FEMALE_GENITALIA_EXPOSED', 'MALE_GENITALIA_EXPOSED', 'ANUS_EXPOSED') OR c2 IN ('FEMALE_GENITALIA_EXPOSED', 'MALE_GENITALIA_EXPOSED', 'ANUS_EXPOSED')
  OR c1 IN ('FEMALE_BREAST_EXPOSED', 'MALE_BREAST_EXPOSED') AND s1 >= 0.8 OR c2 IN ('FEMALE_BREAST_EXPOSED', 'MALE_BREAST_EXPOSED') AND s2 >= 0.8) AS trigger FROM boxed)
SELECT video_id, frame_idx, CASE WHEN score2 >= 0.9 THEN CASE WHEN trigger THEN 'ban' ELSE 'blur' END WHEN score2 >= 0.8 THEN 'blur' ELSE 'safe' END AS action FROM l""", "frames")
def detector_override_batch(spark, sf_dir):
    base = pol.action(pol.level(F.col("score2"), pol.NSFW_BAN, pol.NSFW_BLUR))
    return _boxed(spark, sf_dir).select("video_id", "frame_idx", pol.detector_override(F.col("score2"), base, pol.body_trigger(F.col("boxes"), exact=True)).alias("action"))


@query(f"""WITH {_BOXED} SELECT video_id, frame_idx, CASE WHEN has THEN greatest(CASE WHEN c1 = 'FEMALE_BREAST_EXPOSED' THEN s1 ELSE 0 END, CASE WHEN c2 = 'FEMALE_BREAST_EXPOSED' THEN s2 ELSE 0 END) ELSE 0 END AS risky,
  CASE WHEN has THEN greatest(CASE WHEN c1 = 'FACE_FEMALE' THEN s1 ELSE 0 END, CASE WHEN c2 = 'FACE_FEMALE' THEN s2 ELSE 0 END) ELSE 0 END AS medical FROM boxed""", "frames")
def class_confidence(spark, sf_dir):
    of = lambda cls: pol.class_confidence(F.col("boxes"), F.lit(cls))
    return _boxed(spark, sf_dir).select("video_id", "frame_idx", of("FEMALE_BREAST_EXPOSED").alias("risky"), of("FACE_FEMALE").alias("medical"))


_SIMS = "s AS (SELECT video_id, avg(score) * (1 + video_id % 7) AS sports, avg(score2) AS violence, max(score) AS anime, min(score2) + 0.05::DOUBLE * (video_id % 6) AS brawl, avg(score * score2) AS gore FROM frames GROUP BY 1)"


@query(f"""WITH {_SIMS}, p AS (SELECT video_id, brawl, exp(sports * 20) / (exp(sports * 20) + exp(violence * 20)) AS ps, exp(anime * 20) / (exp(anime * 20) + exp((sports + violence) / 2 * 20)) AS pa, exp(gore * 25) / (exp(gore * 25) + exp(brawl * 25)) AS pg FROM s)
SELECT video_id, ps > 0.55 AS is_sports, pa > 0.55 AS is_anime, pg > 0.6 AS is_gore, brawl > 0.22 AS is_brawl, round(CASE WHEN ps > 0.55 THEN greatest(0.15::DOUBLE, 1 - ps) ELSE 1.0::DOUBLE END, 6) AS factor FROM p""", "frames")
def context_flags(spark, sf_dir):
    """Similarities that some videos' ids raise, so that each flag is set for some."""
    video = F.col("video_id")
    sims = frames(spark, sf_dir).groupBy("video_id").agg((F.avg("score") * (1 + video % 7)).alias("sports"), F.avg("score2").alias("violence"), F.max("score").alias("anime"), (F.min("score2") + 0.05 * (video % 6)).alias("brawl"), F.avg(F.col("score") * F.col("score2")).alias("gore"))
    flags = pol.context_flags(*(F.col(c) for c in ("sports", "violence", "anime", "gore", "brawl")))
    return sims.select("video_id", *(v.alias(k) for k, v in flags.items() if k != "factor"), F.round(flags["factor"], 6).alias("factor"))


@query(f"""WITH {_SIMS}, p AS (SELECT video_id, 1 / (1 + exp((violence - sports) * 20)) AS ps FROM s),
a AS (SELECT f.video_id, max(greatest(0.0::DOUBLE, score2 - CASE WHEN ps > 0.55 THEN round(1 - greatest(0.15::DOUBLE, 1 - ps), 2) ELSE 0.0::DOUBLE END)) AS n FROM frames f JOIN p ON p.video_id = f.video_id GROUP BY 1)
SELECT video_id, CASE WHEN round(n, 9) >= 0.8 THEN 'ban' WHEN round(n, 9) >= 0.7 THEN 'blur' ELSE 'safe' END AS action FROM a""", "frames")
def nsfw_sport_action(spark, sf_dir):
    means = frames(spark, sf_dir).groupBy("video_id").agg((F.avg("score") * (1 + F.col("video_id") % 7)).alias("sports"), F.avg("score2").alias("violence"), F.max("score2").alias("top"))
    p = pol.sports_probability(F.col("sports"), F.col("violence"))
    adjusted = F.round(pol.nsfw_after_sport(F.col("top"), p), 9)
    return means.select("video_id", pol.action(pol.level(adjusted, pol.VIDEO_NSFW_BAN, pol.VIDEO_NSFW_BLUR)).alias("action"))


@query("""SELECT video_id, frame_idx, CASE level WHEN 2 THEN 'Phát hiện nội dung: ' || reasons WHEN 1 THEN 'Nội dung có yếu tố: ' || reasons ELSE '' END AS reason FROM (
  SELECT video_id, frame_idx, greatest(CASE WHEN score2 >= 0.9 THEN 2 WHEN score2 >= 0.8 THEN 1 ELSE 0 END, CASE WHEN score >= 0.9 THEN 2 WHEN score >= 0.7 THEN 1 ELSE 0 END) AS level,
    concat_ws(', ', CASE WHEN score2 >= 0.9 THEN 'khỏa thân / khiêu dâm' WHEN score2 >= 0.8 THEN 'nhạy cảm / sexy / bikini' END, CASE WHEN score >= 0.9 THEN 'bạo lực' WHEN score >= 0.7 THEN 'bạo lực nhẹ' END) AS reasons FROM frames)""", "frames")
def image_reason(spark, sf_dir):
    nsfw = pol.level(F.col("score2"), pol.NSFW_BAN, pol.NSFW_BLUR)
    return frames(spark, sf_dir).select("video_id", "frame_idx", pol.image_reason(nsfw, pol.level(F.col("score"), pol.VIOLENCE_BAN, pol.VIOLENCE_BLUR)).alias("reason"))


@query("SELECT video_id, frame_idx, round(greatest(score, 0.5::DOUBLE * score2), 6) AS weapon FROM frames", "frames")
def weapon_ensemble(spark, sf_dir):
    return frames(spark, sf_dir).select("video_id", "frame_idx", F.round(pol.ensemble_weapon(F.col("score"), F.col("score2")), 6).alias("weapon"))


_TAXONOMY = [(0, "gun", "weapon", 5, 0.5, 0.8), (1, "knife", "weapon", 4, 0.5, 0.85), (2, "blood", "gore", 3, 0.6, 0.9)]


@query(f"""WITH t(class_id, class, category, priority, blur, ban) AS (VALUES {', '.join(map(str, _TAXONOMY))}),
d AS (SELECT user_id, event_id % 5 AS class_id, least(value / 500, 1.0::DOUBLE) AS p FROM events),
j AS (SELECT d.*, coalesce(class, 'unknown_' || d.class_id) AS class, coalesce(category, 'unknown') AS category, coalesce(priority, 0) AS priority, coalesce(blur, 2.0) AS blur, coalesce(ban, 2.0) AS ban FROM d LEFT JOIN t ON t.class_id = d.class_id)
SELECT user_id AS item, category, max(p) AS p, bool_or(p >= blur) AS any_blur, CASE WHEN bool_or(p >= ban) THEN 'ban' WHEN bool_or(p >= blur) THEN 'blur' ELSE 'safe' END AS action, max(priority)::INT AS priority FROM j GROUP BY 1, 2""")
def taxonomy_rollup(spark, sf_dir):
    taxonomy = spark.createDataFrame(_TAXONOMY, "class_id long, class string, category string, priority int, blur double, ban double")
    found = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), (F.col("event_id") % 5).alias("class_id"), F.least(F.col("value") / 500, F.lit(1.0)).alias("p"))
    return pol.rolled_up(found, taxonomy)


@query(f"""WITH t(class_id, class) AS (VALUES {', '.join(f"({i}, '{c}')" for i, c, *_ in _TAXONOMY)}) SELECT event_id, coalesce(class, 'unknown_' || (event_id % 5)) AS class FROM events LEFT JOIN t ON t.class_id = event_id % 5""")
def class_names(spark, sf_dir):
    taxonomy = spark.createDataFrame(_TAXONOMY, "class_id long, class string, category string, priority int, blur double, ban double")
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 5).alias("class_id"))
    return pol.with_classes(rows, taxonomy).select("event_id", "class")


def _size_scorer(most, factor):
    """A model that takes `most` items at a time and scores them by their sizes."""

    def score(batch):
        if len(batch) > most:
            raise ValueError(f"more than {most} items at a time")
        return (batch["size"] / factor).clip(upper=1.0).to_numpy()

    return lambda: score


@stated("SELECT conv_id, msg_id, mime, round(least(1, size / CAST(CASE WHEN mime LIKE 'image/%' THEN 500 ELSE 900 END AS DOUBLE)), 6) AS score FROM {media_items} WHERE mime LIKE 'image/%' OR mime LIKE 'video/%'")
def media_scores(spark, sf_dir):
    """Images 64 at a time, videos one by one, each by its own scorer."""
    media = media_items(spark, sf_dir).select("conv_id", "msg_id", "mime", "size")
    found = scored_media(media, _size_scorer(IMAGE_BATCH, 500.0), _size_scorer(VIDEO_BATCH, 900.0))
    return found.select("conv_id", "msg_id", "mime", F.round("score", 6).alias("score"))
