"""Decisions from scores: penalties, thresholds, ensembles, levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as pol
from ..operators.policy import applied
from ..sources.views import frames, media_items, predictions
from .common import query, stated

_FLAGS = {"anime": 7, "dark": 3, "warm": 4, "composite": 9, "sport": 11}
_FLAG_SQL = ", ".join(f"frame_idx % {m} = 0 AS {n}" for n, m in _FLAGS.items())


def _flagged(spark, sf_dir):
    flags = {n: F.col("frame_idx") % m == 0 for n, m in _FLAGS.items()}
    rows = frames(spark, sf_dir).withColumns(flags)
    return rows.withColumn("resolution", pol.resolution_penalty(F.col("frame_idx") * 16, F.lit(480)))


_RES = "CASE WHEN frame_idx * 16 * 480 <= 144 * 176 THEN 0.20 WHEN frame_idx * 16 * 480 <= 360 * 480 THEN 0.12 WHEN frame_idx * 16 * 480 <= 640 * 480 THEN 0.08 ELSE 0 END::DOUBLE"
_CHAIN = f"greatest(0, score - {_RES})"
for _n, _p in pol.PENALTIES.items():
    _CHAIN = f"greatest(0, {_CHAIN} - CASE WHEN {_n} THEN {_p}::DOUBLE ELSE 0 END)"


@query("SELECT video_id, frame_idx, round(CASE WHEN score - score2 < 0.4 AND score < 0.95 THEN greatest(0, score - 0.2::DOUBLE) ELSE score END, 6) AS p FROM frames", "frames")
def margin_penalty(spark, sf_dir):
    return frames(spark, sf_dir).select("video_id", "frame_idx", F.round(pol.margin_penalty(F.col("score"), F.col("score2")), 6).alias("p"))


@query(f"SELECT video_id, frame_idx, {_RES} AS penalty FROM frames", "frames")
def resolution_tier(spark, sf_dir):
    return _flagged(spark, sf_dir).select("video_id", "frame_idx", F.col("resolution").alias("penalty"))


@query(f"SELECT video_id, frame_idx, round({_CHAIN}, 6) AS p FROM (SELECT *, {_FLAG_SQL} FROM frames)", "frames")
def penalty_chain(spark, sf_dir):
    p = pol.penalised(F.col("score"), F.col("resolution"), **{n: F.col(n) for n in _FLAGS})
    return _flagged(spark, sf_dir).select("video_id", "frame_idx", F.round(p, 6).alias("p"))


@query(f"SELECT video_id, frame_idx, round(CASE WHEN frame_idx % 10 >= 6 AND (dark OR warm OR composite) THEN score ELSE {_CHAIN} END, 6) AS p FROM (SELECT *, {_FLAG_SQL} FROM frames)", "frames")
def safety_bypass(spark, sf_dir):
    after = pol.penalised(F.col("score"), F.col("resolution"), **{n: F.col(n) for n in _FLAGS})
    p = pol.with_bypass(F.col("score"), after, F.col("frame_idx") % 10, F.col("dark"), F.col("warm"), F.col("composite"))
    return _flagged(spark, sf_dir).select("video_id", "frame_idx", F.round(p, 6).alias("p"))


@query(f"""SELECT action, count(*) AS n FROM (SELECT CASE WHEN score < CASE WHEN sport THEN 0.65 ELSE 0.5 END THEN 'safe' WHEN sport THEN 'safe' WHEN anime THEN 'blur' WHEN composite THEN 'ban' ELSE 'blur' END AS action
  FROM (SELECT *, {_FLAG_SQL} FROM frames)) GROUP BY action""", "frames")
def violence_action(spark, sf_dir):
    a = pol.violence_action(F.col("score"), F.col("sport"), F.col("anime"), F.col("composite"))
    return _flagged(spark, sf_dir).groupBy(a.alias("action")).agg(F.count("*").alias("n"))


@query("SELECT video_id, frame_idx, CASE WHEN score2 >= 0.80 THEN 'ban' WHEN score2 >= 0.70 THEN 'blur' ELSE 'safe' END AS action FROM frames", "frames")
def nsfw_action(spark, sf_dir):
    a = pol.action(pol.level(F.col("score2"), pol.VIDEO_NSFW_BAN, pol.VIDEO_NSFW_BLUR))
    return frames(spark, sf_dir).select("video_id", "frame_idx", a.alias("action"))


@query("SELECT level, count(*) AS n FROM (SELECT greatest(CASE WHEN score2 >= 0.9 THEN 2 WHEN score2 >= 0.8 THEN 1 ELSE 0 END, CASE WHEN score >= 0.9 THEN 2 WHEN score >= 0.7 THEN 1 ELSE 0 END)::INT AS level FROM frames) GROUP BY level", "frames")
def image_level(spark, sf_dir):
    return frames(spark, sf_dir).groupBy(pol.image_level(F.col("score2"), F.col("score")).alias("level")).agg(F.count("*").alias("n"))


@query("SELECT video_id, frame_idx, round(0.5 * greatest(score, 0.8 * score2) + 0.3 * score2 + 0.2 * (1 - score), 6) AS p FROM frames", "frames")
def ensemble(spark, sf_dir):
    p = pol.ensemble_self_harm(F.col("score"), F.col("score2"), F.col("score2"), 1 - F.col("score"))
    return frames(spark, sf_dir).select("video_id", "frame_idx", F.round(p, 6).alias("p"))


@stated("""SELECT video_id, category, round(max(p), 6) AS p, CASE WHEN max(p) >= 0.9 THEN 'ban' WHEN max(p) >= 0.7 THEN 'blur' ELSE 'safe' END AS action FROM (
  SELECT video_id, 'violence' AS category, score AS p FROM {frames} UNION ALL SELECT video_id, 'nsfw', score2 FROM {frames}) GROUP BY video_id, category""")
def policy_rollup(spark, sf_dir):
    found = pol.highest_by_category(frames(spark, sf_dir), "video_id", {"violence": "score", "nsfw": "score2"}, pol.VIOLENCE_BAN, pol.VIOLENCE_BLUR)
    return found.withColumn("p", F.round("p", 6))


@stated("SELECT doc_id, label, score >= CASE label WHEN 'violence' THEN 0.5 ELSE 0.6 END AS flag FROM {predictions}")
def label_flags(spark, sf_dir):
    return predictions(spark, sf_dir).select("doc_id", "label", pol.flags(F.col("label"), F.col("score"), {"violence": 0.5}, 0.6).alias("flag"))


@stated("SELECT video_id, frame_idx, round(score * CASE WHEN score2 > 0.55 THEN greatest(0.15, 1 - score2) ELSE 1.0 END, 6) AS p FROM {frames}")
def context_suppression(spark, sf_dir):
    p = F.col("score") * pol.suppress_factor(F.col("score2"))
    return frames(spark, sf_dir).select("video_id", "frame_idx", F.round(p, 6).alias("p"))


@stated("SELECT video_id, frame_idx, round(1 / (1 + exp((score2 - score) * 20)), 6) AS p FROM {frames}")
def two_way_softmax(spark, sf_dir):
    return frames(spark, sf_dir).select("video_id", "frame_idx", F.round(pol.of_two(F.col("score"), F.col("score2"), 20), 6).alias("p"))


@stated("SELECT verdict, CASE WHEN verdict LIKE '%BAN%' THEN 2 WHEN verdict LIKE '%BLUR%' THEN 1 ELSE 0 END AS level, n FROM (SELECT CASE level WHEN 2 THEN 'x (BAN)' WHEN 1 THEN 'x (BLUR)' ELSE 'SAFE' END AS verdict, count(*) AS n FROM {media_items} GROUP BY 1)")
def verdict_levels(spark, sf_dir):
    verdict = F.when(F.col("level") == 2, "x (BAN)").when(F.col("level") == 1, "x (BLUR)").otherwise("SAFE")
    counts = media_items(spark, sf_dir).groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))
    return counts.select("verdict", pol.verdict_level(F.col("verdict")).alias("level"), "n")


@stated("SELECT conv_id, msg_id, regexp_extract(concat('**Reason:** ', reason), 'Reason:[* ]*(.*)$', 1) AS reason FROM {media_items}")
def reason_prefix(spark, sf_dir):
    return media_items(spark, sf_dir).select("conv_id", "msg_id", pol.stated_reason(F.concat(F.lit("**Reason:** "), "reason")).alias("reason"))


@stated("""SELECT m.conv_id, max(coalesce(t.priority, 0)) AS priority FROM {media_items} m LEFT JOIN (SELECT 0 AS level, 1 AS priority UNION ALL SELECT 1, 5) t ON t.level = m.level GROUP BY m.conv_id""")
def category_priority(spark, sf_dir):
    return pol.priorities(media_items(spark, sf_dir), "conv_id", {0: 1, 1: 5})


@query("""SELECT conv_id, CASE WHEN max(level) = 2 THEN 'banned' WHEN max(level) = 1 THEN 'sensitive' ELSE 'active' END AS status,
  max(level)::INT AS level, count(*) AS media, count(*) FILTER (WHERE level > 0) AS flagged FROM media_items WHERE coalesce(is_moderated, false) = false GROUP BY conv_id""", "media_items")
def post_apply(spark, sf_dir):
    return applied(media_items(spark, sf_dir))
