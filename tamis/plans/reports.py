"""Reports over several relations: calibration search, gates, baselines, training logs, role-based splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation as cur
from ..operators import metrics
from ..operators import reports as op
from ..session import table
from ..sources.views import features, frames, manifest, predictions
from .common import query, stated

_CURVE = """c AS (SELECT label, score, sum(pos) OVER (PARTITION BY label ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY label ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY label) AS n_pos
  FROM (SELECT label, score, sum(y) AS pos, sum(1 - y) AS neg FROM {predictions} GROUP BY 1, 2))"""

@stated(f"""WITH {_CURVE}, p AS (SELECT label, score, CAST(tp AS DOUBLE) / n_pos AS r, CAST(tp AS DOUBLE) / (tp + fp) AS pr FROM c),
l AS (SELECT label, r, pr, coalesce(lag(r) OVER (PARTITION BY label ORDER BY score DESC), 0) AS r0, coalesce(lag(pr) OVER (PARTITION BY label ORDER BY score DESC), 1) AS p0 FROM p)
SELECT label, round(sum((r - r0) * (pr + p0) / 2), 6) AS area FROM l GROUP BY label""")
def pr_auc_trapezoid(spark, sf_dir):
    return metrics.area_by_trapezoids(predictions(spark, sf_dir), "label").withColumn("area", F.round("area", 6))


@stated("""SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn, k FROM {features} CROSS JOIN (SELECT greatest(1, CAST(floor(100.0 / count(DISTINCT label)) AS INT)) AS k FROM {features})) WHERE rn <= k""")
def class_balanced_sample(spark, sf_dir):
    return cur.balanced_sample(features(spark, sf_dir).select("vec_id", "label"), "label", 100, "vec_id")


_LOG = "(SELECT CAST(ts AS DATE) AS epoch, round(avg(value), 6) AS loss FROM {events} GROUP BY 1)"
@stated(f"SELECT user_id, event_id, round(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS best, value >= max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS improved FROM {{events}}")
def best_so_far(spark, sf_dir):
    found = op.best_so_far(table(spark, sf_dir, "events"), "user_id", "value", F.to_date("ts"), "ts", "event_id")
    return found.select("user_id", "event_id", F.round("best", 6).alias("best"), "improved")


@stated(f"""SELECT arg_min(loss, epoch) AS first_loss, arg_max(loss, epoch) AS last_loss, count(*) AS epochs, arg_max(loss, epoch) > arg_min(loss, epoch) AS diverged FROM {_LOG}""")
def training_diagnosis(spark, sf_dir):
    log = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))
    return op.loss_trend(log, "epoch", "loss")


_ROLES = [("en", 1, 3.0, 50), ("fr", 0, 1.0, 20), ("de", 0, 0.5, 10)]


@query("""SELECT m.doc_id, r.label, r.weight, m.split FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY draw, doc_id) AS rn FROM manifest) m
JOIN (SELECT 'en' AS lang, 1 AS label, 3.0::DOUBLE AS weight, 50 AS cap UNION ALL SELECT 'fr', 0, 1.0, 20 UNION ALL SELECT 'de', 0, 0.5, 10) r ON r.lang = m.lang WHERE m.rn <= r.cap""", "manifest")
def role_split(spark, sf_dir):
    roles = spark.createDataFrame(_ROLES, "lang string, label int, weight double, cap int")
    placed = cur.ranked(manifest(spark, sf_dir).select("doc_id", "lang", "split", "draw"), ["lang"], "draw", "doc_id", name="rn")
    return placed.join(roles, "lang").filter("rn <= cap").select("doc_id", "label", "weight", "split")


@query("""SELECT doc_id, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM (
  SELECT doc_id, row_number() OVER (PARTITION BY violence, nsfw ORDER BY draw, doc_id) AS rn, count(*) OVER (PARTITION BY violence, nsfw) AS n FROM manifest)""", "manifest")
def ranked_cut_split(spark, sf_dir):
    """Strata are the vectors of labels."""
    return cur.cut_split(manifest(spark, sf_dir), ["violence", "nsfw"], "draw", "doc_id").select("doc_id", "split")


@stated("""SELECT source, group_id, count(*) AS n FROM {manifest} WHERE violence = 0 AND nsfw = 0 GROUP BY source, group_id HAVING count(*) > 1""")
def group_negatives(spark, sf_dir):
    return op.negative_groups(manifest(spark, sf_dir), ["violence", "nsfw"], "source", "group_id")


@stated("""SELECT video_id, round(sum(a * ln(a / b)), 6) AS kl FROM (SELECT video_id, (score + 0.01) / sum(score + 0.01) OVER (PARTITION BY video_id) AS a, (score2 + 0.01) / sum(score2 + 0.01) OVER (PARTITION BY video_id) AS b FROM {frames}) GROUP BY video_id""")
def score_divergence(spark, sf_dir):
    return op.divergence(frames(spark, sf_dir), "video_id", "score", "score2").withColumn("kl", F.round("kl", 6))


@stated("""SELECT bucket, label, round(avg(score), 6) AS m, CASE WHEN avg(score) < 0.35 THEN 'low' WHEN avg(score) > 0.55 THEN 'high' ELSE 'middle' END AS gate FROM {predictions} GROUP BY bucket, label""")
def expert_means(spark, sf_dir):
    return op.expert_means(predictions(spark, sf_dir), "bucket", "label").withColumn("m", F.round("m", 6))


@stated("""SELECT count(*) FILTER (WHERE s >= 0.7) AS flagged, count(*) FILTER (WHERE s < 0.7) AS safe, count(*) FILTER (WHERE s IS NULL) AS errors FROM (SELECT CASE WHEN frame_idx % 17 <> 3 THEN score END AS s FROM {frames})""")
def batch_inference_summary(spark, sf_dir):
    """Some frames have no score, as where inference failed."""
    return op.inference_summary(frames(spark, sf_dir).withColumn("score", F.when(F.col("frame_idx") % 17 != 3, F.col("score"))), 0.7)


@stated("""SELECT md5, count(DISTINCT split) AS splits FROM {manifest} GROUP BY md5 HAVING count(DISTINCT split) > 1""")
def straddling_groups(spark, sf_dir):
    """Copies as groups."""
    return op.straddling(manifest(spark, sf_dir), "md5")
