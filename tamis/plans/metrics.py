"""Evaluation and calibration of scores against truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as pol
from ..functions import sequences as seq
from ..operators import calibration as cal
from ..operators import metrics as op
from ..operators import search
from ..session import table
from ..sources.views import features, predictions
from .common import query, stated

_POINTS = """pts AS (SELECT label, score, sum(y) AS pos, sum(1 - y) AS neg FROM predictions GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER (PARTITION BY label ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY label ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY label) AS n_pos, sum(neg) OVER (PARTITION BY label) AS n_neg FROM pts)"""
_CONFUSION = """SELECT {k}, count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp,
  count(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND score < 0.5) AS tn FROM {{predictions}} GROUP BY {k}"""


def _rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@stated(_CONFUSION.format(k="label"))
def confusion(spark, sf_dir):
    return op.confusion(predictions(spark, sf_dir), 0.5, "label")


@stated(_CONFUSION.format(k="bucket, label"))
def bucket_metrics(spark, sf_dir):
    return op.confusion(predictions(spark, sf_dir), 0.5, "bucket", "label")


@stated("SELECT label, round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 6) AS p, round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 6) AS r, round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 6) AS f1, round(coalesce(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 0), 6) AS specificity FROM (" + _CONFUSION.format(k="label") + ")")
def prf(spark, sf_dir):
    counts = op.confusion(predictions(spark, sf_dir), 0.5, "label")
    return counts.select("label", *(F.round(c, 6).alias(n) for n, c in op.rates(counts).items()))


@stated("SELECT round(avg(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0)), 6) AS macro, round(sum(2 * tp) / nullif(CAST(sum(2 * tp + fp + fn) AS DOUBLE), 0), 6) AS micro FROM (" + _CONFUSION.format(k="label") + ")")
def macro_micro_f1(spark, sf_dir):
    return _rounded(op.macro_micro_f1(op.confusion(predictions(spark, sf_dir), 0.5, "label")), "macro", "micro")


@stated("SELECT label, round(avg((score - y) * (score - y)), 6) AS brier FROM {predictions} GROUP BY label")
def brier(spark, sf_dir):
    return _rounded(op.brier(predictions(spark, sf_dir), "label"), "brier")


@stated("SELECT label, round(avg(CASE WHEN score >= 0.5 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS rate, round(avg(score), 6) AS m, round(stddev_pop(score), 6) AS sd FROM {predictions} GROUP BY label")
def flag_rates(spark, sf_dir):
    return _rounded(op.flag_rates(predictions(spark, sf_dir), 0.5, "label"), "rate", "m", "sd")


@stated("SELECT label, count(*) AS n, count(*) FILTER (WHERE (score >= 0.9) = (y = 1)) AS agreed FROM {predictions} GROUP BY label")
def scheme_strict(spark, sf_dir):
    return op.agreement(predictions(spark, sf_dir), 0.9, "label")


@stated("SELECT label, count(*) AS n, count(*) FILTER (WHERE (score >= 0.9) = (y = 1)) AS agreed FROM {predictions} WHERE score >= 0.9 OR score < 0.7 GROUP BY label")
def scheme_exclude_blur(spark, sf_dir):
    return op.agreement(op.without_blurred(predictions(spark, sf_dir), 0.9, 0.7), 0.9, "label")


@stated("SELECT l.level, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / sum(coalesce(n, 0)) OVER (), 4) AS percent FROM (SELECT 0 AS level UNION ALL SELECT 1 UNION ALL SELECT 2) l LEFT JOIN (SELECT CASE WHEN score >= 0.9 THEN 2 WHEN score >= 0.7 THEN 1 ELSE 0 END AS level, count(*) AS n FROM {predictions} GROUP BY 1) p ON p.level = l.level")
def level_distribution(spark, sf_dir):
    levels = predictions(spark, sf_dir).select(pol.level(F.col("score"), pol.VIOLENCE_BAN, pol.VIOLENCE_BLUR).alias("level"))
    return _rounded(op.level_distribution(levels), "percent", digits=4)


@stated("SELECT event_type, round(avg(value), 4) AS m, round(quantile_cont(value, 0.5), 4) AS med, min(value) AS low, max(value) AS high, round(sum(value), 2) AS total FROM {events} GROUP BY event_type")
def runtime_stats(spark, sf_dir):
    found = op.value_stats(table(spark, sf_dir, "events"), "value", "event_type")
    return found.select("event_type", F.round("m", 4).alias("m"), F.round("med", 4).alias("med"), "low", "high", F.round("total", 2).alias("total"))


@stated("SELECT label, round(avg(CASE WHEN y = 1 THEN score END) - avg(CASE WHEN y = 0 THEN score END), 6) AS gap FROM {predictions} GROUP BY label")
def class_gap(spark, sf_dir):
    return _rounded(op.class_gap(predictions(spark, sf_dir), "label"), "gap")


@stated("SELECT label, round(avg(a), 6) AS acc, CASE WHEN avg(a) < 0.52 THEN 'chance' WHEN avg(a) < 0.62 THEN 'weak' ELSE 'good' END AS tier FROM (SELECT label, bucket, avg(CASE WHEN (score >= 0.5) = (y = 1) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS a FROM {predictions} GROUP BY label, bucket) GROUP BY label")
def batch_mean_accuracy(spark, sf_dir):
    return _rounded(op.mean_accuracy(predictions(spark, sf_dir), 0.5, "bucket", "label"), "acc")


@stated("SELECT doc_id, label, round(y * CAST(0.9 AS DOUBLE) + CAST(0.05 AS DOUBLE), 6) AS smooth FROM {predictions}")
def label_smoothing(spark, sf_dir):
    return predictions(spark, sf_dir).select("doc_id", "label", F.round(op.smoothed(F.col("y")), 6).alias("smooth"))


@stated("SELECT label, y, round(CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (PARTITION BY label), 4) AS percent FROM {predictions} GROUP BY label, y")
def class_percent(spark, sf_dir):
    return _rounded(op.percent_of(predictions(spark, sf_dir), "y", "label"), "percent", digits=4)


@query(f"WITH {_POINTS} SELECT label, round(sum(pos * (n_neg - fp + neg / 2.0)) / (max(n_pos) * max(n_neg)), 6) AS auc FROM c GROUP BY label", "predictions")
def roc_auc(spark, sf_dir):
    return op.roc_auc(predictions(spark, sf_dir), "label").withColumn("auc", F.round("auc", 6))


@query(f"WITH {_POINTS} SELECT label, round(sum(pos::DOUBLE * tp / (tp + fp)) / max(n_pos), 6) AS ap FROM c GROUP BY label", "predictions")
def average_precision(spark, sf_dir):
    return op.average_precision(predictions(spark, sf_dir), "label").withColumn("ap", F.round("ap", 6))


@query(f"WITH {_POINTS} SELECT label, score AS threshold, j FROM (SELECT label, score, j, row_number() OVER (PARTITION BY label ORDER BY j DESC, score DESC) AS rn FROM (SELECT *, round(tp::DOUBLE / n_pos - fp::DOUBLE / n_neg, 9) AS j FROM c)) WHERE rn = 1", "predictions")
def youden(spark, sf_dir):
    return op.youden(predictions(spark, sf_dir), "label")


def _grid_sql(low, high, n):
    """Counts at each threshold of a grid, row by row."""
    return f"""g AS (SELECT i, least({high}::DOUBLE, {low}::DOUBLE + i * (({high}::DOUBLE - {low}::DOUBLE) / {n - 1})) AS t FROM (SELECT unnest(range(0, {n})) AS i)),
s AS (SELECT label, t, sum(y * (score >= t)::INT) AS tp, sum((1 - y) * (score >= t)::INT) AS fp, sum(y * (score < t)::INT) AS fn FROM predictions, g GROUP BY 1, 2)"""


_BEST = """f AS (SELECT *, round(coalesce({b}::DOUBLE * tp / nullif({b} * tp + {c} * fn + fp, 0), 0), 9) AS f FROM s)
SELECT label, t AS threshold, f FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f DESC, t) AS rn FROM f) WHERE rn = 1"""


@query("WITH " + _grid_sql(0.01, 0.99, 199) + ", " + _BEST.format(b=5, c=4), "predictions")
def fbeta_grid(spark, sf_dir):
    return cal.best_on_grid(predictions(spark, sf_dir), cal.WIDE_GRID, 2.0, "label")


@query("WITH " + _grid_sql(0.05, 0.95, 100) + ", " + _BEST.format(b=2, c=1), "predictions")
def f1_narrow_grid(spark, sf_dir):
    return cal.best_on_grid(predictions(spark, sf_dir), cal.NARROW_GRID, 1.0, "label")


_FLOOR = """r AS (SELECT *, coalesce(tp / nullif((tp + fp)::DOUBLE, 0), 0) AS p, coalesce(tp / nullif((tp + fn)::DOUBLE, 0), 0) AS r, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fn + fp, 0), 0) AS f1, coalesce(5.0::DOUBLE * tp / nullif(5 * tp + 4 * fn + fp, 0), 0) AS f2 FROM s),
a AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY r DESC, f2 DESC, p DESC, t) AS rn FROM r WHERE p >= {floor}),
b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, t) AS rn FROM r)
SELECT label, 'precision_floor' AS selection, t AS threshold, round(p, 9) AS "precision", round(r, 9) AS recall, round(f2, 9) AS f2 FROM a WHERE rn = 1
UNION ALL SELECT label, 'f1', t, round(p, 9), round(r, 9), round(f2, 9) FROM b WHERE rn = 1 AND label NOT IN (SELECT label FROM a)"""


def _floored(spark, sf_dir, floor):
    found = cal.with_precision_floor(predictions(spark, sf_dir), floor, "label")
    return found.select("label", "selection", "threshold", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f2")))


@query("WITH " + _grid_sql(0.01, 0.99, 199) + ", " + _FLOOR.format(floor=0.65), "predictions")
def precision_floor(spark, sf_dir):
    return _floored(spark, sf_dir, 0.65)


@query("WITH " + _grid_sql(0.01, 0.99, 199) + ", " + _FLOOR.format(floor=1.5), "predictions")
def precision_floor_fallback(spark, sf_dir):
    """A floor that no threshold reaches."""
    return _floored(spark, sf_dir, 1.5)


@query(f"""WITH {_POINTS}, p AS (SELECT *, tp::DOUBLE / (tp + fp) AS pr, tp::DOUBLE / n_pos AS rc FROM c)
SELECT label, score AS threshold, f FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f DESC, score) AS rn FROM (SELECT *, round(5 * pr * rc / greatest(4 * pr + rc, 1e-12), 9) AS f FROM p)) WHERE rn = 1""", "predictions")
def pr_vertex(spark, sf_dir):
    return cal.best_vertex(predictions(spark, sf_dir), 2.0, "label")


def _quantile_sql(q, low, high):
    return f"SELECT label, round(least({high}, greatest({low}, quantile_cont(score, {q}))), 6) AS t FROM {{predictions}} GROUP BY label"


def _clipped_quantile(spark, sf_dir, q, low, high):
    found = op.quantiles(predictions(spark, sf_dir), "score", {"t": q}, "label")
    return found.select("label", F.round(F.least(F.lit(high), F.greatest(F.lit(low), F.col("t"))), 6).alias("t"))


@stated(_quantile_sql(0.9, 0.05, 0.99))
def quantile_threshold(spark, sf_dir):
    return _clipped_quantile(spark, sf_dir, 0.9, 0.05, 0.99)


@stated(_quantile_sql(0.98, 0.2, 0.999))
def quantile_event_s(spark, sf_dir):
    return _clipped_quantile(spark, sf_dir, 0.98, 0.2, 0.999)


@stated(_quantile_sql(0.995, 0.2, 0.999))
def quantile_event_n(spark, sf_dir):
    return _clipped_quantile(spark, sf_dir, 0.995, 0.2, 0.999)


_Z = "z AS (SELECT label, y, ln(greatest(1e-6, least(1 - 1e-6, score)) / (1 - greatest(1e-6, least(1 - 1e-6, score)))) AS z FROM predictions)"
_T = f"""{_Z}, g AS (SELECT unnest({cal.TEMPERATURES}::DOUBLE[]) AS t), p AS (SELECT label, t, y, 1 / (1 + exp(-greatest(-30, least(30, z / t)))) AS p FROM z, g),
b AS (SELECT label, t, least(floor(p * 15), 14) AS bin, count(*) AS n, avg(p) AS s, avg(y) AS m, sum((p - y) ** 2) AS e FROM p GROUP BY 1, 2, 3),
e AS (SELECT label, t, row_number() OVER (PARTITION BY label ORDER BY t) AS i, sum(n * abs(s - m)) / sum(n) AS ece, sum(e) / sum(n) AS brier FROM b GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE {{views}}{_T}, f AS (SELECT label, i, t, ece, brier FROM e WHERE i = 1
UNION ALL SELECT e.label, e.i, CASE WHEN e.ece < f.ece OR abs(e.ece - f.ece) < 1e-6 AND e.brier < f.brier THEN e.t ELSE f.t END,
  CASE WHEN e.ece < f.ece OR abs(e.ece - f.ece) < 1e-6 AND e.brier < f.brier THEN e.ece ELSE f.ece END, CASE WHEN e.ece < f.ece OR abs(e.ece - f.ece) < 1e-6 AND e.brier < f.brier THEN e.brier ELSE f.brier END
  FROM f JOIN e ON e.label = f.label AND e.i = f.i + 1)
SELECT label, t AS temperature, round(ece, 6) AS ece, round(brier, 6) AS brier FROM f WHERE i = {len(cal.TEMPERATURES)}""", "predictions")
def temperature_search(spark, sf_dir):
    return cal.best_temperature(predictions(spark, sf_dir), "label").select("label", "temperature", F.round("ece", 6).alias("ece"), F.round("brier", 6).alias("brier"))


#: More labels: scores that are nearly right and know it, right and too sure of it, or too unsure.
_SHIFTS = {"sharp": 0.05, "sure": 0.001, "unsure": 0.3}
_MORE = """more AS (SELECT doc_id, label, y, score, bucket FROM predictions UNION ALL SELECT doc_id, label || '_' || k, y, CASE WHEN doc_id % 11 = 0 AND k = 'sure' THEN 1 - y ELSE abs(y - s) END, bucket FROM predictions, (SELECT unnest(""" + f"{list(_SHIFTS)}) AS k, unnest({list(_SHIFTS.values())}::DOUBLE[]) AS s))"


def _more(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    wrong = (F.col("doc_id") % 11 == 0) & (F.col("k") == "sure")
    kinds = F.explode(F.create_map(*(F.lit(x) for pair in _SHIFTS.items() for x in pair))).alias("k", "s")
    shifted = rows.select("doc_id", "label", "y", "bucket", kinds).select("doc_id", F.concat_ws("_", "label", "k").alias("label"), "y", F.when(wrong, 1.0 - F.col("y")).otherwise(F.abs(F.col("y") - F.col("s"))).alias("score"), "bucket")
    return rows.unionByName(shifted)


def _of_more(sql):
    return sql.replace("WITH ", f"WITH {_MORE}, ", 1).replace("FROM predictions GROUP", "FROM more GROUP").replace(" AS z FROM predictions)", " AS z FROM more)").replace("AS p FROM predictions)", "AS p FROM more)")


@query(_of_more(f"""WITH {_POINTS}, a AS (SELECT label, sum(pos * (n_neg - fp + neg / 2.0)) / (max(n_pos) * max(n_neg)) AS auc FROM c GROUP BY 1),
r AS (SELECT label, count(*) FILTER (WHERE y = 1 AND score >= 0.5)::DOUBLE / count(*) FILTER (WHERE y = 1) AS recall FROM predictions GROUP BY 1),
{_T}, k AS (SELECT unnest(['gore', 'self_harm']) AS expert, unnest([0.88, 0.78]) AS least_auc, unnest([0.80, 0.75]) AS least_recall)
SELECT a.label, expert, CASE WHEN NOT (auc >= least_auc AND recall >= least_recall) THEN 'fail_1' WHEN one.ece < 0.10 THEN 'pass' WHEN m.ece < 0.10 THEN 'pass_scaled' ELSE 'fail_2' END AS gate
FROM a JOIN r ON r.label = a.label JOIN (SELECT label, ece FROM e WHERE t = 1) one ON one.label = a.label JOIN (SELECT label, min(ece) AS ece FROM e GROUP BY 1) m ON m.label = a.label, k"""), "predictions")
def gate_checks(spark, sf_dir):
    rows = _more(spark, sf_dir)
    recall = rows.groupBy("label").agg((F.count_if((F.col("y") == 1) & (F.col("score") >= 0.5)) / F.sum("y")).alias("recall"))
    ece = cal.calibration_by_temperature(rows, "label")
    one = ece.filter("temperature = 1").select("label", F.col("ece").alias("one"))
    found = op.roc_auc(rows, "label").join(recall, "label").join(one, "label").join(ece.groupBy("label").agg(F.min("ece").alias("scaled")), "label")
    gates = F.array(*(F.struct(F.lit(k).alias("expert"), cal.gate(F.col("auc"), F.col("recall"), F.col("one"), F.col("scaled"), *v).alias("gate")) for k, v in cal.GATES.items()))
    return found.select("label", F.explode(gates).alias("g")).select("label", "g.expert", "g.gate")


@query(f"WITH {_MORE} " + """SELECT label, (delta > 0.10)::INT + (positives < 0.40)::INT + (entropy > 0.85)::INT AS fails, CASE (delta > 0.10)::INT + (positives < 0.40)::INT + (entropy > 0.85)::INT WHEN 3 THEN 'shortcut' WHEN 0 THEN 'ok' ELSE 'partial' END AS tier FROM (
  SELECT label, avg(score) FILTER (WHERE bucket = 'bucket0') - avg(score) FILTER (WHERE bucket = 'bucket1') AS delta, avg(score) FILTER (WHERE y = 1) AS positives,
    avg(-(p * ln(p) + (1 - p) * ln(1 - p)) / ln(2)) AS entropy FROM (SELECT *, greatest(1e-6, least(1 - 1e-6, score)) AS p FROM more) GROUP BY label)""", "predictions")
def shortcut_probe(spark, sf_dir):
    entropy = seq.binary_entropy(F.col("score"))
    mean = lambda test: F.avg(F.when(test, F.col("score")))
    found = _more(spark, sf_dir).groupBy("label").agg((mean(F.col("bucket") == "bucket0") - mean(F.col("bucket") == "bucket1")).alias("d"), mean(F.col("y") == 1).alias("m"), F.avg(entropy).alias("e"))
    fails, tier = cal.shortcut_tier(F.col("d"), F.col("m"), F.col("e"))
    return found.select("label", fails.alias("fails"), tier.alias("tier"))


@query("""WITH e AS (SELECT event_type, strftime(ts, '%d')::INT AS epoch, stddev_pop(value / 500) AS sd, avg(value) AS dist, min(value) AS bce, stddev_pop(value / 20000) AS side, max(value) / 100 - 0.6 AS entropy FROM events GROUP BY 1, 2)
SELECT event_type, epoch, concat_ws(';', CASE WHEN sd < 0.05 THEN 'collapse' END, CASE WHEN dist > 10 * bce THEN 'distillation' END, CASE WHEN epoch >= 5 AND side < 0.01 THEN 'not_learning' END,
  CASE WHEN entropy > 4 THEN 'flat' WHEN entropy >= 0 AND entropy < 0.5 THEN 'one_frame' END) AS issues FROM e""")
def health_rules(spark, sf_dir):
    v = F.col("value")
    found = table(spark, sf_dir, "events").groupBy("event_type", F.dayofmonth("ts").alias("epoch")).agg(F.stddev_pop(v / 500).alias("sd"), F.avg(v).alias("dist"), F.min(v).alias("bce"), F.stddev_pop(v / 20000).alias("side"), (F.max(v) / 100 - 0.6).alias("entropy"))
    issues = cal.health_issues(F.col("epoch"), 5, F.col("sd"), F.col("dist"), F.col("bce"), F.col("side"), F.col("entropy"))
    return found.select("event_type", "epoch", issues.alias("issues"))


@query("""SELECT label, round(sum(n * abs(s - y)) / sum(n), 6) AS ece FROM (SELECT label, least(floor(score * 15), 14) AS bin, count(*) AS n, avg(score) AS s, avg(y) AS y FROM predictions GROUP BY 1, 2) GROUP BY label""", "predictions")
def ece(spark, sf_dir):
    return op.calibration_error(predictions(spark, sf_dir), 15, "label").withColumn("ece", F.round("ece", 6))


_NEAR = """s AS (SELECT q.vec_id AS q, q.label AS truth, b.vec_id, b.label, round(list_cosine_similarity(q.v, b.v), 9) AS s FROM features q, features b WHERE q.split = 'val' AND b.split = 'train'),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, vec_id) AS rank FROM s)"""


@query(f"""WITH {_NEAR}, v AS (SELECT q, truth, label, count(*) AS n, min(rank) AS first FROM r WHERE rank <= 5 GROUP BY 1, 2, 3)
SELECT q, truth, label AS vote FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, first) AS rn FROM v) WHERE rn = 1""", "features")
def knn_vote(spark, sf_dir):
    f = features(spark, sf_dir)
    return search.knn_vote(f.filter("split = 'val'"), f.filter("split = 'train'"), 5)


_SCORES = f"""{_NEAR}, t AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) AS place, row_number() OVER (ORDER BY md5('43:' || vec_id), vec_id) AS dealt FROM features WHERE split = 'train'),
o AS (SELECT a.vec_id, b.label AS other FROM t a JOIN t b ON a.place = b.dealt),
k AS (SELECT q, truth, rank, unnest(['real', 'shuffled']) AS kind, unnest([label, other]) AS label FROM r JOIN o USING (vec_id) WHERE rank <= 5),
c AS (SELECT q, truth, kind, label, count(*) AS n, min(rank) AS first FROM k GROUP BY 1, 2, 3, 4),
v AS (SELECT *, row_number() OVER (PARTITION BY q, kind ORDER BY n DESC, first) AS rn FROM c),
h AS (SELECT kind, sum((label = truth)::INT) AS hits FROM v WHERE rn = 1 GROUP BY 1),
m AS (SELECT sum(n)::BIGINT AS queries, max(n) AS most FROM (SELECT count(*) AS n FROM features WHERE split = 'val' GROUP BY label)),
w AS (SELECT queries, (SELECT hits FROM h WHERE kind = 'real') / queries::DOUBLE AS real_score, (SELECT hits FROM h WHERE kind = 'shuffled') / queries::DOUBLE AS shuffled_score, most / queries::DOUBLE AS majority FROM m)"""


@query(f"WITH {_SCORES} SELECT queries, round(real_score, 6) AS real_score, round(shuffled_score, 6) AS shuffled_score, round(majority, 6) AS majority FROM w", "features")
def knn_scores(spark, sf_dir):
    f = features(spark, sf_dir)
    return _rounded(search.knn_scores(f.filter("split = 'val'"), f.filter("split = 'train'")), "real_score", "shuffled_score", "majority")


@query(f"WITH {_SCORES} SELECT unnest(['majority', 'shuffled']) AS baseline, round(unnest([majority, shuffled_score]), 6) AS share FROM w", "features")
def knn_baselines(spark, sf_dir):
    """What a vote of neighbours has to beat: the validation split's most frequent label, and a vote of permuted labels."""
    baselines = F.array(*(F.struct(F.lit(name).alias("baseline"), F.col(c).alias("share")) for name, c in (("majority", "majority"), ("shuffled", "shuffled_score"))))
    return knn_scores(spark, sf_dir).select(F.explode(baselines).alias("b")).select("b.*")
