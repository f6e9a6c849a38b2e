"""Ordered score sequences: sampling, resampling, pooling, windows, peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policy as pol
from ..functions import sequences as seq
from ..operators import curation as cur
from ..operators import balancing, search, temporal
from ..operators.metrics import alike
from ..session import table
from ..sources.views import features, frames, series
from .common import query, stated

_R16 = "list_transform(range(0, 16), lambda i: x[1 + floor(i * (len(x) - 1) / 15.0::DOUBLE)::INT] + (x[1 + least(floor(i * (len(x) - 1) / 15.0::DOUBLE)::INT + 1, len(x) - 1)] - x[1 + floor(i * (len(x) - 1) / 15.0::DOUBLE)::INT]) * (i * (len(x) - 1) / 15.0::DOUBLE - floor(i * (len(x) - 1) / 15.0::DOUBLE)))"
_TOPK = "list_sort({x}, 'DESC')[1:least(len({x}), greatest(3, ceil(len({x}) * 0.2::DOUBLE)))::INT]"
_NOISY = "(1 - list_product(list_transform(" + _TOPK + ", lambda p: 1 - p + 0.000001::DOUBLE)))"


def _x(name="x"):
    return F.col(name)


def _round(x, digits=6):
    return F.transform(x, lambda v: F.round(v, digits))


_CHAIN = "greatest(0, list_max(x) - CASE WHEN w * 480 <= 144 * 176 THEN 0.20 WHEN w * 480 <= 360 * 480 THEN 0.12 WHEN w * 480 <= 640 * 480 THEN 0.08 ELSE 0 END::DOUBLE)"
for _flag, _less in (("anime", 0.15), ("dark", 0.12), ("warm", 0.10), ("composite", 0.20), ("sport", 0.15)):
    _CHAIN = f"greatest(0, {_CHAIN} - CASE WHEN {_flag} THEN {_less} ELSE 0 END::DOUBLE)"
_DECIDED = f"""c AS (SELECT *, video_id % 11 / 10.0::DOUBLE AS p_sports, video_id % 11 / 10.0::DOUBLE > 0.55 AS sport, video_id % 7 = 0 AS anime, video_id % 2 = 0 AS gore, video_id % 3 = 0 AS dark, video_id % 4 = 0 AS warm, video_id % 9 = 0 AS composite,
  100 * (video_id % 8) AS w, len(list_filter({_R16}, lambda v: v > 0.7)) AS high FROM (SELECT video_id, list_transform(x, lambda v: least(1, 5 * v)) AS x, list_transform(y, lambda v: v * (1 - 0.07::DOUBLE * (video_id % 6))) AS y FROM series)),
s AS (SELECT *, round(CASE WHEN high >= 6 AND (dark OR warm OR composite) THEN list_max(x) ELSE {_CHAIN} END, 9) AS v,
  round(CASE WHEN sport THEN greatest(0, list_max(y) - round(1 - greatest(0.15::DOUBLE, 1 - p_sports), 2)) ELSE list_max(y) END, 9) AS n FROM c),
d AS (SELECT *, CASE WHEN v < CASE WHEN sport THEN 0.65 ELSE 0.5 END OR sport THEN 'safe' WHEN anime THEN 'blur' WHEN gore THEN 'ban' ELSE 'blur' END AS violence,
  CASE WHEN n >= 0.80 THEN 'ban' WHEN n >= 0.70 THEN 'blur' ELSE 'safe' END AS nsfw FROM s)"""


def _decided(spark, sf_dir):
    """Scores are the views' times a factor, so that every branch is reached; what pixels and prompts would say is drawn
    from the videos' ids."""
    video = F.col("video_id")
    more, less = F.transform("x", lambda v: F.least(F.lit(1.0), 5 * v)), F.transform("y", lambda v: v * (1 - 0.07 * (F.col("video_id") % 6)))
    found = series(spark, sf_dir).withColumns({"x": more, "y": less}).select("video_id", F.array_max("x").alias("peak"), F.array_max("y").alias("top"), seq.count_above(seq.resample(_x(), 16), pol.HIGH_SCORE).alias("high"))
    flags = {name: video % m == 0 for name, m in (("anime", 7), ("gore", 2), ("dark", 3), ("warm", 4), ("composite", 9))}
    decision = pol.video_decision(F.col("peak"), F.col("top"), F.col("high"), pol.resolution_penalty(100 * (video % 8), F.lit(480)), (video % 11) / F.lit(10.0), **flags)
    decision |= {c: F.round(decision[c], 9) for c in ("violence_score", "nsfw_score")}
    return found.select("video_id", "high", *(c.alias(n) for n, c in decision.items()))


@query(f"WITH {_DECIDED} SELECT violence, nsfw, violence <> 'safe' OR nsfw <> 'safe' AS flagged, count(*) AS videos, sum(high)::BIGINT AS high_frames FROM d GROUP BY ALL", "series")
def flag_video(spark, sf_dir):
    """Videos by what is decided on their violence and nsfw peaks."""
    return _decided(spark, sf_dir).groupBy("violence", "nsfw", "flagged").agg(F.count("*").alias("videos"), F.sum("high").alias("high_frames"))


@query(f"WITH {_DECIDED} SELECT video_id, round(v, 6) AS violence_score, round(n, 6) AS nsfw_score, violence, nsfw FROM d", "series")
def video_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).select("video_id", *(F.round(c, 6).alias(c) for c in ("violence_score", "nsfw_score")), "violence", "nsfw")


@query("SELECT video_id, list_transform(range(0, 8), lambda i: floor(i * (len(x) - 1) / 7)::INT) AS idx FROM series".replace("AS idx", "AS i").replace("SELECT video_id, ", "SELECT video_id, array_to_string(").replace(" AS i FROM", ", ',') AS idx FROM"), "series")
def linspace_idx(spark, sf_dir):
    return series(spark, sf_dir).select("video_id", F.array_join(seq.linspace_indices(F.size("x"), 8).cast("array<string>"), ",").alias("idx"))


@query(f"SELECT video_id, unnest(range(0, 16))::INT AS i, round(unnest({_R16}), 6) AS v FROM series", "series")
def resample16(spark, sf_dir):
    return series(spark, sf_dir).select("video_id", F.posexplode(seq.resample(_x(), 16)).alias("i", "v")).withColumn("v", F.round("v", 6))


@query(f"SELECT video_id, round({_NOISY.format(x='x')}, 6) AS pooled FROM series", "series")
def noisy_or(spark, sf_dir):
    return series(spark, sf_dir).select("video_id", F.round(seq.noisy_or(_x()), 6).alias("pooled"))


@query("WITH g AS (SELECT video_id, list_transform(range(1, len(x) + 1), lambda i: x[i] * (0.5::DOUBLE + 0.5::DOUBLE * y[i] / list_max(y))) AS g FROM series) SELECT video_id, round(" + _NOISY.format(x="g") + ", 6) AS pooled FROM g", "series")
def attn_noisy_or(spark, sf_dir):
    return series(spark, sf_dir).select("video_id", F.round(seq.gated_noisy_or(_x(), _x("y")), 6).alias("pooled"))


@query("SELECT video_id, round(sum(score * score2) / sum(score2), 6) AS m FROM frames GROUP BY video_id", "frames")
def weighted_mean(spark, sf_dir):
    return series(spark, sf_dir).select("video_id", F.round(seq.weighted_mean(_x(), _x("y")), 6).alias("m"))


@query("SELECT video_id, round(list_sum(list_transform(x, lambda v: (v - list_min(x)) / (list_max(x) - list_min(x)))), 4) AS total FROM series", "series")
def minmax(spark, sf_dir):
    return series(spark, sf_dir).select("video_id", F.round(seq.total(seq.min_max(_x())), 4).alias("total"))


@query("SELECT vec_id, unnest(range(0, 70))::INT AS i, round(unnest(list_concat(v, list_transform(range(0, 6), lambda k: 0.0::DOUBLE))), 6) AS x FROM features", "features")
def pad_truncate(spark, sf_dir):
    return features(spark, sf_dir).select("vec_id", F.posexplode(seq.pad(_x("v"), 70)).alias("i", "x")).withColumn("x", F.round("x", 6))


@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda z: z * z)) / len(v) + 1e-8))), 5) AS total FROM features", "features")
def rms_unit(spark, sf_dir):
    return features(spark, sf_dir).select("vec_id", F.round(seq.total(seq.rms_unit(_x("v"))), 5).alias("total"))


@query("WITH w AS (SELECT video_id, list_transform(y, lambda v: v / list_sum(y)) AS a FROM series WHERE len(y) > 1) SELECT video_id, round(-list_sum(list_transform(a, lambda v: v * ln(v + 1e-8))) / ln(len(a)), 6) AS ratio FROM w", "series")
def entropy_ratio(spark, sf_dir):
    found = series(spark, sf_dir).filter(F.size("y") > 1).select("video_id", F.col("y"), seq.total(_x("y")).alias("t"))
    return found.select("video_id", F.round(seq.entropy_ratio(F.transform("y", lambda v: v / F.col("t"))), 6).alias("ratio"))


@query("""WITH p AS (SELECT vec_id % 3 AS prompt_group, v FROM features WHERE vec_id < 24)
SELECT f.vec_id, p.prompt_group, round(max(list_cosine_similarity(f.v, p.v)), 6) AS similarity FROM features f, p GROUP BY 1, 2""", "features")
def prompt_similarity(spark, sf_dir):
    """Every vector against three groups of prompts; the first 24 vectors stand in for the prompts' embeddings."""
    f = features(spark, sf_dir)
    prompts = f.filter("vec_id < 24").select((F.col("vec_id") % 3).alias("prompt_group"), "v")
    return search.prompt_maxima(f.select("vec_id", "v"), prompts, "prompt_group").withColumn("similarity", F.round("similarity", 6))


_ROUND = """a{n} AS (SELECT vec_id, label, q / sum(q) OVER (PARTITION BY label) / count(DISTINCT label) OVER () AS q FROM b{m}),
b{n} AS (SELECT vec_id, label, q / sum(q) OVER (PARTITION BY vec_id) / count(DISTINCT vec_id) OVER () AS q FROM a{n})"""


@query(f"""WITH p AS (SELECT label, list(m ORDER BY i) AS p FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM features) GROUP BY 1, 2) GROUP BY 1),
z AS (SELECT vec_id, p.label, exp(list_cosine_similarity(v, p.p) / 0.05) AS e FROM features, p), b0 AS (SELECT vec_id, label, e / sum(e) OVER () AS q FROM z),
{", ".join(_ROUND.format(n=n + 1, m=n) for n in range(3))}
SELECT vec_id, label, round(q * count(DISTINCT vec_id) OVER (), 6) AS q FROM b3""", "features")
def balanced_assignment(spark, sf_dir):
    """Every vector's share in each class, the classes as large as one another."""
    f = features(spark, sf_dir)
    found = balancing.logits(f, balancing.class_means(f, "label", "v"), "vec_id", "label", "v")
    return balancing.balanced(found, "vec_id", 0.05, 3).withColumn("q", F.round("q", 6))


@query("SELECT video_id, count(*) AS n, round(avg(s), 6) AS m FROM (SELECT video_id, abs(score - lag(score) OVER (PARTITION BY video_id ORDER BY frame_idx)) AS s FROM frames) WHERE s IS NOT NULL GROUP BY video_id", "frames")
def consecutive_change(spark, sf_dir):
    change = F.zip_with(F.slice("x", 2, F.size("x")), F.slice("x", 1, F.size("x") - 1), lambda b, a: F.abs(b - a))
    found = series(spark, sf_dir).filter(F.size("x") > 1).select("video_id", change.alias("c"))
    return found.select("video_id", F.size("c").cast("long").alias("n"), F.round(seq.mean(_x("c")), 6).alias("m"))


@query("SELECT video_id, frame_idx, round(score / max(score) OVER (PARTITION BY video_id), 6) AS flow FROM frames", "frames")
def flow_norm(spark, sf_dir):
    rows = frames(spark, sf_dir)
    met = alike(rows, rows.groupBy("video_id").agg(F.max("score").alias("top")), ["video_id"])
    return met.select("video_id", "frame_idx", F.round(F.try_divide("score", "top"), 6).alias("flow"))


@query("""WITH n AS (SELECT video_id, max(frame_idx) + 1 AS n FROM frames GROUP BY 1),
s AS (SELECT video_id, unnest(list_distinct(list_concat(range(0, greatest(n - 16, 0) + 1, 8), [greatest(n - 16, 0)]))) AS start FROM n),
c AS (SELECT s.video_id, start, sum(round(score * 1000000)::BIGINT) AS m, count(*) AS k FROM s JOIN frames f ON f.video_id = s.video_id AND f.frame_idx >= start AND f.frame_idx < start + 16 GROUP BY 1, 2)
SELECT f.video_id, f.frame_idx, sum(c.m)::DOUBLE / (1000000 * sum(c.k)) AS smooth FROM frames f JOIN c ON c.video_id = f.video_id AND f.frame_idx >= start AND f.frame_idx < start + 16 GROUP BY 1, 2""", "frames")
def window_overlap_avg(spark, sf_dir):
    """Means of overlapping 16-frame clips, averaged back to the frames that they cover. Scores are whole millionths and
    all clips of a video are equally long, so sums are exact and divided once."""
    whole = F.transform("x", lambda v: F.round(v * 1_000_000).cast("long"))
    starts = series(spark, sf_dir).select("video_id", whole.alias("x"), F.explode(seq.windows(F.size("x"), 16, 8)).alias("start"))
    clips = starts.select("video_id", "start", F.slice("x", F.col("start") + 1, 16).alias("clip")).withColumn("m", F.aggregate("clip", F.lit(0).cast("long"), lambda a, v: a + v))
    spread = clips.select("video_id", F.explode(F.sequence(F.col("start"), F.col("start") + F.size("clip") - 1)).alias("frame_idx"), "m", F.size("clip").alias("k"))
    return spread.groupBy("video_id", "frame_idx").agg((F.sum("m").cast("double") / (1_000_000 * F.sum("k"))).alias("smooth"))


@query("""SELECT video_id, frame_idx, score, CASE WHEN up <= k2 THEN 0 WHEN down <= k1 THEN 1 ELSE -1 END AS pseudo FROM (
  SELECT *, greatest(1, floor(count(*) OVER w * 0.1::DOUBLE)) AS k1, greatest(1, floor(count(*) OVER w * 0.3::DOUBLE)) AS k2,
  row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_idx DESC) AS down, row_number() OVER (PARTITION BY video_id ORDER BY score, frame_idx) AS up FROM frames WINDOW w AS (PARTITION BY video_id))""", "frames")
def pseudo_labels(spark, sf_dir):
    """Ranks from above and from below are worked out by buckets of scores, so a long video is split."""
    rows = frames(spark, sf_dir).select("video_id", "frame_idx", "score", (-F.col("score")).alias("_s"), (-F.col("frame_idx")).alias("_f"))
    steps = lambda c: F.floor(F.col(c) * 64)
    placed = cur.ranked(rows, ["video_id"], "score", "frame_idx", name="up", size="n", bucket=steps("score"))
    placed = cur.ranked(placed, ["video_id"], "_s", "_f", name="down", bucket=steps("_s"))
    least = lambda share: F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(share)))
    return placed.select("video_id", "frame_idx", "score", F.when(F.col("up") <= least(0.3), 0).when(F.col("down") <= least(0.1), 1).otherwise(-1).alias("pseudo"))


@stated("""SELECT video_id, frame_idx, round(h, 6) AS entropy FROM (SELECT video_id, frame_idx, -(p * ln(p) + (1 - p) * ln(1 - p)) / ln(2) AS h FROM (SELECT video_id, frame_idx, least(1 - 1e-6, greatest(1e-6, score)) AS p FROM {frames})) WHERE h <= 0.5""")
def certain_frames(spark, sf_dir):
    found = frames(spark, sf_dir).select("video_id", "frame_idx", seq.binary_entropy(F.col("score")).alias("h")).filter("h <= 0.5")
    return found.select("video_id", "frame_idx", F.round("h", 6).alias("entropy"))


@stated("SELECT video_id, frame_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frame_idx DESC) AS rn FROM {frames}) WHERE rn <= 6")
def topk_frames(spark, sf_dir):
    return cur.first_of_each(frames(spark, sf_dir), "video_id", 6, F.desc("score"), F.desc("frame_idx")).select("video_id", "frame_idx", "score")


@query("""WITH p AS (SELECT video_id, x, list_max(x) AS peak, list_position(x, list_max(x)) AS k FROM series),
n AS (SELECT *, list_concat(x[greatest(k - 2, 1):k - 1], x[k + 1:k + 2]) AS near FROM p),
e AS (SELECT video_id, peak, CASE WHEN len(near) = 0 THEN 'no_context' WHEN peak >= 0.78 AND list_max(near) >= 0.12 THEN 'fast_action' WHEN peak >= 0.65 AND list_avg(near) >= 0.18 THEN 'sustained_action'
  WHEN peak >= 0.65 AND list_max(near) < 0.12 THEN 'isolated_spike' ELSE 'weak_signal' END AS pattern FROM n)
SELECT video_id, pattern, round(peak * CASE pattern WHEN 'no_context' THEN 0.30 WHEN 'fast_action' THEN 0.65 WHEN 'sustained_action' THEN 0.80 WHEN 'isolated_spike' THEN 0.25 ELSE 0.40 END::DOUBLE, 6) AS evidence FROM e""", "series")
def peak_evidence(spark, sf_dir):
    pattern, evidence = seq.peak_evidence(_x())
    return series(spark, sf_dir).select("video_id", pattern.alias("pattern"), F.round(evidence, 6).alias("evidence"))


@stated("SELECT video_id, count(*) AS n, round(avg(score), 6) AS m, max(score2) AS top, round(min(score), 6) AS low FROM {frames} GROUP BY video_id")
def frame_summary(spark, sf_dir):
    found = frames(spark, sf_dir).groupBy("video_id")
    return found.agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("m"), F.max("score2").alias("top"), F.round(F.min("score"), 6).alias("low"))


@stated("SELECT video_id, frame_idx, n - 1 - frame_idx AS back_idx FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM {frames})")
def reversed_frames(spark, sf_dir):
    rows = frames(spark, sf_dir)
    met = alike(rows, rows.groupBy("video_id").agg(F.count("*").alias("n")), ["video_id"])
    return met.select("video_id", "frame_idx", (F.col("n") - 1 - F.col("frame_idx")).alias("back_idx"))


@query("""WITH l AS (SELECT label, v, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM features),
c AS (SELECT label, count(*) AS frames, avg(CASE WHEN p IS NOT NULL THEN list_cosine_similarity(v, p) END) AS similarity FROM l GROUP BY 1),
d AS (SELECT label, avg(x) AS variance FROM (SELECT label, i, var_samp(x) AS x FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS i FROM features) GROUP BY 1, 2) GROUP BY 1)
SELECT label, frames, round(similarity, 6) AS similarity, round(variance, 6) AS variance FROM c JOIN d USING (label)""", "features")
def temporal_coherence(spark, sf_dir):
    """Vectors of one label as a sequence in the order of their ids."""
    found = temporal.coherence(features(spark, sf_dir), "label", "vec_id", "v", F.floor(F.col("vec_id") / 256))
    return found.select("label", "frames", *(F.round(c, 6).alias(c) for c in ("similarity", "variance")))


_COIN = "('0x' || substr(md5('42:{0}:' || video_id), 1, 2))::INT % 2"
_DRAWN = "list_transform(list_sort([" + ", ".join(f"{{'h': md5('42:group:' || video_id || ':{g}'), 'g': {g}}}" for g in range(4)) + "]), lambda d: d.g)"


@query(f"""WITH s AS (SELECT video_id, least(count(*), 16) AS n, {_COIN.format('direction')} AS y_direction, {_COIN.format('shuffle')} AS y_shuffle, {_COIN.format('speed')} AS y_speed, {_DRAWN} AS drawn FROM frames WHERE frame_idx < 32 GROUP BY video_id),
f AS (SELECT video_id, frame_idx AS i, s.* EXCLUDE (video_id, drawn), CASE WHEN drawn = [0, 1, 2, 3] THEN [1, 2, 3, 0] ELSE drawn END AS drawn, n // 4 AS size FROM frames JOIN s USING (video_id) WHERE frame_idx < 32),
p AS (SELECT *, CASE WHEN i < n THEN CASE y_direction WHEN 1 THEN n - 1 - i ELSE i END END AS direction_at,
  CASE WHEN i < 4 * size THEN CASE y_shuffle WHEN 1 THEN (list_position(drawn, i // greatest(size, 1)) - 1) * size + i % greatest(size, 1) ELSE i END END AS shuffle_at,
  CASE WHEN y_speed = 0 THEN CASE WHEN i < n THEN i END WHEN i % 2 = 0 THEN i // 2 END AS speed_at FROM f)
SELECT video_id, i AS frame_idx, y_direction, y_shuffle, y_speed, direction_at::BIGINT AS direction_at, shuffle_at::BIGINT AS shuffle_at, speed_at::BIGINT AS speed_at FROM p WHERE coalesce(direction_at, shuffle_at, speed_at) IS NOT NULL""", "frames")
def pretext_clips(spark, sf_dir):
    return temporal.pretext(frames(spark, sf_dir).select("video_id", "frame_idx"), "video_id", "frame_idx", 42)


@stated("SELECT video_id, round(1 / (1 + exp(-avg(20 * (score - score2)))), 6) AS p FROM {frames} GROUP BY video_id")
def clip_logits(spark, sf_dir):
    logit = F.avg(20 * (F.col("score") - F.col("score2")))
    return frames(spark, sf_dir).groupBy("video_id").agg(F.round(1 / (1 + F.exp(-logit)), 6).alias("p"))


@stated("SELECT video_id, m AS risk, m >= 0.2 AS passed FROM (SELECT video_id, CAST(sum(CAST(round(score * 1000000) AS BIGINT)) AS DOUBLE) / CAST(1000000 * count(*) AS DOUBLE) AS m FROM {frames} WHERE frame_idx < 8 GROUP BY video_id)")
def proxy_gate(spark, sf_dir):
    whole = F.sum(F.round(F.col("score") * 1_000_000).cast("long")).cast("double")
    found = frames(spark, sf_dir).filter("frame_idx < 8").groupBy("video_id").agg((whole / (1_000_000 * F.count("*"))).alias("risk"))
    return found.select("video_id", "risk", (F.col("risk") >= 0.2).alias("passed"))


@query("SELECT video_id, round(list_max(list_transform(x, lambda v: exp((v - list_max(x)) / 0.2::DOUBLE) / list_sum(list_transform(x, lambda z: exp((z - list_max(x)) / 0.2::DOUBLE))))), 6) AS highest FROM series", "series")
def softmax_pool(spark, sf_dir):
    return series(spark, sf_dir).select("video_id", F.round(F.array_max(seq.softmax(_x(), 0.2)), 6).alias("highest"))
