"""Single rules over fixtures that reach each of their branches."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks
from ..functions import boxes
from ..functions import sequences as seq
from ..operators import audit, curation, metrics, reports
from ..session import shared_dir, table
from ..sources import scans
from ..sources.views import features, frames, manifest, media_listing, predictions, series
from .common import query, stated

_FRAME_NAME = "'v_' || user_id || CASE event_id % 4 WHEN 0 THEN '_x' || event_id ELSE '_' || event_id END"


@query(f"""WITH n AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN {_FRAME_NAME} ELSE 'v_' || user_id END AS video FROM events),
g AS (SELECT video FROM (SELECT DISTINCT video FROM n) ORDER BY md5('9:' || video), video LIMIT 40) SELECT event_id, video FROM n WHERE video IN (SELECT video FROM g)""")
def drawn_negatives(spark, sf_dir):
    """All frames of 40 videos; a frame whose name has no number at its end is a video of its own."""
    event = F.col("event_id").cast("string")
    name = F.concat(F.lit("v_"), F.col("user_id").cast("string"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("_x"), event)).otherwise(F.concat(F.lit("_"), event)))
    rows = table(spark, sf_dir, "events").select("event_id", scans.video_id(name).alias("video"))
    return curation.drawn_groups(rows, "video", 40, 9)


_W, _H = "320 * (1 + frame_idx % 5)", "240 * (1 + frame_idx % 3)"


@query(f"""WITH f AS (SELECT video_id, frame_idx, {_W} AS ow, {_H} AS oh, 0.25::DOUBLE AS s, floor(score * {_W} * 0.3)::BIGINT AS x, floor(score2 * {_H} * 0.2)::BIGINT AS y, floor(score2 * {_W} * 0.3)::BIGINT AS w, floor({_H} * 0.26)::BIGINT AS h FROM frames),
o AS (SELECT *, greatest(0, trunc(x * (1 / s))::BIGINT) AS x0, greatest(0, trunc(y * (1 / s))::BIGINT) AS y0 FROM f),
b AS (SELECT *, greatest(1, least(trunc(w * (1 / s))::BIGINT, ow - x0)) AS w0, greatest(1, least(trunc(h * (1 / s))::BIGINT, oh - y0)) AS h0 FROM o),
t AS (SELECT *, greatest(0, trunc(x0 * (224 / ow::DOUBLE))::BIGINT) AS x1, greatest(0, trunc(y0 * (224 / oh::DOUBLE))::BIGINT) AS y1 FROM b WHERE w0 * h0 / (ow * oh)::DOUBLE < 0.95)
SELECT video_id, frame_idx, x0 AS x, y0 AS y, w0 AS w, h0 AS h, x1 AS cx, y1 AS cy, greatest(1, least(trunc(w0 * (224 / ow::DOUBLE))::BIGINT, 224 - x1)) AS cw, greatest(1, least(trunc(h0 * (224 / oh::DOUBLE))::BIGINT, 224 - y1)) AS ch FROM t""", "frames")
def box_scaling(spark, sf_dir):
    """Boxes from frames of a quarter of the size, in the frame and in a 224 x 224 crop; those that are nearly all of the
    frame are left out."""
    # A side's two factors one after the other, as the SQL has them: their product first rounds otherwise.
    across, down = (320, 1 + F.col("frame_idx") % 5), (240, 1 + F.col("frame_idx") % 3)
    rows = frames(spark, sf_dir).withColumns({name: side[0] * side[1] for name, side in (("ow", across), ("oh", down))})
    part = lambda score, side, share: F.floor(F.col(score) * side[0] * side[1] * share)
    found = boxes.content_box(part("score", across, 0.3), part("score2", down, 0.2), part("score2", across, 0.3), F.floor(F.col("oh") * 0.26), F.lit(0.25), F.col("ow"), F.col("oh"))
    rows = rows.withColumn("b", found).filter("b IS NOT NULL")
    side = F.lit(224).cast("long")
    crop = boxes.scaled(*(F.col(f"b.{c}") for c in "xywh"), 224 / F.col("ow").cast("double"), 224 / F.col("oh").cast("double"), side, side)
    return rows.withColumn("c", crop).select("video_id", "frame_idx", "b.*", *(F.col(f"c.{c}").alias(f"c{c}") for c in "xywh"))


_DAMAGED = """d AS (SELECT vec_id, vec_id // 20 AS item, CASE vec_id % 50 WHEN 7 THEN v[1:60] WHEN 11 THEN list_concat(v[1:5], ['nan'::DOUBLE], v[7:64]) WHEN 13 THEN list_concat(['inf'::DOUBLE], v[2:64]) ELSE v END AS v FROM (SELECT vec_id, list_concat(v[1:63], [v[64] / 100]) AS v FROM features))"""


def _damaged(spark, sf_dir):
    """Vectors as frames of items, some too short, some with a NaN at place 5 or an infinity at 0; place 63 hardly varies."""
    v, k = F.transform("v", lambda a, j: F.when(j == 63, a / 100).otherwise(a)), F.col("vec_id") % 50
    bad = lambda i, x: F.transform(v, lambda a, j: F.when(j == i, F.lit(x)).otherwise(a))
    damaged = F.when(k == 7, F.slice(v, 1, 60)).when(k == 11, bad(5, float("nan"))).when(k == 13, bad(0, float("inf"))).otherwise(v)
    return features(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 20).alias("item"), damaged.alias("v"))


@query(f"""WITH {_DAMAGED}, i AS (SELECT item, bool_or(len(list_filter(v, lambda x: isnan(x))) > 0) AS nan, bool_or(len(list_filter(v, lambda x: isinf(x))) > 0) AS inf,
  stddev_pop(v[62]) AS gore, stddev_pop(v[63]) AS self_harm, stddev_pop(v[64]) AS nsfw FROM d GROUP BY 1),
m AS (SELECT count(*) AS items, count(*) FILTER (WHERE nan) AS nan_items, count(*) FILTER (WHERE inf) AS inf_items, avg(gore) AS gore, avg(self_harm) AS self_harm, avg(nsfw) AS nsfw FROM i)
SELECT items, (SELECT array_to_string(list_sort(list(DISTINCT len(v))), ',') FROM d) AS widths, nan_items, inf_items, unnest(['gore', 'self_harm', 'nsfw']) AS "column", round(unnest([gore, self_harm, nsfw]), 6) AS mean_std,
  CASE WHEN unnest([gore, self_harm, nsfw]) > 0.1 THEN 'ok' ELSE 'low' END AS status FROM m""", "features")
def feature_set_sanity(spark, sf_dir):
    """Three columns of the vectors as those of experts."""
    found = audit.set_sanity(_damaged(spark, sf_dir), "item", "v", {"gore": 61, "self_harm": 62, "nsfw": 63}, 0.1)
    return found.withColumn("mean_std", F.round("mean_std", 6))


@query(f"""WITH {_DAMAGED}, f AS (SELECT vec_id, CASE vec_id % 50 WHEN 17 THEN list_transform(v, lambda x: x / 10) ELSE v END AS v FROM d),
n AS (SELECT *, len(list_filter(v, lambda x: isnan(x) OR isinf(x))) > 0 AS bad, list_sum(list_transform(v, lambda x: x * x)) AS s2 FROM f)
SELECT vec_id, len(v)::INT AS width, CASE WHEN NOT bad THEN round(sqrt(s2), 6) END AS norm, concat_ws(';', CASE WHEN len(v) <> 64 THEN 'width' END, CASE WHEN bad THEN 'not_finite' END,
  CASE WHEN list_max(list_transform(list_filter(v, lambda x: NOT isnan(x)), lambda x: abs(x))) > 0.4 OR vec_id % 50 = 11 THEN 'range' END,
  CASE WHEN NOT bad AND sqrt(greatest(0, s2 / len(v) - (list_sum(v) / len(v)) ** 2)) < 0.05 THEN 'flat' END) AS issues FROM n""", "features")
def feature_qa(spark, sf_dir):
    """Damaged vectors and some of hardly any spread; a NaN is out of every range."""
    rows = _damaged(spark, sf_dir)
    v = F.when(F.col("vec_id") % 50 == 17, F.transform("v", lambda x: x / 10)).otherwise(F.col("v"))
    found = audit.feature_issues(rows.withColumn("v", v), "vec_id", "v", 64, 0.4)
    return found.withColumn("norm", F.when(~F.isnan("norm") & (F.col("norm") < float("inf")), F.col("norm")))


@query("""SELECT vec_id, CASE vec_id % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'not_finite' WHEN 2 THEN 'kind' WHEN 3 THEN 'dimensions' WHEN 4 THEN 'unreadable' WHEN 5 THEN 'not_finite' END AS fault FROM embeddings""")
def array_checks(spark, sf_dir):
    """Arrays as they are loaded, with every fault; null for those without any."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.col("embedding").cast("array<double>")).alias("a"), (F.col("vec_id") % 7).alias("k"))
    put = lambda x: F.concat("a", F.array(F.array(F.lit(x))))
    array = F.when(F.col("k") == 0, F.array(F.array().cast("array<double>"))).when(F.col("k") == 1, put(float("nan"))).when(F.col("k") == 5, put(float("-inf"))).when(F.col("k") != 4, F.col("a"))
    kind, dimensions = F.when(F.col("k") == 2, "float64").otherwise("float32"), F.when(F.col("k") == 3, 1).otherwise(2)
    return rows.select("vec_id", audit.array_faults(array, kind, dimensions).alias("fault"))


@query("""WITH k AS (SELECT doc_id, CASE WHEN doc_id % 3 = 2 AND doc_id % 4 = 0 THEN 'v' || doc_id ELSE NULL END AS given, doc_id % 3 = 0 AS by_full, doc_id % 3 = 1 AND doc_id % 10 <> 0 AS by_name FROM documents)
SELECT doc_id, CASE WHEN given IS NOT NULL OR by_full OR by_name THEN 'v' || doc_id END AS file, CASE WHEN given IS NOT NULL THEN 'given' WHEN by_full THEN 'full' WHEN by_name THEN 'name' ELSE 'none' END AS how FROM k""")
def resolve_paths(spark, sf_dir):
    """Paths that are known, paths whose last component is, once or twice, files that are given and nulls in writing."""
    key, source = F.col("doc_id").cast("string"), F.col("source")
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    files = docs.select(F.concat(F.lit("a//"), source, F.lit("/"), key, F.lit(".npy")).alias("path"), F.concat(F.lit("v"), key).alias("file"))
    twice = docs.filter("doc_id % 10 = 0").select(F.concat(F.lit("b/"), key, F.lit(".npy")).alias("path"), F.concat(F.lit("w"), key).alias("file"))
    path = F.when(k % 3 == 0, F.concat(F.lit(" ./a/"), source, F.lit("\\"), key, F.lit(".npy"))).when(k % 3 == 1, F.concat(F.lit("moved/"), key, F.lit(".npy"))).otherwise(F.concat(F.lit("gone/x"), key))
    given = F.when(k % 3 == 2, F.when(k % 4 == 0, F.concat(F.lit(" v"), key, F.lit(" "))).when(k % 4 == 1, "NaN").when(k % 4 == 2, "None"))
    return audit.resolved(docs.select("doc_id", path.alias("path"), given.alias("given")), files.unionByName(twice)).select("doc_id", "file", "how")


@query("""WITH m AS (SELECT doc_id, split, md5, 'set/' || lang || CASE doc_id % 5 WHEN 0 THEN '/flat/' ELSE '/images/' END || doc_id || '.jpg' AS path FROM manifest),
l AS (SELECT doc_id, path FROM m WHERE split <> 'train' AND md5 IN (SELECT md5 FROM m WHERE split = 'train'))
SELECT path FROM l UNION SELECT replace(replace(path, '/images/', '/labels/'), '.jpg', '.txt') FROM l WHERE doc_id % 5 <> 0 AND doc_id % 3 <> 0""", "manifest")
def leak_removals(spark, sf_dir):
    """Leaked images and their label files; some have none, some lie in a folder of another name."""
    key = F.col("doc_id").cast("string")
    path = F.concat(F.lit("set/"), "lang", F.when(F.col("doc_id") % 5 == 0, "/flat/").otherwise("/images/"), key, F.lit(".jpg"))
    rows = manifest(spark, sf_dir).select("doc_id", "split", "md5", "lang", path.alias("path"))
    leaked = rows.filter("split <> 'train'").join(rows.filter("split = 'train'").select("md5"), "md5", "left_semi")
    labels = rows.filter("doc_id % 3 <> 0").select(F.concat(F.lit("set/"), "lang", F.lit("/labels/"), key, F.lit(".txt")).alias("path"))
    return audit.removals(leaked, labels)


_SOFT = "list_transform(x, lambda v: exp((v - list_max(x)) / 2::DOUBLE) / list_sum(list_transform(x, lambda z: exp((z - list_max(x)) / 2::DOUBLE))))"
_FLOORED = "list_transform({0}, lambda v: greatest(1e-6, v) / list_sum(list_transform({0}, lambda z: greatest(1e-6, z))))"


@query(f"""WITH s AS (SELECT video_id % 10 AS epoch, x, {_FLOORED.format(_SOFT)} AS t, {_FLOORED.format("y")} AS a FROM series),
v AS (SELECT epoch, list_sum(list_transform(range(1, len(t) + 1), lambda i: t[i] * (ln(t[i]) - ln(a[i])))) AS kl, -list_sum(list_transform(a, lambda z: z * ln(z))) AS entropy, list_max(x) AS bce FROM s),
e AS (SELECT epoch, CASE WHEN epoch < 3 THEN 0 ELSE avg(kl) END AS kl, avg(entropy) AS entropy, avg(bce) AS bce FROM v GROUP BY 1)
SELECT epoch, round(kl, 6) AS kl, round(entropy, 6) AS entropy, round(bce + CASE WHEN epoch < 3 THEN 0 ELSE 0.5::DOUBLE END * kl + 0.1::DOUBLE * entropy, 6) AS total FROM e""", "series")
def distillation(spark, sf_dir):
    """Videos in ten epochs, the first three a warm-up; second scores are the attention, the peak stands for the loss."""
    rows = series(spark, sf_dir).withColumn("epoch", F.col("video_id") % 10)
    found = reports.distillation(rows, "epoch", F.col("x"), F.col("y"), F.array_max("x"), 3, 2.0, 0.5, 0.1)
    return found.select("epoch", *(F.round(c, 6).alias(c) for c in ("kl", "entropy", "total")))


_RATE = "coalesce({0} / nullif({1}::DOUBLE, 0), 0)"


@stated(f"""SELECT bucket, label, n, tp, fp, fn, tn, round({_RATE.format("tp", "(tp + fp)")}, 6) AS p, round({_RATE.format("tp", "(tp + fn)")}, 6) AS r, round({_RATE.format("2 * tp", "(2 * tp + fp + fn)")}, 6) AS f1, round(avg({_RATE.format("2 * tp", "(2 * tp + fp + fn)")}) OVER (PARTITION BY bucket), 6) AS macro
FROM (SELECT bucket, label, count(*) AS n, count(*) FILTER (WHERE y = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND score >= 0.5) AS fp, count(*) FILTER (WHERE y = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND score < 0.5) AS tn
  FROM (SELECT label, y, score, CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 2 = 0 AND y = 0 AND score < 0.5 THEN 'calm' ELSE bucket END AS bucket FROM {{predictions}}) WHERE bucket <> '' GROUP BY 1, 2)""")
def bucket_report(spark, sf_dir):
    """Rows without a bucket are left out; one bucket has neither a positive nor a flagged row."""
    calm = (F.col("doc_id") % 2 == 0) & (F.col("y") == 0) & (F.col("score") < 0.5)
    rows = predictions(spark, sf_dir).withColumn("bucket", F.when(F.col("doc_id") % 7 == 0, "").when(calm, "calm").otherwise(F.col("bucket")))
    found = metrics.bucket_report(rows, 0.5, "bucket", "label")
    return found.withColumns({c: F.round(c, 6) for c in ("p", "r", "f1", "macro")})


@query("""WITH c AS (SELECT video_id, ([0.25, 0.8, 1.25, 3]::DOUBLE[])[1 + video_id % 4] AS f, video_id % 7 - 3 AS o, x FROM (SELECT video_id, x[1:1 + 3 * (video_id % 9)] AS x FROM series)),
j AS (SELECT video_id, f, CASE WHEN len(x) > 6 AND o > 0 THEN x[o + 1:] ELSE x END AS x FROM c),
m AS (SELECT *, greatest(4, floor(len(x) / least(2::DOUBLE, greatest(0.5::DOUBLE, f)))::INT) AS m FROM j),
r AS (SELECT video_id, CASE WHEN len(x) < 4 THEN x ELSE list_transform(range(0, m), lambda i: x[1 + CASE WHEN i = m - 1 THEN len(x) - 1 ELSE floor(i * ((len(x) - 1) / (m - 1)::DOUBLE))::INT END]) END AS y FROM m)
SELECT video_id, unnest(range(0, len(y)))::INT AS i, round(unnest(y), 6) AS v FROM r""", "series")
def speed_and_start(spark, sf_dir):
    """Sequences of one row and more begun later by up to three rows, then played at other speeds, some out of bounds."""
    video = F.col("video_id")
    cut = series(spark, sf_dir).select("video_id", F.slice("x", 1, (1 + 3 * (video % 9)).cast("int")).alias("x"))
    factor = F.element_at(F.array(*map(F.lit, [0.25, 0.8, 1.25, 3.0])), (video % 4 + 1).cast("int"))
    later = cut.withColumn("x", seq.started_later(F.col("x"), (video % 7 - 3).cast("int"), 3))
    return later.select("video_id", F.posexplode(seq.respeeded(F.col("x"), factor)).alias("i", "v")).withColumn("v", F.round("v", 6))


@stated("SELECT video_id, frame_idx, score, attention FROM (SELECT video_id, frame_idx, score, score2 AS attention, row_number() OVER (PARTITION BY video_id ORDER BY score2 DESC, frame_idx DESC) AS rn FROM {frames}) WHERE rn <= 5")
def attention_gallery(spark, sf_dir):
    """The five frames of the highest attention; of equals the last ones, as when a list is sorted and read backwards."""
    rows = frames(spark, sf_dir).withColumnRenamed("score2", "attention")
    return curation.first_of_each(rows, "video_id", 5, F.desc("attention"), F.desc("frame_idx")).select("video_id", "frame_idx", "score", "attention")


@query("SELECT doc_id, path FROM media_listing WHERE lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('mp4', 'avi', 'mov', 'mkv', 'webm') ORDER BY path LIMIT 25", "media_listing")
def first_videos(spark, sf_dir):
    """The first 25 files of one media type."""
    return curation.first_of_kind(scans.with_media_type(media_listing(spark, sf_dir)), "video", 25, "path").select("doc_id", "path")


@query("""SELECT e.artifact, coalesce(round(sum(length) / 1e6, 1), 0) AS size_mb, count(length) > 0 AS found FROM (SELECT unnest(['a', 'boxes', 'misc', 'nsfw_dataset_v1', 'lost']) AS artifact) e
LEFT JOIN (SELECT split_part(path, '/', 2) AS artifact, length FROM media_listing WHERE path LIKE 'in/%') f ON f.artifact = e.artifact GROUP BY 1""", "media_listing")
def artifact_sizes(spark, sf_dir):
    """Folders of the listing as artifacts; one that is expected isn't there."""
    listing = media_listing(spark, sf_dir).filter(F.startswith("path", F.lit("in/"))).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("artifact"), "length")
    expected = spark.createDataFrame([(x,) for x in ("a", "boxes", "misc", "nsfw_dataset_v1", "lost")], "artifact string")
    return reports.sizes(listing, expected, "artifact")


@query("""SELECT 'arrays' AS kind, doc_id, path, violence FROM manifest WHERE doc_id % 2 = 0 UNION ALL SELECT 'images', doc_id, path, violence FROM manifest WHERE doc_id % 2 = 1 AND doc_id % 3 < 2""", "manifest")
def sniffed_manifests(spark, sf_dir):
    """Two manifests written in two parts each, one with arrays and its columns in another order, read back by their headers."""
    rows, out = manifest(spark, sf_dir).select("doc_id", "path", "violence"), []
    for k, name in enumerate(("array_path", "image_path")):
        path = shared_dir(spark, f"manifest-{k}")
        for part in range(2):
            own = rows.filter((F.col("doc_id") % 2 == k) & (F.col("doc_id") % 3 == part) if k else (F.col("doc_id") % 2 == k) & (F.col("doc_id") % 4 == 2 * part))
            renamed = own.withColumnRenamed("path", name)
            sinks.append_csv(renamed.select("violence", name, "doc_id") if k else renamed, path)
        kind, found = sinks.read_manifest(spark, path, "doc_id bigint, array_path string, violence int", "doc_id bigint, image_path string, violence int")
        out.append(found.withColumnRenamed(name, "path").withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1]).select("kind", "doc_id", "path", "violence")
