"""Scans and ladders over paths and class numbers, packed arrays, shots, runs, and sinks read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import sinks
from ..functions import sequences as seq
from ..operators import calibration as cal
from ..session import shared_dir, table
from ..sources import scans
from ..sources.views import features, frames, manifest, series
from .common import query


@query("SELECT DISTINCT lower(replace(split_part(trim(url || ' 12 x'), ' ', 1), chr(92), '/')) AS name FROM pages WHERE url <> ''")
def first_token_names(spark, sf_dir):
    return scans.first_tokens(table(spark, sf_dir, "pages").select(F.concat("url", F.lit(" 12 x")).alias("value")))


@query("""SELECT doc_id, list_contains(string_split(path, '/'), 'en') AS included, NOT list_has_any(string_split(path, '/'), ['fr', 'de']) AS left_in FROM manifest""", "manifest")
def class_folders(spark, sf_dir):
    path = F.col("path")
    return manifest(spark, sf_dir).select("doc_id", scans.in_classes(path, include=["en"]).alias("included"), scans.in_classes(path, exclude=["fr", "de"]).alias("left_in"))


@query("SELECT doc_id, 'root/' || source AS source, length(source) % 3 AS target_class, CASE split WHEN 'train' THEN '' ELSE split END AS locked_split FROM manifest WHERE doc_id % 4 <> 0", "manifest")
def dataset_discovery(spark, sf_dir):
    m = manifest(spark, sf_dir)
    folder = F.when(F.col("doc_id") % 4 == 0, "notes").otherwise("images")
    files = m.select("doc_id", F.concat_ws("/", F.lit("root"), "source", F.when(F.col("split") == "val", "valid").otherwise(F.col("split")), folder, F.concat(F.col("doc_id").cast("string"), F.lit(".jpg"))).alias("path"))
    root = F.concat(F.lit("root/"), F.col("source"))
    specs = m.select("source").distinct().select(root.alias("root"), root.alias("source"), (F.length("source") % 3).alias("target_class"))
    return scans.discovered(files, specs, {"valid": "val", "test": "test"}).select("doc_id", "source", "target_class", "locked_split")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def paired_images(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    named = lambda kind, end: F.concat_ws("/", F.lit("root"), "source", F.lit(kind), F.concat(F.col("doc_id").cast("string"), F.lit(end)))
    images = docs.select("doc_id", named("images", ".jpg").alias("path"))
    return scans.paired(images, docs.filter("doc_id % 3 <> 0").select(named("labels", ".txt").alias("path"))).select("doc_id")


@query("SELECT doc_id, CASE lang WHEN 'fr' THEN 'risk' ELSE 'safe' END AS label, 'SYNTHETIC_ONLY' AS notes FROM manifest WHERE lang IN ('fr', 'en')", "manifest")
def audit_labels(spark, sf_dir):
    return scans.audit_rows(manifest(spark, sf_dir).select("doc_id", "path"), ["en"], ["fr"]).select("doc_id", "label", "notes")


@query("""WITH r AS (SELECT doc_id, path, lang, CASE doc_id % 4 WHEN 0 THEN '1' WHEN 1 THEN '0' WHEN 2 THEN 'x' END AS label FROM manifest WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0)
SELECT doc_id, coalesce(TRY_CAST(label AS INT), CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 END) AS label FROM r WHERE coalesce(TRY_CAST(label AS INT), CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 END) IS NOT NULL""", "manifest")
def checked_labels(spark, sf_dir):
    m = manifest(spark, sf_dir)
    kind = F.col("doc_id") % 4
    rows = m.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("path"))).alias("path"), F.when(kind == 0, "1").when(kind == 1, "0").when(kind == 2, "x").alias("label"))
    return scans.checked_paths(rows, m.filter("doc_id % 5 <> 0"), {"en": 0, "fr": 1}).select("doc_id", "label")


@query("SELECT count(*) FILTER (WHERE vec_id % 13 = 0) AS skipped, min(vec_id) FILTER (WHERE vec_id % 13 = 0) AS example FROM features", "features")
def readability(spark, sf_dir):
    return scans.readable(features(spark, sf_dir), (F.col("vec_id") % 13 != 0) & (F.size("v") == 64), "vec_id")[1]


_CLASSES = "[(event_id % 6)::INT, (event_id // 7 % 6)::INT]"


def _classes():
    return F.array((F.col("event_id") % 6).cast("int"), F.expr("cast(event_id div 7 % 6 as int)"))


@query(f"""WITH c AS (SELECT event_id, {_CLASSES} AS c FROM events) SELECT event_id, CASE WHEN list_contains(c, 1) THEN 'skip' WHEN list_contains(c, 4) THEN CASE WHEN list_has_any(c, [0, 5]) THEN 'positive_contaminated' ELSE 'positive_clean' END
  WHEN list_contains(c, 2) AND NOT list_contains(c, 3) THEN 'negative_clean' WHEN list_contains(c, 3) AND NOT list_contains(c, 2) THEN 'negative_violent' ELSE 'skip' END AS category FROM c""")
def image_ladder(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scans.blood_category(_classes()).alias("category"))


@query(f"""WITH c AS (SELECT event_id, {_CLASSES} AS c FROM events) SELECT event_id, CASE WHEN list_has_any(c, [2, 3]) THEN 'ligature' WHEN c[1] = 5 AND c[2] = 5 THEN 'hard_negative'
  WHEN list_has_any(c, [0, 1]) AND NOT list_has_any(c, [2, 3, 4, 5]) THEN 'weapon' WHEN list_contains(c, 4) AND NOT list_has_any(c, [0, 1, 2, 3]) THEN 'instrument' ELSE 'other' END AS part,
  ['syn_', 'noose_', 'img_', 'xsyn_'][event_id % 4 + 1] IN ('syn_', 'noose_') AS synthetic FROM c""")
def class_membership(spark, sf_dir):
    name = F.concat(F.get(F.array(*map(F.lit, ["syn_", "noose_", "img_", "xsyn_"])), (F.col("event_id") % 4).cast("int")), F.lit("1.jpg"))
    return table(spark, sf_dir, "events").select("event_id", scans.membership(_classes()).alias("part"), scans.is_synthetic(name).alias("synthetic"))


@query("SELECT doc_id, CASE WHEN source = 'wiki' THEN lang || '/' || doc_id || '.txt' ELSE path END AS below FROM manifest", "manifest")
def relative_paths(spark, sf_dir):
    return manifest(spark, sf_dir).select("doc_id", scans.relative_path(F.col("path"), F.lit("wiki/")).alias("below"))


_TAILS = ["_7", "_x7", "", "_1.5", "_-2e3", "_.5", "_1.", "_NaN", "_-inf", "_1d", "_7 ", "_7_x"]


@query(f"SELECT event_id, CASE WHEN event_id % {len(_TAILS)} IN (0, 3, 4, 5, 6, 7, 8, 10) THEN 'v_' || user_id ELSE CASE event_id % {len(_TAILS)} WHEN 2 THEN 'v' ELSE 'v_' || user_id || ({_TAILS})[1 + event_id % {len(_TAILS)}] END END AS video FROM events")
def video_ids(spark, sf_dir):
    """Tails that are numbers (also fractions, powers, infinities) and tails that aren't."""
    tail = F.element_at(F.array(*map(F.lit, _TAILS)), (F.col("event_id") % len(_TAILS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", scans.video_id(F.concat(F.lit("v_"), F.col("user_id").cast("string"), tail)).alias("video"))


@query("SELECT doc_id, coalesce(toxic, CASE lang WHEN 'en' THEN 0 ELSE 1 END)::INT AS label FROM documents LEFT JOIN labels USING (doc_id)")
def labels_inferred(spark, sf_dir):
    known = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    found = scans.label_or_inferred(table(spark, sf_dir, "documents"), known, "doc_id", F.when(F.col("lang") == "en", 0).otherwise(1))
    return found.select("doc_id", F.col("label").cast("int").alias("label"))


def _matrix():
    """Eight rows of eight columns from a vector of 64."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, 8))


@query("""WITH r AS (SELECT vec_id, v, unnest(range(0, 5)) AS i FROM features), k AS (SELECT *, i * 7 / 4.0::DOUBLE AS pos FROM r)
SELECT vec_id, i::INT AS i, j::INT AS j, round(v[floor(pos)::INT * 8 + j + 1] + (v[least(floor(pos)::INT + 1, 7) * 8 + j + 1] - v[floor(pos)::INT * 8 + j + 1]) * (pos - floor(pos)), 6) AS x FROM k, (SELECT unnest(range(0, 8)) AS j)""", "features")
def resampled_matrix(spark, sf_dir):
    rows = features(spark, sf_dir).select("vec_id", F.posexplode(seq.resample_columns(_matrix(), 5)).alias("i", "row"))
    return rows.select("vec_id", "i", F.posexplode("row").alias("j", "x")).withColumn("x", F.round("x", 6))


@query("""SELECT vec_id, i::INT AS i, j::INT AS j, CASE WHEN i < 8 AND j < 8 THEN v[i * 8 + j + 1] ELSE 0.0 END::DOUBLE AS x FROM features, (SELECT unnest(range(0, 10)) AS i), (SELECT unnest(range(0, 9)) AS j)""", "features")
def fitted_matrix(spark, sf_dir):
    rows = features(spark, sf_dir).select("vec_id", F.posexplode(seq.fitted(_matrix(), 10, 9)).alias("i", "row"))
    return rows.select("vec_id", "i", F.posexplode("row").alias("j", "x"))


@query("""SELECT vec_id, 57 AS width, v[58] AS flow_x, v[62] AS gore, CASE WHEN vec_id % 2 = 0 THEN v[63] ELSE 0.0 END AS self_harm, CASE WHEN vec_id % 2 = 0 THEN v[64] ELSE v[63] END AS nsfw FROM features""", "features")
def packed_vectors(spark, sf_dir):
    """The vectors as packed frames of 57 + 7 values, every other one in the shorter layout."""
    packed = F.when(F.col("vec_id") % 2 == 0, F.col("v")).otherwise(F.slice("v", 1, 63))
    embedding, aux = seq.unpacked(packed, 57)
    found = features(spark, sf_dir).select("vec_id", F.size(embedding).alias("width"), aux.alias("a"))
    return found.select("vec_id", "width", *(f"a.{c}" for c in ("flow_x", "gore", "self_harm", "nsfw")))


@query("""SELECT vec_id, i::INT AS i, j::INT AS j, CASE WHEN j < 2 THEN CASE WHEN i < 3 THEN v[i * 2 + j + 1] ELSE 0.0 END ELSE v[10 + i * 3 + j - 2 + 1] END::DOUBLE AS x FROM features, (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j)""", "features")
def aligned_blocks(spark, sf_dir):
    """Three rows of two columns beside five rows of three."""
    cut = lambda first, rows, width: F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda i: F.slice("v", i * width + first + 1, width))
    rows = features(spark, sf_dir).select("vec_id", F.posexplode(seq.aligned([(cut(0, 3, 2), 2), (cut(10, 5, 3), 3)])).alias("i", "row"))
    return rows.select("vec_id", "i", F.posexplode("row").alias("j", "x"))


@query("""WITH n AS (SELECT video_id, count(*) AS n FROM frames GROUP BY 1), s AS (SELECT video_id, k AS start, least(n, k + 5 + k % 7) AS stop FROM (SELECT video_id, n, unnest(range(0, n, 10)) AS k FROM n)),
l AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY stop - start DESC, start) AS r FROM s), t AS (SELECT * FROM l WHERE r <= 3),
f AS (SELECT video_id, r, p, start + least(p, (stop - start - 1) // greatest(1, (stop - start) // 4)) * greatest(1, (stop - start) // 4) AS frame FROM t, (SELECT unnest(range(0, 4)) AS p)),
m AS (SELECT video_id, max(r) AS r FROM t GROUP BY 1), e AS (SELECT f.video_id, frame AS last FROM f JOIN m ON m.video_id = f.video_id AND m.r = f.r WHERE p = 3)
SELECT e.video_id, i::INT AS i, coalesce(f.frame, last)::INT AS frame FROM e CROSS JOIN (SELECT unnest(range(0, 12)) AS i) g LEFT JOIN f ON f.video_id = e.video_id AND (f.r - 1) * 4 + f.p = g.i""", "frames")
def longest_shots(spark, sf_dir):
    n = frames(spark, sf_dir).groupBy("video_id").agg(F.count("*").cast("int").alias("n"))
    starts = F.sequence(F.lit(0), F.col("n") - 1, F.lit(10))
    shots = F.transform(starts, lambda k: F.struct(k.alias("start"), F.least(F.col("n"), k + 5 + k % 7).alias("end")))
    return n.select("video_id", F.posexplode(seq.shot_frames(shots, 3, 4)).alias("i", "frame"))


_RUN = """d AS (SELECT event_type, strftime(ts, '%d')::INT AS epoch, sum(round(value * 100)::BIGINT) // count(*) AS v FROM events GROUP BY 1, 2)"""


def _run(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy("event_type", F.dayofmonth("ts").alias("epoch")).agg(F.expr("sum(cast(round(value * 100) as bigint)) div count(*)").alias("v"))
    return days.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("epoch", F.col("v").cast("double").alias("value")))).alias("log"))


@query(f"""WITH RECURSIVE {_RUN}, o AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY epoch) AS i FROM d),
s AS (SELECT event_type, i, v AS best, epoch AS best_epoch, 0 AS wait, NULL::INT AS stopped FROM o WHERE i = 1
UNION ALL SELECT o.event_type, o.i, CASE WHEN stopped IS NULL THEN greatest(best, v) ELSE best END, CASE WHEN stopped IS NULL AND v > best THEN epoch ELSE best_epoch END, CASE WHEN v > best THEN 0 ELSE wait + 1 END,
  coalesce(stopped, CASE WHEN v <= best AND wait + 1 >= 3 THEN epoch END) FROM s JOIN o ON o.event_type = s.event_type AND o.i = s.i + 1)
SELECT event_type, best::DOUBLE AS best, best_epoch, stopped AS stopped_at FROM s QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY i DESC) = 1""")
def early_stopping(spark, sf_dir):
    found = _run(spark, sf_dir).select("event_type", seq.early_stop(F.col("log"), 3).alias("s"))
    return found.select("event_type", "s.best", "s.best_epoch", "s.stopped_at")


@query(f"""WITH {_RUN}, l AS (SELECT event_type, list(v ORDER BY epoch) AS v FROM d GROUP BY 1), c AS (SELECT event_type, v AS val, list_transform(v, lambda x: 50000 - x) AS train, (v[1] % 100) / 100.0::DOUBLE AS score FROM l)
SELECT event_type, CASE WHEN score < 0.4 AND train[1] - train[-1] < 0.5 THEN 'underfit' WHEN len(val) > 3 AND val[-1] > val[-3] AND train[-1] < train[-3] THEN 'overfit' WHEN score >= 0.7 THEN 'success' ELSE 'good_but_low' END AS diagnosis FROM c""")
def run_diagnosis(spark, sf_dir):
    val = F.transform("log", lambda x: x["value"])
    runs = _run(spark, sf_dir).select("event_type", val.alias("val"), F.transform(val, lambda v: 50000 - v).alias("train"), ((F.get(val, 0) % 100) / 100).alias("score"))
    return runs.select("event_type", seq.diagnosis(F.col("train"), F.col("val"), F.col("score"), 0.7).alias("diagnosis"))


@query("""SELECT video_id, frame_idx, round(x[least(len(x), frame_idx + 3)], 6) AS later FROM (SELECT f.video_id, f.frame_idx, s.x FROM frames f JOIN series s ON s.video_id = f.video_id)""", "series")
def jittered_frames(spark, sf_dir):
    found = series(spark, sf_dir).select("video_id", F.posexplode(seq.jittered(F.col("x"), 2)).alias("frame_idx", "later"))
    return found.withColumn("later", F.round("later", 6))


@query("SELECT video_id, frame_idx, round(1 / (1 + exp(-greatest(-30, least(30, (score - score2) * 200 / 1.5::DOUBLE)))), 9) AS p FROM frames", "frames")
def scaled_scores(spark, sf_dir):
    return frames(spark, sf_dir).select("video_id", "frame_idx", F.round(cal.scaled((F.col("score") - F.col("score2")) * 200, F.lit(1.5)), 9).alias("p"))


@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: CASE WHEN x > 0.2 THEN 1e6 WHEN x < -0.2 THEN 0 ELSE x END)), 3) AS total FROM features", "features")
def cleaned_vectors(spark, sf_dir):
    """Infinities and NaN put in for large and small values, and cleaned again."""
    broken = F.transform("v", lambda x: F.when(x > 0.2, float("inf")).when(x < -0.2, float("nan")).otherwise(x))
    return features(spark, sf_dir).select("vec_id", F.round(seq.total(seq.clean(broken)), 3).alias("total"))


@query("SELECT user_id, event_id, 7 AS cls, round(value / 500, 6) AS cx FROM events WHERE event_id % 4 <> 0")
def relabelled_boxes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat_ws(" ", (F.col("event_id") % 9).cast("string"), (F.col("value") / 500).cast("string"), F.lit("0.5 0.1 0.1"))
    boxes = e.filter("event_id % 4 <> 0").select("user_id", "event_id", F.explode(scans.relabelled(scans.box_labels(line), 7)).alias("b"))
    return boxes.select("user_id", "event_id", "b.cls", F.round("b.cx", 6).alias("cx"))


_EXPORT = "sample_id string, path string, violence int, source string, split string"


@query("SELECT split, sample_id, path, violence FROM manifest WHERE split <> 'val'", "manifest")
def export_by_split(spark, sf_dir):
    """Written as CSV by split and read back without one folder."""
    path = shared_dir(spark, "export")
    sinks.export_by_split(manifest(spark, sf_dir).select("sample_id", "path", "violence", "source", "split"), path, "split")
    return sinks.read_export(spark, path, _EXPORT).filter("split <> 'val'").select("split", "sample_id", "path", "violence")


@query("SELECT source, split, path, row_number() OVER (ORDER BY source, split, path) - 1 AS place FROM manifest", "manifest")
def export_sorted(spark, sf_dir):
    """Written in global order; the places are those of files by name and of lines in a file."""
    path = shared_dir(spark, "master")
    sinks.export_sorted(manifest(spark, sf_dir).select("source", "split", "path"), path, "source", "split", "path")
    lines = sinks.read_export(spark, path, "source string, split string, path string").select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    n = lines.groupBy("file").agg(F.count("*").alias("n"))  # a row per file
    before = n.alias("a").join(n.alias("b"), F.col("b.file") < F.col("a.file"), "left").groupBy("a.file").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1 + F.col("before")
    return lines.join(before, "file").select("source", "split", "path", place.alias("place"))


@query("SELECT '{\"n\":' || count(*) || ',\"positives\":' || sum(violence) || '}' AS value FROM manifest", "manifest")
def summary_json(spark, sf_dir):
    path = shared_dir(spark, "summary")
    sinks.write_summary(manifest(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("violence").alias("positives")), path)
    return spark.read.text(path)


@query("SELECT event_id, event_type FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 3 = 1")
def appended_log(spark, sf_dir):
    path = shared_dir(spark, "log")
    for k in range(2):
        sinks.append_log(table(spark, sf_dir, "events").filter(F.col("event_id") % 3 == k).select("event_id", "event_type"), path)
    return spark.read.schema("event_id long, event_type string").json(path)
