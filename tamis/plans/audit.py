"""Audits: duplicates, leakage across splits, label classes, path resolution, feature checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as op
from ..operators import curation as cur
from ..operators import metrics
from ..operators import search
from ..session import table
from ..sources.views import features, frames, manifest, media_items
from .common import query, stated

_RANK = "CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END"


@query(f"""SELECT doc_id, md5, split, rn > 1 AS is_duplicate, CASE WHEN rn > 1 THEN first_id END AS duplicate_of FROM (
  SELECT doc_id, md5, split, row_number() OVER w AS rn, first_value(doc_id) OVER w AS first_id FROM manifest WINDOW w AS (PARTITION BY md5 ORDER BY {_RANK}, doc_id))""", "manifest")
def dedup_keep_first(spark, sf_dir):
    return op.keep_first(manifest(spark, sf_dir), "md5", ["train", "val", "test"], "doc_id").select("doc_id", "md5", "split", "is_duplicate", "duplicate_of")


@stated("SELECT md5, count(*) AS n, min(doc_id) AS first_id FROM {manifest} GROUP BY md5 HAVING count(*) > 1")
def dup_groups(spark, sf_dir):
    return op.copies(manifest(spark, sf_dir), "md5", "doc_id")


@stated("""SELECT v.doc_id AS val_id, t.train_id, v.md5 FROM {manifest} v JOIN (SELECT md5, min(doc_id) AS train_id FROM {manifest} WHERE split = 'train' GROUP BY md5) t ON t.md5 = v.md5 WHERE v.split = 'val'""")
def leak_exact(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return op.leaked(m.filter("split = 'val'"), m.filter("split = 'train'"), "md5", "doc_id", ("val_id", "train_id"))


@stated("""SELECT a.split AS split1, b.split AS split2, count(*) AS n FROM (SELECT DISTINCT split, md5 FROM {manifest}) a JOIN (SELECT DISTINCT split, md5 FROM {manifest}) b ON a.md5 = b.md5 AND a.split < b.split GROUP BY 1, 2""")
def leak_summary(spark, sf_dir):
    return op.leak_summary(manifest(spark, sf_dir), "md5")


@stated(f"""SELECT a.md5, a.split AS split1, b.split AS split2, a.n AS n1, b.n AS n2, a.first_id AS id1, b.first_id AS id2 FROM (SELECT md5, split, count(*) AS n, min(doc_id) AS first_id FROM {{manifest}} GROUP BY 1, 2) a
  JOIN (SELECT md5, split, count(*) AS n, min(doc_id) AS first_id FROM {{manifest}} GROUP BY 1, 2) b ON a.md5 = b.md5 AND {_RANK.replace('split', 'a.split')} < {_RANK.replace('split', 'b.split')}""")
def leak_pairs(spark, sf_dir):
    return op.leak_classes(manifest(spark, sf_dir), "md5", "doc_id", ["train", "val", "test"])


_HASHES = """h AS (SELECT bit_string, min(vec_id) AS id, count(*) AS n FROM (SELECT vec_id, array_to_string(list_transform(v[1:24], lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bit_string FROM features) GROUP BY 1),
p AS (SELECT a.id AS id1, b.id AS id2, a.n AS n1, b.n AS n2, len(list_filter(range(1, 25), lambda i: substr(a.bit_string, i, 1) <> substr(b.bit_string, i, 1))) AS distance FROM h a JOIN h b ON a.id < b.id)"""


def _hashes(spark, sf_dir):
    """Signs of 24 dimensions, so that some vectors are near."""
    short = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 24).alias("v"))
    return op.sign_bits(short, "vec_id", "v")


@query(f"WITH {_HASHES} SELECT id1, id2, n1, n2, distance::INT AS distance FROM p WHERE distance <= 3", "features")
def leak_hamming(spark, sf_dir):
    return search.hamming_pairs(_hashes(spark, sf_dir), 3, 24)


@query(f"""WITH {_HASHES}, d AS (SELECT id1 AS id, id2 AS other, n2 AS rows FROM p WHERE distance <= 3 UNION ALL SELECT id2, id1, n1 FROM p WHERE distance <= 3)
SELECT h.id, h.n, count(other) AS links, coalesce(sum(rows), 0)::BIGINT AS linked_rows, least(h.id, coalesce(min(other), h.id)) AS "first" FROM h LEFT JOIN d ON d.id = h.id GROUP BY h.id, h.n""", "features")
def hamming_links(spark, sf_dir):
    return search.hamming_links(_hashes(spark, sf_dir), 3, 24)


@stated("""SELECT 'md5' AS kind, count(*) AS n FROM (SELECT md5 FROM {manifest} WHERE split = 'train' INTERSECT SELECT md5 FROM {manifest} WHERE split = 'test')
UNION ALL SELECT 'path', count(*) FROM (SELECT path FROM {manifest} WHERE split = 'train' INTERSECT SELECT path FROM {manifest} WHERE split = 'test')
UNION ALL SELECT 'group', count(*) FROM (SELECT group_id FROM {manifest} WHERE split = 'train' INTERSECT SELECT group_id FROM {manifest} WHERE split = 'test')""")
def overlap_matrix(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return op.overlaps(m.filter("split = 'train'"), m.filter("split = 'test'"), {"md5": "md5", "path": "path", "group": "group_id"})


@stated("SELECT v.doc_id, v.split FROM {manifest} v WHERE v.split = 'train' OR NOT EXISTS (SELECT 1 FROM {manifest} t WHERE t.split = 'train' AND t.md5 = v.md5)")
def leak_cleaned(spark, sf_dir):
    return op.without_leaks(manifest(spark, sf_dir).select("doc_id", "split", "md5"), "md5").select("doc_id", "split")


@query("""WITH c AS (SELECT label || ':' || vec_id % 20 AS label, split FROM features) SELECT DISTINCT label FROM c WHERE label NOT IN (SELECT label FROM c WHERE split = 'test')""", "features")
def missing_classes(spark, sf_dir):
    """Classes of a few vectors each, so that the test split lacks some."""
    label = F.concat_ws(":", F.col("label").cast("string"), (F.col("vec_id") % 20).cast("string"))
    return op.absent(features(spark, sf_dir).withColumn("label", label), "test", "label")


@stated("SELECT label, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, label) AS BIGINT) AS place FROM {embeddings} GROUP BY label")
def class_distribution(spark, sf_dir):
    return op.placed_counts(table(spark, sf_dir, "embeddings"), "label")


@stated("SELECT count(DISTINCT sample_id) AS samples, count(DISTINCT path) AS paths, count(DISTINCT group_id) AS groups, CAST(sum(violence) AS BIGINT) AS positives FROM {manifest}")
def manifest_stats(spark, sf_dir):
    distinct = [F.count_distinct(c).alias(n) for c, n in (("sample_id", "samples"), ("path", "paths"), ("group_id", "groups"))]
    return manifest(spark, sf_dir).agg(*distinct, F.sum("violence").cast("long").alias("positives"))


@stated("SELECT md5, count(DISTINCT path) AS paths FROM {manifest} GROUP BY md5 HAVING count(DISTINCT path) > 1")
def key_conflicts(spark, sf_dir):
    return op.conflicts(manifest(spark, sf_dir), "md5", "path").withColumnRenamed("values", "paths")


@stated("""SELECT doc_id, concat_ws(';', CASE WHEN length(text) < 60 THEN 'short' END, CASE WHEN length(text) > 5000 THEN 'long' END, CASE WHEN text LIKE '%$$$%' THEN 'symbols' END) AS flags FROM {documents}""")
def audit_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", op.text_flags(F.col("text")).alias("flags"))


@stated("""SELECT kind, count(*) AS n FROM (SELECT split_part(CASE WHEN length(text) < 300 THEN 'short:' || length(text) ELSE 'fine:' || lang END, ':', 1) AS kind FROM {documents}) GROUP BY kind""")
def issue_counts(spark, sf_dir):
    size = F.length("text")
    issue = F.when(size < 300, F.concat(F.lit("short:"), size.cast("string"))).otherwise(F.concat(F.lit("fine:"), "lang"))
    return table(spark, sf_dir, "documents").groupBy(op.kinds(issue).alias("kind")).agg(F.count("*").alias("n"))


@stated("""SELECT video_id, round(p90 - p10, 6) AS spread, n >= 10 AND p90 - p10 < 0.75 AND m > 0.3 AS stuck FROM (
  SELECT video_id, count(*) AS n, avg(score2) AS m, quantile_cont(score2, 0.9) AS p90, quantile_cont(score2, 0.1) AS p10 FROM {frames} GROUP BY video_id)""")
def stuck_scores(spark, sf_dir):
    return metrics.stuck(frames(spark, sf_dir), "score2", "video_id").withColumn("spread", F.round("spread", 6))


@stated("""SELECT split, round(c, 6) AS coverage, c >= 0.8 AS enabled FROM (SELECT split, avg(CASE WHEN l.doc_id IS NOT NULL OR e.vec_id IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS c
  FROM (SELECT doc_id, CASE WHEN doc_id < 500 THEN 'early' ELSE 'late' END AS split FROM {documents}) d LEFT JOIN {labels} l ON l.doc_id = d.doc_id LEFT JOIN {embeddings} e ON e.vec_id = d.doc_id GROUP BY 1)""")
def teacher_coverage(spark, sf_dir):
    """Of two parts of the table, of which one has fewer features; only enough coverage lets the teachers teach."""
    teachers = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "embeddings").select("vec_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") < 500, "early").otherwise("late").alias("split"))
    return op.coverage(rows, "doc_id", *teachers, by=["split"]).withColumn("coverage", F.round("coverage", 6))


@stated("""SELECT conv_id, msg_id, mime, size FROM {media_items} WHERE status IN ('active', 'pending') AND NOT coalesce(is_moderated, false) AND NOT coalesce(is_sensitive, false) AND (mime LIKE 'image/%' OR mime LIKE 'video/%')""")
def eligible_media(spark, sf_dir):
    return op.eligible(media_items(spark, sf_dir)).select("conv_id", "msg_id", "mime", "size")


@stated("SELECT thread, conv_id, msg_id FROM (SELECT conv_id // 5 AS thread, conv_id, msg_id, row_number() OVER (PARTITION BY conv_id // 5 ORDER BY conv_id DESC, msg_id DESC) AS rn FROM {media_items}) WHERE rn <= 10")
def latest_per_conversation(spark, sf_dir):
    """Five conversations as one thread, so that there are more than ten messages."""
    rows = media_items(spark, sf_dir).select(F.floor(F.col("conv_id") / 5).alias("thread"), "conv_id", "msg_id")
    return cur.first_of_each(rows, "thread", 10, F.desc("conv_id"), F.desc("msg_id")).select("thread", "conv_id", "msg_id")


@stated("SELECT o_orderkey, o_orderdate FROM {orders} ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def newest_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)


@stated("SELECT m.conv_id, m.msg_id FROM {media_items} m WHERE NOT EXISTS (SELECT 1 FROM {media_items} p WHERE p.conv_id = m.conv_id AND p.msg_id = m.msg_id AND p.is_moderated)")
def processed_excluded(spark, sf_dir):
    return op.without_processed(media_items(spark, sf_dir).select("conv_id", "msg_id", "is_moderated"), "conv_id", "msg_id").select("conv_id", "msg_id")


@stated("""SELECT conv_id, msg_id, size FROM (SELECT conv_id, msg_id, size, mime, lag(mime) OVER (PARTITION BY conv_id ORDER BY msg_id) AS last_mime FROM {media_items}) WHERE mime IS DISTINCT FROM last_mime""")
def changed_values(spark, sf_dir):
    return op.changes(media_items(spark, sf_dir), "conv_id", "msg_id", "mime").select("conv_id", "msg_id", "size")


@stated("""SELECT conv_id, max(level) AS level, arg_min(reason, msg_id * 1.0 - 1000 * level) AS reason, count(*) FILTER (WHERE level > 0) AS flagged FROM {media_items} GROUP BY conv_id""")
def post_levels(spark, sf_dir):
    return op.post_levels(media_items(spark, sf_dir), "conv_id", "msg_id")


@stated("SELECT conv_id, msg_id, CASE WHEN role = 'user' THEN least(level, 1) ELSE level END AS level, status FROM {media_items}")
def chat_levels(spark, sf_dir):
    clamped = F.when(F.col("role") == "user", F.least("level", F.lit(1))).otherwise(F.col("level"))
    return media_items(spark, sf_dir).select("conv_id", "msg_id", clamped.alias("level"), "status")


@stated("SELECT conv_id, msg_id, reason FROM {media_items} WHERE level = 2 AND role <> 'system' AND status <> 'deleted'")
def notifications(spark, sf_dir):
    told = media_items(spark, sf_dir).filter("level = 2 AND role <> 'system' AND status <> 'deleted'")
    return told.select("conv_id", "msg_id", "reason")
