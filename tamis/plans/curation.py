"""Dataset curation: identifiers, splits, caps, holdouts, exports and summaries over the manifest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.hashing import hash_split, output_name, sample_order
from ..operators import curation as op
from ..operators.digest import digests
from ..session import table
from ..sources import scans
from ..sources.views import BUCKET, manifest
from .common import query, stated

_B = BUCKET.format("doc_id::VARCHAR")


@query(f"SELECT doc_id, CASE WHEN {_B} < 70 THEN 'train' WHEN {_B} < 85 THEN 'val' ELSE 'test' END AS split FROM documents")
def hash_split_ratio(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", hash_split(F.col("doc_id").cast("string"), 0.7, 0.15).alias("split"))


@stated("SELECT doc_id, split FROM {manifest}")
def hash_split_assign(spark, sf_dir):
    return manifest(spark, sf_dir).select("doc_id", "split")


@stated("SELECT doc_id, sample_id, path, group_id, violence, nsfw, 'v' || violence || '_n' || nsfw AS label_signature, 'text' AS media_type FROM {manifest}")
def manifest_records(spark, sf_dir):
    signature = F.concat(F.lit("v"), "violence", F.lit("_n"), "nsfw")
    return manifest(spark, sf_dir).select("doc_id", "sample_id", "path", "group_id", "violence", "nsfw", signature.alias("label_signature"), F.lit("text").alias("media_type"))


@stated("SELECT split, count(*) AS n, CAST(sum(violence) AS BIGINT) AS n_violence, CAST(sum(nsfw) AS BIGINT) AS n_nsfw FROM {manifest} GROUP BY split")
def split_counts(spark, sf_dir):
    return op.split_counts(manifest(spark, sf_dir), "violence", "nsfw")


@stated("SELECT source, split, count(*) AS n FROM {manifest} GROUP BY ROLLUP (source, split)")
def split_rollup(spark, sf_dir):
    return manifest(spark, sf_dir).rollup("source", "split").agg(F.count("*").alias("n"))


@stated("SELECT path, violence AS label, sample_id, source, group_id FROM {manifest} WHERE split = 'train'")
def label_export(spark, sf_dir):
    return manifest(spark, sf_dir).filter("split = 'train'").select("path", F.col("violence").alias("label"), "sample_id", "source", "group_id")


@stated("""SELECT source, count(*) AS n, count(*) FILTER (WHERE split = 'train') AS train, count(*) FILTER (WHERE split = 'val') AS val,
  count(*) FILTER (WHERE split = 'test') AS test, array_to_string(list_sort(list(DISTINCT lang)), ';') AS langs FROM {manifest} GROUP BY source""")
def summary_by_source(spark, sf_dir):
    return op.source_summary(manifest(spark, sf_dir))


@stated("""SELECT branch, split, count(*) AS n FROM (
  SELECT 'violence' AS branch, split FROM {manifest} WHERE violence = 1 UNION ALL SELECT 'nsfw', split FROM {manifest} WHERE nsfw = 1
  UNION ALL SELECT 'multitask', split FROM {manifest}) GROUP BY branch, split""")
def summary_by_branch(spark, sf_dir):
    return op.branches(manifest(spark, sf_dir), "violence", "nsfw")


@stated("SELECT split, round(avg(CAST(violence AS DOUBLE)), 9) AS ratio FROM {manifest} GROUP BY split")
def positive_ratio(spark, sf_dir):
    return manifest(spark, sf_dir).groupBy("split").agg(F.round(F.avg(F.col("violence").cast("double")), 9).alias("ratio"))


@stated("""SELECT 'a' AS scan, doc_id, lang FROM {manifest} WHERE lang = 'en' UNION ALL SELECT 'b', doc_id, lang FROM {manifest} WHERE lang IN ('fr', 'de')""")
def union_of_scans(spark, sf_dir):
    m = manifest(spark, sf_dir).select("doc_id", "lang")
    return op.scans_united({"a": m.filter("lang = 'en'"), "b": m.filter("lang IN ('fr', 'de')")})


@stated("""SELECT DISTINCT source FROM {manifest} WHERE source NOT IN (SELECT source FROM {manifest} WHERE violence = 1 AND source IS NOT NULL)""")
def unmatched_sources(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return op.unmatched(m, m.filter("violence = 1"), "source")


@stated("SELECT lower(source) AS name FROM {manifest} WHERE split = 'val' UNION SELECT lower(source) FROM {manifest} WHERE split = 'test'")
def split_lists_union(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return m.filter("split IN ('val', 'test')").select(F.lower("source").alias("name")).distinct()


@query("""SELECT doc_id, source, violence, nsfw, locked_split FROM (SELECT *, row_number() OVER (PARTITION BY source, violence, nsfw ORDER BY CASE WHEN locked_split = '' THEN 0 ELSE 1 END, draw, doc_id) AS rn FROM manifest)
WHERE locked_split <> '' OR rn <= 20""", "manifest")
def cap_per_signature(spark, sf_dir):
    return op.capped(manifest(spark, sf_dir), ["source", "violence", "nsfw"], 20, "draw", "doc_id").select("doc_id", "source", "violence", "nsfw", "locked_split")


GROUP_SPLIT_SQL = """WITH g AS (SELECT source, group_id, arg_min(violence * 2 + nsfw, path) AS sig, md5('7:' || group_id) AS draw FROM manifest WHERE locked_split = '' GROUP BY source, group_id),
r AS (SELECT *, row_number() OVER (PARTITION BY source, sig ORDER BY draw, group_id) AS rn, count(*) OVER (PARTITION BY source, sig) AS n FROM g),
s AS (SELECT source, group_id, CASE WHEN n < 2 THEN 'train' WHEN rn <= ceil(n * 0.15::DOUBLE) THEN 'test' WHEN rn <= ceil(n * 0.15::DOUBLE) + ceil((n - ceil(n * 0.15::DOUBLE)) * (0.15::DOUBLE / 0.85::DOUBLE)) THEN 'val' ELSE 'train' END AS split FROM r)
SELECT doc_id, m.source, CASE WHEN locked_split <> '' THEN locked_split ELSE s.split END AS split FROM manifest m LEFT JOIN s ON s.source = m.source AND s.group_id = m.group_id AND m.locked_split = ''"""


@query(GROUP_SPLIT_SQL, "manifest")
def group_split(spark, sf_dir):
    return op.group_split(manifest(spark, sf_dir), 0.15, 0.15, seed=7).select("doc_id", "source", "split")


@query("""WITH b AS (SELECT *, CASE WHEN violence = 1 THEN 'positive_hard' WHEN nsfw = 1 THEN 'normal_hard' ELSE '' END AS bucket FROM manifest),
g AS (SELECT bucket, source, group_id, min(CASE split WHEN 'test' THEN 0 WHEN 'val' THEN 1 ELSE 2 END) AS p FROM b WHERE bucket <> '' GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY p, source, group_id) AS rn FROM g)
SELECT doc_id, CASE WHEN rn <= 15 THEN 'challenge' ELSE split END AS split, split AS split_before FROM b LEFT JOIN r ON r.bucket = b.bucket AND r.source = b.source AND r.group_id = b.group_id""", "manifest")
def challenge_holdout(spark, sf_dir):
    m = manifest(spark, sf_dir).withColumn("bucket", F.when(F.col("violence") == 1, "positive_hard").when(F.col("nsfw") == 1, "normal_hard").otherwise(""))
    return op.holdout(m, 15).select("doc_id", "split", "split_before")


@query("""WITH r AS (SELECT doc_id, violence, count(*) OVER w AS n, row_number() OVER (w ORDER BY draw, doc_id) AS rn FROM manifest WINDOW w AS (PARTITION BY source, violence)),
k AS (SELECT *, CASE WHEN n < 100 THEN greatest(10, n // 5) ELSE greatest(30, floor(0.10::DOUBLE * n)) END AS test, CASE WHEN n < 100 THEN greatest(10, n // 5) ELSE greatest(30, floor(0.15::DOUBLE * n)) END AS val FROM r)
SELECT doc_id, CASE WHEN rn <= test THEN 'test' WHEN rn <= test + val THEN 'val' ELSE 'train' END AS split FROM k WHERE violence = 1 OR rn <= test + val + 40""", "manifest")
def class_floor_split(spark, sf_dir):
    """The cap stands in for the reference's 1500, which no class of the fixtures reaches."""
    cap = F.when(F.col("violence") == 0, 40)
    return op.floor_split(manifest(spark, sf_dir), ["source", "violence"], "draw", "doc_id", cap).select("doc_id", "split")


@query("""WITH o AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id) AS rn, md5('43:' || doc_id) AS again FROM manifest WHERE locked_split = ''),
t AS (SELECT *, rn <= CASE WHEN n >= 3 THEN ceil(n * 0.15::DOUBLE) ELSE 0 END AS test FROM o),
v AS (SELECT *, count(*) OVER (PARTITION BY source) AS m, row_number() OVER (PARTITION BY source ORDER BY again, doc_id) AS rv FROM t WHERE NOT test)
SELECT doc_id, CASE WHEN rv <= CASE WHEN m >= 3 THEN ceil(m * least(0.1::DOUBLE / greatest(1 - 0.15::DOUBLE, 1e-6), 0.5)) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM v
UNION ALL SELECT doc_id, 'test' FROM t WHERE test UNION ALL SELECT doc_id, locked_split FROM manifest WHERE locked_split <> ''""", "manifest")
def locked_split_by_source(spark, sf_dir):
    m = manifest(spark, sf_dir).withColumn("again", sample_order(43, F.col("doc_id")))
    return op.locked_aware_split(m, "source", 0.15, 0.1, "draw", "again", "doc_id").select("doc_id", "split")


@query("""SELECT doc_id, violence, split FROM (SELECT *, row_number() OVER (PARTITION BY violence, split ORDER BY draw, doc_id) AS rn FROM manifest)
WHERE violence = 1 OR rn <= CASE split WHEN 'train' THEN 100 WHEN 'val' THEN 12 ELSE 18 END""", "manifest")
def negative_quotas(spark, sf_dir):
    m = manifest(spark, sf_dir)
    return op.with_quotas(m, F.col("violence") == 1, {"train": 100, "val": 12, "test": 18}, "draw", "doc_id").select("doc_id", "violence", "split")


@query("""SELECT doc_id, violence FROM (SELECT *, row_number() OVER (PARTITION BY violence ORDER BY draw, doc_id) AS rn, sum(violence) OVER () AS p FROM manifest)
WHERE violence = 1 OR rn <= greatest(6 * p, 300)""", "manifest")
def bounded_pool(spark, sf_dir):
    return op.pool_bounded(manifest(spark, sf_dir), F.col("violence") == 1, "draw", "doc_id").select("doc_id", "violence")


@query("SELECT doc_id, doc_id || '_' || substr(md5(path), 1, 8) AS name FROM manifest", "manifest")
def output_names(spark, sf_dir):
    return manifest(spark, sf_dir).select("doc_id", output_name(F.col("path")).alias("name"))


@query("""SELECT doc_id, source, round(least(4.0::DOUBLE, greatest(0.25::DOUBLE, w / avg(w) OVER ())), 6) AS weight FROM (
  SELECT doc_id, source, 1 / sqrt(count(*) OVER (PARTITION BY source, violence, nsfw)) AS w FROM manifest)""", "manifest")
def sampler_weights(spark, sf_dir):
    return op.inverse_sqrt_weights(manifest(spark, sf_dir), ["source", "violence", "nsfw"], 0.25, 4.0).select("doc_id", "source", F.round("weight", 6).alias("weight"))


@stated("""SELECT round(CASE WHEN p = 0 THEN 1.0 ELSE least(20.0, greatest(1.0, CAST(n - p AS DOUBLE) / p)) END, 6) AS weight FROM (SELECT sum(violence) AS p, count(*) AS n FROM {manifest})""")
def pos_weight(spark, sf_dir):
    return op.positive_weight(manifest(spark, sf_dir), "violence").select(F.round("weight", 6).alias("weight"))


@stated("""SELECT round(least(6.0, greatest(1.5, sqrt(r))), 6) AS soft, round(least(12.0, greatest(2.0, r)), 6) AS hard FROM (SELECT CAST(count(*) - sum(violence) AS DOUBLE) / greatest(1, sum(violence)) AS r FROM {manifest})""")
def imbalance_weights(spark, sf_dir):
    return op.imbalance_weights(manifest(spark, sf_dir), "violence").select(F.round("soft", 6).alias("soft"), F.round("hard", 6).alias("hard"))


@query("SELECT split, count(*) AS n, (sum(('0x' || substr(md5(path), 1, 12))::BIGINT::HUGEINT) % 1152921504606846976)::BIGINT AS hash, round(count(*) / (sum(count(*)) OVER ()), 6) AS share FROM manifest GROUP BY split", "manifest")
def split_fingerprint(spark, sf_dir):
    return op.fingerprints(manifest(spark, sf_dir), "split", "path")


@query("""WITH k AS (SELECT split, md5(doc_id::VARCHAR) AS h, count(*) AS c FROM manifest GROUP BY 1, 2),
l AS (SELECT split, substr(h, 1, 4) AS leaf, sum(c)::BIGINT AS n, md5(string_agg(h || ':' || c, '' ORDER BY h)) AS d FROM k GROUP BY 1, 2),
o AS (SELECT split, substr(leaf, 1, 2) AS node, sum(n)::BIGINT AS n, md5(string_agg(leaf || ':' || d, '' ORDER BY leaf)) AS d FROM l GROUP BY 1, 2),
r AS (SELECT split, sum(n)::BIGINT AS n, md5(string_agg(node || ':' || d, '' ORDER BY node)) AS digest FROM o GROUP BY 1)
SELECT split, n, digest, violence_ratio FROM r JOIN (SELECT split, round(avg(violence), 4) AS violence_ratio FROM manifest GROUP BY 1) USING (split)""", "manifest")
def split_lock(spark, sf_dir):
    """What a lock file says of each split: a digest of its stems, its size and its share of positives."""
    m = manifest(spark, sf_dir)
    stems = m.select("split", scans.file_stem(F.col("path")).alias("stem"))
    ratio = m.groupBy("split").agg(F.round(F.avg("violence"), 4).alias("violence_ratio"))
    return digests(stems, "split", "stem").join(ratio, "split")


@query("""SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('5:' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 5""")
def sample_per_source(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    by = Window.partitionBy("source").orderBy(sample_order(5, F.col("doc_id")), "doc_id")
    return docs.withColumn("rn", F.row_number().over(by)).filter("rn <= 5").select("source", "doc_id")


@stated("SELECT doc_id, k AS copy FROM {labels}, (SELECT unnest(range(0, 5)) AS k) WHERE toxic = 1")
def replicate_rows(spark, sf_dir):
    return op.replicated(table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id"), 5)


@stated("SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '_?[0-9]+$', '') AS stem_group, split_part(url, '/', 3) AS host FROM {pages}")
def stem_groups(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", scans.stem_group(url).alias("stem_group"), F.split_part(url, F.lit("/"), F.lit(3)).alias("host"))


@stated(r"SELECT page_id, regexp_replace(regexp_replace(replace(trim(['', './', './/./', ' .\\', '/', '../', ' '][1 + page_id % 7] || url, ' '), chr(92), '/'), '/+', '/', 'g'), '^(\./)+', '') AS path FROM {pages}")
def path_norm(spark, sf_dir):
    prefix = F.element_at(F.array(*map(F.lit, ["", "./", ".//./", " .\\\\", "/", "../", " "])), (F.col("page_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", scans.normal_path(F.concat(prefix, F.col("url"))).alias("path"))


@stated("SELECT coalesce(folder, '(total)') AS folder, count(*) AS n FROM (SELECT split_part(path, '/', 1) AS folder FROM {manifest}) GROUP BY ROLLUP (folder)")
def files_per_folder(spark, sf_dir):
    """And of all folders."""
    return op.files_per_folder(manifest(spark, sf_dir), "path")


@stated("SELECT doc_id, CASE WHEN split_part(path, '/', 2) = 'en' THEN 'normal' WHEN split_part(path, '/', 2) IN ('fr', 'de') THEN 'fight' ELSE 'unknown' END AS label FROM {manifest}")
def label_from_path(spark, sf_dir):
    return manifest(spark, sf_dir).select("doc_id", scans.folder_label(F.col("path"), 2, {"en": "normal", "fr": "fight", "de": "fight"}).alias("label"))


@stated("""SELECT n >= 10000 AS enough, p >= 1000 AS enough_positives, CAST(n - p AS DOUBLE) / greatest(1, p) < 2 AS balanced FROM (SELECT count(*) AS n, sum(violence) AS p FROM {manifest})""")
def corpus_minimums(spark, sf_dir):
    return op.corpus_minimums(manifest(spark, sf_dir), "violence")


@stated("SELECT source, split, path, CAST(row_number() OVER (PARTITION BY source ORDER BY split, path) AS BIGINT) AS place FROM {manifest}")
def master_order(spark, sf_dir):
    return op.ranked(manifest(spark, sf_dir).select("source", "split", "path"), ["source"], "split", "path", name="place")
