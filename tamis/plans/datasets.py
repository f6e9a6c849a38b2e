"""Scans of dataset layouts: file listings become manifest records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import datasets as scan
from ..sources.listings import fold_lines, listed_lines, media_listing
from .common import query

_STEM = r"regexp_extract(path, '([^/]+?)(\.[^./]*)?$', 1)"
_NAME = "regexp_extract(path, '([^/]+)$', 1)"
_SUFFIX = r"lower(regexp_extract(path, '\.([^./]+)$', 1))"
_VIDEOS, _IMAGES = f"{_SUFFIX} IN ('mp4', 'avi', 'mov', 'mkv', 'webm')", f"{_SUFFIX} IN ('jpg', 'jpeg', 'png', 'bmp', 'webp') AND valid"
_DIGIT = "('0x' || substr(md5(doc_id::VARCHAR), 7, 1))::INT"


def _record(source, media, found, group=f"lower({_STEM})", violence="0", self_harm="0", nsfw="0", proxy="0", bucket="''", confidence="'high'", notes="''"):
    """Records of a relation `found` (path, original_split, locked_split, ...)."""
    video = int(media == "video")
    return f"""SELECT '{source}_' || substr(sha1(path), 1, 12) AS sample_id, '{source}' AS source, path AS relative_path, '{media}' AS media_type, original_split, locked_split, '{source}:' || {group} AS group_id,
  ({violence})::INT AS violence, ({self_harm})::INT AS self_harm, ({nsfw})::INT AS nsfw, ({proxy})::INT AS proxy_label, {video} AS include_proxy, {video} AS include_temporal, {1 - video} AS include_spatial, 1 AS include_multitask,
  {bucket} AS challenge_bucket, {confidence} AS mapping_confidence, {notes} AS notes, 'v' || ({violence})::INT || '_s' || ({self_harm})::INT || '_n' || ({nsfw})::INT || '_p' || ({proxy})::INT AS label_signature FROM ({found})"""


_FIGHTS = f"""SELECT path, p[1] AS original_split, CASE p[1] WHEN 'val' THEN 'test' ELSE '' END AS locked_split, CASE p[2] WHEN 'Fight' THEN 1 ELSE 0 END AS v
  FROM (SELECT path, string_split(substr(path, position('RWF-2000/' IN path) + 9), '/') AS p FROM media_listing WHERE path LIKE '%RWF-2000/%' AND {_VIDEOS}) WHERE p[1] IN ('train', 'val') AND p[2] IN ('Fight', 'NonFight')"""


@query(_record("rwf2000", "video", _FIGHTS, rf"regexp_replace(lower({_STEM}), '_\d+$', '')", "v", proxy="v", notes="'fight clip'"), "media_listing")
def scan_fight_clips(spark, sf_dir):
    return scan.fight_clips(media_listing(spark, sf_dir))


_CRIMES = f"""crime AS (SELECT doc_id, path, lower({_STEM}) AS stem, string_split(substr(path, position('(UCF)/' IN path) + 6), '/') AS p FROM media_listing WHERE path LIKE '%(UCF)/%' AND {_VIDEOS}),
listed AS (SELECT stem, {_DIGIT} % 3 = 0 AS in_test, {_DIGIT} % 2 = 0 AS in_train, path, p FROM crime)"""


@query(f"""WITH {_CRIMES} {_record("ucf_crimes", "video", "SELECT path, p[2] AS class, CASE WHEN in_test AND NOT in_train THEN 'test' ELSE 'train' END AS original_split, CASE WHEN in_test THEN 'test' ELSE '' END AS locked_split FROM listed WHERE p[1] = 'Anomaly-Videos'",
    violence="lower(class) IN ('fighting', 'explosion')", proxy="1", bucket="'positive_hard'", confidence="'medium'", notes="'class=' || class")}
UNION ALL {_record("ucf_crimes", "video", "SELECT path, p[1] AS folder, CASE p[1] WHEN 'Testing_Normal_Videos_Anomaly' THEN 'test' ELSE 'train' END AS original_split, CASE p[1] WHEN 'Testing_Normal_Videos_Anomaly' THEN 'test' ELSE '' END AS locked_split FROM listed WHERE p[1] LIKE '%Normal%'", notes="'folder=' || folder")}""", "media_listing")
def scan_surveillance(spark, sf_dir):
    return scan.surveillance(media_listing(spark, sf_dir), listed_lines(spark, sf_dir, False), listed_lines(spark, sf_dir, True))


_ACTIONS = f"""SELECT path, p[1] AS class, p[-2] AS parent, CASE WHEN listed THEN 'test' ELSE 'train' END AS original_split, CASE WHEN listed THEN 'test' ELSE '' END AS locked_split FROM (
  SELECT path, string_split(substr(path, 9), '/') AS p, {_DIGIT} % 3 = 0 AND path NOT LIKE '%/more/%' AS listed FROM media_listing WHERE path LIKE 'UCF-101/%' AND {_VIDEOS})"""


@query(_record("ucf101", "video", _ACTIONS, f"lower(parent) || '/' || lower({_STEM})", bucket="CASE WHEN lower(class) IN ('punch', 'fencing') THEN 'normal_hard' ELSE '' END", notes="'class=' || class"), "media_listing")
def scan_actions(spark, sf_dir):
    return scan.actions(media_listing(spark, sf_dir), fold_lines(spark, sf_dir))


_NSFW = f"""SELECT path, class, '' AS original_split, '' AS locked_split FROM (SELECT path, split_part(substr(path, position('_v1/' IN path) + 4), '/', 1) AS class FROM media_listing WHERE path LIKE '%nsfw_dataset_v1/%' AND {_IMAGES})
  WHERE lower(class) IN ('porn', 'sexy', 'hentai', 'neutral', 'drawings')"""


@query(_record("nsfw_dataset_v1", "image", _NSFW, nsfw="lower(class) IN ('porn', 'sexy', 'hentai')", notes="'class=' || class"), "media_listing")
def scan_nsfw_images(spark, sf_dir):
    return scan.nsfw_images(media_listing(spark, sf_dir))


_ADULT = f"""SELECT path, p[2] AS class, CASE lower(p[1]) WHEN 'val1' THEN 'val' WHEN 'valid' THEN 'val' WHEN 'test1' THEN 'test' WHEN 'test' THEN 'test' ELSE 'train' END AS original_split,
  CASE lower(p[1]) WHEN 'val1' THEN 'val' WHEN 'valid' THEN 'val' WHEN 'test1' THEN 'test' WHEN 'test' THEN 'test' ELSE '' END AS locked_split
  FROM (SELECT path, string_split(substr(path, position('P2datasetFull/' IN path) + 14), '/') AS p FROM media_listing WHERE path LIKE '%P2datasetFull/%' AND {_IMAGES}) WHERE p[2] IN ('1', '2')"""


@query(_record("adult_content_binary", "image", _ADULT, nsfw="class = '2'", bucket="CASE class WHEN '2' THEN 'positive_hard' ELSE '' END", notes="'folder map'"), "media_listing")
def scan_adult_images(spark, sf_dir):
    return scan.adult_images(media_listing(spark, sf_dir))


_BOXED = f"""SELECT path, CASE s WHEN 'valid' THEN 'val' ELSE s END AS original_split, CASE s WHEN 'train' THEN '' WHEN 'valid' THEN 'val' ELSE s END AS locked_split
  FROM (SELECT path, lower(p[1]) AS s, p FROM (SELECT path, string_split(substr(path, position('boxes/' IN path) + 6), '/') AS p FROM media_listing WHERE path LIKE 'in/boxes/%' AND {_IMAGES})) WHERE s IN ('train', 'valid', 'val', 'test') AND p[2] = 'images'"""


@query(_record("boxes", "image", _BOXED, self_harm="1", proxy="1", bucket="'positive_hard'", notes="'boxes'"), "media_listing")
def scan_boxed_images(spark, sf_dir):
    return scan.boxed_images(media_listing(spark, sf_dir), "boxes", "boxes", "boxes", 1, True)


_WOUNDS = f"""SELECT path, p[1] AS class, '' AS original_split, '' AS locked_split FROM (SELECT path, string_split(substr(path, position('copy/' IN path) + 5), '/') AS p FROM media_listing WHERE path LIKE '%Wound_dataset copy/%' AND {_IMAGES}) WHERE len(p) > 1"""


@query(_record("wound_medical_negative", "image", _WOUNDS, bucket="'normal_hard'", notes="'class=' || class"), "media_listing")
def scan_wounds(spark, sf_dir):
    return scan.wounds(media_listing(spark, sf_dir))


@query(f"""SELECT path, CASE WHEN parent IN ('porn', 'hentai', 'sexy') THEN 1 ELSE 0 END AS label FROM (SELECT path, lower(string_split(path, '/')[-2]) AS parent FROM media_listing WHERE {_SUFFIX} IN ('jpg', 'jpeg', 'png', 'bmp', 'webp'))
WHERE parent IN ('porn', 'hentai', 'sexy', 'neutral', 'drawings')""", "media_listing")
def image_lists(spark, sf_dir):
    names = {v: tuple(k for k, x in scan.NSFW_CLASSES.items() if x == v) for v in (0, 1)}
    return scan.two_lists(media_listing(spark, sf_dir), names[1], names[0]).select("path", "label")


_PLAIN = "replace(replace(lower({0}), '-', ''), '_', '')"


@query(f"""WITH d AS (SELECT DISTINCT rtrim(regexp_extract(path, '^(.*)/[^/]*$', 1), '/') AS folder FROM media_listing),
a AS (SELECT DISTINCT array_to_string(string_split(folder, '/')[1:i], '/') AS folder FROM (SELECT folder, unnest(range(1, 1 + len(string_split(folder, '/')))) AS i FROM d)),
n AS (SELECT folder, {_PLAIN.format("string_split(folder, '/')[-1]")} AS name, {_PLAIN.format("coalesce(string_split(folder, '/')[-2], '')")} AS parent FROM a)
SELECT folder, CASE WHEN name IN ('violent', 'violence', 'gore', 'fight', 'brawl', 'assault', 'attack') THEN 'violent' ELSE 'non_violent' END AS kind FROM n
WHERE name IN ('nonviolent', 'nonviolence', 'sfw', 'safe', 'normal', 'benign', 'peaceful') OR name IN ('violent', 'violence', 'gore', 'fight', 'brawl', 'assault', 'attack') AND parent NOT LIKE '%non%'""", "media_listing")
def folders_by_name(spark, sf_dir):
    """Every folder of the listing that one of two sets of names stands for."""
    return scan.folders_by_name(media_listing(spark, sf_dir).select(F.col("path")))
