"""A listing of media files for the scans, drawn from the documents table: a path in one of the layouts per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

VIDEO, IMAGE = [".avi", ".MP4", ".mkv", ".txt"], [".jpg", ".PNG", ".jpeg", ".gif"]
#: Components of a path per layout: a text, or what a digit of the document's hash picks. None stands for the id.
LAYOUTS: list[list] = [
    ["in/a/RWF-2000/", (1, ["train", "val", "test"]), "/", (2, ["Fight", "NonFight", "Other"]), "/", (3, ["", "deep/"]), "Clip", None, (4, ["_1", "_22", "_x"]), (5, VIDEO)],
    ["in/Real-world Anomaly Detection in Surveillance Videos (UCF)/", (1, ["Anomaly-Videos/Fighting", "Anomaly-Videos/Stealing", "Anomaly-Videos/explosion", "Training-Normal-Videos", "Testing_Normal_Videos_Anomaly", "Normal_Videos_for_Event_Recognition", "Other"]), "/Scene", None, (5, VIDEO)],
    ["UCF-101/", (1, ["Punch", "Biking", "fencing", "Punch/more"]), "/v_", None, (5, VIDEO)],
    ["in/nsfw_dataset_v1/", (1, ["porn", "Neutral", "other", "drawings", "Sexy"]), "/", None, (5, IMAGE)],
    ["in/p/P2datasetFull/", (1, ["train", "val1", "Test1", "odd"]), "/", (2, ["1", "2", "3"]), "/", None, (5, IMAGE)],
    ["in/boxes/", (1, ["train", "Valid", "test", "extra"]), "/", (2, ["images", "labels", "images/more"]), "/", None, (5, IMAGE)],
    ["in/Wound_dataset copy/", (1, ["Burns/", "Cuts/", ""]), None, (5, IMAGE)],
    ["in/misc/", (1, ["violence", "non-violence/fight", "Peace_ful", "nonviolent", "set/gore"]), "/", None, (5, VIDEO + IMAGE)],
]


def _digit(i: int) -> Column:
    return F.conv(F.substring("hash", i, 1), 16, 10).cast("int")


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, length and hash. Hash and path are exploded, so that what follows works on columns and not each on a
    copy of their expressions."""
    key = F.col("doc_id").cast("string")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("length"), F.explode(F.array(F.md5(key))).alias("hash"))

    def part(p) -> Column:
        if p is None:
            return key
        return F.lit(p) if isinstance(p, str) else F.element_at(F.array(*map(F.lit, p[1])), _digit(p[0]) % len(p[1]) + 1)

    path = F.coalesce(*(F.when(F.col("doc_id") % len(LAYOUTS) == i, F.concat(*map(part, layout))) for i, layout in enumerate(LAYOUTS)))
    return docs.select("doc_id", "length", "hash", F.explode(F.array(path)).alias("path"))


def media_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, length and valid: whether the file could be opened."""
    return _hashed(spark, sf_dir).select("doc_id", "path", "length", (_digit(6) > 1).alias("valid"))


def _sql(p) -> str:
    if p is None:
        return "doc_id"
    return f"'{p}'" if isinstance(p, str) else f"({p[1]})[1 + ('0x' || substr(md5(doc_id::VARCHAR), {p[0]}, 1))::INT % {len(p[1])}]"


MEDIA_LISTING = f"""media_listing AS (SELECT doc_id, CASE doc_id % {len(LAYOUTS)} {" ".join(f"WHEN {i} THEN {' || '.join(map(_sql, layout))}" for i, layout in enumerate(LAYOUTS))} END AS path,
  length(text) AS length, ('0x' || substr(md5(doc_id::VARCHAR), 6, 1))::INT > 1 AS valid FROM documents)"""


def listed_lines(spark: SparkSession, sf_dir: str, test: bool) -> DataFrame:
    """Lines of the split lists: names of clips in several forms, those of some documents."""
    draw, name = _digit(7), F.regexp_extract("path", "([^/]+)$", 1)
    some = _hashed(spark, sf_dir).filter(draw % (3 if test else 2) == 0)
    line = F.when(draw < 6, F.concat(F.lit("  Folder/"), name, F.lit(" 12 34"))).when(draw < 11, F.concat(name, F.lit(";x/"), F.upper(name))).otherwise(F.concat(F.lit(" "), F.regexp_replace(name, r"\.[^.]*$", "")))
    return some.select(line.alias("value"))


def fold_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a fold's test list: class/file and a number."""
    some = _hashed(spark, sf_dir).filter(F.contains(F.col("path"), F.lit("UCF-101/")) & (_digit(7) % 3 == 0))
    return some.select(F.concat(F.translate(F.regexp_extract("path", "UCF-101/(.*)$", 1), "/", "\\"), F.lit(" 1")).alias("value"))
