"""Scans: what paths, split lists, box labels, threshold files and media files say, as rows.

Files are read with Spark's own readers (`binaryFile`, `text`), so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEDIA = ("jpg", "jpeg", "png", "bmp", "webp", "mp4", "avi", "mov", "mkv", "webm")


def media_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = MEDIA, content: bool = False) -> DataFrame:
    """Files below root with one of the extensions in either case: path, length, and md5 if asked for. No root, no rows."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, length long" + ", md5 string" * content)
    files = files.filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    return files.select("path", "length", *([F.md5("content").alias("md5")] if content else []))


def with_media_type(files: DataFrame) -> DataFrame:
    """Adds media_type by the suffix: image, video or null."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.withColumn("media_type", F.when(suffix.isin(*MEDIA[:5]), "image").when(suffix.isin(*MEDIA[5:]), "video"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def labelled_by_directory(files: DataFrame, labels: dict[str, int], split_alias: dict[str, str] | None = None) -> DataFrame:
    """Rows whose parent directory has a label; split from the directory above it, by its alias if it has one."""
    parts = F.split("path", "/")
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    alias = F.create_map(*(F.lit(x) for pair in (split_alias or {"val": "val"}).items() for x in pair))
    above = F.element_at(parts, -3)
    rows = files.withColumn("class_dir", F.lower(F.element_at(parts, -2))).withColumn("original_split", above)
    rows = rows.withColumn("label", F.element_at(known, F.col("class_dir"))).filter("label IS NOT NULL")
    return rows.withColumn("locked_split", F.coalesce(F.element_at(alias, F.col("original_split")), F.lit("")))


def with_split_list(files: DataFrame, names: DataFrame, split: str) -> DataFrame:
    """Locks the split of files whose stem a list names (names: lower-cased)."""
    listed = names.select(F.col("name").alias("_stem")).distinct().withColumn("_listed", F.lit(True))
    joined = files.withColumn("_stem", F.lower(stem(F.col("path")))).join(listed, "_stem", "left")
    return joined.withColumn("locked_split", F.when(F.col("_listed"), split).otherwise(F.col("locked_split"))).drop("_stem", "_listed")


def split_list(lines: DataFrame, pattern: str = r"[\w-]+(?=\.(?:mp4|avi|mkv))") -> DataFrame:
    """Names in a text list: every media name of a line, or the whole line if it has none; lower-cased, distinct."""
    line = F.trim("value")
    found = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
    names = F.when(F.size(found) > 0, found).otherwise(F.array(line))
    return lines.select(F.explode(names).alias("name")).filter("name <> ''").select(F.lower("name").alias("name")).distinct()


def box_labels(text: Column, least_fields: int = 5) -> Column:
    """Boxes of a label text, one per line 'class cx cy w h'; blank and short lines are skipped."""
    rows = F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.split(F.trim(x), r"\s+")), lambda p: (F.size(p) >= least_fields) & (p[0] != ""))
    number = lambda p, i: F.try_element_at(p, F.lit(i)).try_cast("double")
    return F.transform(rows, lambda p: F.struct(p[0].try_cast("int").alias("cls"), number(p, 2).alias("cx"), number(p, 3).alias("cy"), number(p, 4).alias("w"), number(p, 5).alias("h")))


def relabelled(boxes: Column, cls: int) -> Column:
    return F.transform(boxes, lambda b: b.withField("cls", F.lit(cls)))


def thresholds(json: Column) -> Column:
    """Thresholds of a JSON text: 'recommended_thresholds' with 'thresholds' over them, or, if it has neither, the whole;
    numbers only."""
    numbers = lambda c: F.map_filter(F.transform_values(F.from_json(c, "map<string,string>"), lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())
    inner = F.get_json_object(json, "$.thresholds")
    recommended = F.get_json_object(json, "$.recommended_thresholds")
    empty = F.create_map().cast("map<string,double>")
    given, advised = F.coalesce(numbers(inner), empty), F.coalesce(numbers(recommended), empty)
    merged = F.map_concat(F.map_filter(advised, lambda k, v: ~F.map_contains_key(given, k)), given)
    return F.when(inner.isNull() & recommended.isNull(), numbers(json)).otherwise(merged)


def first_tokens(lines: DataFrame) -> DataFrame:
    """First blank-separated token of each line, with forward slashes, lower-cased; distinct, without empty ones."""
    token = F.lower(F.translate(F.split(F.trim("value"), r"\s+")[0], "\\", "/"))
    return lines.select(token.alias("name")).filter("name <> ''").distinct()


def folders(path: Column) -> Column:
    """The components of a path, without the file's own name."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def in_classes(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a component of the path (the name included) is among the classes to include or, failing those, none is
    among those to exclude."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    if include:
        return F.arrays_overlap(parts, F.array(*map(F.lit, include)))
    return ~F.arrays_overlap(parts, F.array(*map(F.lit, exclude))) if exclude else F.lit(True)


def discovered(files: DataFrame, specs: DataFrame, split_alias: dict[str, str]) -> DataFrame:
    """Images below `root/<split folder>/images/` of each spec (source, root, target_class): source, target_class and the
    split that the folder's name stands for. Specs are a short table; files meet them by their root."""
    alias = F.create_map(*(F.lit(x) for pair in split_alias.items() for x in pair))
    root, split = (F.regexp_extract("path", r"^(.*)/([^/]+)/images/[^/]+$", k) for k in (1, 2))
    placed = files.withColumns({"root": root, "_split": split}).filter("root <> ''")
    return placed.join(specs, "root").withColumn("locked_split", F.coalesce(F.element_at(alias, F.col("_split")), F.lit(""))).drop("_split", "root")


def paired(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images whose label file exists: equal folder of the dataset and equal stem, `images` and `labels` apart."""
    key = lambda: F.regexp_replace(F.regexp_replace("path", r"/(images|labels)/", "/"), r"\.[^./]*$", "")
    return images.withColumn("_key", key()).join(labels.select(key().alias("_key")).distinct(), "_key", "left_semi").drop("_key")


def audit_rows(files: DataFrame, safe: list[str], risk: list[str], tag: str = "SYNTHETIC_ONLY") -> DataFrame:
    """Files of two classes by folder name, risk before safe, each with the tag as its note."""
    parts = folders(F.lower("path"))
    has = lambda names: F.arrays_overlap(parts, F.array(*map(F.lit, names)))
    label = F.when(has(risk), "risk").when(has(safe), "safe")
    return files.withColumn("label", label).filter("label IS NOT NULL").withColumn("notes", F.lit(tag))


def checked_paths(rows: DataFrame, files: DataFrame, taxonomy: dict[str, int]) -> DataFrame:
    """Rows (path, label as text) with a path that isn't blank and exists among `files`; a label that is no number is
    taken from the first folder of the path that the taxonomy knows, else the row goes."""
    named = rows.withColumn("path", F.trim("path")).filter("path <> ''").join(files.select("path").distinct(), "path", "left_semi")
    known = F.create_map(*(F.lit(x) for pair in taxonomy.items() for x in pair))
    guess = F.try_element_at(F.filter(F.transform(folders(F.lower("path")), lambda p: F.element_at(known, p)), lambda v: v.isNotNull()), F.lit(1))
    return named.withColumn("label", F.coalesce(F.col("label").try_cast("int"), guess)).filter("label IS NOT NULL")


def readable(rows: DataFrame, valid: Column, key: str) -> tuple[DataFrame, DataFrame]:
    """(readable rows, one row with skipped: the number of others, and example: the least of their keys)."""
    flagged = rows.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    report = flagged.agg(F.count_if(~F.col("_valid")).alias("skipped"), F.min(F.when(~F.col("_valid"), F.col(key))).alias("example"))
    return flagged.filter("_valid").drop("_valid"), report


def relative_path(path: Column, root: Column) -> Column:
    """The path below a root; the path itself if it isn't below it."""
    base = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path)


#: What counts as a number at the end of a name: any float, written as usual, with blanks around it.
FLOAT = r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*|\s*[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*"


def video_id(name: Column) -> Column:
    """A name without what follows its last underscore, if that is a number."""
    return F.when(F.rlike(name, F.lit(f"_({FLOAT})$")), F.regexp_replace(name, r"_[^_]*$", "")).otherwise(name)


def file_stem(path: Column) -> Column:
    """The file's name without its last extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


# Fixed values of the image ladders: class numbers of the two label sets.
BLOOD_SET = {"gun": 0, "mutilation": 1, "normal": 2, "violent": 3, "blood": 4, "knife": 5}
SYNTHETIC = ("syn_", "noose_", "setup_", "hardneg_")


def blood_category(classes: Column) -> Column:
    """positive_clean, positive_contaminated, negative_clean, negative_violent or skip, from an image's class numbers."""
    has = lambda name: F.array_contains(classes, BLOOD_SET[name])
    return (
        F.when(classes.isNull() | (F.size(classes) == 0) | has("mutilation"), "skip")
        .when(has("blood"), F.when(has("gun") | has("knife"), "positive_contaminated").otherwise("positive_clean"))
        .when(has("normal") & ~has("violent"), "negative_clean")
        .when(has("violent") & ~has("normal"), "negative_violent")
        .otherwise("skip")
    )


def membership(classes: Column) -> Column:
    """ligature, hard_negative, weapon, instrument or other, from an image's class numbers; the first that fits."""
    has = lambda *ids: F.arrays_overlap(classes, F.array(*map(F.lit, ids)))
    return (
        F.when(has(2, 3), "ligature")
        .when((F.size(F.array_distinct(classes)) == 1) & has(5), "hard_negative")
        .when(has(0, 1) & ~has(2, 3, 4, 5), "weapon")
        .when(has(4) & ~has(0, 1, 2, 3), "instrument")
        .otherwise("other")
    )


def is_synthetic(name: Column) -> Column:
    return F.startswith(name, F.lit(SYNTHETIC[0])) | F.startswith(name, F.lit(SYNTHETIC[1])) | F.startswith(name, F.lit(SYNTHETIC[2])) | F.startswith(name, F.lit(SYNTHETIC[3]))


def label_or_inferred(rows: DataFrame, labels: DataFrame, key: str, inferred: Column) -> DataFrame:
    """Adds `label`: from the label map (key, label) if it has one, else inferred."""
    known = labels.groupBy(key).agg(F.min("label").alias("_label"))
    return rows.join(known, key, "left").withColumn("label", F.coalesce("_label", inferred)).drop("_label")


def stem_group(path: Column) -> Column:
    """The file's name without the number at its end."""
    return F.regexp_replace(F.regexp_extract(path, "([^/]*)$", 1), "_?[0-9]+$", "")


def normal_path(path: Column) -> Column:
    """Trimmed, with forward and single slashes only, and without any `./` at the start."""
    slashes = F.regexp_replace(F.translate(F.btrim(path, F.lit(" \t\n\r\f\v")), "\\", "/"), "/+", "/")
    return F.regexp_replace(slashes, r"^(\./)+", "")


def folder_label(path: Column, level: int, labels: dict[str, str], default: str = "unknown") -> Column:
    """The label of the path's component at a level, from 1."""
    known = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.split_part(path, F.lit("/"), F.lit(level))), F.lit(default))
