"""Scans of known dataset layouts: listings of files (path below the input folder, valid) become manifest records.

A scan is a projection and a filter over the listing; only split lists are joined, by name. Files may lie at any depth
below a class folder. Class names are compared in lower case unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_id
from .scans import file_stem

# Suffixes, folder names, classes and split names of the layouts.
IMAGES = ("jpg", "jpeg", "png", "bmp", "webp")
VIDEOS = ("mp4", "avi", "mov", "mkv", "webm")
FIGHTS, FIGHT_CLASSES, FIGHT_SPLITS = "RWF-2000", {"Fight": 1, "NonFight": 0}, {"train": "", "val": "test"}
CRIMES = "Real-world Anomaly Detection in Surveillance Videos (UCF)"
CRIME_FOLDER = "Anomaly-Videos"
VIOLENT_CRIMES = ("abuse", "arrest", "arson", "assault", "burglary", "explosion", "fighting", "roadaccidents", "robbery", "shooting")
NORMAL_FOLDERS = {"Training-Normal-Videos": ("train", ""), "Testing_Normal_Videos_Anomaly": ("test", "test"), "Normal_Videos_for_Event_Recognition": ("train", "")}
ACTIONS = "UCF-101"
HARD_ACTIONS = ("boxingpunchingbag", "boxingspeedbag", "fencing", "hammering", "nunchucks", "punch", "sumowrestling", "cuttinginkitchen", "shavingbeard")
NSFW, NSFW_CLASSES = "nsfw_dataset_v1", {"porn": 1, "sexy": 1, "hentai": 1, "neutral": 0, "drawings": 0}
ADULT, ADULT_CLASSES = "P2datasetFull", {"1": 0, "2": 1}
ADULT_SPLITS = {"train": ("train", ""), "val1": ("val", "val"), "valid": ("val", "val"), "test1": ("test", "test"), "test": ("test", "test")}
BOX_SPLITS = {"train": ("train", ""), "valid": ("val", "val"), "val": ("val", "val"), "test": ("test", "test")}
WOUNDS = "Wound_dataset copy"

FLAGS = ("violence", "self_harm", "nsfw", "proxy_label", "include_proxy", "include_temporal", "include_spatial", "include_multitask")


def lookup(values: dict, key: Column, default: object = None) -> Column:
    """The value of a key in a short map; the default (null) for others."""
    known = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    return F.coalesce(F.try_element_at(known, key), F.lit(default))


def below(files: DataFrame, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """Files with one of the suffixes (in any case) somewhere below a folder of that name; `parts` are the folders between
    the two."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    marked = F.concat(F.lit("/"), F.col("path"))
    at = F.position(F.lit(f"/{folder}/"), marked)
    inner = F.substring(marked, at + len(folder) + 2, F.length(marked))
    found = files.filter(suffix.isin(*suffixes) & (at > 0))
    parts = F.split(inner, "/")
    return found.withColumn("parts", F.slice(parts, 1, F.size(parts) - 1))


def readable(files: DataFrame) -> DataFrame:
    """Images that could be opened."""
    return files.filter(F.coalesce("valid", F.lit(False)))


def records(files: DataFrame, source: str, media: str, group: Column | None = None, confidence: str = "high", notes: Column | str = "", bucket: Column | str = "", **flags: Column | int) -> DataFrame:
    """Manifest records of scanned files (path, original_split, locked_split): identifiers, flags (0 unless given), what
    the record is used for, and its signature."""
    video = media == "video"
    use = {"include_proxy": video, "include_temporal": video, "include_spatial": not video, "include_multitask": True}
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    values = {name: as_column(flags.get(name, int(use.get(name, 0)))).cast("int").alias(name) for name in FLAGS}
    signature = F.concat(*(F.concat(F.lit(f"{'_' if i else ''}{letter}"), values[name].cast("string")) for i, (letter, name) in enumerate(zip("vsnp", FLAGS))))
    key = F.lower(file_stem(F.col("path"))) if group is None else group
    return files.select(
        stable_id(F.lit(source), F.col("path")).alias("sample_id"),
        F.lit(source).alias("source"),
        F.col("path").alias("relative_path"),
        F.lit(media).alias("media_type"),
        "original_split",
        "locked_split",
        F.concat(F.lit(f"{source}:"), key).alias("group_id"),
        *values.values(),
        as_column(bucket).alias("challenge_bucket"),
        F.lit(confidence).alias("mapping_confidence"),
        as_column(notes).alias("notes"),
        signature.alias("label_signature"),
    )


def with_split(files: DataFrame, splits: dict[str, tuple[str, str]], name: Column, default: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Adds original_split and locked_split by a folder's name."""
    first, locked = ({k: v[i] for k, v in splits.items()} for i in (0, 1))
    return files.withColumns({"original_split": lookup(first, name, default[0]), "locked_split": lookup(locked, name, default[1])})


def listed_videos(lines: DataFrame) -> DataFrame:
    """Names in a list of videos: the stems of all video files that a line names, or of the whole line if it names none."""
    line = F.btrim("value", F.lit(" \t\r\n\f\v"))
    found = F.regexp_extract_all("value", F.lit(rf"(?i)([^\s,;]+\.(?:{'|'.join(VIDEOS)}))"), F.lit(1))
    names = F.when(F.size(found) > 0, found).otherwise(F.array(line))
    return lines.select(F.explode(names).alias("name")).select(F.lower(file_stem(F.col("name"))).alias("name")).filter("name <> ''").distinct()


def among(files: DataFrame, names: DataFrame, key: Column, mark: str) -> DataFrame:
    """Adds a flag: whether the key is among the names (distinct)."""
    known = names.select(F.col("name").alias("_name")).withColumn(mark, F.lit(True))
    met = files.withColumn("_key", key).join(known, F.col("_key") == F.col("_name"), "left").drop("_key", "_name")
    return met.withColumn(mark, F.coalesce(mark, F.lit(False)))


def fight_clips(files: DataFrame) -> DataFrame:
    """Split folder, then class folder, both spelt as they are; the folder val is the locked test set."""
    found = below(files, FIGHTS, VIDEOS).withColumns({"original_split": F.get("parts", F.lit(0)), "violence": lookup(FIGHT_CLASSES, F.get("parts", F.lit(1)))})
    found = found.withColumn("locked_split", lookup(FIGHT_SPLITS, F.col("original_split"))).filter("locked_split IS NOT NULL AND violence IS NOT NULL")
    group = F.regexp_replace(F.lower(file_stem(F.col("path"))), "_[0-9]+$", "")
    return records(found, "rwf2000", "video", group, notes="fight clip", violence=F.col("violence"), proxy_label=F.col("violence"))


def surveillance(files: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """Clips of crimes by class folder, their split from lists of names, and three folders of normal clips."""
    found = below(files, CRIMES, VIDEOS)
    first, second = F.get("parts", F.lit(0)), F.get("parts", F.lit(1))
    crimes = found.filter((first == CRIME_FOLDER) & (F.size("parts") > 1))
    stem = F.lower(file_stem(F.col("path")))
    crimes = among(among(crimes, listed_videos(test), stem, "in_test"), listed_videos(train), stem, "in_train")
    split = F.when(F.col("in_test") & ~F.col("in_train"), "test").otherwise("train")
    crimes = crimes.withColumns({"locked_split": F.when(F.col("in_test"), "test").otherwise(""), "original_split": split, "class": second})
    violent = F.lower("class").isin(*VIOLENT_CRIMES).cast("int")
    marked = records(crimes, "ucf_crimes", "video", confidence="medium", notes=F.concat(F.lit("class="), "class"), bucket="positive_hard", violence=violent, proxy_label=1)
    normal = with_split(found, NORMAL_FOLDERS, first).filter("original_split IS NOT NULL")
    return marked.unionByName(records(normal, "ucf_crimes", "video", notes=F.concat(F.lit("folder="), first)))


def actions(files: DataFrame, test: DataFrame) -> DataFrame:
    """Harmless actions by class folder; the fold's test list, lines of class/file, locks the split. Classes that look
    violent are hard negatives."""
    found = below(files, ACTIONS, VIDEOS).withColumn("class", F.get("parts", F.lit(0))).filter("class IS NOT NULL")
    key = F.lower(F.concat("class", F.lit("/"), F.regexp_extract("path", "([^/]+)$", 1)))
    listed = test.select(F.lower(F.translate(F.split(F.btrim("value", F.lit(" \t\r\n\f\v")), r"\s+")[0], "\\", "/")).alias("name")).distinct()
    found = among(found, listed, key, "in_test")
    found = found.withColumns({"locked_split": F.when(F.col("in_test"), "test").otherwise(""), "original_split": F.when(F.col("in_test"), "test").otherwise("train")})
    group = F.concat(F.lower(F.element_at("parts", -1)), F.lit("/"), F.lower(file_stem(F.col("path"))))
    hard = F.when(F.lower("class").isin(*HARD_ACTIONS), "normal_hard").otherwise("")
    return records(found, "ucf101", "video", group, notes=F.concat(F.lit("class="), "class"), bucket=hard)


def nsfw_images(files: DataFrame) -> DataFrame:
    """Class folders of two sets; others are left out."""
    found = readable(below(files, NSFW, IMAGES)).withColumn("class", F.get("parts", F.lit(0)))
    found = found.withColumns({"nsfw": lookup(NSFW_CLASSES, F.lower("class")), "original_split": F.lit(""), "locked_split": F.lit("")}).filter("nsfw IS NOT NULL")
    return records(found, "nsfw_dataset_v1", "image", notes=F.concat(F.lit("class="), "class"), nsfw=F.col("nsfw"))


def adult_images(files: DataFrame, classes: dict[str, int] | None = None) -> DataFrame:
    """Split folder by its alias (train for any other), then a class folder that the map names."""
    found = readable(below(files, ADULT, IMAGES)).withColumn("nsfw", lookup(ADULT_CLASSES if classes is None else classes, F.get("parts", F.lit(1))))
    found = with_split(found, ADULT_SPLITS, F.lower(F.get("parts", F.lit(0))), ("train", "")).filter("nsfw IS NOT NULL")
    return records(found, "adult_content_binary", "image", notes="folder map", bucket=F.when(F.col("nsfw") == 1, "positive_hard").otherwise(""), nsfw=F.col("nsfw"))


def boxed_images(files: DataFrame, folder: str, source: str, notes: str, self_harm: int, positive: bool) -> DataFrame:
    """Images below `<split>/images` of a dataset with box labels; other split folders are left out."""
    found = readable(below(files, folder, IMAGES)).filter(F.get("parts", F.lit(1)) == "images")
    found = with_split(found, BOX_SPLITS, F.lower(F.get("parts", F.lit(0)))).filter("original_split IS NOT NULL")
    return records(found, source, "image", notes=notes, bucket="positive_hard" if positive else "normal_hard", self_harm=self_harm, proxy_label=int(positive))


def wounds(files: DataFrame) -> DataFrame:
    """Medical images, hard negatives by class folder."""
    found = readable(below(files, WOUNDS, IMAGES)).withColumn("class", F.get("parts", F.lit(0))).filter("class IS NOT NULL")
    found = found.withColumns({"original_split": F.lit(""), "locked_split": F.lit("")})
    return records(found, "wound_medical_negative", "image", notes=F.concat(F.lit("class="), "class"), bucket="normal_hard")


def two_lists(files: DataFrame, positive: tuple[str, ...], negative: tuple[str, ...], suffixes: tuple[str, ...] = IMAGES) -> DataFrame:
    """Files by their parent folder: label 1 or 0; others are left out."""
    suffix, parent = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), F.lower(F.regexp_extract("path", "([^/]+)/[^/]+$", 1))
    label = F.when(parent.isin(*positive), 1).when(parent.isin(*negative), 0)
    return files.filter(suffix.isin(*suffixes)).withColumn("label", label).filter("label IS NOT NULL")


# What folders of videos are called, without dashes and underscores.
CALM_NAMES = ("nonviolent", "nonviolence", "sfw", "safe", "normal", "benign", "peaceful")
VIOLENT_NAMES = ("violent", "violence", "gore", "fight", "brawl", "assault", "attack")


def folders_by_name(files: DataFrame) -> DataFrame:
    """folder and kind for every folder above a file whose name is in one of the two sets; one of violence must not lie
    right below a folder with `non` in its name. Names are lower-cased, dashes and underscores taken out."""
    parts = F.filter(F.split(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "/"), lambda p: p != "")
    above = files.select(parts.alias("p")).filter(F.size("p") > 0).distinct()
    each = above.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.slice("p", F.lit(1), i))).alias("p")).distinct()
    plain = lambda c: F.regexp_replace(F.lower(c), "[-_]", "")
    name, parent = plain(F.element_at("p", -1)), plain(F.coalesce(F.try_element_at("p", F.lit(-2)), F.lit("")))
    kind = F.when(name.isin(*CALM_NAMES), "non_violent").when(name.isin(*VIOLENT_NAMES) & ~F.contains(parent, F.lit("non")), "violent")
    return each.select(F.array_join("p", "/").alias("folder"), kind.alias("kind")).filter("kind IS NOT NULL")
