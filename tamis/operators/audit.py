"""Duplicates, near-duplicates, path resolution and feature checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as seq
from ..sources.scans import normal_path


def keep_first(rows: DataFrame, key: str, split_order: list[str], tie: str) -> DataFrame:
    """Marks all but the first row of each key, in order of split and tie, with the first one's id.

    The first row comes from an aggregate that combines before the shuffle, so a key with very many rows costs no
    more than any other.
    """
    rank = F.array_position(F.array(*map(F.lit, split_order)), F.col("split"))
    first = rows.groupBy(key).agg(F.min(F.struct(rank.alias("r"), F.col(tie).alias("id")))["id"].alias("_first"))
    joined = rows.join(first, key)
    return joined.withColumn("is_duplicate", F.col(tie) != F.col("_first")).withColumn("duplicate_of", F.when(F.col("is_duplicate"), F.col("_first"))).drop("_first")


def sign_bits(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """A 64-bit hash of each vector's signs, as a signed long."""
    bits = F.array_join(F.transform(vector, lambda x: F.when(x > 0, "1").otherwise("0")), "")
    return rows.select(F.col(key).alias("id"), F.conv(bits, 2, -10).cast("long").alias("bits"))


def resolved(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds file and how to rows (path, given): the file that was given unless it is blank or a written null, else that of
    the full path, else that of the path's last component if one path only ends in it, else none.

    `files` (path, file) must not have two files for one path; paths are compared in their normal form.
    """
    name = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    known = files.select(normal_path(F.col("path")).alias("_full"), "file").groupBy("_full").agg(F.count_distinct("file").alias("_n"), F.min("file").alias("_by_full"))
    bad = known.filter("_n > 1").agg(F.count("*").alias("n"), F.min("_full").alias("example")).first()
    if bad.n:
        raise ValueError(f"{bad.n} paths have several files, {bad.example} among them")
    known = known.drop("_n")
    unique = known.groupBy(name(F.col("_full")).alias("_name")).agg(F.count("*").alias("_n"), F.min("_by_full").alias("_by_name")).filter("_n = 1").drop("_n")
    keyed = rows.withColumn("_full", normal_path(F.col("path"))).withColumn("_name", name(F.col("_full")))
    met = keyed.join(known, "_full", "left").join(unique, "_name", "left")
    given = F.btrim("given")
    given = F.when(~F.lower(given).isin("", "nan", "none"), given)
    how = F.when(given.isNotNull(), "given").when(F.col("_by_full").isNotNull(), "full").when(F.col("_by_name").isNotNull(), "name").otherwise("none")
    return met.select(*rows.columns, F.coalesce(given, "_by_full", "_by_name").alias("file"), how.alias("how"))


def removals(leaked_images: DataFrame, files: DataFrame) -> DataFrame:
    """Paths to be removed: each leaked image, and its label file if there is one among `files`: the first folder named
    images becomes labels, the suffix txt."""
    label = F.regexp_replace(F.regexp_replace("path", r"^((?:(?!images/)[^/]+/)*)images/", "$1labels/"), r"\.[^./]*$", ".txt")
    labels = leaked_images.filter(F.rlike(F.col("path"), F.lit("(^|/)images/"))).select(label.alias("path"))
    return leaked_images.select("path").unionByName(labels.join(files.select("path"), "path", "left_semi")).distinct()


def set_sanity(rows: DataFrame, item: str, vector: str, columns: dict[str, int], least_std: float = 0.01) -> DataFrame:
    """What a whole set of items (frames with a vector each) looks like, a row per named column of the vectors: how many
    items there are, the widths that occur, how many items hold a NaN and how many an infinity, and the mean over the items
    of the column's standard deviation (population; an item with a NaN there makes it NaN), with ok or low."""
    v = F.col(vector)
    any_of = lambda test: F.bool_or(F.exists(v, test))
    at = {name: F.get(v, F.lit(i)) for name, i in columns.items()}
    items = rows.groupBy(item).agg(
        F.collect_set(F.size(v)).alias("w"),  # as many as there are widths
        any_of(F.isnan).alias("nan"),
        any_of(lambda x: F.abs(x) == float("inf")).alias("inf"),
        *(F.stddev_pop(x).alias(f"std_{name}") for name, x in at.items()),
    )
    found = items.agg(
        F.count("*").alias("items"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("w")))), ",").alias("widths"),
        F.count_if("nan").alias("nan_items"),
        F.count_if("inf").alias("inf_items"),
        *(F.avg(f"std_{name}").alias(name) for name in columns),
    )
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("column"), F.col(name).alias("mean_std")) for name in columns)))
    out = found.select("items", "widths", "nan_items", "inf_items", each.alias("e")).select("items", "widths", "nan_items", "inf_items", "e.*")
    return out.withColumn("status", F.when(~F.isnan("mean_std") & (F.col("mean_std") > least_std), "ok").otherwise("low"))


def array_faults(x: Column, kind: Column, dimensions: Column, expected_kind: str = "float32", expected_dimensions: int = 2) -> Column:
    """Why a loaded array (rows of numbers) is no feature: the first of unreadable, empty, dimensions, kind, not_finite; null
    if it is one."""
    wrong = F.exists(x, lambda row: F.exists(row, lambda v: F.isnan(v) | (F.abs(v) == float("inf"))))
    return (
        F.when(x.isNull(), "unreadable")
        .when(F.size(F.flatten(x)) == 0, "empty")
        .when(dimensions != expected_dimensions, "dimensions")
        .when(kind != expected_kind, "kind")
        .when(F.coalesce(wrong, F.lit(False)), "not_finite")
    )


def feature_issues(rows: DataFrame, key: str, vector: str, width: int, most: float) -> DataFrame:
    """Width, norm and issues of each vector."""
    v = F.col("v")
    n = F.size(v)
    variance = seq.dot(v, v) / n - F.pow(seq.total(v) / n, 2)
    wrong = F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    issues = F.concat_ws(
        ";",
        F.when(n != width, "width"),
        F.when(wrong, "not_finite"),
        F.when(F.array_max(F.transform(v, lambda x: F.abs(x))) > most, "range"),
        F.when(F.sqrt(F.greatest(F.lit(0.0), variance)) < 0.05, "flat"),
    )
    return rows.select(key, F.col(vector).cast("array<double>").alias("v")).select(key, n.alias("width"), F.round(seq.norm(v), 6).alias("norm"), issues.alias("issues"))


def copies(rows: DataFrame, key: str, tie: str) -> DataFrame:
    """Keys that occur more than once: how often, and the first row's id."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.min(tie).alias("first_id")).filter("n > 1")


def leaked(rows: DataFrame, source: DataFrame, key: str, tie: str, names: tuple[str, str]) -> DataFrame:
    """Rows whose key is in `source` too, with the first id there: one row per row, however often the key occurs."""
    first = source.groupBy(key).agg(F.min(tie).alias(names[1]))
    return rows.select(F.col(tie).alias(names[0]), key).join(first, key)


def leak_classes(rows: DataFrame, key: str, tie: str, split_order: list[str]) -> DataFrame:
    """For each key in two splits: both splits in their order, how many rows each has and its first id. Keys first become
    one row per split, so a key with very many rows is never paired row by row."""
    place = F.array_position(F.array(*map(F.lit, split_order)), F.col("split"))
    place = F.when(place > 0, place).otherwise(len(split_order))
    found = rows.groupBy(key, "split").agg(F.count("*").alias("n"), F.min(tie).alias("id"))
    entry = F.struct(place.alias("place"), "split", "n", "id")
    grouped = found.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("s")).filter(F.size("s") > 1)
    a = grouped.select(key, "s", F.explode("s").alias("a")).select(key, "a", F.explode("s").alias("b")).filter("a.place < b.place")
    return a.select(key, *(F.col(f"{x}.{c}").alias(f"{c}{i}") for i, x in ((1, "a"), (2, "b")) for c in ("split", "n", "id")))


def leak_summary(rows: DataFrame, key: str) -> DataFrame:
    """How many keys each two splits share, the splits in the order of their names."""
    splits = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("s")).filter(F.size("s") > 1)
    a = splits.select("s", F.explode("s").alias("split1")).select("split1", F.explode("s").alias("split2")).filter("split1 < split2")
    return a.groupBy("split1", "split2").agg(F.count("*").alias("n"))


def overlaps(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Distinct values that two tables share, for each kind of key (kind -> column); both are read once for all kinds.
    A null is a value like others."""
    entries = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in keys.items()))
    values = lambda rows, side: rows.select(F.explode(entries).alias("e"), F.lit(side).alias("side")).select("e.*", "side")
    sides = values(left, 1).unionByName(values(right, 2)).groupBy("kind", "value").agg(F.bit_or("side").alias("sides"))
    found = sides.groupBy("kind").agg(F.count_if(F.col("sides") == 3).alias("n"))
    kinds = left.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, keys))).alias("kind"))
    return kinds.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def without_leaks(rows: DataFrame, key: str, split: str = "train") -> DataFrame:
    """Rows of the split, and the others' rows whose key it lacks."""
    own = F.col("split") == split
    taken = rows.filter(own).select(key)
    return rows.filter(own).unionByName(rows.filter(~own).join(taken, key, "left_anti"))


def absent(rows: DataFrame, split: str, label: str) -> DataFrame:
    """Labels of the table that no row of the split has."""
    found = rows.groupBy(label).agg(F.bool_or(F.col("split") == split).alias("_has"))
    return found.filter("NOT coalesce(_has, false)").select(label)


def placed_counts(rows: DataFrame, label: str) -> DataFrame:
    """Rows per label and the label's place, the most frequent first; the window sees a row per label."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), label)).cast("long"))


def conflicts(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value, and with how many."""
    return rows.groupBy(key).agg(F.count_distinct(value).alias("values")).filter("values > 1")


def text_flags(text: Column, short: int = 60, long: int = 5000, symbols: str = "$$$") -> Column:
    return F.concat_ws(";", F.when(F.length(text) < short, "short"), F.when(F.length(text) > long, "long"), F.when(F.contains(text, F.lit(symbols)), "symbols"))


def kinds(issue: Column) -> Column:
    """What an issue says before its first colon."""
    return F.split_part(issue, F.lit(":"), F.lit(1))


#: A teacher whose features cover less of the rows has no say.
LEAST_COVERAGE = 0.8


def coverage(rows: DataFrame, key: str, *teachers: DataFrame, by: list[str] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """Share of the rows (per group) that one teacher at least knows, and whether that is enough; each teacher's first
    column is its key."""
    known, found = rows, F.lit(False)
    for i, t in enumerate(teachers):
        mark = f"_known_{i}"
        known = known.join(t.select(F.col(t.columns[0]).alias(key)).distinct().withColumn(mark, F.lit(True)), key, "left")
        found = found | F.coalesce(mark, F.lit(False))
    shares = known.groupBy(*(by or [])).agg(F.avg(F.when(found, 1.0).otherwise(0.0)).alias("coverage"))
    return shares.withColumn("enabled", F.coalesce(F.col("coverage") >= least, F.lit(False)))


def eligible(media: DataFrame) -> DataFrame:
    """Images and videos of live items that are neither sensitive nor moderated yet."""
    kind = F.startswith("mime", F.lit("image/")) | F.startswith("mime", F.lit("video/"))
    return media.filter(F.col("status").isin("active", "pending") & ~F.coalesce("is_moderated", F.lit(False)) & ~F.coalesce("is_sensitive", F.lit(False)) & kind)


def without_processed(media: DataFrame, *key: str) -> DataFrame:
    """Media of which no row is moderated."""
    return media.join(media.filter("is_moderated").select(*key), [*key], "left_anti")


def changes(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before it in their group, the first ones included."""
    last = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_same", F.col(value).eqNullSafe(last)).filter("NOT _same").drop("_same")


def post_levels(media: DataFrame, document: str, order: str) -> DataFrame:
    """Per document: the highest level, the reason of its first medium of that level, media above level 0."""
    reason = F.max_by("reason", F.struct("level", -F.col(order)))
    return media.groupBy(document).agg(F.max("level").alias("level"), reason.alias("reason"), F.count_if(F.col("level") > 0).alias("flagged"))
