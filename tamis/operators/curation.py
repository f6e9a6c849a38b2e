"""Capping, splitting, holding out and weighting rows of a manifest; all deterministic and keyed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import sample_order


#: Characters of a draw (a hex hash) that deal rows of one group to buckets: 4096 of them.
DRAW_CHARS = 3


def ranked(rows: DataFrame, by: list[str], draw: str, *ties: str, name: str = "rank", size: str | None = None, bucket: Column | None = None) -> DataFrame:
    """Adds the row's place (from 1) within its group, in order of `draw`, a hex hash, and of `ties`; and the group's size.

    A group is dealt to buckets by the draw's first characters. Bucket counts, 4096 a group at most, say how many rows
    come before a bucket; only rows of one bucket are sorted together, so a group of any size is split. For a draw that
    is no hash, `bucket` gives buckets that are in its order.
    """
    dealt = rows.withColumn("_bucket", F.substring(draw, 1, DRAW_CHARS) if bucket is None else bucket)
    counts = dealt.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)), F.col("_bucket").alias("_b"), before.alias("_before"), F.sum("_n").over(group).alias("_size"))
    same = F.col("_bucket").eqNullSafe(F.col("_b"))
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{i}"))
    met = dealt.join(counts, same)
    place = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(draw, *ties)) + F.col("_before")
    out = met.withColumn(name, place)
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_bucket", "_b", "_before", "_size", *(f"_by_{i}" for i in range(len(by))))


def capped(rows: DataFrame, by: list[str], most: int, draw: str, key: str) -> DataFrame:
    """Up to `most` open rows of each group, in order of their draw; locked rows always stay. No cap if most <= 0."""
    if most <= 0:
        return rows
    is_open = F.col("locked_split") == ""
    kept = ranked(rows.filter(is_open), by, draw, key, name="_rank").filter(F.col("_rank") <= most).drop("_rank")
    return kept.unionByName(rows.filter(~is_open))


def group_split(rows: DataFrame, test: float, val: float, seed: int) -> DataFrame:
    """Splits whole groups of open rows within source and signature; sizes are rounded up, test is drawn first.

    A stratum of one group isn't split; locked rows keep their split.
    """
    signature = F.min_by(F.col("violence") * 2 + F.col("nsfw"), "path")
    groups = rows.filter("locked_split = ''").groupBy("source", "group_id").agg(signature.alias("sig")).withColumn("draw", sample_order(seed, F.col("group_id")))
    groups = ranked(groups, ["source", "sig"], "draw", "group_id", name="rank", size="n")
    n_test = F.ceil(F.col("n") * F.lit(test))
    n_val = F.ceil((F.col("n") - n_test) * F.lit(val / (1 - test)))
    split = F.when(F.col("n") < 2, "train").when(F.col("rank") <= n_test, "test").when(F.col("rank") <= n_test + n_val, "val").otherwise("train")
    drawn = groups.select("source", "group_id", split.alias("_drawn"))
    joined = rows.join(drawn, ["source", "group_id"], "left")
    return joined.withColumn("split", F.when(F.col("locked_split") != "", F.col("locked_split")).otherwise(F.col("_drawn"))).drop("_drawn")


def holdout(rows: DataFrame, groups: int) -> DataFrame:
    """Moves the first groups of each bucket to 'challenge', groups with test rows first, then val, then train."""
    order = F.when(F.col("split") == "test", 0).when(F.col("split") == "val", 1).otherwise(2)
    ranked = rows.filter("bucket <> ''").groupBy("bucket", "source", "group_id").agg(F.min(order).alias("p"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("p", "source", "group_id"))).filter(F.col("rank") <= groups)
    chosen = ranked.select("bucket", "source", "group_id", F.lit(True).alias("_held"))
    joined = rows.withColumnRenamed("split", "split_before").join(chosen, ["bucket", "source", "group_id"], "left")
    return joined.withColumn("split", F.when(F.col("_held"), "challenge").otherwise(F.col("split_before"))).drop("_held")


# Fixed values of the class-floor split: shares and floors of large classes, share and floor of classes under SMALL.
TEST_SHARE, VAL_SHARE, LEAST_ROWS, SMALL, SMALL_PART, SMALL_LEAST = 0.10, 0.15, 30, 100, 5, 10


def floor_split(rows: DataFrame, by: list[str], draw: str, key: str, train_cap: Column | None = None) -> DataFrame:
    """Test and val rows per class by share, with floors; the rest is train, of which `train_cap` rows at most stay
    (null: all)."""
    placed = ranked(rows, by, draw, key, name="_rank", size="_n")
    n, rank = F.col("_n"), F.col("_rank")
    small = F.greatest(F.lit(SMALL_LEAST), F.expr(f"_n div {SMALL_PART}"))
    test = F.when(n < SMALL, small).otherwise(F.greatest(F.lit(LEAST_ROWS), F.floor(n * F.lit(TEST_SHARE))))
    val = F.when(n < SMALL, small).otherwise(F.greatest(F.lit(LEAST_ROWS), F.floor(n * F.lit(VAL_SHARE))))
    split = F.when(rank <= test, "test").when(rank <= test + val, "val").otherwise("train")
    placed = placed.withColumn("split", split)
    if train_cap is not None:
        placed = placed.filter((F.col("split") != "train") | train_cap.isNull() | (rank <= test + val + train_cap))
    return placed.drop("_n", "_rank")


def locked_aware_split(rows: DataFrame, by: str, test: float, val: float, draw: str, second_draw: str, key: str) -> DataFrame:
    """Locked rows keep their split. Of a source's open rows a share is drawn for test if there are three at least, then
    of the rest (by a draw of its own) one for val, again if there are three; sizes are rounded up."""
    is_open = F.col("locked_split") == ""
    placed = ranked(rows.filter(is_open), [by], draw, key, name="_rank", size="_n")
    n_test = F.when((F.col("_n") >= 3) & F.lit(test > 0), F.ceil(F.col("_n") * F.lit(test))).otherwise(0)
    placed = placed.withColumn("_test", F.col("_rank") <= n_test).drop("_rank", "_n")
    rest = ranked(placed.filter("NOT _test"), [by], second_draw, key, name="_rank", size="_n")
    relative = min(val / max(1 - test, 1e-6), 0.5)
    n_val = F.when((F.col("_n") >= 3) & F.lit(val > 0), F.ceil(F.col("_n") * F.lit(relative))).otherwise(0)
    rest = rest.withColumn("split", F.when(F.col("_rank") <= n_val, "val").otherwise("train")).drop("_rank", "_n", "_test")
    tested = placed.filter("_test").withColumn("split", F.lit("test")).drop("_test")
    return rest.unionByName(tested).unionByName(rows.filter(~is_open).withColumn("split", F.col("locked_split")))


def cut_split(rows: DataFrame, by: list[str], draw: str, key: str, first: float = 0.70, second: float = 0.85) -> DataFrame:
    """Train, val and test by the row's place in its stratum, e.g. its vector of labels."""
    placed = ranked(rows, by, draw, key, name="_rank", size="_n")
    split = F.when(F.col("_rank") <= F.floor(F.col("_n") * F.lit(first)), "train").when(F.col("_rank") <= F.floor(F.col("_n") * F.lit(second)), "val").otherwise("test")
    return placed.withColumn("split", split).drop("_rank", "_n")


def with_quotas(rows: DataFrame, positive: Column, quotas: dict[str, int], draw: str, key: str) -> DataFrame:
    """All positives, and of the negatives of each split as many as its quota allows, drawn by hash."""
    quota = F.element_at(F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair)), F.col("split"))
    drawn = ranked(rows.filter(~positive), ["split"], draw, key, name="_rank").filter(F.col("_rank") <= F.coalesce(quota, F.lit(0))).drop("_rank")
    return rows.filter(positive).unionByName(drawn)


def pool_bounded(rows: DataFrame, positive: Column, draw: str, key: str, times: int = 6, least: int = 300) -> DataFrame:
    """All positives and max(times x positives, least) negatives at most, drawn by hash."""
    bound = max(times * rows.filter(positive).count(), least)
    drawn = ranked(rows.filter(~positive).withColumn("_all", F.lit(1)), ["_all"], draw, key, name="_rank").drop("_all")
    drawn = drawn.filter(F.col("_rank") <= bound).drop("_rank")
    return rows.filter(positive).unionByName(drawn)


def inverse_sqrt_weights(rows: DataFrame, by: list[str], least: float, most: float) -> DataFrame:
    """Weights 1 / sqrt(group size), scaled to a mean of 1 and clipped. Group sizes come from an aggregate that is
    joined back, so no window holds a group or the table."""
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    mean = sizes.agg((F.sum(F.sqrt("_n")) / F.sum("_n")).alias("_mean"))
    weighted = rows.join(sizes.join(F.broadcast(mean)), by)  # the mean is one row
    return weighted.withColumn("weight", F.least(F.lit(most), F.greatest(F.lit(least), 1 / F.sqrt("_n") / F.col("_mean")))).drop("_n", "_mean")


def fingerprints(rows: DataFrame, by: str, key: str) -> DataFrame:
    """Size, share and an order-free hash of the keys of each split: the sum of 48-bit hashes modulo 2**60, so that
    equal keys give equal hashes on any cluster and repeated keys count."""
    hashed = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("decimal(38,0)")
    found = rows.groupBy(by).agg(F.count("*").alias("n"), F.pmod(F.sum(hashed), F.lit(1 << 60)).cast("long").alias("hash"))
    return found.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))  # a row per split


def split_counts(rows: DataFrame, *flags: str) -> DataFrame:
    """Rows per split, and how many of them have each flag (0 or 1)."""
    return rows.groupBy("split").agg(F.count("*").alias("n"), *(F.sum(c).cast("long").alias(f"n_{c}") for c in flags))


def branches(rows: DataFrame, *flags: str) -> DataFrame:
    """Rows per branch and split: a branch for each flag, with the rows that have it, and one with all. A row is read once."""
    names = F.array_compact(F.array(*(F.when(F.col(c) == 1, c) for c in flags), F.lit("multitask")))
    return rows.select("split", F.explode(names).alias("branch")).groupBy("branch", "split").agg(F.count("*").alias("n"))


def source_summary(rows: DataFrame) -> DataFrame:
    """Per source: rows, rows of each split, and its languages."""
    splits = [F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")]
    return rows.groupBy("source").agg(F.count("*").alias("n"), *splits, F.array_join(F.array_sort(F.collect_set("lang")), ";").alias("langs"))


def scans_united(scans: dict[str, DataFrame]) -> DataFrame:
    """The rows of all scans under their scan's name."""
    parts = [rows.withColumn("scan", F.lit(name)) for name, rows in scans.items()]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def unmatched(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Keys that `others` lacks; null keys count as neither there nor lacking."""
    return rows.select(key).filter(F.col(key).isNotNull()).distinct().join(others.select(key), key, "left_anti")


def positive_weight(rows: DataFrame, flag: str, most: float = 20.0) -> DataFrame:
    """Negatives per positive, between 1 and `most`; 1 without positives."""
    p = F.sum(flag)
    ratio = F.try_divide((F.count("*") - p).cast("double"), p)
    return rows.agg(F.when(p == 0, 1.0).otherwise(F.least(F.lit(most), F.greatest(F.lit(1.0), ratio))).alias("weight"))


def imbalance_weights(rows: DataFrame, flag: str) -> DataFrame:
    """Soft (square root, 1.5 to 6) and hard (2 to 12) weights of the positives from negatives per positive."""
    r = (F.count("*") - F.sum(flag)).cast("double") / F.greatest(F.lit(1), F.sum(flag))
    clip = lambda x, low, high: F.least(F.lit(high), F.greatest(F.lit(low), x))
    return rows.agg(clip(F.sqrt(r), 1.5, 6.0).alias("soft"), clip(r, 2.0, 12.0).alias("hard"))


# What a corpus must have at least, and negatives per positive of one that counts as balanced.
LEAST_CORPUS, LEAST_POSITIVES, BALANCED = 10_000, 1_000, 2


def corpus_minimums(rows: DataFrame, flag: str) -> DataFrame:
    n, p = F.count("*"), F.sum(flag)
    balanced = (n - p).cast("double") / F.greatest(F.lit(1), p) < BALANCED
    return rows.agg((n >= LEAST_CORPUS).alias("enough"), (p >= LEAST_POSITIVES).alias("enough_positives"), balanced.alias("balanced"))


def replicated(rows: DataFrame, copies: int) -> DataFrame:
    """Each row `copies` times, numbered from 0."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))


def first_of_each(rows: DataFrame, by: str, most: int, *order) -> DataFrame:
    """The first rows of each group, `most` of them. Spark cuts each task's groups before they meet."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_rank") <= most).drop("_rank")


def balanced_sample(rows: DataFrame, by: str, size: int, key: str) -> DataFrame:
    """About `size` rows in all, equally many of each class, those with the least keys."""
    classes = rows.select(by).distinct().filter(F.col(by).isNotNull()).count()
    return first_of_each(rows, by, max(1, size // max(1, classes)), key)


def drawn_groups(rows: DataFrame, group: str, groups: int, seed: int) -> DataFrame:
    """All rows of so many whole groups, drawn by a hash of the group and the seed; all rows if there are no more groups."""
    chosen = rows.select(group).distinct().orderBy(sample_order(seed, F.col(group)), group).limit(groups)
    return rows.join(chosen, group, "left_semi")


def first_of_kind(rows: DataFrame, kind: str, most: int, *order) -> DataFrame:
    """The first rows of one media type in an order; all of them if `most` is 0."""
    found = rows.filter(F.col("media_type") == kind)
    return found.orderBy(*order).limit(most) if most > 0 else found


def files_per_folder(files: DataFrame, path: str, total: str = "(total)") -> DataFrame:
    """Files below each first folder and, under the name `total`, all of them."""
    counts = files.select(F.split_part(path, F.lit("/"), F.lit(1)).alias("folder")).rollup("folder").agg(F.count("*").alias("n"), F.grouping("folder").alias("_all"))
    return counts.select(F.when(F.col("_all") == 1, total).otherwise(F.col("folder")).alias("folder"), "n")
