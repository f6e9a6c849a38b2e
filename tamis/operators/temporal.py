"""Sequences of any length, split over tasks: rows meet the one before them across buckets of time, and pretext tasks
place frames without gathering a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as seq
from .metrics import alike


def with_previous(rows: DataFrame, by: list[str], order: list[str], columns: list[str], bucket: Column, name: str = "previous") -> DataFrame:
    """rows with a struct `name` of the columns of the row before in their group; null for a group's first row.

    `bucket` is an expression whose values follow the order. Each bucket also gets the last row of the bucket before it,
    its halo, so only rows of one bucket are sorted together; what is ordered over a whole group is a row per bucket.
    """
    dealt = rows.withColumn("_bucket", bucket)
    last = F.max_by(F.struct(*columns), F.struct(*order))
    ends = dealt.groupBy(*by, "_bucket").agg(last.alias("_last"))
    halo = ends.withColumn("_halo", F.lag("_last").over(Window.partitionBy(*by).orderBy("_bucket"))).drop("_last")
    met = alike(dealt, halo, [*by, "_bucket"])
    before = F.lag(F.struct(*columns)).over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return met.withColumn(name, F.coalesce(before, F.col("_halo"))).drop("_bucket", "_halo")


def changes(rows: DataFrame, by: list[str], order: list[str], value: str, bucket: Column) -> DataFrame:
    """Rows whose value differs from the one before it in their group, the first ones included."""
    met = with_previous(rows, by, order, [value], bucket, "_previous")
    is_first, same = F.col("_previous").isNull(), F.col(value).eqNullSafe(F.col("_previous")[value])
    return met.filter(is_first | ~same).drop("_previous")


def coherence(rows: DataFrame, by: str, order: str, vector: str, bucket: Column) -> DataFrame:
    """Per sequence of vectors: frames, similarity (mean cosine of consecutive frames; null for one frame) and variance
    (sample variance over time, averaged over the dimensions; null for one frame)."""
    met = with_previous(rows.select(by, order, F.col(vector).cast("array<double>").alias("_v")), [by], [order], ["_v"], bucket)
    cosine = F.when(F.col("previous").isNotNull(), seq.cosine(F.col("_v"), F.col("previous._v")))
    similar = met.groupBy(by).agg(F.count("*").alias("frames"), F.avg(cosine).alias("similarity"))
    cells = rows.select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    spread = cells.groupBy(by, "i").agg(F.var_samp("x").alias("x")).groupBy(by).agg(F.avg("x").alias("variance"))
    return alike(similar, spread, [by])


def coin(seed: int, task: str, key: Column) -> Column:
    """0 or 1 by a hash of the seed, the task and the key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{task}:"), key.cast("string"))), 1, 2), 16, 10).cast("int") % 2


def group_order(seed: int, key: Column, groups: int) -> Column:
    """The numbers 0 to groups - 1 in an order drawn by hashes, never the plain one, which is turned by one instead."""
    draws = F.array(*(F.struct(F.md5(F.concat(F.lit(f"{seed}:group:"), key.cast("string"), F.lit(f":{g}"))).alias("h"), F.lit(g).alias("g")) for g in range(groups)))
    drawn, plain = F.transform(F.array_sort(draws), lambda d: d["g"]), F.array(*map(F.lit, range(groups)))
    return F.when(drawn == plain, F.array(*map(F.lit, [*range(1, groups), 0]))).otherwise(drawn)


def pretext(frames: DataFrame, by: str, index: str, seed: int, length: int = 16, groups: int = 4) -> DataFrame:
    """Where each frame stands in three clips of its sequence, and the clips' labels.

    The clip is the first `length` frames. direction_at: played backwards if y_direction; shuffle_at: its groups of equal
    size in another order if y_shuffle, what is left over after the groups dropped; speed_at: every other frame of twice
    as many if y_speed. A place is null for a frame that the clip doesn't hold; frames that are in none are left out. A
    sequence's order is a function of its key, so only the number of its first 2 * length frames is brought to the rows.
    """
    some = frames.filter(F.col(index) < 2 * length)
    sizes = some.groupBy(by).agg(F.count("*").alias("_n"))
    at, key = F.col(index), F.col(by)
    met = alike(some, sizes, [by]).withColumns({f"y_{task}": coin(seed, task, key) for task in ("direction", "shuffle", "speed")})
    n = F.least(F.col("_n"), F.lit(length))
    size = F.floor(n / groups)
    place = F.array_position(group_order(seed, key, groups), F.floor(at / F.greatest(size, F.lit(1))).cast("int")) - 1
    grouped = (size > 0) & (at < size * groups)
    out = {
        "direction_at": F.when(at < n, F.when(F.col("y_direction") == 1, n - 1 - at).otherwise(at)),
        "shuffle_at": F.when(grouped, F.when(F.col("y_shuffle") == 1, place * size + at % F.greatest(size, F.lit(1))).otherwise(at)),
        "speed_at": F.when(F.col("y_speed") == 0, F.when(at < n, at)).when(at % 2 == 0, F.floor(at / 2)),
    }
    found = met.withColumns({c: v.cast("long") for c, v in out.items()}).drop("_n")
    return found.filter(F.coalesce(*out).isNotNull())
