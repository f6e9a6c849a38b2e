"""Evaluation of scores. Rows are first grouped by distinct score, so what is sorted and summed up is as small as the
scores are coarse, and one label's curve never passes row by row through a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SCORE_BUCKETS = 1024


def by_score(rows: DataFrame, *by: str) -> DataFrame:
    """Positives and negatives per distinct score, and how many of both score at least as much (tp, fp).

    Scores (0 to 1) fall into buckets; sums over whole buckets, a bounded number of rows, give each bucket what lies
    above it, and only scores of one bucket are sorted together.
    """
    points = rows.groupBy(*by, "score").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    points = points.withColumn("_bucket", F.floor(F.col("score") * SCORE_BUCKETS))
    sums = points.groupBy(*by, "_bucket").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above, every = Window.partitionBy(*by).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select(*by, "_bucket", zero(F.sum("_p").over(above)).alias("_tp"), zero(F.sum("_n").over(above)).alias("_fp"), F.sum("_p").over(every).alias("n_pos"), F.sum("_n").over(every).alias("n_neg"))
    down = Window.partitionBy(*by, "_bucket").orderBy(F.desc("score"))
    met = points.join(sums, [*by, "_bucket"])
    return met.withColumns({"tp": F.col("_tp") + F.sum("pos").over(down), "fp": F.col("_fp") + F.sum("neg").over(down)}).drop("_bucket", "_tp", "_fp")


def roc_auc(rows: DataFrame, *by: str) -> DataFrame:
    """Area under the ROC curve, ties counted half; null if a label has one class only."""
    p = by_score(rows, *by)
    below = F.col("n_neg") - F.col("fp")
    area = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    return p.groupBy(*by).agg(F.try_divide(area, (F.first("n_pos") * F.first("n_neg"))).alias("auc"))


def average_precision(rows: DataFrame, *by: str) -> DataFrame:
    p = by_score(rows, *by)
    return p.groupBy(*by).agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.first("n_pos")).alias("ap"))


def youden(rows: DataFrame, *by: str) -> DataFrame:
    """The threshold with the highest tpr - fpr; the highest threshold of equals."""
    p = by_score(rows, *by).withColumn("j", F.round(F.try_divide("tp", "n_pos") - F.try_divide("fp", "n_neg"), 9))
    return p.groupBy(*by).agg(F.max(F.struct("j", "score")).alias("best")).select(*by, F.col("best.score").alias("threshold"), F.col("best.j").alias("j"))


def calibration_error(rows: DataFrame, bins: int, *by: str) -> DataFrame:
    """Expected calibration error over equal bins."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    binned = rows.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg("y").alias("y"))
    return binned.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("ece"))


def confusion(rows: DataFrame, cut: float, *by: str) -> DataFrame:
    """tp, fp, fn and tn of the scores (column score) that reach the cut, against the truth (column y)."""
    hit, flagged = F.col("y") == 1, F.col("score") >= cut
    miss, passed = F.col("y") == 0, F.col("score") < cut
    return rows.groupBy(*by).agg(F.count_if(hit & flagged).alias("tp"), F.count_if(miss & flagged).alias("fp"), F.count_if(hit & passed).alias("fn"), F.count_if(miss & passed).alias("tn"))


def share(part: Column, whole: Column) -> Column:
    """part / whole; 0 of nothing."""
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def f1(counts: DataFrame) -> Column:
    tp, fp, fn = (counts[c] for c in ("tp", "fp", "fn"))
    return share(2 * tp, 2 * tp + fp + fn)


def rates(counts: DataFrame) -> dict[str, Column]:
    """Precision, recall, F1 and specificity of a confusion."""
    tp, fp, fn, tn = (counts[c] for c in ("tp", "fp", "fn", "tn"))
    return {"p": share(tp, tp + fp), "r": share(tp, tp + fn), "f1": f1(counts), "specificity": share(tn, tn + fp)}


def macro_micro_f1(counts: DataFrame) -> DataFrame:
    """The mean of the groups' F1 and the F1 of their sums."""
    tp, wrong = counts["tp"], counts["fp"] + counts["fn"]
    return counts.agg(F.avg(f1(counts)).alias("macro"), F.try_divide(F.sum(2 * tp).cast("double"), F.sum(2 * tp + wrong)).alias("micro"))


def brier(rows: DataFrame, *by: str) -> DataFrame:
    less = F.col("score") - F.col("y")
    return rows.groupBy(*by).agg(F.avg(less * less).alias("brier"))


def one_if(test: Column) -> Column:
    """1.0 or 0.0; an unknown counts as 0."""
    return F.when(test, 1.0).otherwise(0.0)


def flag_rates(rows: DataFrame, cut: float, *by: str) -> DataFrame:
    """Share of scores that reach the cut, their mean and their standard deviation."""
    return rows.groupBy(*by).agg(F.avg(one_if(F.col("score") >= cut)).alias("rate"), F.avg("score").alias("m"), F.stddev_pop("score").alias("sd"))


def agreement(rows: DataFrame, cut: float, *by: str) -> DataFrame:
    """How many rows there are, and in how many the cut decides as the truth does."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if((F.col("score") >= cut) == (F.col("y") == 1)).alias("agreed"))


def without_blurred(rows: DataFrame, ban: float, blur: float) -> DataFrame:
    """Rows whose score calls for a ban or for nothing."""
    return rows.filter((F.col("score") >= ban) | (F.col("score") < blur))


def class_gap(rows: DataFrame, *by: str) -> DataFrame:
    """Mean score of the positives less that of the negatives."""
    mean = lambda y: F.avg(F.when(F.col("y") == y, F.col("score")))
    return rows.groupBy(*by).agg((mean(1) - mean(0)).alias("gap"))


# Mean accuracies under these are chance and weak.
CHANCE, WEAK = 0.52, 0.62


def mean_accuracy(rows: DataFrame, cut: float, batch: str, *by: str) -> DataFrame:
    """Accuracy per batch, averaged over the batches whatever their sizes, and its tier."""
    right = (F.col("score") >= cut) == (F.col("y") == 1)
    batches = rows.groupBy(*by, batch).agg(F.avg(one_if(right)).alias("a"))
    found = batches.groupBy(*by).agg(F.avg("a").alias("acc"))
    return found.withColumn("tier", F.when(F.col("acc") < CHANCE, "chance").when(F.col("acc") < WEAK, "weak").otherwise("good"))


def smoothed(y: Column, share_kept: float = 0.9) -> Column:
    """The truth pulled towards 0.5."""
    return y * F.lit(share_kept) + F.lit((1 - share_kept) / 2)


def percent_of(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Percent of each value within its group; windows see a row per value."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"))
    return counts.select(*by, value, (F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(*by))).alias("percent"))


def level_distribution(levels: DataFrame, most: int = 2) -> DataFrame:
    """Count and percent of each level from 0 to `most`, also of those that no row has."""
    known = levels.sparkSession.range(most + 1).select(F.col("id").cast("int").alias("level"))
    counts = known.join(levels.groupBy("level").agg(F.count("*").alias("n")), "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))
    return counts.withColumn("percent", F.try_divide(F.lit(100.0) * F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))))


def area_by_trapezoids(rows: DataFrame, *by: str) -> DataFrame:
    """Area under the precision-recall curve that starts at recall 0 with precision 1. A point's predecessor is the point
    less its own rows, so no window runs along the curve."""
    p = by_score(rows, *by)
    tp, fp, n = F.col("tp"), F.col("fp"), F.col("n_pos")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    before = F.coalesce(F.try_divide(tp0, tp0 + fp0), F.lit(1.0))
    return p.groupBy(*by).agg(F.sum(F.try_divide(F.col("pos"), n) * (tp / (tp + fp) + before) / 2).alias("area"))


QUANTILE_BUCKETS = 4096


def quantiles(rows: DataFrame, value: str, cuts: dict[str, float], *by: str) -> DataFrame:
    """Exact quantiles, interpolated between neighbours, a column per cut; nulls don't count.

    Equal values are one row with a count. Those fall into buckets between the least and the greatest of their group;
    bucket sums, a bounded number of rows, say which buckets hold the ranks in question, and only these are sorted, each
    for itself.
    """
    v = F.col(value)
    points = rows.filter(v.isNotNull()).groupBy(*by, v.alias("_v")).agg(F.count("*").alias("_c"))
    ends = points.groupBy(*by).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.sum("_c").alias("_n"))
    place = F.try_divide(F.col("_v") - F.col("_low"), F.col("_high") - F.col("_low")) * QUANTILE_BUCKETS
    dealt = alike(points, ends, by).withColumn("_bucket", F.coalesce(F.floor(place), F.lit(0)))
    every = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*by, "_bucket").agg(F.sum("_c").alias("_in"), F.first("_n").alias("_n"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_in").over(every), F.lit(0)))
    at = {name: (F.col("_n") - 1) * F.lit(q) for name, q in cuts.items()}
    ranks = [end(x) for x in at.values() for end in (F.floor, F.ceil)]
    inside = lambda r, first, n: (r >= first) & (r < first + n)
    wanted = F.lit(False)
    for r in ranks:
        wanted = wanted | inside(r, F.col("_before"), F.col("_in"))
    near = alike(dealt.drop("_n"), sums.filter(wanted).drop("_in"), (*by, "_bucket"))
    within = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_c").over(within), F.lit(0)))
    value_at = lambda r: F.max(F.when(inside(r, F.col("_first"), F.col("_c")), F.col("_v")))
    lows = [value_at(F.floor(x)).alias(f"_low_{name}") for name, x in at.items()]
    highs = [value_at(F.ceil(x)).alias(f"_high_{name}") for name, x in at.items()]
    found = near.groupBy(*by).agg(F.first("_n").alias("_n"), *lows, *highs)
    sides = {name: (F.col(f"_low_{name}").cast("double"), F.col(f"_high_{name}").cast("double")) for name in cuts}
    return found.select(*by, *(between(*sides[name], x).alias(name) for name, x in at.items()))


def between(low: Column, high: Column, rank: Column) -> Column:
    """low and high weighed by the rank's fraction, rounded where DuckDB rounds: its first product is fused with the sum.
    Any other rounding puts a spread of 0.75 on the other side of a limit of 0.75."""
    share = rank - F.floor(rank)
    fused = F.java_method(F.lit("java.lang.Math"), F.lit("fma"), low, 1 - share, high * share).cast("double")
    return F.when(share == 0, low).when(low.isNotNull() & high.isNotNull(), fused)


def alike(left: DataFrame, right: DataFrame, by) -> DataFrame:
    """left with the columns of `right` that has one row per `by`; nulls are equal."""
    if not by:
        return left.crossJoin(right)  # one row
    keys = {c: f"_key_{c}" for c in by}
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    return left.join(right.withColumnsRenamed(keys), same).drop(*keys.values())


def value_stats(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Mean (m), median (med), least, greatest and total of a column."""
    v = F.col(value)
    stats = rows.groupBy(*by).agg(F.avg(v).alias("m"), F.min(v).alias("low"), F.max(v).alias("high"), F.sum(v).alias("total"))
    return alike(stats, quantiles(rows, value, {"med": 0.5}, *by), by)


def stuck(rows: DataFrame, score: str, *by: str) -> DataFrame:
    """Whether ten scores or more of a group lie close together at a mean over 0.3: spread between its outer tenths."""
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(score).alias("m"))
    found = alike(stats, quantiles(rows, score, {"p90": 0.9, "p10": 0.1}, *by), by)
    spread = F.col("p90") - F.col("p10")
    return found.select(*by, spread.alias("spread"), ((F.col("n") >= 10) & (spread < 0.75) & (F.col("m") > 0.3)).alias("stuck"))


def bucket_report(rows: DataFrame, cut: float, bucket: str, label: str) -> DataFrame:
    """Per bucket and label: rows, confusion, precision, recall and F1, 0 where nothing is true or flagged, and the mean of
    the bucket's F1s; rows without a bucket are left out."""
    named = rows.filter(F.coalesce(bucket, F.lit("")) != "")
    counts = confusion(named, cut, bucket, label)
    sizes = [(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n")]
    each = counts.select(bucket, label, *sizes, "tp", "fp", "fn", "tn", *(c.alias(n) for n, c in rates(counts).items() if n != "specificity"))
    return alike(each, each.groupBy(bucket).agg(F.avg("f1").alias("macro")), [bucket])
