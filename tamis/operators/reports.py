"""Reports on runs and tables: baselines, training logs, score distributions, sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as seq

def best_so_far(log: DataFrame, by: str, value: str, period, *order: str) -> DataFrame:
    """Adds the highest value up to each row of its group, and whether the row reaches it.

    `period` is an expression whose values are in the rows' order, e.g. their day. Periods are maximised first; a row is
    compared with its period's rows and with one maximum of all periods before.
    """
    dealt = log.withColumn("_period", period)
    tops = dealt.groupBy(by, "_period").agg(F.max(value).alias("_top"))
    earlier = F.max("_top").over(Window.partitionBy(by).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1))
    tops = tops.select(F.col(by).alias("_by"), F.col("_period").alias("_p"), earlier.alias("_earlier"))
    met = dealt.join(tops, F.col(by).eqNullSafe(F.col("_by")) & F.col("_period").eqNullSafe(F.col("_p")))
    best = F.greatest(F.max(value).over(Window.partitionBy(by, "_period").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)), F.col("_earlier"))
    out = met.withColumn("best", best)
    return out.withColumn("improved", F.col(value) >= F.col("best")).drop("_period", "_p", "_by", "_earlier")


def loss_trend(log: DataFrame, epoch: str, loss: str) -> DataFrame:
    """First and last loss, number of epochs, and whether the loss went up."""
    first, last = F.min_by(loss, epoch), F.max_by(loss, epoch)
    return log.agg(first.alias("first_loss"), last.alias("last_loss"), F.count("*").alias("epochs"), (last > first).alias("diverged"))


def negative_groups(rows: DataFrame, flags: list[str], *by: str) -> DataFrame:
    """Groups of several rows without any flag, and their sizes."""
    clean = rows
    for c in flags:
        clean = clean.filter(F.col(c) == 0)
    return clean.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")


def divergence(rows: DataFrame, by: str, p: str, q: str, least: float = 0.01) -> DataFrame:
    """Kullback-Leibler divergence of two score columns, made distributions per group after adding `least`. One aggregate:
    the sums that normalise them are taken out of the logarithm."""
    a, b = F.col(p) + least, F.col(q) + least
    found = rows.groupBy(by).agg(F.sum(a * F.ln(a / b)).alias("s"), F.sum(a).alias("a"), F.sum(b).alias("b"))
    return found.select(by, (F.col("s") / F.col("a") + F.ln(F.col("b") / F.col("a"))).alias("kl"))


# Expert means under and over these are low and high.
LOW_MEAN, HIGH_MEAN = 0.35, 0.55


def expert_means(rows: DataFrame, *by: str) -> DataFrame:
    found = rows.groupBy(*by).agg(F.avg("score").alias("m"))
    return found.withColumn("gate", F.when(F.col("m") < LOW_MEAN, "low").when(F.col("m") > HIGH_MEAN, "high").otherwise("middle"))


def inference_summary(rows: DataFrame, cut: float) -> DataFrame:
    """Rows flagged, safe, and without a score."""
    s = F.col("score")
    return rows.agg(F.count_if(s >= cut).alias("flagged"), F.count_if(s < cut).alias("safe"), F.count_if(s.isNull()).alias("errors"))


def sizes(files: DataFrame, artifacts: DataFrame, by: str, unit: float = 1e6) -> DataFrame:
    """Each artifact expected (a column `by`, distinct), its size with all its files and whether there is one; files have
    `by` and length."""
    found = files.groupBy(by).agg(F.sum("length").alias("_bytes"))
    return artifacts.join(found, by, "left").select(by, F.round(F.coalesce("_bytes", F.lit(0)) / unit, 1).alias("size_mb"), F.col("_bytes").isNotNull().alias("found"))


def distillation(rows: DataFrame, epoch: str, teacher: Column, student: Column, bce: Column, warm_up: int, temperature: float, weight: float, entropy_weight: float) -> DataFrame:
    """Per epoch: mean divergence of the teacher's softened scores from the student's attention (0 in the warm-up, where it
    has no weight either), mean entropy of the attention, and the weighted total with the mean loss."""
    attention, soft = seq.guarded(student), seq.softened(teacher, temperature)
    kl = F.when(F.col(epoch) < warm_up, 0.0).otherwise(seq.total(F.zip_with(soft, attention, lambda t, s: t * (F.ln(t) - F.ln(s)))))
    entropy = -seq.total(F.transform(attention, lambda a: a * F.ln(a)))
    found = rows.groupBy(epoch).agg(F.avg(kl).alias("kl"), F.avg(entropy).alias("entropy"), F.avg(bce).alias("bce"))
    factor = F.when(F.col(epoch) < warm_up, 0.0).otherwise(weight)
    return found.withColumn("total", F.col("bce") + factor * F.col("kl") + entropy_weight * F.col("entropy"))


def straddling(rows: DataFrame, group: str, split: str = "split") -> DataFrame:
    """Groups with rows in several splits."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")
