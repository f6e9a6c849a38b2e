"""Threshold and temperature search, gates and health checks over scores.

A grid search sorts nothing: each row falls to the highest grid point that it reaches, so a label is a few hundred counts
whatever the number of rows, and what each threshold catches are sums over those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import fbeta
from .metrics import by_score

# Fixed values of the searches.
TEMPERATURES = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0]
LOGIT_CLIP, ECE_BINS, TIE = 30.0, 15, 1e-6
#: Expert -> least AUC and recall at 0.5; all need an ECE under ECE_GATE, after scaling if need be.
GATES = {"gore": (0.88, 0.80), "self_harm": (0.78, 0.75)}
ECE_GATE = 0.10


def linspace(low: float, high: float, n: int) -> list[float]:
    step = (high - low) / (n - 1)
    return [min(high, low + i * step) for i in range(n)]


WIDE_GRID, NARROW_GRID = linspace(0.01, 0.99, 199), linspace(0.05, 0.95, 100)


def grid_counts(rows: DataFrame, grid: list[float], *by: str) -> DataFrame:
    """(by, t, tp, fp, fn) for every threshold of an ascending, evenly spaced grid."""
    points, n = F.array(*map(F.lit, grid)), len(grid)
    guess = F.greatest(F.lit(-1), F.least(F.lit(n - 1), F.floor((F.col("score") - grid[0]) / ((grid[-1] - grid[0]) / (n - 1))))).cast("int")
    at = lambda i: F.get(points, i)  # noqa: E731  null outside the grid
    place = F.when(F.col("score") >= at(guess + 1), guess + 1).when(F.col("score") < at(guess), guess - 1).otherwise(guess)
    counts = rows.withColumn("_k", place).groupBy(*by, "_k").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    # At most one entry per grid point, and one for rows below the grid.
    label = counts.groupBy(*by).agg(F.collect_list(F.struct("_k", "pos", "neg")).alias("c"))

    def total(test, field: str) -> Column:
        return F.aggregate(F.filter("c", test), F.lit(0).cast("long"), lambda a, x: a + x[field])

    spread = label.select(*by, "c", F.posexplode(points).alias("i", "t"))
    reached, missed = lambda x: x["_k"] >= F.col("i"), lambda x: x["_k"] < F.col("i")
    return spread.select(*by, "t", total(reached, "pos").alias("tp"), total(reached, "neg").alias("fp"), total(missed, "pos").alias("fn"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": fbeta(tp, fp, fn, 1.0), "f2": fbeta(tp, fp, fn, 2.0)})


def best_on_grid(rows: DataFrame, grid: list[float], beta: float, *by: str) -> DataFrame:
    """The first threshold of the grid with the highest F-beta."""
    scored = grid_counts(rows, grid, *by).withColumn("f", F.round(fbeta(F.col("tp"), F.col("fp"), F.col("fn"), beta), 9))
    best = F.max_by(F.struct("t", "f"), F.struct("f", -F.col("t"))).alias("b")
    return scored.groupBy(*by).agg(best).select(*by, F.col("b.t").alias("threshold"), F.col("b.f").alias("f"))


def with_precision_floor(rows: DataFrame, floor: float, *by: str, grid: list[float] = WIDE_GRID) -> DataFrame:
    """The threshold of most recall (then F2, then precision, then the first) whose precision reaches the floor; where
    none does, the first one with the highest F1. `selection` says which of the two it is."""
    rated = with_rates(grid_counts(rows, grid, *by))
    ok = F.col("precision") >= floor
    down = -F.col("t")
    kept = F.struct("t", "precision", "recall", "f1", "f2")
    with_floor = F.max_by(F.when(ok, kept), F.when(ok, F.struct("recall", "f2", "precision", down)))
    best_f1 = F.max_by(kept, F.struct("f1", down))
    found = rated.groupBy(*by).agg(with_floor.alias("a"), best_f1.alias("b"))
    chosen = F.coalesce("a", "b")
    return found.select(*by, F.when(F.col("a").isNotNull(), "precision_floor").otherwise("f1").alias("selection"), chosen["t"].alias("threshold"), *(chosen[c].alias(c) for c in ("precision", "recall", "f1", "f2")))


def best_vertex(rows: DataFrame, beta: float, *by: str) -> DataFrame:
    """The lowest of the scores whose point on the precision-recall curve has the highest F-beta."""
    p = by_score(rows, *by)
    pr, rc = F.col("tp") / (F.col("tp") + F.col("fp")), F.try_divide("tp", "n_pos")
    f = F.round((1 + beta * beta) * pr * rc / F.greatest(beta * beta * pr + rc, F.lit(1e-12)), 9)
    return p.withColumn("f", f).groupBy(*by).agg(F.max_by(F.struct("score", "f"), F.struct("f", -F.col("score"))).alias("b")).select(*by, F.col("b.score").alias("threshold"), F.col("b.f").alias("f"))


def logit(score: Column, eps: float = 1e-6) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), score))
    return F.ln(p / (1 - p))


def scaled(z: Column, temperature: Column) -> Column:
    """The probability of a logit at a temperature, with the logit clipped."""
    x = F.greatest(F.lit(-LOGIT_CLIP), F.least(F.lit(LOGIT_CLIP), z / temperature))
    return 1 / (1 + F.exp(-x))


def calibration_by_temperature(rows: DataFrame, *by: str, temperatures: list[float] = TEMPERATURES) -> DataFrame:
    """(by, temperature, ece, brier)."""
    p = rows.withColumn("temperature", F.explode(F.array(*map(F.lit, temperatures)))).withColumn("p", scaled(logit(F.col("score")), F.col("temperature")))
    bins = p.groupBy(*by, "temperature", F.least(F.floor(F.col("p") * ECE_BINS), F.lit(ECE_BINS - 1)).alias("bin"))
    sums = bins.agg(F.count("*").alias("n"), F.avg("p").alias("s"), F.avg("y").alias("m"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("e"))
    return sums.groupBy(*by, "temperature").agg((F.sum(F.col("n") * F.abs(F.col("s") - F.col("m"))) / F.sum("n")).alias("ece"), (F.sum("e") / F.sum("n")).alias("brier"))


def best_temperature(rows: DataFrame, *by: str, temperatures: list[float] = TEMPERATURES) -> DataFrame:
    """Temperatures are tried in order; one replaces the best so far if its ECE is lower, or as good as equal with a
    lower Brier score."""
    found = calibration_by_temperature(rows, *by, temperatures=temperatures)
    tried = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("temperature", "ece", "brier"))).alias("tried"))
    start = F.struct(F.lit(1.0).alias("temperature"), F.lit(float("inf")).alias("ece"), F.lit(float("inf")).alias("brier"))
    better = lambda b, x: (x["ece"] < b["ece"]) | ((F.abs(x["ece"] - b["ece"]) < TIE) & (x["brier"] < b["brier"]))
    return tried.select(*by, F.aggregate("tried", start, lambda b, x: F.when(better(b, x), x).otherwise(b)).alias("b")).select(*by, "b.temperature", "b.ece", "b.brier")


def gate(auc: Column, recall: Column, ece: Column, ece_scaled: Column, least_auc: float, least_recall: float) -> Column:
    first = (auc >= least_auc) & (recall >= least_recall)
    return F.when(~F.coalesce(first, F.lit(False)), "fail_1").when(ece < ECE_GATE, "pass").when(ece_scaled < ECE_GATE, "pass_scaled").otherwise("fail_2")


def shortcut_tier(delta: Column, positives: Column, entropy: Column) -> tuple[Column, Column]:
    """(fails, tier) of three probes: blurred against clean scores, the mean on positives, attention entropy."""
    fails = F.coalesce((delta > 0.10).cast("int"), F.lit(0)) + F.coalesce((positives < 0.40).cast("int"), F.lit(0)) + F.coalesce((entropy > 0.85).cast("int"), F.lit(0))
    return fails, F.when(fails == 3, "shortcut").when(fails > 0, "partial").otherwise("ok")


def health_issues(epoch: Column, warm_up: int, std: Column, distillation: Column, bce: Column, side_std: Column, entropy: Column) -> Column:
    """Issues of one epoch, in order."""
    return F.concat_ws(
        ";",
        F.when(F.isnan(std) | F.isnan(side_std) | F.isnan(bce), "not_finite"),
        F.when(std < 0.05, "collapse"),
        F.when(distillation > 10 * bce, "distillation"),
        F.when((epoch >= warm_up) & (side_std < 0.01), "not_learning"),
        F.when(entropy > 4.0, "flat").when((entropy >= 0) & (entropy < 0.5), "one_frame"),
    )
