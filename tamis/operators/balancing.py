"""Balanced assignment of vectors to prototypes by alternating row and column normalisation (Sinkhorn)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as seq
from ..session import shared_dir

#: Prototypes that one broadcast row holds at most.
MOST_PROTOTYPES = 65_536


def class_means(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """The mean vector of each label, as array<double>; added up by dimension, so a label of any size is spread."""
    cells = rows.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    return cells.groupBy(label).agg(F.transform(ordered, lambda c: c["x"]).alias(vector))


def _one_row(prototypes: DataFrame, label: str, value: Column, name: str) -> DataFrame:
    """All prototypes in one row, in the order of their labels."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(label), value.alias("x"))))
    return prototypes.agg(F.transform(ordered, lambda p: p["x"]).alias(name), F.transform(ordered, lambda p: p[label]).alias("labels"))


def logits(rows: DataFrame, prototypes: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """key, labels and logits: each row's cosine with every prototype, in the order of the labels."""
    if prototypes.count() > MOST_PROTOTYPES:
        raise ValueError(f"more than {MOST_PROTOTYPES} prototypes")
    all_of_them = _one_row(prototypes, label, F.col(vector), "_p")
    met = rows.select(key, F.col(vector).cast("array<double>").alias("_v")).crossJoin(F.broadcast(all_of_them))  # one row
    return met.select(key, "labels", F.transform("_p", lambda p: seq.cosine(F.col("_v"), p)).alias("logits"))


def balanced(rows: DataFrame, key: str, epsilon: float = 0.05, iterations: int = 3) -> DataFrame:
    """key, label and q for every row and prototype of a table of `logits` (see there).

    exp(logit / epsilon) is made to add up to the same for every prototype, then to the same for every row, `iterations`
    times; last of all every row adds up to 1. The matrix itself never changes: a normalised cell is its exponential times
    a weight of its row times one of its prototype, and a row's weight follows from the prototypes'. So the state of an
    iteration is a number per prototype, stored in the shared folder, and an iteration is one aggregate whose tasks add up
    before they meet; rows are not shuffled at all.
    """
    if iterations < 1:
        raise ValueError("at least one iteration")
    spark, path = rows.sparkSession, shared_dir(rows.sparkSession, "balanced")
    top = F.array_max("logits")  # a factor of the row, so that no exponential overflows
    rows.select(key, "labels", top.alias("top"), F.transform("logits", lambda x: F.exp((x - top) / epsilon)).alias("e")).write.parquet(f"{path}/cells")
    cells = spark.read.parquet(f"{path}/cells")
    # The first sums are over the exponentials themselves, all less by the greatest of them.
    whole = F.exp((F.col("top") - F.col("peak")) / epsilon)
    peak = F.broadcast(cells.agg(F.max("top").alias("peak")))  # one row
    now = cells.crossJoin(peak).select(F.transform("e", lambda e: e * whole).alias("c"))
    state = None
    for i in range(iterations):
        sums = now.select(F.posexplode("c").alias("i", "c")).groupBy("i").agg(F.greatest(F.sum("c"), F.lit(1e-300)).alias("s"))
        last = sums.withColumn("w", F.lit(1.0)) if state is None else sums.join(state, "i")
        last.select("i", (F.col("w") / F.col("s")).alias("w")).write.parquet(f"{path}/state-{i}")
        state = spark.read.parquet(f"{path}/state-{i}")
        now = _weighted(cells, state)
    found = now.select(key, F.explode(F.arrays_zip("labels", "c")).alias("z"))
    return found.select(key, F.col("z.labels").alias("label"), F.col("z.c").alias("q"))


def _weighted(cells: DataFrame, state: DataFrame) -> DataFrame:
    """Cells after normalising prototypes by the state and then rows to 1, as column c."""
    weights = F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda s: s["w"])
    met = cells.crossJoin(F.broadcast(state.agg(weights.alias("w"))))  # one row, a number per prototype
    met = met.withColumn("c", F.zip_with("e", "w", lambda e, w: e * w))
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x)
    return met.withColumn("_t", total).withColumn("c", F.transform("c", lambda x: x / F.col("_t")))
