"""Mixing sources to target weights by systematic sampling.

Sources get a share of all words by weight; none gets more than `most` times its own words, and what is over goes to
the others by weight. Every document of a source with words then has the same expected number of copies, target over
size. Their prefix sums within the source, from one random offset, cross integers: a document is emitted once for
each that it crosses. Documents are taken in the order of their sizes, so the words taken differ from the target by
less than the largest document's words. Sums are whole numbers of 2^-40 copies, so they are exact in any order, and no
document is emitted more than `most` times. Only sizes are shuffled; ranks come from range partitions (see
`common.numbered`), so a source that holds most rows is dealt to many tasks. The table of sources, a row each, is
ordered in one task.

Cases: a null or empty text has no words and no copies; null is a source of its own, the last; of rows with equal size
and doc_id any may get the copy; null doc_ids come last among their size; sources without words have the target 0; a
very long text is one document, taken whole or not; extra columns of any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANK, documents, numbered, written

WEIGHTS, PERCENT, MOST, SEED = (5, 2, 1), 100, 3, "mix"
#: Hexadecimal digits of the offset, and as many parts of a copy.
DIGITS = 10
UNIT = 16**DIGITS


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, the words of the whole text."""
    words = F.regexp_count(F.col("text"), F.lit(f"[^{BLANK}]+"))
    return docs.select("doc_id", "source", F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST) -> DataFrame:
    """source, source_size and target for a table of sources and their sizes.

    Filling the sources to a common level of words per weight, those with least words per weight are full first: a
    source is full if the level that the rest would have, were it and those after it not full, is above its limit.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    least = lcm(*weights)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), turn)
    weighed = sources.withColumns({"weight": pick(weights), "per_weight": F.col("source_size") * pick([least // w for w in weights])})
    fill = Window.orderBy("per_weight", F.col("source").asc_nulls_last())
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    total, limit = F.sum("source_size").over(everything) * percent / 100, most * F.col("source_size")
    level = (total - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    found = weighed.withColumn("full", level * F.col("weight") > limit)
    over = F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(everything)
    left = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    found = found.withColumn("share", (total - most * over) / left * F.col("weight"))
    return found.select("source", "source_size", F.when(F.col("full"), limit).otherwise(F.least("share", limit)).cast("double").alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target and copies, how often the mix takes it."""
    sized = written(sizes(docs), "mix-sizes")
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, most)
    # What one copy in UNIT parts each document of the source is to have, and where its prefix sum begins.
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    offset = F.conv(F.substring(F.sha2(name, 256), 1, DIGITS), 16, 10).cast("long")
    share = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.nullif("source_size", F.lit(0)) * UNIT)).otherwise(0)
    goal = goal.withColumns({"share": share.cast("long"), "offset": offset})
    goal = written(goal, "mix-targets")
    ranked = numbered(sized.filter("size > 0"), ["source"], [F.col("size"), F.col("doc_id").asc_nulls_last()], "rank", goal)
    begins = F.pmod(F.col("offset") + (F.col("rank") - 1).cast("decimal(38,0)") * F.col("share"), F.lit(UNIT)).cast("long")
    ranked = ranked.withColumn("copies", F.floor((begins + F.col("share")) / UNIT))
    empty = sized.filter("size = 0").join(goal.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
    columns = ["doc_id", "source", "size", "source_size", "target", "copies"]
    return ranked.select(columns).unionByName(empty.withColumn("copies", F.lit(0).cast("long")).select(columns))


def emitted(mixed: DataFrame) -> DataFrame:
    """The mix itself: a row for every copy, with its number from 1."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP13_SQL = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
turns AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sized GROUP BY source),
weighed AS (SELECT source, source_size, [5, 2, 1][turn + 1] AS weight, source_size * [2, 5, 10][turn + 1] AS per_weight FROM turns),
filled AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(weight) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) * weight > 3 * source_size AS is_full
  FROM weighed WINDOW fill AS (ORDER BY per_weight, source NULLS LAST)),
goals AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN 3 * source_size ELSE least((sum(source_size) OVER () - 3 * sum(CASE WHEN is_full THEN source_size ELSE 0 END) OVER ())
      / (sum(CASE WHEN NOT is_full THEN weight END) OVER ()) * weight, 3 * source_size) END::DOUBLE AS target
  FROM filled),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * {UNIT})::BIGINT ELSE 0 END AS share,
    ('0x' || substr(sha256('{SEED}:' || coalesce('=' || source, '')), 1, {DIGITS}))::BIGINT AS off
  FROM goals),
ranked AS (
  SELECT d.doc_id, d.size, s.*, row_number() OVER (PARTITION BY d.source, d.size > 0 ORDER BY d.size, d.doc_id NULLS LAST) - 1 AS r
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size > 0 THEN size * (((off + r::HUGEINT * share) % {UNIT} + share) // {UNIT}) ELSE 0 END)::BIGINT AS taken
FROM ranked
"""
