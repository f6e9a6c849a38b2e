"""From raw documents to packed training sequences, in five stages.

Every stage takes what the one before it kept. All but the last return rows with the columns of `documents`, whatever
other columns there are. Cases hold for every stage unless it says otherwise: a null text counts as empty; repeated
rows are each a row of their own; very long texts are read whole; an empty table gives an empty table; columns whose
names an operator uses itself are carried through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamis.llm import common, decontaminate, neardup, packing, quality, substring


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality cascade rejects go, null and empty texts among them. The verdict depends on the row alone."""
    return quality.passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each connected group of near-duplicates (5-word shingles with a Jaccard similarity of 0.8 or more) the row with
    the least doc_id stays: SimHash brings near texts together, MinHash those beyond its bits, whole sets decide. A null
    doc_id comes last, and of rows that tie in doc_id one stays. Null and empty texts are one group."""
    return neardup.one_of_each(docs)


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 13-word passages that a document with a smaller doc_id has too are taken out of the text; rows left without
    a word go. Rows of one doc_id never take words from each other; rows with a null doc_id stay as they are."""
    return substring.without_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows contaminated with benchmark passages go, all others stay as they are; without a benchmark item all stay."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest is tokenised and packed into sequences of 2048 tokens: a row per piece, as the packing operator returns.
    Pieces of equal length change places without a change in the sequences' lengths; a null doc_id is carried along."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_substrings),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

#: MinHash, FM-index and tokeniser have no SQL; tests/llm/test_pipeline.py holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline's result for the table `documents` in sf_dir.

    Each stage's rows are stored before the next one, and deleted when that one is stored, as is all that a stage has
    stored on its way; the last ones stay, for the result reads them.
    """
    docs, before = common.documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = common.scratch_dir(spark, f"pipeline-{name}")
        with common.scratch_deleted():
            docs = common.stored(stage(spark, docs, sf_dir), path)
        if before:
            common.deleted(before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
