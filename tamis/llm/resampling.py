"""Target-distribution importance resampling over hashed features, with word tries.

Features are all runs of 1 to `longest` consecutive words. A task counts them in a trie: a node stands for a run, holds
how often it occurs and the CRC-32 state of its text, so a longer run's bucket takes one more update from its parent's.
What tasks send on are totals by bucket, at most `buckets` rows each; added up, they give every bucket's gain, the
logarithm of how much more likely its features are in the target than in the documents. In a second pass tries have the
gains attached to their nodes, and a document's weight is the sum over the paths its words walk. Gumbel noise from a
hash of doc_id makes the highest scores a sample without replacement. Ranks come from range partitions (see
`common.numbered`).

A trie of more than MOST_NODES nodes is emptied into the totals and begun anew, so memory is bounded and nothing is lost.
The driver holds the buckets' totals and gains, whose number is a parameter.

Cases: a null or empty text has no features, weight 0 and is not drawn; repeated rows are scored and drawn each for
itself, and any of them gets the better rank; a null doc_id hashes as an empty one and comes last among equal scores; a
very long text is read whole, in pieces; extra columns of any name are ignored; without target texts or without
documents the totals are 0 and gains are still defined; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, documents, numbered, text_bytes, written

LONGEST, BUCKETS, PERCENT, LEAST_WORDS, SEED = 1, 10_000, 10, 20, 2024
#: Nodes of a task's trie, and the words of a text that are walked at a time.
MOST_NODES, STRIDE = 200_000, 65_536


class Node(dict):
    """A run of words; its children by the next word are made when they are first asked for."""

    __slots__ = ("trie", "crc", "count", "gain")

    def __missing__(self, word: bytes) -> Node:
        node = Node()
        trie = node.trie = self.trie
        node.crc = crc32(word) if self.crc is None else crc32(word, crc32(b" ", self.crc))
        node.count, node.gain = 0, trie.gains[node.crc % trie.buckets] if trie.gains else 0
        trie.size += 1
        self[word] = node
        return node


class Trie:
    def __init__(self, longest: int, buckets: int, gains: list[int] | None = None):
        self.longest, self.buckets, self.gains = longest, buckets, gains
        self.totals = np.zeros(buckets, np.int64)
        self.clear()

    def clear(self) -> None:
        self.size, self.root = 0, Node()
        self.root.trie, self.root.crc = self, None

    def walk(self, words: list[bytes]) -> Iterator[list[Node]]:
        """The nodes of every run of the text: lists of runs of one length that begin within one stride."""
        for at in range(0, len(words), STRIDE):
            nodes = [self.root] * min(STRIDE, len(words) - at)
            for k in range(self.longest):
                nodes = [node[word] for node, word in zip(nodes, words[at + k : at + k + STRIDE])]
                yield nodes
            if self.size > MOST_NODES:
                self.flush()

    def flush(self) -> None:
        """Adds the nodes' counts to the totals by bucket and empties the trie."""
        if self.gains is None:
            level = [self.root]
            while level := [child for node in level for child in node.values()]:
                crcs = np.fromiter((n.crc for n in level), np.int64, len(level))
                np.add.at(self.totals, crcs % self.buckets, np.fromiter((n.count for n in level), np.int64, len(level)))
        self.clear()

    def count(self, words: list[bytes]) -> None:
        for nodes in self.walk(words):
            for node in nodes:
                node.count += 1

    def weigh(self, words: list[bytes]) -> tuple[int, int]:
        """(features, sum of their gains)."""
        n = weight = 0
        for nodes in self.walk(words):
            n += len(nodes)
            weight += sum([node.gain for node in nodes])
        return n, weight


def bucket_totals(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> dict[int, int]:
    """How many features of the texts fall in each bucket that has any: at most `buckets` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(longest, buckets)
        for batch in batches:
            for raw in batch.column(0):
                trie.count(raw.as_py().translate(ALNUM_BYTES).split())
        trie.flush()
        (found,) = np.nonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(trie.totals[found])], ["bucket", "n"])

    totals = docs.select(text_bytes()).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r.bucket: r.n for r in totals.collect()}


def gains(have: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """By bucket, a thousand times the logarithm of its smoothed share in the target over that in the documents."""
    s_all, t_all = float(sum(have.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s_all / ((have.get(b, 0) + 1) * t_all))) for b in range(buckets)]


def weights(docs: DataFrame, gain: list[int], longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(longest, len(gain), gain)
        for batch in batches:
            rows = []
            for raw in batch.column(1):
                words = raw.as_py().translate(ALNUM_BYTES).split()
                rows.append((len(words), *trie.weigh(words)))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_bytes()).mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED
) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and rank; the rank is null for those not drawn.

    Of the documents with at least `least_words` words, `percent` in a hundred are drawn, those of the highest scores.
    """
    gain = gains(bucket_totals(docs, longest, buckets), bucket_totals(target, longest, buckets), buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    scored = written(weights(docs, gain, longest).withColumn("score", F.col("weight") + gumbel), "resample-scores")
    enough = F.col("n_words") >= least_words
    drawn = scored.filter(enough).count() * percent // 100
    ranked = numbered(scored.filter(enough), [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    return ranked.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
