"""Near-duplicates by the Jaccard similarity of 5-word shingles, for the pipeline's stage.

Two rows are linked if their sets of 5-word shingles have a Jaccard similarity of 0.8 or more; of each connected group
one row stays. Candidates come from two sources. The SimHash operator, on the same shingles, groups fingerprints within
its four bits of one another, and loses no such pair. Pairs at 0.8 differ in about ten bits, out of its reach; MinHash
brings these: 24 bands of 4 minima each, so a pair at 0.8 exactly meets in no band with a probability of
(1 - 0.8^4)^24, about 3 in a million, and more alike pairs with less. Every candidate pair is verified on the whole sets
before it is linked, for four bits can be few changes or many in a long text.

Texts with the same words are one node from the start. Nodes of one SimHash component are a cell, and nodes that share a
band; of cells with the same nodes one stays. A crowded cell is cut to blocks by number and bytes of its sets, and each pair of blocks is a cell of
its own, so no task holds more than two blocks. A cell returns a star for each linked group, not its pairs.

Cases: case is ignored for A-Z; null and empty texts are one node; a text of fewer words than a shingle is one
shingle; shingles are compared by 64-bit hashes; the row that stays is one with the group's least doc_id, null last;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER_BYTES, U64, gram_hashes, mix, text_bytes, written
from .simhash import components, near_duplicates, stars

SHINGLE_WORDS, SEED = 5, 42
#: Linked at a similarity of LEAST_SHARED[0] / LEAST_SHARED[1] or more.
LEAST_SHARED = (4, 5)
BANDS, BAND_MINIMA = 24, 4
BLOCK, BLOCK_BYTES = 256, 16 << 20
_RANDOM = mix(np.arange(1, 2 * BANDS * BAND_MINIMA + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
XORS, FACTORS = _RANDOM[::2], _RANDOM[1::2] | U64(1)


def shingles(text: bytes) -> tuple[int, np.ndarray]:
    """A signed 64-bit name for the text's words, and the ascending hashes of its distinct shingles."""
    words = text.translate(LOWER_BYTES).split()
    name = xxh64_intdigest(b" ".join(words), SEED)
    hashes = np.fromiter((xxh64_intdigest(w, SEED) for w in words), U64, len(words))
    found = np.unique(gram_hashes(hashes, min(SHINGLE_WORDS, len(words)))) if words else np.empty(0, U64)
    return name - (1 << 64) if name >> 63 else name, found


def bands(found: np.ndarray) -> np.ndarray:
    """The names of the BANDS cells that a set of shingles belongs to; none for an empty set."""
    if not len(found):
        return np.empty(0, np.int64)
    least = np.full(BANDS * BAND_MINIMA, ~U64(0))
    for i in range(0, len(found), 2048):
        least = np.minimum(least, ((found[i : i + 2048, None] ^ XORS) * FACTORS).min(0))
    out = np.arange(1, BANDS + 1, dtype=U64)
    for part in least.reshape(BANDS, BAND_MINIMA).T:
        out = mix(out * U64(0x9E3779B97F4A7C15) + part)
    return out.view(np.int64)


def signatures(placed: DataFrame) -> DataFrame:
    """Per row: doc_id, _place, node, size (distinct shingles) and cells."""
    kinds = placed.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(name, len(found), bands(found)) for name, found in map(shingles, batch.column(2).to_pylist())]
            columns = [pa.array([g[k] for g in got], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "_place", "node", "size", "cells"])

    fields = [f"{c} {kinds[c].dataType.simpleString()}" for c in ("doc_id", "_place")]
    return placed.select("doc_id", "_place", text_bytes()).mapInArrow(run, ", ".join([*fields, "node bigint, size bigint, cells array<bigint>"]))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, shingles): the hashes of each text's shingles as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t)[1].tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    return texts.select("node", text_bytes()).mapInArrow(run, "node bigint, shingles binary")


def similar(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets are linked, as a square matrix."""
    n, size = len(sets), np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count > 1  # the others are shared by no pair
    owner, at = owner[several[at]], (np.cumsum(several) - 1)[at[several[at]]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    shared, step = np.zeros((n, n), np.int64), 4096
    cuts = np.searchsorted(at, np.arange(0, int(several.sum()) + step, step))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        has = np.zeros((n, step), np.float32)
        has[owner[a:b], at[a:b] - k * step] = 1
        shared += (has @ has.T).astype(np.int64)
    p, q = LEAST_SHARED
    return (p + q) * shared >= p * (size[:, None] + size)


def links(probes: DataFrame, sets: DataFrame, crowded: DataFrame) -> DataFrame:
    """Edges (u, v) that connect all nodes of a cell with similar sets; `crowded` has the cells and their parts."""
    met = probes.join(crowded, "cell").withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "node", "cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block"
    )
    key = ["cell", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(nodes: list[int], blocks: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(nodes) < 2:
                return
            near, side = similar(sets), np.array(blocks)
            if len(set(blocks)) > 1:
                near &= side[:, None] != side
            found = stars(near, np.array(nodes, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        last, held = None, ([], [], [])
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns[:5]]
            for node, cell, i, j, block, s in zip(*columns, batch.column(5)):
                if (cell, i, j) != last:
                    yield from linked(*held)
                    last, held = (cell, i, j), ([], [], [])
                held[0].append(node)
                held[1].append(block)
                held[2].append(np.frombuffer(s.as_py(), U64))
        yield from linked(*held)

    return dealt.join(sets, "node").select("node", *key, "block", "shingles").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "u bigint, v bigint")


def one_of_each(docs: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, unchanged, of which there is one for each connected group of near-duplicates.

    Rows are told apart by a number that is stored with them: numbered again, they would get other numbers whenever
    Spark splits the input otherwise, as it does when executors come or go.
    """
    placed = written(docs.select(F.struct("*").alias("_row"), F.monotonically_increasing_id().alias("_place")), "neardup-rows")
    placed = placed.select("_row.doc_id", "_row.text", "_row", "_place")
    groups = near_duplicates(placed, SHINGLE_WORDS, also=("_place",)).select("_place", F.array(F.xxhash64(F.lit("fp"), "centre")).alias("group"))
    cells = F.when(F.col("size") > 0, F.concat("cells", "group")).otherwise(F.col("cells"))
    found = written(signatures(placed).join(groups, "_place").withColumn("cells", cells).drop("group"), "neardup")
    probes = found.select("node", "size", F.explode("cells").alias("cell")).distinct()
    cells = probes.groupBy("cell").agg(
        F.count("*").alias("n"), F.sum("size").alias("size"), F.bit_xor("node").alias("a"), F.bit_xor(F.xxhash64("node")).alias("b")
    )
    cells = cells.filter("n > 1").groupBy("n", "size", "a", "b").agg(F.min("cell").alias("cell"))
    parts = F.greatest(F.ceil(F.col("n") / block), F.ceil(8 * F.col("size") / block_bytes)).cast("int")
    crowded = written(cells.select("cell", parts.alias("parts")), "neardup-cells")
    met = written(probes.select("node", "cell").join(crowded.select("cell"), "cell", "left_semi"), "neardup-probes")
    shown = found.join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("_place").alias("_place"))
    sets = written(shingle_sets(placed.select("_place", "text").join(shown, "_place").select("node", "text")), "neardup-sets")
    linked = components(links(met, sets, crowded), "neardup-links").withColumnsRenamed({"u": "node", "v": "centre"})
    first = found.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_place")).alias("first"))
    chosen = first.join(linked, "node", "left").groupBy(F.coalesce("centre", "node").alias("centre")).agg(F.min("first").alias("first"))
    return placed.join(chosen.select("first._place"), "_place", "left_semi").select("_row.*")
