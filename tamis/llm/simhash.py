"""SimHash near-duplicates: generalised pigeonhole search for fingerprints that differ in few bits.

The 64 bits are grouped to partitions, correlated bits together, and each partition i gets a threshold t_i of its own
with sum(t_i + 1) = most_bits + 1. Two fingerprints within `most_bits` bits then agree within t_i bits on one
partition at least, whatever the grouping and the thresholds; these decide the cost alone. They are chosen for the
least estimated cost: a bounded sample of fingerprints (SAMPLE) gives bit correlations and the share of pairs that
would meet on each partition at each threshold, and dynamic programming shares the thresholds out. Large inputs so get
few wide partitions with a tolerance, small ones several narrow ones without.

A partition with threshold t is probed by one mask for each way of leaving out t of its bits: agreeing within t bits
is agreeing exactly on one of those masks. Fingerprints that share a mask's value meet in a cell; a value shared by
many is cut to blocks, and each pair of blocks is a cell of its own, so no cell is larger than two blocks. A cell
verifies its pairs by popcount and returns a star for each linked group, not its pairs. Equal texts and other equal
fingerprints are one node from the start. Components come from alternating large-star and small-star steps, each
written to the shared folder.

Cases: a null or empty text has fingerprint 0, linked like any other; a text of fewer words than a shingle is one
shingle; repeated rows share a fingerprint; a null doc_id is never a component's name unless all of its doc_ids are
null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER_BYTES, documents, text_bytes, written

SHINGLE_WORDS, SEED, MOST_BITS = 4, 42, 4
SAMPLE, BLOCK = 2048, 2048
#: Cost of comparing two fingerprints, against that of moving one of them to a cell.
COMPARE_COST = 1 / 500


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's word shingles, as a signed 64-bit integer."""
    words = text.translate(LOWER_BYTES).split()
    if not words:
        return 0
    line, k = b" ".join(words), min(shingle_words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.r_[0, ends[:-1] + 1][: len(words) - k + 1].tolist()
    last = ends[k - 1 :].tolist()
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(first, last)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in `also`, and fp, the fingerprint of each row's text."""
    kept = ["doc_id", *also]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle_words) for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], [*kept, "fp"])

    fields = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept]
    return docs.select(*kept, text_bytes()).mapInArrow(run, ", ".join([*fields, "fp bigint"]))


def bit_partitions(bits: np.ndarray, m: int) -> list[list[int]]:
    """64 bits in m groups of about the same width, each grown from the bits most correlated with it."""
    dev = bits - bits.mean(0)
    sd = np.maximum(dev.std(0), 1e-9)
    corr = np.abs(dev.T @ dev / max(1, len(bits)) / sd / sd[:, None])
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for i in range(m):
        group = [max(left, key=lambda b: corr[b, left].sum())]
        left.remove(group[0])
        while left and len(group) < 64 * (i + 1) // m - 64 * i // m:
            group.append(max(left, key=lambda b: corr[b, group].sum()))
            left.remove(group[-1])
        groups.append(group)
    return groups


def meetings(bits: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated number of meetings per pair of fingerprints, for thresholds 0..most on the group.

    The share of exact agreement falls by about the same factor with every bit; where a sample is too small to see
    it on all bits, it is carried on from the bits on which it can be seen. A pair that differs in k <= t bits of the
    group meets on each mask that leaves out those k bits and t - k others.
    """
    n, w = len(bits), len(group)
    pairs, logs = max(1, n * (n - 1) / 2), [0.0]
    key = np.zeros(n, np.int64)
    for b in group:
        key = key * 2 + bits[:, b]
        counts = np.unique(key, return_counts=True)[1]
        same = float((counts * (counts - 1) // 2).sum())
        if same < 30:
            break
        logs.append(np.log(same / pairs))
    seen = len(logs) - 1
    slope = (logs[-1] - logs[seen // 2]) / max(1, seen - seen // 2) if seen else -0.69
    exact = float(np.exp(logs[-1] + min(slope, -1e-3) * (w - seen)))
    agree = np.clip(np.mean([(bits[:, b].mean() ** 2 + (1 - bits[:, b].mean()) ** 2) for b in group]), 0.5, 1)
    odds = (1 - agree) / agree
    return [sum(min(1.0, exact * comb(w, k) * odds**k) * comb(w - k, t - k) for k in range(t + 1)) for t in range(most + 1)]


def thresholds(cost: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 (-1: not probed) with sum(t_i + 1) = units and the least total of cost[i][t_i]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t in range(-1, min(len(row), units - used)):
                total = c + (row[t] if t >= 0 else 0.0)
                if used + t + 1 not in step or total < step[used + t + 1][0]:
                    step[used + t + 1] = (total, [*chosen, t])
        best = step
    return best[units]


def choose_masks(sample: np.ndarray, n: int, most_bits: int = MOST_BITS, largest_threshold: int = 2) -> list[int]:
    """Masks (signed 64-bit) for n fingerprints: any two within most_bits bits agree on one of them."""
    bits = ((sample[:, None].astype(np.uint64) >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int64)
    if not len(bits):
        bits = np.zeros((1, 64), np.int64)
    options = []
    for m in range(1, most_bits + 2):
        groups = bit_partitions(bits, m)
        cost = []
        for g in groups:
            met = meetings(bits, g, min(largest_threshold, most_bits))
            cost.append([comb(len(g), t) * n + COMPARE_COST * m * n * n / 2 for t, m in enumerate(met)])
        if sum(len(c) for c in cost) >= most_bits + 1:
            total, chosen = thresholds(cost, most_bits + 1)
            options.append((total, groups, chosen))
    _, groups, chosen = min(options, key=lambda o: o[0])
    masks = []
    for g, t in zip(groups, chosen):
        if t >= 0:
            masks += [sum(1 << b for b in g if b not in out) for out in combinations(g, t)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def linked_stars(fps: np.ndarray, blocks: np.ndarray, most_bits: int) -> list[tuple[int, int]]:
    """(member, centre) for the groups linked by pairs of one block (if there is one) or across two blocks."""
    values = fps.view(np.uint64)
    near = np.empty((len(fps), len(fps)), bool)
    for i in range(0, len(fps), 256):
        near[i : i + 256] = np.bitwise_count(values[i : i + 256, None] ^ values) <= most_bits
    if len(set(blocks.tolist())) > 1:
        near &= blocks[:, None] != blocks
    return stars(near, fps)


def stars(near: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """(member, centre) for the groups that a square matrix of links connects."""
    np.fill_diagonal(near, False)
    todo, out = near.any(1), []
    while todo.any():
        reach = np.zeros(len(nodes), bool)
        front = np.zeros(len(nodes), bool)
        front[np.flatnonzero(todo)[0]] = True
        while front.any():
            reach |= front
            front = near[front].any(0) & ~reach
        todo &= ~reach
        group = np.sort(nodes[reach]).tolist()
        out += [(x, group[0]) for x in group[1:]]
    return out


def links(nodes: DataFrame, masks: list[int], most_bits: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) that connect all fingerprints `fp` within most_bits bits of one another."""
    probes = nodes.select("fp", F.posexplode(F.array(*map(F.lit, masks)))).select("fp", F.col("pos").alias("mask"), F.col("fp").bitwiseAND(F.col("col")).alias("value"))
    crowded = probes.groupBy("mask", "value").count().filter("count > 1").withColumn("parts", F.ceil(F.col("count") / block).cast("int")).drop("count")
    met = probes.join(crowded, ["mask", "value"]).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    cells = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "mask", "value", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp"
    )
    key = ["mask", "value", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []

        def stars(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            edge = np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)
            cuts = [0, *(np.flatnonzero(edge) + 1).tolist(), len(columns[0])]
            found = [x for a, b in zip(cuts, cuts[1:]) if b - a > 1 for x in linked_stars(columns[5][a:b], columns[4][a:b], most_bits)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [c.to_numpy() for c in batch.columns]
            rest = [np.concatenate(x) for x in zip(rest, new)] if rest else new
            same = np.all([c == c[-1] for c in rest[:4]], axis=0)  # the last cell may go on in the next batch
            at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if at:
                yield from stars([c[:at] for c in rest])
                rest = [c[at:] for c in rest]
        if rest:
            yield from stars(rest)

    return cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "u bigint, v bigint")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(u, v): v is the least node reachable from u, for every node u that isn't the least of its component."""
    state = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label)
    sign = None
    while True:
        new = state.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if new == sign or not new[0]:
            return state
        sign = new
        both = state.union(state.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = written(small.union(low).distinct(), label)


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, most_bits: int = MOST_BITS, sample: int = SAMPLE, block: int = BLOCK, also: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, the columns in `also`, fp, centre (a fingerprint that stands for the component) and
    component_id (least doc_id among those reachable by links of at most most_bits bits)."""
    found = written(fingerprints(docs, shingle_words, also), "simhash")
    nodes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    some = nodes.orderBy(F.xxhash64("fp"), "fp").limit(sample).select("fp").collect()
    masks = choose_masks(np.array([r.fp for r in some], np.int64), nodes.count(), most_bits)
    stars = components(links(nodes, masks, most_bits, block), "simhash-links")
    member = stars.select(F.col("u").alias("fp"), F.col("v").alias("centre")).union(stars.select("v", "v").distinct())
    named = member.join(nodes, "fp")
    names = named.groupBy("centre").agg(F.min("least").alias("component_id"))
    linked = named.select("fp", "centre").join(names, "centre").select("fp", "centre", "component_id")
    whole = nodes.join(linked, "fp", "left").select("fp", F.coalesce("centre", "fp").alias("centre"), F.coalesce("component_id", "least").alias("component_id"))
    return found.join(written(whole, "simhash-classes"), "fp").select("doc_id", *also, "fp", "centre", "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
