"""Exact search among vectors and bit strings: nearest neighbours by cosine, prompts, all hashes within a radius.

Sides are cut into blocks and every pair of blocks is one small matrix product, or one comparison of words of bits, so
no task holds more than two blocks and nothing is broadcast but prompts, whose number is limited. What the pairs of
blocks find (k-best lists, maxima, counts and least ids) merges in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, and similarities that a task holds at a time.
BLOCK_ROWS, CELLS = 16_384, 1 << 19


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one width as rows; ValueError if the widths differ."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(column) and (len(flat) % len(column) or set(np.diff(column.offsets.to_numpy())) != {len(flat) // len(column)}):
        raise ValueError("vectors differ in width")
    return flat.reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero vector stays zero, so its cosine with any other is 0."""
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-150)


def by_blocks(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """What `run` gives for every pair of a block of `left` and a block of `right`. Rows are dealt by a hash of themselves,
    so that each side is sent once per block of the other."""
    n_left, n_right = (max(1, ceil(side.count() / block_rows)) for side in (left, right))

    def dealt(side: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        cut = side.withColumn(own, F.pmod(F.xxhash64(*side.columns), F.lit(blocks)).cast("int"))
        return cut.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    a = dealt(left, "_a", n_left, "_b", n_right).groupBy("_a", "_b")
    b = dealt(right, "_b", n_right, "_a", n_left).groupBy("_a", "_b")
    return a.cogroup(b).applyInArrow(run, schema)


def k_best(a: np.ndarray, b: np.ndarray, ids: np.ndarray, k: int, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, ids, cosines to 9 digits) of each row's k nearest of b, of equals the least ids; never a row's own id.

    ids are ascending. A cosine and its column together are one whole number, so the order is total and a partition
    finds the k least, however many are equal.
    """
    step = max(1, CELLS // max(1, len(b)))
    columns = np.arange(len(b))
    for at in range(0, len(a), step):
        s = np.round(a[at : at + step] @ b.T, 9)
        place = np.round((2 - s) * 1e9).astype(np.int64) * len(b) + columns
        place[own[at : at + step, None] == ids] = np.iinfo(np.int64).max
        best = np.argpartition(place, min(k, len(b)) - 1, axis=1)[:, :k]
        rows = np.repeat(np.arange(len(s)), best.shape[1])
        best = best.ravel()
        real = place[rows, best] < np.iinfo(np.int64).max
        yield at + rows[real], ids[best[real]], s[rows, best][real]


def nearest(queries: DataFrame, base: DataFrame, k: int, key: str = "vec_id", vector: str = "v", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """q, rank (from 1), the neighbour's key and its cosine s for the k nearest rows of `base` to every query.

    Exact: all of `base` is compared. Of equal cosines (to 9 digits) the least key comes first; a row is not its own
    neighbour; fewer than k rows in `base` give fewer. Keys are whole numbers; rows without a vector take no part.
    """

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({c: pa.array([], t) for c, t in (("q", pa.int64()), (key, pa.int64()), ("s", pa.float64()))})
        b = b.sort_by(key)
        own, ids = (t[key].to_numpy().astype(np.int64) for t in (a, b))
        found = list(k_best(unit(matrix(a[vector])), unit(matrix(b[vector])), ids, k, own))
        rows, near, s = (np.concatenate(x) for x in zip(*found))
        return pa.table({"q": own[rows], key: near, "s": s})

    sides = [side.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector)) for side in (queries, base)]
    found = by_blocks(*sides, run, f"q bigint, {key} bigint, s double", block_rows)
    order = Window.partitionBy("q").orderBy(F.desc("s"), key)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def voted(neighbours: DataFrame, *by: str) -> DataFrame:
    """The label that most neighbours have; of equally frequent ones that of the nearest."""
    votes = neighbours.groupBy(*by, "label").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    return votes.groupBy(*by).agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("vote"))


def knn_vote(queries: DataFrame, base: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """q, truth and vote: the majority label of every query's k nearest rows (rows: vec_id, v, label)."""
    near = nearest(queries, base, k, block_rows=block_rows).join(base.select("vec_id", "label"), "vec_id")
    return voted(near, "q").join(queries.select(F.col("vec_id").alias("q"), F.col("label").alias("truth")), "q").select("q", "truth", "vote")


def permuted(rows: DataFrame, key: str, value: str, seed: int, name: str) -> DataFrame:
    """key and value with the values dealt anew, as column `name`: rows in one order of hashes meet rows in another, so
    each value is given out once."""
    from ..functions.hashing import sample_order
    from .curation import ranked

    placed = lambda s, *keep: ranked(rows.select(*keep, key, sample_order(s, F.col(key)).alias("_draw")), [], "_draw", key, name="_place")
    plain = placed(seed, value).select(key, value, "_place")
    other = placed(seed + 1, F.col(value).alias(name)).select(name, "_place")
    return plain.join(other, "_place").drop("_place")


def knn_scores(queries: DataFrame, base: DataFrame, k: int = 5, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """How often the vote of the k nearest is right, how often with the labels of `base` permuted, and the share of the
    queries' most frequent label: what a score that means something has to beat. One search serves both scores; without
    rows on either side a score is 0."""
    near = nearest(queries, base, k, block_rows=block_rows)
    both = permuted(base.select("vec_id", "label"), "vec_id", "label", seed, "other")
    kinds = F.explode(F.array(F.struct(F.lit("real").alias("kind"), "label"), F.struct(F.lit("shuffled").alias("kind"), F.col("other").alias("label"))))
    labelled = near.join(both.select("vec_id", kinds.alias("l")), "vec_id").select("q", "rank", "l.*")
    truth = queries.select(F.col("vec_id").alias("q"), F.col("label").alias("truth"))
    right = voted(labelled, "q", "kind").join(truth, "q").groupBy("kind").agg(F.count_if(F.col("vote") == F.col("truth")).alias("right"))
    hits = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("right"))), F.lit(0))
    scores = right.agg(hits("real").alias("real"), hits("shuffled").alias("shuffled"))
    sizes = queries.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("queries"), F.max("n").alias("most"))
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("queries")), F.lit(0.0))
    return scores.crossJoin(sizes).select("queries", *(share(c).alias(name) for c, name in (("real", "real_score"), ("shuffled", "shuffled_score"), ("most", "majority"))))


#: Prompts in one matrix that goes to every task: 4096 of them at a width of 768 are 25 MB.
MOST_PROMPTS = 4096


def prompt_maxima(rows: DataFrame, prompts: DataFrame, group: str, vector: str = "v", key: str | None = None) -> DataFrame:
    """Per row and prompt group the highest cosine with a prompt of the group: columns `group` and similarity.

    Up to MOST_PROMPTS prompts are one matrix in every task, and rows are neither shuffled nor joined. More are cut into
    blocks that meet blocks of rows; `key`, unique in `rows`, then brings the maxima together, and only it is returned.
    Rows without a vector are left out.
    """
    given = prompts.select(F.col(group).alias("_group"), F.col(vector).cast("array<double>").alias("_p")).filter("_p IS NOT NULL")
    kind = dict(prompts.dtypes)[group]
    rows = rows.filter(F.col(vector).isNotNull())
    found = given.limit(MOST_PROMPTS + 1).toArrow()
    if found.num_rows > MOST_PROMPTS:
        if not key:
            raise ValueError(f"more than {MOST_PROMPTS} prompts need a key of the rows")
        kept = f"{key} {dict(rows.dtypes)[key]}, {group} {kind}, similarity double"
        best = by_blocks(rows.select(key, F.col(vector).cast("array<double>").alias("_v")), given, lambda a, b: _maxima(a, "_v", b, group, [key]), kept)
        return best.groupBy(key, group).agg(F.max("similarity").alias("similarity"))
    others = [c for c in rows.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _maxima(pa.Table.from_batches([batch]), vector, found, group, others).to_batches()

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != vector)
    return rows.withColumn(vector, F.col(vector).cast("array<double>")).mapInArrow(run, f"{fields}, `{group}` {kind}, similarity double")


def _maxima(rows: pa.Table, vector: str, prompts: pa.Table, group: str, kept: list[str]) -> pa.Table:
    if not prompts.num_rows or not rows.num_rows:
        return pa.table({**{c: rows[c].slice(0, 0) for c in kept}, group: prompts["_group"].slice(0, 0), "similarity": pa.array([], pa.float64())})
    prompts = prompts.sort_by("_group")
    groups = prompts["_group"].combine_chunks()
    codes = groups.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    b, parts = unit(matrix(prompts["_p"])).T, []
    a = unit(matrix(rows[vector]))
    step = max(1, CELLS // b.shape[1])
    for at in range(0, len(a), step):
        parts.append(np.maximum.reduceat(a[at : at + step] @ b, starts, axis=1))
    best = np.concatenate(parts)
    repeat = pa.array(np.repeat(np.arange(len(a)), len(starts)))
    names = groups.take(pa.array(np.tile(starts, len(a))))
    return pa.table({**{c: rows[c].take(repeat) for c in kept}, group: names, "similarity": best.ravel()})


# Hashes within a radius.

#: Rows of a cell that are compared with each other at once, combinations of parts at most, and parts of a split cell's lookup.
CELL_ROWS, MOST_KEYS, SALTS = 4096, 2000, 32
#: Cost of comparing two hashes, against that of moving one of them to a cell.
COMPARE_COST = 1 / 500


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def search_keys(n: int, most: int, bits: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """(masks of the parts, keys as combinations of parts) such that hashes at most `most` bits apart agree on some key.

    Cut into most + c parts, such hashes differ in `most` parts at most and agree on c whole ones. c is the least for
    which a key has log2(n) bits, so that n evenly spread hashes seldom meet by chance, as long as there are no more than
    MOST_KEYS keys. Where more than 2^(bits/2) hashes fill the space, chance can't be kept out and each key moves all of
    them once more: c is then the one of least cost, moves and comparisons together, and keys stay few at any n.
    """
    best, need = 1, log2(max(2, n))
    if 2 * need > bits:
        most_parts = [c for c in range(1, bits - most + 1) if comb(most + c, c) <= MOST_KEYS]
        cost = {c: comb(most + c, c) * (1 + COMPARE_COST * n / 2 ** (1 + bits * c // (most + c))) for c in most_parts}
        best = min(cost, key=cost.get, default=1)
    else:
        for c in range(1, bits - most + 1):
            if comb(most + c, c) > MOST_KEYS:
                break
            best = c
            if c * (bits // (most + c)) >= need:
                break
    parts = most + best
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])], list(combinations(range(parts), best))


def within_radius(classes: DataFrame, most: int, bits: int, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, list, list]:
    """Rows of `classes` (id, n, bits) under every key that others share: key, cell, and the pair of blocks x <= y of the
    cell in which they're compared. A cell of more than `cell_rows` rows is cut into blocks, each pair a group of its own."""
    masks, keys = search_keys(classes.count(), most, bits)
    key_masks = [signed(sum(masks[p] for p in key)) for key in keys]
    keyed = classes.select("id", "n", "bits", F.posexplode(F.array(*map(F.lit, key_masks))).alias("key", "mask"))
    keyed = keyed.withColumn("part", F.col("bits").bitwiseAND(F.col("mask"))).drop("mask").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    sizes = keyed.groupBy("key", "part").agg(F.count("*").alias("rows")).filter("rows > 1")
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    # No broadcast: Spark's estimate of the cells leaves out that they are given once per salt.
    met = keyed.join(salted.hint("merge"), ["key", "part", "salt"]).withColumn("blocks", F.ceil(F.col("rows") / cell_rows).cast("int"))
    own = F.pmod(F.xxhash64("id", "bits"), F.col("blocks")).cast("int")
    met = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("key", "part", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "n", "bits"), masks, keys


def _groups(batches: Iterator[pa.RecordBatch], on: list[str]) -> Iterator[pa.Table]:
    """The runs of equal columns of a sorted stream, each whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in on:
            values = batch.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= values[1:] != values[:-1]
            if held:
                new[0] |= values[0] != held[-1].column(c)[-1].as_py()
        cuts = np.flatnonzero(new)
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if a in cuts and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _near(group: pa.Table, masks: list[int], keys: list[tuple[int, ...]], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, rows, distances) of the group's pairs within the radius that agree on no key before this one."""
    bits = group["bits"].to_numpy().view(np.uint64)
    own, key = group["own"].to_numpy(), keys[group["key"][0].as_py()]
    before = [np.uint64(masks[p]) for p in range(key[-1]) if p not in key]
    same = group["x"][0].as_py() == group["y"][0].as_py()
    left = np.arange(len(bits)) if same else np.flatnonzero(own == group["x"][0].as_py())
    right = left if same else np.flatnonzero(own == group["y"][0].as_py())
    step = max(1, CELLS // max(1, len(right)))
    for at in range(0, len(left), step):
        some = left[at : at + step]
        x = bits[some, None] ^ bits[right]
        ok = np.bitwise_count(x) <= most
        if same:
            ok &= some[:, None] < right
        i, j = np.nonzero(ok)
        x = x[i, j]
        first = np.ones(len(x), bool)
        for mask in before:
            first &= (x & mask) != 0
        yield some[i[first]], right[j[first]], np.bitwise_count(x[first])


def _searched(classes: DataFrame, most: int, bits: int, cell_rows: int, emit: Callable, schema: str) -> DataFrame:
    dealt, masks, keys = within_radius(classes, most, bits, cell_rows)
    on = ["key", "part", "x", "y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, on):
            for found in _near(group, masks, keys, most):
                if len(found[0]):
                    yield emit(group, *found)

    return dealt.repartition(*on).sortWithinPartitions(*on).mapInArrow(run, schema)


def hash_classes(hashes: DataFrame) -> DataFrame:
    """Rows of one hash as one: bits, the least id and n, their number."""
    return hashes.groupBy("bits").agg(F.min("id").alias("id"), F.count("*").alias("n"))


def hamming_pairs(hashes: DataFrame, most: int, bits: int = 64, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Pairs of distinct hashes of `bits` bits that differ in at most `most`: id1 and id2 are the least ids of two classes,
    n1 and n2 their sizes. As many rows as there are such pairs; for one row per class see `hamming_links`."""

    def emit(group: pa.Table, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        ids, n = (group[c].to_numpy() for c in ("id", "n"))
        i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        return pa.RecordBatch.from_pydict({"id1": ids[i], "id2": ids[j], "n1": n[i], "n2": n[j], "distance": distance.astype(np.int32)})

    return _searched(hash_classes(hashes), most, bits, cell_rows, emit, "id1 bigint, id2 bigint, n1 bigint, n2 bigint, distance int")


def hamming_links(hashes: DataFrame, most: int, bits: int = 64, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per distinct hash: id (the least of its rows), n (its rows), links (other hashes within `most` bits), linked_rows
    (their rows) and first (the least id among its own and theirs, the centre of its star).

    Every pair is compared and counted, but no pair leaves its task: a block sends on a row per hash, so a dense cluster
    costs no more than its hashes.
    """
    classes = hash_classes(hashes)

    def emit(group: pa.Table, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        ids, n = (group[c].to_numpy() for c in ("id", "n"))
        links, rows, first = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), ids.copy()
        for a, b in ((i, j), (j, i)):
            np.add.at(links, a, 1)
            np.add.at(rows, a, n[b])
            np.minimum.at(first, a, ids[b])
        some = links > 0
        return pa.RecordBatch.from_pydict({"id": ids[some], "links": links[some], "linked_rows": rows[some], "first": first[some]})

    found = _searched(classes, most, bits, cell_rows, emit, "id bigint, links bigint, linked_rows bigint, first bigint")
    merged = found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("linked_rows").alias("linked_rows"), F.min("first").alias("first"))
    zero = F.lit(0).cast("long")
    joined = classes.join(merged, "id", "left")
    return joined.select("id", "n", F.coalesce("links", zero).alias("links"), F.coalesce("linked_rows", zero).alias("linked_rows"), F.coalesce("first", "id").alias("first"))
