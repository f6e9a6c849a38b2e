"""Vector and hash search against plain numpy."""

import tracemalloc
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.operators import search

VECTORS = "vec_id long, v array<float>, label string"


def vectors(rng, n, first=0):
    """Small whole numbers, so that many cosines are equal; every third vector is the same."""
    x = rng.integers(-1, 3, (n, 4)).astype(float)
    x[::3] = [1.0, 2.0, 0.0, 1.0]
    return [(first + i, [float(a) for a in v], "abc"[int(rng.integers(3))]) for i, v in enumerate(x)]


def brute(queries, base, k):
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-150)
    out = {}
    for q, v, _ in queries:
        near = sorted((-round(float(unit(v) @ unit(b)), 9) + 0.0, i) for i, b, _ in base if i != q and b is not None)
        out[q] = [(i, -s + 0.0) for s, i in near[:k]]
    return out


@pytest.mark.parametrize("block_rows, cells, k", [(16_384, 1 << 22, 5), (17, 40, 5), (50, 1000, 1), (17, 1 << 22, 90)])
def test_nearest_in_blocks(spark, monkeypatch, block_rows, cells, k):
    monkeypatch.setattr(search, "CELLS", cells)
    rng = np.random.default_rng(5)
    base = vectors(rng, 80) + [(900, [0.0] * 4, "a"), (901, None, "a")]
    queries = vectors(rng, 30, 200) + base[:10]
    found = search.nearest(spark.createDataFrame(queries, VECTORS), spark.createDataFrame(base, VECTORS), k, block_rows=block_rows).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.q, []).append((r.vec_id, round(r.s, 9) + 0.0))
    assert got == brute(queries, base, k)


def test_scores_and_their_controls(spark):
    rng = np.random.default_rng(6)
    sign = lambda label: {"a": 1.0, "b": -1.0}[label]
    rows = [(i, [sign("ab"[i % 2]), float(rng.normal()) / 50], "ab"[i % 2]) for i in range(400)]
    base, queries = rows[:300], rows[300:]
    got = search.knn_scores(spark.createDataFrame(queries, VECTORS), spark.createDataFrame(base, VECTORS), block_rows=64).first()
    assert got.queries == 100 and got.real_score == 1.0 and got.majority == 0.5 and 0.2 < got.shuffled_score < 0.8
    dealt = search.permuted(spark.createDataFrame(base, VECTORS), "vec_id", "label", 42, "other").collect()
    assert sorted(r.other for r in dealt) == sorted(r.label for r in dealt) and sum(r.other != r.label for r in dealt) > 100
    none = spark.createDataFrame([], VECTORS)
    assert search.knn_scores(none, spark.createDataFrame(base, VECTORS)).first() == (0, 0.0, 0.0, 0.0)
    assert search.knn_scores(spark.createDataFrame(queries, VECTORS), none).first() == (100, 0.0, 0.0, 0.5)


def test_widths_must_agree(spark):
    bad = spark.createDataFrame([(1, [1.0], "a"), (2, [1.0, 2.0], "a")], VECTORS)
    with pytest.raises(Exception, match="differ in width"):
        search.nearest(bad, bad, 1).collect()


def test_memory_of_two_blocks():
    """Two whole blocks are compared in little more memory than they take themselves."""
    rng = np.random.default_rng(12)
    a, b = rng.normal(size=(1000, 16)), rng.normal(size=(search.BLOCK_ROWS, 16))
    ids = np.arange(len(b))
    tracemalloc.start()
    try:
        found = list(search.k_best(a, b, ids, 5, np.full(len(a), -1)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 48 << 20 and sum(len(x[0]) for x in found) == 5 * len(a)


@pytest.mark.parametrize("most", [4096, 20])
def test_many_prompts(spark, monkeypatch, most):
    """One matrix in every task, or blocks of prompts: the same maxima."""
    monkeypatch.setattr(search, "MOST_PROMPTS", most)
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(50)] + [(99, None)]
    prompts = [("xyz"[i % 3], [float(x) for x in rng.normal(size=8)]) for i in range(200)] + [(None, [1.0] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("similarity", F.lit(1)).drop("similarity")
    got = search.prompt_maxima(df, spark.createDataFrame(prompts, "g string, v array<double>"), "g", key="id").collect()
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = {(i, g): round(max(cos(v, p) for h, p in prompts if h == g), 9) for i, v in rows[:-1] for g in ("x", "y", "z", None)}
    assert {(r.id, r.g): round(r.similarity, 9) for r in got} == want and len(got) == len(want)
    if most < len(prompts):
        with pytest.raises(ValueError, match="need a key"):
            search.prompt_maxima(df, spark.createDataFrame(prompts, "g string, v array<double>"), "g")


def links(values, most):
    """(n, links, linked rows, first) by the least id of every distinct hash."""
    first, n = {}, {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
        n[v] = n.get(v, 0) + 1
    u = np.array(list(first), np.int64).view(np.uint64)
    ids, rows = np.array(list(first.values())), np.array([n[v] for v in first])
    near = np.bitwise_count(u[:, None] ^ u) <= most
    return {int(i): (int(c), int(m.sum()) - 1, int(rows[m].sum() - c), int(ids[m].min())) for i, c, m in zip(ids, rows, near)}


@pytest.mark.parametrize("most, cell_rows", [(3, 4096), (3, 50), (10, 64), (0, 64)])
def test_links_with_a_hot_band(spark, most, cell_rows):
    """Half of the hashes agree on their lower 48 bits or nearly so; none of their links is lost."""
    rng = np.random.default_rng(8)
    hot = [int(0x1234_5678_9ABC) | int(x) << 48 for x in rng.integers(-(2**15), 2**15, 400)]
    rest = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 300)]
    rest += [v ^ (1 << int(a)) ^ (1 << int(b)) for v, a, b in zip(rest[:100], rng.integers(0, 63, 100), rng.integers(0, 63, 100))]
    values = hot + rest + rest[:50] * 2
    df = spark.createDataFrame(list(enumerate(values)), "id long, bits long").repartition(7)
    got = {r.id: (r.n, r.links, r.linked_rows, r.first) for r in search.hamming_links(df, most, 64, cell_rows).collect()}
    assert got == links(values, most)
    if most == 3:
        pairs = search.hamming_pairs(df, most, 64, cell_rows).collect()
        assert len(pairs) == len({(p.id1, p.id2) for p in pairs}) == sum(x[1] for x in got.values()) // 2


def test_salted_cells_are_not_broadcast(spark):
    """Spark takes the lookup of cells for as small as it is before it is given once per salt."""
    rng = np.random.default_rng(11)
    df = spark.createDataFrame(list(enumerate(map(int, rng.integers(0, 2**24, 3000)))), "id long, bits long")
    for found in (search.hamming_links(df, 3, 24), search.hamming_pairs(df, 3, 24)):
        assert found.collect()
        joins = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "salt#" in x and "Join" in x]
        assert joins and not any("Broadcast" in x for x in joins)


def test_keys_find_every_pair():
    """Whatever bits differ, one key at least is left whole, and its parts have the bits that n asks for."""
    rng = np.random.default_rng(9)
    for n, most, bits in ((100, 3, 24), (10**9, 3, 64), (10**6, 10, 64), (10, 0, 8), (10**6, 20, 64)):
        masks, keys = search.search_keys(n, most, bits)
        assert sum(masks) == (1 << bits) - 1 and len(keys) <= search.MOST_KEYS
        for _ in range(300):
            x = sum(1 << int(b) for b in rng.choice(bits, most, replace=False))
            assert any(all(not x & masks[p] for p in key) for key in keys)
    assert min(sum(search.search_keys(10**9, 3, 64)[0][p].bit_count() for p in key) for key in search.search_keys(10**9, 3, 64)[1]) >= 30


def test_keys_stay_few_where_hashes_are_dense():
    """More keys can't keep hashes apart that fill their space; each would move all of them once more."""
    for n in (5000, 10**5, 6 * 10**5, 6 * 10**6):
        masks, keys = search.search_keys(n, 3, 24)
        assert len(keys) <= 20
        for at in combinations(range(24), 3):
            x = sum(1 << b for b in at)
            assert any(all(not x & masks[p] for p in key) for key in keys)


def test_empty_hashes(spark):
    none = spark.createDataFrame([], "id long, bits long")
    assert search.hamming_links(none, 3).collect() == [] and search.hamming_pairs(none, 3).collect() == []
