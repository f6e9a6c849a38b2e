import re
from collections import defaultdict

import numpy as np
import xxhash

from tamis.llm import simhash
from tamis.llm.common import documents


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs, prints):
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    values = np.array(prints, np.uint64)
    for i in range(len(docs)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4) + i + 1:
            parent[root(i)] = root(int(j))
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[root(i)].append(i)
    out = []
    for members in groups.values():
        least = min((docs[i][0] for i in members if docs[i][0] is not None), default=None)
        out += [(docs[i][0], f"{prints[i]:016x}", least) for i in members]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect()), key=str)


def test_documents_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    want = brute(docs, [plain_fingerprint(t) for _, t in docs])
    assert len({w[2] for w in want}) < len({w[1] for w in want})  # near copies are there
    assert sorted((tuple(r) for r in simhash.op4_simhash_near_dedup(spark, sf_dir).collect()), key=str) == want


def test_odd_rows(spark):
    base = " ".join(f"word{i}" for i in range(300))
    docs = [(9, None), (7, ""), (None, " \n"), (None, "lone text of its own here"), (3, "a b"), (3, "a b"), (5, "A  B"), (20, base)]
    docs += [(30 + i, base.replace(f"word{i * 7} ", "changed ")) for i in range(25)] + [(80, "long text " * 40000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "0 as fp", "'x' as component_id", "1 as mask")
    want = brute(docs, [plain_fingerprint(t) for _, t in docs])
    assert result(simhash.near_duplicates(df)) == want
    assert result(simhash.near_duplicates(df, block=3)) == want
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_masks_lose_no_pair():
    rng = np.random.default_rng(4)
    for n, size in ((100, 50), (10**6, 500), (10**10, 2048)):
        sample = rng.integers(0, 2**63, size, np.int64)
        sample |= sample >> 31 & 0xFFFF  # correlated bits
        masks = np.array(simhash.choose_masks(sample, n), np.int64)
        a = rng.integers(-(2**63), 2**63 - 1, 4000, np.int64)
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 5, 4000)], np.uint64).view(np.int64)
        assert ((a[:, None] & masks) == ((a ^ flips)[:, None] & masks)).any(1).all()
    assert len(masks) > 5  # a large input gets tolerant partitions


def test_thresholds_are_the_cheapest():
    total, chosen = simhash.thresholds([[5, 6, 90], [1, 50, 60], [4, 30, 31]], 5)
    assert sum(t + 1 for t in chosen) == 5 and total == min(
        sum([5, 6, 90, 0][a] for a in [x])
        + [1, 50, 60, 0][y]
        + [4, 30, 31, 0][z]
        for x in range(-1, 3) for y in range(-1, 3) for z in range(-1, 3) if x + y + z + 3 == 5
    )


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.u: r.v for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}
