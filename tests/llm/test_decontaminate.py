import hashlib
import re

import numpy as np

from tamis.llm import decontaminate as d
from tamis.llm.common import documents
from tamis.llm.fmindex import FMIndex, suffix_array


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item_id, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= {str(x) for x in got if x is not None}
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in d.judged(df).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(0)
    for n, k in ((1, 3), (40, 3), (500, 4), (800, 30)):
        s = rng.integers(1, k, n)
        if n > 100:
            s[n // 2 : n // 2 + 90] = s[:90]  # a long repeat
        t = np.r_[s, 0]
        assert suffix_array(t).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())
        index = FMIndex(s, k, sample=7)
        for m in (1, 2, 5):
            rows = np.array([s[i : i + m] for i in range(0, max(1, n - m), 3) if i + m <= n] + [rng.integers(1, k, m)])
            for row, lo, hi in zip(rows, *index.search(rows)):
                want = [i for i in range(n - m + 1) if (s[i : i + m] == row).all()]
                assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def test_tables(spark, sf_dir):
    docs, bench = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert any(w[5] for w in want)
    assert result(d.find_contamination(docs, bench)) == want
    assert result(d.find_contamination(docs, bench, shard_words=3000, block_bytes=2000)) == want
    assert sorted((tuple(r) for r in d.op7_benchmark_decontamination(spark, sf_dir).collect()), key=str) == want


def test_odd_rows(spark):
    long = " ".join(f"w{i % 97}" for i in range(40_000))
    phrase = " ".join(f"p{i}" for i in range(20))
    docs = [(1, None), (None, "x a-B c"), (2, ""), (3, "ab ab ab ab"), (3, "ab ab ab ab"), (4, long), (5, f"q {phrase} {phrase} Ünï.cöde"), (6, "one two")]
    items = [(1, None), (2, "ab AB"), (2, "zz"), (None, "one"), (3, ""), (4, phrase), (4, phrase), (5, "ünï cöde"), (6, long[:400])]
    docs_df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as items", "2 as n_words", "3 as spans")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    for size in (10**6, 150):
        assert result(d.find_contamination(docs_df, items_df, block_bytes=size)) == brute(docs, items)
    assert result(d.find_contamination(docs_df.limit(0), items_df)) == []
    assert result(d.find_contamination(docs_df, items_df.limit(0))) == brute(docs, [])
    assert [r.clean_text for r in d.find_contamination(docs_df, items_df, clean=True).collect() if r.doc_id == 5] == ["q  Ünï.cöde"]


def test_removal_keeps_the_rest():
    assert d.without(b"Keep, THIS part; and that.", [(1, 3)]) == b"Keep, ; and that."
    assert d.without(b"a b", []) == b"a b"
    assert d.merge([(5, 8), (0, 2), (2, 4), (6, 7)]) == [(0, 4), (5, 8)]
