import hashlib
import random

import numpy as np

from tamis.llm import substring
from tamis.llm.common import documents


def brute(docs):
    words = [(t or "").encode().split() for _, t in docs]
    least = {}
    for (doc_id, _), w in zip(docs, words):
        for i in range(len(w) - 12):
            if doc_id is not None:
                key = tuple(w[i : i + 13])
                least[key] = min(doc_id, least.get(key, doc_id))
    out = []
    for (doc_id, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - 12):
            if doc_id is not None and least[tuple(w[i : i + 13])] < doc_id:
                gone.update(range(i, i + 13))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), hashlib.sha256(r.kept_words.encode()).hexdigest()) for r in df.collect()), key=str)


def test_documents_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    want = brute(docs)
    assert sum(w[2] for w in want) > 1000
    assert sorted((tuple(r) for r in substring.op9_substring_dedup(spark, sf_dir).collect()), key=str) == want


def test_shared_passages_of_every_length(spark, monkeypatch):
    rng = random.Random(5)
    source = [f"s{rng.randint(0, 400)}" for _ in range(3000)]
    docs = []
    for i in range(150):
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts += [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 20))]
            at = rng.randint(0, 2900)
            parts += source[at : at + rng.randint(1, 40)]
        docs.append((rng.randint(0, 10**6), " ".join(parts)))
    common = " ".join(f"common{k}" for k in range(15))
    docs += [(10**7 + i, f"a{i} b{i} c{i} {common} d{i} e{i} f{i}") for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute(docs)
    assert result(substring.remove_repeats(df)) == want
    monkeypatch.setattr(substring, "HOT_SHARE", 0)  # anchors of eight documents and more count as hot
    assert result(substring.remove_repeats(df)) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # keys go on from batch to batch
    try:
        assert result(substring.remove_repeats(df)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    docs = [(5, passage), (1, None), (None, passage), (2, ""), (9, passage), (9, passage), (9, "x " + passage), (3, "same " * 30000), (4, "same\n" * 14), (-7, "y " + passage + "\x0b\x0cz"), (6, "é " * 13)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as doc", "2 as place", "'k' as kind")
    assert result(substring.remove_repeats(df)) == brute(docs)
    assert substring.remove_repeats(df.limit(0)).collect() == []


def test_hot_anchors_of_later_rows_and_long_texts(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    rows = [(i, f"alone {i} " * 10) for i in range(2500)]
    rows += [(i, f"a{i} {passage} b{i} " + (f"c{i} " * 15000 if i % 100 == 0 else "")) for i in range(2500, 4000)]
    late = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    anchors = set(substring.Hashed(passage.encode()).contexts(13, substring.GRAM)[0].tolist())
    assert anchors <= set(substring.hot_anchors(late, 13, substring.GRAM).tolist())
    assert anchors <= set(substring.hot_anchors(late.filter("length(text) > 50000").union(late.filter("doc_id < 5")), 13, substring.GRAM).tolist())


def test_rows_of_one_doc_id_are_told_apart_by_their_whole_hash(spark):
    """Many texts of one doc_id, of which half hold a passage that a smaller document has too."""
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [(0, passage)] + [(1, f"{k} {passage if k % 2 else ' '.join(f'x{k}y{i}' for i in range(20))} end") for k in range(1500)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(substring.remove_repeats(df)) == brute(docs)


def test_second_hash_tells_windows_apart(spark, monkeypatch):
    """With first hashes that all collide, the second one still decides."""
    text = " ".join(f"w{i % 31} v{i % 17}" for i in range(400)).encode()
    hashed, at = substring.Hashed(text), np.arange(780)
    words = text.split()
    by = {}
    for i, h in zip(at.tolist(), hashed.second_runs(at, 13).tolist()):
        by.setdefault(h, set()).add(tuple(words[i : i + 13]))
    assert all(len(x) == 1 for x in by.values()) and len(by) == len({tuple(words[i : i + 13]) for i in range(780)})
    a, c = np.zeros(4, np.uint64), np.array([1, 2, 1, 2], np.uint64)
    doc = np.array([5, 6, 7, 6])
    out = substring.settle(a, c, doc, doc, doc, np.zeros(4, np.int64)).to_pydict()
    assert out["kind"] == [substring.OPEN, substring.OPEN, substring.SETTLED, substring.OPEN]
