import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from tamis.llm import resampling
from tamis.llm.common import documents


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(text, longest):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    bucket = lambda f: crc32(f.encode()) % buckets
    have, want = (Counter(bucket(f) for t in texts for f in runs(t, longest)) for texts in ([t for _, t in docs], target))
    s, t = sum(have.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (s + buckets) / ((have[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        found = runs(text, longest)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(words(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    place = {id(r): k + 1 for k, r in enumerate(enough[: len(enough) * percent // 100])}
    return sorted(((*r, place.get(id(r))) for r in rows), key=str)


def result(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_documents_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = brute(docs, target)
    assert sum(w[5] is not None for w in want) == sum(w[1] >= 20 for w in want) // 10 > 0
    found = resampling.op11_importance_resampling(spark, sf_dir)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"] and set(dict(found.dtypes).values()) == {"bigint"}
    assert result(found) == sorted(((w[0], *w[2:]) for w in want), key=str)


DOCS = [(1, None), (2, ""), (3, "One two. TWO three four"), (None, "five six " * 12), (None, "five six " * 12), (4, "a-b é Ü " * 9), (4, "a-b é Ü " * 9), (5, "one two " * 40_000)]
DOCS += [(10 + i, f"one two w{i} " * 8) for i in range(60)]
TARGET = ["one two three", None, "", "é ü w5 w6"]


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'x' as weight", "1 as rank", "2 as n", "3 as bucket", "4 as score")
    return docs, spark.createDataFrame([(t,) for t in TARGET], "text string")


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (3, 50, 37), (2, 1, 100)])
def test_runs_and_odd_rows(tables, longest, buckets, percent):
    docs, target = tables
    found = resampling.resample(docs.repartition(5), target, longest, buckets, percent)
    assert result(found) == brute(DOCS, TARGET, longest, buckets, percent)


def test_emptied_tries_lose_nothing(monkeypatch):
    text = [w.encode() for w in words(" ".join(f"w{i % 700} v{i % 11}" for i in range(5000)))]
    monkeypatch.setattr(resampling, "MOST_NODES", 100)
    monkeypatch.setattr(resampling, "STRIDE", 64)
    trie = resampling.Trie(3, 97)
    trie.count(text)
    trie.flush()
    want = Counter(crc32(b" ".join(text[i : i + k])) % 97 for k in (1, 2, 3) for i in range(len(text) - k + 1))
    assert dict(enumerate(trie.totals.tolist())) == {b: want[b] for b in range(97)}
    gains = list(range(97))
    assert resampling.Trie(3, 97, gains).weigh(text) == (sum(want.values()), sum(b * n for b, n in want.items()))


def test_empty_tables(tables):
    docs, target = tables
    assert resampling.resample(docs.limit(0), target).collect() == []
    assert result(resampling.resample(docs, target.limit(0))) == brute(DOCS, [])
