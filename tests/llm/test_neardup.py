import re

import numpy as np

import corpus_pipeline
from tamis.llm import neardup, simhash
from tamis.llm.common import documents


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """doc_ids that stay, by comparing all pairs."""
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(root(i), []).append((doc_id is None, doc_id))
    return sorted((min(g) for g in groups.values()), key=str)


def stays(df):
    return sorted(((r.doc_id is None, r.doc_id) for r in df.collect()), key=str)


def edited(words, places):
    return " ".join(f"other{i}" if i in places else w for i, w in enumerate(words))


def test_pairs_of_many_bits_go(spark):
    """Texts at a similarity just above 0.8 differ in more than four SimHash bits; just below they both stay."""
    rows, base = [], 0
    for k in range(40):
        words = [f"w{k}x{i}" for i in range(204)]  # 200 shingles; an edit far from others changes five
        rows += [(base, " ".join(words)), (base + 1, edited(words, {20, 60, 100, 140}))]  # 180 of 220
        rows.append((base + 2, edited([f"v{w}" for w in words], ())))
        rows.append((base + 3, edited([f"v{w}" for w in words], {20, 60, 100, 140, 180})))  # 175 of 225
        base += 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len(want) == 3 * 40
    assert stays(dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")) == want


def test_simhash_alone_finds_what_is_within_its_bits(spark, monkeypatch):
    """Without MinHash the operator's fingerprints still bring together texts of few other shingles; sets decide."""
    rows, near = [], 0
    for k in range(30):
        words = [f"w{k}x{i}" for i in range(1500)]
        texts = [" ".join(words), edited(words, {700}), edited(words, {300, 1100})]
        a, b, c = (simhash.fingerprint(t.encode(), 5) & (1 << 64) - 1 for t in texts)
        near += [(a ^ b).bit_count() <= 4, (a ^ c).bit_count() <= 4, (b ^ c).bit_count() <= 4].count(True) > 1
        rows += [(3 * k + i, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, t) for i, t in enumerate(("a b", "c d", "", None))]  # short texts: far apart, or one group
    monkeypatch.setattr(neardup, "bands", lambda found: np.empty(0, np.int64))
    got = stays(neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")))
    assert near > 20 and {x for _, x in got} >= {x for _, x in brute(rows)}
    assert len(got) <= 30 + 3 + 2 * (30 - near)


def test_documents_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    got = neardup.one_of_each(docs)
    assert got.columns == docs.columns and stays(got) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows_and_blocks(spark):
    words = [f"word{i}" for i in range(300)]
    rows = [(9, None), (7, ""), (None, " \n"), (3, "a b"), (3, "a b"), (5, "A  B"), (6, "a b c"), (None, "lone text"), (80, "long text " * 40000)]
    rows += [(30 + i, edited(words, {i * 7 + 5})) for i in range(25)] + [(20 + i, edited(words, set(range(10, 10 + 40 * i)))) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 as node", "'x' as cells", "1 as _place2")
    want = brute(rows)
    assert stays(neardup.one_of_each(docs)) == want
    assert stays(neardup.one_of_each(docs, block=3)) == want
    assert stays(neardup.one_of_each(docs, block_bytes=5000)) == want
    assert neardup.one_of_each(docs.limit(0)).collect() == []


def test_input_split_otherwise_between_reads(spark, tmp_path, monkeypatch):
    """The rows that stay don't depend on how Spark splits the files each time it reads them."""
    rows = [(i // 2, " ".join(f"w{i // 2}x{k}" for k in range(40))) for i in range(400)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(8).write.parquet(path)
    docs, links, most = spark.read.parquet(path), neardup.links, "spark.sql.files.maxPartitionBytes"

    def regrouped(*args):
        spark.conf.set(most, "4k")
        return links(*args)

    before = spark.conf.get(most)
    monkeypatch.setattr(neardup, "links", regrouped)
    try:
        spark.conf.set(most, "128m")
        got = [r.doc_id for r in neardup.one_of_each(docs).collect()]
    finally:
        spark.conf.set(most, before)
    assert sorted(got) == list(range(200))
