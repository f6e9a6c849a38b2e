import random
import re

import duckdb

from tamis.llm import mixing
from tamis.llm.common import documents

SCHEMA = "doc_id long, source string, text string, size string, target int, rank int"


def frame(spark, rows):
    """Documents with extra columns of clashing names."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)


def goals(sizes, weights=mixing.WEIGHTS, most=3):
    """Targets by resharing the excess until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, out = set(), {}
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        out = {s: most * sizes[s] if s in full else left * weight[s] / rest for s in names}
        above = {s for s in names if s not in full and out[s] > most * sizes[s]}
        if not above:
            return out
        full |= above


def held(rows, docs):
    """The rules that any mix keeps."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest, taken = {}, {}, {}
    for _, source, text in docs:
        sizes[source] = sizes.get(source, 0) + count(text)
        largest[source] = max(largest.get(source, 0), count(text))
    want = goals(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.source or "", r.size) for r in rows) == sorted((i is None, i or 0, s or "", count(t)) for i, s, t in docs)
    for r in rows:
        assert 0 <= r.copies <= 3 and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target) and r.source_size == sizes[r.source]
        assert r.size or not r.copies
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
    for source, n in taken.items():
        assert abs(n - want[source]) <= largest[source]
        if want[source] == 3 * sizes[source]:
            assert n == 3 * sizes[source]


def test_documents_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    held(mixing.mix(docs).collect(), [(r.doc_id, r.source, r.text) for r in docs.collect()])
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    found = mixing.op13_source_mixing(spark, sf_dir)
    want = db.execute(mixing.OP13_SQL)
    assert found.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())


def test_full_sources_and_odd_rows(spark):
    rng = random.Random(4)
    docs = [(i, "a", "w " * rng.randint(1, 5)) for i in range(6)]  # weight 5, few words: full
    docs += [(100 + i, "b", "w " * rng.randint(0, 90)) for i in range(200)] + [(300 + i, None, "w\tw w") for i in range(50)]
    docs += [(None, "b", "w " * 7), (None, "b", "w " * 7), (9, "c", None), (9, "c", ""), (10, "", "w " * 30_000), (11, "d", "w w"), (11, "d", "w w")]
    df = frame(spark, docs)
    rows = mixing.mix(df).collect()
    held(rows, docs)
    assert {r.copies for r in rows if r.source == "a"} == {3} and {r.target for r in rows if r.source == "c"} == {0.0}
    again = mixing.mix(df.repartition(7)).collect()  # other partitions, the same mix
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_only_source_takes_all(spark):
    docs = [(i, "only", "w " * (i % 5)) for i in range(40)]
    rows = mixing.mix(frame(spark, docs)).collect()
    assert all(r.copies == bool(r.size) for r in rows)


def test_copies_are_rows(spark):
    mixed = mixing.mix(frame(spark, [(i, "ab"[i % 7 == 0], "w " * (i + 1)) for i in range(50)]))
    rows = mixing.emitted(mixed).collect()
    want = [(r.doc_id, k) for r in mixed.collect() for k in range(1, r.copies + 1)]
    assert sorted((r.doc_id, r.copy) for r in rows) == sorted(want)


def test_empty_table(spark):
    df = frame(spark, [(1, "a", "w")]).limit(0)
    assert mixing.mix(df).collect() == [] and mixing.emitted(mixing.mix(df)).collect() == []


def test_texts_without_words(spark):
    rows = mixing.mix(frame(spark, [(1, "a", None), (2, "b", " \n")])).collect()
    assert [(r.size, r.target, r.copies) for r in rows] == [(0, 0.0, 0)] * 2


def test_a_source_in_many_partitions(spark):
    """Ranks of a source that holds nearly all rows come from many partitions, and are the plain ranks."""
    from pyspark.sql import functions as F

    from tamis.llm.common import numbered

    rows = spark.range(5000).select(F.when(F.col("id") % 9 > 0, "hot").alias("source"), F.pmod(F.xxhash64("id"), F.lit(300)).alias("size"), "id")
    found = numbered(rows, ["source"], [F.col("size"), F.col("id").desc()], "rank").collect()
    for source in ("hot", None):
        own = sorted((r for r in found if r.source == source), key=lambda r: (r.size, -r.id))
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1))
