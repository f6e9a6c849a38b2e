import re
from collections import Counter

import duckdb

from tamis.llm import quality
from tamis.llm.common import documents

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(doc_id, text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), len(w) < 10 or 100 * len(repeated) > 20 * len(w))


def test_table_and_sql(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = quality.op6_quality_rules(spark, sf_dir).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in rows) == sorted(brute(r.doc_id, r.text) for r in docs.collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = db.execute(quality.OP6_SQL).fetchall()
    assert sorted(got) == sorted(tuple(r) for r in rows)
    assert 0 < sum(r.kept for r in rows) < len(rows)


ODD = [
    (1, None),
    (None, ""),
    (2, "a b c d e a b c d e a"),
    (2, "a b c d e a b c d e a"),
    (3, "x\n\nx\n x\nx\r\ny\x0bz 𝒳𝒴 é"),
    (4, "same " * 50_000),
    (5, " ".join(f"w{i}" for i in range(30_000)) + " w1 w2 w3 w4 w5"),
    (6, "# * $ % & | < > ok fine words here now and then"),
]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "'q' as n_words", "1 as kept", "2 as base_failed")
    rows = quality.judge_quality(docs).collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in rows), key=str) == sorted((brute(*r) for r in ODD), key=str)
    assert all(r.kept == (r.rejected_by is None) for r in rows)
    assert quality.judge_quality(docs.limit(0)).collect() == []


def test_other_columns_stay(spark):
    names = ["_words", "_lines", "_hashes", "_windows", "_sorted", "_places", "_own_0", "_h", "a.b"]
    docs = spark.createDataFrame([(*r, *range(9)) for r in ODD], ["doc_id", "text", *names])
    rows = quality.judge_quality(docs.withColumnRenamed("a.b", "n_units").withColumnsRenamed({"_h": "a b"})).collect()
    assert all([r[c] for c in (*names[:7], "a b")] == list(range(8)) and r.n_units >= r.n_words for r in rows) and len(rows) == len(ODD)


def test_sample_is_of_all_partitions(spark):
    docs = spark.range(0, 4000, 1, 8).selectExpr("cast(id as string) as text", "1 as _h")
    for size in (500, 1999, 4000, 9000):
        got = [int(r.text) for r in quality.rule_sample(docs, size).collect()]
        assert 0.85 * min(size, 4000) <= len(got) <= size and len(got) == len(set(got))
        counts = [sum(i // 500 == k for i in got) for k in range(8)]
        assert min(counts) > 0.5 * max(counts), counts


def test_order_never_changes_what_is_kept(spark, sf_dir):
    rules = quality.default_rules()
    featured = quality.features(documents(spark, sf_dir)).cache()
    want = {r.doc_id: r.kept for r in quality.cascade(featured, sorted(rules), rules).collect()}
    assert want == {r.doc_id: r.kept for r in quality.cascade(featured, sorted(rules)[::-1], rules).collect()}
    assert sorted(quality.rule_order(documents(spark, sf_dir).select("text"), rules)) == sorted(rules)


def test_main_path_is_native(spark, sf_dir):
    plan = quality.op6_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline_keeps_long_and_unspaced_texts(spark):
    letters = str.maketrans("0123456789", "abcdefghij")
    long = " ".join(f"v{i}".translate(letters) for i in range(1_000_001))
    clean = {
        1: "".join(chr(0x4E00 + i * 37 % 5000) for i in range(120)) + "。\n" + "".join(chr(0x4E00 + i * 41 % 5000) for i in range(150)) + "。",
        2: "ひらがなとカタカナのことば、" * 3 + "あいうえおかきくけこさしすせそたちつてと。",
        3: "".join(chr(0x0E01 + i * 7 % 46) for i in range(200)),
        4: long,
    }
    bad = {5: " ".join(("xyz" * 9 + c) for c in "abcdefghijklmnop"), 6: "一二三"}
    docs = spark.createDataFrame([*clean.items(), *bad.items()], "doc_id long, text string")
    assert sorted(r.doc_id for r in quality.passing(docs).collect()) == [1, 2, 3, 4]
