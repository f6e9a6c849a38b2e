from pathlib import Path
import re

import corpus_pipeline
from tamis.llm import common

from . import test_decontaminate, test_neardup, test_packing, test_quality, test_substring


def rejected(text):
    """The quality rules written out, on one text."""
    _, n, chars, symbols, dup_lines, repeats, _ = test_quality.brute(0, text)
    text = text or ""
    lines = text.split("\n")
    if n < 10 or 100 * repeats > 20 * n:
        return True
    share = lambda test: sum(map(test, text))
    dots = sum(x.rstrip(" ").endswith(("...", "…")) for x in lines)
    bullets = sum(bool(re.match("[-*•]", x.lstrip(" "))) for x in lines)
    return (
        chars < 2 * n or chars > 15 * n or 10 * symbols > 3 * n or 10 * dup_lines > 3 * len(lines) or 10 * share(str.isupper) > 5 * chars
        or 10 * share(lambda c: c in "0123456789") > 4 * chars or 10 * share(str.isalpha) < 5 * chars or 10 * text.count("!") > 3 * n
        or 10 * dots > 4 * len(lines) or 10 * bullets > 9 * len(lines)
    )


def brute(spark, rows, sf_dir):
    """doc_id and text after each of the first four stages."""
    rows = [r for r in rows if not rejected(r[1])]
    yield rows
    stay = {doc_id for _, doc_id in test_neardup.brute(rows)}
    rows = [r for r in rows if r[0] in stay]
    yield rows
    gone = {i: (n, sha) for i, _, n, sha in test_substring.brute(rows)}
    texts = []
    for i, t in rows:
        words = t.encode().split()
        texts.append((i, t if not gone[i][0] else b" ".join(x for x, k in zip(words, kept(rows, i)) if k).decode()))
    rows = [r for r in texts if r[1]]
    yield rows
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    hit = {r[0] for r in test_decontaminate.brute(rows, items) if r[5]}
    yield [r for r in rows if r[0] not in hit]


def kept(rows, doc_id, cache={}):  # noqa: B006
    key = id(rows)
    if key not in cache:
        least, out = {}, {}
        words = {i: t.encode().split() for i, t in rows}
        for i, w in words.items():
            for k in range(len(w) - 12):
                g = tuple(w[k : k + 13])
                least[g] = min(i, least.get(g, i))
        for i, w in words.items():
            keep = [True] * len(w)
            for k in range(len(w) - 12):
                if least[tuple(w[k : k + 13])] < i:
                    keep[k : k + 13] = [False] * 13
            out[i] = keep
        cache[key] = out
    return cache[key][doc_id]


def test_stages_and_run(spark, sf_dir):
    docs = common.documents(spark, sf_dir)
    columns, sizes = docs.columns, [docs.count()]
    want = brute(spark, [(r.doc_id, r.text) for r in docs.collect()], sf_dir)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"t-{name}")
        assert docs.columns == columns
        got = docs.collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted(next(want)), name
        assert all(r.n_chars == len(r.text) for r in got)
        sizes.append(len(got))
    assert sizes[0] > sizes[1] > sizes[2] and sizes[3] > sizes[4] > 0
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    test_packing.check([(r.doc_id, r.text) for r in got], rows)


def test_run_leaves_what_its_result_reads(spark, sf_dir):
    root = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(root.iterdir())
    found = corpus_pipeline.run(spark, sf_dir)
    left = {re.sub("-[0-9a-f]{32}$", "", p.name) for p in set(root.iterdir()) - before}
    assert left <= {"tamis-pipeline-decontaminate", "tamis-pack-pieces", "tamis-pack-counts"}
    assert found.count() > 0


def test_odd_rows(spark, sf_dir):
    passage = " ".join(f"w{i} and" for i in range(30))
    rows = [(None, None, "x"), (1, None, None), (2, "", "x"), (3, passage, "a"), (3, passage, "a"), (None, passage + " z", "b"), (5, "other words " + passage, "c"), (6, " ".join("v" + "".join("abcdefghij"[int(c)] for c in str(i)) + " the" for i in range(20000)), "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string").selectExpr("*", "'q' as n_words", "7 as places", "'r' as spans", "1 as _x")
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, sf_dir), f"t-{name}")
        none = stage(spark, docs.limit(0), sf_dir)
        assert none.collect() == [] and none.columns == out.columns
        if name != "pack":
            assert out.columns == docs.columns and out.count() > 0
            docs = out
    assert {r.doc_id for r in docs.collect()} >= {3, 6}
