import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tamis.llm import katz
from tamis.llm.common import documents


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Plain:
    """The same model from dictionaries; p(h, w) recurses as written in the module's text."""

    def __init__(self, texts, order):
        self.order = order
        tokens = [[*words(t), None] for t in texts]
        self.c = Counter(w for t in tokens for w in t)
        self.n = sum(self.c.values())
        dc = lambda c, d: (d[c] if c < len(d) else 1.0) * c
        d1 = katz.discounts(Counter(self.c.values()))
        seen = sum(dc(c, d1) for c in self.c.values())
        scale = self.n if seen < self.n * (1 - 1e-12) else self.n + 1
        self.p1 = {w: dc(c, d1) / scale for w, c in self.c.items()}
        self.never = (scale - seen) / scale
        self.share, self.back = {}, {}
        for k in range(2, order + 1):
            counts = Counter(g for t in tokens for g in self.grams(t, k))
            d = katz.discounts(Counter(counts.values()))
            after = defaultdict(dict)
            for g, c in counts.items():
                after[g[:-1]][g[-1]] = c
            for h, found in after.items():
                n, total = sum(found.values()), sum(dc(c, d) for c in found.values())
                whole = n if total < n * (1 - 1e-12) else n + 1
                unseen = 1 - sum(self.p(h[1:], w) for w in found)
                self.share[h] = {w: dc(c, d) / whole for w, c in found.items()}
                self.back[h] = (1 - total / whole) / unseen

    @staticmethod
    def grams(tokens, k):
        padded = ["<s>"] * (k - 1) + tokens
        return [tuple(padded[i : i + k]) for i in range(len(tokens))]

    def p(self, h, w):
        if not h:
            return self.p1.get(w, self.never)
        if w in self.share.get(h, {}):
            return self.share[h][w]
        return self.back.get(h, 1.0) * self.p(h[1:], w)

    def score(self, text):
        return sum(math.log10(self.p(g[:-1], g[-1])) for g in self.grams([*words(text), None], self.order))

    def base(self, text):
        return sum(math.log10((self.c.get(w, 0) + 0.5) / (self.n + 0.5 * (len(self.c) + 1))) for w in [*words(text), None])


def check(plain, rows, found):
    got = {r.doc_id: r for r in found}
    assert len(got) == len(found) == len(rows)
    for i, text in rows:
        w = [*words(text), None]
        assert (got[i].n_tokens, got[i].n_known) == (len(w), sum(x in plain.c for x in w))
        assert math.isclose(got[i].base_score, plain.base(text), rel_tol=1e-9)
        assert math.isclose(got[i].score, plain.score(text), rel_tol=1e-9)


@pytest.mark.parametrize("order, frequent", [(3, katz.FREQUENT_SHARE), (2, 1 / 300), (4, 0.9)])
def test_same_as_the_plain_model(spark, sf_dir, order, frequent):
    docs = documents(spark, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    plain = Plain([t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1], order)
    for h in [*list(plain.share)[:: len(plain.share) // 40], ("never", "a history")[: order - 1]]:
        assert abs(sum(plain.p(h, w) for w in plain.p1) + plain.p(h, "never seen") - 1) < 1e-9
    model = katz.train(docs.filter(~katz.held_out()), order, frequent)
    assert (model.tokens, model.types) == (plain.n, len(plain.c))
    check(plain, rows, katz.score(docs, model).collect())


def test_order_three_on_more_texts(spark):
    """All of sf0.01 trains, where frequent words are a small part of all; every word is a type of its own."""
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    plain = Plain([t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1], 3)
    found = katz.score(docs, katz.train(docs.filter(~katz.held_out()), 3, 1 / 5000)).collect()
    check(plain, rows, found)
    unseen = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 1]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


@pytest.mark.parametrize("order, frequent, size", [(3, 1 / 3000, 2000), (2, 1 / 300, 1000), (4, 1 / 300, 1500)])
def test_words_with_several_buckets(spark, sf_dir, order, frequent, size):
    docs = documents(spark, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    plain = Plain([t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1], order)
    model = katz.train(docs.filter(~katz.held_out()), order, frequent, size)
    assert model.layout.passes > 1 and model.layout.splits.max() > 1 and model.layout.splits.min() == 1
    check(plain, rows, katz.score(docs, model).collect())
    for k in range(2, order + 1):
        table = katz.probabilities(model, k).collect()
        assert len(table) == len({tuple(r)[:k] for r in table}) == sum(map(len, (f for h, f in plain.share.items() if len(h) == k - 1)))
        want = sorted((p, math.log10(plain.back[h])) for h, f in plain.share.items() if len(h) == k - 1 for p in f.values())
        assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for x, y in zip(sorted((r.p, r.log_backoff) for r in table), want) for a, b in zip(x, y))
    assert katz.probabilities(model, 1).count() == len(plain.c)


def test_tables_are_small(spark):
    """What training and scoring leave in the shared folder, in bytes a token."""

    def size():
        return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(spark.conf.get("spark.checkpoint.dir")) for f in files)

    docs, before = documents(spark, "/root/testdata/sf0.01"), size()
    model = katz.train(docs.filter(~katz.held_out()))
    n = sum(r.n_tokens for r in katz.score(docs, model).collect())
    print("bytes a token", (size() - before) / n)
    assert size() - before < 12 * n


def test_index():
    """Rows that share a hash are told apart, and what isn't there isn't found."""
    a = np.array([5, 1, 5, 2, 1], np.int64)
    index = katz.Index([a, a * 2])
    assert sorted(zip(index.columns[0].tolist(), index.sums(np.ones(5)).tolist())) == [(1, 2.0), (2, 1.0), (5, 2.0)]
    assert (index.columns[0][index.members()] == a).all() and index.find([np.array([7, 5]), np.array([14, 11])]).tolist() == [-1, -1]
    numbers = np.array([katz.word_key(b"x"), 0, 499_999, katz.word_key(b"y")])
    assert (katz.unpacked(katz.packed(numbers), 4) == numbers).all() and len(katz.unpacked(katz.packed(numbers[:0]), 0)) == 0


def test_word_keys():
    """Every word has one key, whatever stands around it, and as many words are found as by a plain split."""
    long = ["w" * n for n in (7, 8, 9, 15, 16, 17, 63, 64, 65, 66, 200)]
    texts = ["", " \t\n\x0b\x0c\r ", "A a\x0bb\x00 b\x00\x00 b", "\u00e9\u00a0\u00c9 \x1f\u2028x", " ".join(long), " ".join(x + "v" for x in long), "end ", " END", *map(chr, range(1, 200))]
    found = [words(t) for t in texts]
    keys, sizes = katz.word_keys([t.encode() for t in texts])
    assert sizes.tolist() == list(map(len, found)) and (keys < katz.NONE).all()
    both = {(w, k) for w, k in zip((w for f in found for w in f), keys.tolist())}
    assert len(both) == len({w for w, _ in both}) == len({k for _, k in both}) and all(katz.word_key(w.encode()) == k for w, k in both)
    assert [len(x) for x in katz.word_keys([])] == [0, 0]


def test_counts_travel_as_arrays(spark):
    """Words are counted in pieces of many words, so rows between tasks don't grow with the vocabulary."""
    docs = spark.range(40).selectExpr("concat_ws(' ', transform(sequence(id * 700, id * 700 + 999), x -> concat('w', x))) text").coalesce(2)
    counts = katz.word_counts(docs)
    want = Counter(x for i in range(40) for x in range(i * 700, i * 700 + 1000))
    got = {r.w1: r.c for r in counts.collect()}
    assert got == {katz.word_key(f"w{x}".encode()): c for x, c in want.items()} | {katz.END: 40}
    assert "Aggregate" not in counts._jdf.queryExecution().executedPlan().toString()


def test_index_with_shared_hashes(monkeypatch):
    real = katz.spread
    monkeypatch.setattr(katz, "spread", lambda columns, seed=0: real(columns, seed) % np.uint64(2 if seed < 3 else 1 << 60))
    a = np.arange(40) % 7
    index = katz.Index([a, a + 1])
    assert index.seed == 3 and len(index.key) == 7 and (index.find([a, a]) == -1).all() and (index.find([a, a + 1]) >= 0).all()


def test_query(spark, sf_dir):
    rows = katz.op5_katz_scoring(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1) for r in rows)
    assert len(rows) == documents(spark, sf_dir).count() and {r.held_out for r in rows} == {True, False}


def test_odd_rows(spark):
    rows = [(1, None), (None, "a b"), (2, ""), (2, "A b\x0bc"), (2, "A b\x0bc"), (3, "zz " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "'x' as key", "2 as c", "3 as w1", "4 as about")
    plain = Plain([t for _, t in rows], 3)
    got = katz.score(docs, katz.train(docs)).collect()
    want = [(i, len(words(t)) + 1, round(plain.base(t), 6), round(plain.score(t), 6)) for i, t in rows]
    assert sorted(((r.doc_id, r.n_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got), key=str) == sorted(want, key=str)
    assert katz.score(docs.limit(0), katz.train(docs)).collect() == []
    untrained = katz.score(docs, katz.train(docs.limit(0))).collect()
    assert [r.score for r in untrained] == [0.0] * len(rows) and all(r.n_known == 0 for r in untrained)
    with pytest.raises(ValueError):
        katz.train(docs, 1)
