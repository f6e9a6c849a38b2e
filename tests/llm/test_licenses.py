import random
import re
import time

import numpy as np

from tamis.llm import licenses
from tamis.llm.common import documents


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def distances(pattern, texts):
    """Least edits between the pattern and any part of each text (Sellers), all texts at once."""
    size = max(map(len, texts))
    chars = np.zeros((len(texts), size), np.uint32)
    for row, t in zip(chars, texts):
        row[: len(t)] = [ord(c) for c in t]
    row = np.tile(np.arange(len(pattern) + 1, dtype=np.int16), (len(texts), 1))
    best, places = row[:, -1].copy(), np.arange(len(pattern) + 1)
    code = np.array([ord(c) for c in pattern])
    for j in range(size):
        step = np.zeros_like(row)
        step[:, 1:] = np.minimum(row[:, :-1] + (code != chars[:, j, None]), row[:, 1:] + 1)
        row = np.minimum.accumulate(step - places, axis=1) + places  # insertions, along the pattern
        best = np.minimum(best, row[:, -1])
    return best.tolist()


def brute(docs, notices=licenses.NOTICES):
    out, split = [], [words(t) for _, t in docs]
    joined = [f" {' '.join(w)} " for w in split]
    least = {}  # texts of like length together
    order = sorted(range(len(docs)), key=lambda i: len(joined[i]))
    for p in notices:
        least[p] = [0] * len(docs)
        for k in range(0, len(order), 40):
            for i, d in zip(order[k : k + 40], distances(f" {p} ", [joined[i] for i in order[k : k + 40]])):
                least[p][i] = d
    for at_doc, (doc_id, _) in enumerate(docs):
        w = split[at_doc]
        places = [(i, label) for p, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        base = {x for _, x in places}
        labels, score = set(base), float(bool(base))
        for p, label in notices.items():
            k = min(licenses.MOST_ERRORS, len(p) // licenses.CHARS_PER_ERROR)
            if (d := least[p][at_doc]) <= k:
                labels.add(label)
                score = max(score, 1 - d / (len(p) + 2))
        at = [i for i, _ in places]
        out.append((doc_id, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), round(score, 9)))
    return sorted(out, key=str)


def result(df):
    return sorted(((*r[:7], round(r[7], 9)) for r in df.collect()), key=str)


def test_documents_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert any(w[6] for w in want) and max(w[1] for w in want) > 2000
    found = licenses.op10_license_scan(spark, sf_dir)
    assert result(found) == want
    assert all(s.start_word < s.end_word <= r.n_words and s.label in r.labels.split(",") for r in found.collect() for s in r.spans)


def test_edited_notices(spark):
    rng, docs = random.Random(3), [(0, None), (None, "CC-BY! cc by"), (1, ""), (2, "all rights reserved all rights reserved"), (2, "all rights reserved all rights reserved"), (3, "x " * 4000 + "General Public License")]
    for i in range(120):
        t = list("ab cd " + rng.choice(list(licenses.NOTICES)) + " ef gh")
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", " ", "é"])
        docs.append((100 + i, "".join(t)))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'z' as label", "0 as n_words")
    assert result(licenses.scan_licenses(df).drop("spans")) == brute(docs)
    assert licenses.scan_licenses(df.limit(0)).collect() == []


def test_spans():
    scanner = licenses.Scanner(licenses.NOTICES, licenses.BASE)
    text = " foo released undr the mit license bar "
    ((label, a, b, errors, _),) = scanner.fuzzy(text)
    assert (label, errors, text[a:b]) == ("mit", 1, " released undr the mit license ")


def test_time_grows_with_the_hits(spark):
    began = time.time()
    n = 300_000
    (row,) = licenses.scan_licenses(spark.createDataFrame([(1, "cc by and " * n)], "doc_id long, text string")).collect()
    assert (row.n_base, row.first_word, row.last_word, row.n_words) == (n, 0, 3 * n - 3, 3 * n) and time.time() - began < 60
