import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tamis.llm import classifier
from tamis.llm.common import documents


def simulated(rng, n, share, right, wrong):
    """Patterns of votes and the truth; labellers say yes with `right` on yes and with `wrong` on no, else no."""
    truth = rng.random(n) < share
    fires = rng.random((n, len(right))) < np.where(truth[:, None], right, wrong)
    return ["".join("+" if x else "-" for x in row) for row in fires], truth


@pytest.mark.parametrize("share, right, wrong", [(0.3, [0.9] * 3 + [0.6] * 3, [0.02] * 3 + [0.3] * 3), (0.1, [0.9] * 3 + [0.6] * 3, [0.02] * 3 + [0.3] * 3), (0.2, [0.7] * 6, [0.05] * 6)])
def test_label_model_recovers_the_answer(share, right, wrong):
    patterns, truth = simulated(np.random.default_rng(2), 200_000, share, right, wrong)
    model = classifier.label_model(Counter(patterns))
    assert (np.array([model.p(p) > 0.5 for p in patterns]) == truth).mean() > 0.95
    assert (model.log_odds[:3, 0] >= model.log_odds[3:, 0]).all() or len(set(right)) == 1  # it knows whom to trust


def plain_em(rows, labelled, rounds=300):
    """The same model row by row, written out."""
    k = len(rows[0])
    yes = []
    for r in rows:
        lean = r.count("+") - r.count("-")
        yes.append(0.9 if lean > 0 else 0.1 if lean < 0 else 0.5)
    for _ in range(rounds):
        rates, total = [], []
        for side in (0, 1):
            weight = [y if side == 0 else 1 - y for y in yes]
            total.append(sum(weight))
            table = []
            for j in range(k):
                row = []
                for v, prior in zip("+0-", classifier.PRIOR[side]):
                    own = classifier.LABELLED_WEIGHT * sum(r[j] == v for r in labelled[side])
                    n = total[side] + classifier.PSEUDO + classifier.LABELLED_WEIGHT * len(labelled[side])
                    row.append((sum(w for w, r in zip(weight, rows) if r[j] == v) + classifier.PSEUDO * prior + own) / n)
                table.append(dict(zip("+0-", row)))
            rates.append(table)
        new = []
        for r in rows:
            odds = (total[0] + 1) / (total[1] + 1)
            for j, v in enumerate(r):
                odds *= rates[0][j][v] / rates[1][j][v]
            new.append(odds / (1 + odds))
        done = max(abs(a - b) for a, b in zip(new, yes)) < 1e-9
        yes = new
        if done:
            break
    return yes


@pytest.mark.parametrize("with_labels", [False, True])
def test_same_as_plain_em(with_labels):
    rng = np.random.default_rng(4)
    rows = ["".join(rng.choice(list("+0-"), p=[0.3, 0.2, 0.5] if t else [0.05, 0.3, 0.65]) for _ in range(4)) for t in rng.random(400) < 0.4]
    labelled = (rows[:30], rows[200:260]) if with_labels else ([], [])
    model = classifier.label_model(Counter(rows), tuple(dict(Counter(x)) for x in labelled), rounds=50)
    assert np.allclose([model.p(r) for r in rows], plain_em(rows, labelled, 50), atol=1e-9)


def test_scorer_is_the_plain_gradient():
    rng = np.random.default_rng(5)
    rows, targets = [np.unique(rng.integers(0, 20, 6)) for _ in range(40)], rng.random(40)
    w, squares = np.zeros(21), np.full(21, 1e-6)
    for _ in range(classifier.ROUNDS):
        g = 1e-4 * w / 40
        g[20] = 0
        for r, y in zip(rows, targets):
            p = 1 / (1 + np.exp(-(sum(w[i] for i in r) / len(r) ** 0.5 + w[20])))
            e = (0.5 / targets.mean() if y > 0.5 else 0.5 / (1 - targets.mean())) * (p - y) / 40
            for i in r:
                g[i] += e / len(r) ** 0.5
            g[20] += e
        squares += g**2
        w -= 0.5 * g / np.sqrt(squares)
    assert np.allclose(classifier.train_scorer(rows, targets, 20), w)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text))


def votes_of(text):
    """The votes of every question, written out; no lexicon."""
    say = lambda yes, no: "+" if yes else "-" if no else "0"
    words, units = words_of(text), re.findall(r"[^\x20\x09-\x0D]+", text)
    n, size = len(words), max(1, len(text.encode()))
    symbols = sum(c in "#*$%&|<>{}\\~^=@_+" for c in text)
    share = lambda test: sum(map(test, units)) / max(1, len(units))
    function = sum(w.encode() in classifier.FUNCTION_WORDS for w in words) / max(1, n)
    bare, mixed = share(lambda u: not re.search(r"[0-9A-Za-z\x80-\U0010ffff]", u)), share(lambda u: re.search(r"[#*$%&|<>{}\\~^=@_+]", u) is not None)
    noise = say(symbols > 0.03 * size, symbols < 0.005 * size) + say(function < 0.05, function > 0.15) + say(bare > 0.05, bare < 0.01) + say(mixed > 0.1, mixed < 0.02)
    loud = sum(bool(re.search("[A-Z]", u)) and not re.search("[a-z]", u) for u in units) / max(1, n)
    small, capitals = len(re.findall("[a-z]", text)), len(re.findall("[A-Z]", text))
    marks, runs = text.count("!"), text.count("!!")
    shouting = say(capitals > 0.4 * max(1, small), capitals < 0.1 * max(1, small)) + say(loud > 0.3, loud < 0.05) + say(marks > 0.1 * max(1, n), marks <= 0.02 * n) + say(runs > 0.02 * n, runs == 0)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated, variety = 1 - len(set(lines)) / max(1, len(lines)), len(set(words)) / max(1, n)
    top = max(Counter(words).values(), default=0) / max(1, n)
    pairs = len({(a, b) for a, b in zip(words, words[1:])}) / max(1, n - 1)
    repetition = say(repeated > 0.3, repeated < 0.05) + say(n > 20 and variety < 0.2, variety > 0.35) + say(n > 20 and top > 0.15, n <= 20 or top < 0.1) + say(n > 20 and pairs < 0.5, n <= 20 or pairs > 0.8)
    hits, english = [sum(w.encode() in s for w in words) for s in classifier.INSULTS], 20 * sum(w.encode() in classifier.ENGLISH for w in words) > n
    total, part = sum(hits), sum(hits) / max(1, n)
    toxic = "".join(say(h > 0, english) for h in hits) + say(total >= 2, english and not total) + say(part > 0.003, english and part < 0.001) + "0000"
    return ["++++" if not n else noise, shouting, repetition, toxic]


def test_query_is_the_brute_force(spark, sf_dir):
    """The whole table: lexicon, patterns, posteriors and scores from plain loops over all texts."""
    texts = {r.doc_id: (r.text or "").encode() for r in documents(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    some = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 2 == 0]
    assert len(some) < 0.95 * classifier.LABELLED_DOCS and len(texts) < 0.95 * classifier.TRAIN_DOCS  # all are in the samples

    def parts(text):
        """(kind, piece) of every word and of its first four and seven bytes, if it has more."""
        words = {w.encode() for w in words_of(text.decode())}
        return {(0, w) for w in words} | {(k, w[:n]) for k, n in ((1, 4), (2, 7)) for w in words if len(w) > n}

    sets = {i: parts(t) for i, t in texts.items()}
    known = [r.doc_id for r in some]
    toxic = {r.doc_id for r in some if r.toxic}
    yes, no = (Counter(f for i in known for f in sets[i] if (i in toxic) == side) for side in (True, False))

    def odds(f, less=0):
        """Log odds of a piece from all labelled texts, or all but one that has it and isn't toxic."""
        x = math.log((yes[f] + 0.3) / (len(toxic) + 1)) - math.log((no[f] - less + 0.3) / (len(known) - len(toxic) - less + 1))
        return x if yes[f] >= classifier.LEXICON_TEXTS and x >= classifier.LEXICON_ODDS else 0.0

    def sums(found, less=0):
        kinds = [math.fsum(odds(f, less) for f in found if f[0] == k) for k in range(3)]
        return [x / math.sqrt(len(found) + 20) for x in (*kinds, math.fsum(odds(f, less) for f in found))]

    bounds = np.quantile([sums(sets[i], 1) for i in known if i not in toxic], classifier.QUANTILES, axis=0)
    lexicon = classifier.lexicon_of([classifier.pieces({p for k, p in sets[i] if not k}) for i in known], np.array([i in toxic for i in known]))
    assert {(k, p): x for k, d in enumerate(lexicon.odds) for p, x in d.items()} == {f: odds(f) for f in yes if odds(f)} and len(lexicon.odds[0]) > 3
    assert np.allclose(lexicon.bounds, bounds)
    evidence = lambda f: [(z > high) - (z <= low) for z, low, high in zip(sums(f), *lexicon.bounds)]
    part = classifier.DIMENSIONS // 3
    found = {}
    for i, t in texts.items():
        votes = [p if q != "toxic" else p[:-4] + "".join("-0+"[v + 1] for v in evidence(sets[i])) for q, p in zip(classifier.QUESTIONS, votes_of(t.decode()))]
        found[i] = (np.array(sorted({zlib.crc32(p) % part * 3 + k for k, p in sets[i]}), np.int32), votes)
    got = {r.doc_id: r for r in classifier.op2_quality_classifier(spark, sf_dir).collect()}
    for k, q in enumerate(classifier.QUESTIONS):
        labelled = tuple([found[r.doc_id][1][k] for r in some if bool(r.toxic) == side] for side in (True, False)) if q == "toxic" else ([], [])
        want = dict(zip(found, plain_em([p[k] for _, p in found.values()], labelled)))
        assert all(abs(got[i][f"{q}_label"] - want[i]) < 1e-6 for i in texts)
        weights = classifier.train_scorer([f for f, _ in found.values()], np.array([*want.values()]))
        scores = {i: 1 / (1 + np.exp(-(weights[f].sum() / max(1, len(f)) ** 0.5 + weights[-1]))) for i, (f, _) in found.items()}
        assert all(abs(got[i][f"{q}_score"] - scores[i]) < 1e-3 for i in texts)
    for r in got.values():
        assert r.kept == all(r[f"{q}_label"] < 0.5 and r[f"{q}_score"] < 0.9 for q in classifier.QUESTIONS)
        assert r.low_quality_label == max(r[f"{q}_label"] for q in classifier.LOW_QUALITY)


def test_accuracy_on_labels_kept_apart(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = [r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 2]
    docs = documents(spark, sf_dir)
    language = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = {r.doc_id: r for r in classifier.op2_quality_classifier(spark, sf_dir).collect()}
    assert len(rows) == len(language)
    caught = lambda found: sum(not rows[r.doc_id].kept for r in found) / max(1, len(found))
    print("good", caught([r for r in labels if r.quality and not r.toxic]), "low", caught([r for r in labels if not r.quality]))
    print({x: (caught([r for r in labels if r.toxic and language[r.doc_id] == x]), sum(r.toxic and language[r.doc_id] == x for r in labels)) for x in ("en", "de", "fr", "es")})
    assert caught([r for r in labels if r.quality and not r.toxic]) < 0.03
    assert caught([r for r in labels if not r.quality]) > 0.95
    for x in ("en", "de", "fr", "es"):
        assert caught([r for r in labels if r.toxic and language[r.doc_id] == x]) > 0.8, x


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, "idiot moron trash " * 3), (2, "plain words here"), (3, "word " * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "'x' as toxic", "2 as f")
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 1), (None, 1, 1), (9, 0, 0), (2, 1, 0), (2, 0, None)], "doc_id long, noise int, toxic int")
    for given in (None, labels, labels.limit(0), labels.drop("toxic")):
        got = classifier.classify(docs, classifier.fit(docs, given)).collect()
        assert len(got) == len(rows) and all(0 <= r.toxic_score <= 1 and 0 <= r.noise_label <= 1 for r in got)
        assert classifier.classify(docs.limit(0), classifier.fit(docs.limit(0), given)).collect() == []
