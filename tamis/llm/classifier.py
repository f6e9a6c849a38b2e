"""Quality classifier: heuristic labellers, a label model by expectation-maximisation, a hashed linear scorer.

Four questions are asked of each text, each by its own set of overlapping labellers: is it noise, is it shouted, does it
repeat itself (any of which is low quality), and is it toxic? Faults of one kind per question, for a label model has one
hidden answer: labellers of different faults would contradict each other. A labeller votes yes, no, or abstains. The
label model takes the labellers as independent given the unknown answer; expectation-maximisation estimates how often
each one gives each of the three votes on both kinds of text, and the share of yes, starting from the majority of votes.
It needs only how often each pattern of votes occurs, which Spark counts over all texts; what is believed beforehand has
the weight of PSEUDO texts. The posterior of each text's pattern then labels a bounded sample of texts (TRAIN_DOCS, chosen
by hash), on which alone a logistic scorer over hashed words and beginnings of words is trained; every whole text is
scored. A text is kept unless the label model or the scorer finds a fault.

Labelled rows, if there are any, do two things, from a bounded sample of them (LABELLED_DOCS rows, chosen by hash from
those whose crc32(doc_id as text) is even; the others are kept apart for tests). Words and beginnings of words that are far
more frequent in toxic texts make up a lexicon, in whatever language, with their log odds; the sums of a text's entries, by
kind and in all, are labellers of their own. And each labelled text counts in the rates as LABELLED_WEIGHT texts whose
answer is known, beside all those whose answer is inferred: a weak prior that the corpus outweighs. No scorer sees a label.

Cases: a text without words (null, empty) is noise by its labellers; ties (a posterior of one half) count as a fault, equal
hashes in a sample are told apart by nothing but the cap; repeated rows are judged each for itself; of very long texts
every word is read; null doc_ids are judged but match no label; of several labels of one doc_id the highest counts; extra
columns of any name are ignored; an empty table gives no rows; without labels, or with labels of one kind only, the
lexicon is empty and the rates are inferred alone.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, documents, text_bytes

DIMENSIONS, TRAIN_DOCS, LABELLED_DOCS, ROUNDS = 1 << 19, 6000, 4000, 40
#: A text goes if the label model finds a fault more likely than not, or the scorer is this sure of one.
SURE = 0.9
#: Texts that the prior of a labeller's rates weighs as much as, and what it says of yes, abstain and no on texts that
#: have the fault and on texts that don't.
PSEUDO, PRIOR = 3.0, ((0.2, 0.4, 0.4), (0.4, 0.4, 0.2))
#: What a labelled text weighs in the labellers' rates, against 1 for every text whose answer is inferred.
LABELLED_WEIGHT = 1.0
#: The lexicon: labelled toxic texts with an entry at least, and its least log odds.
LEXICON_TEXTS, LEXICON_ODDS = 3, 2.0
#: Shares of labelled texts that aren't toxic below which a lexicon labeller says no, and above which it says yes.
QUANTILES = 0.9, 0.99
#: Bytes of a word's beginnings that are features besides the word.
BEGINNINGS = (4, 7)

#: Frequent function words of four languages.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for on with as was by this be are from or an at les des la le et un une du que qui dans est pour par sur au"
    " der die das und den von zu mit ist im dem nicht ein eine auf el los las y en que por con para su del".encode().split()
)
ENGLISH = frozenset(b"the of and to in a is that it for on with as was by this be are from or an at".split())
#: Common English insults, in three lists that vote on their own.
INSULTS = [
    frozenset(b"idiot moron imbecile fool dumb stupid dimwit cretin brainless halfwit".split()),
    frozenset(b"trash scum filth garbage vermin clown loser pig rat maggot".split()),
    frozenset(b"pathetic worthless disgusting useless revolting vile despicable hateful contemptible loathsome".split()),
]


def _vote(yes: bool, no: bool) -> int:
    return 1 if yes else -1 if no else 0


# Bytes to delete so that units between blanks are left only where they hold what is asked for.
_BLANKS = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>{}\\~^=@_+"


def _only(kept: bytes) -> bytes:
    return bytes(x for x in range(256) if x not in kept and x not in _BLANKS)


_NOT_SYMBOLS = _only(_SYMBOLS)
_SMALL, _LETTERS = b"abcdefghijklmnopqrstuvwxyz", b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NOT_SMALL, _NOT_LETTERS = _only(_SMALL), _only(_LETTERS)
_NOT_CAPITALS = bytes(x for x in range(256) if not 65 <= x <= 90)
_NOT_SMALL_OR_BLANK = bytes(x for x in range(256) if not 97 <= x <= 122)
_NOT_ALNUM = _only(_LETTERS + b"0123456789" + bytes(range(128, 256)))


def units_with(text: bytes, others: bytes) -> int:
    """Units between blanks that hold anything but the bytes `others`."""
    return len(text.translate(None, others).split())


@dataclass
class Text:
    """A text as the labellers see it."""

    raw: bytes
    words: list[bytes]
    counts: Counter
    evidence: tuple[int, ...]  # what the lexicon's labellers vote

    def share(self, known: frozenset) -> float:
        """Share of the words that are among the known ones."""
        return self.total(known) / max(1, len(self.words))

    def total(self, known: frozenset) -> int:
        return sum([self.counts[w] for w in known & self.counts.keys()])


def noise_votes(t: Text) -> tuple[int, ...]:
    n, size = len(t.words), max(1, len(t.raw))
    if not n:
        return (1, 1, 1, 1)
    symbols, units, function = len(t.raw) - len(t.raw.translate(None, _SYMBOLS)), len(t.raw.split()), t.share(FUNCTION_WORDS)
    bare = 1 - units_with(t.raw, _NOT_ALNUM) / units
    mixed = units_with(t.raw, _NOT_SYMBOLS) / units if symbols else 0.0
    return (
        _vote(symbols > 0.03 * size, symbols < 0.005 * size),
        _vote(function < 0.05, function > 0.15),
        _vote(bare > 0.05, bare < 0.01),
        _vote(mixed > 0.1, mixed < 0.02),
    )


def shouting_votes(t: Text) -> tuple[int, ...]:
    n, capitals, small = len(t.words), len(t.raw.translate(None, _NOT_CAPITALS)), len(t.raw.translate(None, _NOT_SMALL_OR_BLANK))
    loud = 0.0  # units with letters, none of them small, per word; each has a capital
    if 20 * capitals >= n > 0:
        loud = (units_with(t.raw, _NOT_LETTERS) - units_with(t.raw, _NOT_SMALL)) / n
    marks = t.raw.count(b"!")
    runs = t.raw.count(b"!!") if marks else 0
    return (
        _vote(capitals > 0.4 * max(1, small), capitals < 0.1 * max(1, small)),
        _vote(loud > 0.3, loud < 0.05),
        _vote(marks > 0.1 * max(1, n), marks <= 0.02 * n),
        _vote(runs > 0.02 * n, runs == 0),
    )


def repetition_votes(t: Text) -> tuple[int, ...]:
    n, enough = len(t.words), len(t.words) > 20
    lines = [x for x in t.raw.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / max(1, len(lines))
    variety = len(t.counts) / max(1, n)
    top = max(t.counts.values()) / n if enough else 0.0
    pairs = len(set(zip(t.words, t.words[1:]))) / max(1, n - 1) if enough else 1.0
    return (
        _vote(repeated > 0.3, repeated < 0.05),
        _vote(enough and variety < 0.2, variety > 0.35),
        _vote(top > 0.15, top < 0.1),
        _vote(pairs < 0.5, pairs > 0.8),
    )


def toxic_votes(t: Text) -> tuple[int, ...]:
    """The insults are English, so on texts without English function words their absence says nothing."""
    found = [t.total(s) for s in INSULTS]
    total, share = sum(found), sum(found) / max(1, len(t.words))
    english = 20 * t.total(ENGLISH) > len(t.words)
    return (*(_vote(h > 0, english) for h in found), _vote(total >= 2, english and not total), _vote(share > 0.003, english and share < 0.001), *t.evidence)


QUESTIONS: dict[str, Callable] = {"noise": noise_votes, "shouting": shouting_votes, "repetition": repetition_votes, "toxic": toxic_votes}
#: Those of which any is low quality.
LOW_QUALITY = ("noise", "shouting", "repetition")
LEXICON_QUESTION = "toxic"
VOTES = "-0+"  # no, abstains, yes


def coded(votes: tuple[int, ...]) -> str:
    return "".join(VOTES[v + 1] for v in votes)


def one_hot(patterns: list[str]) -> np.ndarray:
    """patterns x labellers x (yes, abstains, no)."""
    at = np.array([[VOTES[::-1].index(v) for v in p] for p in patterns])
    return np.eye(3)[at]


@dataclass
class LabelModel:
    """log_odds: labellers x (yes, abstains, no), what a vote adds to the logarithm of the odds `prior` of yes."""

    prior: float
    log_odds: np.ndarray
    known: dict[str, float] = field(default_factory=dict)

    def p(self, pattern: str) -> float:
        if pattern not in self.known:
            z = self.prior + (one_hot([pattern])[0] * self.log_odds).sum()
            self.known[pattern] = float(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return self.known[pattern]


def label_model(counts: dict[str, float], labelled: tuple[dict[str, float], dict[str, float]] = ({}, {}), rounds: int = 300) -> LabelModel:
    """Expectation-maximisation over counted patterns of votes.

    `labelled` has the counts of patterns on texts known to be yes and known to be no. It starts from the majority of
    each pattern's votes, so that 'yes' keeps its meaning.
    """
    patterns = sorted(counts)
    if not patterns:
        return LabelModel(0.0, np.zeros((0, 3)))
    votes, n = one_hot(patterns), np.array([counts[p] for p in patterns], float)
    lean = votes[:, :, 0].sum(1) - votes[:, :, 2].sum(1)
    yes = np.select([lean > 0, lean < 0], [0.9, 0.1], 0.5)
    seen = [np.tensordot(list(c.values()), one_hot(list(c)), 1) if c else None for c in labelled]
    for _ in range(rounds):
        log_rates, share = [], []
        for weight, prior, known in zip((n * yes, n * (1 - yes)), PRIOR, seen):
            total, size = np.tensordot(weight, votes, 1) + PSEUDO * np.array(prior), weight.sum() + PSEUDO
            if known is not None:
                total, size = total + LABELLED_WEIGHT * known, size + LABELLED_WEIGHT * known[0].sum()
            log_rates.append(np.log(total / size))
            share.append((weight.sum() + 1) / (n.sum() + 2))
        model = LabelModel(float(np.log(share[0] / share[1])), log_rates[0] - log_rates[1])
        new = 1 / (1 + np.exp(-np.clip(model.prior + np.tensordot(votes, model.log_odds, 2), -30, 30)))
        done = np.abs(new - yes).max() < 1e-9
        yes = new
        if done:
            break
    return model


def pieces(words: Iterable[bytes]) -> list[set[bytes]]:
    """Distinct words, and their distinct beginnings of each size that are shorter than the word."""
    distinct = set(words)
    return [distinct, *({w[:size] for w in distinct if len(w) > size} for size in BEGINNINGS)]


def hashed(found: list[set[bytes]], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Ascending features of a text's pieces; modulo 3 the kind of piece."""
    codes = np.array(list(chain.from_iterable(map(crc32, some) for some in found)), np.int64) % (dimensions // 3) * 3
    at = 0
    for kind, some in enumerate(found):
        codes[at : at + len(some)] += kind
        at += len(some)
    return np.unique(codes).astype(np.int32)


def train_scorer(rows: list[np.ndarray], targets: np.ndarray, dimensions: int = DIMENSIONS, rounds: int = ROUNDS, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on hashed words, by full-batch AdaGrad; the last weight is the constant."""
    weights, squares = np.zeros(dimensions + 1), np.full(dimensions + 1, 1e-6)
    if not len(rows):
        return weights
    sizes = np.array([len(r) for r in rows])
    at, doc = np.concatenate(rows), np.repeat(np.arange(len(rows)), sizes)
    value = np.repeat(1 / np.sqrt(np.maximum(1, sizes)), sizes)
    balance = np.where(targets > 0.5, 0.5 / max(targets.mean(), 0.02), 0.5 / max(1 - targets.mean(), 0.02))
    for _ in range(rounds):
        z = np.bincount(doc, weights[at] * value, len(rows)) + weights[-1]
        error = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets) / len(rows)
        gradient = np.bincount(at, error[doc] * value, dimensions + 1) + decay * weights / len(rows)
        gradient[-1] = error.sum()
        squares += gradient**2
        weights -= rate * gradient / np.sqrt(squares)
    return weights


def linear(features: np.ndarray, weights: np.ndarray) -> float:
    z = weights[features].sum() / np.sqrt(max(1, len(features))) + weights[-1]
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


@dataclass
class Lexicon:
    """Log odds of words and beginnings, by kind, and the bounds of no and yes for each of four sums of them."""

    odds: list[dict[bytes, float]]
    bounds: list[list[float]]

    def __post_init__(self):
        self.known = [frozenset(d) for d in self.odds]

    @staticmethod
    def sums(odds: list[list[float]], size: int) -> list[float]:
        """Log odds of words, of both kinds of beginnings, and of all, against the square root of the text's size. Exact
        sums, so their order doesn't matter."""
        return [math.fsum(x) / math.sqrt(size + 20) for x in (*odds, chain.from_iterable(odds))]

    def votes(self, found: list[set[bytes]]) -> tuple[int, ...]:
        if not self.odds:
            return (0,) * 4
        z = self.sums([[d[p] for p in known & some] for d, known, some in zip(self.odds, self.known, found)], sum(map(len, found)))
        return tuple((x > high) - (x <= low) for x, low, high in zip(z, *self.bounds))


def lexicon_of(texts: list[list[set[bytes]]], toxic: np.ndarray) -> Lexicon:
    """The lexicon of the pieces of labelled texts. Bounds are taken on the texts that aren't toxic, each with the log odds
    that the other texts give."""
    if not toxic.any() or toxic.all():
        return Lexicon([], [])
    kinds, n_yes, n_no = range(1 + len(BEGINNINGS)), int(toxic.sum()), int((~toxic).sum())
    yes, no = ([Counter(chain.from_iterable(t[k] for t, y in zip(texts, toxic) if y == side)) for k in kinds] for side in (True, False))
    often = [{p for p, c in some.items() if c >= LEXICON_TEXTS} for some in yes]

    def odds(k: int, p: bytes, less: int) -> float:
        x = math.log((yes[k][p] + 0.3) / (n_yes + 1)) - math.log((no[k][p] - less + 0.3) / (n_no - less + 1))
        return x if x >= LEXICON_ODDS else 0.0

    sums = [Lexicon.sums([[odds(k, p, 1) for p in often[k] & t[k]] for k in kinds], sum(map(len, t))) for t, y in zip(texts, toxic) if not y]
    value = [{p: x for p in often[k] if (x := odds(k, p, 0)) > 0} for k in kinds]
    return Lexicon(value, np.quantile(np.array(sums), QUANTILES, axis=0).tolist())


class Reader:
    """Reads a text's pieces and, by question, its pattern of votes."""

    def __init__(self, questions: dict[str, Callable], lexicon: Lexicon):
        self.questions, self.lexicon = questions, lexicon

    def __call__(self, raw: bytes) -> tuple[list[set[bytes]], list[str]]:
        words = raw.translate(ALNUM_BYTES).split()
        counts = Counter(words)
        found = pieces(counts)
        text = Text(raw, words, counts, self.lexicon.votes(found))
        return found, [coded(votes(text)) for votes in self.questions.values()]


def labelled_words(texts: DataFrame, also: list[str]) -> DataFrame:
    """The distinct words of each text and the columns `also`."""
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(set(t.translate(ALNUM_BYTES).split())) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.binary())), *batch.columns[1:]], ["words", *also])

    return texts.select("text", *also).mapInArrow(run, ", ".join(["words array<binary>", *(f"{c} {kinds[c]}" for c in also)]))


def counted_patterns(texts: DataFrame, shared) -> DataFrame:
    """(question, pattern, n); each task adds up its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, counts = shared.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(zip(read.questions, read(text)[1]))
        if counts:
            q, p = zip(*counts)
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(p), pa.array(list(counts.values()), pa.int64())], ["question", "pattern", "n"])

    found = texts.select("text").mapInArrow(run, "question string, pattern string, n bigint")
    return found.groupBy("question", "pattern").agg(F.sum("n").alias("n"))


def read_texts(texts: DataFrame, shared, also: list[str]) -> DataFrame:
    """Features f, the pattern of each question, and the columns `also`."""
    names, kinds = list(shared.value.questions), dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = shared.value
        for batch in batches:
            got = [read(t) for t in batch.column(0).to_pylist()]
            columns = [pa.array([hashed(f) for f, _ in got], pa.list_(pa.int32())), *(pa.array([p[k] for _, p in got], pa.string()) for k in range(len(names)))]
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[1:]], ["f", *names, *also])

    fields = ["f array<int>", *(f"{q} string" for q in names), *(f"{c} {kinds[c]}" for c in also)]
    return texts.select("text", *also).mapInArrow(run, ", ".join(fields))


def sampled(rows: DataFrame, on: list[str], n: int, size: int) -> DataFrame:
    """About `size` of the n rows, by a hash of the columns `on`; repeated rows go together, so cap what is taken."""
    share = min(1.0, 0.95 * size / max(1, n))
    return rows.filter(F.pmod(F.xxhash64(*on, F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30)))


@dataclass
class Classifier:
    questions: dict[str, Callable]
    lexicon: Lexicon
    labels: dict[str, LabelModel]
    weights: dict[str, np.ndarray]


def fit(docs: DataFrame, labels: DataFrame | None = None, questions: dict[str, Callable] | None = None, train_docs: int = TRAIN_DOCS, labelled_docs: int = LABELLED_DOCS) -> Classifier:
    """`labels` (doc_id, and per question a column of its name, 1 for yes and 0 for no) may be absent."""
    questions = questions or QUESTIONS
    broadcast = docs.sparkSession.sparkContext.broadcast
    texts = docs.select("doc_id", text_bytes())
    lexicon, known = Lexicon([], []), {q: ({}, {}) for q in questions}
    if labels is not None:
        answers = [q for q in questions if q in labels.columns]
        some = labels.filter(F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0))
        some = some.groupBy("doc_id").agg(F.count("*").alias("n"), *(F.max(F.col(q).cast("int")).alias(f"{q}_answer") for q in answers)).drop("n")
        some = sampled(some, ["doc_id"], some.count(), labelled_docs).limit(labelled_docs)
        chosen = texts.join(F.broadcast(some), "doc_id").limit(labelled_docs)  # `some` has labelled_docs rows at most
        also = [f"{q}_answer" for q in answers]
        if LEXICON_QUESTION in answers:
            got = labelled_words(chosen, also).filter(f"{LEXICON_QUESTION}_answer IS NOT NULL").toArrow()
            lexicon = lexicon_of([pieces(w) for w in got["words"].to_pylist()], got[f"{LEXICON_QUESTION}_answer"].to_numpy() == 1)
        answered = read_texts(chosen, broadcast(Reader(questions, lexicon)), also).drop("f").toArrow()
        for q in answers:
            pairs = list(zip(answered[q].to_pylist(), answered[f"{q}_answer"].to_pylist()))
            known[q] = tuple(dict(Counter(p for p, y in pairs if y == side)) for side in (1, 0))

    shared = broadcast(Reader(questions, lexicon))
    counts: dict[str, dict[str, float]] = {q: {} for q in questions}
    for r in counted_patterns(texts, shared).collect():  # at most 3 ** (number of labellers) rows a question
        counts[r.question][r.pattern] = r.n
    models = {q: label_model(counts[q], known[q]) for q in questions}
    n = max((sum(c.values()) for c in counts.values()), default=0)
    got = read_texts(sampled(texts, ["doc_id", "text"], n, train_docs), shared, []).limit(train_docs).toArrow()
    features = [np.array(f, np.int32) for f in got["f"].to_pylist()]
    weights = {q: train_scorer(features, np.array([models[q].p(p) for p in got[q].to_pylist()])) for q in questions}
    return Classifier(questions, lexicon, models, weights)


def classify(docs: DataFrame, model: Classifier) -> DataFrame:
    """Per row: doc_id; for each question the scorer's and the label model's probability; kept."""
    read = Reader(model.questions, model.lexicon)
    shared = docs.sparkSession.sparkContext.broadcast((read, model.labels, {q: w.astype(np.float32) for q, w in model.weights.items()}))
    names = [n for q in model.questions for n in (f"{q}_score", f"{q}_label")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, labels, weights = shared.value
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for text in batch.column(1).to_pylist():
                found, patterns = read(text)
                features = hashed(found)
                for k, (q, pattern) in enumerate(zip(read.questions, patterns)):
                    out[2 * k].append(linear(features, weights[q]))
                    out[2 * k + 1].append(labels[q].p(pattern))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in out)], ["doc_id", *names])

    found = docs.select("doc_id", text_bytes()).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))
    kept = F.lit(True)
    for q in model.questions:
        kept = kept & (F.col(f"{q}_label") < 0.5) & (F.col(f"{q}_score") < SURE)
    return found.withColumn("kept", kept)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    low = {f"low_quality_{kind}": F.greatest(*(f"{q}_{kind}" for q in LOW_QUALITY)) for kind in ("score", "label")}
    return classify(docs, fit(docs, labels)).withColumns(low)
