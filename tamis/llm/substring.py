"""Substring deduplication by seed and extend.

A window is `window` consecutive words of a document. A word goes if a window over it also stands in a document with
a smaller doc_id; runs of such windows are the maximal repeats over the length threshold.

Seeds. Winnowing picks from each window the 5-word gram with the least hash, its anchor; the choice depends on the
window's words alone, so equal windows have equal anchors, and one gram in five or so is one. A document's windows on
one anchor form its context: the anchor with the words on both sides as far as those windows reach.

Extension. Occurrences of an anchor meet by its hash. Equal contexts match on both sides throughout: all but the
smallest document's windows there are repeats. Where an anchor has several contexts, one document of each is taken
back to its text and the words around the anchor are compared window by window, again with the smallest document
that has the same window.

Skew. Every task first settles what it can by itself: of the occurrences of one context (or window) that it reads,
only those of the smallest document travel, the others are repeats already. So a passage in a third of all documents
sends a row per task. Anchors that stand between ever new words (the ends of a common line) are found on a bounded
sample of documents and are dealt out by context as well.

Equality. Contexts are equal if their anchors' and their own 64-bit hashes are, windows if two independent 64-bit
hashes are: 128 bits in all, so that no two of even 10^15 different ones are expected to meet. Words themselves aren't
carried along.

Cases: a null or empty text has no words; texts shorter than a window keep all words; rows that share a doc_id are
told apart by the 64-bit hash of their text and never remove each other's words (repeated rows are treated alike); rows
with a null doc_id neither lose words nor take part; a very long text is read whole; extra columns of any name are
ignored or carried along; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import U64, documents, mix, text_bytes, written

WINDOW, GRAM = 13, 5
#: Occurrences that a task gathers before it settles and sends them.
BATCH_ROWS = 1_000_000
#: Documents read to find anchors with ever new contexts, the share of documents that makes one hot, and how many
#: partitions such an anchor is dealt to.
SAMPLE_DOCS, HOT_SHARE, HOT_PARTS = 2000, 1 / 200, 64

_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.multiply.accumulate(np.r_[U64(1), np.full(max(n, 1 << 15), base, U64)])
    return [p[:n] for p in _powers]


class Hashed:
    """A text's words, with the hash of any run of them in constant time."""

    def __init__(self, text: bytes):
        words = text.split()
        self.n = len(words)
        self.words = np.array([xxh64_intdigest(x) for x in words], U64)
        up, self.down = powers(self.n + 1)
        self.sums = np.r_[U64(0), np.cumsum(self.words * up[:-1], dtype=U64)]

    def runs(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + size] - self.sums[start]) * self.down[start] + np.asarray(size).astype(U64))

    def second_runs(self, start: np.ndarray, size: int) -> np.ndarray:
        """Another hash of runs, from other hashes of the words."""
        sums = np.r_[U64(0), np.cumsum(mix(self.words ^ _BASE) * powers(self.n + 1)[0][:-1], dtype=U64)]
        return mix((sums[start + size] - sums[start]) * self.down[start] ^ _BASE)

    def contexts(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each anchor: its hash, its context's hash, and its first and last window."""
        if self.n < window:
            return (np.empty(0, U64),) * 2 + (np.empty(0, np.int64),) * 2
        grams = self.runs(np.arange(self.n - gram + 1), gram)
        at = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(1) + np.arange(self.n - window + 1)
        edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[edge[1:], len(at)] - 1
        anchor = at[edge]
        whole = self.runs(edge, last - edge + window)
        return grams[anchor], mix(whole + (anchor - edge).astype(U64)), edge, last


def pack(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """First window, and the number of windows less one (which is less than the words of a window)."""
    return first << 8 | (last - first)


def tag_of(text: bytes) -> int:
    """A signed hash of the text, which tells rows of one doc_id apart; Spark's xxhash64."""
    h = xxh64_intdigest(text, 42)
    return h - (1 << 64) if h >> 63 else h


#: Rows on their way: a key to meet by, a finer key, the document, its place, and what it is.
MEET = "a bigint, c bigint, doc bigint, tag bigint, place bigint, kind tinyint"
OPEN, SETTLED, HOT = 0, 1, 2  # to be compared, a repeat already, to be compared and of a hot anchor
FOUND = "doc bigint, tag bigint, place bigint, kind tinyint"  # SETTLED: a repeat; OPEN: a context to be taken back to its text


def batch_of(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    kinds = {"kind": pa.int8()}
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int8) if k in kinds else v.view(np.int64)) for k, v in columns.items()], list(columns))


def settle(a: np.ndarray, c: np.ndarray, doc: np.ndarray, tag: np.ndarray, place: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    """Of the rows of one key, those after the smallest document are repeats; these travel under a key of their own."""
    order = np.lexsort((doc, c, a))
    new = np.r_[True, (c[order][1:] != c[order][:-1]) | (a[order][1:] != a[order][:-1])]
    first = np.empty_like(doc)  # in the rows' own order, in which a document's rows follow one another
    first[order] = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))]
    repeat = doc > first
    a = np.where(repeat, mix(doc.view(U64) * _BASE + place.view(U64)), a)
    return batch_of({"a": a, "c": np.where(repeat, U64(0), c), "doc": doc, "tag": tag, "place": place, "kind": np.where(repeat, SETTLED, kind)})


def gathered(parts: Iterator[tuple], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= rows:
            yield settle(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if size:
        yield settle(*map(np.concatenate, zip(*held)))


def meet(rows: DataFrame) -> DataFrame:
    """Brings rows of one key together, smallest document first, and reads them as a stream.

    Gives repeats, and the smallest document's rows for keys that have several finer keys. A key may have any number
    of rows; only the rows of its first finer key in one document are held back until a second one shows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_a = last_c = first_doc = None
        seen, held = 0, []

        def found(doc: np.ndarray, tag: np.ndarray, place: np.ndarray, kind: int) -> pa.RecordBatch:
            return batch_of({"doc": doc, "tag": tag, "place": place, "kind": np.full(len(doc), kind)})

        for batch in batches:
            a, c, doc, tag, place, kind = (x.to_numpy() for x in batch.columns)
            if (done := kind == SETTLED).any():
                yield found(doc[done], tag[done], place[done], SETTLED)
                a, c, doc, tag, place, kind = (x[~done] for x in (a, c, doc, tag, place, kind))
            if not len(a):
                continue
            i = np.arange(len(a))
            new_a = np.r_[last_a is None or a[0] != last_a, a[1:] != a[:-1]]
            new_c = new_a | np.r_[last_c is None or c[0] != last_c, c[1:] != c[:-1]]
            start = np.maximum.accumulate(np.where(new_c, i, -1))
            first = np.where(start >= 0, doc[start], first_doc if first_doc is not None else 0)
            repeat = doc > first
            if repeat.any():
                yield found(doc[repeat], tag[repeat], place[repeat], SETTLED)
            group = np.cumsum(new_a)  # 0: goes on from the batch before
            contexts = np.cumsum(new_c)
            before = np.r_[-seen, contexts[new_a] - 1][group]
            ordinal = contexts - before
            most = np.zeros(group[-1] + 1, np.int64)
            most[group] = ordinal  # ascending within a group, so the last one stays
            several = (most >= 2)[group] | (kind == HOT)
            take = several & ~repeat
            if held and (most[0] >= 2 if group[0] == 0 else False):
                yield found(*map(np.concatenate, zip(*held)), OPEN)
                held = []
            if group[-1] > 0:
                held = []
            if take.any():
                yield found(doc[take], tag[take], place[take], OPEN)
            wait = ~several & ~repeat & (group == group[-1])
            if wait.any():
                held.append((doc[wait], tag[wait], place[wait]))
            last_a, last_c, first_doc, seen = a[-1], c[-1], first[-1], int(ordinal[-1])

    return rows.repartition("a").sortWithinPartitions("a", "c", "doc", "tag", "place").mapInArrow(run, FOUND)


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        yield from ((d, t) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if d is not None)


def hot_anchors(docs: DataFrame, window: int, gram: int) -> np.ndarray:
    """Anchors of many documents in a sample by hash of all rows, long texts too; counted by Spark.

    No more than its texts have anchors, divided by the documents that make one hot.
    """
    rows = docs.filter(F.col("doc_id").isNotNull())
    one_in = max(1, rows.count() // SAMPLE_DOCS)
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(one_in)) == 0).select("doc_id", text_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text in texts_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(Hashed(text).contexts(window, gram)[0]).view(np.int64))], ["a"])

    least = max(8, int(SAMPLE_DOCS * HOT_SHARE))
    found = sample.mapInArrow(run, "a bigint").groupBy("a").count().filter(F.col("count") >= least).select("a").collect()
    return np.sort(np.array([r.a for r in found], np.int64).view(U64))


def anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs, window, gram))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value

        def parts() -> Iterator[tuple]:
            for doc, text in texts_of(batches):
                a, c, first, last = Hashed(text).contexts(window, gram)
                if len(a):
                    is_hot = known[np.minimum(np.searchsorted(known, a), len(known) - 1)] == a if len(known) else np.zeros(len(a), bool)
                    a = np.where(is_hot, mix(a + c % U64(HOT_PARTS)), a)
                    yield a, c, np.full(len(a), doc), np.full(len(a), tag_of(text)), pack(first, last), np.where(is_hot, HOT, OPEN)

        yield from gathered(parts())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()).mapInArrow(run, MEET)


def window_rows(docs: DataFrame, contexts: DataFrame, window: int) -> DataFrame:
    """The windows of contexts (doc, tag, place), from the documents' texts."""
    places = contexts.groupBy("doc", "tag").agg(F.collect_list("place").alias("places"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), text_bytes()).withColumn("tag", F.xxhash64("text"))
    with_text = texts.join(places, ["doc", "tag"]).select("doc", "tag", "text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in batches:
                for doc, tag, text, places in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3)):
                    p = places.values.to_numpy()
                    size = (p & 0xFF) + 1
                    at = np.unique(np.repeat(p >> 8, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
                    if len(at):
                        hashed = Hashed(text)
                        yield hashed.runs(at, window), hashed.second_runs(at, window), np.full(len(at), doc), np.full(len(at), tag), pack(at, at), np.zeros(len(at), np.int64)

        yield from gathered(parts())

    return with_text.mapInArrow(run, MEET)


def removed(docs: DataFrame, repeats: DataFrame, window: int, carry: str = "doc_id") -> DataFrame:
    """Per row of docs: the column `carry`, n_words, spans (of words, merged), kept_words (joined by one blank)."""
    places = repeats.groupBy("doc", "tag").agg(F.collect_list("place").alias("places"))
    kind = docs.schema[carry].dataType.simpleString()
    texts = docs.select(F.col(carry), text_bytes(), F.col("doc_id").cast("long").alias("doc")).withColumn("tag", F.xxhash64("text"))
    joined = texts.join(places, ["doc", "tag"], "left").select(carry, "text", "places")
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2)):
                words, found = text.split(), []
                p = np.sort(places.values.to_numpy()) if places.is_valid else ()
                if len(p):
                    first, end = p >> 8, (p >> 8) + (p & 0xFF) + window
                    reach = np.maximum.accumulate(end)
                    cut = np.flatnonzero(np.r_[True, first[1:] > reach[:-1]])
                    found = list(zip(first[cut].tolist(), reach[np.r_[cut[1:], len(p)] - 1].tolist()))
                kept, at = [], 0
                for a, b in found:
                    kept += words[at:a]
                    at = b
                out[0].append(len(words))
                out[1].append([{"start": a, "end": b} for a, b in found])
                out[2].append(b" ".join(kept + words[at:]).decode())
            columns = [pa.array(v, t) for v, t in zip(out, (pa.int64(), spans, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [carry, "n_words", "spans", "kept_words"])

    return joined.mapInArrow(run, f"{carry} {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, kept_words string")


def find_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, tag, place) of windows that a smaller document has too."""
    seeds = written(meet(anchor_rows(docs, window, gram)), "substring-seeds")
    whole = seeds.filter(F.col("kind") == SETTLED)
    partial = meet(window_rows(docs, seeds.filter(F.col("kind") == OPEN), window)).filter(F.col("kind") == SETTLED)
    partial = written(partial.select("doc", "tag", "place"), "substring-windows")
    return whole.select("doc", "tag", "place").union(partial)


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    return removed(docs, find_repeats(docs, window, gram), window)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """`docs` with the words of repeats taken out of its texts; rows without any are unchanged, rows that have no
    word left go. A column n_chars follows the text."""
    wrapped = docs.select("doc_id", "text", F.struct("*").alias("_row"))
    found = removed(wrapped, find_repeats(docs, window, gram), window, "_row").filter("kept_words <> '' OR size(spans) = 0")
    changed = F.size("spans") > 0
    new = {"text": F.when(changed, F.col("kept_words")).otherwise(F.col("_row.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length("kept_words").cast(kind)).otherwise(F.col("_row.n_chars"))
    return found.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(documents(spark, sf_dir))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("kept_words", 256).alias("kept_sha256"))
