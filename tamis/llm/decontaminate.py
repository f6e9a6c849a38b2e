"""Benchmark decontamination with an FM-index per shard of training documents.

A shard is as many documents of one task as hold about SHARD_WORDS words. Its text is indexed over the benchmark's
alphabet: a word that no benchmark item contains can't be part of an occurrence, so it only separates runs, and runs
shorter than the shortest test phrase are left out. Every test phrase (13 consecutive words of an item; the whole of
a shorter item) goes through backward search; the occurrences found are located by sampled suffix positions, mapped
back to documents, and merged to removal spans.

The phrases of up to BLOCK_BYTES of benchmark text are broadcast. A longer benchmark is written to the shared folder in
blocks of about that size; each task then reads block after block for a shard it holds, and merges their spans, so
documents are read once and never shuffled, and neither driver nor task holds more than a block.

Cases: a null or empty text has no words and is not contaminated; an item without words has no phrase; an item with
a null item_id marks words but is not counted or named as an item; repeated documents and items are treated each
for itself; an empty benchmark marks nothing; a document of more words than a shard is a shard of its own; extra columns of any
name are ignored or carried along; an empty table of documents gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_BYTES, LOWER_BYTES, documents, file_system, scratch_dir, text_bytes
from .fmindex import FMIndex

PHRASE_WORDS, SHARD_WORDS, BLOCK_BYTES = 13, 1_000_000, 4_000_000
_word = re.compile(rb"[0-9a-z\x80-\xff]+")


class Phrases:
    """The test phrases of some benchmark items, as symbols of their own alphabet (0 ends a text, 1 separates)."""

    def __init__(self, items: list[tuple], phrase_words: int):
        self.alphabet: dict[bytes, int] = {}
        owners: dict[tuple, set] = {}
        for item_id, text in items:
            words = [self.alphabet.setdefault(w, len(self.alphabet) + 2) for w in (text or "").encode().translate(ALNUM_BYTES).split()]
            n = min(len(words), phrase_words)
            for i in range(len(words) - n + 1 if words else 0):
                owners.setdefault(tuple(words[i : i + n]), set()).update({str(item_id)} if item_id is not None else ())
        self.shortest = min(map(len, owners), default=0)
        self.groups = []  # by length: phrases as rows, and the items of each
        for n in sorted({len(p) for p in owners}):
            same = [p for p in owners if len(p) == n]
            self.groups.append((n, np.array(same, np.int64), [sorted(owners[p]) for p in same]))


def shard_hits(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list, set]]:
    """For each text of a shard: its number of words, the merged spans of words hit, the items found in it."""
    out, symbols, docs, places, at = [], [], [], [], 0
    for k, text in enumerate(texts):
        words = text.translate(ALNUM_BYTES).split()
        out.append((len(words), [], set()))
        s = np.fromiter(map(phrases.alphabet.get, words, iter(lambda: 1, 0)), np.int64, len(words))
        if not phrases.shortest or not (s > 1).any():
            continue
        known = np.r_[False, s > 1, False]
        edge = np.flatnonzero(known[1:] != known[:-1])
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a >= phrases.shortest:
                symbols += [s[a:b], [1]]
                docs.append((at, k, a))
                at += b - a + 1
    if not docs:
        return out
    index = FMIndex(np.concatenate(symbols), len(phrases.alphabet) + 2)
    begin, doc, word = (np.array(x) for x in zip(*docs))
    for n, rows, items in phrases.groups:
        low, high = index.search(rows)
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        counts = (high - low)[found]
        which = np.repeat(found, counts)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
        positions = index.locate(low[which] + inner)
        run = np.searchsorted(begin, positions, "right") - 1
        starts = word[run] + positions - begin[run]
        for k, start, p in zip(doc[run].tolist(), starts.tolist(), which.tolist()):
            out[k][1].append((start, start + n))
            out[k][2].update(items[p])
    return [(n, merge(spans), items) for n, spans, items in out]


def merge(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words in the spans, and without what stands between two words of one span."""
    words = [m.span() for m in _word.finditer(text.translate(LOWER_BYTES))]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return b"".join([*out, text[at:]])


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


class Blocks:
    """The phrases of a benchmark, block by block; the last one read is kept."""

    def __init__(self, phrase_words: int, items: list[tuple] | None = None, path: str = "", n: int = 1):
        self.phrase_words, self.path, self.n = phrase_words, path, n
        self.held = (0, Phrases(items, phrase_words)) if items is not None else (None, None)

    def __iter__(self) -> Iterator[Phrases]:
        for k in range(self.n):
            if self.held[0] != k:
                self.held = (k, Phrases(self.read(k), self.phrase_words))
            yield self.held[1]

    def read(self, k: int) -> list[tuple]:
        import pyarrow.dataset as ds
        from pyarrow.fs import FileType

        files, root = file_system(f"{self.path}/block={k}")
        if files.get_file_info(root).type == FileType.NotFound:  # no item fell to this block
            return []
        table = ds.dataset(root, filesystem=files, format="parquet").to_table(["item_id", "text"])
        return list(zip(table["item_id"].to_pylist(), table["text"].to_pylist()))


def shard_rows(ids: list, key: pa.DataType, texts: list[bytes], blocks: Blocks, clean: bool) -> pa.RecordBatch:
    hits = None
    for phrases in blocks:
        found = shard_hits(texts, phrases)
        hits = found if hits is None else [(n, a + b, x | y) for (n, a, x), (_, b, y) in zip(hits, found)]
    spans = [merge(h[1]) for h in hits]
    columns = [
        pa.array(ids, key),
        pa.array([h[0] for h in hits], pa.int64()),
        pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], SPANS),
        pa.array([sorted(h[2]) for h in hits], pa.list_(pa.string())),
    ]
    names = ["doc_id", "n_words", "spans", "items"]
    if clean:
        columns.append(pa.array([without(t, s).decode() if s else None for t, s in zip(texts, spans)], pa.string()))
        names.append("clean_text")
    return pa.RecordBatch.from_arrays(columns, names)


def blocks_of(benchmark: DataFrame, phrase_words: int, block_bytes: int) -> Blocks:
    sized = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, math.ceil((sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    if n == 1:
        return Blocks(phrase_words, [tuple(r) for r in sized.collect()])
    path = scratch_dir(benchmark.sparkSession, "benchmark")
    dealt = sized.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    dealt.repartition("block").write.partitionBy("block").parquet(path)
    return Blocks(phrase_words, path=path, n=n)


def find_contamination(docs: DataFrame, benchmark: DataFrame, phrase_words: int = PHRASE_WORDS, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, clean: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, spans (of words, merged), items (found in it); and, if `clean`, clean_text: what
    is left without the spans (null if there are none)."""
    shared = docs.sparkSession.sparkContext.broadcast(blocks_of(benchmark, phrase_words, block_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = shared.value
        ids, texts, size, key = [], [], 0, pa.int64()
        for batch in batches:
            key = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc_id)
                texts.append(text)
                size += len(text) // 6 + 1
                if size >= shard_words:
                    yield shard_rows(ids, key, texts, blocks, clean)
                    ids, texts, size = [], [], 0
        if ids:
            yield shard_rows(ids, key, texts, blocks, clean)

    return docs.select("doc_id", text_bytes()).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}" + ", clean_text string" * clean)


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated: hit words make up a twentieth of all words or more."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumns(
        {
            "n_hit": n_hit,
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join(F.array_sort("items"), ","), 256),
        }
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs`, unchanged, that aren't contaminated."""
    wrapped = docs.select(F.struct("*").alias("doc_id"), "text")
    return judged(find_contamination(wrapped, benchmark)).filter("NOT contaminated").select("doc_id.*")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
