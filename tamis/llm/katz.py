"""Katz backoff language model: Good-Turing discounted counts, exactly normalised backoff weights.

The model. Tokens are a text's lower-cased words and one end; the first ones follow order - 1 begins. With c their
counts, d Good-Turing discounts by order, h a history of n - 1 tokens and h' the same without its first:

    Pn(w | h) = d(c(h, w)) * c(h, w) / c(h)    if h w was seen, else    a(h) * Pn-1(w | h')
    a(h)      = (1 - sum of the discounted shares after h) / (1 - sum of Pn-1 over what was seen after h)

so that Pn(. | h) sums to 1 for every h; an unseen h has a(h) = 1. P1 sums to 1 over all training words, the end and
one never-seen word, which gets what the discounts leave. Where counts are too few for Good-Turing estimates, absolute
discounts take their place; where every count after h is beyond discounting, one more count is set aside for the
unseen. Every word is a type of its own and every n-gram is counted, whatever the input's size.

A word is a number: its place among the frequent words (at least FREQUENT_SHARE of all tokens, so there are at most
1 / FREQUENT_SHARE, known to every task), else a 63-bit hash of its bytes, its key. Words are cut and hashed some MB of
texts at a time, as arrays; counts are kept by key.

N-grams are dealt to buckets by the word before their last. A bucket then has every history that ends with its words, all
that follows these, and so counts, discounts, weights and sums of each order from 2 on, but for P1 of what follows: the
frequent words' are known, and the others' add up in the buckets of those words, which tell each word that they followed.
A word with more than a bucket's share of the tokens has several buckets by the word before it; its pairs are counted
apart and given to all of them. The table written to the shared folder has the counts of the highest order by bucket,
added up in each task before they travel; lower orders are their marginal sums, and `probabilities` unfolds it.

Training and scoring go through the buckets in up to PASSES passes over the coded texts, so that what is shuffled at once
is that part of all n-grams. In a pass the n-grams of the texts meet their bucket's table, piece by piece: only the table
is held. Sums per text go back; words that aren't frequent and are asked of order 1 meet the table of words at the end.

Cases: a null or empty text is one end; without training texts every token is a never-seen word; repeated rows are
counted and scored each for itself; a null doc_id counts as the empty string when texts are dealt to training; very
long texts are scored whole; extra columns of any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import LOWER_BYTES, U64, deleted, documents, mix, scratch_dir, stored, text_bytes

ORDER, FREQUENT_SHARE = 3, 1 / 500_000
DISCOUNTED = 5  # counts up to this one are discounted
BATCH_TOKENS = 2_000_000
ASKED_AT_ONCE = 100_000
PASSES = 6
COUNTED_TOGETHER = 2  # passes whose n-grams are counted at once: counts take less room than questions
SLICE_BYTES = 1 << 20
#: Tokens that are not words, before the frequent words' own numbers. Those of words that aren't frequent are below NONE.
NONE, BEGIN, END, FIRST_WORD = -1, 0, 1, 2


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def slices(texts: list[bytes]) -> Iterator[list[int]]:
    """Places of consecutive texts of some SLICE_BYTES, or of one longer text."""
    found, size = [], 0
    for i, text in enumerate(texts):
        found.append(i)
        size += len(text)
        if size >= SLICE_BYTES:
            yield found
            found, size = [], 0
    if found:
        yield found


BLANKS = bytes(b in b" \t\n\x0b\x0c\r" for b in range(256))
#: Longer words are hashed one by one.
LONG = 64
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the texts' lower-cased words in their order, and how many words each text has.

    The key of a word that is not frequent is its number, below NONE: its bytes go eight at a time through a hash that
    begins with their number.
    """
    data = b" ".join([b"", *texts, b""]).translate(LOWER_BYTES)
    blank = np.frombuffer(data.translate(BLANKS), np.bool_)
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    lanes = np.frombuffer(data + bytes(16 - len(data) % 8), "<u8")
    h, left = mix(sizes.astype(U64)), np.arange(len(starts))
    for k in range(0, LONG, 8):
        at, n = starts[left] + k, np.minimum(sizes[left] - k, 8)
        lane, off = at >> 3, (at & 7).astype(U64) << U64(3)
        # The next lane's bytes, shifted in two steps: by 64 at once is not defined.
        x = (lanes[lane] >> off) | (lanes[lane + 1] << (U64(63) - off) << U64(1))
        found = mix(h[left] * U64(0x9E3779B97F4A7C15) + (x & FIRST_BYTES[n]))
        h[left] = found
        left = left[sizes[left] > k + 8]
        if not len(left):
            break
    for i in left:
        h[i] = xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]], 42)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return -2 - (h >> U64(1)).astype(np.int64), np.diff(np.searchsorted(starts, ends), prepend=0)


def word_key(word: bytes) -> int:
    return int(word_keys([word])[0][0])


def discounts(n: dict[int, int], k: int = DISCOUNTED) -> list[float]:
    """d[r] for r = 0..k (d[0] unused): Good-Turing as Katz has it, or absolute discounts if that isn't possible."""
    if all(n.get(r) for r in range(1, k + 2)):
        last = (k + 1) * n[k + 1] / n[1]
        if last < 1:
            d = [((r + 1) * n[r + 1] / (r * n[r]) - last) / (1 - last) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return [0.0, *d]
    less = n[1] / (n[1] + 2 * n[2]) if n.get(1) and n.get(2) else 0.5
    return [0.0, *((r - less) / r for r in range(1, k + 1))]


def discounted(count: Column, d: list[float]) -> Column:
    """d(c) * c."""
    return F.element_at(F.array(*map(F.lit, [*d[1:], 1.0])), F.least(count, F.lit(len(d))).cast("int")) * count


def names(n: int) -> list[str]:
    return [f"w{i}" for i in range(1, n + 1)]


WORD_BUCKETS = 1024  # a power of two


def word_counts(docs: DataFrame, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """(w1, c): counts of words by key and of ends; each task adds up its own before they travel, in pieces by bucket."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def added() -> pa.RecordBatch:
            w, c = np.unique(np.concatenate(held), return_counts=True)  # ascending, so buckets are consecutive rows
            bucket = np.where(w < NONE, (NONE - w) >> (63 - (WORD_BUCKETS - 1).bit_length()), 0)
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rows = [(int(bucket[i]), w[i:j].tobytes(), c[i:j].tobytes()) for i, j in zip(at, [*at[1:], len(w)])]
            return as_batch(rows, arrow("bucket int, w binary, c binary"))

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for some in slices(texts):
                held += [word_keys([texts[i] for i in some])[0], np.full(len(some), END)]
                size += sum(map(len, held[-2:]))
                if size >= batch_tokens:
                    yield added()
                    held, size = [], 0
        if held:
            yield added()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in groupby(rows_of(batches), key=lambda p: p[0]):
            _, w, c = (b"".join(x) if isinstance(x[0], bytes) else x for x in zip(*found))
            words = Index([np.frombuffer(w, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(words.columns[0]), pa.array(words.sums(np.frombuffer(c, np.int64)))], ["w1", "c"])

    pieces = docs.select(text_bytes()).mapInArrow(counted, "bucket int, w binary, c binary")
    return pieces.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merged, "w1 bigint, c bigint")


def spread(columns: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """64-bit hashes of the rows of the columns."""
    h = np.full(len(columns[0]), seed, U64)
    for c in columns:
        h = mix(h * U64(0x9E3779B97F4A7C15) + c.view(U64))
    return h


def packed(numbers: np.ndarray) -> bytes:
    """Words' numbers as 32 bits each, those of words that aren't frequent as 64 bits after these."""
    rare = numbers < NONE
    return np.where(rare, NONE - 1, numbers).astype(np.int32).tobytes() + numbers[rare].tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    numbers = np.frombuffer(data, np.int32, n).astype(np.int64)
    numbers[numbers < NONE] = np.frombuffer(data, np.int64, -1, 4 * n)
    return numbers


class Index:
    """Distinct rows of the columns. The hash by which they are sorted has another seed if two of them share it, and
    what is looked up is compared, so that hashes decide nothing. Of up to a million rows the hash's last bits give way
    to the row's place, so that hash and place are sorted as one number."""

    def __init__(self, columns: list[np.ndarray]):
        self.seed, n = 0, len(columns[0])
        self.less = U64(n.bit_length() if n < 1 << 20 else 0)
        while True:
            key = spread(columns, self.seed) >> self.less
            if self.less:
                key = np.sort(key << self.less | np.arange(n, dtype=U64))
                self.order, key = (key & ((U64(1) << self.less) - U64(1))).astype(np.int64), key >> self.less
            else:
                self.order = np.argsort(key)
                key = key[self.order]
            rows = [c[self.order] for c in columns]
            same = key[1:] == key[:-1]
            if not np.logical_or.reduce([c[1:] != c[:-1] for c in rows])[same].any():
                break
            self.seed += 1
        self.starts = np.flatnonzero(np.r_[True, ~same]) if len(key) else np.empty(0, np.int64)
        self.key, self.columns = key[self.starts], [c[self.starts] for c in rows]
        self.first = None

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.order], self.starts) if len(x) else x

    def members(self) -> np.ndarray:
        """Per row given, which of the distinct ones it is."""
        at = np.empty(len(self.order), np.int64)
        at[self.order] = np.repeat(np.arange(len(self.starts)), np.diff(np.r_[self.starts, len(self.order)]))
        return at

    def find(self, columns: list[np.ndarray]) -> np.ndarray:
        """Places of the rows, -1 where there is none."""
        if not len(self.key):
            return np.full(len(columns[0]), -1)
        if self.first is None:  # where the keys with the same first bits begin
            self.bits = U64(64 - len(self.key).bit_length()) - self.less
            slots = np.bincount((self.key >> self.bits).astype(np.int64), minlength=1 << len(self.key).bit_length())
            self.first = np.minimum(np.r_[0, np.cumsum(slots)[:-1]], len(self.key) - 1)
        key = spread(columns, self.seed) >> self.less
        at = self.first[(key >> self.bits).astype(np.int64)]
        less = np.flatnonzero(self.key[at] < key)
        while len(less):
            at[less] += 1
            less = less[at[less] < len(self.key)]
            less = less[self.key[at[less]] < key[less]]
        at[at == len(self.key)] = 0
        hit = np.flatnonzero(self.key[at] == key)
        hit = hit[np.logical_and.reduce([a[at[hit]] == b[hit] for a, b in zip(self.columns, columns)])]
        found = np.full(len(key), -1)
        found[hit] = at[hit]
        return found


@dataclass
class Vocabulary:
    """What every task knows: the frequent words' numbers and counts."""

    keys: Index  # of the frequent words in the order of their numbers
    count: np.ndarray  # by number; 0 for BEGIN

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The texts' words and ends as numbers, and how many each text has."""
        keys, sizes = word_keys(texts)
        at = self.keys.find([keys])
        often = np.flatnonzero(at >= 0)
        keys[often] = FIRST_WORD + self.keys.order[at[often]]
        tokens, is_word = np.full(len(keys) + len(sizes), END), np.ones(len(keys) + len(sizes), bool)
        is_word[np.cumsum(sizes + 1) - 1] = False
        tokens[is_word] = keys
        return tokens, sizes + 1


@dataclass
class Layout:
    """Where n-grams are dealt: to the bucket of the word before their last, w. If w has more than a bucket's share of
    the tokens, it has several buckets, among which the word before w decides."""

    fields: int  # words of an n-gram that travel: 3 at least, so that there is a word before w
    buckets: int
    passes: int
    splits: np.ndarray  # by number of a frequent word, 1 for most
    first: np.ndarray | None = None  # and its first bucket, once a task has asked for it

    def parts(self, w: np.ndarray) -> np.ndarray:
        return np.where(w > NONE, self.splits[np.maximum(w, 0)], 1)

    def place(self, w: np.ndarray, part: np.ndarray) -> np.ndarray:
        return (spread([w, part]) % U64(self.buckets)).astype(np.int64)

    def bucket(self, columns: list[np.ndarray]) -> np.ndarray:
        if self.first is None:
            self.first = self.place(np.arange(len(self.splits)), np.zeros(len(self.splits), np.int64))
        w = columns[-2]
        number, rare = np.maximum(w, 0), np.flatnonzero(w < NONE)
        found = self.first[number]
        found[rare] = self.place(w[rare], np.zeros(len(rare), np.int64))
        several = np.flatnonzero((self.splits > 1)[number])
        several = several[w[several] > NONE]
        if len(several):
            part = (spread([columns[-3][several]], 1) % self.splits[w[several]].astype(U64)).astype(np.int64)
            found[several] = self.place(w[several], part)
        return found


def layout(order: int, vocabulary: Vocabulary, tokens: int, bucket_tokens: int | None = None) -> Layout:
    size = bucket_tokens or min(max(tokens // 512, 1 << 17), 1 << 20)
    buckets = -(-max(tokens, 1) // size)
    count = vocabulary.count.copy()
    count[[BEGIN, END]] = count[END], 0  # a text has one of each; BEGIN is before others, END never
    return Layout(max(order, 3), buckets, max(1, min(PASSES, buckets // 4)), np.maximum(1, -(-count // size)))


#: Kinds of pieces, in the order in which a bucket's are read: n-grams and counts; words and what P1 of those words after
#: them that aren't frequent adds up to; pairs of a word with several buckets and counts; n-grams of texts and these.
GRAMS, AFTER, PAIRS, ASKED = range(4)


def piece_fields(fields: int) -> str:
    """n rows of a bucket: their words and one more figure, whole ones in 8 or 16 bits each where these are enough."""
    return "bucket int, kind int, chunk bigint, n int, " + ", ".join(f"{w} binary" for w in names(fields)) + ", x binary"


def pieces(fields: int, bucket: np.ndarray, kind: int, columns: list[np.ndarray], x: np.ndarray, chunk: int = 0) -> list[tuple]:
    """The rows, in their order, as a piece per bucket."""
    narrow = bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket
    order = np.argsort(narrow, kind="stable")
    bucket, columns, x = bucket[order], [c[order] for c in columns], x[order]
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    out = []
    for a, b in zip(at, [*at[1:], len(bucket)]):
        words = [packed(c[a:b]) for c in columns]
        out.append((int(bucket[a]), kind, chunk, int(b - a), *[b""] * (fields - len(words)), *words, narrowed(x[a:b]).tobytes()))
    return out


def narrowed(x: np.ndarray) -> np.ndarray:
    """Whole numbers, none below 0, in 8 or 16 bits each if these are enough."""
    if x.dtype == float:
        return x
    most = x.max()
    return x.astype(np.uint8 if most < 1 << 8 else np.uint16) if most < 1 << 16 else x


def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def arrow(fields: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in map(str.split, fields.split(", "))])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def joined(found: list[tuple], columns: int, x_type: type) -> tuple[list[np.ndarray], np.ndarray]:
    """The last words and the figures of pieces."""
    if not found:
        return [np.empty(0, np.int64)] * columns, np.empty(0, x_type)
    kinds = [{1: np.uint8, 2: np.uint16}.get(len(p[-1]) // max(p[3], 1), x_type) for p in found]
    x = np.concatenate([np.frombuffer(p[-1], kind) for p, kind in zip(found, kinds)]).astype(x_type, copy=False)
    return [np.concatenate([unpacked(p[c - 1 - columns], p[3]) for p in found]) for c in range(columns)], x


def coded(docs: DataFrame, trains: Column, vocabulary, plan: Layout, tokens: int, types: int, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Texts as numbers: per some texts, which all train or don't, a row with its number (chunk), their tokens, the pass
    that each token's n-gram is for, and what is known of each text (about)."""
    kind = docs.schema["doc_id"].dataType
    about = f"array<struct<doc_id:{kind.simpleString()},n_tokens:bigint,n_known:bigint,base_score:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        base = np.log10((known.count + 0.5) / (tokens + 0.5 * (types + 1)))
        unknown = np.log10(0.5 / (tokens + 0.5 * (types + 1)))
        chunk = TaskContext.get().partitionId() << 33
        held: dict[bool, list] = {True: [], False: []}
        size = {True: 0, False: 0}

        def added(training: bool) -> pa.RecordBatch:
            nonlocal chunk
            doc_ids, found, *facts = zip(*held[training])
            struct = pa.StructArray.from_arrays([pa.concat_arrays(doc_ids), *map(pa.array, map(np.concatenate, facts))], ["doc_id", "n_tokens", "n_known", "base_score"])
            about = pa.ListArray.from_arrays(pa.array([0, len(struct)], pa.int32()), struct)
            sizes, numbers = np.concatenate(facts[0]).astype(np.int32), np.concatenate(found)
            columns, _ = grams(sizes, numbers, plan.fields, np.arange(len(numbers)))
            passes = (plan.bucket(columns) % plan.passes).astype(np.uint8).tobytes()
            chunk, held[training], size[training] = chunk + 1, [], 0
            columns = [pa.array([chunk]), pa.array([training]), pa.array([sizes.tobytes()]), pa.array([packed(numbers)]), pa.array([passes]), about]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "trains", "sizes", "tokens", "passes", "about"])

        for batch in batches:
            for training in held:
                part = batch.filter(pa.compute.equal(batch.column(2), training))
                texts = part.column(1).to_pylist()
                for some in slices(texts):
                    found, n = known.tokens([texts[i] for i in some])
                    starts, often = np.cumsum(n) - n, found > NONE
                    number = np.maximum(found, 0)
                    n_known = np.add.reduceat((often & (known.count[number] > 0)).astype(np.int64), starts)
                    score = np.add.reduceat(np.where(often, base[number], unknown), starts)
                    held[training].append((part.column(0).slice(some[0], len(some)), found, n, n_known, score))
                    size[training] += len(found)
                    if size[training] >= batch_tokens:
                        yield added(training)
        for training in held:
            if held[training]:
                yield added(training)

    return docs.select("doc_id", text_bytes(), trains.alias("trains")).mapInArrow(run, f"chunk bigint, trains boolean, sizes binary, tokens binary, passes binary, about {about}")


def grams(sizes: np.ndarray, tokens: np.ndarray, fields: int, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns w1 .. wn of the n-grams that end at the given tokens of some texts, and which of the texts."""
    ends = np.cumsum(sizes)
    text = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[at]
    place = at - (ends - sizes)[text]
    return [np.where(place >= k, tokens[np.maximum(at - k, 0)], BEGIN) for k in range(fields - 1, 0, -1)] + [tokens[at]], text


def read(sizes: bytes, tokens: bytes, passes: bytes, which: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of some texts, their tokens, and the places of those whose n-grams are for some passes."""
    r = np.frombuffer(passes, np.uint8)
    return np.frombuffer(sizes, np.int32), unpacked(tokens, len(passes)), np.flatnonzero((r >= which.start) & (r < which.stop))


def of_order(k: int, index: Index, c: np.ndarray, pairs: tuple[list[np.ndarray], np.ndarray], plan: Layout) -> tuple[Index, np.ndarray]:
    """A bucket's n-grams of an order and their counts, from its longest ones; those of words with several buckets
    that are of order 2 are given."""
    if k == plan.fields:
        return index, c
    columns = index.columns[-k:]
    if k == 2:
        here = plan.parts(columns[0]) == 1
        columns, c = [np.r_[a[here], b] for a, b in zip(columns, pairs[0])], np.r_[c[here], pairs[1]]
    found = Index(columns)
    return found, found.sums(c)


@dataclass
class Model:
    order: int
    vocabulary: Vocabulary
    words: DataFrame  # w1, c, p
    grams: DataFrame  # pieces of n-grams with counts, and what else their buckets need, by pass
    discounts: dict[int, list[float]]  # by order
    layout: Layout
    p: np.ndarray  # P1 by number of a frequent word
    never: float  # P1 of a never-seen word
    tokens: int
    types: int  # distinct training tokens
    path: str
    texts: DataFrame | None  # as numbers, if they were kept


def train(
    docs: DataFrame, order: int = ORDER, frequent_share: float = FREQUENT_SHARE, bucket_tokens: int | None = None, trains: Column | None = None
) -> Model:
    """Counts all texts of `docs` and writes the model's tables to the shared folder.

    With a condition `trains`, only texts that meet it are counted, and all are kept as numbers for `score`.
    """
    if order < 2:
        raise ValueError("the order must be 2 at least")
    spark: SparkSession = docs.sparkSession
    path = scratch_dir(spark, "katz")
    counts = stored(word_counts(docs if trains is None else docs.filter(trains)), f"{path}/word-counts", "zstd", dictionary=False)
    of_count = [F.coalesce(F.sum((F.col("c") == r).cast("long")), F.lit(0)).alias(f"n{r}") for r in range(1, DISCOUNTED + 2)]
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.expr(f"if(w1 = {END}, c, 0)")), F.lit(0)).alias("ends"), *of_count).first()
    n, singles = total.n, {r: total[f"n{r}"] for r in range(1, DISCOUNTED + 2)}
    d1 = discounts(singles)
    is_frequent, is_end = F.col("c") >= n * frequent_share, F.col("w1") == END
    frequent = sorted((-r.c, r.w1) for r in counts.filter(is_frequent & ~is_end).collect())  # at most 1 / frequent_share
    count = np.array([0, total.ends, *(-c for c, _ in frequent)], np.int64)
    vocabulary = Vocabulary(Index([np.array([w for _, w in frequent], np.int64)]), count)

    # Unigrams: the mass that discounts leave is a never-seen word's; one more count if they leave none.
    seen = n - sum((1 - d1[r]) * r * singles[r] for r in range(1, DISCOUNTED + 1))
    scale = n if seen < n * (1 - 1e-12) else n + 1
    never = (scale - seen) / scale
    words = spark.createDataFrame([(i, int(c)) for i, c in enumerate(count) if c], "w1 long, c long")
    words = counts.filter(~is_frequent & ~is_end).unionByName(words)
    words = words.withColumn("p", discounted(F.col("c"), d1) / F.lit(float(scale)))

    plan = layout(order, vocabulary, n, bucket_tokens)
    shared = spark.sparkContext.broadcast(vocabulary)
    texts = stored(coded(docs, F.lit(True) if trains is None else trains, shared, plan, n, total.v), f"{path}/texts", "zstd", dictionary=False)
    counting = texts.filter("trains").select("chunk", "sizes", "tokens", "passes")
    fields = piece_fields(plan.fields)
    kept = f"{fields}, part int, counts array<bigint>"
    for r in range(0, plan.passes, COUNTED_TOGETHER):
        found = counting.mapInArrow(partial(counted_pieces, plan=plan, which=range(r, r + COUNTED_TOGETHER)), fields).repartition("bucket").sortWithinPartitions("bucket")
        merged = found.mapInArrow(partial(merged_pieces, plan=plan, order=order, d1=d1, scale=scale), kept)
        stored(merged, f"{path}/grams/pass={r}", "zstd", ["part"], dictionary=False)
    if trains is None:
        deleted(f"{path}/texts")
    tables = spark.read.schema(f"{kept}, pass int").parquet(f"{path}/grams")
    seen = tables.filter(f"kind = {GRAMS}").select(*(F.sum(F.col("counts")[i]) for i in range((order - 1) * (DISCOUNTED + 1)))).first()
    of_counts = np.array([x or 0 for x in seen]).reshape(order - 1, DISCOUNTED + 1)
    by_order = {k: discounts({c + 1: int(x) for c, x in enumerate(of_counts[k - 2])}) for k in range(2, order + 1)}
    p = np.where(count > 0, discounted_counts(count, d1) / scale, never)
    return Model(order, vocabulary, words, tables, by_order, plan, p, never, n, total.v, path, None if trains is None else texts)


def discounted_counts(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([*d, 1.0])[np.minimum(c, len(d))] * c


def counted_pieces(batches: Iterator[pa.RecordBatch], plan: Layout, which: range) -> Iterator[pa.RecordBatch]:
    """The n-grams of some texts, those of some passes, each once with its count."""
    schema = arrow(piece_fields(plan.fields))
    first = plan.place(np.arange(len(plan.splits)), np.zeros(len(plan.splits), np.int64))
    paired = (plan.splits > 1) & np.isin(first % plan.passes, which)  # their pairs are counted in the first of their buckets
    above = np.flatnonzero(paired).max(initial=-1)
    for _, *texts in rows_of(batches):
        sizes, tokens, at = read(*texts, which)
        index = Index(grams(sizes, tokens, plan.fields, at)[0])
        out = pieces(plan.fields, plan.bucket(index.columns), GRAMS, index.columns, index.sums(np.ones(len(index.order), np.int64)))
        at = np.flatnonzero((tokens > NONE) & (tokens <= above))
        at = at[paired[tokens[at]]] + 1
        if paired[BEGIN]:
            at = np.r_[at, np.cumsum(sizes) - sizes]
        if len(at):
            pairs = Index(grams(sizes, tokens, 2, at)[0])
            out += pieces(plan.fields, first[pairs.columns[0]], PAIRS, pairs.columns, pairs.sums(np.ones(len(pairs.order), np.int64)))
        if out:
            yield as_batch(out, schema)


def merged_pieces(batches: Iterator[pa.RecordBatch], plan: Layout, order: int, d1: list[float], scale: int) -> Iterator[pa.RecordBatch]:
    """Each bucket's counts added up and counted themselves; what goes to the buckets of other words from these."""
    schema = arrow(f"{piece_fields(plan.fields)}, part int, counts array<bigint>")
    after: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def sent() -> list[tuple]:
        words = Index([np.concatenate([a for a, _ in after])])
        p, w = words.sums(np.concatenate([b for _, b in after])), words.columns[0]
        return to_all(AFTER, [w], p)

    def to_all(kind: int, columns: list[np.ndarray], x: np.ndarray) -> list[tuple]:
        """Pieces for every bucket that the first column's words have."""
        parts = plan.parts(columns[0])
        row = np.repeat(np.arange(len(parts)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        once = Index([plan.place(columns[0][row], part), row])  # two parts may share a bucket
        bucket, row = once.columns
        return [(*p, p[0] % plan.passes, None) for p in pieces(plan.fields, bucket, kind, [c[row] for c in columns], x[row])]

    for bucket, found in groupby(rows_of(batches), key=lambda p: p[0]):
        found = list(found)
        columns, c = joined([p for p in found if p[1] == GRAMS], plan.fields, np.int64)
        index = Index(columns)
        c = index.sums(c)
        two, twice = joined([p for p in found if p[1] == PAIRS], 2, np.int64)
        pairs = Index(two)
        twice = pairs.sums(twice)
        of_counts = [np.bincount(n[n <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)[1:] for n in (of_order(k, index, c, (pairs.columns, twice), plan)[1] for k in range(2, order + 1))]
        by_word = np.argsort(index.columns[-2], kind="stable")  # compresses better
        out = pieces(plan.fields, np.full(len(c), bucket), GRAMS, [x[by_word] for x in index.columns], c[by_word])
        # A bucket may hold nothing but pairs.
        out = out or [(bucket, GRAMS, 0, 0, *[b""] * plan.fields, b"")]
        out = [(*p, bucket % plan.passes, np.concatenate(of_counts).tolist()) for p in out]
        if len(twice):
            out += to_all(PAIRS, pairs.columns, twice)
        # P1 of a word that isn't frequent, for each word that it follows.
        rare = index.columns[-2] < NONE
        before = Index([x[rare] for x in index.columns[-3:-1]])
        word = Index([before.columns[1]])
        p = discounted_counts(word.sums(before.sums(c[rare])), d1) / scale
        after.append((before.columns[0], p[word.members()]))
        size += len(before.key)
        if size >= BATCH_TOKENS:
            out, after, size = out + sent(), [], 0
        yield as_batch(out, schema)
    if size:
        yield as_batch(sent(), schema)


class Bucket:
    """Probabilities and backoff weights of a bucket's n-grams by order."""

    def __init__(self, found: list[tuple], order: int, plan: Layout, by_order: dict[int, list[float]], p1: np.ndarray):
        self.grams: dict[int, Index] = {}
        self.p: dict[int, np.ndarray] = {}
        self.log_p: dict[int, np.ndarray] = {}
        self.histories: dict[int, Index] = {}
        self.backoff: dict[int, np.ndarray] = {}
        columns, c = joined([p for p in found if p[1] == GRAMS], plan.fields, np.int64)
        longest = Index(columns)
        c = longest.sums(c)
        pairs = joined([p for p in found if p[1] == PAIRS], 2, np.int64)
        (w,), p = joined([p for p in found if p[1] == AFTER], 1, np.float64)
        after = Index([w])
        p = after.sums(p)
        for k in range(2, order + 1):
            index, n = of_order(k, longest, c, pairs, plan)
            history = Index(index.columns[:-1])
            dc = discounted_counts(n, by_order[k])
            total, shares = history.sums(n), history.sums(dc)
            if k == 2:
                last, self.count = index.columns[-1], total
                lower = history.sums(np.where(last > NONE, p1[np.maximum(last, 0)], 0.0))
                at = after.find(history.columns)
                if len(p):
                    lower = lower + np.where(at < 0, 0.0, p[at])
            else:
                lower = history.sums(self.p[k - 1][self.grams[k - 1].find(index.columns[1:])])
            whole = np.where(shares < total * (1 - 1e-12), total, total + 1)
            self.grams[k], self.histories[k] = index, history
            self.p[k] = dc / whole[history.members()]
            self.log_p[k] = np.log10(self.p[k])
            self.backoff[k] = np.log10((1 - shares / whole) / (1 - lower))


def probabilities(model: Model, k: int) -> DataFrame:
    """w1 .. wk, p and, from k = 2 on, log_backoff of w1 .. wk-1, of all n-grams of an order."""
    if k == 1:
        return model.words.select("w1", "p")
    plan, order, by_order = model.layout, model.order, model.discounts
    p1 = model.words.sparkSession.sparkContext.broadcast(model.p)
    named = [*names(k), "p", "log_backoff"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, found in groupby(rows_of(batches), key=lambda p: p[0]):
            of = Bucket(list(found), order, plan, by_order, p1.value)
            index = of.grams[k]
            # Pairs of a word with several buckets are in all of them, and told by the first.
            first = np.zeros(len(index.key), np.int64)
            here = (plan.parts(index.columns[0]) == 1) | (plan.place(index.columns[0], first) == bucket) if k == 2 else first == 0
            columns = [*index.columns, of.p[k], of.backoff[k][of.histories[k].members()]]
            yield pa.RecordBatch.from_arrays([pa.array(c[here]) for c in columns], named)

    kept = model.grams.select(*(f.split()[0] for f in piece_fields(plan.fields).split(", "))).repartition("bucket").sortWithinPartitions("bucket")
    return kept.mapInArrow(run, ", ".join(f"{w} bigint" for w in names(k)) + ", p double, log_backoff double")


def answers(batches: Iterator[pa.RecordBatch], order: int, plan: Layout, by_order: dict[int, list[float]], p1) -> Iterator[pa.RecordBatch]:
    """Per piece of n-grams asked: what they add to the texts' scores, and words whose P1 is to be added yet."""
    schema = arrow(ANSWER)

    def answered(bucket: Bucket, asked: list[tuple]) -> pa.RecordBatch:
        columns, text = joined(asked, plan.fields, np.int32)
        value, left = np.zeros(len(text)), np.arange(len(text))
        for k in range(order, 1, -1):
            words = [c[left] for c in columns[-k:]]
            at = bucket.grams[k].find(words)
            hit = at >= 0
            value[left[hit]] += bucket.log_p[k][at[hit]]
            left, words = left[~hit], [c[~hit] for c in words[:-1]]
            at = bucket.histories[k].find(words)
            hit = at >= 0
            value[left[hit]] += bucket.backoff[k][at[hit]]
        often = columns[-1][left] > NONE
        value[left[often]] += np.log10(p1.value[columns[-1][left[often]]])
        left = left[~often]
        # The word before the last one: every word is that once.
        rare = np.flatnonzero(columns[-2] < NONE)
        at = bucket.histories[2].find([columns[-2][rare]])
        rare, at = rare[at >= 0], at[at >= 0]
        gain = np.log10((bucket.count[at] + 0.5) / 0.5)
        # A sum per text of a piece.
        ends = np.cumsum([p[3] for p in asked])
        new = np.r_[True, text[1:] != text[:-1]]
        new[ends[:-1]] = True
        starts = np.flatnonzero(new)
        kinds = [(starts, text[starts], np.add.reduceat(value, starts)), (rare, text[rare], gain), (left, text[left], columns[-1][left])]
        cuts = [np.r_[0, np.searchsorted(at, ends)] for at, _, _ in kinds]
        return as_batch([(p[2], *(x[c[i] : c[i + 1]].tobytes() for c, (_, *both) in zip(cuts, kinds) for x in both)) for i, p in enumerate(asked)], schema)

    for _, found in groupby(rows_of(batches), key=lambda p: p[0]):
        table, asked, size = [], [], 0
        bucket = None
        for piece in found:
            if piece[1] != ASKED:
                table.append(piece)
                continue
            bucket = bucket or Bucket(table, order, plan, by_order, p1.value)
            asked.append(piece)
            size += piece[3]
            if size >= ASKED_AT_ONCE:
                yield answered(bucket, asked)
                asked, size = [], 0
        if asked:
            yield answered(bucket, asked)


#: Texts of a chunk and what they get; texts of known words that aren't frequent and what these add to the base; texts
#: and words.
ANSWER = "chunk bigint, text binary, value binary, known binary, gain binary, of binary, word binary"
SUM = "chunk bigint, at int, value double, known bigint, gain double, words array<bigint>"


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text the sum of its answers."""
    schema = arrow(SUM)
    for chunk, found in groupby(rows_of(batches), key=lambda a: a[0]):
        columns = list(zip(*found))[1:]
        text, value, known, gain, of, word = (np.frombuffer(b"".join(c), t) for c, t in zip(columns, (np.int32, float, np.int32, float, np.int32, np.int64)))
        at, members = np.unique(text, return_inverse=True)
        value, known = np.bincount(members, weights=value, minlength=len(at)), np.searchsorted(at, known)
        gain, known = np.bincount(known, weights=gain, minlength=len(at)), np.bincount(known, minlength=len(at))
        order = np.argsort(of, kind="stable")
        ends = np.r_[0, np.searchsorted(of[order], at, "right")].astype(np.int32)
        words = pa.ListArray.from_arrays(pa.array(ends), pa.array(word[order]))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk)), pa.array(at), pa.array(value), pa.array(known.astype(np.int64)), pa.array(gain), words], schema=schema)


def asked_pieces(batches: Iterator[pa.RecordBatch], plan: Layout, r: int) -> Iterator[pa.RecordBatch]:
    """All n-grams of texts that are a pass's, with their text."""
    schema = arrow(piece_fields(plan.fields))
    for chunk, *texts in rows_of(batches):
        sizes, tokens, at = read(*texts, range(r, r + 1))
        if len(at):
            columns, text = grams(sizes, tokens, plan.fields, at)
            yield as_batch(pieces(plan.fields, plan.bucket(columns), ASKED, columns, text, chunk), schema)


def score(docs: DataFrame | None, model: Model) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score, score (log10 probability of the text). Without docs, those of the
    texts that were kept in training."""
    spark, plan = model.words.sparkSession, model.layout
    path = scratch_dir(spark, "katz-scores")
    shared, p1 = spark.sparkContext.broadcast(model.vocabulary), spark.sparkContext.broadcast(model.p)
    texts = model.texts
    if docs is not None:
        texts = stored(coded(docs, F.lit(False), shared, plan, model.tokens, model.types), f"{path}/texts", "zstd", dictionary=False)
    fields = piece_fields(plan.fields)
    named = [f.split()[0] for f in fields.split(", ")]
    for r in range(plan.passes):
        asked = texts.select("chunk", "sizes", "tokens", "passes").mapInArrow(partial(asked_pieces, plan=plan, r=r), fields)
        met = asked.unionByName(model.grams.filter(f"part = {r}").select(*named)).repartition("bucket").sortWithinPartitions("bucket", "kind")
        found = met.mapInArrow(partial(answers, order=model.order, plan=plan, by_order=model.discounts, p1=p1), ANSWER)
        stored(found.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(summed, SUM), f"{path}/sums/pass={r}")
    sums = spark.read.schema(SUM).parquet(f"{path}/sums")
    # Words that aren't frequent and followed no word of theirs in training: P1 from the table of words.
    words = sums.select("chunk", "at", F.explode("words").alias("w1")).join(model.words, "w1", "left")
    words = words.select("chunk", "at", F.log10(F.coalesce("p", F.lit(model.never))).alias("value"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("gain"))
    sums = sums.select(words.columns).unionByName(words).groupBy("chunk", "at").agg(*(F.sum(x).alias(x) for x in ("value", "known", "gain")))
    about = texts.select("chunk", F.posexplode("about").alias("at", "about")).select("chunk", "at", "about.*")
    found = about.join(sums, ["chunk", "at"]).select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.col("known")).alias("n_known"),
        (F.col("base_score") + F.col("gain")).alias("base_score"),
        F.col("value").alias("score"),
    )
    found = stored(found, f"{path}/scores")
    if docs is not None:
        deleted(f"{path}/texts")
    deleted(f"{path}/sums")
    return found


def op5_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, trains=~held_out())
    found = score(None, model)
    deleted(model.path)
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
