"""Best-fit packing: documents, cut to pieces of at most a sequence's length, into as few sequences as possible.

Best-fit decreasing places the longest piece first, each in the open sequence with the least room that still holds
it. Pieces of one length are interchangeable, so the plan needs only the number of pieces of each length: at most
`capacity` numbers, whatever the input's size. The driver makes the plan from them: a segment tree over remaining
capacities finds the tightest open room in logarithmic time, and sequences with the same history are kept as one
run with a count. The executors then rank the pieces within their length and read their places off the plan. The
ranking is done in two steps (counts by bucket and length, then row numbers within them), so a length that holds a
third of all pieces is still spread over all buckets.

Cases: a null text is empty; an empty text is one piece of one token (the end id); a document of more than
`capacity` tokens is cut into full pieces, with the shorter one first; repeated rows are packed once per row; null
doc_ids are packed as any other; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, written
from .tokens import BYTE_BPE, encoder, in_groups

CAPACITY, END_ID, BUCKETS = 2048, 0, 1024


class RoomTree:
    """Segment tree over remaining capacities 0..size: which of them have open sequences."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = bytearray(2 * self.leaves)

    def set(self, room: int, is_open: bool) -> None:
        i = room + self.leaves
        self.open[i] = is_open
        while i > 1:
            i //= 2
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least open room of at least `need`, in logarithmic time."""
        i = need + self.leaves
        if not self.open[i]:
            while i > 1 and (i & 1 or not self.open[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths.

    Gives (length, first rank, pieces per sequence, first sequence, first offset): ranks from `first rank` on, up to
    the next entry of the same length, fill sequences from `first sequence` on, so many pieces in each, from
    `first offset` on. A run is (first sequence, number of sequences); all of a run's sequences have the same room.
    """
    tree, runs, out, made = RoomTree(capacity), defaultdict(list), [], 0

    def put(first: int, n: int, room: int) -> None:
        if n and room:
            runs[room].append((first, n))
            tree.set(room, True)

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, rank = counts[length], 0
        while left:
            if (room := tree.tightest(length)) is None:
                per = capacity // length
                n = -(-left // per)
                first, made, room = made, made + n, capacity
            else:
                first, n = runs[room].pop()
                if not runs[room]:
                    tree.set(room, False)
                per = room // length
            full = min(n, left // per)  # sequences that take as many pieces as go in
            rest = left - full * per if full < n else 0  # pieces for one more, partly filled sequence
            if full:
                out.append((length, rank, per, first, capacity - room))
                put(first, full, room - per * length)
            if rest:
                out.append((length, rank + full * per, rest, first + full, capacity - room))
                put(first + full, 1, room - rest * length)
            put(first + full + bool(rest), n - full - bool(rest), room)
            rank, left = rank + full * per + rest, left - full * per - rest
    return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str = BYTE_BPE, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves if asked for."""
    end = np.array([end_id], "<u4").tobytes()
    fields = [("doc_id", docs.schema["doc_id"].dataType.simpleString()), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint")]
    fields += [("ids", "array<int>")] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            kind = batch.schema.field(0).type
            for ids, texts in in_groups(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: list[list] = [[] for _ in fields]
                for doc, got in zip(ids, enc.ids(texts)):
                    got += end
                    for k, (start, length) in enumerate(cut(len(got) // 4, capacity)):
                        part = got[4 * start : 4 * (start + length)]
                        row = (doc, k, start, length, zlib.crc32(part), np.frombuffer(part, "<i4") if keep_ids else None)
                        for column, value in zip(out, row):
                            column.append(value)
                types = [kind, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [f[0] for f in fields])

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    return docs.select("doc_id", text).mapInArrow(run, ", ".join(f"{a} {b}" for a, b in fields))


def pack(found: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (doc_id, piece, start, length, ids_crc32, ...).

    The table is read twice, so pass one that is stored. Only the histogram of lengths, at most `capacity` rows,
    reaches the driver, and the plan that goes back is a function of it alone (see `plan`).
    """
    spark: SparkSession = found.sparkSession
    narrow = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counted = narrow.groupBy("bucket", "length").count()
    by_length = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = written(counted.withColumn("before", F.coalesce(F.sum("count").over(by_length), F.lit(0))), "pack-counts")
    histogram = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    steps = plan(histogram, capacity)
    places = spark.createDataFrame(
        _by_length(steps),
        "length long, steps array<struct<rank:long, per:long, sequence:long, offset:long>>",
    )  # at most `capacity` rows
    here = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = narrow.withColumn("row", F.row_number().over(here)).join(counted.select("bucket", "length", "before"), ["bucket", "length"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("row") - 1).drop("before", "row", "bucket")
    # The last step that begins at or before the rank; steps are in ascending rank.
    placed = ranked.join(F.broadcast(places), "length").withColumn("step", F.expr("element_at(filter(steps, s -> s.rank <= rank), -1)"))
    within = F.col("rank") - F.col("step.rank")
    return placed.withColumns(
        {
            "sequence_id": F.col("step.sequence") + F.floor(within / F.col("step.per")),
            "offset": F.col("step.offset") + F.pmod(within, F.col("step.per")) * F.col("length"),
        }
    ).drop("rank", "steps", "step")


def _by_length(steps: list[tuple]) -> list[tuple[int, list]]:
    out = defaultdict(list)
    for length, *rest in steps:
        out[length].append(tuple(rest))
    return sorted(out.items())


def pack_documents(docs: DataFrame, tokenizer: str = BYTE_BPE, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs `docs`; `keep_ids` also returns each piece's ids."""
    found = pack(written(pieces(docs, tokenizer, capacity, keep_ids=keep_ids), "pack-pieces"), capacity)
    first = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return found.select(*first, *["ids"] * keep_ids)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
