"""Token ids in length-delimited binary record files, with a separate offset index per file.

A record file is a sequence of frames, a frame being

    length   u64   bytes of the payload
    check    u32   masked checksum of the eight length bytes
    payload        i64 doc_id, u64 flags, then the ids
    check    u32   masked checksum of the payload

all little-endian. Of the flags, bit 0 says that the doc_id is null, bit 1 that the ids are u16, for they all fit;
else they are u32. The checksum is CRC-32 (zlib's; a vectorised CRC-32C isn't among the libraries here), masked as
usual for stored checksums: rotated right by 15 bits, plus 0xa282ead8. The index file has 32 bytes for each frame,
in file order: u64 byte offset of the frame, u64 payload length, i64 doc_id, u64 number of ids, so a reader can seek
to any record, in any order, without scanning. A manifest row per file (number, rows, ids) gives each file its place
in the whole.

Each task writes its own pair of files in the shared folder: to a name of its own attempt, renamed at the end, so a
task that is run again replaces its files and leaves nothing half-written. Files are in ascending doc_id order, and
so are the rows in each.

Cases: a null text is empty; an empty text is the end id alone; null doc_ids come first; repeated rows are written
once per row (rows of one doc_id ordered by a hash of their text); a very long text is one frame; extra columns are
ignored; an empty table writes no frames.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, file_system, scratch_dir, written
from .tokens import WORD_BPE, encoder, in_groups

END_ID = 1
INDEX = np.dtype([("offset", "<u8"), ("length", "<u8"), ("doc_id", "<i8"), ("n_ids", "<u8")])
MANIFEST = "file int, name string, n_rows bigint, n_ids bigint, n_bytes bigint"
_HEAD = struct.Struct("<qQ")
#: Record files that a task of a shuffled read holds open.
OPEN_FILES = 64


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: bytes) -> bytes:
    """The frame of a document's ids, given as u32."""
    wide = np.frombuffer(ids, "<u4")
    small = not len(wide) or wide.max() < 1 << 16
    payload = _HEAD.pack(doc_id or 0, (doc_id is None) | small << 1) + (wide.astype("<u2").tobytes() if small else ids)
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes) -> tuple[int | None, bytes]:
    """doc_id and ids (as u32) of one whole frame; raises on a broken one."""
    (length,), (check,) = struct.unpack_from("<Q", data), struct.unpack_from("<I", data, 8)
    if check != masked(data[:8]) or len(data) != length + 16:
        raise ValueError("broken frame: its length doesn't fit its checksum")
    payload = data[12 : 12 + length]
    if struct.unpack_from("<I", data, 12 + length)[0] != masked(payload):
        raise ValueError("broken frame: its payload doesn't fit its checksum")
    doc_id, flags = _HEAD.unpack_from(payload)
    ids = payload[_HEAD.size :]
    return None if flags & 1 else doc_id, np.frombuffer(ids, "<u2").astype("<u4").tobytes() if flags & 2 else ids


def write_records(docs: DataFrame, path: str, tokenizer: str = WORD_BPE, end_id: int = END_ID) -> DataFrame:
    """Writes `docs` (doc_id, text) to record files below `path`; returns their manifest, one row per file."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(path)
        task = TaskContext.get()
        number, name = task.partitionId(), f"part-{task.partitionId():06d}"
        attempt = f"{root}/_attempt-{task.taskAttemptId()}-{name}"
        files.create_dir(root, recursive=True)
        enc, at, n_ids, index = encoder(tokenizer), 0, 0, []
        with files.open_output_stream(f"{attempt}.rec") as out:
            for batch in batches:
                for ids, texts in in_groups(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for doc_id, got in zip(ids, enc.ids(texts)):
                        data = frame(doc_id, got + end)
                        index.append((at, len(data) - 16, doc_id or 0, len(got) // 4 + 1))
                        out.write(data)
                        at, n_ids = at + len(data), n_ids + len(got) // 4 + 1
        with files.open_output_stream(f"{attempt}.idx") as out:
            out.write(np.array(index, INDEX).tobytes())
        for kind in ("rec", "idx"):
            files.move(f"{attempt}.{kind}", f"{root}/{name}.{kind}")
        row = {"file": number, "name": name, "n_rows": len(index), "n_ids": n_ids, "n_bytes": at}
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds)], list(row))

    chosen = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # Rows of one doc_id, however many and however alike, may be split by their texts' hashes and their own numbers.
    ties = {"_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}
    ordered = chosen.withColumns(ties).repartitionByRange("doc_id", *ties).sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text")
    return written(ordered.mapInArrow(run, MANIFEST), "record-manifest")


def read_records(spark: SparkSession, path: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Reads record files back, frame by frame by the offset index: one row per record, checksums verified.

    `start` is the number of ids in all records before it: those of earlier files (a running sum over the manifest,
    a row per file) plus those before it in its own.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.filter("n_rows > 0").withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    fields = ["doc_id bigint", "start bigint", "n_tokens bigint", "ids_crc32 bigint", "file int", "frame_offset bigint"] + ["ids array<int>"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(path)
        types = [pa.int64()] * 4 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
        names = [f.split()[0] for f in fields]
        for batch in batches:
            for number, name, base in zip(*(batch.column(k).to_pylist() for k in range(3))):
                with files.open_input_stream(f"{root}/{name}.idx") as source:
                    index = np.frombuffer(source.read(), INDEX)
                starts = base + np.cumsum(index["n_ids"].astype(np.int64)) - index["n_ids"].astype(np.int64)
                out: list[list] = [[] for _ in fields]
                size = 0
                with files.open_input_file(f"{root}/{name}.rec") as source:
                    for (at, length, _, n), start in zip(index.tolist(), starts.tolist()):
                        doc_id, ids = unframe(source.read_at(length + 16, at))
                        if len(ids) != 4 * n:
                            raise ValueError(f"{name}: the index and the frame at {at} don't agree")
                        row = (doc_id, start, n, zlib.crc32(ids), number, at, np.frombuffer(ids, "<i4") if with_ids else None)
                        for column, value in zip(out, row):
                            column.append(value)
                        size += with_ids * len(ids)
                        if len(out[0]) >= 10_000 or size > 16_000_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)
                            out, size = [[] for _ in fields], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    spread = placed.select("file", "name", "base").repartition(max(1, min(manifest.count(), spark.sparkContext.defaultParallelism * 4)), "file")
    return spread.mapInArrow(run, ", ".join(fields))


def read_shuffled(spark: SparkSession, path: str, manifest: DataFrame, seed: int, epoch: int = 0) -> DataFrame:
    """All records in an order drawn by seed and epoch: doc_id, ids and draw, in ascending draw from partition to partition.

    Only places from the index files are shuffled, 32 bytes a record; a task then seeks to its records in whatever files
    they are, with at most OPEN_FILES of them open. The draw is a hash of seed, epoch, file and offset, so an order can be
    had again, and another epoch gives another one.
    """

    most = OPEN_FILES

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{root}/{name}.idx") as source:
                    index = np.frombuffer(source.read(), INDEX)
                columns = [pa.array([name] * len(index), pa.string()), *(pa.array(index[c].astype(np.int64)) for c in ("offset", "length"))]
                yield pa.RecordBatch.from_arrays(columns, ["name", "frame_offset", "length"])

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = file_system(path)
        opened: dict = {}
        for batch in batches:
            out: list[list] = [[], [], []]
            for name, at, length, draw in zip(*(c.to_pylist() for c in batch.columns)):
                if name not in opened:
                    if len(opened) >= most:
                        opened.pop(next(iter(opened))).close()
                    opened[name] = files.open_input_file(f"{root}/{name}.rec")
                doc_id, ids = unframe(opened[name].read_at(length + 16, at))
                for column, value in zip(out, (doc_id, np.frombuffer(ids, "<i4"), draw)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.list_(pa.int32()), pa.int64()))], ["doc_id", "ids", "draw"])
        for source in opened.values():
            source.close()

    found = manifest.filter("n_rows > 0").select("name").mapInArrow(places, "name string, frame_offset bigint, length bigint")
    drawn = found.withColumn("draw", F.xxhash64(F.lit(seed), F.lit(epoch), "name", "frame_offset"))
    return drawn.repartitionByRange("draw").sortWithinPartitions("draw", "name", "frame_offset").mapInArrow(frames, "doc_id bigint, ids array<int>, draw bigint")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "records")
    manifest = write_records(documents(spark, sf_dir), path)
    return read_records(spark, path, manifest).select("doc_id", "start", "n_tokens", "ids_crc32", "file", "frame_offset")
