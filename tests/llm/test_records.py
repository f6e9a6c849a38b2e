import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from tamis.llm import records
from tamis.llm.common import documents, scratch_dir


def want(docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(records.WORD_BPE))
    out, start = [], 0
    tie = lambda t: int(np.uint64(xxh64_intdigest(t or "", 42)).astype(np.int64))
    for doc_id, text in sorted(docs, key=lambda r: (r[0] is not None, r[0], tie(r[1]))):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_documents_table(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    rows = records.op3_token_records(spark, sf_dir).collect()
    assert sorted((tuple(r[:4]) for r in rows), key=str) == want(docs)


def test_odd_rows_round_trip(spark):
    rows = [(3, None, 1), (None, "null id", 2), (2, "", 3), (2, "b b", 4), (2, "a", 4), (9, "ÉCOLE  straße\n\nİΣ 漢字 <|endoftext|> it's", 5), (7, "word " * 30000, 6), (7, "word " * 30000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, file long").repartition(3)
    path = scratch_dir(spark, "t")
    manifest = records.write_records(docs, path)
    got = records.read_records(spark, path, manifest, with_ids=True).collect()
    assert sorted((tuple(r[:4]) for r in got), key=str) == want([r[:2] for r in rows])
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, 2, 2, 2, 3, 7, 7, 9]


def test_shuffled_reads(spark, monkeypatch):
    """Every record once, in an order of its own for each seed and epoch, the same again for the same ones."""
    monkeypatch.setattr(records, "OPEN_FILES", 2)
    rows = [(i if i % 9 else None, f"text {i} " * (i % 5)) for i in range(200)] + [(7, "twice"), (7, "twice")]
    path = scratch_dir(spark, "t")
    manifest = records.write_records(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path)
    plain = [(r.doc_id, tuple(r.ids)) for r in records.read_records(spark, path, manifest, with_ids=True).collect()]
    read = lambda seed, epoch=0: [(r.doc_id, tuple(r.ids)) for r in records.read_shuffled(spark, path, manifest, seed, epoch).collect()]
    first = read(1)
    assert sorted(first, key=str) == sorted(plain, key=str) and first == read(1)
    orders = [first, read(2), read(1, 1), plain]
    assert all(a != b for i, a in enumerate(orders) for b in orders[:i])
    near = sum(abs(first.index(a) - first.index(b)) == 1 for a, b in zip(plain, plain[1:]))
    assert near < 30  # neighbours in the files are seldom neighbours here


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = scratch_dir(spark, "t")
    assert records.read_records(spark, path, records.write_records(docs, path)).collect() == []


def test_broken_frames_are_found():
    data = records.frame(5, b"\1\0\0\0\2\0\0\0")
    assert records.unframe(data) == (5, b"\1\0\0\0\2\0\0\0")
    wide = np.array([70_000, 3], "<u4").tobytes()
    assert records.unframe(records.frame(None, wide)) == (None, wide) and len(records.frame(None, wide)) == len(data) + 4
    for k in range(len(data)):
        broken = data[:k] + bytes([data[k] ^ 4]) + data[k + 1 :]
        with pytest.raises(ValueError):
            records.unframe(broken)
