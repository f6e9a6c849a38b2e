import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tamis.llm import packing
from tamis.llm.common import documents


def best_fit_decreasing(lengths, capacity):
    """One piece at a time, by search through all open sequences."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= n]
        if fits:
            k = min(fits, key=lambda i: rooms[i])
            rooms[k] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for case in range(60):
        capacity = rng.choice([5, 16, 64, 100])
        lengths = [min(capacity, rng.choice([rng.randint(1, capacity), rng.randint(1, 1 + capacity // 4)])) for _ in range(rng.randint(0, 300))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        used, ranks = {}, {n: [] for n in counts}
        steps = packing.plan(counts, capacity)
        for k, (n, rank, per, first, offset) in enumerate(steps):
            end = next((s[1] for s in steps[k + 1 :] if s[0] == n), counts[n])
            for r in range(rank, end):
                ranks[n].append(r)
                used.setdefault(first + (r - rank) // per, []).append((offset + (r - rank) % per * n, n))
        assert all(got == list(range(counts[n])) for n, got in ranks.items())
        for places in used.values():
            assert [p[0] for p in sorted(places)] == [sum(n for _, n in sorted(places)[:i]) for i in range(len(places))]
        assert sorted(capacity - sum(n for _, n in p) for p in used.values()) == best_fit_decreasing(lengths, capacity)


def check(docs, rows, capacity=2048):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.BYTE_BPE))
    want = []
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        head = len(ids) % capacity or capacity
        starts = [0, *range(min(head, len(ids)), len(ids), capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want.append((doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda x: str(x)
    assert sorted(([tuple(r[:5]) for r in rows]), key=key) == sorted(want, key=key)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [x[0] for x in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= capacity
    assert len(places) == len(best_fit_decreasing([w[3] for w in want], capacity))


def test_documents_table(spark, sf_dir):
    docs = documents(spark, sf_dir)
    check([(r.doc_id, r.text) for r in docs.collect()], packing.op1_best_fit_packing(spark, sf_dir).collect())


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (3, "same", None), (3, "same", None), (4, "long " * 9000, "y"), (5, "Ünïcode 漢字 <|endoftext|> \x1c z  \n\n a", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    check([r[:2] for r in rows], packing.pack_documents(docs).collect())
    assert packing.pack_documents(docs.limit(0)).collect() == []
    kept = packing.pack_documents(docs, keep_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in kept)
