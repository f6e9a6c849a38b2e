"""Streams cut into batches, stopped, run again: the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.streaming import retries, worker
from tamis.streaming.state import ChangeFollower, KeyedBuckets

EVENTS = "event_id long, user_id long, ts string, event_type string, value double"


def events(n, seed=3):
    """One user has a third of all rows; nulls and repeats among the values."""
    rng = np.random.default_rng(seed)
    users = np.where(rng.random(n) < 0.34, 1, rng.integers(2, 9, n))
    kinds = [None if k == 3 else "abc"[k] for k in rng.integers(0, 4, n)]
    minutes = np.sort(rng.integers(0, 20 * 24 * 60, n))
    return [(i, int(u), f"2024-01-{1 + m // 1440:02} {m % 1440 // 60:02}:{m % 60:02}:00", k, 1.0) for i, (u, m, k) in enumerate(zip(users, minutes.tolist(), kinds))]


def put(spark, rows, folder):
    df = spark.createDataFrame(rows, EVENTS).selectExpr("event_id", "user_id", "cast(ts as timestamp_ntz) ts", "event_type", "value")
    df.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def changed_rows(rows):
    last, out = {}, []
    for i, user, _, kind, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if user not in last or last[user] != kind:
            out.append((user, i, kind))
        last[user] = kind
    return sorted(out, key=str)


@pytest.mark.parametrize("files, per_trigger", [(1, None), (4, 1), (4, 3), (12, 1)])
def test_changes_whatever_the_batches(spark, tmp_path, files, per_trigger):
    rows = events(120 if files == 12 else 400)
    for k in range(files):
        put(spark, rows[len(rows) * k // files : len(rows) * (k + 1) // files], tmp_path)
    found = worker.changed(worker.event_stream(spark, str(tmp_path), per_trigger), spark, "t-changed")
    assert sorted(map(tuple, found.collect()), key=str) == changed_rows(rows)


def test_changes_after_a_restart(spark, tmp_path):
    rows, path = events(300), str(tmp_path / "run")
    put(spark, rows[:140], tmp_path)
    worker.changed(worker.event_stream(spark, str(tmp_path), 1), spark, "t", path=path)
    put(spark, rows[140:], tmp_path)
    found = worker.changed(worker.event_stream(spark, str(tmp_path), 1), spark, "t", path=path)
    assert sorted(map(tuple, found.collect()), key=str) == changed_rows(rows)


def test_a_batch_that_is_run_again(spark, tmp_path):
    """Whole, or after it had stopped in the middle of its update: what it finds doesn't change."""
    rows = events(200)
    df = spark.createDataFrame(rows, EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    first, second = df.filter("event_id < 90"), df.filter("event_id >= 90")
    follow = ChangeFollower(str(tmp_path / "s"), "user_id", ["ts", "event_id"], "event_type", F.to_date("ts"), dict(df.dtypes))
    got = lambda batch, n: sorted(r.event_id for r in follow.found(batch, n).collect())
    a = got(first, 0)
    follow.update(first, 0)
    b = got(second, 1)
    follow.update(second.filter("user_id < 4"), 1)  # only some keys
    assert got(second, 1) == b
    follow.update(second, 1)
    follow.update(second, 1)
    assert got(second, 1) == b and sorted(a + b) == sorted(i for _, i, _ in changed_rows(rows))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    store = KeyedBuckets(str(tmp_path / "t"), "k", "k long, at long, v string", 8)
    rows = lambda *r: spark.createDataFrame(list(r), "k long, at long, v string")
    store.upsert(rows(*((i, 0, "a") for i in range(40))), "at")
    files = lambda: {f for f in (tmp_path / "t").rglob("*.parquet")}
    before = files()
    store.upsert(rows((5, 1, "b"), (5, 2, "c"), (5, 0, "old"), (None, 1, "n")), "at")
    store.upsert(rows((5, 1, "b")), "at")  # late
    got = {r.k: r.v for r in store.read(spark).collect()}
    assert got == {**{i: "a" for i in range(40)}, 5: "c", None: "n"}
    assert len(before & files()) >= len(before) - 2


def attempt(items, number):
    need = items["event_id"].mod(5).map({0: 9, 1: 1, 2: 2}).fillna(0)
    return (number > need).to_numpy()


def ended(rows, wait_ms=retries.WAIT_MS, late_ms=86_400_000):
    at = lambda r: int(np.datetime64(r[2].replace(" ", "T")).astype("datetime64[ms]").astype(int))
    now, out = max(map(at, rows)) - late_ms, []
    for r in rows:
        need, due = {0: 9, 1: 1, 2: 2}.get(r[0] % 5, 0), (at(r) // wait_ms + 2) * wait_ms
        tries = 1 + (due <= now) + (due + wait_ms <= now)
        if need < tries:
            out.append((r[0], "done", need + 1))
        elif tries == 3:
            out.append((r[0], "dead", 3))
    return sorted(out)


@pytest.mark.parametrize("stops", [[], [2]])
def test_retries_whatever_the_batches(spark, tmp_path, stops):
    """All at once, file by file, and over a stop after the second file: every item ends once, the same way."""
    own, rows, path = retries.stateful_session(spark), events(200), str(tmp_path / "run")

    def run(per_trigger, where):
        stream = worker.event_stream(own, str(tmp_path), per_trigger).select("event_id", "ts")
        return worker.run_available(retries.with_retries(stream, "event_id", attempt, late="1 day", parts=3), own, "t", path=where)

    for k in range(4):
        put(spark, rows[50 * k : 50 * k + 50], tmp_path)
        if k + 1 in stops:
            assert len(run(1, path).collect()) < 100
    want = ended(rows)
    assert sorted(map(tuple, run(1, path).collect())) == want and {w[1:] for w in want} == {("done", 1), ("done", 2), ("done", 3), ("dead", 3)}
    if not stops:
        assert sorted(map(tuple, run(None, str(tmp_path / "other")).collect())) == want


def test_one_attempt_only(spark, tmp_path):
    own, rows = retries.stateful_session(spark), events(20)
    put(spark, rows, tmp_path)
    stream = worker.event_stream(own, str(tmp_path)).select("event_id", "ts")
    got = worker.run_available(retries.with_retries(stream, "event_id", attempt, most=1, parts=2), own, "t").collect()
    assert sorted((r.event_id, r.state) for r in got) == [(i, "dead" if i % 5 in (0, 1, 2) else "done") for i in range(20)]


def test_moderation_rounds(spark, tmp_path):
    """Items that come again, in the same round or a later one, are handled once; levels only rise."""
    flow = worker.Moderation(str(tmp_path / "m"), "doc", "bigint", 4)
    media = lambda *r: spark.createDataFrame([(i, d, lv, "image/png", s, m, False) for i, d, lv, s, m in r], "item string, doc long, level int, mime string, status string, is_moderated boolean, is_sensitive boolean")
    first = media(("a", 1, 1, "active", None), ("a", 1, 1, "active", None), ("b", 2, 0, "pending", False), ("c", 2, 2, "deleted", False))
    flow.round(first, 0)
    flow.round(first, 0)
    flow.round(media(("a", 1, 2, "active", None), ("d", 1, 0, "active", None), ("e", 3, 2, "active", True), ("f", 2, 2, "active", None)), 1)
    assert sorted(map(tuple, flow.outcome(spark).select("doc", "level", "status", "media").collect())) == [(1, 1, "sensitive", 2), (2, 2, "banned", 2)]
