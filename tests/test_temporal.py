"""Scenes, sequences, balanced assignment, digests and the video decision against plain loops."""

import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.functions import policy
from tamis.operators import balancing, digest, temporal
from tamis.registry import QUERIES
from tamis.sources import scans, scenes


def normalised(item, fps, place):
    """(shot, frames, seconds) of one element; None if it is left out, ValueError or TypeError if it holds no number."""
    number = lambda v: float(v) if not isinstance(v, (list, dict)) and v is not None else float("spoiled")
    whole = lambda v: int(v) if v is not None and not isinstance(v, (list, dict)) else int("spoiled")
    if isinstance(item, dict):
        start = number(item["start_time"]) if "start_time" in item else 0.0
        end = number(item["end_time"]) if "end_time" in item else start
        first = whole(item["start_frame"]) if "start_frame" in item else round(start * fps)
        last = whole(item["end_frame"]) if "end_frame" in item else round(end * fps)
        return (whole(item["shot_id"]) if "shot_id" in item else place, first, max(first, last), start, end)
    if isinstance(item, list) and len(item) >= 2:
        a, b = item[:2]
        if isinstance(a, int) and isinstance(b, int):
            return (place, int(a), max(int(a), int(b)), *((x / fps if fps > 0 else 0.0) for x in (a, b)))
        a, b = number(a), number(b)
        return (place, *((round(x * fps) if fps > 0 else 0) for x in (a, b)), a, b)
    return None


def expected(text, fps, frames):
    try:
        items = json.loads(text or "")
        found = [normalised(x, fps, i) for i, x in enumerate(items)] if isinstance(items, list) else []
    except (ValueError, TypeError):
        found = []
    found = [(*f, True) for f in found if f]
    return found or [(0, 0, max(frames - 1, 0), 0.0, frames / fps if fps > 0 else 0.0, False)]


LISTS = [
    "[]", "nothing", None, "{}", '"x"', "[[1, 2]]", "[[5, 2]]", "[[5.0, 2.5]]", "[[1, 2.5], [0.5, 2]]", "[[7]]", "[null, [1, 2]]", '["3-4", [3, 4]]', "[[1, 2, 3]]",
    '[{"start_time": 1.5}]', '[{"start_time": "1.25", "end_time": 2}]', '[{"end_time": "soon"}]', '[{"start_time": null}]', '[{"start_frame": 9, "end_frame": 4, "shot_id": 3}]', '[{"start_frame": 2.9, "end_frame": "11"}]',
    '[{"start_frame": "2.9"}]', '[{"start_time": [1]}]', '[["a", 2]]', "[[true, 3]]", '[{"other": 1}, [2, 3], {}]', "[[0.1, 0.3], [1e1, 2]]", '[[1, 2], {"shot_id": "x"}]', "[[null, 2]]",
]


@pytest.mark.parametrize("fps, frames", [(25.0, 100), (0.0, 7), (29.97, 0)])
def test_scene_lists(spark, fps, frames):
    df = spark.createDataFrame([(i, t, fps, frames) for i, t in enumerate(LISTS)], "video long, list string, fps double, frames long")
    got = {}
    for r in scenes.scenes(df, "list", "fps", "frames").collect():
        got.setdefault(r.video, []).append((r.shot_id, r.start_frame, r.end_frame, round(r.start_time, 9), round(r.end_time, 9), r.detected))
    for i, t in enumerate(LISTS):
        want = [(*w[:3], round(w[3], 9), round(w[4], 9), w[5]) for w in expected(t, fps, frames)]
        assert sorted(got[i]) == sorted(want), t


def test_scenes_without_a_rate(spark):
    df = spark.createDataFrame([(1, "[[2, 4]]", None, None), (2, None, None, 5)], "video long, list string, fps double, frames long")
    assert [tuple(r)[3:] for r in scenes.scenes(df, "list", "fps", "frames").orderBy("video").collect()] == [(0, 2, 4, 0.0, 0.0, True), (0, 0, 4, 0.0, 0.0, False)]


def test_sinkhorn(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 4))
    for iterations, epsilon in ((1, 0.5), (3, 0.05), (40, 0.5)):
        q = np.exp(x / epsilon).T
        q /= q.sum()
        for _ in range(iterations):
            q = q / q.sum(axis=1, keepdims=True) / q.shape[0]
            q = q / q.sum(axis=0, keepdims=True) / q.shape[1]
        q = (q * q.shape[1]).T
        df = spark.createDataFrame([(i, list("abcd"), [float(v) for v in r]) for i, r in enumerate(x)], "id long, labels array<string>, logits array<double>").repartition(5)
        got = np.zeros_like(q)
        for r in balancing.balanced(df, "id", epsilon, iterations).collect():
            got[r.id, "abcd".index(r.label)] = r.q
        assert np.allclose(got, q, rtol=1e-9) and np.allclose(got.sum(axis=1), 1)
    assert np.allclose(got.sum(axis=0), 15, rtol=1e-3)  # after many rounds the classes are as large as one another
    with pytest.raises(ValueError):
        balancing.balanced(df, "id", 0.5, 0)


def test_previous_across_buckets(spark):
    """A sequence with most rows, cut into many buckets, some of them empty; nulls are values."""
    rng = random.Random(4)
    rows = [(("hot", None, "few")[0 if i % 5 else 1 + i % 2], i * 7 % 1000, rng.choice([None, "a", "b"])) for i in range(700)]
    df = spark.createDataFrame(rows, "by string, at long, v string").repartition(6)
    for width in (1, 13, 400, 10_000):
        found = temporal.with_previous(df, ["by"], ["at"], ["v"], F.floor(F.col("at") / width)).collect()
        for name in ("hot", None, "few"):
            own = sorted((r.at, r.v, r.previous and (r.previous.v,)) for r in found if r.by == name)
            assert [o[2] for o in own] == [None, *((o[1],) for o in own[:-1])]
        got = sorted((r.by or "", r.at) for r in temporal.changes(df, ["by"], ["at"], "v", F.floor(F.col("at") / width)).collect())
        want = []
        for name in ("hot", None, "few"):
            own = sorted(((t, v) for b, t, v in rows if b == name), key=lambda x: x[0])
            want += [(name or "", t) for k, (t, v) in enumerate(own) if not k or own[k - 1][1] != v]
        assert got == sorted(want)


def test_a_hot_sequence_is_many_groups(spark):
    """No task sorts more than a bucket of a sequence that holds all rows."""
    df = spark.range(4000).select(F.lit("one").alias("by"), F.col("id").alias("at"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    met = temporal.with_previous(df, ["by"], ["at"], ["v"], F.floor(F.col("at") / 100))
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    sorts = [line for line in plan.splitlines() if "Window" in line and "lag(" in line]
    assert sorts and all("_bucket" in line for line in sorts)


def test_coherence(spark):
    rng = np.random.default_rng(3)
    videos = {"a": rng.normal(size=(50, 3)), "b": rng.normal(size=(1, 3)), "z": np.zeros((4, 3))}
    df = spark.createDataFrame([(k, i, [float(x) for x in v]) for k, m in videos.items() for i, v in enumerate(m)], "by string, at long, v array<double>")
    got = {r.by: r for r in temporal.coherence(df, "by", "at", "v", F.floor(F.col("at") / 8)).collect()}
    for k, m in videos.items():
        norm = np.maximum(np.linalg.norm(m, axis=1), 1e-9)
        cos = [(m[i] @ m[i + 1]) / (norm[i] * norm[i + 1]) for i in range(len(m) - 1)]
        assert got[k].frames == len(m)
        if len(m) > 1:
            assert math.isclose(got[k].similarity, np.mean(cos), abs_tol=1e-9) and math.isclose(got[k].variance, m.var(axis=0, ddof=1).mean(), abs_tol=1e-9)
        else:
            assert got[k].similarity is None and got[k].variance is None


def test_pretext_clips(spark):
    lengths = {i: n for i, n in enumerate([40, 32, 16, 15, 7, 3, 1] * 6)}
    df = spark.createDataFrame([(v, i) for v, n in lengths.items() for i in range(n)], "v long, i long")
    rows = temporal.pretext(df, "v", "i", 1).collect()
    assert rows == temporal.pretext(df, "v", "i", 1).collect() or sorted(map(tuple, rows)) == sorted(map(tuple, temporal.pretext(df.repartition(3), "v", "i", 1).collect()))
    seen = set()
    for v, n in lengths.items():
        own = sorted((r for r in rows if r.v == v), key=lambda r: r.i)
        clip, first = min(n, 16), own[0]
        at = lambda c: [r[c] for r in own if r[c] is not None]
        assert sorted(at("direction_at")) == list(range(clip)) and at("direction_at") == (list(range(clip)), list(range(clip))[::-1])[first.y_direction]
        size = clip // 4
        shuffled = at("shuffle_at")
        assert sorted(shuffled) == list(range(4 * size)) and (shuffled != list(range(4 * size))) == bool(first.y_shuffle and size)
        assert all(shuffled[k] + 1 == shuffled[k + 1] for k in range(4 * size - 1) if (k + 1) % max(size, 1))
        assert at("speed_at") == (list(range(clip)) if not first.y_speed else list(range((min(n, 32) + 1) // 2)))
        seen.add((first.y_direction, first.y_shuffle, first.y_speed))
    assert len(seen) >= 6


def test_digests(spark):
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    stems = [f"clip{i}" for i in range(500)] + ["hot"] * 400
    df = spark.createDataFrame([("train", s) for s in stems] + [("test", "one"), ("test", None)], "split string, stem string")
    found = {r.split: (r.n, r.digest) for r in digest.digests(df, "split", "stem").collect()}
    count = {s: stems.count(s) for s in stems}
    tree = {}
    for s, c in count.items():
        tree.setdefault(md5(s)[:2], {}).setdefault(md5(s)[:4], []).append(f"{md5(s)}:{c}")
    leaf = lambda entries: md5("".join(sorted(entries)))
    node = lambda leaves: md5("".join(f"{k}:{leaf(v)}" for k, v in sorted(leaves.items())))
    assert found["train"] == (900, md5("".join(f"{k}:{node(v)}" for k, v in sorted(tree.items())))) and found["test"][0] == 2
    assert {r.split: (r.n, r.digest) for r in digest.digests(df.repartition(9, "stem"), "split", "stem").collect()} == found
    for other in (df.filter("stem <> 'clip7'"), df.unionByName(df.filter("stem = 'clip7'")), df.replace("clip7", "clip_7", "stem")):
        assert {r.split: r.digest for r in digest.digests(other, "split", "stem").collect()}["train"] != found["train"][1]
    assert digest.digests(df.limit(0), "split", "stem").collect() == []


def decision(peak, nsfw, high, resolution, p, anime, gore, dark, warm, composite):
    sport = p > 0.55
    score = max(0.0, peak - resolution)
    for flag, less in ((anime, 0.15), (dark, 0.12), (warm, 0.10), (composite, 0.20), (sport, 0.15)):
        score = max(0.0, score - less) if flag else score
    if high >= 6 and (dark or warm or composite):
        score = peak
    if sport:
        nsfw = max(0.0, nsfw - round(1 - max(0.15, 1 - p), 2))
    over = score >= (0.65 if sport else 0.5)
    violence = "safe" if not over or sport else "blur" if anime else "ban" if gore else "blur"
    return round(score, 9), round(nsfw, 9), violence, "ban" if nsfw >= 0.8 else "blur" if nsfw >= 0.7 else "safe"


def test_video_decision(spark):
    rng = random.Random(9)
    rows = [(rng.random() ** 0.3, rng.random() ** 0.3, rng.randint(0, 9), rng.choice([0.0, 0.08, 0.2]), rng.random(), *(rng.random() < 0.3 for _ in range(5))) for _ in range(600)]
    names = "peak nsfw high resolution p anime gore dark warm composite".split()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["id", *names])
    out = policy.video_decision(*(F.col(c) for c in names))
    got = {r.id: r for r in df.select("id", *(c.alias(n) for n, c in out.items())).collect()}
    want = [decision(*r) for r in rows]
    assert [(round(got[i].violence_score, 9), round(got[i].nsfw_score, 9), got[i].violence, got[i].nsfw) for i in range(600)] == want
    assert all(got[i].flagged == (w[2] != "safe" or w[3] != "safe") for i, w in enumerate(want))
    assert {w[2:] for w in want} >= {("ban", "safe"), ("blur", "safe"), ("safe", "safe"), ("safe", "ban"), ("safe", "blur")}


def test_numbers_at_the_end_of_names(spark):
    names = ["a_12", "a_b_3", "a_x", "12", "a_1.5", "a_1e3", "a_-2.", "a_.5", "a_.", "a_nan", "a_Infinity", "a_1d", "a_0x1", "a_", "_7", "a_ 7", "a_1_2", "a_1e"]

    def cut(name):
        base, found, tail = name.rpartition("_")
        try:
            float(tail if found else "no number")
        except ValueError:
            return name
        return base

    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", scans.video_id(F.col("n")).alias("v")).collect()
    assert {r.n: r.v for r in got} == {n: cut(n) for n in names}


def test_paths_are_cleaned(spark):
    paths = {" ./a//b ": "a/b", ".//./a": "a", "././x//y": "x/y", "/./a": "/./a", "\\a\\\\b": "/a/b", "../a": "../a", "./": "", "\t./c\n": "c", ".a/b": ".a/b"}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", scans.normal_path(F.col("p")).alias("n")).collect()
    assert {r.p: r.n for r in got} == paths


def test_long_videos_have_all_their_shots(spark, tmp_path):
    rows = spark.range(2500).selectExpr("id event_id", "timestamp_ntz '2024-01-01 00:00:00' ts", "7L user_id", "'a' event_type", "1.0D value", "'{\"k\": 1}' props")
    rows.write.parquet(str(tmp_path / "events.parquet"))
    frames = [r.frame for r in QUERIES["longest_shots"](spark, str(tmp_path)).collect()]
    starts = sorted(range(0, 2500, 10), key=lambda k: (-(min(2500, k + 5 + k % 7) - k), k))[:3]
    assert {f // 10 * 10 for f in frames} == set(starts) and max(starts) > 100
