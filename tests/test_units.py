"""Edge cases on small hand-written rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.functions import hashing, policy, sequences
from tamis import sinks
from tamis.operators import audit, calibration, curation, moderation, reports, scoring, search
from tamis.operators import metrics as m
from tamis.registry import QUERIES
from tamis.session import first_column, require_columns
from tamis.sources import config, scans
from tamis.streaming import worker


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def array(*values):
    return F.array(*(F.lit(float(v)) for v in values)) if values else F.array().cast("array<double>")


def test_bucket_is_the_whole_md5(spark):
    keys = [f"k{i}" for i in range(300)]
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", hashing.percent_bucket(F.col("k")).alias("b")).collect()
    assert all(r.b == int(hashlib.md5(r.k.encode()).hexdigest(), 16) % 100 for r in got)
    with pytest.raises(ValueError):
        hashing.hash_split(F.col("k"), 0.9, 0.2)


@pytest.mark.parametrize("n", [0, 1, 2, 15, 16, 32, 33])
def test_resample_is_linear(spark, n):
    x = [((i * 7) % 11) / 10 for i in range(n)]
    got = one(spark, sequences.resample(array(*x), 16).alias("r")).r
    want = np.interp(np.linspace(0, n - 1, 16), range(n), x) if n else np.zeros(16)
    assert np.allclose(got, want)


@pytest.mark.parametrize("x", [[], [0.3], [0.9, 0.1], [0.5] * 15, [0.2, 1.4, -0.1] * 6])
def test_noisy_or(spark, x):
    k = min(len(x), max(3, int(np.ceil(0.2 * len(x)))))
    want = 1 - np.prod([1 - p + 1e-6 for p in sorted(x)[::-1][:k]]) if x else 0.0
    assert np.isclose(one(spark, sequences.noisy_or(array(*x)).alias("p")).p, want)


@pytest.mark.parametrize("x, pattern, share", [([0.8], "no_context", 0.3), ([0.1, 0.12, 0.78], "fast_action", 0.65), ([0.2, 0.7, 0.2], "sustained_action", 0.8), ([0.0, 0.65, 0.1], "isolated_spike", 0.25), ([0.1, 0.3], "weak_signal", 0.4)])
def test_peak_patterns(spark, x, pattern, share):
    p, e = sequences.peak_evidence(array(*x))
    r = one(spark, p.alias("p"), e.alias("e"))
    assert r.p == pattern and np.isclose(r.e, max(x) * share)


def test_penalties_stop_at_zero_and_bypass(spark):
    on = {n: F.lit(True) for n in policy.PENALTIES}
    assert one(spark, policy.penalised(F.lit(0.3), F.lit(0.2), **on).alias("p")).p == 0
    bypass = lambda n, flag: one(spark, policy.with_bypass(F.lit(0.9), F.lit(0.1), F.lit(n), F.lit(flag), F.lit(False), F.lit(False)).alias("p")).p
    assert (bypass(6, True), bypass(5, True), bypass(6, False)) == (0.9, 0.1, 0.1)
    level = lambda a, b: one(spark, policy.image_level(F.lit(a), F.lit(b)).alias("l")).l
    assert [level(0.0, 0.699), level(0.0, 0.7), level(0.8, 0.0), level(0.9, 0.0), level(0.0, 0.9)] == [0, 1, 1, 2, 2]


def test_windows_reach_the_tail(spark):
    starts = lambda n: one(spark, sequences.windows(F.lit(n), 16, 8).alias("w")).w
    assert [starts(16), starts(17), starts(40), starts(3)] == [[0], [0, 1], [0, 8, 16, 24], [0]]


def test_cap_keeps_locked_rows(spark):
    rows = spark.createDataFrame([(i, "a", "test" if i % 3 == 0 else "", f"{i % 7}") for i in range(60)], "id long, g string, locked_split string, draw string")
    kept = curation.capped(rows, ["g"], 5, "draw", "id").collect()
    assert sum(r.locked_split == "" for r in kept) == 5 and sum(r.locked_split != "" for r in kept) == 20
    assert curation.capped(rows, ["g"], 0, "draw", "id").count() == 60


def test_group_split_keeps_groups_and_sizes(spark):
    rows = [(i, "s", f"g{i}", f"p{i:03}", 0, 0, "") for i in range(396)] + [(900 + i, "t", "only", f"q{i}", 0, 0, "") for i in range(4)] + [(999, "s", "g1", "z", 0, 0, "val")]
    df = spark.createDataFrame(rows, "doc_id long, source string, group_id string, path string, violence int, nsfw int, locked_split string").withColumn("split", F.lit(""))
    got = curation.group_split(df, 0.15, 0.15, 7).collect()
    count = lambda s: sum(r.split == s for r in got if r.source == "s" and not r.locked_split)
    assert (count("test"), count("val"), count("train")) == (60, 60, 276)
    assert {r.split for r in got if r.source == "t"} == {"train"} and [r.split for r in got if r.locked_split] == ["val"]


def test_hamming_pairs_lose_none(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    values = [int(v) for v in base] + [int(v ^ np.int64((1 << int(a)) | (1 << int(b)))) for v, a, b in zip(base, rng.integers(0, 63, 60), rng.integers(0, 63, 60))]
    values += values[:40] * 3  # copies are one class
    got = {(r.id1, r.id2, r.n1, r.n2): r.distance for r in search.hamming_pairs(spark.createDataFrame(list(enumerate(values)), "id long, bits long"), 3).collect()}
    first, n = {}, {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
        n[v] = n.get(v, 0) + 1
    u = sorted(first.items(), key=lambda x: x[1])
    bits = lambda a, b: int(np.bitwise_count(np.int64(a).view(np.uint64) ^ np.int64(b).view(np.uint64)))
    want = {(i, j, n[a], n[b]): bits(a, b) for k, (a, i) in enumerate(u) for b, j in u[k + 1 :] if bits(a, b) <= 3}
    assert got == want and len(want) >= 60


def test_auc_of_ties_and_single_class(spark):
    rows = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("b", 1, 0.3)], "label string, y int, score double")
    got = {r.label: r.auc for r in m.roc_auc(rows, "label").collect()}
    assert got == {"a": 0.75, "b": None}


def test_scans(spark, tmp_path):
    for name in ("train/fight/a_1.MP4", "val/fight/b.mp4", "train/normal/c.txt", "train/normal/d.avi"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    files = scans.media_files(spark, str(tmp_path), content=True)
    rows = scans.labelled_by_directory(files, {"fight": 1, "normal": 0}, {"val": "test"})
    listed = scans.with_split_list(rows, spark.createDataFrame([("d",)], "name string"), "test")
    got = {r.path.rsplit("/", 1)[1]: (r.label, r.locked_split, r.md5) for r in listed.collect()}
    x = hashlib.md5(b"x").hexdigest()
    assert got == {"a_1.MP4": (1, "", x), "b.mp4": (1, "test", x), "d.avi": (0, "test", x)}
    boxes = one(spark, scans.box_labels(F.lit("1 .5 .5 .1 .1\n\n2 .5\n3 a .5 .1 .1\r\n")).alias("b")).b
    assert [(b.cls, b.cx) for b in boxes] == [(1, 0.5), (3, None)]
    found = lambda j: one(spark, scans.thresholds(F.lit(j)).alias("t")).t
    assert found('{"a": 0.5, "b": "x"}') == {"a": 0.5} and found('{"recommended_thresholds": {"a": 1}}') == {"a": 1.0}
    both = '{"recommended_thresholds": {"a": 0.1, "b": 0.2}, "thresholds": {"b": 0.7, "c": "no"}, "d": 1}'
    assert found(both) == {"a": 0.1, "b": 0.7} and found('{"thresholds": {}}') == {}
    assert scans.media_files(spark, str(tmp_path / "nowhere")).collect() == [] and scans.media_files(spark, str(tmp_path / "nowhere"), content=True).columns == ["path", "length", "md5"]


def test_config_and_columns(spark):
    trees = {"a": {"inherits": "b", "x": {"p": 1}}, "b": {"x": {"p": 0, "q": 2}, "y": 3}, "c": {"inherits": "c"}}
    assert config.inherited("a", trees.get) == {"x": {"p": 1, "q": 2}, "y": 3}
    with pytest.raises(ValueError):
        config.inherited("c", trees.get)
    df = spark.range(1)
    assert require_columns(df, ["id"]) is df and first_column(df, "x", "id") == "id"
    with pytest.raises(ValueError, match="x, y"):
        require_columns(df, ["x", "id", "y"])


def split_sizes(df):
    return {r.split: r["count"] for r in df.groupBy("split").count().collect()}


@pytest.mark.parametrize("n, cap, want", [(1000, None, (100, 150, 750)), (1000, 500, (100, 150, 500)), (250, None, (30, 37, 183)), (100, None, (30, 30, 40)), (99, None, (19, 19, 61)), (30, None, (10, 10, 10)), (15, None, (10, 5, 0))])
def test_floor_split_sizes(spark, n, cap, want):
    """Test has a tenth and val 15 percent, 30 at least; classes under 100 give a fifth, 10 at least, to each."""
    rows = spark.range(n).select("id", F.lit("weapon").alias("g"), F.md5(F.col("id").cast("string")).alias("draw"))
    got = split_sizes(curation.floor_split(rows, ["g"], "draw", "id", None if cap is None else F.lit(cap)))
    assert tuple(got.get(s, 0) for s in ("test", "val", "train")) == want


def test_locked_split_guards(spark):
    rows = [(i, "a", "") for i in range(2)] + [(10 + i, "b", "") for i in range(3)] + [(20 + i, "c", "") for i in range(100)] + [(200 + i, "c", "val") for i in range(7)]
    df = spark.createDataFrame(rows, "id long, g string, locked_split string").selectExpr("*", "md5(string(id)) AS d1", "md5(concat('x', id)) AS d2")
    got = curation.locked_aware_split(df, "g", 0.15, 0.1, "d1", "d2", "id").collect()
    size = lambda g, s: sum(r.g == g and r.split == s for r in got)
    assert len(got) == len(rows) and [size("a", s) for s in ("test", "val", "train")] == [0, 0, 2]
    assert [size("b", s) for s in ("test", "val", "train")] == [1, 0, 2]  # two are left: too few for val
    assert [size("c", s) for s in ("test", "val", "train")] == [15, 7 + math.ceil(0.1 / 0.85 * 85), 85 - math.ceil(0.1 / 0.85 * 85)]


def test_ranks_of_split_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(i, None if g == 0 else f"g{g}", hashlib.md5(str(i // 2).encode()).hexdigest()) for i, g in enumerate(rng.integers(0, 3, 2000).tolist())]
    got = curation.ranked(spark.createDataFrame(rows, "id long, g string, draw string"), ["g"], "draw", "id", size="n").collect()
    for g in (None, "g1", "g2"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.rank)
        assert [(r.draw, r.id) for r in mine] == sorted((d, i) for i, x, d in rows if x == g) and [r.rank for r in mine] == list(range(1, len(mine) + 1)) and {r.n for r in mine} == {len(mine)}


def test_grid_search_is_the_plain_loop(spark):
    """Against a loop over thresholds, on scores that stand on grid points, below and above the grid."""
    rng = np.random.default_rng(4)
    grid = [float(t) for t in np.linspace(0.01, 0.99, 199)]
    assert np.allclose(calibration.WIDE_GRID, grid, atol=1e-15) and np.allclose(calibration.NARROW_GRID, np.linspace(0.05, 0.95, 100), atol=1e-15)
    score = np.r_[rng.choice(calibration.WIDE_GRID, 150), rng.random(150), 0, 1, 0.005, 0.995]
    y = (rng.random(len(score)) < score).astype(int)
    df = spark.createDataFrame([("a", int(b), float(s)) for b, s in zip(y, score)] + [("b", 0, 0.5)], "label string, y int, score double")

    def rates(t):
        p = score >= t
        tp, fp, fn = (p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum()
        pr, rc = tp / max(1, tp + fp), tp / max(1, tp + fn)
        f = lambda b: (1 + b * b) * tp / max(1e-9, (1 + b * b) * tp + b * b * fn + fp)
        return dict(t=t, p=pr, r=rc, f1=f(1), f2=f(2))

    every = [rates(t) for t in calibration.WIDE_GRID]
    best = max(every, key=lambda m: (round(m["f2"], 9), -m["t"]))
    got = {r.label: r for r in calibration.best_on_grid(df, calibration.WIDE_GRID, 2.0, "label").collect()}
    assert got["a"].threshold == best["t"] and abs(got["a"].f - best["f2"]) < 1e-8 and got["b"].threshold == calibration.WIDE_GRID[0] and got["b"].f == 0
    for floor in (0.6, 1.1):
        ok = [m for m in every if m["p"] >= floor]
        want = max(ok, key=lambda m: (m["r"], m["f2"], m["p"], -m["t"])) if ok else max(every, key=lambda m: (m["f1"], -m["t"]))
        r = {r.label: r for r in calibration.with_precision_floor(df, floor, "label").collect()}["a"]
        assert (r.selection, r.threshold) == ("precision_floor" if ok else "f1", want["t"]) and abs(r.recall - want["r"]) < 1e-12


def test_temperature_ties_go_by_order(spark):
    """The fold over temperatures, written out on the table of their errors."""
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([("a", int(rng.random() < s), float(s)) for s in rng.random(400)] + [("b", 1, 0.5)], "label string, y int, score double")
    got = {r.label: r for r in calibration.best_temperature(rows, "label").collect()}
    for label in ("a", "b"):
        best = (1.0, math.inf, math.inf)
        for r in sorted((r for r in calibration.calibration_by_temperature(rows, "label").collect() if r.label == label), key=lambda r: r.temperature):
            if r.ece < best[1] or abs(r.ece - best[1]) < 1e-6 and r.brier < best[2]:
                best = (r.temperature, r.ece, r.brier)
        assert (got[label].temperature, got[label].ece, got[label].brier) == best
    assert got["b"].temperature == 0.25  # a score of one half is the same at every temperature: the first stays


def test_gates_probes_and_health(spark):
    gate = lambda *v: one(spark, calibration.gate(*map(F.lit, v), *calibration.GATES["gore"]).alias("g")).g
    assert [gate(0.88, 0.80, 0.05, 0.05), gate(0.879, 0.9, 0.0, 0.0), gate(0.9, 0.9, 0.10, 0.09), gate(0.9, 0.9, 0.2, 0.1)] == ["pass", "fail_1", "pass_scaled", "fail_2"]
    tier = lambda *v: one(spark, calibration.shortcut_tier(*map(F.lit, v))[1].alias("t")).t
    assert [tier(0.2, 0.3, 0.9), tier(0.2, 0.5, 0.1), tier(0.10, 0.40, 0.85)] == ["shortcut", "partial", "ok"]
    issues = lambda *v: one(spark, calibration.health_issues(F.lit(v[0]), 3, *map(F.lit, v[1:])).alias("i")).i
    assert issues(3, 0.01, 11.0, 1.0, 0.001, 4.5) == "collapse;distillation;not_learning;flat" and issues(2, 0.1, 1.0, 1.0, 0.001, 0.4) == "one_frame" and issues(2, 0.1, 1.0, 1.0, 0.5, -1.0) == ""


BOXES = "array<struct<cls:string,conf:double>>"


def test_posts_comments_messages_profiles(spark):
    media = [("u0", "image/png", None, None, None), ("u1", "image/png", False, True, "old"), ("u2", "video/mp4", True, False, None)]
    posts = spark.createDataFrame([(1, "regular", "x", media), (2, "avatar_update", "x", media), (3, "regular", None, media), (4, None, "x", []), (5, "regular", "x", media)], f"doc_id long, type string, author_id string, media {moderation.MEDIA}")
    verdicts = spark.createDataFrame([(1, 0, 1, "r0"), (1, 2, 2, "r2"), (2, 1, 1, "p"), (3, 0, 2, "q"), (4, 7, 2, "gone"), (9, 0, 2, "no post")], "doc_id long, media_index int, level int, reason string")
    got = {r.doc_id: r for r in moderation.applied_to_posts(posts, verdicts).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert {k: (r.level, r.status, r.reason, r.notify) for k, r in got.items()} == {1: (2, "policy_violation", "r2", True), 2: (2, "policy_violation", "p", False), 3: (2, "policy_violation", "q", False), 4: (0, "active", None, False)}
    assert [(m.is_moderated, m.is_sensitive, m.reason) for m in got[1].media] == [(True, True, "r0"), (False, True, "old"), (True, True, "r2")]
    comments = spark.createDataFrame([(1, "x", 7), (2, "x", 7), (3, None, 7), (4, "x", 7)], "doc_id long, author_id string, post_id long")
    v = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (3, 2, "c"), (4, 2, "d")], "doc_id long, level int, reason string")
    assert sorted(tuple(r) for r in moderation.applied_to_comments(comments, v).select("doc_id", "status", "is_sensitive", "reason", "notify").collect()) == [
        (1, "active", False, None, False), (2, "active", True, None, False), (3, "policy_violation", True, "c", False), (4, "policy_violation", True, "d", True)]
    (m,) = moderation.applied_to_messages(posts.filter("doc_id = 1"), verdicts).collect()
    assert m.violation and m.media[1].reason == "old" and "status" not in m.asDict()
    profiles = spark.createDataFrame([(1, "avatar", "u"), (2, "cover", "u"), (5, "cover", "u")], "doc_id long, kind string, url string")
    assert sorted(tuple(r) for r in moderation.applied_to_profiles(profiles, v).select("doc_id", "url", "notify").collect()) == [(1, "u", False), (2, "", True)]
    level = lambda lv, s: one(spark, moderation.chat_clamped(F.lit(lv), F.lit(s)).alias("l")).l
    assert [level(2, "message"), level(2, "post"), level(0, "message")] == [1, 2, 0] and one(spark, moderation.video_level(F.lit("x FLAGGED y")).alias("l")).l == 2


def test_detector_and_context_rules(spark):
    def act(score, boxes, exact):
        row = spark.createDataFrame([(score, boxes)], f"s double, b {BOXES}").select(policy.detector_override(F.col("s"), F.lit("safe"), policy.body_trigger(F.col("b"), exact)).alias("a")).first()
        return row.a

    covered, exposed, anus = ("FEMALE_BREAST_COVERED", 0.85), ("FEMALE_BREAST_EXPOSED", 0.85), ("ANUS_EXPOSED", 0.1)
    assert [act(0.95, [covered], False), act(0.95, [covered], True), act(0.95, [exposed], True), act(0.95, [("FEMALE_BREAST_EXPOSED", 0.7)], True)] == ["ban", "blur", "ban", "blur"]
    assert [act(0.95, [anus], False), act(0.95, [anus], True), act(0.95, [], True), act(0.95, None, False), act(0.89, [exposed], True)] == ["blur", "ban", "blur", "blur", "safe"]
    flags = policy.context_flags(F.lit(0.30), F.lit(0.25), F.lit(0.40), F.lit(0.31), F.lit(0.22))
    r = one(spark, *(v.alias(k) for k, v in flags.items()))
    p = 1 / (1 + math.exp(-0.05 * 20))
    assert (r.is_sports, r.is_anime, r.is_gore, r.is_brawl) == (True, True, True, False) and math.isclose(r.factor, max(0.15, 1 - p))
    assert math.isclose(one(spark, policy.nsfw_after_sport(F.lit(0.85), F.lit(p)).alias("n")).n, 0.85 - round(p, 2))


def test_embedding_rank_and_prompts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    by = {}
    for r in rows:
        by.setdefault(r.label, []).append(r.embedding)
    values = {k: np.linalg.svd(np.array(v, float), compute_uv=False) for k, v in by.items()}
    want = {k: int((s > 0.01 * s.max()).sum()) for k, s in values.items()}
    assert {r.label: r.rank for r in QUERIES["embedding_rank"](spark, sf_dir).collect()} == want
    low = spark.createDataFrame([("a", [1.0, 0.0, 1.0]), ("a", [2.0, 0.0, 2.0]), ("a", [0.0, 1.0, 0.0])], "label string, embedding array<double>").repartition(3)
    assert [r["rank"] for r in scoring.effective_rank(low, "label", "embedding").collect()] == [2]
    frames = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8])], "id long, v array<double>")
    prompts = spark.createDataFrame([("x", [1.0, 0.0]), ("x", [0.0, 2.0]), ("y", [-1.0, 0.0])], "g string, v array<double>")
    got = {(r.id, r.g): round(r.similarity, 9) for r in search.prompt_maxima(frames, prompts, "g").collect()}
    assert got == {(1, "x"): 1.0, (1, "y"): -1.0, (2, "x"): 0.8, (2, "y"): -0.6}
    assert search.prompt_maxima(frames, prompts.limit(0), "g").collect() == []


def test_streams_don_t_depend_on_batches(spark, tmp_path):
    """Files out of order, one per batch."""
    for k, day in enumerate((5, 1, 9, 3)):
        rows = [(10 * k + i, 1, f"2024-01-0{day} 00:0{i}:00", "ab"[i % 2], 1.0) for i in range(4)] + [(0, 1, "2024-01-05 00:00:00", "a", 1.0)]
        spark.createDataFrame(rows, "event_id long, user_id long, ts string, event_type string, value double").selectExpr("event_id", "user_id", "cast(ts as timestamp_ntz) ts", "event_type", "value").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = worker.event_stream(spark, str(tmp_path), files_per_trigger=1)
    found = worker.run_available(worker.deduplicated(stream, "event_id").select("event_id"), spark, "t-dedup").collect()
    assert sorted(r.event_id for r in found) == [10 * k + i for k in range(4) for i in range(4)]
    days = worker.run_available(worker.daily_counts(worker.event_stream(spark, str(tmp_path), 1), "30 days"), spark, "t-days", ["day", "event_type"]).collect()
    assert sum(r.n for r in days) == 20 and len(days) == 8


def test_summary(spark, tmp_path):
    sinks.write_summary(spark.range(1).selectExpr("3 AS n", "'x' AS s"), str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ['{"n":3,"s":"x"}']


def test_ladders_paths_and_runs(spark):
    category = lambda *c: one(spark, scans.blood_category(F.array(*map(F.lit, c)) if c else F.array().cast("array<int>")).alias("c")).c
    assert [category(4), category(4, 0), category(4, 1), category(1), category(2), category(2, 3), category(3), category(0), category()] == [
        "positive_clean", "positive_contaminated", "skip", "skip", "negative_clean", "skip", "negative_violent", "skip", "skip"]
    part = lambda *c: one(spark, scans.membership(F.array(*map(F.lit, c))).alias("c")).c
    assert [part(2, 5), part(5, 5), part(0), part(1, 4), part(4), part(4, 5), part(0, 5)] == ["ligature", "hard_negative", "weapon", "other", "instrument", "instrument", "other"]
    path = lambda p, r: one(spark, scans.relative_path(F.lit(p), F.lit(r)).alias("p")).p
    assert [path("a/b/c", "a/b"), path("a/bc", "a/b"), path("a/b/c", "a/b//")] == ["c", "a/bc", "c"]
    assert [one(spark, scans.video_id(F.lit(n)).alias("v")).v for n in ("a_12", "a_b_3", "a_x", "12")] == ["a", "a_b", "a_x", "12"]
    good, report = scans.readable(spark.createDataFrame([("a", 1), ("b", None), ("c", 0)], "k string, n int"), F.col("n") > 0, "k")
    assert [r.k for r in good.collect()] == ["a"] and tuple(report.first()) == (2, "b")
    log = lambda *v: F.array(*(F.struct(F.lit(i).alias("epoch"), F.lit(float(x)).alias("value")) for i, x in enumerate(v)))
    stop = lambda patience, *v: tuple(one(spark, sequences.early_stop(log(*v), patience).alias("s")).s)
    assert stop(2, 1, 3, 2, 3, 9)[0::3] == (3.0, 3) and stop(0, 1, 0, 0, 0)[3] is None and stop(2, 5, 4, 6, 5)[:2] == (6.0, 2)
    shots = lambda *s: one(spark, sequences.shot_frames(F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in s)), 2, 3).alias("f")).f
    assert shots((0, 2), (2, 12), (12, 18)) == [2, 5, 8, 12, 14, 16] and shots((0, 2)) == [0, 1, 1, 1, 1, 1] and shots((3, 3)) == []
    say = lambda t, v, s: one(spark, sequences.diagnosis(array(*t), array(*v), F.lit(s), 0.7).alias("d")).d
    assert [say([1, 0.9], [1, 1], 0.3), say([3, 2, 1.5, 1], [3, 1, 1, 2], 0.8), say([3, 1], [3, 1], 0.8), say([3, 1], [3, 1], 0.5), say([], [], 0.5)] == ["underfit", "overfit", "success", "good_but_low", "error"]
    m = F.array(array(0, 10), array(2, 20), array(4, 30))
    assert one(spark, sequences.resample_columns(m, 2).alias("r")).r == [[0.0, 10.0], [4.0, 30.0]] and one(spark, sequences.fitted(m, 2, 3).alias("r")).r == [[0.0, 10.0, 0.0], [2.0, 20.0, 0.0]]
    assert one(spark, sequences.aligned([(m, 2), (F.array(array(7)), 1)]).alias("r")).r == [[0.0, 10.0, 7.0], [2.0, 20.0, 0.0], [4.0, 30.0, 0.0]]
    assert one(spark, sequences.clean(array(float("nan"), float("inf"), float("-inf"), 2)).alias("c")).c == [0.0, 1e6, -1e6, 2.0]


def test_quantiles_are_numpys(spark):
    rng = np.random.default_rng(3)
    groups = {"ties": [float(v) for v in rng.integers(0, 7, 500)], "wide": [float(v) for v in rng.lognormal(0, 3, 700)], "one": [2.5], "same": [1.0] * 9, None: [float(v) for v in rng.normal(size=51)]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("one", None), ("nothing", None)]
    cuts = {"low": 0.0, "tenth": 0.1, "med": 0.5, "p90": 0.9, "high": 1.0}
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: r for r in m.quantiles(df, "v", cuts, "g").collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert np.allclose([got[g][c] for c in cuts], np.quantile(values, list(cuts.values())))
    every = [v for _, v in rows if v is not None]
    assert np.isclose(m.quantiles(df, "v", {"med": 0.5}).first().med, np.median(every))
    assert m.quantiles(df.limit(0), "v", cuts, "g").collect() == []


def test_best_so_far_is_the_plain_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(["hot", "b", None][int(rng.choice(3, p=[0.8, 0.1, 0.1]))], int(t) // 10, int(t), i, float(v)) for i, (t, v) in enumerate(zip(rng.integers(0, 60, 400), rng.integers(0, 50, 400)))]
    df = spark.createDataFrame(rows, "g string, day int, t int, id int, v double").repartition(4)
    got = {r.id: (r.best, r.improved) for r in reports.best_so_far(df, "g", "v", F.col("day"), "t", "id").collect()}
    best, want = {}, {}
    for g, _, t, i, v in sorted(rows, key=lambda r: (r[2], r[3])):
        best[g] = max(best.get(g, v), v)
        want[i] = (best[g], v >= best[g])
    assert got == want


def test_ranks_by_buckets_of_numbers(spark):
    rng = np.random.default_rng(5)
    ids = [int(i) for i in rng.choice(10**6, 300, replace=False)]
    df = spark.createDataFrame([("ab"[i % 2], i) for i in ids], "g string, id long").repartition(4)
    got = {r.id: r.rank for r in curation.ranked(df, ["g"], "id", bucket=F.floor(F.col("id") / 10000)).collect()}
    assert got == {i: sorted(x for x in ids if x % 2 == i % 2).index(i) + 1 for i in ids}


def test_leaks_between_splits(spark):
    rows = [(i, "hot", "train") for i in range(50)] + [(100 + i, "hot", "val") for i in range(40)]
    rows += [(200, "x", "val"), (201, "x", "test"), (202, "y", "train"), (203, None, "train"), (204, None, "val")]
    df = spark.createDataFrame(rows, "doc_id long, md5 string, split string")
    order = ["train", "val", "test"]
    assert {tuple(r) for r in audit.leak_classes(df, "md5", "doc_id", order).collect()} == {("hot", "train", 50, 0, "val", 40, 100), ("x", "val", 1, 200, "test", 1, 201)}
    assert {tuple(r) for r in audit.leak_summary(df, "md5").collect()} == {("train", "val", 1), ("test", "val", 1)}
    assert {r.doc_id for r in audit.without_leaks(df, "md5").collect()} == {*range(50), 202, 203, 204, 200, 201}
    assert audit.leaked(df.filter("split = 'val'"), df.filter("split = 'train'"), "md5", "doc_id", ("val_id", "train_id")).count() == 40
    assert {(r.md5, r.splits) for r in reports.straddling(df, "md5").collect()} == {("hot", 2), ("x", 2), (None, 2)}
    assert {r.md5 for r in audit.absent(df, "train", "md5").collect()} == {"x"}
    kinds = audit.overlaps(df.filter("split = 'train'"), df.filter("split = 'val'"), {"text": "md5", "id": "doc_id"}).collect()
    assert {(r.kind, r.n) for r in kinds} == {("text", 2), ("id", 0)}  # null is shared too, as INTERSECT has it
    for found in (audit.leak_classes(df.limit(0), "md5", "doc_id", order), audit.leak_summary(df.limit(0), "md5"), audit.without_leaks(df.limit(0), "md5"), reports.straddling(df.limit(0), "md5")):
        assert found.collect() == []


def test_curves_distributions_and_weights(spark):
    rng = np.random.default_rng(6)
    rows = [(float(round(s, 2)), int(y)) for s, y in zip(rng.random(300), rng.integers(0, 2, 300))]
    df = spark.createDataFrame(rows, "score double, y int").withColumn("label", F.lit("a"))
    area, r0, p0 = 0.0, 0.0, 1.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp, fp = sum(y for s, y in rows if s >= t), sum(1 - y for s, y in rows if s >= t)
        r, p = tp / sum(y for _, y in rows), tp / (tp + fp)
        area, r0, p0 = area + (r - r0) * (p + p0) / 2, r, p
    assert np.isclose(m.area_by_trapezoids(df, "label").first().area, area)
    a, b = np.array([s for s, _ in rows]) + 0.01, np.array([y for _, y in rows]) + 0.01
    a, b = a / a.sum(), b / b.sum()
    assert np.isclose(reports.divergence(df, "label", "score", "y").first().kl, (a * np.log(a / b)).sum())
    levels = spark.createDataFrame([(2,), (2,), (0,)], "level int")
    assert [tuple(r) for r in m.level_distribution(levels).orderBy("level").collect()] == [(0, 1, 100 / 3), (1, 0, 0.0), (2, 2, 200 / 3)]
    flags = lambda *v: spark.createDataFrame([(x,) for x in v], "f int")
    assert [curation.positive_weight(flags(*v), "f").first()[0] for v in ([0] * 3, [1] + [0] * 3, [1] + [0] * 50, [1, 1, 0])] == [1.0, 3.0, 20.0, 1.0]
    assert m.macro_micro_f1(m.confusion(df.limit(0), 0.5, "label")).first().asDict() == {"macro": None, "micro": None}


def test_coverage_and_branches(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,), (None,)], "doc_id long")
    teachers = spark.createDataFrame([(1,), (1,), (9,)], "a long"), spark.createDataFrame([(3,), (None,)], "b long")
    assert audit.coverage(docs, "doc_id", *teachers).first().coverage == 0.5
    rows = spark.createDataFrame([("train", 1, 1), ("train", 0, 1), ("val", 0, 0)], "split string, violence int, nsfw int")
    got = {(r.branch, r.split): r.n for r in curation.branches(rows, "violence", "nsfw").collect()}
    assert got == {("violence", "train"): 1, ("nsfw", "train"): 2, ("multitask", "train"): 2, ("multitask", "val"): 1}
    assert curation.balanced_sample(rows.limit(0), "split", 10, "nsfw").collect() == []
    x = [0.1, 0.9, 0.4]
    e = np.exp(np.array(x) / 0.2)
    assert np.allclose(one(spark, sequences.softmax(array(*x), 0.2).alias("s")).s, e / e.sum())
