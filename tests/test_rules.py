"""Scans, files, feature checks and boxes against plain Python."""

import hashlib
import math
import random
import re
from pathlib import PurePosixPath

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis import sinks
from tamis.functions import boxes, sequences
from tamis.operators import audit, curation, metrics, reports
from tamis.registry import QUERIES
from tamis.sources import datasets, scans

VIDEO, IMAGE = {".mp4", ".avi", ".mov", ".mkv", ".webm"}, {".jpg", ".jpeg", ".png", ".bmp", ".webp"}


def files(spark, *paths, invalid=()):
    return spark.createDataFrame([(p, p not in invalid) for p in paths], "path string, valid boolean")


def found(df, *columns):
    return {r.relative_path: tuple(r[c] for c in columns) for r in df.collect()}


def test_fight_clips(spark):
    base = "in/x/RWF-2000"
    paths = [f"{base}/train/Fight/A_12.avi", f"{base}/val/NonFight/deep/b.MP4", f"{base}/val/fight/c.avi", f"{base}/test/Fight/d.avi", f"{base}/train/Fight/e.txt", f"{base}/train/f.avi", "in/other/train/Fight/g.avi", "RWF-2000/val/Fight/h_1.webm"]
    got = found(datasets.fight_clips(files(spark, *paths)), "violence", "proxy_label", "original_split", "locked_split", "group_id", "label_signature", "include_proxy", "include_spatial")
    assert got == {
        paths[0]: (1, 1, "train", "", "rwf2000:a", "v1_s0_n0_p1", 1, 0),
        paths[1]: (0, 0, "val", "test", "rwf2000:b", "v0_s0_n0_p0", 1, 0),
        paths[7]: (1, 1, "val", "test", "rwf2000:h", "v1_s0_n0_p1", 1, 0),
    }
    (row,) = datasets.fight_clips(files(spark, paths[0])).collect()
    assert row.sample_id == "rwf2000_" + hashlib.sha1(paths[0].encode()).hexdigest()[:12] and row.media_type == "video"


def test_surveillance(spark):
    base = datasets.CRIMES
    paths = [f"{base}/Anomaly-Videos/{x}" for x in ("Fighting/F1.mp4", "Stealing/S1.avi", "Robbery/R1.mp4", "Robbery/more/R2.mp4", "loose.mp4")]
    paths += [f"{base}/Training-Normal-Videos/n1.mp4", f"{base}/Testing_Normal_Videos_Anomaly/deep/n2.mp4", f"{base}/Other/n3.mp4"]
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    test = lines("  Stealing/S1.avi  Stealing 10 20", "", "Robbery/R1.mp4;x/F9.MKV", "r2 ")
    train = lines("Robbery/R1.mp4", "F1")
    assert {r.name for r in datasets.listed_videos(test).collect()} == {"s1", "r1", "f9", "r2"}
    got = found(datasets.surveillance(files(spark, *paths), train, test), "violence", "proxy_label", "original_split", "locked_split", "challenge_bucket", "mapping_confidence")
    assert got == {
        paths[0]: (1, 1, "train", "", "positive_hard", "medium"),
        paths[1]: (0, 1, "test", "test", "positive_hard", "medium"),
        paths[2]: (1, 1, "train", "test", "positive_hard", "medium"),
        paths[3]: (1, 1, "test", "test", "positive_hard", "medium"),
        paths[5]: (0, 0, "train", "", "", "high"),
        paths[6]: (0, 0, "test", "test", "", "high"),
    }


def test_actions(spark):
    paths = ["a/UCF-101/Punch/v_1.avi", "a/UCF-101/Biking/V_2.avi", "a/UCF-101/Biking/sub/v_3.avi", "a/UCF-101/v_4.avi"]
    lines = spark.createDataFrame([("punch\\v_1.avi 1",), (" Biking/v_3.avi",), ("Biking/v_9.avi",)], "value string")
    got = found(datasets.actions(files(spark, *paths), lines), "original_split", "locked_split", "challenge_bucket", "group_id")
    assert got == {
        paths[0]: ("test", "test", "normal_hard", "ucf101:punch/v_1"),
        paths[1]: ("train", "", "", "ucf101:biking/v_2"),
        paths[2]: ("test", "test", "", "ucf101:sub/v_3"),
    }


def test_image_scans(spark):
    paths = [f"nsfw_dataset_v1/{x}" for x in ("Porn/a.jpg", "drawings/b.PNG", "food/c.jpg", "porn/d.gif", "sexy/broken.jpg")]
    got = found(datasets.nsfw_images(files(spark, *paths, invalid=paths[-1:])), "nsfw", "include_spatial", "include_proxy", "notes")
    assert got == {paths[0]: (1, 1, 0, "class=Porn"), paths[1]: (0, 1, 0, "class=drawings")}
    paths = [f"p/P2datasetFull/{x}" for x in ("train/1/a.jpg", "Val1/2/b.jpg", "test1/2/c.jpg", "odd/2/d.jpg", "train/3/e.jpg", "train/f.jpg")]
    got = found(datasets.adult_images(files(spark, *paths)), "nsfw", "original_split", "locked_split", "challenge_bucket")
    assert got == {paths[0]: (0, "train", "", ""), paths[1]: (1, "val", "val", "positive_hard"), paths[2]: (1, "test", "test", "positive_hard"), paths[3]: (1, "train", "", "positive_hard")}
    paths = [f"x/set/{x}" for x in ("train/images/a.jpg", "valid/images/deep/b.jpg", "Test/images/c.webp", "extra/images/d.jpg", "train/labels/e.jpg")]
    got = found(datasets.boxed_images(files(spark, *paths), "set", "s", "n", 1, False), "self_harm", "proxy_label", "original_split", "locked_split", "challenge_bucket")
    assert got == {paths[0]: (1, 0, "train", "", "normal_hard"), paths[1]: (1, 0, "val", "val", "normal_hard"), paths[2]: (1, 0, "test", "test", "normal_hard")}
    paths = ["Wound_dataset copy/Burns/a.jpg", "Wound_dataset copy/b.jpg"]
    assert found(datasets.wounds(files(spark, *paths)), "challenge_bucket", "violence") == {paths[0]: ("normal_hard", 0)}


def test_folder_names(spark):
    paths = ["a/Non-Violence/x.mp4", "a/non_violent/Fight/y.mp4", "a/b/Gore/deep/z.mp4", "Peaceful/w.mp4", "plain.mp4", "a/fights/v.mp4"]
    got = {(r.folder, r.kind) for r in datasets.folders_by_name(files(spark, *paths)).collect()}
    assert got == {("a/Non-Violence", "non_violent"), ("a/non_violent", "non_violent"), ("a/b/Gore", "violent"), ("Peaceful", "non_violent")}


def test_scans_reach_every_branch(spark, sf_dir):
    """The fixtures hold every split, class and bucket that a scan can give."""
    of = lambda name, *c: {tuple(r) for r in QUERIES[name](spark, sf_dir).select(*c).distinct().collect()}
    assert {x[0] for x in of("resolve_paths", "how")} == {"given", "full", "name", "none"}
    assert {x[0] for x in of("array_checks", "fault")} == {None, "empty", "not_finite", "kind", "dimensions", "unreadable"}
    assert {x[0] for x in of("scenes", "detected")} == {True, False}
    assert {x[0] for x in of("folders_by_name", "kind")} == {"violent", "non_violent"}
    assert {x[0] for x in of("scan_fight_clips", "violence")} == {0, 1}
    big = sf_dir.replace("sf0.001", "sf0.01")
    more = lambda name, *c: {tuple(r) for r in QUERIES[name](spark, big).select(*c).distinct().collect()}
    assert {x[0] for x in more("video_decisions", "violence")} == {x[0] for x in more("video_decisions", "nsfw")} == {"safe", "blur", "ban"}
    assert {x[:1] for x in more("scan_surveillance", "locked_split")} == {("",), ("test",)} and {x[0] for x in more("scan_actions", "challenge_bucket")} == {"", "normal_hard"}
    assert {x[0] for x in more("gate_checks", "gate")} >= {"fail_1", "pass", "pass_scaled"} and {x[0] for x in more("shortcut_probe", "tier")} >= {"ok", "partial"}
    flags = more("context_flags", "is_sports", "is_anime", "is_gore", "is_brawl")
    assert all({x[k] for x in flags} == {True, False} for k in (0, 1, 3)) and {x[0] for x in more("stuck_scores", "stuck")} == {True, False}
    assert {i for x in more("feature_qa", "issues") for i in x[0].split(";")} == {"", "width", "not_finite", "range", "flat"}
    assert more("missing_classes", "label") and more("straddling_groups", "splits") and next(iter(more("batch_inference_summary", "errors")))[0] > 0
    assert {x[0] for x in more("feature_set_sanity", "status")} == {"ok", "low"} and more("dead_letters", "state", "attempts") == {("done", 1), ("done", 2), ("dead", 3)}


def test_whole_groups(spark):
    df = spark.createDataFrame([(f"g{i % 37}", i) for i in range(400)], "g string, i long")
    rows = curation.drawn_groups(df, "g", 5, 3).collect()
    order = sorted({f"g{i}" for i in range(37)}, key=lambda g: hashlib.md5(f"3:{g}".encode()).hexdigest())[:5]
    assert sorted(r.i for r in rows) == [i for i in range(400) if f"g{i % 37}" in order]
    assert curation.drawn_groups(df, "g", 99, 3).count() == 400


def test_boxes(spark):
    rng = random.Random(5)
    rows = [(*(rng.randint(0, 200) for _ in range(4)), rng.choice([0.25, 0.3, 1.0]), rng.randint(50, 900), rng.randint(50, 900)) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, x long, y long, w long, h long, s double, ow long, oh long")
    got = {r.i: r.b for r in df.select("i", boxes.content_box(*(F.col(c) for c in ("x", "y", "w", "h", "s", "ow", "oh"))).alias("b")).collect()}
    for i, (x, y, w, h, s, ow, oh) in enumerate(rows):
        f = 1 / s
        x0, y0 = max(0, int(x * f)), max(0, int(y * f))
        w0, h0 = max(1, min(int(w * f), ow - x0)), max(1, min(int(h * f), oh - y0))
        assert (got[i] and tuple(got[i])) == ((x0, y0, w0, h0) if w0 * h0 / (ow * oh) < 0.95 else None)


def test_file_resolution(spark):
    table = lambda *rows: spark.createDataFrame(list(rows), "path string, file string")
    known = table(("./a//1.npy", "v1"), ("a/1.npy", "v1"), ("b/2.npy", "v2"), ("c/2.npy", "v3"), ("c/4.npy", "v4"))
    rows = spark.createDataFrame([(1, "a\\1.npy", None), (2, "x/2.npy", None), (3, "b/2.npy", " nan "), (4, "q/4.npy", ""), (5, "q/4.npy", " mine "), (6, "zz", "NONE"), (7, None, None)], "i long, path string, given string")
    got = {r.i: (r.file, r.how) for r in audit.resolved(rows, known).collect()}
    assert got == {1: ("v1", "full"), 2: (None, "none"), 3: ("v2", "full"), 4: ("v4", "name"), 5: ("mine", "given"), 6: (None, "none"), 7: (None, "none")}
    with pytest.raises(ValueError, match="a/1.npy"):
        audit.resolved(rows, known.unionByName(table(("a/1.npy", "other"))))


def test_label_files_go_too(spark):
    images = ["s/images/a.b.jpg", "images/c.png", "s/pics/d.jpg", "s/images/images/e.jpg", "s/images/none.jpg"]
    labels = ["s/labels/a.b.txt", "labels/c.txt", "s/labels/images/e.txt", "s/pics/d.txt", "s/images/labels/e.txt"]
    got = {r.path for r in audit.removals(files(spark, *images), files(spark, *labels)).collect()}
    want = set(images)
    for p in images:
        parts = list(PurePosixPath(p).parts)
        if "images" in parts:
            parts[parts.index("images")] = "labels"
            label = str(PurePosixPath(*parts).with_suffix(".txt"))
            want |= {label} & set(labels)
    assert got == want and len(got) == 8


def test_set_sanity(spark):
    rng = np.random.default_rng(1)
    items = {i: rng.normal(size=(6, 4)) for i in range(9)}
    items[3][2, 0], items[4][1, 1], items[5][0, 1] = np.nan, np.inf, -np.inf
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, m in items.items() for row in m] + [(9, [1.0, 2.0])], "item long, v array<double>")
    got = {r["column"]: r for r in audit.set_sanity(df, "item", "v", {"a": 2, "b": 3, "c": 0}, 0.01).collect()}
    for name, k in (("a", 2), ("b", 3)):
        assert math.isclose(got[name].mean_std, np.mean([m[:, k].std() for m in items.values()])) and got[name].status == "ok"
    assert math.isnan(got["c"].mean_std) and got["c"].status == "low"
    assert {(r["items"], r.widths, r.nan_items, r.inf_items) for r in got.values()} == {(10, "2,4", 1, 2)}


def test_speed_start_and_guards(spark):
    def one(c):
        return spark.range(1).select(c.alias("c")).first().c

    arr = lambda v: F.array(*(F.lit(float(x)) for x in v)) if len(v) else F.array().cast("array<double>")
    for n, factor in ((3, 2.0), (4, 0.1), (10, 0.8), (17, 1.25), (20, 9.0), (0, 1.0)):
        x = np.arange(n, dtype=float)
        f = max(0.5, min(2.0, factor))
        want = x if n < 4 else x[np.linspace(0, n - 1, max(4, int(n / f))).astype(int)]
        assert one(sequences.respeeded(arr(x), F.lit(factor))) == want.tolist(), (n, factor)
    for n, offset in ((7, 2), (6, 2), (7, -2), (7, 0), (9, 3)):
        x = list(range(n))
        assert one(sequences.started_later(arr(x), F.lit(offset), 3)) == (x if n <= 6 else x[max(0, offset) :])
    nan, inf = float("nan"), float("inf")
    raw = np.array([nan, 0.2, inf, 0.0, -inf])
    clean = np.maximum(np.nan_to_num(raw, nan=0.0, posinf=0.0, neginf=0.0), 1e-6)
    assert np.allclose(one(sequences.guarded(arr(raw))), clean / clean.sum())
    soft = np.exp(np.nan_to_num(raw, nan=0.5, posinf=1.0, neginf=0.0) / 0.02)
    soft = np.maximum(soft / soft.sum(), 1e-6)
    assert np.allclose(one(sequences.softened(arr(raw), 0.02)), soft / soft.sum())


def test_distillation(spark):
    rng = np.random.default_rng(3)
    rows = [(e, rng.random(5), rng.random(5), float(rng.random())) for e in range(4) for _ in range(6)]
    df = spark.createDataFrame([(e, t.tolist(), s.tolist(), b) for e, t, s, b in rows], "epoch long, t array<double>, s array<double>, b double")
    got = {r.epoch: r for r in reports.distillation(df, "epoch", F.col("t"), F.col("s"), F.col("b"), 2, 0.5, 0.7, 0.1).collect()}
    for e in range(4):
        kl, ent, bce = [], [], []
        for _, t, s, b in (r for r in rows if r[0] == e):
            soft = np.exp(t / 0.5) / np.exp(t / 0.5).sum()
            a = s / s.sum()
            kl.append((soft * (np.log(soft) - np.log(a))).sum())
            ent.append(-(a * np.log(a)).sum())
            bce.append(b)
        k = np.mean(kl) if e >= 2 else 0.0
        assert np.allclose([got[e].kl, got[e].entropy, got[e].total], [k, np.mean(ent), np.mean(bce) + 0.7 * k + 0.1 * np.mean(ent)], rtol=1e-5)


def test_buckets_without_positives(spark):
    rows = [("a", "x", 1, 0.9), ("a", "x", 0, 0.9), ("a", "y", 0, 0.1), ("none", "x", 0, 0.1), ("none", "x", 0, 0.2), ("", "x", 1, 0.9), (None, "x", 1, 0.9)]
    got = {(r.bucket, r.label): tuple(r)[2:] for r in metrics.bucket_report(spark.createDataFrame(rows, "bucket string, label string, y int, score double"), 0.5, "bucket", "label").collect()}
    assert got == {("a", "x"): (2, 1, 1, 0, 0, 0.5, 1.0, 2 / 3, 1 / 3), ("a", "y"): (1, 0, 0, 0, 1, 0.0, 0.0, 0.0, 1 / 3), ("none", "x"): (2, 0, 0, 0, 2, 0.0, 0.0, 0.0, 0.0)}


def test_manifests_by_header(spark, tmp_path):
    schema = "doc_id bigint, array_path string, violence int"
    for k in range(2):
        sinks.append_csv(spark.createDataFrame([(f'p,"{k}"', k, k + 5)], "array_path string, violence int, doc_id long"), str(tmp_path / "m"))
    assert sinks.csv_header(spark, str(tmp_path / "m")) == ["array_path", "violence", "doc_id"]
    kind, rows = sinks.read_manifest(spark, str(tmp_path / "m"), schema, schema.replace("array", "image"))
    assert kind == "arrays" and sorted(map(tuple, rows.collect())) == [(5, 'p,"0"', 0), (6, 'p,"1"', 1)]


def test_suffixes_and_types(spark):
    names = ["a.JPG", "b.mp4", "c.txt", "d", "e.webm", "f.jpeg"]
    got = {r.path: r.media_type for r in scans.with_media_type(files(spark, *names)).collect()}
    assert got == {n: "image" if PurePosixPath(n).suffix.lower() in IMAGE else "video" if PurePosixPath(n).suffix.lower() in VIDEO else None for n in names}
    assert re.fullmatch(scans.FLOAT, "1.5") and not re.fullmatch(scans.FLOAT, "1.5f")


def test_media_in_batches_of_their_own(spark):
    from tamis.operators.scoring import scored_media

    media = spark.range(0, 700, 1, 3).select("id", F.when(F.col("id") % 7 == 0, "video/mp4").when(F.col("id") % 7 == 1, "text/plain").otherwise("image/png").alias("mime"))
    sizes = lambda: lambda batch: np.full(len(batch), float(len(batch)))
    rows = scored_media(media, sizes, sizes).collect()
    assert len(rows) == 600 and {r.score for r in rows if r.mime == "video/mp4"} == {1.0}
    images = [r.score for r in rows if r.mime == "image/png"]
    assert max(images) == 64.0 and all(images.count(x) % int(x) == 0 for x in set(images))
