"""Operators, readers and streams on small tables with known answers."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reconspark.functions import geometry as g
from reconspark.operators import boxes as bx
from reconspark.operators import calibration as cb
from reconspark.operators import frames as fr
from reconspark.operators import jobs as jb
from reconspark.operators import listings as ls
from reconspark.operators import logs as lg
from reconspark.operators import models as md
from reconspark.operators import rig as rg
from reconspark.operators import spatial as sp
from reconspark.operators import stats as st
from reconspark.operators.hull import area_of, hull_areas
from reconspark.sources import readers as rd
from reconspark.streaming import logs as sl


def rows(df):
    return [tuple(r) for r in df.collect()]


def frames(spark, scores):
    return spark.createDataFrame([("v", n, float(s)) for n, s in scores.items()], "video string, name string, score double")


def test_threshold_and_quota_together(spark):
    d = fr.select_frames(frames(spark, {"a": 3, "b": 5, "c": 12, "d": 20, "e": math.nan}), threshold=8.0, keep_pct=90.0)
    assert {r.name: r.decision for r in d.collect()} == {"a": "kept", "b": "kept", "c": "above_threshold", "d": "above_threshold", "e": "invalid_score"}
    assert rows(fr.frame_quality_counts(d).select(*fr.DECISIONS)) == [(2, 2, 0, 1)]


def test_ties_by_name(spark):
    f = frames(spark, {"c": 3, "a": 3, "b": 3, "d": math.inf})
    assert {r.name for r in fr.select_frames(f, threshold=8.0, keep_pct=70.0).where("decision = 'kept'").collect()} == {"a", "b"}
    assert fr.select_frames(f, threshold=8.0).where("decision = 'kept'").count() == 3


@pytest.mark.parametrize("bad", [("x", None), ("-1", None), ("nan", None), (None, "0"), (None, "101"), ("inf", None)])
def test_bad_frame_options(bad):
    with pytest.raises(ValueError):
        fr.validate_frame_options(*bad)


def test_scores_follow_frames_or_fail(spark):
    lines = [("v", i, t) for i, t in enumerate(["[Parsed_blurdetect_1 @ 0x1] blur: 1.5", "other", "[Parsed_blurdetect_1 @ 0x1] blur: bad", "blur mean: 99.0"])]
    log = spark.createDataFrame(lines, "video string, seq long, line string")
    files = spark.createDataFrame([("v", "f1"), ("v", "f2")], "video string, file string")
    got = sorted(rows(rd.scores_from_log(log, files).select("file", "score")))
    assert got[0] == ("f1", 1.5) and got[1][0] == "f2" and math.isnan(got[1][1])
    with pytest.raises(Exception, match="differ in number"):
        rd.scores_from_log(log, files.limit(1)).collect()


def test_tiles_cover_exactly(spark):
    w, h = 14204, 10652
    one = spark.createDataFrame([(w, h)], "w long, h long")
    cols, rws = g.tile_layout("w", "h", 4096)
    assert rows(one.select(cols, rws)) == [(4, 3)]
    area = 0
    for tc in range(4):
        for tr in range(3):
            x0, y0, x1, y1 = rows(one.select(*g.tile_bounds("w", "h", F.lit(4), F.lit(3), F.lit(tc), F.lit(tr))))[0]
            assert 0 < x1 - x0 <= 4096 and 0 < y1 - y0 <= 4096
            area += (x1 - x0) * (y1 - y0)
    assert area == w * h


def test_grid_is_clamped(spark):
    cells = rows(sp.grid_cells(spark, (0.0, 0.0, 250.0, 90.0), 100.0).orderBy("iy", "ix"))
    assert len(cells) == 3 and cells[0] == (0, 0, 0.0, 0.0, 100.0, 90.0) and cells[2][4] == 250.0


@pytest.mark.parametrize("text,want", [("", None), ("0, 1 2,3", (0, 1, 2, 3)), ("0,0,0,1", ValueError), ("1 2 3", ValueError)])
def test_region(text, want):
    if want is ValueError:
        with pytest.raises(ValueError):
            g.parse_region(text)
    else:
        assert g.parse_region(text) == want


def test_nadir_frame(spark):
    one = spark.range(1)
    r = g.cam_from_world(F.lit(0.0), F.lit(0.0), F.lit(180.0))
    assert [round(v, 9) for v in rows(one.select(*[v for row in r for v in row]))[0]] == [-1, 0, 0, 0, 1, 0, 0, 0, -1]
    assert [round(v, 9) for v in rows(one.select(*g.gravity_in_camera(F.lit(0.0), F.lit(0.0), F.lit(180.0))))[0]] == [0, 0, 1]
    lat, lon = rows(one.select(*g.tm_to_wgs84(F.lit(250000.0), F.lit(2655000.0), "EPSG:3826")))[0]
    assert lon == pytest.approx(121.0) and 23.9 < lat < 24.1
    with pytest.raises(ValueError):
        g.resolve_crs("mars")


def test_rig_by_pattern(spark):
    names = [f"{cam}/{cam}-1_0-{serial}_{i:05d}.jpg" for cam, serial in (("N", 61214), ("F", 61294), ("B", 70924)) for i in range(3)]
    df = spark.createDataFrame([(n,) for n in [*names, "stray.jpg"]], "name string")
    rig, rest = rg.group_by_regex(df, r"^(?P<cam>[A-Z])-.*_(?P<frame>\d{5})")
    assert {r.camera for r in rig.collect()} == {"B", "F", "N"} and [r.name for r in rest.collect()] == ["stray.jpg"]
    assert rows(rg.rig_summary(rig).select("n_frames", "n_complete", "n_partial", "weak")) == [(3, 3, 0, False)]
    with pytest.raises(ValueError):
        rg.group_by_regex(df, r"(?P<cam>x)")


def test_rig_auto_fields(spark):
    serial = {"nadir": 100, "forward": 200, "backward": 300}
    names = [f"{c}/{c}_{s}_{i}_{n + 10 * s + i}.jpg" for c, n in serial.items() for s in (1, 2) for i in range(3)]
    rig, _ = rg.group_auto(spark.createDataFrame([(n,) for n in names], "name string"))
    assert {r.frame_key for r in rig.collect()} == {f"{s}_{i}" for s in (1, 2) for i in range(3)}


def test_rig_by_gps(spark):
    f = [(f"{c}/{n}.jpg", 24.1 + 0.1 * k, 120.6) for c in "abc" for k, n in enumerate((f"{c}x", f"{c}y"))] + [("flat.jpg", 24.1, 120.6)]
    rig, rest = rg.group_by_gps(spark.createDataFrame(f, "name string, lat double, lon double"), 0.5)
    assert rows(rg.rig_summary(rig).select("n_frames", "n_complete")) == [(2, 2)] and [r.name for r in rest.collect()] == ["flat.jpg"]


def test_eo_csv(spark, tmp_path):
    (tmp_path / "eo.csv").write_text("﻿Image ID,Easting,NORTHING,Ellipsoid_Height,omega,Phi,Kappa\nA1.jpg,1,2,3,4,5,6\n ,1,1,1,1,1,1\nA2,1.5,2,3,4,5,6\n")
    assert sorted(rows(rd.read_eo_csv(spark, str(tmp_path / "eo.csv")))) == [("A1", 1, 2, 3, 4, 5, 6), ("A2", 1.5, 2, 3, 4, 5, 6)]
    (tmp_path / "bad.csv").write_text("ID,EASTING\nA,1\n")
    with pytest.raises(ValueError, match="missing"):
        rd.read_eo_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "num.csv").write_text("id,x,y,z,omega,phi,kappa\nA,1,2,bad,4,5,6\n")
    with pytest.raises(Exception, match="bad height"):
        rd.read_eo_csv(spark, str(tmp_path / "num.csv")).collect()


def test_model_text(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# c\n1 PINHOLE 64 48 60 60 32 24\n")
    (tmp_path / "images.txt").write_text("# i\n1 1 0 0 0 1 2 3 1 a b.jpg\n1.0 2.0 7 3.0 4.0 -1\n2 1 0 0 0 0 0 0 1 c.jpg\n\n")
    (tmp_path / "points3D.txt").write_text("7 1 2 3 255 0 1 0.5 1 0 2 4\n")
    assert rows(rd.read_cameras(spark, str(tmp_path / "cameras.txt")).select("camera_id", "model", "params")) == [(1, "PINHOLE", [60.0, 60.0, 32.0, 24.0])]
    images, obs = rd.read_images(spark, str(tmp_path / "images.txt"))
    assert sorted(rows(images.select("image_id", "name", "tx"))) == [(1, "a b.jpg", 1.0), (2, "c.jpg", 0.0)]
    assert sorted(rows(obs.select("image_id", "idx", "x", "point_id"))) == [(1, 0, 1.0, 7), (1, 1, 3.0, None)]
    points, tracks = rd.read_points(spark, str(tmp_path / "points3D.txt"))
    assert rows(points.select("point_id", "z", "r", "error")) == [(7, 3.0, 255, 0.5)] and sorted(rows(tracks.select("image_id", "idx"))) == [(1, 0), (2, 4)]


def cloud(spark, n=300, seed=1):
    rng = random.Random(seed)
    return [(i, rng.gauss(0, 1) + 50 * (i % 3 == 0), rng.gauss(0, 5), rng.random()) for i in range(n)]


def test_knn_equals_brute_force(spark):
    pts = cloud(spark)
    got = {}
    for r in sp.knn(spark.createDataFrame(pts, "id long, x double, y double, z double"), "id", ("x", "y", "z"), 3).collect():
        got.setdefault(r.id, []).append((r.nth, r.neighbour))
    for i, *p in pts:
        want = sorted((math.dist(p, q), j) for j, *q in pts if j != i)[:3]
        assert [n for _, n in sorted(got[i])] == [j for _, j in want]


def test_nearest_station_first_wins(spark):
    im = spark.createDataFrame([(1, 24.0, 120.0), (2, 25.0, 121.0)], "image_id long, lat double, lon double")
    s = spark.createDataFrame([(10, 0, 24.00001, 120.0), (11, 1, 24.00001, 120.0), (12, 2, 24.1, 120.0)], "station_id long, nth long, lat double, lon double")
    assert [(r[0], r[1]) for r in rows(sp.nearest_station(im, s, 5.0))] == [(1, 10)]


def test_pairs(spark):
    im = spark.createDataFrame([(0, p) for p in range(6)], "grp long, pos long")
    assert {(r[1], r[3]) for r in rows(sp.sequence_pairs(im, 2, 2))} == {(a, a + s) for a in range(6) for s in (0, 1, 2, 3) if a + s < 6}
    loops = sp.loop_pairs(im, spark.createDataFrame([(0, 5)], "a long, b long"), 2)
    assert {(r[1], r[3]) for r in rows(loops)} == {(a, b) for a in (0, 1, 2) for b in (3, 4, 5)}
    p = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("d", "d")], "name_a string, name_b string")
    assert sorted(rows(sp.dedup_pairs(p))) == [("a", "b"), ("a", "c")] and rows(sp.dedup_pairs(p, compat=True)) == [("a", "c")]


def test_hull(spark):
    import numpy as np

    assert area_of(np.array([0, 4, 4, 0, 2, 2]), np.array([0, 0, 3, 3, 1, 3])) == 12
    assert area_of(np.array([0, 1, 2]), np.array([0, 1, 2])) == 0 == area_of(np.array([1, 1]), np.array([2, 2]))
    d = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 0.0), (1, 0.0, 2.0), (1, 0.0, 0.0), (2, 1.0, 1.0)], "k long, x double, y double")
    assert dict(rows(hull_areas(d, ["k"]))) == {1: 2.0, 2: 0.0}


def test_two_blocks_see_their_own_clusters(spark):
    rng = random.Random(0)
    at = {0: (5, 5), 1: (155, 5)}
    points = [(c * 100 + k, at[c][0] + rng.uniform(-4.9, 4.9), at[c][1] + rng.uniform(-4.9, 4.9)) for c in at for k in range(60)]
    p = spark.createDataFrame(points, "point_id long, x double, y double")
    blocks = spark.createDataFrame([(0, 0.0, 0.0, 100.0, 10.0), (1, 100.0, 0.0, 200.0, 10.0)], "block long, x0 double, y0 double, x1 double, y1 double")
    obs = spark.createDataFrame([(c * 10 + i, pid, x - at[c][0] + 30, y + 20) for c in at for i in range(3) for pid, x, y in points if pid // 100 == c], "image_id long, point_id long, x double, y double")
    centers = spark.createDataFrame([(c * 10 + i, float(at[c][0] + i), 5.0) for c in at for i in range(3)], "image_id long, x double, y double")
    members = sp.assign_points(p, blocks, 5.0).select("point_id", "block")
    assert sorted(rows(sp.assign_images(centers, obs, members, blocks))) == [(c * 10 + i, c) for c in at for i in range(3)]
    assert sorted(rows(sp.skip_small_blocks(sp.assign_images(centers, obs, members, blocks), 3)[0])) == [(0, 3), (1, 3)]
    chosen = sp.select_region_images(centers, obs, p, (0.0, 0.0, 20.0, 10.0))
    assert {r.image_id for r in chosen.collect()} == {0, 1, 2}


def test_rebalance_is_a_cover_with_enough_images(spark):
    pts = [(i, x, y) for i, x, y, _ in cloud(spark, 600, 2)]
    d = spark.createDataFrame(pts, "image_id long, x double, y double")
    region = (-5.0, -20.0, 55.0, 20.0)
    rects = [r[1:] for r in rows(sp.rebalance_cells(d, region, 150, 20, 2.0))]
    assert sum((x1 - x0) * (y1 - y0) for x0, y0, x1, y1 in rects) == pytest.approx(60 * 40)
    n = [sum(x0 <= x < x1 and y0 <= y < y1 for _, x, y in pts) for x0, y0, x1, y1 in rects]
    assert len(rects) > 3 and all(k >= 20 for k in n) and sp.auto_params(600, region)[:2] == (120, 36)


def test_scale_check_recovers_the_scale(spark):
    cams = []
    for i in range(10):
        for j in range(10):
            x, y, z = 100.0 * i, 100.0 * j, 10 * math.sin(i + j)
            cams.append((i * 10 + j, "fwd" if (i + j) % 2 else "bwd", 1.002 * x, 1.002 * y, 1.002 * z, x, y, z))
    d = spark.createDataFrame(cams, "image_id long, folder string, sx double, sy double, sz double, dx double, dy double, dz double")
    e = st.scale_estimate(st.scale_pairs(d)).first()
    assert e.err_pct == pytest.approx(0.2, abs=1e-6)
    assert st.scale_check(d).first().err_pct == pytest.approx(0.2, abs=0.05)
    u = st.umeyama(d, ["folder"]).collect()
    assert all(r.scale == pytest.approx(1 / 1.002) for r in u)
    assert all(r.rms < 1e-9 for r in st.prior_residuals(d, ["folder"]).collect())


def test_diameter_and_plane(spark):
    pts = [(0, *p) for _, *p in cloud(spark, 150, 7)]
    d = spark.createDataFrame(pts, "k long, x double, y double, z double")
    assert st.diameter(d, ["k"]).first().diameter == pytest.approx(max(math.dist(a[1:], b[1:]) for a in pts for b in pts))
    flat = spark.createDataFrame([(0, float(x), float(y), 2.0 * x - y + 3) for x in range(4) for y in range(5)], "k long, x double, y double, z double")
    r = st.plane_fit(flat, ["k"]).first()
    assert (r.a, r.b, r.c) == pytest.approx((2, -1, 3))


def test_triangulation(spark):
    o = []
    for v, (cx, cy) in enumerate([(0.0, 0.0), (1.0, 0.0), (0.0, 2.0)]):
        x, y, z = 0.3, -0.2, 5.0
        o.append((1, (x - cx) / z, (y - cy) / z, 1.0, 0.0, 0.0, -cx, 0.0, 1.0, 0.0, -cy, 0.0, 0.0, 1.0, 0.0))
    names = "point_id long, u double, v double, " + ", ".join(f"p{i}{j} double" for i in range(3) for j in range(4))
    r = st.triangulate_tracks(spark.createDataFrame(o, names)).first()
    assert (r.x, r.y, r.z) == pytest.approx((0.3, -0.2, 5.0)) and r.n == 3


def boxes(spark, bs):
    return spark.createDataFrame([("i", k, *map(float, b), s, 100, 80) for k, (b, s) in enumerate(bs)], "image_id string, box_id long, x0 double, y0 double, x1 double, y1 double, score double, width int, height int")


def test_boxes(spark):
    b = boxes(spark, [((10, 10, 50, 50), 0.9), ((50, 50, 10, 10), 0.8), ((-20, -20, 0, 0), 0.7), ((60, 12, 90, 48), 0.6), ((60, 70, 95, 79), 0.5)])
    clean = bx.clip_boxes(bx.normalize_boxes(b))
    assert {r.box_id for r in clean.collect()} == {0, 1, 3, 4}
    assert {r.box_id for r in bx.nms(clean).collect()} == {0, 3, 4}
    assert [r.box_id for r in bx.row_boxes(bx.nms(clean)).orderBy("nth").collect()] == [0, 3]
    clicks = spark.createDataFrame([("i", 20.0, 20.0), ("i", 99.0, 79.0), ("j", 1.0, 1.0)], "image_id string, x double, y double")
    assert sorted(rows(bx.route_clicks(bx.nms(clean), clicks)), key=str) == sorted([("i", 20.0, 20.0, 0), ("i", 99.0, 79.0, 4), ("j", 1.0, 1.0, None)], key=str)


def test_nms_equals_a_plain_loop(spark):
    rng = random.Random(4)
    bs = [((x := rng.uniform(0, 60), y := rng.uniform(0, 50), x + rng.uniform(5, 40), y + rng.uniform(5, 30)), round(rng.random(), 3)) for _ in range(60)]

    def iou(a, b):
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        s = lambda r: (r[2] - r[0]) * (r[3] - r[1])
        return w * h / (s(a) + s(b) - w * h)

    kept = []
    for k in sorted(range(60), key=lambda k: (-bs[k][1], k)):
        if all(iou(bs[k][0], bs[j][0]) <= 0.3 for j in kept):
            kept.append(k)
    assert {r.box_id for r in bx.nms(boxes(spark, bs), threshold=0.3).collect()} == set(kept)


JOBS = [("train-a", "train", "done", "vase 花瓶", 1), ("colmap-b", "colmap", "failed", "vase 花瓶", 2), ("train-c", "train", "failed", "chair", 3), ("split-d", "blocksplit", "done", "hall", 4), ("train-e", "train", "done", "vase 花瓶 two", 5)]


def test_facets(spark):
    j = spark.createDataFrame([(i, k, s, t, f"/w/{i}", c) for i, k, s, t, c in JOBS], "id string, kind string, status string, title string, subtitle string, created_at long")
    f = {(r.facet, r.value): r.n for r in jb.facets(j, "花瓶", "train", "failed").collect()}
    assert ("total", "") not in f and f[("kind", "colmap")] == 1 and f[("status", "done")] == 2 and f[("summary", "failed")] == 2
    assert [r.id for r in jb.page(j, 1).collect()][:2] == ["train-e", "split-d"]


LOG = ["=== [12:00:00] feature_extractor x ===", "noise", "=== [12:01:00] exhaustive_matcher ===", "skip simplify", "=== [12:02:00] colmap mapper x", "=== [12:03:00] rig calibration pass 2/2: rig_configurator x", "=== [12:04:00] done. workspace=/w"]


def test_stages_batch_equals_stream(spark, tmp_path):
    t0 = datetime(2026, 1, 1)
    data = [(j, k, t0 + timedelta(seconds=k), line) for j in ("a", "b") for k, line in enumerate(LOG[: 7 if j == "a" else 5])]
    schema = "job_id string, seq long, ts timestamp, line string"
    df = spark.createDataFrame(data, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(r.job_id, r.stage): r.status for r in lg.stage_status(df).collect()}
    assert batch[("a", "mapper")] == "done" and batch[("b", "mapper")] == "running" and batch[("a", "simplify")] == "skipped"
    q = sl.stage_machine(sl.clean_lines(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))).writeStream.format("memory").queryName("stages").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.table("stages").orderBy("seq").collect():
        last[r.job_id] = r.statuses
    assert last == {j: sl.write_statuses({s: v for (k, s), v in batch.items() if k == j}) for j in ("a", "b")}


def run_stream(df, mode="append"):
    """What a stream has written when its source is used up: all rows of each batch, in order."""
    out = []
    q = df.writeStream.outputMode(mode).foreachBatch(lambda batch, k: out.extend(batch.collect())).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return out


def test_a_job_ends_when_it_has_finished_and_its_log_is_drained(spark, tmp_path):
    lines, jobs = str(tmp_path / "lines"), str(tmp_path / "jobs")
    put = lambda path, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    log, job = "job_id string, seq long, line string", "job_id string, last_seq long, status string"
    state = str(tmp_path / "state")

    def turn():
        got = []
        found = sl.stage_machine(spark.readStream.schema(log).parquet(lines), spark.readStream.schema(job).parquet(jobs))
        q = found.writeStream.foreachBatch(lambda b, k: got.extend(b.collect())).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return [(r.job_id, r.seq, r.statuses, r.ended) for r in sorted(got, key=lambda r: (r.job_id, r.seq, r.ended))]

    put(lines, [("a", 0, LOG[0]), ("a", 1, LOG[-1]), ("b", 0, LOG[0])], log)
    put(jobs, [("b", 2, "failed")], job)
    # The closing banner alone ends nothing, nor does the record of a job whose lines are still to come.
    assert turn() == [("a", 0, "extract=running", False), ("a", 1, "extract=done", False), ("b", 0, "extract=running", False)]
    put(lines, [("a", 2, "=== [12:05:00] colmap mapper again"), ("b", 1, "x"), ("b", 2, "last words")], log)
    assert turn() == [("a", 2, "extract=done,mapper=running", False), ("b", 2, "extract=failed", True)]
    put(jobs, [("a", 2, "done")], job)
    assert turn() == [("a", 2, "extract=done,mapper=done", True)]


#: Lines of each kind and what they amount to, by hand.
KINDS = {
    "frames": (["Found 3 video", "######## [1/3] a", "-> 3 kept / 1 dropped", "x", "######## [2/4]", "-> 4 kept / 0 dropped"], {"total": "4", "cur": "2", "kept": 7, "dropped": 1}),
    "train": (["Loading train cameras: 3/245 [00:01", "Training progress: 10/30000 [00:01, Loss=0.5]", "20/7000 | Loss: 0.25 | Splats: 1", "[ITER 30] 1/2 | Loss: 0.2", "Training complete!"], {"iter": "30", "total": "2", "loss": "0.2", "complete": True, "phase": "完成"}),
    "mesh": (
        ["Found 5 cameras", "Num vertices post: 12", "[mesh] result: /m.ply", "[mesh] scaled result: /mm.ply mm_per_unit=2.5", "[texture] obj: /t.obj", "[texture] scaled obj: /tm.obj", "[texture] glb: /t.glb", "[texture] scaled glb: /tm.glb", "[texture] atlas: /1.png", "[texture] atlas: /0.png", "View selection"],
        {"vertices": "12", "mesh_path": "/m.ply", "mesh_scaled_path": "/mm.ply", "mm_per_unit": "2.5", "texture_obj": "/t.obj", "texture_obj_mm": "/tm.obj", "texture_glb": "/t.glb", "texture_glb_mm": "/tm.glb", "texture_atlas": ["/1.png", "/0.png"], "phase": "貼圖:選視角"},
    ),
    "gcs": (["Building synchronization state...", "Copying gs://a", "Starting synchronization", " Downloading b"], {"copied": 2, "objects": None, "size": None, "phase": "下載中"}),
    "depth": (["Images: 9 under /d x", "[1/8] a.jpg", "Done. processed=7 skipped=1"], {"total": "8", "out_dir": "/d x", "cur": "1", "written": "7", "skipped": "1", "phase": "完成"}),
    "matte": (["Images: 9 under /d", "[1/9] a.jpg boxes=2", "[2/9] b boxes=3", "[warn] no boxes: c"], {"total": "9", "out_dir": "/d", "cur": "2", "written": None, "skipped": None, "phase": "推論中", "boxes": 5, "empty": 1}),
    "blocksplit": (["[blocksplit] block_1_0: 3 images → 40 views", "[blocksplit] block_0_0: 2 → 10 views", "[blocksplit] block_1_0: again → 99 views"], {"blocks": ["block_1_0", "block_0_0"], "views": ["40", "10"]}),
}


@pytest.mark.parametrize("kind", list(KINDS))
def test_counters_of_each_kind_stream_equals_batch(spark, tmp_path, kind):
    lines, want = KINDS[kind]
    df = spark.createDataFrame([("j", k, datetime(2026, 1, 1), x) for k, x in enumerate(lines)], "job_id string, seq long, ts timestamp, line string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    batch = lg.counters(df, kind, ["job_id"]).first().asDict()
    assert batch == {"job_id": "j"} | want
    stream = run_stream(sl.running_counters(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), kind), "update")
    assert stream[-1].asDict() == batch


def test_replay_then_follow(spark, tmp_path):
    schema, path = "job_id string, seq long, ts timestamp, line string", str(tmp_path / "log")
    put = lambda *rows: spark.createDataFrame([(j, k, None, x) for j, k, x in rows], schema).write.mode("append").json(path)
    put(("a", 0, "first line"), ("a", 1, "second"), ("a", 2, "third"), ("b", 0, "only"))
    past, stream = rd.replay_then_follow(spark, path, 14, str(tmp_path / "seen"))
    put(("a", 3, "fourth"), ("c", 0, "new job"))
    assert sorted((r.job_id, r.seq) for r in past.collect()) == [("a", 1), ("a", 2), ("b", 0)]
    assert sorted((r.job_id, r.seq) for r in run_stream(stream)) == [("a", 3), ("c", 0)]


def test_images_are_paired_over_splits(spark, tmp_path):
    path = tmp_path / "m"
    path.mkdir()
    body = "".join(f"{i} 1 0 0 0 1 2 3 1 dir/name {i}.jpg\n" + (" ".join(f"{i}.5 {k} {k - 1}" for k in range(i % 4)) + "\n") for i in range(400))
    (path / "images.txt").write_text("# a comment\n" + body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        poses, obs = rd.read_images(spark, str(path / "images.txt"))
        assert sorted((r.image_id, r.name) for r in poses.collect()) == [(i, f"dir/name {i}.jpg") for i in range(400)]
        assert sorted(rows(obs.select("image_id", "idx", "x", "y", F.coalesce("point_id", F.lit(-1))))) == [(i, k, i + 0.5, float(k), k - 1) for i in range(400) for k in range(i % 4)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ranks_without_keys(spark, monkeypatch):
    values = [(k * 7919 % 1000, k) for k in range(1000)] + [(5, 2000), (None, 3000)]
    df = spark.createDataFrame(values, "v long, k long").repartition(5)
    want = {k: i for i, (v, k) in enumerate(sorted(values, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))}
    for bucket in (10**6, 90):
        monkeypatch.setattr(fr, "BUCKET", bucket)
        assert {r.k: r.position for r in fr.ranked(df, [], ["v", "k"]).collect()} == want


def test_cull_cameras_gives_the_whole_model(spark):
    images = spark.createDataFrame([(i, f"n{i}", i % 2, float(i), 0.0, 0.0) for i in range(6)], "image_id long, name string, camera_id long, cx double, cy double, cz double")
    points = spark.createDataFrame([(0, 0.0, 0.0, 10.0, 1.0), (1, 0.0, 0.0, 500.0, 1.0), (2, 1.0, 0.0, 10.0, 9.0), (3, 5.0, 0.0, 9.0, 1.0), (4, 3.0, 0.0, 90.0, 1.0)], "point_id long, x double, y double, z double, error double")
    obs = spark.createDataFrame([(0, 0), (1, 0), (0, 1), (1, 1), (0, 2), (1, 2), (5, 3), (4, 3), (2, None), (2, 4), (0, 4), (1, 4), (4, 4)], "image_id long, point_id long")
    gone = spark.createDataFrame([("n5",)], "name string")
    out = md.cull_cameras(images, obs, points, gone)
    assert {r.image_id for r in out["images"].collect()} == {0, 1, 2, 3, 4} and {r.camera_id for r in out["cameras"].collect()} == {0, 1}
    assert {r.point_id for r in out["points"].collect()} == {0, 4}  # 1: too narrow, 2: error, 3: seen once
    assert sorted(rows(out["observations"].select("image_id", F.coalesce("point_id", F.lit(-1))))) == sorted([(0, 0), (1, 0), (0, -1), (1, -1), (0, -1), (1, -1), (4, -1), (2, -1), (2, 4), (0, 4), (1, 4), (4, 4)])
    kept = md.cull_cameras(images, obs, points, gone, filter_points=False)
    assert {r.point_id for r in kept["points"].collect()} == {0, 1, 2, 3, 4}


def test_size_mismatch_lists_missing_files(spark):
    cams = spark.createDataFrame([(1, 100, 80), (2, 100, 80)], "camera_id long, width int, height int")
    images = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c"), (4, 2, "d"), (5, 2, "e")], "image_id long, camera_id long, name string")
    files = spark.createDataFrame([("a", 50, 40), ("c", 100, 80), ("d", 60, 80), ("e", 100, 80)], "name string, width int, height int")
    assert sorted((r.image_id, r.problem, r.uniform) for r in md.size_mismatch(cams, images, files).collect()) == [(1, "size", True), (2, "missing", False), (4, "size", False)]


def test_fits_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    src = rng.normal(size=(60, 3)) * [5, 2, 1]
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    dst = 2.5 * src @ q.T + [10, -4, 3] + rng.normal(size=src.shape) * 0.01
    df = spark.createDataFrame([("k", *map(float, s), *map(float, t)) for s, t in zip(src, dst)], "k string, sx double, sy double, sz double, dx double, dy double, dz double").repartition(4)
    fit = st.umeyama(df, ["k"]).first()
    r = np.array([[fit[f"r{i}{j}"] for j in range(3)] for i in range(3)])
    t = np.array([fit[f"t{i}"] for i in range(3)])
    assert fit.scale == pytest.approx(2.5, abs=0.01) and np.allclose(r, q, atol=0.01) and np.allclose(r @ r.T, np.eye(3))
    e = fit.scale * src @ r.T + t - dst
    got = st.prior_residuals(df, ["k"]).first()
    assert [got.rms_x, got.rms_y, got.rms_z] == pytest.approx(list(np.sqrt((e**2).mean(0)))) and got.largest == pytest.approx(np.linalg.norm(e, axis=1).max()) and got["median"] == pytest.approx(np.median(np.linalg.norm(e, axis=1)))
    pts = df.select("k", F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dz").alias("z"))
    b = st.basis(pts, ["k"]).first()
    v = np.array([[b[f"v{i}{j}"] for j in range(3)] for i in range(3)])
    w, u = np.linalg.eigh(np.cov(dst.T))
    assert np.allclose(np.abs(v), np.abs(u[:, ::-1]), atol=1e-6)
    on = (dst - dst.mean(0)) @ v
    want = on.max(0) - on.min(0)
    assert [st.extents(pts, ["k"]).first()[f"extent{i}"] for i in range(3)] == pytest.approx(list(want))
    assert [st.extents(pts, ["k"], mm_per_unit=2.0, height_axis=1, swap_wd=True, flip_h=True).first()[f"extent{i}"] for i in range(3)] == pytest.approx([2 * want[1], 2 * want[2], 2 * want[0]])
    assert st.diameter(pts, ["k"]).first().diameter == pytest.approx(max(np.linalg.norm(a - c) for a in dst for c in dst))


def test_visibility_and_region_against_plain_hulls(spark):
    import random

    rng = random.Random(2)

    def area(p):
        p, out = sorted(set(p)), []
        for way in (p, p[::-1]):
            hull = []
            for q in way:
                while len(hull) > 1 and (hull[-1][0] - hull[-2][0]) * (q[1] - hull[-2][1]) - (hull[-1][1] - hull[-2][1]) * (q[0] - hull[-2][0]) <= 0:
                    hull.pop()
                hull.append(q)
            out += hull[:-1]
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(out, out[1:] + out[:1]))) / 2 if len(out) > 2 else 0.0

    points = [(k, rng.uniform(0, 30), rng.uniform(0, 30)) for k in range(80)]
    obs = [(i, k, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(12) for k in rng.sample(range(80), 15)]
    centers = [(i, rng.uniform(0, 30), rng.uniform(0, 30)) for i in range(12)]
    region, buffer = (5.0, 5.0, 18.0, 20.0), 1.0
    inside = {k for k, x, y in points if 4 <= x <= 19 and 4 <= y <= 21}
    want = {}
    for i, x, y in centers:
        whole, part = area([(a, b) for j, _, a, b in obs if j == i]), area([(a, b) for j, k, a, b in obs if j == i and k in inside])
        by = (5 <= x <= 18 and 5 <= y <= 20, whole > 0 and part / whole >= 1 / 6)
        if any(by):
            want[i] = by
    found = sp.select_region_images(spark.createDataFrame(centers, "image_id long, x double, y double"), spark.createDataFrame(obs, "image_id long, point_id long, x double, y double"), spark.createDataFrame(points, "point_id long, x double, y double"), region, buffer)
    assert {r.image_id: (r.by_center, r.by_visibility) for r in found.collect()} == want


def test_listings(spark):
    paths = spark.createDataFrame([("b/0520/CAM_a",), ("b/0520/CAM_b",)], "path string")
    assert sorted(rows(ls.common_parent_plan(paths, "/out"))) == [("b/0520/CAM_a", "/out/0520/CAM_a"), ("b/0520/CAM_b", "/out/0520/CAM_b")]
    listing = spark.createDataFrame([("p/a/1.jpg",), ("p/a/",), ("p/b/2.PNG",), ("p/x.txt",), ("q/z.jpg",)], "key string")
    assert dict(rows(ls.inventory_children(listing, "p/"))) == {"a/": 1, "b/": 1, "": 1}
    assert rows(ls.layout(listing)) == [("nested", 3)]
    up = spark.createDataFrame([("gs://b/x/y/",), ("gs://b/x",), ("gs://b/",), ("gs://",), ("",)], "p string")
    assert rows(up.select(ls.parent_prefix("p"))) == [("gs://b/x/",), ("gs://b/",), ("",), (None,), (None,)]
    one = lambda *r: spark.createDataFrame(list(r), "key string, size long, md5 string")
    assert dict(rows(ls.sync_plan(one(("a", 1, "x"), ("b", 1, "x")), one(("b", 2, "x"), ("c", 1, "x")), True))) == {"a": "new", "b": "changed", "c": "delete"}


def test_drop_images_cascade(spark):
    images = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "c")], "image_id long, camera_id long, name string")
    obs = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (1, 11), (3, 11), (1, None)], "image_id long, point_id long")
    points = spark.createDataFrame([(10,), (11,)], "point_id long")
    out = md.drop_images(images, obs, points, cameras=(2,))
    assert {r.point_id for r in out["points"].collect()} == {10} and {r.camera_id for r in out["cameras"].collect()} == {1}
    assert sorted(rows(out["observations"].select("image_id", "point_id")), key=str) == sorted([(1, 10), (2, 10), (1, None), (1, None)], key=str)


def test_calibration(spark):
    cams = spark.createDataFrame([("Nadir_1",), ("FWD",), ("none",)], "camera string")
    cals = spark.createDataFrame([("fwd", 0), ("nadir", 1)], "name string, nth int")
    assert dict(rows(cb.match_calibration(cams, cals))) == {"Nadir_1": "nadir", "FWD": "fwd", "none": None}
    nodal = spark.createDataFrame([("N", 0.0, 0.0, 0.0), ("F", 100.0, 20.0, -5.0)], "sensor string, front double, right double, down double")
    arms = cb.lever_arms(nodal, "N")
    assert {r.sensor: (round(r.x, 6), round(r.y, 6), round(r.z, 6)) for r in arms.collect()}["F"] == (0.02, -0.1, -0.005)
    moved = arms.withColumn("x", F.col("x") + F.when(F.col("sensor") == "F", 0.6).otherwise(0.0))
    assert {r.sensor: r.fails for r in cb.check_lever_arms(moved, arms).collect()} == {"N": False, "F": True}


def test_upright_frame(spark):
    c = spark.createDataFrame([(0, i, float(i % 5), float(i // 5), 50.0) for i in range(25)], "k long, image_id long, x double, y double, z double")
    obs = spark.createDataFrame([(0, i, i) for i in range(25)], "k long, image_id long, point_id long")
    pts = spark.createDataFrame([(0, i, float(i % 5), float(i // 5), 40.0) for i in range(25)], "k long, point_id long, x double, y double, z double")
    r = cb.upright_frame(c, obs, pts, ["k"]).first()
    m = [[r[f"{n}_{a}"] for a in "xyz"] for n in ("right", "down", "forward")]
    assert r.scale == pytest.approx(2.0) and all(sum(a * b for a, b in zip(m[p], m[q])) == pytest.approx(float(p == q), abs=1e-9) for p in range(3) for q in range(3))
    assert abs(m[1][2]) == pytest.approx(1.0)


def test_writers(spark, tmp_path):
    f = fr.select_frames(frames(spark, {"a": 3, "b": 9}), threshold=8.0)
    rd.write_frame_report(f, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report/frames"), header=True).count() == 2
    views = spark.createDataFrame([(1, 5), (2, 6)], "block int, image_id int")
    rd.write_blocks({"views": views}, views.groupBy("block").count(), str(tmp_path / "blocks"))
    assert spark.read.parquet(str(tmp_path / "blocks/views")).where("block = 2").first().image_id == 6
    with pytest.raises(Exception, match="(?i)exists"):
        rd.write_blocks({"views": views}, views, str(tmp_path / "blocks"))
    (tmp_path / "jobs").mkdir()
    (tmp_path / "jobs/a.json").write_text('{"id": "a", "kind": "train", "status": "running", "other": 1}')
    (tmp_path / "jobs/b.json").write_text("not json")
    assert [(r.id, r.status) for r in rd.read_jobs(spark, str(tmp_path / "jobs")).collect()] == [("a", "failed")]


def test_entry_imports_without_llm(tmp_path):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(__file__).resolve().parent.parent
    shutil.copytree(root / "reconspark", tmp_path / "reconspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'w1_select_frames' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
