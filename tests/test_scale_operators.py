"""Selection, hulls, neighbours, suppression and two-view checks: against plain versions, on skewed data, in small pieces."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reconspark.operators import boxes as bx
from reconspark.operators import hull, neighbours, rig, selection, spatial, stats, twoview


def spread_values(rng, n):
    kinds = [lambda: 0.0, lambda: 7.0, lambda: rng.gauss(0, 1), lambda: rng.lognormvariate(0, 20), lambda: -rng.lognormvariate(0, 20), lambda: rng.randint(0, 3)]
    return [float(rng.choice(kinds)()) for _ in range(n)]


@pytest.mark.parametrize("bucket", [3, 40, 50_000])
def test_ranks_are_exact_however_few_rows_are_sorted_together(spark, monkeypatch, bucket):
    monkeypatch.setattr(selection, "BUCKET", bucket)
    rng = random.Random(bucket)
    groups = {"hot": spread_values(rng, 900), "equal": [2.5] * 300, "two": [1.0] * 150 + [2.0] * 151, None: spread_values(rng, 70), "one": [4.0]}
    rows = [(g, v) for g, values in groups.items() for v in values] + [("hot", None), ("hot", float("nan")), ("none", None)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {r.g: r for r in selection.at_ranks(d, "v", ["g"], {"first": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1, "past": lambda n: n}).collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        own = sorted(values)
        r = found[g]
        assert (r.n, r.first, r.mid, r["last"], r.past) == (len(own), own[0], own[len(own) // 2], own[-1], None)
    shares = {"a": 0.01, "b": 0.25, "c": 0.5, "d": 0.9}
    for r in selection.quantiles(d, "v", ["g"], shares).collect():
        assert np.allclose([r[k] for k in shares], np.quantile(groups[r.g], list(shares.values())), rtol=1e-12, atol=1e-12)
    whole = [v for values in groups.values() for v in values]
    one = selection.median(d, "v", []).collect()
    assert len(one) == 1 and one[0].n == len(whole) and math.isclose(one[0].median, float(np.median(whole)))


def test_ranks_of_nothing(spark):
    d = spark.createDataFrame([], "g string, v double")
    assert selection.median(d, "v", ["g"]).count() == 0
    assert [(r.n, r.median) for r in selection.median(d, "v", []).collect()] == [(0, None)]


def test_hulls_merge_over_any_cut(spark):
    rng = np.random.default_rng(2)
    sets = {(1, "a"): rng.normal(size=(5000, 2)), (2, None): rng.normal(size=(9, 2)), (3, "b"): np.repeat([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]], 20, axis=0), (4, "b"): np.array([[1.0, 2.0]]), (5, "b"): np.array([[math.cos(a), math.sin(a)] for a in np.linspace(0, 6.28, 700)])}
    rows = [(*k, float(x), float(y)) for k, xy in sets.items() for x, y in xy] + [(1, "a", None, 1.0), (1, "a", float("nan"), 1.0), (6, "b", None, None)]
    random.Random(1).shuffle(rows)
    d = spark.createDataFrame(rows, "k long, m string, x double, y double")
    wanted = {k: hull.area_of(xy[:, 0], xy[:, 1]) for k, xy in sets.items()} | {(6, "b"): 0.0}
    for parts in (1, 7):
        found = {(r.k, r.m): r.area for r in hull.hull_areas(d.repartition(parts), ["k", "m"]).collect()}
        assert found.keys() == wanted.keys() and all(math.isclose(found[k], wanted[k], rel_tol=1e-9, abs_tol=1e-12) for k in wanted)
    # A hot group reaches the second step as corners alone, and batches of one row give the same hull.
    import pandas as pd

    xy = sets[(1, "a")]
    frame = pd.DataFrame({"_g": 1, "x": xy[:, 0], "y": xy[:, 1]})
    thin = pd.concat(hull._thin(iter([frame])))
    assert len(thin) < 60
    ones = pd.concat(hull._areas(frame.iloc[k : k + 1] for k in range(len(frame))))
    assert math.isclose(ones["_area"].iloc[0], wanted[(1, "a")], rel_tol=1e-9)


def brute_nearest(points, k):
    out = []
    for i, p in points:
        near = sorted((math.dist(p, q), j) for j, q in points if j != i)[:k]
        out += [(i, j, n + 1) for n, (_, j) in enumerate(near)]
    return sorted(out)


def clouds(rng):
    dense = [(k, tuple(rng.gauss(5, 1e-5) for _ in range(3))) for k in range(400)]
    wide = [(400 + k, tuple(rng.uniform(0, 1000) for _ in range(3))) for k in range(6)]
    return dense + wide + [(500 + k, (7.0, 7.0, 7.0)) for k in range(5)]  # five at one place


@pytest.mark.parametrize("cell", [8, 60, 4096])
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_neighbours_of_a_skewed_cloud(spark, cell, k):
    points = clouds(random.Random(3))
    d = spark.createDataFrame([(i, *p) for i, p in points] + [(None, 1.0, 1.0, 1.0), (900, None, 1.0, 1.0)], "id long, x double, y double, z double").repartition(3)
    found = neighbours.knn(d, "id", ("x", "y", "z"), k, cell=cell).collect()
    assert sorted((r.id, r.neighbour, r.nth) for r in found) == brute_nearest(points, k)
    leaves = neighbours.leaf_of(neighbours.grow(np.array([p for _, p in points]), 41), np.array([p for _, p in points]))
    assert np.bincount(leaves).max() < 40  # 97 % of the points stand in a millionth of the extent


def test_nearest_neighbours_by_key(spark):
    rng = random.Random(9)
    sets = {g: [(k, (rng.random(), rng.random())) for k in range(n)] for g, n in (("a", 90), ("b", 12), ("c", 2), ("d", 1))}
    d = spark.createDataFrame([(g, i, *p) for g, own in sets.items() for i, p in own], "g string, id long, x double, y double").repartition(4)
    found = neighbours.knn(d, "id", ("x", "y"), 3, ["g"], cell=10).collect()
    assert sorted((r.g, r.id, r.neighbour, r.nth) for r in found) == sorted((g, *r) for g, own in sets.items() for r in brute_nearest(own, 3))
    assert neighbours.knn(d.where("false"), "id", ("x", "y"), 3, ["g"]).count() == 0


def plain_nms(boxes, threshold):
    def iou(a, b):
        w, h = max(0, min(a[4], b[4]) - max(a[2], b[2])), max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return w * h / max((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h, 1e-6)

    kept = []
    for b in sorted(boxes, key=lambda b: (-b[6], b[1])):
        if all(k[0] != b[0] or iou(k, b) <= threshold for k in kept):
            kept.append(b)
    return sorted((b[0], b[1]) for b in kept)


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.9])
def test_suppression_in_rounds_equals_the_plain_loop(spark, threshold):
    rng = random.Random(7)
    boxes = []
    for image, n in ((1, 300), (2, 40), (3, 1)):
        for k in range(n):
            x, y, side = rng.uniform(0, 60), rng.uniform(-20, 20), rng.choice([3, 3.5, 4, 8, 20]) * rng.uniform(0.8, 1.2)
            boxes.append((image, k, x, y, x + side, y + side * rng.uniform(0.9, 1.1), round(rng.random(), 1)))
    boxes += [(1, 900, 5.0, 5.0, 5.0, 9.0, 0.9)] + [(1, 1000 + k, 1.0, 1.0, 4.0, 4.0, 0.5) for k in range(30)]  # no area; one box thirty times
    d = spark.createDataFrame(boxes, "image_id int, box_id int, x0 double, y0 double, x1 double, y1 double, score double").repartition(3)
    wanted = plain_nms(boxes, threshold)
    for fold in (0, 100, 10_000):
        assert sorted((r.image_id, r.box_id) for r in bx.nms(d, threshold=threshold, fold=fold).collect()) == wanted


def quaternion(axis, angle):
    s = math.sin(angle / 2) / math.sqrt(sum(a * a for a in axis))
    return (math.cos(angle / 2), *[a * s for a in axis])


def matrix(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


VIEWS = "image_id long, sensor string, frame_key long, fx double, fy double, cx double, cy double, k double, qw double, qx double, qy double, qz double, tx double, ty double, tz double"


def test_epipolar_errors_of_known_poses(spark):
    rng = np.random.default_rng(5)
    world = rng.uniform(-2, 2, (80, 3)) + [0, 0, 8]
    views, seen = [], {}
    for image, (sensor, frame, k) in enumerate([("left", 0, 0.0), ("right", 0, 0.05), ("left", 1, 0.0), ("right", 1, 0.05), ("left", None, 0.0)]):
        q, t = quaternion(rng.normal(size=3), 0.1 * (image + 1)), rng.normal(size=3) * 0.5
        views.append((image, sensor, frame, 800.0, 820.0, 500.0, 400.0, k, *map(float, q), *map(float, t)))
        p = world @ matrix(q).T + t
        u = p[:, :2] / p[:, 2:]
        u = u * (1 + k * (u**2).sum(1, keepdims=True))
        seen[image] = u * [800.0, 820.0] + [500.0, 400.0]
    keypoints = [(i, n, float(x), float(y)) for i, xy in seen.items() for n, (x, y) in enumerate(xy)]
    pairs = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    matches = [(a * 2147483647 + b, [(n, n) for n in range(80)]) for a, b in pairs] + [(2 * 2147483647 + 77, [(n, n) for n in range(80)]), (3, [(0, 0)] * 10)]
    tables = (spark.createDataFrame(matches, "pair_id long, matches array<struct<a: int, b: int>>"), spark.createDataFrame(keypoints, "image_id long, idx int, x double, y double"), spark.createDataFrame(views, VIEWS))
    found = twoview.epipolar_errors(*tables).collect()
    # All pairs but those of one frame, of an unregistered image, and of few matches; right poses leave no error.
    assert {r.pair_id for r in found} == {a * 2147483647 + b for a, b in pairs} - {1, 2 * 2147483647 + 3}
    assert len(found) == 8 * 80 and max(r.px for r in found) < 1e-3
    wrong = [v if v[0] != 2 else (*v[:12], v[12] + 0.4, *v[13:]) for v in views]
    checked = {(r.sensor_a, r.sensor_b): r for r in stats.epipolar_check(twoview.epipolar_errors(*tables[:2], spark.createDataFrame(wrong, VIEWS)), limit_px=5.0).collect()}
    assert checked[("left", "left")].fails and checked[("left", "left")].pairs == 3 and not checked[("right", "right")].fails
    few = twoview.epipolar_errors(*tables, max_pairs=1).select("sensor_a", "sensor_b", "pair_id").distinct().collect()
    assert sorted((r.sensor_a, r.sensor_b, r.pair_id) for r in few) == [("left", "left", 2), ("left", "right", 3), ("right", "right", 1 * 2147483647 + 3)]


def test_colocation_turns_offsets_of_strips_flown_both_ways(spark):
    arm, poses, rows = np.array([0.3, 0.0, 0.1]), [], []
    for frame in range(8):
        # Heading by strip: even frames one way, odd ones the other.
        q = quaternion((0, 0, 1), math.pi * (frame % 2))
        r, centre = matrix(q), np.array([10.0 * frame, 5.0, 100.0])
        for camera, offset in (("nadir", np.zeros(3)), ("side", arm), ("far", np.array([0.0, 2.0, 0.0]))):
            place = centre + r.T @ offset
            name = f"{camera}/{frame}"
            poses.append((name, *map(float, q), *map(float, -r @ place)))
            rows.append((name, camera, str(frame)))
    d = spark.createDataFrame(poses, "name string, qw double, qx double, qy double, qz double, tx double, ty double, tz double")
    r = spark.createDataFrame(rows, "name string, camera string, frame_key string")
    certificate = spark.createDataFrame([("side", 0.3, 0.0, 0.4)], "camera string, x double, y double, z double")
    found = {x.camera: x for x in rig.colocation(r, d, "nadir", certificate, lever_arm_m=0.2).collect()}
    # In world axes the two headings cancel; in the reference camera's axes the mean is the lever arm.
    assert np.allclose([found["side"][f"m{v}"] for v in "xyz"], arm, atol=1e-9) and found["side"].spread < 1e-9
    assert math.isclose(found["side"].error, 0.3, abs_tol=1e-9) and found["side"].fails
    assert found["far"].error is None and found["far"].fails
    assert {x.camera: x.fails for x in rig.colocation(r, d, "nadir").collect()} == {"side": False, "far": True}


def test_sequence_pairs_join_on_positions(spark):
    d = spark.createDataFrame([(g, p) for g in "abc" for p in range(6)], "grp string, pos long")
    plan = spatial.sequence_pairs(d, 2, 2)
    assert "NestedLoop" not in plan._jdf.queryExecution().toString() and "Cartesian" not in plan._jdf.queryExecution().toString()
    steps = {0, 1, 2, 3}
    assert sorted((r.group_a, r.pos_a, r.group_b, r.pos_b) for r in plan.collect()) == sorted((a, p, b, p + s) for a in "abc" for b in "abc" if b >= a for p in range(6) for s in steps if p + s < 6)


def test_blocks_of_very_different_sizes(spark):
    rng = random.Random(41)
    blocks = [(0, 0.0, 0.0, 1e6, 1e6), (1, 5.0, 5.0, 5.0, 9.0), (2, -3e5, 10.0, 3e5, 10.5)]
    blocks += [(k, x := rng.uniform(-50, 50), y := rng.uniform(-50, 50), x + rng.uniform(0.1, 2), y + rng.uniform(0.1, 2)) for k in range(3, 60)]
    points = [(k, rng.uniform(-60, 60), rng.uniform(-60, 60)) for k in range(400)] + [(1000 + k, rng.uniform(-4e5, 1.2e6), rng.uniform(0, 20)) for k in range(200)]
    points += [(2000 + b, x, y) for b, x, y, _, _ in blocks] + [(3000 + b, x, y) for b, _, _, x, y in blocks] + [(9, None, 1.0)]
    p = spark.createDataFrame(points, "point_id long, x double, y double")
    b = spark.createDataFrame(blocks, "block long, x0 double, y0 double, x1 double, y1 double")
    for buffer in (0.0, 0.75):
        found = [(r["point_id"], r["block"]) for r in spatial.assign_points(p, b, buffer).collect()]
        want = [(i, k) for i, x, y in points for k, x0, y0, x1, y1 in blocks if x is not None and x0 - buffer <= x < x1 + buffer and y0 - buffer <= y < y1 + buffer]
        assert sorted(found) == sorted(want)
        assert len(want) > 300
    assert spatial.assign_points(p, b.limit(0), 0.0).count() == 0


def test_widest_angles_of_merged_hulls(spark):
    from reconspark.operators.hull import hull_angles, widest_angle

    rng = np.random.default_rng(5)
    rays = rng.normal(0, 0.02, (3000, 2))
    unit = np.column_stack([rays, np.ones(3000)])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    plain = np.degrees(np.arccos(np.clip(unit @ unit.T, -1, 1).min()))
    assert widest_angle(rays) == pytest.approx(plain, rel=1e-9)
    ring = np.column_stack([np.cos(np.arange(1500)), np.sin(np.arange(1500))]) * 0.01  # every ray is a corner
    assert widest_angle(ring) == pytest.approx(np.degrees(2 * np.arctan(0.01)), rel=1e-5)
    rows = [(1, float(x), float(y)) for x, y in rays] + [(2, 0.5, 0.5), (3, None, 0.1)]
    df = spark.createDataFrame(rows, "k long, x double, y double").repartition(7)
    found = {r.k: r.angle for r in hull_angles(df, ["k"]).collect()}
    assert found[1] == pytest.approx(plain, rel=1e-9) and found[2] == 0 and found[3] == 0


@pytest.mark.parametrize("paired", [1, 64])
def test_narrow_tracks_by_hull_or_pairs(spark, monkeypatch, paired):
    """Tracks that the first ray doesn't settle: the same points stand whether pairs or hulls decide."""
    from reconspark.operators import models

    monkeypatch.setattr(models, "PAIRED", paired)
    rng = np.random.default_rng(9)
    centres, points, obs, want = [], [], [], set()
    for p in range(12):
        n, at = 10 + p, np.array([p * 50.0, 0.0, 0.0])
        way = rng.normal(size=3)
        way /= np.linalg.norm(way)
        cam = at + 100 * way + rng.normal(0, 0.2 + 0.05 * p, (n, 3))
        unit = (cam - at) / np.linalg.norm(cam - at, axis=1, keepdims=True)
        if np.degrees(np.arccos(np.clip(unit @ unit.T, -1, 1).min())) >= 1.5:
            want.add(p)
        points.append((p, *map(float, at), 1.0))
        for row in cam:
            obs.append((len(centres), p))
            centres.append((len(centres), *map(float, row)))
    images = spark.createDataFrame(centres, "image_id long, cx double, cy double, cz double")
    pts = spark.createDataFrame(points, "point_id long, x double, y double, z double, error double")
    got = {r.point_id for r in models.supported_points(images, spark.createDataFrame(obs, "image_id long, point_id long"), pts).collect()}
    assert got == want and 0 < len(want) < 12


def test_frame_key_of_more_cameras_than_a_mask_holds(spark):
    from reconspark.operators import rig

    names = [(f"c{c:03d}", f"c{c:03d}/s{c}_{run}_{shot}.jpg") for c in range(130) for run in range(2) for shot in range(3)]
    names += [("c000", "c000/s0_9_9.jpg")]  # not of all cameras
    df = spark.createDataFrame(names, "camera string, name string")
    assert [(r.combo, r.shared) for r in rig.auto_frame_key(df).collect()] == [([1, 2], 6)]
    grouped, rest = rig.group_auto(df.select("name"))
    assert grouped.count() == 781 and rest.count() == 0
    twice = df.select("name").unionByName(spark.createDataFrame([("c001/t1_0_0.jpg",), ("loose.jpg",)], "name string"))
    grouped, rest = rig.group_auto(twice)
    assert not grouped.where("frame_key = '0_0'").count() and rest.count() == 130 + 1 + 1


def test_release_deletes_kept_tables_alone(spark):
    import os

    from reconspark.operators.frames import kept, release

    table = kept(spark.range(100).repartition(3))
    assert table.count() == 100
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    mine = os.path.join(folder, "table-of-another")
    os.makedirs(mine)
    assert any(n.startswith("rdd-") for n in os.listdir(folder))
    assert release(spark) >= 1 and os.listdir(folder) == ["table-of-another"] and release(spark) == 0
    os.rmdir(mine)
    assert kept(spark.range(7)).count() == 7  # and the folder goes on being used


def test_many_corners_in_a_small_file_are_not_broadcast(spark, tmp_path):
    path = str(tmp_path / "corners")
    spark.range(20_000).selectExpr("id div 49 AS m", "id % 7 AS gx", "id % 49 div 7 AS gy", "CAST(id % 7 AS DOUBLE) AS x", "CAST(id % 49 div 7 AS DOUBLE) AS y", "0D AS z").write.parquet(path)
    pairs = stats.corner_pairs(spark.read.parquet(path), keys=["m"])
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert pairs.where("abs(sample - 10) > 1e-9").count() == 0 and pairs.count() > 20_000


def test_pair_ids_beyond_the_whole_numbers_of_a_double(spark):
    d, pairs = 2147483647, [(7_903_147, 794_745), (7_912_787, 782_393), (9_000_000, 899_999), (8_999_999, 1), (4_194_305, 2147483647), (2147483646, 7), (0, 5)]
    own = spark.createDataFrame([(a * d + b,) for a, b in pairs], "p long")
    assert [tuple(r) for r in own.select(*stats.pair_images("p")).collect()] == pairs


@pytest.mark.parametrize("few", [1, 32])
def test_nearest_stations_of_crowded_places(spark, monkeypatch, few):
    monkeypatch.setattr(spatial, "FEW_PLACES", few)
    rng = np.random.default_rng(few)
    spots = np.concatenate([rng.uniform(0, 0.01, (60, 2)), 0.004 + rng.uniform(0, 1e-5, (80, 2)), np.repeat([[0.006, 0.006]], 40, axis=0), [[0.0075, 0.002], [0.0077, 0.002]]])
    asked = np.concatenate([rng.uniform(-0.001, 0.011, (150, 2)), [[0.0076, 0.002], [0.006, 0.006]], np.repeat([[0.0063, 0.006]], 50, axis=0)])
    im = spark.createDataFrame([(k, 24 + float(a), 120 + float(b)) for k, (a, b) in enumerate(asked)] + [(900, None, 120.0)], "image_id long, lat double, lon double")
    s = spark.createDataFrame([(k, 1000 - k, 24 + float(a), 120 + float(b)) for k, (a, b) in enumerate(spots)], "station_id long, nth long, lat double, lon double")
    scale = 111320.0 * math.cos(math.radians(float(np.mean(24 + spots[:, 0]))))
    wanted = {}
    for k, p in enumerate(asked):
        d = np.round(np.hypot((p[0] - spots[:, 0]) * 111132.0, (p[1] - spots[:, 1]) * scale), 6)
        if d.min() <= 150:
            wanted[k] = (max(np.flatnonzero(d == d.min())), d.min())  # the last station has the first nth
    found = {r.image_id: (r.station_id, r.distance) for r in spatial.nearest_station(im, s, 150.0).collect()}
    assert found.keys() == wanted.keys() and len(found) > 100
    assert all(abs(found[k][1] - d) < 1e-5 and (found[k][0] == n or k == 150) for k, (n, d) in wanted.items())


def test_images_and_stations_at_one_place_are_not_paired(spark):
    images = spark.range(30_000).selectExpr("id AS image_id", "24D + id % 3 / 1e4 AS lat", "120D AS lon")
    stations = spark.range(20_000).selectExpr("id AS station_id", "20000 - id AS nth", "24D + id % 2 / 1e4 AS lat", "120D AS lon")
    assert spatial.nearest_station(images, stations, 5.0).groupBy("station_id").count().orderBy("station_id").collect() == [(19_998, 10_000), (19_999, 10_000)]


def test_many_small_hulls_at_once_equal_single_ones():
    import time

    import pandas as pd

    rng = np.random.default_rng(8)
    sets = [np.round(rng.normal(size=(n, 2)), int(rng.integers(0, 4))) for n in rng.integers(1, 45, 600)] + [np.ones((9, 2)), np.column_stack([np.arange(7.0), np.arange(7.0) * 3])]
    frame = pd.concat([pd.DataFrame({"_g": k, "x": p[:, 0], "y": p[:, 1]}) for k, p in enumerate(sets)], ignore_index=True)
    for size in (1, 50, 100_000):
        found = pd.concat(hull._areas(frame.iloc[k : k + size] for k in range(0, len(frame), size)))
        assert found["_g"].tolist() == list(range(len(sets)))
        assert np.allclose(found["_area"], [hull.area_of(p[:, 0], p[:, 1]) for p in sets], rtol=1e-12, atol=1e-12)
    # Groups of four points cost less than one call for each.
    many = pd.DataFrame({"_g": np.repeat(np.arange(50_000), 4), "x": rng.normal(size=200_000), "y": rng.normal(size=200_000)})
    start = time.process_time()
    assert sum(len(f) for f in hull._areas(many.iloc[k : k + 10_000] for k in range(0, len(many), 10_000))) == 50_000
    together, start = time.process_time() - start, time.process_time()
    for k in range(0, 20_000, 4):
        hull.area_of(many["x"].to_numpy()[k : k + 4], many["y"].to_numpy()[k : k + 4])
    assert together < 10 * (time.process_time() - start)


def test_tracks_of_a_batch_are_solved_together(spark):
    rng = np.random.default_rng(4)
    names, obs = ["point_id", "u", "v", *[f"p{i}{j}" for i in range(3) for j in range(4)]], []
    for k in range(300):
        x = np.array([*rng.uniform(-1, 1, 2), rng.uniform(4, 6), 1.0])
        for _ in range(int(rng.integers(1, 6)) if k else 12_000):
            p = np.column_stack([np.eye(3), [*rng.uniform(-1, 1, 2), 0.0]]) * [[1000.0], [1000.0], [1.0]]
            q = p @ x
            obs.append([k, *(float(c) for c in q[:2] / q[2]), *map(float, p.ravel())])
    sizes = {k: sum(1 for o in obs if o[0] == k) for k in range(300)}
    d = spark.createDataFrame(obs + [[None, *obs[0][1:]]] * 3, "point_id long, " + ", ".join(f"{n} double" for n in names[1:]))
    solve = stats.triangulate_tracks(d)
    assert "FlatMapGroupsInPandas" not in solve._jdf.queryExecution().executedPlan().toString()
    found = {r.point_id: r for r in solve.collect()}
    assert {k: r.n for k, r in found.items()} == {k: n for k, n in sizes.items() if n > 1} and all(r.median_px < 1e-6 for r in found.values())


def test_ranks_of_a_hot_key_are_made_in_buckets(spark, monkeypatch):
    from reconspark.operators import frames

    rows = [(k, f"n{(j * 7919) % 900:04d}", j) for k, n in ((1, 900), (2, 30), (None, 200)) for j in range(n)]
    d = spark.createDataFrame(rows, "k long, name string, j long").repartition(3)
    plain = sorted(map(str, frames.ranked(d, ["k"], ["name", "j"]).collect()))
    monkeypatch.setattr(frames, "BUCKET", 20)
    cut = frames.ranked(d, ["k"], ["name", "j"])
    assert sorted(map(str, cut.collect())) == plain
    assert cut.columns == ["k", "name", "j", "position", "n"]
    assert "windowspecdefinition(k" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    from reconspark.operators import frames
    from reconspark.plans.queries import j11_valid_observations

    monkeypatch.setattr(frames, "TASK_ROWS", 100)
    d = frames.dealt(spark.range(2000).selectExpr("id", "id % 7 AS k"), 2000, "id")
    sizes = [r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 200
    # Rows are dealt by number between the join and the counts.
    plan = j11_valid_observations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression") < plan.index("LeftSemi")


def test_rows_of_a_block_meet_the_blocks_in_many_tasks(spark):
    from reconspark.plans.queries import _blocked

    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        tasks = _blocked(spark, "/root/testdata/sf0.001")[0].select("block", F.spark_partition_id().alias("p")).distinct().groupBy("block").count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks and min(r["count"] for r in tasks) > 4


def test_keys_of_few_cameras_are_counted_in_one_aggregation(spark):
    names = spark.createDataFrame([(c, f"{c}/x_{k}.jpg") for c in "ab" for k in range(5)], "camera string, name string")
    found = rig.auto_frame_key(names)
    assert "AS word" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.combo, r.shared) for r in found.collect()] == [([0], 5)]


def test_views_of_a_large_block_are_numbered_in_buckets(spark, monkeypatch):
    from reconspark.operators import frames

    monkeypatch.setattr(frames, "BUCKET", 20)
    rows = [(b, i, t) for b in range(3) for i in range(40) for t in range(b + 1)] + [(3, 7, None)]
    tiles = spark.createDataFrame(random.Random(3).sample(rows, len(rows)), "block long, image_id long, tile long")
    found = spatial.number_views(tiles)
    assert "_bucket" in found._jdf.queryExecution().analyzed().toString()
    assert {(r.block, r.image_id, r.tile): r.view_id for r in found.collect()} == {row: 40 + k for k, row in enumerate(sorted(rows[:-1]))} | {(3, 7, None): 7}
