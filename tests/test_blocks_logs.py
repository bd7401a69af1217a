"""Views and tracks of blocks, logs followed by bytes, current stages, projections, noise-relative scale checks, small rules."""

import io
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reconspark.functions import geometry as g
from reconspark.operators import listings, logs, models, rig, spatial, stats
from reconspark.sources import byte_log


def test_views_are_numbered_without_gaps_and_tracks_lead_back(spark):
    rng = random.Random(1)
    obs = [(image, point, block, None if block == 2 else rng.randint(0, 2), rng.random() * 90, rng.random() * 50) for image in range(20) for point in range(30) if rng.random() < 0.4 for block in range(3) if (point + block) % 4]
    d = spark.createDataFrame(obs, "image_id long, point_id long, block int, tile int, x double, y double").withColumns({"ox": F.coalesce(F.col("tile") * 30.0, F.lit(0.0)), "oy": F.lit(0.0)})
    views = spatial.number_views(d.select("block", "image_id", "tile").distinct()).cache()
    tiled = sorted((v.view_id, v.block, v.image_id, v.tile) for v in views.where("tile IS NOT NULL").collect())
    assert [v[0] for v in tiled] == list(range(20, 20 + len(tiled))) and [v[1:] for v in tiled] == sorted(v[1:] for v in tiled)
    assert all(v.view_id == v.image_id for v in views.where("tile IS NULL").collect())
    emitted = spatial.emit_views(d, views).collect()
    at = {(e.block, e.view_id, e.idx): e for e in emitted}
    assert len(at) == len(emitted) == len(obs)
    for block, view in {(e.block, e.view_id) for e in emitted}:
        own = sorted(e.idx for e in emitted if (e.block, e.view_id) == (block, view))
        assert own == list(range(len(own)))
    members = spark.createDataFrame([(b, p) for b in range(3) for p in range(31)], "block int, point_id long")
    told = {(t.block, t.point_id): [(v.view_id, v.idx) for v in t.track] for t in spatial.tracks(spatial.emit_views(d, views), members).collect()}
    assert len(told) == 93 and told[(0, 30)] == []
    # Every observation is found from its point's track, and every entry of a track is an observation of that point.
    assert all((e.view_id, e.idx) in told[(e.block, e.point_id)] for e in emitted)
    assert all(at[(b, v, k)].point_id == p for (b, p), track in told.items() for v, k in track) and sum(map(len, told.values())) == len(emitted)


def test_manifest_names_skipped_blocks_and_blocks_of_images(spark):
    v = spark.createDataFrame([(1, 0, 10, 20), (1, 1, 10, 20), (2, 0, 10, 20), (2, 0, 5, 4)], "image_id int, block int, w int, h int")
    small = spark.createDataFrame([(7, 2)], "block int, n_images int")
    found = {r.block: r for r in spatial.block_manifest(v, spark.createDataFrame([(0,), (0,)], "block int"), small).collect()}
    assert (found[0].n_images, found[0].n_views, found[0].pixels, found[0].n_points, found[0].skipped) == (2, 3, 420, 2, False)
    assert (found[7].n_images, found[7].n_views, found[7].skipped) == (2, 0, True)
    assert {r.image_id: r.blocks for r in spatial.image_blocks(v).collect()} == {1: [0, 1], 2: [0]}


@pytest.mark.parametrize("chunk", [1, 7, 64, 10_000])
def test_chunks_of_a_log_give_each_whole_line_once(chunk, monkeypatch):
    monkeypatch.setattr(byte_log, "STEP", 5)
    data = "first\n\nthird line äö\r\n" + "x" * 90 + "\nlast\nhalf".encode().decode()
    raw = data.encode()
    end = byte_log.whole_lines(io.BytesIO(raw), len(raw))
    assert raw[:end].endswith(b"last\n")
    found = [(at, line) for s in range(0, end, chunk) for at, line in byte_log.lines_between(io.BytesIO(raw), s, min(s + chunk, end), end)]
    assert [line for _, line in found] == raw[:end].split(b"\n")[:-1]
    assert all(raw[at : at + len(line)] == line for at, line in found)


def test_a_growing_log_is_followed_by_bytes(spark, tmp_path):
    folder, out, state = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "state")
    (folder / "job").mkdir(parents=True)
    log = folder / "job" / "console.log"
    log.write_text("".join(f"line {k}\n" for k in range(100)) + "not yet")

    def run():
        s = byte_log.follow(spark, str(folder), tail_bytes=21, chunk_bytes=16)
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.file, r.position, r.line) for r in spark.read.parquet(out).collect())

    first = run()
    assert [line for _, _, line in first] == ["line 98", "line 99"]  # the line that runs over the start is not one of them
    with log.open("a") as file:
        file.write(" but now\nline 101\nopen")
    (folder / "new.log").write_text("all of it\nfrom the start\n")
    second = run()
    assert [x for x in second if x not in first] == sorted([("job/console.log", log.read_text().index("not"), "not yet but now"), ("job/console.log", log.read_text().index("line 101"), "line 101"), ("new.log", 0, "all of it"), ("new.log", 10, "from the start")])
    with log.open("a") as file:
        file.write("ed\n")
    assert len(run()) == len(second) + 1 and len(run()) == len(second) + 1


def test_current_stage_is_that_of_the_last_line_that_names_one(spark):
    told = {
        "frames": ["Found 3 video files", "######## [1/3] a", "######## [2/3] b", "-> 4 kept / 1 dropped"],
        "train": ["Loading train cameras: 3/245 [", "Training progress: 10/30000 [00:01", "[ITER 20] loss", "Training complete!", "bye"],
        "mesh": ["Extracting mesh from TSDF", "=== [12:00:00] mesh done. x"],
        "gcs": ["Building synchronization state..."],
        "depth": ["Images: 4 under /d", "[1/4] a.jpg"],
        "matte": ["Images: 4 under /d", "Done. processed=4 skipped=0"],
    }
    found = {}
    for kind, lines in told.items():
        d = spark.createDataFrame([("j", k, line) for k, line in enumerate(lines)], "job_id string, seq long, line string").repartition(3)
        found[kind] = logs.current_stage(d, kind, ["job_id"]).first().current_stage
    assert found == {"frames": "video 2/3", "train": "done", "mesh": "done", "gcs": None, "depth": "depth", "matte": "done"}


def test_residuals_of_projected_points_are_none(spark):
    rng = np.random.default_rng(2)
    world = rng.uniform(-1, 1, (40, 3)) + [0, 0, 6]
    cameras = [(1, "PINHOLE", [700.0, 690.0, 320.0, 240.0]), (2, "SIMPLE_RADIAL", [700.0, 320.0, 240.0, 0.1]), (3, "RADIAL", [700.0, 320.0, 240.0, 0.1, -0.02]), (4, "PINHOLE", [700.0, 690.0, 320.0, 240.0])]
    images, obs = [], []
    for camera, model, p in cameras:
        a = 0.1 * camera
        q, t = (math.cos(a), 0.0, math.sin(a), 0.0), (0.1 * camera, -0.2, -20.0 if camera == 4 else 0.3)
        r = np.array([[1 - 2 * q[2] ** 2, 0, 2 * q[0] * q[2]], [0, 1, 0], [-2 * q[0] * q[2], 0, 1 - 2 * q[2] ** 2]])
        c = world @ r.T + t
        u = c[:, :2] / c[:, 2:]
        s = (u**2).sum(1, keepdims=True)
        bend = 1 + (p[3] * s if model != "PINHOLE" else 0) + (p[4] * s * s if model == "RADIAL" else 0)
        uv = u * bend * ([p[0], p[1]] if model == "PINHOLE" else [p[0], p[0]]) + ([p[2], p[3]] if model == "PINHOLE" else [p[1], p[2]])
        images.append((camera * 10, camera, *q, *map(float, t)))
        obs += [(camera * 10, k, float(x), float(y) + 3.0 * (k == 0)) for k, (x, y) in enumerate(uv)]
    tables = [
        spark.createDataFrame(obs, "image_id int, point_id int, x double, y double"), spark.createDataFrame(images, "image_id int, camera_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double"),
        spark.createDataFrame(cameras, "camera_id int, model string, params array<double>"), spark.createDataFrame([(k, *map(float, w)) for k, w in enumerate(world)], "point_id int, x double, y double, z double"),
    ]
    found = models.reprojection(*tables)
    for r in found.collect():
        assert r.residual is None if r.image_id == 40 else abs(r.residual - 3.0 * (r.point_id == 0)) < 1e-9
    report = {r.camera_id: r for r in models.sensor_report(found, tables[1], tables[3]).collect()}
    assert report[1].median_residual < 1e-9 and report[4].median_residual is None and report[4].n_obs == 40


def network(scale=1.0, noise=0.0, bias=0.0, lift=10.0, bend=0.0):
    """Ten by ten cameras 100 m apart; knobs: scale, noise of the survey, offset between folders, height, bending with distance."""
    rng = random.Random(6)
    rows = []
    for i in range(10):
        for j in range(10):
            x, y, z = 100.0 * i, 100.0 * j, lift * math.sin(i + j)
            off = bias if (i + j) % 2 else 0.0
            rows.append((i * 10 + j, "fwd" if (i + j) % 2 else "bwd", scale * x * (1 + bend * x / 900), scale * y, scale * z, x + off + rng.gauss(0, noise), y + rng.gauss(0, noise), z + rng.gauss(0, noise)))
    return rows


NETWORK = "image_id long, folder string, sx double, sy double, sz double, dx double, dy double, dz double"


def test_scale_checks_count_only_what_noise_does_not_explain(spark):
    check = lambda **k: stats.scale_check(spark.createDataFrame(network(**k), NETWORK)).first()
    right = check()
    assert abs(right.corrected_pct) < 1e-9 and right.drift_pct < 1e-9 and right.sensitivity_pct == 0.05 and right.vertical_usable and not right.warns
    assert abs(check(scale=1.002).err_pct - 0.2) < 1e-6
    noisy = check(scale=1.002, noise=3.0)
    # Noise makes distances longer, the ratio smaller: corrected by what a perfect model shows.
    assert noisy.noise_bias_pct < 0 and abs(noisy.corrected_pct - 0.2) < abs(noisy.err_pct - 0.2) + noisy.sensitivity_pct and noisy.sensitivity_pct > 0.05
    assert noisy.drift_pct < 0.5
    flights = check(bias=2.0)
    assert abs(flights.folder_bias_m - 2.0) < 0.05 and flights.sensitivity_pct > 0.1
    assert check(bend=0.2).drift_pct > 1.0
    flat = check(lift=0.1, noise=2.0)
    assert not flat.vertical_usable and flat.dims == 2 and "horizontal" in flat.note
    assert check(scale=1.2).warns
    assert stats.scale_check(spark.createDataFrame(network()[:5], NETWORK)).count() == 0
    cal = stats.noise_calibrate(spark.createDataFrame(network(), NETWORK), {"x": 2.0, "y": 2.0, "z": 2.0}, gate=(135.0, 1200.0)).first()
    assert cal.trials == 5 and cal.spread_pct >= 0 and min(cal.noise_bin0, cal.noise_bin1, cal.noise_bin2) > 0.9


def test_spellings_of_coordinate_systems():
    assert [g.resolve_crs(n) for n in ("EPSG:3826", " twd97 ", "TWD97-TM2-119", "Local", "xyz", "none", "cartesian")] == ["twd97_tm2_121", "twd97_tm2_121", "twd97_tm2_119", "cartesian", "cartesian", "cartesian", "cartesian"]
    for wrong in ("", None, "wgs84"):
        with pytest.raises(ValueError):
            g.resolve_crs(wrong)
    with pytest.raises(ValueError):
        g.tm_to_wgs84("e", "n", "local")


def test_rescaled_cameras(spark):
    d = spark.createDataFrame([("EQUIRECTANGULAR", [4000.0, 2000.0], 2000, 1000), ("SIMPLE_RADIAL", [100.0, 50.0, 40.0, 0.1], 2000, 1010), ("PINHOLE", [100.0, 110.0, 50.0, 40.0], 2000, 1000)], "m string, p array<double>, w int, h int")
    out = g.rescale_camera("m", "p", F.lit(4000), F.lit(2000), "w", "h")
    found = {r.m: r for r in d.select("m", *[v.alias(k) for k, v in out.items()]).collect()}
    assert found["EQUIRECTANGULAR"].params == [2000.0, 1000.0] and not found["EQUIRECTANGULAR"].warns
    assert found["PINHOLE"].params == [50.0, 55.0, 25.0, 20.0]
    single = found["SIMPLE_RADIAL"]
    assert np.allclose(single.params, [100 * (0.5 + 0.505) / 2, 25.0, 20.2, 0.1]) and single.warns and math.isclose(single.residual_px, 2000 * abs(0.5 / 0.505 - 1))


def test_priors_of_two_coordinate_systems_are_refused(spark):
    images = spark.createDataFrame([(k,) for k in range(4)], "image_id int")
    prior = lambda ids, crs: spark.createDataFrame([(k, 1.0, crs) for k in ids], "image_id int, px double, crs string")
    merged, without = models.merge_priors([(prior([0, 1], "wgs84"), 2), (prior([1, 2], "wgs84"), 1)], images)
    assert sorted(r.image_id for r in merged.collect()) == [0, 1, 2] and [r.image_id for r in without.collect()] == [3]
    with pytest.raises(Exception, match="several coordinate systems"):
        models.merge_priors([(prior([0], "wgs84"), 2), (prior([1], "cartesian"), 1)], images)[0].collect()


def test_counts_of_cameras_and_outputs(spark):
    r = spark.createDataFrame([("A", "1", "A/1.jpg"), ("A", "2", "A/2.jpg"), ("B", "1", "B/1.jpg")], "camera string, frame_key string, name string")
    assert {(x.camera, x.n_images, x.n_frames) for x in rig.rig_cameras(r).collect()} == {("A", 2, 2), ("B", 1, 1)}
    o = spark.createDataFrame([(f"k{k}", k % 3) for k in range(9)], "key string, mtime int")
    assert [(x.key, x.total) for x in listings.newest(o, 2).orderBy(F.desc("mtime"), "key").collect()] == [("k2", 9), ("k5", 9)]


def test_a_repeated_key_stands_in_the_sync_plan_as_often_as_in_its_sql(spark, tmp_path):
    import duckdb

    from reconspark.plans import queries as q

    pages = [(n, f"http://a/{n % 9}" if n % 11 else None, "x" * (n % 4)) for n in range(1, 60)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    wanted = duckdb.sql(q.oracle_sql()["j18_sync_plan"].replace("FROM pages", f"FROM '{tmp_path}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, q.queries()["j18_sync_plan"](spark, str(tmp_path)).select("key", "action").collect())) == sorted(wanted)
