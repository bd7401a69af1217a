"""Analytics of reconstructed models: cameras, images, points and their observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconspark.functions.geometry import base_name, c, camera_center, drop_predicate, first_folder, in_rect_closed, project_point
from reconspark.operators.hull import hull_angles
from reconspark.operators.selection import median


def valid_observations(obs: DataFrame, points: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Observations of a registered point that exists; points are as many as the scene has, so they aren't broadcast on the size of their file."""
    return obs.where("point_id IS NOT NULL AND point_id >= 0").join(points.select(*keys, "point_id").distinct().hint("merge"), [*keys, "point_id"], "left_semi")


def track_lengths(obs: DataFrame, keys: list[str] = ()) -> DataFrame:
    return obs.where("point_id >= 0").groupBy(*keys, "point_id").agg(F.count("*").alias("track"))


def points_stats(points: DataFrame, obs: DataFrame, keys: list[str] = ()) -> DataFrame:
    """n, mean error, mean track length; 0 if there are none."""
    joined = points.join(track_lengths(obs, keys), [*keys, "point_id"], "left")
    return joined.groupBy(*keys).agg(F.count("*").alias("n_points"), F.coalesce(F.avg("error"), F.lit(0.0)).alias("mean_error"), F.coalesce(F.avg(F.coalesce("track", F.lit(0))), F.lit(0.0)).alias("mean_track"))


def scene_summary(cameras: DataFrame, images: DataFrame, points: DataFrame) -> DataFrame:
    """Counts and mean reprojection error in pixels: an error under 0.1 is in units of the focal length and is multiplied by its mean."""
    focal = cameras.agg(F.count("*").alias("n_cameras"), F.avg(F.col("params")[0]).alias("focal"))
    n = images.agg(F.count("*").alias("n_images"))
    p = points.agg(F.count("*").alias("n_points"), F.coalesce(F.avg("error"), F.lit(0.0)).alias("e"))
    return focal.crossJoin(n).crossJoin(p).select("n_cameras", "n_images", "n_points", F.bround(F.when(F.col("e") < 0.1, F.col("e") * F.col("focal")).otherwise(F.col("e")), 2).alias("mean_reproj"))  # one row each


def region_stats(centers: DataFrame, points: DataFrame, region, axes=("x", "y"), track_min: int = 5) -> DataFrame:
    """Cameras and points inside a closed rectangle; mean track and share of tracks from track_min on among the points inside."""
    inside = in_rect_closed(*axes, region)
    cams = centers.agg(F.count_if(inside).alias("cams_in"), F.count("*").alias("cams_total"))
    rest = ({"x", "y", "z"} - set(axes)).pop()
    pts = points.agg(
        F.count_if(inside).alias("points_in"), F.count("*").alias("points_total"),
        F.coalesce(F.avg(F.when(inside, F.col("track"))), F.lit(0.0)).alias("mean_track"),
        F.coalesce(F.avg(F.when(inside, (F.col("track") >= track_min).cast("double"))), F.lit(0.0)).alias("share_long"),
        F.min(F.when(inside, F.col(rest))).alias("low"), F.max(F.when(inside, F.col(rest))).alias("high"),
    )
    return cams.crossJoin(pts)  # one row each


def up_axis(centers: DataFrame, keys: list[str] = ()) -> DataFrame:
    """The axis along which the camera centres vary least, the first on a tie; null under 3 images.  horiz: the other two."""
    ranges = F.array(*[F.max(a) - F.min(a) for a in ("x", "y", "z")])
    found = centers.groupBy(*keys).agg(F.count("*").alias("n"), ranges.alias("r"))
    up = F.when(F.col("n") >= 3, (F.array_position("r", F.array_min("r")) - 1).cast("int"))
    return found.withColumn("up", up).withColumn("horiz", F.filter(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda a: a != F.col("up"))).drop("r")


def image_detail(images: DataFrame, obs: DataFrame) -> DataFrame:
    """Number of features and of registered ones of every image."""
    counts = obs.groupBy("image_id").agg(F.count("*").alias("n_features"), F.count_if(F.col("point_id") >= 0).alias("n_registered"))
    return images.select("image_id").join(counts, "image_id", "left").na.fill(0, ["n_features", "n_registered"])


def coverage_report(listed: DataFrame, registered: DataFrame, name: str = "name", weak_below: float = 0.5) -> DataFrame:
    """Registered of listed images by first folder; weak under half."""
    per = lambda df, n: df.groupBy(first_folder(name).alias("folder")).agg(F.count("*").alias(n))
    joined = per(listed, "listed").join(per(registered, "registered"), "folder", "left").na.fill(0, ["registered"])
    return joined.withColumn("share", F.col("registered") / F.col("listed")).withColumn("weak", F.col("share") < weak_below)


def models_report(components: DataFrame) -> DataFrame:
    """Components with their share of all images, and whether each is the chosen one (see largest_model)."""
    total = components.agg(F.sum("n_images").alias("total"))
    best = largest_model(components, []).select(F.col("model").alias("chosen_model"))
    return components.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(best)).select("model", "n_images", "n_points", (F.col("n_images") / F.col("total")).alias("share"), (F.col("model") == F.col("chosen_model")).alias("chosen"))  # one-row tables


def largest_model(components: DataFrame, keys: list[str]) -> DataFrame:
    """Most images, then most points, then the lowest number; empty components are out."""
    return components.where("n_images > 0").groupBy(*keys).agg(F.max_by(F.struct("model", "n_images", "n_points"), F.struct(F.col("n_images"), F.col("n_points"), -F.col("model"))).alias("m")).select(*keys, "m.*")


def track_stats(obs: DataFrame) -> DataFrame:
    t = track_lengths(obs)
    return t.agg(F.avg("track").alias("mean"), F.median("track").alias("median"), F.avg((F.col("track") >= 3).cast("double")).alias("share3"), F.avg((F.col("track") >= 5).cast("double")).alias("share5"))


def covisibility(obs: DataFrame, images: DataFrame, sensor: str = "camera_id", ref=None) -> DataFrame:
    """How many points each sorted set of sensors sees; with_ref: the set holds the reference and another."""
    sets = obs.where("point_id >= 0").join(images.select("image_id", sensor), "image_id").groupBy("point_id").agg(F.array_sort(F.collect_set(sensor)).alias("sensors"))
    counted = sets.groupBy("sensors").agg(F.count("*").alias("n_points"))
    return counted.withColumn("with_ref", F.array_contains("sensors", ref) & (F.size("sensors") > 1)) if ref is not None else counted


def reprojection(obs: DataFrame, images: DataFrame, cameras: DataFrame, points: DataFrame) -> DataFrame:
    """``obs(image_id, point_id, x, y)`` of points and images that exist, with ``residual``: pixels from where the point projects; null behind the camera.

    ``images(image_id, camera_id, qw ... tz)``, ``cameras(camera_id, model, params)``, ``points(point_id, x, y, z)``."""
    q, t = ("qw", "qx", "qy", "qz"), ("tx", "ty", "tz")
    posed = images.select("image_id", "camera_id", *q, *t).join(cameras.select("camera_id", "model", "params"), "camera_id").drop("camera_id")
    j = obs.join(points.select("point_id", *[F.col(v).alias(f"_{v}") for v in "xyz"]), "point_id").join(posed, "image_id")
    u, v = project_point(("_x", "_y", "_z"), q, t, "model", "params")
    return j.select(*obs.columns, F.hypot(u - F.col("x"), v - F.col("y")).alias("residual"))


def sensor_report(obs: DataFrame, images: DataFrame, points: DataFrame, sensor: str = "camera_id") -> DataFrame:
    """Per sensor: images, observations, observations an image, median residual; a sensor without observations fails.

    ``obs`` carries the residual in pixels as ``residual``, as ``reprojection`` makes it."""
    seen = valid_observations(obs, points).join(images.select("image_id", sensor), "image_id").groupBy(sensor).agg(F.count("*").alias("n_obs"), F.median("residual").alias("median_residual"))
    have = images.groupBy(sensor).agg(F.count("*").alias("n_images"))
    return have.join(seen, sensor, "left").na.fill(0, ["n_obs"]).withColumn("obs_per_image", F.col("n_obs") / F.col("n_images")).withColumn("fails", F.col("n_obs") == 0)


def camera_folders(images: DataFrame, camera: str = "camera_id", folder: str = "folder") -> DataFrame:
    """A camera's only folder; cameras of several folders are dropped."""
    return images.groupBy(camera).agg(F.min(folder).alias("folder"), F.max(folder).alias("other")).where("folder = other").drop("other")


def drop_images(images: DataFrame, obs: DataFrame, points: DataFrame, cameras=(), parts=(), min_track: int = 2) -> dict[str, DataFrame]:
    """The cascade of removing images: their observations go, points left with under two go, observations of those lose
    their point, cameras without images go.  Returns images, observations, points and cameras that stay."""
    doomed = images.where(drop_predicate("camera_id", "name", cameras, parts)).select("image_id")
    kept_images = images.join(doomed, "image_id", "left_anti")
    kept_obs = obs.join(doomed, "image_id", "left_anti")
    lasting = kept_obs.where("point_id >= 0").groupBy("point_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_track).select("point_id", F.lit(True).alias("lasts"))
    kept_points = points.join(lasting, "point_id", "left_semi")
    kept_obs = kept_obs.join(lasting, "point_id", "left").withColumn("point_id", F.when(F.col("lasts"), F.col("point_id"))).drop("lasts")
    return {"images": kept_images, "observations": kept_obs, "points": kept_points, "cameras": kept_images.select("camera_id").distinct()}


#: Narrow tracks of more rays than this are decided by the hull of their rays, shorter ones by their pairs.
PAIRED = 64


def tangent_plane(rays: DataFrame, at: str = "f") -> DataFrame:
    """``rays(u, v, w, f)`` with x and y: where the ray (u, v, w) meets the plane that touches the unit sphere at f(u, v, w)."""
    f = [F.col(f"{at}.{n}") for n in "uvw"]
    ray = [F.col(n) for n in "uvw"]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    upright = F.abs(f[2]) < 0.9
    side = cross(f, [F.when(upright, 0.0).otherwise(1.0), F.lit(0.0), F.when(upright, 1.0).otherwise(0.0)])
    out = rays.withColumn("_side", F.array(*side)).withColumn("_norm", F.sqrt(dot(side, side)))
    e1 = [F.col("_side")[k] / F.col("_norm") for k in range(3)]
    return out.withColumn("x", dot(ray, e1) / dot(ray, f)).withColumn("y", dot(ray, cross(f, e1)) / dot(ray, f)).drop("_side", "_norm")


def supported_points(images: DataFrame, obs: DataFrame, points: DataFrame, max_error: float = 4.0, min_track: int = 2, min_angle: float = 1.5) -> DataFrame:
    """Points whose track, error and largest triangulation angle are at the limits or better.  ``images`` carries centres cx, cy, cz.

    A ray at the limit from the track's first ray settles the point; only tracks whose rays all lie within the limit of it, and
    reach half of it, need more: their pairs, or with over PAIRED rays the hull of where they meet the first ray's tangent plane, so no track is
    paired with itself at length.  ``min_angle`` is at most 80 degrees.
    """
    if min_angle > 80:
        raise ValueError("min_angle is at most 80 degrees")
    rays = obs.where("point_id >= 0").join(images.select("image_id", "cx", "cy", "cz"), "image_id").join(points.where(F.col("error") <= max_error).select("point_id", "x", "y", "z"), "point_id")
    d = [F.col("cx") - F.col("x"), F.col("cy") - F.col("y"), F.col("cz") - F.col("z")]
    norm = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    unit = rays.select("point_id", "image_id", *[(v / norm).alias(n) for v, n in zip(d, "uvw")])
    angle = lambda dot: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    first = unit.groupBy("point_id").agg(F.count("*").alias("n"), F.min_by(F.struct("u", "v", "w"), "image_id").alias("f")).where(F.col("n") >= min_track)
    spread = unit.join(first, "point_id").groupBy("point_id").agg(F.first("n").alias("n"), F.first("f").alias("f"), F.max(angle(F.col("u") * F.col("f.u") + F.col("v") * F.col("f.v") + F.col("w") * F.col("f.w"))).alias("far"))
    sure = spread.where(F.col("far") >= min_angle).select("point_id")
    # Two rays are at most twice as far apart as the farther one is from the first; the slack covers rounding.
    narrow = unit.join(spread.where((F.col("far") < min_angle) & (2 * F.col("far") >= min_angle * (1 - 1e-6))).select("point_id", "n", "f"), "point_id")
    open_ = narrow.where(F.col("n") <= PAIRED)
    a, b = open_.alias("a"), open_.alias("b")
    pairs = a.join(b, (F.col("a.point_id") == F.col("b.point_id")) & (F.col("a.image_id") < F.col("b.image_id")))
    dot = sum((F.col(f"a.{n}") * F.col(f"b.{n}") for n in "vw"), F.col("a.u") * F.col("b.u"))
    wide = pairs.groupBy(F.col("a.point_id").alias("point_id")).agg(F.max(angle(dot)).alias("most")).where(F.col("most") >= min_angle).select("point_id")
    long_wide = hull_angles(tangent_plane(narrow.where(F.col("n") > PAIRED)), ["point_id"]).where(F.col("angle") >= min_angle).select("point_id")
    return points.join(sure.unionByName(wide).unionByName(long_wide), "point_id", "left_semi")


def cull_cameras(images: DataFrame, obs: DataFrame, points: DataFrame, names: DataFrame, filter_points: bool = True, max_error: float = 4.0, min_track: int = 2, min_angle: float = 1.5) -> dict[str, DataFrame]:
    """The whole model without the named images: images, observations, points and cameras that stay.

    Observations of the named images go; so do points that nothing sees any more, and with ``filter_points`` those
    that what is left doesn't support (see supported_points).  Kept images' observations of lost points lose their point.
    """
    left = images.join(names.select("name").distinct(), "name", "left_anti")
    seen = obs.join(left.select("image_id"), "image_id", "left_semi")
    stay = supported_points(left, seen, points, max_error, min_track, min_angle) if filter_points else points.join(seen.where("point_id >= 0"), "point_id", "left_semi")
    lasting = stay.select("point_id", F.lit(True).alias("_lasts"))
    pruned = seen.join(lasting, "point_id", "left").withColumn("point_id", F.when(F.col("_lasts"), F.col("point_id"))).drop("_lasts")
    out = {"images": left, "observations": pruned, "points": stay}
    return out | ({"cameras": left.select("camera_id").distinct()} if "camera_id" in left.columns else {})


def cull_points(points: DataFrame, doomed: DataFrame) -> DataFrame:
    """Points whose float32 position is not among the doomed ones."""
    f = lambda df: [F.col(a).cast("float").alias(f"f{a}") for a in "xyz"]
    return points.select("*", *f(points)).join(doomed.select(*f(doomed)).distinct(), ["fx", "fy", "fz"], "left_anti").drop("fx", "fy", "fz")


def frame_delta(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """Largest centre difference, extent and number of the images that two models share; the models match when
    the difference is at most max(extent * 1e-4, 1e-6).  Nothing shared: infinite difference."""
    j = a.select(name, "x", "y", "z").alias("a").join(b.select(name, "x", "y", "z").alias("b"), name)
    delta = F.greatest(*[F.max(F.abs(F.col(f"a.{v}") - F.col(f"b.{v}"))) for v in "xyz"])
    size = F.greatest(*[F.max(f"a.{v}") - F.min(f"a.{v}") for v in "xyz"])
    out = j.agg(F.coalesce(delta, F.lit(float("inf"))).alias("delta"), F.coalesce(size, F.lit(0.0)).alias("size"), F.count("*").alias("shared"))
    return out.withColumn("match", F.col("delta") <= F.greatest(F.col("size") * 1e-4, F.lit(1e-6)))


def size_mismatch(cameras: DataFrame, images: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Images whose size is not their camera's, and images without a file, with ``problem`` (size or missing).

    ``uniform``: all files of the camera share one other size (a resize).  Sizes come from ``images`` or, by name, from
    ``files(name, width, height)``; an image without a width has no file.
    """
    own = images if files is None else images.drop("width", "height").join(files.select("name", "width", "height"), "name", "left")
    j = own.join(cameras.select("camera_id", F.col("width").alias("cam_w"), F.col("height").alias("cam_h")), "camera_id")
    size = F.when(F.col("width").isNotNull(), F.struct("width", "height"))
    sizes = j.groupBy("camera_id").agg(F.min(size).alias("lo"), F.max(size).alias("hi"))
    j = j.join(sizes, "camera_id").withColumn("problem", F.when(F.col("width").isNull(), "missing").when((F.col("width") != F.col("cam_w")) | (F.col("height") != F.col("cam_h")), "size"))
    return j.where("problem IS NOT NULL").withColumn("uniform", (F.col("problem") == "size") & (F.col("lo") == F.col("hi"))).drop("lo", "hi")


def merge_priors(priors: list[tuple[DataFrame, int]], images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The prior of highest priority of each image, and the images that have none.

    Priors with a column ``crs`` must agree in it: the first row of another coordinate system stops the query with an error."""
    every = None
    for df, priority in priors:
        own = df.withColumn("priority", F.lit(priority))
        every = own if every is None else every.unionByName(own, allowMissingColumns=True)
    if every is not None and "crs" in every.columns:
        systems = every.agg(F.min("crs").alias("_low"), F.max("crs").alias("_high"))  # one row
        mixed = F.concat(F.lit("priors of several coordinate systems: "), F.col("_low"), F.lit(", "), F.col("_high"))
        every = every.crossJoin(F.broadcast(systems)).withColumn("crs", F.when(F.col("_low") == F.col("_high"), F.col("crs")).when(F.col("_low").isNotNull(), F.raise_error(mixed).cast("string"))).drop("_low", "_high")
    rest = [k for k in every.columns if k not in ("image_id", "priority")]
    merged = every.groupBy("image_id").agg(F.max_by(F.struct(*rest), "priority").alias("p")).select("image_id", "p.*")
    return merged, images.join(merged, "image_id", "left_anti")


def prior_coverage(images: DataFrame, *priors: DataFrame) -> DataFrame:
    """Images with any prior of all; ``complete`` only at 100 percent."""
    covered = None
    for p in priors:
        own = p.select("image_id")
        covered = own if covered is None else covered.unionByName(own)
    j = images.select("image_id").join(covered.distinct().withColumn("has", F.lit(1)), "image_id", "left")
    return j.agg(F.count("has").alias("covered"), F.count("*").alias("total")).withColumn("complete", F.col("covered") == F.col("total"))


def centers(images: DataFrame) -> DataFrame:
    """Images with their centres x, y, z from qw..qz and tx..tz."""
    at = camera_center(("qw", "qx", "qy", "qz"), ("tx", "ty", "tz"))
    return images.select("*", *[v.alias(n) for v, n in zip(at, "xyz")])


def region_subset(listed: DataFrame, chosen: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Listed rows whose full name is chosen, else whose base name is; and the chosen ones that match nothing."""
    full = listed.join(chosen.select(F.col(name)).distinct(), name, "left_semi")
    rest = listed.join(chosen.select(F.col(name)).distinct(), name, "left_anti")
    by_base = rest.withColumn("base", base_name(name)).join(chosen.select(base_name(name).alias("base")).distinct(), "base", "left_semi").drop("base")
    kept = full.unionByName(by_base)
    missing = chosen.join(listed.select(name), name, "left_anti").withColumn("base", base_name(name)).join(listed.select(base_name(name).alias("base")).distinct(), "base", "left_anti").drop("base")
    return kept, missing


def left_without(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a without a partner in b: unmatched, orphans, missing selections."""
    return a.join(b.select(*on).distinct(), on, "left_anti")


def median_gsd(samples: DataFrame, focal: str = "focal_px") -> DataFrame:
    """Median over images of each image's median depth a focal pixel."""
    per = samples.where((F.col("depth") > 0) & (F.col(focal) > 0)).groupBy("image_id").agg((F.median("depth") / F.max(focal)).alias("gsd"))
    return median(per, "gsd", [], "median_gsd").select("median_gsd", F.col("n").alias("n_images"))


def auto_resolution(gsd: Column, spacing: Column, extent: Column) -> dict[str, Column]:
    """Resolution = GSD / 4, else point spacing, else extent / 512; truncation 4 of it; depth to twice the extent."""
    e = F.when(c(extent) > 0, c(extent)).otherwise(F.lit(1.0))
    r = F.coalesce(c(gsd) / 4, c(spacing), e / 512)
    return {"resolution": r, "truncation": 4 * r, "max_depth": 2 * e}
