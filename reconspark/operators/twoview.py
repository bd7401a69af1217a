"""Two-view geometry of matched images, as columns: relative poses, essential matrices and Sampson errors in pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconspark.functions.geometry import c, rotation
from reconspark.operators.stats import pair_images, sampson

POSE = ("qw", "qx", "qy", "qz", "tx", "ty", "tz")
#: Steps of the fixed point that takes radial distortion off a point.
UNDISTORT = 12


def relative_pose(turn_a, move_a, turn_b, move_b) -> tuple[list[list[Column]], list[Column]]:
    """Rotation and translation from camera a to camera b, of their poses from world to camera."""
    turn = [[sum((turn_b[i][k] * turn_a[j][k] for k in (1, 2)), turn_b[i][0] * turn_a[j][0]) for j in range(3)] for i in range(3)]
    return turn, [move_b[i] - (turn[i][0] * move_a[0] + turn[i][1] * move_a[1] + turn[i][2] * move_a[2]) for i in range(3)]


def essential(turn, move) -> list[list[Column]]:
    """[t]x R: x_b' E x_a = 0 for the two views of one point."""
    t0, t1, t2 = move
    return [[t1 * turn[2][j] - t2 * turn[1][j] for j in range(3)], [t2 * turn[0][j] - t0 * turn[2][j] for j in range(3)], [t0 * turn[1][j] - t1 * turn[0][j] for j in range(3)]]


def normalised(x, y, fx, fy, cx, cy, k=None) -> tuple[Column, Column]:
    """Pixels to the plane at depth 1: pinhole, or one radial factor ``k`` undone by a fixed point over the radius."""
    u, v = (c(x) - c(cx)) / c(fx), (c(y) - c(cy)) / c(fy)
    if k is None:
        return u, v
    seen = F.hypot(u, v)
    r = seen
    for _ in range(UNDISTORT):
        r = seen / (1 + c(k) * F.pow(r, F.lit(2.0)))
    share = F.when(seen > 0, r / seen).otherwise(F.lit(1.0))
    return u * share, v * share


def epipolar_errors(matches: DataFrame, keypoints: DataFrame, images: DataFrame, min_matches: int = 50, max_pairs: int = 50) -> DataFrame:
    """(sensor_a, sensor_b, pair_id, px) of each match: Sampson error times the first camera's focal length.

    ``matches(pair_id, matches array<struct<a, b>>)`` has keypoint numbers in both images of a pair id; ``keypoints(image_id, idx, x, y)``;
    ``images(image_id, sensor, frame_key, fx, fy, cx, cy, k, qw ... tz)`` the registered ones, ``frame_key`` null where frames
    are unknown.  Pairs with over ``min_matches`` matches whose images are registered and of different frames take part, of each pair of
    sensors (in order of name) the first ``max_pairs`` by pair id: a property of the check, and chosen before any keypoint is read.
    """
    ids = pair_images("pair_id")
    wide = matches.where(F.size("matches") > min_matches).select("pair_id", "matches", ids[0].alias("image_a"), ids[1].alias("image_b"))
    r = rotation(*POSE[:4])
    view = F.struct("sensor", "frame_key", "fx", "fy", "cx", "cy", "k", *[r[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)], *[F.col(v).alias(f"t{i}") for i, v in enumerate(POSE[4:])])
    side = lambda s: images.select(F.col("image_id").alias(f"image_{s}"), view.alias(s))
    # Poses first: which pairs count is decided on narrow rows, arrays of matches come along for those alone.
    both = wide.select("pair_id", "image_a", "image_b").join(side("a"), "image_a").join(side("b"), "image_b")
    both = both.where(~F.coalesce(F.col("a.frame_key") == F.col("b.frame_key"), F.lit(False)))
    both = both.withColumns({"sensor_a": F.least("a.sensor", "b.sensor"), "sensor_b": F.greatest("a.sensor", "b.sensor")})
    few = both.withColumn("nth", F.row_number().over(Window.partitionBy("sensor_a", "sensor_b").orderBy("pair_id"))).where(F.col("nth") <= max_pairs).drop("nth")
    own = lambda s: ([[F.col(f"{s}.r{i}{j}") for j in range(3)] for i in range(3)], [F.col(f"{s}.t{i}") for i in range(3)])
    turn, move = relative_pose(*own("a"), *own("b"))
    moved = few.withColumns({f"m{i}{j}": turn[i][j] for i in range(3) for j in range(3)} | {f"t{i}": move[i] for i in range(3)})
    e = essential([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)], [F.col(f"t{i}") for i in range(3)])
    posed = moved.select("pair_id", "image_a", "image_b", "sensor_a", "sensor_b", F.struct(*[F.col(f"{s}.{v}").alias(f"{v}_{s}") for s in "ab" for v in ("fx", "fy", "cx", "cy", "k")]).alias("lens"), *[e[i][j].alias(f"e{i}{j}") for i in range(3) for j in range(3)])
    each = posed.join(wide.select("pair_id", F.explode("matches").alias("m")), "pair_id").withColumns({"idx_a": F.col("m.a"), "idx_b": F.col("m.b")}).drop("m")
    for s in "ab":
        each = each.join(keypoints.select(F.col("image_id").alias(f"image_{s}"), F.col("idx").alias(f"idx_{s}"), F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}")), [f"image_{s}", f"idx_{s}"])
    at = {s: normalised(f"x_{s}", f"y_{s}", *[F.col(f"lens.{v}_{s}") for v in ("fx", "fy", "cx", "cy", "k")]) for s in "ab"}
    plane = each.select("sensor_a", "sensor_b", "pair_id", F.col("lens.fx_a").alias("focal"), *[v.alias(f"{n}{s}") for s in "ab" for n, v in zip("uv", at[s])], *[f"e{i}{j}" for i in range(3) for j in range(3)])
    matrix = [[F.col(f"e{i}{j}") for j in range(3)] for i in range(3)]
    return plane.select("sensor_a", "sensor_b", "pair_id", (sampson("ua", "va", "ub", "vb", matrix) * F.col("focal")).alias("px"))
