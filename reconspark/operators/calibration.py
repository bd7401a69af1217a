"""Calibrations, lever arms and upright orientation: small tables per capture, joined over a fleet of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.functions.geometry import f_cx_cy
from reconspark.operators.stats import diameter, plane_fit

#: Metres in a unit of a certificate.
UNIT_M = {"mm": 1e-3, "cm": 1e-2, "m": 1.0}


def match_calibration(cameras: DataFrame, calibrations: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Each camera with the calibration of its name, whatever the case; else the first (by ``nth``) where one name holds the
    other; null if there is none.  Both sides are a handful of rows per key, and the key bounds the pairs."""
    cam = cameras.select(*keys, "camera", F.lower(F.trim("camera")).alias("_k"))
    cal = calibrations.select(*keys, "name", "nth", F.lower(F.trim("name")).alias("_n"))
    on = F.col("_n").contains(F.col("_k")) | F.col("_k").contains(F.col("_n"))
    pairs = cam.join(cal, list(keys)).where(on) if keys else cam.join(cal, on)
    best = pairs.groupBy(*keys, "camera").agg(F.min_by("name", F.struct(F.col("_n") != F.col("_k"), F.col("nth"))).alias("calibration"))
    return cameras.select(*keys, "camera").join(best, [*keys, "camera"], "left")


def intrinsics_report(solved: DataFrame, certified: DataFrame, keys: list[str]) -> DataFrame:
    """Solved minus certified focal length and principal point; both have model and params."""
    own = lambda df, p: df.select(*keys, *[v.alias(f"{p}{n}") for v, n in zip(f_cx_cy("model", "params"), ("f", "cx", "cy"))])
    j = own(solved, "s_").join(own(certified, "c_"), keys)
    return j.select(*keys, *[(F.col(f"s_{n}") - F.col(f"c_{n}")).alias(f"d_{n}") for n in ("f", "cx", "cy")], (100 * (F.col("s_f") / F.col("c_f") - 1)).alias("d_f_pct"))


def lever_arms(nodal: DataFrame, reference: str, keys: list[str] = (), axes: dict[str, str] | None = None, units: str = "mm") -> DataFrame:
    """Nodal points (sensor, front, right, down) as offsets from the reference sensor in its camera axes, in metres.

    ``axes`` names the signed camera axis of each body axis."""
    axes = axes or {"front": "-Y", "right": "+X", "down": "+Z"}
    base = nodal.where(F.col("sensor") == reference).select(*keys, *[F.col(a).alias(f"_{a}") for a in axes])
    j = nodal.join(base, list(keys)) if keys else nodal.crossJoin(F.broadcast(base))  # one row
    out = {"X": F.lit(0.0), "Y": F.lit(0.0), "Z": F.lit(0.0)}
    for body, spec in axes.items():
        sign, axis = (-1 if spec.strip()[0] == "-" else 1), spec.strip()[-1].upper()
        out[axis] = out[axis] + sign * UNIT_M[units] * (F.col(body) - F.col(f"_{body}"))
    return j.select(*keys, "sensor", *[out[a].alias(a.lower()) for a in "XYZ"])


def check_lever_arms(solved: DataFrame, certified: DataFrame, keys: list[str] = (), limit_m: float = 0.5) -> DataFrame:
    """Distance of each solved sensor centre from the certificate's; above the limit it fails."""
    on = [*keys, "sensor"]
    j = solved.select(*on, *[F.col(v).alias(f"s{v}") for v in "xyz"]).join(certified.select(*on, "x", "y", "z"), on)
    d = [F.col(f"s{v}") - F.col(v) for v in "xyz"]
    return j.select(*on, F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]).alias("delta_m")).withColumn("fails", F.col("delta_m") > limit_m)


def upright_frame(centers: DataFrame, obs: DataFrame, points: DataFrame, keys: list[str], target: float = 20.0) -> DataFrame:
    """Scale and basis [right, -up, forward] per key that stand a model upright.

    up is the normal of the plane through the camera centres, right the direction of the farthest pair of them made
    square to it, forward their product.  The scale brings the median distance of cameras to the points they see to
    ``target``.  A basis and its mirror (right reversed) are equally good; the pair with the larger first id leads.
    """
    seen = obs.where("point_id >= 0").select(*keys, "image_id", "point_id").join(centers.select(*keys, "image_id", "x", "y", "z"), [*keys, "image_id"]).join(points.select(*keys, "point_id", *[F.col(v).alias(f"p{v}") for v in "xyz"]), [*keys, "point_id"])
    gap = [F.col(v) - F.col(f"p{v}") for v in "xyz"]
    scale = seen.groupBy(*keys).agg((target / F.median(F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]))).alias("scale"))
    far = diameter(centers, keys, ends=True)
    j = plane_fit(centers, keys).join(far, keys).join(scale, keys)
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]

    def unit(v):
        n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        return [c / n for c in v]

    up = [F.col("nx"), F.col("ny"), F.col("nz")]
    forward = unit(cross(up, [F.col("dx"), F.col("dy"), F.col("dz")]))
    right = unit(cross(forward, up))
    return j.select(*keys, "scale", *[v.alias(f"{n}{a}") for n, vec in (("right_", right), ("down_", [-u for u in up]), ("forward_", forward)) for a, v in zip("xyz", vec)])
