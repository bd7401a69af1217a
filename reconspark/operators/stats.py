"""Statistical checks: scale, residuals, similarity fits, bases, triangulation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconspark.functions.geometry import c, enu_factors
from reconspark.operators.frames import kept, stride_sample


def to_enu(fixes: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Metres east, north, up about the mean fix of each key, at its height."""
    mean = fixes.groupBy(*keys).agg(F.avg("lat").alias("_la"), F.avg("lon").alias("_lo"), F.avg("alt").alias("_al"))
    j = fixes.join(mean, list(keys)) if keys else fixes.crossJoin(F.broadcast(mean))  # one row
    north, east = enu_factors("_la", "_al")
    return j.select("*", ((F.col("lon") - F.col("_lo")) * east).alias("e"), ((F.col("lat") - F.col("_la")) * north).alias("n"), (F.col("alt") - F.col("_al")).alias("u")).drop("_la", "_lo", "_al")


def _distance(side: str, axes: tuple[str, ...]) -> Column:
    d = [F.col(f"a.{side}{x}") - F.col(f"b.{side}{x}") for x in axes]
    return F.sqrt(sum((v * v for v in d[1:]), d[0] * d[0]))


#: Cameras of a model whose pairs are compared: a property of the estimate, as pairs grow with the square.
MOST_CAMERAS = 600


def scale_pairs(cams: DataFrame, axes: tuple[str, ...] = ("x", "y", "z"), order: str = "image_id", keys: list[str] = ()) -> DataFrame:
    """Distances of all camera pairs in the model (s*) and the survey (d*), of at most MOST_CAMERAS cameras of each key, evenly strided."""
    cams = stride_sample(cams, list(keys), [order], MOST_CAMERAS)
    cols = [*keys, order, *[f"s{a}" for a in axes], *[f"d{a}" for a in axes]]
    a, b = cams.select(*cols).alias("a"), cams.select(*cols).alias("b")
    on = F.col(f"a.{order}") < F.col(f"b.{order}")
    for k in keys:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], _distance("s", axes).alias("d_src"), _distance("d", axes).alias("d_dst"))


def scale_estimate(pairs: DataFrame, keys: list[str] = (), floor_m: float = 30.0, least_pairs: int = 30, gate: tuple[float, float] | None = None) -> DataFrame:
    """Median of d_src / d_dst over long pairs, its quartiles and three equal bins by d_src; nothing under 30 pairs.

    ``gate`` (floor, dmax) pins the range to another estimate's, so that the bins of both can be compared.
    """
    if gate:
        top = pairs.groupBy(*keys).agg(F.lit(float(gate[1])).alias("dmax"), F.lit(float(gate[0])).alias("floor"))
    else:
        top = pairs.groupBy(*keys).agg(F.max("d_src").alias("dmax")).withColumn("floor", F.greatest(F.lit(floor_m), 0.15 * F.col("dmax")))
    j = pairs.join(top, list(keys)) if keys else pairs.crossJoin(F.broadcast(top))  # one row
    j = j.where((F.col("d_src") >= F.col("floor")) & (F.col("d_src") <= F.col("dmax")) & (F.col("d_dst") > 0)).withColumn("r", F.col("d_src") / F.col("d_dst"))
    step = (F.col("dmax") - F.col("floor")) / 3
    j = j.withColumn("bin", F.least(F.lit(2), F.floor((F.col("d_src") - F.col("floor")) / F.when(step > 0, step).otherwise(F.lit(1.0))).cast("int")))
    q = F.percentile("r", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = j.groupBy(*keys).agg(F.count("*").alias("n_pairs"), q.alias("q"), *[F.median(F.when(F.col("bin") == b, F.col("r"))).alias(f"bin{b}") for b in range(3)], F.max("floor").alias("floor"), F.max("dmax").alias("dmax"))
    return out.where(F.col("n_pairs") >= least_pairs).select(*keys, "n_pairs", F.col("q")[1].alias("ratio"), (100 * (F.col("q")[1] - 1)).alias("err_pct"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), "bin0", "bin1", "bin2", "floor", "dmax")


def noise(seed: int, *parts) -> Column:
    """A standard normal number from a hash of the parts (Box-Muller), the same in every run."""
    u = [(F.pmod(F.xxhash64(F.lit(seed + i), *[c(p) for p in parts]), F.lit((1 << 53) - 1)) + 1) / float(1 << 53) for i in range(2)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * float(np.pi) * u[1])


def noise_calibrate(cams: DataFrame, sigma: dict[str, float], trials: int = 5, seed: int = 20260804, order: str = "image_id", gate: tuple[float, float] | None = None) -> DataFrame:
    """What the estimator says of a perfect model at this noise: the middle trial's error and bins, and half the spread, in percent.

    One row, of ``trials`` 0 and nulls if no trial has pairs enough.  The middle trial is the one whose error is in the middle, so its bins belong to it.
    """
    axes = tuple(sigma)
    t = cams.select(order, *[f"d{a}" for a in axes], F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"))
    t = t.select("trial", order, *[F.col(f"d{a}").alias(f"s{a}") for a in axes], *[(F.col(f"d{a}") + noise(seed, F.lit(a), "trial", order) * s).alias(f"d{a}") for a, s in sigma.items()])
    e = scale_estimate(scale_pairs(t, axes, order, ["trial"]), ["trial"], gate=gate)
    listed = e.agg(F.sort_array(F.collect_list(F.struct("err_pct", "trial", "bin0", "bin1", "bin2"))).alias("all"))  # one entry a trial
    mid = F.get("all", F.floor(F.size("all") / 2).cast("int"))
    spread = (F.get("all", F.size("all") - 1)["err_pct"] - F.get("all", F.lit(0))["err_pct"]) / 2
    return listed.select(mid["err_pct"].alias("bias_pct"), spread.alias("spread_pct"), F.size("all").cast("long").alias("trials"), *[mid[f"bin{b}"].alias(f"noise_bin{b}") for b in range(3)])


#: True height must spread over so many sigmas to count; percent of error from which a model is taken for not aligned.
HEIGHT_SIGMAS, MISALIGNED_PCT = 2.0, 5.0
CHECKED = "dims int, err_pct double, corrected_pct double, noise_bias_pct double, sensitivity_pct double, folder_bias_m double, drift_pct double, n_pairs long, vertical_usable boolean, warns boolean, note string"


def scale_check(cams: DataFrame, least: int = 8, order: str = "image_id", floor_m: float = 30.0) -> DataFrame:
    """One row: the scale error less what noise alone shows, how sure it is, drift in excess of noise, and warnings; no row under ``least`` cameras or 30 pairs.

    ``cams`` has model coordinates sx, sy, sz, survey coordinates dx, dy, dz in metres, and folder.  Sigma of an axis is the residual's spread about its mean.
    Height counts only if the model's own heights spread over HEIGHT_SIGMAS of its sigma; else (``vertical_usable`` false, ``note`` says so) the estimate is horizontal.
    ``sensitivity_pct`` is the largest of the trials' half spread, two folders' differing offsets over the longest pair, and 0.05.  ``drift_pct``: how much more the medians of the three ranges of
    distance spread than those of the middle noise trial.  ``warns``: more than MISALIGNED_PCT are left after the correction.
    """
    n = cams.agg(F.count("*").alias("n"), *[F.stddev_pop(F.col(f"s{a}") - F.col(f"d{a}")).alias(f"sigma_{a}") for a in "xyz"], *[F.avg(F.col(f"s{a}") - F.col(f"d{a}")).alias(f"mean_{a}") for a in "xyz"], F.stddev_pop("sz").alias("height")).first()  # one row
    empty = cams.sparkSession.createDataFrame([], CHECKED)
    if not n or n["n"] < least:
        return empty
    usable = n["height"] > HEIGHT_SIGMAS * n["sigma_z"]
    axes = ("x", "y", "z") if usable else ("x", "y")
    est = kept(scale_estimate(scale_pairs(cams, axes, order), floor_m=floor_m))
    own = est.select("floor", "dmax").first()  # one row at most
    if own is None:
        return empty
    cal = noise_calibrate(cams, {a: float(n[f"sigma_{a}"]) for a in axes}, order=order, gate=(own["floor"], own["dmax"]))
    # Offsets of folders of three cameras or more, in centimetres as reported; the widest pair of them.
    per = kept(cams.groupBy("folder").agg(F.count("*").alias("k"), *[F.round(F.avg(F.col(f"s{a}") - F.col(f"d{a}")) - n[f"mean_{a}"], 2).alias(f"b{a}") for a in axes]).where("k >= 3"))
    other = per.select(F.col("folder").alias("_folder"), *[F.col(f"b{a}").alias(f"c{a}") for a in axes])
    gaps = per.join(other, F.col("folder") < F.col("_folder"))  # folders of one capture: a handful
    bias = gaps.agg(F.coalesce(F.max(F.sqrt(sum(((F.col(f"b{a}") - F.col(f"c{a}")) * (F.col(f"b{a}") - F.col(f"c{a}")) for a in axes), F.lit(0.0)))), F.lit(0.0)).alias("folder_bias_m"))
    one = est.crossJoin(F.broadcast(cal)).crossJoin(F.broadcast(bias))  # one row each

    def spread(names: list[str]) -> Column:
        known = sum((F.col(v).isNotNull().cast("int") for v in names), F.lit(0))
        return F.when(known > 1, 100 * (F.greatest(*names) - F.least(*names))).otherwise(F.lit(0.0))

    drift = F.greatest(F.lit(0.0), spread(["bin0", "bin1", "bin2"]) - spread(["noise_bin0", "noise_bin1", "noise_bin2"]))
    left = F.col("err_pct") - F.coalesce("bias_pct", F.lit(0.0))
    note = F.lit(None).cast("string") if usable else F.lit(f"heights spread over {n['height']:.1f} m, their noise is {n['sigma_z']:.1f} m: horizontal distances alone")
    floor = F.when(F.col("dmax") > 0, 100 * F.col("folder_bias_m") / F.col("dmax")).otherwise(F.lit(0.0))
    return one.select(F.lit(len(axes)).alias("dims"), "err_pct", left.alias("corrected_pct"), F.coalesce("bias_pct", F.lit(0.0)).alias("noise_bias_pct"), F.greatest(F.coalesce("spread_pct", F.lit(0.0)), floor, F.lit(0.05)).alias("sensitivity_pct"), "folder_bias_m", drift.alias("drift_pct"), "n_pairs", F.lit(bool(usable)).alias("vertical_usable"), (F.abs(left) > MISALIGNED_PCT).alias("warns"), note.alias("note"))


def moments(rows: DataFrame, keys: list[str], src=("sx", "sy", "sz"), dst=("dx", "dy", "dz")) -> DataFrame:
    """Means, population covariances and variance of two point sets, in one pass per key."""
    cov = [F.covar_pop(d, s).alias(f"c{i}{j}") for i, d in enumerate(dst) for j, s in enumerate(src)]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(s).alias(f"ms{i}") for i, s in enumerate(src)], *[F.avg(d).alias(f"md{i}") for i, d in enumerate(dst)], *cov, sum((F.var_pop(s) for s in src[1:]), F.var_pop(src[0])).alias("var"))


def umeyama(rows: DataFrame, keys: list[str], src=("sx", "sy", "sz"), dst=("dx", "dy", "dz")) -> DataFrame:
    """Least-squares similarity dst = scale * R * src + t per key; reflections are ruled out.  The solver sees one row of moments per key."""
    m = moments(rows, keys, src, dst)

    def solve(frames):
        for f in frames:
            if not len(f):
                continue
            cov = f[[f"c{i}{j}" for i in range(3) for j in range(3)]].to_numpy(dtype=float).reshape(-1, 3, 3)
            u, s, vt = np.linalg.svd(cov)
            flip = np.ones((len(f), 3))
            flip[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
            flip[flip == 0] = 1.0
            r = (u * flip[:, None, :]) @ vt
            scale = (s * flip).sum(1) / np.maximum(f["var"].to_numpy(dtype=float), 1e-300)
            ms, md = f[["ms0", "ms1", "ms2"]].to_numpy(dtype=float), f[["md0", "md1", "md2"]].to_numpy(dtype=float)
            t = md - scale[:, None] * np.einsum("nij,nj->ni", r, ms)
            out = {k: f[k] for k in keys} | {"n": f["n"], "scale": scale} | {f"r{i}{j}": r[:, i, j] for i in range(3) for j in range(3)} | {f"t{i}": t[:, i] for i in range(3)}
            yield pd.DataFrame(out)

    kinds = {k.name: k.dataType.simpleString() for k in m.schema}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "n long", "scale double", *[f"r{i}{j} double" for i in range(3) for j in range(3)], *[f"t{i} double" for i in range(3)]])
    return m.where("n >= 3").mapInPandas(solve, schema)


def prior_residuals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """After the best similarity: RMS per axis, and RMS, median and largest of the 3-D residual."""
    j = rows.join(umeyama(rows, keys).drop("n"), keys)
    at = [F.col("scale") * (F.col(f"r{i}0") * F.col("sx") + F.col(f"r{i}1") * F.col("sy") + F.col(f"r{i}2") * F.col("sz")) + F.col(f"t{i}") - F.col(d) for i, d in enumerate(("dx", "dy", "dz"))]
    e = j.select(*keys, *[v.alias(f"e{i}") for i, v in enumerate(at)]).withColumn("e3", F.sqrt(F.col("e0") * F.col("e0") + F.col("e1") * F.col("e1") + F.col("e2") * F.col("e2")))
    rms = lambda v: F.sqrt(F.avg(F.col(v) * F.col(v)))
    return e.groupBy(*keys).agg(F.count("*").alias("n"), rms("e0").alias("rms_x"), rms("e1").alias("rms_y"), rms("e2").alias("rms_z"), rms("e3").alias("rms"), F.median("e3").alias("median"), F.max("e3").alias("largest"))


def plane_fit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """z = a x + b y + c by least squares, from moments alone: a, b, c and the unit normal of (a, b, -1)."""
    m = rows.groupBy(*keys).agg(F.covar_pop("x", "x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("y", "y").alias("yy"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    a = (F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy")) / det
    b = (F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy")) / det
    s = m.where(det > 0).select(*keys, a.alias("a"), b.alias("b"), (F.col("mz") - a * F.col("mx") - b * F.col("my")).alias("c"))
    n = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + 1)
    return s.withColumn("nx", F.col("a") / n).withColumn("ny", F.col("b") / n).withColumn("nz", -1 / n)


def basis(rows: DataFrame, keys: list[str], mode: str = "pca") -> DataFrame:
    """Centroid and axes (columns of v): raw axes, or principal ones by descending eigenvalue; the solver sees one covariance a key."""
    axes = ("x", "y", "z")
    m = rows.groupBy(*keys).agg(*[F.avg(a).alias(f"m{a}") for a in axes], *[F.covar_samp(a, b).alias(f"c{i}{j}") for i, a in enumerate(axes) for j, b in enumerate(axes)])
    kinds = {k.name: k.dataType.simpleString() for k in m.schema}

    def solve(frames):
        for f in frames:
            if not len(f):
                continue
            cov = np.nan_to_num(f[[f"c{i}{j}" for i in range(3) for j in range(3)]].to_numpy(dtype=float).reshape(-1, 3, 3))
            w, v = np.linalg.eigh(cov)
            order = np.argsort(-w, axis=1, kind="stable")
            v = np.take_along_axis(v, order[:, None, :], axis=2) if mode == "pca" else np.tile(np.eye(3), (len(f), 1, 1))
            # A sign for each axis that does not depend on the solver: its largest component is positive.
            big = np.take_along_axis(v, np.abs(v).argmax(1)[:, None, :], axis=1)
            v = v * np.where(big < 0, -1, 1)
            yield pd.DataFrame({k: f[k] for k in keys} | {f"m{a}": f[f"m{a}"] for a in axes} | {f"v{i}{j}": v[:, i, j] for i in range(3) for j in range(3)})

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], *[f"m{a} double" for a in axes], *[f"v{i}{j} double" for i in range(3) for j in range(3)]])
    return m.mapInPandas(solve, schema)


def measured_axes(rows: DataFrame, keys: list[str], mode: str = "pca", height_axis: int = 0, swap_wd: bool = False, flip_h: bool = False, flip_w: bool = False, flip_d: bool = False) -> DataFrame:
    """``rows`` with h, w and d: coordinates along the basis axis taken as height and the two others, in order or swapped, each flipped at will."""
    j = rows.join(basis(rows, keys, mode), keys)
    delta = [F.col(a) - F.col(f"m{a}") for a in ("x", "y", "z")]
    on = [delta[0] * F.col(f"v0{k}") + delta[1] * F.col(f"v1{k}") + delta[2] * F.col(f"v2{k}") for k in range(3)]
    others = [k for k in range(3) if k != height_axis]
    order = [height_axis, *(others[::-1] if swap_wd else others)]
    return j.withColumns({n: (-on[k] if flip else on[k]) for n, k, flip in zip("hwd", order, (flip_h, flip_w, flip_d))}).select(*rows.columns, *"hwd")


def extents(rows: DataFrame, keys: list[str], mode: str = "pca", mm_per_unit: float | None = None, height_axis: int = 0, swap_wd: bool = False, flip_h: bool = False, flip_w: bool = False, flip_d: bool = False) -> DataFrame:
    """Height, width and depth (extent0 to extent2) along the chosen axes, in millimetres if the scale is known."""
    own = measured_axes(rows, keys, mode, height_axis, swap_wd, flip_h, flip_w, flip_d)
    k = mm_per_unit or 1.0
    return own.groupBy(*keys).agg(*[((F.max(v) - F.min(v)) * k).alias(f"extent{i}") for i, v in enumerate("hwd")])


def diameter(rows: DataFrame, keys: list[str], parts: int = 16, levels: int = 2, ends: bool = False) -> DataFrame:
    """The farthest pair of points per key, exact, by cell pairs whose upper bound beats the best distance known.

    Each level cuts the cells that are left into ``parts`` per axis (the first level the whole extent), pairs them within the
    pairs of the level before, and raises the lower bound to the largest distance between cells' representatives, so dense
    far cells shrink to their outermost points before any points are paired.  Repeated points count once.
    ``ends``: with dx, dy, dz from one end to the other.
    """
    axes = ("x", "y", "z")
    names = [f"_k{i}" for i in range(len(keys))]
    own = rows.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *axes).distinct()
    span = own.groupBy(*names).agg(*[F.min(a).alias(f"lo_{a}") for a in axes], F.greatest(*[F.max(a) - F.min(a) for a in axes], F.lit(1e-9)).alias("side"))
    placed, pairs = own.join(span, names), None
    for level in range(levels):
        step = F.col("side") / float(parts ** (level + 1))
        cell = F.struct(*[F.floor((F.col(a) - F.col(f"lo_{a}")) / step).alias(f"g{a}") for a in axes])
        placed = placed.withColumn("up", F.col("cell") if level else F.lit(0)).withColumn("cell", cell)
        cells = placed.groupBy(*names, "up", "cell").agg(F.min(F.struct(*axes)).alias("rep"), F.max("side").alias("side"))
        side = lambda p: cells.select(*names, F.col("up").alias(f"{p}_up"), F.col("cell").alias(p), F.col("rep").alias(f"{p}_rep"), *([F.col("side")] if p == "a" else []))
        met = side("a").join(side("b"), names) if pairs is None else pairs.select(*names, F.col("a").alias("a_up"), F.col("b").alias("b_up")).join(side("a"), [*names, "a_up"]).join(side("b"), [*names, "b_up"])
        met = met.where((F.col("a") <= F.col("b")) | (F.col("a_up") != F.col("b_up")))  # children of one cell meet once
        wide = [(F.abs(F.col(f"a.g{v}") - F.col(f"b.g{v}")) + 1) * (F.col("side") / float(parts ** (level + 1))) for v in axes]
        apart = [(F.col(f"a_rep.{v}") - F.col(f"b_rep.{v}")) * (F.col(f"a_rep.{v}") - F.col(f"b_rep.{v}")) for v in axes]
        met = kept(met.select(*names, "a", "b", F.sqrt(sum(w * w for w in wide)).alias("upper"), F.sqrt(sum(apart[1:], apart[0])).alias("known")))
        best = met.groupBy(*names).agg(F.max("known").alias("best"))
        # The slack covers rounding of the bounds.
        pairs = kept(met.join(best, names).where(F.col("upper") * (1 + 1e-9) >= F.col("best")).select(*names, "a", "b"))
        left = pairs.select(*names, F.col("a").alias("cell")).unionByName(pairs.select(*names, F.col("b").alias("cell"))).distinct()
        placed = kept(placed.join(left, [*names, "cell"], "left_semi"))
    at = lambda p, q: placed.select(*names, F.col("cell").alias(p), *[F.col(v).alias(f"{q}{v}") for v in axes])
    j = pairs.join(at("a", "p"), [*names, "a"]).join(at("b", "q"), [*names, "b"])
    d = [(F.col(f"p{v}") - F.col(f"q{v}")) * (F.col(f"p{v}") - F.col(f"q{v}")) for v in axes]
    out = [F.sqrt(F.max(d[0] + d[1] + d[2])).alias("diameter")]
    if ends:
        step_to = F.struct(*[(F.col(f"p{v}") - F.col(f"q{v}")).alias(f"d{v}") for v in axes])
        out.append(F.max_by(step_to, F.struct(d[0] + d[1] + d[2], step_to)).alias("_to"))
    found = j.groupBy(*names).agg(*out)
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "diameter", *(["_to.*"] if ends else []))


def _solve_tracks(uv: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Homogeneous points and median reprojection errors of tracks of equally many views: ``uv[track, view, axis]``, ``p[track, view, 3, 4]``."""
    a = np.concatenate([uv[:, :, :1] * p[:, :, 2] - p[:, :, 0], uv[:, :, 1:] * p[:, :, 2] - p[:, :, 1]], axis=1)
    h = np.linalg.svd(a, full_matrices=a.shape[1] < 4)[2][:, -1]
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        q = np.einsum("tvij,tj->tvi", p, h / h[:, 3:])
        return h, np.median(np.hypot(q[:, :, 0] / q[:, :, 2] - uv[:, :, 0], q[:, :, 1] / q[:, :, 2] - uv[:, :, 1]), axis=1)


def triangulate_tracks(obs: DataFrame, key: str = "point_id", min_views: int = 2, max_median: float = 2.0) -> DataFrame:
    """Points from tracks by direct linear transform.  ``obs`` has u, v and the 3x4 projection p00..p23; a track is one group,
    bounded by the images that see one point.  Tracks with a median reprojection error above the limit are dropped, observations without a key are none.

    Tracks come in order, those of a batch are solved together by their number of views; the open one is carried on."""
    kind = obs.schema[key].dataType.simpleString()
    cells = ["u", "v", *[f"p{i}{j}" for i in range(3) for j in range(4)]]

    def solved(keys: np.ndarray, v: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
        sizes, found = np.diff(starts), []
        for n in np.unique(sizes[sizes >= min_views]).tolist():
            at = starts[:-1][sizes == n]
            own = v[at[:, None] + np.arange(n)]
            h, error = _solve_tracks(own[:, :, :2], own[:, :, 2:].reshape(len(at), n, 3, 4))
            good = (np.abs(h[:, 3]) >= 1e-12) & (error <= max_median)
            x = h[good, :3] / h[good, 3:]
            found.append(pd.DataFrame({key: keys[at[good]], "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "n": n, "median_px": error[good]}))
        return pd.concat(found) if found else pd.DataFrame({key: keys[:0], "x": [], "y": [], "z": [], "n": [], "median_px": []})

    def solve(frames):
        held: list[pd.DataFrame] = []
        for frame in frames:
            if not len(frame):
                continue
            names = frame[key].to_numpy()
            if held and held[0][key].iloc[0] == names[0] == names[-1]:
                held.append(frame)
                continue
            frame = pd.concat([*held, frame])
            names = frame[key].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1])
            held = [frame.iloc[starts[-1] :]]
            if len(starts) > 1:
                yield solved(names, frame[cells].to_numpy(dtype=float), starts)
        if held:
            frame = pd.concat(held)
            yield solved(frame[key].to_numpy(), frame[cells].to_numpy(dtype=float), np.array([0, len(frame)]))

    own = obs.where(F.col(key).isNotNull()).select(key, *cells).repartition(key).sortWithinPartitions(key)
    return own.mapInPandas(solve, f"{key} {kind}, x double, y double, z double, n long, median_px double")


def corner_pairs(corners: DataFrame, max_hop: int = 2, square_mm: float = 10.0, keys: list[str] = ()) -> DataFrame:
    """Samples mm / model distance of corner pairs within ``max_hop`` steps on the board: corners(gx, gy, x, y, z)."""
    hops = [(i, j) for i in range(-max_hop, max_hop + 1) for j in range(max_hop + 1) if (j, i) > (0, 0)]
    a = corners.select(*keys, "gx", "gy", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in hops])).alias("hop"))
    a = a.select("*", (F.col("gx") + F.col("hop.i")).alias("bgx"), (F.col("gy") + F.col("hop.j")).alias("bgy"))
    b = corners.select(*keys, F.col("gx").alias("bgx"), F.col("gy").alias("bgy"), "x", "y", "z")
    d = [F.col(f"a{v}") - F.col(v) for v in "xyz"]
    far = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    real = square_mm * F.sqrt((F.col("hop.i") * F.col("hop.i") + F.col("hop.j") * F.col("hop.j")).cast("double"))
    # Corners are many however small their files: both sides move for the join, none is broadcast.
    return a.join(b.hint("merge"), [*keys, "bgx", "bgy"]).where(far > 0).select(*keys, (real / far).alias("sample"))


def marker_scale(samples: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Median, mean, MAD, relative MAD in percent (over 5 warns), least and largest of the scale samples."""
    med = samples.groupBy(*keys).agg(F.median("sample").alias("med"))
    j = samples.join(med, list(keys)) if keys else samples.crossJoin(F.broadcast(med))  # one row
    out = j.groupBy(*keys).agg(F.count("*").alias("n"), F.max("med").alias("median"), F.avg("sample").alias("mean"), F.median(F.abs(F.col("sample") - F.col("med"))).alias("mad"), F.min("sample").alias("least"), F.max("sample").alias("largest"))
    return out.withColumn("mad_pct", 100 * F.col("mad") / F.col("median")).withColumn("warns", F.col("mad_pct") > 5)


def sampson(x1, y1, x2, y2, e: list[list[Column]]) -> Column:
    """Sampson distance of two normalised points under an essential matrix."""
    a = [e[i][0] * c(x1) + e[i][1] * c(y1) + e[i][2] for i in range(3)]
    b = [e[0][i] * c(x2) + e[1][i] * c(y2) + e[2][i] for i in range(2)]
    top = c(x2) * a[0] + c(y2) * a[1] + a[2]
    return F.abs(top) / F.greatest(F.sqrt(a[0] * a[0] + a[1] * a[1] + b[0] * b[0] + b[1] * b[1]), F.lit(1e-12))


def pair_images(pair_id) -> tuple[Column, Column]:
    """The two image ids of a pair id: quotient and remainder by 2147483647, where remainder 0 stands for the divisor."""
    d = 2147483647
    second = c(pair_id) % d
    first = F.call_function("div", c(pair_id), F.lit(d))  # in whole numbers: doubles are too short for ids from 2 ** 53 on
    return F.when(second == 0, first - 1).otherwise(first).cast("long"), F.when(second == 0, F.lit(d)).otherwise(second).cast("long")


def epipolar_check(errors: DataFrame, min_matches: int = 50, max_pairs: int = 50, limit_px: float = 5.0) -> DataFrame:
    """``errors(sensor_a, sensor_b, pair_id, px)``, as ``twoview.epipolar_errors`` makes them: median per pair with over ``min_matches`` matches, then the median of the
    first ``max_pairs`` pairs of a pair of sensors; above the limit it fails."""
    from pyspark.sql import Window

    per = errors.groupBy("sensor_a", "sensor_b", "pair_id").agg(F.count("*").alias("n"), F.median("px").alias("px")).where(F.col("n") > min_matches)
    some = per.withColumn("nth", F.row_number().over(Window.partitionBy("sensor_a", "sensor_b").orderBy("pair_id"))).where(F.col("nth") <= max_pairs)
    return some.groupBy("sensor_a", "sensor_b").agg(F.count("*").alias("pairs"), F.median("px").alias("median_px")).withColumn("fails", F.col("median_px") > limit_px)


def eo_check(centers: DataFrame, eo: DataFrame, max_rms: float) -> DataFrame:
    """Centres against survey positions by stem: bias and spread per axis, RMS, largest, unmatched; fails above the limit."""
    j = centers.select("stem", "x", "y", "z").join(eo.select("stem", "e", "n", "h", F.lit(1).alias("has")), "stem", "left")
    d = {"x": F.col("x") - F.col("e"), "y": F.col("y") - F.col("n"), "z": F.col("z") - F.col("h")}
    sq = d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]
    return j.agg(F.count("has").alias("matched"), (F.count("*") - F.count("has")).alias("unmatched"), *[F.avg(v).alias(f"bias_{k}") for k, v in d.items()], *[F.stddev_pop(v).alias(f"sd_{k}") for k, v in d.items()], F.sqrt(F.avg(sq)).alias("rms"), F.sqrt(F.max(sq)).alias("largest")).withColumn("fails", F.col("rms") > max_rms)
