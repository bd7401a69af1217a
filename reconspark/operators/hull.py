"""Convex-hull areas of groups of points, and widest angles of groups of rays, from hulls that are merged.

The hull of a union is the hull of the hulls' corners.  So each task first replaces the points of a group in a batch by their
hull's corners; only those move.  Behind the shuffle a group's corners come in sorted order, and what is carried from batch to
batch is the corners of the one group still open: no row and no task ever holds a whole group.  Groups of few points are many: those of a batch are
worked off together, by their number of points.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corners(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of rows (x, y), in order; of points on a line its ends, of equal points one."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    chains = []
    for way in (points.tolist(), points[::-1].tolist()):
        chain: list = []
        for px, py in way:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2:]
                if (bx - ax) * (py - ay) > (by - ay) * (px - ax):
                    break
                chain.pop()
            chain.append((px, py))
        chains += chain[:-1]
    return np.array(chains)


def area_of(x: np.ndarray, y: np.ndarray) -> float:
    """Area of the convex hull; 0 for fewer than three different points or points on a line."""
    ring = corners(np.column_stack([x, y]).astype(float))
    if len(ring) < 3:
        return 0.0
    nxt = np.roll(ring, -1, axis=0)
    return float(abs((ring[:, 0] * nxt[:, 1] - ring[:, 1] * nxt[:, 0]).sum()) / 2)


#: Points of a group in a batch that are handed on as they are, and of a group whose hull is found together with those of other groups.
FEW = 32


def small_areas(xy: np.ndarray) -> np.ndarray:
    """Hull areas of groups of equally many points, ``xy[group, point, axis]``: the chains of ``corners`` for all groups at once."""
    many, n, _ = xy.shape
    area = np.zeros(many)
    if n < 3:
        return area
    order = np.lexsort((xy[:, :, 1], xy[:, :, 0]))
    x, y = np.take_along_axis(xy[:, :, 0], order, 1), np.take_along_axis(xy[:, :, 1], order, 1)
    for way in (1, -1):
        cx, cy, top = np.zeros((many, n)), np.zeros((many, n)), np.zeros(many, dtype="int64")
        for i in range(n)[::way]:
            px, py = x[:, i], y[:, i]
            at = np.arange(many)
            while len(at := at[top[at] > 1]):
                k = top[at]
                ax, ay, bx, by = cx[at, k - 2], cy[at, k - 2], cx[at, k - 1], cy[at, k - 1]
                at = at[~((bx - ax) * (py[at] - ay) > (by - ay) * (px[at] - ax))]
                top[at] -= 1
            every = np.arange(many)
            cx[every, top], cy[every, top] = px, py
            top += 1
        on = np.arange(1, n)[None, :] < top[:, None]
        area += np.where(on, cx[:, :-1] * cy[:, 1:] - cy[:, :-1] * cx[:, 1:], 0.0).sum(1)
    return np.abs(area) / 2


def _runs(frame: pd.DataFrame) -> np.ndarray:
    """Where runs of equal group numbers start in a frame sorted by them, and its length."""
    g = frame["_g"].to_numpy()
    return np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]]) if len(g) else np.array([0])


def _thin(frames):
    """Of each batch: every group's points, or the corners of their hull."""
    for frame in frames:
        frame = frame.sort_values("_g", kind="stable")
        starts = _runs(frame)
        if not (np.diff(starts) > FEW).any():
            yield frame
            continue
        xy, g = frame[["x", "y"]].to_numpy(), frame["_g"].to_numpy()
        big = np.flatnonzero(np.diff(starts) > FEW)
        stay = np.ones(len(frame), dtype=bool)
        more_xy, more_g = [], []
        for k in big:
            a, b = starts[k], starts[k + 1]
            stay[a:b] = False
            found = corners(xy[a:b])
            more_xy.append(found)
            more_g.append(np.full(len(found), g[a]))
        xy, g = np.concatenate([xy[stay], *more_xy]), np.concatenate([g[stay], *more_g])
        yield pd.DataFrame({"_g": g, "x": xy[:, 0], "y": xy[:, 1]})


def _of_hulls(values, name: str):
    """The function of a task: ``values(xy, starts)``, named ``name``, of each group's points; groups come in order, the corners of the open one are carried on."""

    def fold(frames):
        own, held = None, np.zeros((0, 2))
        for frame in frames:
            if not len(frame):
                continue
            starts, xy, g = _runs(frame), frame[["x", "y"]].to_numpy(), frame["_g"].to_numpy()
            done, first = [], 0
            if own is not None and g[0] == own:
                held, first = corners(np.concatenate([held, xy[: starts[1]]])), 1
            if own is not None and first < len(starts) - 1:  # another group begins: the open one is whole
                done.append((np.array([own]), values(held, np.array([0, len(held)]))))
            if first < len(starts) - 1:
                whole = starts[first:-1]
                done.append((g[whole[:-1]], values(xy, whole)))
                own, held = g[whole[-1]], xy[whole[-1] :]
            yield pd.DataFrame({"_g": np.concatenate([d[0] for d in done]) if done else np.zeros(0, "int64"), name: np.concatenate([d[1] for d in done]) if done else np.zeros(0)})
        if own is not None:
            yield pd.DataFrame({"_g": [own], name: values(held, np.array([0, len(held)]))})

    return fold


def _area_values(xy: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hull areas of the runs of rows between ``starts``: runs of equal length together, long ones by themselves."""
    sizes, out = np.diff(starts), np.zeros(len(starts) - 1)
    for n in np.unique(sizes[sizes > 2]).tolist():
        at = np.flatnonzero(sizes == n)
        if n <= FEW:
            out[at] = small_areas(xy[starts[at][:, None] + np.arange(n)])
        else:
            out[at] = [area_of(xy[starts[k] : starts[k + 1], 0], xy[starts[k] : starts[k + 1], 1]) for k in at]
    return out


_areas = _of_hulls(_area_values, "_area")

#: Corners compared with all others at a time.
ROWS = 512


def widest_angle(points: np.ndarray) -> float:
    """The largest angle in degrees between rays (x, y, 1)."""
    ring = corners(points)
    rays = np.column_stack([ring, np.ones(len(ring))])
    rays /= np.linalg.norm(rays, axis=1, keepdims=True)
    most = 0.0
    for at in range(0, len(rays), ROWS):
        chord = np.zeros((len(rays[at : at + ROWS]), len(rays)))
        for axis in range(3):
            chord += (rays[at : at + ROWS, axis, None] - rays[None, :, axis]) ** 2
        most = max(most, float(chord.max()))
    return float(np.degrees(2 * np.arcsin(min(1.0, np.sqrt(most) / 2))))


def _angle_values(xy: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.array([widest_angle(xy[a:b]) for a, b in zip(starts[:-1], starts[1:])])


def _hull_values(rows: DataFrame, keys: list[str], x: str, y: str, fold, value: str, name: str) -> DataFrame:
    if len(keys) == 1 and rows.schema[keys[0]].dataType.simpleString() in ("bigint", "int") and not rows.schema[keys[0]].nullable:
        named, numbers = rows.withColumn("_g", F.col(keys[0]).cast("long")), None
    else:
        # Groups travel as one number; two keys of one number are told apart by the check below.
        named = rows.withColumn("_g", F.xxhash64(*keys))
        numbers = named.groupBy("_g").agg(F.min(F.xxhash64(F.lit(1), *keys)).alias("_low"), F.max(F.xxhash64(F.lit(1), *keys)).alias("_high"), *[F.first(k).alias(k) for k in keys])
    points = named.select("_g", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    thin = points.mapInPandas(_thin, "_g long, x double, y double")
    values = thin.repartition("_g").sortWithinPartitions("_g").mapInPandas(fold, f"_g long, {value} double")
    if numbers is None:
        return named.select("_g").distinct().join(values, "_g", "left").select(F.col("_g").cast(rows.schema[keys[0]].dataType).alias(keys[0]), F.coalesce(value, F.lit(0.0)).alias(name))
    # A number that two keys share stops the query instead of mixing their points.
    alone = F.when(F.col("_low") != F.col("_high"), F.raise_error(F.lit("two groups with one hash"))).otherwise(F.coalesce(value, F.lit(0.0)))
    return numbers.join(values, "_g", "left").select(*keys, alone.alias(name))


def hull_areas(rows: DataFrame, keys: list[str], x: str = "x", y: str = "y", name: str = "area") -> DataFrame:
    """One row per key: the keys and the area of the convex hull of the key's points.

    Points with a null or NaN coordinate are left out; a key without others has area 0.  Null keys are a key like any other.
    """
    return _hull_values(rows, keys, x, y, _areas, "_area", name)


def hull_angles(rows: DataFrame, keys: list[str], x: str = "x", y: str = "y", name: str = "angle") -> DataFrame:
    """One row per key: the keys and the largest angle in degrees between any two of the key's rays (x, y, 1).

    Straight lines of that plane are great circles, and an angle from a fixed ray has its maximum at a corner of a hull, so the
    corners are enough: a key of many rays is never paired with itself.  Null and NaN as in ``hull_areas``; a key of one ray has angle 0.
    """
    return _hull_values(rows, keys, x, y, _of_hulls(_angle_values, "_angle"), "_angle", name)
