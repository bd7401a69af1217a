"""Nearest neighbours on an adaptive index: a k-d tree whose leaves hold about equally many points, however they are spread.

The tree's top is fitted on a sample of about SAMPLE points chosen by hash, with a leaf for every CELL points and at most
MAX_LEAVES of them; it decides how even the groups are, never what is found.  Every point goes to its leaf; there the k nearest are
found.  A point whose k-th distance reaches over the leaf's edge is then sent to the leaves within that distance (of their points'
tight boxes), and what they have is merged.  Inside a leaf buckets of points are visited by the distance of their boxes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconspark.operators.frames import kept

#: Points wanted in a leaf; most leaves of all trees together; points that trees are fitted on; points in a bucket of a leaf.
CELL, MAX_LEAVES, SAMPLE, BUCKET = 4096, 16_384, 200_000, 128


def grow(points: np.ndarray, leaves: int):
    """Nested (axis, cut, left, right) with leaf numbers at the ends: halves along the widest axis at the median; points on the cut go right."""
    numbers = iter(range(leaves))

    def split(own: np.ndarray, leaves: int):
        for axis in np.argsort(-(own.max(0) - own.min(0))) if leaves > 1 and len(own) > 1 else ():
            cut = float(np.quantile(own[:, axis], (leaves // 2) / leaves))
            left = own[:, axis] < cut
            if not left.any():  # many points at the low end: the next value cuts
                above = own[own[:, axis] > cut, axis]
                if not len(above):
                    continue
                cut = float(above.min())
                left = own[:, axis] < cut
            share = min(leaves - 1, max(1, round(leaves * float(left.mean()))))
            return (int(axis), cut, split(own[left], share), split(own[~left], leaves - share))
        return next(numbers)

    return split(points, leaves)


def leaf_of(tree, points: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), dtype="int64")
    stack = [(tree, np.arange(len(points)))]
    while stack:
        node, at = stack.pop()
        if not isinstance(node, tuple):
            out[at] = node
            continue
        axis, cut, left, right = node
        low = points[at, axis] < cut
        stack += [(left, at[low]), (right, at[~low])]
    return out


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Euclidean distances of points (rows) to boxes (columns)."""
    out = np.zeros((len(points), len(low)))
    for axis in range(points.shape[1]):
        p = points[:, axis, None]
        out += np.maximum(np.maximum(low[None, :, axis] - p, p - high[None, :, axis]), 0.0) ** 2
    return np.sqrt(out)


def nearest(own: np.ndarray, ids: np.ndarray, asked: np.ndarray, asked_ids: np.ndarray, k: int, far: np.ndarray | None = None):
    """Per asking point the (up to) k nearest others of ``own`` by (distance, id), those beyond its ``far`` left out: lists of (asking row, id, distance)."""
    order = leaf_of(grow(own, max(1, len(own) // BUCKET)), own) if len(own) > BUCKET else np.zeros(len(own), "int64")
    by = np.argsort(order, kind="stable")
    starts = np.concatenate([[0], np.flatnonzero(np.diff(order[by])) + 1, [len(by)]])
    parts = [by[a:b] for a, b in zip(starts[:-1], starts[1:])]
    low, high = np.array([own[p].min(0) for p in parts]), np.array([own[p].max(0) for p in parts])
    rows, found, away = [], [], []
    turn = np.argsort(leaf_of(grow(asked, max(1, len(asked) // BUCKET)), asked), kind="stable") if len(asked) > BUCKET else np.arange(len(asked))
    for at in range(0, len(turn), BUCKET):
        q = turn[at : at + BUCKET]
        gap = box_distance(asked[q], low, high)
        limit = np.full(len(q), np.inf) if far is None else far[q]
        c_row, c_id, c_distance = np.zeros(0, "int64"), ids[:0], np.zeros(0)
        for part in np.argsort(gap.min(0), kind="stable"):
            need = np.flatnonzero(gap[:, part] <= limit)
            if not len(need):
                if gap[:, part].min() > limit.max():
                    break
                continue
            p = parts[part]
            d = np.sqrt(((asked[q[need]][:, None, :] - own[p][None, :, :]) ** 2).sum(2))
            d[ids[p][None, :] == asked_ids[q[need]][:, None]] = np.inf
            i, j = np.nonzero((d <= limit[need][:, None]) & (d < np.inf))
            c_row, c_id, c_distance = np.concatenate([c_row, need[i]]), np.concatenate([c_id, ids[p[j]]]), np.concatenate([c_distance, d[i, j]])
            pick = np.lexsort((c_id, c_distance, c_row))
            c_row, c_id, c_distance = c_row[pick], c_id[pick], c_distance[pick]
            nth = np.arange(len(c_row)) - np.searchsorted(c_row, c_row)
            c_row, c_id, c_distance, nth = (v[nth < k] for v in (c_row, c_id, c_distance, nth))
            full = nth == k - 1
            limit[c_row[full]] = np.minimum(limit[c_row[full]], c_distance[full])
        rows.append(q[c_row])
        found.append(c_id)
        away.append(c_distance)
    if not rows:
        return np.zeros(0, "int64"), ids[:0], np.zeros(0)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(away)


def knn(rows: DataFrame, id_col: str, axes: tuple[str, ...], k: int, keys: list[str] = (), cell: int | None = None) -> DataFrame:
    """(keys, id, neighbour, distance, nth): the k nearest others of each row of its key, exact; ties by neighbour id.

    Ids are unique within a key and coordinates finite; rows with a null id, key or coordinate are left out.  A key of one row gives none.
    """
    keys, cell = list(keys), cell or CELL
    at = [f"p{i}" for i in range(len(axes))]
    own = rows.select(F.struct(*keys).alias("_key") if keys else F.struct(F.lit(0)).alias("_key"), F.col(id_col).alias("id"), *[F.col(a).cast("double").alias(n) for a, n in zip(axes, at)]).na.drop(subset=["id", *at])
    for key in keys:
        own = own.where(F.col(f"_key.{key}").isNotNull())
    id_kind = own.schema["id"].dataType.simpleString()
    own = own.withColumn("_group", F.xxhash64("_key"))
    # A tree for each key with more points than a leaf: at most MAX_LEAVES of them, the largest.
    sizes = own.groupBy("_key", "_group").agg(F.count("*").alias("n")).where(F.col("n") > cell).orderBy(F.desc("n"), "_group").limit(MAX_LEAVES).select("_group", "n").collect()
    total = sum(r["n"] for r in sizes)
    trees: dict[int, object] = {}
    if sizes:
        share = F.pmod(F.xxhash64("_group", "id"), F.lit(1 << 40)) < int(min(1.0, SAMPLE / total) * (1 << 40))
        large = own.sparkSession.createDataFrame([(r["_group"],) for r in sizes], "_group long")
        sample = own.where(share).join(F.broadcast(large), "_group", "left_semi").select("_group", *at).toPandas()  # about SAMPLE rows; at most MAX_LEAVES keys
        wanted = {r["_group"]: min(-(-r["n"] // cell), max(1, MAX_LEAVES * r["n"] // total)) for r in sizes}
        trees = {g: grow(part[at].to_numpy(), wanted[g]) for g, part in sample.groupby("_group")}
    number = f"_key {own.schema['_key'].dataType.simpleString()}, _group long, id {id_kind}, {', '.join(f'{a} double' for a in at)}, leaf int"

    def place(frames):
        for frame in frames:
            leaf = np.zeros(len(frame), dtype="int64")
            xy = frame[at].to_numpy()
            for g, index in frame.groupby("_group").indices.items():
                if g in trees:
                    leaf[index] = leaf_of(trees[g], xy[index])
            yield frame.assign(leaf=leaf)

    placed = kept(own.mapInPandas(place, number))
    split = F.col("_group").isin(list(trees)) if len(trees) <= 50 else None
    in_trees = (placed.where(split) if split is not None else placed.join(F.broadcast(large), "_group", "left_semi")) if trees else None
    boxes: dict[int, tuple] = {}
    if in_trees is not None:
        stats = in_trees.groupBy("_group", "leaf").agg(F.count("*").alias("n"), *[F.min(a).alias(f"l{a}") for a in at], *[F.max(a).alias(f"h{a}") for a in at]).toPandas()  # at most MAX_LEAVES rows
        boxes = {g: (part["leaf"].to_numpy(), part[[f"l{a}" for a in at]].to_numpy(), part[[f"h{a}" for a in at]].to_numpy(), part["n"].to_numpy()) for g, part in stats.groupby("_group")}
    out_schema = f"_group long, leaf int, id {id_kind}, neighbour {id_kind}, distance double"

    def inside(frame: pd.DataFrame) -> pd.DataFrame:
        ids, xy = frame["id"].to_numpy(), frame[at].to_numpy()
        asking, found, away = nearest(xy, ids, xy, ids, k)
        return pd.DataFrame({"_group": frame["_group"].iloc[0], "leaf": frame["leaf"].iloc[0], "id": ids[asking], "neighbour": found, "distance": away})

    first = kept(placed.groupBy("_group", "leaf").applyInPandas(inside, out_schema))
    near = first.select("_group", "id", "neighbour", "distance")
    if boxes:
        reach = first.groupBy("_group", "id").agg(F.when(F.count("*") == k, F.max("distance")).alias("_far"))
        asking = in_trees.join(reach, ["_group", "id"], "left").select("_group", "id", *at, "leaf", "_far")

        def send(frames):
            for frame in frames:
                out = []
                for g, index in frame.groupby("_group").indices.items():
                    leaf, low, high, n = boxes[g]
                    for s in range(0, len(index), 2048):
                        some = frame.iloc[index[s : s + 2048]]
                        xy, far = some[at].to_numpy(), some["_far"].to_numpy(dtype=float).copy()
                        open_ = np.flatnonzero(np.isnan(far))
                        if len(open_):  # fewer than k in the own leaf: the nearest leaves that hold k others wholly bound the distance
                            most = np.sqrt((np.maximum(np.abs(xy[open_][:, None, :] - low), np.abs(xy[open_][:, None, :] - high)) ** 2).sum(2))
                            order = np.argsort(most, axis=1)
                            enough = np.cumsum(n[order], axis=1) >= k + 1
                            far[open_] = np.where(enough.any(1), np.take_along_axis(most, order, 1)[np.arange(len(open_)), enough.argmax(1)], np.inf)
                        i, j = np.nonzero((box_distance(xy, low, high) <= far[:, None]) & (leaf[None, :] != some["leaf"].to_numpy()[:, None]))
                        picked = some.iloc[i]
                        out.append(pd.DataFrame({"_group": g, "leaf": leaf[j], "id": picked["id"].to_numpy(), **{a: picked[a].to_numpy() for a in at}, "_far": far[i]}))
                if out:
                    yield pd.concat(out)

        sent = asking.mapInPandas(send, f"_group long, leaf int, id {id_kind}, {', '.join(f'{a} double' for a in at)}, _far double")
        both = in_trees.select("_group", "leaf", "id", *at, F.lit(None).cast("double").alias("_far")).unionByName(sent)

        def across(frame: pd.DataFrame) -> pd.DataFrame:
            guest = frame["_far"].notna().to_numpy()
            home, asks = frame[~guest], frame[guest]
            ids, names = home["id"].to_numpy(), asks["id"].to_numpy()
            if not len(asks) or not len(home):
                return pd.DataFrame({"_group": pd.Series(dtype="int64"), "leaf": pd.Series(dtype="int64"), "id": ids[:0], "neighbour": ids[:0], "distance": pd.Series(dtype="float64")})
            asking, found, away = nearest(home[at].to_numpy(), ids, asks[at].to_numpy(), names, k, asks["_far"].to_numpy(dtype=float))
            return pd.DataFrame({"_group": frame["_group"].iloc[0], "leaf": frame["leaf"].iloc[0], "id": names[asking], "neighbour": found, "distance": away})

        near = near.unionByName(both.groupBy("_group", "leaf").applyInPandas(across, out_schema).select("_group", "id", "neighbour", "distance"))
    nth = F.row_number().over(Window.partitionBy("_group", "id").orderBy("distance", "neighbour"))
    top = near.withColumn("nth", nth).where(F.col("nth") <= k)
    if not keys:
        return top.select("id", "neighbour", "distance", "nth")
    names = own.groupBy("_group").agg(F.first("_key").alias("_key"), F.count_distinct("_key").alias("_n"))
    check = F.when(F.col("_n") > 1, F.raise_error(F.lit("two keys with one hash"))).otherwise(F.col("_key"))
    return top.join(names.select("_group", check.alias("_key")), "_group").select(*[F.col(f"_key.{key}").alias(key) for key in keys], "id", "neighbour", "distance", "nth")
