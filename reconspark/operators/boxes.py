"""Detection boxes, clicks and prompts per image."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconspark.functions.geometry import big_enough, c, clip_box, has_sides, normalize_box
from reconspark.operators.frames import kept

BOX = ("x0", "y0", "x1", "y1")


def _put(df: DataFrame, values) -> DataFrame:
    return df.withColumns(dict(zip(BOX, values)))


def normalize_boxes(boxes: DataFrame) -> DataFrame:
    return _put(boxes, normalize_box(*BOX))


def clip_boxes(boxes: DataFrame, width="width", height="height") -> DataFrame:
    """Clamped to the image; boxes with a side under 1 are dropped."""
    return _put(boxes, clip_box(BOX, width, height)).where(has_sides(BOX))


def scale_boxes(boxes: DataFrame, sx, sy) -> DataFrame:
    return _put(boxes, [c("x0") * sx, c("y0") * sy, c("x1") * sx, c("y1") * sy])


def filter_small(boxes: DataFrame, share: float, width="width", height="height") -> DataFrame:
    return boxes.where(big_enough(BOX, share, width, height))


#: An image with at most so many boxes is one array; boxes of larger ones are rows of a join.
FOLD = 256


def _iou(a: dict, b: dict) -> Column:
    area = lambda v: (v["x1"] - v["x0"]) * (v["y1"] - v["y0"])
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h / F.greatest(area(a) + area(b) - w * h, F.lit(1e-6))


def nms(boxes: DataFrame, image: str = "image_id", score: str | None = "score", threshold: float = 0.9, fold: int = FOLD) -> DataFrame:
    """Greedy suppression per image: by score (or area) descending, then box_id; a box stays if its IoU with all kept is at most the threshold.

    The boxes of a common image, at most ``fold``, are one array that a fold over its rank order keeps or drops.  Those of larger images
    stay rows (``overlaps``, ``suppressed``).  Both give the same boxes.  A box_id occurs once in an image.
    """
    order = (c(score) if score else (c("x1") - c("x0")) * (c("y1") - c("y0"))).cast("double")
    counts = boxes.groupBy(image).agg(F.count("*").alias("_n"))
    large = kept(counts.where(F.col("_n") > fold).select(image))
    if large.isEmpty():
        return _folded(boxes, image, order, threshold)
    many = boxes.join(large, image, "left_semi")
    gone = suppressed(overlaps(many, image, order, threshold))
    rest = many.join(gone.select(F.col("_image").alias(image), F.col("_lose").alias("box_id")), [image, "box_id"], "left_anti").select(*boxes.columns)
    return _folded(boxes.join(large, image, "left_anti"), image, order, threshold).unionByName(rest)


def _folded(boxes: DataFrame, image: str, order: Column, threshold: float) -> DataFrame:
    rest = [k for k in boxes.columns if k != image]
    ranked = F.sort_array(F.collect_list(F.struct((-order).alias("_rank"), F.col("box_id").alias("_id"), F.struct(*rest).alias("_b"))))
    grouped = boxes.groupBy(image).agg(ranked.alias("_all"))
    keep = F.aggregate("_all", F.slice("_all", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: _iou(k["_b"], x["_b"]) > threshold), kept).otherwise(F.concat(kept, F.array(x))))
    return grouped.select(image, F.explode(keep).alias("_k")).select(image, "_k._b.*").select(*boxes.columns)


def overlaps(boxes: DataFrame, image: str, order: Column, threshold: float) -> DataFrame:
    """(_image, _win, _lose): pairs of box ids of an image whose IoU is above the threshold, the better rank first.

    Sides of such boxes differ by less than the factor 1 / threshold.  So a box is put on grids of cells as large as the power of two
    above its own sides, and of the larger ones up to that factor; on the grid of the larger of the two sides both cover the cell
    that holds their overlap's lower corner, and there alone the pair is made.
    """
    steps = max(1, math.ceil(math.log2(1 / max(threshold, 1 / 64)) + 1e-9))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    level = lambda side: F.when(side > 0, F.ceil(F.log2(side))).otherwise(F.lit(-30)).cast("int")
    own = boxes.where((w > 0) & (h > 0)).select(F.col(image).alias("_image"), F.col("box_id").alias("_id"), order.alias("_rank"), *[F.col(v).cast("double").alias(v) for v in BOX], level(w).alias("_lx"), level(h).alias("_ly"))
    for axis, low, high in (("x", "x0", "x1"), ("y", "y0", "y1")):
        own = own.withColumn(f"_g{axis}", F.explode(F.array(*[F.col(f"_l{axis}") + s for s in range(steps + 1)])))
        size = F.pow(F.lit(2.0), F.col(f"_g{axis}"))
        own = own.withColumn(f"_c{axis}", F.explode(F.sequence(F.floor(F.col(low) / size).cast("long"), F.floor(F.col(high) / size).cast("long"))))
    cell = ["_image", "_gx", "_gy", "_cx", "_cy"]
    rename = lambda s: own.select(*cell, F.struct("_id", "_rank", *BOX, "_lx", "_ly").alias(s))
    a, b = F.col("a"), F.col("b")
    better = (a["_rank"] > b["_rank"]) | ((a["_rank"] == b["_rank"]) & (a["_id"] < b["_id"]))
    once = [F.col(f"_g{v}") == F.greatest(a[f"_l{v}"], b[f"_l{v}"]) for v in "xy"] + [F.col(f"_c{v}") == F.floor(F.greatest(a[f"{v}0"], b[f"{v}0"]) / F.pow(F.lit(2.0), F.col(f"_g{v}"))) for v in "xy"]
    pairs = rename("a").join(rename("b"), cell).where(better & once[0] & once[1] & once[2] & once[3])
    return pairs.where(_iou({v: a[v] for v in BOX}, {v: b[v] for v in BOX}) > threshold).select("_image", a["_id"].alias("_win"), b["_id"].alias("_lose"))


def suppressed(pairs: DataFrame) -> DataFrame:
    """(_image, _lose) of the boxes that a kept better one drops, in rounds: a box that no undecided one can drop is kept and
    drops what it overlaps.  Each round decides at least the best undecided box of every image, mostly a large share of all."""
    left, gone = kept(pairs), None
    while not left.isEmpty():
        losers = left.select("_image", F.col("_lose").alias("_win")).distinct()
        sure = left.join(losers, ["_image", "_win"], "left_anti")
        now = kept(sure.select("_image", "_lose").distinct())
        gone = now if gone is None else gone.unionByName(now)
        # What a kept box drops is decided, and what is dropped drops nothing.
        left = kept(left.join(now, ["_image", "_lose"], "left_anti").join(now.withColumnRenamed("_lose", "_win"), ["_image", "_win"], "left_anti"))
    return gone if gone is not None else pairs.select("_image", "_lose")


def row_boxes(boxes: DataFrame, image: str = "image_id", tolerance: float = 0.6, least: int = 2) -> DataFrame:
    """Boxes on the image's dominant row, left to right (``nth``); all of them if fewer than ``least`` would stay."""
    med = boxes.groupBy(image).agg(F.median((c("y0") + c("y1")) * 0.5).alias("_cy"), F.median(F.greatest(c("y1") - c("y0"), F.lit(1.0))).alias("_h"))
    j = boxes.join(med, image).withColumn("_on", F.abs((c("y0") + c("y1")) * 0.5 - c("_cy")) <= tolerance * c("_h"))
    j = j.withColumn("_n", F.count_if("_on").over(Window.partitionBy(image))).where(F.col("_on") | (F.col("_n") < least))
    return j.withColumn("nth", F.row_number().over(Window.partitionBy(image).orderBy("x0", "box_id"))).drop("_cy", "_h", "_on", "_n")


def route_clicks(boxes: DataFrame, clicks: DataFrame, image: str = "image_id") -> DataFrame:
    """Each click with the box it belongs to: the smallest that holds it, else the one with the nearest centre; the lowest
    box_id on a tie; null where the image has no box."""
    inside = c("x").between(c("x0"), c("x1")) & c("y").between(c("y0"), c("y1"))
    area = (c("x1") - c("x0")) * (c("y1") - c("y0"))
    away = F.hypot(c("x") - (c("x0") + c("x1")) / 2, c("y") - (c("y0") + c("y1")) / 2)
    j = clicks.join(boxes.select(image, "box_id", *BOX), image, "left")
    return j.groupBy(*clicks.columns).agg(F.min_by("box_id", F.struct(~inside, F.when(inside, area).otherwise(away), F.col("box_id"))).alias("box_id"))


def refine_boxes(boxes: DataFrame, share: float = 0.0, threshold: float = 0.9, row: bool = False) -> DataFrame:
    """clip, drop small, suppress overlaps, then the row filter if asked for."""
    out = nms(filter_small(clip_boxes(boxes), share), threshold=threshold)
    return row_boxes(out).drop("nth") if row else out


def prompts_for_images(images: DataFrame, per_image: DataFrame, defaults: DataFrame, kind: str = "boxes", apply: str = "all", ref: str | None = None) -> DataFrame:
    """Prompts of every image, in pixels.  ``per_image(name, ...)`` wins even if its list is empty (``has`` table of names);
    boxes: with apply 'ref' only the reference image takes the defaults; clicks: only apply 'all' gives defaults.

    per_image holds name and ``prompts`` (array of normalised structs); defaults is one row of ``prompts``."""
    j = images.join(per_image.select("name", F.col("prompts").alias("own")), "name", "left").crossJoin(F.broadcast(defaults.select(F.col("prompts").alias("shared"))))  # one row
    empty = F.slice("shared", 1, 0)
    default = F.when((F.lit(apply) == "ref") & (F.col("name") != F.lit(ref)), empty) if kind == "boxes" else F.when(F.lit(apply) != "all", empty)
    chosen = F.when(F.col("own").isNotNull(), F.col("own")).otherwise(default.otherwise(F.col("shared")))
    return j.select("name", "width", "height", chosen.alias("prompts"))
