"""Grouping the images of a multi-camera rig into exposures."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconspark.functions.geometry import base_name, camera_center, first_folder, rotation, stem
from reconspark.operators.frames import dealt, kept
from reconspark.operators.spatial import within

EARTH = 6371000.0


def _keyed(names: DataFrame, name: str, cam, frame) -> tuple[DataFrame, DataFrame]:
    both = names.select(F.col(name).alias("name"), cam.alias("camera"), frame.alias("frame_key"))
    bad = (F.coalesce(F.col("camera"), F.lit("")) == "") | (F.coalesce(F.col("frame_key"), F.lit("")) == "")
    # A repeated (camera, frame) keeps its last name in order.
    rig = both.where(~bad).groupBy("camera", "frame_key").agg(F.max("name").alias("name"))
    return rig, both.where(bad).select("name")


def group_by_folder(names: DataFrame, name: str = "name"):
    """camera = first folder, frame = the rest of the path.  Returns rig(camera, frame_key, name) and unmatched(name)."""
    return _keyed(names, name, first_folder(name), F.regexp_extract(name, r"^[^/]*/(.+)$", 1))


def group_by_regex(names: DataFrame, pattern: str, name: str = "name"):
    """Named groups ``cam`` and ``frame`` of a pattern, on the base name first and then on the whole name."""
    groups = re.compile(pattern).groupindex
    missing = {"cam", "frame"} - set(groups)
    if missing:
        raise ValueError(f"the pattern lacks the named groups {sorted(missing)}")
    java = pattern.replace("(?P<", "(?<")
    get = lambda key: F.when(base_name(name).rlike(java), F.regexp_extract(base_name(name), java, groups[key])).otherwise(F.regexp_extract(name, java, groups[key]))
    return _keyed(names, name, get("cam"), get("frame"))


def filename_camera(name) -> F.Column:
    """The leading non-digit run of the base name, before an optional separator and a digit."""
    return F.regexp_replace(F.regexp_extract(base_name(name), r"^([^\d]+?)[-_]?\d", 1), r"^[-_]+|[-_]+$", "")


#: Cameras in a mask of a long.
MASK = 63
#: Rows of a table of cameras that is broadcast.
FEW_CAMERAS = 10_000


def digit_fields(name: str = "name") -> F.Column:
    """The runs of digits of a name's stem."""
    return F.regexp_extract_all(stem(name), F.lit(r"(\d+)"), F.lit(1))


def auto_frame_key(cameras: DataFrame, fields: str | None = None) -> DataFrame:
    """``cameras(camera, name)`` to one row (combo, shared): the digit fields of the stem that identify an exposure.

    Candidates are single fields and pairs below the least field count; the score is how many keys all cameras share; the first
    best wins, singles before pairs.  Keys of all candidates are counted in one aggregation: cameras are numbered, a key's cameras are bits
    of masks, and tasks merge masks before they move.  ``fields`` names a column that has the digit fields already.
    """
    toks = cameras.select("camera", (F.col(fields) if fields else digit_fields()).alias("t"))
    if not fields:
        toks = kept(toks)
    numbers = toks.groupBy("camera").agg(F.min(F.size("t")).alias("least"))  # one row a camera
    numbers = numbers.select("camera", (F.row_number().over(Window.orderBy("camera")) - 1).alias("number"), F.min("least").over(Window.partitionBy()).alias("least"), F.count("*").over(Window.partitionBy()).cast("int").alias("n_cameras"))
    i = F.sequence(F.lit(0), F.col("least") - 1)
    singles = F.transform(i, lambda a: F.array(a))
    pairs = F.flatten(F.transform(i, lambda a: F.transform(F.filter(i, lambda b: b > a), lambda b: F.array(a, b))))
    # The candidates stand once with each camera; its table is broadcast up to FEW_CAMERAS rows.
    numbers = kept(numbers.where("least > 0 AND n_cameras > 1").select("camera", "number", "n_cameras", F.concat(singles, pairs).alias("combos")))
    n_cameras = numbers.count()
    numbered = toks.join(F.broadcast(numbers) if n_cameras <= FEW_CAMERAS else numbers, "camera")
    keys = numbered.select("number", "n_cameras", "t", F.posexplode("combos").alias("rank", "combo"))  # a few fields, squared
    keys = keys.select("rank", F.col("combo")[0].alias("a"), F.get("combo", F.lit(1)).alias("b"), "t", "number", "n_cameras")
    keys = keys.select("rank", "a", "b", F.concat_ws("_", F.get("t", F.col("a")), F.get("t", F.col("b"))).alias("key"), "number", "n_cameras")
    word, bit = F.floor(F.col("number") / MASK).cast("int"), F.expr(f"shiftleft(1L, number % {MASK})")
    if n_cameras <= MASK:  # one mask holds them all, so keys move once and no task holds them twice
        held = keys.groupBy("rank", "a", "b", "key").agg(F.bit_count(F.bit_or(bit)).alias("c"), F.max("n_cameras").alias("n")).where("c = n")
    else:
        masks = keys.groupBy("rank", "a", "b", "key", word.alias("word")).agg(F.bit_or(bit).alias("mask"), F.max("n_cameras").alias("n"))
        held = masks.groupBy("rank", "a", "b", "key").agg(F.sum(F.bit_count("mask")).alias("c"), F.max("n").alias("n")).where("c = n")
    shared = held.groupBy("rank", "a", "b").agg(F.count("*").alias("shared"))
    return shared.orderBy(F.desc("shared"), "rank").limit(1).select(F.array_compact(F.array("a", "b")).alias("combo"), "shared")


def group_auto(names: DataFrame, name: str = "name"):
    """Cameras by folder, or by file-name prefix where there is one folder only; frames by ``auto_frame_key``.

    A key that repeats within a camera is dropped for all cameras.  Names are taken apart once, into a table spread by name and number of rows (one file
    would be one task, and the names left over are found in it by name) that every step reads."""
    every = kept(dealt(names.select(F.col(name).alias("name")), names.count(), "name").select("name", F.nullif(first_folder("name"), F.lit("")).alias("folder"), filename_camera("name").alias("prefix"), digit_fields("name").alias("fields")))
    facts = every.agg(F.count_distinct("folder").alias("folders"), F.count_distinct(F.when(F.col("prefix") != "", F.col("prefix"))).alias("prefixes"), F.count_if(F.col("prefix") == "").alias("bare"))
    by_folder, by_prefix = F.col("folders") >= 2, (F.col("folders") < 2) & (F.col("prefixes") >= 2) & (F.col("bare") == 0)
    cams = every.crossJoin(F.broadcast(facts)).select("name", "fields", F.when(by_folder, F.col("folder")).when(by_prefix, F.col("prefix")).alias("camera"))  # one row
    combo = kept(auto_frame_key(cams.where("camera IS NOT NULL"), "fields"))
    keyed = cams.where("camera IS NOT NULL").crossJoin(F.broadcast(combo)).select("camera", "name", F.array_join(F.transform("combo", lambda k: F.get("fields", k)), "_").alias("frame_key"))  # one row
    frames = keyed.groupBy("camera", "frame_key").agg(F.count("*").alias("n"), F.min("name").alias("name"))
    rig = frames.where("n = 1").join(frames.where("n > 1").select("frame_key").distinct(), "frame_key", "left_anti").select("camera", "frame_key", "name")
    return rig, every.select("name").join(rig.select("name"), "name", "left_anti")


def group_by_gps(fixes: DataFrame, tolerance: float = 0.5):
    """``fixes(name, lat, lon)``: images join the nearest image of the anchor camera within the tolerance in metres; of equal
    distances the last anchor wins; the anchor's stem is the frame.  The anchor camera has most images."""
    own = fixes.select("name", first_folder("name").alias("camera"), "lat", "lon")
    cams = own.where("camera <> '' AND lat IS NOT NULL AND lon IS NOT NULL")
    anchor = cams.groupBy("camera").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "camera").limit(1).select(F.col("camera").alias("anchor_camera"))
    # For the grid: degrees to metres, longitudes by the largest latitude in use, so no pair within the tolerance is missed.
    scale = F.radians(F.lit(1.0)) * EARTH
    flat = cams.crossJoin(F.broadcast(cams.agg(F.max(F.abs("lat")).alias("top"))))  # one row
    flat = flat.select("name", "camera", "lat", "lon", (F.col("lat") * scale).alias("gn"), (F.col("lon") * scale * F.cos(F.radians("top"))).alias("ge"))
    anchors = flat.join(F.broadcast(anchor), F.col("camera") == F.col("anchor_camera"), "left_semi").select(F.col("name").alias("anchor"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.col("gn").alias("an"), F.col("ge").alias("ae"))
    pairs = within(flat, anchors, ("gn", "ge"), ("an", "ae"), tolerance * 1.001)
    dx = F.radians(F.col("a_lon") - F.col("lon")) * F.cos(F.radians((F.col("lat") + F.col("a_lat")) / 2)) * EARTH
    dy = F.radians(F.col("a_lat") - F.col("lat")) * EARTH
    near = pairs.withColumn("metres", F.hypot(dx, dy)).where(F.col("metres") <= tolerance)
    best = near.groupBy("camera", "name").agg(F.max_by("anchor", F.struct(-F.col("metres"), F.col("anchor"))).alias("anchor"))
    rig = best.groupBy("camera", stem("anchor").alias("frame_key")).agg(F.max("name").alias("name"))
    return rig, fixes.select("name").join(best.select("name"), "name", "left_anti")


def rig_summary(rig: DataFrame) -> DataFrame:
    """Frames, how many all cameras have, how many not; weak if under half are complete."""
    n_cams = rig.agg(F.count_distinct("camera").alias("n_cameras"))
    frames = rig.groupBy("frame_key").agg(F.count_distinct("camera").alias("c"))
    out = frames.crossJoin(F.broadcast(n_cams)).agg(F.count("*").alias("n_frames"), F.count_if(F.col("c") == F.col("n_cameras")).alias("n_complete"), F.max("n_cameras").alias("n_cameras"))  # one row
    return out.withColumn("n_partial", F.col("n_frames") - F.col("n_complete")).withColumn("weak", F.col("n_complete") < 0.5 * F.col("n_frames"))


def rig_cameras(rig: DataFrame) -> DataFrame:
    """(camera, n_images, n_frames) of each camera of a rig."""
    return rig.groupBy("camera").agg(F.count_distinct("name").alias("n_images"), F.count_distinct("frame_key").alias("n_frames"))


def recommend_ref(rig: DataFrame, eo_stems: DataFrame | None = None) -> DataFrame:
    """The camera with most stems in the survey table, else with most frames; the first name on a tie."""
    own = rig.withColumn("stem", stem("name"))
    if eo_stems is not None:
        own = own.join(eo_stems.select("stem", F.lit(1).alias("hit")).distinct(), "stem", "left")
    else:
        own = own.withColumn("hit", F.lit(None).cast("int"))
    return own.groupBy("camera").agg(F.count("hit").alias("hits"), F.count("*").alias("frames")).orderBy(F.desc("hits"), F.desc("frames"), "camera").limit(1)


def colocation(rig: DataFrame, poses: DataFrame, ref: str, certificate: DataFrame | None = None, lever_arm_m: float = 0.5, colocation_m: float = 0.5) -> DataFrame:
    """Per camera: mean offset from the reference camera of the same frame, in the reference camera's axes, and its largest spread.

    ``poses(name, qw, qx, qy, qz, tx, ty, tz)`` map world to camera.  Offsets in world axes turn with the heading: on strips flown both ways they
    cancel, so each is turned by its frame's reference image first.  ``certificate(camera, x, y, z)``: the measured lever arm of
    a camera, in the same axes; ``error`` is the mean's distance from it and fails above ``lever_arm_m``; a camera without one fails
    where the mean offset is longer than ``colocation_m``.
    """
    q = ("qw", "qx", "qy", "qz")
    at = rig.join(poses, "name").select("camera", "frame_key", F.struct(*q).alias("q"), *[v.alias(n) for n, v in zip("xyz", camera_center(q, ("tx", "ty", "tz")))])
    base = at.where(F.col("camera") == ref).select("frame_key", F.col("q").alias("rq"), *[F.col(v).alias(f"r{v}") for v in "xyz"])
    turn = rotation(*[F.col(f"rq.{v}") for v in q])
    away = [F.col(v) - F.col(f"r{v}") for v in "xyz"]
    off = at.where(F.col("camera") != ref).join(base, "frame_key").select("camera", *[(turn[i][0] * away[0] + turn[i][1] * away[1] + turn[i][2] * away[2]).alias(f"d{v}") for i, v in enumerate("xyz")])
    mean = off.groupBy("camera").agg(F.count("*").alias("n"), *[F.avg(f"d{v}").alias(f"m{v}") for v in "xyz"])
    length = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    spread = off.join(mean, "camera").groupBy("camera").agg(F.max("n").alias("n"), *[F.max(f"m{v}").alias(f"m{v}") for v in "xyz"], F.max(length([F.col(f"d{v}") - F.col(f"m{v}") for v in "xyz"])).alias("spread"))
    out = spread.withColumn("offset", length([F.col(f"m{v}") for v in "xyz"]))
    if certificate is None:
        return out.withColumn("error", F.lit(None).cast("double")).withColumn("fails", F.col("offset") > colocation_m)
    told = out.join(certificate.select("camera", *[F.col(v).alias(f"c{v}") for v in "xyz"]), "camera", "left")
    told = told.withColumn("error", length([F.col(f"m{v}") - F.col(f"c{v}") for v in "xyz"])).drop("cx", "cy", "cz")
    return told.withColumn("fails", F.when(F.col("error").isNotNull(), F.col("error") > lever_arm_m).otherwise(F.col("offset") > colocation_m))
