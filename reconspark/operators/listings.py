"""Object listings: children of a prefix, image lists, pairings, sync plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.functions.geometry import base_name, c, mask_name

IMAGE = r"(?i)\.(jpe?g|png|tiff?)$"


def parent_prefix(prefix) -> F.Column:
    """One level above a ``gs://`` prefix: empty for the list of buckets, null above that."""
    body = F.regexp_replace(F.regexp_replace(F.trim(c(prefix)), "/+$", ""), "^gs:(//?|$)", "")
    above = F.concat(F.lit("gs://"), F.regexp_replace(body, "[^/]*$", ""))
    return F.when(body == "", F.lit(None).cast("string")).when(~body.contains("/"), "").otherwise(above)


def inventory_children(listing: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """One level below a prefix: sub-prefixes with their file counts, and ``''`` for the files right there (placeholders are out)."""
    rest = F.substring(c(key), len(prefix) + 1, 1 << 30)
    own = listing.where(c(key).startswith(prefix)).select(rest.alias("rest")).where("rest <> ''")
    child = F.when(F.col("rest").contains("/"), F.concat(F.split_part("rest", F.lit("/"), F.lit(1)), F.lit("/"))).otherwise("")
    return own.groupBy(child.alias("child")).agg(F.count_if(~F.col("rest").endswith("/")).alias("n_files"))


def list_images(listing: DataFrame, key: str = "key") -> DataFrame:
    return listing.where(c(key).rlike(IMAGE))


def layout(listing: DataFrame, key: str = "key") -> DataFrame:
    """single (all in one folder or none), multi (one level of folders) or nested (deeper), from aggregates over the names."""
    depth = F.size(F.split(c(key), "/")) - 1
    a = list_images(listing, key).agg(F.max(depth).alias("d"), F.count_distinct(F.split_part(c(key), F.lit("/"), F.lit(1))).alias("n"), F.count("*").alias("n_images"))
    return a.select(F.when(F.col("d") > 1, "nested").when((F.col("d") == 1) & (F.col("n") > 1), "multi").otherwise("single").alias("layout"), "n_images")


def pair_masks(images: DataFrame, masks: DataFrame, name: str = "name") -> DataFrame:
    """Images and masks by relative path without extension, both kinds of orphan included; of images with one key the first wins."""
    key = F.regexp_replace(c(name), r"(?<=[^/])\.[^./]*$", "").alias("key")
    i = images.groupBy(key).agg(F.min(name).alias("image"))
    m = masks.groupBy(key).agg(F.min(name).alias("mask"))
    return i.join(m, "key", "full_outer")


def masks_for(images: DataFrame, masks: DataFrame, name: str = "name") -> DataFrame:
    """The mask at the same place with ``.png``, else a flat one of the base name."""
    m = masks.select(F.col(name).alias("mask")).distinct()
    own, flat = mask_name(name), mask_name(base_name(name))
    j = images.select(name, own.alias("own"), flat.alias("flat")).join(m.withColumnRenamed("mask", "own_mask"), F.col("own") == F.col("own_mask"), "left").join(m.withColumnRenamed("mask", "flat_mask"), F.col("flat") == F.col("flat_mask"), "left")
    return j.select(name, F.coalesce("own_mask", "flat_mask").alias("mask"))


def outputs_complete(sources: DataFrame, outputs: DataFrame, modes: list[str], name: str = "name") -> DataFrame:
    """Per mode: images without an output ``<mode>/<path>.png``, and whether none is missing (never for an empty source)."""
    want = sources.select(F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"), c(name).alias("image"))
    want = want.withColumn("key", F.concat("mode", F.lit("/"), mask_name("image")))
    have = outputs.select(c(name).alias("key"), F.lit(1).alias("has")).distinct()
    return want.join(have, "key", "left").groupBy("mode").agg(F.count("*").alias("n"), (F.count("*") - F.count("has")).alias("n_missing")).withColumn("complete", F.col("n_missing") == 0)


def sync_plan(src: DataFrame, dst: DataFrame, delete: bool = False) -> DataFrame:
    """key and action: copy what is new or changed (size or md5), delete what only the destination has if asked for."""
    j = src.select("key", F.col("size").alias("s_size"), F.col("md5").alias("s_md5"), F.lit(1).alias("s")).join(dst.select("key", F.col("size").alias("d_size"), F.col("md5").alias("d_md5"), F.lit(1).alias("d")), "key", "full_outer")
    same = F.col("s_size").eqNullSafe(F.col("d_size")) & F.col("s_md5").eqNullSafe(F.col("d_md5"))
    action = F.when(F.col("s").isNull(), F.lit("delete" if delete else "keep")).when(F.col("d").isNull(), "new").when(~same, "changed").otherwise("same")
    return j.select("key", action.alias("action"))


def common_parent_plan(paths: DataFrame, root: str, path: str = "path") -> DataFrame:
    """dest = root / last folder that all paths share / what remains of each."""
    parts = paths.select(F.col(path).alias("path"), F.split(path, "/").alias("p"))
    at = parts.select("path", F.posexplode(F.slice("p", 1, F.size("p") - 1)).alias("i", "part"))
    n = parts.agg(F.count_distinct("path").alias("n"))
    level = at.groupBy("i").agg(F.count_distinct("part").alias("k"), F.count_distinct("path").alias("have"), F.max("part").alias("part")).crossJoin(F.broadcast(n))  # one row
    first_bad = level.agg(F.min(F.when((F.col("k") > 1) | (F.col("have") < F.col("n")), F.col("i"))).alias("bad"), F.max("i").alias("top"))
    shared = first_bad.select(F.coalesce("bad", F.col("top") + 1).alias("depth"))
    j = parts.crossJoin(F.broadcast(shared))  # one row
    rest = F.array_join(F.slice("p", F.greatest("depth", F.lit(1)), F.size("p")), "/")
    return j.select("path", F.concat(F.lit(root.rstrip("/") + "/"), rest).alias("dest"))


def pass_summary(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Per input pass: images, images with a mask, different sizes, the most common size."""
    have = masks_for(images.select("name"), masks)
    j = images.join(have, "name")
    sizes = j.groupBy("pass", "width", "height").agg(F.count("*").alias("k"), F.count("mask").alias("m"))
    return sizes.groupBy("pass").agg(F.sum("k").alias("n_images"), F.sum("m").alias("n_masks"), F.count("*").alias("n_sizes"), F.max_by(F.concat_ws("x", "width", "height"), F.struct("k", "width", "height")).alias("common_size"))


def newest(outputs: DataFrame, n: int, key: str = "key", time: str = "mtime") -> DataFrame:
    """The n newest outputs, each with ``total``: how many there are."""
    total = outputs.agg(F.count("*").alias("total"))  # one row
    return outputs.orderBy(F.desc(time), key).limit(n).crossJoin(F.broadcast(total))


def trained_file(outputs: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """The file of the highest iteration in its path's digits."""
    iteration = F.regexp_extract(c(path), r"iteration_(\d+)", 1).try_cast("long")
    return outputs.withColumn("iteration", iteration).where("iteration IS NOT NULL").groupBy(*keys).agg(F.max_by(F.struct(path, "iteration"), F.struct("iteration", path)).alias("m")).select(*keys, "m.*")
