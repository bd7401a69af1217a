"""The driver's tables in the shapes that the operators take, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); a local one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="scratch-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def images(spark, d):
    name = F.concat("o_orderpriority", F.lit("/img_"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.lit(".jpg"))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), (F.col("o_custkey") % 7).alias("camera_id"), F.col("o_orderpriority").alias("folder"), name.alias("name"))


def observations(spark, d):
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.when(F.col("l_linenumber") != 3, F.col("l_partkey")).alias("point_id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


def points(spark, d):
    return t(spark, d, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 10).alias("y"), (F.col("p_partkey") % 97).cast("double").alias("z"), (F.col("p_size") / 10.0).alias("error"))


def poses(spark, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("camera_id"), *[e(i).alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz", "tx", "ty", "tz"))])


def cloud(spark, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("label").alias("folder"), *[(e(i) * 100).alias(n) for i, n in enumerate(("x", "y", "z"))], *[(e(i) * 100 + e(i + 3)).alias(n) for i, n in enumerate(("dx", "dy", "dz"))])


def frames(spark, d):
    return t(spark, d, "events").select(F.col("user_id").alias("video"), F.lpad(F.col("event_id").cast("string"), 8, "0").alias("name"), F.when(F.col("event_id") % 37 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("score"))


def boxes(spark, d):
    a = t(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount").distinct()
    return a.select(F.col("l_orderkey").alias("image_id"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("box_id"), (F.col("l_partkey") % 50).cast("double").alias("x0"), (F.col("l_suppkey") % 40).cast("double").alias("y0"), ((F.col("l_partkey") % 50) + F.col("l_quantity") - 10).alias("x1"), ((F.col("l_suppkey") % 40) + F.col("l_quantity") / 2).alias("y1"), (F.col("l_discount") + F.col("l_quantity") / 1000).alias("score"), F.lit(60).alias("width"), F.lit(48).alias("height"))


def listing(spark, d):
    key = F.regexp_replace("url", r"^https?://", "")
    return t(spark, d, "pages").select(key.alias("key"), F.length("html").cast("long").alias("size"), F.md5("html").alias("md5"), F.col("page_id").alias("mtime"))


def jobs(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("failed")
    return t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("kind"), status.alias("status"), F.concat(F.lit("job "), F.col("o_custkey").cast("string")).alias("title"), F.concat(F.lit("/data/"), F.col("o_custkey").cast("string")).alias("subtitle"), F.unix_timestamp("o_orderdate").alias("created_at"), F.concat(F.lit("w"), (F.col("o_custkey") % 20).cast("string")).alias("workspace"))


def log_lines(spark, d):
    kinds = F.col("event_type")
    n, v = (F.col("event_id") % 9).cast("string"), F.floor("value").cast("string")
    line = (
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("=== [12:00:00] feature_extractor "), kinds))
        .when(F.col("event_id") % 7 == 1, F.concat(F.lit("=== [12:00:01] exhaustive_matcher "), kinds))
        .when(F.col("event_id") % 7 == 2, F.concat(F.lit("=== [12:00:02] colmap mapper "), kinds))
        .when(F.col("event_id") % 7 == 3, F.concat(F.lit("-> "), n, F.lit(" kept / "), v, F.lit(" dropped")))
        .when(F.col("event_id") % 7 == 4, F.concat(v, F.lit("%|##| 3 it/s")))
        .when((F.col("event_id") % 7 == 5) & (F.col("event_id") % 11 == 0), "skip simplify")
        .when(F.col("event_id") % 7 == 5, F.concat(F.lit("######## ["), n, F.lit("/9]")))
        .when(F.col("event_id") % 13 == 0, "=== [12:30:00] done. workspace=x")
        .otherwise(F.concat(F.lit("add_exif_item_to_spec: didn't know how to process "), v))
    )
    return t(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), "ts", line.alias("line"))


_V, _N = "CAST(CAST(floor(value) AS BIGINT) AS STRING)", "CAST(event_id % 9 AS STRING)"
#: What each kind of job prints, one template for each remainder of the event's id; read by Spark and DuckDB alike.
KIND_LINES = {
    "frames": [f"concat('Found ', {_V}, ' video files')", f"concat('######## [', {_N}, '/9] clip')", f"concat('-> ', {_N}, ' kept / ', {_V}, ' dropped')", "'opened'"],
    "train": [
        "'Loading train cameras'", f"concat('Training progress: ', {_V}, '/30000 [00:0', {_N}, '<01:00, Loss=0.1', {_N}, ']')", f"concat({_V}, '/7000 | Loss: 0.0', {_N}, ' | Splats: 100')", f"concat('[ITER ', {_V}, '] loss: 0.2', {_N})",
        "'Loading COLMAP dataset'", f"concat('Loading test cameras: ', {_N}, '/245 [')", "CASE WHEN user_id % 3 = 0 THEN 'Training complete!' ELSE 'Saving checkpoint' END",
    ],
    "mesh": [
        "'Found 12 cameras'", f"concat('Num vertices post: ', {_V})", f"concat('[mesh] result: /w/', {_V}, '.ply')", f"concat('[mesh] scaled result: /w/', {_V}, '_mm.ply mm_per_unit=', {_N}, '.5')", f"concat('[texture] obj: /t/', {_V}, '.obj')",
        f"concat('[texture] scaled glb: /t/', {_V}, '_mm.glb')", f"concat('[texture] atlas: /t/', {_N}, '.png')", "'Extracting mesh from TSDF'", "'pass 1/2'", f"concat('[texture] glb: /t/', {_V}, '.glb')", f"concat('[texture] scaled obj: /t/', {_V}, '_mm.obj')",
    ],
    "gcs": ["'Building synchronization state...'", f"CASE WHEN user_id % 3 = 0 THEN 'Starting synchronization' ELSE concat('Copying gs://b/', {_V}) END", f"CASE WHEN user_id % 3 = 1 THEN concat('Operation completed over ', {_V}, ' objects/', {_N}, '.5 MiB.') ELSE 'idle' END"],
    "depth": [f"concat('Images: ', {_V}, ' under /d/', {_N})", f"concat('[', {_N}, '/9] a.jpg')", f"concat('Done. processed=', {_V}, ' skipped=', {_N})", "'warming up'"],
    "matte": [f"concat('Images: ', {_V}, ' under /d/', {_N})", f"concat('[', {_N}, '/9] a.jpg boxes=', {_V})", "'[warn] no boxes for a.jpg'", f"concat('Done. processed=', {_V}, ' skipped=', {_N})"],
    "blocksplit": [f"concat('[blocksplit] block_', {_N}, '_', CAST(event_id % 2 AS STRING), ': 12 images → ', {_V}, ' views')", "'[blocksplit] planning'"],
}


def _kind_line(kind: str) -> str:
    return "CASE event_id % " + str(len(KIND_LINES[kind])) + " " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(KIND_LINES[kind])) + " END"


def kind_lines(spark, d, kind):
    return t(spark, d, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), F.expr(_kind_line(kind)).alias("line"))


CTE = {
    "images": "SELECT o_orderkey AS image_id, o_custkey % 7 AS camera_id, o_orderpriority AS folder, o_orderpriority || '/img_' || lpad(o_orderkey::VARCHAR, 8, '0') || '.jpg' AS name FROM orders",
    "obs": "SELECT l_orderkey AS image_id, CASE WHEN l_linenumber <> 3 THEN l_partkey END AS point_id, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem",
    "pts": "SELECT p_partkey AS point_id, p_size::DOUBLE AS x, p_retailprice / 10 AS y, (p_partkey % 97)::DOUBLE AS z, p_size / 10.0::DOUBLE AS error FROM part",
    "poses": "SELECT vec_id AS image_id, label AS camera_id, embedding[1]::DOUBLE AS qw, embedding[2]::DOUBLE AS qx, embedding[3]::DOUBLE AS qy, embedding[4]::DOUBLE AS qz, embedding[5]::DOUBLE AS tx, embedding[6]::DOUBLE AS ty, embedding[7]::DOUBLE AS tz FROM embeddings",
    "cloud": "SELECT vec_id AS image_id, label AS folder, embedding[1]::DOUBLE * 100 AS x, embedding[2]::DOUBLE * 100 AS y, embedding[3]::DOUBLE * 100 AS z, embedding[1]::DOUBLE * 100 + embedding[4]::DOUBLE AS dx, embedding[2]::DOUBLE * 100 + embedding[5]::DOUBLE AS dy, embedding[3]::DOUBLE * 100 + embedding[6]::DOUBLE AS dz FROM embeddings",
    "frames": "SELECT user_id AS video, lpad(event_id::VARCHAR, 8, '0') AS name, CASE WHEN event_id % 37 = 0 THEN 'NaN'::DOUBLE ELSE value END AS score FROM events",
    "boxes": "SELECT l_orderkey AS image_id, l_partkey * 1000 + l_suppkey AS box_id, (l_partkey % 50)::DOUBLE AS x0, (l_suppkey % 40)::DOUBLE AS y0, (l_partkey % 50) + l_quantity - 10 AS x1, (l_suppkey % 40) + l_quantity / 2 AS y1, l_discount + l_quantity / 1000 AS score, 60 AS width, 48 AS height FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_quantity, l_discount FROM lineitem)",
    "listing": "SELECT regexp_replace(url, '^https?://', '') AS key, length(html)::BIGINT AS size, md5(html) AS md5, page_id AS mtime FROM pages",
    "jobs": "SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS kind, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'failed' END AS status, 'job ' || o_custkey AS title, '/data/' || o_custkey AS subtitle, epoch(o_orderdate)::BIGINT AS created_at, 'w' || (o_custkey % 20) AS workspace FROM orders",
    "lines": """SELECT user_id::VARCHAR AS job_id, event_id AS seq, ts, CASE WHEN event_id % 7 = 0 THEN '=== [12:00:00] feature_extractor ' || event_type WHEN event_id % 7 = 1 THEN '=== [12:00:01] exhaustive_matcher ' || event_type
      WHEN event_id % 7 = 2 THEN '=== [12:00:02] colmap mapper ' || event_type WHEN event_id % 7 = 3 THEN '-> ' || (event_id % 9) || ' kept / ' || floor(value)::BIGINT || ' dropped' WHEN event_id % 7 = 4 THEN floor(value)::BIGINT || '%|##| 3 it/s'
      WHEN event_id % 7 = 5 AND event_id % 11 = 0 THEN 'skip simplify' WHEN event_id % 7 = 5 THEN '######## [' || (event_id % 9) || '/9]' WHEN event_id % 13 = 0 THEN '=== [12:30:00] done. workspace=x' ELSE 'add_exif_item_to_spec: didn''t know how to process ' || floor(value)::BIGINT END AS line FROM events""",
}


CTE |= {f"{kind}_lines": f"SELECT user_id::VARCHAR AS job_id, event_id AS seq, {_kind_line(kind)} AS line FROM events" for kind in KIND_LINES}


def sql(names: str, body: str) -> str:
    """A query over the named inputs."""
    return "WITH " + ", ".join(f"{n} AS ({CTE[n]})" for n in names.split()) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().removeprefix("+")
