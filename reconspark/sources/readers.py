"""Reading and writing models, survey tables, logs, jobs and blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconspark.operators.jobs import settle_stale
from reconspark.functions.geometry import c, stem

#: Accepted header names in order of preference, as letters and digits only.
EO_HEADERS = {
    "id": ("id", "name", "image", "imageid", "photo"),
    "easting": ("easting", "x", "e"),
    "northing": ("northing", "y", "n"),
    "height": ("ellipsoidheight", "height", "z", "alt", "altitude", "h"),
    "omega": ("omega", "o"),
    "phi": ("phi", "p"),
    "kappa": ("kappa", "k"),
}
JOB_SCHEMA = "id string, kind string, title string, subtitle string, params map<string,string>, meta map<string,string>, status string, created_at double, started_at double, finished_at double, error string, current_stage string, stage_status map<string,string>"


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    """cameras.txt of any number of models: camera_id, model, width, height, params, and the file's path."""
    t = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> '' AND NOT trim(value) LIKE '#%'")
    return lines.select("file", t[0].cast("long").alias("camera_id"), t[1].alias("model"), t[2].cast("long").alias("width"), t[3].cast("long").alias("height"), F.transform(F.slice(t, 5, 100), lambda v: v.cast("double")).alias("params"))


def read_points(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """points3D.txt: points, and their tracks as observations (image_id, idx, point_id)."""
    t = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> '' AND NOT trim(value) LIKE '#%'").withColumn("t", t)
    g = lambda i: F.col("t")[i]
    points = lines.select("file", g(0).cast("long").alias("point_id"), *[g(i + 1).cast("double").alias(v) for i, v in enumerate("xyz")], *[g(i + 4).cast("short").alias(v) for i, v in enumerate("rgb")], g(7).cast("double").alias("error"))
    n = F.size("t")
    pairs = F.when(n >= 10, F.transform(F.sequence(F.lit(8), n - 2, F.lit(2)), lambda i: F.struct(F.get("t", i).cast("long").alias("image_id"), F.get("t", i + 1).cast("int").alias("idx"))))
    tracks = lines.select("file", g(0).cast("long").alias("point_id"), F.explode(pairs).alias("o")).select("file", "point_id", "o.image_id", "o.idx")
    return points, tracks


def read_images(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """images.txt: poses, and observations (image_id, idx, x, y, point_id; -1 becomes null).

    An image is a pair of lines, the second of which may be empty.  Files are read by line and split like any other: a line's
    place is the file, the offset of its split, and its order within the split; lines are counted per split, and
    pairs are made by their number in the file.
    """
    # The text reader hands out a split's lines in order, so these ids grow along it.
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("order"))
    lines = lines.where(~F.col("value").startswith("#"))
    counts = lines.groupBy("file", "split").agg(F.count("*").alias("n"))
    before = counts.select("file", "split", (F.sum("n").over(Window.partitionBy("file").orderBy("split")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("file", "split").orderBy("order")) - 1
    placed = lines.withColumn("place", place).join(before, ["file", "split"]).withColumn("nth", F.col("place") + F.col("before"))
    text = lambda odd: F.max(F.when(F.col("nth") % 2 == odd, F.col("value")))
    pairs = placed.groupBy("file", F.floor(F.col("nth") / 2).alias("pair")).agg(text(0).alias("head"), text(1).alias("body")).where("trim(head) <> ''")
    h = F.split(F.trim("head"), r"\s+", 10)
    names = ["qw", "qx", "qy", "qz", "tx", "ty", "tz"]
    heads = pairs.select("file", "body", h.alias("h")).select("file", "body", F.col("h")[0].cast("long").alias("image_id"), *[F.col("h")[i + 1].cast("double").alias(n) for i, n in enumerate(names)], F.col("h")[8].cast("long").alias("camera_id"), F.col("h")[9].alias("name"))
    b = F.filter(F.split(F.coalesce("body", F.lit("")), r"\s+"), lambda v: v != "")
    obs = heads.select("file", "image_id", b.alias("b")).where(F.size("b") >= 3)
    obs = obs.select("file", "image_id", "b", F.posexplode(F.sequence(F.lit(0), F.size("b") - 3, F.lit(3))).alias("idx", "at"))
    point = F.get("b", F.col("at") + 2).cast("long")
    obs = obs.select("file", "image_id", "idx", F.get("b", F.col("at")).cast("double").alias("x"), F.get("b", F.col("at") + 1).cast("double").alias("y"), F.when(point >= 0, point).alias("point_id"))
    return heads.drop("body"), obs


def read_eo_csv(spark: SparkSession, path: str) -> DataFrame:
    """Survey rows by header names whatever their case and punctuation; blank ids are skipped.

    A missing column, a bad number or a table without rows is an error."""
    raw = spark.read.csv(path, header=True)
    plain = {"".join(ch for ch in h.lower().lstrip("\ufeff") if ch.isalnum()): h for h in reversed(raw.columns)}
    chosen = {k: next((plain[n] for n in names if n in plain), None) for k, names in EO_HEADERS.items()}
    missing = [k for k, v in chosen.items() if v is None]
    if missing:
        raise ValueError(f"missing columns {missing}; the header has {raw.columns}")
    col = lambda k: F.col(f"`{chosen[k]}`")
    own = raw.where(F.trim(F.coalesce(col("id"), F.lit(""))) != "")
    if own.isEmpty():
        raise ValueError("no data rows")
    number = lambda k: F.coalesce(F.trim(col(k)).try_cast("double"), F.raise_error(F.concat(F.lit(f"bad {k} of "), col("id"))).cast("double")).alias(k)
    return own.select(stem(F.trim(col("id"))).alias("stem"), *[number(k) for k in list(EO_HEADERS)[1:]])


def scores_from_log(lines: DataFrame, frames: DataFrame, key: str = "video", seq: str = "seq", line: str = "line") -> DataFrame:
    """The n-th score of a log is the n-th frame's; an unreadable one is NaN.  Counts that differ are an error, never a shift."""
    per = Window.partitionBy(key)
    text = F.regexp_extract(c(line), r"(?i)\bblur:\s*(\S+)", 1)
    scored = lines.where(c(line).contains("blurdetect") & (text != "")).select(key, F.coalesce(text.try_cast("double"), F.lit(float("nan"))).alias("score"), F.row_number().over(per.orderBy(seq)).alias("nth"))
    numbered = frames.select(key, "file", F.row_number().over(per.orderBy("file")).alias("nth"))
    j = numbered.join(scored.withColumn("has", F.lit(1)), [key, "nth"], "full_outer")
    bad = F.col("file").isNull() | F.col("has").isNull()
    return j.select(key, "nth", "file", F.when(bad, F.raise_error(F.concat(F.lit("scores and frames differ in number: "), F.col(key).cast("string"))).cast("double")).otherwise(F.col("score")).alias("score"))


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Job records: unknown fields go, missing ones are null, malformed records are skipped, stale ones have failed."""
    return settle_stale(spark.read.schema(JOB_SCHEMA).json(path, mode="DROPMALFORMED", multiLine=True).where("id IS NOT NULL"))


def write_frame_report(selected: DataFrame, path: str) -> None:
    """Rows as CSV and counts as JSON, in folders beneath the path."""
    from reconspark.operators.frames import frame_quality_counts

    selected.select("video", "name", "score", "decision").write.csv(f"{path}/frames", header=True)
    frame_quality_counts(selected).write.json(f"{path}/summary")


def write_blocks(tables: dict[str, DataFrame], manifest: DataFrame, path: str) -> None:
    """Each table by block, and the manifest; an existing output is refused."""
    for name, df in tables.items():
        df.write.mode("errorifexists").partitionBy("block").parquet(f"{path}/{name}")
    manifest.write.mode("errorifexists").json(f"{path}/manifest")


def tail_logs(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Console lines as a stream of text files, a bounded number of files a batch."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def last_bytes(lines: DataFrame, n_bytes: int, key: str = "job_id", seq: str = "seq", line: str = "line") -> DataFrame:
    """The lines of each job that lie in its last ``n_bytes`` bytes, line ends included."""
    back = Window.partitionBy(key).orderBy(F.desc(seq)).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("_b", F.sum(F.octet_length(line) + 1).over(back)).where(F.col("_b") <= n_bytes).drop("_b")


def replay_then_follow(spark: SparkSession, path: str, n_bytes: int, seen_path: str, schema: str = "job_id string, seq long, ts timestamp, line string", max_files: int = 100) -> tuple[DataFrame, DataFrame]:
    """The last ``n_bytes`` of each job's log now, and a stream of the lines after them.

    A log is a folder of JSON lines files that only grows.  What is there now is noted as the last line number of each job
    (a table at ``seen_path``, in the shared folder); the stream reads the folder a bounded number of files a batch and
    passes on lines beyond it, so nothing is lost or sent twice between the two.
    """
    now = spark.read.schema(schema).json(path)
    now.groupBy("job_id").agg(F.max("seq").alias("seen")).write.parquet(seen_path)
    seen = spark.read.parquet(seen_path)
    past = now.join(seen, "job_id").where(F.col("seq") <= F.col("seen")).drop("seen")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)
    return last_bytes(past, n_bytes), stream.join(seen, "job_id", "left").where(F.col("seen").isNull() | (F.col("seq") > F.col("seen"))).drop("seen")
