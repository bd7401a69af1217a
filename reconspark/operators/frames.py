"""Frame selection by score and quota, and the rankings used around images and jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconspark.functions.geometry import c, valid_score

DECISIONS = ("kept", "above_threshold", "percentile", "invalid_score")


def validate_frame_options(threshold: str | float | None, keep_pct: str | float | None) -> tuple[float | None, float | None]:
    """Numbers, or an error: a threshold is finite and not negative, a percentage is in (0, 100]."""
    out = []
    for name, value in (("threshold", threshold), ("keep_pct", keep_pct)):
        number = None if value in (None, "") else float(value)
        if number is not None and (number != number or number in (float("inf"), float("-inf")) or number < 0 or (name == "keep_pct" and not 0 < number <= 100)):
            raise ValueError(f"bad {name}: {value!r}")
        out.append(number)
    return out[0], out[1]


def select_frames(frames: DataFrame, video: str = "video", name: str = "name", score: str = "score", threshold: float | None = None, keep_pct: float | None = None) -> DataFrame:
    """``frames`` with decision, rank (of valid rows, by score then name) and cutoff (score at the quota).

    Reasons in this order: invalid_score, above_threshold, percentile (rank above max(1, int(n_valid * pct / 100))),
    kept.  The rank is over all valid rows of the video, before the threshold: a quota is never filled up with
    blurred frames.
    """
    ok = valid_score(score)
    per = Window.partitionBy(video)
    n_valid = F.count(F.when(ok, 1)).over(per)
    rank = F.when(ok, F.row_number().over(per.orderBy(F.when(ok, 0).otherwise(1), F.col(score), F.col(name))))
    quota = F.greatest(F.lit(1), F.floor(n_valid * float(keep_pct) / 100).cast("int")) if keep_pct is not None else F.lit(None).cast("int")
    ranked = frames.withColumn("rank", rank).withColumn("quota", quota)
    decision = F.when(~ok, "invalid_score")
    if threshold is not None:
        decision = decision.when(F.col(score) > threshold, "above_threshold")
    if keep_pct is not None:
        decision = decision.when(F.col("rank") > F.col("quota"), "percentile")
    cutoff = F.max(F.when(F.col("rank") == F.col("quota"), F.col(score))).over(per)
    return ranked.withColumn("decision", decision.otherwise("kept")).withColumn("cutoff", cutoff).drop("quota")


def frame_quality_counts(selected: DataFrame, video: str = "video") -> DataFrame:
    """Counts for every decision, present or not, and the cutoff, per video."""
    return selected.groupBy(video).agg(*[F.count_if(F.col("decision") == d).alias(d) for d in DECISIONS], F.max("cutoff").alias("cutoff"))


def newest_by_key(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The last row of each key in the given order, by partial aggregation instead of a window."""
    rest = [k for k in rows.columns if k not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*[c(o) for o in order])).alias("row")).select(*keys, "row.*")


def frame_position(images: DataFrame, folder: str = "folder", name: str = "name") -> DataFrame:
    """0-based position of a name within its folder, sorted, and how many siblings it has."""
    per = Window.partitionBy(folder)
    return images.withColumn("position", F.row_number().over(per.orderBy(name)) - 1).withColumn("siblings", F.count("*").over(per))


def kept(df: DataFrame) -> DataFrame:
    """``df`` as it is now, for steps that read it again: a checkpoint in the folder that spark.checkpoint.dir names.

    Only on a local master, where the session names none, a temporary one is made: on a cluster each executor would write to its own disk."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


#: Rows that ``dealt`` gives to a task.
TASK_ROWS = 250_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of ``rows`` rows dealt by keys so that a task takes about TASK_ROWS of them, whatever their number.

    Left alone, adaptive execution merges partitions by their packed bytes, to millions of rows of a few numbers each."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def release(spark) -> int:
    """Delete what ``kept`` wrote for this session's context, once the results that read it are done; how many tables went.

    Only the context's own folder below spark.checkpoint.dir is emptied.  A result that is read afterwards fails."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        return 0
    path = spark._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    own = [s.getPath() for s in files.listStatus(path) if s.getPath().getName().startswith("rdd-")] if files.exists(path) else []
    return sum(files.delete(one, True) for one in own)


#: Rows in a bucket of the two-level ranks of a table without keys.
BUCKET = 100_000


def ranked(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with their 0-based position in the order within each key, and the key's count n.

    A table without keys, or with a key of more than BUCKET rows, is cut at values of the first order column into buckets of about BUCKET rows (cuts from a hash
    sample, so they are the same in every run): counts per key and bucket, then ranks within a bucket of a key.  Rows that share
    that value share a bucket.
    """
    total = rows.count()
    if total <= BUCKET or (keys and rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] <= BUCKET):
        per = Window.partitionBy(*keys)
        return rows.withColumn("position", F.row_number().over(per.orderBy(*order)) - 1).withColumn("n", F.count("*").over(per))
    first, parts = order[0], -(-total // BUCKET)
    every = max(1, total // (200 * parts))
    sample = sorted(r[0] for r in rows.where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).select(first).where(F.col(first).isNotNull()).collect())  # about 200 values a bucket
    cuts = sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []
    kind = rows.schema[first].dataType
    listed = lambda values: F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array().cast(f"array<{kind.simpleString()}>")
    # Of many cuts every so manieth is looked at first, then those behind the last one below.
    wide = max(1, int(len(cuts) ** 0.5))
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b <= F.col(first)))
    fine = F.array(*[listed(cuts[k : k + wide - 1]) for k in range(1, len(cuts) + 1, wide)]) if cuts else None
    placed = rows.withColumn("_coarse", below(listed(cuts[::wide])))
    inner = below(F.get(fine, F.col("_coarse") - 1)) if cuts else F.lit(0)
    placed = placed.withColumn("_bucket", F.when(F.col("_coarse") > 0, (F.col("_coarse") - 1) * wide + 1 + inner).otherwise(F.lit(0))).drop("_coarse").withColumn("_key", F.struct(F.lit(0), *keys))  # a struct is never null
    counts = placed.groupBy("_key", "_bucket").agg(F.count("*").alias("_rows"))
    per = Window.partitionBy("_key")
    before = counts.select("_key", "_bucket", (F.sum("_rows").over(per.orderBy("_bucket")) - F.col("_rows")).alias("_before"), F.sum("_rows").over(per).alias("n"))  # one row for each bucket of a key
    inside = F.row_number().over(Window.partitionBy("_key", "_bucket").orderBy(*order)) - 1
    joined = placed.withColumn("_inside", inside).join(before if keys else F.broadcast(before), ["_key", "_bucket"])
    return joined.withColumn("position", (F.col("_inside") + F.col("_before")).cast("long")).select(*rows.columns, "position", "n")


def even_spread(rows: DataFrame, keys: list[str], order: list[str], cap: int, current: Column | None = None) -> DataFrame:
    """All rows of a key with at most ``cap``; else those at positions int(k * n / cap), and the current one."""
    numbered = ranked(rows, keys, order)
    # Position p is int(k * n / cap) for some k iff the next multiple of n / cap lies below p + 1.
    k = F.ceil(F.col("position") * cap / F.col("n"))
    spread = (F.col("n") <= cap) | ((F.floor(k * F.col("n") / cap) == F.col("position")) & (k < cap))
    return numbered.where(spread if current is None else spread | F.coalesce(current, F.lit(False)))


def stride_sample(rows: DataFrame, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """Every ceil(n / cap)-th row of each key: at most ``cap`` rows."""
    return ranked(rows, keys, order).where(F.col("position") % F.ceil(F.col("n") / cap) == 0).drop("n")


def collapse_progress(lines: DataFrame, key: str = "job_id", seq: str = "seq", line: str = "line", last: int | None = 300) -> DataFrame:
    """Adjacent progress lines collapse to the last of their run; of the rest the last ``last`` lines per key."""
    per = Window.partitionBy(key).orderBy(seq)
    progress = F.col(line).rlike(r"\d+%\||it/s")
    kept = lines.withColumn("next_too", F.lead(progress, 1, False).over(per)).where(~(progress & F.col("next_too"))).drop("next_too")
    if last is None:
        return kept
    return kept.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where(F.col("back") <= last).drop("back")


def span_select(images: DataFrame, source: str, first: str = "", last: str = "", scope: str = "span", folder: str = "folder", name: str = "name") -> DataFrame:
    """Frames of the source's folder: ``one`` the source, ``all`` its folder, ``span`` between two names (swapped if
    reversed; an unknown end counts as the source)."""
    if scope not in ("one", "all", "span"):
        raise ValueError(f"unknown scope {scope!r}")
    own = images.where(F.col(name) == source).select(F.col(folder).alias("own_folder"))
    mates = images.join(own, F.col(folder) == F.col("own_folder"), "left_semi")
    if scope == "all":
        return mates
    if scope == "one":
        return mates.where(F.col(name) == source)
    ends = mates.agg(F.coalesce(F.max(F.when(F.col(name) == first, F.col(name))), F.lit(source)).alias("a"), F.coalesce(F.max(F.when(F.col(name) == last, F.col(name))), F.lit(source)).alias("b")).select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    return mates.join(F.broadcast(ends), F.col(name).between(F.col("low"), F.col("high"))).drop("low", "high")


def worst(rows: DataFrame, score: str, n: int, *ties: str) -> DataFrame:
    """The n rows of highest score: top-k per partition, then of those (no full sort)."""
    return rows.orderBy(F.desc(score), *ties).limit(n)


def index_statistics(values: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """sorted[n // 2], sorted[int(0.9 n)] and the largest, not interpolated, per key."""
    from reconspark.operators.selection import at_ranks

    found = at_ranks(values, value, keys, {"mid": lambda n: F.floor(n / 2), "p90": lambda n: F.floor(n * 0.9), "largest": lambda n: n - 1})
    return found.where("n > 0").select(*keys, "mid", "p90", "largest")
