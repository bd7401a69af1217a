"""Console lines of jobs: noise, events, stages and counters, as column rules.

The same rules serve batch tables and the streaming operators.  A rule table maps a kind of job to patterns with the
fields they fill; a line may match several.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconspark.functions.geometry import c

#: Fixed value: what a line of the image reader that says nothing of use begins with.
NOISE = r"^add_exif_item_to_spec: didn't know how to process"
BANNER = r"^=== \[\d\d:\d\d:\d\d\]"
#: Markers of a reconstruction's banner lines in the order they are tried, and the stage each one starts.
STAGE_MARKERS = [
    ("stage nested layout", "stage"),
    ("feature_extractor", "extract"),
    (r"\] rig_configurator -> ", "rig"),
    ("GPS pose priors: injected", "gps_inject"),
    ("sequential_matcher|vocab_tree_matcher|spatial_matcher|exhaustive_matcher|matches_importer", "match"),
    ("view_graph_calibrator", "calibrate"),
    ("colmap global_mapper|colmap mapper |colmap pose_prior_mapper|colmap hierarchical_mapper", "mapper"),
    ("simplify_images", "simplify"),
    ("model_aligner", "align"),
    ("image_undistorter", "undistort"),
    (r"auto_reorient|\] reorient \(", "reorient"),
]
STAGES = [s for _, s in STAGE_MARKERS]
_BAR = r"^(?=.*Training).*?(\d+)/(\d+)\s*\["
_LOSS_BAR = r"(\d+)/(\d+)\s*\|\s*Loss:"
_IMAGES, _NTH, _DONE = r"^Images: (\d+) under (.+)$", r"^\[(\d+)/(\d+)\] .+$", r"^Done\. processed=(\d+) skipped=(\d+)$"
_BLOCK = r"^\[blocksplit\] (block_\d+_\d+): .*?→ (\d+) views"
_DEPTH = {
    "total": ("last", [(_NTH, 2), (_IMAGES, 1)]), "out_dir": ("last", [(_IMAGES, 2)]), "cur": ("last", [(_NTH, 1)]),
    "written": ("last", [(_DONE, 1)]), "skipped": ("last", [(_DONE, 2)]), "phase": ("last", [(_DONE, "完成"), (_IMAGES, "推論中")]),
}
#: Per kind, field -> (how the values of many lines combine, [(pattern, its group or a constant)]).
#: Of several patterns that match a line the first one counts.  ``last_or``: the last pattern's value holds only until any other comes.
EVENT_RULES = {
    "frames": {
        "total": ("last", [(r"######## \[(\d+)/(\d+)\]", 2), (r"Found (\d+) video", 1)]),
        "cur": ("last", [(r"######## \[(\d+)/(\d+)\]", 1)]),
        "kept": ("sum", [(r"-> (\d+) kept / (\d+) dropped", 1)]),
        "dropped": ("sum", [(r"-> (\d+) kept / (\d+) dropped", 2)]),
    },
    "train": {
        "iter": ("last", [(r"\[ITER\s+(\d+)\]", 1), (_LOSS_BAR, 1), (_BAR, 1)]),
        "total": ("last", [(_LOSS_BAR, 2), (_BAR, 2)]),
        "loss": ("last", [(r"(?i)loss[=:]\s*([0-9.]+)", 1)]),
        "complete": ("flag", [(r"Training complete", "yes")]),
        "phase": ("last", [
            (r"Training complete", "完成"), (_LOSS_BAR, "訓練中"), (_BAR, "訓練中"), (r"Loading train cameras", "載入訓練相機"), (r"Loading test cameras", "載入測試相機"),
            (r"Loading COLMAP|Loading dataset", "載入資料集"), (r"Number of points at init", "初始化點雲"), (r"Populating", "建立多視角資料"), (r"Saving Gaussians|Saving final model", "存檔中"), (r"Saving checkpoint", "存 checkpoint"),
        ]),
    },
    "mesh": {
        "vertices": ("last", [(r"Num vertices post:\s*(\d+)", 1)]),
        "mesh_path": ("last", [(r"\[mesh\] result:\s*(\S+)", 1)]),
        "mesh_scaled_path": ("last", [(r"\[mesh\] scaled result:\s*(\S+)", 1)]),
        "mm_per_unit": ("last", [(r"mm_per_unit=([0-9.]+)", 1)]),
        "texture_obj": ("last", [(r"\[texture\] obj:\s*(\S+)", 1)]),
        "texture_glb": ("last", [(r"\[texture\] glb:\s*(\S+)", 1)]),
        "texture_obj_mm": ("last", [(r"\[texture\] scaled obj:\s*(\S+)", 1)]),
        "texture_glb_mm": ("last", [(r"\[texture\] scaled glb:\s*(\S+)", 1)]),
        "texture_atlas": ("list", [(r"\[texture\] atlas:\s*(\S+)", 1)]),
        "phase": ("last", [
            (r"\[mesh\] scaled result:\s*(\S+)", "已縮放 (mm)"), (r"Found \d+ cameras", "載入相機"), (r"Estimated voxel|Voxel_size|TSDF config", "估計體素 / 融合"), (r"Extracting mesh", "抽取 mesh"), (r"Post processing|Post-processed", "後處理"),
            (r"pre-mask", "貼圖:去背影像"), (r"Generating texture views|wrote NVM", "貼圖:載入視角"), (r"Building adjacency graph", "貼圖:建立鄰接圖"), (r"View selection|Optimizing", "貼圖:選視角"),
            (r"Generating texture patches|Running global seam|Local seam leveling|Generating texture atlases", "貼圖:縫合/打包"), (r"Building objmodel|Saving model", "貼圖:輸出模型"), (r"^paste|pass \d/2", "合併貼圖"),
        ]),
    },
    "gcs": {
        "copied": ("count", [(r"^\s*(?:Copying|Downloading)\b", "copy")]),
        "objects": ("last", [(r"Operation completed over (\d+) objects", 1)]),
        "size": ("last", [(r"Operation completed over \d+ objects/([\d.]+\s*\w+)", 1)]),
        "phase": ("last_or", [(r"Operation completed over (\d+) objects", "完成"), (r"^\s*(?:Copying|Downloading)\b", "下載中"), (r"Building synchronization state|Starting synchronization", "比對差異中")]),
    },
    "depth": _DEPTH,
    "matte": _DEPTH | {"boxes": ("sum", [(r"\bboxes=(\d+)", 1)]), "empty": ("count", [(r"\[warn\] no boxes", "empty")])},
    "blocksplit": {"blocks": ("distinct", [(_BLOCK, 1)]), "views": ("with", [(_BLOCK, 2)])},
}


#: Per kind, what a line says the job is at, last rule first (of several that match a line the first here counts); {n} is a group.
CURRENT_STAGE = {
    "frames": [(r"######## \[(\d+)/(\d+)\]", "video {1}/{2}")],
    "train": [(r"Training complete", "done"), (r"\[ITER\s+(\d+)\]", "train"), (_LOSS_BAR, "train"), (_BAR, "train")],
    "mesh": [(r"^=== \[\d\d:\d\d:\d\d\] mesh done\.|\[mesh\] result:\s*(\S+)", "done"), (r"Extracting mesh from TSDF", "extract")],
    "gcs": [(r"Operation completed over (\d+) objects", "done")],
    "depth": [(_DONE, "done"), (_IMAGES, "depth")],
    "matte": [(_DONE, "done"), (_IMAGES, "matte")],
}


def filter_noise(lines: DataFrame, line: str = "line", pattern: str = NOISE) -> DataFrame:
    return lines.where(~F.coalesce(c(line).rlike(pattern), F.lit(False)))


def _value(line: Column, pattern: str, what: int | str) -> Column:
    if isinstance(what, int):
        return F.nullif(F.regexp_extract(line, pattern, what), F.lit(""))
    return F.when(line.rlike(pattern), F.lit(what))


def parse_events(lines: DataFrame, kind: str, line: str = "line") -> DataFrame:
    """``lines`` with a column for each field of the kind, null where the line says nothing of it."""
    return lines.select("*", *[F.coalesce(*[_value(c(line), p, w) for p, w in rules]).alias(field) for field, (_, rules) in EVENT_RULES[kind].items()])


def current_stage(lines: DataFrame, kind: str, keys: list[str], seq: str = "seq", line: str = "line") -> DataFrame:
    """What each job is at: the label of its last line that says so, null where none does.  An aggregate alone, for tables and streams."""
    def label(pattern: str, text: str) -> Column:
        parts = re.split(r"\{(\d)\}", text)
        return F.when(c(line).rlike(pattern), F.concat(*[F.regexp_extract(c(line), pattern, int(p)) if k % 2 else F.lit(p) for k, p in enumerate(parts)]))

    found = F.coalesce(*[label(*rule) for rule in CURRENT_STAGE[kind]])
    return lines.withColumn("_at", found).groupBy(*keys).agg(F.max_by("_at", F.when(F.col("_at").isNotNull(), F.col(seq))).alias("current_stage"))


def _first_of_each(found: Column) -> Column:
    """Of an array of structs those whose v0 no earlier one has."""
    return F.filter(found, lambda s, k: F.array_position(_part(found, "v0"), s["v0"]) == k + 1)


def _part(found: Column, name: str) -> Column:
    return F.transform(found, lambda s: s[name])


def counters(lines: DataFrame, kind: str, keys: list[str], seq: str = "seq", line: str = "line") -> DataFrame:
    """What a job's lines amount to: sums, counts, last values by seq, lists in order of appearance, each name once where names repeat.

    Aggregates alone, so that it serves tables and, in update mode, streams.  A list's state is bounded by the
    blocks or atlases of one job.
    """
    parsed, out = parse_events(lines, kind, line), []
    parsed = parsed.select(*lines.columns, *[F.col(f).alias(f"_{f}") for f in EVENT_RULES[kind]])  # results have the fields' own names
    at = lambda v: F.when(v.isNotNull(), F.col(seq))
    listed = lambda *v: F.array_sort(F.collect_list(F.when(v[0].isNotNull(), F.struct(F.col(seq).alias("at"), *[x.alias(f"v{k}") for k, x in enumerate(v)]))))
    for field, (how, rules) in EVENT_RULES[kind].items():
        v = F.col(f"_{field}")
        if how == "sum":
            out.append(F.coalesce(F.sum(v.try_cast("long")), F.lit(0)).alias(field))
        elif how == "count":
            out.append(F.count(v).alias(field))
        elif how == "flag":
            out.append(F.coalesce(F.bool_or(v.isNotNull()), F.lit(False)).alias(field))
        elif how == "last":
            out.append(F.max_by(v, at(v)).alias(field))
        elif how == "last_or":
            firm = F.when(v != rules[-1][1], v)
            out.append(F.coalesce(F.max_by(firm, at(firm)), F.max(v)).alias(field))
        elif how == "list":
            out.append(F.transform(listed(v), lambda s: s["v0"]).alias(field))
        elif how == "distinct":  # with the values beside it of the first line of each name
            mates = [f for f, (h, _) in EVENT_RULES[kind].items() if h == "with"]
            first = _first_of_each(listed(v, *[F.col(f"_{m}") for m in mates]))
            out += [_part(first, f"v{k}").alias(name) for k, name in enumerate([field, *mates])]
    return parsed.groupBy(*keys).agg(*out)


def stage_of(line) -> Column:
    """The stage that a banner line starts, null for any other line."""
    found = F.lit(None).cast("string")
    for pattern, stage in reversed(STAGE_MARKERS):
        found = F.when(c(line).rlike(pattern), F.lit(stage)).otherwise(found)
    return F.when(c(line).rlike(BANNER), found)


def skipped_stage(line) -> Column:
    name = F.regexp_extract(c(line), r"^\s*skip (\w+)", 1)
    return F.when(name.isin(*STAGES), name)


def is_done(line) -> Column:
    return c(line).rlike(BANNER) & c(line).contains("done. workspace=")


def stage_events(lines: DataFrame, key: str = "job_id", seq: str = "seq", line: str = "line") -> DataFrame:
    """The lines that bear on a job's stages, as columns: start, skip (names of stages) and done."""
    done = F.coalesce(is_done(line), F.lit(False))
    return lines.select(key, seq, F.when(~done, stage_of(line)).alias("start"), skipped_stage(line).alias("skip"), done.alias("done")).where("start IS NOT NULL OR skip IS NOT NULL OR done")


def stage_timeline(lines: DataFrame, key: str = "job_id", seq: str = "seq", line: str = "line") -> DataFrame:
    """The stage that holds at each line, carried forward from the last banner: job, stage, first and last line, lines."""
    per = Window.partitionBy(key).orderBy(seq)
    mark = lines.withColumn("_start", stage_of(line))
    held = mark.withColumn("stage", F.last("_start", ignorenulls=True).over(per.rowsBetween(Window.unboundedPreceding, 0)))
    change = F.coalesce(F.lag("stage").over(per) != F.col("stage"), F.lit(True))
    runs = held.where("stage IS NOT NULL").withColumn("_new", change.cast("int")).withColumn("run", F.sum("_new").over(per.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "run", "stage").agg(F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"), F.count("*").alias("n_lines"))


def stage_status(lines: DataFrame, finished: DataFrame | None = None, key: str = "job_id", seq: str = "seq", line: str = "line") -> DataFrame:
    """Status of each stage a job has met: skipped, done, or running (at the end done or failed, from finished(job, ok)).

    A stage is done when a later banner starts another one or the closing banner comes while it runs; the
    last of ``skip`` and banner lines decides.
    """
    events = stage_events(lines, key, seq, line)
    starts = events.where("start IS NOT NULL").select(key, seq, F.col("start").alias("stage"), F.lead("start").over(Window.partitionBy(key).orderBy(seq)).alias("next_stage"))
    closed = events.where("done").groupBy(key).agg(F.max(seq).alias("done_seq"))
    last = starts.groupBy(key, "stage").agg(F.max_by(F.struct(seq, "next_stage"), seq).alias("s")).select(key, "stage", F.col(f"s.{seq}").alias("at"), F.col("s.next_stage"))
    at_end = F.when(F.col("next_stage").isNull() & (F.col("done_seq") > F.col("at")), F.col("done_seq")).otherwise(F.col("at"))  # the closing banner speaks of the last stage
    run = last.join(closed, key, "left").select(key, "stage", at_end.alias("at"), F.when(F.col("next_stage").isNotNull() | (F.col("done_seq") > F.col("at")), "done").otherwise("running").alias("status"))
    skip = events.where("skip IS NOT NULL").groupBy(key, F.col("skip").alias("stage")).agg(F.max(seq).alias("at")).withColumn("status", F.lit("skipped"))
    both = run.unionByName(skip).groupBy(key, "stage").agg(F.max_by("status", "at").alias("status"))
    if finished is None:
        return both
    end = F.when(F.col("status") == "running", F.when(F.col("ok"), "done").otherwise("failed")).otherwise(F.col("status"))
    return both.join(finished, key, "left").select(key, "stage", F.when(F.col("ok").isNull(), F.col("status")).otherwise(end).alias("status"))


def change_feed(states: DataFrame, key: str = "job_id", seq: str = "seq", signature: tuple[str, ...] = ("status", "stage")) -> DataFrame:
    """Rows at which the signature of a job differs from its row before."""
    per = Window.partitionBy(key).orderBy(seq)
    now = F.struct(*signature)
    return states.withColumn("_b", F.lag(now).over(per)).where(~F.coalesce(F.col("_b").eqNullSafe(now), F.lit(False)) | F.col("_b").isNull()).drop("_b")
