"""Lines out of order over several batches give what lines in order give; timers pass over gaps; nothing is kept of ended jobs."""

import time

import pytest

from reconspark.streaming import ordered
from reconspark.streaming.logs import OUTPUT

LOG = ["=== [12:00:00] feature_extractor", "noise", "=== [12:01:00] exhaustive_matcher", "skip simplify", "=== [12:02:00] colmap mapper x", "add", "=== [12:03:00] done. workspace=x", "tail"]
SCHEMA = "job_id string, seq long, line string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ordered.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def run(spark, tmp_path, batches, ended, rows, **how):
    """Batches of lines as files, each taken by a micro-batch of its own; the output once it has as many rows, or after half a minute."""
    for name in ("in", "end"):
        (tmp_path / name).mkdir(exist_ok=True)
    lines = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    finished = spark.readStream.schema("job_id string, last_seq long, status string").json(str(tmp_path / "end"))
    query = ordered.ordered_stage_machine(lines, finished, **how).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    out = lambda: sorted((r.job_id, r.seq, r.ended, r.stage, r.statuses) for r in spark.read.schema(OUTPUT).parquet(str(tmp_path / "out")).collect()) if (tmp_path / "out").exists() else []
    try:
        sent = 0
        for batch, end in zip(batches, ended):
            for name, own in (("in", [f'{{"job_id": "{j}", "seq": {k}, "line": "{x}"}}' for j, k, x in batch]), ("end", [f'{{"job_id": "{j}", "last_seq": {k}, "status": "{x}"}}' for j, k, x in end])):
                if own:
                    (tmp_path / f"{sent}{name}").write_text("\n".join(own))
                    (tmp_path / f"{sent}{name}").rename(tmp_path / name / f"{sent}.json")  # a whole file at once
            sent += len(batch) + len(end)
            until = time.time() + 30
            while sum(p["numInputRows"] for p in query.recentProgress) < sent and time.time() < until:
                time.sleep(0.2)
        until = time.time() + 30
        while len(out()) < rows and time.time() < until:
            time.sleep(0.3)
    finally:
        query.stop()
    return out()


def test_lines_out_of_order_over_three_batches(rocks, tmp_path):
    spark = rocks
    a, b = [("a", k, x) for k, x in enumerate(LOG)], [("b", k, x) for k, x in enumerate(LOG[:5])]
    batches = [[a[4], a[1], b[3], a[7]], [a[0], b[0], b[1], a[2], b[4], a[4]], [a[6], a[5], a[3], b[2]]]
    found = run(spark, tmp_path, batches, [[], [("a", 7, "done")], [("b", 4, "failed")]], 11)
    first = ["extract=running", "extract=done,match=running", "extract=done,match=running,simplify=skipped", "extract=done,mapper=running,match=done,simplify=skipped"]
    last = first[-1].replace("running", "done")
    wanted = [("a", k, False, stage, x) for k, stage, x in zip((0, 2, 3, 4), ("extract", "match", "match", "mapper"), first)] + [("a", 6, False, "mapper", last), ("a", 7, True, "mapper", last)]
    wanted += [("b", k, False, stage, x) for k, stage, x in zip((0, 2, 3, 4), ("extract", "match", "match", "mapper"), first)] + [("b", 4, True, "mapper", first[-1].replace("running", "failed"))]
    assert found == sorted(wanted)


def test_a_gap_is_passed_over_when_patience_ends(rocks, tmp_path):
    lines = [("a", k, x) for k, x in enumerate(LOG)]
    found = run(rocks, tmp_path, [[lines[0], lines[2]], [("z", 0, "x")], [("z", 1, "x")]], [[], [], []], 2, patience=0.001)
    assert ("a", 2, False, "match", "extract=done,match=running") in found


def test_another_state_store_is_refused(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        ordered.ordered_stage_machine(spark.createDataFrame([], SCHEMA))
