"""Live job status from console lines: Structured Streaming twins of the batch log operators.

Lines are keyed by job and carry a sequence number; duplicates within the watermark are dropped, and within a
micro-batch a job's lines are taken in sequence order.  The rules that read a line are those of the batch
operators: they run as columns before any state is touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconspark.operators.logs import counters, filter_noise, is_done, skipped_stage, stage_of

STATE = "stage string, statuses string, sent string, seen long, last_seq long, outcome string"
OUTPUT = "job_id string, seq long, stage string, statuses string, ended boolean"


def clean_lines(lines: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Noise out, repeated deliveries of a line out."""
    return filter_noise(lines).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "seq"])


def running_counters(lines: DataFrame, kind: str) -> DataFrame:
    """What each job's lines amount to so far, for update mode: the batch aggregates."""
    return counters(lines, kind, ["job_id"])


def write_statuses(statuses: dict[str, str]) -> str:
    return ",".join(f"{k}={v}" for k, v in sorted(statuses.items()))


class JobState:
    """Stages of one job: folds events that the batch columns have read."""

    def __init__(self, stored: tuple | None):
        self.stage, statuses, self.sent, self.seen, self.last_seq, self.outcome = stored or ("", "", "", -1, None, None)
        self.statuses = dict(x.split("=") for x in statuses.split(",") if x)

    def close(self, status: str) -> None:
        """The stage that runs, if any, has ended so."""
        if self.statuses.get(self.stage) == "running":
            self.statuses[self.stage] = status

    def fold(self, start: str | None, skip: str | None, done: bool) -> None:
        if skip:
            self.statuses[skip] = "skipped"
        elif done:
            if self.stage:
                self.statuses[self.stage] = "done"
        elif start:
            if start != self.stage:
                self.close("done")
            self.stage, self.statuses[start] = start, "running"

    def drained(self) -> bool:
        """Whether the job has finished and all its lines have been seen."""
        return self.outcome is not None and self.seen >= self.last_seq

    def stored(self) -> tuple:
        return self.stage, write_statuses(self.statuses), self.sent, self.seen, self.last_seq, self.outcome


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    job, rows = JobState(state.get if state.exists else None), []

    def send(seq: int, ended: bool) -> None:
        now = f"{job.stage}|{write_statuses(job.statuses)}|{ended}"
        if now != job.sent:  # a change feed: only what differs is sent
            rows.append((key[0], seq, job.stage, write_statuses(job.statuses), ended))
            job.sent = now

    # Null texts of pandas are None or NaN.
    for seq, start, skip, done, outcome in pd.concat(list(frames)).sort_values("seq")[["seq", "start", "skip", "done", "outcome"]].astype(object).itertuples(index=False):
        if isinstance(outcome, str):
            job.outcome, job.last_seq = outcome, int(seq)
            continue
        job.seen = max(job.seen, int(seq))
        job.fold(start if isinstance(start, str) else None, skip if isinstance(skip, str) else None, bool(done))
        send(int(seq), False)
    if job.drained():
        job.close("done" if job.outcome == "done" else "failed")
        send(job.seen, True)
        state.remove()  # finished and drained: nothing more is kept
    else:
        state.update(job.stored())
    yield pd.DataFrame(rows, columns=["job_id", "seq", "stage", "statuses", "ended"])


def stage_machine(lines: DataFrame, finished: DataFrame | None = None) -> DataFrame:
    """A row for every change of the stages of a stream's jobs.

    ``finished(job_id, last_seq, status)`` says that a job has ended with a status (done, failed, cancelled) and which line is its last.
    A job ends when it has finished and its log is drained, in whichever order the two arrive; then a stage that still runs is
    done or failed, the row says ``ended``, and the state is dropped.  A closing banner alone ends nothing: lines may follow.
    """
    none = F.lit(None).cast("string")
    # The last line of each batch counts as seen even if it bears on no stage, so all lines are passed on, but not their text.
    done = F.coalesce(is_done("line"), F.lit(False))
    rows = lines.select("job_id", F.col("seq").cast("long").alias("seq"), F.when(~done, stage_of("line")).alias("start"), skipped_stage("line").alias("skip"), done.alias("done"), none.alias("outcome"))
    if finished is not None:
        rows = rows.unionByName(finished.select("job_id", F.col("last_seq").cast("long").alias("seq"), none.alias("start"), none.alias("skip"), F.lit(False).alias("done"), F.col("status").alias("outcome")))
    return rows.groupBy("job_id").applyInPandasWithState(_advance, OUTPUT, STATE, "append", "NoTimeout")
