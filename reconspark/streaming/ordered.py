"""The stage machine over lines that come out of order: state with a buffer, timers and an end.

``logs.stage_machine`` takes a job's lines in sequence within a micro-batch.  Here a line waits in the job's state until all before it
have come, so batches may overlap in any way.  A gap that does not close within ``patience`` is passed over (a timer), and the
state of a job that nobody ends is dropped ``ttl`` after its last line.  Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from reconspark.operators.logs import is_done, skipped_stage, stage_of
from reconspark.streaming.logs import OUTPUT, STATE, JobState, write_statuses

#: State store that keeps values, maps and timers of a key apart.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OrderedStages(StatefulProcessor):
    """``next``: the sequence number that is due; ``waiting``: the lines beyond it, by number."""

    def __init__(self, first: int, patience_ms: int, ttl_ms: int):
        self.first, self.patience_ms, self.ttl_ms = first, patience_ms, ttl_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE, self.ttl_ms)
        self.next = handle.getValueState("next", "seq long", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "seq long", "start string, skip string, done boolean", self.ttl_ms)

    def _held(self) -> dict[int, tuple]:
        return {int(k[0]): tuple(v) for k, v in self.waiting.iterator()} if self.waiting.exists() else {}

    def _fold(self, key, due: int, held: dict[int, tuple], job: JobState, over_gaps: bool) -> tuple[list, int]:
        """Rows for the changes that the lines in order bring, and the number that is due after them."""
        rows = []

        def send(seq: int, ended: bool) -> None:
            now = f"{job.stage}|{write_statuses(job.statuses)}|{ended}"
            if now != job.sent:
                rows.append((key[0], seq, job.stage, write_statuses(job.statuses), ended))
                job.sent = now

        for seq in sorted(held):
            if seq > due and not over_gaps:
                break
            start, skip, done = held.pop(seq)
            if self.waiting.exists() and self.waiting.containsKey((seq,)):
                self.waiting.removeKey((seq,))
            job.seen, due = max(job.seen, seq), seq + 1
            job.fold(start, skip, bool(done))
            send(seq, False)
        if job.drained() and not held:
            job.close("done" if job.outcome == "done" else "failed")
            send(job.seen, True)
        return rows, due

    def _keep(self, due: int, held: dict[int, tuple], job: JobState, now_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if job.drained() and not held:
            self.job.clear()
            self.next.clear()
            self.waiting.clear()
            return
        self.job.update(job.stored())
        self.next.update((due,))
        if held:
            self.handle.registerTimer(now_ms + self.patience_ms)

    def _state(self) -> tuple[JobState, int]:
        return JobState(tuple(self.job.get()) if self.job.exists() else None), int(self.next.get()[0]) if self.next.exists() else self.first

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        job, due = self._state()
        held = self._held()
        text = lambda v: v if isinstance(v, str) else None  # noqa: E731  null texts of pandas are None or NaN
        for frame in rows:
            for seq, start, skip, done, outcome in frame[["seq", "start", "skip", "done", "outcome"]].astype(object).itertuples(index=False):
                if isinstance(outcome, str):
                    job.outcome, job.last_seq = outcome, int(seq)
                elif int(seq) >= due and int(seq) not in held:  # a line that comes again is known
                    held[int(seq)] = (text(start), text(skip), bool(done))
                    self.waiting.updateValue((int(seq),), held[int(seq)])
        out, due = self._fold(key, due, held, job, False)
        self._keep(due, held, job, timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(out, columns=["job_id", "seq", "stage", "statuses", "ended"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job, due = self._state()
        held = self._held()
        out, due = self._fold(key, due, held, job, True)
        self._keep(due, held, job, timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(out, columns=["job_id", "seq", "stage", "statuses", "ended"])

    def close(self) -> None:
        pass


def ordered_stage_machine(lines: DataFrame, finished: DataFrame | None = None, first: int = 0, patience: float = 60.0, ttl: float = 7 * 86400.0) -> DataFrame:
    """A row for every change of a job's stages, as ``logs.stage_machine`` gives for lines in order.

    Lines are numbered from ``first`` without gaps, noise included.  ``patience`` and ``ttl`` are seconds.  ``finished(job_id, last_seq, status)`` ends a job
    once its last line has been taken; then its state goes at once.
    """
    if lines.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {PROVIDER}")
    none = F.lit(None).cast("string")
    done = F.coalesce(is_done("line"), F.lit(False))
    rows = lines.select("job_id", F.col("seq").cast("long").alias("seq"), F.when(~done, stage_of("line")).alias("start"), skipped_stage("line").alias("skip"), done.alias("done"), none.alias("outcome"))
    if finished is not None:
        rows = rows.unionByName(finished.select("job_id", F.col("last_seq").cast("long").alias("seq"), none.alias("start"), none.alias("skip"), F.lit(False).alias("done"), F.col("status").alias("outcome")))
    return rows.groupBy("job_id").transformWithStateInPandas(OrderedStages(first, int(patience * 1000), int(ttl * 1000)), OUTPUT, "Append", "ProcessingTime")
