"""Run states from a stream of job events.

``states`` follows each run through its events: the latest event by ``seq`` decides, a late one changes nothing, and
a run that stays RUNNING for ``hours`` of processing time is reported as hung.  In update mode its last row for a run
equals the batch operator ``guard.latest_state``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import states as tables
from ..functions import times

OUTPUT = "run_id string, status string, seq long, hung boolean"
_HOUR = 3_600_000


class RunState(StatefulProcessor):
    """Value state (status, seq) for each run, and a timer while it is RUNNING."""

    def __init__(self, hours: int | None):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, seq = self.last.get() if self.last.exists() else (None, -1)
        for pdf in rows:
            if len(pdf) and pdf["seq"].max() > seq:
                top = pdf.loc[pdf["seq"].idxmax()]
                status, seq = top["status"], int(top["seq"])
        self.last.update((status, seq))
        if self.hours is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if status == "RUNNING":
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.hours * _HOUR)
        yield pd.DataFrame({"run_id": [key[0]], "status": [status], "seq": [seq], "hung": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            status, seq = self.last.get()
            if status == "RUNNING":
                yield pd.DataFrame({"run_id": [key[0]], "status": [status], "seq": [seq], "hung": [True]})

    def close(self) -> None:
        pass


def states(events: DataFrame, hours: int | None = 24) -> DataFrame:
    """A stream (run_id, status, seq) -> the state after each batch.  Needs the RocksDB state store.

    With ``hours`` None no run is watched for hanging; a query that is to end by itself needs that, for timers
    of processing time keep it running.
    """
    mode = "None" if hours is None else "ProcessingTime"
    return events.groupBy("run_id").transformWithStateInPandas(RunState(hours), OUTPUT, "Update", mode)


def final_states(events: DataFrame) -> DataFrame:
    """A stream of job endings (run_id, state, code, line) with their decided final state; stateless."""
    return events.select("run_id", tables.final_state(F.col("state"), F.col("code"), F.col("line")).alias("final")).select("run_id", "final.*")


def limit_warnings(starts: DataFrame) -> DataFrame:
    """A stream of starts (run_id, ts, time_limit) -> the moment at which each run is warned."""
    return starts.select("run_id", times.warning_at(F.col("ts"), F.col("time_limit")).alias("warn_at"))


def submissions(events: DataFrame, delay: str = "24 hours") -> DataFrame:
    """The first submission of each variant; a repeated one within the watermark is dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["exp_name", "variant_key"])


def activity(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Events per window and type, after the watermark."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
