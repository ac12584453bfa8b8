"""The state of each measured cell as a stream: the last entry wins, its verdict is told when it changes, cells nobody touches expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.functions.exprs import verdict
from gaugeworks.sources.scratch import ship

CELL = ("project_id", "sample_id", "char_id")
#: What keeps states on executors; sessions that run these streams need it.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
CHANGES = "project_id long, sample_id long, char_id long, seq long, was string, verdict string, status string"


class _Cells(StatefulProcessor):
    """Of a cell the number of its last entry and the verdict told last; a timer for when it expires."""

    def __init__(self, expiry: int | None) -> None:
        self.expiry = expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "seq long, verdict string")

    def _timed(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at + self.expiry)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, told = self.last.get() if self.last.exists() else (None, None)
        entries = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for number, is_, at in zip(entries["seq"].tolist(), entries["verdict"].tolist(), entries["at"].tolist(), strict=True):
            if seq is not None and number <= seq:
                out.append((*key, number, told, is_, "refused"))
                continue
            if is_ != (told or "missing"):
                out.append((*key, number, told or "missing", is_, "changed"))
            seq, told = number, is_
        self.last.update((seq, told))
        if self.expiry is not None:
            self._timed(max(int(at) for at in entries["at"]))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, told = self.last.get() if self.last.exists() else (None, None)
        self.last.clear()
        yield pd.DataFrame([(*key, seq, told, "missing", "expired")] if seq is not None else [], columns=[c.split()[0] for c in CHANGES.split(", ")])

    def close(self) -> None:
        pass


def verdict_changes(entries: DataFrame, limits: DataFrame, late: str = "10 minutes", expiry: float | None = None) -> DataFrame:
    """Of a stream of entries (project_id, sample_id, char_id, seq, ts, value, attribute) a row for each change of a cell's verdict, in update mode.

    `limits` (project_id, char_id, lower_limit, upper_limit) are joined before the state, which then is a number and a verdict for each
    cell. Entries of a batch count in order of `seq`; the last wins, and one with neither value nor attribute clears its cell. An
    entry that is not after the last is refused: it changes nothing and has that status. Cells without an entry for `expiry` seconds of event time
    are told as `expired` and forgotten. Entries of unknown characteristics are not judged; entries later than the watermark (`late`) are dropped by
    Spark. Null values and limits are as in verdict(); an entry without seq or a part of its cell's key is left out.
    """
    ship(entries.sparkSession)
    entries.sparkSession.streams  # noqa: B018 - a batch needs what keeps states, too, and nothing else has started it there
    judged = entries.join(F.broadcast(limits.select("project_id", "char_id", "lower_limit", "upper_limit")), ["project_id", "char_id"])
    told = judged.where(" AND ".join(f"{c} IS NOT NULL" for c in (*CELL, "seq", "ts"))).withWatermark("ts", late)
    told = told.select(*[F.col(c).cast("long").alias(c) for c in (*CELL, "seq")], "ts", verdict(F.col("value"), F.col("attribute"), F.col("lower_limit"), F.col("upper_limit")).alias("verdict"), F.unix_millis("ts").alias("at"))
    mode = "None" if expiry is None else "EventTime"
    return told.groupBy(*CELL).transformWithStateInPandas(_Cells(None if expiry is None else int(expiry * 1000)), CHANGES, "Update", mode)
