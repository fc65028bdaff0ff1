"""How runs ended, as their events arrive: keyed state holds each run's last terminal event. An extension.

An event's place in its run decides, not the time or the order in which it arrives: a later result replaces an earlier one
whenever it comes, an earlier one that comes late changes nothing, and one that comes again changes nothing. No watermark sets
a horizon. A run's state is a few values; with `idle` it is given up once nothing came for so long, which a timer sees to.

Needs the state store that keeps several variables a key (RocksDB; `use_state_store`), and a checkpoint for restarts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "run string, pos bigint, subtype string, is_error boolean, outcome string, n_events bigint"
_STATE = "pos bigint, subtype string, is_error boolean, n_events bigint"


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def outcome_of(subtype: str | None, is_error: bool | None) -> str:
    """`traces.outcomes` for one result event."""
    from runlens.operators.traces import ENDINGS

    if subtype == "success":
        return "finished_with_api_error" if is_error else "finished"
    return ENDINGS.get(subtype, "execution_error")


class LastEnding(StatefulProcessor):
    """Emits a run's ending whenever it changes."""

    def __init__(self, idle_ms: int | None) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pos, subtype, is_error, n = self.last.get() if self.last.exists() else (-1, None, None, 0)
        before = pos
        for part in rows:
            n += len(part)
            ends = part[part["type"] == "result"]
            if len(ends) and int(ends["pos"].max()) > pos:
                row = ends.loc[ends["pos"].idxmax()]
                pos, subtype = int(row["pos"]), None if pd.isna(row["subtype"]) else str(row["subtype"])
                is_error = False if pd.isna(row["is_error"]) else bool(row["is_error"])
        self.last.update((pos, subtype, is_error, n))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        if pos > before:
            yield pd.DataFrame([{"run": key[0], "pos": pos, "subtype": subtype, "is_error": is_error, "outcome": outcome_of(subtype, is_error), "n_events": n}])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def endings(events: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """events (run, pos, type, subtype, is_error), a stream: a row each time a run's ending changes; the last row of a run is how it ended so far."""
    own = events.selectExpr("run", "CAST(pos AS BIGINT) AS pos", "type", "subtype", "CAST(is_error AS BOOLEAN) AS is_error").where("run is not null")
    mode = "None" if idle_ms is None else "ProcessingTime"
    return own.groupBy("run").transformWithStateInPandas(LastEnding(idle_ms), outputStructType=RESULT, outputMode="Update", timeMode=mode)
