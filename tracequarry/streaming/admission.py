"""Admission of requests as they come: the window of each project is keyed state, which a timer clears once it is over."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracequarry.operators.admission import LIMIT, SECONDS, SlidingWindow

OUT = "project_id string, request_id long, at timestamp, cost long, allowed boolean, remaining long, retry_after int"


class Admission(StatefulProcessor):
    """Requests of one batch are judged in order of time, on top of what passed before. If the state cannot be read or written,
    requests pass: losing telemetry would be worse than what the limit prevents."""

    def __init__(self, limit: int = LIMIT, seconds: int = SECONDS):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("passed", "at long, cost long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows), ignore_index=True).sort_values(["at", "request_id"])
        micros = asked["at"].astype("datetime64[us]").astype("int64")
        try:
            window = SlidingWindow(self.limit, self.seconds, [(int(a), int(c)) for a, c in self.state.get()])
            answers = [window.ask(int(at), int(cost)) for at, cost in zip(micros, asked["cost"], strict=True)]
            self.state.put(list(window.passed)) if window.passed else self.state.clear()
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 2000 * self.seconds)
        except Exception:
            answers = [(True, self.limit)] * len(asked)
        asked["allowed"], asked["remaining"] = zip(*answers, strict=True)
        asked["retry_after"] = [0 if a else self.seconds for a, _ in answers]
        asked["project_id"] = key[0]
        yield asked[["project_id", "request_id", "at", "cost", "allowed", "remaining", "retry_after"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Nothing came for two windows: the state is over."""
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def admission_stream(requests: DataFrame, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """A stream of requests (project_id, request_id, at, cost) with allowed, remaining and retry_after.

    The session must keep its state in RocksDB (SETTINGS). A stream that is to end (availableNow) must not run batches without
    data, as timers ask for them without end; SETTINGS turn those off, and timers then run with the next data."""
    typed = requests.select("project_id", F.col("request_id").cast("long").alias("request_id"), F.col("at").cast("timestamp").alias("at"), F.col("cost").cast("long").alias("cost"))
    return typed.groupBy("project_id").transformWithStateInPandas(Admission(limit, seconds), OUT, "Update", "ProcessingTime")


SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
