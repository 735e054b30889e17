"""Admission of requests by a sliding window of costs for each project.

A request passes if its cost and those of the requests that passed in the `seconds` before it stay within the limit; one that
is refused costs nothing. As each decision depends on those before, a project's requests are read in order as a stream with
the window as its only state; stretches between which nothing came for a whole window are independent and dealt out apart."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The usual window in seconds and its limit.
SECONDS, LIMIT = 60, 6000


class SlidingWindow:
    """Costs that passed within the last `seconds`, oldest first; times are microseconds."""

    def __init__(self, limit: int, seconds: int, passed: list[tuple[int, int]] | None = None):
        self.limit, self.length, self.passed = limit, seconds * 1_000_000, deque(passed or [])
        self.used = sum(cost for _, cost in self.passed)

    def ask(self, at: int, cost: int) -> tuple[bool, int]:
        """Whether a request passes, and how much is left after it."""
        while self.passed and self.passed[0][0] <= at - self.length:
            self.used -= self.passed.popleft()[1]
        allowed = self.used + cost <= self.limit
        if allowed and cost:
            self.passed.append((at, cost))
            self.used += cost
        return allowed, max(0, self.limit - self.used)


def admitted(requests: DataFrame, limit: int = LIMIT, seconds: int = SECONDS) -> DataFrame:
    """requests (project_id, request_id, at, cost) with allowed, remaining and retry_after; equal times go by request_id.

    A null time or cost is refused as it cannot be judged; null projects are one project."""
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    d = requests.withColumns({"_at": micros, "_slot": F.floor(micros / (seconds * 1_000_000)).cast("long")})
    slots = d.where("_slot is not null").select("project_id", "_slot").distinct()  # small: a row for each busy window
    before = F.lag("_slot").over(Window.partitionBy("project_id").orderBy("_slot"))
    begins = slots.withColumn("_new", (F.col("_slot") > before + 1).cast("int"))  # an empty slot lies between
    stretch = F.coalesce(F.sum("_new").over(Window.partitionBy("project_id").orderBy("_slot")), F.lit(0))
    begins = begins.select(F.col("project_id").alias("_p"), F.col("_slot").alias("_s"), stretch.alias("_stretch"))
    d = d.join(begins, d["project_id"].eqNullSafe(begins["_p"]) & (d["_slot"] == begins["_s"]), "left").drop("_p", "_s", "_slot")
    names = [c for c in d.columns if c not in ("_at", "_stretch")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, window = None, SlidingWindow(limit, seconds)
        for batch in batches:
            rows = []
            for project, stretch, at, cost in zip(*(batch[c].to_pylist() for c in ("project_id", "_stretch", "_at", "cost")), strict=True):
                if here != (project, stretch):
                    here, window = (project, stretch), SlidingWindow(limit, seconds)
                rows.append((False, None) if at is None or cost is None else window.ask(at, cost))
            allowed, left = zip(*rows, strict=True) if rows else ((), ())
            retry = [0 if a else seconds for a in allowed]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(allowed, pa.bool_()), pa.array(left, pa.int64()), pa.array(retry, pa.int32())], [*names, "allowed", "remaining", "retry_after"])

    dealt = d.repartition("project_id", "_stretch").sortWithinPartitions("project_id", "_stretch", "_at", "request_id")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return dealt.select(*names, "_at", "_stretch").mapInArrow(run, f"{kinds}, allowed boolean, remaining long, retry_after int")
