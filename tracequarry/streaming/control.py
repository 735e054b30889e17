"""Control state (alert rules, sampling marks, the review queue) that changes as a whole or not at all.

Tables lie in folders that are written once. A commit is one small file that names the folders of every table; it is made
under another name and renamed to its number, which a file system does in one step and refuses where the number is taken.
A round that is killed before this leaves the old state, and one that another round overtook is refused."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracequarry.operators import alerts, review

DIGITS = 12


class Overtaken(Exception):
    """Another change was committed first."""


class ControlState:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        folder = self._hadoop("commits")
        if not self._files.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._files.listStatus(folder) if s.getPath().getName().isdigit())

    def version(self) -> int:
        """The number of the last commit; 0 before the first."""
        return max(self._numbers(), default=0)

    def _tables(self, version: int) -> dict[str, list[str]]:
        if not version:
            return {}
        stream = self._files.open(self._hadoop(f"commits/{version:0{DIGITS}}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        folders = self._tables(self.version() if version is None else version).get(table)
        if not folders:
            raise LookupError(f"no table {table}")
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])

    def commit(self, version: int, replaced: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None) -> int:
        """Tables replaced or added to, all at once, on top of `version`; Overtaken if that is not the last any more."""
        tables = dict(self._tables(version))
        for name, df in (replaced or {}).items():
            tables[name] = [self._write(name, df)]
        for name, df in (appended or {}).items():
            tables[name] = [*tables.get(name, []), self._write(name, df)]
        self._publish(version + 1, tables)
        return version + 1

    def _write(self, name: str, df: DataFrame) -> str:
        folder = f"data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def _publish(self, version: int, tables: dict[str, list[str]]) -> None:
        draft, final = self._hadoop(f"commits/draft-{uuid.uuid4().hex}"), self._hadoop(f"commits/{version:0{DIGITS}}")
        out = self._files.create(draft)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        if self._files.exists(final) or not self._files.rename(draft, final):
            self._files.delete(draft, False)
            raise Overtaken(f"version {version} is there already")

    def clean(self, keep: int = 10) -> None:
        """Deletes commits before the last `keep`, and folders that none of those names. Not while a round is running."""
        numbers = self._numbers()
        for n in numbers[:-keep]:
            self._files.delete(self._hadoop(f"commits/{n:0{DIGITS}}"), False)
        named = {f for n in numbers[-keep:] for folders in self._tables(n).values() for f in folders}
        if self._files.exists(self._hadoop("data")):
            for s in self._files.listStatus(self._hadoop("data")):
                if f"data/{s.getPath().getName()}" not in named:
                    self._files.delete(s.getPath(), True)


def alert_round(state: ControlState, rollups: DataFrame, now: datetime, secret: str, send: Callable[[str, bytes, dict[str, str]], int] = alerts.post) -> DataFrame:
    """One round over roll-ups, run by a clock apart from ingest: the rules' decisions; their next state is committed."""
    version = state.version()
    decided, rules = alerts.evaluated(state.read("rules", version), rollups, now, secret, send)
    try:
        state.commit(version, replaced={"rules": rules})
    finally:
        decided.unpersist()
    return decided


def sampling_round(state: ControlState, rollups: DataFrame, spans: DataFrame, now: datetime) -> int:
    """One round of the sampler: new items join the queue and the projects' marks move, both or neither. Gives the version."""
    version = state.version()
    settings = state.read("settings", version)
    items, marks = review.sample_projects(rollups, spans, state.read("queue", version), settings, now)
    moved = settings.join(marks.withColumnRenamed("last_scanned_at", "_mark"), "project_id", "left")
    moved = moved.withColumn("last_scanned_at", F.coalesce("_mark", "last_scanned_at")).select(*settings.columns)
    items = items.select("project_id", "trace_id", "status", "sampled_as", "severity", "output")
    return state.commit(version, replaced={"settings": moved}, appended={"queue": items})
