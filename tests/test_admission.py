"""Sliding-window admission, batch and stream."""

from __future__ import annotations

import datetime as dt
import random
import tempfile

import pytest

from tracequarry.operators.admission import admitted
from tracequarry.streaming import admission

BEGIN = dt.datetime(2024, 1, 1)
KINDS = "project_id string, request_id long, at timestamp, cost long"


def requests(n=400, seed=1):
    rng, at, out = random.Random(seed), {"a": 0.0, "b": 0.0, None: 0.0}, []
    for i in range(n):
        p = rng.choice(["a", "a", "b", None])
        at[p] += rng.choice([0, 1, 5, 9, 200 if rng.random() < 0.05 else 3])
        out.append((p, i, BEGIN + dt.timedelta(seconds=at[p]), rng.randrange(8)))
    return out


def brute(rows, limit, seconds):
    out, passed = {}, {}
    for p, i, at, cost in sorted(rows, key=lambda r: (r[2], r[1])):
        own = passed.setdefault(p, [])
        used = sum(c for t, c in own if t > at - dt.timedelta(seconds=seconds))
        ok = used + cost <= limit
        if ok:
            own.append((at, cost))
        out[i] = (ok, max(0, limit - used - (cost if ok else 0)), 0 if ok else seconds)
    return out


@pytest.mark.parametrize(("limit", "seconds"), [(20, 60), (7, 10), (0, 60), (10**6, 60)])
def test_batch_equals_the_definition(spark, limit, seconds):
    rows = requests()
    got = admitted(spark.createDataFrame(rows, KINDS).repartition(5), limit, seconds).collect()
    assert {r["request_id"]: (r["allowed"], r["remaining"], r["retry_after"]) for r in got} == brute(rows, limit, seconds) and len(got) == len(rows)


def test_nulls_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1, None, 1), ("a", 2, BEGIN, None), ("a", 3, BEGIN, 1)], KINDS)
    assert {r["request_id"]: r["allowed"] for r in admitted(df).collect()} == {1: False, 2: False, 3: True}
    assert admitted(df.where("false")).collect() == []


def run(spark, rows, parts=3):
    folder = tempfile.mkdtemp(prefix="spark-")
    for i in range(parts):
        part = sorted(rows, key=lambda r: (r[2], r[1]))[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        spark.createDataFrame(part, KINDS).coalesce(1).write.mode("append").parquet(folder + "/in")
    settings = admission.SETTINGS | {"spark.sql.shuffle.partitions": "2"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(KINDS).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(folder + "/in")
        out = admission.admission_stream(stream, 20, 60).writeStream.outputMode("update").foreachBatch(lambda d, _: d.write.mode("append").parquet(folder + "/out")).option("checkpointLocation", folder + "/c").trigger(availableNow=True).start()
        assert out.awaitTermination(200)
        return {r["request_id"]: (r["allowed"], r["remaining"], r["retry_after"]) for r in spark.read.parquet(folder + "/out").collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_stream_equals_batch(spark):
    rows = [r for r in requests(160) if r[0]]
    assert run(spark, rows) == brute(rows, 20, 60)


def test_a_broken_state_lets_requests_pass():
    import pandas as pd

    class Broken:
        def get(self):
            raise OSError("gone")

    p = admission.Admission(5, 60)
    p.state, p.handle = Broken(), None
    rows = pd.DataFrame({"request_id": [1, 2], "at": pd.to_datetime([BEGIN, BEGIN]), "cost": [9, 9]})
    out = next(p.handleInputRows(("a",), iter([rows]), None))
    assert out["allowed"].all() and (out["remaining"] == 5).all() and (out["retry_after"] == 0).all()
