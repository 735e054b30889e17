"""Threshold rules: whether they fire now, delivery, and the state that they leave behind."""

from __future__ import annotations

import hashlib
import hmac
import json
import urllib.request
from collections.abc import Callable
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from . import metrics

MOST_FAILURES = 10
TIMEOUT = 10
MOST_FIRED = 10_000


def decide(rules: DataFrame, now: datetime) -> DataFrame:
    """rules with a value and sample_size, and their decision: the first gate that holds, in the order cooldown, sample size, threshold."""
    since = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("last_fired_at").cast("timestamp"))) / 1_000_000
    over = F.when(F.col("comparison") == "above", F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    decision = (
        F.when(~F.col("enabled"), "disabled").when(since < F.col("cooldown_seconds"), "cooldown")
        .when((F.col("sample_size") < F.col("min_sample_size")) | F.col("value").isNull(), "too_few").when(over, "fire").otherwise("ok")
    )
    return rules.withColumn("decision", decision)


def after_delivery(decided: DataFrame, delivered: DataFrame, now: datetime) -> DataFrame:
    """The rules' next state; delivered: rule, ok. A failed delivery starts the cooldown too, MOST_FAILURES in a row disable the rule."""
    out = decided.join(delivered, "rule", "left")
    fired = F.col("decision") == "fire"
    failures = F.when(fired & F.coalesce("ok", F.lit(False)), 0).when(fired, F.col("consecutive_failures") + 1).otherwise(F.col("consecutive_failures"))
    return out.withColumns({
        "last_fired_at": F.when(fired, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("last_fired_at")),
        "consecutive_failures": failures,
        "enabled": F.col("enabled") & (failures < MOST_FAILURES),
    }).drop("ok")


def notice(rule: Row, now: datetime) -> bytes:
    """What a webhook gets of a fired rule, as compact JSON."""
    # fixed values: the names of the fields, which receivers read
    about = {k: rule[k] for k in ("rule", "metric", "comparison", "threshold", "window_seconds")}
    body = {"type": "alert.triggered", "rule": about, "value": rule["value"], "sample_size": rule["sample_size"], "project_id": rule["project_id"], "triggered_at": now.isoformat()}
    return json.dumps(body, separators=(",", ":")).encode()


def signature(payload: bytes, secret: str) -> str:
    """HMAC-SHA256 of the very bytes that are sent."""
    return hmac.new(secret.encode(), payload, hashlib.sha256).hexdigest()


def post(url: str, payload: bytes, headers: dict[str, str]) -> int:
    with urllib.request.urlopen(urllib.request.Request(url, payload, headers), timeout=TIMEOUT) as reply:
        return reply.status


def deliver(fired: DataFrame, secret: str, now: datetime, send: Callable[[str, bytes, dict[str, str]], int] = post) -> DataFrame:
    """rule, ok of fired rules (with webhook_url), sent from the driver; a status under 300 is a success.

    Rules are settings that people write; more than MOST_FIRED at once is an error."""
    rows = fired.limit(MOST_FIRED + 1).collect()
    if len(rows) > MOST_FIRED:
        raise ValueError(f"over {MOST_FIRED} rules fire at once")
    out: list[tuple[Any, bool]] = []
    for r in rows:
        payload = notice(r, now)
        headers = {"content-type": "application/json", "x-signature": signature(payload, secret), "x-event": "alert.triggered"}
        try:
            ok = send(r["webhook_url"], payload, headers) < 300
        except Exception:  # an endpoint may fail in any way; the rule's count of failures records it
            ok = False
        out.append((r["rule"], ok))
    return fired.sparkSession.createDataFrame(out, "rule string, ok boolean")


def evaluated(rules: DataFrame, traces: DataFrame, now: datetime, secret: str, send: Callable[[str, bytes, dict[str, str]], int] = post) -> tuple[DataFrame, DataFrame]:
    """One round: decisions of all rules, and their next state, with fired ones delivered."""
    values = metrics.alert_values(traces, rules, now).select("rule", "sample_size", "value")
    decided = decide(rules.join(values, "rule"), now).persist()
    state = after_delivery(decided, deliver(decided.where("decision = 'fire'"), secret, now, send), now)
    return decided, state.select(*rules.columns)
