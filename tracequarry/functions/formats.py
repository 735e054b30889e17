"""Numbers as a dashboard shows them, and canonical JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def error_tone(rate: Column) -> Column:
    return F.when(rate > 0.05, "critical").when(rate > 0.01, "warning").otherwise("neutral")


def shown_duration(ms: Column) -> Column:
    """Whole milliseconds below one second, seconds with two decimals beyond."""
    short = F.concat(F.floor(ms + 0.5).cast("long").cast("string"), F.lit("ms"))
    return F.when(ms.isNull(), "—").when(ms >= 1000, F.format_string("%.2fs", ms / 1000.0)).otherwise(short)


def shown_cost(usd: Column) -> Column:
    """Two decimals, four below one cent of a dollar."""
    v = usd.cast("double")
    return F.when(v.isNull(), "—").when(v == 0, "$0").when(v < 0.01, F.format_string("$%.4f", v)).otherwise(F.format_string("$%.2f", v))


def shown_share(rate: Column) -> Column:
    return F.when(rate.isNull(), "—").otherwise(F.format_string("%.1f%%", rate * 100.0))


def shown_count(n: Column) -> Column:
    """Compact: thousands as k, millions as M."""
    v = n.cast("double")
    return (
        F.when(v >= 1e6, F.format_string("%.1fM", v / 1e6)).when(v >= 1e3, F.format_string("%.1fk", v / 1e3))
        .when((v > 0) & (v < 1), F.format_string("%.2f", v)).otherwise(F.floor(v + 0.5).cast("long").cast("string"))
    )


def shown_age(at: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 60_000_000)
    ago = lambda n, unit: F.concat(F.floor(n).cast("long").cast("string"), F.lit(unit + " ago"))
    return F.when(at.isNull(), "—").when(minutes < 1, "just now").when(minutes < 60, ago(minutes, "m")).when(minutes < 1440, ago(minutes / 60, "h")).otherwise(ago(minutes / 1440, "d"))


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """JSON with keys in order and no spaces, numbers as written in Python; null for what is no JSON."""

    def one(t: str | None) -> str | None:
        try:
            return json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return None

    return texts.map(one, na_action=None).astype(object).where(lambda s: s.notna(), None)


def content_hash(value: Column) -> Column:
    """SHA-256 of a JSON text's canonical form."""
    return F.sha2(canonical_json(value), 256)
