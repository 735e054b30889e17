"""Errors of one row kept to that row.

A column of Spark's own functions fails as a whole job, so built-in evaluators never raise. What users add, and what may fail
or hang on one value (patterns, providers, checks), runs through isolated(): each row gives a value, or null and a reason."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import Any

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Characters of a reason; seconds that a pattern may take for one text.
CLIP, PATTERN_SECONDS = 2000, 1.0


class Unscoreable(Exception):
    """A gap and no fault: its message alone is the reason."""


def reason_of(error: Exception) -> str:
    text = str(error) if isinstance(error, Unscoreable) else f"{type(error).__name__}: {error}"
    return text[:CLIP]


def isolated(f: Callable[..., Any], kind: T.DataType, nulls: bool = False) -> Callable[..., Column]:
    """A function of columns that gives struct(value, error) by f of each row's values. With a null among them the value is
    null without a call, unless `nulls`."""
    arrow = to_arrow_type(kind)

    def run(*columns: pa.Array) -> pa.Array:
        values, errors = [], []
        for row in zip(*(c.to_pylist() for c in columns), strict=True):
            value = error = None
            if nulls or None not in row:
                try:
                    value = pa.scalar(f(*row), arrow).as_py()  # a value of another type is this row's error too
                except Exception as e:
                    error = reason_of(e)
            values.append(value)
            errors.append(error)
        return pa.StructArray.from_arrays([pa.array(values, arrow), pa.array(errors, pa.string())], ["value", "error"])

    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.StructType([T.StructField("value", kind), T.StructField("error", T.StringType())]))


def isolated_batches(f: Callable[..., pd.Series], kind: T.DataType) -> Callable[..., Column]:
    """As isolated(), for an f of whole Series: a batch in which it raises is halved until the rows at fault stand alone, so
    that a few of them cost a few calls more, not one for each row."""
    arrow = to_arrow_type(kind)

    def tried(parts: list[pd.Series], values: list, errors: list) -> None:
        try:
            found = list(f(*parts))
            if len(found) != len(parts[0]):
                raise ValueError(f"{len(found)} values for {len(parts[0])} rows")
            made = pa.array(found, arrow).to_pylist()
        except Exception as e:
            if len(parts[0]) <= 1:
                values += [None] * len(parts[0])
                errors += [reason_of(e)] * len(parts[0])
                return
            half = len(parts[0]) // 2
            tried([p.iloc[:half] for p in parts], values, errors)
            tried([p.iloc[half:] for p in parts], values, errors)
            return
        values += made
        errors += [None] * len(made)

    def run(*columns: pa.Array) -> pa.Array:
        values, errors = [], []
        if len(columns[0]):
            tried([c.to_pandas() for c in columns], values, errors)
        return pa.StructArray.from_arrays([pa.array(values, arrow), pa.array(errors, pa.string())], ["value", "error"])

    run.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.StructType([T.StructField("value", kind), T.StructField("error", T.StringType())]))


@lru_cache(256)
def _pattern(pattern: str, ignore_case: bool) -> regex.Pattern:
    return regex.compile(pattern, regex.IGNORECASE if ignore_case else 0)


FOUND = T.StructType([T.StructField("hit", T.BooleanType()), T.StructField("matched", T.StringType())])


def matched(text: Column, pattern: str, full: bool = False, ignore_case: bool = False, seconds: float = PATTERN_SECONDS) -> Column:
    """struct(value: struct(hit, matched), error): whether, and what, a pattern finds in a text. A pattern that goes on longer
    than `seconds` for one text, as nested repeats do, is stopped, and the reason says so."""

    def one(t: str) -> dict[str, Any]:
        p = _pattern(pattern, ignore_case)
        try:
            m = (p.fullmatch if full else p.search)(t, timeout=seconds)
        except TimeoutError:
            raise Unscoreable(f"the pattern took over {seconds:g} s for this text; it has nested repeats, perhaps") from None
        return {"hit": m is not None, "matched": m and m.group(0)[:500]}

    return isolated(one, FOUND)(text)


@F.arrow_udf(T.StringType())
def casefolded(texts: pa.Array) -> pa.Array:
    """Without differences of case, as Unicode defines it: ß is ss."""
    return pa.array([None if t is None else t.casefold() for t in texts.to_pylist()], pa.string())
