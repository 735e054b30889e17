"""Rows of one project, point reads, and removal by predicate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Rows up to which a table of settings is broadcast; larger ones are joined by shuffles.
SMALL = 100_000


def scoped(df: DataFrame, project_id: str) -> DataFrame:
    """The rows of one project. Reads of several projects at once carry project_id in their keys instead."""
    if not project_id:
        raise ValueError("a project is required")
    return df.where(F.col("project_id") == project_id)


def found(df: DataFrame, what: str, **key: object) -> Row:
    """The one row with the key's values; LookupError if there is none."""
    for name, value in key.items():
        df = df.where(F.col(name) == F.lit(value))
    rows = df.take(1)
    if not rows:
        raise LookupError(f"{what} {', '.join(str(v) for v in key.values())} not found")
    return rows[0]


def among(df: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows whose key is in `wanted`; the keys never pass the driver."""
    return df.join(small(wanted.select(*keys).distinct()), list(keys), "left_semi")


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """df, to be broadcast if it has at most `rows` rows; its size is counted first, up to that bound."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(df: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """df without the rows of `gone` and without what hangs on them, for a rewrite of the table."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def rejected(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that fit all rules, and the others with the reasons (names of the rules that do not hold; null does not)."""
    failing = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
    # judged once: the generator keeps the rules from being evaluated for the filter and again for the column
    judged = df.select(F.inline(F.array(F.struct(*df.columns, failing.alias("reasons")))))
    return judged.where(F.size("reasons") == 0).drop("reasons"), judged.where(F.size("reasons") > 0)


class Project:
    """What one project's requests may see: its rows of each table, by name. Tables without a project_id are not given."""

    def __init__(self, tables: dict[str, DataFrame], project_id: str):
        self._tables, self.project_id = tables, project_id

    def table(self, name: str) -> DataFrame:
        if name not in self._tables or "project_id" not in self._tables[name].columns:
            raise LookupError(f"no table {name} of projects")
        return scoped(self._tables[name], self.project_id)

    def found(self, name: str, **key: object) -> Row:
        """One row of the project; another project's row is not found, whoever knows its key."""
        return found(self.table(name), name, **key)

    def with_ids(self, name: str, wanted: DataFrame, *keys: str) -> DataFrame:
        return among(self.table(name), wanted, *keys)
