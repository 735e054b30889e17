"""Positions in a total order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequarry.scratch import written

_IN_PARTITION = (1 << 33) - 1


def positions(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with the row's place in the given order, from 0: ranges are sorted apart and shifted by the sizes of those before."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))}), "ordered")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    return dealt.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")


def sums_before(df: DataFrame, out: str, value: str, by: list[str], order: list[str]) -> DataFrame:
    """df with `out`: the sum of `value` over the rows of its group (by) that come before it in `order`.

    Rows are dealt by ranges of group and order, so that a group of any size is spread; each range adds what earlier ranges
    of the same group have."""
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in [*by, *order]]).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    inside = Window.partitionBy("_part", *by).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part", *by).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.sum("_sum").over(earlier)).where("_before is not null").drop("_sum")  # ranges that go on with a group
    local = ranged.withColumn("_local", F.sum(value).over(inside))
    # few rows, one at most for each range, and null-safe in the group
    r = sums.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], "_before")
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    none = F.lit(0).cast("long")
    joined = local.join(r, same, "left").withColumn(out, F.coalesce("_local", none) + F.coalesce("_before", none))
    return joined.select(*df.columns, out)
