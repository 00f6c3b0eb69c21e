"""Running sums, running maxima and earlier rows along an order within groups, without a task that holds a whole group.

A group's rows are dealt to buckets of consecutive order, windows run inside buckets, and what the buckets before
contribute is looked up in one row for each bucket. The bucket is a column that never falls along the order, such as a
place divided by a constant, so it is the same in every attempt of a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bucket where the order is a place; bytes where it is an offset.
PLACES, BYTES = 1 << 14, 1 << 22


def bucket_of(order: str) -> Column:
    """The bucket of an order column: offsets by BYTES, places by PLACES."""
    return F.expr(f"{order} div {BYTES if order.endswith('offset') else PLACES}")


def _with_buckets(df: DataFrame, by: list[str], order: list[str], **totals: Column) -> tuple[DataFrame, DataFrame, object]:
    df = df.withColumn("__bucket", bucket_of(order[0]))
    each = df.groupBy(*by, "__bucket").agg(*(c.alias(n) for n, c in totals.items()))
    return df, each, Window.partitionBy(*by).orderBy("__bucket")


def _joined(df: DataFrame, each: DataFrame, by: list[str]) -> DataFrame:
    keys = [*by, "__bucket"]
    right = each.select(*(F.col(k).alias(f"__r_{k}") for k in keys), *(c for c in each.columns if c not in keys))
    on = [df[k].eqNullSafe(right[f"__r_{k}"]) for k in keys]
    return df.join(right, on, "left").drop(*(f"__r_{k}" for k in keys), "__bucket")


def sum_before(df: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """df with out: the sum of value over the rows of the group before each, 0 for the first."""
    df = df.withColumn("__value", value)
    df, each, buckets = _with_buckets(df, by, order, __total=F.sum("__value"))
    each = each.withColumn("__before", F.coalesce(F.sum("__total").over(buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__total")
    inside = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return _joined(df, each, by).withColumn(out, F.col("__inside") + F.col("__before")).drop("__value", "__inside", "__before")


def max_before(df: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """df with out: the greatest value of the rows of the group before each, null for the first."""
    df = df.withColumn("__value", value)
    df, each, buckets = _with_buckets(df, by, order, __most=F.max("__value"))
    each = each.withColumn("__before", F.max("__most").over(buckets.rowsBetween(Window.unboundedPreceding, -1))).drop("__most")
    inside = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__inside", F.max("__value").over(inside))
    return _joined(df, each, by).withColumn(out, F.greatest("__inside", "__before")).drop("__value", "__inside", "__before")


def value_before(df: DataFrame, by: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """df with out: value of the row of the group before each, null for the first."""
    df = df.withColumn("__value", value)
    df, each, buckets = _with_buckets(df, by, order, __last=F.max_by("__value", F.struct(*order)))
    each = each.withColumn("__before", F.lag("__last").over(buckets)).drop("__last")
    inside = Window.partitionBy(*by, "__bucket").orderBy(*order)
    df = df.withColumn("__inside", F.lag("__value").over(inside)).withColumn("__first", F.row_number().over(inside) == 1)
    return _joined(df, each, by).withColumn(out, F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__inside"))).drop("__value", "__inside", "__before", "__first")
