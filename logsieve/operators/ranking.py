"""Running totals and exact quantiles over a large ordered set of values.

A window over the whole set would put every row into one task. Here the rows are
range-partitioned by value, each range is summed, and only the range totals (one
row per partition) are accumulated in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def running_totals(counts: DataFrame, value: str, weights: Sequence[str]) -> DataFrame:
    """Adds ``<w>_before`` (sum over smaller values) and ``<w>_total`` for each weight.

    ``counts`` has one row per distinct value, so the ranges are even whatever
    the weights are. The ranged rows are written once: range bounds come from a
    sample, and both uses must see the same ranges.
    """
    ranged = written(
        counts.repartitionByRange(F.col(value)).withColumn("_range", F.spark_partition_id()),
        "ranged",
    )
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.partitionBy()
    totals = ranged.groupBy("_range").agg(*[F.sum(weight).alias(weight) for weight in weights])
    offsets = totals.select(
        "_range",
        *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"{w}_offset") for w in weights],
        *[F.sum(w).over(overall).alias(f"{w}_total") for w in weights],
    )
    inside = (
        Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = ranged.join(F.broadcast(offsets), "_range")
    running = {
        f"{w}_before": F.col(f"{w}_offset") + F.coalesce(F.sum(w).over(inside), F.lit(0))
        for w in weights
    }
    return joined.withColumns(running).drop("_range", *[f"{w}_offset" for w in weights])


def quantile(value: str, weight: str, q: float) -> Column:
    """Aggregate over ``running_totals``: linear-interpolated quantile of the weighted values."""
    position = F.lit(q) * (F.col(f"{weight}_total") - 1)
    reached = F.col(f"{weight}_before") + F.col(weight)
    low = F.min(F.when(reached > F.floor(position), F.col(value)))
    high = F.min(F.when(reached > F.ceil(position), F.col(value)))
    share = F.max(position - F.floor(position))
    return low + (high - low) * share


def moments(value: str, weight: str) -> tuple[Column, Column]:
    """Mean and population deviation of weighted values, as aggregates."""
    n = F.sum(weight)
    mean = F.sum(F.col(value) * F.col(weight)) / n
    square = F.sum(F.col(value) * F.col(value) * F.col(weight)) / n
    return mean, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))


def grid_index(value: Column, step: float, last: int) -> Column:
    """Largest k in 0..last with ``value >= k * step`` in double arithmetic; -1 if none."""
    guess = F.floor(value / step)
    exact = (
        F.when(value >= (guess + 1) * F.lit(step), guess + 1)
        .when(value >= guess * F.lit(step), guess)
        .otherwise(guess - 1)
    )
    return F.greatest(F.least(exact, F.lit(last)), F.lit(-1)).cast("int")
