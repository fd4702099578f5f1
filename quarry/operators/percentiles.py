"""Three percentiles without interpolation, which differ on small samples, and the upper median."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upper_median(x: Column) -> Column:
    s = F.sort_array(F.collect_list(x))
    return F.try_element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def percent_rank_value(df: DataFrame, key: list[str], x: str, q: float, name: str) -> DataFrame:
    """Per key, the highest value whose percent rank is at most q."""
    ranked = df.where(F.col(x).isNotNull()).withColumn("__r", F.percent_rank().over(Window.partitionBy(*key).orderBy(x)))
    return ranked.groupBy(*key).agg(F.max(F.when(F.col("__r") <= q, F.col(x))).alias(name))


def ranked_values(df: DataFrame, key: list[str], x: str, picks: dict[str, Column]) -> DataFrame:
    """Per key, the value at each place of the sorted sample, counted from 0; places may use ``n``, its size. Nulls are left out.

    Values are counted first, so that a window holds distinct values and no row holds a whole sample.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*key, F.col(x).alias("__x")).agg(F.count("*").alias("__k"))
    up = Window.partitionBy(*key).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("__upto", F.sum("__k").over(up)).withColumn("n", F.sum("__k").over(Window.partitionBy(*key)))
    return placed.groupBy(*key).agg(*[F.min(F.when(F.col("__upto") > place, F.col("__x"))).alias(name) for name, place in picks.items()])


def place_even(q: float) -> Column:
    return F.bround(F.lit(q) * (F.col("n") - 1), 0)


def place_ceil(q: float) -> Column:
    return F.greatest(F.ceil(F.round(F.lit(q) * F.col("n"), 9)), F.lit(1)) - 1


def place_upper_median() -> Column:
    return F.floor(F.col("n") / 2)
