"""Mergeable sketches: distinct counts and quantiles kept by a fine key and merged upward, with the error they may have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative standard error of a HyperLogLog sketch of 2^n registers, times the root of its size.
HLL_ERROR = 1.04
#: Bits of a distinct-count sketch, and the accuracy of a quantile sketch, by default.
HLL_BITS, KLL_K = 12, 200


def distinct_error(bits: int = HLL_BITS, deviations: float = 4.0) -> float:
    """The relative error that a distinct count keeps within, at so many standard deviations."""
    return deviations * HLL_ERROR / 2 ** (bits / 2)


def rank_error(k: int = KLL_K, deviations: float = 2.0) -> float:
    """The share of rows by which a quantile's rank may be off (1.33 % at k = 200 with 99 % confidence), widened by a factor."""
    return deviations * 2.296 / k**0.9723


def daily_sketches(df: DataFrame, by: list[str], key: Column, value: Column, bits: int = HLL_BITS, k: int = KLL_K) -> DataFrame:
    """One row per ``by``: ``n``, ``keys`` (a sketch of distinct keys) and ``values`` (one of the values' distribution). Nulls are in neither; a group without values has a null sketch."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.hll_sketch_agg(key, bits).alias("keys"), F.kll_sketch_agg_double(value.cast("double"), k).alias("values"))


def merged(sketches: DataFrame, by: list[str], ranks: dict[str, float]) -> DataFrame:
    """Sketches of :func:`daily_sketches` merged upward: ``n``, ``keys`` (estimated distinct keys), and the quantile of each rank by name. Only sketches are read, a fixed size each."""
    both = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("keys").alias("k"), F.kll_merge_agg_double("values").alias("v"))
    quantiles = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("v", F.lit(r))).alias(name) for name, r in ranks.items()]
    return both.select(*by, "n", F.hll_sketch_estimate("k").alias("keys"), *quantiles)


def checked(estimates: DataFrame, rows: DataFrame, by: list[str], key: Column, value: Column, name: str, rank: float, bits: int = HLL_BITS, k: int = KLL_K) -> DataFrame:
    """``by``, the exact count of keys and rows, and whether the estimate of the keys and the rank of the estimated quantile lie within their errors."""
    at = rows.join(estimates.select(*by, F.col("keys").alias("__keys"), F.col(name).alias("__q")), by)
    found = at.groupBy(*by).agg(
        F.count(value).alias("n"), F.count_distinct(key).alias("users"), F.first("__keys").alias("__keys"),
        F.count_if(value < F.col("__q")).alias("__below"), F.count_if(value <= F.col("__q")).alias("__upto"),
    )
    slack = rank_error(k) * F.col("n") + 1
    near = (F.col("__below") <= rank * F.col("n") + slack) & (F.col("__upto") >= rank * F.col("n") - slack)
    close = F.abs(F.col("__keys") - F.col("users")) <= distinct_error(bits) * F.col("users") + 1
    return found.select(*by, "n", "users", close.alias("users_ok"), near.alias("quantile_ok"))
