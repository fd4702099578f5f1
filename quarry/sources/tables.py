"""Readers of tables: Parquet folders, point lookups, caches, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, **options: str) -> DataFrame:
    """A database table in ranges of its key, read at most ``parts`` ranges at a time."""
    return spark.read.jdbc(url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts, properties={"fetchsize": "10000", **options})


def by_id_ranges(df: DataFrame, key: str, parts: int) -> DataFrame:
    """The table dealt into ranges of its key, for scans that report by range."""
    return df.repartitionByRange(parts, key)


def point_lookup(keys: DataFrame, table: DataFrame, key: str, unknown: DataFrame | None = None) -> DataFrame:
    """``keys`` with ``lookup``: present, missing, or unknown for keys whose batch failed (never missing then)."""
    seen = table.select(key).distinct().withColumn("__seen", F.lit(True))
    out = keys.join(seen, key, "left")
    lost = F.lit(False)
    if unknown is not None:
        out = out.join(unknown.select(key).distinct().withColumn("__lost", F.lit(True)), key, "left")
        lost = F.coalesce("__lost", F.lit(False))
    state = F.when(F.coalesce("__seen", F.lit(False)), "present").when(lost, "unknown").otherwise("missing")
    return out.withColumn("lookup", state).drop("__seen", "__lost")


def normalize_hits(hits: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Search hits with defaults for absent columns and nulls; a hit without a permission counts as restricted."""
    for name, value in {**defaults, "permission_level": "restricted"}.items():
        hits = hits.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in hits.columns else F.lit(value))
    return hits


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(cache, key, "left_anti")


def cache_put(cache: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The cache with ``new`` in it, whose rows win."""
    return cache.join(new, key, "left_anti").unionByName(new)


def cache_evict(cache: DataFrame, order: Column, keep: int) -> DataFrame:
    """The last ``keep`` rows by insertion order."""
    return cache.orderBy(order.desc()).limit(keep)


def refresh_snapshot(old: DataFrame, new: DataFrame, key: str, revision: int) -> DataFrame:
    """A full refresh: rows of ``new`` are active under the revision, rows that only ``old`` has stay and turn inactive."""
    values = [c for c in new.columns if c != key]
    a, b = old.alias("a"), new.withColumn("__in", F.lit(True)).alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    fresh = F.coalesce(F.col("b.__in"), F.lit(False))
    return joined.select(
        F.coalesce(f"b.{key}", f"a.{key}").alias(key), *[F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in values],
        fresh.cast("int").alias("is_active"), F.when(fresh, F.lit(revision)).otherwise(F.col("a.revision")).alias("revision"),
    )


def latest_per_key(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    rank = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(rank)).where("__n = 1").drop("__n")
