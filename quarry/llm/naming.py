"""Integer names of values by sorting: equal values share a name, different ones never do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise

#: So many hashes that different values share go to every task; beyond it they are joined like any other.
FEW = 100_000


def names_of(rows: DataFrame, *keys: str) -> DataFrame:
    """The distinct keys (none of them null) with ``name``: sorted within the partitions that their hash deals them to, then counted. Written, as a name must not change."""
    return materialise(rows.select(*keys).distinct().sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()), "names")


def named(rows: DataFrame, values: list[str], mark: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """``rows`` with ``name`` in place of the values (none of them null).

    Only distinct values are shuffled; rows meet their names at a hash of the values. Where different values share a
    hash, their rows keep the values and are named by them, so a name is never shared. ``rows`` is evaluated twice, and
    columns that differ from one evaluation to the next are taken from the second. No rows give no rows.
    """
    others = [c for c in rows.columns if c not in values]
    hashed = mark(*values).alias("mark")
    sorted_ = rows.select(*values).distinct().sortWithinPartitions(*values).select(hashed, F.monotonically_increasing_id().alias("name"))
    names = materialise(sorted_, "names")
    shared = materialise(names.groupBy("mark").count().where("count > 1").select("mark", F.lit(True).alias("shared")), "shared")
    several = shared.count()
    if not several:
        return rows.select(*others, hashed).join(names, "mark").drop("mark")
    kept = rows.select(*others, hashed, *values).join(F.broadcast(shared) if several <= FEW else shared, "mark", "left")
    kept = materialise(kept.select(*others, "mark", "shared", *[F.when(F.col("shared"), F.col(v)).alias(v) for v in values]), "marked")
    alone = kept.where("shared IS NULL").drop("shared", *values).join(names, "mark").drop("mark")
    alike = kept.where("shared").drop("shared", "mark")
    own = names_of(alike, *values).withColumn("name", -1 - F.col("name"))
    return alone.unionByName(alike.join(own, values).drop(*values))
