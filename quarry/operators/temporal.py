"""Joins and frames along time: as-of, interval, counts of the last while."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hours(at: Column) -> Column:
    """Whole hours since 1970, whatever the session's zone is."""
    return F.unix_date(at.cast("date")).cast("long") * 24 + F.hour(at)


def _bucket(at: Column, width: int) -> Column:
    return F.floor(hours(at) / width)


def as_of_join(left: DataFrame, right: DataFrame, on: str, left_at: str, right_at: str, forward: bool = False, within: str | None = None, tie: list[str] | None = None, bucket_hours: int = 24) -> DataFrame:
    """All rows of ``left`` with ``match``, the struct of the row of ``right`` of the same ``on`` that is nearest before it (or at the same time), or after it if ``forward``.

    ``within`` is an interval such as ``7 days`` beyond which there is no match; of rows at the same time the one
    greatest by ``tie`` counts. Rows without key or time match nothing.

    Both sides are merged by time within a key and a stretch of ``bucket_hours``; what a stretch hands on to those after
    it is one row, so a key is as many tasks as it has stretches.
    """
    tie = tie or []
    shape = {"l": left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType, "r": right.select(F.struct(*right.columns).alias("r")).schema["r"].dataType}
    ranks = [F.col(c) for c in tie]
    place = F.struct(F.col(right_at).alias("at"), *[r.alias(f"t{n}") for n, r in enumerate(ranks)])
    key = F.col(on)
    rights = right.where(key.isNotNull() & F.col(right_at).isNotNull()).select(key.alias("__k"), F.col(right_at).alias("__at"), F.lit(0).alias("__side"), place.alias("__place"), F.struct(*right.columns).alias("r"), F.lit(None).cast(shape["l"]).alias("l"))
    rights = rights.withColumn("__b", _bucket(F.col("__at"), bucket_hours))
    asking = key.isNotNull() & F.col(left_at).isNotNull()
    lefts = left.where(asking).select(key.alias("__k"), F.col(left_at).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(rights.schema["__place"].dataType).alias("__place"), F.lit(None).cast(shape["r"]).alias("r"), F.struct(*left.columns).alias("l"))
    lefts = lefts.withColumn("__b", _bucket(F.col("__at"), bucket_hours))
    # What each stretch hands on: its last row, or its first if the join looks forward (of those at one time the greatest).
    near = F.min("__place.at") if forward else F.max("__place.at")
    edge = rights.groupBy("__k", "__b").agg(near.alias("__near"))
    ends = rights.join(edge, ["__k", "__b"]).where(F.col("__at") == F.col("__near")).groupBy("__k", "__b").agg(F.max_by(F.struct("__at", "__place", "r"), "__place").alias("__end"))
    stretches = lefts.select("__k", "__b").distinct().withColumn("__end", F.lit(None).cast(ends.schema["__end"].dataType)).withColumn("__asks", F.lit(True)).unionByName(ends.withColumn("__asks", F.lit(False)))
    over = Window.partitionBy("__k").orderBy(F.desc("__b") if forward else F.asc("__b")).rangeBetween(Window.unboundedPreceding, -1)
    handed = stretches.withColumn("__end", F.last("__end", ignorenulls=True).over(over)).where("__asks AND __end IS NOT NULL")
    handed = handed.select("__k", F.col("__end.__at").alias("__at"), F.lit(0).alias("__side"), F.col("__end.__place").alias("__place"), F.col("__end.r").alias("r"), F.lit(None).cast(shape["l"]).alias("l"), "__b")
    along = [F.desc("__at") if forward else F.asc("__at"), "__side", *[F.col(f"__place.t{n}").asc_nulls_first() for n in range(len(tie))]]
    last = F.last(F.when(F.col("__side") == 0, F.struct("__at", "r")), ignorenulls=True).over(Window.partitionBy("__k", "__b").orderBy(*along).rowsBetween(Window.unboundedPreceding, 0))
    met = rights.unionByName(handed).unionByName(lefts).withColumn("__m", last).where("__side = 1")
    if within is not None:
        gap = F.col("__m.__at") - F.col("__at") if forward else F.col("__at") - F.col("__m.__at")
        met = met.withColumn("__m", F.when(gap <= F.expr(f"INTERVAL {within}"), F.col("__m")))
    out = met.select("l.*", F.col("__m.r").alias("match"))
    return out.unionByName(left.where(~asking | key.isNull() | F.col(left_at).isNull()).withColumn("match", F.lit(None).cast(shape["r"])))


def interval_join(left: DataFrame, right: DataFrame, on: str, left_at: str, right_at: str, lower: str, upper: str, bucket_hours: int = 24) -> DataFrame:
    """``l, r``: pairs of rows of the same ``on`` where ``right_at`` lies from ``left_at - lower`` to ``left_at + upper``, both included.

    Rows meet by key and stretch of time: a left row is sent to each stretch that its interval touches, a right row to
    its own, so a pair is made once and a key is as many tasks as it has stretches. Rows without key or time make none.
    """
    low, high = F.col(left_at) - F.expr(f"INTERVAL {lower}"), F.col(left_at) + F.expr(f"INTERVAL {upper}")
    a = left.select(F.col(on).alias("k"), low.alias("low"), high.alias("high"), F.struct(*left.columns).alias("l")).where("k IS NOT NULL AND low <= high")
    a = a.withColumn("b", F.explode(F.sequence(_bucket(F.col("low"), bucket_hours), _bucket(F.col("high"), bucket_hours))))
    b = right.select(F.col(on).alias("k"), F.col(right_at).alias("at"), F.struct(*right.columns).alias("r")).where("k IS NOT NULL AND at IS NOT NULL").withColumn("b", _bucket(F.col("at"), bucket_hours))
    return a.join(b, ["k", "b"]).where("at BETWEEN low AND high").select("l", "r")


def in_the_last(df: DataFrame, on: str, at: str, frame: str, measures: dict[str, str], bucket_hours: int = 24) -> DataFrame:
    """``df`` with measures (SQL aggregates by name) over the rows of the same ``on`` from ``frame`` (an interval, no longer than a stretch) before each row up to it, its equals in time included.

    A stretch sees the one before it as well, as far as the frame reaches back, and no self join is made. Rows without
    time have measures over each other; rows without a key are a key of their own.
    """
    rows = df.select(F.struct(*df.columns).alias("row"), F.col(on).alias("k"), F.col(at).alias("at")).withColumns({"b": _bucket(F.col("at"), bucket_hours), "own": F.lit(True)})
    ends = (F.col("b") + 1) * bucket_hours
    reach = hours(F.col("at") + F.expr(f"INTERVAL {frame}")) >= ends
    context = rows.where(reach).withColumns({"b": F.col("b") + 1, "own": F.lit(False)})
    both = rows.unionByName(context).select("row.*", F.col("k").alias("__k"), F.col("b").alias("__b"), F.col("at").alias("__at"), F.col("own").alias("__own"))
    over = f"OVER (PARTITION BY __k, __b ORDER BY __at RANGE BETWEEN INTERVAL {frame} PRECEDING AND CURRENT ROW)"
    out = both.selectExpr("*", *[f"{sql} {over} AS {name}" for name, sql in measures.items()])
    return out.where("__own").drop("__k", "__b", "__at", "__own")
