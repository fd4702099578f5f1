"""Places, running totals and greedy batches along one global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.steps import written


def running_totals(df: DataFrame, order: list[str | Column], value: Column | None = None) -> DataFrame:
    """``df`` with ``place`` (0, 1, ... by ``order``) and ``before``, the sum of ``value`` (a whole number, null counts as 0) over all earlier rows.

    The rows are sorted over all tasks and written; each task's count and sum, one row per task, is all that is added
    up in one place. Rows that the order can't tell apart come one after another. No rows give no rows.
    """
    rows = df.withColumn("__v", F.coalesce(F.lit(0) if value is None else value.cast("long"), F.lit(0)).cast("long"))
    placed = written(rows.orderBy(*order).withColumn("__seq", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__seq", 33)
    tasks = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"), F.sum("__v").alias("v"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = tasks.select("__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__n"), F.coalesce(F.sum("v").over(earlier), F.lit(0)).alias("__s"))
    own = Window.partitionBy("__part").orderBy("__seq").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("__part", part).withColumn("__own", F.coalesce(F.sum("__v").over(own), F.lit(0)))
    out = at.join(F.broadcast(starts), "__part")  # one row per task
    index = F.col("__seq").bitwiseAND((1 << 33) - 1)
    return out.select(*df.columns, (F.col("__n") + index).alias("place"), (F.col("__s") + F.col("__own")).alias("before"))


def containing(points: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """``points(at, ...)`` with ``span``, the struct of the one of the disjoint ``spans(low, high, ...)`` in which ``at`` lies (``low <= at < high``), or null.

    Spans are cut at multiples of ``width``; within such a stretch the last start at or before a point tells its span.
    So a stretch is a task's, whatever lies in it; many points at one place make that stretch long.
    """
    cut = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    starts = cut.select("__b", F.greatest("low", F.col("__b") * width).alias("__at"), F.lit(0).alias("__side"), F.struct(*spans.columns).alias("span"), F.lit(None).cast(points.select(F.struct(*points.columns)).schema[0].dataType).alias("__p"))
    asked = points.select(F.floor(F.col("at") / width).alias("__b"), F.col("at").alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(starts.schema["span"].dataType).alias("span"), F.struct(*points.columns).alias("__p"))
    last = F.last("span", ignorenulls=True).over(Window.partitionBy("__b").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0))
    found = starts.unionByName(asked).withColumn("span", last).where("__side = 1")
    return found.select("__p.*", F.when(F.col("span.high") > F.col("__p.at"), F.col("span")).alias("span"))


def greedy_batches(df: DataFrame, order: list[str | Column], size: Column, limit: int) -> DataFrame:
    """``df`` with ``place``, ``size`` and ``batch_no``: batches filled one after another along the order, each closed before the row that would exceed the limit.

    A row over the limit is a batch of its own. What a batch that starts at a row would hold is known for every row from
    the running total alone; which rows do start one is found by jumping from the first row's, twice as many batches at
    a time. Sizes are whole and at least 1.
    """
    rows = written(running_totals(df.withColumn("size", size.cast("long")), order, F.col("size")), "totals")
    spans = rows.select("place", F.col("before").alias("low"), (F.col("before") + F.col("size")).alias("high"))
    width = max(1, limit)
    asked = rows.select("place", "size", (F.col("before") + limit).alias("at"))
    onward = F.when(F.col("size") > limit, F.col("place") + 1).otherwise(F.col("span.place"))
    count = rows.count()
    jump = written(containing(asked, spans, width).select("place", onward.alias("to")).where((F.col("to") < count)), "jumps")
    starts = written(rows.where("place = 0").select("place"), "starts")
    while True:
        more = starts.join(jump, "place").select(F.col("to").alias("place"))
        if not more.limit(1).count():
            break
        starts = written(starts.union(more), "starts")
        jump = written(jump.join(jump.select(F.col("place").alias("to"), F.col("to").alias("far")), "to").select("place", F.col("far").alias("to")), "jumps")
    numbered = running_totals(starts.join(rows.select("place", F.col("before").alias("low")), "place").withColumnRenamed("place", "first"), ["first"]).select("first", "low", F.col("place").alias("batch_no"))
    numbered = written(numbered, "numbered")
    ends = numbered.select((F.col("batch_no") - 1).alias("batch_no"), F.col("low").alias("high"))
    whole = rows.agg((F.max(F.col("before") + F.col("size"))).alias("high"))
    total = whole.first()["high"] or 0
    closed = numbered.join(ends, "batch_no", "left").select("batch_no", "low", F.coalesce("high", F.lit(total)).alias("high"))
    return containing(rows.withColumnRenamed("before", "at"), closed, width).select(*df.columns, "place", "size", F.col("span.batch_no").alias("batch_no"))
