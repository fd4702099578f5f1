"""Daily service metrics and their objectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.status import outcome_class
from quarry.operators.percentiles import place_even, ranked_values, upper_median

#: Thresholds of the service objectives.
OBJECTIVES = {
    "answer_rate_min": 0.75, "no_result_rate_max": 0.15, "p95_latency_ms_max": 25000.0, "error_rate_max": 0.05, "traffic_drop_ratio": 0.3, "traffic_min_base": 10.0, "min_sample": 20.0,
    "total_failure_min_n": 3.0,
}


def rate(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole), 4)


def daily_metrics(log: DataFrame, day: Column, rejected: DataFrame | None = None) -> DataFrame:
    """One row per day of the question log; rates are over admitted queries, null without any.

    ``rejected(day, reason, n)`` adds what admission turned away; reasons that start with two underscores are no
    rejections.
    """
    kind = outcome_class(F.col("answer_status"), F.col("blocked"), F.col("hits"))
    rows = log.withColumn("day", day).withColumn("kind", kind).withColumn("lat", F.when(F.col("latency_ms") > 0, F.col("latency_ms")))
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = rows.groupBy("day").agg(
        F.count("*").alias("total_queries"), count(F.col("kind") == "success").alias("success_count"), count(F.col("kind") == "refusal").alias("refusal_count"),
        count(F.col("kind") == "no_result").alias("no_result_count"), count(F.col("kind") == "error").alias("error_count"), count(F.col("blocked")).alias("risk_blocked_count"),
        F.round(F.avg("top_score"), 4).alias("avg_top_score"),
        F.count_distinct("user_id").alias("distinct_users"), F.count_distinct("session_id").alias("distinct_sessions"),
    )
    total = F.col("total_queries")
    out = out.join(ranked_values(rows, ["day"], "lat", {"p50": place_even(0.5), "p95": place_even(0.95)}), "day", "left")
    out = out.withColumns({"answer_rate": rate(F.col("success_count"), total), "no_result_rate": rate(F.col("no_result_count"), total), "error_rate": rate(F.col("error_count"), total)})
    out = out.withColumn("p50_latency_ms", F.floor("p50").cast("long")).withColumn("p95_latency_ms", F.floor("p95").cast("long")).drop("p50", "p95")
    if rejected is not None:
        real = rejected.where(~F.startswith("reason", F.lit("__"))).groupBy("day").agg(F.sum("n").alias("rejected_count"), F.sum(F.when(F.col("reason") == "global_cap", F.col("n")).otherwise(0)).alias("rejected_global_cap"))
        out = out.join(real, "day", "left").withColumns({"rejected_count": F.coalesce("rejected_count", F.lit(0)), "rejected_global_cap": F.coalesce("rejected_global_cap", F.lit(0))})
        out = out.withColumn("offered_queries", total + F.col("rejected_count"))
    return out


def weekday_baseline(daily: DataFrame) -> DataFrame:
    """``daily`` with ``baseline``: the upper median of the total on the same weekday of the four weeks before; null without any."""
    days = daily.select(F.col("day").alias("past"), F.col("total_queries").alias("n"))
    shifted = days.select(F.explode(F.array(*[F.date_add("past", 7 * k) for k in (1, 2, 3, 4)])).alias("day"), "n")
    return daily.join(shifted.groupBy("day").agg(upper_median(F.col("n")).alias("baseline")), "day", "left")


def evaluate_objectives(daily: DataFrame, limits: dict[str, float] = OBJECTIVES) -> DataFrame:
    """``daily`` with ``breaches``, ``low_confidence`` (sorted names) and ``slo_ok``.

    A null metric breaches nothing. Ratios and the percentile count only from the least sample on; total failure from
    three queries on. Under that they are of low confidence. A global cap always breaches. Absent columns are unknown.
    """
    c = lambda name: F.col(name) if name in daily.columns else F.lit(None).cast("double")
    n = c("total_queries")
    yes = lambda x: F.coalesce(x, F.lit(False))
    enough = n.isNull() | (n >= limits["min_sample"])
    some = yes(n >= limits["total_failure_min_n"])
    ar, nr, er, p95, base = c("answer_rate"), c("no_result_rate"), c("error_rate"), c("p95_latency_ms"), c("baseline")
    ratios = [
        ("answer_rate_min", yes(ar < limits["answer_rate_min"]), yes(ar == 0)), ("no_result_rate_max", yes(nr > limits["no_result_rate_max"]), yes(nr == 1)),
        ("error_rate_max", yes(er > limits["error_rate_max"]), yes(er == 1)), ("p95_latency_ms_max", yes(p95 > limits["p95_latency_ms_max"]), F.lit(False)),
    ]
    always = [
        ("global_cap_rejected", yes(c("rejected_global_cap") > 0)), ("zero_traffic", yes((base > 0) & (n == 0))),
        ("traffic_collapse", yes((base >= limits["traffic_min_base"]) & (n > 0) & (n < limits["traffic_drop_ratio"] * base))),
    ]
    hard = [F.when(hit, F.lit(k)) for k, hit in always] + [F.when(hit & (enough | (all_ & some)), F.lit(k)) for k, hit, all_ in ratios]
    soft = [F.when(hit & ~(enough | (all_ & some)), F.lit(k)) for k, hit, all_ in ratios]
    out = daily.withColumn("breaches", F.array_sort(F.array_compact(F.array(*hard)))).withColumn("low_confidence", F.array_sort(F.array_compact(F.array(*soft))))
    return out.withColumn("slo_ok", (F.size("breaches") == 0).cast("int"))


def weekly(daily: DataFrame) -> DataFrame:
    """Sums by week, rates from the sums, the percentile's plain mean and its maximum, days in breach, and the change to the week before (null if either side is)."""
    from pyspark.sql import Window

    w = Window.orderBy("week")
    out = daily.groupBy(F.to_date(F.date_trunc("week", "day")).alias("week")).agg(
        F.sum("total_queries").alias("total_queries"), F.sum("success_count").alias("success_count"), F.sum("no_result_count").alias("no_result_count"),
        F.round(F.avg("p95_latency_ms"), 2).alias("p95_mean"), F.max("p95_latency_ms").alias("p95_max"), F.count_if(F.col("slo_ok") == 0).alias("breach_days"),
    )
    out = out.withColumn("answer_rate", rate(F.col("success_count"), F.col("total_queries")))
    return out.withColumn("total_delta", F.col("total_queries") - F.lag("total_queries").over(w)).withColumn("answer_rate_delta", F.round(F.col("answer_rate") - F.lag("answer_rate").over(w), 4))
