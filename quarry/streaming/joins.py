"""Two streams joined by key and interval of time, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_stream_join(left: DataFrame, right: DataFrame, on: str, left_at: str, right_at: str, lower: str, upper: str, lateness: str = "1 day") -> DataFrame:
    """``l, r``: pairs whose ``right_at`` lies from ``left_at - lower`` to ``left_at + upper``, as in the join of tables.

    Both sides may be up to ``lateness`` behind the latest time seen; the interval tells how long a row has to wait for
    partners, so the state holds no row for longer than that. Later rows are dropped by the watermark: see ``on_time``.
    Times must be instants (``timestamp``), as watermarks are.
    """
    a = left.withWatermark(left_at, lateness).select(F.col(on).alias("lk"), F.col(left_at).alias("lt"), F.struct(*left.columns).alias("l"))
    b = right.withWatermark(right_at, lateness).select(F.col(on).alias("rk"), F.col(right_at).alias("rt"), F.struct(*right.columns).alias("r"))
    near = F.expr(f"lk = rk AND rt >= lt - INTERVAL {lower} AND rt <= lt + INTERVAL {upper}")
    return a.join(b, near).select("l", "r")


def on_time(batch: DataFrame, at: str, seen: str | None, lateness: str) -> tuple[DataFrame, DataFrame]:
    """A batch's rows that a watermark of ``lateness`` behind ``seen`` (the latest time before the batch) lets in, and the others for a table of their own. Rows without time are late."""
    if seen is None:
        return batch.where(F.col(at).isNotNull()), batch.where(F.col(at).isNull())
    good = F.coalesce(F.col(at) >= F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {lateness}"), F.lit(False))
    return batch.where(good), batch.where(~good)
