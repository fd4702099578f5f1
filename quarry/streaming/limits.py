"""Sliding-window admission per actor, as a stream and as a batch; the day's quota."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "actor string, ts double, admitted boolean"


def admit(times: Iterable[float], held: list[float], limit: int, seconds: float) -> list[bool]:
    """Admits while fewer than ``limit`` admitted requests lie in the last ``seconds``; what is rejected doesn't count. ``held`` is changed."""
    window, out = deque(held), []
    for t in times:
        while window and window[0] <= t - seconds:
            window.popleft()
        ok = len(window) < limit
        if ok:
            window.append(t)
        out.append(ok)
    held[:] = window
    return out


def sliding_limit(requests: DataFrame, limit: int, seconds: float = 60.0) -> DataFrame:
    """Batch form over ``requests(actor, ts)``: recursive, hence one Arrow group per actor."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")[["actor", "ts"]]
        return pdf.assign(admitted=admit(pdf["ts"], [], limit, seconds))

    return requests.select(F.col("actor").cast("string"), F.col("ts").cast("double")).groupBy("actor").applyInPandas(run, OUT)


def sliding_limit_stream(requests: DataFrame, limit: int, seconds: float = 60.0, expire: bool = True) -> DataFrame:
    """Streaming form: an actor's state is the times in its window, dropped after the window's length without requests.

    With ``expire`` the stream runs on as long as there is state to drop, so a run that shall end when its input does
    (an available-now trigger) needs ``expire=False``.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        for pdf in batches:
            pdf = pdf.sort_values("ts")
            yield pd.DataFrame({"actor": pdf["actor"], "ts": pdf["ts"], "admitted": admit(pdf["ts"], held, limit, seconds)})
        state.update((held,))
        if expire:
            state.setTimeoutDuration(int(seconds * 1000))

    rows = requests.select(F.col("actor").cast("string"), F.col("ts").cast("double"))
    return rows.groupBy("actor").applyInPandasWithState(run, OUT, "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def daily_quota(requests: DataFrame, day: Column, weight: Column, quota: float) -> DataFrame:
    """``used`` and ``within``: weights of an actor's day summed in order, against the quota."""
    w = Window.partitionBy("actor", "day").orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, 0)
    return requests.withColumn("day", day).withColumn("used", F.sum(weight).over(w)).withColumn("within", F.col("used") <= quota)
