"""Comments that a user owes on an answer: marked once, taken once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "actor string, ts double, comment_of string"


def take(events: Iterable[tuple[float, str, str | None]], ids: list[str], times: list[float], seconds: float) -> list[tuple[float, str | None]]:
    """Each message's time and the answer that it comments on, or None if it is a question of its own.

    A ``mark`` makes its answer wait, again if it did before; a ``message`` takes the answer marked last within
    ``seconds``. What is older waits no longer. ``ids`` and ``times`` are changed.
    """
    out: list[tuple[float, str | None]] = []
    for ts, kind, answer in events:
        live = [(i, t) for i, t in zip(ids, times, strict=True) if t >= ts - seconds and not (kind == "mark" and i == answer)]
        if kind == "mark":
            live.append((answer, ts))
        else:
            out.append((ts, live.pop()[0] if live else None))
        ids[:], times[:] = [i for i, _ in live], [t for _, t in live]
    return out


def _rows(pdf: pd.DataFrame, actor: str, ids: list[str], times: list[float], seconds: float) -> pd.DataFrame:
    ordered = pdf.sort_values(["ts", "seq"])
    got = take(zip(ordered["ts"], ordered["kind"], ordered["answer"], strict=True), ids, times, seconds)
    return pd.DataFrame({"actor": [actor] * len(got), "ts": [t for t, _ in got], "comment_of": pd.Series([c for _, c in got], dtype=object)})


def _typed(events: DataFrame) -> DataFrame:
    return events.select(F.col("actor").cast("string"), F.col("ts").cast("double"), F.col("seq").cast("long"), "kind", F.col("answer").cast("string"))


def handoffs(events: DataFrame, seconds: float = 600.0) -> DataFrame:
    """Batch form over ``events(actor, ts, seq, kind, answer)``, kind mark or message: one Arrow group per actor."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _rows(pdf, key[0], [], [], seconds)

    return _typed(events).groupBy("actor").applyInPandas(run, OUT)


def handoff_stream(events: DataFrame, seconds: float = 600.0) -> DataFrame:
    """Streaming form: an actor's state is the answers that wait."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, times = (list(x) for x in state.get) if state.exists else ([], [])
        yield _rows(pd.concat(list(batches)), key[0], ids, times, seconds)
        if ids:
            state.update((ids, times))
        elif state.exists:
            state.remove()

    return _typed(events).groupBy("actor").applyInPandasWithState(run, OUT, "ids array<string>, times array<double>", "append", GroupStateTimeout.NoTimeout)
