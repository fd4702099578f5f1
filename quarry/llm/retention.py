"""A cohort retention matrix: contributions of clients, added up in sparse blocks of a tensor that tasks merge as a tree.

The tensor's axes are state, segment, cohort and period. Tasks add what their clients contribute into blocks of
``SIDE x SIDE`` cells with ``numpy.add.at``; blocks are then merged level by level, ``FAN`` of them at a time, as a tree
aggregate does, but dealt by block over tasks: nothing is gathered in the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialise, partitions

#: Cohorts and periods of a block.
SIDE = 32
#: Blocks that a task keeps open; beyond them it hands on what it has.
OPEN = 512
#: Partial blocks of a cell that one task merges.
FAN = 32

MEASURES = ("users", "users_crc32", "moved", "cents")
_BLOCK = "state int, segment string, cohort_block long, period_block long"
_PARTIAL = f"{_BLOCK}, task int, cells array<int>, " + ", ".join(f"{m} array<long>" for m in MEASURES)


def _day(at: Column) -> Column:
    return F.unix_date(at.cast("date")).cast("long")


def starts(clicks: DataFrame, clients: DataFrame, cutoff: str, cohort_days: int) -> DataFrame:
    """One row per client that ever starts: segment, the start in state 0 (or null) and in state 1, and whether the cohort moved.

    A client listed more than once in ``clients`` has the greatest of its segments; null ids there count for nobody.
    """
    begun = clicks.where("kind = 'signup' AND ts IS NOT NULL AND client_id IS NOT NULL").groupBy("client_id").agg(F.min(F.when(_known(cutoff), F.col("ts"))).alias("start0"), F.min("ts").alias("start1"))
    listed = clients.where("client_id IS NOT NULL").groupBy("client_id").agg(F.max("segment").alias("segment"))
    cohort = {f"cohort{s}": F.floor(_day(F.col(f"start{s}")) / cohort_days) for s in (0, 1)}
    out = begun.join(listed, "client_id", "left").withColumns({"segment": F.coalesce("segment", F.lit("")), **cohort})
    return materialise(out.withColumn("moved", F.coalesce(F.col("cohort0") != F.col("cohort1"), F.lit(False))), "starts")


def _known(cutoff: str) -> Column:
    """Whether the click arrives before the cutoff: every third one, by its id's checksum, arrives up to 99 days late."""
    h = F.crc32(F.col("click_id").cast("string").cast("binary"))
    arrives = F.when(h % 3 == 0, F.col("arrived_at") + F.make_dt_interval(days=(h % 100).cast("int"))).otherwise(F.col("arrived_at"))
    return F.coalesce(arrives < F.lit(cutoff).cast("timestamp_ntz"), F.lit(False))


def contributions(clicks: DataFrame, clients: DataFrame, cutoff: str = "2024-02-15 00:00:00", cohort_days: int = 1, period_days: int = 1) -> DataFrame:
    """One row per state, client and period in which a known click of it lies: ``state, segment, cohort, period, crc, moved, cents``.

    Rows meet the starts in a join that may split a client's rows over tasks; they are added up before they meet by
    client and period, so that no client is one task's alone.
    """
    first = starts(clicks, clients, cutoff, cohort_days)
    once = clicks.where("ts IS NOT NULL AND client_id IS NOT NULL").distinct()
    cents = F.coalesce(F.floor(100 * F.col("value") + 0.5).cast("long"), F.lit(0))
    rows = once.select("client_id", "ts", _known(cutoff).alias("known"), cents.alias("cents")).join(first, "client_id")

    def state(s: int, known: Column) -> Column:
        begun = F.col(f"start{s}")
        period = F.floor(F.extract(F.lit("DAY"), F.col("ts") - begun) / period_days).cast("long")
        row = F.struct(F.lit(s).alias("state"), F.col("client_id").alias("client"), "segment", F.col(f"cohort{s}").alias("cohort"), period.alias("period"), "moved", "cents")
        return F.when(known & (F.col("ts") >= begun), row)

    each = rows.select(F.explode(F.array_compact(F.array(state(0, F.col("known")), state(1, F.lit(True))))).alias("c")).select("c.*")
    summed = each.groupBy("state", "client", "segment", "cohort", "period", "moved").agg(F.sum("cents").alias("cents"))
    return summed.select("state", "segment", "cohort", "period", F.crc32(F.col("client").cast("string").cast("binary")).alias("crc"), "moved", "cents")


def _sparse(keys: list[tuple], dense: np.ndarray, task: int) -> pa.RecordBatch:
    """Rows of the blocks (``dense``: block, measure, cell) with the cells in which somebody is."""
    cells = [np.flatnonzero(d[0]).astype(np.int32) for d in dense]
    columns = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))]
    columns += [pa.array([task] * len(keys), pa.int32()), pa.array(cells, pa.list_(pa.int32()))]
    columns += [pa.array([d[m][c] for d, c in zip(dense, cells, strict=True)], pa.list_(pa.int64())) for m in range(len(MEASURES))]
    return pa.RecordBatch.from_arrays(columns, names=["state", "segment", "cohort_block", "period_block", "task", "cells", *MEASURES])


def scatter(batches):
    """Adds a task's contributions into blocks, and hands the blocks on at its end or when ``OPEN`` of them are full."""
    task, slots = TaskContext.get().partitionId(), {}
    dense = np.zeros((OPEN, len(MEASURES), SIDE * SIDE), np.int64)
    for batch in batches:
        state, cohort, period, crc, moved, cents = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("state", "cohort", "period", "crc", "moved", "cents"))
        segment = batch.column("segment").dictionary_encode()
        code = np.stack([state, segment.indices.to_numpy().astype(np.int64), cohort // SIDE, period // SIDE])
        blocks, of = np.unique(code, axis=1, return_inverse=True)
        of, names = of.reshape(-1), segment.dictionary.to_pylist()
        keys = [(int(s), names[g], int(c), int(p)) for s, g, c, p in blocks.T]
        for low in range(0, len(keys), OPEN):
            part = keys[low : low + OPEN]
            if len(slots.keys() | set(part)) > OPEN:
                yield _sparse(list(slots), dense[: len(slots)], task)
                dense[: len(slots)], slots = 0, {}
            at = np.array([slots.setdefault(k, len(slots)) for k in part])
            mine = (of >= low) & (of < low + OPEN)
            slot, cell = at[of[mine] - low], (cohort[mine] % SIDE) * SIDE + period[mine] % SIDE
            for m, v in enumerate((1, crc[mine], moved[mine], cents[mine])):
                np.add.at(dense, (slot, m, cell), v)
    if slots:
        yield _sparse(list(slots), dense[: len(slots)], task)


def merge(table: pa.Table) -> pa.Table:
    """Partial blocks of one key as one block."""
    dense = np.zeros((1, len(MEASURES), SIDE * SIDE), np.int64)
    cells = table.column("cells").combine_chunks().flatten().to_numpy()
    for m, name in enumerate(MEASURES):
        np.add.at(dense[0, m], cells, table.column(name).combine_chunks().flatten().to_numpy())
    first = table.slice(0, 1).to_pylist()[0]
    return pa.Table.from_batches([_sparse([tuple(first[k] for k in ("state", "segment", "cohort_block", "period_block"))], dense, first["task"])])


def tree_merge(partials: DataFrame) -> DataFrame:
    """One block per key. A level merges at most ``FAN`` tasks' blocks at a time (more only where a task handed on twice); the last merges what is left of a key."""
    tasks = partitions(partials.sparkSession)
    key = ["state", "segment", "cohort_block", "period_block"]
    while tasks > FAN:
        partials = partials.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy(*key, "task").applyInArrow(merge, _PARTIAL)
        tasks = -(-tasks // FAN)
    return partials.groupBy(*key).applyInArrow(merge, _PARTIAL)


def cohort_retention(clicks: DataFrame, clients: DataFrame, cutoff: str = "2024-02-15 00:00:00", cohort_days: int = 1, period_days: int = 1) -> DataFrame:
    """Cells of the matrix that are not empty: ``state, segment, cohort, period, users, users_crc32, moved, cents``.

    Equal clicks count once; clicks without time or client don't count, those without id or kind do; without an arrival
    they are known in state 1 only. A client's start is its earliest known signup in the state; without one it has no
    rows there. Null values are 0 cents, null and missing segments ''. Empty tables give no cells. Further columns take
    part in telling clicks apart and in nothing else.
    """
    partials = contributions(clicks, clients, cutoff, cohort_days, period_days).mapInArrow(scatter, _PARTIAL)
    blocks = tree_merge(partials)
    cells = blocks.select("state", "segment", "cohort_block", "period_block", F.explode(F.arrays_zip("cells", *MEASURES)).alias("c"))
    return cells.select(
        "state", "segment", (F.col("cohort_block") * SIDE + F.floor(F.col("c.cells") / SIDE)).alias("cohort"),
        (F.col("period_block") * SIDE + F.col("c.cells") % SIDE).alias("period"), *[F.col(f"c.{m}").alias(m) for m in MEASURES],
    )
