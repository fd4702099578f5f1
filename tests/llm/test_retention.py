"""The retention matrix against a plain count."""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa

from quarry.llm import retention
from quarry.llm.retention import cohort_retention

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
CLIENTS = "client_id long, segment string"
EPOCH = datetime(1970, 1, 1)


def crc(n):
    return zlib.crc32(str(n).encode())


def plain(clicks, clients, cohort_days=1, period_days=1):
    segment = {}
    for c, s in clients:
        segment[c] = max(segment.get(c) or "", s or "")
    known = [[], []]
    for click, ts, arrived, client, kind, value, _ in {tuple(r) for r in clicks}:
        if ts is None or client is None:
            continue
        known[1].append((client, ts, kind, value))
        if arrived is not None:
            late = crc(click) % 100 if click is not None and crc(click) % 3 == 0 else 0
            if arrived + timedelta(days=late) < datetime(2024, 2, 15):
                known[0].append((client, ts, kind, value))
    starts = [{}, {}]
    for s in (0, 1):
        for client, ts, kind, _ in known[s]:
            if kind == "signup":
                starts[s][client] = min(ts, starts[s].get(client, ts))
    cohort = [{c: (t - EPOCH).days // cohort_days for c, t in starts[s].items()} for s in (0, 1)]
    users, cents = defaultdict(set), defaultdict(int)
    for s in (0, 1):
        for client, ts, _, value in known[s]:
            if client in starts[s] and ts >= starts[s][client]:
                key = (s, segment.get(client, ""), cohort[s][client], (ts - starts[s][client]).days // period_days)
                users[key].add(client)
                cents[key] += math.floor(100 * value + 0.5) if value is not None else 0
    moved = {c for c in cohort[0] if c in cohort[1] and cohort[0][c] != cohort[1][c]}
    return sorted((*k, len(u), sum(map(crc, u)), len(u & moved), cents[k]) for k, u in users.items())


def made(n=1500):
    rng, rows = random.Random(2), []
    for i in range(n):
        client = rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7, None])
        ts = None if rng.random() < 0.02 else datetime(2024, 1, 1) + timedelta(microseconds=rng.randrange(100 * 86_400 * 10**6))
        arrived = None if rng.random() < 0.05 else (ts or datetime(2024, 1, 5)) + timedelta(seconds=rng.randrange(9))
        rows.append((None if rng.random() < 0.05 else i, ts, arrived, client, rng.choice(["signup", "view", None]) if rng.random() < 0.1 else "click", rng.choice([None, 0.005, 1.115, -3.335, 20.0]), "{}"))
    return rows + rows[:200]


def test_cells(spark):
    clicks, clients = made(), [(1, "a"), (2, None), (3, "b"), (3, "b"), (4, "a"), (4, "c"), (None, "x")]
    a = spark.createDataFrame(clicks, CLICKS).repartition(5)
    b = spark.createDataFrame(clients, CLIENTS)
    assert sorted(map(tuple, cohort_retention(a, b).collect())) == plain(clicks, clients)
    assert sorted(map(tuple, cohort_retention(a, b, cohort_days=7, period_days=30).collect())) == plain(clicks, clients, 7, 30)


def test_blocks_that_do_not_fit_are_handed_on_and_merged(spark, monkeypatch):
    monkeypatch.setattr(retention, "FAN", 2)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        clicks, clients = made(400), [(c, f"s{c}") for c in range(8)]
        got = cohort_retention(spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(clients, CLIENTS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(map(tuple, got)) == plain(clicks, clients)


def test_a_task_hands_on_what_it_can_not_hold(monkeypatch):
    monkeypatch.setattr(retention, "OPEN", 3)
    monkeypatch.setattr(retention, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 4)}))}))
    rng = np.random.default_rng(1)
    n = 5000
    cols = {"state": rng.integers(0, 2, n), "segment": [f"s{k}" for k in rng.integers(0, 4, n)], "cohort": rng.integers(-40, 90, n), "period": rng.integers(0, 90, n), "crc": rng.integers(0, 2**32, n), "moved": rng.random(n) < 0.2, "cents": rng.integers(-5, 500, n)}
    table = pa.table({k: pa.array(v) for k, v in cols.items()})
    got = pa.Table.from_batches(list(retention.scatter(table.to_batches(max_chunksize=700))))
    assert set(got.column("task").to_pylist()) == {4}
    assert sum(map(sum, got.column("users").to_pylist())) == n and sum(map(sum, got.column("cents").to_pylist())) == int(cols["cents"].sum())


def test_empty_tables(spark):
    a, b = spark.createDataFrame([], CLICKS), spark.createDataFrame([], CLIENTS)
    assert cohort_retention(a, b).collect() == []
    assert cohort_retention(spark.createDataFrame(made(50), CLICKS), b).columns == ["state", "segment", "cohort", "period", "users", "users_crc32", "moved", "cents"]
