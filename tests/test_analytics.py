"""Joins along time, batches, leaders, ranges, sketches, vectors and table functions against plain versions."""

from __future__ import annotations

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.functions import tables
from quarry.operators import evaluation, gaps, reconcile, sequence, sketches, temporal, vectors
from quarry.streaming import joins

START = dt.datetime(2024, 1, 1)


def moments(rng, n, keys=("hot", "hot", "hot", "b", "c", None)):
    return [(i, rng.choice(keys), None if rng.random() < 0.05 else START + dt.timedelta(minutes=rng.randrange(0, 9000, 5))) for i in range(n)]


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("within", [None, "3 hours"])
def test_as_of(spark, forward, within):
    rng = random.Random(4)
    left, right = moments(rng, 300), moments(rng, 200)
    right += right[:40]
    got = temporal.as_of_join(spark.createDataFrame(left, "id int, k string, at timestamp_ntz"), spark.createDataFrame(right, "n int, k string, t timestamp_ntz"), "k", "at", "t", forward, within, ["n"], 7)
    reach = dt.timedelta(hours=3) if within else dt.timedelta(days=999)
    want = []
    for i, k, at in left:
        near = [(abs(t - at), -n) for n, key, t in right if key == k and k is not None and at is not None and t is not None and (t >= at if forward else t <= at) and abs(t - at) <= reach]
        want.append((i, -min(near)[1] if near else None))
    assert sorted((r["id"], r["match"]["n"] if r["match"] else None) for r in got.collect()) == sorted(want)


def test_as_of_without_rows(spark):
    none = spark.createDataFrame([], "n int, k string, t timestamp_ntz")
    some = spark.createDataFrame([(1, "a", START)], "id int, k string, at timestamp_ntz")
    assert [r["match"] for r in temporal.as_of_join(some, none, "k", "at", "t").collect()] == [None]
    assert temporal.as_of_join(some.where("false"), none, "k", "at", "t").collect() == []


def test_intervals_and_frames(spark):
    rng = random.Random(5)
    left, right = moments(rng, 200), moments(rng, 200)
    a, b = spark.createDataFrame(left, "id int, k string, at timestamp_ntz"), spark.createDataFrame(right, "n int, k string, t timestamp_ntz")
    got = temporal.interval_join(a, b, "k", "at", "t", "2 hours", "30 hours", 5)
    want = sorted((i, n) for i, k, at in left for n, key, t in right if k is not None and k == key and at and t and dt.timedelta(hours=-2) <= t - at <= dt.timedelta(hours=30))
    assert sorted((r["l"]["id"], r["r"]["n"]) for r in got.collect()) == want and len(want) > 50
    last = temporal.in_the_last(a.where("at IS NOT NULL"), "k", "at", "3 hours", {"m": "count(*)", "least": "min(id)"}, 4)
    rows = [r for r in left if r[2]]
    near = {i: [j for j, key, t in rows if key == k and dt.timedelta() <= at - t <= dt.timedelta(hours=3)] for i, k, at in rows}
    assert sorted((r["id"], r["m"], r["least"]) for r in last.collect()) == sorted((i, len(x), min(x)) for i, x in near.items())


@pytest.mark.parametrize("n", [0, 1, 7, 400])
def test_batches(spark, n):
    rng = random.Random(n)
    rows = [(f"{rng.randrange(50):03}", rng.choice([1, 2, 3, 9, 30, 31, 80])) for _ in range(n)]
    got = sequence.greedy_batches(spark.createDataFrame(rows, "id string, bytes int").repartition(3), ["id", "bytes"], F.col("bytes"), 30).collect()
    want, used, batch = [], None, -1
    for place, (i, size) in enumerate(sorted(rows)):
        if used is None or used + size > 30:
            used, batch = 0, batch + 1
        used += size
        want.append((place, i, size, batch))
    assert sorted((r["place"], r["id"], r["size"], r["batch_no"]) for r in got) == want


def test_running_totals(spark):
    rows = [(n % 17, n) for n in range(500)]
    got = sequence.running_totals(spark.createDataFrame(rows, "a int, v int"), ["a", "v"], F.col("v")).collect()
    total = 0
    for place, (a, v) in enumerate(sorted(rows)):
        r = next(x for x in got if x["place"] == place)
        assert (r["a"], r["v"], r["before"]) == (a, v, total)
        total += v


def sequential(rows, near, best):
    leaders, out = [], {}
    for h, x, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        found = [(name, near(x, y)) for name, y in leaders]
        found = [(name, s) for name, s in found if s is not None]
        if found:
            out[h] = max(found, key=lambda f: f[1])[0] if best else found[0][0]
        else:
            leaders.append((h, x))
            out[h] = h
    return out


@pytest.mark.parametrize(("threshold", "tile"), [(0.5, 2000), (0.25, 40), (0.15, 2000)])
def test_leaders_of_all_vectors(spark, data, threshold, tile):
    e = spark.read.parquet(f"{data}/embeddings.parquet").selectExpr("format_string('%05d', vec_id) AS hash", "cast(embedding AS array<double>) AS vector", "vec_id % 5 AS weight")
    e = e.unionByName(e.where("hash < '00040'").selectExpr("concat(hash, 'copy') AS hash", "vector", "3L AS weight")).unionByName(spark.createDataFrame([("zero", [0.0] * 64, 9), ("null", None, 9)], "hash string, vector array<double>, weight long"))
    rows = [tuple(r) for r in e.collect()]

    def near(x, y):
        x, y = np.array(x or [0.0] * 64), np.array(y or [0.0] * 64)
        s = x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) if x.any() and y.any() else 0.0
        return round(float(s), 12) if s >= threshold else None

    got = gaps.leader_clusters(e, threshold, 16, tile).collect()
    assert {r["hash"]: r["representative"] for r in got} == sequential(rows, near, True) and len(got) == len(rows)


def test_leaders_of_all_turns(spark, data):
    t = spark.read.parquet(f"{data}/conversations.parquet").selectExpr("format_string('%05d-%03d', conv_id, turn) AS hash", "text", "conv_id % 3 AS weight")
    t = t.unionByName(t.where("weight = 1").selectExpr("concat(hash, 'copy') AS hash", "concat(' ', text) AS text", "2L AS weight")).unionByName(spark.createDataFrame([("a", None, 1), ("b", "", 0), ("c", "x", 5), ("d", " x ", 4)], "hash string, text string, weight long"))
    rows = [(h, x, w) for h, x, w in map(tuple, t.collect())]

    def grams(x):
        x = "".join((x or "").split())
        return {x[k : k + 2] for k in range(max(1, len(x) - 1))}

    sets = {h: grams(x) for h, x, _ in rows}
    near = lambda x, y: 1 if len(x & y) / len(x | y) >= 0.5 else None
    got = gaps.text_leader_clusters(t).collect()
    assert {r["hash"]: r["representative"] for r in got} == sequential([(h, sets[h], w) for h, _, w in rows], near, False) and len(got) == len(rows)


def test_near_pairs_against_all(spark):
    rng = np.random.default_rng(2)
    hot = rng.normal(size=8)
    made = [(n, (hot + 0.2 * rng.normal(size=8) if n % 3 else rng.normal(size=8)).tolist()) for n in range(120)]
    df = spark.createDataFrame([*made, (200, [0.0] * 8), (201, None)], "id long, vector array<double>")
    m = vectors._unit([v for _, v in made])
    want = {(a, b) for a in range(120) for b in range(120) if m[a] @ m[b] >= 0.9}
    got = [(r["a"], r["b"]) for r in vectors.near_pairs(df, df, 0.9, vectors.centres(df, 8), tile=10).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_lists_give_the_exact_nearest(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(9, 12))
    made = [(n, (middles[n % 9] + 0.1 * rng.normal(size=12)).tolist()) for n in range(300)]
    df = spark.createDataFrame([*made, (900, None)], "id long, vector array<double>")
    pivots = vectors.centres(df, 12)
    lists = vectors.build_lists(df, pivots)
    assert lists.count() == 300
    near, exact = vectors.search_lists(df.where("id % 50 = 0").withColumnRenamed("id", "query_id"), lists, pivots, 7, probes=1)
    m = vectors._unit([v for _, v in made])
    want = {(q, int(v), r + 1) for q in range(0, 300, 50) for r, v in enumerate(np.argsort(-(m @ m[q]), kind="stable")[:7])}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in exact.collect()} == want
    hits = {(r["query_id"], r["vec_id"]) for r in near.collect()} & {(q, v) for q, v, _ in want}
    assert len(hits) >= 0.9 * len(want)
    with pytest.raises(ValueError):
        vectors.search_lists(spark.range(5000).selectExpr("id AS query_id", "array(1.0D) AS vector"), lists, pivots, 1)


def test_ranges(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(3000), rng.randrange(3), rng.choice(["x", None])) for _ in range(4000)]
    other = [r for r in rows if r[0] not in (5, 2500)] + [(77, 9, "new"), (5000, 1, "x"), rows[0]] + [(None, 1, "x")]
    a, b = (spark.createDataFrame(r, "k long, v int, t string") for r in (rows, other))
    bag = lambda r: {k: sorted((v, t or "") for q, v, t in r if q == k) for k in {x[0] for x in r if x[0] is not None}}
    x, y = bag(rows), bag(other)
    want = {(k, "missing" if k not in y else "extra" if k not in x else "changed") for k in x.keys() | y.keys() if x.get(k) != y.get(k)}
    found, totals = reconcile.reconcile_by_ranges(a, b, "k", ["v", "t"], 4)
    t = totals.first()
    assert {tuple(r) for r in found.collect()} == want and t["verdict"] == "different" and t["differences"] == len(want) and t["joined"] <= 5 and t["compared"] < t["leaves"]
    assert reconcile.reconcile_by_ranges(a, a.repartition(5), "k", ["v", "t"], 4)[1].first()["verdict"] == "equal"
    lost = reconcile.reconcile_by_ranges(a, a, "k", ["v", "t"], 4, spark.createDataFrame([(3,)], "leaf long"))[1].first()
    assert lost["verdict"] == "incomplete" and lost["differences"] == 0


def test_sketches(spark):
    rows = spark.range(40_000).selectExpr("id % 3 AS week", "id % 20 AS day", "id * 7 % 9001 AS user", "cast(id * 31 % 10007 AS double) AS value")
    found = sketches.merged(sketches.daily_sketches(rows, ["week", "day"], F.col("user"), F.col("value")), ["week"], {"p95": 0.95})
    assert all(r["users_ok"] and r["quantile_ok"] for r in sketches.checked(found, rows, ["week"], F.col("user"), F.col("value"), "p95", 0.95).collect())
    wrong = found.withColumn("p95", F.col("p95") * 0.7).withColumn("keys", F.col("keys") * 2)
    assert not any(r["users_ok"] or r["quantile_ok"] for r in sketches.checked(wrong, rows, ["week"], F.col("user"), F.col("value"), "p95", 0.95).collect())


def test_bootstrap_in_place(spark):
    rng = np.random.default_rng(1)
    v = rng.gamma(2.0, 3.0, 3000)
    rows = spark.createDataFrame(pd.DataFrame({"id": range(3000), "x": v}))
    one = evaluation.bootstrap_ci(rows, "x", "id", 1500).first()
    assert one == evaluation.bootstrap_ci(rows.repartition(7), "x", "id", 1500).first() or math.isclose(one["low"], evaluation.bootstrap_ci(rows.repartition(7), "x", "id", 1500).first()["low"], rel_tol=1e-9)
    means = np.sort([rng.choice(v, len(v)).mean() for _ in range(1500)])
    se = v.std() / math.sqrt(len(v))
    assert one["n"] == 3000 and math.isclose(one["mean"], v.mean()) and abs(one["low"] - means[37]) < 0.3 * se and abs(one["high"] - means[1462]) < 0.3 * se
    none = evaluation.bootstrap_ci(rows.where("false"), "x", "id", 10).first()
    assert none["n"] == 0 and none["mean"] is None and none["low"] is None


def test_streams_join_like_tables(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = [("purchase", "bought"), ("click", "clicked")]
    schema = e.schema
    cut = ["2024-01-10", "2024-01-20", "2024-02-10"]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def feed(n):
        low = cut[n - 1] if n else "2000-01-01"
        for kind, name in parts:
            e.where((F.col("event_type") == kind) & (F.col("ts") >= low) & (F.col("ts") < cut[n])).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run():
        a, b = (spark.readStream.schema(schema).parquet(str(tmp_path / name)).select("event_id", "user_id", "ts") for _, name in parts)
        joined = joins.interval_stream_join(a, b.toDF("c_id", "c_user", "c_ts").withColumnRenamed("c_user", "user_id"), "user_id", "ts", "c_ts", "2 hours", "1 hour", "10 days")
        q = joined.select("l.event_id", "r.c_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        assert q.awaitTermination(180)

    for n in range(3):  # the query stops and starts again on its checkpoint
        feed(n)
        run()
    a, b = (e.where(F.col("event_type") == kind) for kind, _ in parts)
    want = temporal.interval_join(a, b.withColumnRenamed("event_id", "c_id"), "user_id", "ts", "ts", "2 hours", "1 hour")
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted((r["l"]["event_id"], r["r"]["c_id"]) for r in want.collect()) and got


def test_late_rows_have_a_table_of_their_own(spark):
    df = spark.createDataFrame([(1, START), (2, START - dt.timedelta(days=3)), (3, None)], "id int, at timestamp")
    good, late = joins.on_time(df, "at", str(START), "1 day")
    assert [r["id"] for r in good.collect()] == [1] and [r["id"] for r in late.orderBy("id").collect()] == [2, 3]
    assert joins.on_time(df, "at", None, "1 day")[0].count() == 2


def test_table_functions(spark):
    tables.register(spark)
    docs = spark.createDataFrame([(1, "a b c d e"), (2, None), (3, " "), (4, "x")], "id int, text string")
    got = spark.sql("SELECT d.id, w.* FROM {docs} d, LATERAL word_windows(d.text, 2) w", docs=docs).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 2, "a b"), (1, 2, 2, "c d"), (1, 4, 1, "e"), (4, 0, 1, "x")]
    at = lambda m: START + dt.timedelta(minutes=m)
    rows = spark.createDataFrame([("u", at(9)), ("u", at(0)), ("u", at(50)), ("v", at(3)), ("u", None)], "key string, at timestamp_ntz")
    assert sorted(map(tuple, spark.sql("SELECT * FROM sessions(TABLE({r}), 600)", r=rows).collect())) == [("u", 0, at(0), at(9), 2), ("u", 1, at(50), at(50), 1), ("v", 0, at(3), at(3), 1)]
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT * FROM {docs} d, LATERAL word_windows(d.text, d.id) w", docs=docs).collect()
    with pytest.raises(Exception, match="key and at"):
        spark.sql("SELECT * FROM sessions(TABLE({r}), 600)", r=docs).collect()
