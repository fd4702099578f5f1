from __future__ import annotations

import math
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm.mixing import binomial, draw_shards, mix_blocks, mix_counts, mix_documents, permuted, plan_mix
from quarry.llm.queries import op8_mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return capped | share
        for s in over:
            capped[s] = 2.0 * sizes[s]
            left -= capped[s]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations(spark, n):
    rows = spark.range(n).select("id", permuted(F.col("id"), F.lit(n).cast("long"), 3, F.lit("k")).alias("y"))
    rows = rows.withColumn("back", permuted(F.col("y"), F.lit(n).cast("long"), 3, F.lit("k"), inverse=True)).collect()
    assert sorted(r["y"] for r in rows) == list(range(n)) and all(r["back"] == r["id"] for r in rows)
    assert n < 10 or [r["y"] for r in rows] != list(range(n))


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    words, sizes = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs}, Counter()
    for r in docs:
        sizes[r["source"]] += words[r["doc_id"]]
    want, source, taken = targets(sizes), {r["doc_id"]: r["source"] for r in docs}, defaultdict(int)
    rows = op8_mixing(spark, data).collect()
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op8_mixing(spark, data).collect()))


def test_documents_and_blocks_hold_what_is_counted(spark, odd):
    mix = plan_mix(odd, block_words=7, n_shards=3)
    counts = mix_counts(mix).collect()
    assert len(counts) == odd.count()
    assert all(r["taken"] == 0 for r in counts if r["size"] == 0)
    out = mix_documents(odd, mix)
    assert out.columns == odd.columns
    got, want = Counter(), Counter()
    for r in out.select("doc_id", "text").collect():
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
    for r in counts:
        want[r["doc_id"]] += r["taken"]
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    blocks = mix_blocks(odd, mix).collect()
    assert sum(r["n_words"] for r in blocks) == sum(want.values()) and all(len(WORD.findall(r["text"])) == r["n_words"] <= 7 for r in blocks)
    assert {r["shard"] for r in blocks} == {0, 1, 2}


def test_empty_and_wordless(spark, none):
    assert mix_counts(plan_mix(none)).count() == 0
    bare = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in mix_counts(plan_mix(bare)).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]


def test_no_python(spark, data):
    plan = op8_mixing(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def hashed(*values):
    """Spark's xxhash64 in plain Python: (value, format) of numbers, strings, nothing for nulls."""
    from xxhash import xxh64_intdigest

    h = 42
    for v in values:
        if v is not None:
            h = xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<" + v[1], v[0]), h)
    return h - (1 << 64) if h >> 63 else h


def permuted_plain(x, n, seed, *key):
    for r in range(24):
        mirror = (hashed((seed, "i"), (r, "i"), *key) % n - x) % n
        if hashed((seed + 1, "i"), (r, "i"), (max(x, mirror), "q"), *key) % 2:
            x = mirror
    return x


def taken_plain(rows, draws, length, seed):
    """Words taken of every row, from its source's stream cut into blocks and the drawn slots."""
    streams, taken = defaultdict(list), Counter()
    buckets = max(1, int(len(rows) ** 0.5))
    for k, (doc_id, text, source) in enumerate(rows):
        size = len(WORD.findall(text or ""))
        place = hashed((seed, "i"), None if doc_id is None else (doc_id, "q"), text)
        src = "n" if source is None else "s" + source
        streams[src].append(((place >> 20) % buckets, place, doc_id is not None, doc_id or 0, size, hashed(text, (0, "i")), k))
    for src, rows_ in streams.items():
        owners = [x[-1] for x in sorted(rows_) for _ in range(x[4])]
        blocks = [owners[at : at + length] for at in range(0, len(owners), length)]
        mine = sorted((d for d in draws if d["src"] == src), key=lambda d: d["shard"])
        if not mine:
            continue
        left, q = mine[0]["words"], 0
        for d in mine:
            assert d["first"] == q
            for _ in range(d["drawn"]):
                turn, j = divmod(q, len(blocks))
                block = blocks[permuted_plain(j, len(blocks), seed + 10, src, (turn, "q"))]
                for owner in block[: max(0, left)]:
                    taken[owner] += 1
                left -= len(block)
                q += 1
        assert left <= 0
    return taken


def test_taken_against_plain_streams(spark, data, odd):
    sample = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    strange = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    for rows, length, shards in ((sample, 64, 8), (strange, 1000, 3), ([(1, "a b c", "x"), (2, "d", "y"), (2, "d", "y"), (None, "e f", None)], 2, 5)):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        mix = plan_mix(docs, block_words=length, n_shards=shards)
        want = taken_plain(rows, [r.asDict() for r in mix.draws.collect()], length, 17)
        key = lambda doc_id, size, taken: (doc_id is not None, doc_id or 0, size, taken)
        assert sorted(key(r["doc_id"], r["size"], r["taken"]) for r in mix_counts(mix).collect()) == sorted(key(d, len(WORD.findall(t or "")), want[k]) for k, (d, t, _) in enumerate(rows))


def test_draws_are_multinomial(spark):
    sources = spark.createDataFrame([(f"s{k}", k, n) for k, n in enumerate([0, 1, 7, 63, 64, 65, 1000, 10**9])], "src string, rank int, n_slots long")
    for shards in (1, 2, 5, 8):
        drawn = defaultdict(dict)
        for r in draw_shards(sources, shards, 3).collect():
            drawn[r["rank"]][r["shard"]] = r["drawn"]
        assert all(set(x) == set(range(shards)) and min(x.values()) >= 0 for x in drawn.values())
        assert [sum(drawn[k].values()) for k in range(8)] == [0, 1, 7, 63, 64, 65, 1000, 10**9]
        assert all(abs(c - 10**9 / shards) < 6 * math.sqrt(10**9 / shards) for c in drawn[7].values())
    for n, p in ((10, 0.3), (64, 0.5), (65, 0.5), (400, 0.25)):
        got = np.array([r[0] for r in spark.range(4000).select(binomial(F.lit(n).cast("long"), F.lit(p), 5, F.col("id"))).collect()])
        assert abs(got.mean() - n * p) < 5 * math.sqrt(n * p * (1 - p) / 4000) and abs(got.var() / (n * p * (1 - p)) - 1) < 0.15


def test_every_shard_has_gapless_slots_and_the_plan_draws_them(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    mix = plan_mix(docs, block_words=64, n_shards=8)
    slots = mix.slots.collect()
    places = defaultdict(list)
    for r in slots:
        places[r["shard"]].append(r["slot"])
    short = {d["src"] for d in mix.sources.collect()}
    assert set(places) == set(range(8)) and all(len(set(x)) == len(x) and max(x) < len(x) + len(short) for x in places.values())
    assert "shard" in mix_counts(mix)._jdf.queryExecution().optimizedPlan().toString()
    plan = mix.taken_segments()._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[src#\d+, block#\d+L?\], \[src#\d+, block#\d+L?\]", plan)
