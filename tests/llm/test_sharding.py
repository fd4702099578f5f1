from __future__ import annotations

import zlib
from collections import Counter

import numpy as np

from quarry.llm.queries import op2_sharding
from quarry.llm.sharding import fisher_yates, shuffle_into_shards, write_shards


def check(rows, n_shards):
    for k in range(n_shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))


def test_every_row_once(spark, odd, none):
    out = shuffle_into_shards(odd, 3)
    rows = out.collect()
    assert out.columns == [c for c in odd.columns if c not in ("shard", "slot", "bucket")] + ["shard", "bucket", "slot"]
    assert Counter((r["doc_id"], r["text"], r["key"]) for r in rows) == Counter((r["doc_id"], r["text"], r["key"]) for r in odd.collect())
    check(rows, 3)
    assert shuffle_into_shards(none).count() == 0


def test_equal_rows_spread_over_buckets(spark):
    docs = spark.createDataFrame([(1, "same text " * 20)] * 4000, "doc_id long, text string")
    rows = shuffle_into_shards(docs, 2, bucket_bytes=20_000).select("shard", "bucket", "slot").collect()
    assert len(rows) == 4000 and len({r["bucket"] for r in rows}) > 5
    check(rows, 2)


def test_more_shards_take_rows_only_into_the_new_one(spark, data):
    rows = op2_sharding(spark, data).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 8)
    assert any(r["grown_shard"] == 8 for r in rows)
    check(rows, 8)


def test_order_is_repeatable_and_mixed(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    a, b = (sorted(map(tuple, shuffle_into_shards(x, 2).select("shard", "slot", "doc_id").collect())) for x in (docs, docs.repartition(7)))
    assert a == b
    ids = [x[2] for x in a if x[0] == 0]
    assert ids != sorted(ids)
    assert sorted(fisher_yates(50, 1)) == list(range(50)) and not np.array_equal(fisher_yates(50, 1), fisher_yates(50, 2))


def test_overfull_buckets_come_apart_alike_under_any_partitioning(spark):
    rows = [(k, f"text {k} " * 30, k % 7) for k in range(300)] + [(900, "w" * 200_000, 1)] + [(7000, "same " * 40, k % 3) for k in range(600)]
    got = []
    for n in (1, 5, 8):
        out = shuffle_into_shards(spark.createDataFrame(rows, "doc_id long, text string, more int").repartition(n), 2, bucket_bytes=8_000)
        got.append(sorted(map(tuple, out.select("shard", "slot", "doc_id", "text", "more").collect())))
    assert got[0] == got[1] == got[2] and Counter(x[2:] for x in got[0]) == Counter(rows)
    places = sorted(x[1] for x in got[0] if x[2] == 7000)
    assert max(b - a for a, b in zip(places, places[1:])) > 1 and len(places) == 600


def plain_shards(rows, n_shards, seed, each):
    """Slots by plain Python from Spark's hash: ``(shard, slot): row``."""
    import struct

    from xxhash import xxh64_intdigest

    def hashed(*values):
        h = 42
        for v in values:
            if v is not None:
                h = xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<" + v[1], v[0]), h)
        return h - (1 << 64) if h >> 63 else h

    long = lambda v: None if v is None else (v, "q")
    buckets = {}
    for doc_id, text in rows:
        shard = max((hashed((seed, "i"), (k, "i"), long(doc_id)), k) for k in range(n_shards))[1]
        buckets.setdefault((shard, shard * each + hashed((seed + 1, "i"), long(doc_id), text) % each), []).append((hashed((seed + 3, "i"), long(doc_id), text), doc_id, text))
    out, at = {}, Counter()
    for (shard, bucket), held in sorted(buckets.items()):
        held.sort(key=lambda x: x[0])
        for k in fisher_yates(len(held), seed * 1_000_003 + bucket):
            out[shard, at[shard]] = held[k][1:]
            at[shard] += 1
    return out


def test_slots_against_plain_python(spark, data, odd):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    for df, size in ((docs, 100_000), (odd.select("doc_id", "text"), 1 << 20)):
        rows = [tuple(r) for r in df.collect()]
        total = sum(len((t or "").encode()) + 64 for _, t in rows)
        got = {(r["shard"], r["slot"]): (r["doc_id"], r["text"]) for r in shuffle_into_shards(df, 3, bucket_bytes=size).collect()}
        assert got == plain_shards(rows, 3, 7, max(1, -(-total // 3 // size)))


def test_write(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    write_shards(shuffle_into_shards(docs, 2), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
