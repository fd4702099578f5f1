from __future__ import annotations

import re
from collections import Counter

import xxhash

from quarry.llm import simhash_dedup as s
from quarry.llm.components import connected_components
from quarry.llm.queries import op10_simhash_dedup


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints):
    """Smallest id reachable over links of two bits, by brute force."""
    label = {k: k for k in prints}
    moved = True
    while moved:
        moved = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and label[b] < label[a]:
                    label[a], moved = label[b], True
    return label


def test_query(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    prints = {k: plain(t) for k, t in docs.items()}
    want = groups(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op10_simhash_dedup(spark, data).collect()}
    assert got == {k: (f"{prints[k]:016x}", want[k]) for k in docs}


def test_links_join_all_close_pairs(spark):
    import random

    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    prints = {k: rng.choice(seeds) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for k in range(300)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    table = spark.createDataFrame([(k, signed(v)) for k, v in prints.items()], "doc_id long, fp long")
    assert {r["doc_id"]: r["component_id"] for r in s._with_components(table, 2).collect()} == groups(prints)


def test_odd_rows(spark, odd, none):
    rows = s.near_duplicates(odd).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count()
    assert by[5]["component_id"] == 1 and by[2]["fingerprint"] == "0" * 16 and by[3]["component_id"] == 2 and by[4]["component_id"] == 2
    assert s.near_duplicates(none).count() == 0


def test_deduplicate_keeps_one_of_each_group(spark, odd, none):
    out = s.deduplicate(odd)
    assert out.columns == odd.columns
    assert Counter(r["doc_id"] for r in out.collect()) == Counter([1, 2, None, 6, 7])
    assert s.deduplicate(none).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 101), (103, 102), (102, 103)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 102: 102, 103: 102}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
