"""The trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm.prefix_trie import louds, parents_of, prefix_trie, tree_sums

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}
    seq = {}
    for c, s in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + s[h:]
    members = defaultdict(list)
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += kids[p] == 0
    sha = {p: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seq[c]) == len(p)))).encode()).hexdigest() for p, m in members.items()}
    return sorted(repr((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha[p])) for p, m in members.items())


def rows_of(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize(("limit", "band"), [(1000, 256), (3, 2)])
def test_the_given_table(spark, data, limit, band):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    assert rows_of(prefix_trie(df, limit, band)) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_copies_long_conversations_nulls_and_ties(spark):
    rng = random.Random(5)
    rows = [(c, t, "user", f"hot {t}") for c in range(1000, 1060) for t in range(9)]
    rows += [(7, t, rng.choice(["user", None]), "long") for t in range(150)] + [(107, t, "user", "long") for t in range(140)]
    rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é€", "", None])) for c in range(200, 230) for t in range(rng.randrange(1, 7))]
    rows += [(300, None, "user", "x"), (300, 1, "user", "b"), (300, 1, "user", "a"), (300, 1, "user", "a"), (-205, 1, "user", "n"), (-200, 1, "user", "base"), (None, 1, "user", "nobody"), (401, 0, "user", "gone")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(prefix_trie(df.selectExpr("*", "'clash' AS node", "1 AS up"), 5, 8)) == plain(rows)


def test_an_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []


def test_louds_tells_every_parent():
    rng = np.random.default_rng(3)
    shard, conv, i, label = [], [], [], []
    for c in range(200):
        s = int(rng.integers(0, 4))
        for k in range(int(rng.integers(1, 6))):
            shard.append(s), conv.append(c), i.append(k), label.append(s if k == 0 else int(rng.integers(0, 3)))
    bits, first, ends, convs, shards = louds(*(np.array(x, np.int64) for x in (shard, conv, i, label)))
    parent = np.concatenate([[0], parents_of(bits)])
    assert len(bits) == 2 * len(parent) - 1 and bits.sum() == len(first) and list(shards) == [0, 1, 2, 3]
    for c, node in zip(convs, ends, strict=True):
        path = []
        while node:
            path.append(label[first[node - 1]])
            node = parent[node]
        assert path[::-1] == [x for x, o in zip(label, conv, strict=True) if o == c]


def test_sums_of_a_long_path(spark):
    rows = [(n, n - 1 if n else None, 1, n) for n in range(70)] + [(100 + n, 5, 1, 0) for n in range(9)]
    got = {r[0]: tuple(r[1:]) for r in tree_sums(spark.createDataFrame(rows, "node long, up long, n_leaves long, saved long")).collect()}
    assert got[0] == (79, sum(range(70))) and got[5] == (65 + 9, sum(range(5, 70))) and got[69] == (1, 69) and got[103] == (1, 0)
