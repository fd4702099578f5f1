from __future__ import annotations

import random

import corpus_pipeline
from quarry.llm import near_copies


def alike(a, b):
    x, y = (set(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) for t in (a, b))
    return len(x & y) >= 0.8 * len(x | y)


def firsts(rows):
    """Plain Python: components of all pairs of texts, the smallest id of each."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, t) in enumerate(rows):
        for j, u in rows[:n]:
            if find(i) != find(j) and alike(t, u):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted({find(i) for i, _ in rows})


def test_stage_finds_near_copies(spark, data):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 200, 2000)))]
        rows.append((1000 + 3 * k, " ".join(words)))
        for c in range(2):
            rows.append((1000 + 3 * k + c + 1, " ".join(w if rng.random() > 0.015 else f"v{rng.randrange(5000)}" for w in words)))
    # One group of many near copies, each of one text with other words, and a passage that unlike texts share.
    long = [f"x{k}" for k in range(300)]
    rows += [(5000 + k, " ".join([*long[: k * 3], "other", *long[k * 3 + 1 :]])) for k in range(90)]
    rows += [(6000 + k, " ".join([*long[:100], *(f"y{k}-{n}" for n in range(100))])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = firsts(rows)
    assert len(want) < 0.7 * len(rows)
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, data).collect()) == want


def test_odd_rows(spark, odd, none):
    out = near_copies.deduplicate(odd)
    assert out.columns == odd.columns and sorted(r["doc_id"] or -1 for r in out.collect()) == [-1, 1, 2, 6, 7]
    assert near_copies.deduplicate(none).count() == 0


def test_prefixes_meet_in_any_order():
    """Whatever the weights, sets of the similarity meet at a place that leaves enough behind."""
    import numpy as np

    rng = np.random.default_rng(9)
    met = 0
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 60), dtype=np.uint64))
        gone = rng.random(len(a)) < rng.choice([0.02, 0.1, 0.2])
        b = np.unique(np.concatenate([a[~gone], rng.integers(0, 1 << 63, rng.integers(0, 8), dtype=np.uint64)]))
        weights = np.zeros(near_copies.COUNTERS, dtype=np.uint32)
        weights[(a & np.uint64(near_copies.COUNTERS - 1)).astype(np.int64)] = rng.integers(0, 5, len(a))
        common = len(np.intersect1d(a, b))
        if not len(b) or common < 0.8 * (len(a) + len(b) - common):
            continue
        x, y = (near_copies.prefix(s, weights, 0.8).tolist() for s in (a, b))
        assert any(min(len(a) - x.index(k), len(b) - y.index(k)) >= 0.8 / 1.8 * (len(a) + len(b)) - 1e-6 for k in set(x) & set(y))
        met += 1
    assert met > 100


def test_a_common_passage_is_no_meeting_place(spark):
    """Texts that share a passage, and that most of them is, meet at their own words or not at all."""
    passage = [f"p{k}" for k in range(40)]
    rows = [(k, " ".join([*passage, *(f"u{k}-{n}" for n in range(25))])) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("unhex(md5(text)) AS row", "doc_id", "text")
    weights = near_copies._weights(near_copies._signatures(docs, 5))
    keys = [k for r in near_copies._prefixes(docs.select("row", "text"), weights, 5, 0.8).collect() for k in r["prefix"]]
    assert len(keys) == len(set(keys))


def test_maps_never_lose_a_pair():
    import numpy as np

    rng = np.random.default_rng(4)
    pruned = 0
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(0, 3000), dtype=np.uint64) << np.uint64(1))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.5, 0.8, 0.95])], rng.integers(0, 1 << 63, rng.integers(0, 200), dtype=np.uint64) << np.uint64(1)]))
        x, y = near_copies.bit_map(a), near_copies.bit_map(b)
        assert max(64, 2 * len(a)) <= 64 * len(x) <= max(64, 4 * len(a))
        most = min(len(a) - near_copies.lacking(x, y), len(b) - near_copies.lacking(y, x))
        assert len(np.intersect1d(a, b)) <= most
        pruned += most < 0.8 / 1.8 * (len(a) + len(b))
    assert pruned > 50


def test_few_comparisons_take_one_round(spark, monkeypatch):
    """Unlike texts that meet are compared in one round if that is little work, in many otherwise; links are the same."""
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(120)]
    rows = [(k, " ".join([*passage, *(f"u{k}-{n}" for n in range(24))])) for k in range(20)]
    # Chains of near copies among them, in which only neighbours are alike.
    rows += [(1000 + 100 * c + k, " ".join([*passage, *(f"c{c}-{n}" for n in range(8 * k, 8 * k + 24))])) for c in range(2) for k in range(6)]
    rng.shuffle(rows)
    docs, want, steps = spark.createDataFrame(rows, "doc_id long, text string"), firsts(rows), []
    assert 20 < len(want) < len(rows)
    write = near_copies.materialise
    monkeypatch.setattr(near_copies, "materialise", lambda df, step: steps.append(step) or write(df, step))
    assert sorted(r["doc_id"] for r in near_copies.deduplicate(docs).collect()) == want
    assert steps.count("labelled") == 1 and steps.count("met") <= 3
    steps.clear()
    assert sorted(r["doc_id"] for r in near_copies.deduplicate(docs, few=0).collect()) == want
    assert steps.count("labelled") > 2
