from __future__ import annotations

import random
import re

from quarry.llm import decontamination as d
from quarry.llm.queries import op3_decontamination


def norm(t):
    return re.sub(r"[^\w]+|_+", " ", (t or "").lower()).strip()


def distance_to_part(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        last, row[0] = row[0], i
        for j, x in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != x))
    return min(row)


def test_myers_against_table():
    rng = random.Random(1)
    for _ in range(300):
        p, t = ("".join(rng.choices("ab c", k=rng.randint(1, 70))) for _ in range(2))
        assert d.best_end(d._masks(p), len(p), t)[0] == distance_to_part(p, t)


def test_pieces_cover():
    assert "".join(x for _, x in d.pieces("abcdefghij", 3)) == "abcdefghij"


def test_finds_all_within_budget():
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 7))) for _ in range(200)]
    items = [(k, " ".join(rng.choices(words, k=30))) for k in range(12)]
    index = d.Index(items, 0.05)
    for _ in range(60):
        n, item = rng.choice(items)
        text = list(item)
        for _ in range(rng.randint(0, 9)):
            at = rng.randrange(len(text))
            text[at] = rng.choice(["", "x", text[at] + "y"])
        text = " ".join(rng.choices(words, k=20)) + " " + "".join(text) + " " + " ".join(rng.choices(words, k=20))
        got = {x[0]: x[1] for x in index.find(text)}
        want = {k: e for k, t in items if (e := distance_to_part(t, text)) <= int(len(t) * 0.05)}
        assert got == want


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "quick BROWN  fox, jumps over the lazy dog"), (2, None), (3, ""), (4, "short"), (1, "quick BROWN  fox, jumps over the lazy dog")], "item_id long, text string")
    got = d.find_leaks(odd, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got) == [(1, 1, 0), (1, 1, 0), (5, 1, 0)]
    kept = d.decontaminate(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 3
    assert d.find_leaks(none, bench).count() == 0 and d.find_leaks(odd, bench.where("false")).count() == 0
    assert d.decontaminate(odd, bench.where("false")).count() == odd.count()


def test_blocks_of_items_give_the_same(spark, data):
    docs, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = (sorted(map(tuple, d.find_leaks(docs, bench, block_chars=n).collect())) for n in (1 << 22, 2000))
    assert one == many
    exact = {(r["doc_id"], b["item_id"]) for r in docs.collect() for b in bench.collect() if len(norm(b["text"])) >= d.SHORTEST and norm(b["text"]) in norm(r["text"])}
    assert {(x[0], x[1]) for x in one if x[2] == 0} == exact
    assert sorted(map(tuple, op3_decontamination(spark, data).collect())) == one


def test_any_shortest_and_edits(spark, odd):
    import pytest

    bench = spark.createDataFrame([(1, ""), (2, None), (3, "x"), (4, "...")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in d.find_leaks(odd, bench, shortest=0).collect()} == {(1, 3), (5, 3), (6, 3)}
    assert {(r["doc_id"], r["item_id"]) for r in d.find_leaks(odd, bench, shortest=-5, edits=0.99).collect()} == {(1, 3), (5, 3), (6, 3)}
    for edits in (1, -0.1):
        with pytest.raises(ValueError, match="edits"):
            d.Index([(1, "some item")], edits)


def test_query_against_brute_force_with_edits(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(300)]
    some = lambda n: " ".join(rng.choices(words, k=n))
    items = [(k, some(rng.choice((7, 15, 40)))) for k in range(15)]
    rows = []
    for k in range(80):
        text = list(rng.choice(items)[1])
        for _ in range(rng.randint(0, 12)):
            at = rng.randrange(len(text))
            text[at] = rng.choice(["", "x", text[at] + "y", text[at]])
        rows.append((k, f"{some(rng.randint(0, 40))} {''.join(text)}. {some(rng.randint(0, 40))}"))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(k, i, e) for k, t in rows for i, x in items if len(norm(x)) >= d.SHORTEST and (e := distance_to_part(norm(x), norm(t))) <= int(len(norm(x)) * d.EDITS)}
    got = d.find_leaks(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == want and any(e for _, _, e in want)
    assert all(r["end"] - r["first"] >= len(norm(dict(items)[r["item_id"]])) - r["distance"] for r in got)
    assert {r["doc_id"] for r in d.decontaminate(docs, bench).collect()} == {k for k, _ in rows} - {k for k, _, _ in want}
