"""Names by blocks against plain groups of equal texts."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm.exact_dedup import exact_dedup, exact_groups, identities
from quarry.llm.naming import named


def plain(rows):
    by = defaultdict(list)
    for i, text in rows:
        by[re.sub(r"[ \t-\r]+", " ", text or "")].append(i)
    out = []
    for text, ids in by.items():
        known = sorted(i for i in ids if i is not None)
        order = known + [None] * (len(ids) - len(known))
        out += [(i, known[0] if known else None, len(ids), n == 0, hashlib.sha256(text.encode()).hexdigest()) for n, i in enumerate(order)]
    return sorted(map(repr, out))


def made():
    rng = random.Random(11)
    rows = [(n, "".join(rng.choice("ab \n") for _ in range(rng.choice([0, 1, 7, 8, 9, 40, 300])))) for n in range(150)]
    rows += [(200 + n, "copy " * 100) for n in range(60)] + [(300, "copy " * 99 + "copz "), (301, "copy\t\n" * 100), (302, None), (303, ""), (None, ""), (None, "alone"), (None, "alone"), (304, " \n "), (305, " "), (5, "é€" * 70), (5, "é€" * 70)]
    return rows


@pytest.mark.parametrize("block", [8, 4096])
def test_groups(spark, block):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("row", F.lit("clash")).withColumn("n", F.lit(1))
    assert sorted(repr(tuple(r)) for r in exact_groups(df, block=block).collect()) == plain(rows)


def test_texts_whose_blocks_share_a_hash_stay_apart(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = identities(df, block=8, mark=lambda c: F.octet_length(c).cast("long")).select("level", "name", "text_sha256").distinct().collect()
    assert len(got) == len({(r[0], r[1]) for r in got}) == len({r[2] for r in got}) == len({re.sub(r"[ \t-\r]+", " ", t or "") for _, t in rows})


def test_whole_rows_stay(spark, odd, none):
    got = exact_dedup(odd)
    assert got.columns == odd.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 1), (False, 2), (False, 4), (False, 6), (False, 7), (True, 0)]
    assert exact_dedup(none).collect() == [] and exact_groups(none).collect() == []


def test_the_given_table(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    assert sorted(repr(tuple(r)) for r in exact_groups(df).collect()) == plain([tuple(r) for r in df.collect()])


def test_names_of_pairs(spark):
    rows = [(n, n % 3, f"t{n % 5}") for n in range(60)]
    got = named(spark.createDataFrame(rows, "id int, a int, b string"), ["a", "b"], mark=lambda a, b: F.col(a).cast("long")).collect()
    assert len(got) == 60 and len({r["name"] for r in got}) == 15
    assert {(r["id"] % 3, f"t{r['id'] % 5}", r["name"]) for r in got}.__len__() == 15
