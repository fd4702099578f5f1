from __future__ import annotations

import zlib

import numpy as np

from quarry.llm import quality
from quarry.llm.queries import op5_quality_classifier


def test_held_out_accuracy(spark):
    """On the rows that no model learns from, at the scale of the correctness gate."""
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op5_quality_classifier(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    apart = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    good = [r["score"] for r in apart if labels[r["doc_id"]] == 1]
    bad = [r["score"] for r in apart if labels[r["doc_id"]] == 0]
    assert np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good]) > 0.95
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in apart]) > 0.95


def test_labels_of_held_out_rows_change_nothing(spark, data):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.score(docs, quality.learn(docs, x)).select("doc_id", "score").collect() for x in (labels, flipped))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2) for k in (1, 2, 3, 4, 5, 7)] + [(None, 1), (6, None)], "doc_id long, quality int")
    out = quality.score(odd, quality.learn(odd, labels))
    rows = out.collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows) and set(odd.columns) == set(out.columns)
    same = {r["score"] for r in rows if r["text"] == "The quick brown fox jumps over the lazy dog"}
    assert len(same) == 1
    assert quality.score(none, quality.learn(none, labels.where("false"))).count() == 0


def test_one_class_gives_a_constant():
    assert quality.fit([("a b", 1), ("c", 1)]).scores(["x", ""]).tolist() == [1.0, 1.0]
    assert quality.fit([]).scores(["x"]).tolist() == [0.5]


def test_long_texts_pool_as_a_whole():
    model = quality.fit([("good words here", 1), ("bad bad bad", 0)] * 8)
    text = "good words here bad " * 20_000
    whole = model.vectors[model.ids(text.split())].mean(axis=0)
    assert np.allclose(model.pool(text)[: quality.WIDTH], whole, atol=1e-4)


def test_temperature_calibrates():
    z = np.array([4.0, 4.0, -4.0, -4.0] * 50)
    y = np.array([1.0, 0.0, 0.0, 1.0] * 50)
    assert quality._temperature(z, y) > 5


def test_shapes_read_whole_words_and_samples_are_bounded_by_bytes(spark):
    assert quality.shape("a1" * 30) != quality.shape("a1" * 300) and quality.shape("ab12") == quality.shape("xyz9")
    docs = spark.createDataFrame([(k, ("good words here " if k % 2 else "x9 ## zz ") * 50) for k in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int")
    whole, part = quality.learn(docs, labels), quality.learn(docs, labels, sample_bytes=20_000)
    assert whole.constant is None and part.constant is None
    assert quality.learn(docs, labels, sample_bytes=10).constant == 0.5


def test_a_text_too_long_for_the_sample_is_passed_over(spark):
    docs = [(k, ("good words here " if k % 2 else "x9 ## zz ") * 5) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    for long_ in range(0, 60, 7):  # one of them comes first
        rows = [(k, t * 1000 if k == long_ else t) for k, t in docs]
        assert quality.learn(spark.createDataFrame(rows, "doc_id long, text string"), labels, sample_bytes=5000).constant is None
