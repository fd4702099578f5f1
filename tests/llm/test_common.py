from __future__ import annotations

import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import common


def test_filters_let_all_of_theirs_through(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = common.filter_of(rows)
    assert rows.count() == common.marked(rows, "h", bits, "in").where("in").count()
    others = spark.range(5000, 30_000).select("id", F.xxhash64("id").alias("h"), F.lit("x").alias("text"))
    out = common.marked(others, "h", bits, "in")
    assert out.columns == ["id", "h", "text", "in"] and out.where("in").count() < 100
    assert common.marked(rows, "h", common.filter_of(rows.where("false")), "in").where("in").count() == 0


def test_row_keys_tell_rows_apart(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (None, "a"), (1, None), (1, ""), (None, None), (11, "")]
    keys = spark.createDataFrame(rows, "i long, t string").select(common.row_key(F.col("i"), F.col("t")).alias("k")).collect()
    assert len({bytes(r["k"]) for r in keys}) == len(rows) and all(len(r["k"]) == 16 for r in keys)


def test_steps_are_written_and_discarded(spark):
    step = common.materialise(spark.range(10), "step")
    assert step.count() == 10
    common.discard(step)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST|FileNotFound"):
        spark.read.parquet(step.quarry_path).count()


def test_a_cluster_must_name_the_shared_folder():
    conf = types.SimpleNamespace(get=lambda *a: None)
    session = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(getConf=lambda: conf, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(session)


def test_filters_keep_rows_out_of_python(spark):
    rows = spark.range(2000).select(F.xxhash64("id").alias("h"), F.lit("x").alias("text"))
    bits = common.filter_of(rows.limit(500))
    out = common.marked(rows, "h", bits, "in")
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    got = [(r["h"], r["in"]) for r in out.collect()]
    want = common.passes(bits, np.array([h for h, _ in got], dtype=np.int64).view(np.uint64)).tolist()
    assert len(got) == 2000 and [x for _, x in got] == want
