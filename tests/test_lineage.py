"""Figures, tables, versions, leases, matches and hand-offs on small fixtures with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.functions import figures, text
from quarry.operators import evaluation, lineage
from quarry.streaming import handoff


@pytest.mark.parametrize(
    ("said", "refs", "broad"),
    [
        ("见图⑭-⑯", [14, 15, 16], False), ("图1-3 和 图7", [1, 2, 3, 7], False), ("①设备②班次", [1, 2], False), ("①-⑥步操作", [], True), ("按1-6步,见图2", [2], True), ("①-②步", [], False),
        ("图⑤-②", [], False), ("", [], False), (None, [], False), ("图100", [10], False),
    ],
)
def test_figure_refs(spark, said, refs, broad):
    df = spark.createDataFrame([(said,)], "t string")
    assert tuple(df.select(figures.figure_refs(F.col("t")), figures.step_ranges(F.col("t"))).first()) == (refs, broad)


@pytest.mark.parametrize(
    ("source", "target", "expected"),
    [
        ("走到机器旁", "见图③", (True, "allow", "stronger_destination_owner", 2, 4)),
        ("见图③", "①-⑥步", (False, "reject_conflict", "range_theft_blocked", 4, 1)),
        ("见图③", "别的", (False, "reject_review", "source_owner_preserved", 4, 0)),
        ("走到机器旁", "①-⑥步", (False, "reject_review", "ambiguous_kept_at_source", 2, 1)),
        ("打开生产订单", "打开生产订单窗口", (True, "allow", "stronger_destination_owner", 3, 3)),
        ("打开生产订单", "打开生产订单窗", (False, "reject_review", "source_owner_preserved", 3, 3)),
        ("图③", "图③④", (True, "allow", "stronger_destination_owner", 4, 4)),
    ],
)
def test_moves(spark, source, target, expected):
    df = spark.createDataFrame([(source, target, "③④", "【文档】打开生产订单窗口")], "s string, t string, seen string, summary string")
    df = df.withColumns({"a": figures.common_run(F.col("summary"), F.col("s")), "b": figures.common_run(F.col("summary"), F.col("t"))})
    got = df.select(figures.move_decision(F.col("s"), F.col("t"), figures.printed_numbers(F.col("seen")), F.col("a"), F.col("b")).alias("m")).first()["m"]
    assert tuple(got) == expected


def test_tables(spark):
    df = spark.createDataFrame([([["a", "b"], ["1", ""]], "x\n| a | ｂ |\r\n|:--|---|\n| 1 | |"), ([["a"]], None), ([], ""), ([["a", "a"]], "| a | c |")], "ref array<array<string>>, md string")
    got = df.select(text.markdown_grid(F.col("md")).alias("g"), text.table_scores(F.col("ref"), text.markdown_grid(F.col("md"))).alias("s")).collect()
    assert got[0]["g"] == [["a", "ｂ"], ["1", ""]]
    assert [tuple(r["s"]) for r in got] == [(1.0, True), (0.0, False), (1.0, True), (0.5, False)]


def test_widths_do_not_count(spark):
    df = spark.createDataFrame([("ＡＢ１", "A B1")], "a string, b string")
    assert tuple(df.select(text.character_error_rate(F.col("a"), F.col("b")), text.char_f1(F.col("a"), F.col("b"))).first()) == (0.0, 1.0)


def test_question_gates(spark):
    rows = [("报销和差旅怎么办理", True), ("报销和差旅", False), ("A、B", False), ("how? and why? now", True), (None, False)]
    df = spark.createDataFrame(rows, "t string, e boolean")
    assert all(r[0] == r[1] for r in df.select(text.looks_multi_intent(F.col("t")), "e").collect())
    rows = [("那这个呢", True, True), ("那这个呢", False, False), ("12", True, False), ("如何申请出差报销单据", True, False), ("上一步之后要填哪张表", True, True), (None, True, False)]
    df = spark.createDataFrame(rows, "t string, h boolean, e boolean")
    assert all(r[0] == r[1] for r in df.select(text.looks_followup(F.col("t"), F.col("h")), "e").collect())


def test_source_relation(spark):
    rows = [("a", "a", None, None, "same_checksum"), ("a", "b", "x", "x", "changed"), ("a", None, ' "X"', "x", "same_etag"), ("", "b", "x", "y", "changed"), (None, None, '""', "x", "unknown"), (None, None, None, None, "unknown")]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    assert all(r[0] == r[1] for r in df.select(lineage.source_relation(F.col("a"), F.col("b"), F.col("c"), F.col("d")), "e").collect())


def test_leases(spark):
    rows = [(3, "w", 10, 3, "renew", 3), (3, "w", 10, 2, "fenced", None), (3, "v", 10, 3, "fenced", None), (3, "v", 1, 1, "claim", 4), (None, None, None, 1, "claim", 1), (3, "w", 1, 3, "claim", 4)]
    df = spark.createDataFrame(rows, "epoch int, owner string, until int, asked int, action string, next int")
    got = df.select(lineage.lease_step(F.col("epoch"), F.col("owner"), F.col("until"), F.lit("w"), F.col("asked"), F.lit(5)).alias("s"), "action", "next").collect()
    assert all(tuple(r["s"]) == (r["action"], r["next"]) for r in got)


def test_stale_images(spark):
    rows = [("a", 1, "image", ["x"]), ("b", 2, "text_chunk", ["x"]), (None, 3, "text_chunk", ["x"]), (None, None, "text_chunk", ["x"]), (None, None, "image", None), ("z", 9, "text_chunk", None), ("d", 4, "text_chunk", ["x"])]
    known = [("a", 1, "d1", "image", 2), ("b", 2, "d1", "text_chunk", 1), ("c", 3, "d1", "text_chunk", 2), ("d", 4, "d2", "image", 1)]
    got = lineage.gate_stale_images(
        spark.createDataFrame(rows, "chunk_id string, pk long, chunk_type string, image_refs array<string>"), spark.createDataFrame(known, "chunk_id string, pk long, doc_id string, chunk_type string, version_no int"),
        spark.createDataFrame([("d1", 2)], "doc_id string, serving int"),
    )
    assert {(r[0], r[1], r[2], tuple(r[3] or ())) for r in got.collect()} == {("a", 1, "image", ("x",)), ("b", 2, "text_chunk", ()), (None, 3, "text_chunk", ("x",)), (None, None, "text_chunk", ()), ("z", 9, "text_chunk", ())}


def test_admin_roots(spark):
    nodes = spark.createDataFrame([(1, 1, 9), (2, 2, 3), (3, 2, 99)], "node long, depth int, subtree long")
    grants = spark.createDataFrame([("m", 2, "manual", True), ("m", 2, "auto", True), ("same", 1, "auto", True), ("moved", 3, "auto", True), ("two", 2, "auto", True), ("new", 2, "auto", False)], "user_id string, node long, source string, is_active boolean")
    staff = spark.createDataFrame([("m", 2), ("same", 1), ("moved", 2), ("two", 2), ("two", 3), ("new", 2), ("top", 1), ("big", 3)], "user_id string, node long")
    admins = spark.createDataFrame([(u,) for u in "m same moved two new top big none".split()], "user_id string")
    assert {tuple(r) for r in lineage.admin_roots(admins, grants, staff, nodes).collect()} == {
        ("m", None, "manual", None, 1), ("same", 1, "unchanged", None, 0), ("moved", 2, "candidate", "root_changed", 1), ("two", None, "unclear", None, 1), ("new", 2, "granted", None, 0),
        ("top", 1, "candidate", "center_level", 0), ("big", 3, "candidate", "oversized", 0), ("none", None, "unclear", None, 0),
    }


def test_match_chunks(spark):
    made = [(1, 0, "alpha beta", "text_chunk", None, None, []), (1, 1, "alpha beta gamma", "step_card", None, 1, []), (1, 2, "alpha beta and more", "step_card", "3.1", 3, [7]), (1, 3, "alpha beta", "step_card", None, 4, [8]), (2, 0, "", "step_card", None, 1, [])]
    chunks = spark.createDataFrame(made, "doc_id int, chunk_no int, text string, chunk_type string, section_no string, step_no int, refs array<int>")
    want = [
        (1, 1, ["Alpha", "beta"], "step_card", "3.1", 3, [7]), (2, 1, ["alpha", "gamma"], "step_card", None, None, []), (3, 1, ["alpha", "beta"], "step_card", None, None, [8, 9]), (4, 1, ["x", "y", "z", "w"], "step_card", None, None, [1]),
        (5, 1, [], "step_card", None, None, [1]), (6, 2, ["a"], "step_card", None, None, [1]), (7, 1, ["alpha"], "faq", None, None, []), (8, 1, ["alpha"], "step_card", "9.9", 1, []),
    ]
    truth = spark.createDataFrame(want, "gt_id int, doc_id int, keywords array<string>, chunk_type string, section_no string, step_no int, refs array<int>")
    assert {tuple(r) for r in evaluation.match_chunks(truth, chunks).collect()} == {
        (1, "matched", 2, 1.0), (2, "matched", 1, 1.0), (3, "matched", 3, 0.5), (4, "below_threshold", None, 0.0), (5, "no_keywords", None, 0.0), (6, "no_scorable", None, 0.0), (7, "matched", 0, 1.0), (8, "matched", 1, 1.0)
    }


def test_handoffs(spark):
    events = [(0.0, "mark", "a"), (10.0, "mark", "b"), (20.0, "message", None), (30.0, "message", None), (40.0, "message", None), (50.0, "mark", "c"), (5000.0, "message", None)]
    assert [x for _, x in handoff.take(events, [], [], 600.0)] == ["b", "a", None, None]
    df = spark.createDataFrame([("u", t, i, k, a) for i, (t, k, a) in enumerate(events)] + [("v", 1.0, 0, "message", None)], "actor string, ts double, seq long, kind string, answer string")
    assert sorted(map(tuple, handoff.handoffs(df).collect()), key=str) == sorted([("u", 20.0, "b"), ("u", 30.0, "a"), ("u", 40.0, None), ("u", 5000.0, None), ("v", 1.0, None)], key=str)


def test_handoff_stream(spark, tmp_path):
    schema = "actor string, ts double, seq long, kind string, answer string"
    for n, rows in enumerate([[("u", 0.0, 0, "mark", "a")], [("u", 5.0, 1, "message", None), ("u", 6.0, 2, "message", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = handoff.handoff_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        out.start().awaitTermination(120)
        assert n < 2
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("ts", "comment_of").collect()) == [(5.0, "a"), (6.0, None)]
