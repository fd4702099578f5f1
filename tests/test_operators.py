"""Operators on small fixtures with known results."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import audits, chunking, evaluation, gaps, hierarchy, metrics, percentiles, reconcile, retrieval
from quarry.sources import files, sinks, tables
from quarry.streaming import limits, rollups


def test_percentiles_differ(spark):
    df = spark.createDataFrame([(1, float(x)) for x in (1, 2, 3, 4)], "k long, x double")
    picks = {"a": percentiles.place_even(0.5), "b": percentiles.place_ceil(0.5), "c": percentiles.place_upper_median(), "d": percentiles.place_even(0.95)}
    got = percentiles.ranked_values(df, ["k"], "x", picks).select("k", "a", "b", "c", "d").first()
    assert df.agg(percentiles.upper_median(F.col("x"))).first()[0] == 3.0
    assert tuple(got)[1:] == (3.0, 2.0, 3.0, 4.0)
    assert percentiles.percent_rank_value(df, ["k"], "x", 0.5, "p").first()["p"] == 2.0 and percentiles.percent_rank_value(df, ["k"], "x", 0.95, "p").first()["p"] == 3.0


def test_objectives(spark):
    rows = [(30, 0.5, 0.0, 0.0, 0, None), (3, 0.0, 1.0, 0.0, 0, None), (5, 0.6, 0.2, 0.0, 0, None), (0, None, None, None, 0, 12), (2, 1.0, 0.0, 0.0, 0, 20), (50, 1.0, 0.0, 0.0, 4, None)]
    df = spark.createDataFrame(rows, "total_queries long, answer_rate double, no_result_rate double, error_rate double, rejected_global_cap long, baseline long")
    got = [(r["breaches"], r["low_confidence"], r["slo_ok"]) for r in metrics.evaluate_objectives(df).collect()]
    assert got == [(["answer_rate_min"], [], 0), (["answer_rate_min", "no_result_rate_max"], [], 0), ([], ["answer_rate_min", "no_result_rate_max"], 1), (["zero_traffic"], [], 0), (["traffic_collapse"], [], 0), (["global_cap_rejected"], [], 0)]


def test_closure_of_a_broken_tree(spark):
    tree = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 2), (7, 8), (8, 7), (9, 9), (10, 99)], "id long, parent long")
    c = hierarchy.ancestors(tree)
    good = {(r["node"], r["ancestor"]) for r in c.where("ok").collect()}
    assert good == {(1, 1), (2, 2), (2, 1), (3, 3), (3, 2), (3, 1)}
    members = spark.createDataFrame([("a", 3), ("b", 3), ("b", 7), ("c", 10), ("d", 1234)], "member string, node long")
    assert {r["member"]: (r["ids"], r["ok"]) for r in hierarchy.resolve_chains(members, c).collect()} == {"a": ([1, 2, 3], True), "b": ([], False), "c": ([], False), "d": ([], False)}
    assert {r["root"]: (len(r["ids"]), r["ok"]) for r in hierarchy.descendants(c, 2).collect()} == {1: (0, False), 2: (2, True), 3: (1, True)}
    long = spark.createDataFrame([(0, None)] + [(k, k - 1) for k in range(1, 20)], "id long, parent long")
    assert {r["node"] for r in hierarchy.ancestors(long).where("not ok").select("node").distinct().collect()} == set(range(16, 20))


def test_parity(spark):
    store = spark.createDataFrame([(1, "a", 1, "INDEXED"), (2, "a", 0, "INDEXED"), (3, "b", 1, "INDEXED"), (4, "b", 1, "NOT_INDEXED"), (5, "b", 1, "INDEXED")], "pk long, doc_id string, is_active int, index_status string")
    index = spark.createDataFrame([(1, "a"), (2, "a"), (5, "b"), (5, "b"), (9, "z")], "pk long, doc_id string")
    assert {(r["pk"], r["kind"]) for r in reconcile.parity(store, index).collect()} == {(2, "inactive"), (3, "missing"), (5, "dup"), (9, "orphan")}
    s = reconcile.parity_summary(store, index).first()
    assert (s["n_missing"], s["vanished_docs"], s["orphan_docs"], s["ok"]) == (1, 0, 1, False)


def test_objects_and_assets(spark):
    chunks = spark.createDataFrame([("c1", 1, '{"oss_key":"k1","image_refs":[{"oss_key":"k2"},{"oss_key":null}]}'), ("c0", 1, '{"image_refs":[{"oss_key":"k2"}]}'), ("c3", 1, "broken"), ("c4", 0, '{"oss_key":"k9"}')], "chunk_id string, is_active int, extra_json string")
    assert {(r["key"], r["chunk_id"]) for r in reconcile.object_parity(chunks, spark.createDataFrame([("k1",)], "key string")).collect()} == {("k2", "c0")}
    shape = "doc_id long, ordinals array<int>, partial boolean, source string"
    old = spark.createDataFrame([(1, [1, 2], False, "s"), (2, [1], False, "s"), (3, None, False, "s"), (4, [1], True, "s"), (5, [1], False, None), (6, [], False, "s")], shape)
    new = spark.createDataFrame([(1, [2, 1], False, "s"), (2, [2], False, "s"), (3, [1], False, "s"), (4, [2], False, "t"), (5, [], False, "t"), (6, [1], False, "t")], shape)
    assert {r["doc_id"]: r["kind"] for r in reconcile.asset_set_diff(old, new).collect()} == {2: "same_source_drift", 4: "ordinal_diff_partial", 5: "ordinal_diff", 6: "source_changed"}


def test_sections_and_windows():
    text = "intro\n# One\nalpha\n\nbeta\n第二章 总则\n| a | b |\n| c | d |\ntail\n# Empty\n"
    assert chunking.sections(text) == [("", "intro"), ("One", "alpha\n\nbeta"), ("第二章 总则", "| a | b |\n| c | d |\ntail")]
    assert chunking.tables_apart("x\n|a|b|\n|c|d|\ny") == (["|a|b|\n|c|d|"], ["x", "y"])
    assert chunking.windows(["a" * 40, "b" * 40, "c" * 40], chunking.ChunkConfig(max_chars=90, overlap=45)) == ["a" * 40 + "\n\n" + "b" * 40, "b" * 40 + "\n\n" + "c" * 40]
    assert chunking.merge_short(["ab", "c" * 9, "d"], 5) == ["ab\n\n" + "c" * 9 + "\n\nd"]


@pytest.mark.parametrize("n", [0, 1, 799, 800, 801, 5000])
def test_split_long_covers(n):
    text = ("一二三四五六七八九。" * (n // 10 + 1))[:n]
    parts = chunking.split_long(text, 800, 50, 100)
    assert all(len(p) <= 801 for p in parts)
    at = 0
    for p in parts:
        at = text.index(p, max(0, at - 100))
        at += len(p)
    assert at == len(text)


def test_modes(spark):
    docs = spark.createDataFrame([("d", 1, "Q: one?\nA: yes\nmore\nQ2: two?\nA: no"), ("e", 1, None)], "doc_id string, version_no int, text string")
    rows = chunking.chunk_documents(docs, "faq").orderBy("chunk_index").collect()
    assert [(r["chunk_type"], r["section_title"]) for r in rows] == [("faq_chunk", "one?"), ("faq_chunk", "two?")]
    steps = chunking.step_chunks("head\n步骤1：open\nlook\n步骤2：close")
    assert [s[:2] for s in steps] == [("text_chunk", ""), ("procedure_parent", ""), ("step_card", "1"), ("step_card", "2")] and steps[1][2] == "1. open\n2. close"
    assert [c[1] for c in chunking.clause_chunks("1、目的 说明\n2.1 范围 3.5 mm\n5mm not\n")] == ["1", "2.1"]


def test_cap_interleave_and_ties(spark):
    pool = spark.createDataFrame([(1, k, d, k in (2,), k) for k, d in enumerate("aaabbc", 1)], "query_id long, pk long, doc_id string, is_cover boolean, rank int")
    assert [r["pk"] for r in retrieval.select_with_cap(pool, 4, 1).orderBy("position").collect()] == [1, 4, 6, 3]
    lists = spark.createDataFrame([(1, 0, 1, "x"), (1, 0, 2, "y"), (1, 1, 1, "y"), (1, 1, 2, "z")], "query_id long, list_no int, rank int, pk string")
    assert [r["pk"] for r in retrieval.interleave(lists).orderBy("position").collect()] == ["x", "y", "z"]
    hits = spark.createDataFrame([(1, 1, 0.9, False), (1, 2, 0.89, False), (1, 3, 0.885, True), (1, 4, 0.5, True)], "query_id long, rank int, score double, is_image boolean")
    assert [(r["rank"], r["score"]) for r in retrieval.image_tie_break(hits, 0.02).orderBy("rank").collect()] == [(1, 0.885), (2, 0.9), (3, 0.89), (4, 0.5)]


def test_steps_and_validation(spark):
    steps = spark.createDataFrame([(f"s{k}", "p", k, "public" if k != 3 else "restricted", "o") for k in range(1, 6)], "chunk_id string, parent_chunk_id string, step_no int, permission_level string, owner_dept string")
    hits = spark.createDataFrame([(1, "general", "s2", "p", 2, "public", "o"), (2, "full", "s9", "p", 9, "public", "o")], "query_id long, intent string, chunk_id string, parent_chunk_id string, step_no int, permission_level string, owner_dept string")
    got = {}
    for r in retrieval.expand_steps(hits, steps).collect():
        got.setdefault(r["query_id"], set()).add(r["chunk_id"])
    assert got == {1: {"s1", "s2"}, 2: {"s1", "s2", "s4", "s5", "s9"}}
    shape = "chunk_id string, permission_level string, owner_dept string, pk long"
    h = spark.createDataFrame([("a", "public", "o", 1), ("b", "public", "o", 2), (None, "public", "o", 3)], shape)
    auth = spark.createDataFrame([("a", "public", "o", 1, 1), ("b", "restricted", "o", 2, 1)], shape + ", is_active int")
    assert retrieval.revalidate(h, auth).count() == 1 and retrieval.revalidate(h, auth, strict=False).count() == 2


def test_dense_refuses_unbounded_queries(spark):
    v = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        retrieval.dense_top_k(v.withColumnRenamed("vec_id", "query_id"), v, 1, max_queries=3)


def test_leaders_and_groups(spark):
    m = spark.createDataFrame([("a", [1.0, 0.0], 5), ("b", [0.99, 0.1], 3), ("c", [0.0, 1.0], 4), ("d", [1.0, 0.0], 1)], "hash string, vector array<double>, weight int")
    clusters = gaps.leader_clusters(m, 0.9)
    assert {r["hash"]: r["representative"] for r in clusters.collect()} == {"a": "a", "b": "a", "c": "c", "d": "a"}
    g = spark.createDataFrame([("a", "A", 2, 5, "no_result"), ("b", "B", 7, 1, "refusal"), ("c", "C", 1, 1, "no_result")], "hash string, raw string, asks long, days int, kind string")
    assert {r["group"]: tuple(r)[1:] for r in gaps.merge_groups(g, clusters).collect()} == {"a": ("A", 9, 1, "refusal", 2), "c": ("C", 1, 1, "no_result", 1)}


def test_statistics(spark):
    sc = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1)], "score double, label int")
    assert evaluation.auc(sc).first()["auc"] == 0.875 and evaluation.youden_threshold(sc).first()["threshold"] == 0.4
    pairs = spark.createDataFrame([(1, 0)] * 6 + [(0, 1)] + [(1, 1)] * 3 + [(None, 1)], "a int, b int")
    assert evaluation.mcnemar(pairs, "a", "b").first()["p"] == pytest.approx(0.125)
    ci = evaluation.bootstrap_ci(spark.createDataFrame([(float(k),) for k in range(100)], "x double"), "x", "x", 500).first()
    assert ci["low"] < ci["mean"] == 49.5 < ci["high"]
    base = spark.createDataFrame([("r", 0.9, True, False, False), ("l", 1.0, False, False, False), ("p", 4.0, True, True, False), ("n", 0.5, True, False, True), ("gone", 1.0, True, False, False)], "metric string, value double, higher_is_better boolean, points boolean, advisory boolean")
    cur = spark.createDataFrame([("r", 0.88), ("l", 1.1), ("p", 3.7), ("n", 0.1)], "metric string, value double")
    assert {r["metric"]: r["verdict"] for r in evaluation.compare_baseline(cur, base, True).collect()} == {"r": "ok", "l": "regression", "p": "regression", "n": "note"}
    assert evaluation.compare_baseline(cur, base, False).first()["verdict"] == "not_comparable"


def test_near_duplicates_against_all_pairs(spark):
    import random

    rng = random.Random(2)
    texts = {}
    for k in range(40):
        t = list(texts[rng.randrange(k)] if k and rng.random() < 0.6 else "".join(rng.choices("abcdef", k=200)))
        t[rng.randrange(len(t))] = "z"
        texts[k] = "".join(t)
    texts |= {40: texts[3], 41: texts[3], 42: "short", 43: ""}
    grams = {k: {t[i : i + 8] for i in range(len(t) - 7)} for k, t in texts.items()}
    want = {(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.9 * max(1, len(grams[a] | grams[b]))}
    df = spark.createDataFrame(list(texts.items()), "chunk_id long, chunk_text string")
    heads = {k: min(j for j in grams if j == k or grams[j] and grams[j] == grams[k]) for k in grams}
    pairs = {(a, b) for a, b in want if heads[a] == a and heads[b] == b}
    assert want and {(r["a"], r["b"]) for r in audits.near_duplicate_classes(audits.gram_classes(df)).collect()} == pairs
    got = {r["chunk_id"]: (r["class_id"], r["links"]) for r in audits.near_duplicate_chunks(df).collect()}
    assert got == {k: (h, sum(h in p for p in pairs)) for k, h in heads.items()}


def test_budget_and_limiter(spark):
    r = spark.createDataFrame([("d", "r1", "x", 1, 5.0), ("d", "r1", "x", 2, 6.0), ("d", "r1", "y", 3, 7.0), ("d", "r1", "y", 4, 1.0), ("d", "r2", "y", 5, 6.0), ("d", "r2", "z", 6, 0.0)], "day string, run string, doc string, seq int, estimate double")
    assert [x["reason"] for x in audits.reserve_budget(r, 10.0, 11.0, 12.0).orderBy("seq").collect()] == ["ok", "doc_cap", "run_cap", "run_tripped", "ok", "bad_estimate"]
    assert limits.admit([0, 1, 2, 59, 60, 61, 62], [], 2, 60) == [True, True, False, False, True, True, False]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.pdf").write_bytes(b"x")
    assert files.list_objects(spark, str(tmp_path / "raw")).count() == 1
    new = spark.createDataFrame([("A", "s1"), ("B", "s1"), ("A", "s2"), ("A", "")], "dept string, stem string")
    old = spark.createDataFrame([("a", "s1"), ("a", "")], "dept string, stem string")
    assert {(r["dept"], r["stem"]): r["action"] for r in files.stem_twins(new, old).collect()} == {("A", "s1"): "skip", ("B", "s1"): "warn", ("A", "s2"): "ok", ("A", ""): "ok"}
    assert files.html_text("<p>a &amp; b</p><script>x</script><div>c</div>") == "a & b\n\nc" and files.html_text("") == ""
    assert spark.createDataFrame([("a;b\n\n c ; d \n",)], "t string").select(files.csv_text(F.col("t")).alias("y")).first()["y"] == "a | b\nc | d"
    snap = tables.refresh_snapshot(spark.createDataFrame([(1, "x", 1), (2, "y", 1)], "id long, name string, revision int"), spark.createDataFrame([(2, "z"), (3, "w")], "id long, name string"), "id", 2)
    assert {tuple(r) for r in snap.collect()} == {(1, "x", 0, 1), (2, "z", 1, 2), (3, "w", 1, 2)}
    keys, table, lost = (spark.createDataFrame([(k,) for k in x], "k long") for x in ([1, 2, 3], [1], [2]))
    assert {r["k"]: r["lookup"] for r in tables.point_lookup(keys, table, "k", lost).collect()} == {1: "present", 2: "unknown", 3: "missing"}
    chunks = spark.createDataFrame([(k, "x" * n) for k, n in enumerate((10, 10, 500, 10))], "id long, body string")
    assert [(r["n_rows"]) for r in sinks.bulk_batches(chunks, "id", 100).orderBy("batch_no").collect()] == [2, 1, 1]
    facts = sinks.retrieved_facts(spark.createDataFrame([(1, '[{"doc_id":"a","cited":1},{"doc_id":"a","cited":1},{"doc_id":"b"}]'), (2, None), (3, "[")], "message_id long, retrieved_docs_json string"))
    assert {tuple(r) for r in facts.collect()} == {(1, "a", 1), (1, "b", 0)}


def test_office_files():
    import io
    import zipfile

    from quarry.sources import office

    buf = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert office.docx_blocks(buf.getvalue()) == [("heading", "Title", None, 1), ("paragraph", "Text", None, None), ("table", "a | b", None, None)]
    assert office.workbook_layout("FAQ list", ["s"], "q") == "faq" and office.workbook_layout("x", [], "") == "table"


def test_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = pd.DataFrame({"message_id": [1, 1, 2, 3], "actor": ["a", "a", "a", "b"], "created_at": [start, start, start + dt.timedelta(hours=1), start + dt.timedelta(days=3)], "ts": [0.0, 0.5, 1.0, 2.0], "answer_status": "SUCCESS", "latency_ms": 1.0})
    spark.createDataFrame(rows).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))

    def collect(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        assert q.awaitTermination(120)
        return spark.table(name).collect()

    assert {(str(r["day"]), r["n"]) for r in collect(rollups.daily_counts(stream), "days")} == {("2024-01-01", 3)}
    assert sorted(r["message_id"] for r in collect(rollups.once_per_message(stream, ts="created_at"), "once")) == [1, 2, 3]
    assert sorted((r["actor"], r["ts"], r["admitted"]) for r in collect(limits.sliding_limit_stream(stream, 2, expire=False), "limited")) == [("a", 0.0, True), ("a", 0.5, True), ("a", 1.0, False), ("b", 2.0, True)]
    seen = []
    assert rollups.drain(stream, str(tmp_path / "drain"), lambda df, n: seen.append(df.count())) >= 1 and sum(seen) == 4
    assert rollups.drain(stream, str(tmp_path / "drain"), lambda df, n: seen.append(df.count())) == 0


def test_dense_top_k_takes_any_number_of_queries(spark, monkeypatch):
    from functools import partial

    from quarry.plans import catalogue, texts

    v = spark.createDataFrame([(100 * n, [float(n), 30.0 - n]) for n in range(30)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(texts, "read", lambda *_: v)
    want = {tuple(r) for r in catalogue.QUERIES["dense_topk"](spark, "").collect()}
    whole = {n: getattr(retrieval, n) for n in ("dense_top_k", "dense_top_k_in_blocks") if hasattr(retrieval, n)}
    for name, f in whole.items():
        monkeypatch.setattr(retrieval, name, partial(f, max_queries=8) if name == "dense_top_k_in_blocks" or len(whole) == 1 else f)
    got = [tuple(r) for r in catalogue.QUERIES["dense_topk"](spark, "").collect()]
    assert len(got) == 300 and set(got) == want
