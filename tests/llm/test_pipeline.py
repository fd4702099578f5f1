from __future__ import annotations

import corpus_pipeline
from quarry.llm import decontamination, quality
from quarry.llm.common import materialise


def firsts_of_groups(rows):
    """The smallest id of each group of texts that five-word shingles link at 0.8, by comparing all pairs of texts."""
    sets = {}
    for i, t in rows:
        words = (t or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else {()}
    label = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    label[a], moved = label[b], True
    return set(label.values())


def test_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]

    kept = materialise(stages["quality"](spark, docs, data), "t")
    good = {r["doc_id"] for r in quality.score(docs, quality.learn(docs, labels)).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == good

    single = materialise(stages["near_duplicates"](spark, kept, data), "t")
    firsts = firsts_of_groups([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert single.columns == docs.columns and sorted(r["doc_id"] for r in single.collect()) == sorted(firsts)

    clean = materialise(stages["decontamination"](spark, single, data), "t")
    leaks = {r["doc_id"] for r in decontamination.find_leaks(single, bench).collect()}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == firsts - leaks

    mixed = materialise(stages["mixing"](spark, clean, data), "t")
    words = lambda df: sum(len((r["text"] or "").split()) for r in df.collect())
    assert mixed.columns == docs.columns and abs(words(mixed) - 1.5 * words(clean)) < 40
    assert all(r["n_chars"] == len(r["text"]) for r in mixed.collect())

    out = stages["sharding"](spark, mixed, data)
    assert out.count() == mixed.count() and set(docs.columns) < set(out.columns)


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data).collect()
    assert out and len({(r["shard"], r["slot"]) for r in out}) == len(out)


def test_odd_rows_and_clashing_names(spark, data, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            out = materialise(stage(spark, docs, data), "t")
            assert set(docs.columns) <= set(out.columns) and out.count() <= 2 * docs.count(), name
            if name != "sharding":
                assert out.columns == docs.columns


def test_no_stage_leaves_python_to_its_reader(spark, data):
    """Whoever reads a stage's result sends no texts through Python in batches of the session's size."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(30)
    for name, stage in corpus_pipeline.STAGES[:3]:
        plan = stage(spark, docs, data)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "Python" not in plan, name
