"""What the findings of round 4 named, each on tables that failed before."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from quarry.operators import audits, gaps, overlaps, retrieval, vectors
from quarry.plans import analytics, catalogue


def test_parity_of_the_first_line_of_a_key(spark, data, tmp_path):
    # Two files, of which the second is read first as it is larger; both hold the same keys.
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    duck = duckdb.connect()
    duck.execute("SET threads = 1")
    keep = "l_orderkey * 10 + l_linenumber AS k, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS n"
    duck.execute(f"CREATE TABLE t AS SELECT * EXCLUDE (k, n) FROM (SELECT *, {keep} FROM '{data}/lineitem.parquet') WHERE n = 1")
    duck.execute(f"COPY (SELECT * REPLACE ('R' AS l_returnflag) FROM t) TO '{folder}/a.parquet'")
    duck.execute(f"COPY (SELECT * REPLACE ('A' AS l_returnflag, 'F' AS l_linestatus) FROM t UNION ALL SELECT * REPLACE (l_orderkey + 1000000 AS l_orderkey) FROM t) TO '{folder}/b.parquet'")
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    want = duck.execute(catalogue.SQL["parity_buckets"]).fetchall()
    got = catalogue.QUERIES["parity_buckets"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def swapped(rows, eps):
    """Neighbours swapped until none can be."""
    rows, moved = list(rows), True
    while moved:
        moved = False
        for k in range(len(rows) - 1):
            a, b = rows[k], rows[k + 1]
            if b[3] and not a[3] and a[2] is not None and b[2] is not None and abs(a[2] - b[2]) < eps:
                rows[k], rows[k + 1], moved = b, a, True
    return [r[1] for r in rows]


@pytest.mark.parametrize("batch", [3, 10_000])
def test_images_move_up_without_a_group_a_query(spark, batch):
    rng = np.random.default_rng(4)
    rows = []
    for query in [None, *range(60)]:
        n = int(rng.integers(1, 60))
        scores = rng.normal(size=n) if query and query % 3 == 0 else np.sort(rng.integers(0, 12, n) / 10)[::-1]
        images = rng.random(n) < rng.random()
        rows += [(query, 100 * (query or 0) + k, None if rng.random() < 0.02 else float(scores[k]), bool(images[k]), 5 * k) for k in range(n)]
    hits = spark.createDataFrame(rows, "query_id long, pk long, score double, is_image boolean, rank int").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        moved = retrieval.image_tie_break(hits, 0.15, batch)
        got = moved.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert moved.schema.simpleString() == hits.schema.simpleString() and len(got) == len(rows)
    for query in {r[0] for r in rows}:
        of = sorted((r["rank"], r["pk"]) for r in got if r["query_id"] == query)
        assert [r[0] for r in of] == list(range(1, len(of) + 1))
        assert [r[1] for r in of] == swapped([r for r in rows if r[0] == query], 0.15)
    assert "FlatMapGroups" not in moved._jdf.queryExecution().toString()


def test_images_move_up_past_many(spark):
    # One query of many hits of one score, every other an image: half of all pairs are swapped.
    hits = spark.range(60_000).selectExpr("1L AS query_id", "id AS pk", "1D AS score", "id % 2 = 1 AS is_image", "id AS rank")
    got = [r["pk"] for r in retrieval.image_tie_break(hits, 0.1, 1000).orderBy("rank").collect()]
    assert got == [*range(1, 60_000, 2), *range(0, 60_000, 2)]


def test_sparse_dot_shuffles_no_pairs(spark):
    rng = np.random.default_rng(5)
    sides = []
    for name, n in (("query", 40), ("doc", 200)):
        at = {(int(rng.integers(0, n)), int(rng.integers(0, 9))): int(rng.integers(-3, 4)) for _ in range(5 * n)}
        sides.append(spark.createDataFrame([(k, t, w) for (k, t), w in at.items()] + [(n, None, 1)], f"{name}_id long, token long, weight long"))
    q, d = sides
    want = {tuple(r) for r in q.withColumnRenamed("weight", "qw").join(d, "token").groupBy("query_id", "doc_id").agg({"*": "count"}).select("query_id", "doc_id").collect()}
    by_query, by_doc = ({}, {})
    for side, out in ((q, by_query), (d, by_doc)):
        for k, t, w in side.where("token IS NOT NULL").collect():
            out.setdefault(k, {})[t] = w
    for most in (1 << 20, 16):
        scored = retrieval.sparse_dot(q, d, most, 50)
        got = {(r["query_id"], r["doc_id"]): r["score"] for r in scored.collect()}
        assert got.keys() == want and all(s == sum(w * by_doc[b].get(t, 0) for t, w in by_query[a].items()) for (a, b), s in got.items())
        # Each exchange is of documents' postings; none is of pairs.
        plan = scored._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert "hashpartitioning(query_id" not in plan


@pytest.mark.parametrize(("side", "rare"), [(1024, 512), (7, 512), (7, 1), (5, 10**9)])
def test_sets_in_tiles_against_all_pairs(monkeypatch, side, rare):
    monkeypatch.setattr(overlaps, "SIDE", side)
    monkeypatch.setattr(overlaps, "RARE", rare)
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 25, int(rng.integers(0, 14)))) for _ in range(60)]
    p, q = sets[:33], sets[20:]
    got = {(int(a), int(b)) for i, j in overlaps._like(p, q, 0.5) for a, b in zip(i, j, strict=True)}
    assert got == {(a, b) for a, x in enumerate(p) for b, y in enumerate(q) if len(x) + len(y) and len(np.intersect1d(x, y)) / len(np.union1d(x, y)) >= 0.5}


@pytest.mark.parametrize(("first", "tile"), [(8, 5), (50, 16)])
def test_text_leaders_in_blocks(spark, first, tile):
    rng = np.random.default_rng(7)
    letters = list("abcde\U0001f600é ")
    rows = [(f"h{k:04d}", "".join(rng.choice(letters, int(rng.integers(0, 9)))), int(rng.integers(0, 3))) for k in range(200)] + [("null", None, 1)]
    got = {r["hash"]: r["representative"] for r in gaps.text_leader_clusters(spark.createDataFrame(rows, "hash string, text string, weight int"), 0.5, first, tile).collect()}
    leaders, want = [], {}
    for name, x, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        x = "".join((x or "").split())
        grams = {x[k : k + 2] for k in range(max(1, len(x) - 1))}
        want[name] = next((lead for lead, y in leaders if len(grams & y) / len(grams | y) >= 0.5), name)
        if want[name] == name:
            leaders.append((name, grams))
    assert got == want


@pytest.mark.parametrize(("k", "pairs"), [(1, 1 << 20), (4, 30), (10, 90)])
def test_nearest_holds_few_products(k, pairs):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(70, 5)).astype(np.float32).astype(float)
    v[20:50] = v[3]
    ids, q = rng.permutation(70), v[::10]
    held = vectors.Nearest(q, k, pairs)
    wanted = rng.random((len(q), len(v))) < 0.7
    for low in range(0, 70, 25):
        held.add(ids[low : low + 25], v[low : low + 25], wanted[:, low : low + 25])
    out = held.frame(np.arange(len(q)) * 7)
    assert held.rows * len(q) <= max(pairs, len(q))
    for n, x in enumerate(q):
        want = sorted((-sum(float(a) * float(b) for a, b in zip(x, y, strict=True)), int(i)) for i, y, w in zip(ids, v, wanted[n], strict=True) if w)[:k]
        got = out[out["query_id"] == n * 7]
        assert got["vec_id"].tolist() == [i for _, i in want]
        assert np.allclose(got["score"], [-s for s, _ in want])


def test_lists_take_any_number_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(9)
    v = spark.createDataFrame([(20 * n, rng.normal(size=4).tolist()) for n in range(60)], "vec_id long, embedding array<float>")
    monkeypatch.setattr(analytics, "read", lambda *_: v)
    want = {name: sorted(tuple(r) for r in catalogue.QUERIES[name](spark, "").collect()) for name in ("ivf_exact", "ivf_recall")}
    monkeypatch.setattr(vectors, "MAX_QUERIES", 4)
    for f in (vectors.search_lists_in_blocks, retrieval.dense_top_k_in_blocks):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], 4))
    assert len(want["ivf_exact"]) == 120
    for name, rows in want.items():
        assert sorted(tuple(r) for r in catalogue.QUERIES[name](spark, "").collect()) == rows


@pytest.mark.parametrize(("threshold", "first", "tile"), [(0.5, 30, 7), (0.5, 1000, 2000), (0.8, 30, 7)])
def test_leaders_of_vectors_in_blocks(spark, threshold, first, tile):
    rng = np.random.default_rng(10)
    made = [rng.normal(size=4).round(2).tolist() for _ in range(120)]
    rows = [(f"h{k:04d}", made[k % 120], int(rng.integers(0, 3))) for k in range(220)] + [("null", None, 1), ("zero", [0.0] * 4, 2)]
    got = {r["hash"]: r["representative"] for r in gaps.leader_clusters(spark.createDataFrame(rows, "hash string, vector array<double>, weight int"), threshold, 8, tile, first).collect()}
    leaders, want = [], {}
    for name, x, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        x = np.array(x or [0.0] * 4)
        near = [(round(float(x @ y / np.linalg.norm(x) / np.linalg.norm(y)), 12), -k) for k, (_, y) in enumerate(leaders) if x.any() and y.any() and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold]
        want[name] = leaders[-max(near)[1]][0] if near else name
        if not near:
            leaders.append((name, x))
    assert got == want


def test_near_duplicates_write_no_sets(spark, monkeypatch):
    rng = np.random.default_rng(11)
    base = ["".join(rng.choice(list("abcdefgh"), 400)) for _ in range(6)]
    texts = [b[: 400 - int(cut)] + "x" * int(more) for b in base for cut, more in zip(rng.integers(0, 40, 6), rng.integers(0, 6, 6), strict=True)] + base + base[:2] + ["", None, "abc"]
    seen, kept = [], audits.written

    def watched(df, *a):
        seen.append(df.schema.simpleString())
        return kept(df, *a)

    monkeypatch.setattr(audits, "written", watched)
    rows = audits.near_duplicate_chunks(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, chunk_text string")).collect()
    assert not any("grams" in s or "prefix" in s for s in seen)
    sets = [frozenset((t or "")[k : k + 8] for k in range(max(0, len(t or "") - 7))) for t in texts]
    alike = [{y for y in sets if y and y != x and len(x & y) / len(x | y) >= 0.9} if x else set() for x in sets]
    assert any(alike)
    assert {r["chunk_id"]: (r["class_id"], r["links"]) for r in rows} == {n: (sets.index(x) if x else n, len(alike[n])) for n, x in enumerate(sets)}


def test_meetings_a_few_at_a_time():
    rng = np.random.default_rng(12)
    owners, codes, sizes = rng.integers(0, 30, 400), rng.integers(0, 25, 400), rng.integers(90, 110, 30)
    want = {(a, b) for a in range(30) for b in range(a + 1, 30) if set(codes[owners == a]) & set(codes[owners == b]) and min(sizes[a], sizes[b]) >= 0.9 * max(sizes[a], sizes[b])}
    for most in (1, 50, 1 << 22):
        x, y = audits._meetings(np.arange(30), sizes, owners, codes, 0.9, most)
        assert len(x) == len(want) and set(zip(x.tolist(), y.tolist(), strict=True)) == want
