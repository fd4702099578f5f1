"""Queries over sources, sinks, retrieval, reconciliation and evaluation that SQL states on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import acl, text
from quarry.operators import audits, chunking, evaluation, hierarchy, reconcile, retrieval
from quarry.plans.registry import query
from quarry.plans.views import DOCS, LOG, chunk, meta, qlog
from quarry.sources import files, sinks, tables
from quarry.sources.tables import read
from quarry.streaming import rollups

_TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query("object_listing", "SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in _TABLES) + ") AS t(name)")
def object_listing(spark: SparkSession, d: str) -> DataFrame:
    listed = files.list_objects(spark, d).where("length > 0")
    return listed.select(F.regexp_extract("key", "/([a-z]+)\\.parquet", 1).alias("name")).where(F.col("name").isin(*_TABLES)).distinct()


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("nation", "customer", "orders", "lineitem", "events")))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = [read(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("nation", "customer", "orders", "lineitem", "events")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("new_objects", "SELECT o_orderkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)")
def new_objects(spark: SparkSession, d: str) -> DataFrame:
    registered = read(spark, d, "lineitem").where("l_linenumber = 4").select(F.col("l_orderkey").alias("key"))
    return files.new_objects(read(spark, d, "orders").select(F.col("o_orderkey").alias("key")), registered)


@query("stem_twins", """WITH n AS (SELECT s_suppkey AS id, 'D' || s_nationkey AS dept, 'f' || (s_suppkey % 40) AS stem FROM supplier), e AS (SELECT DISTINCT lower('d' || c_nationkey) AS dept, 'f' || (c_custkey % 60) AS stem FROM customer WHERE c_custkey % 3 = 0)
SELECT id, dept, stem, CASE WHEN NOT EXISTS (SELECT 1 FROM e WHERE e.stem = n.stem) THEN 'ok' WHEN EXISTS (SELECT 1 FROM e WHERE e.stem = n.stem AND e.dept = lower(n.dept)) THEN 'skip' ELSE 'warn' END AS action FROM n""")
def stem_twins(spark: SparkSession, d: str) -> DataFrame:
    new = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("D"), F.col("s_nationkey").cast("string")).alias("dept"), F.concat(F.lit("f"), (F.col("s_suppkey") % 40).cast("string")).alias("stem"))
    old = read(spark, d, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("dept"), F.concat(F.lit("f"), (F.col("c_custkey") % 60).cast("string")).alias("stem"))
    return files.stem_twins(new, old).select("id", "dept", "stem", "action")


@query("point_lookup", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'present' WHEN c_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) THEN 'unknown' ELSE 'missing' END AS lookup FROM customer")
def point_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return tables.point_lookup(c.select("c_custkey"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", c.where("c_nationkey = 3"))


@query("normalized_hits", "SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS section, CASE WHEN o_orderkey % 5 = 0 THEN 'restricted' ELSE 'public' END AS permission_level, 0 AS rank FROM orders")
def normalized_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("section"), F.when(F.col("o_orderkey") % 5 != 0, "public").alias("permission_level"))
    return tables.normalize_hits(hits, {"section": "none", "rank": 0})


@query("cache_rounds", """WITH c AS (SELECT c_custkey AS k, 'old' AS v FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT DISTINCT o_custkey AS k, 'new' AS v FROM orders WHERE o_orderkey % 3 = 0), p AS (SELECT * FROM n UNION ALL SELECT * FROM c WHERE k NOT IN (SELECT k FROM n)),
e AS (SELECT * FROM p ORDER BY k DESC LIMIT 50), m AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT k FROM p)) SELECT 'kept' AS what, k, v FROM e UNION ALL SELECT 'miss', k, NULL FROM m""")
def cache_rounds(spark: SparkSession, d: str) -> DataFrame:
    orders = read(spark, d, "orders")
    cache = read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    put = tables.cache_put(cache, orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("k"), F.lit("new").alias("v")).distinct(), "k")
    missed = tables.cache_misses(orders.select(F.col("o_custkey").alias("k")), put, "k")
    return tables.cache_evict(put, F.col("k"), 50).select(F.lit("kept").alias("what"), "k", "v").union(missed.select(F.lit("miss"), "k", F.lit(None).cast("string")))


@query("org_snapshot", """WITH o AS (SELECT n_nationkey AS id, n_name AS name, 1 AS revision FROM nation WHERE n_nationkey < 20), n AS (SELECT n_nationkey AS id, lower(n_name) AS name FROM nation WHERE n_nationkey > 4)
SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN n.id IS NOT NULL THEN 1 ELSE 0 END AS is_active, CASE WHEN n.id IS NOT NULL THEN 2 ELSE o.revision END AS revision FROM o FULL JOIN n ON o.id = n.id""")
def org_snapshot(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation")
    old = n.where("n_nationkey < 20").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(1).alias("is_active"), F.lit(1).alias("revision"))
    return tables.refresh_snapshot(old, n.where("n_nationkey > 4").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name")), "id", 2)


@query("status_write_back", f"""WITH {DOCS}, c AS (SELECT doc_id, version_no, CASE WHEN part_id % 11 = 0 THEN 'FAILED' ELSE index_status END AS s FROM chunk), p AS (SELECT doc_id, version_no, count(*) AS n, count(*) FILTER (s = 'FAILED') AS f, count(*) FILTER (s = 'INDEXED') AS i FROM c GROUP BY 1, 2)
SELECT doc_id, version_no, CASE WHEN n IS NULL THEN 'EMPTY' WHEN f > 0 THEN 'FAILED' WHEN i = n THEN 'INDEXED' ELSE 'PROCESSING' END AS chunk_status FROM (SELECT doc_id, current_version_no AS version_no FROM meta) LEFT JOIN p USING (doc_id, version_no)""")
def status_write_back(spark: SparkSession, d: str) -> DataFrame:
    c = chunk(spark, d).withColumn("index_status", F.when(F.col("part_id") % 11 == 0, "FAILED").otherwise(F.col("index_status")))
    return sinks.status_write_back(meta(spark, d).select("doc_id", F.col("current_version_no").alias("version_no")), c)


@query("insert_ignored_facts", f"""WITH {LOG}, r AS (SELECT message_id, k % 9 AS doc_id FROM qlog WHERE k % 2 = 0), t AS (SELECT message_id, 0 AS doc_id, 'old' AS origin FROM qlog WHERE message_id % 4 = 0)
SELECT * FROM t UNION ALL SELECT message_id, doc_id, 'new' FROM r WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.message_id = r.message_id AND t.doc_id = r.doc_id)""")
def insert_ignored_facts(spark: SparkSession, d: str) -> DataFrame:
    log = qlog(spark, d)
    old = log.where("message_id % 4 = 0").select("message_id", F.lit(0).cast("long").alias("doc_id"), F.lit("old").alias("origin"))
    new = log.where("k % 2 = 0").select("message_id", (F.col("k") % 9).alias("doc_id"), F.lit("new").alias("origin"))
    return sinks.insert_ignore(old, new.union(new), ["message_id", "doc_id"])


@query("retrieved_facts", f"WITH {LOG} SELECT DISTINCT message_id, doc_id, cited FROM (SELECT message_id, unnest(['d' || k % 7, 'd' || k % 5]) AS doc_id, unnest([1, 0]) AS cited FROM qlog WHERE k % 6 > 0)")
def retrieved_facts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    said = F.format_string('[{"doc_id": "d%d", "cited": 1}, {"doc_id": "d%d"}, {"doc_id": null}]', k % 7, k % 5)
    return sinks.retrieved_facts(qlog(spark, d).select("message_id", F.when(k % 6 > 0, said).when(k % 12 == 0, "[broken").alias("retrieved_docs_json")))


@query("conditional_update", f"""WITH {DOCS} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM chunk WHERE is_active = 0 AND qty > 40) THEN 'stale' ELSE status END AS status FROM meta""")
def conditional_update(spark: SparkSession, d: str) -> DataFrame:
    return sinks.update_where(meta(spark, d).select("doc_id", "status"), chunk(spark, d), ["doc_id"], F.expr("is_active = 0 AND qty > 40"), {"status": F.lit("stale")})


@query("log_commit", f"""WITH {LOG} SELECT 'events' AS part, count(*) AS n, CAST(sum(message_id) AS BIGINT) AS total FROM qlog UNION ALL SELECT 'facts', count(*), CAST(sum(message_id) AS BIGINT) FROM (SELECT DISTINCT message_id, unnest([k % 3, k % 4]) AS doc FROM qlog)
UNION ALL SELECT 'conversations', count(*), CAST(sum(messages) AS BIGINT) FROM (SELECT session_id, count(*) AS messages FROM qlog GROUP BY 1)""")
def log_commit(spark: SparkSession, d: str) -> DataFrame:
    rows = qlog(spark, d).withColumn("retrieved", F.array(F.col("k") % 3, F.col("k") % 4, F.lit(None)))
    parts = sinks.log_rows(rows.unionByName(rows.withColumn("created_at", F.expr("created_at + INTERVAL 1 HOUR"))))
    total = {"events": F.sum("message_id"), "facts": F.sum("message_id"), "conversations": F.sum("messages")}
    out = None
    for name, part in parts.items():
        one = part.agg(F.count("*").alias("n"), total[name].alias("total")).select(F.lit(name).alias("part"), "n", "total")
        out = one if out is None else out.union(one)
    return out


@query("archived_then_deleted", f"WITH {DOCS} SELECT doc_id, priority FROM meta WHERE NOT CAST(created_at AS DATE) < CAST(DATE '1998-08-01' - INTERVAL 18 MONTH AS DATE) OR doc_id % 10 = 0")
def archived_then_deleted(spark: SparkSession, d: str) -> DataFrame:
    """What the archive missed stays."""
    rows = meta(spark, d).select("doc_id", "priority", "created_at")
    _, old = sinks.split_by_retention(rows, "created_at", "rows", F.lit("1998-08-01").cast("date"))
    return sinks.delete_archived(rows, old.where("doc_id % 10 <> 0"), ["doc_id"]).select("doc_id", "priority")


@query("audit_rows", "SELECT c_custkey, CASE WHEN length(v) <= 4 THEN repeat('*', length(v)) ELSE substr(v, 1, 2) || '***' || substr(v, length(v) - 1, 2) END AS staff_id, substr(m, 1, 20) AS message FROM (SELECT c_custkey, CAST(c_custkey * 91 AS VARCHAR) AS v, c_mktsegment || ' ' || c_name || ' was changed' AS m FROM customer)")
def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 91).cast("string").alias("staff_id"), F.concat_ws(" ", "c_mktsegment", "c_name", F.lit("was changed")).alias("message"))
    return sinks.audit_rows(rows, 20)


_HITS = "h AS (SELECT l_orderkey AS query_id, l_orderkey * 10 + l_linenumber AS chunk_id, min(l_partkey) AS pk, CASE l_linenumber % 3 WHEN 0 THEN 'restricted' ELSE 'public' END AS permission_level, 'o' || (min(l_suppkey) % 4) AS owner_dept FROM lineitem GROUP BY l_orderkey, l_linenumber)"


@query("revalidated_hits", f"""WITH {_HITS}, a AS (SELECT chunk_id, CASE WHEN pk % 13 = 0 THEN 'restricted' ELSE permission_level END AS p, CASE WHEN pk % 17 = 0 THEN NULL ELSE owner_dept END AS o, CASE WHEN pk % 19 = 0 THEN pk + 1 ELSE pk END AS k FROM h WHERE pk % 7 > 0)
SELECT h.query_id, h.chunk_id FROM h JOIN a USING (chunk_id) WHERE h.permission_level = a.p AND h.owner_dept IS NOT DISTINCT FROM a.o AND h.pk = a.k""")
def revalidated_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = _hits(spark, d)
    pk = F.col("pk")
    authority = hits.select(
        "chunk_id", (pk % 7 > 0).cast("int").alias("is_active"), F.when(pk % 13 == 0, "restricted").otherwise(F.col("permission_level")).alias("permission_level"),
        F.when(pk % 17 != 0, F.col("owner_dept")).alias("owner_dept"), F.when(pk % 19 == 0, pk + 1).otherwise(pk).alias("pk"),
    )
    return retrieval.revalidate(hits, authority).select("query_id", "chunk_id")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    one = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("pk"), F.min("l_suppkey").alias("owner"))
    return one.select(
        F.col("l_orderkey").alias("query_id"), (F.col("l_orderkey") * 10 + n).alias("chunk_id"), "pk", F.when(n % 3 == 0, "restricted").otherwise("public").alias("permission_level"),
        F.concat(F.lit("o"), (F.col("owner") % 4).cast("string")).alias("owner_dept"),
    )


@query("revoked_grants", """WITH h AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, 'g' || l_linenumber % 3 AS grp, l_suppkey % 2 = 0 AS via FROM lineitem), g AS (SELECT o_orderkey AS doc_id, 'g' || o_custkey % 3 AS grp, o_orderstatus AS s FROM orders)
SELECT doc_id, n FROM h WHERE NOT via OR EXISTS (SELECT 1 FROM g WHERE g.doc_id = h.doc_id AND g.grp = h.grp AND s = 'F')""")
def revoked_grants(spark: SparkSession, d: str) -> DataFrame:
    hits = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), F.concat(F.lit("g"), (F.col("l_linenumber") % 3).cast("string")).alias("group"), (F.col("l_suppkey") % 2 == 0).alias("via_grant"))
    grants = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("g"), (F.col("o_custkey") % 3).cast("string")).alias("group"), F.when(F.col("o_orderstatus") == "F", "Approved").otherwise("revoked").alias("status"))
    return acl.still_granted(hits, grants).select("doc_id", "n")


@query("gated_groups", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND source IS NOT NULL THEN source ELSE '' END AS allowed FROM documents")
def gated_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    allowed = acl.gate_allowed(F.when(F.col("doc_id") % 3 == 0, "dept_internal").otherwise("public"), F.when(F.col("source").isNotNull(), F.array("source")))
    return docs.select("doc_id", F.array_join(allowed, ",").alias("allowed"))


@query("id_lists", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 5, 9))")
def id_lists(spark: SparkSession, d: str) -> DataFrame:
    ids = read(spark, d, "customer").where(F.col("c_nationkey").isin(1, 5, 9)).select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, d, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("first_level_ancestor", """WITH RECURSIVE t AS (SELECT CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent UNION ALL SELECT DISTINCT CAST(c_custkey AS BIGINT), CAST(c_custkey // 3 AS BIGINT) FROM customer WHERE c_custkey > 0), r AS (SELECT id AS node, id, parent FROM t WHERE id > 0 UNION ALL SELECT r.node, t.id, t.parent FROM r JOIN t ON t.id = r.parent WHERE t.id > 0)
SELECT node, id AS top FROM r WHERE parent = 0""")
def first_level_ancestor(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("id"), F.expr("c_custkey div 3").alias("parent")).distinct()
    tree = c.union(spark.createDataFrame([(0, None)], "id long, parent long")).withColumn("depth", F.when(F.col("parent").isNull(), 0).when(F.col("parent") == 0, 1).otherwise(2))
    return hierarchy.first_level(hierarchy.ancestors(tree), tree).where("node > 0")


@query("docset_hash", "SELECT l_orderkey, substr(sha256(array_to_string(list_sort(list_distinct(list(CAST(l_partkey AS VARCHAR)))), ',')), 1, 12) AS h FROM lineitem GROUP BY 1")
def docset_hash(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(text.docset_hash(F.collect_list(F.col("l_partkey").cast("string"))).alias("h"))


@query("degraded_arms", f"""WITH {_HITS}, a AS (SELECT DISTINCT query_id, chunk_id AS pk, CASE WHEN chunk_id % 2 = 0 THEN 'dense' ELSE 'bm25' END AS arm FROM h) SELECT query_id, pk, arm, query_id % 5 IN (0, 1) AS degraded FROM a WHERE NOT (query_id % 5 IN (0, 1) AND arm = 'dense')""")
def degraded_arms(spark: SparkSession, d: str) -> DataFrame:
    arms = _hits(spark, d).select("query_id", F.col("chunk_id").alias("pk"), F.when(F.col("chunk_id") % 2 == 0, "dense").otherwise("bm25").alias("arm"))
    q = F.col("query_id") % 5
    vector = F.when(q == 0, F.lit(None).cast("array<double>")).when(q == 1, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    return retrieval.degrade_dense(arms, arms.select("query_id").distinct().withColumn("embedding", vector))


@query("sparse_dot", """WITH q AS (SELECT o_orderkey AS query_id, l_partkey % 50 AS token, max(l_linenumber) AS qw FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 100 = 0 GROUP BY 1, 2), p AS (SELECT l_orderkey AS doc_id, l_partkey % 50 AS token, CAST(max(l_quantity) AS BIGINT) AS dw FROM lineitem GROUP BY 1, 2)
SELECT query_id, doc_id, CAST(sum(qw * dw) AS BIGINT) AS score FROM q JOIN p USING (token) GROUP BY 1, 2""")
def sparse_dot(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the orders whose id is divisible by 100."""
    p = read(spark, d, "lineitem").groupBy("l_orderkey", (F.col("l_partkey") % 50).alias("token")).agg(F.max("l_quantity").cast("long").alias("dw"), F.max("l_linenumber").cast("long").alias("qw"))
    queries = p.where("l_orderkey % 100 = 0").select(F.col("l_orderkey").alias("query_id"), "token", F.col("qw").alias("weight"))
    return retrieval.sparse_dot(queries, p.select(F.col("l_orderkey").alias("doc_id"), "token", F.col("dw").alias("weight")))


_RANKED = "r AS (SELECT l_orderkey AS query_id, l_linenumber AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rank, l_partkey AS doc_id, l_quantity AS qty FROM lineitem)"


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("n"), rank.alias("rank"), F.col("l_partkey").alias("doc_id"), F.col("l_quantity").alias("qty"))


@query("demoted_covers", f"""WITH {_RANKED}, c AS (SELECT *, doc_id % 2 = 0 AND doc_id % 3 = 0 AND qty < 20 AS cover FROM r) SELECT query_id, n, doc_id, cover AS is_cover, row_number() OVER (PARTITION BY query_id ORDER BY cover, rank) AS rank FROM c""")
def demoted_covers(spark: SparkSession, d: str) -> DataFrame:
    doc = F.col("doc_id")
    hits = _ranked(spark, d).withColumns({"chunk_type": F.when(doc % 2 == 0, "text_chunk").otherwise("table_chunk"), "section_title": F.when(doc % 3 != 0, "s"), "chunk_text": F.repeat(F.lit("x"), (F.col("qty") * 10).cast("int"))})
    return retrieval.demote_covers(hits).select("query_id", "n", "doc_id", "is_cover", F.col("rank").cast("long").alias("rank"))


@query("reranked", f"""WITH {_RANKED}, s AS (SELECT *, CASE WHEN doc_id % 9 > 0 THEN qty END AS new FROM r) SELECT query_id, n, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY new DESC NULLS LAST, rank) AS rank FROM s QUALIFY rank <= 3""".replace("QUALIFY rank <= 3", "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY new DESC NULLS LAST, s.rank) <= 3"))
def reranked(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.rerank(_ranked(spark, d), F.when(F.col("doc_id") % 9 > 0, F.col("qty")), 3)
    return out.select("query_id", "n", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("rerank_degraded", f"WITH {_RANKED} SELECT query_id, n, doc_id, rank, true AS degraded FROM r WHERE rank <= 3")
def rerank_degraded(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.rerank(_ranked(spark, d), None, 3).select("query_id", "n", "doc_id", F.col("rank").cast("long").alias("rank"), "degraded")


@query("cosurfaced_images", f"""WITH {_RANKED}, b AS (SELECT query_id, doc_id, min(rank) AS rank FROM r GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS k FROM b QUALIFY k <= 2), i AS (SELECT DISTINCT ps AS doc_id, image_id FROM (SELECT l_partkey AS ps, l_suppkey AS image_id FROM lineitem))
SELECT query_id, doc_id, image_id, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY image_id) AS n FROM t JOIN i USING (doc_id) QUALIFY n <= 3""")
def cosurfaced_images(spark: SparkSession, d: str) -> DataFrame:
    images = read(spark, d, "lineitem").select(F.col("l_partkey").alias("doc_id"), F.col("l_suppkey").alias("image_id")).distinct()
    return retrieval.cosurface_images(_ranked(spark, d), images).withColumn("n", F.col("n").cast("long"))


@query("dated_hits", f"""WITH {DOCS}, v AS (SELECT o_orderkey AS doc_id, unnest([1, 2, 3]) AS version_no, o_orderdate AS d FROM orders WHERE o_orderkey % 5 > 0) SELECT chunk_id, CAST(d + to_days(CAST(version_no AS INT)) AS DATE) AS doc_date FROM chunk LEFT JOIN (SELECT v.doc_id, v.version_no, v.d FROM v JOIN meta m ON m.doc_id = v.doc_id AND m.current_version_no = v.version_no) v USING (doc_id)""".replace("chunk_id, CAST", "chunk.chunk_id, CAST").replace("version_no AS INT", "v.version_no AS INT"))
def dated_hits(spark: SparkSession, d: str) -> DataFrame:
    m = meta(spark, d)
    v = m.where("doc_id % 5 > 0").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("version_no"), F.col("created_at").alias("at"))
    v = v.select("doc_id", "version_no", F.date_add(F.to_date("at"), F.col("version_no")).alias("created_at"))
    return retrieval.attach_dates(chunk(spark, d).select("chunk_id", "doc_id"), v, m).select("chunk_id", "doc_date")


@query("page_with_more", f"WITH {DOCS} SELECT doc_id, (SELECT count(*) FROM meta) > 70 AS has_more FROM meta ORDER BY price DESC, doc_id LIMIT 50 OFFSET 20")
def page_with_more(spark: SparkSession, d: str) -> DataFrame:
    page, more = retrieval.page_with_more(meta(spark, d), [F.desc("price"), F.col("doc_id")], 50, 20)
    return page.select("doc_id", F.lit(more).alias("has_more"))


@query("random_rows", "SELECT doc_id FROM documents ORDER BY md5('7|' || doc_id), doc_id LIMIT 100")
def random_rows(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.random_rows(read(spark, d, "documents"), "doc_id", 100).select("doc_id")


_STORE = """s AS (SELECT l_orderkey * 10 + l_linenumber AS pk, l_orderkey AS doc_id, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS is_active, CASE l_linestatus WHEN 'F' THEN 'INDEXED' ELSE 'NOT_INDEXED' END AS index_status FROM lineitem),
i AS (SELECT pk, doc_id FROM s WHERE pk % 11 > 0 UNION ALL SELECT pk, doc_id FROM s WHERE pk % 97 = 0 UNION ALL SELECT -pk, -doc_id FROM s WHERE pk % 89 = 0)"""


def _stores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Of lines of one key the store has the first in the table's order, whatever the partitions."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place")
    s = read(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pk"), F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("is_active"), F.when(F.col("l_linestatus") == "F", "INDEXED").otherwise("NOT_INDEXED").alias("index_status"), place)
    i = s.where("pk % 11 > 0").select("pk", "doc_id").union(s.where("pk % 97 = 0").select("pk", "doc_id")).union(s.where("pk % 89 = 0").select(-F.col("pk"), -F.col("doc_id")))
    first = s.groupBy("pk").agg(F.min(F.struct("place", "doc_id", "is_active", "index_status")).alias("first"))
    return first.select("pk", "first.doc_id", "first.is_active", "first.index_status"), i


@query("parity_buckets", f"""WITH {_STORE}, c AS (SELECT pk, count(*) AS n FROM i GROUP BY 1), u AS (SELECT DISTINCT ON (pk) * FROM s), j AS (SELECT coalesce(u.pk, c.pk) AS pk, CASE WHEN c.pk IS NULL AND is_active = 1 AND index_status = 'INDEXED' THEN 'missing' WHEN c.pk IS NULL THEN NULL WHEN n > 1 THEN 'dup' WHEN u.pk IS NULL THEN 'orphan' WHEN is_active <> 1 THEN 'inactive' END AS kind FROM u FULL JOIN c ON u.pk = c.pk)
SELECT ((pk % 8) + 8) % 8 AS bucket, count(*) FILTER (kind = 'missing') AS n_missing, count(*) FILTER (kind = 'dup') AS n_dup, count(*) FILTER (kind = 'inactive') AS n_inactive, count(*) FILTER (kind = 'orphan') AS n_orphan FROM j WHERE kind IS NOT NULL GROUP BY 1""")
def parity_buckets(spark: SparkSession, d: str) -> DataFrame:
    """On keys of one row each."""
    s, i = _stores(spark, d)
    return reconcile.parity_in_buckets(s, i, 8)


_MISSING = f"{DOCS}, m AS (SELECT DISTINCT chunk_id AS pk, doc_id, CASE WHEN part_id % 3 = 0 THEN 'invisible' WHEN part_id % 17 = 1 THEN 'unclassified' ELSE 'confirmed' END AS found FROM (SELECT DISTINCT ON (chunk_id) * FROM chunk ORDER BY chunk_id, part_id) WHERE is_active = 1 AND qty > 45)"


def _missing(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("chunk_id").orderBy("part_id")
    c = chunk(spark, d).withColumn("w", F.row_number().over(w)).where("w = 1 and is_active = 1 and qty > 45").select(F.col("chunk_id").alias("pk"), "doc_id", "part_id")
    return reconcile.reclassify_missing(c, c.where("part_id % 3 = 0"), c.where("part_id % 17 = 1"))


@query("missing_reclassified", f"WITH {_MISSING.replace('ORDER BY chunk_id, part_id', 'ORDER BY chunk_id, part_id')} SELECT found, count(*) AS n, count(DISTINCT doc_id) AS docs FROM m GROUP BY 1")
def missing_reclassified(spark: SparkSession, d: str) -> DataFrame:
    return _missing(spark, d).groupBy("found").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("vanished_verdicts", f"""WITH {_MISSING}, v AS (SELECT doc_id FROM meta WHERE doc_id % 6 = 0), p AS (SELECT doc_id, bool_and(found = 'invisible') AS there FROM m GROUP BY 1)
SELECT CASE WHEN there IS NULL THEN 'at_risk:no_indexed_coverage' WHEN there THEN 'artifact' ELSE 'at_risk:confirmed_or_unclassified' END AS verdict, count(*) AS n FROM v LEFT JOIN p USING (doc_id) GROUP BY 1""")
def vanished_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.vanished_verdicts(meta(spark, d).where("doc_id % 6 = 0"), _missing(spark, d)).groupBy("verdict").agg(F.count("*").alias("n"))


@query("raw_parity", f"""WITH {DOCS} SELECT CASE WHEN doc_id % 7 = 0 THEN 'no_key' ELSE 'missing' END AS state, count(*) AS n FROM meta WHERE doc_id % 7 = 0 OR owner_id NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0) GROUP BY 1""")
def raw_parity(spark: SparkSession, d: str) -> DataFrame:
    versions = meta(spark, d).select("doc_id", F.col("current_version_no").alias("version_no"), F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("raw/"), F.col("owner_id").cast("string"))).alias("raw_key"))
    present = read(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("raw/"), F.col("n_nationkey").cast("string")).alias("key"))
    return reconcile.raw_parity(versions, present).groupBy("state").agg(F.count("*").alias("n"))


@query("reconciled_ids", "SELECT 'lost' AS state, count(*) AS n FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')) UNION ALL SELECT 'unexpected', count(*) FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def reconciled_ids(spark: SparkSession, d: str) -> DataFrame:
    ids = chunking.reconcile_ids(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk_id")), read(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("chunk_id")))
    states = spark.createDataFrame([("lost",), ("unexpected",)], "state string")
    return states.join(ids.groupBy("state").agg(F.count("*").alias("n")), "state", "left").na.fill(0, ["n"])


@query("purge_order", f"WITH {LOG}, mine AS (SELECT * FROM qlog WHERE user_id IN (SELECT user_id FROM qlog WHERE k = 7)) SELECT 1 AS step, 'facts' AS what, count(*) AS n FROM qlog WHERE k % 2 = 0 AND message_id IN (SELECT message_id FROM mine) UNION ALL SELECT 2, 'log', count(*) FROM mine")
def purge_order(spark: SparkSession, d: str) -> DataFrame:
    log = qlog(spark, d)
    facts, mine = reconcile.purge_order(log.where("k % 2 = 0").select("message_id"), log, log.where("k = 7"))
    return facts.agg(F.count("*").alias("n")).select(F.lit(1).alias("step"), F.lit("facts").alias("what"), "n").union(mine.agg(F.count("*")).select(F.lit(2), F.lit("log"), "count(1)"))


@query("judge_panel", f"WITH {LOG} SELECT session_id, round(avg(k % 6), 6) AS mean, round(stddev_pop(k % 6), 6) AS spread, count(*) AS judges FROM qlog GROUP BY 1")
def judge_panel(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.panel(qlog(spark, d).withColumn("s", F.col("k") % 6), "session_id", "s")


@query("gold_ranks", f"WITH {_RANKED}, g AS (SELECT o_orderkey AS qid, o_custkey AS doc_id FROM orders), h AS (SELECT query_id AS qid, doc_id % 30 AS doc_id, rank FROM r), b AS (SELECT qid, min(rank) AS rank FROM h JOIN (SELECT qid, doc_id % 30 AS doc_id FROM g) USING (qid, doc_id) GROUP BY 1) SELECT g.qid, rank FROM (SELECT DISTINCT qid FROM g) g LEFT JOIN b USING (qid)")
def gold_ranks(spark: SparkSession, d: str) -> DataFrame:
    hits = _ranked(spark, d).select(F.col("query_id").alias("qid"), (F.col("doc_id") % 30).alias("doc_id"), "rank")
    return evaluation.gold_rank(hits, read(spark, d, "orders").select(F.col("o_orderkey").alias("qid"), (F.col("o_custkey") % 30).alias("doc_id"))).withColumn("rank", F.col("rank").cast("long"))


@query("pooled_rates", f"WITH {LOG} SELECT answer_status, round(sum(hits) / nullif(sum(k), 0), 6) AS rate FROM qlog GROUP BY 1")
def pooled_rates(spark: SparkSession, d: str) -> DataFrame:
    return qlog(spark, d).groupBy("answer_status").agg(evaluation.pooled_rate(F.col("hits"), F.col("k")).alias("rate"))


@query("strata_summary", """WITH q AS (SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 12 + 1 END AS rank, o_orderkey % 3 AS positives, o_orderkey % 10 = 0 AS gated, o_orderpriority AS module, o_orderstatus AS source, o_custkey % 3 AS difficulty FROM orders), k AS (SELECT * FROM q WHERE positives > 0 AND NOT gated),
s AS (SELECT 'target' AS stratum, CASE WHEN positives = 1 THEN 'single' ELSE 'multi' END AS value, rank FROM k UNION ALL SELECT 'module', module, rank FROM k UNION ALL SELECT 'source', source, rank FROM k UNION ALL SELECT 'difficulty', CAST(difficulty AS VARCHAR), rank FROM k)
SELECT stratum, value, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10,
 round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 / rank END), 6) AS mrr, round(avg(CASE WHEN rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS found_rate FROM s GROUP BY 1, 2""")
def strata_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(k.alias("qid"), F.when(k % 4 != 0, k % 12 + 1).alias("rank"), (k % 3).alias("positives"), (k % 10 == 0).alias("gated"), F.col("o_orderpriority").alias("module"), F.col("o_orderstatus").alias("source"), (F.col("o_custkey") % 3).alias("difficulty"))
    return evaluation.strata_summary(rows)


@query("run_metrics", f"WITH {DOCS} SELECT doc_id AS run_id, CAST(sum(CASE WHEN is_active = 1 THEN qty END) AS BIGINT) AS chunks_written, CAST(sum(CASE WHEN part_id % 50 = 0 THEN 1 END) AS BIGINT) AS docs_failed FROM chunk GROUP BY 1")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    batches = chunk(spark, d).select(F.col("doc_id").alias("run_id"), F.when(F.col("is_active") == 1, F.col("qty").cast("long")).alias("chunks_written"), F.when(F.col("part_id") % 50 == 0, F.lit(1).cast("long")).alias("docs_failed"))
    return audits.run_metrics(batches, ["chunks_written", "docs_failed"])


@query("run_failures", "SELECT o_orderkey AS run_id, o_custkey % 7 AS failed, o_custkey % 50 AS embedded, coalesce(round((o_custkey % 7) / nullif(o_custkey % 50 + o_custkey % 7, 0), 4), 0) AS failure_rate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 8")
def run_failures(spark: SparkSession, d: str) -> DataFrame:
    runs = read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), (F.col("o_custkey") % 7).alias("failed"), (F.col("o_custkey") % 50).alias("embedded"))
    return audits.run_failure_rate(runs).drop("started_at")


@query("stale_work", f"WITH {DOCS} SELECT doc_id FROM meta WHERE created_at < TIMESTAMP '1997-01-01 00:00:00' - INTERVAL 2 HOUR")
def stale_work(spark: SparkSession, d: str) -> DataFrame:
    return rollups.stale(meta(spark, d), "TIMESTAMP_NTZ '1997-01-01 00:00:00'", "created_at").select("doc_id")


@query("outbox_generations", "WITH o AS (SELECT l_orderkey AS doc_id, l_linenumber AS generation, l_suppkey % 5 AS attempts, l_partkey AS enqueued_at FROM lineitem WHERE l_returnflag <> 'R') SELECT doc_id, max(generation) AS generation, arg_max(attempts, struct_pack(g := generation, a := attempts)) AS attempts FROM o GROUP BY 1")
def outbox_generations(spark: SparkSession, d: str) -> DataFrame:
    box = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("generation"), (F.col("l_suppkey") % 5).alias("attempts"), F.col("l_partkey").alias("enqueued_at"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")).alias("done_at"))
    return rollups.latest_generation(box).select("doc_id", "generation", "attempts")


@query("reject_counts", "SELECT date_trunc('day', ts) AS start, event_type AS reason, count(*) AS n FROM events GROUP BY 1, 2")
def reject_counts(spark: SparkSession, d: str) -> DataFrame:
    return rollups.reject_counts(read(spark, d, "events").withColumnRenamed("event_type", "reason"))


@query("live_sessions", """WITH t AS (SELECT user_id % 40 AS session_id, user_id, ts FROM events), o AS (SELECT session_id, arg_min(user_id, struct_pack(ts := ts, u := user_id)) AS owner FROM t GROUP BY 1), l AS (SELECT session_id, owner, max(ts) AS last_at FROM t JOIN o USING (session_id) WHERE user_id = owner GROUP BY 1, 2)
SELECT * FROM l WHERE last_at >= (SELECT max(ts) FROM events) - INTERVAL 36 HOUR ORDER BY last_at DESC, session_id LIMIT 10""")
def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    now = e.agg(F.max("ts").cast("string").alias("m")).first()["m"]
    return rollups.latest_sessions(e.select((F.col("user_id") % 40).alias("session_id"), "user_id", "ts"), f"TIMESTAMP_NTZ '{now}'", "36 HOURS", 10)


@query("present_keys", "SELECT p_partkey, coalesce(p_size > 20, false) AS present FROM part")
def present_keys(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.present_by(read(spark, d, "part").select("p_partkey", "p_size"), F.col("p_size") > 20).select("p_partkey", "present")


@query("ledger_filters", f"""WITH {DOCS}, l AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'public' ELSE 'dept_internal' END AS p, CASE doc_id % 4 WHEN 0 THEN '处理失败' WHEN 1 THEN '已隔离' ELSE '已上线' END AS b FROM meta), f AS (SELECT doc_id FROM chunk WHERE part_id % 5 = 0)
SELECT 'all' AS what, count(*) AS n FROM l UNION ALL SELECT 'public_bad', count(*) FROM l WHERE p = 'public' AND b IN ('处理失败', '已隔离') UNION ALL SELECT 'live_used', count(*) FROM l WHERE b = '已上线' AND doc_id IN (SELECT doc_id FROM f) UNION ALL SELECT 'unused', count(*) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM f)""")
def ledger_filters(spark: SparkSession, d: str) -> DataFrame:
    from quarry.functions.status import ledger_filter

    i = F.col("doc_id")
    docs = meta(spark, d).select(i, F.when(i % 3 == 0, "public").otherwise("dept_internal").alias("permission_level"), F.when(i % 4 == 0, "处理失败").when(i % 4 == 1, "已隔离").otherwise("已上线").alias("badge"))
    facts = chunk(spark, d).select("doc_id", (F.col("part_id") % 5 == 0).cast("int").alias("cited"))
    asked = {"all": {}, "public_bad": {"permission": "public", "badge": "bad"}, "live_used": {"badge": "已上线", "cited": "used"}, "unused": {"cited": "unused"}}
    out = None
    for name, criteria in asked.items():
        one = ledger_filter(docs, facts, **criteria).agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.union(one)
    return out
