"""Queries along time, over ranges of keys, by sketches and vectors, with subtotals and table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import reconcile, retrieval, sketches, temporal, vectors
from quarry.plans.registry import query
from quarry.plans.views import LOG, qlog
from quarry.sources.tables import read

#: One sale per client and time: of several the one of the greatest id.
_SALES = "s AS (SELECT client_id, sold_at, max(sale_id) AS sale_id FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL AND sale_id IS NOT NULL GROUP BY 1, 2)"


def _sales(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "sales").select("client_id", "sold_at", "sale_id").where("sale_id IS NOT NULL")


@query("asof_sale_before", f"WITH {_SALES} SELECT c.click_id, c.client_id, c.ts, s.sale_id, s.sold_at FROM clicks c ASOF LEFT JOIN s ON c.client_id = s.client_id AND c.ts >= s.sold_at")
def asof_sale_before(spark: SparkSession, d: str) -> DataFrame:
    """Every click with its client's last sale so far."""
    clicks = read(spark, d, "clicks").select("click_id", "client_id", "ts")
    out = temporal.as_of_join(clicks, _sales(spark, d), "client_id", "ts", "sold_at", tie=["sale_id"])
    return out.select("click_id", "client_id", "ts", "match.sale_id", "match.sold_at")


@query("asof_sale_after", f"WITH {_SALES}, j AS (SELECT c.click_id, c.client_id, c.ts, s.sale_id, s.sold_at FROM clicks c ASOF LEFT JOIN s ON c.client_id = s.client_id AND c.ts <= s.sold_at) SELECT click_id, client_id, ts, CASE WHEN sold_at <= ts + INTERVAL 7 DAY THEN sale_id END AS sale_id FROM j")
def asof_sale_after(spark: SparkSession, d: str) -> DataFrame:
    """Every click with its client's next sale, if that comes within a week."""
    clicks = read(spark, d, "clicks").select("click_id", "client_id", "ts")
    out = temporal.as_of_join(clicks, _sales(spark, d), "client_id", "ts", "sold_at", forward=True, within="7 days", tie=["sale_id"])
    return out.select("click_id", "client_id", "ts", "match.sale_id")


@query("asof_last_error", "WITH e AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1, 2) SELECT p.event_id, e.event_id AS error_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN e ON p.user_id = e.user_id AND p.ts >= e.ts")
def asof_last_error(spark: SparkSession, d: str) -> DataFrame:
    """Every purchase with the user's last error before it."""
    e = read(spark, d, "events")
    out = temporal.as_of_join(e.where("event_type = 'purchase'"), e.where("event_type = 'error'").select("event_id", "user_id", "ts"), "user_id", "ts", "ts", tie=["event_id"])
    return out.select("event_id", F.col("match.event_id").alias("error_id"))


@query("interval_sales", "SELECT c.click_id, s.sale_id, count(*) AS n FROM clicks c JOIN sales s ON s.client_id = c.client_id AND s.sold_at BETWEEN c.ts - INTERVAL 30 MINUTE AND c.ts + INTERVAL 2 HOUR WHERE c.kind = 'purchase' GROUP BY 1, 2")
def interval_sales(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with the client's sales from half an hour before to two hours after."""
    bought = read(spark, d, "clicks").where("kind = 'purchase'")
    pairs = temporal.interval_join(bought, read(spark, d, "sales"), "client_id", "ts", "sold_at", "30 minutes", "2 hours", bucket_hours=12)
    return pairs.groupBy("l.click_id", "r.sale_id").agg(F.count("*").alias("n"))


@query("events_last_hour", "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS spent, max(value) OVER w AS most FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW)")
def events_last_hour(spark: SparkSession, d: str) -> DataFrame:
    """Each event with what its user did in the hour up to it."""
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "value")
    out = temporal.in_the_last(e, "user_id", "ts", "1 hour", {"n": "count(*)", "spent": "sum(value)", "most": "max(value)"})
    return out.select("event_id", "n", F.round("spent", 4).alias("spent"), "most")


@query("price_bands", "SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS quarter, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS size_rank, round(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING), 2) AS like_sized FROM part")
def price_bands(spark: SparkSession, d: str) -> DataFrame:
    """Parts by quarter of their brand's prices, rank of size, and the summed price of about the same size."""
    brand = Window.partitionBy("p_brand")
    near = brand.orderBy("p_size").rangeBetween(-3, 3)
    return read(spark, d, "part").select("p_partkey", F.ntile(4).over(brand.orderBy("p_retailprice", "p_partkey")).cast("long").alias("quarter"), F.dense_rank().over(brand.orderBy("p_size")).cast("long").alias("size_rank"), F.round(F.sum("p_retailprice").over(near), 2).alias("like_sized"))


_KINDS = f"WITH {LOG} SELECT CAST(created_at AS DATE) AS day, answer_status, k % 3 AS kind, "


@query("reject_sets", f"{_KINDS} count(*) AS n, grouping_id(CAST(created_at AS DATE), answer_status, k % 3) AS level FROM qlog WHERE answer_status NOT IN ('SUCCESS') GROUP BY GROUPING SETS ((CAST(created_at AS DATE), answer_status, k % 3), (CAST(created_at AS DATE), answer_status), (CAST(created_at AS DATE)), (answer_status), ())")
def reject_sets(spark: SparkSession, d: str) -> DataFrame:
    """Rejects by day, reason and kind of asker, with subtotals by day and reason, by day, by reason, and the total."""
    rows = qlog(spark, d).where("answer_status <> 'SUCCESS'").select(F.to_date("created_at").alias("day"), "answer_status", (F.col("k") % 3).alias("kind"))
    day, status, kind = F.col("day"), F.col("answer_status"), F.col("kind")
    sets = rows.groupingSets([[day, status, kind], [day, status], [day], [status], []], day, status, kind)
    return sets.agg(F.count("*").alias("n"), F.grouping_id().alias("level")).select("day", "answer_status", "kind", "n", "level")


@query("order_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping_id(o_orderstatus, o_orderpriority) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def order_cube(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("level"))


@query("sales_rollup", "SELECT n_regionkey, n_name, c_mktsegment, count(*) AS n, grouping_id(n_regionkey, n_name, c_mktsegment) AS level FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, n_name, c_mktsegment)")
def sales_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Customers by region, nation and segment, rolled up."""
    rows = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.rollup("n_regionkey", "n_name", "c_mktsegment").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


_HALF = "SELECT l_partkey % 50 AS part, l_linenumber AS line, l_returnflag AS flag FROM lineitem WHERE l_orderkey % 2 = "


@query("intersect_all", f"SELECT part, line, flag, count(*) AS n FROM (({_HALF}0) INTERSECT ALL ({_HALF}1)) t GROUP BY 1, 2, 3")
def intersect_all(spark: SparkSession, d: str) -> DataFrame:
    """What both halves of the lines have, as often as both have it."""
    even, odd = _halves(spark, d)
    return even.intersectAll(odd).groupBy("part", "line", "flag").agg(F.count("*").alias("n"))


@query("except_all", f"SELECT part, line, flag, count(*) AS n FROM (({_HALF}0) EXCEPT ALL ({_HALF}1)) t GROUP BY 1, 2, 3")
def except_all(spark: SparkSession, d: str) -> DataFrame:
    """What the even half has beyond the odd one, as often as it has it more."""
    even, odd = _halves(spark, d)
    return even.exceptAll(odd).groupBy("part", "line", "flag").agg(F.count("*").alias("n"))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, d, "lineitem")
    part = [(F.col("l_partkey") % 50).alias("part"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag")]
    return rows.where("l_orderkey % 2 = 0").select(*part), rows.where("l_orderkey % 2 = 1").select(*part)


#: A copy of the lines with some lost, some changed and some new.
_COPY = """c AS (SELECT l_orderkey AS k, l_linenumber AS line, CASE WHEN l_orderkey = 1 + (SELECT max(l_orderkey) // 3 FROM lineitem) THEN l_quantity + 1 ELSE l_quantity END AS qty FROM lineitem
 WHERE l_orderkey NOT BETWEEN (SELECT max(l_orderkey) // 2 FROM lineitem) AND (SELECT max(l_orderkey) // 2 + 3 FROM lineitem) UNION ALL SELECT max(l_orderkey) + 5, 1, 1.0 FROM lineitem)"""


def _copies(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("qty"))
    most = lines.agg(F.max("k")).first()[0]
    new = spark.range(1).select(F.lit(most + 5).alias("k"), F.lit(1).alias("line"), F.lit(1.0).alias("qty"))
    changed = lines.where(~F.col("k").between(most // 2, most // 2 + 3)).withColumn("qty", F.when(F.col("k") == most // 3 + 1, F.col("qty") + 1).otherwise(F.col("qty")))
    return lines, changed.unionByName(new)


@query("range_differences", f"WITH {_COPY}, a AS (SELECT l_orderkey AS k, list_sort(list(struct_pack(line := l_linenumber, qty := l_quantity))) AS r FROM lineitem GROUP BY 1), b AS (SELECT k, list_sort(list(struct_pack(line := line, qty := qty))) AS r FROM c GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'changed' END AS kind FROM a FULL JOIN b ON a.k = b.k WHERE a.r IS DISTINCT FROM b.r")
def range_differences(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose lines differ between the table and its copy, by digests of ranges of 64 orders."""
    return reconcile.reconcile_by_ranges(*_copies(spark, d), "k", ["line", "qty"], 64)[0]


@query("range_verdict", "SELECT 'incomplete' AS verdict, true AS few_joined")
def range_verdict(spark: SparkSession, d: str) -> DataFrame:
    """The verdict when one range couldn't be read, and whether at most four ranges were joined."""
    a, b = _copies(spark, d)
    totals = reconcile.reconcile_by_ranges(a, b, "k", ["line", "qty"], 64, unread=spark.range(1).select(F.lit(0).cast("long").alias("leaf")))[1]
    return totals.select("verdict", (F.col("joined") <= 4).alias("few_joined"))


@query("weekly_sketches", "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(value) AS n, count(DISTINCT user_id) AS users, true AS users_ok, true AS quantile_ok FROM events GROUP BY 1")
def weekly_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Users and the 95th percentile of a week from sketches kept by day, and whether both lie within their errors."""
    e = read(spark, d, "events").select(F.to_date("ts").alias("day"), F.to_date(F.date_trunc("week", F.col("ts"))).alias("week"), "user_id", "value")
    kept = sketches.daily_sketches(e, ["week", "day"], F.col("user_id"), F.col("value"))
    found = sketches.merged(kept, ["week"], {"p95": 0.95})
    return sketches.checked(found, e, ["week"], F.col("user_id"), F.col("value"), "p95", 0.95)


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    pivots = vectors.centres(e, 32)
    near, exact = vectors.search_lists_in_blocks(e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), vectors.build_lists(e, pivots), pivots, 10, probes=26)
    return e, near, exact


_COSINE = "SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_inner_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0"


@query("ivf_exact", f"WITH s AS ({_COSINE}) SELECT query_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) WHERE rank <= 10")
def ivf_exact(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every hundredth vector by an inverted file, lists probed until none can hold a nearer one."""
    return _index(spark, d)[2].select("query_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("ivf_recall", "SELECT count(*) FILTER (vec_id % 100 = 0) AS queries, true AS recalled FROM embeddings")
def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether 26 of 32 lists give at least nine tenths of what exact search over all vectors gives; the tables' vectors are random directions, of which no fewer lists hold that share."""
    e, near, _ = _index(spark, d)
    asked = e.where("id % 100 = 0")
    exact = retrieval.dense_top_k_in_blocks(asked.select(F.col("id").alias("query_id"), vectors.unit(F.col("vector")).alias("embedding")), e.select(F.col("id").alias("vec_id"), vectors.unit(F.col("vector")).alias("embedding")), 10)
    met = exact.join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return met.agg(F.count_distinct("query_id").alias("queries"), (F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("recalled"))


@query("word_windows", r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), x -> x <> '') AS w FROM documents) SELECT doc_id, CAST(s AS INT) AS start, CAST(least(200, len(w) - s) AS INT) AS n_words FROM w, LATERAL (SELECT unnest(range(0, len(w), 200)) AS s)".replace("x -> x", "lambda x: x"))
def word_windows(spark: SparkSession, d: str) -> DataFrame:
    """All documents in windows of 200 words, by a table function called from SQL."""
    from quarry.functions import tables

    tables.register(spark)
    return spark.sql("SELECT d.doc_id, w.start, w.n_words FROM {docs} d, LATERAL word_windows(d.text, 200) w", docs=read(spark, d, "documents").select("doc_id", "text"))


@query("click_sessions", """WITH c AS (SELECT client_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM clicks WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY client_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS session FROM c) SELECT client_id AS key, CAST(session AS BIGINT) AS session, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n FROM s GROUP BY 1, 2""")
def click_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of clients, cut where half an hour passes, by a table function partitioned and ordered by its own rules."""
    from quarry.functions import tables

    tables.register(spark)
    return spark.sql("SELECT * FROM sessions(TABLE({clicks}), 1800)", clicks=read(spark, d, "clicks").select(F.col("client_id").alias("key"), F.col("ts").alias("at")))
