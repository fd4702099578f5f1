"""The question log, versions and chunks as views over the star-schema tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import read

#: The question log over ``events``.
LOG = """log AS (SELECT event_id AS message_id, ts AS created_at, user_id, user_id * 1000 + day(ts) AS session_id,
 CASE event_type WHEN 'purchase' THEN 'SUCCESS' WHEN 'click' THEN 'SUCCESS' WHEN 'view' THEN 'NO_RESULT' WHEN 'signup' THEN 'REFUSAL' ELSE 'ERROR' END AS answer_status,
 value AS latency_ms, value / 10 AS top_score, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
qlog AS (SELECT *, k % 7 AS hits, k = 13 AS blocked, 'q ' || k || ' ' || answer_status AS query_text FROM log)"""


def qlog(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind.isin("purchase", "click"), "SUCCESS").when(kind == "view", "NO_RESULT").when(kind == "signup", "REFUSAL").otherwise("ERROR")
    rows = read(spark, folder, "events").select(
        F.col("event_id").alias("message_id"), F.col("ts").alias("created_at"), "user_id", (F.col("user_id") * 1000 + F.dayofmonth("ts")).alias("session_id"), status.alias("answer_status"),
        F.col("value").alias("latency_ms"), (F.col("value") / 10).alias("top_score"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    return rows.withColumns({"hits": F.col("k") % 7, "blocked": F.col("k") == 13, "query_text": F.concat_ws(" ", F.lit("q"), "k", "answer_status")})


#: Documents and their versions over ``orders`` and ``lineitem``: an order is a document, its lines are chunks.
DOCS = """meta AS (SELECT o_orderkey AS doc_id, o_custkey % 25 AS owner_id, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'ACTIVE' ELSE 'retired' END AS status, o_orderkey % 3 + 1 AS current_version_no,
 o_orderpriority AS priority, o_totalprice AS price, o_orderdate AS created_at FROM orders),
chunk AS (SELECT l_orderkey AS doc_id, l_linenumber AS chunk_index, l_linenumber % 3 + 1 AS version_no, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS is_active,
 CASE l_linestatus WHEN 'F' THEN 'INDEXED' ELSE 'NOT_INDEXED' END AS index_status, l_partkey AS part_id, l_suppkey AS owner, l_quantity AS qty, l_orderkey * 10 + l_linenumber AS chunk_id FROM lineitem)"""


def meta(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("o_orderstatus")
    return read(spark, folder, "orders").select(
        F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") % 25).alias("owner_id"), F.when(s == "F", "active").when(s == "O", "ACTIVE").otherwise("retired").alias("status"),
        (F.col("o_orderkey") % 3 + 1).alias("current_version_no"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("created_at"),
    )


def chunk(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_linenumber") % 3 + 1).alias("version_no"), F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("is_active"),
        F.when(F.col("l_linestatus") == "F", "INDEXED").otherwise("NOT_INDEXED").alias("index_status"), F.col("l_partkey").alias("part_id"), F.col("l_suppkey").alias("owner"), F.col("l_quantity").alias("qty"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"),
    )
