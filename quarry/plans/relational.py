"""Filters, joins, aggregates and windows over the question log and the document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import acl, status
from quarry.operators import metrics, percentiles
from quarry.plans.registry import query
from quarry.plans.views import DOCS, LOG, chunk, meta, qlog
from quarry.sources.tables import read

def _day() -> Column:
    return F.to_date("created_at")


_CLASS = """CASE WHEN blocked OR answer_status = 'REFUSAL' THEN 'refusal' WHEN answer_status = 'SUCCESS' THEN 'success' WHEN answer_status = 'NO_RESULT' OR (hits = 0 AND answer_status NOT LIKE '%ERROR%') THEN 'no_result' WHEN answer_status LIKE '%ERROR%' THEN 'error' END"""
_P = "CASE WHEN len({v}) = 0 THEN NULL ELSE {v}[CAST(round_even({q} * (len({v}) - 1), 0) AS INT) + 1] END"
DAILY = f"""{LOG}, cls AS (SELECT *, CAST(created_at AS DATE) AS day, {_CLASS} AS kind FROM qlog),
daily AS (SELECT day, count(*) AS total_queries, count(*) FILTER (kind = 'success') AS success_count, count(*) FILTER (kind = 'refusal') AS refusal_count, count(*) FILTER (kind = 'no_result') AS no_result_count,
 count(*) FILTER (kind = 'error') AS error_count, count(*) FILTER (blocked) AS risk_blocked_count, list_sort(list(latency_ms) FILTER (latency_ms > 0)) AS lat, round(avg(top_score), 4) AS avg_top_score,
 count(DISTINCT user_id) AS distinct_users, count(DISTINCT session_id) AS distinct_sessions FROM cls GROUP BY day),
metric AS (SELECT day, total_queries, success_count, refusal_count, no_result_count, error_count, risk_blocked_count, avg_top_score, distinct_users, distinct_sessions, round(success_count / total_queries, 4) AS answer_rate,
 round(no_result_count / total_queries, 4) AS no_result_rate, round(error_count / total_queries, 4) AS error_rate, CAST(floor({_P.format(v='lat', q=0.5)}) AS BIGINT) AS p50_latency_ms, CAST(floor({_P.format(v='lat', q=0.95)}) AS BIGINT) AS p95_latency_ms FROM daily)"""


@query("daily_metrics", f"WITH {DAILY} SELECT * FROM metric")
def daily_metrics(spark: SparkSession, d: str) -> DataFrame:
    return metrics.daily_metrics(qlog(spark, d), _day())


_BASE = f"""{DAILY}, shifted AS (SELECT day + CAST(w * 7 AS INT) AS day, total_queries AS n FROM metric, (VALUES (1), (2), (3), (4)) AS t(w)),
base AS (SELECT day, list_sort(list(n))[CAST(len(list(n)) // 2 AS INT) + 1] AS baseline FROM shifted GROUP BY day)"""


@query("weekday_baseline", f"WITH {_BASE} SELECT m.day, total_queries, baseline FROM metric m LEFT JOIN base USING (day)")
def weekday_baseline(spark: SparkSession, d: str) -> DataFrame:
    return metrics.weekday_baseline(daily_metrics(spark, d)).select("day", "total_queries", "baseline")


_SLO = f"""{_BASE}, j AS (SELECT m.*, baseline FROM metric m LEFT JOIN base USING (day)), hit AS (SELECT *, list_filter([CASE WHEN baseline >= 10 AND total_queries < 0.3 * baseline THEN 'traffic_collapse' END, CASE WHEN answer_rate < 0.75 AND (total_queries >= 20 OR (answer_rate = 0 AND total_queries >= 3)) THEN 'answer_rate_min' END,
 CASE WHEN no_result_rate > 0.15 AND (total_queries >= 20 OR (no_result_rate = 1 AND total_queries >= 3)) THEN 'no_result_rate_max' END, CASE WHEN error_rate > 0.05 AND (total_queries >= 20 OR (error_rate = 1 AND total_queries >= 3)) THEN 'error_rate_max' END, CASE WHEN p95_latency_ms > 25000 AND total_queries >= 20 THEN 'p95_latency_ms_max' END], lambda x: x IS NOT NULL) AS b FROM j)"""


@query("slo_breaches", f"WITH {_SLO} SELECT day, coalesce(array_to_string(list_sort(b), ','), '') AS breaches, CASE WHEN len(b) = 0 THEN 1 ELSE 0 END AS slo_ok FROM hit")
def slo_breaches(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.evaluate_objectives(metrics.weekday_baseline(daily_metrics(spark, d)))
    return out.select("day", F.array_join("breaches", ",").alias("breaches"), "slo_ok")


@query("weekly_report", f"""WITH {_SLO}, s AS (SELECT *, CASE WHEN len(b) = 0 THEN 1 ELSE 0 END AS slo_ok FROM hit), w AS (SELECT CAST(date_trunc('week', day) AS DATE) AS week, CAST(sum(total_queries) AS BIGINT) AS total_queries, CAST(sum(success_count) AS BIGINT) AS success_count, CAST(sum(no_result_count) AS BIGINT) AS no_result_count,
 round(avg(p95_latency_ms), 2) AS p95_mean, max(p95_latency_ms) AS p95_max, count(*) FILTER (slo_ok = 0) AS breach_days, round(sum(success_count) / sum(total_queries), 4) AS answer_rate FROM s GROUP BY 1)
SELECT *, total_queries - lag(total_queries) OVER (ORDER BY week) AS total_delta, round(answer_rate - lag(answer_rate) OVER (ORDER BY week), 4) AS answer_rate_delta FROM w""")
def weekly_report(spark: SparkSession, d: str) -> DataFrame:
    return metrics.weekly(metrics.evaluate_objectives(metrics.weekday_baseline(daily_metrics(spark, d))))


@query("beijing_day_counts", f"WITH {LOG} SELECT CAST(timezone('Asia/Shanghai', timezone('America/Los_Angeles', created_at)) AS DATE) AS day, count(*) AS n FROM qlog GROUP BY 1")
def beijing_day_counts(spark: SparkSession, d: str) -> DataFrame:
    return qlog(spark, d).groupBy(status.service_day(F.col("created_at")).alias("day")).agg(F.count("*").alias("n"))


@query("percentile_three_variants", f"""WITH {LOG}, v AS (SELECT answer_status, list_sort(list(latency_ms)) AS s FROM qlog GROUP BY 1), r AS (SELECT answer_status, latency_ms, percent_rank() OVER (PARTITION BY answer_status ORDER BY latency_ms) AS r FROM qlog),
c AS (SELECT answer_status, max(latency_ms) FILTER (r <= 0.95) AS p95_rank FROM r GROUP BY 1)
SELECT v.answer_status, s[CAST(round_even(0.95 * (len(s) - 1), 0) AS INT) + 1] AS p95_even, s[CAST(ceil(round(0.95 * len(s), 9)) AS INT)] AS p95_ceil, p95_rank, s[CAST(len(s) // 2 AS INT) + 1] AS upper_median FROM v JOIN c USING (answer_status)""")
def percentile_three_variants(spark: SparkSession, d: str) -> DataFrame:
    log, x = qlog(spark, d), F.col("latency_ms")
    a = percentiles.ranked_values(log, ["answer_status"], "latency_ms", {"p95_even": percentiles.place_even(0.95), "p95_ceil": percentiles.place_ceil(0.95), "upper_median": percentiles.place_upper_median()})
    return a.join(percentiles.percent_rank_value(log, ["answer_status"], "latency_ms", 0.95, "p95_rank"), "answer_status")


@query("insights_distinct", f"""WITH {LOG} SELECT CAST(created_at AS DATE) AS day, count(DISTINCT query_text) AS questions, count(DISTINCT user_id) AS askers, count(DISTINCT CASE WHEN answer_status = 'REFUSAL' THEN message_id END) AS refused,
 count(DISTINCT CASE WHEN answer_status = 'SUCCESS' THEN user_id END) AS served, CAST(sum(CASE WHEN top_score >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS confident FROM qlog GROUP BY 1""")
def insights_distinct(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("answer_status")
    return qlog(spark, d).groupBy(_day().alias("day")).agg(
        F.count_distinct("query_text").alias("questions"), F.count_distinct("user_id").alias("askers"), F.count_distinct(F.when(s == "REFUSAL", F.col("message_id"))).alias("refused"),
        F.count_distinct(F.when(s == "SUCCESS", F.col("user_id"))).alias("served"), F.count_if(F.col("top_score") >= 5).alias("confident"),
    )


@query("call_totals", f"WITH {LOG} SELECT count(*) AS calls, coalesce(CAST(sum(k) AS BIGINT), 0) AS tokens, round(avg(latency_ms), 4) AS mean_latency, max(latency_ms) AS max_latency FROM qlog")
def call_totals(spark: SparkSession, d: str) -> DataFrame:
    return qlog(spark, d).agg(F.count("*").alias("calls"), F.coalesce(F.sum("k"), F.lit(0)).alias("tokens"), F.round(F.avg("latency_ms"), 4).alias("mean_latency"), F.max("latency_ms").alias("max_latency"))


@query("top_docs", f"WITH {LOG} SELECT k, count(DISTINCT message_id) AS hits FROM qlog WHERE answer_status = 'SUCCESS' GROUP BY k ORDER BY hits DESC, k LIMIT 10")
def top_docs(spark: SparkSession, d: str) -> DataFrame:
    return qlog(spark, d).where("answer_status = 'SUCCESS'").groupBy("k").agg(F.count_distinct("message_id").alias("hits")).orderBy(F.desc("hits"), "k").limit(10)


@query("gap_queries", f"WITH {LOG} SELECT query_text, count(*) AS asks, CAST(sum(CAST(round(top_score * 1000) AS BIGINT)) AS BIGINT) / count(*) AS mean_score_milli FROM (SELECT DISTINCT message_id, query_text, top_score FROM qlog WHERE answer_status <> 'SUCCESS') GROUP BY 1")
def gap_queries(spark: SparkSession, d: str) -> DataFrame:
    return qlog(spark, d).where("answer_status <> 'SUCCESS'").select("message_id", "query_text", "top_score").distinct().groupBy("query_text").agg(F.count("*").alias("asks"), (F.sum(F.round(F.col("top_score") * 1000).cast("long")) / F.count("*")).alias("mean_score_milli"))


@query("hot_questions", f"WITH {LOG} SELECT query_text, count(*) AS cnt FROM qlog WHERE length(query_text) BETWEEN 4 AND 30 AND query_text NOT LIKE 'q 1%' GROUP BY 1 HAVING count(*) >= 2 ORDER BY cnt DESC, query_text LIMIT 20")
def hot_questions(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query_text")
    return qlog(spark, d).where(F.char_length(q).between(4, 30) & ~q.startswith("q 1")).groupBy("query_text").agg(F.count("*").alias("cnt")).where("cnt >= 2").orderBy(F.desc("cnt"), "query_text").limit(20)


@query("json_lateral_attribution", f"""WITH {LOG}, docs AS (SELECT message_id, answer_status, unnest([k, k + 1]) AS doc_id FROM qlog WHERE k % 5 <> 0)
SELECT doc_id % 7 AS owner, count(DISTINCT message_id) AS messages, count(DISTINCT CASE WHEN answer_status = 'REFUSAL' THEN message_id END) AS refused FROM docs GROUP BY 1""")
def json_lateral_attribution(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    listed = F.when(k % 5 != 0, F.to_json(F.array(F.struct(k.alias("doc_id")), F.struct((k + 1).alias("doc_id")))))
    log = qlog(spark, d).withColumn("retrieved_docs_json", listed)
    docs = log.select("message_id", "answer_status", F.explode(F.from_json("retrieved_docs_json", "array<struct<doc_id: bigint>>")).alias("x"))
    return docs.groupBy((F.col("x.doc_id") % 7).alias("owner")).agg(F.count_distinct("message_id").alias("messages"), F.count_distinct(F.when(F.col("answer_status") == "REFUSAL", F.col("message_id"))).alias("refused"))


@query("badge_counts", f"""WITH {DOCS}, v AS (SELECT doc_id, doc_id % 17 AS r, doc_id % 11 AS s, status FROM meta), c AS (SELECT CASE WHEN lower(status) NOT IN ('active', '') THEN '已退役' WHEN r = 1 OR s = 3 THEN '已隔离' WHEN r = 2 OR r = 3 THEN '未入索引' WHEN r = 4 THEN '未入索引' WHEN r = 5 THEN '内容不符' WHEN s = 4 THEN '历史版本' WHEN r = 6 OR r = 7 THEN '已上线'
 WHEN r = 8 OR r = 9 THEN '处理失败' WHEN r = 10 THEN '已驳回' WHEN r = 11 THEN '内容未变' WHEN r = 12 THEN '待审核' WHEN r = 13 OR r = 14 THEN '排队中' ELSE '处理中' END AS badge FROM v) SELECT badge, count(*) AS n FROM c GROUP BY 1""")
def badge_counts(spark: SparkSession, d: str) -> DataFrame:
    r, s = F.col("doc_id") % 17, F.col("doc_id") % 11
    at = lambda *pairs: F.coalesce(*[F.when(r == k, F.lit(v)) for k, v in pairs])
    content = F.when(r.isin(13), F.lit(None).cast("string")).otherwise(F.coalesce(at((5, "CONTENT_MISMATCH"), (8, "failed"), (10, "REJECTED"), (11, "SKIPPED_DUPLICATE"), (12, "PENDING_APPROVAL"), (14, "not_started")), F.lit("RUNNING")))
    badge = status.status_badge(
        F.col("status"), F.when(s == 4, "Superseded"), at((1, "quarantined"), (3, "skipped_empty")), F.when(s == 3, "Quarantined"), at((2, "EMPTY"), (4, "needs_review")), content,
        at((6, "indexed"), (7, "SUCCESS"), (9, "Failed")),
    )
    return meta(spark, d).groupBy(badge.alias("badge")).agg(F.count("*").alias("n"))


@query("first_event_user", f"WITH {LOG} SELECT k, arg_min(user_id, struct_pack(t := created_at, i := message_id)) AS first_user, arg_max(user_id, struct_pack(t := created_at, i := message_id)) AS last_user FROM qlog WHERE answer_status = 'ERROR' GROUP BY k")
def first_event_user(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("created_at", "message_id")
    return qlog(spark, d).where("answer_status = 'ERROR'").groupBy("k").agg(F.min_by("user_id", order).alias("first_user"), F.max_by("user_id", order).alias("last_user"))


@query("semi_exists", f"WITH {DOCS} SELECT doc_id, priority FROM meta m WHERE EXISTS (SELECT 1 FROM chunk c WHERE c.doc_id = m.doc_id AND c.index_status = 'NOT_INDEXED' AND c.qty > 45)")
def semi_exists(spark: SparkSession, d: str) -> DataFrame:
    return meta(spark, d).join(chunk(spark, d).where("index_status = 'NOT_INDEXED' AND qty > 45"), "doc_id", "left_semi").select("doc_id", "priority")


@query("anti_not_exists", f"WITH {DOCS} SELECT doc_id, priority FROM meta m WHERE NOT EXISTS (SELECT 1 FROM chunk c WHERE c.doc_id = m.doc_id AND c.index_status <> 'INDEXED')")
def anti_not_exists(spark: SparkSession, d: str) -> DataFrame:
    return meta(spark, d).join(chunk(spark, d).where("index_status <> 'INDEXED'"), "doc_id", "left_anti").select("doc_id", "priority")


@query("current_version_chunks", f"WITH {DOCS} SELECT m.doc_id, count(*) AS n FROM meta m JOIN chunk c ON c.doc_id = m.doc_id AND c.version_no = m.current_version_no GROUP BY 1")
def current_version_chunks(spark: SparkSession, d: str) -> DataFrame:
    m = meta(spark, d).select("doc_id", F.col("current_version_no").alias("version_no"))
    return m.join(chunk(spark, d), ["doc_id", "version_no"]).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("left_mismatch", f"WITH {DOCS} SELECT c.chunk_id FROM chunk c LEFT JOIN meta m ON m.doc_id = c.doc_id AND m.status <> 'retired' WHERE m.doc_id IS NULL OR c.version_no <> m.current_version_no")
def left_mismatch(spark: SparkSession, d: str) -> DataFrame:
    m = meta(spark, d).where("status <> 'retired'").select("doc_id", "current_version_no", F.lit(True).alias("known"))
    return chunk(spark, d).join(m, "doc_id", "left").where("known IS NULL OR version_no <> current_version_no").select("chunk_id")


@query("theta_residual", f"WITH {DOCS}, v AS (SELECT DISTINCT doc_id, version_no FROM chunk) SELECT a.doc_id, a.version_no AS newer, count(*) AS older FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.version_no < a.version_no GROUP BY 1, 2")
def theta_residual(spark: SparkSession, d: str) -> DataFrame:
    v = chunk(spark, d).select("doc_id", "version_no").distinct()
    o = v.select(F.col("doc_id").alias("d"), F.col("version_no").alias("o"))
    return v.join(o, (F.col("doc_id") == F.col("d")) & (F.col("o") < F.col("version_no"))).groupBy("doc_id", F.col("version_no").alias("newer")).agg(F.count("*").alias("older"))


@query("multi_left_fanout", f"""WITH {LOG} SELECT answer_status, count(*) AS n, count(f.message_id) AS with_feedback, count(e.message_id) AS with_ticket FROM qlog l LEFT JOIN (SELECT message_id - message_id % 3 AS message_id FROM qlog WHERE k < 40) f USING (message_id)
 LEFT JOIN (SELECT message_id - message_id % 2 AS message_id FROM qlog WHERE k > 80) e USING (message_id) GROUP BY 1""")
def multi_left_fanout(spark: SparkSession, d: str) -> DataFrame:
    log, m = qlog(spark, d), F.col("message_id")
    f = log.where("k < 40").select((m - m % 3).alias("message_id"), F.lit(1).alias("f"))
    e = log.where("k > 80").select((m - m % 2).alias("message_id"), F.lit(1).alias("e"))
    return log.join(f, "message_id", "left").join(e, "message_id", "left").groupBy("answer_status").agg(F.count("*").alias("n"), F.count("f").alias("with_feedback"), F.count("e").alias("with_ticket"))


@query("collated_join", "SELECT n_name, count(*) AS n FROM nation JOIN customer ON lower(n_name) = lower(upper('nation_' || c_nationkey)) GROUP BY 1")
def collated_join(spark: SparkSession, d: str) -> DataFrame:
    """Names that differ in case are equal under the collation."""
    c = read(spark, d, "customer").select(F.collate(F.upper(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string"))), "UNICODE_CI").alias("name"))
    n = read(spark, d, "nation").select("n_name", F.collate("n_name", "UNICODE_CI").alias("name"))
    return n.join(c, "name").groupBy("n_name").agg(F.count("*").alias("n"))


@query("names_or_ids", "SELECT s_suppkey, coalesce(n_name, 'id:' || s_nationkey) AS dept FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 12) ON n_nationkey = s_nationkey")
def names_or_ids(spark: SparkSession, d: str) -> DataFrame:
    n = read(spark, d, "nation").where("n_nationkey < 12")
    return read(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.concat(F.lit("id:"), F.col("s_nationkey").cast("string"))).alias("dept"))


@query("reason_split_counts", f"""WITH {LOG}, r AS (SELECT unnest(string_split(CASE WHEN k % 4 = 0 THEN '' ELSE 'r' || (k % 4) || ', r' || (k % 3) END, ',')) AS code FROM qlog), t AS (SELECT CASE WHEN trim(code) = '' THEN '__none__' ELSE trim(code) END AS reason FROM r)
SELECT reason, count(*) AS n FROM t GROUP BY 1""")
def reason_split_counts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    codes = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("r"), (k % 4).cast("string"), F.lit(", r"), (k % 3).cast("string")))
    each = qlog(spark, d).select(F.explode(F.split(codes, ",")).alias("code"))
    return each.groupBy(F.when(F.trim("code") == "", "__none__").otherwise(F.trim("code")).alias("reason")).agg(F.count("*").alias("n"))


@query("ledger_page", f"WITH {DOCS} SELECT doc_id, price FROM meta WHERE contains(priority, 'HIGH') ORDER BY price DESC, doc_id LIMIT 20 OFFSET 40")
def ledger_page(spark: SparkSession, d: str) -> DataFrame:
    return meta(spark, d).where(F.contains("priority", F.lit("HIGH"))).orderBy(F.desc("price"), "doc_id").offset(40).limit(20).select("doc_id", "price")


@query("like_escaped", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%red!%' ESCAPE '!' OR p_name LIKE '%a!_b%' ESCAPE '!' OR p_name LIKE '%ring%' ESCAPE '!'".replace("LIKE '%red!%' ESCAPE '!' OR p_name ", ""))
def like_escaped(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("p_name")
    return read(spark, d, "part").where(F.like(p, F.lit("%a!_b%"), F.lit("!")) | F.like(p, F.lit("%ring%"), F.lit("!"))).select("p_partkey", "p_name")


@query("owner_facets", f"WITH {DOCS} SELECT CASE WHEN owner_id % 5 = 0 THEN 'node:' || owner_id WHEN owner_id % 7 = 0 THEN 'unknown' ELSE 'dept' || owner_id END AS owner, count(*) AS n FROM meta GROUP BY 1")
def owner_facets(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("owner_id")
    owner = F.when(o % 5 == 0, "").when(o % 7 == 0, None).otherwise(F.concat(F.lit("dept"), o.cast("string")))
    return meta(spark, d).groupBy(status.owner_label(owner, F.when(o % 5 == 0, o)).alias("owner")).agg(F.count("*").alias("n"))


@query("file_types", "SELECT CASE p_size % 6 WHEN 0 THEN 'word' WHEN 1 THEN 'sheet' WHEN 2 THEN 'pdf' WHEN 3 THEN 'text' WHEN 4 THEN 'other' ELSE 'image' END AS file_type, count(*) AS n FROM part GROUP BY 1")
def file_types(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, (".DocX", ".csv", ".v2.PDF", ".md", "", ".Jpeg"))), (F.col("p_size") % 6 + 1).cast("int"))
    return read(spark, d, "part").groupBy(status.file_class(F.concat("p_name", ext)).alias("file_type")).agg(F.count("*").alias("n"))


@query("feedback_buckets", f"""WITH {LOG}, b AS (SELECT CASE WHEN answer_status = 'ERROR' THEN 'B4' WHEN answer_status IN ('NO_RESULT', 'REFUSAL') THEN 'B3' WHEN k % 3 = 0 AND top_score < 7.7 THEN 'B1' WHEN k % 3 = 0 THEN 'B2' END AS bucket, k FROM qlog), u AS (SELECT bucket FROM b WHERE bucket IS NOT NULL UNION ALL SELECT 'B5' FROM b WHERE k % 10 = 0) SELECT bucket, count(*) AS n FROM u GROUP BY 1""")
def feedback_buckets(spark: SparkSession, d: str) -> DataFrame:
    log = qlog(spark, d)
    own = log.select(status.feedback_bucket(F.col("answer_status"), F.col("k") % 3 == 0, status.confidence_band(F.col("top_score"))).alias("bucket")).where("bucket is not null")
    return own.unionByName(log.where("k % 10 = 0").select(F.lit("B5").alias("bucket"))).groupBy("bucket").agg(F.count("*").alias("n"))


@query("confidence_bands", f"WITH {LOG} SELECT CASE WHEN top_score >= 7.7 THEN 'high' WHEN top_score >= 5.8 THEN 'medium' ELSE 'low' END AS band, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM qlog GROUP BY 1")
def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    out = qlog(spark, d).groupBy(status.confidence_band(F.col("top_score")).alias("band")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


@query("refusal_trend", f"WITH {LOG} SELECT CAST(created_at AS DATE) AS day, count(*) AS total, count(*) FILTER (answer_status = 'NO_RESULT') AS no_result, count(*) FILTER (answer_status = 'REFUSAL') AS refusal, count(*) FILTER (blocked) AS blocked, round(count(*) FILTER (answer_status = 'REFUSAL') / count(*), 4) AS rate FROM qlog GROUP BY 1")
def refusal_trend(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("answer_status")
    out = qlog(spark, d).groupBy(_day().alias("day")).agg(F.count("*").alias("total"), F.count_if(s == "NO_RESULT").alias("no_result"), F.count_if(s == "REFUSAL").alias("refusal"), F.count_if("blocked").alias("blocked"))
    return out.withColumn("rate", metrics.rate(F.col("refusal"), F.col("total")))


@query("admission_rollup", f"""WITH {LOG}, r AS (SELECT CAST(created_at AS DATE) AS day, CASE k % 4 WHEN 0 THEN '__probe' WHEN 1 THEN 'global_cap' ELSE 'per_min' END AS reason FROM qlog WHERE answer_status = 'ERROR')
SELECT day, count(*) FILTER (reason NOT LIKE '\\_\\_%' ESCAPE '\\') AS rejected, count(*) FILTER (reason = 'global_cap') AS global_cap, count(*) FILTER (reason = 'per_min') AS per_min FROM r GROUP BY 1""")
def admission_rollup(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k") % 4
    reason = F.when(k == 0, "__probe").when(k == 1, "global_cap").otherwise("per_min")
    return qlog(spark, d).where("answer_status = 'ERROR'").groupBy(_day().alias("day")).agg(F.count_if(~F.startswith(reason, F.lit("__"))).alias("rejected"), F.count_if(reason == "global_cap").alias("global_cap"), F.count_if(reason == "per_min").alias("per_min"))


@query("dept_coverage", f"""WITH {DOCS}, {LOG}, a AS (SELECT owner_id AS dept, count(*) AS docs, count(*) FILTER (status = 'retired') AS retired, count(*) FILTER (created_at >= TIMESTAMP '1998-01-01') AS new_docs, count(*) FILTER (created_at >= TIMESTAMP '1997-01-01' AND created_at < TIMESTAMP '1998-01-01') AS before FROM meta GROUP BY 1),
b AS (SELECT k % 30 AS dept, count(*) AS qa_hits, count(*) FILTER (answer_status = 'REFUSAL') AS refusals FROM qlog GROUP BY 1)
SELECT coalesce(a.dept, b.dept) AS dept, coalesce(docs, 0) AS docs, coalesce(retired, 0) AS retired, coalesce(qa_hits, 0) AS qa_hits, coalesce(refusals, 0) AS refusals, round((new_docs - before) / nullif(before, 0), 4) AS growth FROM a FULL JOIN b ON a.dept = b.dept""")
def dept_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("created_at")
    a = meta(spark, d).groupBy(F.col("owner_id").alias("dept")).agg(F.count("*").alias("docs"), F.count_if(F.col("status") == "retired").alias("retired"), F.count_if(t >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("new_docs"), F.count_if((t >= F.lit("1997-01-01").cast("timestamp_ntz")) & (t < F.lit("1998-01-01").cast("timestamp_ntz"))).alias("before"))
    b = qlog(spark, d).groupBy((F.col("k") % 30).alias("dept")).agg(F.count("*").alias("qa_hits"), F.count_if(F.col("answer_status") == "REFUSAL").alias("refusals"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, "dept", "full_outer").select("dept", zero("docs"), zero("retired"), zero("qa_hits"), zero("refusals"), metrics.rate(F.col("new_docs") - F.col("before"), F.nullif("before", F.lit(0))).alias("growth"))


@query("any_all_quantifiers", f"WITH {DOCS} SELECT doc_id, CASE WHEN max(CASE WHEN owner = 7 THEN 1 ELSE 0 END) = 1 THEN true ELSE false END AS hit_mine, min(CASE WHEN index_status = 'INDEXED' THEN 1 ELSE 0 END) = 1 AS all_indexed FROM chunk GROUP BY 1")
def any_all_quantifiers(spark: SparkSession, d: str) -> DataFrame:
    return chunk(spark, d).groupBy("doc_id").agg(F.bool_or(F.col("owner") == 7).alias("hit_mine"), F.bool_and(F.col("index_status") == "INDEXED").alias("all_indexed"))


@query("multi_version_docs", f"WITH {DOCS} SELECT doc_id, count(DISTINCT version_no) AS versions, array_to_string(list_sort(list(DISTINCT CAST(version_no AS VARCHAR))), ',') AS listed FROM chunk GROUP BY 1 HAVING count(DISTINCT version_no) > 1")
def multi_version_docs(spark: SparkSession, d: str) -> DataFrame:
    return chunk(spark, d).groupBy("doc_id").agg(F.count_distinct("version_no").alias("versions"), F.array_join(F.array_sort(F.collect_set(F.col("version_no").cast("string"))), ",").alias("listed")).where("versions > 1")


@query("scalar_subqueries", f"WITH {DOCS} SELECT (SELECT count(*) FROM meta WHERE status = 'retired') AS retired, (SELECT count(*) FROM chunk WHERE is_active = 0) AS inactive_chunks")
def scalar_subqueries(spark: SparkSession, d: str) -> DataFrame:
    a = meta(spark, d).where("status = 'retired'").agg(F.count("*").alias("retired"))
    # Two global aggregates of one row each.
    return a.crossJoin(chunk(spark, d).where("is_active = 0").agg(F.count("*").alias("inactive_chunks")))


@query("leaderboard", f"""WITH {LOG}, s AS (SELECT user_id, count(*) FILTER (answer_status = 'SUCCESS') AS adopted, count(DISTINCT k) AS hits, count(*) FILTER (blocked) AS feedback FROM qlog GROUP BY 1), t AS (SELECT *, 10 * adopted + 3 * hits + feedback AS score FROM s)
SELECT user_id, score, adopted, row_number() OVER (ORDER BY score DESC, adopted DESC, user_id) AS rank FROM t QUALIFY rank <= 25""")
def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    s = qlog(spark, d).groupBy("user_id").agg(F.count_if(F.col("answer_status") == "SUCCESS").alias("adopted"), F.count_distinct("k").alias("hits"), F.count_if("blocked").alias("feedback"))
    top = s.withColumn("score", 10 * F.col("adopted") + 3 * F.col("hits") + F.col("feedback")).orderBy(F.desc("score"), F.desc("adopted"), "user_id").limit(25)
    return top.select("user_id", "score", "adopted", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("adopted"), "user_id")).cast("long").alias("rank"))


@query("queue_probe", f"WITH {DOCS} SELECT priority, count(*) AS open, CAST(max(date_sub('hour', created_at, TIMESTAMP '1999-01-01')) AS BIGINT) AS oldest_hours, max(date_diff('day', CAST(created_at AS DATE), DATE '1999-01-01')) AS oldest_days FROM meta WHERE status = 'ACTIVE' GROUP BY 1")
def queue_probe(spark: SparkSession, d: str) -> DataFrame:
    age = F.expr("timestampdiff(HOUR, created_at, TIMESTAMP_NTZ '1999-01-01 00:00:00')")
    return meta(spark, d).where("status = 'ACTIVE'").groupBy("priority").agg(F.count("*").alias("open"), F.max(age).alias("oldest_hours"), F.max(F.date_diff(F.lit("1999-01-01").cast("date"), F.to_date("created_at"))).cast("long").alias("oldest_days"))


@query("claim_counts", f"""WITH {DOCS} SELECT count(*) FILTER (index_status = 'NOT_INDEXED') AS stage3, count(*) FILTER (is_active = 0 AND version_no < 3) AS stage2, count(*) FILTER (version_no = 1 AND part_id % 2 = 0) AS stage1 FROM chunk""")
def claim_counts(spark: SparkSession, d: str) -> DataFrame:
    none, now = F.lit(None).cast("string"), F.current_timestamp()
    c = chunk(spark, d)
    s1 = status.claimable(1, F.when(F.col("version_no") == 1, "not_started"), F.when(F.col("part_id") % 2 == 1, "x"), none, none, none, now)
    s2 = status.claimable(2, F.when(F.col("is_active") == 0, "failed"), none, F.col("version_no"), none, none, now)
    s3 = status.claimable(3, none, none, none, F.col("index_status"), F.lit(None).cast("timestamp"), now)
    return c.agg(F.count_if(s3).alias("stage3"), F.count_if(s2).alias("stage2"), F.count_if(s1).alias("stage1"))


_ACL = """doc AS (SELECT doc_id, source, CASE doc_id % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'restricted' ELSE 'dept_internal' END AS permission, CASE WHEN doc_id % 6 = 2 THEN ['src1', 'src9'] ELSE [] END AS allowed FROM documents)"""


def _acl_docs(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    perm = F.when(i % 4 == 0, "public").when(i % 4 == 1, "restricted").otherwise("dept_internal")
    return read(spark, d, "documents").select("doc_id", "source", perm.alias("permission"), F.when(i % 6 == 2, F.array(F.lit("src1"), F.lit("src9"))).otherwise(F.array().cast("array<string>")).alias("allowed"))


@query("acl_visible_docs", f"WITH {_ACL} SELECT doc_id, permission FROM doc WHERE permission = 'public' OR (permission = 'dept_internal' AND (source IN ('src1', 'src2', 'src3') OR list_has_any(allowed, ['src1', 'lines'])))")
def acl_visible_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = _acl_docs(spark, d).withColumn("groups", acl.normalize_groups(F.lit(" src1, lines ,bad,src1"), ["src1", "lines"]))
    owners = acl.expand_owners(F.col("groups"), {"lines": ["src2", "src3"]})
    return docs.where(acl.read_filter(F.col("permission"), F.col("source"), F.col("allowed"), F.col("groups"), owners)).select("doc_id", "permission")


@query("acl_decisions", f"""WITH {_ACL}, p AS (SELECT *, unnest([1, 2, 3]) AS principal FROM doc) SELECT principal, CASE WHEN doc_id % 5 = 0 THEN 'node' ELSE 'legacy' END AS mode, count(*) FILTER (permission = 'public' OR (permission = 'dept_internal' AND CASE WHEN doc_id % 5 = 0 THEN principal = 3 OR (principal = 2 AND doc_id % 3 = 1) ELSE principal = 1 AND (source = 'src1' OR list_contains(allowed, 'src1')) END)) AS readable FROM p GROUP BY 1, 2""")
def acl_decisions(spark: SparkSession, d: str) -> DataFrame:
    docs = _acl_docs(spark, d).withColumn("principal", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("mode", F.when(F.col("doc_id") % 5 == 0, "node").otherwise("legacy"))
    who, longs = F.col("principal"), F.array().cast("array<long>")
    groups = F.when(who == 1, F.array(F.lit("src1"))).otherwise(F.array().cast("array<string>"))
    ok = acl.can_read(
        F.col("permission"), F.col("mode"), F.col("source"), F.col("allowed"), F.array(F.col("doc_id") % 3), longs, groups, groups, F.when(who == 2, F.array(F.lit(1).cast("long"))).otherwise(longs), longs, who > 1,
        who == 3,
    )
    return docs.groupBy("principal", "mode").agg(F.count_if(ok).alias("readable"))


@query("acl_projection", f"""WITH {_ACL} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '__node__' ELSE source END AS owner, array_to_string(CASE WHEN doc_id % 3 = 0 THEN ['d:' || (doc_id % 7), 'dx:' || (doc_id % 5)] ELSE allowed END, ',') AS allowed FROM doc""".replace("array_to_string(CASE", "coalesce(array_to_string(CASE").replace("END, ',') AS allowed", "END, ','), '') AS allowed"))
def acl_projection(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    p = acl.project_acl(F.when(i % 3 == 0, "node").otherwise("odd"), F.col("source"), F.col("allowed"), F.array(i % 7), F.array(i % 5))
    return _acl_docs(spark, d).select("doc_id", p["owner"].alias("owner"), F.array_join(p["allowed"], ",").alias("allowed"))


@query("session_context", "WITH f AS (SELECT conv_id, min(turn) AS first FROM conversations GROUP BY 1) SELECT conv_id, turn, turn > first AS has_context FROM conversations JOIN f USING (conv_id) WHERE role = 'user'")
def session_context(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").withColumn("first", F.min("turn").over(Window.partitionBy("conv_id")))
    return c.where("role = 'user'").select("conv_id", "turn", (F.col("turn") > F.col("first")).alias("has_context"))


@query("session_windows", f"""WITH {LOG}, g AS (SELECT user_id, created_at, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY user_id ORDER BY created_at) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM qlog), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, count(*) AS turns, min(created_at) AS start FROM s GROUP BY user_id, sid""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    from quarry.streaming.rollups import sessions

    return sessions(qlog(spark, d), gap="6 hours").select("user_id", "turns", F.col("start").cast("timestamp_ntz").alias("start"))


@query("tumbling_days", f"WITH {LOG} SELECT CAST(created_at AS DATE) AS day, answer_status, count(*) AS n, round(sum(latency_ms), 2) AS latency FROM qlog GROUP BY 1, 2")
def tumbling_days(spark: SparkSession, d: str) -> DataFrame:
    from quarry.streaming.rollups import daily_counts

    return daily_counts(qlog(spark, d)).withColumn("latency", F.round("latency", 2))


@query("daily_quota", f"WITH {LOG} SELECT message_id, sum(k) OVER (PARTITION BY user_id, CAST(created_at AS DATE) ORDER BY created_at, message_id ROWS UNBOUNDED PRECEDING) <= 100 AS within FROM qlog")
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    from quarry.streaming import limits

    log = qlog(spark, d).select(F.col("user_id").alias("actor"), F.col("created_at").alias("ts"), F.col("message_id").alias("request_id"), "k")
    return limits.daily_quota(log, F.to_date("ts"), F.col("k"), 100).select(F.col("request_id").alias("message_id"), "within")


@query("sliding_limiter", f"""WITH RECURSIVE {LOG}, r AS (SELECT CAST(user_id AS VARCHAR) AS actor, epoch_us(created_at) / 1e6 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY created_at) AS n FROM qlog), f AS (SELECT actor, n, ts, true AS admitted, [ts] AS held FROM r WHERE n = 1
UNION ALL SELECT r.actor, r.n, r.ts, len(list_filter(held, lambda x: x > r.ts - 3600)) < 2, CASE WHEN len(list_filter(held, lambda x: x > r.ts - 3600)) < 2 THEN list_append(list_filter(held, lambda x: x > r.ts - 3600), r.ts) ELSE list_filter(held, lambda x: x > r.ts - 3600) END FROM f JOIN r ON r.actor = f.actor AND r.n = f.n + 1) SELECT actor, ts, admitted FROM f""")
def sliding_limiter(spark: SparkSession, d: str) -> DataFrame:
    from quarry.streaming.limits import sliding_limit

    log = qlog(spark, d).select(F.col("user_id").cast("string").alias("actor"), F.unix_micros(F.col("created_at").cast("timestamp")).cast("double").alias("ts")).withColumn("ts", F.col("ts") / 1e6)
    return sliding_limit(log, 2, 3600.0)


@query("first_message_wins", f"WITH {LOG} SELECT session_id, arg_min(message_id, message_id) AS message_id FROM qlog GROUP BY 1")
def first_message_wins(spark: SparkSession, d: str) -> DataFrame:
    from quarry.sources.tables import latest_per_key

    return latest_per_key(qlog(spark, d), ["session_id"], F.asc("message_id")).select("session_id", "message_id")


@query("history_union", f"""WITH {LOG}, u AS (SELECT 'error' AS source, message_id AS id, created_at AS "at" FROM qlog WHERE answer_status = 'ERROR' UNION ALL SELECT 'refusal', message_id, created_at FROM qlog WHERE answer_status = 'REFUSAL' UNION ALL SELECT 'block', message_id, created_at FROM qlog WHERE blocked) SELECT * FROM u ORDER BY "at" DESC, source, id LIMIT 200""")
def history_union(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators.audits import history_union as merged

    log = qlog(spark, d)
    part = lambda name, c: log.where(c).select(F.lit(name).alias("source"), F.col("message_id").alias("id"), F.col("created_at").alias("at"))
    return merged([part("error", "answer_status = 'ERROR'"), part("refusal", "answer_status = 'REFUSAL'"), part("block", "blocked")])


@query("retention_split", f"WITH {DOCS} SELECT CASE WHEN CAST(created_at AS DATE) < CAST(DATE '1998-08-01' - INTERVAL 18 MONTH AS DATE) THEN 'expired' ELSE 'kept' END AS state, count(*) AS n FROM meta GROUP BY 1")
def retention_split(spark: SparkSession, d: str) -> DataFrame:
    from quarry.sources.sinks import split_by_retention

    kept, old = split_by_retention(meta(spark, d), "created_at", "rows", F.lit("1998-08-01").cast("date"))
    return kept.select(F.lit("kept").alias("state")).union(old.select(F.lit("expired").alias("state"))).groupBy("state").agg(F.count("*").alias("n"))


@query("ingest_policy", """WITH k AS (SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'raw/_archive/x.pdf' WHEN 1 THEN 'a/~$x.docx' WHEN 2 THEN 'a/Thumbs.db' WHEN 3 THEN 'a/noext' WHEN 4 THEN 'a/x.DOC' WHEN 5 THEN 'a/x.weird' ELSE 'a/x.PDF' END AS key FROM part)
SELECT CASE key WHEN 'raw/_archive/x.pdf' THEN 'excluded_path' WHEN 'a/~$x.docx' THEN 'temp_file' WHEN 'a/Thumbs.db' THEN 'junk_name' WHEN 'a/noext' THEN 'no_extension' WHEN 'a/x.DOC' THEN 'legacy_extension' WHEN 'a/x.weird' THEN 'unknown_extension' ELSE 'ok' END AS reason, count(*) AS n FROM k GROUP BY 1""")
def ingest_policy(spark: SparkSession, d: str) -> DataFrame:
    from quarry.sources.files import ingest_decision

    keys = F.array(*map(F.lit, ("raw/_archive/x.pdf", "a/~$x.docx", "a/Thumbs.db", "a/noext", "a/x.DOC", "a/x.weird", "a/x.PDF")))
    return read(spark, d, "part").groupBy(ingest_decision(F.element_at(keys, (F.col("p_size") % 7 + 1).cast("int")))["reason"].alias("reason")).agg(F.count("*").alias("n"))
