"""Queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table

#: The rules that ``op1_url_filter`` judges by: host, path, verdict.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.url_filter import match_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return match_urls(table(spark, sf_dir, "pages"), rules)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.sharding import shard_of, shuffle_into_shards

    dealt = shuffle_into_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dealt.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot",
        shard_of(F.col("doc_id"), 9, 7).cast("int").alias("grown_shard"),
    )


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.decontamination import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality import held_out, learn, score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.matroska import digests, store

    return digests(store(table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.mixing import mix_counts, plan_mix

    return mix_counts(plan_mix(table(spark, sf_dir, "documents")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.html_extract import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.simhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_cohort_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.retention import cohort_retention

    return cohort_retention(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "clients"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_sharding": op2_sharding,
    "op3_decontamination": op3_decontamination,
    "op4_license_scan": op4_license_scan,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_personal_data": op6_personal_data,
    "op7_matroska": op7_matroska,
    "op8_mixing": op8_mixing,
    "op9_html_extraction": op9_html_extraction,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_cohort_retention": op13_cohort_retention,
}


def _url_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return f"""
WITH r(rule_host, rule_path, verdict) AS (VALUES {rules}),
s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
m AS (SELECT u.n, arg_max(struct_pack(rule := r.rule_host || r.rule_path, verdict := r.verdict), length(r.rule_host || r.rule_path) * 1000 + length(r.rule_host)) AS best
      FROM u JOIN r ON (u.host = r.rule_host OR ends_with(u.host, '.' || r.rule_host)) AND starts_with(u.path, r.rule_path) GROUP BY u.n)
SELECT u.page_id, u.host, u.path, m.best.rule AS rule, coalesce(m.best.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (n)
"""


#: A row with the table of the CRC-32, for :func:`_crc`.
_CRC_TABLE = """t AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)::BIGINT[]),
 lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    """The CRC-32 of an ASCII text beside the row of ``t``."""
    bytes_ = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


_TRIE_SQL = f"""
WITH {_CRC_TABLE},
m AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, {_crc("conv_id::VARCHAR")} % 6 AS h FROM m, t),
b AS (SELECT h.conv_id, list_concat(coalesce(o.own[1:h.h], []), h.own[h.h + 1:]) AS seq FROM h LEFT JOIN m o ON o.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, seq[1:d] AS pre, len(seq) = d AS last FROM b, LATERAL (SELECT unnest(range(0, len(seq) + 1)) AS d)),
n AS (SELECT pre, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY pre, d),
k AS (SELECT pre[1:d - 1] AS pre, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
a AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(pre[d].text) ELSE 0 END AS saved FROM n LEFT JOIN k USING (pre)),
s AS (SELECT pre[1:e] AS pre, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM a, LATERAL (SELECT unnest(range(0, d + 1)) AS e) GROUP BY 1)
SELECT a.conv_id, a.d AS depth, u.conv_id AS parent_conv_id, a.n_convs, a.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
FROM a JOIN s ON s.pre = a.pre LEFT JOIN n u ON a.d > 0 AND u.pre = a.pre[1:a.d - 1]
"""

_DEDUP_SQL = r"""
WITH s AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept, text_sha256
FROM s WINDOW w AS (PARTITION BY text_sha256)
"""

_RETENTION_SQL = f"""
WITH {_CRC_TABLE},
d AS (SELECT DISTINCT * FROM clicks WHERE ts IS NOT NULL AND client_id IS NOT NULL),
h AS (SELECT d.*, {_crc("click_id::VARCHAR")} AS h FROM d, t),
k AS (SELECT *, coalesce(arrived_at + to_days((CASE WHEN h % 3 = 0 THEN h % 100 ELSE 0 END)::INT) < TIMESTAMP '2024-02-15', false) AS known FROM h),
s AS (SELECT 0 AS state, client_id, min(ts) AS start FROM k WHERE kind = 'signup' AND known GROUP BY 2 UNION ALL SELECT 1, client_id, min(ts) FROM k WHERE kind = 'signup' GROUP BY 2),
c AS (SELECT s.*, start::DATE - DATE '1970-01-01' AS cohort, {_crc("client_id::VARCHAR")} AS crc FROM s, t),
g AS (SELECT client_id, max(segment) AS segment FROM clients GROUP BY 1),
m AS (SELECT c.*, coalesce(o.cohort <> c.cohort, false) AS moved, coalesce(g.segment, '') AS segment FROM c LEFT JOIN c o ON o.client_id = c.client_id AND o.state <> c.state LEFT JOIN g ON g.client_id = c.client_id),
p AS (SELECT m.state, m.segment, m.cohort, date_diff('microsecond', m.start, k.ts) // 86400000000 AS period, m.client_id, m.crc, m.moved, sum(coalesce(floor(100 * k.value + 0.5)::BIGINT, 0)) AS cents
      FROM k JOIN m ON m.client_id = k.client_id AND k.ts >= m.start AND (m.state = 1 OR k.known) GROUP BY ALL)
SELECT state::INT AS state, segment, cohort::BIGINT AS cohort, period::BIGINT AS period, count(*) AS users, sum(crc)::BIGINT AS users_crc32, count(*) FILTER (moved) AS moved, sum(cents)::BIGINT AS cents
FROM p GROUP BY 1, 2, 3, 4
"""


def _oracles() -> dict[str, str]:
    from quarry.llm import licenses

    shop = {"op11_conversation_trie": _TRIE_SQL, "op12_exact_dedup": _DEDUP_SQL, "op13_cohort_retention": _RETENTION_SQL}
    return {"op1_url_filter": _url_sql(), "op4_license_scan": licenses.oracle(), **shop}


ORACLE_SQL: dict[str, str] = _oracles()
