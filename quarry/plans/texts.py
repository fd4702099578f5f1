"""Queries over texts, vectors, chunks, hierarchies, reconciliation, gaps and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import redact, text
from quarry.operators import audits, chunking, evaluation, gaps, hierarchy, reconcile, retrieval
from quarry.plans.registry import query
from quarry.plans.views import DOCS, LOG, chunk, qlog
from quarry.sources.tables import read


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents")


def _tokens_sql(col: str) -> str:
    return f"CAST(floor(len(regexp_extract_all({col}, '[一-鿿]')) / 1.5 + (length({col}) - len(regexp_extract_all({col}, '[一-鿿]'))) / 4) AS INT)"


_NORM = "regexp_replace(translate(regexp_replace({c}, '[\u200b\u200c\u200d\u2060\ufeff]', '', 'g'), '{full}', '{half}'), '\\n[ \\t\u3000]*\\n(?:[ \\t\u3000]*\\n)+', chr(10) || chr(10), 'g')".format(c="text", full=text._FULL, half=text._HALF)
_QNORM = "regexp_replace(lower(trim(translate(coalesce({c}, ''), '{full}', '{half}'))), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')"


def _qnorm(c: str) -> str:
    return _QNORM.format(c=c, full=text._FULL, half=text._HALF)


@query("normalize_text", f"SELECT doc_id, sha256({_NORM}) AS canonical_sha256 FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    from quarry.sources.sinks import fingerprints

    return fingerprints(docs(spark, d)).select("doc_id", "canonical_sha256")


@query("question_hash", f"SELECT conv_id, turn, sha256({_qnorm('text')}) AS hash, length({_qnorm('text')}) < 2 OR regexp_matches({_qnorm('text')}, '^[0-9]+$') AS junk FROM conversations")
def question_hash(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "conversations").select("conv_id", "turn", text.question_hash(t).alias("hash"), text.is_junk_question(t).alias("junk"))


@query("token_estimate", f"SELECT doc_id, {_tokens_sql('text')} AS tokens FROM documents")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("chunk_id", "WITH r AS (SELECT l_orderkey, l_linenumber, l_orderkey || '_v' || (l_linenumber % 3 + 1) || '_c' || lpad(CAST(l_linenumber AS VARCHAR), 4, '0') AS raw FROM lineitem) SELECT l_orderkey, l_linenumber, raw || '_' || upper(substr(sha256(raw), 1, 8)) AS chunk_name, CAST(CAST('0x' || substr(md5(raw), 1, 16) AS UBIGINT) & 9223372036854775807 AS BIGINT) AS pk FROM r")
def chunk_id(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    name = text.chunk_id(F.col("l_orderkey"), n % 3 + 1, n)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", name.alias("chunk_name"), text.stable_pk(F.substring_index(name, "_", 3)).alias("pk"))


@query("exact_dup_groups", "WITH g AS (SELECT md5(regexp_replace(text, '\\s+', '', 'g')) AS h, count(*) AS n, count(DISTINCT source) AS sources, min(doc_id) AS first_id FROM documents GROUP BY 1) SELECT * FROM g WHERE n > 1")
def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).groupBy(F.md5(text.without_space(F.col("text"))).alias("h")).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("benchmark_containment", """WITH b AS (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM benchmark), g AS (SELECT item_id, list_distinct(list_transform(range(1, length(t) - 1), lambda k: substr(t, k, 3))) AS grams FROM b)
SELECT x.item_id, round(len(list_intersect(x.grams, y.grams)) / len(x.grams), 6) AS share FROM g x JOIN g y ON y.item_id = x.item_id + 1""")
def benchmark_containment(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "benchmark")
    nxt = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hay"))
    return b.join(nxt, "item_id").select("item_id", F.round(text.gram_containment(F.col("text"), F.col("hay")), 6).alias("share"))


@query("near_dup_jaccard")
def near_dup_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return audits.near_duplicate_chunks(docs(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text")))


@query("benchmark_simhash", """WITH b AS (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM benchmark), g AS (SELECT item_id, CAST('0x' || substr(md5(unnest(list_transform(range(1, length(t) - 1), lambda k: substr(t, k, 3)))), 1, 16) AS UBIGINT) AS h FROM b),
v AS (SELECT item_id, bit, sum(CASE WHEN (h >> bit) & 1 = 1 THEN 1 ELSE -1 END) AS votes FROM g, (SELECT CAST(unnest(range(0, 64)) AS INT) AS bit) GROUP BY 1, 2) SELECT item_id, string_agg(CASE WHEN votes > 0 THEN '1' ELSE '0' END, '' ORDER BY bit DESC) AS bits FROM v GROUP BY 1""")
def benchmark_simhash(spark: SparkSession, d: str) -> DataFrame:
    from quarry.functions.arrow import simhash64

    return read(spark, d, "benchmark").select("item_id", F.lpad(F.bin(simhash64(F.col("text"))), 64, "0").alias("bits"))


@query("document_simhash")
def document_simhash(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents, with the distance to the fingerprint of the document of the smallest id in their source."""
    from quarry.functions.arrow import simhash64

    prints = docs(spark, d).select("doc_id", "source", simhash64(F.col("text")).alias("h"))
    first = prints.groupBy("source").agg(F.min_by("h", "doc_id").alias("first"))
    near = text.hamming64(F.col("h"), F.col("first")).alias("distance")
    return prints.join(first, "source").select("doc_id", F.lpad(F.bin("h"), 64, "0").alias("bits"), near)


@query("pii_emails", "SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS emails FROM documents")
def pii_emails(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.coalesce(F.try_element_at(redact.detect(F.col("text")), F.lit("email")), F.lit(0)).cast("long").alias("emails"))


@query("pii_risk")
def pii_risk(spark: SparkSession, d: str) -> DataFrame:
    return redact.risk_decision(docs(spark, d)).groupBy("risk", "action").agg(F.count("*").alias("n"))


@query("pii_scrub")
def pii_scrub(spark: SparkSession, d: str) -> DataFrame:
    s = redact.scrub(F.col("text"))
    return docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.sha2("s.text", 256).alias("text_sha256"), F.array_join("s.findings", ",").alias("findings"))


@query("html_text")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    from quarry.sources.files import html_to_text

    return read(spark, d, "pages").select("page_id", html_to_text(F.col("html")).alias("text")).select("page_id", F.char_length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query("page_hosts", "SELECT regexp_extract(url, '://([^/?#]+)', 1) AS host, count(*) AS pages, count(DISTINCT md5(html)) AS distinct_pages FROM pages GROUP BY 1")
def page_hosts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").groupBy(F.regexp_extract("url", "://([^/?#]+)", 1).alias("host")).agg(F.count("*").alias("pages"), F.count_distinct(F.md5("html")).alias("distinct_pages"))


@query("native_text_quality", "WITH b AS (SELECT doc_id, text, regexp_replace(text, '[ \\t\\n\\r\\f\\v]', '', 'g') AS bare FROM documents) SELECT doc_id, CASE WHEN trim(text) = '' OR length(bare) = 0 THEN true ELSE len(regexp_extract_all(bare, '[\\x21-\\x7e一-鿿\u3000-〿\uff00-\uffef]')) >= 0.70 * length(bare) END AS ok FROM b")
def native_text_quality(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", text.native_text_ok(F.col("text")).alias("ok"))


@query("title_similarity", """WITH t AS (SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[^\\p{L}\\p{N}]+', '', 'g') AS k, 'redring' AS o FROM part), g AS (SELECT *, list_distinct(list_transform(range(1, length(k)), lambda i: substr(k, i, 2))) AS a, list_distinct(list_transform(range(1, length(o)), lambda i: substr(o, i, 2))) AS b FROM t)
SELECT p_partkey, CASE WHEN contains(k, o) OR contains(o, k) THEN 1.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) END AS similarity FROM g""")
def title_similarity(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", F.round(text.title_similarity(F.col("p_name"), F.lit("Red Ring.docx")), 6).alias("similarity"))


@query("character_error", "SELECT p_partkey, round(levenshtein(replace(p_name, ' ', ''), 'smallring') / length(replace(p_name, ' ', '')), 4) AS cer FROM part")
def character_error(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", text.character_error_rate(F.col("p_name"), F.lit("small ring")).alias("cer"))


@query("char_f1", """WITH t AS (SELECT p_partkey, replace(p_name, ' ', '') AS a, 'smallring' AS b FROM part), c AS (SELECT *, list_distinct(list_filter(string_split(a, ''), lambda x: x <> '')) AS s FROM t)
SELECT p_partkey, round(2 * list_sum(list_transform(s, lambda x: least(length(a) - length(replace(a, x, '')), length(b) - length(replace(b, x, ''))))) / (length(a) + length(b)), 4) AS f1 FROM c""")
def char_f1(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select("p_partkey", text.char_f1(F.col("p_name"), F.lit("small ring")).alias("f1"))


@query("keyword_coverage", "SELECT doc_id, round((CASE WHEN contains(lower(text), 'the') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'der') THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'les') THEN 1 ELSE 0 END) / 3, 6) AS coverage FROM documents")
def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.round(text.keyword_coverage(F.col("text"), F.array(F.lit("the"), F.lit("DER"), F.lit("les"))), 6).alias("coverage"))


@query("staff_masks", "SELECT c_custkey, CASE WHEN length(v) <= 4 THEN repeat('*', length(v)) ELSE substr(v, 1, 2) || '***' || substr(v, length(v) - 1, 2) END AS masked FROM (SELECT c_custkey, CAST(c_custkey * 37 AS VARCHAR) AS v FROM customer)")
def staff_masks(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select("c_custkey", text.mask_staff_id((F.col("c_custkey") * 37).cast("string")).alias("masked"))


@query("paragraphs", "WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS paragraphs, max(length(trim(line, ' ' || chr(9)))) AS longest FROM p WHERE trim(line, ' ' || chr(9)) <> '' GROUP BY 1")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    p = docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.regexp_replace("line", "^[ \\t]+|[ \\t]+$", "")).where("line <> ''")
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max(F.char_length("line")).cast("long").alias("longest"))


@query("table_islands", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), t AS (SELECT *, length(line) - length(replace(line, '|', '')) >= 2 AS is_table FROM l),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) - row_number() OVER (PARTITION BY doc_id, is_table ORDER BY n) AS island FROM t) SELECT doc_id, is_table, island, count(*) AS lines FROM i GROUP BY ALL""")
def table_islands(spark: SparkSession, d: str) -> DataFrame:
    return chunking.table_islands(docs(spark, d)).withColumn("island", F.col("island").cast("long"))


@query("chunks_default")
def chunks_default(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(docs(spark, d).withColumn("version_no", F.lit(1)))


@query("chunk_neighbour_links", f"WITH {DOCS} SELECT chunk_id, lag(chunk_id) OVER w AS prev_chunk_id, lead(chunk_id) OVER w AS next_chunk_id FROM chunk WINDOW w AS (PARTITION BY doc_id, version_no ORDER BY chunk_id)")
def chunk_neighbour_links(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_links(chunk(spark, d).withColumn("chunk_index", F.col("chunk_id"))).select("chunk_id", "prev_chunk_id", "next_chunk_id")


@query("chunk_quality", "WITH c AS (SELECT doc_id, source, trim(text) AS t, text FROM documents) SELECT source, count(*) AS n, count(*) FILTER (NOT regexp_matches(t, '[。！？.!?；;:：)）\"”|\\]]$')) AS mid_sentence, count(*) FILTER (NOT length(t) BETWEEN 5 AND 2000) AS odd_size FROM c GROUP BY 1")
def chunk_quality(spark: SparkSession, d: str) -> DataFrame:
    return chunking.quality_flags(docs(spark, d).withColumnRenamed("text", "chunk_text")).groupBy("source").agg(F.count("*").alias("n"), F.count_if("mid_sentence").alias("mid_sentence"), F.count_if("odd_size").alias("odd_size"))


@query("neighbor_stitch", f"WITH {DOCS}, c AS (SELECT DISTINCT doc_id, chunk_index FROM chunk), k AS (SELECT doc_id, chunk_index FROM c) SELECT k.doc_id, k.chunk_index, string_agg('c' || c.chunk_index, chr(10) ORDER BY c.chunk_index) AS text FROM k JOIN c ON c.doc_id = k.doc_id AND c.chunk_index BETWEEN k.chunk_index - 1 AND k.chunk_index + 1 GROUP BY 1, 2")
def neighbor_stitch(spark: SparkSession, d: str) -> DataFrame:
    c = chunk(spark, d).select("doc_id", "chunk_index").distinct().select("doc_id", "chunk_index", F.lit(1).alias("version_no"), F.lit("public").alias("permission_level"), F.lit("o").alias("owner"), F.concat(F.lit("c"), F.col("chunk_index").cast("string")).alias("text"))
    return retrieval.stitch_neighbors(c, c).select("doc_id", "chunk_index", "text")


_EMB = "e AS (SELECT vec_id, embedding, label FROM embeddings), q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0)"


@query("dense_topk", f"WITH {_EMB}, s AS (SELECT query_id, vec_id, list_inner_product(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q, e), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 4) AS score, rank FROM r WHERE rank <= 10")
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100."""
    e = read(spark, d, "embeddings")
    out = retrieval.dense_top_k_in_blocks(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e, 10)
    return out.select("query_id", "vec_id", F.round("score", 4).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("self_retrieval", f"WITH {_EMB}, s AS (SELECT query_id, vec_id, list_inner_product(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q, e) SELECT query_id, arg_max(vec_id, struct_pack(s := score, v := -vec_id)) = query_id AS found FROM s GROUP BY 1")
def self_retrieval(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    out = retrieval.dense_top_k_in_blocks(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e, 1)
    return out.select("query_id", (F.col("vec_id") == F.col("query_id")).alias("found"))


_BM25 = """qt AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark),
dt AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS terms FROM documents), st AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM dt),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM dt) WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2)"""


@query("bm25_topk", f"WITH {_BM25}, r AS (SELECT query_id, doc_id, round(score, 4) AS score FROM bm) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 10")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    out = retrieval.bm25(docs(spark, d), read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")).withColumn("score", F.round("score", 4))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return out.withColumn("rank", rank.cast("long")).where("rank <= 10")


_ARMS = "arm AS (SELECT l_orderkey % 50 AS query_id, CASE l_linenumber % 3 WHEN 0 THEN 'dense' WHEN 1 THEN 'bm25' ELSE 'sparse' END AS arm, l_partkey AS pk, CAST(max(l_quantity) AS DOUBLE) AS score FROM lineitem GROUP BY ALL)"


def _arms(spark: SparkSession, d: str) -> DataFrame:
    arm = F.when(F.col("l_linenumber") % 3 == 0, "dense").when(F.col("l_linenumber") % 3 == 1, "bm25").otherwise("sparse")
    li = read(spark, d, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 50).alias("query_id"), arm.alias("arm"), F.col("l_partkey").alias("pk")).agg(F.max("l_quantity").alias("score"))


@query("rrf_fusion", f"WITH {_ARMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, arm ORDER BY score DESC, pk) AS r FROM arm) SELECT query_id, pk, round(sum(1.0 / (60 + r)), 6) AS fused FROM r GROUP BY 1, 2")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.reciprocal_rank_fusion(_arms(spark, d)).withColumn("fused", F.round("fused", 6))


_FUSED = f"""{_ARMS}, m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM arm WINDOW w AS (PARTITION BY query_id, arm)),
f AS (SELECT query_id, pk, round(sum(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END * CASE arm WHEN 'dense' THEN 0.7 WHEN 'sparse' THEN 0.1 ELSE 0.3 END), 6) AS fused FROM m GROUP BY 1, 2)"""
_WEIGHTS = {"dense": 0.7, "sparse": 0.1, "bm25": 0.3}


@query("minmax_fusion", f"WITH {_FUSED} SELECT * FROM f")
def minmax_fusion(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.min_max_fusion(_arms(spark, d), _WEIGHTS).withColumn("fused", F.round("fused", 6))


@query("server_fusion", f"WITH {_ARMS} SELECT query_id, pk, round(sum(score * CASE arm WHEN 'dense' THEN 0.7 WHEN 'bm25' THEN 0.3 ELSE 0 END), 4) AS fused FROM arm GROUP BY 1, 2")
def server_fusion(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.weighted_fusion(_arms(spark, d), {"dense": 0.7, "bm25": 0.3}).withColumn("fused", F.round("fused", 4))


@query("doc_cap", f"""WITH {_FUSED}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, pk) AS rank, pk % 13 AS doc_id, pk % 5 = 0 AS is_cover FROM f), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, is_cover, doc_id ORDER BY rank) AS nth FROM p),
g AS (SELECT *, CASE WHEN NOT is_cover AND nth <= 2 THEN 0 WHEN NOT is_cover THEN 1 ELSE 2 END AS grp FROM n), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grp, rank) AS position FROM g) SELECT query_id, pk, position FROM o WHERE position <= 30""")
def doc_cap(spark: SparkSession, d: str) -> DataFrame:
    pool = minmax_fusion(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "pk"))).withColumn("doc_id", F.col("pk") % 13).withColumn("is_cover", F.col("pk") % 5 == 0)
    return retrieval.select_with_cap(pool, 30, 2).select("query_id", "pk", F.col("position").cast("long").alias("position"))


@query("interleave", f"""WITH {_ARMS}, l AS (SELECT query_id, pk, CASE arm WHEN 'bm25' THEN 0 WHEN 'dense' THEN 1 ELSE 2 END AS list_no, row_number() OVER (PARTITION BY query_id, arm ORDER BY score DESC, pk) AS rank FROM arm), u AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY query_id, pk ORDER BY rank, list_no) = 1)
SELECT query_id, pk, row_number() OVER (PARTITION BY query_id ORDER BY rank, list_no) AS position FROM u""")
def interleave(spark: SparkSession, d: str) -> DataFrame:
    arms = _arms(spark, d)
    rank = F.row_number().over(Window.partitionBy("query_id", "arm").orderBy(F.desc("score"), "pk"))
    lists = arms.select("query_id", "pk", F.when(F.col("arm") == "bm25", 0).when(F.col("arm") == "dense", 1).otherwise(2).alias("list_no"), rank.alias("rank"))
    return retrieval.interleave(lists).select("query_id", "pk", F.col("position").cast("long").alias("position"))


@query("context_packing", f"WITH {_FUSED}, p AS (SELECT query_id, pk, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, pk) AS rank FROM f), u AS (SELECT *, sum(pk % 90 + 10) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM p) SELECT query_id, pk, CAST(used AS BIGINT) AS used FROM u WHERE used <= 1000")
def context_packing(spark: SparkSession, d: str) -> DataFrame:
    hits = minmax_fusion(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "pk"))).withColumn("text", F.repeat(F.lit("x"), (F.col("pk") % 90 + 10).cast("int")))
    return retrieval.pack_context(hits, 1000).select("query_id", "pk", "used")


_PAR = """st AS (SELECT l_orderkey * 10 + l_linenumber AS pk, l_orderkey AS doc_id, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS is_active, CASE WHEN l_linestatus = 'F' THEN 'INDEXED' ELSE 'NOT_INDEXED' END AS index_status FROM lineitem), st1 AS (SELECT pk, any_value(doc_id) AS doc_id, min(is_active) AS is_active, min(index_status) AS index_status FROM st GROUP BY pk),
ix AS (SELECT pk, doc_id FROM st1 WHERE pk % 11 <> 0 UNION ALL SELECT pk, doc_id FROM st1 WHERE pk % 29 = 1 UNION ALL SELECT -pk, -doc_id FROM st1 WHERE pk % 31 = 0)"""


def _stores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = read(spark, d, "lineitem")
    store = li.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pk")).agg(F.max("l_orderkey").alias("doc_id"), F.min(F.when(F.col("l_returnflag") == "R", 0).otherwise(1)).alias("is_active"), F.min(F.when(F.col("l_linestatus") == "F", "INDEXED").otherwise("NOT_INDEXED")).alias("index_status"))
    ix = store.select("pk", "doc_id")
    return store, ix.where("pk % 11 <> 0").union(ix.where("pk % 29 = 1")).union(ix.where("pk % 31 = 0").select(-F.col("pk"), -F.col("doc_id")))


@query("parity_diff", f"WITH {_PAR}, i AS (SELECT pk, count(*) AS copies FROM ix GROUP BY 1), j AS (SELECT coalesce(s.pk, i.pk) AS pk, CASE WHEN i.pk IS NULL AND is_active = 1 AND index_status = 'INDEXED' THEN 'missing' WHEN i.pk IS NULL THEN NULL WHEN copies > 1 THEN 'dup' WHEN s.pk IS NULL THEN 'orphan' WHEN is_active <> 1 THEN 'inactive' END AS kind FROM st1 s FULL JOIN i ON s.pk = i.pk) SELECT * FROM j WHERE kind IS NOT NULL")
def parity_diff(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.parity(*_stores(spark, d))


@query("parity_summary", f"""WITH {_PAR}, i AS (SELECT pk, count(*) AS copies FROM ix GROUP BY 1), j AS (SELECT CASE WHEN i.pk IS NULL AND is_active = 1 AND index_status = 'INDEXED' THEN 'missing' WHEN i.pk IS NULL THEN NULL WHEN copies > 1 THEN 'dup' WHEN s.pk IS NULL THEN 'orphan' WHEN is_active <> 1 THEN 'inactive' END AS kind FROM st1 s FULL JOIN i ON s.pk = i.pk),
k AS (SELECT count(*) FILTER (kind = 'missing') AS n_missing, count(*) FILTER (kind = 'dup') AS n_dup, count(*) FILTER (kind = 'inactive') AS n_inactive, count(*) FILTER (kind = 'orphan') AS n_orphan FROM j), v AS (SELECT count(*) AS vanished_docs FROM (SELECT DISTINCT doc_id FROM st1 WHERE is_active = 1 AND index_status = 'INDEXED' EXCEPT SELECT doc_id FROM ix)), o AS (SELECT count(*) AS orphan_docs FROM (SELECT doc_id FROM ix EXCEPT SELECT doc_id FROM st1))
SELECT *, n_missing = 0 AND vanished_docs = 0 AS ok FROM k, v, o""")
def parity_summary(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.parity_summary(*_stores(spark, d))


@query("deletable_orphans", f"WITH {_PAR}, act AS (SELECT pk, pk // 2 AS chunk_id FROM st1 WHERE is_active = 1), x AS (SELECT DISTINCT pk, abs(pk) // 2 AS chunk_id FROM ix), absent AS (SELECT DISTINCT chunk_id FROM act WHERE pk NOT IN (SELECT pk FROM x)) SELECT x.pk, x.chunk_id, CASE WHEN a.chunk_id IS NOT NULL THEN 'dup_replacement_absent' ELSE 'delete' END AS decision FROM x LEFT JOIN absent a USING (chunk_id) WHERE x.pk NOT IN (SELECT pk FROM act)")
def deletable_orphans(spark: SparkSession, d: str) -> DataFrame:
    store, index = _stores(spark, d)
    return reconcile.deletable_orphans(index.select("pk", F.expr("abs(pk) div 2").alias("chunk_id")).distinct(), store.where("is_active = 1").select("pk", F.expr("pk div 2").alias("chunk_id")))


@query("serving_version", f"WITH {DOCS}, p AS (SELECT doc_id, version_no, sum(CASE WHEN index_status <> 'INDEXED' THEN 1 ELSE 0 END) AS open FROM chunk WHERE is_active = 1 GROUP BY 1, 2), q AS (SELECT doc_id, max(version_no) FILTER (open = 0) AS complete, count(*) AS n, max(version_no) AS only_ FROM p GROUP BY 1) SELECT doc_id, coalesce(complete, CASE WHEN n = 1 THEN only_ END) AS serving FROM q")
def serving_version(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.serving_version(chunk(spark, d))


@query("stranded_versions", f"WITH {DOCS}, p AS (SELECT doc_id, version_no, bool_and(index_status = 'INDEXED') AS whole FROM chunk WHERE is_active = 1 GROUP BY 1, 2) SELECT a.doc_id, a.version_no FROM p a WHERE whole AND EXISTS (SELECT 1 FROM p b WHERE b.doc_id = a.doc_id AND b.version_no < a.version_no)")
def stranded_versions(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.stranded_versions(chunk(spark, d))


@query("asset_set_diff", "WITH o AS (SELECT l_orderkey AS doc_id, list_sort(list(DISTINCT l_linenumber)) AS a, list_sort(list(DISTINCT l_linenumber % 3)) AS b FROM lineitem GROUP BY 1) SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'same_source_drift' ELSE 'source_changed' END AS kind, coalesce(array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ','), '') AS removed, coalesce(array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ','), '') AS added FROM o WHERE list_sort(a) <> list_sort(b)")
def asset_set_diff(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set("l_linenumber").alias("a"), F.collect_set(F.col("l_linenumber") % 3).alias("b"))
    old = g.select("doc_id", F.col("a").alias("ordinals"), F.lit(False).alias("partial"), F.lit("s").alias("source"))
    new = g.select("doc_id", F.col("b").alias("ordinals"), F.lit(False).alias("partial"), F.when(F.col("doc_id") % 2 == 0, "s").otherwise("t").alias("source"))
    return reconcile.asset_set_diff(old, new).select("doc_id", "kind", F.array_join("removed", ",").alias("removed"), F.array_join("added", ",").alias("added"))


_TREE = "tree AS (SELECT CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent UNION ALL SELECT 1 + r_regionkey, 0 FROM region UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey FROM nation UNION ALL SELECT 1000 + s_suppkey, 100 + s_nationkey FROM supplier)"


def _tree(spark: SparkSession, d: str) -> DataFrame:
    root = spark.range(1).select(F.lit(0).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"))
    r = read(spark, d, "region").select((F.col("r_regionkey") + 1).cast("long"), F.lit(0).cast("long"))
    n = read(spark, d, "nation").select((F.col("n_nationkey") + 100).cast("long"), (F.col("n_regionkey") + 1).cast("long"))
    s = read(spark, d, "supplier").select((F.col("s_suppkey") + 1000).cast("long"), (F.col("s_nationkey") + 100).cast("long"))
    return root.union(r).union(n).union(s)


@query("hierarchy_closure", f"WITH RECURSIVE {_TREE}, c AS (SELECT id AS node, id AS ancestor, parent AS nxt, 0 AS hops FROM tree UNION ALL SELECT c.node, t.id, t.parent, c.hops + 1 FROM c JOIN tree t ON t.id = c.nxt) SELECT node, ancestor, hops, true AS ok FROM c WHERE ancestor <> 0")
def hierarchy_closure(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.ancestors(_tree(spark, d))


@query("nearest_anchor", f"WITH RECURSIVE {_TREE}, c AS (SELECT id AS node, id AS ancestor, parent AS nxt, 0 AS hops FROM tree UNION ALL SELECT c.node, t.id, t.parent, c.hops + 1 FROM c JOIN tree t ON t.id = c.nxt), k AS (SELECT * FROM c WHERE ancestor <> 0), h AS (SELECT node, arg_min('g' || ancestor, hops) AS groups FROM k WHERE ancestor % 4 = 1 GROUP BY 1) SELECT DISTINCT k.node, groups FROM k LEFT JOIN h USING (node)")
def nearest_anchor(spark: SparkSession, d: str) -> DataFrame:
    tree = _tree(spark, d)
    anchors = tree.where("id % 4 = 1").select("id", F.concat(F.lit("g"), F.col("id").cast("string")).alias("groups"))
    return hierarchy.nearest_anchor(hierarchy.ancestors(tree), anchors)


@query("descendant_counts", f"WITH RECURSIVE {_TREE}, c AS (SELECT id AS node, id AS ancestor, parent AS nxt FROM tree UNION ALL SELECT c.node, t.id, t.parent FROM c JOIN tree t ON t.id = c.nxt) SELECT ancestor AS root, CASE WHEN count(*) <= 16 THEN count(*) ELSE 0 END AS n, count(*) <= 16 AS ok FROM c WHERE ancestor <> 0 GROUP BY 1")
def descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.ancestors(_tree(spark, d)), 16).select("root", F.size("ids").cast("long").alias("n"), "ok")


_GAPS = f"""{LOG}, f AS (SELECT session_id, min(message_id) AS first_id FROM qlog GROUP BY 1), c AS (SELECT *, sha256({_qnorm('query_text')}) AS hash FROM qlog WHERE answer_status IN ('NO_RESULT', 'REFUSAL')),
g AS (SELECT hash, min(query_text) AS raw, count(DISTINCT message_id) AS asks, min(date_diff('day', CAST(created_at AS DATE), DATE '2024-02-01')) AS days, CASE WHEN bool_or(answer_status = 'REFUSAL') THEN 'refusal' ELSE 'no_result' END AS kind, min(message_id) AS message_id FROM c GROUP BY 1)"""


@query("open_gaps", f"WITH {_GAPS} SELECT hash, raw, asks, days, kind, message_id FROM g WHERE hash NOT IN (SELECT sha256({_qnorm('query_text')}) FROM qlog WHERE answer_status IN ('NO_RESULT', 'REFUSAL') AND k % 10 = 3)")
def open_gaps(spark: SparkSession, d: str) -> DataFrame:
    log = qlog(spark, d)
    closed = log.where("answer_status IN ('NO_RESULT', 'REFUSAL') AND k % 10 = 3").select(text.question_hash(F.col("query_text")).alias("hash")).distinct()
    out = gaps.open_gaps(log, closed, F.lit("2024-02-01").cast("date"))
    return out.withColumn("days", F.col("days").cast("long"))


@query("leader_clusters")
def leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return gaps.leader_clusters(e.select(F.col("vec_id").cast("string").alias("hash"), F.col("embedding").alias("vector"), (F.col("vec_id") % 5).alias("weight")), 0.5)


@query("text_leader_clusters")
def text_leader_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Turns of users, by their first words' two-grams."""
    turns = read(spark, d, "conversations").where("role = 'user'")
    return gaps.text_leader_clusters(turns.select(F.format_string("%012d-%06d", "conv_id", "turn").alias("hash"), "text", (F.col("conv_id") % 3).alias("weight")))


_SCORES = "sc AS (SELECT l.doc_id, quality AS label, round(n_chars / 100) / 10 AS score FROM labels l JOIN documents USING (doc_id))"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "labels").join(docs(spark, d), "doc_id").select("doc_id", F.col("quality").alias("label"), (F.round(F.col("n_chars") / 100) / 10).alias("score"))


@query("auc", f"WITH {_SCORES}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM sc), n AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q, sum(r) FILTER (label = 1) AS s FROM r) SELECT round((s - p * (p + 1) / 2) / (p * q), 6) AS auc, p AS positives, q AS negatives FROM n")
def auc(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.auc(_scores(spark, d))


@query("youden_threshold", f"WITH {_SCORES}, p AS (SELECT score AS threshold, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM sc GROUP BY 1), j AS (SELECT threshold, round(sum(p) OVER u / sum(p) OVER () - sum(n) OVER u / sum(n) OVER (), 9) AS j FROM p WINDOW u AS (ORDER BY threshold ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT threshold, round(j, 6) AS j FROM j ORDER BY j.j DESC, threshold LIMIT 1")
def youden_threshold(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.youden_threshold(_scores(spark, d))


_RANKS = "rk AS (SELECT o_orderkey AS qid, o_orderpriority AS stratum, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 12 + 1 END AS rank FROM orders)"


@query("recall_mrr", f"WITH {_RANKS} SELECT stratum, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_3, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10, round(avg(CASE WHEN rank IS NOT NULL THEN 1 / rank ELSE 0.0 END), 6) AS mrr, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS found_rate FROM rk GROUP BY 1")
def recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return evaluation.ranking_summary(read(spark, d, "orders").select(F.col("o_orderpriority").alias("stratum"), F.when(k % 9 != 0, k % 12 + 1).alias("rank")), by=["stratum"])


@query("ndcg", "WITH r AS (SELECT l_orderkey AS qid, l_partkey, CAST(l_quantity AS INT) % 4 AS relevance, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity) AS rank FROM lineitem), i AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC, rank) AS ideal FROM r), s AS (SELECT qid, sum(CASE WHEN rank <= 10 THEN relevance / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN ideal <= 10 THEN relevance / log2(ideal + 1) ELSE 0 END) AS idcg FROM i GROUP BY 1) SELECT qid, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM s")
def ndcg(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    return evaluation.ndcg(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("qid"), (F.col("l_quantity").cast("int") % 4).alias("relevance"), rank.alias("rank")))


@query("mcnemar_counts", "SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS both, count(*) FILTER (quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (quality = 0 AND toxic = 1) AS only_b, count(*) FILTER (quality = 0 AND toxic = 0) AS neither FROM labels")
def mcnemar_counts(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.mcnemar(read(spark, d, "labels"), "quality", "toxic").drop("p")


@query("score_summary", f"WITH {LOG}, s AS (SELECT answer_status, list_sort(list(top_score)) AS s FROM qlog GROUP BY 1), a AS (SELECT answer_status, count(top_score) AS n, min(top_score) AS min, max(top_score) AS max, round(avg(top_score), 6) AS mean, round(median(top_score), 6) AS median, round(stddev_pop(top_score), 6) AS pstdev FROM qlog GROUP BY 1) SELECT a.*, s[CAST(ceil(round(0.25 * len(s), 9)) AS INT)] AS p25, s[CAST(ceil(round(0.5 * len(s), 9)) AS INT)] AS p50, s[CAST(ceil(round(0.75 * len(s), 9)) AS INT)] AS p75, s[CAST(ceil(round(0.9 * len(s), 9)) AS INT)] AS p90 FROM a JOIN s USING (answer_status)")
def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.score_summary(qlog(spark, d), "top_score", ["answer_status"])


_NEAR = "abs(low - (mean - 1.96 * se)) <= 0.2 * se AND abs(high - (mean + 1.96 * se)) <= 0.2 * se"


@query("bootstrap_ci", f"WITH {LOG} SELECT count(top_score) AS n, round(avg(top_score), 6) AS mean, true AS near FROM qlog")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """The mean score's interval over rows; ``near``: both ends lie within a fifth of a standard error of the normal interval's."""
    log = qlog(spark, d)
    se = log.agg((F.stddev_pop("top_score") / F.sqrt(F.count("top_score"))).alias("se"))
    out = evaluation.bootstrap_ci(log, "top_score", "message_id", 2000).crossJoin(se)  # one row a side
    return out.select("n", F.round("mean", 6).alias("mean"), F.expr(_NEAR).alias("near"))


@query("clustered_bootstrap", "WITH c AS (SELECT avg(l_extendedprice) AS x FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS n, round(avg(x), 2) AS mean, true AS near FROM c")
def clustered_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """The interval over orders' mean prices."""
    lines = read(spark, d, "lineitem")
    se = lines.groupBy("l_orderkey").agg(F.avg("l_extendedprice").alias("x")).agg((F.stddev_pop("x") / F.sqrt(F.count("x"))).alias("se"))
    out = evaluation.clustered_bootstrap(lines, "l_extendedprice", "l_orderkey", 2000).crossJoin(se)
    return out.select("n", F.round("mean", 2).alias("mean"), F.expr(_NEAR).alias("near"))


@query("judge_agreement", f"WITH {LOG}, p AS (SELECT k % 6 AS j, (k * 7) % 6 AS h FROM qlog), c AS (SELECT count(*) AS n, round(avg(abs(j - h)), 6) AS mae, round(avg(CASE WHEN abs(j - h) <= 1 THEN 1.0 ELSE 0.0 END), 6) AS within_one, count(*) FILTER (j >= 4 AND h >= 4) AS tp, count(*) FILTER (j >= 4 AND h < 4) AS fp, count(*) FILTER (j < 4 AND h >= 4) AS fn FROM p) SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c")
def judge_agreement(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.agreement(qlog(spark, d).select((F.col("k") % 6).alias("j"), (F.col("k") * 7 % 6).alias("h")), "j", "h", 4)


@query("orphan_audit", f"WITH {DOCS}, s AS (SELECT chunk_id, CASE WHEN part_id % 10 = 0 THEN NULL ELSE doc_id * 10 + part_id % 9 END AS parent FROM chunk WHERE chunk_index > 1), p AS (SELECT chunk_id, min(is_active) AS is_active, CASE WHEN chunk_id % 4 = 0 THEN 'text_chunk' ELSE 'procedure_parent' END AS chunk_type FROM chunk WHERE chunk_index = 1 GROUP BY chunk_id) SELECT CASE WHEN parent IS NULL THEN 'NULL_PARENT' WHEN p.chunk_id IS NULL THEN 'PARENT_NOT_FOUND' WHEN p.is_active <> 1 THEN 'PARENT_DEACTIVATED' WHEN chunk_type <> 'procedure_parent' THEN 'PARENT_WRONG_TYPE:' || chunk_type END AS reason, count(*) AS n FROM s LEFT JOIN p ON p.chunk_id = s.parent GROUP BY 1 HAVING reason IS NOT NULL")
def orphan_audit(spark: SparkSession, d: str) -> DataFrame:
    c = chunk(spark, d)
    cards = c.where("chunk_index > 1").select("chunk_id", F.when(F.col("part_id") % 10 != 0, F.col("doc_id") * 10 + F.col("part_id") % 9).alias("parent_chunk_id"))
    parents = c.where("chunk_index = 1").groupBy("chunk_id").agg(F.min("is_active").alias("is_active")).withColumn("chunk_type", F.when(F.col("chunk_id") % 4 == 0, "text_chunk").otherwise("procedure_parent"))
    return audits.orphan_audit(cards, parents).groupBy("reason").agg(F.count("*").alias("n"))


@query("sequence_gaps", f"WITH {DOCS}, g AS (SELECT doc_id AS parent, min(chunk_index) AS first, max(chunk_index) AS last, count(DISTINCT chunk_index) AS distinct_steps, count(*) FILTER (chunk_index IS NULL) AS null_steps FROM chunk GROUP BY 1) SELECT *, last - distinct_steps AS missing FROM g WHERE first <> 1 OR last - distinct_steps > 0")
def sequence_gaps(spark: SparkSession, d: str) -> DataFrame:
    return audits.sequence_gaps(chunk(spark, d).select(F.col("doc_id").alias("parent"), F.col("chunk_index").alias("step_no")))


@query("missing_steps", f"WITH {DOCS}, l AS (SELECT doc_id AS parent, max(chunk_index) AS last FROM chunk GROUP BY 1), a AS (SELECT parent, CAST(unnest(range(1, last + 1)) AS INT) AS step_no FROM l) SELECT parent, step_no FROM a WHERE NOT EXISTS (SELECT 1 FROM chunk c WHERE c.doc_id = parent AND c.chunk_index = step_no)")
def missing_steps(spark: SparkSession, d: str) -> DataFrame:
    return audits.missing_steps(chunk(spark, d).select(F.col("doc_id").alias("parent"), F.col("chunk_index").alias("step_no")))


@query("parent_balance", f"WITH {DOCS}, b AS (SELECT doc_id, version_no, count(*) FILTER (part_id % 3 > 0) AS steps, count(*) FILTER (part_id % 3 = 0) AS parents FROM chunk GROUP BY 1, 2) SELECT *, CASE WHEN parents = 0 THEN 'missing' ELSE 'duplicate' END AS state FROM b WHERE steps > 0 AND parents <> 1")
def parent_balance(spark: SparkSession, d: str) -> DataFrame:
    return audits.parent_balance(chunk(spark, d).withColumn("chunk_type", F.when(F.col("part_id") % 3 == 0, "procedure_parent").otherwise("step_card")))


@query("json_compliance", "SELECT count(*) AS elements, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS compliant, round(count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) / count(*), 6) AS share FROM events")
def json_compliance(spark: SparkSession, d: str) -> DataFrame:
    return audits.json_compliance(read(spark, d, "events").select(F.concat(F.lit("["), "props", F.lit("]")).alias("refs")), "refs", ["k"])


@query("rebuild_eligibility", f"WITH {DOCS} SELECT CASE WHEN is_active <> 1 THEN 'inactive' WHEN index_status = 'NOT_INDEXED' THEN 'already_claimable' WHEN part_id % 7 = 0 THEN 'doc_not_active' WHEN part_id % 7 = 1 THEN 'version_deleting' WHEN part_id % 7 = 2 THEN 'stage3_running' ELSE 'eligible' END AS skip_reason, count(*) AS n FROM chunk GROUP BY 1")
def rebuild_eligibility(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("part_id") % 7
    rows = chunk(spark, d).withColumns({"chunk_status": F.col("index_status"), "doc_status": F.when(p == 0, "retired").otherwise("Active"), "version_deleting": p == 1, "stage3_running": p == 2})
    return audits.rebuild_eligibility(rows).groupBy("skip_reason").agg(F.count("*").alias("n"))


@query("index_health", f"WITH {DOCS} SELECT version_no, CASE WHEN x < a THEN 'loss' WHEN x = a THEN 'exact' WHEN x - a <= greatest(5, a * 0.005) THEN 'tolerated' ELSE 'surplus' END AS state FROM (SELECT version_no, count(*) FILTER (index_status = 'INDEXED') AS x, count(*) FILTER (is_active = 1) AS a FROM chunk GROUP BY 1)")
def index_health(spark: SparkSession, d: str) -> DataFrame:
    c = chunk(spark, d).groupBy("version_no").agg(F.count_if(F.col("index_status") == "INDEXED").alias("x"), F.count_if(F.col("is_active") == 1).alias("a"))
    return c.select("version_no", reconcile.index_health(F.col("x"), F.col("a")).alias("state"))


@query("exact_duplicates_by_sha", "WITH s AS (SELECT doc_id, source, sha256(text) AS h FROM documents) SELECT a.doc_id, min(b.doc_id) AS incumbent, CASE WHEN a.source = 'src0' THEN 'warn' ELSE 'skip' END AS action FROM s a JOIN s b ON a.h = b.h AND b.doc_id < a.doc_id GROUP BY a.doc_id, a.source")
def exact_duplicates_by_sha(spark: SparkSession, d: str) -> DataFrame:
    """Later copies of a text: skipped if all who may read them may read the first, else kept with a warning."""
    from quarry.functions.acl import covers

    s = docs(spark, d).select("doc_id", "source", F.sha2("text", 256).alias("h"))
    first = s.groupBy("h").agg(F.min("doc_id").alias("incumbent"))
    later = s.join(first, "h").where("doc_id > incumbent")
    wide = covers(F.lit("dept_internal"), F.lit("src0"), F.when(F.col("source") == "src0", "public").otherwise("dept_internal"), F.lit("src0"))
    return later.select("doc_id", "incumbent", F.when(wide, "skip").otherwise("warn").alias("action"))


@query("bulk_batches", """WITH RECURSIVE b AS (SELECT CAST(doc_id AS VARCHAR) AS id, CAST(strlen(CAST(json_object('doc_id', doc_id, 'text', text) AS VARCHAR)) + 1 AS BIGINT) AS bytes FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY id) AS n FROM b), f AS (SELECT n, bytes, 0 AS batch_no, bytes AS used FROM r WHERE n = 1
UNION ALL SELECT r.n, r.bytes, CASE WHEN used + r.bytes > 20000 THEN batch_no + 1 ELSE batch_no END, CASE WHEN used + r.bytes > 20000 THEN r.bytes ELSE used + r.bytes END FROM f JOIN r ON r.n = f.n + 1)
SELECT CAST(batch_no AS BIGINT) AS batch_no, count(*) AS n_rows, CAST(sum(bytes) AS BIGINT) AS n_bytes FROM f GROUP BY 1""")
def bulk_batches(spark: SparkSession, d: str) -> DataFrame:
    from quarry.sources.sinks import bulk_batches as batches

    return batches(docs(spark, d).select("doc_id", "text"), "doc_id", 20_000).select("batch_no", "n_rows", "n_bytes")


@query("stratified_sample", "SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('7|' || doc_id), doc_id) AS n FROM documents) WHERE n <= 20")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twenty documents of each language."""
    return evaluation.stratified_sample(docs(spark, d), "lang", "doc_id", 20).select("lang", "doc_id")


@query("upsert_latest", f"WITH {LOG}, c AS (SELECT user_id, arg_max(message_id, message_id) AS last_id FROM qlog WHERE k < 50 GROUP BY 1) SELECT u.user_id, coalesce(c.last_id, -1) AS last_id FROM (SELECT DISTINCT user_id FROM qlog) u LEFT JOIN c USING (user_id)")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    from quarry.sources.sinks import upsert

    log = qlog(spark, d)
    target = log.select("user_id").distinct().withColumn("last_id", F.lit(-1).cast("long"))
    return upsert(target, log.where("k < 50").select("user_id", F.col("message_id").alias("last_id")), ["user_id"], F.col("last_id"))
