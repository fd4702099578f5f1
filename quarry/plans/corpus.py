"""Operators on texts, chunks, answers, grants and reviews, over inputs that are made of the given tables row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import answers, arrow, redact, status, text
from quarry.operators import audits, chunking, evaluation, gaps, reconcile, retrieval
from quarry.plans.registry import query
from quarry.plans.views import DOCS, LOG, chunk, qlog
from quarry.sources import files
from quarry.sources.tables import read

# Sources.


@query("inventory_of_orders", """WITH o AS (SELECT o_orderkey AS k, 'raw/' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.zip' ELSE '.pdf' END AS key, CAST(o_custkey AS VARCHAR) AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'e' || o_orderkey % 7 END AS etag, CAST(o_orderdate AS DATE) AS day, o_orderkey % 3 = 0 AS self FROM orders),
r AS (SELECT * FROM o WHERE k % 2 = 0), f AS (SELECT o.*, date_diff('day', day, DATE '1998-06-01') AS age FROM o WHERE k % 2 = 1)
SELECT class, count(*) AS n FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.doc_id = f.doc_id AND r.etag = f.etag) THEN 'expected_reject' WHEN self AND age > 7 THEN 'self_serve_orphan' WHEN key LIKE '%.zip' THEN 'policy_rejected' ELSE 'unregistered' END AS class FROM f) GROUP BY 1""")
def inventory_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as uploaded objects, every second one registered."""
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select(
        k.alias("k"), F.concat(F.lit("raw/"), k.cast("string"), F.when(k % 4 == 0, ".zip").otherwise(".pdf")).alias("key"), F.col("o_custkey").cast("string").alias("doc_id"),
        F.when(k % 5 != 0, F.concat(F.lit("e"), (k % 7).cast("string"))).alias("etag"), F.col("o_orderdate").alias("last_modified"), (k % 3 == 0).alias("self_serve"),
    )
    found = files.classify_inventory(o.where("k % 2 = 1"), o.where("k % 2 = 0").select("key", "doc_id", "etag"), F.lit("1998-06-01"))
    return found.groupBy("class").agg(F.count("*").alias("n"))


_TALK = "t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '[\\s|#,;\"]+', ' ', 'g')) AS said FROM conversations)"


def _talk(spark: SparkSession, d: str) -> DataFrame:
    """Turns with their text as one plain line."""
    return read(spark, d, "conversations").select("conv_id", "turn", "role", F.trim(F.regexp_replace("text", "[\\s|#,;\"]+", " ")).alias("said"))


def _lines(rows: DataFrame, line, glue: str = "\n", by: str = "conv_id", order: str = "turn") -> DataFrame:
    """One text per key, of a line per row."""
    each = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("x"))
    return each.select(F.col(by).cast("string").alias("doc_id"), F.lit(1).alias("version_no"), F.array_join(F.transform("x", lambda r: r["line"]), glue).alias("text"))


@query("blocks_of_talks", f"WITH {_TALK} SELECT CAST(conv_id AS VARCHAR) AS doc_id, 'heading' AS block_type, '## ' || role AS text, 2 AS level, count(*) AS n FROM t GROUP BY conv_id, role UNION ALL SELECT CAST(conv_id AS VARCHAR), 'paragraph', said, NULL, count(*) FROM t WHERE said <> '' GROUP BY conv_id, said")
def blocks_of_talks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as headed paragraphs, read back as blocks."""
    body = F.concat(F.lit("## "), "role", F.lit("\n"), "said", F.lit("\n"))
    blocks = files.markdown_blocks(_lines(_talk(spark, d), body))
    return blocks.groupBy("doc_id", "block_type", "text", "level").agg(F.count("*").alias("n"))


@query("csv_of_talks", f"WITH {_TALK} SELECT CAST(conv_id AS VARCHAR) AS doc_id, 'conv | turn | role' || chr(10) || string_agg(conv_id || ' | ' || turn || ' | ' || role, chr(10) ORDER BY turn) AS out FROM t GROUP BY 1")
def csv_of_talks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations written as comma-separated rows, read back as lines of cells."""
    rows = _lines(_talk(spark, d), F.concat_ws(", ", "conv_id", "turn", "role"), "\r\n")
    return rows.select("doc_id", files.csv_text(F.concat(F.lit("conv,turn,role\r\n\r\n"), "text")).alias("out"))


@query("decoded_documents", "SELECT doc_id, md5(text) AS digest FROM documents")
def decoded_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents as bytes, every second one with a byte-order mark, read back as text."""
    raw = F.encode("text", "UTF-8")
    marked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.unhex(F.lit("EFBBBF")), raw)).otherwise(raw)
    return read(spark, d, "documents").select("doc_id", F.md5(files.decode_text(marked).cast("binary")).alias("digest"))


# Entities, in texts written from customers.


def _cards(spark: SparkSession, d: str) -> DataFrame:
    """Customers with a telephone, a mail address and a long number, which every third calls an order."""
    k = F.col("c_custkey").cast("string")
    number = F.concat(F.lit("622202"), F.lpad(k, 13, "0"))
    said = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("订单号 "), number)).otherwise(F.concat(F.lit("卡号 "), number))
    return read(spark, d, "customer").select("c_custkey", F.concat(F.lit("电话138"), F.lpad(k, 8, "0"), F.lit("，邮箱 user"), k, F.lit("@x.com，"), F.repeat(F.lit("　"), 30), said).alias("text"))


_PHONE, _NUMBER = "'138' || lpad(CAST(c_custkey AS VARCHAR), 8, '0')", "'622202' || lpad(CAST(c_custkey AS VARCHAR), 13, '0')"


@query("entities_of_customers", "SELECT c_custkey, 1 AS phones, 1 AS mails, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 1 END AS cards FROM customer")
def entities_of_customers(spark: SparkSession, d: str) -> DataFrame:
    """A long number that is called an order is no card."""
    found = redact.detect(F.col("text"))
    count = lambda k: F.coalesce(F.try_element_at(found, F.lit(k)).cast("int"), F.lit(0))
    return _cards(spark, d).select("c_custkey", count("cn_mobile").alias("phones"), count("email").alias("mails"), count("bank_card").alias("cards"))


@query("masked_customers", f"SELECT c_custkey, '电话138****' || right({_PHONE}, 4) || '，邮箱 us***@x.com，' || repeat('　', 30) || CASE WHEN c_custkey % 3 = 0 THEN '订单号 ' || {_NUMBER} ELSE '卡号 6222****' || right({_NUMBER}, 4) END AS out FROM customer")
def masked_customers(spark: SparkSession, d: str) -> DataFrame:
    return _cards(spark, d).select("c_custkey", redact.scrub(F.col("text"), images=False)["text"].alias("out"))


@query("redacted_customers", f"SELECT c_custkey, '电话[CN_MOBILE]，邮箱 [EMAIL]，' || repeat('　', 30) || CASE WHEN c_custkey % 3 = 0 THEN '订单号 ' ELSE '卡号 ' END || '[BANK_CARD]' AS out, 0 AS residual FROM customer")
def redacted_customers(spark: SparkSession, d: str) -> DataFrame:
    """Redaction takes what looks like a card whatever it is called, and nothing is found in what it leaves."""
    out = _cards(spark, d).withColumn("out", redact.redact(F.col("text")))
    return out.select("c_custkey", "out", F.size(redact.residual(F.col("out"))).alias("residual"))


@query("risks_of_customers", "SELECT 'medium' AS risk, 'redact' AS action, count(*) AS n FROM customer")
def risks_of_customers(spark: SparkSession, d: str) -> DataFrame:
    return redact.risk_decision(_cards(spark, d)).groupBy("risk", "action").agg(F.count("*").alias("n"))


# Answers of the log.

_SAID = "CASE answer_status WHEN 'NO_RESULT' THEN '抱歉，知识库中没有这项内容' WHEN 'REFUSAL' THEN repeat('可以。', 40) || '但是未找到第二项' WHEN 'SUCCESS' THEN '1. 打开' || chr(10) || '2、关闭' || chr(10) || repeat('<<IMG: 3>>', CAST(k % 3 AS INT)) || CASE WHEN k % 5 = 0 THEN '参考来源：甲' ELSE '' END END"


@query("answers_of_the_log", f"WITH {LOG} SELECT message_id, answer_status IN ('NO_RESULT', 'REFUSAL') AS refuses, answer_status = 'NO_RESULT' AS wholly, answer_status = 'SUCCESS' AND k % 5 = 0 AS leaks, CASE WHEN answer_status = 'SUCCESS' THEN CAST(k % 3 AS INT) ELSE 0 END AS images, CASE WHEN answer_status = 'SUCCESS' THEN 2 ELSE 0 END AS steps FROM qlog")
def answers_of_the_log(spark: SparkSession, d: str) -> DataFrame:
    """Answers by what they decline, leak and show."""
    t = F.expr(_SAID.replace("chr(10)", "'\\n'"))
    return qlog(spark, d).select("message_id", answers.refuses(t).alias("refuses"), answers.refuses_wholly(t).alias("wholly"), answers.leaks_sources(t).alias("leaks"), answers.image_marks(t).cast("int").alias("images"), answers.numbered_steps(t).cast("int").alias("steps"))


@query("sums_of_lines", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) + l_linenumber * 3 - 2 ** 3 AS value FROM lineitem")
def sums_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Sums written out, worked out again."""
    said = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("+"), F.col("l_linenumber").cast("string"), F.lit("×3-2**3=?"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", answers.arithmetic(said).alias("value"))


@query("common_substrings_of_parts", "SELECT p_partkey, CAST(max(CASE WHEN contains(p_type, substr(p_name, s + 1, n)) THEN n ELSE 0 END) AS INT) AS length FROM part, LATERAL (SELECT unnest(range(0, length(p_name))) AS s), LATERAL (SELECT unnest(range(1, length(p_name) - s + 1)) AS n) GROUP BY 1")
def common_substrings_of_parts(spark: SparkSession, d: str) -> DataFrame:
    """The longest run that a part's name and type share."""
    return read(spark, d, "part").select("p_partkey", arrow.longest_common_substring(F.col("p_name"), F.col("p_type")).cast("int").alias("length"))


@query("prose_tables_of_talks", f"WITH {_TALK} SELECT conv_id, turn, false AS prose FROM t")
def prose_tables_of_talks(spark: SparkSession, d: str) -> DataFrame:
    """No row of two short cells is prose in a table."""
    row = F.concat("role", F.lit(" | "), F.substring("said", 1, 20))
    return _talk(spark, d).select("conv_id", "turn", text.is_prose_table(row).alias("prose"))


# Chunks.


@query("faq_of_talks", f"WITH {_TALK}, a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n, left(said, 40) AS said FROM t WHERE said <> '') SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(n AS INT) AS chunk_index, 'faq_chunk' AS chunk_type, '问：第' || turn || '问' || chr(10) || '答：' || trim(said) AS chunk_text FROM a")
def faq_of_talks(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as the answer to a numbered question."""
    said = F.concat(F.lit("问：第"), F.col("turn").cast("string"), F.lit("问\n答："), F.trim(F.substring("said", 1, 40)))
    docs = _lines(_talk(spark, d).where("said <> ''"), said)
    return chunking.chunk_documents(docs, "faq").select("doc_id", "chunk_index", "chunk_type", "chunk_text")


_ITEMS = "i AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n) AS p FROM i)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their distinct line numbers, numbered from 1."""
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n")).distinct()
    return rows.withColumn("p", F.row_number().over(Window.partitionBy("k").orderBy("n")))


@query("clauses_of_orders", f"WITH {_ITEMS} SELECT CAST(k AS VARCHAR) AS doc_id, CAST(p - 1 AS INT) AS chunk_index, 'clause_chunk' AS chunk_type, CAST(p AS VARCHAR) AS section_title, p || '、条款内容' || n AS chunk_text FROM r")
def clauses_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as clauses, cut at their numbers."""
    docs = _lines(_items(spark, d), F.concat(F.col("p").cast("string"), F.lit("、条款内容"), F.col("n").cast("string")), by="k", order="p")
    return chunking.chunk_documents(docs, "clause").select("doc_id", "chunk_index", "chunk_type", "section_title", "chunk_text")


@query("steps_of_orders", f"WITH {_ITEMS}, m AS (SELECT k FROM r GROUP BY k HAVING count(*) >= 2) SELECT CAST(k AS VARCHAR) AS doc_id, 'step_card' AS chunk_type, CAST(p AS VARCHAR) AS section_title, 'STEP ' || p || ': 拧紧螺丝' || n AS chunk_text FROM r JOIN m USING (k)")
def steps_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as steps: the cards of orders with two steps or more."""
    items = _items(spark, d)
    several = items.groupBy("k").agg(F.count("*").alias("many")).where("many >= 2").select("k")
    docs = _lines(items.join(several, "k"), F.concat(F.lit("STEP "), F.col("p").cast("string"), F.lit(": 拧紧螺丝"), F.col("n").cast("string")), by="k", order="p")
    return chunking.chunk_documents(docs, "step").where("chunk_type = 'step_card'").select("doc_id", "chunk_type", "section_title", "chunk_text")


@query("children_of_orders", "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(i AS INT) AS chunk_index, CASE i WHEN 0 THEN 'text_chunk' ELSE 'child_chunk' END AS chunk_type, CASE i WHEN 0 THEN repeat('甲', 100) WHEN 3 THEN repeat('甲', 20) ELSE repeat('甲', 60) END AS chunk_text FROM orders, LATERAL (SELECT unnest(range(0, 4)) AS i)")
def children_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """A parent of a hundred characters and its children of sixty that overlap by twenty, for every order."""
    docs = read(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("version_no"), F.repeat(F.lit("甲"), 100).alias("text"))
    return chunking.chunk_documents(docs, "default", chunking.ChunkConfig(parent_child=True, child_chars=60, child_overlap=20)).select("doc_id", "chunk_index", "chunk_type", "chunk_text")


@query("slides_of_talks", f"WITH {_TALK} SELECT CAST(conv_id AS VARCHAR) AS doc_id, CAST(turn AS VARCHAR) AS section_title, CASE WHEN role = 'system' THEN 'table_chunk' ELSE 'text_chunk' END AS chunk_type, '# ' || role || chr(10) || left(said, 200) AS chunk_text FROM t WHERE said <> ''")
def slides_of_talks(spark: SparkSession, d: str) -> DataFrame:
    """Turns as pages of two blocks, one chunk a page."""
    t = _talk(spark, d).where("said <> ''")
    kind = F.when(F.col("role") == "system", "table").otherwise("paragraph")
    pair = F.array(F.struct((F.col("turn") * 2).cast("int").alias("block_no"), F.lit("heading").alias("block_type"), F.concat(F.lit("# "), "role").alias("text")), F.struct((F.col("turn") * 2 + 1).cast("int").alias("block_no"), kind.alias("block_type"), F.substring("said", 1, 200).alias("text")))
    blocks = t.select(F.col("conv_id").cast("string").alias("doc_id"), F.lit(1).alias("version_no"), F.explode(pair).alias("b"), F.col("turn").cast("int").alias("page_num")).select("doc_id", "version_no", "b.*", "page_num")
    return chunking.chunk_blocks(blocks, "slide").select("doc_id", "section_title", "chunk_type", "chunk_text")


@query("headers_of_lines", "SELECT l_orderkey AS doc_id, min(n) AS chunk_index FROM (SELECT l_orderkey, l_linenumber % 3 AS file, l_orderkey * 0 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) GROUP BY l_orderkey, file")
def headers_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Page headers of three files within an order: the first of each stays."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    body = F.concat(F.lit("文件 "), (F.col("l_linenumber") % 3).cast("string"), F.lit(" | 第 "), F.col("chunk_index").cast("string"), F.lit(" 页"))
    rows = read(spark, d, "lineitem").withColumn("chunk_index", n.cast("long")).select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("version_no"), "chunk_index", F.lit("table_chunk").alias("chunk_type"), body.alias("chunk_text"), F.lit(False).alias("has_images"))
    return chunking.drop_repeated_headers(rows).select("doc_id", "chunk_index")


@query("titles_of_documents", "WITH p AS (SELECT doc_id, text, lang, source, '【部门:' || source || ' | 文档:' || lang || doc_id || ' | 章节:S】' AS whole, least(100, greatest(20, CAST(floor(length(text) * 0.3) AS INT))) AS n FROM documents) SELECT doc_id, CASE WHEN length(whole) > n THEN substr(whole, 1, n - 1) || '】' || chr(10) ELSE whole || chr(10) END AS prefix, CASE WHEN doc_id % 3 = 0 THEN 'own' WHEN contains(text, lang) THEN lang END AS title FROM p")
def titles_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document's context line, cut to its length, and its section's title."""
    docs = read(spark, d, "documents")
    prefix = chunking.context_prefix(F.col("source"), F.concat("lang", F.col("doc_id").cast("string")), F.lit("S"), F.col("text"))
    own = F.when(F.col("doc_id") % 3 == 0, "own")
    return docs.select("doc_id", prefix.alias("prefix"), chunking.section_title(own, F.col("lang"), F.col("text")).alias("title"))


@query("leaning_chunks", "SELECT l_orderkey AS doc_id, count(*) AS prose, count(*) FILTER (l_quantity > 25 AND l_linenumber % 2 = 0) AS dangling, round(count(*) FILTER (l_quantity > 25 AND l_linenumber % 2 = 0) / count(*), 6) AS rate FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def leaning_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Lines as chunks: prose that leans on what came before and has no title of its own."""
    q, n = F.col("l_quantity") > 25, F.col("l_linenumber") % 2 == 0
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", "table_chunk").otherwise("text_chunk").alias("chunk_type"), F.when(q, "【部门:D】该设备").otherwise("设备").alias("chunk_text"), F.when(~n, "标题").alias("section_title"))
    return chunking.self_contained(rows)


@query("routes_of_orders", "WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'faq' WHEN 1 THEN 'step' ELSE 'clause' END AS mode FROM orders), c AS (SELECT l_orderkey, max(CASE WHEN l_returnflag = 'R' AND m.mode = 'faq' OR l_returnflag = 'A' AND m.mode = 'step' OR l_returnflag = 'N' AND m.mode = 'clause' THEN 1 ELSE 0 END) AS fits, any_value(m.mode) AS mode FROM lineitem JOIN o m ON m.o_orderkey = l_orderkey GROUP BY 1) SELECT mode, count(*) AS docs, CAST(sum(fits) AS BIGINT) AS fitting FROM c GROUP BY 1")
def routes_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders by the way they were cut, and those with a chunk of a kind that it gives."""
    mode = F.when(F.col("l_orderkey") % 3 == 0, "faq").when(F.col("l_orderkey") % 3 == 1, "step").otherwise("clause")
    kind = F.when(F.col("l_returnflag") == "R", "faq_chunk").when(F.col("l_returnflag") == "A", "step_card").otherwise("clause_chunk")
    known = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return chunking.routing_fit(read(spark, d, "lineitem").join(known, "l_orderkey", "left_semi").select(mode.alias("mode"), F.col("l_orderkey").cast("string").alias("doc_id"), kind.alias("chunk_type")))


@query("images_of_orders", "SELECT CAST(l_orderkey AS VARCHAR) AS chunk_id, CAST(count(*) AS INT) AS refs, round(count(*) / count(DISTINCT l_partkey % 3), 4) AS factor FROM lineitem GROUP BY 1")
def images_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """References of an order's lines to one of three images."""
    ref = F.to_json(F.struct((F.col("l_partkey") % 3).cast("string").alias("image_index")))
    rows = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("chunk_id")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(ref), ","), F.lit("]")).alias("image_refs_json"))
    return chunking.image_binding(rows).select("chunk_id", F.col("refs").cast("int").alias("refs"), "factor")


# Retrieval.


@query("steps_around_lines", f"WITH {_ITEMS}, h AS (SELECT k AS query_id, CASE k % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'locate' WHEN 2 THEN 'specific' ELSE 'general' END AS intent, max(p) // 2 + 1 AS mid FROM r GROUP BY k) SELECT query_id, CAST(p AS INT) AS step_no FROM h JOIN r ON r.k = query_id WHERE p = mid OR CASE intent WHEN 'full' THEN p <= 3 WHEN 'locate' THEN false WHEN 'specific' THEN p = mid + 1 ELSE abs(p - mid) = 1 END")
def steps_around_lines(spark: SparkSession, d: str) -> DataFrame:
    """The steps that a hit on an order's middle one brings along, by what was asked."""
    items = _items(spark, d)
    steps = items.select(F.concat_ws("-", "k", "p").alias("chunk_id"), F.col("k").cast("string").alias("parent_chunk_id"), F.col("p").alias("step_no"), F.lit("public").alias("permission_level"), F.lit("o").alias("owner_dept"), "k")
    middle = items.groupBy("k").agg(F.floor(F.max("p") / 2).cast("int").alias("half")).withColumn("p", F.col("half") + 1)
    intent = F.when(F.col("k") % 4 == 0, "full").when(F.col("k") % 4 == 1, "locate").when(F.col("k") % 4 == 2, "specific").otherwise("general")
    hits = middle.select("k", F.col("p").alias("step_no")).join(steps, ["k", "step_no"]).select(F.col("k").alias("query_id"), intent.alias("intent"), "chunk_id", "parent_chunk_id", "step_no", "permission_level", "owner_dept")
    return retrieval.expand_steps(hits, steps.drop("k"), 3).select("query_id", F.col("step_no").cast("int").alias("step_no"))


@query("image_ties_of_orders", "WITH r AS (SELECT l_orderkey AS query_id, l_linenumber * 1000000 + l_partkey AS pk, l_returnflag = 'R' AS is_image, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rank FROM lineitem) SELECT query_id, pk, row_number() OVER (PARTITION BY query_id ORDER BY is_image DESC, rank) AS rank FROM r")
def image_ties_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Hits of almost one score: all images come first, else in the old order."""
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") * F.lit(1000000) + F.col("l_partkey")).alias("pk"), rank.cast("long").alias("rank"), (1.0 - F.col("l_linenumber") * 1e-6).alias("score"), (F.col("l_returnflag") == "R").alias("is_image"))
    return retrieval.image_tie_break(rows, 0.01).select("query_id", "pk", "rank")


@query("contexts_of_orders", f"""WITH {DOCS}, c AS (SELECT doc_id, chunk_index, min(qty) AS qty FROM chunk GROUP BY 1, 2),
a AS (SELECT doc_id % 50 AS query_id, doc_id * 10 + chunk_index AS pk, doc_id, chunk_index, qty FROM c WHERE doc_id % 7 = 0),
f AS (SELECT *, CASE WHEN max(qty) OVER q > min(qty) OVER q THEN (qty - min(qty) OVER q) / (max(qty) OVER q - min(qty) OVER q) ELSE 1.0 END AS fused FROM a WINDOW q AS (PARTITION BY query_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, CAST(pk AS VARCHAR)) AS rank FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) AS nth FROM k),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS position FROM o WHERE nth = 1)
SELECT s.query_id, CAST(s.pk AS VARCHAR) AS pk, s.position, string_agg('t' || n.chunk_index, chr(10) ORDER BY n.chunk_index) AS text FROM s JOIN c n ON n.doc_id = s.doc_id AND n.chunk_index BETWEEN s.chunk_index - 1 AND s.chunk_index + 1 WHERE s.position <= 3 GROUP BY 1, 2, 3""")
def contexts_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """The whole way from scored hits to stitched contexts: fused, one hit a document, three a query, neighbours around."""
    c = chunk(spark, d).groupBy("doc_id", "chunk_index").agg(F.min("qty").alias("qty"))
    pk = (F.col("doc_id") * 10 + F.col("chunk_index")).cast("string")
    fixed = {"version_no": F.lit(1), "permission_level": F.lit("public"), "owner": F.lit("o"), "section_title": F.lit("s"), "chunk_type": F.lit("text_chunk")}
    chunks = c.select(pk.alias("pk"), "doc_id", "chunk_index", F.concat(F.lit("t"), F.col("chunk_index").cast("string")).alias("text")).withColumns(fixed)
    arms = c.where("doc_id % 7 = 0").select((F.col("doc_id") % 50).alias("query_id"), F.lit("dense").alias("arm"), pk.alias("pk"), F.col("qty").alias("score"))
    return retrieval.retrieve(arms, chunks, {"dense": 1.0}, 3, 1).select("query_id", "pk", F.col("position").cast("long").alias("position"), "text")


# Reconciliation, gaps, evaluation.


@query("absent_objects_of_lines", f"WITH {DOCS}, r AS (SELECT chunk_id, unnest([part_id % 500, 1000 + owner % 50]) AS n FROM chunk WHERE is_active = 1 AND part_id % 11 > 0) SELECT 'k' || n AS key, min(chunk_id) AS chunk_id FROM r WHERE n % 3 > 0 GROUP BY n")
def absent_objects_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Objects that active chunks refer to and storage lacks; the JSON of some is broken."""
    c = chunk(spark, d)
    key = lambda n: F.concat(F.lit("k"), n.cast("string"))
    extra = F.to_json(F.struct(key(F.col("part_id") % 500).alias("oss_key"), F.array(F.struct(key(1000 + F.col("owner") % 50).alias("oss_key"))).alias("image_refs")))
    rows = c.select("chunk_id", "is_active", F.when(F.col("part_id") % 11 == 0, "{broken").otherwise(extra).alias("extra_json"))
    present = c.select(F.explode(F.array(F.col("part_id") % 500, 1000 + F.col("owner") % 50)).alias("n")).where("n % 3 = 0").select(key(F.col("n")).alias("key"))
    return reconcile.object_parity(rows, present)


@query("grants_of_orders", "SELECT o_orderkey AS doc_id, o_orderkey % 5 NOT IN (0, 1) AND o_orderkey % 7 <> 3 AS unchanged FROM orders")
def grants_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Grants as wished for and as they are: nodes, broken lists and other lists are changed."""
    k = F.col("o_orderkey")
    want = F.when(k % 5 == 0, "[broken").otherwise(F.to_json(F.array("o_orderpriority", "o_orderstatus")))
    have = F.array_sort(F.when(k % 7 == 3, F.array("o_orderstatus")).otherwise(F.array("o_orderstatus", "o_orderpriority")))
    rows = read(spark, d, "orders").select(k.alias("doc_id"), F.when(k % 5 == 1, "NODE").when(k % 5 == 2, "legacy").alias("mode"), want.alias("want_json"), have.alias("have"))
    return reconcile.unchanged_grants(rows)


@query("merged_gaps_of_the_log", f"WITH {LOG}, g AS (SELECT query_text AS h, count(*) AS asks, min(date_diff('day', CAST(created_at AS DATE), DATE '2024-02-01')) AS days, answer_status FROM qlog WHERE answer_status IN ('NO_RESULT', 'REFUSAL') GROUP BY 1, 4) SELECT CAST(regexp_extract(h, 'q (\\d+)', 1) AS INT) % 20 AS bundle, CAST(sum(asks) AS BIGINT) AS asks, min(days) AS days, CASE WHEN bool_or(answer_status = 'REFUSAL') THEN 'refusal' ELSE 'no_result' END AS kind, count(*) AS members FROM g GROUP BY 1")
def merged_gaps_of_the_log(spark: SparkSession, d: str) -> DataFrame:
    """Open questions in twenty bundles."""
    log = qlog(spark, d).where("answer_status IN ('NO_RESULT', 'REFUSAL')")
    rows = log.groupBy(F.col("query_text").alias("hash"), "k", "answer_status").agg(F.count("*").alias("asks"), F.min(F.date_diff(F.lit("2024-02-01").cast("date"), F.to_date("created_at"))).cast("long").alias("days"))
    open_ = rows.select("hash", F.col("hash").alias("raw"), "asks", "days", F.when(F.col("answer_status") == "REFUSAL", "refusal").otherwise("no_result").alias("kind"))
    clusters = rows.select("hash", F.concat(F.lit("g"), (F.col("k") % 20).cast("string")).alias("representative"))
    merged = gaps.merge_groups(open_, clusters)
    return merged.select(F.substring("group", 2, 9).cast("int").alias("bundle"), "asks", "days", "kind", "members")


@query("contributions_of_orders", "SELECT CASE o_orderstatus WHEN 'F' THEN CASE o_orderkey % 4 WHEN 0 THEN 'searchable' WHEN 1 THEN 'failed' WHEN 2 THEN 'processing' ELSE 'accepted' END WHEN 'O' THEN 'rejected' ELSE 'pending' END AS state, count(*) AS n FROM orders GROUP BY 1")
def contributions_of_orders(spark: SparkSession, d: str) -> DataFrame:
    """Contributions by the one state of their review and their ingest."""
    k, s = F.col("o_orderkey") % 4, F.col("o_orderstatus")
    review = F.when(s == "F", "accepted").when(s == "O", "rejected").otherwise("open")
    ingest = F.when(k == 0, "searchable").when(k == 1, "failed").when(k == 2, "registering")
    return read(spark, d, "orders").select(status.contribution_state(review, ingest).alias("state")).groupBy("state").agg(F.count("*").alias("n"))


@query("baseline_of_flags", "WITH m AS (SELECT l_returnflag AS metric, round(avg(l_discount), 6) AS value, round(avg(l_tax), 6) AS reference FROM lineitem GROUP BY 1) SELECT metric, value, reference, CASE WHEN metric = 'A' AND value >= reference - 0.001 OR metric <> 'A' AND value <= reference + 0.001 THEN 'ok' WHEN metric = 'N' THEN 'note' ELSE 'regression' END AS verdict FROM m")
def baseline_of_flags(spark: SparkSession, d: str) -> DataFrame:
    """Mean discounts held against mean taxes: higher is better for one flag, of another a fall is only noted."""
    m = read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).agg(F.round(F.avg("l_discount"), 6).alias("value"), F.round(F.avg("l_tax"), 6).alias("tax"))
    base = m.select("metric", F.col("tax").alias("value"), (F.col("metric") == "A").alias("higher_is_better"), F.lit(False).alias("points"), (F.col("metric") == "N").alias("advisory"))
    return evaluation.compare_baseline(m.select("metric", "value"), base, True, delta=0.001)


@query("coverage_of_benchmark", "WITH g AS (SELECT item_id, list_distinct(list_transform(range(1, length(text) - 6), lambda s: substr(text, s, 8))) AS whole, list_distinct(list_transform(range(1, length(text) // 2 - 6), lambda s: substr(text, s, 8))) AS half FROM (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS text FROM benchmark)) SELECT item_id AS doc_id, round(CASE WHEN len(whole) = 0 THEN 1.0 ELSE len(list_intersect(whole, half)) / len(whole) END, 6) AS coverage FROM g")
def coverage_of_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """How much of a text's 8-grams its first half holds; chunks are put together in order first."""
    items = read(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "\\s+", "").alias("t")).withColumn("n", F.floor(F.char_length("t") / 2).cast("int"))
    kept = items.select(F.col("item_id").alias("doc_id"), F.lit(0).alias("chunk_index"), F.substring("t", F.lit(1), F.col("n")).alias("chunk_text"))
    rest = items.select(F.col("item_id").alias("doc_id"), F.col("item_id").alias("keep_id"), F.explode(F.array(F.struct(F.lit(1).alias("chunk_index"), F.substring("t", F.col("n") + 1, F.char_length("t")).alias("chunk_text")), F.struct(F.lit(0).alias("chunk_index"), F.substring("t", F.lit(1), F.col("n")).alias("chunk_text")))).alias("c"))
    return audits.document_coverage(rest.select("doc_id", "keep_id", "c.*"), kept)
