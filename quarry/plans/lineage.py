"""Versions, owners, leases, images and matches over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import figures, text
from quarry.operators import evaluation, hierarchy, lineage
from quarry.plans.registry import query
from quarry.plans.texts import _TREE, _tree
from quarry.plans.views import DOCS, LOG, chunk, meta, qlog
from quarry.sources.tables import read
from quarry.streaming import handoff


@query("figure_refs", f"""WITH t AS (SELECT p_partkey, p_size % 9 + 1 AS a, p_size % 20 + 1 AS b, p_partkey % 3 = 0 AS broad FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct([a, a + 1, a + 2, b])), ',') AS refs, broad FROM t""")
def figure_refs(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("p_size") % 9 + 1, F.col("p_size") % 20 + 1
    step = F.concat(F.when(F.col("p_partkey") % 3 == 0, "①-⑥步操作 ").otherwise("1-2步 "), F.lit("见图"), a, F.lit("-"), a + 2, F.lit(" 设备"), F.substr(F.lit(figures.CIRCLED), b, F.lit(1)))
    return read(spark, d, "part").select("p_partkey", F.array_join(figures.figure_refs(step), ",").alias("refs"), figures.step_ranges(step).alias("broad"))


@query("image_moves", """WITH t AS (SELECT p_partkey % 4 AS s, p_size % 4 AS t, p_partkey % 2 AS broad FROM part),
o AS (SELECT CASE s WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END AS a, CASE t WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE broad END AS b, broad FROM t)
SELECT CASE WHEN b > a THEN 'stronger_destination_owner' WHEN a < 3 THEN 'ambiguous_kept_at_source' WHEN broad = 1 THEN 'range_theft_blocked' ELSE 'source_owner_preserved' END AS reason, a AS source_score, b AS target_score, count(*) AS n FROM o GROUP BY 1, 2, 3""")
def image_moves(spark: SparkSession, d: str) -> DataFrame:
    said = lambda c: F.when(c == 0, "图③").when(c == 1, "panel left").otherwise("-")
    target = F.concat(said(F.col("p_size") % 4), F.when(F.col("p_partkey") % 2 == 1, " ①-⑥步").otherwise(""))
    rows = read(spark, d, "part").select(said(F.col("p_partkey") % 4).alias("source"), target.alias("target"), F.lit("the panel left of it").alias("summary"))
    rows = rows.withColumns({"a": figures.common_run(F.col("summary"), F.col("source")), "b": figures.common_run(F.col("summary"), F.col("target"))})
    got = figures.move_decision(F.col("source"), F.col("target"), figures.printed_numbers(F.lit("part ③")), F.col("a"), F.col("b"))
    return rows.select(got.alias("m")).groupBy("m.reason", "m.source_score", "m.target_score").agg(F.count("*").alias("n"))


@query("table_fidelity", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.6667 END AS cell_f1, p_size % 3 = 0 AS grid_exact FROM part")
def table_fidelity(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    kind, key, size = F.col("p_size") % 3, F.concat(F.lit("k"), "p_partkey"), F.concat(F.lit("s"), "p_size")
    first = F.concat(F.lit("| "), key, F.lit(" | "), F.when(kind == 1, "wrong").otherwise(size), F.lit(" |\n|---|:--:|"))
    rest = F.when(kind == 2, "\n| other | cells |").otherwise("")
    got = text.table_scores(F.array(F.array(key, size)), text.markdown_grid(F.concat(first, rest)))
    return p.select("p_partkey", got["cell_f1"].alias("cell_f1"), got["grid_exact"].alias("grid_exact"))


@query("question_gates", f"""SELECT conv_id, turn, length(text) >= 8 AND (regexp_matches(text, '{text.MULTI_INTENT[0]}|{text.MULTI_INTENT[1]}|{text.MULTI_INTENT[2]}|{text.MULTI_INTENT[3]}') OR regexp_matches(text, '{text.MULTI_INTENT[4]}')) AS multi FROM conversations""")
def question_gates(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select("conv_id", "turn", text.looks_multi_intent(F.col("text")).alias("multi"))


@query("source_relations", f"""WITH {DOCS}, v AS (SELECT doc_id, doc_id % 4 AS k, doc_id % 3 AS t FROM meta)
SELECT CASE WHEN k = 0 THEN 'same_checksum' WHEN k = 1 THEN 'changed' WHEN t = 0 THEN 'same_etag' WHEN t = 1 THEN 'changed' ELSE 'unknown' END AS relation, count(*) AS n, min(substr(sha256('ASSET_SET_DIFF|' || doc_id || '|None|2'), 1, 16)) AS least_key FROM v GROUP BY 1""")
def source_relations(spark: SparkSession, d: str) -> DataFrame:
    k, t, none = F.col("doc_id") % 4, F.col("doc_id") % 3, F.lit(None).cast("string")
    relation = lineage.source_relation(F.lit("a"), F.when(k == 0, "a").when(k == 1, "b").otherwise(""), F.lit(' "AB"'), F.when(t == 0, "ab").when(t == 1, "cd").otherwise(none))
    return meta(spark, d).groupBy(relation.alias("relation")).agg(F.count("*").alias("n"), F.min(lineage.event_key(F.col("doc_id"), none, F.lit(2))).alias("least_key"))


_VERSIONS = f"""{DOCS}, v AS (SELECT doc_id, version_no, bool_and(index_status = 'INDEXED') AS done, min(part_id) % 5 <> 0 AS canonical, min(part_id) % 3 AS p FROM chunk GROUP BY 1, 2)"""


def _versions(spark: SparkSession, d: str) -> DataFrame:
    per = chunk(spark, d).groupBy("doc_id", "version_no").agg(F.bool_and(F.col("index_status") == "INDEXED").alias("done"), F.min("part_id").alias("p"))
    return per.select("doc_id", "version_no", F.when(F.col("done"), "SUCCESS").otherwise("PROCESSING").alias("index_status"), F.when(F.col("p") % 5 != 0, F.lit("key")).alias("canonical_key"), (F.col("p") % 3).alias("p"))


@query("baseline_versions", f"WITH {_VERSIONS} SELECT doc_id, version_no, (SELECT max(b.version_no) FROM v b WHERE b.doc_id = v.doc_id AND b.version_no < v.version_no AND b.done AND b.canonical) AS baseline_no FROM v")
def baseline_versions(spark: SparkSession, d: str) -> DataFrame:
    return lineage.baseline_versions(_versions(spark, d)).select("doc_id", "version_no", "baseline_no")


@query("epoch_probes", f"""WITH {DOCS}, j AS (SELECT m.doc_id, CASE WHEN part_id % 11 > 0 THEN part_id % 4 END AS has, m.doc_id % 5 AS due FROM chunk c JOIN meta m USING (doc_id) WHERE is_active = 1)
SELECT count(DISTINCT CASE WHEN has IS NULL OR has < due THEN doc_id END) AS unconverged, count(DISTINCT CASE WHEN has > due THEN doc_id END) AS ahead FROM j""")
def epoch_probes(spark: SparkSession, d: str) -> DataFrame:
    chunks = chunk(spark, d).withColumn("epoch", F.when(F.col("part_id") % 11 > 0, F.col("part_id") % 4))
    return lineage.epoch_probes(chunks, meta(spark, d).withColumn("epoch", F.col("doc_id") % 5))


@query("unknown_owners", f"WITH {DOCS} SELECT DISTINCT 'production_' || (owner_id % 7) AS owner_dept FROM meta WHERE lower(status) = 'active' AND owner_id % 7 NOT IN (0, 1, 2) AND owner_id % 2 = 0")
def unknown_owners(spark: SparkSession, d: str) -> DataFrame:
    docs = meta(spark, d).withColumn("owner_dept", F.concat(F.when(F.col("owner_id") % 2 == 0, "production_").otherwise("sales_"), F.col("owner_id") % 7))
    return lineage.unknown_owners(docs, ["production_0", "production_1", "production_2"])


@query("resume_report", f"""WITH {_VERSIONS}, r AS (SELECT v.*, lower(status) = 'active' AS live, created_at < TIMESTAMP '1996-01-01' AS old FROM v JOIN meta USING (doc_id))
SELECT count(*) FILTER (p = 0 AND live) AS stage1_in_flight, count(*) FILTER (p < 2 AND live) AS stage2_in_flight, count(*) FILTER (p < 2 AND live AND old) AS stage2_stale, count(*) FILTER (NOT done) AS stage3_in_flight, count(*) FILTER (NOT done AND old) AS stage3_stale FROM r""")
def resume_report(spark: SparkSession, d: str) -> DataFrame:
    rows = _versions(spark, d).join(meta(spark, d).select("doc_id", "status", F.col("created_at").alias("updated_at")), "doc_id")
    return lineage.resume_report(rows.withColumn("content_status", F.when(F.col("p") == 0, "LOADING").when(F.col("p") == 1, "PROCESSING").otherwise("DONE")), F.lit("1996-01-01").cast("timestamp_ntz"))


@query("routed_coverage", f"""WITH {DOCS}, c AS (SELECT doc_id, count(*) FILTER (part_id % 5 = 0) AS step_cards, count(*) AS total FROM chunk WHERE is_active = 1 GROUP BY 1)
SELECT doc_id, coalesce(step_cards, 0) AS step_cards, coalesce(total, 0) AS total, CASE WHEN step_cards > 0 THEN 'covered' WHEN total > 0 THEN 'missed' ELSE 'empty' END AS state FROM meta LEFT JOIN c USING (doc_id) WHERE owner_id % 3 = 0""")
def routed_coverage(spark: SparkSession, d: str) -> DataFrame:
    return lineage.routed_coverage(meta(spark, d).where("owner_id % 3 = 0"), chunk(spark, d).withColumn("chunk_type", F.when(F.col("part_id") % 5 == 0, "step_card").otherwise("text_chunk")))


@query("admin_roots", f"""WITH RECURSIVE {_TREE}, c AS (SELECT id AS node, id AS ancestor, parent AS nxt FROM tree UNION ALL SELECT c.node, t.id, t.parent FROM c JOIN tree t ON t.id = c.nxt),
n AS (SELECT ancestor AS node, count(*) AS subtree FROM c WHERE ancestor <> 0 GROUP BY 1), a AS (SELECT c_custkey AS user_id, c_custkey % 6 AS g, 100 + c_nationkey AS home, CASE WHEN c_custkey % 4 = 0 THEN 1 + c_nationkey % 5 ELSE 100 + c_nationkey END AS root FROM customer),
j AS (SELECT a.*, subtree FROM a JOIN n ON n.node = a.root), k AS (SELECT *, CASE WHEN g = 0 THEN 'manual' WHEN g = 1 THEN 'unclear' WHEN g = 2 AND root = home THEN 'unchanged' WHEN root < 100 OR subtree > 5 OR g IN (2, 3) THEN 'candidate' ELSE 'granted' END AS action FROM j)
SELECT user_id, CASE WHEN g > 1 THEN root END AS root, action, CASE WHEN action = 'candidate' THEN CASE WHEN root < 100 THEN 'center_level' WHEN subtree > 5 THEN 'oversized' ELSE 'root_changed' END END AS risk,
 CASE WHEN g IN (0, 2, 3) AND action <> 'unchanged' THEN 1 ELSE 0 END AS revoked FROM k""")
def admin_roots(spark: SparkSession, d: str) -> DataFrame:
    people = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 6).alias("g"), (F.col("c_nationkey") + 100).cast("long").alias("home"), (F.col("c_nationkey") % 5 + 1).cast("long").alias("top"))
    root = F.when(F.col("user_id") % 4 == 0, F.col("top")).otherwise(F.col("home"))
    staff = people.select("user_id", F.explode(F.when(F.col("g") == 1, F.array("home", "top")).otherwise(F.array(root))).alias("node"))
    held = people.where("g in (0, 2, 3)").select("user_id", F.when(F.col("g") == 3, F.lit(9999).cast("long")).otherwise(F.col("home")).alias("node"), F.lit("auto").alias("source"), F.lit(True).alias("is_active"))
    manual = people.where("g = 0").select("user_id", "home", F.lit("manual"), F.lit(True))
    closure = hierarchy.ancestors(_tree(spark, d))
    nodes = closure.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("subtree")).withColumn("depth", F.when(F.col("node") < 100, 1).otherwise(2))
    return lineage.admin_roots(people, held.union(manual), staff, nodes, 5)


@query("cited_usage", """SELECT unnest(['": 1', '": 12', '": 9']) AS id, unnest([count(*) FILTER (contains(props, '": 1')), count(*) FILTER (contains(props, '": 12')), count(*) FILTER (contains(props, '": 9'))]) AS n FROM events""")
def cited_usage(spark: SparkSession, d: str) -> DataFrame:
    return lineage.cited_usage(read(spark, d, "events"), ['": 1', '": 12', '": 9'], "props")


@query("lease_steps", f"""WITH {DOCS}, l AS (SELECT current_version_no AS e, doc_id % 5 = 0 OR created_at < TIMESTAMP '1996-01-01' AS free, owner_id % 3 = 1 AS mine FROM meta),
s AS (SELECT e, CASE WHEN NOT free AND mine AND e = 2 THEN 'renew' WHEN free THEN 'claim' ELSE 'fenced' END AS action FROM l) SELECT action, CASE action WHEN 'claim' THEN e + 1 WHEN 'renew' THEN e END AS epoch, count(*) AS n FROM s GROUP BY 1, 2""")
def lease_steps(spark: SparkSession, d: str) -> DataFrame:
    owner = F.when(F.col("doc_id") % 5 > 0, F.col("owner_id") % 3)
    step = lineage.lease_step(F.col("current_version_no"), owner, F.col("created_at"), F.lit(1), F.lit(2), F.lit("1996-01-01").cast("timestamp_ntz"))
    return meta(spark, d).select(step.alias("s")).groupBy("s.action", "s.epoch").agg(F.count("*").alias("n"))


#: Chunks by their place in the document; the tables repeat some places.
_PLACES = "u AS (SELECT doc_id, chunk_index, min(part_id) AS part_id FROM chunk GROUP BY 1, 2)"


def _places(spark: SparkSession, d: str) -> DataFrame:
    return chunk(spark, d).groupBy("doc_id", "chunk_index").agg(F.min("part_id").alias("part_id"))


_SERVING = "s AS (SELECT doc_id, max(version_no) AS serving FROM chunk WHERE is_active = 1 GROUP BY 1)"


@query("stale_image_gate", f"""WITH {DOCS}, {_SERVING}, r AS (SELECT chunk_id, part_id % 4 AS kind, coalesce(version_no = serving, false) AS fine FROM chunk LEFT JOIN s USING (doc_id))
SELECT kind, count(*) AS n, count(*) FILTER (fine AND kind < 2) AS with_images FROM r WHERE NOT (kind = 0 AND NOT fine) GROUP BY 1""")
def stale_image_gate(spark: SparkSession, d: str) -> DataFrame:
    c = chunk(spark, d).withColumn("kind", F.col("part_id") % 4)
    rows = c.select(
        F.when(F.col("chunk_id") % 2 == 0, F.col("chunk_id").cast("string")).alias("chunk_id"), F.col("chunk_id").alias("pk"), "kind", F.when(F.col("kind") == 0, "image").otherwise("text_chunk").alias("chunk_type"),
        F.when(F.col("kind") < 2, F.array("part_id")).alias("image_refs"),
    )
    authority = c.select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("chunk_id").alias("pk"), "doc_id", F.lit("text_chunk").alias("chunk_type"), "version_no")
    serving = chunk(spark, d).where("is_active = 1").groupBy("doc_id").agg(F.max("version_no").alias("serving"))
    return lineage.gate_stale_images(rows, authority, serving).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.size("image_refs") > 0).alias("with_images"))


@query("section_cards", f"""WITH {DOCS}, {_PLACES}, b AS (SELECT doc_id, chunk_index, CASE part_id % 4 WHEN 0 THEN 'raw material' WHEN 1 THEN 'process' END AS s FROM u),
f AS (SELECT *, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_index), 'header') AS section FROM b),
t AS (SELECT *, CASE WHEN lag(section) OVER (PARTITION BY doc_id ORDER BY chunk_index) = section THEN 0 ELSE 1 END AS turned FROM f), g AS (SELECT *, sum(turned) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS card_no FROM t)
SELECT doc_id, card_no, min(section) AS section, sum(length(coalesce(s, 'some other line') || ' ' || chunk_index) + 1) - 1 AS n_chars FROM g GROUP BY 1, 2 HAVING n_chars >= 10""")
def section_cards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("part_id") % 4
    line = F.concat(F.when(k == 0, "raw material").when(k == 1, "process").otherwise("some other line"), F.lit(" "), "chunk_index")
    blocks = _places(spark, d).select("doc_id", F.col("chunk_index").alias("block_no"), line.alias("text"))
    cards = lineage.section_cards(blocks, [(["raw"], "raw material", "material_card"), (["process"], "process", "process_card")])
    return cards.select("doc_id", "card_no", "section", F.char_length("text").cast("long").alias("n_chars"))


@query("severity_pairs", """WITH p AS (SELECT quality = 0 AS off, toxic = 1 AS "on", doc_id % 3 AS s, doc_id % 2 AS t FROM labels), c AS (SELECT count(*) FILTER ("on" AND NOT off AND s = 0) AS on_only_high, count(*) FILTER ("on" AND NOT off AND s < 2) AS on_only_medium_plus,
 count(*) FILTER (off AND NOT "on" AND t = 0) AS off_only_high, count(*) FILTER (off AND NOT "on") AS off_only_medium_plus FROM p) SELECT *, on_only_high > 0 AS high_severity_block, on_only_medium_plus > off_only_medium_plus AS asymmetric_violation FROM c""")
def severity_pairs(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("doc_id") % 3
    rows = read(spark, d, "labels").select(
        (F.col("quality") == 0).alias("off"), (F.col("toxic") == 1).alias("on"), F.when(F.col("doc_id") % 2 == 0, "high").otherwise("medium").alias("off_severity"), F.when(s == 0, "HIGH").when(s == 1, "MEDIUM").otherwise("LOW").alias("on_severity")
    )
    return evaluation.severity_pairs(rows)


@query("visibility_check", "WITH g AS (SELECT doc_id FROM documents WHERE doc_id % 4 > 0 AND source <> '') SELECT count(*) AS tested, count(*) AS hidden, count(*) FILTER (doc_id % 4 > 1) AS shown, count(*) > 0 AS applicable, true AS no_leak FROM g")
def visibility_check(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    docs = read(spark, d, "documents").select("doc_id", F.col("source").alias("owner"), F.when(i % 4 == 0, "public").when(i % 4 == 1, "restricted").otherwise("dept_internal").alias("permission"))
    return evaluation.visibility_check(docs, F.col("permission") == "public", F.col("permission") != "restricted")


_MATCH = f"""{DOCS}, {_PLACES}, c AS (SELECT doc_id, chunk_index, p_name AS text, part_id % 2 AS kind, part_id % 3 AS refs FROM u JOIN part ON p_partkey = part_id), t AS (SELECT doc_id, string_split(text, ' ') AS words FROM c WHERE chunk_index = 1),
j AS (SELECT t.doc_id, chunk_index, kind, refs, len(list_filter(words, lambda w: contains(lower(text), lower(w)))) AS hits, len(words) AS k, length(text) AS n FROM t JOIN c USING (doc_id)), s AS (SELECT *, hits / k >= 0.3 AS fit, hits / k AS recall, hits / sqrt(n) AS density FROM j),
a AS (SELECT *, max(CASE WHEN fit AND kind = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS typed FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN typed = 1 THEN recall ELSE 0 END DESC, CASE WHEN typed = 1 AND refs > 0 THEN 1 ELSE 0 END DESC, density DESC, chunk_index) AS place FROM a WHERE fit AND (typed = 0 OR kind = 0))"""


@query("match_chunks", f"WITH {_MATCH} SELECT doc_id, 'matched' AS status, chunk_index AS chunk_no, CASE WHEN refs = 1 THEN 1.0 ELSE 0.0 END AS jaccard FROM r WHERE place = 1")
def match_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = _places(spark, d).join(read(spark, d, "part").select(F.col("p_partkey").alias("part_id"), F.col("p_name").alias("text")), "part_id")
    none, ref = F.lit(None).cast("int"), F.col("part_id") % 3
    chunks = c.select("doc_id", F.col("chunk_index").alias("chunk_no"), "text", F.when(F.col("part_id") % 2 == 0, "step_card").otherwise("text_chunk").alias("chunk_type"), none.alias("section_no"), none.alias("step_no"), F.when(ref > 0, F.array(ref)).otherwise(F.array().cast("array<long>")).alias("refs"))
    truth = c.where("chunk_index = 1").select(F.col("doc_id").alias("gt_id"), "doc_id", F.split("text", " ").alias("keywords"), F.lit("step_card").alias("chunk_type"), none.alias("section_no"), none.alias("step_no"), F.array(F.lit(1).cast("long")).alias("refs"))
    return evaluation.match_chunks(truth, chunks).withColumnRenamed("gt_id", "doc_id")


@query("anchor_hits", f"""WITH {DOCS}, h AS (SELECT doc_id, bool_or(part_id % 4 = 0) AS seen FROM chunk WHERE chunk_index IN (2, 3) GROUP BY 1)
SELECT m.doc_id AS anchor_id, h.doc_id IS NOT NULL AS key_hit, h.doc_id IS NOT NULL AND (m.doc_id % 2 = 0 OR seen) AS image_hit FROM meta m LEFT JOIN h USING (doc_id)""")
def anchor_hits(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("part_id") % 4
    ref = F.struct(k.alias("image_index"), F.lit("Summary").alias("visual_summary"), F.lit(None).cast("string").alias("ocr_text"))
    chunks = chunk(spark, d).select("doc_id", F.concat(F.lit("k"), "chunk_index").alias("key"), F.array(ref).alias("image_refs"))
    signals = F.when(F.col("doc_id") % 2 == 1, F.array(F.lit("00"), F.lit(" summary"))).otherwise(F.array().cast("array<string>"))
    return evaluation.anchor_hits(meta(spark, d).select(F.col("doc_id").alias("anchor_id"), "doc_id", F.array(F.lit("k2"), F.lit("k3")).alias("keys"), signals.alias("signals")), chunks)


@query("comment_handoffs", f"""WITH RECURSIVE {LOG}, r AS (SELECT CAST(user_id AS VARCHAR) AS actor, epoch_us(created_at) / 1e6 AS ts, answer_status = 'NO_RESULT' AS mark, CAST(message_id AS VARCHAR) AS id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, message_id) AS n FROM qlog),
s AS (SELECT actor, n, ts, mark, CAST(NULL AS VARCHAR) AS comment_of, CASE WHEN mark THEN [struct_pack(id := id, t := ts)] ELSE [] END AS live FROM r WHERE n = 1
UNION ALL SELECT r.actor, r.n, r.ts, r.mark, CASE WHEN NOT r.mark THEN list_filter(live, lambda x: x.t >= r.ts - 21600)[-1].id END, CASE WHEN r.mark THEN list_append(list_filter(live, lambda x: x.t >= r.ts - 21600), struct_pack(id := r.id, t := r.ts)) ELSE list_filter(live, lambda x: x.t >= r.ts - 21600)[1:-2] END FROM s JOIN r ON r.actor = s.actor AND r.n = s.n + 1)
SELECT actor, ts, comment_of FROM s WHERE NOT mark""")
def comment_handoffs(spark: SparkSession, d: str) -> DataFrame:
    q = qlog(spark, d)
    mark = F.col("answer_status") == "NO_RESULT"
    events = q.select(F.col("user_id").alias("actor"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("us"), F.col("message_id").alias("seq"), F.when(mark, "mark").otherwise("message").alias("kind"), F.when(mark, F.col("message_id")).alias("answer"))
    return handoff.handoffs(events.withColumn("ts", F.col("us") / 1e6), 6 * 3600.0)
