"""Retrieval: dense and lexical scores, fusion, caps, interleaving, neighbours, packing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.vectors import Nearest, in_blocks
from quarry.sources.steps import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int, allowed: Column | None = None, max_queries: int = 4096) -> DataFrame:
    """``query_id, vec_id, score, rank``: exact inner-product neighbours; ``allowed`` filters before ranking.

    The query set is stated by the caller and at most ``max_queries`` rows, checked; it goes to every task, where
    matrix products score a few vectors at a time and the best k of each query are kept. What leaves a task is k rows a query.
    """
    stated = queries.select("query_id", "embedding").limit(max_queries + 1).collect()
    if len(stated) > max_queries:
        raise ValueError(f"more than {max_queries} queries; pass them in blocks")
    ids = [r["query_id"] for r in stated]
    matrix = queries.sparkSession.sparkContext.broadcast(np.array([r["embedding"] for r in stated], dtype=np.float64).reshape(len(ids), -1))

    def best(batches):
        held = Nearest(matrix.value, k)
        for pdf in batches:
            if len(pdf):
                held.add(pdf["vec_id"].to_numpy(), np.stack(pdf["embedding"].to_numpy()).astype(np.float64))
        out = held.frame(np.array(ids))
        if out is not None:
            yield out

    pool = vectors if allowed is None else vectors.where(allowed)
    part = pool.select("vec_id", "embedding").mapInPandas(best, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return part.withColumn("rank", rank).where(F.col("rank") <= k)


def dense_top_k_in_blocks(queries: DataFrame, vectors: DataFrame, k: int, allowed: Column | None = None, max_queries: int = 4096) -> DataFrame:
    """``dense_top_k`` for any number of queries: blocks of at most ``max_queries`` by a hash of ``query_id``, one scan of the vectors each."""
    parts = [dense_top_k(block, vectors, k, allowed, max_queries) for block in in_blocks(queries, max_queries)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query_id, doc_id, score`` over ``docs(doc_id, text)`` and ``queries(query_id, text)``; any term of a query may match.

    Only terms of queries are counted, so the shuffle holds their postings and not the corpus. The corpus's two
    statistics are scalars; of a term its postings are counted where they meet the queries.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    lengths = docs.select("doc_id", tokens(F.col("text")).alias("terms")).withColumn("dl", F.size("terms"))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    tf = lengths.select("doc_id", "dl", F.explode("terms").alias("term")).join(wanted.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.ln(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(stats["avgdl"])))
    # Queries take the small side's statistics along before they meet the postings.
    return wanted.join(idf, "term").join(tf, "term").groupBy("query_id", "doc_id").agg(F.sum(weight).alias("score"))


def sparse_dot(queries: DataFrame, docs: DataFrame, most_postings: int = 1 << 20, most_pairs: int = 1 << 20) -> DataFrame:
    """``query_id, doc_id, score`` over postings ``(id, token, weight)`` of both sides.

    Every query meets every document that shares a token, so nothing of a pair is shuffled: postings of documents are
    dealt by document, into so many parts that each makes about ``most_pairs`` products, and queries come to them in
    broadcast blocks of about ``most_postings``; a pair's sum is made where its products are.
    """
    q, d = queries.select("query_id", "token", F.col("weight").alias("qw")), docs.select("doc_id", "token", F.col("weight").alias("dw"))
    q = written(q.where("token IS NOT NULL"), "query_postings")
    d = written(d.where("token IS NOT NULL"), "doc_postings")
    n_q, n_d = (x.groupBy("token").agg(F.count("*").cast("double").alias(n)) for x, n in ((q, "nq"), (d, "nd")))
    products = n_q.join(n_d, "token").agg(F.sum(F.col("nq") * F.col("nd"))).first()[0] or 0.0
    blocks = max(1, math.ceil(q.count() / most_postings))
    parts = int(min(100_000, max(1, products / most_pairs / blocks), max(1, d.count())))
    dealt = d.repartition(max(parts, q.sparkSession.sparkContext.defaultParallelism), "doc_id")
    out = None
    for n in range(blocks):
        some = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)
        # Hashed by document, the products already lie together by query and document.
        pairs = dealt.join(F.broadcast(some), "token").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("dw")).alias("score"))
        out = pairs if out is None else out.unionByName(pairs)
    return out


def min_max_fusion(arms: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``query_id, pk, fused``: arms ``(query_id, arm, pk, score)`` scaled to 0..1 over a query's hits (1 if all are equal), weighted and summed; an absent arm adds nothing."""
    w = Window.partitionBy("query_id", "arm")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0)
    share = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return arms.withColumn("part", scaled * F.coalesce(F.try_element_at(share, F.col("arm")), F.lit(0.0))).groupBy("query_id", "pk").agg(F.sum("part").alias("fused"))


def weighted_fusion(arms: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``query_id, pk, fused``: raw scores weighted and summed."""
    share = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return arms.groupBy("query_id", "pk").agg(F.sum(F.col("score") * F.coalesce(F.try_element_at(share, F.col("arm")), F.lit(0.0))).alias("fused"))


def reciprocal_rank_fusion(arms: DataFrame, k: int = 60) -> DataFrame:
    """``query_id, pk, fused``: the sum over arms of 1 / (k + rank)."""
    rank = F.row_number().over(Window.partitionBy("query_id", "arm").orderBy(F.desc("score"), "pk"))
    return arms.withColumn("r", rank).groupBy("query_id", "pk").agg(F.sum(1 / (k + F.col("r"))).alias("fused"))


def demote_covers(hits: DataFrame, shortest: int = 200) -> DataFrame:
    """``rank`` anew: text chunks without a section title and under 200 characters go last, in their order."""
    cover = (F.col("chunk_type") == "text_chunk") & (F.coalesce("section_title", F.lit("")) == "") & (F.char_length("chunk_text") < shortest)
    return hits.withColumn("is_cover", cover).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("is_cover", "rank")))


def select_with_cap(pool: DataFrame, top_k: int, cap: int) -> DataFrame:
    """At most ``cap`` rows a document and ``top_k`` a query: first rows within the cap, then what overflowed, covers after either's others.

    With no cap, or a pool no larger than ``top_k``, just the first rows.
    """
    within = F.row_number().over(Window.partitionBy("query_id", "is_cover", "doc_id").orderBy("rank"))
    size = F.count("*").over(Window.partitionBy("query_id"))
    free = (F.lit(cap) <= 0) | (size <= top_k)
    group = F.when(free, 0).when(~F.col("is_cover") & (F.col("__nth") <= cap), 0).when(~F.col("is_cover"), 1).otherwise(2)
    ranked = pool.withColumn("__nth", within).withColumn("__group", group)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("__group", "rank"))
    return ranked.withColumn("position", order).where(F.col("position") <= top_k).drop("__nth", "__group")


def interleave(lists: DataFrame, key: str = "pk") -> DataFrame:
    """Round-robin by rank over ``lists(query_id, list_no, rank, key)``; of a key the first occurrence stays."""
    first = F.row_number().over(Window.partitionBy("query_id", key).orderBy("rank", "list_no"))
    kept = lists.withColumn("__n", first).where("__n = 1").drop("__n")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "list_no")))


def _blocked(scores: np.ndarray, ends: np.ndarray, lows: np.ndarray, asked: np.ndarray, eps: float) -> np.ndarray:
    """For each of ``asked`` the end of ``scores[:end]`` without its trailing ones that lie within ``eps`` of it, ``low`` at least; by minima and maxima of blocks of doubled length."""
    low, high = [scores], [scores]
    while len(low[-1]) > 1:
        even = len(low[-1]) & ~1
        low.append(np.minimum(low[-1][:even:2], low[-1][1:even:2]))
        high.append(np.maximum(high[-1][:even:2], high[-1][1:even:2]))
    at, top = ends.copy(), np.full(len(ends), -1)

    def clear(who: np.ndarray, level: int) -> np.ndarray:
        block = (at[who] >> level) - 1
        return (at[who] - (1 << level) >= lows[who]) & (high[level][block] - asked[who] < eps) & (asked[who] - low[level][block] < eps)

    # Upwards over the blocks that make up a prefix, as long as they are clear; then down within the first that isn't.
    going = np.flatnonzero(at > lows)
    for level in range(len(low)):
        here = going[(at[going] >> level) & 1 == 1]
        good = clear(here, level)
        at[here[good]] -= 1 << level
        top[here[~good]] = level
        going = going[(top[going] < 0) & (at[going] > lows[going])]
    for level in range(int(top.max(initial=0)) - 1, -1, -1):
        # Of a block that isn't clear the parts end where its end is, so they are whole blocks of their level.
        here = np.flatnonzero((top > level) & (at - (1 << level) >= lows))
        at[here[clear(here, level)]] -= 1 << level
    return at


def image_tie_break(hits: DataFrame, eps: float, rows: int = 1 << 16) -> DataFrame:
    """Within a query, an image right below a hit of nearly its score moves up, until none can.

    Swaps never change the order among images or among others, and no two of them exclude each other, so an image ends
    below the last other hit before it whose score isn't near its own, and not above an image before it. That place is
    found in one pass over rows sorted by query and rank, ``rows`` or more at a time; what is held of a query are its
    other hits' scores from the last image's place on. A null score is near none.
    """
    before = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("rank"))
    numbered = hits.withColumn("__seq", F.row_number().over(before).cast("long"))
    numbered = numbered.sortWithinPartitions("query_id", "__seq")
    names = numbered.columns

    def settle(held: list, scores: np.ndarray, base: int):
        """The places of the rows of ``held``, and what their last query hands on: its scores, and how many others lie before those."""
        columns = [pa.chunked_array([b.column(names.index(c)) for b in held]).combine_chunks() for c in ("score", "is_image", "__seq")]
        score = columns[0].cast(pa.float64()).to_numpy(zero_copy_only=False)
        image = columns[1].fill_null(False).to_numpy(zero_copy_only=False)
        first = columns[2].to_numpy() == 1
        every, ends = np.concatenate([scores, score[~image]]), len(scores) + np.cumsum(~image)
        group, begins = np.cumsum(first), np.concatenate([[0], (ends - ~image)[first]])
        low, bases = begins[group], np.concatenate([[base], np.zeros(len(begins) - 1, np.int64)])
        reached = ends.copy()
        # Queries follow one another, so a running maximum never carries over from one to the next.
        reached[image] = np.maximum.accumulate(_blocked(every, ends[image], low[image], score[image], eps))
        last = max(int(reached[image][-1]) if image.any() else 0, int(begins[-1]))
        return reached - low + bases[group], every[last:], int(bases[-1]) + last - int(begins[-1])

    def place(batches):
        held, many, scores, base = [], 0, np.zeros(0), 0

        def done():
            places, scores_, base_ = settle(held, scores, base)
            out, at = [], 0
            for b in held:
                out.append(pa.RecordBatch.from_arrays([*b.columns, pa.array(places[at : at + b.num_rows], pa.int64())], names=[*names, "__place"]))
                at += b.num_rows
            return out, scores_, base_

        for b in batches:
            if b.num_rows:
                held, many = [*held, b], many + b.num_rows
            # As many rows at once as scores are held, so that these are looked through a few times only.
            if many >= max(rows, len(scores)):
                out, scores, base = done()
                yield from out
                held, many = [], 0
        if held:
            yield from done()[0]

    placed = numbered.mapInArrow(place, T.StructType([*numbered.schema.fields, T.StructField("__place", T.LongType())]))
    order = Window.partitionBy("query_id").orderBy("__place", F.coalesce("is_image", F.lit(False)), "__seq")
    kind = hits.schema["rank"].dataType
    return placed.withColumn("rank", F.row_number().over(order).cast(kind)).select(*hits.columns)


def stitch_neighbors(centres: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """``doc_id, version_no, chunk_index, text``: each centre with its neighbours of the same version and audience, in order.

    ``(doc_id, version_no, chunk_index, permission_level, owner, text)``. A centre that comes twice counts once. The
    ids of a centre's neighbours are known beforehand, so the join is on equality.
    """
    keys = ["doc_id", "version_no", "permission_level", "owner"]
    wanted = centres.dropDuplicates(["doc_id", "version_no", "chunk_index"]).select(*keys, F.col("chunk_index").alias("centre"), F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"))
    near = wanted.join(chunks.select(*keys, "chunk_index", "text"), [*keys, "chunk_index"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"]), "\n")
    return near.groupBy("doc_id", "version_no", F.col("centre").alias("chunk_index")).agg(joined.alias("text"))


def expand_steps(hits: DataFrame, steps: DataFrame, max_steps: int = 8) -> DataFrame:
    """``query_id, chunk_id, step_no`` of siblings by intent: full (the first steps), locate (itself), specific (itself and the next), general (one around).

    Siblings share parent, permission and owner; the hit itself always stays.
    """
    h = hits.select("query_id", "intent", "parent_chunk_id", F.col("step_no").alias("at"), F.col("chunk_id").alias("hit"), "permission_level", "owner_dept")
    gap = F.col("step_no") - F.col("at")
    wanted = F.when(F.col("intent") == "full", F.col("step_no") <= max_steps).when(F.col("intent") == "locate", gap == 0).when(F.col("intent") == "specific", gap.between(0, 1)).otherwise(gap.between(-1, 1))
    near = h.join(steps, ["parent_chunk_id", "permission_level", "owner_dept"]).where(wanted | (F.col("chunk_id") == F.col("hit")))
    return near.select("query_id", "chunk_id", "step_no").union(hits.select("query_id", "chunk_id", "step_no")).distinct()


def cosurface_images(hits: DataFrame, images: DataFrame, top_docs: int = 2, per_doc: int = 3) -> DataFrame:
    """``query_id, doc_id, image_id, n``: images of a query's best documents."""
    best = hits.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    best = best.withColumn("__d", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "doc_id"))).where(F.col("__d") <= top_docs)
    seen = best.join(images, "doc_id").withColumn("n", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("image_id")))
    return seen.where(F.col("n") <= per_doc).select("query_id", "doc_id", "image_id", "n")


def pack_context(hits: DataFrame, budget: int) -> DataFrame:
    """The leading hits of each query whose texts fit the budget of characters together."""
    used = F.sum(F.char_length("text")).over(Window.partitionBy("query_id").orderBy("rank"))
    return hits.withColumn("used", used).where(F.col("used") <= budget)


def rerank(hits: DataFrame, score: Column | None, top_n: int) -> DataFrame:
    """Hits by a new score, the fused one kept; without a score (the model failed) the old order, cut and flagged."""
    if score is None:
        return hits.where(F.col("rank") <= top_n).withColumn("degraded", F.lit(True)).withColumn("rerank_score", F.lit(None).cast("double"))
    new = hits.withColumn("rerank_score", score).withColumn("degraded", F.lit(False))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "rank"))
    return new.withColumn("rank", order).where(F.col("rank") <= top_n)


def revalidate(hits: DataFrame, authority: DataFrame, strict: bool = True) -> DataFrame:
    """Hits that the authority still has as they are: active, same permission, owner and physical key. Rows without a key stay unless strict."""
    a = authority.where("is_active = 1").select("chunk_id", F.col("permission_level").alias("__p"), F.col("owner_dept").alias("__o"), F.col("pk").alias("__k"))
    same = F.col("permission_level").eqNullSafe(F.col("__p")) & F.col("owner_dept").eqNullSafe(F.col("__o")) & (F.col("pk") == F.col("__k"))
    good = hits.where("chunk_id is not null").join(a, "chunk_id").where(same).select(*hits.columns)
    return good if strict else good.unionByName(hits.where("chunk_id is null"))


def retrieve(arms: DataFrame, chunks: DataFrame, weights: dict[str, float], top_k: int, cap: int, window: int = 1) -> DataFrame:
    """From arms to stitched context: fuse, demote covers, cap by document, stitch neighbours."""
    fused = min_max_fusion(arms, weights).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "pk")))
    hits = demote_covers(fused.join(chunks.withColumnRenamed("text", "chunk_text"), "pk"))
    chosen = select_with_cap(hits, top_k, cap)
    context = stitch_neighbors(chosen, chunks, window)
    return chosen.drop("chunk_text").join(context, ["doc_id", "version_no", "chunk_index"])


def attach_dates(hits: DataFrame, versions: DataFrame, meta: DataFrame) -> DataFrame:
    """Hits with ``doc_date``, the day on which their document's current version came in; null where nothing is known."""
    current = meta.select("doc_id", F.col("current_version_no").alias("version_no")).join(versions, ["doc_id", "version_no"])
    days = current.groupBy("doc_id").agg(F.max(F.to_date("created_at")).alias("doc_date"))
    return hits.join(days, "doc_id", "left")


def page_with_more(df: DataFrame, order: list[Column], n: int, offset: int = 0) -> tuple[DataFrame, bool]:
    """A page of ``n`` rows, and whether any row follows: one row more is asked for than is shown."""
    probe = df.orderBy(*order).offset(offset).limit(n + 1)
    return probe.limit(n), probe.count() > n


def degrade_dense(arms: DataFrame, embedded: DataFrame) -> DataFrame:
    """Arms without the dense hits of queries whose embedding failed (a null or zero vector in ``embedded(query_id, embedding)``); ``degraded`` tells them."""
    failed = embedded.where(F.col("embedding").isNull() | ~F.exists("embedding", lambda x: x != 0)).select("query_id").distinct().withColumn("degraded", F.lit(True))
    out = arms.join(failed, "query_id", "left").withColumn("degraded", F.coalesce("degraded", F.lit(False)))
    return out.where(~(F.col("degraded") & (F.col("arm") == "dense")))


def retrieve_and_enrich(
    arms: DataFrame, chunks: DataFrame, weights: dict[str, float], top_k: int, cap: int, *, window: int = 1, embedded: DataFrame | None = None, score: Column | None = None, eps: float = 0.0,
    authority: DataFrame | None = None, steps: DataFrame | None = None, images: DataFrame | None = None, regime: str = "client_fusion",
) -> DataFrame:
    """``query_id, pk, doc_id, position, band, text, siblings, images``: the whole way from arms to enriched hits.

    Arms of queries without an embedding lose their dense hits (``embedded``); the rest is fused, covers go last, a new
    score may rank anew (``score``), documents are capped, images of nearly equal score move up (``eps``), hits that the
    ``authority`` no longer has go, and what stays gets its neighbours' text, the ids of its sibling steps by the query's
    ``intent``, the best documents' images, and a band of confidence. Options that are left out change nothing.
    ``chunks(pk, chunk_id, doc_id, version_no, chunk_index, text, section_title, chunk_type, permission_level, owner,
    is_image, intent, parent_chunk_id, step_no)``; the last three only with ``steps``.
    """
    from quarry.functions.status import confidence_band

    if embedded is not None:
        arms = degrade_dense(arms, embedded).drop("degraded")
    fused = min_max_fusion(arms, weights).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("fused"), "pk")))
    hits = demote_covers(fused.join(chunks.withColumnRenamed("text", "chunk_text"), "pk"))
    if score is not None:
        hits = rerank(hits, score, 1 << 30)
    chosen = select_with_cap(hits, top_k, cap)
    if eps > 0:
        tied = image_tie_break(chosen.select("query_id", "pk", F.col("position").alias("rank"), F.col("fused").alias("score"), "is_image"), eps)
        chosen = chosen.drop("position").join(tied.select("query_id", "pk", F.col("rank").alias("position")), ["query_id", "pk"])
    if authority is not None:
        chosen = revalidate(chosen.withColumn("owner_dept", F.col("owner")), authority).drop("owner_dept")
    out = chosen.join(stitch_neighbors(chosen, chunks, window), ["doc_id", "version_no", "chunk_index"])
    none = F.array().cast("array<string>")
    if steps is not None:
        cards = chosen.where("step_no is not null").withColumn("owner_dept", F.col("owner"))
        found = expand_steps(cards, steps).join(steps.select("chunk_id", F.col("parent_chunk_id").alias("parent")), "chunk_id")
        listed = found.groupBy("query_id", "parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("step_no", "chunk_id"))), lambda x: x["chunk_id"]).alias("siblings"))
        out = out.join(listed.withColumnRenamed("parent", "parent_chunk_id"), ["query_id", "parent_chunk_id"], "left")
    if images is not None:
        shown = cosurface_images(chosen.withColumn("rank", F.col("position")), images).groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(F.col("image_id").cast("string"))).alias("images"))
        out = out.join(shown, ["query_id", "doc_id"], "left")
    listing = [F.coalesce(F.col(c), none).alias(c) if c in out.columns else none.alias(c) for c in ("siblings", "images")]
    return out.select("query_id", "pk", "doc_id", "position", confidence_band(F.col("fused"), regime).alias("band"), "text", *listing)
