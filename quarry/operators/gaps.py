"""Knowledge gaps: open questions, leader clustering, folding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import is_incomplete_question, is_junk_question, question_hash
from quarry.operators.overlaps import TILE, first_like, like_pairs
from quarry.operators.sequence import running_totals
from quarry.operators.vectors import centres, narrow, near_pairs, pairs_in_tiles
from quarry.sources.steps import written


def open_gaps(log: DataFrame, closed: DataFrame, now: Column) -> DataFrame:
    """``hash, raw, asks, days, kind, message_id``: unanswered or refused questions that nothing has closed.

    ``log(message_id, session_id, created_at, answer_status, query_text)``, ``closed(hash)``. Junk goes; a question that
    lacks a subject stays only where its session has an earlier turn. A refusal outweighs no result; asks are distinct
    messages, days since the latest.
    """
    first = log.groupBy("session_id").agg(F.min("message_id").alias("first_id"))
    open_ = log.where(F.col("answer_status").isin("NO_RESULT", "REFUSAL") & ~is_junk_question(F.col("query_text"))).join(first, "session_id")
    open_ = open_.where(~is_incomplete_question(F.col("query_text")) | (F.col("message_id") > F.col("first_id")))
    grouped = open_.groupBy(question_hash(F.col("query_text")).alias("hash")).agg(
        F.min("query_text").alias("raw"), F.count_distinct("message_id").alias("asks"), F.min(F.date_diff(now, F.to_date("created_at"))).alias("days"),
        F.when(F.bool_or(F.col("answer_status") == "REFUSAL"), "refusal").otherwise("no_result").alias("kind"), F.min("message_id").alias("message_id"),
    )
    return grouped.join(closed, "hash", "left_anti")


def first_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The ids of ``nodes(id, place)`` that a walk along ``place`` would pick, skipping every node with an edge to one picked before: ``edges(a, b)``, each once, the earlier node first.

    In a round all nodes without an undecided earlier neighbour are picked at once and their later neighbours leave, so
    rounds follow the longest chain of neighbours that decides anything, not the number of nodes.
    """
    taken, open_ = [], written(edges.select("a", "b"), "open")
    left = written(nodes.select("id"), "undecided")
    while True:
        waiting = open_.select(F.col("b").alias("id")).distinct()
        picked = written(left.join(waiting, "id", "left_anti"), "picked")
        taken.append(picked)
        gone = written(open_.join(picked.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "gone")
        left = written(left.join(picked.unionByName(gone), "id", "left_anti"), "undecided")
        if not left.limit(1).count():
            break
        still = open_.join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti")
        open_ = written(still.join(picked.select(F.col("id").alias("a")), "a", "left_anti").select("a", "b"), "open")
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def _placed(members: DataFrame) -> DataFrame:
    """Members with their place by falling weight and then hash, written."""
    return written(running_totals(members, [F.desc("weight"), F.asc("hash")]).drop("before"), "members")


def leader_clusters(members: DataFrame, threshold: float = 0.90, cells: int = 64, tile: int = 2000, first: int = 16_384) -> DataFrame:
    """``hash, representative`` by greedy leader clustering of ``members(hash, vector, weight)``.

    By falling weight and then hash, a member joins the best representative before it whose cosine reaches the threshold
    (of equally good ones the first), else it becomes one. Equal vectors are one node; zero and null vectors are near
    nothing and represent themselves. Nodes come in blocks by their place, the ``first`` and then each as long as all before it: those near a
    representative so far are none, and of what is left the first independent set of its graph are representatives. So
    nodes are compared with representatives and with what is left of their block, in cells about pivots where the
    threshold's angle lets most cells be passed over, else in tiles.
    """
    placed = _placed(members.withColumn("vector", F.col("vector").cast("array<double>")))
    nodes = written(placed.groupBy("vector").agg(F.min("place").alias("id")), "vectors")
    rows = placed.join(nodes.withColumnRenamed("id", "node"), placed["vector"].eqNullSafe(nodes["vector"])).select("hash", "place", "node")
    rows = written(rows, "rows")
    plain = F.exists(F.coalesce("vector", F.array().cast("array<double>")), lambda x: x != 0)
    solid = written(nodes.where(plain), "solid")
    pivots = centres(solid, cells) if narrow(threshold) else None

    def pairs(left: DataFrame, right: DataFrame | None) -> DataFrame:
        if pivots is None:
            return pairs_in_tiles(left, right, threshold, tile)
        return near_pairs(left, left, threshold, pivots, tile).where("a < b") if right is None else near_pairs(left, right, threshold, pivots, tile)

    total, low, leaders, near = placed.count(), 0, None, []
    as_near = ["node", "leader", "cosine"]
    while low < total or leaders is None:
        high = low + max(first, low)
        block = rest = solid.where((F.col("id") >= low) & (F.col("id") < high))
        joined = None
        if leaders is not None:
            joined = written(pairs(block, leaders).toDF(*as_near), "joined")
            near.append(joined)
            rest = written(block.join(joined.select(F.col("node").alias("id")), "id", "left_anti"), "rest")
        edges = written(pairs(rest, None), "edges")
        new = written(first_independent(rest.select("id", F.col("id").alias("place")), edges), "leaders")
        near.append(edges.join(new.select(F.col("id").alias("a")), "a", "left_semi").select("b", "a", "cosine").toDF(*as_near))
        near.append(new.select(F.col("id").alias("node"), F.col("id").alias("leader"), F.lit(1.0).alias("cosine")))
        sets = written(rest.join(new, "id", "left_semi"), "leader_vectors")
        if joined is not None:
            # Those near an earlier representative may have a better one in their own block.
            others = written(block.join(joined.select(F.col("node").alias("id")), "id", "left_semi"), "others")
            near.append(written(pairs(others, sets).toDF(*as_near).where("leader < node"), "nearer"))
        leaders = sets if leaders is None else leaders.unionByName(sets)
        low = high
    # A vector's later copies may join representatives after its first.
    again = written(solid.join(rows.where("place > node").select(F.col("node").alias("id")).distinct(), "id", "left_semi"), "repeated")
    if again.limit(1).count():
        near.append(written(pairs(again, leaders).toDF(*as_near).where("leader > node"), "later"))
    found = near[0]
    for some in near[1:]:
        found = found.unionByName(some)
    best = F.max_by("leader", F.struct(F.round("cosine", 12).alias("c"), -F.col("leader")))
    found = rows.join(found, "node").where(F.col("leader") <= F.col("place")).groupBy("hash").agg(best.alias("leader"))
    names = rows.where("place = node").select(F.col("place").alias("leader"), F.col("hash").alias("representative"))
    return rows.join(found, "hash", "left").join(names, "leader", "left").select("hash", F.coalesce("representative", "hash").alias("representative"))


def two_grams(text: Column) -> Column:
    """The distinct two-grams of a text without its white space; one of fewer than two characters is its own."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\\s+", "")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(t) - 1)), lambda k: F.substring(t, k, F.lit(2))))


def text_leader_clusters(members: DataFrame, threshold: float = 0.5, first: int = 16_384, tile: int = TILE) -> DataFrame:
    """``hash, representative`` of ``members(hash, text, weight)``: a text joins the first representative before it that shares at least half of their two-grams (Jaccard), else it becomes one.

    Texts of equal two-grams are one node. Nodes come in blocks by their place, the ``first`` and then each as long as all
    before it: those near a representative so far join it, the others are compared with one another, and of them a
    first independent set are representatives too. So each is compared with representatives and with what is left of its block, in tiles; of
    texts that are all unlike one another these are all pairs.
    """
    placed = _placed(members)
    # A gram as a number: its length and its characters.
    code = lambda g: F.shiftleft(F.char_length(g).cast("long"), 42) + F.shiftleft(F.ascii(F.substring(g, 1, 1)).cast("long"), 21) + F.ascii(F.substring(g, 2, 1))
    grams = placed.select("hash", "place", F.sort_array(F.transform(two_grams(F.col("text")), code)).alias("grams"))
    nodes = written(grams.groupBy("grams").agg(F.min("place").alias("id")).select("id", F.col("grams").alias("elements")), "sets")
    rows = written(grams.join(nodes.withColumnRenamed("elements", "grams"), "grams").select("hash", "place", F.col("id").alias("node")), "rows")
    total, low, near, leaders = placed.count(), 0, None, None
    while low < total or near is None:
        high = low + max(first, low)
        rest = nodes.where((F.col("id") >= low) & (F.col("id") < high))
        if leaders is not None:
            joined = written(first_like(rest, leaders, threshold, tile), "joined")
            near = near.unionByName(joined)
            rest = written(rest.join(joined.select(F.col("node").alias("id")), "id", "left_anti"), "rest")
        edges = written(like_pairs(rest, threshold, tile), "edges")
        new = written(first_independent(rest.select("id", F.col("id").alias("place")), edges), "leaders")
        own = new.select(F.col("id").alias("node"), F.col("id").alias("leader"))
        found = own.unionByName(edges.join(new.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("node"), F.col("a").alias("leader"))).groupBy("node").agg(F.min("leader").alias("leader"))
        near = found if near is None else near.unionByName(found)
        sets = written(rest.join(new, "id", "left_semi"), "leader_sets")
        leaders = sets if leaders is None else leaders.unionByName(sets)
        low = high
    names = rows.where("place = node").select(F.col("place").alias("leader"), F.col("hash").alias("representative"))
    return rows.join(near, "node").join(names, "leader").select("hash", "representative")


def merge_groups(gaps: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per cluster: asks summed, days the least, refusal wins, headed by the representative if it is open, else by the most asked."""
    joined = gaps.join(clusters, "hash", "left").withColumn("group", F.coalesce("representative", "hash"))
    head = F.max_by("raw", F.struct((F.col("hash") == F.col("group")).alias("own"), "asks", "hash"))
    return joined.groupBy("group").agg(head.alias("raw"), F.sum("asks").alias("asks"), F.min("days").alias("days"), F.when(F.bool_or(F.col("kind") == "refusal"), "refusal").otherwise("no_result").alias("kind"), F.count("*").alias("members"))
