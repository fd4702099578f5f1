"""Closures of a parent table: ancestor chains, descendants, nearest anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.steps import written


def ancestors(tree: DataFrame, max_hops: int = 15) -> DataFrame:
    """``node, ancestor, hops, ok`` over ``tree(id, parent)``: each node with itself and all above it but the root.

    The root is the node without a parent. A chain that loops, misses a parent or is longer than ``max_hops`` is not
    ``ok``, and then the node has but its own row. Chains are put together from chains of half their length, so rounds
    grow with the logarithm of the height; each is written, as the next reads it twice.
    """
    chains = written(tree.select(F.col("id").alias("node"), F.array("id").alias("ids"), F.col("parent").alias("next"), F.lit(False).alias("lost")), "chains")
    length = 1
    while length <= max_hops + 1 and chains.where("next IS NOT NULL").limit(1).count():
        upper = chains.select(F.col("node").alias("next"), F.col("ids").alias("more"), F.col("next").alias("far"), F.col("lost").alias("gone"))
        both = chains.join(upper, "next", "left")
        missing = F.col("next").isNotNull() & F.col("more").isNull()
        longer = F.when(F.col("more").isNull(), F.col("ids")).otherwise(F.concat("ids", "more"))
        chains, length = written(both.select("node", longer.alias("ids"), F.col("far").alias("next"), (F.col("lost") | missing | F.coalesce("gone", F.lit(False))).alias("lost")), "chains"), length * 2
    ok = ~F.col("lost") & F.col("next").isNull() & (F.size("ids") <= max_hops + 1)
    roots = tree.where("parent is null").select(F.col("id").alias("ancestor"))
    each = chains.withColumn("ok", ok).select("node", F.posexplode(F.when(F.col("ok"), F.col("ids")).otherwise(F.array("node"))).alias("hops", "ancestor"), "ok")
    return each.join(roots, "ancestor", "left_anti").select("node", "ancestor", "hops", "ok")


def resolve_chains(members: DataFrame, closure: DataFrame, max_direct: int = 8) -> DataFrame:
    """``member, ids, ok`` for ``members(member, node)``: the union of the chains; any broken chain, an unknown node or too many nodes give ``[], false``."""
    sizes = members.groupBy("member").agg(F.count_distinct("node").alias("direct"))
    joined = members.distinct().join(closure, "node", "left").groupBy("member").agg(F.array_sort(F.collect_set("ancestor")).alias("ids"), F.bool_and(F.coalesce("ok", F.lit(False))).alias("ok"))
    fine = F.col("ok") & (F.col("direct") <= max_direct)
    return joined.join(sizes, "member").select("member", F.when(fine, F.col("ids")).otherwise(F.array().cast(joined.schema["ids"].dataType)).alias("ids"), fine.alias("ok"))


def descendants(closure: DataFrame, max_nodes: int = 512) -> DataFrame:
    """``root, ids, ok``: all nodes below and including each; over the limit none."""
    grouped = closure.where("ok").groupBy(F.col("ancestor").alias("root")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("node")).alias("ids"))
    fine = F.col("n") <= max_nodes
    return grouped.select("root", F.when(fine, F.col("ids")).otherwise(F.array().cast(grouped.schema["ids"].dataType)).alias("ids"), fine.alias("ok"))


def nearest_anchor(closure: DataFrame, anchors: DataFrame) -> DataFrame:
    """``node, groups``: those of the nearest ancestor that ``anchors(id, groups)`` names, an empty list included; null without any."""
    hit = closure.where("ok").join(anchors.select(F.col("id").alias("ancestor"), "groups"), "ancestor")
    near = hit.groupBy("node").agg(F.min_by("groups", "hops").alias("groups"))
    return closure.select("node").distinct().join(near, "node", "left")


def first_level(closure: DataFrame, tree: DataFrame, depth: str = "depth") -> DataFrame:
    """``node, top``: the highest ancestor at depth one or above (``tree(id, depth)``), the node itself included; null without any."""
    named = closure.where("ok").join(tree.select(F.col("id").alias("ancestor"), F.col(depth).alias("__depth")), "ancestor").where("__depth <= 1")
    top = named.groupBy("node").agg(F.max_by("ancestor", "hops").alias("top"))
    return closure.select("node").distinct().join(top, "node", "left")
