"""Exact duplicates by deterministic block naming, without Python on the executors.

A text's blocks of a fixed size are sorted into integer names; adjacent pairs of names are sorted into names of their
own, again and again, until every text has one name. Two texts have the same name at the same level if and only if they
are equal: no hash decides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialise
from quarry.llm.naming import named, names_of

#: Bytes of a block.
BLOCK = 4096


def normalised(text: Column) -> Column:
    """The text with every run of white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[ \\t-\\r]+", " ")


def identities(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK, mark: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """One row per document: ``row`` (a number of its own), ``doc_id``, ``text_sha256``, ``level`` and ``name``.

    ``level`` and ``name`` together are the same for equal texts and for no others. Null texts are empty, an empty text
    is one empty block, repeated rows are rows of their own, an empty table gives none. Other columns aren't read.
    """
    body = F.encode(normalised(F.col(text_column)), "UTF-8")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), body.alias("body"))
    sized = texts.select("row", "doc_id", "body", F.sha2("body", 256).alias("sha"), F.greatest(F.lit(1), F.ceil(F.octet_length("body") / block)).cast("int").alias("n"))
    cut = F.expr(f"transform(sequence(0, n - 1), i -> substring(body, i * {block} + 1, {block}))")
    blocks = sized.select("row", "doc_id", "n", "sha", F.posexplode(cut).alias("i", "block"))
    blocks = blocks.withColumns({"sha": F.when(F.col("i") == 0, F.col("sha")), "doc_id": F.when(F.col("i") == 0, F.col("doc_id"))})
    first = materialise(named(blocks, ["block"], mark), "blocks")
    levels = max(1, first.agg(F.max("n")).first()[0] or 1)
    at, level, ends, steps = first.select("row", "i", "n", "name"), 0, [], []
    for level in range((levels - 1).bit_length() + 1):
        half, even = F.shiftright("i", 1), F.col("i") % 2 == 0
        two = at.groupBy("row", half.alias("i")).agg(F.max("n").alias("n"), F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-(1 << 62))).alias("b"))
        pairs = materialise(two, "pairs")
        steps.append(pairs)
        ends.append(pairs.where("n = 1").select("row", F.lit(level).alias("level"), F.col("a").alias("name")))
        if level < (levels - 1).bit_length():
            more = pairs.where("n > 1")
            at = more.join(names_of(more, "a", "b"), ["a", "b"]).select("row", "i", F.ceil(F.col("n") / 2).cast("int").alias("n"), "name")
    found = ends[0]
    for e in ends[1:]:
        found = found.union(e)
    out = materialise(first.where("i = 0").select("row", "doc_id", F.col("sha").alias("text_sha256")).join(found, "row"), "identities")
    discard(first, *steps)
    return out


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts (white space runs as one space) the smallest id stays, null ids only where the group has no others;
    of repeated rows one stays. ``keep_id`` is null if all ids are. Null texts equal empty ones; an empty table gives no rows.
    """
    rows = identities(docs, id_column, text_column, block)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row"))
    groups = materialise(rows.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first")), "groups")
    both = rows.join(groups, ["level", "name"])
    return both.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever those are called; see :func:`exact_groups` for which."""
    numbered = materialise(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.monotonically_increasing_id().alias("number")), "numbered")
    rows = identities(numbered.select(F.struct(F.col(f"all.`{id_column}`").alias("id"), "number").alias("doc_id"), F.col(f"all.`{text_column}`").alias("text")))
    order = F.min(F.struct(F.col("doc_id.id").isNull().alias("no"), "doc_id"))
    stay = rows.groupBy("level", "name").agg(order.alias("first")).select(F.col("first.doc_id.number").alias("number"))
    return numbered.join(stay, "number", "left_semi").select("all.*")
