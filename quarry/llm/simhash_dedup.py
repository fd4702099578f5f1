"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct 64-bit fingerprint emits all values within half the radius of itself. Two fingerprints are within
the radius of each other exactly if they share such a value, so a shuffle on the values brings all close pairs
together without comparing fingerprints pairwise. Fingerprints are made distinct first, so a group of copies of any
size counts once, and what meets at a value is a Hamming ball: at most as many rows as there are variants.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import apart, filter_of, marked, materialise, row_key
from quarry.llm.components import connected_components

#: Bits of every byte value, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANES = (np.arange(8, dtype=np.int64) * 256)[None, :]
_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)
_BLOCK = 1 << 16


def fingerprint(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of UTF-8 bytes; zero if there are no words."""
    from functools import partial

    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxh64_intdigest(b" ".join(words), seed)
    digest = partial(xxh64_intdigest, seed=seed)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    hashes = np.fromiter(map(digest, shingles), dtype="<u8", count=len(words) - width + 1)
    return votes(hashes)


def votes(hashes: np.ndarray) -> int:
    """The fingerprint of shingle hashes (``<u8``): bits set in over half of them."""
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        lanes = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8) + _LANES
        count += (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(_WEIGHTS[count * 2 > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(doc_id, fp)``, one row per row; ``fp`` is the fingerprint as a signed long. Null texts count as empty."""
    return _printed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), width)


def _printed(source: DataFrame, width: int) -> DataFrame:
    """``source`` with the fingerprint ``fp`` of its last column in that column's place."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in texts), dtype=np.uint64, count=len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])

    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField("fp", T.LongType())]))


def ball(radius: int) -> list[int]:
    """Signed masks of all 64-bit values with at most ``radius / 2`` bits."""
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: then any two values that meet are within it")
    unsigned = [sum(1 << k for k in bits) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    return [x - (1 << 64) if x >> 63 else x for x in unsigned]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """``distinct(fp)`` to ``(a, b)``: edges that connect all fingerprints within ``radius`` bits of each other.

    Whatever meets at a variant lies within the radius of each other, so an edge from each to the smallest there
    keeps every connection; all pairs of a ball are never made. Each edge is verified on its own bits.
    """
    met = distinct.select("fp", F.explode(F.array(*map(F.lit, ball(radius)))).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    least = met.withColumn("a", F.min("fp").over(Window.partitionBy("variant")))
    pairs = least.where("a <> fp").select("a", F.col("fp").alias("b")).distinct()
    return pairs.where(F.expr(f"bit_count(a ^ b) <= {int(radius)}"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest doc_id reachable).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows stay repeated. Null ids take
    part and never name a component unless all its ids are null. An empty table gives no rows. Other columns of
    ``docs`` are not read.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, width), "fingerprints")
    return _with_components(prints, radius).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_components(prints: DataFrame, radius: int) -> DataFrame:
    groups = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "groups")
    labels = connected_components(links(groups.select("fp"), radius))
    members = groups.join(labels.withColumnRenamed("node", "fp"), "fp")
    roots = members.groupBy("label").agg(F.min("first_id").alias("root_id"))
    named = members.join(roots, "label").select("fp", "root_id")
    # Written, so that the join below reads both sides anew and a fingerprint of very many rows can be split.
    classes = materialise(groups.join(named, "fp", "left").select("fp", F.coalesce("root_id", "first_id").alias("component_id")), "classes")
    return prints.join(classes, "fp")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs``, one of each group of near-duplicates: the one with the smallest id.

    Among rows of the same id the smallest key of id and text stays, among rows equal in both one of them. Null and
    empty texts are one group. Null ids take part; a row of one stays only if its group has no other ids. An empty
    table gives no rows; the columns are the input's, whatever they are called.
    """
    row = apart(docs) + "row"
    keyed = docs.withColumn(row, row_key(F.col(id_col), F.col(text_col)))
    source = keyed.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = materialise(_printed(source, width).groupBy("row", "doc_id", "fp").agg(F.count("*").alias("n")), "rows")
    return keep_first(docs, keyed, materialise(_with_components(seen, radius), "whole"), row)


def keep_first(docs: DataFrame, keyed: DataFrame, whole: DataFrame, row: str) -> DataFrame:
    """The rows of ``docs`` that are first in their component. ``keyed`` is ``docs`` with ``row``, a key of id and text; ``whole``: ``doc_id, row, n`` (rows of that hash), ``component_id``."""
    many, hash_, open_ = (apart(keyed) + x for x in ("many", "hash", "open"))
    best = whole.groupBy("component_id", F.col("component_id").isNull().alias("none")).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "n")).alias("best"))
    kept = materialise(best.select(F.col("best.row").alias(row), (F.col("best.n") > 1).alias(many)), "kept")
    # Rows that surely stay, as no row that goes or comes again has their hash, aren't shuffled.
    unsure = whole.select("row", "n").join(kept.select(F.col(row).alias("row")), "row", "left_anti").union(whole.where("n > 1").select("row", "n"))
    hashed = marked(keyed.withColumn(hash_, F.xxhash64(row)), hash_, filter_of(unsure.select(F.xxhash64("row").alias("h"))), open_)
    sure = hashed.where(~F.col(open_)).select(*docs.columns)
    joined = hashed.where(open_).join(kept, row)
    single = sure.union(joined.where(~F.col(many)).select(*docs.columns))
    if kept.where(F.col(many)).limit(1).count() == 0:
        return single
    return single.union(joined.where(F.col(many)).dropDuplicates([row]).select(*docs.columns))
