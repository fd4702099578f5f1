"""Sharding as a two-pass external shuffle.

The first pass scatters records by seeded hashes into buckets of bounded size, each within one shard. The second
loads one bucket at a time, deals its records in a Fisher-Yates order and numbers them. A shard is the one with the
highest hash of id and shard, so one more shard takes records only into itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import apart, materialise, partitions

#: Bytes of text that a bucket aims at, and the most partitions that buckets are dealt to.
BUCKET_BYTES, MOST_PARTITIONS = 8 << 20, 20_000
#: Equal rows that one row makes at most where they are made again.
_EQUAL = 4096


def key_hash(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def shard_of(key: Column, n_shards: int, seed: int) -> Column:
    """The shard with the highest hash of (key, shard): it depends on the key and the count alone.

    One more shard wins only the keys whose highest hash is its own.
    """
    ranked = [F.struct(F.xxhash64(F.lit(seed), F.lit(k), key).alias("h"), F.lit(k).alias("shard")) for k in range(n_shards)]
    return (F.greatest(*ranked) if n_shards > 1 else ranked[0])["shard"]


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """The order in which a bucket's rows are dealt: place k swaps with a uniform place from k on."""
    order = np.arange(n)
    rng = np.random.default_rng(seed & (1 << 64) - 1)
    picks = rng.integers(np.arange(n), n) if n else order
    for k, j in enumerate(picks.tolist()):
        order[k], order[j] = order[j], order[k]
    return order


def _hashed(docs: DataFrame) -> list[Column]:
    """The columns of ``docs`` as a hash reads them."""
    return [F.to_json(F.col(f.name)) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in docs.schema.fields]


def _split(labelled: DataFrame, full: DataFrame, columns: list[str], hashed: list[Column], seed: int) -> DataFrame:
    """``labelled`` with the rows of the places in ``full(shard, place, parts)`` spread over that many places of their shard, by a hash of a row and of its number among equal rows.

    Equal rows are counted and made again, with numbers, so that any group of them comes apart, and alike however the
    input is partitioned.
    """
    keys = [*columns, "shard", "place"]
    heavy = labelled.join(full, ["shard", "place"]).groupBy(*keys, "parts").agg(F.count("*").alias("n"))
    heavy = heavy.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {_EQUAL}"))))
    number = F.explode(F.sequence(F.col("block") * _EQUAL, F.least(F.col("n"), (F.col("block") + 1) * _EQUAL) - 1))
    heavy = heavy.repartition(partitions(labelled.sparkSession), "block", "place", "shard").withColumn("number", number)
    place = F.pmod(F.xxhash64(F.lit(seed + 2), *hashed, F.col("number")), F.col("parts")).cast("int")
    return labelled.join(full, ["shard", "place"], "left_anti").select(*keys).unionByName(heavy.withColumn("place", place).select(*keys))


def shuffle_into_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` with ``shard`` (int), ``bucket`` (int) and ``slot`` (long, gapless from 0 within a shard).

    Every row is kept with all its columns; input columns named like the three new ones are replaced. Null ids and
    texts hash as themselves and take part. Rows equal in id and text land in one bucket; the rows of a bucket that is
    overfull all the same (equal rows, or an overlong one) are spread over as many as their shard fills. The result is
    the same however the input is partitioned; only rows equal in all columns stand for each other. An empty table
    gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("shard", "bucket", "slot")]
    own = apart(docs)
    # Inside, the input's columns have names that nothing here clashes with.
    inner = docs.select(*[F.col(c).alias(f"{own}{k}") for k, c in enumerate(kept)])
    columns, hashed = inner.columns, _hashed(inner)
    id_, text = (F.col(f"{own}{kept.index(c)}") for c in (id_col, text_col))
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 64
    total = inner.select(F.sum(size).alias("bytes")).first()["bytes"] or 0
    each = max(1, math.ceil(total / n_shards / bucket_bytes))
    spread = F.pmod(F.xxhash64(F.lit(seed + 1), id_, text), F.lit(each)).cast("int")
    labelled = inner.withColumn("shard", shard_of(id_, n_shards, seed)).withColumn("place", spread)

    def counted(rows: DataFrame) -> DataFrame:
        return materialise(rows.groupBy("shard", "place").agg(F.count("*").alias("n"), F.sum(size).alias("bytes")), "buckets")

    counts = counted(labelled)
    full = counts.where(F.col("bytes") > 8 * bucket_bytes)
    if full.limit(1).count():
        by_shard = counts.groupBy("shard").agg(F.ceil(F.sum("bytes") / bucket_bytes).cast("int").alias("parts"))
        each = max(each, by_shard.agg(F.max("parts").alias("parts")).first()["parts"])
        labelled = _split(labelled, materialise(full.select("shard", "place").join(by_shard, "shard"), "full"), columns, hashed, seed)
        counts = counted(labelled)
    bucket = (F.col("shard") * each + F.col("place")).alias("bucket")
    before = Window.partitionBy("shard").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    fields = [T.StructField(c, f.dataType, f.nullable) for c, f in zip(columns, inner.schema.fields, strict=True)]
    schema = T.StructType([*fields, T.StructField("shard", T.IntegerType()), T.StructField("bucket", T.IntegerType()), T.StructField("slot", T.LongType())])

    def deal(key, rows: pa.Table, start: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_pylist([], schema=pa.schema([f for f in rows.schema if f.name != "order"] + [pa.field("slot", pa.int64())]))
        # A fixed order first, so that a repeated task deals alike whatever order its rows came in.
        place = np.argsort(rows.column("order").to_numpy(), kind="stable")
        place = place[fisher_yates(len(place), seed * 1_000_003 + key[0].as_py())]
        first = start.column("first_slot")[0].as_py()
        dealt = rows.take(pa.array(place)).drop_columns(["order"])
        return dealt.append_column("slot", pa.array(np.arange(first, first + len(place)), pa.int64()))

    # As many partitions as buckets, up to a bound: then a task sorts few buckets, and loads them one at a time.
    n = max(partitions(docs.sparkSession), min(each * n_shards, MOST_PARTITIONS))
    order = F.xxhash64(F.lit(seed + 3), *hashed).alias("order")
    scattered = labelled.select(*columns, "shard", bucket, order).repartition(n, "bucket")
    dealt = scattered.groupBy("bucket").cogroup(offsets.repartition(n, "bucket").groupBy("bucket")).applyInArrow(deal, schema)
    return dealt.select(*[F.col(c).alias(name) for c, name in zip(columns, kept, strict=True)], "shard", "bucket", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, without another shuffle: a file holds whole buckets, each in the order of its slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
