"""Mixing sources to target weights, in DataFrame functions only.

Each source is one stream of words cut into blocks of a fixed length, and has as many slots as its target takes. The
slots of every source are drawn into the output shards, each as likely: a shard's source counts are then multinomial by
the target weights, and the draws of a source add up to its slots, so targets are met rather than hit in expectation.
A shard's draws number a source's slots on from the shards before; those numbers map through the source's own
pseudorandom permutation (one per pass over the source) to block indices, and blocks join to slots by index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import apart, materialise, partitions

#: Weights by rank of the source (code point order, null last), repeating.
WEIGHTS = (5, 2, 1)
_SPACE = "\\x20\\x09-\\x0D"
_ROUNDS = 24
#: Slots that one row makes, and that one task makes at most.
_CHUNK, _TASK = 4096, 1 << 20
#: Trials up to which a binomial draw counts them one by one; beyond, it rounds a normal draw.
_COUNTED = 64


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.regexp_count(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), F.lit(f"[{_SPACE}][^{_SPACE}]")).cast("long")


def permuted(x: Column, n: Column, seed: int, *key: Column, inverse: bool = False) -> Column:
    """A keyed pseudorandom permutation of 0 .. n-1 (swap-or-not: each round mirrors x or leaves it, by a hashed bit)."""
    rounds = range(_ROUNDS - 1, -1, -1) if inverse else range(_ROUNDS)

    def step(acc: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(F.lit(seed), r, *key), n) - acc, n)
        swap = F.pmod(F.xxhash64(F.lit(seed + 1), r, F.greatest(acc, mirror), *key), F.lit(2)) == 1
        return F.when(swap, mirror).otherwise(acc)

    return F.aggregate(F.array(*map(F.lit, rounds)), x.cast("long"), step)


def _uniform(seed: int, *key: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def binomial(n: Column, p: Column, seed: int, *key: Column) -> Column:
    """A pseudorandom binomial draw of ``n`` trials, told by its key."""
    few = F.size(F.filter(F.sequence(F.lit(1), F.lit(_COUNTED)), lambda i: (i <= n) & (_uniform(seed, i, *key) < p))).cast("long")
    normal = F.sqrt(-2 * F.ln(_uniform(seed + 1, *key))) * F.cos(2 * math.pi * _uniform(seed + 2, *key))
    many = F.greatest(F.lit(0).cast("long"), F.least(n, F.round(n * p + F.sqrt(n * p * (1 - p)) * normal).cast("long")))
    return F.when(n <= _COUNTED, few).otherwise(many)


def draw_shards(sources: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """``sources`` with its ``n_slots`` drawn into shards: a row per source and ``shard`` with ``drawn`` of them.

    The shards are halved again and again, and each half's slots are a binomial draw of the whole's.
    """
    names = sources.columns
    drawn = sources.withColumn("part", F.struct(F.lit(0).alias("low"), F.lit(n_shards).alias("high"), F.col("n_slots").alias("n")))
    for level in range(max(0, math.ceil(math.log2(n_shards)))):
        low, high, n = (F.col(f"part.{x}") for x in ("low", "high", "n"))
        mid = F.expr("(part.low + part.high) div 2").cast("int")
        half = drawn.withColumn("left", binomial(n, (mid - low) / (high - low), seed + 3 * level, F.col("src"), low))
        split = F.when(high - low > 1, F.array(F.struct(low.alias("low"), mid.alias("high"), F.col("left").alias("n")), F.struct(mid.alias("low"), high.alias("high"), (n - F.col("left")).alias("n")))).otherwise(F.array("part"))
        drawn = half.select(*names, F.explode(split).alias("part"))
    return drawn.select(*names, F.col("part.low").alias("shard"), F.col("part.n").alias("drawn"))


class Mix:
    """The plan of a mix: ``sources``, ``docs`` (rows with their place in their source's stream), ``slots``."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, source_col: str, share: float, most: float, block_words: int, n_shards: int, seed: int, weights: tuple[float, ...]):
        self.block_words = block_words
        text = F.col(text_col)
        rows = docs.select(
            F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("src"),
            word_count(text).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col).cast("long"), text).alias("place"), F.xxhash64(text, F.lit(0)).alias("text_hash"),
        )
        rows = materialise(rows, "sizes")
        # As many buckets as rows in a bucket of a single source: neither window below holds over about the root of all rows.
        n_buckets = max(1, int(rows.count() ** 0.5))
        rows = rows.withColumn("bucket", F.pmod(F.shiftright("place", 20), F.lit(n_buckets)))
        buckets = materialise(rows.groupBy("src", "bucket").agg(F.sum("size").alias("words")), "bucket_sizes")
        self.sources = materialise(self._sources(buckets, share, most, weights), "sources")
        before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = buckets.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
        offsets = offsets.join(self.sources.select("src", "source_size", "target"), "src")
        within = Window.partitionBy("src", "bucket").orderBy("place", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
        placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
        self.docs = placed.join(offsets, ["src", "bucket"]).withColumn("start", F.col("offset") + F.col("inner")).drop("bucket", "inner", "offset", "place")
        self.slots = self._slots(seed, n_shards)

    def _sources(self, buckets: DataFrame, share: float, most: float, weights: tuple[float, ...]) -> DataFrame:
        """Targets: each takes its weight's share up to ``most`` times its size; what that leaves goes to the others by weight."""
        by_name = Window.orderBy(F.col("src") == "n", F.expr("substr(src, 2)"))
        by_room = Window.orderBy("room", "rank")
        all_ = Window.partitionBy()
        own = buckets.groupBy("src").agg(F.sum("words").alias("source_size")).withColumn("rank", F.row_number().over(by_name) - 1)
        own = own.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
        own = own.withColumn("room", most * F.col("source_size") / F.col("weight")).withColumn("total", share * F.sum("source_size").over(all_))
        capped = F.coalesce(F.sum(most * F.col("source_size")).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        open_ = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
        own = own.withColumn("level", (F.col("total") - capped) / open_).withColumn("level", F.max("level").over(all_))
        target = F.least(most * F.col("source_size"), F.col("level") * F.col("weight"))
        length = self.block_words
        own = own.select("src", "rank", "weight", "source_size", target.alias("target"), F.floor(target + 0.5).cast("long").alias("words"), F.ceil(F.col("source_size") / length).cast("long").alias("n_blocks"))
        own = own.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0).cast("long")))
        own = own.withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
        last = F.when(F.col("rest") > 0, F.least("n_blocks", F.expr(f"rest div {length}") + 2)).otherwise(F.lit(0).cast("long"))
        return own.withColumn("n_slots", F.col("passes") * F.col("n_blocks") + last)

    def _draws(self, seed: int, n_shards: int) -> DataFrame:
        """Sources by shards: the slots ``drawn``, the number of the first of them in the source and of their first place in the shard."""
        drawn = materialise(draw_shards(self.sources.where("n_slots > 0"), n_shards, seed + 30), "draws")
        before = lambda w: F.coalesce(F.sum("drawn").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
        numbered = drawn.withColumn("first", before(Window.partitionBy("src").orderBy("shard"))).withColumn("place", before(Window.partitionBy("shard").orderBy("rank")))
        return materialise(numbered.withColumn("per_shard", F.sum("drawn").over(Window.partitionBy("shard"))).where("drawn > 0"), "shards")

    def _slots(self, seed: int, n_shards: int) -> DataFrame:
        """``src, pass, block, take, shard, slot``: the first ``take`` words of the block go to that slot of the shard."""
        length = self.block_words
        self.draws = self._draws(seed, n_shards)
        total = self.draws.agg(F.sum("drawn").alias("n")).first()["n"] or 0
        chunks = self.draws.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(drawn - 1) div {_CHUNK}"))))
        # A count of partitions by the slots, which adaptive execution does not merge: a row makes thousands.
        chunks = chunks.repartition(max(partitions(self.draws.sparkSession), math.ceil(total / _TASK)), "src", "shard", "chunk")
        slots = chunks.withColumn("k", F.explode(F.sequence(F.col("chunk") * _CHUNK, F.least(F.col("drawn"), (F.col("chunk") + 1) * _CHUNK) - 1))).withColumn("q", F.col("first") + F.col("k"))
        slots = slots.withColumn("pass", F.expr("q div n_blocks")).withColumn("j", F.expr("q % n_blocks"))
        slots = slots.withColumn("block", permuted(F.col("j"), F.col("n_blocks"), seed + 10, F.col("src"), F.col("pass")))
        # All blocks hold as many words but the stream's last, which is short; where it stands in this pass shifts what came before.
        short_at = permuted(F.col("n_blocks") - 1, F.col("n_blocks"), seed + 10, F.col("src"), F.col("pass"), inverse=True)
        lacks = F.col("n_blocks") * length - F.col("source_size")
        came = F.col("j") * length - F.when(short_at < F.col("j"), lacks).otherwise(0)
        holds = length - F.when(F.col("block") == F.col("n_blocks") - 1, lacks).otherwise(0)
        take = F.when(F.col("pass") < F.col("passes"), holds).otherwise(F.least(holds, F.col("rest") - came))
        slot = permuted(F.col("place") + F.col("k"), F.col("per_shard"), seed + 20, F.col("shard"))
        return slots.withColumn("take", take).where("take > 0").select("src", "pass", "block", "take", "shard", slot.alias("slot"))

    def segments(self) -> DataFrame:
        """``docs`` by the blocks that they lie in; ``low`` and ``high`` count words from the block's start."""
        length = self.block_words
        cut = self.docs.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {length}"), F.expr(f"(start + size - 1) div {length}"))))
        low = F.greatest(F.col("start") - F.col("block") * length, F.lit(0).cast("long"))
        high = F.least(F.col("start") + F.col("size") - F.col("block") * length, F.lit(length).cast("long"))
        return cut.withColumn("low", low).withColumn("high", high)

    def taken_segments(self) -> DataFrame:
        """Segments joined to slots by block index, cut to the words that the slot takes."""
        # Slots grow with the input while the draws that make them do not, so Spark would take them for a small side.
        joined = self.segments().join(self.slots.hint("merge"), ["src", "block"])
        return joined.withColumn("high", F.least("high", "take")).where("high > low")


def plan_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: float = 2.0,
    block_words: int = 1024, n_shards: int = 64, seed: int = 17, weights: tuple[float, ...] = WEIGHTS,
) -> Mix:
    """Plans the mix of ``docs``; only id, text and source are read.

    Null texts have no words. Null sources form a source of their own, the last. Rows without words are never
    taken. Repeated rows are separate rows of their stream. An empty table gives empty plans.
    """
    return Mix(docs, id_col, text_col, source_col, share, most, block_words, n_shards, seed, weights)


def mix_counts(mix: Mix) -> DataFrame:
    """One row per document row: ``doc_id, size, source_size, target, taken`` (words that the mix takes, repeats counted)."""
    taken = mix.taken_segments().groupBy("src", "start").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    worded = mix.docs.where("size > 0").join(taken, ["src", "start"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    bare = mix.docs.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    names = ["doc_id", "size", "source_size", "target", "taken"]
    return worded.select(*names).unionByName(bare.select(*names))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{_SPACE}]+"), lambda w: w != "")


def mix_documents(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Rows of ``docs`` as the mix takes them: one per document and pass, with the words taken there as its text.

    A document taken whole in a pass keeps its text as it is; else its words are joined by spaces. Rows with a null,
    empty or blank text are never taken. Rows equal in source, id and text are taken as often as the mix says, with the
    other columns of one of them. Null ids and sources take part. An empty table gives no rows; the columns are the
    input's, whatever they are called.
    """
    own = apart(docs)
    src, id_, hash_, many, cut = (own + n for n in ("src", "id", "hash", "many", "parts"))
    key = [F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias(src), F.col(id_col).cast("long").alias(id_), F.xxhash64(F.col(text_col), F.lit(0)).alias(hash_)]
    at = F.struct((F.col("low") + F.col("block") * mix.block_words - F.col("start")).alias("at"), (F.col("high") - F.col("low")).alias("n"))
    parts = mix.taken_segments().groupBy("src", "doc_id", "text_hash", "start", "pass").agg(F.sort_array(F.collect_list(at)).alias("parts"))
    rows = mix.docs.groupBy("src", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    parts = parts.join(rows, [parts.src == rows.src, parts.doc_id.eqNullSafe(rows.doc_id), parts.text_hash == rows.text_hash]).select(
        parts.src.alias(src + "_"), parts.doc_id.alias(id_ + "_"), parts.text_hash.alias(hash_ + "_"), F.col("parts").alias(cut), (F.col("n") > 1).alias(many))
    parts = materialise(parts, "parts")
    keyed = docs.select("*", *key)

    def joined(left: DataFrame, repeated: bool) -> DataFrame:
        right = parts.where(F.col(many) == repeated)
        return left.join(right, (F.col(src) == F.col(src + "_")) & F.col(id_).eqNullSafe(F.col(id_ + "_")) & (F.col(hash_) == F.col(hash_ + "_")))

    out = joined(keyed, False)
    if parts.where(F.col(many)).limit(1).count():
        out = out.unionByName(joined(keyed.dropDuplicates([src, id_, hash_]), True))
    whole = F.aggregate(F.col(cut), F.lit(0).cast("long"), lambda acc, p: acc + p["n"]) == word_count(F.col(text_col))
    # The words are bound once as a lambda's variable; within the inner lambda alone they would be cut anew for every part.
    held = F.array(F.struct(_words(F.col(text_col)).alias("words"), F.col(cut).alias("parts")))
    some = F.transform(held, lambda h: F.array_join(F.flatten(F.transform(h["parts"], lambda p: F.slice(h["words"], (p["at"] + 1).cast("int"), p["n"].cast("int")))), " "))[0]
    return out.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(some)).select(*docs.columns)


def mix_blocks(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The packed blocks themselves: ``shard, slot, source, n_words, text``, each block's words joined by spaces.

    Slots are gapless but where a source's last block takes no words. Null texts and sources as in ``plan_mix``; other
    columns aren't read; an empty table gives no rows.
    """
    pieces = mix.taken_segments().select("shard", "slot", "src", "doc_id", "text_hash", "start", F.col("low"), (F.col("low") + F.col("block") * mix.block_words - F.col("start")).alias("at"), (F.col("high") - F.col("low")).alias("n"))
    texts = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("src"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col), F.lit(0)).alias("text_hash"), F.col(text_col).alias("text"),
    ).dropDuplicates(["src", "doc_id", "text_hash"])
    hit = pieces.join(texts, (pieces.src == texts.src) & pieces.doc_id.eqNullSafe(texts.doc_id) & (pieces.text_hash == texts.text_hash)).select("shard", "slot", pieces.src, "low", "n", F.slice(_words(F.col("text")), (F.col("at") + 1).cast("int"), F.col("n").cast("int")).alias("words"))
    packed = hit.groupBy("shard", "slot", "src").agg(F.sum("n").alias("n_words"), F.sort_array(F.collect_list(F.struct("low", "words"))).alias("parts"))
    return packed.select("shard", "slot", F.when(F.col("src") != "n", F.expr("substr(src, 2)")).alias("source"), "n_words", F.array_join(F.flatten(F.transform("parts", lambda p: p["words"])), " ").alias("text"))
