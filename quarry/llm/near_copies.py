"""Near copies by the Jaccard similarity of word shingles, found by SimHash balls first and by rare shingles beyond them.

Texts of equal words are one class before anything meets. Classes whose SimHash fingerprints lie within the radius are
candidates by ball hashing. At a similarity of 0.8, fingerprints typically differ in about ten bits, which no ball
reaches, so an exact search takes the rest: of two sets that similar, with their shingles in one order, each holds a
common one among its first ``n - ceil(s n) + 1``, at places that leave enough shingles behind. The order puts shingles
first that are rare by a sketch of fixed size, so texts that share but a common passage don't meet. Bit maps of the sets,
two to four bits a shingle, bound what a pair can have in common; those that pass are judged on their whole sets. Among those that meet at a shingle, members are compared with centres, few at first and
four times as many in each further round, and only with those outside their component: a large group of near copies is
linked in about as many comparisons as it has members, and no pair of unlike components is left out. Once no more
comparisons are left than there are classes, one round makes them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import apart, discard, filter_of, marked, materialise, row_key, slices
from quarry.llm.components import connected_components
from quarry.llm.simhash_dedup import keep_first, links, votes

#: Words of a shingle, the similarity of near copies, the radius of fingerprints, and the counters of the sketch that
#: tells common shingles, with how many of the highest of them count (whatever it says, no pair is lost).
WIDTH, SIMILARITY, RADIUS, COUNTERS, HEAVY = 5, 0.8, 2, 1 << 21, 1 << 17
#: So many comparisons are few, however few classes there are.
FEW = 10_000


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles in ascending order; a shorter text is one shingle, without words there is none."""
    return np.unique(_runs((text or b"").lower().split(), width))


def _runs(words: list[bytes], width: int) -> np.ndarray:
    from functools import partial

    from xxhash import xxh64_intdigest

    if not words:
        return np.empty(0, dtype=np.uint64)
    count = max(1, len(words) - width + 1)
    runs = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(partial(xxh64_intdigest, seed=42), runs), dtype=np.uint64, count=count)


def least_common(size: int, similarity: float) -> int:
    """What two sets have in common at least, if they are as similar as that and one is of this size."""
    return int(np.ceil(similarity * size - 1e-9))


def prefix(hashes: np.ndarray, weights: np.ndarray, similarity: float) -> np.ndarray:
    """Of distinct shingles, the first in the order of their weights (then hashes) that any set as similar must meet; signed."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    order = weights[hashes & np.uint64(COUNTERS - 1)].astype(np.uint64) << np.uint64(32) | hashes >> np.uint64(32)
    count = len(hashes) - least_common(len(hashes), similarity) + 1
    first = np.argsort(order, kind="stable")[:count]
    return hashes[first].view(np.int64)


def bit_map(hashes: np.ndarray) -> np.ndarray:
    """The map of a set by its shingles' lowest bits, of two to four bits a shingle (64 at least, a power of two), in words."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length()) if len(hashes) else 64
    seen = np.zeros(bits, dtype=bool)
    seen[(hashes & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(seen, bitorder="little").view("<i8")


def lacking(x: np.ndarray, y: np.ndarray) -> int:
    """How many shingles of one set another lacks at least, by their maps of any two lengths: each bit without its like in ``y`` stands for one or more."""
    if len(y) > len(x):
        y = np.bitwise_or.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count((x.reshape(-1, len(y)) & ~y).view(np.uint64)).sum())


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """``docs(row, doc_id, text)`` to ``row, doc_id, words, size, fp``: the hash of a row's words, its number of distinct shingles, its fingerprint. A row without ``words`` has a task's ``heavy`` counters."""
    from xxhash import xxh3_128_digest

    names = ["row", "doc_id", "words", "size", "fp", "heavy"]
    pairs = pa.list_(pa.struct([("counter", pa.int64()), ("n", pa.int64())]))

    def run(batches):
        counters, total = np.zeros(COUNTERS, dtype=np.uint32), 0
        for b in slices(batches, 2048):
            words, sizes, prints = [], [], []
            for x in b.column(2).cast(pa.binary()):
                said = (x.as_py() or b"").lower().split()
                hashes = _runs(said, width)
                distinct = np.unique(hashes)
                places, n = np.unique(distinct & np.uint64(COUNTERS - 1), return_counts=True)
                counters[places.astype(np.int64)] += n.astype(np.uint32)
                total += len(distinct)
                words.append(xxh3_128_digest(b" ".join(said)))
                sizes.append(len(distinct))
                prints.append(votes(hashes))
            fps = np.array(prints, dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps), pa.nulls(len(words), pairs)], names=names)
        mean = total / COUNTERS
        # What stands out a little in many tasks stands out much in their sum.
        heavy = np.flatnonzero(counters >= max(2, np.ceil(mean + 2 * mean**0.5 + 1)))
        found = pa.StructArray.from_arrays([pa.array(heavy, pa.int64()), pa.array(counters[heavy], pa.int64())], fields=list(pairs.value_type))
        held = pa.ListArray.from_arrays(np.array([0, len(found)], dtype=np.int32), found)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), held], names=names)

    return docs.mapInArrow(run, "row binary, doc_id long, words binary, size long, fp long, heavy array<struct<counter: long, n: long>>")


def _weights(prints: DataFrame) -> np.ndarray:
    """How common the shingles of each counter are, of the ``HEAVY`` highest ones, which reach the driver; 0 for others."""
    counted = prints.where("words is null").select(F.explode("heavy").alias("x")).groupBy("x.counter").agg(F.sum("x.n").alias("n"))
    heavy = counted.orderBy(F.desc("n"), "counter").limit(HEAVY).toArrow()
    out = np.zeros(COUNTERS, dtype=np.uint32)
    out[heavy.column("counter").to_numpy()] = np.minimum(heavy.column("n").to_numpy(), (1 << 32) - 1)
    return out


def _prefixes(docs: DataFrame, weights: np.ndarray, width: int, similarity: float) -> DataFrame:
    """``docs(row, text)`` to ``row, prefix, map``."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for b in slices(batches):
            sets = [shingles(x.as_py(), width) for x in b.column(1).cast(pa.binary())]
            found = pa.array([prefix(s, shared.value, similarity) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), found, pa.array([bit_map(s) for s in sets], pa.list_(pa.int64()))], names=["row", "prefix", "map"])

    return docs.mapInArrow(run, "row binary, prefix array<long>, map array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """``docs(node, text)`` to ``node, shingles``."""

    def run(batches):
        for b in slices(batches):
            sets = [shingles(x.as_py(), width).view(np.int64) for x in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>")


def _like(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are as similar as that."""
    left, right = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"of_{x}")) for x in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    return both.where(F.col("common") >= F.lit(similarity - 1e-9) * (F.size("of_a") + F.size("of_b") - F.col("common"))).select("a", "b")


def _sized(similarity: float):
    """Sets whose sizes allow that similarity."""
    return F.least("size", "size_a") >= F.lit(similarity - 1e-9) * F.greatest("size", "size_a")


def _enough(similarity: float) -> Column:
    """Whether behind the place where two sets meet there are as many shingles as they need in common."""
    behind = F.least(F.col("size") - F.col("at"), F.col("size_a") - F.col("at_a"))
    return behind >= F.lit(similarity / (1 + similarity)) * (F.col("size") + F.col("size_a")) - F.lit(1e-6)


def _by_fingerprint(classes: DataFrame, radius: int, similarity: float) -> DataFrame:
    """``a, b``: of each fingerprint, the first class with all others, and of fingerprints within the radius, their first classes."""
    firsts = materialise(classes.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("first")).select("fp", F.col("first.node").alias("a"), F.col("first.size").alias("size_a")), "firsts")
    same = classes.join(firsts, "fp").where((F.col("node") != F.col("a")) & _sized(similarity)).select("a", F.col("node").alias("b"))
    near = materialise(links(firsts.select("fp"), radius).withColumnsRenamed({"a": "fp", "b": "fp_b"}), "near_prints")
    other = firsts.select(F.col("fp").alias("fp_b"), F.col("a").alias("b"), F.col("size_a").alias("size"))
    return same.union(near.join(firsts, "fp").join(other, "fp_b").where(_sized(similarity)).select("a", "b"))


def _possible(pairs: DataFrame, maps: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` that by ``maps(node, size, map)`` may have enough in common: what one's bits lack in the other's is common to neither."""
    met = materialise(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "met_nodes")
    few = materialise(maps.join(met, "node", "left_semi"), "maps")
    left, right = (few.select(F.col("node").alias(x), F.col("size").alias(f"n_{x}"), F.col("map").alias(f"of_{x}")) for x in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "of_a", "of_b")

    def run(batches):
        for b in slices(batches):
            sizes, maps_ = [b.column(k).to_pylist() for k in (2, 3)], [b.column(k) for k in (4, 5)]
            kept = []
            for k, (n, m) in enumerate(zip(*sizes, strict=True)):
                x, y = (c[k].values.to_numpy() for c in maps_)
                kept.append(min(n - lacking(x, y), m - lacking(y, x)) >= similarity / (1 + similarity) * (n + m) - 1e-6)
            yield b.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    out = materialise(both.mapInArrow(run, "a long, b long"), "pairs")
    discard(met, few)
    return out


def _labels(classes: DataFrame, met: DataFrame, maps: DataFrame, sets_of, similarity: float, radius: int, few: int) -> DataFrame | None:
    """``node, label`` of the components over ``classes(node, size, fp)`` that meet by fingerprint or in ``met(key, node, size, at, place)``."""
    def judged(pairs: DataFrame) -> DataFrame | None:
        met_ = materialise(pairs, "met")
        pairs = _possible(met_, maps, similarity)
        discard(met_)
        if not pairs.limit(1).count():
            discard(pairs)
            return None  # no link, so no text need be read again
        sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        out = materialise(_like(pairs, sets, similarity), "links")
        discard(pairs, sets)
        return out

    links_ = judged(_by_fingerprint(classes, radius, similarity))
    labels = connected_components(links_) if links_ is not None else None
    members, left = _open(met, labels)
    low, step = 0, 1
    while left:
        # Few comparisons are made at once: each is of one outside the shingle's largest component. Else centres come by their places.
        last_round = left <= few
        centre = F.col("label") != F.col("main") if last_round else F.col("place") < low + step
        centres = members.where(centre).select("key", F.col("node").alias("a"), F.col("place").alias("before"), F.col("size").alias("size_a"), F.col("at").alias("at_a"), F.col("label").alias("label_a"))
        earlier = (F.col("before") < F.col("place")) | (F.col("before") == F.col("place")) & (F.col("a") < F.col("node"))
        new = earlier | (F.col("label") == F.col("main")) if last_round else earlier
        together = members.join(centres, "key").where(new & (F.col("label") != F.col("label_a")) & _sized(similarity) & _enough(similarity))
        more = judged(together.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())
        if more is not None:
            links_ = links_.union(more) if links_ is not None else more
            before, labels = labels, connected_components(links_)
            if before is not None:
                discard(before)
        if last_round:
            break
        low, step = low + step, step * 4
        # What has been a centre is done, and so is a shingle whose members are all of one component.
        last = members
        members, left = _open(members.where(F.col("place") >= low).drop("label", "main"), labels)
        discard(last)
    discard(members)
    return labels


def _open(members: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, int]:
    """``members`` with their ``label``, of shingles at which several components meet, and the ``main`` one there, that of most members; how many pairs of unlike components meet."""
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")) if labels is not None else members.withColumn("label", F.col("node"))
    labelled = materialise(named, "labelled")
    each = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    whole = each.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("like"))
    mixed = materialise(whole.where("n > most.n").select("key", F.col("most.label").alias("main"), ((F.col("n") * F.col("n") - F.col("like")) / 2).alias("pairs")), "mixed")
    left = int(mixed.agg(F.sum("pairs")).first()[0] or 0)
    out = materialise(labelled.join(mixed.select("key", "main"), "key"), "members")
    discard(labelled, mixed)
    return out, left


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS, few: int | None = None) -> DataFrame:
    """The rows of ``docs``, one of each group that is linked by texts of that similarity or more: the one with the smallest id.

    Among rows of the same id the smallest key of id and text stays, among rows equal in both one of them. Null, empty
    and blank texts are one group. Null ids take part; a row of one stays only if its group has no other ids. An empty
    table gives no rows; the columns are the input's, whatever they are called. ``few`` (if not given,
    the number of classes) is how many comparisons one last round may make; it changes no result.
    """
    row = apart(docs) + "row"
    keyed = docs.withColumn(row, row_key(F.col(id_col), F.col(text_col)))
    source = keyed.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = materialise(_signatures(source, width), "signatures")
    weights = _weights(prints)
    prints_ = prints.where("words is not null")
    classes = prints_.groupBy("words").agg(F.first("size").alias("size"), F.first("fp").alias("fp"), F.min("row").alias("stand"))
    # Once written, the numbers stay what they are.
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("node"), "words", "size", "fp", "stand"), "classes")
    rows = materialise(prints_.groupBy("words", "row", "doc_id").agg(F.count("*").alias("n")), "rows")
    seen = materialise(rows.join(classes.select("words", "node"), "words").select("row", "doc_id", "n", "node"), "seen")
    discard(prints, rows)
    found = _prefixes(source.select("row", "text"), weights, width, similarity)
    # Of rows equal in id and text one stands; each task's copies go before the shuffle.
    stands = classes.select("node", "size", F.col("stand").alias("row"))
    one = found.join(stands, "row").groupBy("node").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("map").alias("map"))
    kept = materialise(one, "prefixes")
    met = materialise(kept.select("node", "size", F.posexplode("prefix").alias("at", "key")), "met")
    counts = materialise(met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    # Most shingles are one text's alone; a filter keeps nearly all of those out of the shuffle.
    met_ = marked(met, "key", filter_of(counts.select(F.col("key").alias("h"))), "open").where("open")
    # A member's place among those that meet is a hash spread over their number, so no task holds them all.
    place = (F.pmod(F.xxhash64("key", "node"), F.lit(1 << 52)) / float(1 << 52)) * F.col("n")
    members = materialise(met_.join(counts, "key").select("key", "node", "size", "at", place.alias("place")), "meetings")
    discard(met, counts)

    def sets_of(nodes: DataFrame) -> DataFrame:
        # One row stands for all of equal words; only candidates' texts are read again, and few others shuffled.
        stand = materialise(classes.select("node", F.col("stand").alias("row")).join(nodes, "node", "left_semi"), "wanted")
        near = marked(source.select("row", "text", F.xxhash64("row").alias("h")), "h", filter_of(stand.select(F.xxhash64("row").alias("h"))), "open").where("open")
        out = materialise(_sets(near.join(stand, "row").select("node", "text"), width).dropDuplicates(["node"]), "sets")
        discard(stand)
        return out

    few = max(FEW, classes.count()) if few is None else few
    labels = _labels(classes.select("node", "size", "fp"), members, kept.select("node", "size", "map"), sets_of, similarity, radius, few)
    discard(members, kept)
    whole = seen.join(labels, "node", "left").withColumn("component_id", F.coalesce("label", "node")) if labels is not None else seen.withColumn("component_id", F.col("node"))
    whole = whole.select("doc_id", "row", "n", "component_id")
    return keep_first(docs, keyed, materialise(whole, "whole"), row)
