"""Prefix tries over conversations: succinct shards in level order, and the heavy levels above them.

Every prefix of a conversation gets an integer name (blocks of ``STEP`` turns, then blocks of blocks, so the rounds grow
with the logarithm of the longest conversation). A prefix with more than ``LIMIT`` members is heavy; such nodes lie on
top of the trie and are summed up as rows. What hangs below them is cut into shards, at most ``LIMIT`` conversations
wide and ``BAND`` turns deep; tasks write them as LOUDS bit vectors with label arrays, and roll them up from the last
level to the first. What lies deeper still is summed up as rows again and enters the shards at their lowest level. So
neither a conversation, nor a group of copies, nor a common prefix is ever one task's.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import discard, materialise, slices
from quarry.llm.naming import named

#: Members beyond which a prefix is heavy, and turns of a shard below the heavy ones.
LIMIT, BAND = 100, 256
#: Turns that are named at once.
STEP = 16
#: Rows after which a task closes a forest of shards.
ROWS = 100_000
#: The node without turns.
ROOT = -1
#: The turns that a conversation takes over from the first of its hundred, at most.
SHARED = 5
#: Ids of members in one string, as a power of two.
CHUNK = 12

_TRIE = (
    "louds binary, tops array<long>, ups array<long>, starts array<long>, nodes array<long>, labels array<long>, chars array<long>, members array<long>, ends array<long>,"
    " child_at array<long>, child_leaves array<long>, child_saved array<long>"
)
_NODE = "node long, up long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long"


def labelled(conversations: DataFrame) -> DataFrame:
    """``conv, at, label, chars``: turns as integers, ``at`` the place of a turn among all turns by conversation and turn.

    Sorted over all tasks by conversation and turn, so a long conversation is spread like any other rows.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = ["conv", F.col("turn").asc_nulls_first()]
    placed = materialise(turns.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text").withColumn("seq", F.monotonically_increasing_id()), "placed")
    counts = placed.groupBy(F.shiftright("seq", 33).alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row per task
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = named(placed.select("conv", "seq", F.char_length("text").cast("long").alias("chars"), "role", "text"), ["role", "text"])
    at = rows.withColumn("part", F.shiftright("seq", 33)).join(F.broadcast(counts.select("part", before.alias("before"))), "part")
    out = materialise(at.select("conv", (F.col("before") + F.col("seq").bitwiseAND((1 << 33) - 1)).alias("at"), F.col("name").alias("label"), "chars"), "labelled")
    discard(placed)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as rebuilt: ``plan(conv, length)`` and ``rows(conv, i, label, chars)``, ``i`` from 0.

    Conversation c begins with the first h turns of the conversation c - c % 100 (fewer if it has fewer, none if there
    is none) and goes on with its own after its first h; h is the checksum of the decimal c modulo ``SHARED + 1``.
    """
    convs = turns.groupBy("conv").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (SHARED + 1)
    convs = materialise(convs.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % 100}), "convs")
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = convs.join(convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("taken", taken)
    plan = materialise(plan.withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))), "plan")
    rank = F.col("at") - F.col("first")
    own = turns.join(plan.select("conv", "first", "h", "taken"), "conv").where(rank >= F.col("h")).select("conv", (F.col("taken") + rank - F.col("h")).alias("i"), "label", "chars")
    heads = turns.join(convs.where("conv = base").select("conv", "first"), "conv").where(rank < SHARED).select(F.col("conv").alias("base"), rank.alias("i"), "label", "chars")
    lead = plan.join(heads, "base").where("i < h").select("conv", "i", "label", "chars")
    return plan.select("conv", "length"), materialise(own.unionByName(lead), "rebuilt")


def prefix_names(rows: DataFrame, longest: int) -> DataFrame:
    """``rows(conv, i, label)`` to ``(conv, i, node)``: equal for those conversations whose labels 0 to i are equal, and for no others."""
    pair = F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda x: x["label"])
    blocks = rows.groupBy("conv", F.floor(F.col("i") / STEP).alias("j")).agg(pair.alias("labels"))
    if longest > STEP:
        blocks = materialise(blocks, "blocks")
        whole = named(blocks.where(F.size("labels") == STEP), ["labels"]).select("conv", F.col("j").alias("i"), F.col("name").alias("label"))
        above = prefix_names(whole, longest // STEP).select("conv", (F.col("i") + 1).alias("j"), F.col("node").alias("before"))
        blocks = blocks.join(above, ["conv", "j"], "left").withColumn("before", F.coalesce("before", F.lit(ROOT)))
    else:
        blocks = blocks.withColumn("before", F.lit(ROOT).cast("long"))
    paths = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.slice("labels", 1, k))
    each = blocks.select("conv", "j", "before", F.posexplode(paths).alias("k", "path"))
    return materialise(named(each, ["before", "path"]).select("conv", (F.col("j") * STEP + F.col("k")).alias("i"), F.col("name").alias("node")), "names")


def tree_sums(nodes: DataFrame) -> DataFrame:
    """``nodes(node, up, n_leaves, saved)`` (``up`` null or another of them) with both summed over subtrees.

    Each round adds what lies twice as deep: the rounds grow with the logarithm of the height.
    """
    sums = materialise(nodes, "sums")
    while sums.where("up IS NOT NULL").limit(1).count():
        add = sums.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
        more = sums.join(add, "node", "left").select("node", "up", (F.col("n_leaves") + F.coalesce("l", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        farther = sums.where("up IS NOT NULL").select(F.col("node").alias("up"), F.col("up").alias("far"))
        before, sums = sums, materialise(more.join(farther, "up", "left").select("node", F.col("far").alias("up"), "n_leaves", "saved"), "sums")
        discard(before)
    return sums.select("node", "n_leaves", "saved")


def louds(shard: np.ndarray, conv: np.ndarray, i: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The forest of some shards: bits, each node's first row, each conversation's last node, the conversations, and the shards in order.

    Node 0 stands above all shards; the others are numbered level by level, children of a node by label. The bits give
    every node, in that order, a 1 for each child and then a 0.
    """
    shards, of = np.unique(shard, return_inverse=True)
    start = np.full(len(shards), np.iinfo(np.int64).max)
    np.minimum.at(start, of, i)
    level = i - start[of]
    convs, who = np.unique(conv, return_inverse=True)
    order = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[order], np.arange(level.max() + 2))
    at, parents, firsts, many = np.zeros(len(convs), np.int64), [np.zeros(0, np.int64)], [], 1
    for ell in range(len(bounds) - 1):
        rows = order[bounds[ell] : bounds[ell + 1]]
        above = at[who[rows]] if ell else of[rows]
        sort = np.lexsort((label[rows], above))
        a, b = above[sort], label[rows][sort]
        new = np.ones(len(rows), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        node = np.empty(len(rows), np.int64)
        node[sort] = many + np.cumsum(new) - 1
        at[who[rows]] = node
        parents.append(a[new] if ell else np.zeros(new.sum(), np.int64))
        firsts.append(rows[sort[new]])
        many += int(new.sum())
    degree = np.bincount(np.concatenate(parents), minlength=many)
    bits = np.ones(int(degree.sum()) + many, np.uint8)
    bits[np.cumsum(degree + 1) - 1] = 0
    return bits, np.concatenate(firsts), at, convs, shards


def parents_of(bits: np.ndarray) -> np.ndarray:
    """The parent of every node but the one above all, by counting zeros before its 1."""
    return np.cumsum(bits == 0)[np.flatnonzero(bits)]


def _tries(batches):
    """Whole shards, sorted by shard, to rows of ``_TRIE``."""
    names = ("shard", "up", "conv", "i", "label", "chars", "node", "child", "child_leaves", "child_saved")

    def build(c: dict[str, np.ndarray]) -> pa.RecordBatch:
        bits, first, ends, convs, shards = louds(c["shard"], c["conv"], c["i"], c["label"])
        node = c["node"][first]
        tops = len(shards)
        below, kid = np.unique(c["child"][c["child"] != ROOT], return_index=True)
        rows = np.flatnonzero(c["child"] != ROOT)[kid]
        number = {n: k + 1 for k, n in enumerate(node.tolist())} if len(below) else {}
        row = {
            "louds": np.packbits(bits).tobytes(), "tops": shards, "ups": c["up"][first[:tops]], "starts": c["i"][first[:tops]], "nodes": node, "labels": c["label"][first], "chars": c["chars"][first],
            "members": convs, "ends": ends, "child_at": [number[n] for n in c["node"][rows].tolist()], "child_leaves": c["child_leaves"][rows], "child_saved": c["child_saved"][rows],
        }
        return pa.RecordBatch.from_arrays([pa.array([row["louds"]], pa.binary()), *[pa.array([np.asarray(v, np.int64)], pa.list_(pa.int64())) for k, v in row.items() if k != "louds"]], names=list(row))

    held, n = [], 0
    for b in batches:
        held.append({c: b.column(c).to_numpy(zero_copy_only=False) for c in names})
        n += b.num_rows
        if n >= ROWS:
            all_ = {c: np.concatenate([h[c] for h in held]) for c in names}
            last = int(np.searchsorted(all_["shard"], all_["shard"][-1]))
            if last:
                yield build({c: v[:last] for c, v in all_.items()})
            held, n = [{c: v[last:] for c, v in all_.items()}], n - last
    if n:
        yield build({c: np.concatenate([h[c] for h in held]) for c in names})


def roll_up(batches):
    """Rows of ``_TRIE`` to rows of ``_NODE``: members, leaves and saved tokens, added up from the last level to the first."""
    for batch in slices(batches, 1):
        for t in batch.to_pylist():
            many, tops = len(t["nodes"]) + 1, len(t["tops"])
            parent = np.concatenate([[0], parents_of(np.unpackbits(np.frombuffer(t["louds"], np.uint8))[: 2 * many - 1])]).astype(np.int64)
            ends, chars = np.array(t["ends"], np.int64), np.array([0, *t["chars"]], np.int64)
            n_convs, least = np.zeros(many, np.int64), np.full(many, np.iinfo(np.int64).max)
            np.add.at(n_convs, ends, 1)
            np.minimum.at(least, ends, np.array(t["members"], np.int64))
            at = np.array(t["child_at"], np.int64)
            children = np.bincount(parent[1:], minlength=many) + np.bincount(at, minlength=many)
            n_leaves, extra = (children == 0).astype(np.int64), np.zeros(many, np.int64)
            np.add.at(n_leaves, at, np.array(t["child_leaves"], np.int64))
            np.add.at(extra, at, np.array(t["child_saved"], np.int64))
            depth, low, high, levels = np.zeros(many, np.int64), 1, 1 + tops, []
            depth[1:high] = np.array(t["starts"], np.int64) + 1
            while low < high:  # the children of a level are the next nodes
                levels.append((low, high))
                more = int(np.searchsorted(parent, high))
                depth[high:more] = depth[parent[high:more]] + 1
                low, high = high, more
            for a, b in reversed(levels[1:]):
                np.add.at(n_convs, parent[a:b], n_convs[a:b])
                np.minimum.at(least, parent[a:b], least[a:b])
            saved = (n_convs - 1) * chars + extra
            for a, b in reversed(levels[1:]):
                np.add.at(n_leaves, parent[a:b], n_leaves[a:b])
                np.add.at(saved, parent[a:b], saved[a:b])
            up = pa.array(t["ups"] + [None] * (many - 1 - tops), pa.int64())
            above = pa.array(least[parent[1:]], pa.int64(), mask=np.arange(1, many) <= tops)
            values = [pa.array(t["nodes"], pa.int64()), up, least[1:], depth[1:], above, n_convs[1:], children[1:], n_leaves[1:], saved[1:]]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in values], names=[f.split()[0] for f in _NODE.split(", ")])


def _outer(rows: DataFrame, stats: DataFrame) -> DataFrame:
    """``stats(node, conv_id, depth, ...)`` with ``up``, the node above: the smallest member tells."""
    above = stats.where("depth > 1").join(rows.select(F.col("conv").alias("conv_id"), (F.col("i") + 2).alias("depth"), F.col("node").alias("up")), ["conv_id", "depth"])
    return above.unionByName(stats.where("depth = 1").withColumn("up", F.lit(ROOT).cast("long")))


def _stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.max("chars").alias("chars"), (F.max("i") + 1).alias("depth"))


def shards(conversations: DataFrame, limit: int = LIMIT, band: int = BAND) -> dict[str, DataFrame]:
    """The steps of a trie: ``plan``, ``rows`` (with ``node``), ``heavy`` nodes, ``deep`` ones, and ``tries``, the shards as rows of bits and arrays."""
    plan, rows = rebuilt(labelled(conversations))
    plan = materialise(plan, "lengths")
    longest = int(plan.agg(F.max("length")).first()[0] or 0)
    rows = materialise(rows.join(prefix_names(rows.select("conv", "i", "label"), longest), ["conv", "i"]), "rows")
    heavy = materialise(_stats(rows).where(F.col("n_convs") > limit), "heavy")
    marked = rows.join(heavy.select("node", F.lit(True).alias("is_heavy")), "node", "left")
    place = F.struct("i", "node")
    tops = marked.groupBy("conv").agg(F.max(F.when(F.col("is_heavy"), place)).alias("up"), F.min(F.when(F.col("is_heavy").isNull(), place)).alias("top")).where("top IS NOT NULL")
    tops = materialise(tops.select("conv", F.coalesce("up.node", F.lit(ROOT)).alias("up"), F.col("top.node").alias("shard"), F.col("top.i").alias("k")), "tops")
    light = rows.join(tops, "conv").where("i >= k")
    inside = light.where(F.col("i") - F.col("k") < band)
    none = {"child": F.lit(ROOT).cast("long"), "child_leaves": F.lit(0).cast("long"), "child_saved": F.lit(0).cast("long")}
    deep = None
    if longest > band:
        stats = materialise(light.where(F.col("i") - F.col("k") >= band).groupBy("node").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.max("chars").alias("chars"), (F.max("i") + 1).alias("depth"), F.max(F.col("i") - F.col("k") == band).alias("first")), "deep_stats")
        own = materialise(_outer(rows, stats), "deep_nodes")
        kids = own.where("NOT first").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
        own = materialise(own.join(kids, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "deep_kids")
        start = own.select("node", F.when(~F.col("first"), F.col("up")).alias("up"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
        deep = materialise(own.join(tree_sums(start), "node"), "deep")
        entry = light.where(F.col("i") - F.col("k") == band).select("conv", (F.col("i") - 1).alias("i"), F.col("node").alias("child"))
        entry = entry.join(deep.where("first").select(F.col("node").alias("child"), F.col("n_leaves").alias("child_leaves"), F.col("saved").alias("child_saved")), "child")
        inside = inside.join(entry, ["conv", "i"], "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    else:
        inside = inside.withColumns(none)
    packed = inside.select("shard", "up", "conv", "i", "label", "chars", "node", *none).repartition("shard").sortWithinPartitions("shard").mapInArrow(_tries, _TRIE)
    return {"plan": plan, "rows": rows, "heavy": heavy, "deep": deep, "tries": materialise(packed, "tries")}


def _digest(batches):
    """Chunks sorted by node and place to one digest per node, as a stream: no list of members is held."""
    node, sha = None, None
    for b in batches:
        for n, ids in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if n != node:
                if sha:
                    yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [sha.hexdigest()]})
                node, sha = n, hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if sha:
        yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [sha.hexdigest()]})


def end_digests(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """``node, ends_sha256`` of every node at which a conversation ends: the SHA-256 of their ids, ascending, with commas."""
    last = plan.where("length > 0").select("conv", (F.col("length") - 1).alias("i")).join(rows.select("conv", "i", "node"), ["conv", "i"]).select("conv", "node")
    last = last.unionByName(plan.where("length = 0").select("conv", F.lit(ROOT).cast("long").alias("node")))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    chunks = materialise(last.groupBy("node", F.shiftright("conv", CHUNK).alias("chunk")).agg(ids.alias("ids")), "chunks")
    counts = chunks.groupBy("node").agg(F.count(F.lit(1)).alias("many"), F.min("ids").alias("ids"))
    one = counts.where("many = 1").select("node", F.sha2("ids", 256).alias("ends_sha256"))
    several = chunks.join(counts.where("many > 1").select("node"), "node", "left_semi").select("node", "chunk", "ids")
    return one.unionByName(several.repartition("node").sortWithinPartitions("node", "chunk").mapInArrow(_digest, "node long, ends_sha256 string"))


def prefix_trie(conversations: DataFrame, limit: int = LIMIT, band: int = BAND) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns are ordered by ``turn``, null first, then by role and text; null roles and texts are empty; repeated rows are
    turns of their own; rows without conversation aren't read. A conversation that keeps no turn is a member of the root
    alone. Without conversations there are no rows. Other columns aren't read. Shards are no wider than ``limit``
    conversations and no deeper than ``band`` turns; neither changes the result.
    """
    step = shards(conversations, limit, band)
    plan, rows, heavy, deep = step["plan"], step["rows"], step["heavy"], step["deep"]
    low = materialise(step["tries"].mapInArrow(roll_up, _NODE), "low")
    root = plan.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).cast("long").alias("node"), "n_convs", "conv_id", F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("up"))
    top = materialise(_outer(rows, heavy).unionByName(root), "top")
    hung = low.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("l"), F.sum("saved").alias("s"))
    heavy_kids = top.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("heavy_kids"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("kids", "l", "s", "heavy_kids")}
    own = top.join(hung, "node", "left").join(heavy_kids, "node", "left").withColumns(zero).withColumn("n_children", F.col("kids") + F.col("heavy_kids"))
    own = materialise(own.select("node", "up", "conv_id", "depth", "n_convs", "n_children", (F.col("l") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"), (F.col("s") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "own")
    sums = tree_sums(own.select("node", "up", "n_leaves", "saved"))
    columns = ["node", "up", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved"]
    outer = own.drop("n_leaves", "saved").join(sums, "node").select(*columns)
    if deep is not None:
        outer = outer.unionByName(deep.select(*columns))
    outer = outer.unionByName(low.where("up IS NOT NULL").select(*columns))
    nodes = low.select("node", "conv_id").unionByName(own.select("node", "conv_id"))
    if deep is not None:
        nodes = nodes.unionByName(deep.select("node", "conv_id"))
    found = outer.join(nodes.select(F.col("node").alias("up"), F.col("conv_id").alias("parent_conv_id")), "up", "left")
    out = found.drop("up").unionByName(low.where("up IS NULL").drop("up")).join(end_digests(plan, rows), "node", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
