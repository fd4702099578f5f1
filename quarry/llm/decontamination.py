"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with up to k edits. Cut into k + 1 pieces, at least one piece then occurs
unchanged; an Aho-Corasick automaton over all pieces finds those hits in one pass over a text, and Myers' bit-parallel
distance verifies the windows around them. Items come in blocks of bounded size, each block in one pass over all rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import apart

#: Edits allowed per character of an item, the shortest item that is looked for, and characters of items in a block.
EDITS, SHORTEST, BLOCK_CHARS = 0.05, 32, 4 << 20


def normalised(text: Column) -> Column:
    """Lower case, with every run of characters other than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+", " "))


def pieces(text: str, count: int) -> list[tuple[int, str]]:
    """``count`` pieces of nearly equal length that cover the text, with their places."""
    cuts = [len(text) * k // count for k in range(count + 1)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass
class Pattern:
    """An item and its masks for Myers' algorithm."""

    item_id: int
    text: str
    edits: int

    def __post_init__(self) -> None:
        self.masks = _masks(self.text)
        self.back = _masks(self.text[::-1])


def _masks(text: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for k, c in enumerate(text):
        masks[c] |= 1 << k
    return dict(masks)


def best_end(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of ``text`` and the first place where it ends.

    ``anchored``: to a prefix of ``text`` instead.
    """
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, best, at = full, 0, m, m, 0
    carry = 1 if anchored else 0
    get = masks.get
    for k, c in enumerate(text, 1):
        eq = get(c, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        plus = down | (full & ~(diag | up))
        minus = diag & up
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best, at = score, k
        plus = plus << 1 & full | carry
        up = (minus << 1 & full) | (full & ~(diag | plus))
        down = plus & diag
    return best, at


class Index:
    """A block of items: the automaton over their pieces."""

    def __init__(self, items: list[tuple[int, str]], edits: float):
        import ahocorasick

        if not 0 <= edits < 1:
            raise ValueError("edits must be at least 0 and below 1 per character: an item that may be replaced whole is in every text")

        self.patterns = [Pattern(n, t, math.floor(len(t) * edits)) for n, t in items]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, p in enumerate(self.patterns):
            for at, piece in pieces(p.text, p.edits + 1):
                found[piece].append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """``(item_id, distance, first, end)``: each item at the place of its least distance, if within its edits."""
        windows: dict[int, list[list[int]]] = {}
        for end, (n, places) in self.automaton.iter(text):
            for k, at in places:
                p = self.patterns[k]
                low = end + 1 - n - at - p.edits
                high = low + len(p.text) + 2 * p.edits
                own = windows.setdefault(k, [])
                if own and low <= own[-1][1] and low >= own[-1][0]:
                    own[-1][1] = max(high, own[-1][1])
                else:
                    own.append([low, high])
        out = []
        for k, own in windows.items():
            p, best = self.patterns[k], None
            for low, high in _merged(own):
                low = max(0, low)
                score, at = best_end(p.masks, len(p.text), text[low:high])
                if score <= p.edits and (best is None or score < best[0]):
                    best = (score, low + at)
            if best:
                score, end = best
                near = text[max(0, end - len(p.text) - p.edits) : end][::-1]
                out.append((p.item_id, score, end - best_end(p.back, len(p.text), near, anchored=True)[1], end))
        return out


def _merged(windows: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(windows):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, shortest: int, block_chars: int) -> list[list[tuple[int, str]]]:
    """The items in blocks; one block at a time reaches the driver. An item over a block's size is its own block."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), normalised(F.col(text_col)).alias("text")).where(F.length("text") >= max(1, shortest)).distinct()
    total = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    count = max(1, math.ceil(total / block_chars))
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        if rows:
            yield sorted((r["item_id"], r["text"]) for r in rows)


def _indexed(spark, items: list[tuple[int, str]], edits: float):
    """A function that gives the block's index, made once in each Python worker."""
    shared = spark.sparkContext.broadcast(items)

    def index() -> Index:
        held = globals().setdefault("_HELD", {})
        if shared.value is not held.get("items"):
            held.update(items=shared.value, index=Index(shared.value, edits))
        return held["index"]

    return index


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, distance, first, end``: items that occur in a row's normalised text within their edits.

    An item may have ``floor(edits * its length)`` edits. One row per row of ``docs`` and item, at the place of least
    distance; places count characters of the normalised text. Items shorter than ``shortest`` characters, null and
    empty ones match nothing. Null and empty texts, empty tables and clean rows give no rows; repeated rows repeat
    theirs. Other columns aren't read.
    """
    schema = "doc_id long, item_id long, distance int, first long, end long"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, item_id_col, item_text_col, shortest, block_chars):
        index = _indexed(docs.sparkSession, items, edits)

        def run(batches, index=index):
            found = index()
            for b in batches:
                hits = [(n, *hit) for n, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for hit in found.find(t.as_py())]
                columns = list(zip(*hits, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "distance", "first", "end"])

        out = out.union(rows.mapInArrow(run, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS, shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no item occurs; nothing is shuffled.

    Null and empty texts hold no item and stay, as do repeated rows without one. Null, empty and too short items occur
    nowhere, so that an empty benchmark keeps every row. Columns are the input's, whatever they are called; an empty
    table gives no rows.
    """
    normal = apart(docs) + "normal"
    shape = T.StructType([*docs.schema.fields, T.StructField(normal, T.StringType())])
    rows = docs.withColumn(normal, normalised(F.col(text_col)))
    for items in _blocks(benchmark, item_id_col, item_text_col, shortest, block_chars):
        index = _indexed(docs.sparkSession, items, edits)

        def run(batches, index=index):
            found = index()
            for b in batches:
                yield b.filter(pa.array([not found.find(t.as_py()) for t in b.column(b.num_columns - 1)], pa.bool_()))

        rows = rows.mapInArrow(run, shape)
    return rows.select(*docs.columns)
