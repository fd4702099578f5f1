"""Sets that have much in common, compared in tiles: what two sets share is a product of 0-1 matrices over their common elements, and rare elements are counted one by one."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sets of a side of a tile, of a matrix, and how many pairs a tile may have for each in which an element is met before it is a column of the matrices.
TILE, SIDE, RARE = 4096, 1024, 512


class _Side:
    """Sets as the entries of their elements, for one matrix's rows."""

    def __init__(self, rows: np.ndarray, elements: np.ndarray, n: int, columns: np.ndarray) -> None:
        self.n, column = n, columns[elements]
        full = column >= 0
        self.full = (rows[full], column[full])
        order = np.argsort(elements[~full], kind="stable")
        self.rare, self.rare_rows = elements[~full][order], rows[~full][order]

    def matrix(self, width: int) -> np.ndarray:
        out = np.zeros((self.n, width), np.float32)
        out[self.full] = 1
        return out


def _rare_in_common(a: _Side, b: _Side) -> np.ndarray | None:
    low, high = np.searchsorted(b.rare, a.rare), np.searchsorted(b.rare, a.rare, side="right")
    met = high - low
    if not met.any():
        return None
    out, ends = np.zeros(a.n * b.n, np.float32), np.cumsum(met)
    # As many meetings at once as there are pairs.
    cuts = np.searchsorted(ends, np.arange(a.n * b.n, ends[-1] + a.n * b.n, a.n * b.n), side="left") + 1
    start = 0
    for cut in cuts.tolist():
        m = met[start:cut]
        if not m.sum():
            start = cut
            continue
        of_b = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[start:cut], m)
        out += np.bincount(np.repeat(a.rare_rows[start:cut], m) * b.n + b.rare_rows[of_b], minlength=len(out))
        start = cut
    return out.reshape(a.n, b.n)


def _like(p: list[np.ndarray], q: list[np.ndarray], threshold: float):
    """``i, j`` of the sets of both lists whose Jaccard similarity is at least the threshold, a matrix at a time."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (p, q)]
    flat = [np.concatenate([np.asarray(s) for s in side]) if n.sum() else np.zeros(0, np.int64) for side, n in zip((p, q), sizes, strict=True)]
    both = np.intersect1d(*flat)
    entries = []
    for n, f in zip(sizes, flat, strict=True):
        at = np.minimum(np.searchsorted(both, f), max(0, len(both) - 1))
        there = both[at] == f if len(both) else np.zeros(len(f), bool)
        entries.append((np.repeat(np.arange(len(n)), n)[there], at[there]))
    counts = [np.bincount(e, minlength=len(both)).astype(float) for _, e in entries]
    common = counts[0] * counts[1] * RARE > len(p) * len(q)
    columns = np.where(common, np.cumsum(common) - 1, -1)
    width = int(common.sum())

    def cut(rows: np.ndarray, elements: np.ndarray, n: int):
        for low in range(0, n, SIDE):
            inside = slice(*np.searchsorted(rows, [low, low + SIDE]))
            yield low, _Side(rows[inside] - low, elements[inside], min(SIDE, n - low), columns)

    right = list(cut(*entries[1], len(q)))
    for low, a in cut(*entries[0], len(p)):
        x = a.matrix(width)
        for low_b, b in right:
            shared = x @ b.matrix(width).T
            rare = _rare_in_common(a, b)
            if rare is not None:
                shared += rare
            na, nb = sizes[0][low : low + a.n], sizes[1][low_b : low_b + b.n]
            share = threshold / (1 + threshold)
            i, j = np.nonzero(shared >= (share * na - 1e-3).astype(np.float32)[:, None] + (share * nb).astype(np.float32)[None, :] - np.float32(1e-5) * (na.max() + nb.max()))
            n = shared[i, j].astype(float)
            # Two empty sets have no similarity.
            good = np.flatnonzero(n / np.maximum(na[i] + nb[j] - n, 1) >= threshold)
            yield i[good] + low, j[good] + low_b


def _tiles(count: int, tile: int) -> int:
    return max(1, math.ceil(count / tile))


def first_like(left: DataFrame, right: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """``node, leader``: of each of ``left(id, elements)`` the smallest of ``right(id, elements)`` whose Jaccard similarity reaches the threshold, if any does; elements are distinct whole numbers."""
    ta, tb = _tiles(left.count(), tile), _tiles(right.count(), tile)
    a = left.select("id", "elements", F.pmod(F.xxhash64("id"), F.lit(ta)).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(tb - 1))).alias("y"))
    b = right.select("id", "elements", F.explode(F.sequence(F.lit(0), F.lit(ta - 1))).alias("x"), F.pmod(F.xxhash64("id"), F.lit(tb)).cast("int").alias("y"))

    def pair(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        ids, best = q["id"].to_numpy(), np.full(len(p), np.iinfo(np.int64).max)
        if len(p) and len(q):
            for i, j in _like(p["elements"].tolist(), q["elements"].tolist(), threshold):
                np.minimum.at(best, i, ids[j])
        found = best < np.iinfo(np.int64).max
        return pd.DataFrame({"node": p["id"].to_numpy()[found], "leader": best[found]})

    met = a.groupBy("x", "y").cogroup(b.groupBy("x", "y")).applyInPandas(pair, "node long, leader long")
    return met.groupBy("node").agg(F.min("leader").alias("leader"))


def like_pairs(sets: DataFrame, threshold: float, tile: int = TILE) -> DataFrame:
    """``a, b``: pairs of ``sets(id, elements)`` whose Jaccard similarity is at least the threshold, the smaller id first."""
    t = _tiles(sets.count(), tile)
    own = F.pmod(F.xxhash64("id"), F.lit(t)).cast("int")
    a = sets.select("id", "elements", own.alias("x")).withColumn("y", F.explode(F.sequence(F.col("x"), F.lit(t - 1))))
    b = sets.select("id", "elements", own.alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("y"))))

    def pair(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(p) and len(q):
            one, other, same = p["id"].to_numpy(), q["id"].to_numpy(), p["x"].iloc[0] == p["y"].iloc[0]
            for i, j in _like(p["elements"].tolist(), q["elements"].tolist(), threshold):
                a, b = one[i], other[j]
                kept = a < b if same else slice(None)
                low, high = [*low, np.minimum(a, b)[kept]], [*high, np.maximum(a, b)[kept]]
        return pd.DataFrame({"a": np.concatenate(low), "b": np.concatenate(high)})

    return a.groupBy("x", "y").cogroup(b.groupBy("x", "y")).applyInPandas(pair, "a long, b long")
