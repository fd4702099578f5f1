"""Pairs of near vectors, and an inverted-file index over vectors: both exact, both by bounds on angles."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.sources.steps import written

#: Vectors of one side of a tile of pairs, and queries that a search takes.
TILE, MAX_QUERIES = 2000, 4096
#: Slack of a bound, for rounding.
SLACK = 1e-6


def _unit(vectors: pd.Series | list) -> np.ndarray:
    m = np.stack([np.asarray(v, np.float64) for v in vectors])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm > 0, norm, 1.0)


def unit(vector: Column) -> Column:
    """Vectors of length 1; zero and null ones stay what they are."""

    def run(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else _unit([v])[0])

    return F.pandas_udf(run, "array<double>")(vector)


class Nearest:
    """The ``k`` best vectors so far of each of a block of queries, by falling inner product and then id; ``matrix`` has a row a query.

    At most ``pairs`` products are held at once. A matrix product finds what may be among the best; those are summed up
    one coordinate after another, so that equal vectors have equal scores wherever they stand.
    """

    def __init__(self, matrix: np.ndarray, k: int, pairs: int = 1 << 20) -> None:
        self.matrix, self.k, self.rows = matrix, k, max(1, pairs // max(1, len(matrix)))
        self.norms = np.linalg.norm(matrix, axis=1) if matrix.size else np.zeros(len(matrix))
        self.query, self.ids, self.scores = np.zeros(0, np.int64), None, np.zeros(0)
        self.worst = np.full(len(matrix), -np.inf)

    def add(self, ids: np.ndarray, vectors: np.ndarray, wanted: np.ndarray | None = None) -> None:
        """``wanted`` tells of each query (row) and vector (column) whether they meet; all do if it is left out."""
        for low in range(0, len(ids) if len(self.matrix) else 0, self.rows):
            part = slice(low, low + self.rows)
            self._add(ids[part], vectors[part], None if wanted is None else wanted[:, part])

    def _add(self, ids: np.ndarray, vectors: np.ndarray, wanted: np.ndarray | None) -> None:
        found = self.matrix @ vectors.T
        if wanted is not None:
            found = np.where(wanted, found, -np.inf)
        slack = 1e-12 * self.norms * np.nan_to_num(np.linalg.norm(vectors, axis=1), posinf=0.0).max()
        least = self.worst
        if found.shape[1] > self.k and np.count_nonzero(found >= (least - slack)[:, None]) > 4 * self.k * len(found):
            least = np.maximum(least, np.partition(found, found.shape[1] - self.k, axis=1)[:, found.shape[1] - self.k])
        near = found >= (least - slack)[:, None]
        i, j = np.nonzero(near if wanted is None else near & wanted)
        if not len(i):
            return
        scores = np.zeros(len(i))
        for x, y in zip(self.matrix.T, vectors.T, strict=True):
            scores += x[i] * y[j]
        query = np.concatenate([self.query, i])
        ids = ids[j] if self.ids is None else np.concatenate([self.ids, ids[j]])
        scores = np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        self.worst[query[place == self.k - 1]] = scores[place == self.k - 1]
        self.query, self.ids, self.scores = (x[place < self.k] for x in (query, ids, scores))

    def frame(self, names: np.ndarray) -> pd.DataFrame | None:
        """``query_id, vec_id, score`` with the queries' ``names``; nothing if nothing was found."""
        return None if self.ids is None else pd.DataFrame({"query_id": names[self.query], "vec_id": self.ids, "score": self.scores})


def in_blocks(queries: DataFrame, most: int) -> list[DataFrame]:
    """``queries(query_id, ...)`` in blocks of at most ``most`` rows by a hash of their id, one block at least; rows of one id can't be parted, so a block of one id may be larger."""
    total = queries.count()
    blocks = 1 if total <= most else -(-2 * total // most)
    while True:
        block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        sizes = {r["block"]: r["count"] for r in queries.groupBy(block.alias("block")).count().collect()}
        if max(sizes.values(), default=0) <= most or blocks > 64 * total:
            break
        blocks *= 2
    return [queries.where(block == n) for n in sorted(sizes)] or [queries]


def centres(vectors: DataFrame, count: int = 64, sample_rows: int = 20_000, rounds: int = 8) -> np.ndarray:
    """``count`` directions by spherical k-means over at most ``sample_rows`` of ``vectors(id, vector)``, those smallest by a hash of their id. Fewer vectors give fewer; none give one."""
    rows = vectors.where("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").collect()
    if not rows:
        return np.ones((1, 1))
    m = _unit([r["vector"] for r in rows])
    out = m[:: max(1, len(m) // count)][:count].copy()
    for _ in range(rounds):
        of = np.argmax(m @ out.T, axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, of, m)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        out = np.where(norm > 0, sums / np.where(norm > 0, norm, 1.0), out)
    return out


def narrow(threshold: float) -> bool:
    """Whether twice the threshold's angle is less than a right angle, so that cells about pivots may be passed over; between random directions right angles are the rule."""
    return 2 * math.acos(min(1.0, max(-1.0, threshold))) < math.pi / 2


def near_pairs(left: DataFrame, right: DataFrame, threshold: float, pivots: np.ndarray, tile: int = TILE) -> DataFrame:
    """``a, b, cosine``: all pairs of ``left(id, vector)`` and ``right(id, vector)`` whose cosine is at least the threshold; a zero vector is near nothing.

    A vector of the right lies in the cell of its nearest pivot. One of the left visits its own cell and every cell whose
    pivot is at most twice the threshold's angle farther than its nearest: by the triangle inequality it meets all that
    can be near it there. Cells are cut into tiles of at most about ``tile`` vectors a side, by hashes of the ids, so no cell
    is one task; only near pairs leave a tile.
    """
    spark = left.sparkSession
    shared = spark.sparkContext.broadcast(pivots)
    reach = 2 * math.acos(min(1.0, max(-1.0, threshold))) + SLACK

    def place(visits: bool):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                pdf = pdf[[v is not None and bool(np.any(np.asarray(v))) for v in pdf["vector"]]]
                if not len(pdf):
                    continue
                angle = np.arccos(np.clip(_unit(pdf["vector"]) @ shared.value.T, -1, 1))
                near = angle <= angle.min(axis=1, keepdims=True) + reach if visits else angle.argmin(axis=1)[:, None] == np.arange(angle.shape[1])
                rows, cells = np.nonzero(near)
                # A vector goes to many cells, so a few at a time.
                for low in range(0, len(rows), 4096):
                    row, cell = rows[low : low + 4096], cells[low : low + 4096]
                    yield pd.DataFrame({"id": pdf["id"].to_numpy()[row], "vector": pdf["vector"].to_numpy()[row], "cell": cell.astype(np.int32)})

        return run

    kind = left.schema["id"].dataType.simpleString()
    schema = f"id {kind}, vector array<double>, cell int"
    to_double = lambda df: df.select("id", F.col("vector").cast("array<double>").alias("vector"))
    a, b = (to_double(side).mapInPandas(place(visits), schema) for side, visits in ((left, True), (right, False)))
    sizes = a.groupBy("cell").agg(F.count("*").alias("na")).join(b.groupBy("cell").agg(F.count("*").alias("nb")), "cell").select("cell", F.ceil(F.col("na") / tile).cast("int").alias("ta"), F.ceil(F.col("nb") / tile).cast("int").alias("tb"))
    sizes = F.broadcast(written(sizes, "tiles"))  # one row per pivot
    a = a.join(sizes, "cell").withColumns({"x": F.pmod(F.xxhash64("id"), "ta").cast("int"), "y": F.explode(F.expr("sequence(0, tb - 1)"))})
    b = b.join(sizes, "cell").withColumns({"y": F.pmod(F.xxhash64("id"), "tb").cast("int"), "x": F.explode(F.expr("sequence(0, ta - 1)"))})

    def pair(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"a": p["id"][:0], "b": q["id"][:0], "cosine": np.zeros(0)})
        cosine = _unit(p["vector"]) @ _unit(q["vector"]).T
        i, j = np.nonzero(cosine >= threshold)
        return pd.DataFrame({"a": p["id"].to_numpy()[i], "b": q["id"].to_numpy()[j], "cosine": cosine[i, j]})

    keys = ["cell", "x", "y"]
    return a.select(*keys, "id", "vector").groupBy(*keys).cogroup(b.select(*keys, "id", "vector").groupBy(*keys)).applyInPandas(pair, f"a {kind}, b {kind}, cosine double")


#: Vectors of a side of a tile without cells at most, and how many tiles there are at least, as far as their sides allow.
WIDE, PARTS = 32_768, 36


def pairs_in_tiles(left: DataFrame, right: DataFrame | None, threshold: float, tile: int = TILE) -> DataFrame:
    """``a, b, cosine`` as ``near_pairs``, of all of ``left(id, vector)`` with all of ``right``, or of ``left``'s own with ``a < b``; no zero or null vectors.

    Every vector meets every other one in one tile. Tiles have ``tile`` to ``WIDE`` vectors a side (fewer if ``tile`` is
    more), as each vector goes to as many tiles as the other side has; of a tile ``tile`` times ``tile`` are multiplied at once.
    """
    n_left, n_right = left.count(), left.count() if right is None else right.count()
    side = max(1, min(WIDE, max(tile, math.ceil(math.sqrt(n_left * n_right / PARTS)))))
    ta, tb = (max(1, math.ceil(n / side)) for n in (n_left, n_right))
    own = lambda t: F.pmod(F.xxhash64("id"), F.lit(t)).cast("int")
    columns = ["id", F.col("vector").cast("array<double>").alias("vector")]
    if right is None:
        a = left.select(*columns, own(ta).alias("x")).withColumn("y", F.explode(F.sequence(F.col("x"), F.lit(ta - 1))))
        b = left.select(*columns, own(ta).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("y"))))
    else:
        a = left.select(*columns, own(ta).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(tb - 1))))
        b = right.select(*columns, own(tb).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(ta - 1))))
    alone = right is None

    def pair(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(p) and len(q):
            one, other, m, n = p["id"].to_numpy(), q["id"].to_numpy(), _unit(p["vector"]), _unit(q["vector"])
            same = alone and p["x"].iloc[0] == p["y"].iloc[0]
            for low in range(0, len(m), tile):
                for low_b in range(0, len(n), tile):
                    cosine = m[low : low + tile] @ n[low_b : low_b + tile].T
                    i, j = np.nonzero(cosine >= threshold)
                    a, b, c = one[i + low], other[j + low_b], cosine[i, j]
                    if alone:
                        kept = a < b if same else slice(None)
                        a, b, c = np.minimum(a, b)[kept], np.maximum(a, b)[kept], c[kept]
                    found.append((a, b, c))
        return pd.DataFrame(dict(zip(("a", "b", "cosine"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    keys, rows = ["x", "y"], ["id", "vector", "x", "y"]
    return a.select(*rows).groupBy(*keys).cogroup(b.select(*rows).groupBy(*keys)).applyInPandas(pair, "a long, b long, cosine double")


def build_lists(vectors: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``vectors(id, vector)`` with ``cell``, the nearest centre, and ``angle`` to it; written in one folder per cell. Null and zero vectors are in no list."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf[[v is not None and bool(np.any(np.asarray(v))) for v in pdf["vector"]]]
            if len(pdf):
                angle = np.arccos(np.clip(_unit(pdf["vector"]) @ shared.value.T, -1, 1))
                cell = angle.argmin(axis=1)
                yield pdf.assign(angle=angle[np.arange(len(pdf)), cell], cell=cell.astype(np.int32))

    kind = vectors.schema["id"].dataType.simpleString()
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
    return written(rows.mapInPandas(run, f"id {kind}, vector array<double>, angle double, cell int"), "lists", ["cell"])


def search_lists(queries: DataFrame, lists: DataFrame, pivots: np.ndarray, k: int, probes: int = 4) -> tuple[DataFrame, DataFrame]:
    """The ``k`` nearest by cosine of each of ``queries(query_id, vector)``: after ``probes`` lists, and after all lists that can still hold a nearer one.

    The first result is approximate; the second is exact: a list whose members lie within ``radius`` of its centre is left
    out only if no vector that near its centre beats the k-th found. Queries are a stated set, checked against
    ``MAX_QUERIES``; what leaves a task is k rows a query. A null query finds nothing.
    """
    spark = queries.sparkSession
    stated = queries.where("vector IS NOT NULL").select("query_id", "vector").limit(MAX_QUERIES + 1).collect()
    if len(stated) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries; pass them in blocks")
    kind = lists.schema["id"].dataType.simpleString()
    found = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id {kind}, score double"
    ids = np.array([r["query_id"] for r in stated])
    matrix = _unit([r["vector"] for r in stated]) if len(stated) else np.zeros((0, pivots.shape[1]))
    theta = np.arccos(np.clip(matrix @ pivots.T, -1, 1)) if len(stated) else np.zeros((0, len(pivots)))
    first = np.zeros_like(theta, bool)
    np.put_along_axis(first, np.argsort(theta, axis=1)[:, :probes], True, axis=1)

    def probe(mask: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, matrix, mask))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, asked, wanted = shared.value
            held = Nearest(asked, k)
            for pdf in parts:
                if len(pdf):
                    held.add(pdf["id"].to_numpy(), _unit(pdf["vector"]), wanted[:, pdf["cell"].to_numpy()])
            out = held.frame(names)
            if out is not None:
                yield out

        cells = [int(c) for c in np.flatnonzero(mask.any(axis=0))]
        return lists.where(F.col("cell").isin(cells)).select("id", "vector", "cell").mapInPandas(run, found)

    def ranked(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= k)

    near = written(ranked(probe(first)), "probed")
    worst = dict(near.where(F.col("rank") == k).select("query_id", "score").collect())  # one row a query
    radius = {r["cell"]: r["r"] for r in lists.groupBy("cell").agg(F.max("angle").alias("r")).collect()}  # one row a centre
    wide = np.array([radius.get(c, -np.inf) for c in range(len(pivots))])
    best = np.cos(np.clip(theta - wide - SLACK, 0, np.pi))
    need = np.array([worst.get(q, -np.inf) for q in ids.tolist()])
    rest = (best >= need[:, None]) & ~first & (wide > -np.inf)
    return near, ranked(near.drop("rank").unionByName(probe(rest)))


def search_lists_in_blocks(queries: DataFrame, lists: DataFrame, pivots: np.ndarray, k: int, probes: int = 4, max_queries: int = MAX_QUERIES) -> tuple[DataFrame, DataFrame]:
    """``search_lists`` for any number of queries, a block after another."""
    parts = [search_lists(block, lists, pivots, k, probes) for block in in_blocks(queries, max_queries)]
    near, exact = parts[0]
    for n, e in parts[1:]:
        near, exact = near.unionByName(n), exact.unionByName(e)
    return near, exact
