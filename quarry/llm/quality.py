"""Quality scores from random-indexing word vectors and a two-layer network.

Every word has a sparse random index vector; a word's own vector sums the index vectors of its neighbours (turned one
way for the word before, the other for the word after) and of its shape over a bounded sample of labelled texts. A
document is pooled to the mean and spread of its words' vectors and the mean of its marks' (repetition, length,
variety). A two-layer numpy network scores that, and a temperature fitted on rows it wasn't trained on calibrates the
probabilities. The sample's size is a parameter; every document is scored on its whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import apart, slices

#: Labelled rows that a model is fitted on at most and the bytes of their texts, words that get a vector of their own
#: (all others share those of their shapes), length of the vectors.
SAMPLE_ROWS, SAMPLE_BYTES, VOCABULARY, WIDTH = 4000, 64 << 20, 20_000, 64
_NONZERO, _HIDDEN, _EPOCHS, _BATCH, _CHUNK = 8, 32, 80, 64, 1 << 15


class _Shapes(dict):
    """Letters by case, digits as one class, all else as it is."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        return self[code]


_SHAPES = _Shapes()


_RUN = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """Classes of the whole word's characters, each run as one; beyond eight, the first eight and the size of the rest by powers of two."""
    runs = _RUN.sub(r"\1", word.translate(_SHAPES))
    return "\x00" + (runs if len(runs) <= 8 else f"{runs[:8]}\x00{(len(runs) - 8).bit_length()}")


def marks(words: list[str], text: str) -> list[str]:
    """What a text shows as a whole: how often words and lines repeat, how long it is, how varied its words are."""
    n = len(words)
    again = sum(map(eq, words, islice(words, 1, None)))
    lines = [x for x in text.split("\n") if x]
    same = len(lines) - len(set(lines))
    return [
        f"\x01again{_tenth(again, n)}", f"\x01lines{_tenth(same, len(lines))}", f"\x01types{_tenth(len(set(words)), n)}",
        f"\x01length{n.bit_length()}", f"\x01line{(n // max(1, len(lines))).bit_length()}", f"\x01word{min(20, sum(map(len, words)) // max(1, n))}",
    ]


def _tenth(part: int, whole: int) -> int:
    return 0 if part <= 0 else 1 + 10 * part // max(1, whole)


def _index_vectors(words: list[str], seed: int) -> np.ndarray:
    """The words' sparse ternary index vectors, each from its own hash alone."""
    from xxhash import xxh64_intdigest

    out = np.zeros((len(words), WIDTH), dtype=np.float32)
    for k, w in enumerate(words):
        rng = np.random.Generator(np.random.PCG64(xxh64_intdigest(w, seed)))
        out[k, rng.choice(WIDTH, _NONZERO, replace=False)] = np.where(rng.random(_NONZERO) < 0.5, -1, 1)
    return out


class _Lookup(dict):
    """Vector numbers by word. A word without one gets its shape's, and is remembered while there is room."""

    none, room = 0, 0

    def __missing__(self, word: str) -> int:
        found = self.get(shape(word), self.none)
        if len(self) >= self.room:
            return found
        self[word] = found
        return found


@dataclass
class Model:
    """Word vectors by word, shape and mark; the network's layers; the temperature."""

    words: dict[str, int]
    vectors: np.ndarray
    layers: list[np.ndarray]
    mean: np.ndarray
    spread: np.ndarray
    temperature: float
    constant: float | None = None

    def ids(self, words: list[str]) -> np.ndarray:
        lookup = self.__dict__.get("_lookup")
        if lookup is None or len(lookup) >= lookup.room:
            lookup = self.__dict__["_lookup"] = _Lookup(self.words)
            lookup.none, lookup.room = len(self.vectors) - 1, len(self.words) + 100_000
        return np.fromiter(map(lookup.__getitem__, words), dtype=np.int32, count=len(words))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_lookup"}

    def pool(self, text: str) -> np.ndarray:
        words = text.split()
        noted = self.vectors[self.ids(marks(words, text))].mean(axis=0)
        if not words:
            return np.concatenate([np.zeros(2 * WIDTH, dtype=np.float32), noted])
        total, squares = np.zeros(WIDTH), np.zeros(WIDTH)
        for at in range(0, len(words), _CHUNK):
            found = self.vectors[self.ids(words[at : at + _CHUNK])]
            total += found.sum(axis=0)
            squares += np.einsum("ij,ij->j", found, found)
        mean = total / len(words)
        return np.concatenate([mean, np.sqrt(np.maximum(squares / len(words) - mean * mean, 0)), noted]).astype(np.float32)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return _forward(self.layers, (pooled - self.mean) / self.spread)[1]

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.zeros(0)
        z = self.logits(np.stack([self.pool(t) for t in texts])).astype(np.float64) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, (hidden @ w2 + b2).ravel()


def _train(x: np.ndarray, y: np.ndarray, seed: int) -> list[np.ndarray]:
    """Adam on the logistic loss with weight decay."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    layers = [rng.normal(0, d**-0.5, (d, _HIDDEN)), np.zeros(_HIDDEN), rng.normal(0, _HIDDEN**-0.5, (_HIDDEN, 1)), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for epoch in range(_EPOCHS):
        rate = 3e-3 * (1 - epoch / _EPOCHS) + 1e-4
        order = rng.permutation(n)
        for at in range(0, n, _BATCH):
            xb, yb = x[order[at : at + _BATCH]], y[order[at : at + _BATCH]]
            hidden, z = _forward(layers, xb)
            error = ((1 / (1 + np.exp(-np.clip(z, -40, 40)))) - yb)[:, None] / len(yb)
            back = error @ layers[2].T * (1 - hidden * hidden)
            grads = [xb.T @ back + 1e-3 * layers[0], back.sum(0), hidden.T @ error + 1e-3 * layers[2], error.sum(0)]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] = layers[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least logistic loss, on a fine grid."""
    grid = np.exp(np.linspace(-2, 3, 101))
    losses = [np.mean(np.logaddexp(0, z / t) - y * z / t) for t in grid]
    return float(grid[int(np.argmin(losses))])


def word_vectors(texts: list[list[str]], vocabulary: int, seed: int) -> tuple[dict[str, int], np.ndarray]:
    """Random-indexing vectors of the commonest words, of all shapes and marks in them, and last the zero vector."""
    counts: Counter[str] = Counter()
    for words in texts:
        counts.update(words)
    own = [w for w, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:vocabulary] if n > 1]
    shapes_of = {w: shape(w) for w in counts}
    names = own + sorted(set(shapes_of.values()))[:vocabulary]
    at = {w: k for k, w in enumerate(names)}
    none = len(names)
    shape_at = {w: at.get(s, none) for w, s in shapes_of.items()}
    index = np.vstack([_index_vectors(names, seed), np.zeros((1, WIDTH), dtype=np.float32)])
    before, after = np.roll(index, 1, axis=1), np.roll(index, -1, axis=1)
    sums, seen = np.zeros((none + 1, WIDTH), dtype=np.float32), np.zeros(none + 1, dtype=np.float32)
    for words in texts:
        for start in range(0, len(words), _CHUNK):
            part = words[start : start + _CHUNK]
            shapes = np.array([shape_at[w] for w in part])
            ids = np.array([at.get(w, s) for w, s in zip(part, shapes.tolist(), strict=True)])
            context = index[shapes]
            context[1:] += before[ids[:-1]]
            context[:-1] += after[ids[1:]]
            own_ = ids != shapes
            _add(sums, seen, shapes, context)
            _add(sums, seen, ids[own_], context[own_])
    vectors = sums / np.maximum(seen, 1)[:, None]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    vectors[none] = 0
    return at, vectors.astype(np.float32)


def _add(sums: np.ndarray, seen: np.ndarray, to: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to the sum it belongs to."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    ids, first, counts = np.unique(to[order], return_index=True, return_counts=True)
    sums[ids] += np.add.reduceat(rows[order], first, axis=0)
    seen[ids] += counts


def fit(rows: list[tuple[str, int]], vocabulary: int = VOCABULARY, seed: int = 5) -> Model:
    """A model from texts with labels 0 or 1. Without both labels, it gives their mean (without any, 0.5)."""
    labels = np.array([y for _, y in rows], dtype=np.float64)
    empty = np.zeros((1, WIDTH), dtype=np.float32)
    if len(set(labels.tolist())) < 2:
        return Model({}, empty, [], empty, empty, 1.0, float(labels.mean()) if len(labels) else 0.5)
    texts = [t.split() for t, _ in rows]
    at, vectors = word_vectors(texts, vocabulary, seed)
    noted = sorted({m for words, (t, _) in zip(texts, rows, strict=True) for m in marks(words, t)})
    for m in noted:
        at[m] = len(vectors) - 1 + noted.index(m)
    vectors = np.vstack([vectors[:-1], _index_vectors(noted, seed), vectors[-1:]])
    model = Model(at, vectors, [], empty, empty, 1.0)
    x = np.stack([model.pool(t) for t, _ in rows])
    model.mean, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = ((x - model.mean) / model.spread).astype(np.float64)
    # Out-of-fold logits: every row is scored by a network that hasn't seen it, and those set the temperature.
    fold = np.arange(len(rows)) % 3
    apart = np.zeros(len(rows))
    for k in range(3):
        if len(set(labels[fold != k].tolist())) == 2 and (fold == k).any():
            apart[fold == k] = _forward(_train(x[fold != k], labels[fold != k], seed), x[fold == k])[1]
    model.temperature = _temperature(apart, labels)
    model.layers = _train(x, labels, seed)
    return model


def held_out(id_: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.encode(F.coalesce(id_.cast("string"), F.lit("")), "UTF-8")) % 3 == 1


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, vocabulary: int = VOCABULARY, seed: int = 5) -> Model:
    """Fits a model on at most ``sample_rows`` labelled rows that aren't held out, in the order of a hash of their id, whose whole texts together have at most ``sample_bytes``: one that no longer fits is passed over.

    Null labels and ids are left out; of several labels for an id the highest counts, of several texts the greatest.
    Null texts count as empty. What reaches the driver is bounded by the two sizes. Without labelled rows the score is
    0.5, without both labels the one there is.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = usable.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__label")).orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").limit(sample_rows)
    ids = docs.sparkSession.createDataFrame(chosen.collect() or [], "__id long, __label int")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(ids), F.col("id") == F.col("__id"))
    sizes = joined.groupBy("__id").agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0))).cast("long").alias("bytes")).orderBy(F.xxhash64(F.lit(seed), "__id"), "__id").collect()
    fits, left = [], sample_bytes
    for r in sizes:  # a text too long for what is left is passed over
        if r["bytes"] <= left:
            left -= r["bytes"]
            fits.append((r["__id"],))
    if len(fits) < len(sizes):
        joined = joined.join(F.broadcast(docs.sparkSession.createDataFrame(fits, "__id long")), "__id", "left_semi")
    rows = joined.groupBy("__id").agg(F.max("__label").alias("label"), F.max(F.coalesce("text", F.lit(""))).alias("text"))
    found = sorted((r["__id"], r["text"], r["label"]) for r in rows.toLocalIterator())
    return fit([(t, y) for _, t, y in found], vocabulary, seed)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double, 0 to 1) and ``predicted`` (int), which replace columns of those names.

    Null and empty texts are scored as texts without words. Every row stays, repeated ones too; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*[c for c in docs.columns if c not in ("score", "predicted")])
    # The text goes along once: as it is, or, where it isn't a string, as one beside the columns.
    own = text_col if dict(docs.dtypes)[text_col] == "string" and text_col in kept.columns else apart(kept) + "text"
    source = kept if own in kept.columns else docs.select(*kept.columns, F.col(text_col).cast("string").alias(own))
    place, width = source.columns.index(own), len(kept.columns)

    def run(batches):
        held = shared.value
        for b in slices(batches, 256):
            scores = held.scores([t.as_py() or "" for t in b.column(place)])
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(scores, pa.float64())], names=[*b.schema.names[:width], "score"])

    from pyspark.sql import types as T

    shape_ = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])
    scored = source.mapInArrow(run, shape_)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
