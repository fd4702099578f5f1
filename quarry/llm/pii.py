"""Personal data: base entities by pattern, further identifiers by bootstrapped contexts.

Seeds are the base entities and long hexadecimal secrets. The one and the two words before a seed, with the punctuation
that opens it, are lexical patterns. All identifier-like tokens and the patterns before them form a bipartite graph that
Spark scores in rounds: a pattern is as good as its instances, an instance as the good patterns before it, and what a
round has discovered counts as seeds in the next, so that patterns without a seed of their own can be found too. Only
contexts take part that precede identifiers more often than not, counted over the whole corpus.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import apart, discard, filter_of, materialise, passes

#: Kinds in the order in which spans with one start stand. The first four are base kinds.
KINDS = ("email", "ip", "card", "phone", "secret", "context")
#: Known instances that a pattern must precede; its confidence; the share of its occurrences in the corpus that precede
#: identifiers; rounds of scoring. None depends on the size of the corpus.
SUPPORT, CONFIDENCE, PRECISION, ROUNDS = 5, 0.2, 0.5, 5

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_RUN = re.compile(r"[0-9][0-9.\x20-]*")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SECRET = re.compile(r"(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}")
_EDGES = "\"'`()[]{}<>,;:!?.#*$%&=|"
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(_DOUBLED[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            out.append((start, 0, last))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in the order of start, then kind; code points, ends exclusive."""
    out = _emails(text) if "@" in text else []
    for run in _RUN.finditer(text):
        start, end = run.span()
        if end - start < 7:
            continue
        out += [(*m.span()[:1], 1, m.end()) for m in _IP.finditer(text, start, end) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text, start, end):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    out.sort()
    return out


def _identifier(core: str) -> bool:
    digits = len(_DIGIT.findall(core))
    return digits >= 5 or digits > 0 and len(core) >= 16 and any(c.isalpha() for c in core)


def other_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Secrets (kind 4) and other identifier-like tokens (kind 5) that touch no base span and no other token."""
    out, last, k = [], 0, 0
    ends = sorted((s, e) for s, _, e in base)
    for m in _DIGIT.finditer(text):
        start = end = m.start()
        if end < last:
            continue
        while start > last and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        last = end
        while start < end and text[start] in _EDGES:
            start += 1
        while end > start and text[end - 1] in _EDGES:
            end -= 1
        while k < len(ends) and ends[k][1] <= start:
            k += 1
        if k < len(ends) and ends[k][0] < end:
            continue
        core = text[start:end]
        if _SECRET.fullmatch(core):
            out.append((start, 4, end))
        elif _identifier(core):
            out.append((start, 5, end))
    return out


def _hash(text: str) -> int:
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(text)
    return value - (1 << 64) if value >> 63 else value


def _bare(word: str) -> str:
    """A word of a pattern: lower case, digits as one class."""
    return _DIGIT.sub("0", word.lower())


_ODD, _LOW = 0x9E3779B97F4A7C15, (1 << 64) - 1


def _mixed(*hashes):
    """One hash of several, of Python's numbers or of numpy's arrays alike; their count and order matter."""
    out = hashes[0]
    for h in hashes[1:]:
        out = (out ^ (out >> 31)) * _ODD & _LOW if isinstance(out, int) else (out ^ (out >> np.uint64(31))) * np.uint64(_ODD)
        out = out ^ h
    return out ^ (out >> 29) if isinstance(out, int) else out ^ (out >> np.uint64(29))


def _opening(word: str) -> str:
    return word[: len(word) - len(word.lstrip(_EDGES))]


def context(text: str, start: int) -> tuple[int, int | None] | None:
    """The patterns before a place: of the last word, and of the last two; with the punctuation that opens the place."""
    at = start
    while at > 0 and text[at - 1] in _EDGES:
        at -= 1
    opening, words = text[at:start], []
    while len(words) < 2 and at > 0 and text[at - 1].isspace():
        while at > 0 and text[at - 1].isspace():
            at -= 1
        end = at
        while at > 0 and not text[at - 1].isspace():
            at -= 1
        if at < end:
            words.append(_hash(_bare(text[at:end])) & _LOW)
    if not words:
        return None
    opened = _hash(opening) & _LOW
    return _signed(_mixed(words[0], opened)), _signed(_mixed(words[1], words[0], opened)) if len(words) == 2 else None


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


_FOUND = "row long, doc_id long, found array<struct<start: int, kind: int, end: int, narrow: long, wide: long, instance: long>>"
_KIND = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("narrow", pa.int64()), ("wide", pa.int64()), ("instance", pa.int64())])


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, doc_id, found``: base spans, secrets and other identifier-like tokens of each row, with the hashes of their patterns and of themselves.

    ``row`` numbers the rows of a partition; written once, it tells repeated rows apart.
    """

    def run(batches):
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 40
        for b in batches:
            offsets, rows = [0], []
            for value in b.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                for start, k, end in base + other_spans(text, base):
                    rows.append((start, k, end, *(context(text, start) or (None, None)), _hash(text[start:end])))
                offsets.append(len(rows))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _KIND, strict=True)], fields=list(_KIND))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, n + b.num_rows)), b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner, type=pa.list_(_KIND))], names=["row", "doc_id", "found"])
            n += b.num_rows

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, _FOUND)


class _Words(dict):
    """Numbers of words, by which arrays give the hash of a word as a pattern has it and of the punctuation that opens it. Number 0 stands between texts."""

    def __init__(self):
        super().__init__()
        self.new, self.bare, self.opening = [], np.zeros(1, dtype=np.uint64), np.zeros(1, dtype=np.uint64)

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self) + 1
        self.new.append(word)
        return n

    def fill(self) -> None:
        """Hashes the words that are new, all at once."""
        from xxhash import xxh64_intdigest

        if self.new:
            n = len(self.new)
            bare = "\n".join(self.new).lower().encode().translate(_ZEROS).split(b"\n")
            hashed = np.fromiter(map(xxh64_intdigest, bare), np.uint64, n)
            opened = np.full(n, _hash("") & _LOW, dtype=np.uint64)
            for k in [k for k, w in enumerate(self.new) if w[0] in _EDGES]:
                opened[k] = _hash(_opening(self.new[k])) & _LOW
            self.bare, self.opening, self.new = np.concatenate([self.bare, hashed]), np.concatenate([self.opening, opened]), []


_ZEROS = bytes.maketrans(b"123456789", b"000000000")
_PIECE, _KNOWN, _HELD = 1 << 18, 200_000, 1 << 18


def _patterns_at(words: _Words, ids: np.ndarray) -> np.ndarray:
    """The hashes of all patterns of a run of words, whatever follows them."""
    words.fill()
    bare, opening = words.bare[ids], words.opening[ids]
    narrow = _mixed(bare[:-1], opening[1:])[(ids[:-1] > 0) & (ids[1:] > 0)]
    wide = _mixed(bare[:-2], bare[1:-1], opening[2:])[(ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0)]
    return np.concatenate([narrow, wide])


def count_occurrences(docs: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """``pattern, occurrences`` of the distinct ``patterns(pattern)``: how often a pattern's words and opening occur at all, whatever follows.

    A pass over all texts with a filter of fixed size; what it lets through is counted exactly by hash and joined to
    the patterns.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(patterns.select(F.col("pattern").alias("h"))))

    def run(batches):
        bits, gap = shared.value, np.zeros(1, dtype=np.int64)
        words, pieces, held = _Words(), [], 0
        found, counts = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)

        def count() -> None:
            nonlocal found, counts
            seen = _patterns_at(words, np.concatenate([*pieces, gap, gap]))
            seen, n = np.unique(seen[passes(bits, seen)], return_counts=True)
            found, place = np.unique(np.concatenate([found, seen]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(found)).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts)], names=["pattern", "n"])

        for b in batches:
            for value in b.column(0):
                text = (value.as_py() or "").split()
                pieces += [np.fromiter(map(words.__getitem__, text), np.int64, len(text)), gap]
                held += len(text)
                if held >= _PIECE:
                    count()
                    pieces, held = [], 0
                    if len(words) > _KNOWN:
                        words = _Words()
                    if len(found) > _HELD:
                        yield out()
                        found, counts = found[:0], counts[:0]
        count()
        yield out()

    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("occurrences"))
    return counts.join(patterns.select("pattern"), "pattern")


def score_patterns(edges: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """``pattern`` of those that are good after the rounds, from ``edges(pattern, instance, seed)``, each once.

    A round sets a pattern's confidence to the mean of its instances' values (with one more instance of none); it is
    good if that and the sum of the values are high enough. An instance is worth 1 as a seed, else the chance that one
    of the good patterns before it is right. The graph stays distributed in all rounds.
    """
    if rounds < 1:
        raise ValueError("at least one round is needed")
    current, before, steps = edges.withColumn("value", F.col("seed")), -1, []
    for k in range(rounds):
        scored = current.groupBy("pattern").agg((F.sum("value") / (F.count("*") + 1)).alias("confidence"), F.sum("value").alias("support"))
        good = materialise(scored.where((F.col("confidence") >= confidence - 1e-9) & (F.col("support") >= support - 1e-9)), "patterns")
        discard(*steps)
        count = good.count()
        if k == rounds - 1 or count == before:
            break
        before = count
        reach = edges.join(good.select("pattern", "confidence"), "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("reach"))
        current = materialise(edges.join(reach, "instance", "left").withColumn("value", F.greatest("seed", F.coalesce("reach", F.lit(0.0)))), "values")
        steps = [good, current]
    return good.select("pattern")


def good_patterns(docs: DataFrame, found: DataFrame, text_col: str = "text", support: float = SUPPORT, confidence: float = CONFIDENCE, precision: float = PRECISION, rounds: int = ROUNDS) -> DataFrame:
    """``pattern``: contexts of enough support and confidence that mostly precede identifiers, as a table."""
    each = found.select(F.explode("found").alias("x")).select(F.explode(F.array("x.narrow", "x.wide")).alias("pattern"), "x.instance", (F.col("x.kind") < 5).cast("double").alias("seed")).where("pattern is not null")
    edges = materialise(each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "edges")
    # Whatever the rounds give, a pattern's values can't sum to more than its instances.
    able = materialise(edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("hits")).where(F.col("instances") >= support), "able_patterns")
    if able.limit(1).count() == 0:
        return able.select("pattern")
    precise = able.join(count_occurrences(docs, able, text_col), "pattern").where(F.col("hits") >= precision * F.col("occurrences")).select("pattern")
    kept = materialise(edges.join(precise, "pattern").select("pattern", "instance", "seed"), "precise_edges")
    good = score_patterns(kept, support, confidence, rounds)
    discard(edges, able, kept)
    return good


def _spans(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"], x["kind"], x["end"])))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_context, n_spans``: one row per row.

    The counts and the hash are of base spans; ``spans`` adds secrets and what good patterns mark. Null texts count
    as empty; an empty text has no spans and the hash of the empty string. Repeated rows stay; other columns aren't
    read; an empty table gives no rows.
    """
    found = materialise(find_candidates(docs, id_col, text_col), "candidates")
    patterns = good_patterns(docs, found, text_col)
    open_ = found.select("row", F.explode("found").alias("x")).where("x.kind = 5").select("row", "x.start", F.explode(F.array("x.narrow", "x.wide")).alias("pattern"))
    marked = open_.join(patterns, "pattern").groupBy("row").agg(F.collect_set("start").alias("marked"))
    marked = materialise(marked, "marked").withColumnRenamed("row", "marked_row")
    base = F.filter("found", lambda x: x["kind"] < 4)
    count = lambda k: F.size(F.filter("kept", lambda x: x["kind"] == k)).cast("long")
    kept = F.filter("found", lambda x: (x["kind"] < 5) | F.coalesce(F.array_contains("marked", x["start"]), F.lit(False)))
    rows = found.join(marked, F.col("row") == F.col("marked_row"), "left").select("doc_id", kept.alias("kept"), F.sha2(_spans(base), 256).alias("base_sha256"))
    return rows.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], "base_sha256", _spans(F.col("kept")).alias("spans"), count(4).alias("n_secret"), count(5).alias("n_context"), F.size("kept").cast("long").alias("n_spans"))


def redact(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``spans(doc_id, spans)`` replaced by its kind in brackets; overlapping spans merge.

    Rows are matched by id, so ids must tell rows apart. Rows without spans keep their text; null stays null.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def cut(texts, found):
        return texts.combine(found, lambda t, s: t if t is None or not s else _replaced(t, s))

    id_, found = (apart(docs) + n for n in ("id", "spans"))
    named = spans.select(F.col("doc_id").alias(id_), F.col("spans").alias(found)).dropDuplicates([id_])
    return docs.join(named, docs[id_col].eqNullSafe(named[id_]), "left").withColumn(text_col, cut(F.col(text_col), F.col(found))).select(*docs.columns)


def _replaced(text: str, spans: str) -> str:
    out, at = [], 0
    for kind, start, end in (x.split(":") for x in spans.split(",")):
        start, end = int(start), int(end)
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])
