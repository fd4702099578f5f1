"""URL filters as a sort-merge range join.

A host reversed by labels (``www.example.com`` to ``com.example.www.``) turns a rule for a host and its subdomains
into an interval of keys. Rules and URLs are dealt into ranges of keys, sorted, and swept once; a stack holds the
rules whose intervals are open, nested as their hosts are. Ranges are cut between rows, not keys, so one host may
fill many of them; a rule goes to each range that its interval touches.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import partitions

_LAST = "\U0010ffff"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows sampled for each range's bound, and characters of a bound; both steer only the balance.
_SAMPLE, _BOUND = 32, 256


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """The host's labels reversed, each ended by a dot; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), "."), F.lit(".")))


class _Node:
    """The rules of one host: verdicts by path, and the lengths that paths have, longest first."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.paths, self.lengths = key, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        # Of two rules for the same host and path, the block holds.
        if self.paths.get(path) != "block":
            self.paths[path] = verdict
        self.lengths = sorted({len(p) for p in self.paths}, reverse=True)


def _longest(stack: list[_Node], path: str) -> tuple[str, str] | None:
    """Rule and verdict: the rule with most characters; of two as long, the one with the longer host."""
    best, most = None, -1
    for node in reversed(stack):
        for n in node.lengths:
            if n <= len(path) and path[:n] in node.paths:
                if len(node.host) + n > most:
                    best, most = (node.host + path[:n], node.paths[path[:n]]), len(node.host) + n
                break
    return best


def match_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict``: one row per row of ``urls``, judged by the longest rule that fits.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the URL's path starts with the rule's.
    Null paths count as empty; rules with a null or empty host, or a null verdict, fit nothing. URLs without a rule
    get a null ``rule`` and the ``default``. Null URLs have an empty host. Repeated rows stay. An empty table
    gives no rows, empty rules give every row the default. Other columns of ``urls`` aren't read.
    """
    spark = urls.sparkSession
    host, path = host_and_path(F.col("url"))
    seen = urls.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    seen = seen.select("id", host.alias("host"), path.alias("path")).select("*", host_key(F.col("host")).alias("key"), F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    n = partitions(spark)
    # Drawn by another hash than the salt itself: else a hot key's sample would hold its lowest salts only.
    sample = seen.select("key", "salt").orderBy(F.xxhash64(F.lit(1), "salt")).limit(_SAMPLE * n).collect()
    ordered = sorted((r["key"][:_BOUND], r["salt"]) for r in sample)
    bounds = [ordered[len(ordered) * k // n] for k in range(1, n)] if ordered else []

    ruled = rules.where("host <> '' and verdict is not null").select(
        F.lit(None).cast("long").alias("id"), F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        host_key(F.translate("host", _UPPER, _LOWER)).alias("key"), F.lit(0).cast("long").alias("salt"), F.col("verdict"),
    )
    fields = ["range", "key", "kind", "id", "host", "path", "verdict"]
    shape = "range int, key string, kind int, id long, host string, path string, verdict string"
    types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def place_urls(batches):
        for b in batches:
            to = [bisect_right(bounds, x) for x in zip(b.column("key").to_pylist(), b.column("salt").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(to, types[0]), b.column("key"), pa.array([1] * len(to), types[2]), b.column("id"), b.column("host"), b.column("path"), pa.nulls(len(to), types[6])], names=fields)

    def place_rules(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                low, high = bisect_right(bounds, (r["key"], -(1 << 63) - 1)), bisect_right(bounds, (r["key"] + _LAST, 1 << 63))
                rows += [(k, r["key"], 0, None, r["host"], r["path"], r["verdict"]) for k in range(low, high + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, types, strict=True)], names=fields)

    def sweep(batches):
        stack: list[_Node] = []
        current = -1
        for b in batches:
            out: list[tuple] = []
            for at, key, kind, n_, host_, path_, verdict in zip(*(b.column(c).to_pylist() for c in fields), strict=True):
                if at != current:
                    stack, current = [], at
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if kind:
                    rule, said = _longest(stack, path_) or (None, default)
                    out.append((n_, host_, path_, rule, said))
                else:
                    if not stack or stack[-1].key != key:
                        stack.append(_Node(key, host_))
                    stack[-1].add(path_, verdict)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * 5, [types[3], *[types[1]] * 4], strict=True)], names=["page_id", "host", "path", "rule", "verdict"])

    both = seen.mapInArrow(place_urls, shape).union(ruled.mapInArrow(place_rules, shape))
    return both.repartitionById(n, F.col("range")).sortWithinPartitions("range", "key", "kind").mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
