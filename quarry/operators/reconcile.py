"""Two-store reconciliation and data-quality operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.sources.steps import written


def parity(store: DataFrame, index: DataFrame) -> DataFrame:
    """``pk, kind`` over ``store(pk, doc_id, is_active, index_status)`` and ``index(pk, doc_id)``.

    missing: active and indexed, but not in the index. Of index rows, the first that holds: dup (a pk that came
    more than once), inactive (known, not active), orphan (unknown). Rows in order have no row here.
    """
    one = index.groupBy("pk").agg(F.count("*").alias("copies"))
    s, i = store.select("pk", "is_active", "index_status").alias("s"), one.alias("i")
    joined = s.join(i, F.col("s.pk") == F.col("i.pk"), "full_outer")
    kind = (
        F.when(F.col("i.pk").isNull() & (F.col("is_active") == 1) & (F.col("index_status") == "INDEXED"), "missing").when(F.col("i.pk").isNull(), None)
        .when(F.col("copies") > 1, "dup").when(F.col("s.pk").isNull(), "orphan").when(F.col("is_active") != 1, "inactive")
    )
    return joined.select(F.coalesce("s.pk", "i.pk").alias("pk"), kind.alias("kind")).where("kind is not null")


def parity_summary(store: DataFrame, index: DataFrame) -> DataFrame:
    """Counts by kind, documents that vanished from the index or that only it has, and the verdict; one row."""
    due = (F.col("is_active") == 1) & (F.col("index_status") == "INDEXED")
    known = store.groupBy("doc_id").agg(F.bool_or(F.coalesce(due, F.lit(False))).alias("due"))
    docs = known.join(index.select("doc_id").distinct().withColumn("there", F.lit(True)), "doc_id", "full_outer")
    state = F.when(F.col("due") & F.col("there").isNull(), "vanished_docs").when(F.col("due").isNull(), "orphan_docs")
    # Rows of keys and of documents meet in one aggregate.
    rows = parity(store, index).select(F.concat(F.lit("n_"), "kind").alias("what")).unionAll(docs.select(state.alias("what")).where("what is not null"))
    names = ("n_missing", "n_dup", "n_inactive", "n_orphan", "vanished_docs", "orphan_docs")
    return rows.agg(*[F.count_if(F.col("what") == k).alias(k) for k in names]).withColumn("ok", (F.col("n_missing") == 0) & (F.col("vanished_docs") == 0))


def object_parity(chunks: DataFrame, present: DataFrame) -> DataFrame:
    """``key, chunk_id`` of objects that active chunks refer to and storage lacks; the first chunk of each key. Broken JSON refers to nothing."""
    extra = F.from_json("extra_json", "struct<oss_key: string, image_refs: array<struct<oss_key: string>>>")
    keys = F.array_compact(F.concat(F.array(extra["oss_key"]), F.coalesce(F.transform(extra["image_refs"], lambda r: r["oss_key"]), F.array().cast("array<string>"))))
    refs = chunks.where("is_active = 1").select("chunk_id", F.explode(keys).alias("key")).where("key <> ''")
    return refs.groupBy("key").agg(F.min("chunk_id").alias("chunk_id")).join(present.select("key").distinct(), "key", "left_anti")


def raw_parity(versions: DataFrame, present: DataFrame) -> DataFrame:
    """``doc_id, version_no, raw_key, state``: no_key for null keys, missing for keys that storage lacks."""
    no_key = versions.where("raw_key is null").withColumn("state", F.lit("no_key"))
    missing = versions.where("raw_key is not null").join(present.select(F.col("key").alias("raw_key")).distinct(), "raw_key", "left_anti").withColumn("state", F.lit("missing"))
    return no_key.select("doc_id", "version_no", "raw_key", "state").unionByName(missing.select("doc_id", "version_no", "raw_key", "state"))


def asset_set_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``doc_id, kind, removed, added`` for documents whose known asset ordinals differ.

    ``(doc_id, ordinals array, partial boolean, source)``: null ordinals are unknown and never differ; with the same
    source the change is drift, with another a changed source, with an unknown one an ordinal difference, partial if
    either side is.
    """
    a, b = old.alias("a"), new.alias("b")
    joined = a.join(b, "doc_id").where("a.ordinals is not null and b.ordinals is not null")
    removed, added = F.array_sort(F.array_except("a.ordinals", "b.ordinals")), F.array_sort(F.array_except("b.ordinals", "a.ordinals"))
    same = F.col("a.source") == F.col("b.source")
    kind = F.when(same, "same_source_drift").when(F.col("a.partial") | F.col("b.partial"), "ordinal_diff_partial").when(~same, "source_changed").otherwise("ordinal_diff")
    return joined.select("doc_id", kind.alias("kind"), removed.alias("removed"), added.alias("added")).where((F.size("removed") > 0) | (F.size("added") > 0))


def serving_version(chunks: DataFrame) -> DataFrame:
    """``doc_id, serving``: the highest version whose active chunks are all indexed; else the only active version; else null."""
    per = chunks.where("is_active = 1").groupBy("doc_id", "version_no").agg(F.sum((F.col("index_status") != "INDEXED").cast("int")).alias("open"))
    out = per.groupBy("doc_id").agg(F.max(F.when(F.col("open") == 0, F.col("version_no"))).alias("complete"), F.count("*").alias("n"), F.max("version_no").alias("only"))
    return out.select("doc_id", F.coalesce("complete", F.when(F.col("n") == 1, F.col("only"))).alias("serving"))


def stranded_versions(chunks: DataFrame) -> DataFrame:
    """``doc_id, version_no``: fully indexed versions over an older one that is still active."""
    per = chunks.where("is_active = 1").groupBy("doc_id", "version_no").agg(F.bool_and(F.col("index_status") == "INDEXED").alias("whole"), F.count("*").alias("n"))
    old = per.select(F.col("doc_id").alias("d"), F.col("version_no").alias("v"))
    return per.where("whole").join(old, (F.col("doc_id") == F.col("d")) & (F.col("v") < F.col("version_no")), "left_semi").select("doc_id", "version_no")


def deletable_orphans(index: DataFrame, active: DataFrame) -> DataFrame:
    """``pk, chunk_id, decision`` for index rows that aren't active: skip if the chunk's active pk is absent from the index, else delete."""
    idle = index.join(active.select("pk"), "pk", "left_anti")
    absent = active.join(index.select("pk").distinct(), "pk", "left_anti").select("chunk_id").distinct().withColumn("__absent", F.lit(True))
    return idle.join(absent, "chunk_id", "left").select("pk", "chunk_id", F.when(F.col("__absent"), "dup_replacement_absent").otherwise("delete").alias("decision"))


def set_drift(want: Column, have: Column) -> Column:
    """Whether two lists differ as sets; null counts as unknown and drifts."""
    return ~F.coalesce(F.array_sort(F.array_distinct(want)) == F.array_sort(F.array_distinct(have)), F.lit(False))


def health_verdict(healthy: Column, missing: Column, unknown: Column) -> Column:
    """unknown if the scan wasn't healthy, degraded if anything is missing or at risk, else healthy."""
    return F.when(~F.coalesce(healthy, F.lit(False)), "unknown").when((missing > 0) | (unknown > 0), "degraded").otherwise("healthy")


def index_health(index_count: Column, active_count: Column) -> Column:
    """loss, exact, surplus within max(5, half a per cent), or surplus."""
    delta = index_count - active_count
    return F.when(delta < 0, "loss").when(delta == 0, "exact").when(delta <= F.greatest(F.lit(5.0), active_count * 0.005), "tolerated").otherwise("surplus")


def purge_order(facts: DataFrame, log: DataFrame, subject: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts and then log rows of a subject; facts are found through the log, so the log goes last."""
    mine = log.join(subject.select("user_id").distinct(), "user_id", "left_semi")
    return facts.join(mine.select("message_id").distinct(), "message_id", "left_semi"), mine


def reclassify_missing(missing: DataFrame, fetched: DataFrame, failed: DataFrame) -> DataFrame:
    """``pk, doc_id, found``: what a lookup by key says of rows that the enumeration lacks: invisible (there), unclassified (its batch failed) or confirmed (gone)."""
    there = fetched.select("pk").distinct().withColumn("__there", F.lit(True))
    lost = failed.select("pk").distinct().withColumn("__lost", F.lit(True))
    joined = missing.select("pk", "doc_id").join(there, "pk", "left").join(lost, "pk", "left")
    return joined.select("pk", "doc_id", F.when(F.col("__there"), "invisible").when(F.col("__lost"), "unclassified").otherwise("confirmed").alias("found"))


def vanished_verdicts(vanished: DataFrame, classified: DataFrame) -> DataFrame:
    """``doc_id, verdict`` of documents that the enumeration lost: an artifact if all their missing keys are there, else at risk, also where none of their keys was looked up."""
    per = classified.groupBy("doc_id").agg(F.bool_and(F.col("found") == "invisible").alias("there"))
    verdict = F.when(F.col("there").isNull(), "at_risk:no_indexed_coverage").when(F.col("there"), "artifact").otherwise("at_risk:confirmed_or_unclassified")
    return vanished.select("doc_id").distinct().join(per, "doc_id", "left").select("doc_id", verdict.alias("verdict"))


def final_verdict(classified: DataFrame, verdicts: DataFrame, unhealthy_buckets: int, lookup_ok: bool) -> DataFrame:
    """``confirmed, unclassified, invisible, at_risk, ok, health, basis``; one row. Without a lookup that worked all vanished documents are at risk."""
    c = classified.agg(*[F.count_if(F.col("found") == k).alias(k) for k in ("confirmed", "unclassified", "invisible")])
    risk = F.count("*") if not lookup_ok else F.count_if(F.startswith("verdict", F.lit("at_risk")))
    # Two global aggregates of one row each.
    out = c.crossJoin(verdicts.agg(risk.alias("at_risk")))
    if not lookup_ok:
        return out.withColumns({"ok": F.lit(False), "health": F.lit("unknown"), "basis": F.lit("query_only")})
    health = F.when(F.col("unclassified") > 0, "unknown").when((F.col("invisible") > 0) | (F.lit(unhealthy_buckets) > 0), "degraded").otherwise("healthy")
    return out.withColumns({"ok": (F.col("confirmed") == 0) & (F.col("unclassified") == 0) & (F.col("at_risk") == 0), "health": health, "basis": F.lit("fetch")})


def unchanged_grants(docs: DataFrame) -> DataFrame:
    """``doc_id, unchanged`` of ``docs(doc_id, mode, want_json, have)``: only where both lists are known, the mode is no node's and they agree as sorted; broken JSON is unknown."""
    want = F.from_json("want_json", "array<string>")
    same = (F.array_sort(want) == F.col("have")) & (F.lower(F.coalesce("mode", F.lit("legacy"))) != "node")
    return docs.select("doc_id", F.coalesce(same, F.lit(False)).alias("unchanged"))


def present_by(keys: DataFrame, exists: Column, name: str = "present") -> DataFrame:
    """Keys with what a caller's predicate says of them; one that fails to say counts as not there."""
    return keys.withColumn(name, F.coalesce(exists, F.lit(False)))


def parity_in_buckets(store: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """``bucket`` and counts by kind, of ``parity`` over buckets of the key: their sums are those of the whole."""
    kinds = parity(store, index).withColumn("bucket", F.pmod("pk", F.lit(buckets)))
    return kinds.groupBy("bucket").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("missing", "dup", "inactive", "orphan")])


#: Ranges that one digest of the level above sums up.
FAN = 64


def range_digests(df: DataFrame, key: str, width: int, columns: list[str]) -> DataFrame:
    """``leaf, n, sum, xor`` per range of ``width`` keys: digests of whole rows that don't depend on their order, repeated rows included."""
    h = F.xxhash64(key, *columns)
    return df.where(F.col(key).isNotNull()).groupBy(F.floor(F.col(key) / width).alias("leaf")).agg(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit((1 << 31) - 1))).alias("sum"), F.bit_xor(F.xxhash64(F.lit(1), key, *columns)).alias("xor"))


def differing_ranges(a: DataFrame, b: DataFrame, fan: int = FAN) -> tuple[DataFrame, dict[str, int]]:
    """The leaves of two tables of digests that differ, found from the top of a tree of ``fan`` ranges a node, and how many nodes were compared."""

    def above(d: DataFrame) -> DataFrame:
        return d.groupBy(F.floor(F.col("leaf") / fan).alias("leaf")).agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.bit_xor("xor").alias("xor"))

    levels = [(written(a, "digests"), written(b, "digests"))]
    while max(x.count() for x in levels[-1]) > fan:
        levels.append(tuple(written(above(x), "digests") for x in levels[-1]))
    open_, compared = None, 0
    for x, y in reversed(levels):
        if open_ is not None:
            under = open_.select(F.col("leaf").alias("up"))
            x, y = (d.withColumn("up", F.floor(F.col("leaf") / fan)).join(under, "up", "left_semi").drop("up") for d in (x, y))
        both = written(x.select("leaf", F.struct("n", "sum", "xor").alias("x")).join(y.select("leaf", F.struct("n", "sum", "xor").alias("y")), "leaf", "full_outer"), "compared")
        compared += both.count()
        open_ = written(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("leaf"), "differ")
    return open_, {"compared": compared, "leaves": max(levels[0][0].count(), levels[0][1].count())}


def reconcile_by_ranges(store: DataFrame, index: DataFrame, key: str, columns: list[str], width: int, unread: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``key, kind`` of keys whose rows differ (missing from the index, extra in it, or changed), and one row of totals.

    Both sides are read once for digests of key ranges; of their rows only those in ranges that differ are read again
    and joined. ``unread(leaf)`` names ranges that a scan couldn't read: nothing is said of their keys, and the verdict
    is ``incomplete``. Rows are compared as bags, so repeated rows count; rows without a key aren't compared.
    Totals: ``leaves, joined, compared, differences, verdict``.
    """
    leaf = F.floor(F.col(key) / width).alias("leaf")
    sides = [df.where(F.col(key).isNotNull()) for df in (store, index)]
    digests = [range_digests(df, key, width, columns) for df in sides]
    if unread is not None:
        digests = [d.join(unread, "leaf", "left_anti") for d in digests]
    open_, seen = differing_ranges(*digests)
    of = [df.select("*", leaf).join(open_, "leaf", "left_semi").groupBy(key, *columns).agg(F.count("*").alias("n")) for df in sides]
    bags = [d.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.pmod(F.xxhash64("n", *columns), F.lit((1 << 31) - 1))).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "n", *columns)).alias("x")) for d in of]
    a, b = (d.select(key, F.struct("n", "s", "x").alias(name)) for d, name in zip(bags, ("a", "b"), strict=True))
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    found = written(a.join(b, key, "full_outer").select(key, kind.alias("kind")).where("kind IS NOT NULL"), "differences")
    lost = unread.limit(1).count() if unread is not None else 0
    joined, many = open_.count(), found.count()
    verdict = "incomplete" if lost else "equal" if not many else "different"
    totals = found.sparkSession.range(1).select(F.lit(seen["leaves"]).alias("leaves"), F.lit(joined).alias("joined"), F.lit(seen["compared"]).alias("compared"), F.lit(many).alias("differences"), F.lit(verdict).alias("verdict"))
    return found, totals
