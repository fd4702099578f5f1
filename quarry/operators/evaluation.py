"""Retrieval and classification statistics."""

from __future__ import annotations

import math
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranking_summary(ranks: DataFrame, rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Recall at 1, 3, 5, 10, mean reciprocal rank and found rate; a null rank wasn't found."""
    r = F.col(rank)
    hit = lambda k: F.round(F.avg(F.when(r <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{k}")
    return ranks.groupBy(*(by or [])).agg(F.count("*").alias("n"), *[hit(k) for k in (1, 3, 5, 10)], F.round(F.avg(F.when(r.isNotNull(), 1 / r).otherwise(0.0)), 6).alias("mrr"), F.round(F.avg(r.isNotNull().cast("double")), 6).alias("found_rate"))


def ndcg(results: DataFrame, k: int = 10) -> DataFrame:
    """``qid, ndcg`` of ``results(qid, rank, relevance)``; 0 where nothing is relevant."""
    ideal = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("relevance"), "rank"))
    gain = lambda at: F.when(F.col(at) <= k, F.col("relevance") / F.log2(F.col(at) + 1)).otherwise(0.0)
    sums = results.withColumn("ideal", ideal).groupBy("qid").agg(F.sum(gain("rank")).alias("dcg"), F.sum(gain("ideal")).alias("idcg"))
    return sums.select("qid", F.round(F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)), 6).alias("ndcg"))


def precision_at(results: DataFrame, k: int) -> DataFrame:
    return results.where(F.col("rank") <= k).groupBy("qid").agg(F.round(F.sum((F.col("relevance") > 0).cast("int")) / k, 6).alias("precision"))


def auc(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The chance that a positive outscores a negative, ties by half.

    Counts by distinct score, so the window holds scores and not rows; give rounded scores where they are many.
    """
    per = scores.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = per.withColumn("won", F.col("p") * (below + F.col("n") / 2))
    return won.agg(F.round(F.try_divide(F.sum("won"), F.sum("p") * F.sum("n")), 6).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def youden_threshold(scores: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The least score at which the true positive rate exceeds the false positive rate most, both of scores at or above it."""
    per = scores.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("n"))
    up = Window.orderBy("threshold").rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    j = F.sum("p").over(up) / F.sum("p").over(every) - F.sum("n").over(up) / F.sum("n").over(every)
    return per.withColumn("j", F.round(j, 9)).orderBy(F.desc("j"), "threshold").limit(1).select("threshold", F.round("j", 6).alias("j"))


def score_summary(df: DataFrame, x: str, by: list[str] | None = None) -> DataFrame:
    from quarry.operators.percentiles import place_ceil, ranked_values

    c, keys = F.col(x), by or []
    cuts = ranked_values(df, keys, x, {f"p{q}": place_ceil(q / 100) for q in (25, 50, 75, 90)})
    out = df.groupBy(*keys).agg(F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.round(F.avg(c), 6).alias("mean"), F.round(F.median(c), 6).alias("median"), F.round(F.stddev_pop(c), 6).alias("pstdev"))
    # Without keys each side is a global aggregate of exactly one row.
    return out.join(cuts, keys, "left") if keys else out.crossJoin(cuts)


#: Chances of a Poisson weight of rate 1 being at most 0, 1, 2, ...
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def _weights(hashes: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """A Poisson weight per row and round, of the row's hash, the round and the seed alone."""
    with np.errstate(over="ignore"):
        z = hashes.astype(np.uint64)[:, None] + (np.arange(rounds, dtype=np.uint64)[None, :] + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right").astype(np.float64)


def bootstrap_ci(df: DataFrame, x: str, key: str, rounds: int = 2000, seed: int = 7, alpha: float = 0.05) -> DataFrame:
    """``n, mean, low, high`` of a mean by resampling rows where they lie: in each round a row counts a hashed Poisson number of times.

    Weights depend on ``key``, the round and the seed alone, so partitions don't matter, and rows of one key are drawn
    together. A task hands on two sums per round; nothing else leaves it. Null values don't count, nor do rounds that draw nothing; without rows all but
    ``n`` are null.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.xxhash64(key).alias("h")).where("x is not null")

    def add(parts):
        n, total, weight, value = 0, 0.0, np.zeros(rounds), np.zeros(rounds)
        for pdf in parts:
            for at in range(0, len(pdf), 2048):
                v, w = pdf["x"].to_numpy()[at : at + 2048], _weights(pdf["h"].to_numpy()[at : at + 2048].view(np.uint64), rounds, seed)
                n, total, weight, value = n + len(v), total + v.sum(), weight + w.sum(axis=0), value + v @ w
        yield pd.DataFrame({"n": [n], "total": [total], "weight": [weight], "value": [value]})

    parts = rows.mapInPandas(add, "n long, total double, weight array<double>, value array<double>")
    whole = parts.agg(F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean"))
    by_round = parts.select(F.posexplode(F.arrays_zip("weight", "value")).alias("round", "s")).groupBy("round").agg(F.try_divide(F.sum("s.value"), F.sum("s.weight")).alias("mean"))
    means = F.array_sort(F.collect_list("mean"))  # one number a round
    cuts = by_round.where("mean IS NOT NULL").agg(means.alias("m")).select(*[F.get("m", F.least(F.size("m") - 1, F.floor(F.size("m") * q).cast("int"))).alias(c) for c, q in (("low", alpha / 2), ("high", 1 - alpha / 2))])
    return whole.crossJoin(cuts).select(F.coalesce("n", F.lit(0)).alias("n"), "mean", "low", "high")  # one row a side


def clustered_bootstrap(df: DataFrame, x: str, cluster: str, rounds: int = 10_000, seed: int = 7) -> DataFrame:
    """The interval over clusters' means."""
    return bootstrap_ci(df.groupBy(cluster).agg(F.avg(x).alias("x")), "x", cluster, rounds, seed)


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of the four outcomes and the exact two-sided p of the discordant ones; pairs with a null are left out."""
    x, y = F.col(a).cast("boolean"), F.col(b).cast("boolean")
    counts = pairs.where(x.isNotNull() & y.isNotNull()).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))

    @F.pandas_udf("double")
    def exact(first: pd.Series, second: pd.Series) -> pd.Series:
        def p(m: int, n: int) -> float:
            total = m + n
            return min(1.0, 2 * sum(comb(total, k) for k in range(min(m, n) + 1)) / 2**total) if total else 1.0

        return pd.Series([p(int(m), int(n)) for m, n in zip(first, second, strict=True)])

    return counts.withColumn("p", exact("only_a", "only_b"))


def agreement(pairs: DataFrame, judge: str, human: str, passing: float) -> DataFrame:
    """Mean absolute error, share within one point, and precision, recall and F1 of passing."""
    j, h = F.col(judge), F.col(human)
    tp, fp, fn = F.count_if((j >= passing) & (h >= passing)), F.count_if((j >= passing) & (h < passing)), F.count_if((j < passing) & (h >= passing))
    out = pairs.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(j - h)), 6).alias("mae"), F.round(F.avg((F.abs(j - h) <= 1).cast("double")), 6).alias("within_one"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return out.withColumns({"precision": F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6), "recall": F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6), "f1": F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6)})


def panel(scores: DataFrame, item: str, score: str) -> DataFrame:
    return scores.groupBy(item).agg(F.round(F.avg(score), 6).alias("mean"), F.round(F.stddev_pop(score), 6).alias("spread"), F.count(score).alias("judges"))


def compare_baseline(current: DataFrame, baseline: DataFrame, same_regime: bool, delta: float = 0.03, delta_points: float = 0.25) -> DataFrame:
    """``metric, value, reference, verdict`` per metric of the baseline that is measured now; another regime gives one row that can't be judged.

    ``baseline(metric, value, higher_is_better, points, advisory)``. Worse by more than the allowance is a regression,
    of an advisory metric only a note.
    """
    if not same_regime:
        return current.sparkSession.createDataFrame([("regime", None, None, "not_comparable")], "metric string, value double, reference double, verdict string")
    b = baseline.select("metric", F.col("value").alias("reference"), "higher_is_better", "points", "advisory")
    joined = b.join(current.select("metric", "value"), "metric")
    room = F.when(F.col("points"), delta_points).otherwise(delta)
    worse = F.when(F.col("higher_is_better"), F.col("value") < F.col("reference") - room).otherwise(F.col("value") > F.col("reference") + room)
    return joined.select("metric", "value", "reference", F.when(~worse, "ok").when(F.col("advisory"), "note").otherwise("regression").alias("verdict"))


def gold_rank(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """``qid, rank``: the best rank at which one of a query's gold documents stands; null if none does."""
    best = hits.join(gold, ["qid", "doc_id"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    return gold.select("qid").distinct().join(best, "qid", "left")


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows of each stratum by a seeded hash of their key."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), key))
    return df.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def pooled_rate(part: Column, whole: Column) -> Column:
    """Sum over sum; null without a denominator."""
    return F.round(F.try_divide(F.sum(part), F.sum(whole)), 6)


def severity_pairs(pairs: DataFrame) -> DataFrame:
    """New against former fabrications of paired answers ``(off, on, off_severity, on_severity)``, and whether they block; one row."""
    counts = []
    for name, here, there, severity in (("on", "on", "off", "on_severity"), ("off", "off", "on", "off_severity")):
        only, level = F.col(here) & ~F.col(there), F.upper(severity)
        counts += [F.count_if(only & (level == "HIGH")).alias(f"{name}_only_high"), F.count_if(only & level.isin("HIGH", "MEDIUM")).alias(f"{name}_only_medium_plus")]
    out = pairs.na.fill(False, ["off", "on"]).agg(*counts)
    return out.withColumns({"high_severity_block": F.col("on_only_high") > 0, "asymmetric_violation": F.col("on_only_medium_plus") > F.col("off_only_medium_plus")})


def visibility_check(docs: DataFrame, public_reads: Column, owner_reads: Column) -> DataFrame:
    """Of gated documents that have an owner: how many the public path hides and the owner's path shows, and whether none leaks; one row."""
    gated = docs.where(F.col("permission").isin("dept_internal", "restricted") & (F.coalesce("owner", F.lit("")) != ""))
    out = gated.agg(F.count("*").alias("tested"), F.count_if(~public_reads).alias("hidden"), F.count_if(owner_reads).alias("shown"))
    return out.withColumns({"applicable": F.col("tested") > 0, "no_leak": F.col("tested") == F.col("hidden")})


def match_chunks(truth: DataFrame, chunks: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``gt_id, status, chunk_no, jaccard``: each expected chunk with the produced one of its document that fits best.

    ``truth(gt_id, doc_id, keywords, chunk_type, section_no, step_no, refs)``, ``chunks(doc_id, chunk_no, text,
    chunk_type, section_no, step_no, refs)``. Only chunks that hold at least ``threshold`` of the keywords count. Those
    of the wanted type go first, among them those of the section, else of the step; then the most keywords, then, where
    images are expected, a chunk with images, then the most keywords per root of the length, then the lower number.
    Without the wanted type density alone decides. No match has a Jaccard index of 0.
    """
    c = chunks.where(F.coalesce("text", F.lit("")) != "").select("doc_id", "chunk_no", F.lower("text").alias("text"), *[F.col(x).alias(f"c_{x}") for x in ("chunk_type", "section_no", "step_no", "refs")])
    joined = truth.join(c, "doc_id", "left")
    hits = F.size(F.filter("keywords", lambda k: F.contains(F.col("text"), F.lower(k))))
    scored = joined.withColumns({"recall": F.try_divide(hits, F.size("keywords")), "density": hits / F.sqrt(F.char_length("text"))})
    per = Window.partitionBy("gt_id")
    fit = F.coalesce(F.col("recall") >= threshold, F.lit(False))
    typed = fit & F.coalesce(F.col("c_chunk_type") == F.col("chunk_type"), F.lit(False))
    same = lambda x: F.coalesce(F.col(f"c_{x}") == F.col(x), F.lit(False)).cast("int")
    has_images = F.coalesce((F.size("refs") > 0) & (F.size("c_refs") > 0), F.lit(False)).cast("int")
    scored = scored.withColumns({"fit": fit, "typed": typed}).withColumn("any_typed", F.max(F.col("typed").cast("int")).over(per) == 1)
    section = F.when(F.col("step_no").isNotNull(), same("section_no")).otherwise(0)
    step = F.when(section == 0, same("step_no")).otherwise(0)
    parts = [F.when(F.col("any_typed"), x.cast("double")).otherwise(0.0) for x in (section, step, F.col("recall"), has_images)]
    rule = F.struct(*parts, F.col("density"))
    order = F.when(F.col("fit") & (F.col("typed") | ~F.col("any_typed")), F.struct(rule.alias("rule"), (-F.col("chunk_no")).alias("n")))
    best = scored.groupBy("gt_id").agg(F.max_by(F.struct("chunk_no", "refs", "c_refs"), order).alias("m"), F.bool_or("fit").alias("matched"), F.count("text").alias("n"), F.max(F.size("keywords")).alias("k"))
    union = F.size(F.array_union("m.refs", "m.c_refs"))
    score = F.when(union == 0, 1.0).otherwise(F.round(F.size(F.array_intersect("m.refs", "m.c_refs")) / union, 4))
    status = F.when(F.coalesce("k", F.lit(0)) <= 0, "no_keywords").when(F.col("n") == 0, "no_scorable").when(~F.col("matched"), "below_threshold").otherwise("matched")
    return best.select("gt_id", status.alias("status"), F.when(status == "matched", F.col("m.chunk_no")).alias("chunk_no"), F.when(status == "matched", score).otherwise(0.0).alias("jaccard"))


def anchor_hits(anchors: DataFrame, chunks: DataFrame) -> DataFrame:
    """``anchor_id, key_hit, image_hit`` over ``anchors(anchor_id, doc_id, keys, signals)`` and ``chunks(doc_id, key, image_refs)``.

    The key is hit if a chunk of the document has one of the anchor's keys; the images, if every signal is the index of
    an image of these chunks (digits) or stands in their summaries or recognised texts; no signals are a hit.
    """
    wanted = anchors.select("anchor_id", "doc_id", F.explode(F.array_distinct("keys")).alias("key")).join(chunks, ["doc_id", "key"])
    found = wanted.groupBy("anchor_id").agg(F.flatten(F.collect_list(F.coalesce("image_refs", F.array().cast(chunks.schema["image_refs"].dataType)))).alias("refs"))
    rows = anchors.select("anchor_id", "signals").join(found, "anchor_id", "left")
    indices = F.transform("refs", lambda r: r["image_index"].cast("string"))
    blob = F.lower(F.array_join(F.transform("refs", lambda r: F.concat_ws(" ", F.coalesce(r["visual_summary"], F.lit("")), F.coalesce(r["ocr_text"], F.lit("")))), " "))
    signals = F.filter(F.transform(F.coalesce("signals", F.array().cast("array<string>")), lambda s: F.trim(s)), lambda s: s != "")
    numeric = lambda s: F.regexp_replace(s, "^0+(?=\\d)", "")
    all_ = F.forall(signals, lambda s: F.when(s.rlike("^\\d+$"), F.array_contains(indices, numeric(s))).otherwise(F.contains(blob, F.lower(s))))
    return rows.select("anchor_id", F.col("refs").isNotNull().alias("key_hit"), (F.col("refs").isNotNull() & F.coalesce(all_, F.lit(False))).alias("image_hit"))


def random_rows(df: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` rows by a seeded hash of their key: the same rows however the table is partitioned."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), key)), key).limit(n)


def strata_summary(ranks: DataFrame) -> DataFrame:
    """``stratum, value`` and the ranking summary of ``ranks(qid, rank, positives, gated, module, source, difficulty)``.

    Negatives (no positive) and gated questions count nowhere; questions with one and with several positives are apart.
    """
    kept = ranks.where((F.col("positives") > 0) & ~F.coalesce("gated", F.lit(False)))
    kept = kept.withColumn("target", F.when(F.col("positives") == 1, "single").otherwise("multi"))
    strata = F.array(*[F.struct(F.lit(c).alias("stratum"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in ("target", "module", "source", "difficulty")])
    return ranking_summary(kept.select(F.explode(strata).alias("s"), "rank").select("s.*", "rank"), by=["stratum", "value"])
