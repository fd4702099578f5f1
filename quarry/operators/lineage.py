"""Versions against their baselines, epochs, owners, leases, recovery, and images of versions that no longer serve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of chunks that are nothing but an image.
IMAGE_KINDS = ("image", "visual_knowledge")


def source_relation(old_checksum: Column, checksum: Column, old_etag: Column, etag: Column) -> Column:
    """same_checksum, same_etag, changed or unknown; checksums outweigh tags, and tags are compared without quotes and case."""
    known = lambda c: F.nullif(c, F.lit(""))
    tag = lambda c: known(F.lower(F.regexp_replace(F.trim(c), "^\"+|\"+$", "")))
    sums, tags = known(old_checksum) == known(checksum), tag(old_etag) == tag(etag)
    return F.when(sums, "same_checksum").when(~sums, "changed").when(tags, "same_etag").when(~tags, "changed").otherwise("unknown")


def event_key(doc: Column, baseline: Column, observed: Column) -> Column:
    """Sixteen hex digits that name the change of a document between two versions."""
    shown = [F.coalesce(c.cast("string"), F.lit("None")) for c in (doc, baseline, observed)]
    return F.substring(F.sha2(F.concat_ws("|", F.lit("ASSET_SET_DIFF"), *shown), 256), 1, 16)


def baseline_versions(versions: DataFrame) -> DataFrame:
    """``baseline_no``: the highest lower version of the document that was indexed and has a canonical form; null without any."""
    before = Window.partitionBy("doc_id").orderBy("version_no").rangeBetween(Window.unboundedPreceding, -1)
    served = F.when((F.col("index_status") == "SUCCESS") & F.col("canonical_key").isNotNull(), F.col("version_no"))
    return versions.withColumn("baseline_no", F.max(served).over(before))


def epoch_probes(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """``unconverged, ahead``: documents with active chunks of no or a lower epoch than their own, and of a higher one; one row."""
    c, d = chunks.where("is_active = 1").select("doc_id", F.col("epoch").alias("has")), docs.select("doc_id", F.col("epoch").alias("due"))
    late = F.col("has").isNull() | (F.col("has") < F.col("due"))
    per = c.join(d, "doc_id").groupBy("doc_id").agg(F.max(late.cast("int")).alias("late"), F.max((F.col("has") > F.col("due")).cast("int")).alias("ahead"))
    return per.agg(F.coalesce(F.sum("late"), F.lit(0)).alias("unconverged"), F.coalesce(F.sum("ahead"), F.lit(0)).alias("ahead"))


def unknown_owners(docs: DataFrame, known: list[str], prefix: str = "production") -> DataFrame:
    """``owner_dept``: owners of active documents that look like the group ``prefix`` but aren't among its known ones."""
    owner = F.col("owner_dept")
    return docs.where((F.lower("status") == "active") & owner.startswith(prefix) & ~owner.isin(*known)).select("owner_dept").distinct()


def resume_report(versions: DataFrame, stale_before: Column) -> DataFrame:
    """Per stage, what is in flight and, of that, what hasn't moved since ``stale_before``; stage 1 has no age limit. One row."""
    content, live = F.col("content_status"), F.lower("status") == "active"
    one, two, three = (content == "LOADING") & live, content.isin("LOADING", "PROCESSING") & live, F.col("index_status") == "PROCESSING"
    old = F.col("updated_at") < stale_before
    return versions.agg(
        F.count_if(one).alias("stage1_in_flight"), F.count_if(two).alias("stage2_in_flight"), F.count_if(two & old).alias("stage2_stale"), F.count_if(three).alias("stage3_in_flight"), F.count_if(three & old).alias("stage3_stale")
    )


def routed_coverage(routed: DataFrame, chunks: DataFrame) -> DataFrame:
    """``doc_id, step_cards, total, state`` of documents routed as procedures: covered, missed (chunks but no step), or empty."""
    per = chunks.where("is_active = 1").groupBy("doc_id").agg(F.count_if(F.col("chunk_type") == "step_card").alias("step_cards"), F.count("*").alias("total"))
    out = routed.select("doc_id").join(per, "doc_id", "left").na.fill(0, ["step_cards", "total"])
    return out.withColumn("state", F.when(F.col("step_cards") > 0, "covered").when(F.col("total") > 0, "missed").otherwise("empty"))


def admin_roots(admins: DataFrame, grants: DataFrame, staff: DataFrame, nodes: DataFrame, most: int = 30) -> DataFrame:
    """``user_id, root, action, risk, revoked`` over ``grants(user_id, node, source, is_active)``, ``staff(user_id, node)`` and ``nodes(node, depth, subtree)``.

    A manual grant replaces automatic ones; none or several departments leave the root to people; the root that is
    already granted stays; one at the first level, with a subtree over ``most``, or in place of another is only a
    candidate; else it is granted. ``revoked`` counts the automatic grants to end.
    """
    held = grants.where("is_active").groupBy("user_id").agg(F.bool_or(F.col("source") == "manual").alias("manual"), F.collect_set(F.when(F.col("source") == "auto", F.col("node"))).alias("auto"))
    homes = staff.groupBy("user_id").agg(F.count_distinct("node").alias("homes"), F.min("node").alias("node"))
    rows = admins.select("user_id").distinct().join(held, "user_id", "left").join(homes, "user_id", "left").join(nodes, "node", "left")
    auto = F.coalesce("auto", F.array().cast(held.schema["auto"].dataType))
    clear = F.coalesce(F.col("homes") == 1, F.lit(False))
    risk = F.when(F.col("depth") == 1, "center_level").when(F.col("subtree") > most, "oversized").when((F.size(auto) > 0) & ~F.array_contains(auto, F.col("node")), "root_changed")
    action = (
        F.when(F.col("manual"), "manual").when(~clear, "unclear").when((F.size(auto) == 1) & F.array_contains(auto, F.col("node")), "unchanged").when(risk.isNotNull(), "candidate").otherwise("granted")
    )
    out = rows.withColumn("action", action)
    ended = F.when(F.col("action").isin("manual", "unclear", "candidate"), F.size(auto)).otherwise(0)
    return out.select("user_id", F.when(F.col("action").isin("unchanged", "candidate", "granted"), F.col("node")).alias("root"), "action", F.when(F.col("action") == "candidate", risk).alias("risk"), ended.alias("revoked"))


def cited_usage(log: DataFrame, ids: list[str], cited: str = "cited_json") -> DataFrame:
    """``id, n``: rows whose JSON text contains the id, longer ids that hold it included; one pass for a stated list of ids."""
    counts = log.agg(*[F.count_if(F.contains(F.col(cited), F.lit(i))).alias(f"n{k}") for k, i in enumerate(ids)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("id"), F.col(f"n{k}").alias("n")) for k, i in enumerate(ids)])).alias("x")).select("x.*")


def lease_step(epoch: Column, owner: Column, until: Column, asker: Column, asked_epoch: Column, now: Column) -> Column:
    """What a worker may do with a lease: renew its own live one at its epoch, claim a free or expired one at the next epoch, else be fenced."""
    free = owner.isNull() | until.isNull() | (until < now)
    action = F.when(~free & (owner == asker) & (epoch == asked_epoch), "renew").when(free, "claim").otherwise("fenced")
    return F.struct(action.alias("action"), F.when(action == "claim", F.coalesce(epoch, F.lit(0)) + 1).when(action == "renew", epoch).alias("epoch"))


def gate_stale_images(rows: DataFrame, authority: DataFrame, serving: DataFrame) -> DataFrame:
    """``rows(chunk_id, pk, chunk_type, image_refs, ...)`` without images of versions that don't serve.

    The version is that of ``authority(chunk_id, pk, doc_id, chunk_type, version_no)``, found by chunk_id or, without
    one, by pk, and must be the document's in ``serving(doc_id, serving)``. What can't be found doesn't pass: rows that
    are but an image, by either side's kind, go; others lose ``image_refs``. Rows without images stay as they are.
    """
    known = authority.join(serving, "doc_id", "left")
    fine = F.coalesce(F.col("version_no") == F.col("serving"), F.lit(False))
    keys = F.array(F.concat(F.lit("c"), "chunk_id"), F.concat(F.lit("p"), F.col("pk").cast("string")))
    verdict = known.select(F.explode(F.array_compact(keys)).alias("__key"), fine.alias("__fine"), F.col("chunk_type").isin(*IMAGE_KINDS).alias("__image"))
    verdict = verdict.groupBy("__key").agg(F.bool_and("__fine").alias("__fine"), F.bool_or("__image").alias("__image"))
    own = F.coalesce(F.concat(F.lit("c"), F.nullif("chunk_id", F.lit(""))), F.concat(F.lit("p"), F.col("pk").cast("string")))
    joined = rows.withColumn("__key", own).join(verdict, "__key", "left")
    image = F.coalesce(F.col("chunk_type").isin(*IMAGE_KINDS), F.lit(False))
    concerned = image | (F.coalesce(F.size("image_refs"), F.lit(0)) > 0)
    stale = concerned & ~F.coalesce("__fine", F.lit(False))
    kept = joined.where(~(stale & (image | F.coalesce("__image", F.lit(False)))))
    return kept.withColumn("image_refs", F.when(~stale, F.col("image_refs"))).select(*rows.columns)


def section_cards(blocks: DataFrame, cards: list[tuple[list[str], str, str]], first: tuple[str, str] = ("header", "spec_header_card"), least: int = 10) -> DataFrame:
    """``doc_id, card_no, section, card_type, text`` over ``blocks(doc_id, block_no, text)``: runs of blocks under one section.

    A block that holds a keyword of ``cards(keywords, section, type)`` opens that section, the first entry that fits;
    neighbours of one section are one card; those shorter than ``least`` are left out.
    """
    text = F.trim("text")
    opened = F.lit(None).cast("struct<section:string,card_type:string>")
    for words, section, kind in reversed(cards):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        opened = F.when(hit, F.struct(F.lit(section).alias("section"), F.lit(kind).alias("card_type"))).otherwise(opened)
    w = Window.partitionBy("doc_id").orderBy("block_no")
    rows = blocks.where(text != "").select("doc_id", "block_no", text.alias("text"), F.last(opened, ignorenulls=True).over(w).alias("s"))
    begin = F.struct(F.lit(first[0]).alias("section"), F.lit(first[1]).alias("card_type"))
    rows = rows.select("doc_id", "block_no", "text", F.coalesce("s", begin).alias("s"))
    turned = F.coalesce(F.lag("s.section").over(w) != F.col("s.section"), F.lit(True))
    rows = rows.withColumn("card_no", F.sum(turned.cast("int")).over(w))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"])
    out = rows.groupBy("doc_id", "card_no").agg(F.min_by("s", "block_no").alias("s"), F.array_join(lines, "\n").alias("text"))
    return out.where(F.char_length("text") >= least).select("doc_id", "card_no", "s.section", "s.card_type", "text")
