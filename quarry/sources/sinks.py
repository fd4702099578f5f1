"""Sinks: bulk batches, upserts, facts, retention, audit, streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import mask_staff_id
from quarry.operators.sequence import greedy_batches


def bulk_batches(chunks: DataFrame, id_col: str, max_bytes: int = 1_500_000) -> DataFrame:
    """``batch_no, n_rows, n_bytes, body``: NDJSON batches filled greedily by UTF-8 bytes, in the order of the ids as text.

    A batch is closed before the row that would exceed the limit, and a row over the limit is a batch of its own. A
    body holds one batch, so its size is bounded by the limit or by its one row.
    """
    body = F.to_json(F.struct(*chunks.columns))
    rows = chunks.select(F.col(id_col).cast("string").alias("__id"), body.alias("body"))
    dealt = greedy_batches(rows, ["__id", F.sha2("body", 256)], F.octet_length("body") + 1, max_bytes)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda x: x["body"]), "\n")
    return dealt.groupBy("batch_no").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), F.concat(lines, F.lit("\n")).alias("body"))


def upsert(target: DataFrame, changes: DataFrame, key: list[str], order: Column | None = None) -> DataFrame:
    """The target with the changes in it; of several changes to a key the last by ``order`` wins."""
    if order is not None:
        rank = Window.partitionBy(*key).orderBy(order.desc())
        changes = changes.withColumn("__n", F.row_number().over(rank)).where("__n = 1").drop("__n")
    return target.join(changes.select(*key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def insert_ignore(target: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The target with rows of new keys; what is there stays, and of several new rows one is taken."""
    return target.unionByName(rows.dropDuplicates(key).join(target.select(*key), key, "left_anti"), allowMissingColumns=True)


def update_where(target: DataFrame, source: DataFrame, key: list[str], condition: Column, values: dict[str, Column]) -> DataFrame:
    """Sets columns of target rows whose source row meets the condition; the others stay as they are."""
    hit = source.where(condition).select(*key).distinct().withColumn("__hit", F.lit(True))
    out = target.join(hit, key, "left")
    for name, value in values.items():
        out = out.withColumn(name, F.when(F.coalesce("__hit", F.lit(False)), value).otherwise(F.col(name)))
    return out.drop("__hit")


def retrieved_facts(log: DataFrame, json_col: str = "retrieved_docs_json") -> DataFrame:
    """``message_id, doc_id, cited`` from the JSON list of each message, each triple once; null and broken lists give none."""
    docs = F.from_json(json_col, "array<struct<doc_id: string, cited: int>>")
    return log.select("message_id", F.explode(docs).alias("d")).select("message_id", "d.doc_id", F.coalesce("d.cited", F.lit(0)).alias("cited")).where("doc_id is not null").distinct()


#: Months that rows are kept, by table.
RETENTION_MONTHS = {"blobs": 6, "rows": 18, "audit": 24, "runs": 12, "findings": 24, "facts": 18}


def split_by_retention(df: DataFrame, ts: str, kind: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """``(kept, expired)``; rows without a time are kept."""
    limit = F.add_months(F.to_date(now), -RETENTION_MONTHS[kind])
    old = F.coalesce(F.to_date(ts) < limit, F.lit(False))
    return df.where(~old), df.where(old)


def archive(expired: DataFrame, path: str, ts: str) -> None:
    """Appends expired rows by month, before they are deleted at the source."""
    expired.withColumn("__month", F.date_format(ts, "yyyy-MM")).write.mode("append").partitionBy("__month").parquet(path)


def audit_rows(actions: DataFrame, longest: int = 500) -> DataFrame:
    """Audit rows with masked staff ids and messages of bounded length."""
    return actions.withColumn("staff_id", mask_staff_id(F.col("staff_id"))).withColumn("message", F.substring("message", 1, longest))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Canonical SHA-256 of the normalised text beside each document."""
    from quarry.functions.text import normalize_text

    return docs.withColumn("canonical_sha256", F.sha2(normalize_text(F.col(text_col)), 256))


def log_rows(answers: DataFrame) -> dict[str, DataFrame]:
    """What one commit of the question log writes, from ``answers(message_id, session_id, user_id, created_at, query_text, answer_status, retrieved)``.

    ``events``: a row per message, of several the first; ``facts``: message and document, each pair once;
    ``conversations``: per session its last time and number of messages, for an upsert. Unknown columns are left out.
    """
    known = [c for c in ("message_id", "session_id", "user_id", "created_at", "query_text", "answer_status") if c in answers.columns]
    first = F.row_number().over(Window.partitionBy("message_id").orderBy("created_at"))
    once = answers.withColumn("__n", first).where("__n = 1").drop("__n")
    facts = once.select("message_id", F.explode("retrieved").alias("doc_id")).where("doc_id is not null").distinct()
    return {"events": once.select(*known), "facts": facts, "conversations": once.groupBy("session_id").agg(F.max("created_at").alias("last_at"), F.count("*").alias("messages"))}


def status_write_back(versions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Versions with ``chunk_status`` from their chunks: EMPTY without any, FAILED if one failed, else INDEXED if all are, else PROCESSING."""
    per = chunks.groupBy("doc_id", "version_no").agg(F.count_if(F.col("index_status") == "FAILED").alias("__f"), F.count_if(F.col("index_status") == "INDEXED").alias("__i"), F.count("*").alias("__n"))
    state = F.when(F.col("__n").isNull(), "EMPTY").when(F.col("__f") > 0, "FAILED").when(F.col("__i") == F.col("__n"), "INDEXED").otherwise("PROCESSING")
    return versions.join(per, ["doc_id", "version_no"], "left").withColumn("chunk_status", state).drop("__f", "__i", "__n")


def delete_archived(df: DataFrame, archived: DataFrame, key: list[str]) -> DataFrame:
    """The table without rows that the archive holds: only what was archived goes."""
    return df.join(archived.select(*key).distinct(), key, "left_anti")
