"""Windows, deduplication, sessions and drains over streams of the question log. Each also takes a batch DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 8) -> DataFrame:
    """Appended files of the log as a stream; a batch takes a bounded number of files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def daily_counts(log: DataFrame, ts: str = "created_at", late: str = "1 day") -> DataFrame:
    """Counts by day and status; days later than the watermark are closed."""
    rows = log.withWatermark(ts, late) if log.isStreaming else log
    return rows.groupBy(F.window(ts, "1 day").alias("w"), "answer_status").agg(F.count("*").alias("n"), F.sum("latency_ms").alias("latency")).select(F.to_date("w.start").alias("day"), "answer_status", "n", "latency")


def reject_counts(rejects: DataFrame, ts: str = "ts", every: str = "1 day", late: str = "1 hour") -> DataFrame:
    rows = rejects.withWatermark(ts, late) if rejects.isStreaming else rejects
    return rows.groupBy(F.window(ts, every).alias("w"), "reason").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "reason", "n")


def once_per_message(messages: DataFrame, key: str = "message_id", ts: str = "ts", window: str = "10 minutes") -> DataFrame:
    """The first of the messages that come again within the retry window."""
    if messages.isStreaming:
        return messages.withWatermark(ts, window).dropDuplicatesWithinWatermark([key])
    return messages.dropDuplicates([key])


def sessions(log: DataFrame, user: str = "user_id", ts: str = "created_at", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions closed by a gap without activity."""
    rows = log.withWatermark(ts, late) if log.isStreaming else log
    return rows.groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("turns")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "turns")


def drain(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> int:
    """Handles all there is in bounded batches and stops; offsets persist in the checkpoint. Returns the number of batches."""
    done = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    done.awaitTermination()
    return len([p for p in done.recentProgress if p["numInputRows"] > 0])


def latest_sessions(turns: DataFrame, now: str, idle: str = "30 MINUTES", most: int = 1000) -> DataFrame:
    """``session_id, owner, last_at``: of sessions not idle for longer, the ``most`` used last; the first turn's user owns one, and only the owner's turns keep it alive."""
    owner = turns.groupBy("session_id").agg(F.min_by("user_id", F.struct("ts", "user_id")).alias("owner"))
    own = turns.join(owner, "session_id").where("user_id = owner").groupBy("session_id", "owner").agg(F.max("ts").alias("last_at"))
    return own.where(F.col("last_at") >= F.expr(f"{now} - INTERVAL {idle}")).orderBy(F.desc("last_at"), "session_id").limit(most)


def latest_generation(outbox: DataFrame) -> DataFrame:
    """Open outbox rows, of each document the highest generation."""
    open_ = outbox.where("done_at is null")
    return open_.groupBy("doc_id").agg(F.max_by(F.struct("generation", "attempts", "enqueued_at"), F.struct("generation", "attempts")).alias("x")).select("doc_id", "x.*")


def stale(rows: DataFrame, now: str, ts: str = "started_at", hours: int = 2) -> DataFrame:
    """Rows in work for longer than two hours, to be set back."""
    return rows.where(F.col(ts) < F.expr(f"{now} - INTERVAL {int(hours)} HOURS"))
