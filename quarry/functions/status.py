"""Column functions over states: badges, outcome classes, bands, claims, leases, time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _up(c: Column) -> Column:
    return F.upper(F.coalesce(c, F.lit("")))


def _low(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("")))


#: Badges that call for somebody's attention.
BAD_BADGES = ("未入索引", "处理失败", "已隔离", "已驳回", "内容不符")


def status_badge(doc_status: Column, version_status: Column, publish: Column, gate: Column, chunk: Column, content: Column, index: Column) -> Column:
    """The badge of a document's version: the first branch that holds."""
    return (
        F.when(doc_status.isNotNull() & ~F.lower(doc_status).isin("active", ""), "已退役")
        .when((_up(publish) == "QUARANTINED") | (_low(gate) == "quarantined"), "已隔离")
        .when((_up(chunk) == "EMPTY") | _up(publish).startswith("SKIPPED"), "未入索引")
        .when(_up(chunk) == "NEEDS_REVIEW", "未入索引")
        .when(_up(content) == "CONTENT_MISMATCH", "内容不符")
        .when(_low(version_status) == "superseded", "历史版本")
        .when(_up(index).isin("INDEXED", "SUCCESS"), "已上线")
        .when((_up(content) == "FAILED") | (_up(index) == "FAILED"), "处理失败")
        .when(_up(content) == "REJECTED", "已驳回")
        .when(_up(content) == "SKIPPED_DUPLICATE", "内容未变")
        .when(_up(content) == "PENDING_APPROVAL", "待审核")
        .when(_up(content).isin("", "NOT_STARTED"), "排队中")
        .otherwise("处理中")
    )


def outcome_class(status: Column, blocked: Column, hits: Column) -> Column:
    """refusal (a block overrides all), success, no_result, error, or null for what counts nowhere."""
    s = _up(status)
    return (
        F.when(F.coalesce(blocked, F.lit(False)) | (s == "REFUSAL"), "refusal").when(s == "SUCCESS", "success")
        .when((s == "NO_RESULT") | (F.coalesce(hits == 0, F.lit(False)) & ~s.contains("ERROR")), "no_result").when(s.contains("ERROR"), "error")
    )


#: Thresholds of confidence by scoring regime.
BANDS = {"fused": (7.7, 5.8), "rerank": (0.9, 0.8), "client_fusion": (0.57, 0.52)}


def confidence_band(score: Column, regime: str = "fused") -> Column:
    high, medium = BANDS[regime]
    return F.when(score.isNull() | F.isnan(score.cast("double")), "").when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def service_day(ts: Column, stored: str = "America/Los_Angeles", shown: str = "Asia/Shanghai") -> Column:
    """The calendar day, where the service is read, of a wall-clock time stored in another zone."""
    return F.to_date(F.convert_timezone(F.lit(stored), F.lit(shown), ts.cast("timestamp_ntz")))


def claimable(stage: int, content: Column, canonical: Column, retries: Column, chunk_state: Column, lease_until: Column, now: Column, max_retries: int = 3) -> Column:
    """Rows that a worker of a stage may claim."""
    if stage == 1:
        return (_up(content) == "NOT_STARTED") & canonical.isNull()
    if stage == 2:
        return (_up(content) == "FAILED") & (F.coalesce(retries, F.lit(0)) < max_retries)
    return _up(chunk_state).isin("NOT_INDEXED", "FAILED", "PROCESSING") & ((_up(chunk_state) != "PROCESSING") | lease_until.isNull() | (lease_until < now))


def takeover(lease_until: Column, started: Column, now: Column, hours: int = 2) -> Column:
    """A lease that has run out, or none and a start more than two hours ago."""
    return F.when(lease_until.isNotNull(), lease_until < now).otherwise(F.coalesce(started < now - F.expr(f"INTERVAL {int(hours)} HOURS"), F.lit(False)))


def owner_label(owner: Column, node_id: Column) -> Column:
    return F.coalesce(F.nullif(owner, F.lit("")), F.concat(F.lit("node:"), node_id.cast("string")), F.lit("unknown"))


def file_class(name: Column) -> Column:
    """Class of the last extension, letter case aside."""
    ext = F.lower(F.substring_index(name, ".", -1))
    return (
        F.when(~F.contains(name, F.lit(".")), "other").when(ext.isin("doc", "docx"), "word").when(ext.isin("xls", "xlsx", "csv"), "sheet").when(ext.isin("ppt", "pptx"), "slides")
        .when(ext == "pdf", "pdf").when(ext.isin("txt", "md"), "text").when(ext.isin("png", "jpg", "jpeg", "gif"), "image").otherwise("other")
    )


def feedback_bucket(status: Column, negative: Column, band: Column) -> Column:
    """B4 errors; B3 nothing found or refused; B1 complaints under confidence that isn't high; B2 other complaints; else null."""
    s = _up(status)
    return F.when(s.contains("ERROR"), "B4").when(s.isin("NO_RESULT", "REFUSAL"), "B3").when(negative & band.isin("low", "medium", ""), "B1").when(negative, "B2")


def contribution_state(review: Column, ingest: Column) -> Column:
    """One state of two lifecycles: what the review left open or refused stands; once accepted, the ingest's state."""
    return (
        F.when(review == "rejected", "rejected").when(review != "accepted", "pending").when(ingest == "searchable", "searchable").when(ingest == "failed", "failed")
        .when(ingest.isin("registering", "registered"), "processing").otherwise("accepted")
    )


def ledger_filter(docs, facts=None, permission: str = "", badge: str = "", cited: str = "", bad: str = "bad"):
    """Rows of ``docs(doc_id, permission_level, badge)`` by audience, badge (``bad`` stands for all that call for attention) and use; an empty criterion, or one without facts, filters nothing."""
    if permission:
        docs = docs.where(F.col("permission_level") == permission)
    if badge:
        docs = docs.where(F.col("badge").isin(*BAD_BADGES) if badge == bad else F.col("badge") == badge)
    if cited in ("used", "unused") and facts is not None:
        docs = docs.join(facts.where("cited = 1").select("doc_id").distinct(), "doc_id", "left_semi" if cited == "used" else "left_anti")
    return docs
