"""Column functions of access control: groups, owners, the read decision, projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODE_OWNER = "__node__"
MAX_TERMS = 64


def _strings() -> Column:
    return F.array().cast("array<string>")


def normalize_groups(groups: Column, allowed: list[str]) -> Column:
    """Comma-separated groups as a list: trimmed, allowed ones only, each once, in their order; null gives none."""
    parts = F.transform(F.split(F.coalesce(groups, F.lit("")), ","), lambda g: F.trim(g))
    return F.array_distinct(F.filter(parts, lambda g: g.isin(*allowed)))


def expand_owners(groups: Column, umbrella: dict[str, list[str]]) -> Column:
    """The owners that groups stand for: an umbrella group for its lines, any other for itself."""
    table = F.create_map(*[x for k, v in umbrella.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if umbrella else None
    if table is None:
        return F.array_distinct(groups)
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.coalesce(F.try_element_at(table, g), F.array(g)))))


def groups_of_owner(owner: Column, umbrella: dict[str, list[str]]) -> Column:
    """The groups that stand for an owner: itself and all umbrellas over it."""
    over = [F.when(owner.isin(*lines), F.lit(k)) for k, lines in umbrella.items()]
    return F.array_distinct(F.array_compact(F.array(owner, *over)))


def _meet(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def read_filter(permission: Column, owner: Column, allowed: Column, groups: Column, owners: Column, use_allowed: bool = True) -> Column:
    """Public rows; a department's own rows; with ``use_allowed`` also rows granted to one of the groups. No groups: public only."""
    inner = F.coalesce(F.array_contains(owners, owner), F.lit(False))
    if use_allowed:
        inner = inner | _meet(allowed, groups)
    return F.coalesce((permission == "public") | ((permission == "dept_internal") & (F.size(groups) > 0) & inner), F.lit(False))


def can_read(
    permission: Column, mode: Column, owner: Column, doc_groups: Column, node_ids: Column, exact_ids: Column, groups: Column, owners: Column, ancestors: Column, direct: Column,
    channel_ok: Column, org_wide: Column, grant: bool = True,
) -> Column:
    """The read decision: anything unknown or null denies."""
    perm, kind = F.lower(F.trim(F.coalesce(permission, F.lit("")))), F.lower(F.trim(F.coalesce(F.nullif(mode, F.lit("")), F.lit("legacy"))))
    legacy = (F.size(groups) > 0) & (F.coalesce(F.array_contains(owners, owner), F.lit(False)) | _meet(groups, doc_groups))
    node = F.lit(grant) & channel_ok & (org_wide | _meet(ancestors, node_ids) | _meet(direct, exact_ids))
    decided = F.when(perm == "public", True).when(perm != "dept_internal", False).when(kind == "legacy", legacy).when(kind == "node", node).otherwise(False)
    return F.coalesce(decided, F.lit(False))


def node_terms(ancestors: Column, direct: Column, channel_ok: Column, limit: int = MAX_TERMS) -> Column:
    """``d:<id>`` and ``dx:<id>``; over the limit or on a channel that can't be trusted, none at all."""
    terms = F.concat(F.transform(F.array_distinct(ancestors), lambda i: F.concat(F.lit("d:"), i.cast("string"))), F.transform(F.array_distinct(direct), lambda i: F.concat(F.lit("dx:"), i.cast("string"))))
    return F.when(F.coalesce(channel_ok, F.lit(False)) & (F.size(terms) <= limit), terms).otherwise(_strings())


def project_acl(mode: Column, owner: Column, groups: Column, nodes: Column, exact: Column) -> Column:
    """``struct(owner, allowed)``: by node with the sentinel owner, else (unknown modes too) by group. Never both."""
    by_node = F.struct(F.lit(NODE_OWNER).alias("owner"), node_terms(nodes, exact, F.lit(True), 1 << 30).alias("allowed"))
    clean = F.array_distinct(F.filter(F.transform(groups, lambda g: F.trim(g)), lambda g: g != ""))
    by_group = F.struct(F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(clean, _strings()).alias("allowed"))
    return F.when(F.lower(F.trim(F.coalesce(mode, F.lit("")))) == "node", by_node).otherwise(by_group)


def gate_allowed(permission: Column, allowed: Column) -> Column:
    """Granted groups count only for a department's internal rows."""
    return F.when(permission == "dept_internal", F.coalesce(allowed, _strings())).otherwise(_strings())


def covers(wide_permission: Column, wide_owner: Column, permission: Column, owner: Column) -> Column:
    """Whether all who may read the second may read the first."""
    return (wide_permission == "public") | ((wide_permission == "dept_internal") & (permission == "dept_internal") & wide_owner.eqNullSafe(owner))


def still_granted(hits, grants):
    """Hits ``(doc_id, group, via_grant)`` less those that were shown for a grant which ``grants(doc_id, group, status)`` no longer has as approved."""
    from pyspark.sql import functions as F

    approved = grants.where(F.lower("status") == "approved").select("doc_id", "group").distinct()
    held = hits.where("via_grant").join(approved, ["doc_id", "group"], "left_semi")
    return hits.where(~F.coalesce("via_grant", F.lit(False))).unionByName(held)
