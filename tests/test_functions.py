"""Column functions on small fixtures, CJK rules among them."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import acl, arrow, redact, status, text


def one(spark, column, **values):
    kinds = {str: "string", int: "long", float: "double", bool: "boolean", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x long"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("y")).first()["y"]


T = F.col


def test_normalize_text(spark):
    raw = "Ａ１​ｂ　c\n \n\t\n\nd\n\ne"
    once = one(spark, text.normalize_text(T("t")), t=raw)
    assert once == "A1b c\n\nd\n\ne" and one(spark, text.normalize_text(T("t")), t=once) == once


@pytest.mark.parametrize(("q", "junk", "incomplete", "noise"), [("？！", True, False, True), ("a", True, False, True), ("12345", True, False, True), ("然后呢", False, True, False), ("第二步呢", False, True, False), ("怎么请假", False, False, False), ("你好", False, False, True), (None, True, False, True), ("库存多少", False, False, False)])
def test_question_rules(spark, q, junk, incomplete, noise):
    assert one(spark, text.is_junk_question(T("q")), q=q) is junk
    assert one(spark, text.is_incomplete_question(T("q")), q=q) is incomplete
    assert one(spark, text.is_noise_turn(T("q")), q=q) is noise


def test_question_hash_forms_agree(spark):
    a, b = "如何 申请 密钥?", "如何申请密钥！"
    assert one(spark, text.question_hash(T("q")), q=a) == one(spark, text.question_hash(T("q")), q=b) == hashlib.sha256("如何申请密钥".encode()).hexdigest()
    assert one(spark, arrow.normalize_question_nfkc(T("q")), q="ﬁ Ｘ①") == "fix1"


def test_tokens_ids_and_grams(spark):
    assert one(spark, text.estimate_tokens(T("t")), t="中文abc") == 2
    assert one(spark, text.chunk_id(T("d"), F.lit(2), F.lit(7)), d="D1") == "D1_v2_c0007_" + hashlib.sha256(b"D1_v2_c0007").hexdigest()[:8].upper()
    assert one(spark, text.gram_containment(T("a"), T("b")), a="ab cd", b="xxabcdyy") == 1.0 and one(spark, text.gram_containment(T("a"), T("b")), a="ab", b="abc") == 0.0
    assert one(spark, text.title_similarity(T("a"), T("b")), a="《手册》 Guide.docx", b="guide") == 1.0
    assert one(spark, text.strip_image_markers(T("t")), t="a<<IMG:1>>b【IMG： 2.3】c") == "abc"
    assert one(spark, text.mask_staff_id(T("t")), t="abcdef") == "ab***ef" and one(spark, text.mask_staff_id(T("t")), t="abc") == "***"


def plain_simhash(t):
    s = "".join(t.split())
    if len(s) < 3:
        return 0
    votes = [0] * 64
    for k in range(len(s) - 2):
        h = int.from_bytes(hashlib.md5(s[k : k + 3].encode()).digest()[:8], "big")
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] > 0)


def test_simhash(spark):
    for t in ("", "ab", "hello world", "中文文本相似度 " * 9):
        assert one(spark, arrow.simhash64(T("t")), t=t) % (1 << 64) == plain_simhash(t)


def test_common_substring():
    assert arrow.common_substring("xabcdy", "zabcdw") == 4 and arrow.common_substring("", "a") == 0


@pytest.mark.parametrize(
    ("raw", "masked", "found"),
    [
        ("身份证号110101199003071234", "身份证号110101****1234", ["cn_id_card"]), ("电话13812345678", "电话138****5678", ["cn_mobile"]), ("订单号 6222020200112233445", "订单号 6222020200112233445", []),
        ("卡号 6222020200112233445", "卡号 6222****3445", ["bank_card"]), ("mail abc@x.com", "mail ab***@x.com", ["email"]), ("数据库password=abcdefgh12", "数据库password=****", ["secret_like"]), ("密钥LTAIabcdefghijkl", "密钥LTAIabcd****", ["access_key"]),
        ("编号3301****1234", "编号[标识已脱敏]", ["masked_id"]), ("杭州市西湖区文三路100号", "[地址已脱敏]", ["address"]), (None, None, []),
    ],
)
def test_masks(raw, masked, found):
    assert redact.mask_text(raw) == (masked, found)


def test_masks_of_image_texts_are_idempotent():
    for raw in ("联系电话 13912349000", "注册号13889211462", "3301****1234"):
        once = redact.mask_text(raw, images=True)[0]
        assert redact.mask_text(once, images=True)[0] == once
    assert redact.mask_text("注册号13889211462", images=True)[0] == "注册号13889211462"


def test_risk(spark):
    docs = spark.createDataFrame([(1, "身份证号110101199003071234"), (2, "abc@x.com"), (3, "nothing"), (4, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["action"] for r in redact.risk_decision(docs).collect()} == {1: "quarantine", 2: "redact", 3: "pass", 4: "pass"}
    assert one(spark, redact.redact(T("t")), t="姓名：张三丰 13812345678") == "姓名：[NAME] [CN_MOBILE]"


def decide(spark, perm="dept_internal", mode="legacy", owner="o", doc_groups=(), nodes=(), exact=(), groups=("g",), owners=("g",), ancestors=(), direct=(), ok=True, wide=False, grant=True):
    strings = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    longs = lambda x: F.array(*[F.lit(i).cast("long") for i in x]) if x else F.array().cast("array<long>")
    return one(spark, acl.can_read(F.lit(perm), F.lit(mode), F.lit(owner), strings(doc_groups), longs(nodes), longs(exact), strings(groups), strings(owners), longs(ancestors), longs(direct), F.lit(ok), F.lit(wide), grant))


@pytest.mark.parametrize(
    ("case", "want"),
    [
        ({"perm": "public"}, True), ({"perm": "restricted", "wide": True}, False), ({"perm": None}, False), ({"mode": "odd"}, False), ({"owner": "g"}, True), ({"doc_groups": ["g"]}, True), ({}, False),
        ({"owner": "g", "groups": []}, False), ({"mode": "node", "wide": True}, True), ({"mode": "node", "wide": True, "grant": False}, False), ({"mode": "node", "wide": True, "ok": False}, False),
        ({"mode": "node", "nodes": [5], "ancestors": [5, 6]}, True), ({"mode": "node", "exact": [5], "ancestors": [5]}, False), ({"mode": "node", "exact": [5], "direct": [5]}, True), ({"mode": "node", "owner": "g"}, False),
    ],
)
def test_read_decision(spark, case, want):
    assert decide(spark, **case) is want


def test_acl_parts(spark):
    assert one(spark, acl.normalize_groups(T("g"), ["a", "b"]), g=" b, a,,x,b") == ["b", "a"] and one(spark, acl.normalize_groups(T("g"), ["a"]), g=None) == []
    assert one(spark, acl.expand_owners(T("g"), {"u": ["p", "q"]}), g=["u", "z", "p"]) == ["p", "q", "z"]
    assert one(spark, acl.groups_of_owner(T("o"), {"u": ["p"], "w": ["q"]}), o="p") == ["p", "u"]
    three = F.array(*[F.lit(i).cast("long") for i in (1, 2, 3)])
    assert one(spark, acl.node_terms(three, three, F.lit(True), 6)) == ["d:1", "d:2", "d:3", "dx:1", "dx:2", "dx:3"] and one(spark, acl.node_terms(three, three, F.lit(True), 5)) == []


def test_badges_over_all_values(spark):
    """The chain of branches against the same rules in plain Python, over the cross product."""
    from itertools import product

    axes = [(None, "active", "Deleted"), (None, "superseded"), (None, "QUARANTINED", "skipped_x"), (None, "quarantined"), (None, "EMPTY", "needs_review"), (None, "NOT_STARTED", "failed", "REJECTED", "CONTENT_MISMATCH", "SKIPPED_DUPLICATE", "PENDING_APPROVAL", "RUNNING"), (None, "INDEXED", "SUCCESS", "FAILED", "x")]
    names = ["ds", "vs", "pub", "gate", "ch", "co", "ix"]

    def plain(ds, vs, pub, gate, ch, co, ix):
        up = lambda x: (x or "").upper()
        for hit, badge in [
            (ds is not None and ds.lower() not in ("active", ""), "已退役"), (up(pub) == "QUARANTINED" or (gate or "").lower() == "quarantined", "已隔离"), (up(ch) == "EMPTY" or up(pub).startswith("SKIPPED"), "未入索引"), (up(ch) == "NEEDS_REVIEW", "未入索引"),
            (up(co) == "CONTENT_MISMATCH", "内容不符"), ((vs or "").lower() == "superseded", "历史版本"), (up(ix) in ("INDEXED", "SUCCESS"), "已上线"), (up(co) == "FAILED" or up(ix) == "FAILED", "处理失败"), (up(co) == "REJECTED", "已驳回"), (up(co) == "SKIPPED_DUPLICATE", "内容未变"),
            (up(co) == "PENDING_APPROVAL", "待审核"), (up(co) in ("", "NOT_STARTED"), "排队中"),
        ]:
            if hit:
                return badge
        return "处理中"

    rows = list(product(*axes))
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = df.select(*names, status.status_badge(*map(F.col, names)).alias("b")).collect()
    assert all(r["b"] == plain(*r[:7]) for r in got) and len(got) == len(rows)


def test_bands_and_days(spark):
    assert [one(spark, status.confidence_band(T("s")), s=x) for x in (7.7, 5.8, 5.7, float("nan"))] == ["high", "medium", "low", ""]
    assert one(spark, status.confidence_band(T("s"), "client_fusion"), s=0.53) == "medium"
    day = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 08:30:00' AS t").select(status.service_day(F.col("t")).alias("d")).first()["d"]
    assert str(day) == "2024-03-10" and str(spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 09:30:00' AS t").select(status.service_day(F.col("t")).alias("d")).first()["d"]) == "2024-03-11"
