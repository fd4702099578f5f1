"""Operators on small stated inputs whose answers were worked out by hand: they stand as values beside the input."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import answers, arrow, redact, status, text
from quarry.operators import audits, chunking, evaluation, gaps, reconcile, retrieval
from quarry.sources import files, office
from quarry.streaming import handoff, limits, rollups


STATED: list = []


def expect(name: str, columns: str, rows: list[tuple]) -> Callable:
    """A case: what the function gives must be these rows."""

    def add(f: Callable[[SparkSession], DataFrame]) -> Callable[[SparkSession], DataFrame]:
        STATED.append(pytest.param(f, columns.split(", "), rows, id=name))
        return f

    return add


def _texts(spark: SparkSession, rows: list[str | None]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows)), "n int, text string")


# Sources.


@expect("ingest_keys", "key, reason", [
    ("raw/_quarantine/a.pdf", "excluded_path"), ("_archive/a.pdf", "excluded_path"), ("raw/x/tmp/a.pdf", "ok"), ("raw/.~a.docx", "temp_file"), ("raw/~$a.docx", "temp_file"), ("raw/Thumbs.db", "junk_name"), ("raw/a.webp", "ok"), ("raw/v.mp4", "ignored_extension"),
    ("raw/a.DOC", "legacy_extension"), ("raw/a.wps", "unknown_extension"), ("raw/a", "no_extension"), ("raw/.hidden", "no_extension"), ("raw/dir/", "directory"), ("", "directory"), ("raw/a.b.PDF", "ok"), ("raw/_Archive/a.pdf", "ok"), ("raw/x.tar", "ignored_extension"),
])
def ingest_keys(spark: SparkSession) -> DataFrame:
    keys = ["raw/_quarantine/a.pdf", "_archive/a.pdf", "raw/x/tmp/a.pdf", "raw/.~a.docx", "raw/~$a.docx", "raw/Thumbs.db", "raw/a.webp", "raw/v.mp4", "raw/a.DOC", "raw/a.wps", "raw/a", "raw/.hidden", "raw/dir/", "", "raw/a.b.PDF", "raw/_Archive/a.pdf", "raw/x.tar"]
    return spark.createDataFrame([(k,) for k in keys], "key string").select("key", files.ingest_decision(F.col("key"))["reason"].alias("reason"))


@expect("raw_key_stems", "key, stem", [("raw/a.b.docx", "a.b"), ("raw/a", "a"), ("raw/.x", ".x"), ("raw/ a .pdf", "a"), ("", "")])
def raw_key_stems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in ("raw/a.b.docx", "raw/a", "raw/.x", "raw/ a .pdf", "")], "key string").select("key", files.raw_key_stem(F.col("key")).alias("stem"))


@expect("inventory_classes", "key, class, age_days", [("raw/b.pdf", "expected_reject", 9), ("raw/c.pdf", "self_serve_orphan", 9), ("raw/d.pdf", "unregistered", 2), ("raw/e.zip", "policy_rejected", 9), ("raw/f.pdf", "unregistered", 9)])
def inventory_classes(spark: SparkSession) -> DataFrame:
    rows = [("raw/a.pdf", "1", "x", "2024-01-01", False), ("raw/b.pdf", "1", "x", "2024-01-01", False), ("raw/c.pdf", "2", "y", "2024-01-01", True), ("raw/d.pdf", "2", "y", "2024-01-08", True), ("raw/e.zip", "3", None, "2024-01-01", False), ("raw/f.pdf", "3", None, "2024-01-01", False)]
    objects = spark.createDataFrame(rows, "key string, doc_id string, etag string, last_modified string, self_serve boolean")
    registry = spark.createDataFrame([("raw/a.pdf", "1", "x"), ("raw/z.pdf", "3", None)], "key string, doc_id string, etag string")
    return files.classify_inventory(objects, registry, F.lit("2024-01-10")).select("key", "class", "age_days")


@expect("plain_blocks", "block_no, block_type, text, level", [(1, "heading", "# Title", 1), (2, "paragraph", "one\ntwo", None), (4, "table", "a | b | c\n1 | 2 | 3", None), (6, "heading", "第一章 总则", 1), (7, "paragraph", "three", None)])
def plain_blocks(spark: SparkSession) -> DataFrame:
    return files.markdown_blocks(_texts(spark, ["# Title\none\ntwo\n\na | b | c\n1 | 2 | 3\n\n第一章 总则\nthree"]), "n").select("block_no", "block_type", "text", "level")


@expect("csv_texts", "n, out", [(0, "a | b\n1 | 2"), (1, "a | b | c\n1 | 2 | 3"), (2, "x | y\n1 | 2"), (3, ""), (4, "a, b | c\n1 | 2")])
def csv_texts(spark: SparkSession) -> DataFrame:
    return _texts(spark, ["a,b\r\n1, 2\n", "a;b;c\n\n1;2;3", "x\ty\n1\t2", "", '"a, b",c\n"1",2']).select("n", files.csv_text(F.col("text")).alias("out"))


@expect("decoded_texts", "n, out", [(0, "中文"), (1, "中文"), (2, "\ufffd"), (3, None), (4, "x")])
def decoded_texts(spark: SparkSession) -> DataFrame:
    rows = [(0, bytearray("中文".encode())), (1, bytearray("中文".encode("gb18030"))), (2, bytearray(b"\xe9")), (3, None), (4, bytearray(b"\xef\xbb\xbfx"))]
    return spark.createDataFrame(rows, "n int, raw binary").select("n", files.decode_text(F.col("raw")).alias("out"))


@expect("html_texts", "n, out", [(0, "Head\n\nOne & two"), (1, "a\nb"), (2, "<p></p>"), (3, "x")])
def html_texts(spark: SparkSession) -> DataFrame:
    return _texts(spark, ["<h1>Head</h1><script>no</script><p>One &amp; two</p>", "a<br>b", "<p></p>", "<style>p{}</style>x"]).select("n", files.html_to_text(F.col("text")).alias("out"))


def _zip(parts: dict[str, str]) -> bytearray:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return bytearray(out.getvalue())


@expect("office_blocks", "path, block_no, block_type, text, page_num, level", [
    ("a.docx", 0, "heading", "Title", None, 1), ("a.docx", 1, "paragraph", "Text", None, None), ("a.docx", 2, "paragraph", "Boxed", None, None), ("a.docx", 3, "paragraph", "Beside", None, None), ("a.docx", 4, "table", "a | b", None, None), ("b.xlsx", 0, "table", "x | 7", 1, None), ("c.pptx", 0, "paragraph", "First", 1, None), ("c.pptx", 1, "paragraph", "Second", 2, None),
])
def office_blocks(spark: SparkSession) -> DataFrame:
    w, a, s = ('xmlns:%s="http://schemas.openxmlformats.org/%s/2006/main"' % x for x in (("w", "wordprocessingml"), ("a", "drawingml"), ("s", "spreadsheetml")))
    para = lambda t, style="": f"<w:p>{style}<w:r><w:t>{t}</w:t></w:r></w:p>"
    head = '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>'
    docx = _zip({"word/document.xml": f"<w:document {w}><w:body>{para('Title', head)}{para('Text')}{para(' ')}<w:p><w:r><w:pict><w:txbxContent>{para('Boxed')}</w:txbxContent></w:pict><w:t>Beside</w:t></w:r></w:p><w:tbl><w:tr><w:tc>{para('a')}</w:tc><w:tc>{para('b')}</w:tc></w:tr></w:tbl></w:body></w:document>"})
    xlsx = _zip({"xl/sharedStrings.xml": f"<s:sst {s}><s:si><s:t>x</s:t></s:si></s:sst>", "xl/worksheets/sheet1.xml": f'<s:worksheet {s}><s:sheetData><s:row><s:c t="s"><s:v>0</s:v></s:c><s:c><s:v>7</s:v></s:c></s:row></s:sheetData></s:worksheet>'})
    slide = lambda t: f"<a:x {a}><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:x>"
    pptx = _zip({"ppt/slides/slide2.xml": slide("Second"), "ppt/slides/slide1.xml": slide("First")})
    return office.read_blocks(spark.createDataFrame([("a.docx", docx), ("b.xlsx", xlsx), ("c.pptx", pptx), ("d.txt", bytearray(b"x"))], "path string, content binary"))


@expect("workbook_layouts", "name, layout", [("常见问题 FAQ.xlsx", "faq"), ("产品规格.xlsx", "spec"), ("操作步骤.xlsx", "steps"), ("2024.xlsx", "table")])
def workbook_layouts(spark: SparkSession) -> DataFrame:
    names = ["常见问题 FAQ.xlsx", "产品规格.xlsx", "操作步骤.xlsx", "2024.xlsx"]
    return spark.createDataFrame([(n, office.workbook_layout(n, ["Sheet1"], "")) for n in names], "name string, layout string")


# Entities.

_PII = [
    "身份证号110101199003071234", "电话13812345678，邮箱 abc@x.com", "订单号 6222020200112233445", "卡号 6222020200112233445", "数据库password=abcdefgh12", "密钥LTAIabcdefghijkl", "编号3301****1234", "杭州市西湖区文三路100号", "物料编码 331081199001011234", "注册号13889211462", "信用代码91330100MA27XYZ123",
    "订单号 6222020200112233445 卡号 6222020200112233446", "plain",
]


@expect("pii_kinds", "n, kinds, in_images", [
    (0, "cn_id_card:1", "cn_id_card:1"), (1, "cn_mobile:1,email:1", "cn_mobile:1,email:1"), (2, "", ""), (3, "bank_card:1", "bank_card:1"), (4, "secret_like:1", "secret_like:1"), (5, "access_key:1", "access_key:1"), (6, "masked_id:1", "masked_id:1"), (7, "address:1", "address:1"),
    (8, "cn_id_card:1", ""), (9, "cn_mobile:1", ""), (10, "uscc:1", "uscc:1"), (11, "bank_card:2", "bank_card:2"), (12, "", ""),
])
def pii_kinds(spark: SparkSession) -> DataFrame:
    shown = lambda found: F.array_join(F.array_compact(F.array(*[F.when(F.map_contains_key(found, k), F.concat(F.lit(k + ":"), found[k].cast("string"))) for k in redact.ENTITIES])), ",")
    return _texts(spark, _PII).select("n", shown(redact.detect(F.col("text"))).alias("kinds"), shown(redact.detect(F.col("text"), images=True)).alias("in_images"))


@expect("pii_masks", "n, body, image", [
    (0, "身份证号110101****1234", "身份证号110101****1234"), (1, "电话138****5678，邮箱 ab***@x.com", "电话138****5678，邮箱 ab***@x.com"), (2, "订单号 6222020200112233445", "订单号 6222020200112233445"), (3, "卡号 6222****3445", "卡号 6222****3445"),
    (4, "数据库password=****", "数据库password=****"), (5, "密钥LTAIabcd****", "密钥LTAIabcd****"), (6, "编号[标识已脱敏]", "编号3301****1234"), (7, "[地址已脱敏]", "[地址已脱敏]"), (8, "物料编码 331081****1234", "物料编码 331081199001011234"), (9, "注册号138****1462", "注册号13889211462"),
    (10, "信用代码9133****23", "信用代码9133****23"), (11, "订单号 6222****3445 卡号 6222****3446", "订单号 6222****3445 卡号 6222****3446"), (12, "plain", "plain"),
])
def pii_masks(spark: SparkSession) -> DataFrame:
    """Of number 11 the word for a card stands near both numbers."""
    return _texts(spark, _PII).select("n", redact.scrub(F.col("text"), images=False)["text"].alias("body"), redact.scrub(F.col("text"))["text"].alias("image"))


@expect("pii_risks", "n, risk, action", [(0, "high", "quarantine"), (1, "medium", "redact"), (2, "low", "pass"), (3, "medium", "redact"), (4, "high", "quarantine"), (5, "high", "quarantine"), (6, "medium", "redact"), (7, "medium", "redact"), (8, "high", "quarantine"), (9, "medium", "redact"), (10, "medium", "redact"), (11, "medium", "redact"), (12, "low", "pass")])
def pii_risks(spark: SparkSession) -> DataFrame:
    return redact.risk_decision(_texts(spark, _PII)).select("n", "risk", "action")


@expect("pii_redacted", "n, out, residual", [(0, "身份证号[CN_ID_CARD]", 0), (1, "姓名：[NAME] [CN_MOBILE]", 0), (2, "[EMAIL] [ADDRESS]", 0), (3, "[SECRET_LIKE]", 0)])
def pii_redacted(spark: SparkSession) -> DataFrame:
    rows = _texts(spark, ["身份证号110101199003071234", "姓名：张三丰 13812345678", "abc@x.com 住杭州市西湖区文三路100号", "token: abcdefgh1234"]).withColumn("out", redact.redact(F.col("text")))
    return rows.select("n", "out", F.size(redact.residual(F.col("out"))).alias("residual"))


# Texts and answers.


@expect("answer_kinds", "n, refuses, wholly, leaks, images, steps", [
    (0, True, True, False, 0, 0), (1, False, False, False, 0, 0), (2, False, False, True, 1, 2), (3, False, False, False, 0, 3), (4, False, False, False, 0, 0), (5, True, True, False, 0, 0), (6, False, False, False, 0, 0),
])
def answer_kinds(spark: SparkSession) -> DataFrame:
    rows = ["抱歉，知识库中没有这项内容。不过" + "可以参考" * 60, "先做一。" * 40 + "知识库中未提供第二项", "1. 打开\n2、关闭\n见<<IMG: 3>>\n参考来源：甲", "第一步 开\n步骤 2 关\n3) 完", None, "短答：无法回答", "根据参考文档，可以"]
    t = F.col("text")
    return _texts(spark, rows).select("n", answers.refuses(t).alias("refuses"), answers.refuses_wholly(t).alias("wholly"), answers.leaks_sources(t).alias("leaks"), answers.image_marks(t).alias("images"), answers.numbered_steps(t).alias("steps"))


@expect("sums", "n, value", [(0, 14.0), (1, 20.0), (2, 7.5), (3, 0.2), (4, -8.0), (5, None), (6, None), (7, None), (8, 2.0), (9, None), (10, None)])
def sums(spark: SparkSession) -> DataFrame:
    rows = ["2+3*4", "(2+3)×4=", "15÷2等于几？", "20%*1", "-2**3", "1/0", "9**999", "今天几号", "17 % 5", "7", "2**3**2"]
    return _texts(spark, rows).select("n", answers.arithmetic(F.col("text")).alias("value"))


@expect("prose_tables", "n, prose, flat", [(0, True, "1、" + "甲" * 30), (1, False, "a b")])
def prose_tables(spark: SparkSession) -> DataFrame:
    long = " | ".join(f"{k}、" + "甲" * 60 for k in range(1, 11))
    t = F.col("text")
    return _texts(spark, [long, "a | b"]).select("n", text.is_prose_table(t).alias("prose"), F.substring(text.flatten_prose_table(t), 1, 32).alias("flat"))


@expect("common_substrings", "n, length", [(0, 4), (1, 0), (2, 3), (3, 0)])
def common_substrings(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(0, "xabcdy", "zabcdw"), (1, "abc", "xyz"), (2, "中文字符", "文字符集"), (3, None, "a")], "n int, a string, b string")
    return rows.select("n", arrow.longest_common_substring(F.col("a"), F.col("b")).alias("length"))


# Chunks.

_CHUNK = "doc_id, chunk_index, chunk_type, section_title, chunk_text"


def _cut(spark: SparkSession, body: str, mode: str, config: chunking.ChunkConfig = chunking.ChunkConfig()) -> DataFrame:
    return chunking.chunk_documents(spark.createDataFrame([("d", 1, body), ("e", 1, None)], "doc_id string, version_no int, text string"), mode, config).select(*_CHUNK.split(", "))


_A, _B = "甲" * 60, "乙" * 60


@expect("chunks_of_sections", _CHUNK, [("d", 0, "text_chunk", None, _A), ("d", 1, "text_chunk", "One", _B + "\n\n" + _A), ("d", 2, "table_chunk", "One", "a | b | c\n1 | 2 | 3"), ("d", 3, "text_chunk", "第二章 附则", "丙" * 50)])
def chunks_of_sections(spark: SparkSession) -> DataFrame:
    return _cut(spark, f"{_A}\n# One\n{_B}\n\n{_A}\na | b | c\n1 | 2 | 3\n## Empty\n第二章 附则\n{'丙' * 50}", "default")


@expect("chunks_parent_child", _CHUNK, [("d", 0, "text_chunk", None, "甲" * 100), ("d", 1, "child_chunk", None, "甲" * 60), ("d", 2, "child_chunk", None, "甲" * 60), ("d", 3, "child_chunk", None, "甲" * 20)])
def chunks_parent_child(spark: SparkSession) -> DataFrame:
    return _cut(spark, "甲" * 100, "default", chunking.ChunkConfig(parent_child=True, child_chars=60, child_overlap=20))


@expect("chunks_faq", _CHUNK, [("d", 0, "text_chunk", None, "前言"), ("d", 1, "faq_chunk", "怎么开？", "Q1：怎么开？\nA：按键。"), ("d", 2, "faq_chunk", "怎么关？", "问：怎么关？\n答：再按。\n两次。")])
def chunks_faq(spark: SparkSession) -> DataFrame:
    return _cut(spark, "前言\nQ1：怎么开？\nA：按键。\n\n问：怎么关？\n答：再按。\n两次。", "faq")


@expect("chunks_clause", _CHUNK, [("d", 0, "text_chunk", None, "总则"), ("d", 1, "clause_chunk", "1", "1、范围包括全部"), ("d", 2, "clause_chunk", "1.1", "1.1 适用于甲方\n2.5kg 不算")])
def chunks_clause(spark: SparkSession) -> DataFrame:
    return _cut(spark, "总则\n1、范围包括全部\n1.1 适用于甲方\n2.5kg 不算", "clause")


@expect("chunks_step", _CHUNK, [
    ("d", 0, "text_chunk", None, "准备\n1 目的"), ("d", 1, "procedure_parent", None, "1. 打开\n2. 关闭\n3. 擦干\n4. 装回\n5.1. 拧紧"), ("d", 2, "step_card", "1", "步骤一：打开\n先看图"), ("d", 3, "step_card", "2", "第二步 关闭"), ("d", 4, "step_card", "3", "3、擦干"),
    ("d", 5, "step_card", "4", "STEP 4: 装回"), ("d", 6, "step_card", "5.1", "5.1 拧紧"),
])
def chunks_step(spark: SparkSession) -> DataFrame:
    return _cut(spark, "准备\n1 目的\n步骤一：打开\n先看图\n第二步 关闭\n3、擦干\nSTEP 4: 装回\n5.1 拧紧", "step")


@expect("chunks_declared_steps", _CHUNK, [
    ("d", 0, "text_chunk", None, "• 第一步：安装电源 …… 1\n• 第二步：安装显卡 …… 2"), ("d", 1, "procedure_parent", None, "1. 安装电源\n2. 显卡插入插槽"), ("d", 2, "step_card", "1", "第一步：安装电源\n拧紧螺丝"), ("d", 3, "step_card", "2", "显卡插入插槽\n接线"),
])
def chunks_declared_steps(spark: SparkSession) -> DataFrame:
    """The second step has no number of its own; the table of contents tells it."""
    return _cut(spark, "• 第一步：安装电源 …… 1\n• 第二步：安装显卡 …… 2\n第一步：安装电源\n拧紧螺丝\n显卡插入插槽\n接线", "step")


_BLOCKS = [(0, "heading", "# 开机", 1), (1, "paragraph", _A, 1), (2, "table", "a | b", 1), (3, "paragraph", _B, 2), (4, "heading", "关机", 2), (5, "paragraph", "丙" * 50, None)]


def _blocks(spark: SparkSession, rows: list[tuple], mode: str) -> DataFrame:
    blocks = spark.createDataFrame([("d", 1, *r) for r in rows], "doc_id string, version_no int, block_no int, block_type string, text string, page_num int")
    return chunking.chunk_blocks(blocks, mode).select(*_CHUNK.split(", "))


@expect("blocks_default", _CHUNK, [("d", 0, "text_chunk", "开机", _A), ("d", 1, "table_chunk", "开机", "a | b"), ("d", 2, "text_chunk", "开机", _B), ("d", 3, "text_chunk", "关机", "丙" * 50)])
def blocks_default(spark: SparkSession) -> DataFrame:
    return _blocks(spark, _BLOCKS, "default")


@expect("blocks_slide", _CHUNK, [("d", 0, "table_chunk", "1", f"# 开机\n{_A}\na | b"), ("d", 1, "text_chunk", "2", f"{_B}\n关机"), ("d", 2, "text_chunk", "0", "丙" * 50)])
def blocks_slide(spark: SparkSession) -> DataFrame:
    return _blocks(spark, _BLOCKS, "slide")


@expect("blocks_product_spec", _CHUNK, [
    ("d", 0, "text_chunk", "header", "规格书编号 2024-001"), ("d", 1, "text_chunk", "product_info", "物料基本信息\n物料名称：茶叶"), ("d", 2, "table_chunk", "raw_material", "原材料信息：绿茶一级"), ("d", 3, "table_chunk", "spec_safety", "微生物指标：合格\n菌落总数\n理化指标：水分 5%"),
])
def blocks_product_spec(spark: SparkSession) -> DataFrame:
    lines = ["规格书编号 2024-001", "物料基本信息", "物料名称：茶叶", "原材料信息：绿茶一级", "微生物指标：合格", "菌落总数", "理化指标：水分 5%", "包装规格"]
    return _blocks(spark, [(0, "heading", "题", 1), *[(k, "paragraph", x, 1) for k, x in enumerate(lines, 1)]], "product_spec")


@expect("header_tables", "chunk_index", [(0,), (2,), (3,), (4,), (6,)])
def header_tables(spark: SparkSession) -> DataFrame:
    rows = [(0, "文件 A | 第 1 页", False), (1, "文件 A | 第 2 页", False), (2, "文件 B | 第 2 页", False), (3, "日产 1200 | x", False), (4, "日产 1200 | x", False), (5, "文件  A | 第3页", False), (6, "文件 A | 第 4 页", True)]
    chunks = spark.createDataFrame([("d", 1, k, "table_chunk", t, i) for k, t, i in rows], "doc_id string, version_no int, chunk_index int, chunk_type string, chunk_text string, has_images boolean")
    return chunking.drop_repeated_headers(chunks).select("chunk_index")


@expect("chunk_titles", "n, prefix, title", [(0, "【部门:D | 文档:T】\n", "S"), (1, "", "W"), (2, "【部门:D | 文档:T | 章节:S】\n", None)])
def chunk_titles(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(0, "D", "T", None, "x" * 300, "S", "W"), (1, None, None, "", "in W it says", None, "W"), (2, "D", "T", "S", "y" * 300, "", "W")], "n int, dept string, title string, section string, body string, own string, inherited string")
    prefix = chunking.context_prefix(F.col("dept"), F.col("title"), F.col("section"), F.col("body"))
    return rows.select("n", prefix.alias("prefix"), chunking.section_title(F.col("own"), F.col("inherited"), F.col("body")).alias("title"))


@expect("windows_of_text", "n, part", [(0, "aa\n\nbb"), (1, "bb\n\ncc"), (2, "cc"), (3, "dddddddd")])
def windows_of_text(spark: SparkSession) -> DataFrame:
    got = chunking.windows(["aa", "bb", "cc", "dddddddd"], chunking.ChunkConfig(max_chars=9, overlap=2))
    return spark.createDataFrame(list(enumerate(got)), "n int, part string")


@expect("merged_parts", "n, part", [(0, "a\n\nlonger one\n\nb"), (1, "longer two")])
def merged_parts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(chunking.merge_short(["a", "longer one", "b", "longer two"], 5))), "n int, part string")


@expect("split_parts", "n, part", [(0, "一二三四五。"), (1, "。六七八九十。末"), (2, "末")])
def split_parts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(chunking.split_long("一二三四五。六七八九十。末", 8, 2, 1))), "n int, part string")


@expect("self_contained_chunks", "doc_id, prose, dangling, rate", [("a", 3, 1, 0.333333), ("b", 1, 0, 0.0)])
def self_contained_chunks(spark: SparkSession) -> DataFrame:
    rows = [("a", "text_chunk", "其他内容", None), ("a", "text_chunk", "【部门:D】该设备", "标题"), ("a", "clause_chunk", "设备", None), ("a", "table_chunk", "它", None), ("b", "faq_chunk", "问：甲", "")]
    return chunking.self_contained(spark.createDataFrame(rows, "doc_id string, chunk_type string, chunk_text string, section_title string"))


@expect("routing_fit", "mode, docs, fitting", [("faq", 2, 1), ("step", 1, 1)])
def routing_fit(spark: SparkSession) -> DataFrame:
    return chunking.routing_fit(spark.createDataFrame([("faq", "a", "faq_chunk"), ("faq", "b", "text_chunk"), ("step", "c", "text_chunk"), ("step", "c", "step_card")], "mode string, doc_id string, chunk_type string"))


@expect("image_bindings", "chunk_id, refs, factor", [("a", 3, 1.5), ("b", 1, 1.0)])
def image_bindings(spark: SparkSession) -> DataFrame:
    rows = [("a", '[{"image_index": 1}, {"image_index": 1}, {"oss_key": "k"}]'), ("b", '[{"oss_key": "k"}]'), ("c", "[broken"), ("d", "[]"), ("e", None)]
    return chunking.image_binding(spark.createDataFrame(rows, "chunk_id string, image_refs_json string"))


# Retrieval.


@expect("image_ties", "query_id, pk, rank", [(1, "b", 1), (1, "a", 2), (1, "d", 3), (1, "c", 4), (2, "e", 1), (2, "f", 2)])
def image_ties(spark: SparkSession) -> DataFrame:
    rows = [(1, "a", 1, 0.90, False), (1, "b", 2, 0.89, True), (1, "c", 3, 0.50, False), (1, "d", 4, 0.495, True), (2, "e", 1, 0.9, False), (2, "f", 2, 0.5, True)]
    return retrieval.image_tie_break(spark.createDataFrame(rows, "query_id int, pk string, rank int, score double, is_image boolean"), 0.02).select("query_id", "pk", "rank")


@expect("expanded_steps", "query_id, chunk_id, step_no", [(1, "s1", 1), (1, "s2", 2), (1, "s3", 3), (2, "s2", 2), (3, "s2", 2), (3, "s3", 3), (4, "s1", 1), (4, "s2", 2), (4, "s3", 3)])
def expanded_steps(spark: SparkSession) -> DataFrame:
    steps = spark.createDataFrame([(f"s{k}", "p", k, "public", "o") for k in range(1, 5)] + [("s9", "p", 3, "restricted", "o")], "chunk_id string, parent_chunk_id string, step_no int, permission_level string, owner_dept string")
    hits = spark.createDataFrame([(1, "full"), (2, "locate"), (3, "specific"), (4, "general")], "query_id int, intent string").crossJoin(steps.where("chunk_id = 's2'"))
    return retrieval.expand_steps(hits, steps, 3)


@expect("retrieved_contexts", "query_id, pk, position, text", [(1, "a2", 1, "t1\nt2\nt3"), (1, "b1", 2, "u1"), (2, "a1", 1, "t1\nt2")])
def retrieved_contexts(spark: SparkSession) -> DataFrame:
    """Fused, covers demoted, capped by document, stitched with neighbours."""
    arms = spark.createDataFrame([(1, "dense", "a2", 0.9), (1, "dense", "a1", 0.5), (1, "bm25", "a2", 7.0), (1, "bm25", "b1", 6.5), (1, "bm25", "c1", 6.0), (2, "dense", "a1", 0.3)], "query_id int, arm string, pk string, score double")
    chunks = spark.createDataFrame([("a1", "A", 1, "t1"), ("a2", "A", 2, "t2"), ("a3", "A", 3, "t3"), ("b1", "B", 1, "u1"), ("c1", "C", 1, "v1")], "pk string, doc_id string, chunk_index int, text string")
    chunks = chunks.withColumns({"version_no": F.lit(1), "permission_level": F.lit("public"), "owner": F.lit("o"), "section_title": F.when(F.col("pk") != "c1", "s"), "chunk_type": F.lit("text_chunk")})
    return retrieval.retrieve(arms, chunks, {"dense": 0.6, "bm25": 0.4}, 2, 1).select("query_id", "pk", "position", "text")


@expect("enriched_hits", "query_id, pk, position, band, text, siblings, images", [(1, "a2", 1, "high", "t1\nt2", "s1,s2", "i1,i2"), (1, "b1", 3, "low", "u1", "", "j1"), (2, "a1", 1, "low", "t1\nt2", "s1", "i1,i2")])
def enriched_hits(spark: SparkSession) -> DataFrame:
    """The second query has no embedding, so its dense hit on B goes; of the first, the authority has lost the image that moved up to the second place."""
    arms = spark.createDataFrame(
        [(1, "dense", "a2", 0.9), (1, "dense", "b1", 0.5), (1, "dense", "p1", 0.5), (1, "bm25", "a2", 7.0), (1, "bm25", "b1", 6.4), (1, "bm25", "p1", 6.39), (1, "bm25", "a1", 6.0), (2, "dense", "b1", 0.9), (2, "bm25", "a1", 3.0)], "query_id int, arm string, pk string, score double",
    )
    rows = [("a1", "A", 1, "t1", False, 1), ("a2", "A", 2, "t2", False, 2), ("b1", "B", 1, "u1", False, None), ("p1", "P", 1, "w1", True, None)]
    chunks = spark.createDataFrame([(pk, f"c{pk}", doc, n, t, image, step) for pk, doc, n, t, image, step in rows], "pk string, chunk_id string, doc_id string, chunk_index int, text string, is_image boolean, step_no int")
    chunks = chunks.withColumns({
        "version_no": F.lit(1), "permission_level": F.lit("public"), "owner": F.lit("o"), "section_title": F.lit("s"), "chunk_type": F.lit("step_card"), "parent_chunk_id": F.when(F.col("step_no").isNotNull(), "p"), "intent": F.when(F.col("step_no") == 2, "full").otherwise("locate"),
    }).withColumn("chunk_id", F.when(F.col("step_no").isNotNull(), F.concat(F.lit("s"), F.col("step_no").cast("string"))).otherwise(F.col("chunk_id")))
    authority = chunks.where("pk <> 'p1'").select("chunk_id", "permission_level", F.col("owner").alias("owner_dept"), "pk", F.lit(1).alias("is_active"))
    steps = spark.createDataFrame([("s1", "p", 1), ("s2", "p", 2)], "chunk_id string, parent_chunk_id string, step_no int").withColumns({"permission_level": F.lit("public"), "owner_dept": F.lit("o")})
    images = spark.createDataFrame([("A", "i1"), ("A", "i2"), ("B", "j1")], "doc_id string, image_id string")
    embedded = spark.createDataFrame([(1, [1.0]), (2, [0.0])], "query_id int, embedding array<double>")
    out = retrieval.retrieve_and_enrich(arms, chunks, {"dense": 0.6, "bm25": 0.4}, 3, 1, embedded=embedded, eps=0.05, authority=authority, steps=steps, images=images)
    return out.select("query_id", "pk", "position", "band", "text", F.array_join("siblings", ",").alias("siblings"), F.array_join("images", ",").alias("images"))


@expect("named_people", "n, out", [(0, "[NAME] met [NAME]"), (1, "nobody"), (2, None)])
def named_people(spark: SparkSession) -> DataFrame:
    """Names by a function that the caller brings."""
    rows = _texts(spark, ["Ada met Grace", "nobody", None])
    return rows.select("n", redact.redact_names(F.col("text"), lambda texts: texts.map(lambda t: [w for w in t.split() if w.istitle()])).alias("out"))


# Reconciliation, gaps, evaluation.


@expect("absent_objects", "key, chunk_id", [("k2", "c1"), ("k3", "c2")])
def absent_objects(spark: SparkSession) -> DataFrame:
    rows = [("c1", 1, '{"oss_key": "k1", "image_refs": [{"oss_key": "k2"}]}'), ("c2", 1, '{"image_refs": [{"oss_key": "k3"}, {"oss_key": "k2"}]}'), ("c3", 0, '{"oss_key": "k9"}'), ("c4", 1, "{broken"), ("c5", 1, None)]
    return reconcile.object_parity(spark.createDataFrame(rows, "chunk_id string, is_active int, extra_json string"), spark.createDataFrame([("k1",)], "key string"))


@expect("unchanged_grants", "doc_id, unchanged", [("a", True), ("b", False), ("c", False), ("d", False), ("e", False)])
def unchanged_grants(spark: SparkSession) -> DataFrame:
    rows = [("a", None, '["y", "x"]', ["x", "y"]), ("b", "legacy", '["x"]', ["x", "y"]), ("c", "node", '["x"]', ["x"]), ("d", None, "[broken", ["x"]), ("e", None, '["x"]', None)]
    return reconcile.unchanged_grants(spark.createDataFrame(rows, "doc_id string, mode string, want_json string, have array<string>"))


@expect("final_verdicts", "n, ok, health, basis, at_risk", [(0, True, "degraded", "fetch", 0), (1, False, "unknown", "fetch", 1), (2, False, "unknown", "query_only", 1), (3, True, "healthy", "fetch", 0)])
def final_verdicts(spark: SparkSession) -> DataFrame:
    kind, verdict = "pk int, doc_id string, found string", "doc_id string, verdict string"
    cases = [([(1, "a", "invisible")], [("a", "artifact")], True), ([(1, "a", "unclassified")], [("a", "at_risk:x")], True), ([(1, "a", "invisible")], [("a", "artifact")], False), ([], [], True)]
    out = None
    for n, (classified, verdicts, ok) in enumerate(cases):
        one = reconcile.final_verdict(spark.createDataFrame(classified, kind), spark.createDataFrame(verdicts, verdict), 0, ok).select(F.lit(n).alias("n"), "ok", "health", "basis", "at_risk")
        out = one if out is None else out.union(one)
    return out


@expect("leaders", "hash, representative", [("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "e")])
def leaders(spark: SparkSession) -> DataFrame:
    rows = [("a", [1.0, 0.0], 5), ("b", [0.99, 0.05], 1), ("c", [0.0, 1.0], 4), ("d", [0.1, 0.99], 1), ("e", [0.0, 0.0], 1)]
    return gaps.leader_clusters(spark.createDataFrame(rows, "hash string, vector array<double>, weight int"))


@expect("text_leaders", "hash, representative", [("a", "a"), ("b", "a"), ("c", "c")])
def text_leaders(spark: SparkSession) -> DataFrame:
    rows = [("a", "如何重置密码", 5), ("b", "如何重置 密码？", 2), ("c", "年假几天", 1)]
    return gaps.text_leader_clusters(spark.createDataFrame(rows, "hash string, text string, weight int"))


@expect("merged_gaps", "raw, asks, days, kind, members", [("qa", 8, 1, "refusal", 2), ("qc", 2, 4, "no_result", 1)])
def merged_gaps(spark: SparkSession) -> DataFrame:
    open_ = spark.createDataFrame([("a", "qa", 3, 2, "no_result"), ("b", "qb", 5, 1, "refusal"), ("c", "qc", 2, 4, "no_result")], "hash string, raw string, asks int, days int, kind string")
    return gaps.merge_groups(open_, spark.createDataFrame([("a", "a"), ("b", "a")], "hash string, representative string")).drop("group")


@expect("contribution_states", "review, ingest, state", [
    ("rejected", "searchable", "rejected"), ("open", "failed", "pending"), ("accepted", "searchable", "searchable"), ("accepted", "failed", "failed"), ("accepted", "registering", "processing"), ("accepted", "registered", "processing"), ("accepted", None, "accepted"),
])
def contribution_states(spark: SparkSession) -> DataFrame:
    rows = [("rejected", "searchable"), ("open", "failed"), ("accepted", "searchable"), ("accepted", "failed"), ("accepted", "registering"), ("accepted", "registered"), ("accepted", None)]
    return spark.createDataFrame(rows, "review string, ingest string").withColumn("state", status.contribution_state(F.col("review"), F.col("ingest")))


@expect("clustered_interval", "n, mean, low, high", [(3, 2.0, 2.0, 2.0)])
def clustered_interval(spark: SparkSession) -> DataFrame:
    """Clusters of one mean leave no spread, whatever is drawn."""
    rows = [(c, x) for c in range(3) for x in (1.0, 3.0)]
    return evaluation.clustered_bootstrap(spark.createDataFrame(rows, "c int, x double"), "x", "c", 100)


@expect("baseline_verdicts", "metric, value, reference, verdict", [("recall", 0.80, 0.82, "ok"), ("mrr", 0.70, 0.80, "regression"), ("noise", 0.50, 0.40, "note"), ("points", 3.8, 4.0, "ok")])
def baseline_verdicts(spark: SparkSession) -> DataFrame:
    now = spark.createDataFrame([("recall", 0.80), ("mrr", 0.70), ("noise", 0.50), ("points", 3.8), ("new", 1.0)], "metric string, value double")
    base = [("recall", 0.82, True, False, False), ("mrr", 0.80, True, False, False), ("noise", 0.40, False, False, True), ("points", 4.0, True, True, False), ("gone", 1.0, True, False, False)]
    return evaluation.compare_baseline(now, spark.createDataFrame(base, "metric string, value double, higher_is_better boolean, points boolean, advisory boolean"), True)


@expect("other_regime", "metric, value, reference, verdict", [("regime", None, None, "not_comparable")])
def other_regime(spark: SparkSession) -> DataFrame:
    one = spark.createDataFrame([("recall", 0.8)], "metric string, value double")
    return evaluation.compare_baseline(one, one, False)


@expect("budget_reservations", "seq, reason", [(1, "ok"), (2, "doc_cap"), (3, "ok"), (4, "run_cap"), (5, "run_tripped"), (6, "ok"), (7, "day_cap"), (8, "bad_estimate")])
def budget_reservations(spark: SparkSession) -> DataFrame:
    rows = [(1, 1, "a", 1, 3.0), (1, 1, "a", 2, 3.0), (1, 1, "b", 3, 4.0), (1, 1, "c", 4, 4.0), (1, 1, "d", 5, 1.0), (1, 2, "e", 6, 4.0), (1, 2, "f", 7, 4.5), (1, 2, "g", 8, 0.0)]
    return audits.reserve_budget(spark.createDataFrame(rows, "day int, run int, doc string, seq int, estimate double"), 5.0, 10.0, 15.0).select("seq", "reason")


@expect("budget_refunds", "seq, held, run_total, tripped", [(1, 6.0, 6.0, False), (2, 0.0, 6.0, True), (3, 0.0, 6.0, True), (4, 2.0, 2.0, False), (5, 5.0, 7.0, False), (6, 0.0, 5.0, False)])
def budget_refunds(spark: SparkSession) -> DataFrame:
    rows = [(1, 1, 1, "reserve", 6.0), (1, 2, 2, "reserve", 6.0), (1, 3, 3, "refund", 4.0), (1, 4, 1, "refund", 4.0), (1, 5, 2, "reserve", 5.0), (1, 6, 1, "refund", 9.0)]
    return audits.settle_budget(spark.createDataFrame(rows, "run int, seq int, doc int, kind string, amount double"), 10.0).select("seq", "held", "run_total", "tripped")


@expect("document_coverages", "doc_id, coverage", [("a", 1.0), ("b", 0.0), ("c", 1.0), ("d", 0.5)])
def document_coverages(spark: SparkSession) -> DataFrame:
    """Of the last, eight of sixteen 8-grams stand in what is kept; the first's lie across its chunks."""
    kept = spark.createDataFrame([("k", 0, "abcdefghijklmno"), ("k", 1, "pqrstuvw")], "doc_id string, chunk_index int, chunk_text string")
    rows = [("a", "k", 1, "mnopqrst"), ("a", "k", 0, "ghijkl"), ("b", "k", 0, "0123456789"), ("c", "k", 0, "short"), ("d", "k", 0, "abcdefghijklmno"), ("d", "k", 1, "01234567")]
    return audits.document_coverage(spark.createDataFrame(rows, "doc_id string, keep_id string, chunk_index int, chunk_text string"), kept)


# Streams and steps.


@expect("admitted_requests", "actor, ts, admitted", [("a", 0.0, True), ("a", 10.0, True), ("a", 20.0, False), ("a", 60.0, True), ("a", 65.0, False), ("b", 5.0, True)])
def admitted_requests(spark: SparkSession) -> DataFrame:
    return limits.sliding_limit(spark.createDataFrame([("a", 0.0), ("a", 10.0), ("a", 20.0), ("a", 60.0), ("a", 65.0), ("b", 5.0)], "actor string, ts double"), 2)


@expect("owed_comments", "actor, ts, comment_of", [("a", 2.0, "m1"), ("a", 3.0, None), ("a", 900.0, None)])
def owed_comments(spark: SparkSession) -> DataFrame:
    rows = [("a", 1.0, 1, "mark", "m1"), ("a", 2.0, 2, "message", None), ("a", 3.0, 3, "message", None), ("a", 4.0, 4, "mark", "m2"), ("a", 900.0, 5, "message", None)]
    return handoff.handoffs(spark.createDataFrame(rows, "actor string, ts double, seq int, kind string, answer string"))


def _plain(v):
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 9)
    if isinstance(v, list):
        return [_plain(x) for x in v]
    return v


@pytest.mark.parametrize(("case", "columns", "rows"), STATED)
def test_stated(spark, case, columns, rows):
    got = case(spark)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(repr([_plain(v) for v in r]) for r in got.select(*columns).collect()) == sorted(repr([_plain(v) for v in r]) for r in rows)
