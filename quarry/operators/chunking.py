"""Chunking: sections, tables, paragraphs, windows, and the modes for questions, clauses, steps and slides.

Filling windows is sequential within a document, so the whole-document chunkers run as Arrow batches; sections,
tables and paragraphs alone also have a set-based form.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What begins a section, a step, a clause, a question and an answer.
SECTION = r"^(?:#{1,4}\s+.+|第[一二三四五六七八九十\d]+[章节条款部分].+|[一二三四五六七八九十]+[、\.].+|（[一二三四五六七八九十\d]+）.+|\d+[\.\、]\s*.+)$"
STEP = (
    r"^[ \t　]*(?:步骤\s*([一二三四五六七八九十\d]+)|[Ss][Tt][Ee][Pp]\s*(\d+)|第\s*([一二三四五六七八九十\d]+)\s*步|(\d+)\s*[\.．、]\s*(?!\d)|(\d+)\s*[)）]|(\d+\.\d+)(?=\s+\S)|(\d+\.\d+(?:\.\d+)+)\s*(?=[一-鿿A-Za-z0-9]))"
    r"\s*[:：.、]?\s*(.*)$"
)
TABLE_OF_STEPS = r"^[\s•·●\-\*\#　]*第\s*([一二三四五六七八九十\d]+)\s*步\s*[:：]\s*(.+?)\s*(?:[„\.…]+|$)"
COMMON_VERBS = ("安装", "操作", "处理", "使用", "设置", "配置", "执行", "完成", "准备", "检查", "进行", "开始")
SECTION_HEADS = frozenset(
    "目的 范围 适用范围 适用 目的和范围 目的与适用范围 目的及适用范围 职责 权责 职责权限 范围和职责 职责和权限 定义 术语 定义和术语 术语和定义 术语及定义 参考文件 参考资料 引用文件 引用标准 规范性引用文件 "
    "相关文件 相关记录 概述 前言 引言 总则 修订记录 修改记录 变更记录 版本记录 附录 附则 流程图".split()
)
PAGE_MARK = r"(?i)页次|页码|页数|第\s*\d+\s*页|共\s*\d+\s*[页张]|Page\s*\d+"
# Words that open the sections of a product specification, the sections, and the kinds of their chunks.
SPEC_SECTIONS = [
    (("物料基本信息", "物料名称", "品牌名称"), "product_info", "text_chunk"), (("原材料信息", "原辅材料"), "raw_material", "table_chunk"), (("生产工艺流程", "工艺流程图", "关键工序", "关键控制点"), "process_ccp", "table_chunk"),
    (("技术标准要求", "技术标准"), "tech_standard_header", "text_chunk"), (("包装规格", "外包装类型"), "packaging", "text_chunk"),
    (("物料图片", "产品正反面图片", "产品装箱", "单条产品图片", "单个实物图片", "标签信息照片", "外箱图片", "包装方式体现"), "product_photo", "image"), (("附件信息", "文件修订", "会签确认"), "appendix", "text_chunk"),
    (("感官要求",), "spec_sensory", "table_chunk"), (("物理指标", "尺寸指标"), "spec_dimension", "table_chunk"), (("微生物指标",), "spec_safety", "table_chunk"), (("理化指标",), "spec_safety", "table_chunk"),
    (("其他指标", "内控要求", "使用性能"), "spec_performance", "table_chunk"),
]
CLAUSE = r"^\s*(\d{1,2}(?:\.\d{1,2})*)[、.\s](?!\d|[a-zA-Z%℃]{1,3}\b)\s*\S"
QUESTION, ANSWER = r"^\s*(?:Q\d*|问|问题)\s*[:：.]\s*(.+)$", r"^\s*(?:A\d*|答|答案)\s*[:：.]\s*(.*)$"
_SECTION, _STEP, _CLAUSE, _QUESTION, _ANSWER, _TABLE_OF_STEPS = (re.compile(p, re.M) for p in (SECTION, STEP, CLAUSE, QUESTION, ANSWER, TABLE_OF_STEPS))
_NUMERALS = "一二三四五六七八九十"
_BREAKS = ("。\n", "。", "；", "\n", "，")


@dataclass(frozen=True)
class ChunkConfig:
    max_chars: int = 800
    min_chars: int = 50
    overlap: int = 100
    merge_below: int = 150
    child_chars: int = 150
    child_overlap: int = 40
    parent_child: bool = False


def sections(text: str) -> list[tuple[str, str]]:
    """``(title, body)``: what stands before the first heading has no title; headings without a body are left out."""
    found = list(_SECTION.finditer(text))
    if not found:
        return [("", text)]
    ends = [m.start() for m in found[1:]] + [len(text)]
    out = [("", text[: found[0].start()].strip())] + [(m[0].strip().lstrip("#").strip(), text[m.end() : e].strip()) for m, e in zip(found, ends, strict=True)]
    return [(t, b) for t, b in out if b] or [("", text)]


def tables_apart(text: str) -> tuple[list[str], list[str]]:
    """Runs of lines with two bars or more, and the runs between them."""
    runs: list[tuple[bool, list[str]]] = []
    for line in text.split("\n"):
        is_table = line.count("|") >= 2
        if not runs or runs[-1][0] != is_table:
            runs.append((is_table, []))
        runs[-1][1].append(line)
    return ["\n".join(x) for t, x in runs if t], ["\n".join(x) for t, x in runs if not t]


def paragraphs(text: str) -> list[str]:
    return [p for x in re.split(r"\n\s*\n", text) if (p := x.strip())]


def windows(parts: list[str], config: ChunkConfig) -> list[str]:
    """Paragraphs filled greedily up to the limit (a break costs two); the next window backs up over whole paragraphs within the overlap and always advances."""
    out, i = [], 0
    while i < len(parts):
        j, used = i, 0
        while j < len(parts) and (used == 0 or used + 2 + len(parts[j]) <= config.max_chars):
            used += len(parts[j]) + (2 if j > i else 0)
            j += 1
        out.append("\n\n".join(parts[i:j]))
        if j >= len(parts):
            break
        back, kept = 0, 0
        while j - back - 1 >= i and kept + len(parts[j - back - 1]) + (2 if back else 0) <= config.overlap:
            kept += len(parts[j - back - 1]) + (2 if back else 0)
            back += 1
        i += max(1, j - i - back)
    return out


def merge_short(parts: list[str], least: int) -> list[str]:
    """Parts under ``least`` characters join the one before, the leading ones the one after."""
    if len(parts) <= 1:
        return parts
    out: list[str] = []
    carry = ""
    for k, p in enumerate(parts):
        p = f"{carry}\n\n{p.strip()}" if carry else p
        carry = ""
        if len(p.strip()) >= least:
            out.append(p)
        elif out:
            out[-1] = f"{out[-1].strip()}\n\n{p.strip()}"
        elif k + 1 < len(parts):
            carry = p.strip()
        else:
            out.append(p)
    return out


def split_long(text: str, limit: int, least: int, overlap: int) -> list[str]:
    """Windows of ``limit`` characters, each cut after the last break of the best kind beyond ``least``; they overlap unless that would not advance."""
    if len(text) <= limit:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = start + limit
        if end < len(text):
            for mark in _BREAKS:
                at = text.rfind(mark, start, end)
                if at > start + least:
                    end = at + len(mark)
                    break
        out.append(text[start:end])
        start = end - overlap if end - overlap > start else end
    return out


def document_chunks(text: str, config: ChunkConfig = ChunkConfig()) -> list[tuple[str, str, str]]:
    """``(type, title, text)`` in order; of each section first its texts, then its tables."""
    out = []
    for title, body in sections(text):
        tables, texts = tables_apart(body)
        for block in texts:
            for part in merge_short(windows(paragraphs(block), config), config.merge_below):
                part = part.strip()
                if len(part) >= config.min_chars:
                    out += [("text_chunk", title, x.strip()) for x in split_long(part, config.max_chars, config.min_chars, config.overlap)]
        out += [("table_chunk", title, t.strip()) for t in tables]
    if not config.parent_child:
        return out
    both = []
    for kind, title, body in out:
        both.append((kind, title, body))
        if len(body) > config.child_chars:
            both += [("child_chunk", title, x) for x in split_long(body, config.child_chars, 1, config.child_overlap)]
    return both


def faq_chunks(text: str) -> list[tuple[str, str, str]]:
    """Questions with their answers as faq_chunk; what stands before the first is text_chunk."""
    out: list[list] = []
    for line in text.split("\n"):
        if m := _QUESTION.match(line):
            out.append(["faq_chunk", m[1].strip(), [line.strip()]])
        elif line.strip():
            if not out:
                out.append(["text_chunk", "", []])
            out[-1][2].append(line.strip())
    return [(k, t, "\n".join(x)) for k, t, x in out]


def clause_chunks(text: str, config: ChunkConfig = ChunkConfig()) -> list[tuple[str, str, str]]:
    """One clause_chunk per numbered clause; decimals and numbers with units begin none."""
    found = list(_CLAUSE.finditer(text))
    if not found:
        return document_chunks(text, config)
    out = [("text_chunk", "", head)] if (head := text[: found[0].start()].strip()) else []
    ends = [m.start() for m in found[1:]] + [len(text)]
    for m, end in zip(found, ends, strict=True):
        out += [("clause_chunk", m[1], x.strip()) for x in split_long(text[m.start() : end].strip(), config.max_chars, config.min_chars, config.overlap)]
    return out


def step_number(shown: str) -> str:
    """A step's number as digits: Chinese numerals up to ten become Arabic ones."""
    return str(_NUMERALS.index(shown) + 1) if shown in list(_NUMERALS) else shown


def declared_steps(lines: list[str]) -> dict[int, list[str]]:
    """By number, the words that tell a step which a table of contents declares; none if it lists less than two.

    Entries begin with a bullet or end in leaders, which steps don't.
    """
    out: dict[int, list[str]] = {}
    for line in lines:
        m = _TABLE_OF_STEPS.match(line)
        if not m or not (line.lstrip()[:1] in "•·●-*#" or line.rstrip()[-1:] in "„.…0123456789" and re.search("[„.…]{2}", line)):
            continue
        number = step_number(m[1])
        words = []
        for part in re.split(r"[\s　，,。.、（）()【】「」]+", m[2]):
            bare = re.sub("[^一-鿿]", "", part)
            verb = next((v for v in COMMON_VERBS if bare.startswith(v) and len(bare) > len(v)), "")
            if len(bare) - len(verb) >= 2:
                words.append(bare[len(verb) :])
        if number.isdigit() and words:
            out.setdefault(int(number), words)
    return out if len(out) > 1 else {}


def step_chunks(text: str, config: ChunkConfig = ChunkConfig()) -> list[tuple[str, str, str]]:
    """A procedure_parent that lists the steps' titles within a budget of tokens, then a step_card per step; text before the first is text_chunk.

    Numbered headings that only give a document its structure begin no step. A line that names what the table of
    contents declares as the next step begins it, even without a number.
    """
    head, cards = [], []
    lines = text.split("\n")
    declared = declared_steps(lines)
    for line in lines:
        listed = declared and _TABLE_OF_STEPS.match(line) and line.lstrip()[:1] in "•·●-*#„"
        m = None if listed else _STEP.match(line)
        if m and m[8].strip() in SECTION_HEADS:
            m = None
        if m:
            number = step_number(next(g for g in m.groups()[:7] if g))
            cards.append((number, m[8].strip(), [line.strip()]))
            continue
        if not line.strip():
            continue
        following = int(cards[-1][0]) + 1 if cards and cards[-1][0].isdigit() else None
        if not listed and following in declared and any(w in line for w in declared[following]):
            cards.append((str(following), line.strip(), [line.strip()]))
        else:
            (cards[-1][2] if cards else head).append(line.strip())
    out = [("text_chunk", "", "\n".join(head))] if head else []
    if cards:
        titles, used = [], 0
        for number, title, _ in cards:
            used += len(title) + len(number) + 2
            if used > config.max_chars:
                break
            titles.append(f"{number}. {title}")
        out.append(("procedure_parent", "", "\n".join(titles)))
        out += [("step_card", number, "\n".join(x)) for number, _, x in cards]
    return out


Block = tuple[str, str, int | None]


def block_chunks(blocks: list[Block], mode: str = "default", config: ChunkConfig = ChunkConfig()) -> list[tuple[str, str, str]]:
    """Chunks of ``(type, text, page)`` blocks by the mode: faq, clause and step read their texts, slide goes by page, product_spec by section, default by heading.

    In the default mode a table stays whole and a heading names what follows it.
    """
    if mode in ("faq", "clause", "step"):
        return MODES[mode]("\n".join(t for _, t, _ in blocks if t.strip()), config)
    if mode == "slide":
        pages: dict[int, list[Block]] = {}
        for b in blocks:
            pages.setdefault(b[2] or 0, []).append(b)
        return [("table_chunk" if any(k == "table" for k, *_ in x) else "text_chunk", str(page), part) for page, x in pages.items() for part in split_long("\n".join(t for _, t, _ in x), config.max_chars, config.min_chars, config.overlap)]
    if mode == "product_spec":
        return spec_chunks([t.strip() for k, t, _ in blocks if k == "paragraph" and t.strip()])
    if mode != "default":
        raise ValueError(f"no such mode: {mode}")
    out, title, texts = [], "", []

    def close() -> None:
        for part in merge_short(windows(texts, config), config.merge_below):
            if len(part.strip()) >= config.min_chars:
                out.extend(("text_chunk", title, x.strip()) for x in split_long(part.strip(), config.max_chars, config.min_chars, config.overlap))
        texts.clear()

    for kind, text, _ in blocks:
        if kind == "heading":
            close()
            title = text.strip().lstrip("#").strip()
        elif kind == "table":
            close()
            out.append(("table_chunk", title, text.strip()))
        elif text.strip():
            texts.append(text.strip())
    close()
    return out


def spec_chunks(lines: list[str], least: int = 10) -> list[tuple[str, str, str]]:
    """A chunk per section of a product specification; a line that names a section begins it, neighbours of one section are one, those under ten characters go."""
    out: list[list] = []
    for line in lines:
        found = next(((name, kind) for words, name, kind in SPEC_SECTIONS if any(w in line for w in words)), None)
        name, kind = found or (out[-1][1:3] if out else ("header", "text_chunk"))
        if out and out[-1][1] == name:
            out[-1][0].append(line)
        else:
            out.append([[line], name, kind])
    return [(kind, name, body) for texts, name, kind in out if len(body := "\n".join(texts)) >= least]


def chunk_blocks(blocks: DataFrame, mode: str = "default", config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of ``blocks(doc_id, version_no, block_no, block_type, text, page_num)``: prose tables are flattened, then the mode's rules apply within a document's version, whose blocks one Arrow group holds."""
    from quarry.functions.text import flatten_prose_table, is_prose_table

    prose = (F.col("block_type") == "table") & is_prose_table(F.col("text"))
    flat = blocks.withColumn("text", F.when(prose, flatten_prose_table(F.col("text"))).otherwise(F.coalesce("text", F.lit("")))).withColumn("block_type", F.when(prose, "paragraph").otherwise(F.col("block_type")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block_no")
        found = block_chunks([(k, t, None if pd.isna(p) else int(p)) for k, t, p in zip(pdf["block_type"], pdf["text"], pdf["page_num"], strict=True)], mode, config)
        rows = [(key[0], key[1], n, chunk_name(key[0], key[1], n), kind, title or None, body) for n, (kind, title, body) in enumerate(found)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    typed = flat.select(F.col("doc_id").cast("string"), F.col("version_no").cast("int"), "block_no", "block_type", "text", F.col("page_num").cast("double"))
    return typed.groupBy("doc_id", "version_no").applyInPandas(run, CHUNK_SCHEMA)


def drop_repeated_headers(chunks: DataFrame) -> DataFrame:
    """Without table chunks that repeat an earlier one of their version but for the page: of at most four lines, with a page mark, without images (``has_images``)."""
    lines = F.filter(F.split("chunk_text", "\n"), lambda x: F.trim(x) != "")
    body = F.array_join(lines, "\n")
    header = (F.col("chunk_type") == "table_chunk") & ~F.col("has_images") & (F.size(lines) <= 4) & body.rlike(PAGE_MARK)
    shown = F.when(header, F.regexp_replace(F.regexp_replace(body, PAGE_MARK, "<PG>"), "(?U)\\s+", "")).otherwise(F.concat(F.lit("\x01"), F.col("chunk_index").cast("string")))
    first = F.row_number().over(Window.partitionBy("doc_id", "version_no", "__shown").orderBy("chunk_index"))
    return chunks.withColumn("__shown", shown).withColumn("__n", first).where("__n = 1").drop("__shown", "__n")


MODES = {"default": document_chunks, "faq": lambda t, c: faq_chunks(t), "clause": clause_chunks, "step": step_chunks}
CHUNK_SCHEMA = "doc_id string, version_no int, chunk_index int, chunk_id string, chunk_type string, section_title string, chunk_text string"


def chunk_name(doc_id: str, version: int, index: int) -> str:
    raw = f"{doc_id}_v{version}_c{index:04d}"
    return f"{raw}_{hashlib.sha256(raw.encode()).hexdigest()[:8].upper()}"


def chunk_documents(docs: DataFrame, mode: str = "default", config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunks of ``docs(doc_id, version_no, text)``; null texts have none."""
    cut = MODES[mode]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, version, text in zip(pdf["doc_id"], pdf["version_no"], pdf["text"], strict=True):
                for k, (kind, title, body) in enumerate(cut(text, config) if text else []):
                    rows.append((doc, version, k, chunk_name(doc, version, k), kind, title or None, body))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("string"), F.col("version_no").cast("int"), "text").mapInPandas(run, CHUNK_SCHEMA)


def slide_chunks(blocks: DataFrame) -> DataFrame:
    """``doc_id, page, chunk_type, text``: a document's blocks by page (null is 0), a table chunk if any block is a table."""
    page = F.coalesce("page_num", F.lit(0))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n")
    return blocks.groupBy("doc_id", page.alias("page")).agg(F.when(F.bool_or(F.col("block_type") == "table"), "table_chunk").otherwise("text_chunk").alias("chunk_type"), joined.alias("text"))


def chunk_links(chunks: DataFrame) -> DataFrame:
    """``prev_chunk_id`` and ``next_chunk_id`` within a document's version."""
    w = Window.partitionBy("doc_id", "version_no").orderBy("chunk_index")
    return chunks.withColumn("prev_chunk_id", F.lag("chunk_id").over(w)).withColumn("next_chunk_id", F.lead("chunk_id").over(w))


def line_sections(docs: DataFrame) -> DataFrame:
    """``doc_id, section_no, lines``: lines counted by section, in set-based form."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    w = Window.partitionBy("doc_id").orderBy("n")
    numbered = lines.withColumn("section_no", F.sum(F.col("line").rlike("^#{1,4} .+$").cast("int")).over(w))
    return numbered.groupBy("doc_id", "section_no").agg(F.count("*").alias("lines"))


def table_islands(docs: DataFrame) -> DataFrame:
    """``doc_id, island, is_table, lines``: runs of table lines and of others, by the difference of two row numbers."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("is_table", F.regexp_count("line", F.lit("\\|")) >= 2)
    all_, own = Window.partitionBy("doc_id").orderBy("n"), Window.partitionBy("doc_id", "is_table").orderBy("n")
    marked = lines.withColumn("island", F.row_number().over(all_) - F.row_number().over(own))
    return marked.groupBy("doc_id", "is_table", "island").agg(F.count("*").alias("lines"))


def context_prefix(dept: Column, title: Column, section: Column, body: Column) -> Column:
    """``【部门:… | 文档:… | 章节:…】`` and a line break; title and section cut at 40 and 60, the whole at 30 % of the body within 20 and 100."""
    cut = lambda c, n: F.when(F.char_length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name), c))
    inner = F.array_join(F.array_compact(F.array(part("部门:", dept), part("文档:", cut(title, 40)), part("章节:", cut(section, 60)))), " | ")
    limit = F.least(F.lit(100), F.greatest(F.lit(20), F.floor(F.char_length(body) * 0.3)))
    whole = F.concat(F.lit("【"), inner, F.lit("】"))
    return F.when(inner == "", "").when(F.char_length(whole) > limit, F.concat(F.substr(whole, F.lit(1), limit - 1), F.lit("】\n"))).otherwise(F.concat(whole, F.lit("\n")))


def section_title(own: Column, inherited: Column, body: Column) -> Column:
    """The chunk's own heading, else the inherited one if the body bears it out, else null."""
    return F.when(F.coalesce(own, F.lit("")) != "", own).when(F.coalesce(F.contains(body, inherited), F.lit(False)) & (inherited != ""), inherited)


def validate_chunks(chunks: DataFrame, least: int = 5, most: int = 2000) -> DataFrame:
    """``reject_reason``: empty, too_short, too_long, no_metadata, or null."""
    n = F.char_length(F.trim(F.coalesce("chunk_text", F.lit(""))))
    return chunks.withColumn("reject_reason", F.when(n == 0, "empty").when(n < least, "too_short").when(n > most, "too_long").when(F.col("doc_id").isNull() | F.col("chunk_id").isNull(), "no_metadata"))


# Chunk kinds that are prose, and words that lean on what stands before.
PROSE_KINDS = ("text_chunk", "clause_chunk", "faq_chunk", "section_chunk")
LEANING = ("它", "他", "她", "该", "此", "其", "这", "那", "上述", "前述", "如前", "如上", "见上", "见下", "见图", "如图", "综上", "因此", "所以", "于是", "据此", "为此", "由此")
#: What chunk kinds a routing mode should give.
EXPECTED_KINDS = {"faq": ("faq_chunk",), "clause": ("clause_chunk",), "step": ("step_card", "procedure_parent"), "slide": ("text_chunk", "table_chunk")}


def self_contained(chunks: DataFrame) -> DataFrame:
    """``doc_id, prose, dangling, rate``: prose chunks of a document, and those that open with a word that leans on what came before and have no section title."""
    body = F.ltrim(F.regexp_replace(F.ltrim(F.coalesce("chunk_text", F.lit(""))), "^【[^】]*】", ""))
    dangling = body.rlike("^(?:" + "|".join(LEANING) + ")") & (F.trim(F.coalesce("section_title", F.lit(""))) == "")
    per = chunks.where(F.col("chunk_type").isin(*PROSE_KINDS)).groupBy("doc_id").agg(F.count("*").alias("prose"), F.count_if(dangling).alias("dangling"))
    return per.withColumn("rate", F.round(F.col("dangling") / F.col("prose"), 6))


def routing_fit(chunks: DataFrame) -> DataFrame:
    """``mode, docs, fitting``: documents by the mode they were routed to, and those with a chunk of a kind that the mode gives."""
    fits = F.lit(False)
    for mode, kinds in EXPECTED_KINDS.items():
        fits = fits | (F.col("mode") == mode) & F.col("chunk_type").isin(*kinds)
    per = chunks.groupBy("mode", "doc_id").agg(F.bool_or(F.coalesce(fits, F.lit(False))).alias("fits"))
    return per.groupBy("mode").agg(F.count("*").alias("docs"), F.count_if("fits").alias("fitting"))


def image_binding(chunks: DataFrame) -> DataFrame:
    """``chunk_id, refs, factor``: image references of a chunk, and how many there are of each image on average (by index, else by key); broken JSON counts as none."""
    parsed = F.from_json("image_refs_json", "array<struct<image_index: string, oss_key: string>>")
    named = F.transform(parsed, lambda r: F.coalesce(r["image_index"], r["oss_key"]))
    distinct = F.size(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))
    return chunks.where(F.size(parsed) > 0).select("chunk_id", F.size(parsed).alias("refs"), F.round(F.try_divide(F.size(parsed), distinct), 4).alias("factor"))


def reconcile_ids(expected: DataFrame, found: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``key, state``: ids that only one side has: lost or unexpected."""
    lost = expected.select(key).distinct().join(found.select(key), key, "left_anti").withColumn("state", F.lit("lost"))
    return lost.union(found.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("state", F.lit("unexpected")))


def quality_flags(chunks: DataFrame) -> DataFrame:
    """Per chunk: ends within a sentence, opens with a reference, is a bare heading, has an odd size."""
    text = F.trim(F.coalesce("chunk_text", F.lit("")))
    return chunks.withColumns({
        "mid_sentence": ~text.rlike("[。！？.!?；;:：)）\"”|]$"), "dangling": text.rlike("^(其|该|此|上述|以上|如下|it |this |these |those )"),
        "orphan_heading": text.rlike("^#{1,6} [^\\n]+$"), "odd_size": ~F.char_length(text).between(5, 2000),
    })
