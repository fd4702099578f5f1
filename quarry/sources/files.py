"""Files as sources: listings, ingest policy, inventory, text extraction from plain formats."""

from __future__ import annotations

import csv
import io
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What the ingest policy looks at.
TEMPORARY_PREFIXES = ("~$", ".~")
JUNK_NAMES = ("thumbs.db", ".ds_store", "desktop.ini")
IGNORED_EXTENSIONS = ("db", "tmp", "lnk", "exe", "dll", "mp4", "avi", "mov", "wmv", "mp3", "wav", "zip", "rar", "7z", "tar", "gz")
LEGACY_EXTENSIONS = ("doc", "xls", "ppt")
EXCLUDED_SEGMENTS = ("/_quarantine/", "/_archive/")
EXCLUDED_PREFIXES = ("raw/_quarantine/", "raw/_archive/", "_quarantine/", "_archive/")
INGESTIBLE_EXTENSIONS = ("pdf", "docx", "xlsx", "pptx", "txt", "md", "csv", "html", "htm", "png", "jpg", "jpeg", "webp", "tif", "tiff", "gif", "bmp")


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """``key, last_modified, length`` of the files under a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("key"), F.col("modificationTime").alias("last_modified"), "length")


def _extension(name: Column) -> Column:
    """What follows the last dot, in lower case; dots that a name begins with separate nothing."""
    return F.lower(F.regexp_extract(name, "^\\.*[^.].*\\.([^.]*)$", 1))


def ingest_decision(key: Column) -> Column:
    """``struct(ok, reason)``: the first rule against the key, or ok. Paths count as they are written, names whatever their case."""
    name = F.element_at(F.split(key, "/"), -1)
    low, ext = F.lower(name), _extension(name)
    apart = F.lit(False)
    for part in EXCLUDED_SEGMENTS:
        apart = apart | F.contains(key, F.lit(part))
    for part in EXCLUDED_PREFIXES:
        apart = apart | F.startswith(key, F.lit(part))
    temporary = F.lit(False)
    for part in TEMPORARY_PREFIXES:
        temporary = temporary | F.startswith(low, F.lit(part))
    reason = (
        F.when(key.isNull() | (key == "") | F.endswith(key, F.lit("/")), "directory").when(apart, "excluded_path").when(temporary, "temp_file").when(low.isin(*JUNK_NAMES), "junk_name")
        .when(ext == "", "no_extension").when(ext.isin(*IGNORED_EXTENSIONS), "ignored_extension").when(ext.isin(*LEGACY_EXTENSIONS), "legacy_extension").when(~ext.isin(*INGESTIBLE_EXTENSIONS), "unknown_extension").otherwise("ok")
    )
    return F.struct((reason == "ok").alias("ok"), reason.alias("reason"))


def raw_key_stem(key: Column) -> Column:
    """The name without its last extension, trimmed."""
    name = F.element_at(F.split(F.coalesce(key, F.lit("")), "/"), -1)
    return F.trim(F.regexp_replace(name, "^(\\.*[^.].*)\\.[^.]*$", "$1"))


def new_objects(listed: DataFrame, registered: DataFrame, key: str = "key") -> DataFrame:
    return listed.join(registered.select(key).distinct(), key, "left_anti")


def stem_twins(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``new(dept, stem)`` with ``action``: skip if the department has the stem, warn if only others do, else ok. Case of departments is ignored."""
    held = existing.where("stem <> ''").groupBy("stem").agg(F.collect_set(F.lower("dept")).alias("__depts"))
    action = F.when(F.col("__depts").isNull(), "ok").when(F.array_contains("__depts", F.lower("dept")), "skip").otherwise("warn")
    return new.join(held, "stem", "left").withColumn("action", action).drop("__depts")


def classify_inventory(objects: DataFrame, registry: DataFrame, now: Column, token_days: int = 7) -> DataFrame:
    """Objects ``(key, doc_id, etag, last_modified, self_serve)`` that no version registers, by class.

    Precedence: expected_reject (the document has that etag already), self_serve_orphan (older than the upload token),
    policy_rejected, else unregistered.
    """
    fresh = objects.join(registry.select("key").distinct(), "key", "left_anti")
    etags = registry.where("etag is not null").select("doc_id", "etag").distinct().withColumn("__seen", F.lit(True))
    age = F.date_diff(F.to_date(now), F.to_date("last_modified"))
    kind = (
        F.when(F.coalesce("__seen", F.lit(False)), "expected_reject").when(F.col("self_serve") & (age > token_days), "self_serve_orphan")
        .when(~ingest_decision(F.col("key"))["ok"], "policy_rejected").otherwise("unregistered")
    )
    return fresh.join(etags, ["doc_id", "etag"], "left").withColumn("age_days", age).withColumn("class", kind).drop("__seen")


class _Text(HTMLParser):
    """Text of a page: scripts and styles skipped, block tags as line breaks."""

    SKIP, BREAK = frozenset(["script", "style"]), frozenset("p div br li tr h1 h2 h3 h4 h5 h6 section article header footer table ul ol".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.skipped = 0

    def handle_starttag(self, tag: str, attrs: object) -> None:
        self.skipped += tag in self.SKIP
        if tag in self.BREAK:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        if tag in self.BREAK:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)


def html_text(page: str | None) -> str:
    """The page's text, lines stripped, more than one blank line folded; a page without text stays as it is."""
    parser = _Text()
    parser.feed(page or "")
    parser.close()
    lines = [x.strip() for x in "".join(parser.parts).split("\n")]
    out: list[str] = []
    for line in lines:
        if line or len(out) < 2 or out[-1] or out[-2]:
            out.append(line)
    return "\n".join(out).strip() or (page or "")


def _html(pages: pd.Series) -> pd.Series:
    return pages.map(html_text)


def html_to_text(page: Column) -> Column:
    """Text of HTML, in Arrow batches."""
    return F.pandas_udf(_html, "string")(page)


def _csv(raw: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            try:
                dialect = csv.Sniffer().sniff(text[:4096], delimiters=",;\t")
            except csv.Error:
                dialect = csv.excel
            rows = [[cell.strip() for cell in row] for row in csv.reader(io.StringIO(text), dialect)]
        except csv.Error:
            return text
        return "\n".join(" | ".join(row) for row in rows if any(row)) or text

    return raw.map(one)


def csv_text(raw: Column) -> Column:
    """Rows of delimited text (comma, semicolon or tab, with quotes) as lines with cells joined by `` | ``, in Arrow batches; blank rows go, what can't be read stays as it is."""
    return F.pandas_udf(_csv, "string")(raw)


def decode_text(raw: Column, encodings: tuple[str, ...] = ("utf-8-sig", "gb18030")) -> Column:
    """Bytes as text in the first encoding that fits; in none, as UTF-8 with marks for what can't be read."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            if b is None:
                return None
            for name in encodings:
                try:
                    return bytes(b).decode(name)
                except UnicodeDecodeError:
                    continue
            return bytes(b).decode("utf-8", "replace")

        return values.map(one)

    return read(raw)


def markdown_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, block_no, block_type, text, level``: headings, tables (lines with two bars or more) and paragraphs of plain text.

    Lines of one kind that follow each other form a block; a blank line ends a paragraph, a heading is a block of its own.
    """
    from pyspark.sql import Window

    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("n", "line"))
    cn = "^(第[一二三四五六七八九十\\d]+[章节条款部分]|[一二三四五六七八九十]+[、.]|（[一二三四五六七八九十\\d]+）)"
    kind = F.when(F.trim("line") == "", "blank").when(F.col("line").rlike("^#{1,6}\\s+\\S"), "heading").when(F.col("line").rlike(cn) & (F.char_length("line") <= 60), "heading").when(F.regexp_count("line", F.lit("\\|")) >= 2, "table").otherwise("paragraph")
    level = F.when(F.col("line").rlike("^#"), F.char_length(F.regexp_extract("line", "^#+", 0))).when(F.col("line").rlike("^第"), 1).otherwise(2)
    w = Window.partitionBy("doc_id").orderBy("n")
    typed = lines.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", level))
    begins = (F.col("kind") == "heading") | F.lag("kind").over(w).isNull() | (F.col("kind") != F.lag("kind").over(w))
    blocks = typed.withColumn("block_no", F.sum(begins.cast("int")).over(w)).where("kind <> 'blank'")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    return blocks.groupBy("doc_id", "block_no").agg(F.first("kind").alias("block_type"), joined.alias("text"), F.max("level").alias("level"))
