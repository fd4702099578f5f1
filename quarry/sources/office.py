"""Office documents as text blocks, read from their XML parts with the standard library.

PDF needs a parser that isn't part of this environment; ``read_pdf`` uses one if it can be imported.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
SCHEMA = "path string, block_no int, block_type string, text string, page_num int, level int"


def docx_blocks(data: bytes) -> list[tuple[str, str, int | None, int | None]]:
    """Headings by style, paragraphs, text boxes before the paragraph that anchors them, tables as lines of cells joined by `` | ``."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out: list[tuple[str, str, int | None, int | None]] = []

    def parts(e: ElementTree.Element, boxes: list[ElementTree.Element]) -> Iterator[str]:
        for c in e:
            if c.tag == f"{_W}txbxContent":
                boxes.append(c)
            elif not c.tag.endswith("}Fallback"):  # the same once more, for old readers
                if c.tag == f"{_W}t":
                    yield c.text or ""
                yield from parts(c, boxes)

    def words(e: ElementTree.Element) -> str:
        return "".join(parts(e, []))

    def boxed(e: ElementTree.Element) -> list[str]:
        boxes: list[ElementTree.Element] = []
        list(parts(e, boxes))
        return [x.strip() for b in boxes for p in b.iter(f"{_W}p") if (x := words(p)).strip()]

    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            out += [("paragraph", x, None, None) for x in boxed(e)]
        if e.tag == f"{_W}p" and words(e).strip():
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "") if style is not None else ""
            level = int(name[-1]) if name.lower().startswith("heading") and name[-1:].isdigit() else None
            out.append(("heading" if level else "paragraph", words(e).strip(), None, level))
        elif e.tag == f"{_W}tbl":
            rows = [" | ".join(words(c).strip() for c in r.iter(f"{_W}tc")) for r in e.iter(f"{_W}tr")]
            out.append(("table", "\n".join(rows), None, None))
    return out


def xlsx_blocks(data: bytes) -> list[tuple[str, str, int | None, int | None]]:
    """One table per sheet."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        out = []
        for page, name in enumerate(sorted(n for n in names if n.startswith("xl/worksheets/sheet")), 1):
            rows = []
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    value = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if value is None else value.text or ""
                    cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
                if any(x.strip() for x in cells):
                    rows.append(" | ".join(cells))
            if rows:
                out.append(("table", "\n".join(rows), page, None))
        return out


def pptx_blocks(data: bytes) -> list[tuple[str, str, int | None, int | None]]:
    """One paragraph per slide, in the order of the slides."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if n.startswith("ppt/slides/slide")), key=lambda n: int("".join(c for c in n if c.isdigit()) or 0))
        texts = ["\n".join(x for p in ElementTree.fromstring(z.read(n)).iter(f"{_A}p") if (x := "".join(t.text or "" for t in p.iter(f"{_A}t")).strip())) for n in slides]
    return [("paragraph", t, k, None) for k, t in enumerate(texts, 1) if t]


def pdf_blocks(data: bytes) -> list[tuple[str, str, int | None, int | None]]:
    """A paragraph per page."""
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise RuntimeError("reading PDF needs pypdf") from error
    return [("paragraph", (p.extract_text() or "").strip(), k, None) for k, p in enumerate(PdfReader(io.BytesIO(data)).pages, 1)]


READERS = {"docx": docx_blocks, "xlsx": xlsx_blocks, "pptx": pptx_blocks, "pdf": pdf_blocks}


def read_blocks(files: DataFrame) -> DataFrame:
    """Blocks of ``files(path, content)`` by their extension; a file that can't be read gives one block of type error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                reader = READERS.get(path.rpartition(".")[2].lower())
                try:
                    blocks = reader(bytes(content)) if reader else []
                except Exception as error:  # a broken file must not end the job
                    blocks = [("error", str(error), None, None)]
                rows += [(path, k, *b) for k, b in enumerate(blocks)]
            yield pd.DataFrame(rows, columns=["path", "block_no", "block_type", "text", "page_num", "level"]).astype({"page_num": "Int64", "level": "Int64"})

    return files.select("path", "content").mapInPandas(run, SCHEMA)


#: Words by which a workbook's layout is told: layout, words in its file and sheet names or cells.
LAYOUTS = {"faq": ("问题", "答案", "faq", "question", "answer"), "spec": ("规格", "型号", "参数", "spec", "model"), "steps": ("步骤", "操作", "step", "procedure")}


def workbook_layout(name: str, sheets: list[str], text: str) -> str:
    """The layout with most word hits (a hit in a name counts thrice), or table."""
    names = (name + " " + " ".join(sheets)).lower()
    scored = {k: sum(3 * (w in names) + (w in text.lower()) for w in words) for k, words in LAYOUTS.items()}
    best = max(scored, key=lambda k: (scored[k], -list(LAYOUTS).index(k)))
    return best if scored[best] >= 2 else "table"
