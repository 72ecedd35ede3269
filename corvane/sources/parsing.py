"""Parsing files to blocks and tables. A file that can't be parsed is a row with an error, never a failed job."""

from __future__ import annotations

import hashlib
import html.parser
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats by suffix.
FORMATS = {"pdf": "pdf", "docx": "docx", "pptx": "pptx", "xlsx": "xlsx", "html": "html", "htm": "html", "md": "markdown", "markdown": "markdown", "txt": "text", "text": "text"}
BLOCK = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "div", "tr", "table", "ul", "ol", "section", "article", "br"}
HIDDEN, FRAME = {"script", "style", "noscript", "template", "svg"}, {"header", "footer", "nav", "aside"}


def format_of(path: Column) -> Column:
    """The format a path's suffix stands for, or null."""
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.try_element_at(known, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


class _Html(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str]] = []
        self.suppressed: list[str] = []
        self.tables: list[list[list[str]]] = []
        self.title = ""
        self._stack: list[str] = []
        self._text: list[str] = []
        self._kind = ("paragraph", 0)

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        self._text = []
        if not text:
            return
        if "title" in self._stack:
            self.title = self.title or text
        elif FRAME & set(self._stack):
            self.suppressed.append(text)
        elif "table" in self._stack:
            if self.tables and self.tables[-1]:
                self.tables[-1][-1].append(text)
        else:
            self.blocks.append((*self._kind, text))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK | FRAME | {"title"}:
            self._flush()
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        if re.fullmatch("h[1-6]", tag):
            self._kind = ("heading", int(tag[1]))
        elif tag == "li":
            self._kind = ("list_item", 0)
        elif tag in BLOCK:
            self._kind = ("paragraph", 0)
        if tag not in {"br", "img", "hr", "meta", "link", "input"}:
            self._stack.append(tag)

    def handle_endtag(self, tag):
        if tag in BLOCK | FRAME | {"title"}:
            self._flush()
        if tag in self._stack:
            while self._stack and self._stack.pop() != tag:
                pass
        if tag in BLOCK:
            self._kind = ("paragraph", 0)

    def handle_data(self, data):
        if not HIDDEN & set(self._stack):
            self._text.append(data)


def parse_html(text: str) -> tuple[str, list[tuple[str, int, str]], list[list[list[str]]], list[str]]:
    """(title, blocks (kind, level, text), tables, suppressed frame text)."""
    p = _Html()
    p.feed(text)
    p.close()
    p._flush()
    return p.title, p.blocks, [t for t in p.tables if t], p.suppressed


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def parse_docx(data: bytes):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    blocks, tables = [], []
    said = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    for e in body:
        if e.tag == f"{_W}tbl":
            tables.append([[said(c) for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")])
        elif e.tag == f"{_W}p" and said(e):
            style = next((s.get(f"{_W}val", "") for s in e.iter(f"{_W}pStyle")), "")
            level = re.search(r"(?i)heading\s*(\d)", style)
            listed = next(e.iter(f"{_W}numPr"), None) is not None or "list" in style.lower()
            blocks.append(("heading", int(level[1]), said(e)) if level else ("list_item" if listed else "paragraph", 0, said(e)))
    return "", blocks, tables, []


def parse_pptx(data: bytes):
    blocks, tables = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for name in slides:
            root = ElementTree.fromstring(z.read(name))
            for t in root.iter(f"{_A}tbl"):
                tables.append([["".join(x.text or "" for x in c.iter(f"{_A}t")) for c in r.iter(f"{_A}tc")] for r in t.iter(f"{_A}tr")])
            for shape in root.iter(f"{_P}sp"):
                kind = next((p.get("type", "") for p in shape.iter(f"{_P}ph")), "")
                for para in shape.iter(f"{_A}p"):
                    text = "".join(x.text or "" for x in para.iter(f"{_A}t")).strip()
                    if text:
                        blocks.append(("heading", 1, text) if kind in ("title", "ctrTitle") else ("paragraph", 0, text))
    return "", blocks, tables, []


def parse_xlsx(data: bytes):
    blocks, tables = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        titles = [s.get("name", "") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n)[0]))
        for k, name in enumerate(sheets):
            blocks.append(("heading", 1, titles[k] if k < len(titles) else name))
            rows = []
            for r in ElementTree.fromstring(z.read(name)).iter(f"{_S}row"):
                cells = []
                for c in r.iter(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                    cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
                rows.append(cells)
            if rows:
                tables.append(rows)
    return "", blocks, tables, []


def parse_markdown(text: str):
    blocks: list[tuple[str, int, str]] = []
    for line in text.split("\n"):
        s = line.strip()
        if not s:
            continue
        h = re.match(r"^(#{1,6})\s+(.+?)\s*#*$", s)
        i = re.match(r"^(?:[-*+]|\d+[.)])\s+(.+)$", s)
        blocks.append(("heading", len(h[1]), h[2]) if h else ("list_item", 0, i[1]) if i else ("paragraph", 0, s))
    return next((t for k, _, t in blocks if k == "heading"), ""), blocks, [], []


def anchor(page: int, kind: str, order: int, text: str) -> str:
    return f"p{page}:{kind}:{order}:{hashlib.sha1(text.encode()).hexdigest()[:10]}"


def numbered(blocks: list[tuple[str, int, str]]) -> list[tuple[str, int, str, str]]:
    """Blocks with section numbers: explicit numbers win, others count on within their level."""
    at = [0] * 7
    out = []
    for kind, level, text in blocks:
        if kind == "heading":
            said = re.match(r"^(\d+(?:\.\d+)*)[.)\s]", text)
            if said:
                parts = [int(x) for x in said[1].split(".")][:6]
                at = [0, *parts, *[0] * (6 - len(parts))]
            else:
                at[level] += 1
                at[level + 1 :] = [0] * (6 - level)
        out.append((kind, level, text, ".".join(str(x) for x in at[1:] if x)))
    return out


def table_markdown(rows: list[list[str]], stub: bool = False) -> str:
    """A table as Markdown, short rows filled; as a stub only its head and size."""
    if not rows:
        return ""
    width = max(map(len, rows))
    full = [[*r, *[""] * (width - len(r))] for r in rows]
    head = "| " + " | ".join(full[0]) + " |"
    if stub:
        return f"{head} ({len(rows) - 1} rows)"
    return "\n".join([head, "|" + " --- |" * width, *("| " + " | ".join(r) + " |" for r in full[1:])])


_PARSERS = {"html": lambda b: parse_html(b.decode("utf-8", "replace")), "docx": parse_docx, "pptx": parse_pptx, "xlsx": parse_xlsx, "markdown": lambda b: parse_markdown(b.decode("utf-8", "replace")), "text": lambda b: parse_markdown(b.decode("utf-8", "replace"))}
BLOCKS = "path string, format string, title string, blocks array<struct<kind:string,level:int,text:string,section:string,anchor:string>>, tables array<array<array<string>>>, suppressed array<string>, failed boolean, error string"


def parse(files: DataFrame) -> DataFrame:
    """`files` (path, content binary) -> one row a file with its blocks, tables and, if it failed, the error. PDF needs a plug-in and fails without."""
    rows = files.select("path", "content", format_of(F.col("path")).alias("format"))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for path, data, kind in zip(p["path"], p["content"], p["format"]):
                try:
                    if kind not in _PARSERS:
                        raise ValueError(f"no parser for {kind}")
                    title, blocks, tables, hidden = _PARSERS[kind](bytes(data))
                    made = [{"kind": k, "level": n, "text": t, "section": s, "anchor": anchor(1, k, o, t)} for o, (k, n, t, s) in enumerate(numbered(blocks))]
                    out.append((path, kind, title, made, tables, hidden, False, None))
                except Exception as e:  # noqa: BLE001  a bad file is data, not a failure of the job
                    out.append((path, kind, None, [], [], [], True, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "format", "title", "blocks", "tables", "suppressed", "failed", "error"])

    return rows.mapInPandas(work, BLOCKS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def unzipped(archives: DataFrame) -> DataFrame:
    """(archive, path, content) of every member of zip archives (path, content)."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for path, data in zip(p["path"], p["content"]):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    rows += [(path, n, z.read(n)) for n in z.namelist() if not n.endswith("/")]
            yield pd.DataFrame(rows, columns=["archive", "path", "content"])

    return archives.mapInPandas(work, "archive string, path string, content binary")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines): lines that aren't JSON of the schema are kept apart."""
    read = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    text = spark.read.text(path)
    good = read.where("_corrupt_record IS NULL").drop("_corrupt_record")
    bad = text.where(F.try_parse_json("value").isNull()).select(F.col("value").alias("line"))
    return good, bad


def append_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_version(rows: DataFrame, path: str, version: str) -> None:
    """An immutable version; the pointer row names the one in force."""
    rows.write.mode("errorifexists").parquet(f"{path}/version={version}")


def point_to(spark: SparkSession, path: str, version: str) -> None:
    spark.createDataFrame([(version,)], "version string").write.mode("overwrite").parquet(f"{path}/_active")


def read_active(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.parquet(f"{path}/_active").first()["version"]
    return spark.read.parquet(f"{path}/version={version}")
