"""Documents and archives as rows: text and tables of each leaf file.

Files come from ``binaryFile``; parsing runs in batches on the executors. Containers are opened
recursively with a limit on depth and on unpacked size, and paths that lead out of them are
refused. What can't be read gives a row with a reason instead of an exception.
"""

from __future__ import annotations

import html
import io
import posixpath
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.sources.pdf import read_pdf

# --- fixed values -----------------------------------------------------------------------------
CONTAINERS = (".zip", ".edoc", ".7z")
TEXTS = (".txt", ".csv")
DEPTH = 5
MOST_BYTES = 1 << 30
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# ----------------------------------------------------------------------------------------------

READ_SCHEMA = "path string, chain string, text string, tables array<array<array<string>>>, reader string, reason string, seconds double"


def extension(name: str) -> str:
    return posixpath.splitext(name.lower())[1]


def leaves(name: str, content: bytes, depth: int = 0, budget: list[int] | None = None) -> Iterator[tuple[str, bytes, str | None]]:
    """``(chain, bytes, reason)`` of all files inside a container; the file itself if it is none.

    Broken containers and those nested deeper than DEPTH come out raw, with a reason.
    """
    budget = budget if budget is not None else [MOST_BYTES]
    ext = extension(name)
    if ext not in CONTAINERS:
        yield name, content, None
        return
    if depth >= DEPTH:
        yield name, content, "nested too deeply"
        return
    if ext == ".7z":
        yield from _seven(name, content, depth, budget)
        return
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                inner = info.filename.replace("\\", "/")
                if info.is_dir() or ext == ".edoc" and (inner.lower() == "mimetype" or inner.lower().startswith("meta-inf/")):
                    continue
                if inner.startswith("/") or ".." in inner.split("/"):
                    yield f"{name}/{posixpath.basename(inner)}", b"", "path leads out of the container"
                    continue
                budget[0] -= info.file_size
                if budget[0] < 0:
                    yield f"{name}/{inner}", b"", "unpacked size over the limit"
                    return
                try:
                    data = z.read(info)
                except (RuntimeError, NotImplementedError, zipfile.BadZipFile, OSError) as e:
                    yield f"{name}/{inner}", b"", f"unreadable member: {type(e).__name__}"
                    continue
                for chain, leaf, reason in leaves(inner, data, depth + 1, budget):
                    yield f"{name}/{chain}", leaf, reason
    except (zipfile.BadZipFile, OSError, ValueError):
        yield name, content, "broken container"


def _seven(name: str, content: bytes, depth: int, budget: list[int]) -> Iterator[tuple[str, bytes, str | None]]:
    try:
        import py7zr
    except ImportError:
        yield name, content, "no reader for 7z installed"
        return
    try:
        with py7zr.SevenZipFile(io.BytesIO(content)) as z:
            for inner, data in sorted(z.readall().items()):
                raw = data.read()
                budget[0] -= len(raw)
                if inner.startswith("/") or ".." in inner.split("/"):
                    yield f"{name}/{posixpath.basename(inner)}", b"", "path leads out of the container"
                    continue
                if budget[0] < 0:
                    yield f"{name}/{inner}", b"", "unpacked size over the limit"
                    return
                for chain, leaf, reason in leaves(inner, raw, depth + 1, budget):
                    yield f"{name}/{chain}", leaf, reason
    except Exception:  # noqa: BLE001  a broken archive must not end the batch
        yield name, content, "broken container"


def read_plain(content: bytes) -> tuple[str, list]:
    return content.decode("utf-8-sig", errors="ignore"), []


def read_docx(content: bytes) -> tuple[str, list]:
    """Body paragraphs by line, and each table as rows of stripped cells."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")

    def text(node: ElementTree.Element) -> str:
        parts = {f"{WORD}t": lambda e: e.text or "", f"{WORD}tab": lambda e: "\t", f"{WORD}br": lambda e: "\n"}
        return "".join(parts[e.tag](e) for e in node.iter() if e.tag in parts)

    lines = [text(p) for p in body.findall(f"{WORD}p")]
    tables = [[["\n".join(text(p) for p in cell.findall(f"{WORD}p")).strip() for cell in row.findall(f"{WORD}tc")] for row in t.findall(f"{WORD}tr")] for t in body.findall(f"{WORD}tbl")]
    return "\n".join(lines), tables


def read_xlsx(content: bytes) -> tuple[str, list]:
    """Rows joined by tabs without empty cells; one table per sheet that keeps empty positions."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{SHEET}si")]
        lines, tables = [], []
        for path in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1])):
            rows = []
            for row in ElementTree.fromstring(z.read(path)).iter(f"{SHEET}row"):
                cells: dict[int, str] = {}
                for k, c in enumerate(row.findall(f"{SHEET}c")):
                    value = c.find(f"{SHEET}v")
                    kind = c.get("t")
                    if kind == "inlineStr":
                        x = "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
                    elif value is None or value.text is None:
                        continue
                    elif kind == "s":
                        x = shared[int(value.text)]
                    else:
                        x = value.text
                    cells[_column(c.get("r"), k)] = x
                if any(v.strip() for v in cells.values()):
                    rows.append([cells.get(i, "") for i in range(max(cells) + 1)])
            lines += ["\t".join(v for v in r if v) for r in rows]
            if rows:
                tables.append(rows)
    return "\n".join(lines), tables


def _column(ref: str | None, fallback: int) -> int:
    letters = re.match(r"[A-Z]+", ref or "")
    if not letters:
        return fallback
    n = 0
    for c in letters[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


class _Grid(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, int, int]]]] = []
        self.open: list[int] = []
        self.cell: list[str] | None = None
        self.spans = (1, 1)
        self.text: list[str] = []
        self.muted = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("script", "style"):
            self.muted += 1
        elif tag == "table":
            self.tables.append([])
            self.open.append(len(self.tables) - 1)
        elif tag == "tr" and self.open:
            self._end_cell()
            self.tables[self.open[-1]].append([])
        elif tag in ("td", "th") and self.open:
            self._end_cell()
            a = dict(attrs)
            self.spans = (_span(a.get("rowspan"), 0), _span(a.get("colspan"), 1))
            self.cell = []
        elif tag in ("p", "br", "div", "li", "h1", "h2", "h3"):
            self.text.append("\n")
            if self.cell is not None:
                self.cell.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.muted = max(0, self.muted - 1)
        elif tag in ("td", "th", "tr"):
            self._end_cell()
        elif tag == "table" and self.open:
            self._end_cell()
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.muted:
            return
        self.text.append(data)
        if self.cell is not None:
            self.cell.append(data)

    def _end_cell(self) -> None:
        if self.cell is not None and self.open:
            rows = self.tables[self.open[-1]]
            if not rows:
                rows.append([])
            rows[-1].append((" ".join("".join(self.cell).split()), *self.spans))
        self.cell = None


def _span(value: str | None, least: int) -> int:
    try:
        n = int(value) if value is not None else 1
    except ValueError:
        return 1
    return min(n, 1000) if n >= least else 1


def html_tables(source: str) -> list[list[list[str]]]:
    """Tables as rectangular grids: a spanning cell's text stands top left, what it covers is ''.

    rowspan 0 reaches to the table's end; an invalid span is 1.
    """
    parser = _Grid()
    parser.feed(source)
    parser.close()
    out = []
    for rows in parser.tables:
        grid: dict[tuple[int, int], str] = {}
        for r, row in enumerate(rows):
            c = 0
            for text, down, across in row:
                while not grid.keys().isdisjoint((r, c + k) for k in range(across)):
                    c += 1  # all columns that the cell covers must be free
                for i in range(r, len(rows) if down == 0 else min(len(rows), r + down)):
                    for j in range(c, c + across):
                        grid[i, j] = ""
                grid[r, c] = text
                c += across
        width = max((j for _, j in grid), default=-1) + 1
        if width:
            out.append([[grid.get((r, j), "") for j in range(width)] for r in range(len(rows))])
    return out


def html_text(source: str) -> str:
    parser = _Grid()
    parser.feed(source)
    parser.close()
    lines = (" ".join(x.split()) for x in html.unescape("".join(parser.text)).split("\n"))
    return "\n".join(x for x in lines if x)


#: Readers by extension; more (doc, xls, OCR) can be registered by the caller.
READERS: dict[str, Callable[[bytes], tuple[str, list]]] = {
    ".txt": read_plain,
    ".csv": read_plain,
    ".docx": read_docx,
    ".xlsx": read_xlsx,
    ".xlsm": read_xlsx,
    ".html": lambda b: (html_text(b.decode("utf-8", "ignore")), html_tables(b.decode("utf-8", "ignore"))),
    ".pdf": read_pdf,
    ".htm": lambda b: (html_text(b.decode("utf-8", "ignore")), html_tables(b.decode("utf-8", "ignore"))),
}


#: fixed values: what is read without looking at pictures
DIGITAL = (".pdf", ".doc", ".docx", ".xls", ".xlsx", ".txt", ".csv")
MODES = ("all", "text", "digital", "tables")


def read_leaf(chain: str, content: bytes, readers: dict, mode: str = "all") -> tuple[str, list, str, str | None]:
    """``(text, tables, reader, reason)`` of one file; what a mode doesn't ask for is empty.

    text: no tables. digital: text of formats that hold characters, nothing else. tables: no
    text, and what can't be read has none.
    """
    ext = extension(chain)
    reader = readers.get(ext)
    if reader is None or mode == "digital" and ext not in DIGITAL:
        return "", [], "none", f"unsupported format {ext or '(none)'}"
    try:
        text, tables = reader(content)
    except Exception as e:  # noqa: BLE001  one unreadable file must not end the batch
        return "", [], ext[1:], f"{type(e).__name__}: {e}"[:200]
    return "" if mode == "tables" else text, [] if mode in ("text", "digital") else tables, ext[1:], None


def read_documents(spark: SparkSession, path: str, readers: dict | None = None, mode: str = "all") -> DataFrame:
    """``path, chain, text, tables, reader, reason, seconds`` of every leaf file under a path (glob).

    ``mode`` is one of MODES (see ``read_leaf``); ``seconds`` is the time its reader took.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    readers = dict(READERS if readers is None else readers)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                out = []
                for chain, data, reason in leaves(posixpath.basename(where), bytes(content)):
                    began = time.perf_counter()
                    text, tables, reader, why = ("", [], "none", reason) if reason else read_leaf(chain, data, readers, mode)
                    out.append((where, chain, text, tables, reader, why, time.perf_counter() - began))
                yield pd.DataFrame(out, columns=["path", "chain", "text", "tables", "reader", "reason", "seconds"])

    return files.mapInPandas(run, READ_SCHEMA)
