"""Files to markdown: office formats are read from their XML, without further libraries.

A file that cannot be read gives an empty text and an error, never an exception.
"""

from __future__ import annotations

import html
import io
import re
import zipfile
import zlib
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _row(cells: list[str]) -> str:
    return "| " + " | ".join(c.replace("|", "\\|").replace("\n", " ") for c in cells) + " |"


def _table(rows: list[list[str]]) -> list[str]:
    if not rows:
        return []
    wide = max(map(len, rows))
    rows = [r + [""] * (wide - len(r)) for r in rows]
    return [_row(rows[0]), "|" + " --- |" * wide, *map(_row, rows[1:])]


def docx(data: bytes) -> str:
    """Headings 1 to 4, list items, paragraphs; tables after them."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    body = root.find(f"{_W}body")
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t"))
    lines, tables = [], []
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "") if style is not None else ""
            said = text(e).strip()
            if not said:
                continue
            level = re.fullmatch(r"(?i)heading\s*([1-4])", name)
            lines += ["#" * int(level[1]) + " " + said if level else "- " + said if name.lower().startswith("list") else said, ""]
        elif e.tag == f"{_W}tbl":
            tables += [*_table([[text(c).strip() for c in r.iter(f"{_W}tc")] for r in e.iter(f"{_W}tr")]), ""]
    return "\n".join(lines + tables).strip()


def xlsx(data: bytes) -> str:
    """Every sheet as a table under its name; empty rows are left out."""
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
    names = [s.get("name") for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_S}sheet")]
    files = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out = []
    for name, file in zip(names, files):
        rows = []
        for r in ElementTree.fromstring(book.read(file)).iter(f"{_S}row"):
            cells: list[str] = []
            for c in r.iter(f"{_S}c"):
                letters = re.match(r"[A-Z]+", c.get("r") or "")
                at = 0
                for ch in letters[0] if letters else "":
                    at = at * 26 + ord(ch) - 64
                cells += [""] * (at - 1 - len(cells))
                v = c.find(f"{_S}v")
                value = (v.text or "") if v is not None else "".join(t.text or "" for t in c.iter(f"{_S}t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            if any(cells):
                rows.append(cells)
        out += [f"## Sheet: {name}", "", *_table(rows), ""]
    return "\n".join(out).strip()


class _Markdown(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.cells: list[str] | None = None
        self.first = self.skip = False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip = True
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("\n- ")
        elif tag in ("p", "div", "table"):
            self.out.append("\n\n")
            self.first = tag == "table" or self.first
        elif tag == "br":
            self.out.append("\n")
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = False
        elif tag == "tr" and self.cells is not None:
            rows = _table([[c.strip() for c in self.cells]])
            self.out.append("\n".join(rows if self.first else rows[:1]) + "\n")
            self.cells, self.first = None, False

    def handle_data(self, data):
        if self.skip:
            return
        if self.cells:
            self.cells[-1] += data
        elif self.cells is None:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(data: bytes) -> str:
    parser = _Markdown()
    parser.feed(data.decode("utf-8", "replace"))
    return re.sub(r"\n{3,}", "\n\n", "".join(parser.out)).strip()


def pdf(data: bytes) -> str:
    """Text shown by the operators of plain or deflated content streams in simple encodings."""
    out = []
    for stream in re.findall(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        try:
            stream = zlib.decompress(stream)
        except zlib.error:
            pass
        if b"BT" not in stream:
            continue
        for block in re.findall(rb"BT(.*?)ET", stream, re.S):
            said = []
            for part in re.findall(rb"\(((?:\\.|[^\\()])*)\)|(T\*|Td|TD|')", block, re.S):
                if part[1]:
                    said.append("\n")
                else:
                    said.append(re.sub(rb"\\([()\\])", rb"\1", part[0]).decode("latin-1"))
            out.append("".join(said).strip())
    return "\n".join(x for x in out if x)


READERS = {".docx": docx, ".xlsx": xlsx, ".pdf": pdf, ".html": html_text, ".htm": html_text}
TEXTS = (".md", ".txt", ".rst")


def one(name: str, data: bytes | None) -> tuple[str, str | None]:
    """(markdown with its source comment, error)."""
    dot = name.rfind(".")
    ending = name[dot:].lower() if dot > 0 else ""
    try:
        if data is None:
            raise ValueError("no content")
        if ending in TEXTS:
            text = data.decode("utf-8", "replace")
        elif ending in READERS:
            text = READERS[ending](data)
        else:
            raise ValueError(f"unsupported format {ending or name}")
        if not text.strip():
            raise ValueError("empty")
    except Exception as e:  # noqa: BLE001  an unreadable file must not end the job
        return "", f"{type(e).__name__}: {e}"
    return f"<!-- converted from {html.unescape(name)} -->\n\n{text}", None


def convert(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """The files' paths with ``markdown`` and ``error``; content is read in Arrow batches."""

    def run(batches):
        for batch in batches:
            made = [one((p or "").rpartition("/")[2], c) for p, c in zip(batch["path"], batch["content"])]
            yield pd.DataFrame({"path": list(batch["path"]), "markdown": [m for m, _ in made], "error": [e for _, e in made]})

    return files.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInPandas(run, "path string, markdown string, error string")
