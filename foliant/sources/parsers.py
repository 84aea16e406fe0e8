"""Parsers: file content to typed blocks, tables, figures and warnings, one file at a time inside a task."""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree

from foliant.sources import pdf_text

HEADING = re.compile(r"^(#{1,6})\s+(.+?)\s*#*\s*$")
IMAGE = re.compile(r"^!\[([^\]]*)\]\(([^)]+)\)\s*$")
SEPARATOR = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$")


@dataclass
class Parsed:
    blocks: list[dict] = field(default_factory=list)
    tables: list[dict] = field(default_factory=list)
    figures: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    pages: int | None = None

    def block(self, text: str, kind: str, path: list[str], first: int | None = None, last: int | None = None, page: int | None = None, table_id=None, figure_id=None) -> None:
        self.blocks.append({"ordinal": len(self.blocks), "text": text, "content_type": kind, "page": page, "section_path": list(path), "line_start": first, "line_end": last, "table_id": table_id, "figure_id": figure_id, "ocr_confidence": None})

    def table(self, document: str, caption: str, rows: list[list[str]], path: list[str], first=None, last=None) -> None:
        name = f"{document}-t{len(self.tables):03d}"
        self.tables.append({"table_id": name, "caption": caption, "columns": rows[0], "rows": rows[1:], "section_path": list(path)})
        lines = [caption, "Columns: " + " | ".join(rows[0]), *(" | ".join(r) for r in rows[1:])]
        self.block("\n".join(lines), "table", path, first, last, table_id=name)

    def figure(self, document: str, caption: str, asset: str, nearby: str, path: list[str], first=None) -> None:
        name = f"{document}-f{len(self.figures):03d}"
        self.figures.append({"figure_id": name, "caption": caption, "asset_path": asset, "nearby_text": nearby, "ocr_text": ""})
        self.block(caption, "figure", path, first, first, figure_id=name)


def cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def markdown(content: bytes, document: str) -> Parsed:
    """Headings, images on a line of their own, pipe tables with a separator row, paragraphs."""
    out, path, pending = Parsed(), [], []
    lines = content.decode("utf-8", "replace").split("\n")

    def flush(last: int) -> None:
        if text := "\n".join(pending).strip():
            out.block(text, "paragraph", path, last - len(pending) + 1, last)
        pending.clear()

    at = 0
    while at < len(lines):
        line = lines[at]
        if m := HEADING.match(line):
            flush(at)
            del path[len(m[1]) - 1 :]
            path.append(m[2])
            out.block(m[2], "heading", path, at + 1, at + 1)
        elif m := IMAGE.match(line.strip()):
            flush(at)
            around = [x.strip() for x in lines[max(0, at - 2) : at] + lines[at + 1 : at + 3] if x.strip()]
            out.figure(document, m[1], m[2], " ".join(around), path, at + 1)
        elif "|" in line and at + 1 < len(lines) and SEPARATOR.match(lines[at + 1]):
            flush(at)
            end = at + 2
            while end < len(lines) and "|" in lines[end] and lines[end].strip():
                end += 1
            out.table(document, path[-1] if path else "", [cells(line), *map(cells, lines[at + 2 : end])], path, at + 1, end)
            at = end - 1
        elif line.strip():
            pending.append(line)
        else:
            flush(at)
        at += 1
    flush(len(lines))
    return out


def plain_text(content: bytes, document: str) -> Parsed:
    """Stanzas between blank lines; a line of its own that starts with one # is a heading."""
    out, path, lines = Parsed(), [], content.decode("utf-8", "replace").split("\n")
    start = 0
    for end in range(len(lines) + 1):
        if end == len(lines) or not lines[end].strip():
            stanza = lines[start:end]
            if len(stanza) == 1 and (m := re.match(r"^#\s+(.+)$", stanza[0])):
                path = [m[1].strip()]
                out.block(path[0], "heading", path, start + 1, end)
            elif stanza:
                out.block("\n".join(stanza).strip(), "paragraph", path, start + 1, end)
            start = end + 1
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx(content: bytes, document: str) -> Parsed:
    """The body in order: styles ``Heading N`` and ``Title`` make sections, tables keep their first row as columns."""
    out, path = Parsed(), []
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        out.warnings.append(f"no readable docx: {e}")
        return out
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t")).strip()
    for node in body if body is not None else ():
        if node.tag == f"{_W}tbl":
            rows = [[text(c) for c in r.iter(f"{_W}tc")] for r in node.iter(f"{_W}tr")]
            if rows and rows[0]:
                out.table(document, path[-1] if path else "", rows, path)
        elif node.tag == f"{_W}p" and (said := text(node)):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            name = (style.get(f"{_W}val") or "") if style is not None else ""
            if m := re.match(r"(?i)heading\s*(\d)|title$", name):
                del path[int(m[1] or 1) - 1 :]
                path.append(said)
                out.block(said, "heading", path)
            else:
                out.block(said, "paragraph", path)
    return out


def image(content: bytes, document: str, path: str = "") -> Parsed:
    """A plate: what its file name says; words on it need an OCR adapter."""
    stem = re.sub(r"\.[^.]+$", "", path.rsplit("/", 1)[-1])
    kind, _, subject = stem.partition("_")
    subject = subject.replace("_", " ").title() or kind.title()
    out = Parsed()
    out.figure(document, f"{kind.replace('-', ' ').title()} plate: {subject}", path, "", [subject])
    return out


#: Characters of a page under which it is taken for a picture of one.
SCANNED = 16


def heading_like(text: str) -> bool:
    """As ``columns.is_heading``: a short line of mostly capitalised words that ends no sentence."""
    words = text.split()
    capital = sum(w[0].isupper() for w in words)
    return 0 < len(text) <= 80 and "\n" not in text and text[-1] not in ".,;:?!" and len(words) <= 10 and capital >= max(1, len(words) - 2)


def paged(pages: list[str]) -> Parsed:
    """Paragraphs, parted by empty lines, of pages of text; a paragraph that looks like a heading begins a section."""
    out, path = Parsed(pages=len(pages)), []
    for number, text in enumerate(pages, 1):
        for part in re.split(r"\n[ \t]*\n", text):
            body = part.strip()
            if heading_like(body):
                path = [body]
                out.block(body, "heading", path, page=number)
            elif body:
                out.block(re.sub(r"\s*\n\s*", " ", body), "paragraph", path, page=number)
        if len(text.strip()) < SCANNED:
            out.warnings.append(f"page {number} has no text layer: it needs OCR, which is not available here")
    return out


def pdf(content: bytes, document: str) -> Parsed:
    """The text layer, page by page."""
    try:
        pages = pdf_text.read(content)
    except pdf_text.Unreadable as e:
        return Parsed(warnings=[f"pdf: {e}"])
    return paged(pages) if pages else Parsed(warnings=["pdf: no pages were found"])


def parse(source_format: str, content: bytes, document: str, path: str) -> Parsed:
    if source_format == "image":
        return image(content, document, path)
    parser = {"markdown": markdown, "text": plain_text, "docx": docx, "pdf": pdf, "pdf_scan": pdf}.get(source_format)
    if parser is None:
        return Parsed(warnings=[f"no parser for {source_format}"])
    return parser(content, document)
