"""The text layer of PDF files: objects, streams and the text operators of pages, by the published format alone.

Read are files with plain or Flate-compressed streams and object streams, and fonts whose codes are Latin-1 or have a
ToUnicode map.  What is encrypted, or drawn as a picture, has no text here.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A step down of more than this share of the font's size begins a line; of more than the second, a paragraph.
LINE, PARAGRAPH = 0.3, 1.6


class Unreadable(ValueError):
    """A file that is no PDF, or is encrypted."""


def _stream(body: bytes) -> bytes:
    m = _STREAM.search(body)
    if not m:
        return b""
    if b"/FlateDecode" in body[: m.start()]:
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return b""
    return m[1]


def objects(data: bytes) -> dict[int, bytes]:
    """Objects by number, those inside object streams too."""
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
    for body in list(found.values()):
        if b"/ObjStm" in body:
            head, count, first = _stream(body), *(re.search(rb"/%s\s+(\d+)" % k, body) for k in (b"N", b"First"))
            if count and first:
                places = [int(x) for x in head[: int(first[1])].split()[: 2 * int(count[1])]]
                ends = [*places[3::2], len(head) - int(first[1])]
                for number, start, end in zip(places[::2], places[1::2], ends, strict=False):
                    found.setdefault(number, head[int(first[1]) + start : int(first[1]) + end])
    return found


def _refs(body: bytes, key: bytes) -> list[int]:
    m = re.search(rb"/%s\s*(\[[^\]]*\]|\d+\s+\d+\s+R)" % key, body)
    return [int(x) for x in _REF.findall(m[1])] if m else []


def pages(known: dict[int, bytes]) -> list[int]:
    """The numbers of page objects in the order of the page tree."""
    roots = [n for n, body in known.items() if re.search(rb"/Type\s*/Pages\b", body) and b"/Parent" not in body]
    out, seen, left = [], set(), roots[:1]
    while left:
        at = left.pop(0)
        if at in seen or at not in known:
            continue
        seen.add(at)
        kids = _refs(known[at], b"Kids")
        if kids or re.search(rb"/Type\s*/Pages\b", known[at]):
            left = kids + left
        else:
            out.append(at)
    return out


def _unicode_map(stream: bytes) -> dict[int, str]:
    """Codes to text of a ToUnicode map."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", stream, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(code, 16)] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", stream, re.S):
        for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            first = text(to)
            for k in range(min(int(high, 16) - int(low, 16) + 1, 1 << 16)):
                out[int(low, 16) + k] = first[:-1] + chr(ord(first[-1]) + k)
    return out


def _fonts(page: bytes, known: dict[int, bytes]) -> dict[bytes, dict[int, str]]:
    """ToUnicode maps by font name of a page's resources."""
    resources = page + b"".join(known.get(n, b"") for n in _refs(page, b"Resources"))
    resources += b"".join(known.get(n, b"") for n in _refs(resources, b"Font"))
    out = {}
    for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", resources):
        for to in _refs(known.get(int(number), b""), b"ToUnicode"):
            out[name] = _unicode_map(_stream(known.get(to, b"")))
    return out


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    plain = lambda m: _ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", plain, token[1:-1], flags=re.S)


def page_text(content: bytes, fonts: dict[bytes, dict[int, str]]) -> str:
    """The text that a page's operators show: a line for each step down, an empty line for each large one."""
    out: list[str] = []
    stack: list[bytes] = []
    font, size, leading, y, last = {}, 12.0, 0.0, 0.0, None

    def shown(raw: bytes) -> str:
        if not font:
            return raw.decode("latin-1")
        wide = 2 if max(font) > 255 else 1
        return "".join(font.get(int.from_bytes(raw[k : k + wide], "big"), "") for k in range(0, len(raw), wide))

    def place() -> None:
        nonlocal last
        if last is not None and abs(last - y) > LINE * size:
            out.append("\n\n" if abs(last - y) > PARAGRAPH * max(size, 1.0) else "\n")
        last = y

    number = lambda k: float(stack[k]) if len(stack) >= -k and re.fullmatch(rb"[-+]?\d*\.?\d+", stack[k]) else 0.0
    for token in _TOKEN.findall(content):
        if not re.fullmatch(rb"[A-Za-z'\"*]+", token):
            stack.append(token)
            continue
        if token == b"Tf" and len(stack) > 1:
            font, size = fonts.get(stack[-2][1:], {}), abs(number(-1)) or size
        elif token == b"TL":
            leading = number(-1)
        elif token in (b"Td", b"TD"):
            y += number(-1)
            leading = -number(-1) if token == b"TD" else leading
        elif token == b"Tm":
            y, size = number(-1), abs(number(-3)) * (size if abs(number(-3)) <= 1 else 1) or size
        elif token in (b"T*", b"'", b'"'):
            y -= leading
        if token in (b"Tj", b"'", b'"') and stack and stack[-1][:1] in b"(<":
            place()
            out.append(shown(_string(stack[-1])))
        elif token == b"TJ" and b"[" in stack:
            place()
            for part in stack[len(stack) - 1 - stack[::-1].index(b"[") :]:
                if part[:1] in (b"(", b"<"):
                    out.append(shown(_string(part)))
                elif re.fullmatch(rb"-\d*\.?\d+", part) and float(part) < -200:
                    out.append(" ")
        elif token == b"ET":
            out.append(" ")
        stack = []
    return re.sub(r"[ \t]+", " ", "".join(out)).strip()


def read(data: bytes) -> list[str]:
    """The text of each page."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise Unreadable("no PDF header")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise Unreadable("the file is encrypted")
    known = objects(data)
    return [page_text(b"\n".join(_stream(known.get(n, b"")) for n in _refs(known[at], b"Contents")), _fonts(known[at], known)) for at in pages(known)]
