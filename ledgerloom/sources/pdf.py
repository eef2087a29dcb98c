"""The text layer of PDF files, page by page, without a library.

Objects are found by scanning the file (also inside object streams), so a damaged
cross-reference table doesn't matter. Text is what the text operators of a page's content show,
decoded by the font's ToUnicode map where it has one; a new line begins where the text position
moves down or back. Encrypted files and streams with other filters than Flate have no text here.
"""

from __future__ import annotations

import re
import zlib
from typing import NamedTuple

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.DOTALL)
_STREAM = re.compile(rb"stream\r?\n?(.*?)\r?\n?endstream", re.DOTALL)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_CONTENT = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?[0-9]*\.?[0-9]+|[A-Za-z'\"*]+", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Page(NamedTuple):
    page_no: int
    text: str
    has_images: bool


class Pdf:
    def __init__(self, content: bytes) -> None:
        if b"%PDF-" not in content[:1024]:
            raise ValueError("no PDF")
        if re.search(rb"/Encrypt\s", content):
            raise ValueError("an encrypted PDF")
        self.objects: dict[int, bytes] = {int(m[1]): m[3] for m in _OBJECT.finditer(content)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        raw = self.stream(body)
        n, first = (int(x[1]) if (x := re.search(rb"/" + k + rb"\s+(\d+)", body)) else 0 for k in (b"N", b"First"))
        numbers = [int(x) for x in raw[:first].split()[: 2 * n]]
        for number, start, stop in zip(numbers[::2], numbers[1::2], [*numbers[3::2], len(raw) - first], strict=False):
            self.objects.setdefault(number, raw[first + start : first + stop])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if m is None:
            return b""
        head = body[: m.start()]
        if b"/FlateDecode" in head:
            try:
                return zlib.decompressobj().decompress(m[1])
            except zlib.error:
                return b""
        return b"" if b"/Filter" in head else m[1]

    def refs(self, body: bytes, key: bytes) -> list[int]:
        """The objects that a key of a dictionary points to: one, or those of a list."""
        m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in _REF.findall(m[1])] if m else []

    def inner(self, body: bytes, key: bytes) -> bytes:
        """A dictionary under a key, written in place or as an object."""
        m = re.search(rb"/" + key + rb"\s*(<<|\d+\s+\d+\s+R)", body)
        if m is None:
            return b""
        if m[1] != b"<<":
            return self.objects.get(int(m[1].split()[0]), b"")
        depth, i = 0, m.start(1)
        for t in re.finditer(rb"<<|>>", body[i:]):
            depth += 1 if t[0] == b"<<" else -1
            if not depth:
                return body[i : i + t.end()]
        return body[i:]

    def pages(self) -> list[bytes]:
        """Page objects in reading order, with the resources they inherit."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        out: list[bytes] = []
        seen: set[int] = set()

        def walk(number: int, resources: bytes) -> None:
            body = self.objects.get(number, b"")
            if number in seen or not body:
                return
            seen.add(number)
            own = self.inner(body, b"Resources") or resources
            if re.search(rb"/Type\s*/Pages\b", body):
                for kid in self.refs(body, b"Kids"):
                    walk(kid, own)
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(body if self.inner(body, b"Resources") else body + b"/Resources " + own)

        for number in self.refs(root, b"Pages"):
            walk(number, b"")
        return out or [b for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b", b)]

    def maps(self, resources: bytes) -> dict[bytes, dict[int, str]]:
        """Font name -> code -> text, for fonts with a ToUnicode map."""
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self.inner(resources, b"Font")):
            for ref in self.refs(self.objects.get(int(number), b""), b"ToUnicode"):
                out[name] = unicode_map(self.stream(self.objects.get(ref, b"")))
        return out


def unicode_map(cmap: bytes) -> dict[int, str]:
    text = lambda x: bytes.fromhex(x.decode() + "0" * (len(x) % 2)).decode("utf-16-be", "ignore")
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.DOTALL):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.DOTALL):
        for a, b, c, listed in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            low, high = int(a, 16), min(int(b, 16), int(a, 16) + 65_535)
            if listed:
                out |= {low + i: text(x) for i, x in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", listed)) if low + i <= high}
            else:
                first = text(c)
                out |= {low + i: first[:-1] + chr(min(ord(first[-1]) + i, 0x10FFFF)) for i in range(high - low + 1)} if first else {}
    return out


def _bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x in (b"\n", b"\r\n") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.DOTALL)


def _shown(token: bytes, codes: dict[int, str] | None) -> str:
    raw = _bytes(token)
    if not codes:
        return raw[2:].decode("utf-16-be", "ignore") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")
    width = 2 if max(codes) > 255 or token[:1] == b"<" and len(raw) % 2 == 0 and not any(b in codes and codes[b].strip() for b in raw[:1]) else 1
    return "".join(codes.get(int.from_bytes(raw[i : i + width], "big"), "") for i in range(0, len(raw), width))


def content_text(content: bytes, maps: dict[bytes, dict[int, str]]) -> str:
    """The text that a content stream shows, in its order."""
    out: list[str] = []
    stack: list[bytes] = []
    codes: dict[int, str] | None = None
    row = None

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for token in _CONTENT.findall(content):
        if not (token[:1].isalpha() or token in (b"'", b'"', b"T*")):
            stack.append(token)
            continue
        if token == b"Tf" and len(stack) >= 2:
            codes = maps.get(stack[-2][1:])
        elif token in (b"Td", b"TD", b"Tm"):
            y = stack[-1] if stack else b"0"
            if token != b"Tm" and float(y if y[-1:].isdigit() else 0) != 0 or token == b"Tm" and y != row:
                line()
            elif out and not out[-1].endswith((" ", "\n")):
                out.append(" ")
            row = y if token == b"Tm" else row
        elif token == b"T*":
            line()
        elif token in (b"Tj", b"'", b'"') and stack:
            if token != b"Tj":
                line()
            if stack[-1][:1] in (b"(", b"<"):
                out.append(_shown(stack[-1], codes))
        elif token == b"TJ":
            for x in stack:
                if x[:1] in (b"(", b"<"):
                    out.append(_shown(x, codes))
                elif x not in (b"[", b"]") and x[:1] == b"-" and float(x) < -200:
                    out.append(" ")  # a gap as wide as a blank
        elif token == b"ET":
            line()
        stack.clear()
    return "\n".join(x.rstrip() for x in "".join(out).split("\n")).strip("\n")


def read_pages(content: bytes) -> list[Page]:
    """Each page's text layer, and whether it holds images (then a page with little text needs OCR)."""
    pdf = Pdf(content)
    out = []
    for i, body in enumerate(pdf.pages(), 1):
        resources = pdf.inner(body, b"Resources")
        stream = b"\n".join(pdf.stream(pdf.objects.get(n, b"")) for n in pdf.refs(body, b"Contents"))
        held = pdf.inner(resources, b"XObject")
        images = any(re.search(rb"/Subtype\s*/Image", pdf.objects.get(int(n), b"")) for n in _REF.findall(held))
        out.append(Page(i, content_text(stream, pdf.maps(resources)), images))
    return out


def needs_ocr(page: Page) -> bool:
    n = len(page.text.strip())
    return n == 0 or n < 50 and page.has_images


def combine(pages: list[Page], ocr: dict[int, str]) -> tuple[str, str, list[int]]:
    """``(text, OCR text, OCR pages)``: both kinds in page order; OCR stands for the text layer of the pages that need it."""
    used = [p.page_no for p in pages if needs_ocr(p) and ocr.get(p.page_no, "").strip()]
    parts = [ocr[p.page_no] if p.page_no in used else p.text for p in pages]
    return "\n".join(x for x in parts if x.strip()), "\n".join(ocr[i] for i in used), used


def read_pdf(content: bytes) -> tuple[str, list]:
    return combine(read_pages(content), {})[0], []
