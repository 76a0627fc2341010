"""Text of PDF files by the standard library: pages, lines and their font sizes, without rendering.

Read are classic and compressed object streams, Flate-compressed contents, and text shown in fonts that are coded as
Windows Latin or carry a map to Unicode. Encrypted files, other filters and scanned pages give no text: ``needs_ocr``
decides on those.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
REF = re.compile(rb"(\d+)\s+\d+\s+R")
TOKEN = re.compile(rb"<<|>>|[\[\]]|/[^\s/<>()\[\]{}%]*|[-+]?\d*\.?\d+|[A-Za-z'\"*]+\d?|%[^\r\n]*")
# What a backslash and a letter mean in a string
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Objects(dict):
    """Objects of a file by number: (dictionary bytes, decoded stream or None)."""

    def __init__(self, data: bytes):
        super().__init__()
        if not data.lstrip().startswith(b"%PDF-"):
            raise ValueError("no PDF file")
        for number, body in OBJECT.findall(data):
            found = STREAM.match(body)
            self[int(number)] = (found[1], self._decoded(found[1], found[2])) if found else (body, None)
        for head, stream in list(self.values()):
            if stream is not None and re.search(rb"/Type\s*/ObjStm\b", head):
                self._unpack(head, stream)

    @staticmethod
    def _decoded(head: bytes, stream: bytes) -> bytes:
        if b"/FlateDecode" not in head:
            return stream
        try:
            return zlib.decompressobj().decompress(stream)
        except zlib.error:
            return b""

    def _unpack(self, head: bytes, stream: bytes) -> None:
        first = int(re.search(rb"/First\s+(\d+)", head)[1])
        numbers = [int(x) for x in stream[:first].split()]
        for number, start, end in zip(numbers[::2], numbers[1::2], [*numbers[3::2], None]):
            self.setdefault(number, (stream[first + start : None if end is None else first + end], None))

    def value(self, head: bytes, key: bytes) -> bytes:
        """What stands after ``key`` in a dictionary, references followed: up to its end if it is a list or a dictionary."""
        found = re.search(rb"/" + key + rb"\b\s*", head)
        if not found:
            return b""
        rest = head[found.end() :]
        if ref := REF.match(rest):
            return self.get(int(ref[1]), (b"", None))[0].strip()
        depth = 0
        for t in re.finditer(rb"<<|>>|\[|\]", rest):
            depth += 1 if t[0] in (b"<<", b"[") else -1
            if depth <= 0:
                return rest[: t.end()]
        return rest

    def pages(self) -> list[bytes]:
        """Dictionaries of the pages in their order; those of a file without a page tree as they stand."""
        roots = [head for head, _ in self.values() if re.search(rb"/Type\s*/Pages\b", head) and b"/Parent" not in head]
        out: list[bytes] = []
        todo = [(head, b"") for head in roots[::-1]]
        seen: set[bytes] = set()
        while todo:
            head, above = todo.pop()
            if head in seen and b"/Kids" in head:
                continue
            seen.add(head)
            resources = self.value(head, b"Resources") or above
            if b"/Kids" in head:
                todo += [(self[int(n)][0], resources) for n in REF.findall(self.value(head, b"Kids"))[::-1] if int(n) in self]
            else:
                out.append(head + (b"" if b"/Resources" in head else b" /Resources " + resources))
        return out or [head for head, _ in self.values() if re.search(rb"/Type\s*/Page\b", head)]


def unicode_map(cmap: bytes) -> tuple[int, dict[int, str]]:
    """(bytes a code, code to text) of a font's map to Unicode."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out, width = {}, 1
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            width, out[int(code, 16)] = len(code) // 2, text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for lo, hi, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            width = len(lo) // 2
            for i, code in enumerate(range(int(lo, 16), min(int(hi, 16), int(lo, 16) + 65535) + 1)):
                out[code] = text(to)[:-1] + chr(ord(text(to)[-1]) + i)
    return width, out


def tokens(content: bytes) -> Iterator[tuple[str, bytes]]:
    """(kind, value): strings with their escapes undone, and all other tokens."""
    at = 0
    while at < len(content):
        c = content[at : at + 1]
        if c == b"(":
            out, depth, at = bytearray(), 1, at + 1
            while at < len(content):
                c = content[at : at + 1]
                if c == b"\\":
                    if octal := re.match(rb"[0-7]{1,3}", content[at + 1 : at + 4]):
                        out.append(int(octal[0], 8) & 255)
                        at += 1 + len(octal[0])
                        continue
                    n = content[at + 1 : at + 2]
                    out += ESCAPES.get(n, b"" if n in b"\r\n" else n)
                    at += 2
                    continue
                depth += (c == b"(") - (c == b")")
                at += 1
                if not depth:
                    break
                out += c
            yield "string", bytes(out)
        elif c == b"<" and content[at : at + 2] != b"<<":
            end = content.find(b">", at)
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", content[at + 1 : end])
            yield "string", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            at = end + 1 if end >= 0 else len(content)
        elif m := TOKEN.match(content, at):
            yield "token", m[0]
            at = m.end()
        else:
            at += 1


def page_lines(objects: Objects, page: bytes) -> list[tuple[str, float]]:
    """(text, font size) of a page's lines as they are shown."""
    contents = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
    stream = b"\n".join(objects.get(int(n), (b"", None))[1] or b"" for n in REF.findall(contents[1])) if contents else b""
    fonts = {}
    for name, number in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", objects.value(objects.value(page, b"Resources"), b"Font")):
        to = re.search(rb"/ToUnicode\s+(\d+)", objects.get(int(number), (b"", None))[0])
        if to and objects.get(int(to[1]), (b"", None))[1]:
            fonts[name] = unicode_map(objects[int(to[1])][1])
    out: list[tuple[str, float]] = []
    line, size, font, stack, place = "", 0.0, None, [], None

    def shown(code: bytes) -> str:
        if font is None:
            return code.decode("cp1252", "replace")
        width, known = font
        return "".join(known.get(int.from_bytes(code[i : i + width], "big"), "") for i in range(0, len(code), width))

    def close() -> None:
        nonlocal line
        if line.strip():
            out.append((re.sub(r"[ \t]+", " ", line).strip(), size))
        line = ""

    for kind, value in tokens(stream):
        if kind == "string" or value in (b"[", b"]") or re.fullmatch(rb"[-+]?\d*\.?\d+|/.*", value):
            stack.append((kind, value))
            continue
        numbers = [float(v) for k, v in stack if k == "token" and re.fullmatch(rb"[-+]?\d*\.?\d+", v)]
        if value == b"Tf":
            names = [v[1:] for k, v in stack if k == "token" and v.startswith(b"/")]
            font, new = fonts.get(names[-1] if names else b""), numbers[-1] if numbers else size
            if new != size and line.strip():
                close()
            size = new
        elif value in (b"T*", b"'", b'"', b"ET") or (value in (b"Td", b"TD") and len(numbers) >= 2 and numbers[-1]):
            close()
        elif value == b"Tm" and len(numbers) >= 6:
            if place is not None and place != numbers[-1]:
                close()
            place = numbers[-1]
        if value in (b"Tj", b"'", b'"'):
            line += "".join(shown(v) for k, v in stack if k == "string")
        elif value == b"TJ":
            line += "".join(shown(v) if k == "string" else " " if re.fullmatch(rb"-\d*\.?\d+", v) and float(v) < -200 else "" for k, v in stack)
        stack = []
    close()
    return out


def lines(data: bytes) -> Iterator[tuple[int, int, str, float]]:
    """(page, pos, text, font size) of a file's lines, pages from 1 on."""
    objects = Objects(data)
    for number, page in enumerate(objects.pages(), 1):
        for pos, (text, size) in enumerate(page_lines(objects, page)):
            yield number, pos, text, size


def properties(data: bytes) -> Iterator[tuple[str | None, str | None, str | None, int]]:
    """(title, author, date as YYYY-MM-DD, pages) of a file."""
    objects = Objects(data)
    info = re.search(rb"/Info\s+(\d+)\s+\d+\s+R", data)
    head = objects.get(int(info[1]), (b"", None))[0] if info else b""

    def field(key: bytes) -> str | None:
        found = re.search(rb"/" + key + rb"\s*(?=[(<])", head)
        value = next((v for k, v in tokens(head[found.end() :]) if k == "string"), b"") if found else b""
        return (value[2:].decode("utf-16-be", "replace") if value.startswith(b"\xfe\xff") else value.decode("cp1252", "replace")) or None

    date = re.match(r"D:(\d{4})(\d{2})(\d{2})", field(b"CreationDate") or "")
    yield field(b"Title"), field(b"Author"), "-".join(date.groups()) if date else None, len(objects.pages())
