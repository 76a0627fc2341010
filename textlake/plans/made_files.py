"""Small office and PDF files made from table rows, for queries whose input is a file's bytes."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(title: str, paragraphs: list[str], author: str) -> bytes:
    """A title in a heading's style and paragraphs, with core properties."""
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>{escape(title)}</w:t></w:r></w:p>'
    body += "".join(f"<w:p><w:r><w:t>{escape(p)}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>')
        z.writestr("docProps/core.xml", f'<cp:coreProperties xmlns:cp="cp" xmlns:dc="dc"><dc:title>{escape(title)}</dc:title><dc:creator>{escape(author)}</dc:creator></cp:coreProperties>')
    return out.getvalue()


def pdf(pages: list[list[str]], title: str, author: str) -> bytes:
    """Pages of lines, the first line of each in large type; contents are compressed."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"}
    text = lambda s: b"(" + s.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
    objects[4] = b"<< /Title " + text(title) + b" /Author " + text(author) + b" /CreationDate (D:20240102030405Z) >>"
    kids = []
    for lines in pages:
        shown = b"BT /F1 18 Tf 72 720 Td " + b"".join((b"/F1 11 Tf 0 -14 Td " if i else b"") + text(line) + b" Tj " for i, line in enumerate(lines)) + b"ET"
        packed, number = zlib.compress(shown), len(objects) + 2
        objects[number] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(packed) + packed + b"\nendstream"
        objects[number + 1] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % number
        kids.append(number + 1)
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in sorted(objects.items())) + b"trailer << /Root 1 0 R /Info 4 0 R >>\n%%EOF\n"
