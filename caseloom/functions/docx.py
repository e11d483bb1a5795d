"""Text of DOCX files, and plain DOCX files of paragraphs."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.parsers import expat
from xml.sax.saxutils import escape

#: How many inflated bytes of a document part are read; a larger one is tagged and not read on.
MOST_BYTES = 256 << 20
PART = "word/document.xml"
_NAMESPACES = ("http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://purl.oclc.org/ooxml/wordprocessingml/main")
_CHOICE = "http://schemas.openxmlformats.org/markup-compatibility/2006 Choice"
_ODD = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


class Oversized(ValueError):
    """A part larger than what is read."""


class _Text:
    """Collects the text of runs: a blank line after a paragraph, a tab for a tab; deleted text and alternatives do not count."""

    def __init__(self):
        self.parts: list[str] = []
        self.in_text = self.skipped = 0

    def start(self, name: str, _: dict) -> None:
        space, _, local = name.rpartition(" ")
        if self.skipped or name == _CHOICE:
            self.skipped += 1
        elif space in _NAMESPACES:
            if local == "t":
                self.in_text += 1
            elif local == "tab" and not self.tab_stops:
                self.parts.append("\t")
            elif local == "tabs":
                self.tab_stops = True

    def end(self, name: str) -> None:
        space, _, local = name.rpartition(" ")
        if self.skipped:
            self.skipped -= 1
        elif space in _NAMESPACES:
            if local == "t":
                self.in_text -= 1
            elif local == "tabs":
                self.tab_stops = False
            elif local == "p":
                self.parts.append("\n\n")

    def data(self, s: str) -> None:
        if self.in_text and not self.skipped:
            self.parts.append(s)

    tab_stops = False  # within a list of tab stops, which are no tabs


def _refused(*_) -> None:
    raise ValueError("a document type is not read")  # (no entities, so nothing expands)


def text(content: bytes, most: int = MOST_BYTES) -> str:
    """The text of a DOCX file, read in pieces; ValueError if it is torn or none, Oversized beyond ``most`` inflated bytes."""
    found, read = _Text(), 0
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = found.start, found.end, found.data
    parser.StartDoctypeDeclHandler = _refused
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(PART) as f:
            while piece := f.read(1 << 16):
                read += len(piece)
                if read > most:
                    raise Oversized(f"over {most} bytes")
                parser.Parse(piece, False)
            parser.Parse(b"", True)
    except (zipfile.BadZipFile, KeyError, EOFError, zlib.error, expat.ExpatError, NotImplementedError, RuntimeError, OSError) as e:
        raise ValueError(str(e)) from e
    return "".join(found.parts)


def document(paragraphs: list[str]) -> bytes:
    """A DOCX file with these paragraphs; what XML cannot hold is left out."""
    run = lambda t: "<w:r><w:tab/></w:r>".join(f'<w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r>' for x in _ODD.sub("", t).replace("\r", "").split("\t"))
    body = "".join(f"<w:p>{run(p)}</w:p>" for p in paragraphs)
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    types = "application/vnd.openxmlformats-package.relationships+xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="{types[0]}"/>'
            f'<Override PartName="/{PART}" ContentType="{types[1]}"/></Types>',
        )
        z.writestr(
            "_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" '
            f'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="{PART}"/></Relationships>',
        )
        z.writestr(PART, f'{head}<w:document xmlns:w="{_NAMESPACES[0]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()
