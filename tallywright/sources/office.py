"""Text, tables and cells of Office Open XML files (zip archives of XML parts), read with the standard library.

Each reader gives the plain value of one document; whatever is no such file
raises ``ValueError``.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

#: Namespaces of the formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/package/2006/relationships}"
REF = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: A part that inflates to more than this is refused.
MAX_PART = 64 << 20


class Package:
    """Parts of an archive and the links between them."""

    def __init__(self, content: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(content))
        except zipfile.BadZipFile as e:
            raise ValueError("not an Office file") from e
        self.names = set(self.zip.namelist())

    def xml(self, part: str) -> ET.Element:
        if part not in self.names:
            raise ValueError(f"no part {part}")
        info = self.zip.getinfo(part)
        if info.flag_bits & 1:
            raise ValueError("the file is encrypted")
        if info.file_size > MAX_PART:
            raise ValueError(f"part {part} is too large")
        try:
            return ET.fromstring(self.zip.read(part))
        except (ET.ParseError, zipfile.BadZipFile) as e:
            raise ValueError(f"part {part} cannot be read") from e

    def links(self, part: str) -> dict[str, tuple[str, str]]:
        """id -> (kind, part) of the links of a part."""
        folder, name = posixpath.split(part)
        rels = f"{folder}/_rels/{name}.rels"
        if rels not in self.names:
            return {}
        out = {}
        for r in self.xml(rels).iter(f"{LINK}Relationship"):
            to = r.get("Target", "")
            out[r.get("Id")] = (r.get("Type", "").rsplit("/", 1)[-1], to.lstrip("/") if to.startswith("/") else posixpath.normpath(f"{folder}/{to}"))
        return out


def _text(node: ET.Element, run: str, more: dict[str, str]) -> str:
    """The text of a paragraph's runs; ``more`` has the characters that other elements stand for."""
    return "".join(x.text or "" if x.tag == run else more[x.tag] for x in node.iter() if x.tag == run or x.tag in more)


# --- documents -------------------------------------------------------------
def _word_text(p: ET.Element) -> str:
    return _text(p, f"{WORD}t", {f"{WORD}tab": "\t", f"{WORD}br": "\n"})


def _word_table(table: ET.Element) -> list[list[str]]:
    """Rows of cell text; a merged cell holds its text at its top left, covered places are empty."""
    rows = []
    for tr in table.findall(f"{WORD}tr"):
        row = []
        for tc in tr.findall(f"{WORD}tc"):
            props = tc.find(f"{WORD}tcPr")
            span = props.find(f"{WORD}gridSpan") if props is not None else None
            merge = props.find(f"{WORD}vMerge") if props is not None else None
            covered = merge is not None and merge.get(f"{WORD}val", "continue") == "continue"
            row.append("" if covered else "\n".join(_word_text(p) for p in tc.findall(f"{WORD}p")))
            row += [""] * (int(span.get(f"{WORD}val", "1")) - 1 if span is not None else 0)
        rows.append(row)
    return rows


def docx(content: bytes) -> dict:
    """Paragraphs and tables in document order."""
    body = Package(content).xml("word/document.xml").find(f"{WORD}body")
    blocks = []
    for x in body if body is not None else ():
        if x.tag == f"{WORD}p":
            style = x.find(f"{WORD}pPr/{WORD}pStyle")
            blocks.append({"kind": "paragraph", "text": _word_text(x), "style": style.get(f"{WORD}val") if style is not None else None})
        elif x.tag == f"{WORD}tbl":
            blocks.append({"kind": "table", "rows": _word_table(x)})
    return {"format": "docx", "blocks": blocks}


# --- slides ----------------------------------------------------------------
def _slide_paragraphs(shape: ET.Element) -> list[str]:
    return [_text(p, f"{DRAW}t", {f"{DRAW}br": "\n"}) for p in shape.iter(f"{DRAW}p")]


def _slide_table(table: ET.Element) -> list[list[str]]:
    return [["" if tc.get("hMerge") in ("1", "true") or tc.get("vMerge") in ("1", "true") else "\n".join(_slide_paragraphs(tc)) for tc in tr.findall(f"{DRAW}tc")] for tr in table.findall(f"{DRAW}tr")]


def _placeholder(shape: ET.Element) -> str | None:
    ph = shape.find(f"{SLIDE}nvSpPr/{SLIDE}nvPr/{SLIDE}ph")
    return None if ph is None else ph.get("type", "body")


def pptx(content: bytes) -> dict:
    """Title, paragraphs, tables and notes of the slides in order."""
    pack = Package(content)
    links = pack.links("ppt/presentation.xml")
    slides = []
    for number, ref in enumerate(pack.xml("ppt/presentation.xml").iter(f"{SLIDE}sldId"), 1):
        part = links[ref.get(f"{REF}id")][1]
        title, paragraphs, tables = None, [], []
        for shape in pack.xml(part).iter(f"{SLIDE}sp"):
            text = [x for x in _slide_paragraphs(shape) if x]
            if _placeholder(shape) in ("title", "ctrTitle") and title is None:
                title = "\n".join(text)
            else:
                paragraphs += text
        tables = [{"rows": _slide_table(t)} for t in pack.xml(part).iter(f"{DRAW}tbl")]
        notes = [x for kind, to in pack.links(part).values() if kind == "notesSlide" for shape in pack.xml(to).iter(f"{SLIDE}sp") if _placeholder(shape) == "body" for x in _slide_paragraphs(shape)]
        slides.append({"number": number, "title": title, "paragraphs": paragraphs, "tables": tables, "notes": "\n".join(notes)})
    return {"format": "pptx", "slides": slides}


# --- sheets ----------------------------------------------------------------
def _number(text: str) -> int | float:
    return int(text) if text.lstrip("-").isdigit() else float(text)


def _cells(sheet: ET.Element, shared: list[str]) -> Iterator[dict]:
    for c in sheet.iter(f"{SHEET}c"):
        kind, v, f = c.get("t", "n"), c.find(f"{SHEET}v"), c.find(f"{SHEET}f")
        inline = c.find(f"{SHEET}is")
        text = v.text or "" if v is not None else None
        value, error = None, None
        if kind == "inlineStr" and inline is not None:
            value = _text(inline, f"{SHEET}t", {})
        elif text is None:
            if f is None:
                continue
        elif kind == "s":
            value = shared[int(text)]
        elif kind == "b":
            value = text == "1"
        elif kind == "e":
            error = text
        elif kind in ("str", "d"):
            value = text
        else:
            value = _number(text)
        yield {"address": c.get("r"), "value": value, "formula": f.text if f is not None else None, "error": error}


def xlsx(content: bytes) -> dict:
    """Present cells by sheet: stored values, formulas as text, dates as serial numbers, errors apart."""
    pack = Package(content)
    links = pack.links("xl/workbook.xml")
    shared = [_text(si, f"{SHEET}t", {}) for si in pack.xml("xl/sharedStrings.xml").findall(f"{SHEET}si")] if "xl/sharedStrings.xml" in pack.names else []
    sheets = [{"name": s.get("name"), "cells": list(_cells(pack.xml(links[s.get(f"{REF}id")][1]), shared))} for s in pack.xml("xl/workbook.xml").iter(f"{SHEET}sheet")]
    return {"format": "xlsx", "sheets": sheets}


READERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx}
