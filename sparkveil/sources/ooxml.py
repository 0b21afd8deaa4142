"""Documents as units by their extension: Office documents (docx, xlsx, xlsm, pptx), read from bytes with zip and XML alone, and PDF.

Files are read by Spark's binaryFile source and unpacked in Python, a document at a time: a document is a few megabytes
and has to be parsed as a whole. Anything that cannot be read raises; a document is never skipped in silence.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.parsers import expat
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .tables import UNIT, _letter, output_name  # noqa: F401  output_name: part of this module's surface

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/package/2006/relationships}"
OFFICE = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
C = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"


class SourceError(ValueError):
    """A document that cannot be read completely."""


def parse(data: bytes) -> ET.Element:
    """XML without document type declarations, and so without entities of its own."""
    guard = expat.ParserCreate()

    def refuse(*_):
        raise SourceError("a part declares a document type")

    guard.StartDoctypeDeclHandler = refuse
    try:
        guard.Parse(data, True)
        return ET.fromstring(data)
    except (expat.ExpatError, ET.ParseError) as e:
        raise SourceError(f"a part is no XML: {e}") from e


def _paragraphs(root: ET.Element, p: str, t: str, br: tuple[str, ...], tab: str) -> Iterator[str]:
    for para in root.iter(p):
        inner = {x for q in para.iter(p) if q is not para for x in q.iter()}  # text boxes hold paragraphs of their own
        said = "".join("\n" if e.tag in br else "\t" if e.tag == tab else e.text or "" for e in para.iter() if (e.tag == t or e.tag in br or e.tag == tab) and e not in inner)
        if said.strip():
            yield said


def _docx(z: zipfile.ZipFile) -> Iterator[tuple]:
    names = sorted(n for n in z.namelist() if re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", n))
    names.sort(key=lambda n: n != "word/document.xml")
    for name in names:
        root = parse(z.read(name))
        for fallback in [e for e in root.iter() if e.tag.endswith("}AlternateContent")]:
            for child in [c for c in fallback if c.tag.endswith("}Fallback")]:
                fallback.remove(child)  # the same text box again, in an older form
        part = posixpath.basename(name)[:-4]
        for k, said in enumerate(_paragraphs(root, f"{W}p", f"{W}t", (f"{W}br", f"{W}cr"), f"{W}tab")):
            yield f"{part}:p{k}", said, None, None, None, None, "paragraph"
        for k, para in enumerate(root.iter(f"{W}p")):
            code = "".join(e.text or "" for e in para.iter(f"{W}instrText")) + "".join(e.get(f"{W}instr", "") for e in para.iter(f"{W}fldSimple"))
            if code.strip():
                yield f"{part}:f{k}", code, None, None, None, None, "field_code"


def _pptx(z: zipfile.ZipFile) -> Iterator[tuple]:
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/(slides/slide|notesSlides/notesSlide)\d+\.xml", n)), key=lambda n: (number(n), n.startswith("ppt/notes")))
    for name in slides:
        part = posixpath.basename(name)[:-4]
        for k, said in enumerate(_paragraphs(parse(z.read(name)), f"{A}p", f"{A}t", (f"{A}br",), "")):
            yield f"{part}:p{k}", said, None, None, None, None, "paragraph"
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"ppt/comments/.*\.xml", n)):
        root = parse(z.read(name))
        for k, e in enumerate(e for e in root.iter() if e.tag.rpartition("}")[2] == "text" or e.tag == f"{A}t"):
            if (e.text or "").strip():
                yield f"{posixpath.basename(name)[:-4]}:c{k}", e.text, None, None, None, None, "comment"


def _rels(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str, bool]]:
    """Of a part's relationships: kind, target and whether it is outside the package."""
    name = posixpath.join(posixpath.dirname(part), "_rels", posixpath.basename(part) + ".rels")
    if name not in z.namelist():
        return {}
    out = {}
    for e in parse(z.read(name)).iter(f"{R}Relationship"):
        outside = e.get("TargetMode") == "External"
        target = e.get("Target", "")
        out[e.get("Id")] = (e.get("Type", "").rpartition("/")[2], target if outside else posixpath.normpath(posixpath.join(posixpath.dirname(part), target)).lstrip("/") if not target.startswith("/") else target[1:], outside)
    return out


def _cell_value(cell: ET.Element, shared: list[str]) -> str | None:
    kind, v = cell.get("t"), cell.find(f"{S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{S}t"))
    if v is None or v.text is None or kind in ("b", "e"):
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind in ("str", "d"):
        return v.text
    number = float(v.text)
    return str(int(number)) if number == int(number) and len(str(abs(int(number)))) >= 5 else None


def _xlsx(z: zipfile.ZipFile) -> Iterator[tuple]:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for r in (si, *si.findall(f"{S}r")) for t in r.findall(f"{S}t")) for si in parse(z.read("xl/sharedStrings.xml")).findall(f"{S}si")]
    book, rels = parse(z.read("xl/workbook.xml")), _rels(z, "xl/workbook.xml")
    for e in book.iter(f"{S}definedName"):
        if (e.text or "").strip():
            yield f"name:{e.get('name')}", e.text, None, None, None, None, "defined_name"
    for sheet in book.iter(f"{S}sheet"):
        title, part = sheet.get("name"), rels[sheet.get(f"{OFFICE}id")][1]
        yield f"title:{title}", title, None, title, None, None, "sheet_title"
        headers: dict[str, str] = {}
        for row in parse(z.read(part)).iter(f"{S}row"):
            for k, cell in enumerate(row.findall(f"{S}c")):
                found = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r") or f"{_letter(k)}{row.get('r')}")
                col, line = found[1], int(found[2])
                formula = cell.find(f"{S}f")
                if formula is not None and formula.text:
                    for j, m in enumerate(re.finditer(r'"((?:[^"]|"")*)"', formula.text)):
                        if m[1].strip():
                            yield f"{title}!{col}{line}:s{j}", m[1].replace('""', '"'), headers.get(col), title, col, line, "formula_literal"
                    continue
                value = _cell_value(cell, shared)
                if line == 1:
                    headers[col] = value or ""
                elif value and value.strip():
                    yield f"{title}!{col}{line}", value, headers.get(col), title, col, line, "cell"
        for kind, target, outside in _rels(z, part).values():
            if kind in ("comments", "threadedComment") and not outside:
                root = parse(z.read(target))
                for e in root.iter():
                    if e.tag.rpartition("}")[2] in ("comment", "threadedComment"):
                        said = "".join(t.text or "" for t in e.iter() if t.tag.rpartition("}")[2] in ("t", "text"))
                        if said.strip():
                            yield f"{title}!{e.get('ref')}:{kind}", said, None, title, None, None, "comment"


def _aux(z: zipfile.ZipFile, depth: int) -> Iterator[tuple]:
    """Link targets, chart texts and embedded packages."""
    for name in sorted(z.namelist()):
        if name.endswith(".rels"):
            for e in parse(z.read(name)).iter(f"{R}Relationship"):
                if e.get("TargetMode") == "External" and e.get("Type", "").endswith("/hyperlink"):
                    yield f"{name}:{e.get('Id')}", e.get("Target", ""), None, None, None, None, "link"
        elif re.search(r"/charts/chart\d*\.xml$", name):
            root = parse(z.read(name))
            for k, e in enumerate(e for e in root.iter() if e.tag in (f"{A}t", f"{C}v")):
                if (e.text or "").strip():
                    yield f"{name}:t{k}", e.text, None, None, None, None, "chart"
        elif "/embeddings/" in name and name.rpartition(".")[2] in _READERS:
            if depth == 0:
                raise SourceError("packages are embedded too deeply")
            for unit, *rest in units_of(z.read(name), name, depth - 1):
                yield f"{name}:{unit}", *rest


_READERS = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "xlsm": _xlsx}
UNSUPPORTED = {"doc", "xls", "ppt"}


def units_of(data: bytes, path: str, depth: int = 2) -> Iterator[tuple]:
    """unit_id, text, header, sheet, col, row, kind of a document's parts, in order."""
    end = path.rpartition(".")[2].lower()
    if end == "pdf":
        from . import pdf

        yield from pdf.units_of(data)
        return
    if end not in _READERS:
        raise SourceError(f"no reader for {end} files" + (": convert them first" if end in UNSUPPORTED else ""))
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            yield from _READERS[end](z)
            yield from _aux(z, depth)
    except (zipfile.BadZipFile, KeyError, IndexError) as e:
        raise SourceError(f"{path} is damaged: {e}") from e


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all files that a path (with wildcards) names."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def unpack(documents: DataFrame) -> DataFrame:
    """Units of documents (path, content). One of another kind, or a damaged one, fails the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [f.split()[0] for f in UNIT.split(", ")]
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, u[0], k, *u[1:]) for k, u in enumerate(units_of(data, name))]
                yield pd.DataFrame(rows, columns=columns).astype({"row": "Int64"})

    return documents.select("path", "content").mapInPandas(run, UNIT)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Units of all documents that a path (with wildcards) names."""
    return unpack(files(spark, path))


def metadata_free(data: bytes) -> bytes:
    """An Office package without author, company, title and custom properties."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for name in z.namelist():
            content = z.read(name)
            if name in ("docProps/core.xml", "docProps/app.xml", "docProps/custom.xml"):
                root = parse(content)
                for e in list(root) if name == "docProps/custom.xml" else root.iter():
                    if name == "docProps/custom.xml":
                        root.remove(e)
                    elif e.tag.rpartition("}")[2] in ("creator", "lastModifiedBy", "title", "subject", "description", "keywords", "category", "contentStatus", "Company", "Manager", "HyperlinkBase"):
                        e.text = ""
                content = ET.tostring(root, xml_declaration=True, encoding="UTF-8")
            w.writestr(name, content)
    return out.getvalue()
