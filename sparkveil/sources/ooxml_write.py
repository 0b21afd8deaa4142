"""Writing replacements back into documents (docx, xlsx, xlsm, pptx; PDF by `pdf`), and proof that nothing of a value is left.

Units are found again by their ids, in the order in which `ooxml` reads them. A replacement lands in the first run that its
span touches, with that run's looks; other runs lose what the span covers. Cells become inline texts, and shared strings that
no cell uses any more are emptied. Sheets with a name in their title get another title, and every reference follows.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ooxml import _READERS, A, C, OFFICE, R, S, SourceError, W, _rels, metadata_free, parse
from .tables import _letter, output_name

#: start, end and what is written there.
Change = tuple[int, int, str]
FILES = "path string, content binary"
_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
TITLE_LENGTH = 31


def spliced_runs(runs: list[str], changes: Iterable[Change]) -> list[str]:
    """The texts of runs after replacements of spans of the whole: each in the first run that its span touches.

    Spans must not overlap; a span outside the text is an error.
    """
    out, starts, at = list(runs), [], 0
    for run in runs:
        starts.append(at)
        at += len(run)
    for start, end, token in sorted(changes, reverse=True):  # from the right, so that places before stay
        if not 0 <= start < end <= at:
            raise SourceError(f"a span from {start} to {end} is outside a text of {at}")
        first = True
        for k, run in enumerate(runs):
            lo, hi = max(start - starts[k], 0), min(end - starts[k], len(run))
            if lo < hi:
                out[k] = out[k][:lo] + (token if first else "") + out[k][hi:]
                first = False
    return out


def spliced(text: str, changes: Iterable[Change]) -> str:
    return spliced_runs([text], changes)[0]


def _parents(root: ET.Element) -> dict[ET.Element, ET.Element]:
    return {child: parent for parent in root.iter() for child in parent}


def _put(e: ET.Element, text: str) -> None:
    e.text = text
    if text != text.strip() and e.tag in (f"{W}t", f"{S}t"):
        e.set(_SPACE, "preserve")


def _rewrite_paragraphs(root: ET.Element, tags: tuple[str, str, tuple[str, ...], str], prefix: str, changes: dict[str, list[Change]]) -> None:
    p, t, br, tab = tags
    parents, k = _parents(root), 0
    for para in list(root.iter(p)):
        inner = {x for q in para.iter(p) if q is not para for x in q.iter()}
        parts = [e for e in para.iter() if (e.tag == t or e.tag in br or e.tag == tab) and e not in inner]
        runs = ["\n" if e.tag in br else "\t" if e.tag == tab else e.text or "" for e in parts]
        if not "".join(runs).strip():
            continue
        if told := changes.get(f"{prefix}:p{k}"):
            for e, old, new in zip(parts, runs, spliced_runs(runs, told), strict=True):
                if e.tag == t:
                    _put(e, new)
                elif new != old:  # a break or tab within a span: gone, and what stands for the span goes on as text
                    holder = parents[e]
                    if new:
                        said = ET.Element(t)
                        _put(said, new)
                        holder.insert(list(holder).index(e), said)
                    holder.remove(e)
        k += 1


def _drop_fallbacks(root: ET.Element) -> None:
    """The older form of a text box repeats its text, which only the newer form was changed in."""
    for box in [e for e in root.iter() if e.tag.endswith("}AlternateContent")]:
        for child in [c for c in box if c.tag.endswith("}Fallback")]:
            box.remove(child)


def _docx_part(name: str, root: ET.Element, changes: dict[str, list[Change]]) -> None:
    part = posixpath.basename(name)[:-4]
    _drop_fallbacks(root)
    for k, para in enumerate(list(root.iter(f"{W}p"))):
        if told := changes.get(f"{part}:f{k}"):
            codes = list(para.iter(f"{W}instrText"))
            simple = list(para.iter(f"{W}fldSimple"))
            runs = spliced_runs([e.text or "" for e in codes] + [e.get(f"{W}instr", "") for e in simple], told)
            for e, new in zip(codes, runs, strict=False):
                e.text = new
            for e, new in zip(simple, runs[len(codes) :], strict=True):
                e.set(f"{W}instr", new)
    _rewrite_paragraphs(root, (f"{W}p", f"{W}t", (f"{W}br", f"{W}cr"), f"{W}tab"), part, changes)


def _pptx_part(name: str, root: ET.Element, changes: dict[str, list[Change]]) -> None:
    part = posixpath.basename(name)[:-4]
    if name.startswith("ppt/comments/"):
        for k, e in enumerate(e for e in root.iter() if e.tag.rpartition("}")[2] == "text" or e.tag == f"{A}t"):
            if told := changes.get(f"{part}:c{k}"):
                e.text = spliced(e.text or "", told)
        return
    _rewrite_paragraphs(root, (f"{A}p", f"{A}t", (f"{A}br",), ""), part, changes)


# --- workbooks --------------------------------------------------------------------------------------------------------

_REFERENCE = re.compile(r"\"(?:[^\"]|\"\")*\"|'((?:[^']|'')+)'!|(?<![\w.'])([\w.]+(?::[\w.]+)?)!")


def rewrite_references(expression: str, renames: dict[str, str]) -> str:
    """An expression in which sheets go by their new titles; texts in quotes stay."""
    new = {k.lower(): v for k, v in renames.items()}

    def one(m: re.Match) -> str:
        if m[0].startswith('"'):
            return m[0]
        named = (m[1].replace("''", "'") if m[1] else m[2]).split(":")
        if not any(part.lower() in new for part in named):
            return m[0]
        title = ":".join(new.get(part.lower(), part) for part in named)
        return f"{title}!" if re.fullmatch(r"[A-Za-z_]\w*", title) and not re.fullmatch(r"[A-Za-z]{1,3}\d+", title) else "'" + title.replace("'", "''") + "'!"

    return _REFERENCE.sub(one, expression)


def sheet_renames(titles: list[str], changes: dict[str, list[Change]], removed: Iterable[str] = ()) -> dict[str, str]:
    """New titles of the sheets whose title holds a finding: valid, of their own, and without any removed value."""
    gone = [v.lower() for v in removed if v.strip()]
    out: dict[str, str] = {}
    taken = {t.lower() for t in titles}
    for k, title in enumerate(titles):
        told = changes.get(f"title:{title}")
        if not told:
            continue
        base = re.sub(r"[\[\]:*?/\\]", "", spliced(title, told)).strip("' ")[:TITLE_LENGTH]
        if not base or any(v in base.lower() for v in gone):
            base = f"Sheet_{k + 1}"
        name, n = base, 1
        while name.lower() in taken:
            n += 1
            name = f"{base[: TITLE_LENGTH - len(str(n)) - 1]}_{n}"
        taken.add(name.lower())
        out[title] = name
    return out


def _literals(formula: str, unit: str, changes: dict[str, list[Change]]) -> str:
    """A formula with replacements in its quoted texts."""
    count = -1

    def one(m: re.Match) -> str:
        nonlocal count
        count += 1
        told = changes.get(f"{unit}:s{count}")
        return '"' + spliced(m[1].replace('""', '"'), told).replace('"', '""') + '"' if told else m[0]

    return re.sub(r'"((?:[^"]|"")*)"', one, formula)


def _sheet(root: ET.Element, title: str, shared: list[str], changes: dict[str, list[Change]], renames: dict[str, str]) -> set[int]:
    """Change a sheet's cells; the shared strings that it still uses."""
    used: set[int] = set()
    for row in root.iter(f"{S}row"):
        for k, cell in enumerate(row.findall(f"{S}c")):
            place = cell.get("r") or f"{_letter(k)}{row.get('r')}"
            unit, formula = f"{title}!{place}", cell.find(f"{S}f")
            if formula is not None and formula.text:
                new = rewrite_references(_literals(formula.text, unit, changes), renames)
                if new != formula.text:
                    formula.text = new
                    for v in cell.findall(f"{S}v"):  # what was worked out from the old formula
                        cell.remove(v)
                continue
            told = changes.get(unit)
            if told:
                kind, v = cell.get("t"), cell.find(f"{S}v")
                if kind == "inlineStr":
                    old = "".join(t.text or "" for t in cell.iter(f"{S}t"))
                elif kind == "s":
                    old = shared[int(v.text)]
                elif kind in ("str", "d"):
                    old = v.text
                else:
                    old = str(int(float(v.text)))
                for child in list(cell):
                    cell.remove(child)
                cell.set("t", "inlineStr")
                _put(ET.SubElement(ET.SubElement(cell, f"{S}is"), f"{S}t"), spliced(old, told))
            elif cell.get("t") == "s" and cell.find(f"{S}v") is not None:
                used.add(int(cell.find(f"{S}v").text))
    for e in root.iter():
        if e.tag == f"{S}hyperlink" and e.get("location"):
            e.set("location", rewrite_references(e.get("location"), renames))
        elif e.tag in (f"{S}formula1", f"{S}formula2", f"{S}formula") and e.text:  # of conditions and validations
            e.text = rewrite_references(e.text, renames)
    return used


def _xlsx(z: zipfile.ZipFile, changes: dict[str, list[Change]], removed: Iterable[str]) -> dict[str, ET.Element]:
    """The parts of a workbook that change."""
    out: dict[str, ET.Element] = {}
    table = parse(z.read("xl/sharedStrings.xml")) if "xl/sharedStrings.xml" in z.namelist() else None
    items = [] if table is None else table.findall(f"{S}si")
    shared = ["".join(t.text or "" for r in (si, *si.findall(f"{S}r")) for t in r.findall(f"{S}t")) for si in items]
    book, rels = parse(z.read("xl/workbook.xml")), _rels(z, "xl/workbook.xml")
    sheets = [(e, e.get("name"), rels[e.get(f"{OFFICE}id")][1]) for e in book.iter(f"{S}sheet")]
    renames = sheet_renames([t for _, t, _ in sheets], changes, removed)
    used: set[int] = set()
    for e, title, part in sheets:
        root = parse(z.read(part))
        used |= _sheet(root, title, shared, changes, renames)
        out[part] = root
        e.set("name", renames.get(title, title))
        for kind, target, outside in _rels(z, part).values():
            if kind in ("comments", "threadedComment") and not outside:
                notes = out.get(target, parse(z.read(target)))
                for note in notes.iter():
                    if note.tag.rpartition("}")[2] in ("comment", "threadedComment") and (told := changes.get(f"{title}!{note.get('ref')}:{kind}")):
                        texts = [t for t in note.iter() if t.tag.rpartition("}")[2] in ("t", "text") and (t.text or not len(t))]
                        for t, new in zip(texts, spliced_runs([t.text or "" for t in texts], told), strict=True):
                            t.text = new
                out[target] = notes
    for e in book.iter(f"{S}definedName"):
        e.text = rewrite_references(spliced(e.text or "", changes.get(f"name:{e.get('name')}", ())), renames)
    out["xl/workbook.xml"] = book
    if table is not None:
        for k, si in enumerate(items):
            if k not in used:  # its cells were replaced; the place stays, as others are counted from it
                for child in list(si):
                    si.remove(child)
                ET.SubElement(si, f"{S}t")
        out["xl/sharedStrings.xml"] = table
    if renames:
        for name in z.namelist():
            if re.search(r"/charts/chart\d*\.xml$|/pivotCache/pivotCacheDefinition\d*\.xml$", name):
                root = parse(z.read(name))
                for e in root.iter():
                    if e.tag == f"{C}f" and e.text:
                        e.text = rewrite_references(e.text, renames)
                    elif e.tag == f"{S}worksheetSource" and e.get("sheet"):
                        e.set("sheet", renames.get(e.get("sheet"), e.get("sheet")))
                out[name] = root
            elif name == "docProps/app.xml":
                root = parse(z.read(name))
                for e in root.iter():
                    if e.text in renames:
                        e.text = renames[e.text]
                out[name] = root
    return out


# --- packages ---------------------------------------------------------------------------------------------------------


def rewrite(data: bytes, path: str, changes: dict[str, list[Change]], removed: Iterable[str] = (), depth: int = 2) -> bytes:
    """A document with replacements (unit_id -> spans) and without the properties that name its author."""
    end = path.rpartition(".")[2].lower()
    if end == "pdf":
        from . import pdf

        return pdf.rewrite(data, changes)
    if end not in _READERS:
        raise SourceError(f"no writer for {end} files")
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        parts = _xlsx(z, changes, removed) if end in ("xlsx", "xlsm") else {}
        for name in z.namelist():
            if name in parts:
                root = parts[name]
            elif end == "docx" and re.fullmatch(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", name):
                _docx_part(name, root := parse(z.read(name)), changes)
            elif end == "pptx" and re.fullmatch(r"ppt/(slides/slide|notesSlides/notesSlide)\d+\.xml|ppt/comments/.*\.xml", name):
                _pptx_part(name, root := parse(z.read(name)), changes)
            else:
                root = None
            if name.endswith(".rels"):
                root = parse(z.read(name))
                for e in root.iter(f"{R}Relationship"):
                    if told := changes.get(f"{name}:{e.get('Id')}"):
                        e.set("Target", _link(e.get("Target", ""), spliced(e.get("Target", ""), told)))
            elif re.search(r"/charts/chart\d*\.xml$", name):
                root = parse(z.read(name)) if root is None else root
                for k, e in enumerate(e for e in root.iter() if e.tag in (f"{A}t", f"{C}v")):
                    if told := changes.get(f"{name}:t{k}"):
                        e.text = spliced(e.text or "", told)
            if root is not None:
                content = ET.tostring(root, xml_declaration=True, encoding="UTF-8")
            else:
                content = z.read(name)
                if "/embeddings/" in name and name.rpartition(".")[2] in _READERS:
                    if depth == 0:
                        raise SourceError("packages are embedded too deeply")
                    inner = {u.removeprefix(f"{name}:"): c for u, c in changes.items() if u.startswith(f"{name}:")}
                    content = rewrite(content, name, inner, removed, depth - 1)
            w.writestr(name, content)
    return metadata_free(out.getvalue())


def _link(old: str, new: str) -> str:
    """A link target that stays one: its scheme is kept, brackets are escaped."""
    scheme = re.match(r"[A-Za-z][A-Za-z0-9+.-]*:(?://)?", old)
    bare = new.replace("[", "%5B").replace("]", "%5D")
    return scheme[0] + bare if scheme and not bare.startswith(scheme[0]) else bare


#: Parts that hold no text of a user.
_PLUMBING = re.compile(r"\[Content_Types\]\.xml$|(?:^|/)(?:theme/|styles\.xml$|settings\.xml$|webSettings\.xml$|fontTable\.xml$|numbering\.xml$|calcChain\.xml$|presProps\.xml$|viewProps\.xml$|tableStyles\.xml$|printerSettings)")
_RSID = re.compile(r"(?:^|\})(?:rsid\w*|paraId|textId)$", re.I)


def text_of(data: bytes, depth: int = 2) -> str:
    """All texts and attribute values of a package, values apart by line ends, and those of embedded packages."""
    said: list[str] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for name in z.namelist():
            if "/embeddings/" in name and name.rpartition(".")[2] in _READERS:
                if depth == 0:
                    raise SourceError("packages are embedded too deeply")
                said.append(text_of(z.read(name), depth - 1))
            elif name.endswith((".xml", ".rels")) and not _PLUMBING.search(name):
                root = parse(z.read(name))
                for para in root.iter():
                    if para.tag in (f"{W}p", f"{A}p", f"{S}si", f"{S}is", f"{S}text"):  # a value may be spread over runs
                        said.append("".join(e.text or "" for e in para.iter() if e.tag.rpartition("}")[2] in ("t", "instrText")))
                for e in root.iter():
                    said.append(e.text or "")
                    said.append(e.tail or "")
                    said += [v for k, v in e.attrib.items() if not _RSID.search(k)]
    return "\n".join(s for s in said if s.strip())


def _all_text(data: bytes, path: str) -> str:
    """All texts of a document by its extension."""
    if path.rpartition(".")[2].lower() == "pdf":
        from . import pdf

        return "\n".join(f"{u[2] or ''}\n{u[1]}" for u in pdf.units_of(data))
    return text_of(data)


def column_headers(data: bytes, path: str) -> set[str]:
    """The texts of the first row of each sheet, which verification leaves alone."""
    if path.rpartition(".")[2].lower() not in ("xlsx", "xlsm"):
        return set()
    out: set[str] = set()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for _, _, header, _, _, _, kind in _READERS["xlsx"](z):
            if kind == "cell" and header:
                out.add(header)
    return out


def residual(data: bytes, path: str, removed: Iterable[str], always: Iterable[str] = (), least: int = 4) -> list[str]:
    """Removed values (of four characters or more, or always checked) that a written document still holds, without case."""
    from ..operators.pseudonymize import TOKEN

    forced = {v.lower() for v in always}
    exempt = {h.strip().lower() for h in column_headers(data, path)} - forced
    blob = _all_text(data, path).lower()
    # a token that merely contains a value is no trace of it
    bare = re.sub(TOKEN, lambda m: m[0] if m[0][1:-1] in wanted else "\0", blob, flags=re.I) if (wanted := {v.strip().lower() for v in removed}) else blob
    flat = re.sub(r"[ \t]+", "", bare)
    return sorted(v for v in wanted if v and (len(v) >= least or v in forced) and v not in exempt and (v in bare or re.sub(r"\s+", "", v) in flat))


def rewritten(files: DataFrame, changes: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """path, content of changed documents. files: path, content; changes: doc_id, unit_id, start, end, token; removed: doc_id, value.

    A document's changes are gathered with it, as it is written as a whole in one task.
    """
    spans = changes.groupBy("doc_id").agg(F.collect_list(F.struct("unit_id", "start", "end", "token")).alias("_spans"))
    gone = (removed if removed is not None else changes.select("doc_id", F.lit("").alias("value")).limit(0)).groupBy("doc_id").agg(F.collect_set("value").alias("_gone"))
    joined = files.join(spans, files["path"] == spans["doc_id"], "left").drop("doc_id").join(gone, files["path"] == gone["doc_id"], "left").drop("doc_id")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for path, data, told, away in zip(batch["path"], batch["content"], batch["_spans"], batch["_gone"], strict=True):
                units: dict[str, list[Change]] = {}
                for s in told if told is not None else ():
                    units.setdefault(s["unit_id"], []).append((s["start"], s["end"], s["token"]))
                done.append((path, rewrite(data, path, units, list(away) if away is not None else ())))
            yield pd.DataFrame(done, columns=["path", "content"])

    return joined.select("path", "content", "_spans", "_gone").mapInPandas(write, FILES)


def residuals(files: DataFrame, removed: DataFrame, always: Iterable[str] = ()) -> DataFrame:
    """path, value of removed values (doc_id, value) that documents (path, content) still hold."""
    gone = removed.groupBy("doc_id").agg(F.collect_set("value").alias("_gone"))
    joined = files.join(gone, files["path"] == gone["doc_id"]).select("path", "content", "_gone")
    forced = tuple(always)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, v) for p, d, g in zip(batch["path"], batch["content"], batch["_gone"], strict=True) for v in residual(d, p, list(g), forced)], columns=["path", "value"])

    return joined.mapInPandas(search, "path string, value string")


def save(files: DataFrame, folder: str, name: Callable[[str], str] = output_name) -> DataFrame:
    """Write documents (path, content) into a folder (a URI that driver and executors share) under their new names; path, written."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        for batch in batches:
            done = []
            for path, data in zip(batch["path"], batch["content"], strict=True):
                target = f"{at}/{posixpath.basename(name(path))}"
                with store.open_output_stream(target) as out:
                    out.write(data)
                done.append((path, target))
            yield pd.DataFrame(done, columns=["path", "written"])

    return files.mapInPandas(write, "path string, written string")
