import io
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import pseudonymize
from sparkveil.plans.config import Config
from sparkveil.plans.office import apply_documents, scan_documents
from sparkveil.plans.scan import decisions_of
from sparkveil.sources import ooxml, ooxml_write, pages, tables

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def rels(*items):
    inner = "".join(f'<Relationship Id="{i}" Type="{REL}/{t}" Target="{x}"{" TargetMode=" + chr(34) + "External" + chr(34) if out else ""}/>' for i, t, x, out in items)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'


XLSX = {
    "xl/workbook.xml": f'<workbook {S} xmlns:r="{REL}"><sheets><sheet name="Main" sheetId="1" r:id="r1"/></sheets><definedNames><definedName name="N">"Geheim"</definedName></definedNames></workbook>',
    "xl/_rels/workbook.xml.rels": rels(("r1", "worksheet", "worksheets/sheet1.xml", False)),
    "xl/sharedStrings.xml": f"<sst {S}><si><t>Name</t></si><si><r><t>Hans </t></r><r><t>Meier</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Nr</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>12345</v></c><c r="C2"><v>12.5</v></c><c r="D2"><f>IF(A1="Frau ""X""";1)</f><v>1</v></c><c r="E2"><v>77</v></c></row></sheetData></worksheet>',
    "xl/worksheets/_rels/sheet1.xml.rels": rels(("c", "comments", "../comments1.xml", False), ("h", "hyperlink", "mailto:a@b.de", True)),
    "xl/comments1.xml": f'<comments {S}><commentList><comment ref="A2"><text><r><t>Ruf </t></r><r><t>an</t></r></text></comment></commentList></comments>',
}
DOCX = {
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:r><w:t>Hans </w:t></w:r><w:r><w:t>Meier</w:t><w:br/><w:t>Zeile</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Zelle</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:instrText>HYPERLINK "mailto:</w:instrText></w:r><w:r><w:instrText>x@y.de"</w:instrText></w:r></w:p></w:body></w:document>',
    "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>Kopf</w:t></w:r></w:p></w:hdr>",
    "word/comments.xml": f"<w:comments {W}><w:comment><w:p><w:r><w:t>Anmerkung</w:t></w:r></w:p></w:comment></w:comments>",
    "word/embeddings/in.xlsx": package(XLSX),
    "docProps/core.xml": '<cp:coreProperties xmlns:cp="urn:x" xmlns:dc="urn:y"><dc:creator>Hans</dc:creator></cp:coreProperties>',
}
PPTX = {
    "ppt/slides/slide1.xml": f"<p {A}><a:p><a:r><a:t>Kunde:</a:t></a:r><a:br/><a:r><a:t>Meier</a:t></a:r></a:p></p>",
    "ppt/notesSlides/notesSlide1.xml": f"<p {A}><a:p><a:r><a:t>Notiz</a:t></a:r></a:p></p>",
    "ppt/comments/comment1.xml": '<c xmlns="urn:c"><text>Bitte</text></c>',
    "ppt/charts/chart1.xml": f'<c:chart xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" {A}><a:t>Titel</a:t><c:v>42</c:v></c:chart>',
}


def test_documents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(package(DOCX))
    (tmp_path / "b.xlsx").write_bytes(package(XLSX))
    (tmp_path / "c.pptx").write_bytes(package(PPTX))
    got = {}
    for r in ooxml.read(spark, f"{tmp_path}/*").orderBy("doc_id", "unit_ord").collect():
        got.setdefault(r["doc_id"][-6:-5], []).append((r["kind"], r["text"], r["header"], r["col"], r["row"]))
    assert [(k, t) for k, t, *_ in got["a"]][:5] == [("paragraph", "Hans Meier\nZeile"), ("paragraph", "Zelle"), ("field_code", 'HYPERLINK "mailto:x@y.de"'), ("paragraph", "Anmerkung"), ("paragraph", "Kopf")]
    assert ("cell", "Hans Meier", "Name", "A", 2) in got["a"], "the embedded workbook"
    assert {(k, t) for k, t, *_ in got["b"]} == {("defined_name", '"Geheim"'), ("sheet_title", "Main"), ("cell", "Hans Meier"), ("cell", "12345"), ("formula_literal", 'Frau "X"'), ("comment", "Ruf an"), ("link", "mailto:a@b.de")}
    assert {(k, t) for k, t, *_ in got["c"]} == {("paragraph", "Kunde:\nMeier"), ("paragraph", "Notiz"), ("comment", "Bitte"), ("chart", "Titel"), ("chart", "42")}


def test_documents_that_must_fail(spark, tmp_path):
    for data, name in ((b"no zip", "x.docx"), (package({}), "x.xlsx"), (package({"word/document.xml": "<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>"}), "x.docx"), (package({"word/document.xml": "<a"}), "x.docx"), (b"", "x.pdf"), (b"", "x.doc")):
        with pytest.raises(ooxml.SourceError):
            list(ooxml.units_of(data, name))
    deep = package(DOCX)
    for _ in range(3):
        deep = package({"word/embeddings/in.docx": deep})
    with pytest.raises(ooxml.SourceError):
        list(ooxml.units_of(deep, "x.docx"))


def test_metadata_goes():
    clean = zipfile.ZipFile(io.BytesIO(ooxml.metadata_free(package(DOCX))))
    assert b"Hans" not in clean.read("docProps/core.xml") and b"Hans" in clean.read("word/document.xml")


def test_names_and_lists(spark, tmp_path):
    assert tables.output_name("/a/b.docx") == "/a/b_psd.docx" and tables.output_name("/a.b/c") == "/a.b/c_psd"
    (tmp_path / "names.txt").write_text("# list\nAnna\n\n Bo \n")
    assert tables.read_words(spark, f"{tmp_path}/names.txt") == ["anna", "bo"] and tables.read_words(spark, f"{tmp_path}/none.txt") == []
    assert [tables._letter(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_csv_log_and_report(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Name,Nr\nHans,1\nAnna,2\n")
    got = {(r["col"], r["row"], r["header"], r["text"]) for r in tables.read_csv(spark, f"{tmp_path}/t.csv").collect()}
    assert got == {("A", 2, "Name", "Hans"), ("B", 2, "Nr", "1"), ("A", 3, "Name", "Anna"), ("B", 3, "Nr", "2")}
    for e in ("one", "two", "three"):
        tables.log_event(spark, f"{tmp_path}/log", e)
    assert [r["event"] for r in tables.read_recent(spark, f"{tmp_path}/log", 2).collect()] == ["three", "two"]
    tables.write_report(spark.range(1), f"{tmp_path}/report", {"config": "abc", "verified": True})
    assert spark.read.json(f"{tmp_path}/report").first()["config"] == "abc"


def test_pages(spark):
    df = spark.createDataFrame([("a" * 30, 0.9, None), ("x", 0.1, None), ("x", 0.9, "read by OCR"), (None, None, None)], "t string, i double, o string")
    assert [r["p"] for r in df.select(pages.page_text(F.col("t"), F.col("i"), F.col("o")).alias("p")).collect()] == ["a" * 30, "x", "read by OCR", ""]
    bad = spark.createDataFrame([("x", 0.9, None)], "t string, i double, o string")
    with pytest.raises(Exception, match="was not read"):
        bad.select(pages.page_text(F.col("t"), F.col("i"), F.col("o"))).collect()
    boxes = spark.createDataFrame([([("a", 0.0, 0.0, 5.0, 5.0, 0, 3), ("b", 6.0, 0.0, 9.0, 5.0, 4, 7)],)], "b array<struct<text:string,x0:double,y0:double,x1:double,y1:double,start:int,end:int>>")
    assert [(r["x0"], r["x1"]) for r in boxes.select(pages.boxes_for_span(F.col("b"), F.lit(3), F.lit(5)).alias("h")).first()["h"]] == [(5.0, 10.0)]


def test_runs():
    runs = ["Hans ", "Mei", "er", " geht"]
    assert ooxml_write.spliced_runs(runs, [(5, 10, "[P]")]) == ["Hans ", "[P]", "", " geht"]
    assert ooxml_write.spliced_runs(runs, [(0, 10, "[P]"), (11, 15, "kommt")]) == ["[P]", "", "", " kommt"]
    assert ooxml_write.spliced_runs(["", "ab"], [(0, 1, "x")]) == ["", "xb"]
    for bad in ((3, 3), (-1, 2), (14, 17)):
        with pytest.raises(ooxml.SourceError):
            ooxml_write.spliced_runs(runs, [(*bad, "x")])


def test_references_follow_renamed_sheets():
    new = {"Hans Meier": "PERSON_1", "Data": "New Data", "It's": "X"}
    told = {
        "SUM('Hans Meier'!A1:B2)+Data!C3": "SUM(PERSON_1!A1:B2)+'New Data'!C3",
        'IF(A1="Data!A1";DATA!B1;Other!C1)': """IF(A1="Data!A1";'New Data'!B1;Other!C1)""",
        "'It''s'!A1+MyData!B2+'My Data'!B2": "X!A1+MyData!B2+'My Data'!B2",
        "SUM(Data:Other!A1)": "SUM('New Data:Other'!A1)",
    }
    for old, want in told.items():
        assert ooxml_write.rewrite_references(old, new) == want
    titles = ["Hans Meier", "PERSON_1", "Rest", "a" * 31]
    renames = ooxml_write.sheet_renames(titles, {"title:Hans Meier": [(0, 10, "[PERSON_1]")], "title:Rest": [(0, 4, "[Hans]")], f"title:{'a' * 31}": [(0, 1, "[PERSON_22]")]}, ["hans"])
    assert renames["Hans Meier"] == "PERSON_1_2" and renames["Rest"] == "Sheet_3" and len(renames["a" * 31]) <= 31


BOOK = XLSX | {
    "xl/workbook.xml": XLSX["xl/workbook.xml"].replace('name="Main"', 'name="Akte Meier"').replace('"Geheim"', "'Akte Meier'!A2"),
    "xl/worksheets/sheet1.xml": XLSX["xl/worksheets/sheet1.xml"].replace("IF(A1", "IF('Akte Meier'!A1").replace('""X""', '""Meier""'),
}


def units(data, path):
    return {u[0]: u[1] for u in ooxml.units_of(data, path)}


def test_rewritten_documents():
    book = ooxml_write.rewrite(package(BOOK), "b.xlsx", {"Akte Meier!A2": [(0, 10, "[P_1]")], "title:Akte Meier": [(5, 10, "[P_1]")], "Akte Meier!D2:s0": [(6, 11, "[P_1]")], "xl/worksheets/_rels/sheet1.xml.rels:h": [(7, 13, "[M_1]")], "Akte Meier!A2:comments": [(0, 6, "[C]")]}, ["Meier", "Hans Meier"])
    got = units(book, "b.xlsx")
    assert got["title:Akte P_1"] == "Akte P_1" and got["Akte P_1!A2"] == "[P_1]" and got["Akte P_1!D2:s0"] == 'Frau "[P_1]"' and got["name:N"] == "'Akte P_1'!A2"
    assert got["xl/worksheets/_rels/sheet1.xml.rels:h"] == "mailto:%5BM_1%5D" and got["Akte P_1!A2:comments"] == "[C]" and got["Akte P_1!B2"] == "12345"
    assert "meier" not in ooxml_write.text_of(book).lower()
    page = ooxml_write.rewrite(package(DOCX), "a.docx", {"document:p0": [(3, 13, "[P_1]")], "document:f2": [(18, 24, "[M_1]")], "word/embeddings/in.xlsx:Main!A2": [(0, 10, "[P_1]")]})
    got = units(page, "a.docx")
    assert got["document:p0"] == "Han[P_1]ile" and got["document:f2"] == 'HYPERLINK "mailto:[M_1]"' and got["word/embeddings/in.xlsx:Main!A2"] == "[P_1]"
    assert "hans" not in ooxml_write.text_of(page).lower(), "neither the texts nor the author"
    show = units(ooxml_write.rewrite(package(PPTX), "c.pptx", {"slide1:p0": [(0, 12, "[P_1]")], "comment1:c0": [(0, 5, "[Q]")], "ppt/charts/chart1.xml:t0": [(0, 5, "[R]")]}), "c.pptx")
    assert show["slide1:p0"] == "[P_1]" and show["comment1:c0"] == "[Q]" and show["ppt/charts/chart1.xml:t0"] == "[R]" and show["notesSlide1:p0"] == "Notiz"
    assert ooxml_write.residual(package(DOCX), "a.docx", ["Hans Meier", "Zelle", "nirgends", "ab"]) == ["hans meier", "zelle"]
    assert ooxml_write.residual(package(XLSX), "b.xlsx", ["name", "hans meier"]) == ["hans meier"], "headers are left alone"


def test_documents_from_end_to_end(spark, tmp_path):
    for name, parts in (("a.docx", DOCX), ("b.xlsx", BOOK), ("c.pptx", PPTX)):
        (tmp_path / name).write_bytes(package(parts))
    documents = ooxml.files(spark, f"{tmp_path}/*.*x")
    config = Config(deny=("Hans Meier", "Meier", "x@y.de", "a@b.de"))
    frames = scan_documents(documents, config)
    written, mapping = apply_documents(documents, frames, decisions_of(frames.groups), pseudonymize.Mapping.empty(spark), f"file://{tmp_path}/out", config)
    assert {r["written"].rpartition("/")[2] for r in written.collect()} == {"a_psd.docx", "b_psd.xlsx", "c_psd.pptx"}
    for name in ("a_psd.docx", "b_psd.xlsx", "c_psd.pptx"):
        said = ooxml_write.text_of((tmp_path / "out" / name).read_bytes()).lower()
        assert "meier" not in said and "x@y.de" not in said
    skipped = frames.groups.select("entity_type", "value_key", F.lit("skip").alias("action"))
    same, _ = apply_documents(documents, frames, skipped, pseudonymize.Mapping.empty(spark), f"file://{tmp_path}/out2", config)
    assert units((tmp_path / "out2" / "c_psd.pptx").read_bytes(), "c.pptx") == units(package(PPTX), "c.pptx")


def test_a_value_that_is_left_stops_the_output(spark, tmp_path, monkeypatch):
    (tmp_path / "a.docx").write_bytes(package(DOCX | {"customXml/item1.xml": "<a b='Hans Meier'/>"}))
    documents = ooxml.files(spark, f"{tmp_path}/a.docx")
    config = Config(deny=("Hans Meier",))
    frames = scan_documents(documents, config)
    with pytest.raises(Exception, match="still in the output"):
        apply_documents(documents, frames, decisions_of(frames.groups), pseudonymize.Mapping.empty(spark), f"file://{tmp_path}/out", config)
    assert not (tmp_path / "out").exists()
