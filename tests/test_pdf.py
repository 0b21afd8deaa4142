import zlib

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import pseudonymize
from sparkveil.plans.config import Config
from sparkveil.plans.office import apply_documents, scan_documents
from sparkveil.plans.scan import decisions_of
from sparkveil.sources import ooxml, ooxml_write, pages, pdf

CONTENT = b"""BT /F1 12 Tf 72 700 Td (Kunde: Hans) Tj ( Mei) Tj [(e) -20 (r)] TJ 0 -20 Td (Stra\\337e 5) Tj T* ET
BT /F2 10 Tf 1 0 0 1 72 600 Tm <00010002> Tj 100 0 Td <0003> Tj ET
q 1 0 0 1 0 -50 cm /X1 Do Q"""
CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <00C4> endbfchar 1 beginbfrange <0002> <0003> <0062> endbfrange"


def stream(head, body, packed=True):
    data = zlib.compress(body) if packed else body
    return f"<< {head} /Length {len(data)} {'/Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + data + b"\nendstream"


def build(objects, trailer="/Root 1 0 R"):
    out = b"%PDF-1.7\n"
    for number, body in objects.items():
        out += f"{number} 0 obj\n".encode() + (body if isinstance(body, bytes) else body.encode()) + b"\nendobj\n"
    return out + f"trailer << {trailer} >>\n%%EOF".encode()


OBJECTS = {
    1: "<< /Type /Catalog /Pages 2 0 R /AcroForm << /Fields [12 0 R] >> >>",
    2: "<< /Type /Pages /Kids [3 0 R 4 0 R] /MediaBox [0 0 600 800] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> /XObject << /X1 9 0 R /Im 10 0 R >> >> >>",
    3: "<< /Type /Page /Parent 2 0 R /Contents [7 0 R] /Annots [11 0 R 12 0 R 13 0 R] >>",
    4: "<< /Type /Page /Parent 2 0 R /Contents 14 0 R >>",
    5: "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 32 /Widths [" + "500 " * 200 + "] >>",
    6: "<< /Type /Font /Subtype /Type0 /DescendantFonts [<< /DW 600 >>] /ToUnicode 8 0 R >>",
    7: stream("", CONTENT),
    8: stream("", CMAP),
    9: stream("/Type /XObject /Subtype /Form", b"BT /F1 12 Tf 72 300 Td (In einer Form) Tj ET"),
    10: stream("/Type /XObject /Subtype /Image /Width 1 /Height 1", b"\0", False),
    11: "<< /Subtype /Link /A << /URI (mailto:a@b.de) >> >>",
    12: "<< /Subtype /Widget /T (Name) /V <FEFF004A00F6> >>",
    13: "<< /Subtype /Text /Contents (Anmerkung \\(1\\)) >>",
    14: stream("", b"BT /F1 12 Tf 14 TL 72 700 Td (Zweite Seite mit genug Text darauf) Tj (und noch eine Zeile) ' ET"),
}


def test_units():
    got = list(pdf.units_of(build(OBJECTS)))
    assert [(u[0], u[1], u[2], u[6]) for u in got] == [
        ("page1", "Kunde: Hans Meier\nStraße 5\nÄb c\nIn einer Form", None, "page"), ("page1:field0", "Jö", "Name", "field"), ("page1:note0", "Anmerkung (1)", None, "note"), ("page1:link0", "mailto:a@b.de", None, "link"),
        ("page2", "Zweite Seite mit genug Text darauf\nund noch eine Zeile", None, "page"),
    ]


def test_packed_objects_and_changed_ones():
    inner = {n: b for n, b in OBJECTS.items() if isinstance(b, str)}
    heads, body = [], ""
    for n, b in inner.items():
        heads.append(f"{n} {len(body)}")
        body += b + " "
    head = " ".join(heads) + " "
    packed = {n: b for n, b in OBJECTS.items() if not isinstance(b, str)} | {20: stream(f"/Type /ObjStm /N {len(inner)} /First {len(head)}", (head + body).encode())}
    assert [u[1] for u in pdf.units_of(build(packed))] == [u[1] for u in pdf.units_of(build(OBJECTS))]
    changed = build(OBJECTS) + b"\n14 0 obj\n" + stream("", b"BT /F1 12 Tf 72 700 Td (Eine neue Fassung der Seite) Tj ET") + b"\nendobj\n"
    assert list(pdf.units_of(changed))[-1][1] == "Eine neue Fassung der Seite"


def test_what_cannot_be_read_raises():
    picture = OBJECTS | {14: stream("", b"q 500 0 0 700 0 0 cm /Im Do Q")}
    bad = {
        "no file": b"", "no PDF": b"hello", "encrypted": build(OBJECTS, "/Root 1 0 R /Encrypt 99 0 R"), "no catalogue": build({3: "<< >>"}), "damaged": build(OBJECTS | {7: b"<< /Length 3 /Filter /FlateDecode >>\nstream\nabc\nendstream"}),
        "packed otherwise": build(OBJECTS | {7: b"<< /Length 3 /Filter /LZWDecode >>\nstream\nabc\nendstream"}), "codes without characters": build(OBJECTS | {8: stream("", b"")}), "a picture": build(picture),
        "round": build({1: "<< /Type /Catalog /Pages 2 0 R >>", 2: "<< /Kids [2 0 R] >>"}),
    }
    for why, data in bad.items():
        with pytest.raises(ooxml.SourceError):
            list(pdf.units_of(data))
            print(why)

    class Reader:
        def words(self, image):
            return [{"text": "Gelesener"}, {"text": "Text"}]

    assert list(pdf.units_of(build(picture), Reader()))[-1][1] == "Gelesener Text"


def test_spans_to_boxes(spark):
    (page, _) = pdf.pages_of(build(OBJECTS))
    boxes = [(w.text, w.x0, w.y0, w.x1, w.y1, w.start, w.end) for w in page.words]
    df = spark.createDataFrame([(boxes, page.text)], "b array<struct<text:string,x0:double,y0:double,x1:double,y1:double,start:int,end:int>>, t string")
    at = F.position(F.lit("Hans Meier"), F.col("t")) - 1
    found = df.select(pages.boxes_for_span(F.col("b"), at, at + 10, 0.0).alias("h")).first()["h"]
    assert [(round(r["x0"]), round(r["y0"]), round(r["y1"])) for r in found] == [(114, 700, 712), (144, 700, 712)]


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(build(OBJECTS))
    assert {r["unit_id"] for r in ooxml.read(spark, f"{tmp_path}/*.pdf").collect()} == {"page1", "page1:field0", "page1:note0", "page1:link0", "page2"}


def test_rewritten():
    text = pdf.pages_of(build(OBJECTS))[0].text
    at = text.index("Hans Meier")
    copy = pdf.rewrite(build(OBJECTS), {"page1": [(at, at + 10, "[PERSON_1]"), (text.index("5"), text.index("5") + 1, "[N]")], "page1:field0": [(0, 2, "[F]")], "page1:link0": [(7, 13, "[M]")]})
    got = {u[0]: u[1] for u in pdf.units_of(copy)}
    assert got["page1"].split() == "Kunde: [PERSON_1] Straße [N] Äb c In einer Form".split()
    assert got["page2"].split() == "Zweite Seite mit genug Text darauf und noch eine Zeile".split()
    assert got["page3"].splitlines() == ["Name: [F]", "Anmerkung (1)", "mailto:[M]"]
    assert b"Hans" not in copy and not any(x in "".join(got.values()) for x in ("Hans", "Meier", "a@b.de", "Jö"))
    inside = pdf.rewrite(build(OBJECTS), {"page1": [(at - 2, at + 7, "[P]")]})  # from within one word into another
    assert pdf.pages_of(inside)[0].text.split()[:2] == ["Kunde[P]", "ier"]
    odd = pdf.rewrite(build(OBJECTS | {14: stream("", b"BT /F2 10 Tf 72 600 Td <0001> Tj ET BT /F1 9 Tf 90 600 Td (a\\\\\\(b) Tj ET")}), {})
    assert pdf.pages_of(odd)[1].text == "Ä a\\(b"
    with pytest.raises(ooxml.SourceError):
        pdf.rewrite(build(OBJECTS), {"page1": [(0, 10_000, "x")]})
    assert ooxml_write.residual(build(OBJECTS), "a.pdf", ["Hans Meier", "nirgends", "Name"]) == ["hans meier", "name"]


def test_from_end_to_end(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(build(OBJECTS))
    documents = ooxml.files(spark, f"{tmp_path}/a.pdf")
    config = Config(deny=("Hans Meier", "a@b.de"))
    frames = scan_documents(documents, config)
    written, _ = apply_documents(documents, frames, decisions_of(frames.groups), pseudonymize.Mapping.empty(spark), f"file://{tmp_path}/out", config)
    assert [r["written"].rpartition("/")[2] for r in written.collect()] == ["a_psd.pdf"]
    said = "".join(u[1] for u in pdf.units_of((tmp_path / "out" / "a_psd.pdf").read_bytes()))
    assert "Meier" not in said and "[PERSON_1]" in said and "mailto:[REDACTED]" in said and "a@b.de" not in said
