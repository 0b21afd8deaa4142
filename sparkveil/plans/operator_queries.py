"""Queries of single operators over values made from the tables, with the SQL that says the same."""

from __future__ import annotations

import io
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxonomy, text
from ..functions.rules import custom_rules, default_rules, expand_umlauts
from ..operators import detect, document, evaluate, model, pseudonymize, review, verify
from ..operators.resolve import resolved
from ..sources import ooxml, ooxml_write, pages, tables
from . import config as cfg
from .materialize import materialized, shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n"), "c_name", "c_mktsegment")


def _name(n: Column) -> Column:
    """A capitalised word that differs by n, in letters alone."""
    return F.concat(F.lit("Ha"), F.chr((97 + n % 26).cast("int")), F.lit("ke"), F.chr((97 + F.floor(n / 26) % 26).cast("int")))


_NAME = "('Ha' || chr((97 + n % 26)::int) || 'ke' || chr((97 + n // 26 % 26)::int))"


def _finding(start: Column | int, end: Column, entity: Column | str, value: Column, score: Column | float, source: Column | str, validated: Column | None = None) -> Column:
    start = start if isinstance(start, Column) else F.lit(start)
    made = detect.finding(start.cast("int"), end.cast("int"), entity, value, score, source)
    return made if validated is None else detect.changed(made, validated=validated)


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"


# --- A: Office documents ----------------------------------------------------------------------------------------------

_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _package(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def _rels(kind: str, target: str, outside: bool = False) -> str:
    mode = ' TargetMode="External"' if outside else ""
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_REL}/{kind}" Target="{target}"{mode}/></Relationships>'


def _docx(n: int, name: str) -> bytes:
    half = len(name) // 2
    body = f"<w:p><w:r><w:t>Kunde </w:t></w:r><w:r><w:t>{name[:half]}</w:t></w:r><w:r><w:t>{name[half:]} schreibt</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Nr</w:t><w:tab/><w:t>{n}</w:t></w:r></w:p>"
    code = f'<w:p><w:r><w:instrText>REF {name}</w:instrText></w:r></w:p>'
    return _package({"word/document.xml": f"<w:document {_W}><w:body>{body}{code}</w:body></w:document>", "word/header1.xml": f"<w:hdr {_W}><w:p><w:r><w:t>Akte {n}</w:t></w:r></w:p></w:hdr>"})


def _pptx(n: int, name: str) -> bytes:
    slide = f"<p {_A}><a:p><a:r><a:t>Kunde</a:t></a:r><a:br/><a:r><a:t>{name}</a:t></a:r></a:p></p>"
    chart = f'<c:chart xmlns:c="http://schemas.openxmlformats.org/drawingml/2006/chart" {_A}><a:t>Umsatz {n}</a:t></c:chart>'
    return _package({"ppt/slides/slide1.xml": slide, "ppt/notesSlides/notesSlide1.xml": f"<p {_A}><a:p><a:r><a:t>Notiz {n}</a:t></a:r></a:p></p>", "ppt/charts/chart1.xml": chart, "ppt/slides/_rels/slide1.xml.rels": _rels("hyperlink", f"mailto:a{n}@b.de", True)})


def _xlsx(n: int, name: str) -> bytes:
    rows = f'<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Konto</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>{1000000 + n}</v></c><c r="C2"><f>IF(\'Akte {name}\'!A2="Frau {name}";1)</f><v>1</v></c><c r="D2"><v>1.5</v></c></row>'
    return _package({
        "xl/workbook.xml": f'<workbook {_S} xmlns:r="{_REL}"><sheets><sheet name="Akte {name}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _rels("worksheet", "worksheets/sheet1.xml"),
        "xl/sharedStrings.xml": f"<sst {_S}><si><t>Name</t></si><si><r><t>{name[:3]}</t></r><r><t>{name[3:]}</t></r></si></sst>",
        "xl/worksheets/sheet1.xml": f"<worksheet {_S}><sheetData>{rows}</sheetData></worksheet>",
    })


def _pdf(n: int, name: str) -> bytes:
    said = zlib.compress(f"BT /F 12 Tf 72 700 Td (Kunde {name[:3]}) Tj ({name[3:]}) Tj 0 -20 Td (Vertrag Nummer {n} liegt vor) Tj ET".encode())
    stream = f"<< /Length {len(said)} /Filter /FlateDecode >>\nstream\n".encode() + said + b"\nendstream"
    objects = (
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Kids [3 0 R] >>",
        f"<< /Type /Page /Contents 5 0 R /Resources << /Font << /F 4 0 R >> >> /Annots [<< /A << /URI (mailto:a{n}@b.de) >> >> << /T (Name) /V ({name}) >>] >>".encode(), b"<< /Type /Font /Subtype /Type1 >>", stream,
    )
    return b"%PDF-1.7\n" + b"".join(f"{k} 0 obj\n".encode() + o + b"\nendobj\n" for k, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>"


def _documents(spark: SparkSession, sf_dir: str, end: str) -> DataFrame:
    """A document of a kind for each nation."""
    make = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "pdf": _pdf}[end]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": [f"{n}.{end}" for n in batch["n"]], "content": [make(n, v) for n, v in zip(batch["n"], batch["v"], strict=True)]}, columns=["path", "content"])

    n = F.col("n_nationkey")
    return _read(spark, sf_dir, "nation").select(n.cast("long").alias("n"), _name(n).alias("v")).mapInPandas(run, ooxml_write.FILES)


_UNITS = ("doc_id", "unit_id", "text", "header", "col", "row", "kind")


def _read_back(end: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ooxml.unpack(_documents(spark, sf_dir, end)).select(*_UNITS)

    return run


_NATIONS = f"with c as (select n_nationkey n from nation), d as (select n, {_NAME} v from c) "


def _units_sql(end: str, *units: tuple[str, str, str, str, str, str]) -> str:
    return _NATIONS + " union all ".join(f"select n || '.{end}' as doc_id, {u} as unit_id, {t} as text, {h}::varchar as header, {c}::varchar as col, {r}::bigint as row, '{k}' as kind from d" for u, t, h, c, r, k in units)


_NO = "null"
A_DOCX = _units_sql(
    "docx", ("'document:p0'", "'Kunde ' || v || ' schreibt'", _NO, _NO, _NO, "paragraph"), ("'document:p1'", "'Nr' || chr(9) || n", _NO, _NO, _NO, "paragraph"),
    ("'document:f3'", "'REF ' || v", _NO, _NO, _NO, "field_code"), ("'header1:p0'", "'Akte ' || n", _NO, _NO, _NO, "paragraph"),
)
A_PPTX = _units_sql(
    "pptx", ("'slide1:p0'", "'Kunde' || chr(10) || v", _NO, _NO, _NO, "paragraph"), ("'notesSlide1:p0'", "'Notiz ' || n", _NO, _NO, _NO, "paragraph"),
    ("'ppt/charts/chart1.xml:t0'", "'Umsatz ' || n", _NO, _NO, _NO, "chart"), ("'ppt/slides/_rels/slide1.xml.rels:r1'", "'mailto:a' || n || '@b.de'", _NO, _NO, _NO, "link"),
)
A_PDF_COPY = _NATIONS + """
select n || '.pdf' as doc_id, 'page1' as unit_id, 'Kunde [PERSON_1]' || chr(10) || 'Vertrag Nummer ' || n || ' liegt vor' as text from d union all
select n || '.pdf', 'page2', 'Name: [PERSON_1]' || chr(10) || 'mailto:a' || n || '@b.de' from d"""
A_PDF = _units_sql(
    "pdf", ("'page1'", "'Kunde ' || v || chr(10) || 'Vertrag Nummer ' || n || ' liegt vor'", _NO, _NO, _NO, "page"), ("'page1:field0'", "v", "'Name'", _NO, _NO, "field"),
    ("'page1:link0'", "'mailto:a' || n || '@b.de'", _NO, _NO, _NO, "link"),
)
_CELL = "'Akte ' || v || '!"
A_XLSX = _units_sql(
    "xlsx", ("'title:Akte ' || v", "'Akte ' || v", _NO, _NO, _NO, "sheet_title"), (f"{_CELL}A2'", "v", "'Name'", "'A'", "2", "cell"), (f"{_CELL}B2'", "(1000000 + n)::varchar", "'Konto'", "'B'", "2", "cell"),
    (f"{_CELL}C2:s0'", "'Frau ' || v", _NO, "'C'", "2", "formula_literal"),
)


def _rewritten(end: str) -> Query:
    """Every occurrence of the name in a document replaced, and the written document read again; and what is left of the name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents = materialized(_documents(spark, sf_dir, end))
        units = ooxml.unpack(documents)
        found = units.select("doc_id", "unit_id", F.explode(text.spans(F.col("text"), "Ha[a-z]ke[a-z]")).alias("m"))
        changes = found.select("doc_id", "unit_id", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.lit("[PERSON_1]").alias("token"))
        removed = found.select("doc_id", F.col("m.value").alias("value")).distinct()
        written = materialized(ooxml_write.rewritten(documents, changes, removed))
        again = ooxml.unpack(written).select("doc_id", "unit_id", "text")
        left = ooxml_write.residuals(written, removed).select(F.col("path").alias("doc_id"), F.lit("residual").alias("unit_id"), F.col("value").alias("text"))
        return again.unionByName(left)

    return run


def _rewritten_sql(read: str) -> str:
    """The same units with the token for the name; sheets' titles without its brackets."""
    # a reference to a renamed sheet, and so the id of its cells, has the title's form
    told = "replace(replace(unit_id, 'Akte ' || v, 'Akte PERSON_1'), v, 'PERSON_1')"
    return f"select doc_id, {told} as unit_id, case when kind = 'sheet_title' then replace(text, v, 'PERSON_1') else replace(text, v, '[PERSON_1]') end as text from ({read}) u join (select n_nationkey n, {_NAME.replace('n ', 'n_nationkey ')} v from nation) d on split_part(u.doc_id, '.', 1) = d.n::varchar"


def a_page_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's own text if there is enough of it, else what was recognised."""
    n = F.col("n")
    own = F.when(n % 3 == 0, F.col("c_name")).when(n % 3 == 1, F.lit("  x "))
    read = F.when(n % 2 == 0, F.concat(F.lit("gelesen "), F.col("c_name")))
    share = F.when(n % 6 < 4, F.lit(0.2)).otherwise(F.when(n % 2 == 0, F.lit(0.9)).otherwise(F.lit(0.1)))
    return _customers(spark, sf_dir).select("n", pages.page_text(F.concat(own, F.lit(" und weiter")), share, read).alias("said"))


A_PAGES = """
with p as (select c_custkey n, case c_custkey % 3 when 0 then c_name || ' und weiter' when 1 then '  x  und weiter' end own, case when c_custkey % 2 = 0 then 'gelesen ' || c_name end ocr from customer)
select n, case when length(trim(coalesce(own, ''))) >= 20 then own else coalesce(ocr, own, '') end as said from p"""


def a_written_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as CSV, a report and an audit log as JSON, units as JSON lines, a list of names: written and read again."""
    base = _folder(spark)
    rows = _customers(spark, sf_dir).select(F.lit("flagged").alias("bucket"), F.concat(F.lit('He said "'), F.col("c_name"), F.lit('", then\nleft; ä')).alias("value"), F.col("n").alias("count"))
    tables.write_findings_csv(rows, f"{base}/csv")
    back = spark.read.csv(f"{base}/csv", header=True, multiLine=True, escape='"', schema="bucket string, value string, count long")
    tables.write_report(_customers(spark, sf_dir).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("values")), f"{base}/report", {"config": "abc", "verified": True})
    report = spark.read.json(f"{base}/report").where("verified and config = 'abc'")
    for event in ("scan", "apply"):
        tables.log_event(spark, f"{base}/log", event)
    log = tables.read_recent(spark, f"{base}/log", 10)
    _customers(spark, sf_dir).select(F.col("n").cast("string").alias("doc_id"), F.lit("u").alias("unit_id"), F.col("n").alias("unit_ord"), F.col("c_name").alias("text")).write.json(f"{base}/units")
    units = tables.read_jsonl(spark, f"{base}/units").where("doc_id is not null and text is not null")
    names = _customers(spark, sf_dir).select(F.concat(F.when(F.col("n") % 2 == 0, "# ").otherwise(" "), F.col("c_name")).alias("value"))
    names.write.text(f"{base}/names")
    listed = len(tables.read_words(spark, f"{base}/names"))
    out = back.select(F.lit("csv").alias("kind"), "value", "count")
    out = out.unionByName(report.select(F.lit("report").alias("kind"), F.col("c_mktsegment").alias("value"), F.col("values").alias("count")))
    out = out.unionByName(log.select(F.lit("log").alias("kind"), F.col("event").alias("value"), F.lit(1).cast("long").alias("count")))
    out = out.unionByName(units.groupBy().agg(F.count(F.lit(1)).alias("count")).select(F.lit("units").alias("kind"), F.lit("").alias("value"), "count"))
    return out.unionByName(spark.range(1).select(F.lit("names").alias("kind"), F.lit("").alias("value"), F.lit(listed).cast("long").alias("count")))


A_WRITTEN = """
select 'csv' as kind, 'He said "' || c_name || '", then' || chr(10) || 'left; ä' as value, c_custkey::bigint as count from customer union all
select 'report', c_mktsegment, count(*) from customer group by 2 union all select 'log', unnest(['scan', 'apply']), 1 union all
select 'units', '', count(*) from customer union all select 'names', '', count(distinct lower(c_name)) filter (where c_custkey % 2 = 1) from customer"""


def a_csv_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV file's cells as units."""
    base = _folder(spark)
    _customers(spark, sf_dir).select("c_name", F.col("n").alias("Nummer"), "c_mktsegment").write.csv(base, header=True)
    return tables.read_csv(spark, base, "file").select("doc_id", "header", "col", "text", "kind")


A_CSV = """
select 'file' as doc_id, 'c_name' as header, 'A' as col, c_name as text, 'cell' as kind from customer union all
select 'file', 'Nummer', 'B', c_custkey::varchar, 'cell' from customer union all select 'file', 'c_mktsegment', 'C', c_mktsegment, 'cell' from customer"""

def a_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a document's properties say before and after they were scrubbed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for n, name in zip(batch["n"], batch["v"], strict=True):
                core = f'<cp:coreProperties xmlns:cp="urn:c" xmlns:dc="urn:d"><dc:creator>{name}</dc:creator><dc:title>Akte {n}</dc:title><cp:revision>{n}</cp:revision></cp:coreProperties>'
                data = _package({"word/document.xml": f"<w:document {_W}><w:body><w:p><w:r><w:t>{name}</w:t></w:r></w:p></w:body></w:document>", "docProps/core.xml": core, "docProps/custom.xml": f"<Properties xmlns='urn:p'><property name='Kunde'>{name}</property></Properties>"})
                rows += [(n, k, ooxml_write.text_of(d).count(name), ooxml_write.text_of(d).count(f"Akte {n}")) for k, d in enumerate((data, ooxml.metadata_free(data)))]
            yield pd.DataFrame(rows, columns=["n", "scrubbed", "names", "titles"])

    n = F.col("n_nationkey")
    return _read(spark, sf_dir, "nation").select(n.cast("long").alias("n"), _name(n).alias("v")).mapInPandas(run, "n long, scrubbed int, names int, titles int")


# in the text a name stands twice: as a paragraph and as its run
A_METADATA = "select n_nationkey as n, k as scrubbed, case when k = 0 then 4 else 2 end as names, 1 - k as titles from nation, (values (0), (1)) v(k)"


def a_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs written to a staging folder: they get a free name once a check has read them, and leave nothing if it fails."""
    base = _folder(spark)
    rows = _customers(spark, sf_dir)

    def refuse(written: DataFrame) -> None:
        raise verify.ResidualError(f"{written.count()} rows")

    names = []
    for check in (lambda w: None, refuse, lambda w: verify.demand_clean(w.where("n < 0")), lambda w: verify.demand_clean(w)):
        try:
            names.append(tables.publish(rows, f"{base}/out", check).rpartition("/")[2])
        except verify.ResidualError:
            names.append("refused")
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    there = sorted(f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path))
    told = spark.createDataFrame([(k, n, ",".join(there)) for k, n in enumerate(names)], "attempt int, name string, there string")
    kept = spark.read.parquet(f"{base}/out (2)").agg(F.count(F.lit(1)).alias("n"))
    return told.join(F.broadcast(kept))


A_PUBLISHED = "select attempt, name, 'out,out (2)' as there, (select count(*) from customer) as n from (values (0, 'out'), (1, 'refused'), (2, 'out (2)'), (3, 'refused')) v(attempt, name)"

# --- D: predicates of findings ----------------------------------------------------------------------------------------

_LEADS = ("", "- ", "Herr ", '"Dr. ', "• Frau ")


def d_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise and titles in front of names go, and their start moves along; other types stay as they are."""
    value = F.concat(evaluate.pick(_LEADS, F.col("n")), _name(F.col("n")))
    kind = evaluate.pick(("PERSON", "LOCATION", "IBAN_CODE"), F.floor(F.col("n") / 5))
    f = detect.trim(_finding(10, F.length(value) + 10, kind, value, 0.5, ""))
    return _customers(spark, sf_dir).select("n", f.alias("f")).select("n", F.col("f.start").alias("start_at"), F.col("f.end").alias("end_at"), F.col("f.value").alias("value"))


D_TRIM = f"""
with c as (select c_custkey n, c_custkey % 5 lead_, c_custkey // 5 % 3 kind from customer), d as (select *, {_NAME} v, ['', '- ', 'Herr ', '"Dr. ', '• Frau '][lead_ + 1] l from c),
k as (select *, case kind when 2 then l when 0 then '' else ['', '', 'Herr ', 'Dr. ', 'Frau '][lead_ + 1] end rest from d)
select n, (10 + length(l) - length(rest))::int as start_at, (10 + length(l) + length(v))::int as end_at, rest || v as value from k"""


def d_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a list of given names or products says of a name's source."""
    n = F.col("n")
    value = F.when(n % 4 == 0, F.concat(F.lit("Anna "), _name(n))).when(n % 4 == 1, F.concat(F.lit("Herr Bernd "), _name(n))).when(n % 4 == 2, F.lit(" Kondor ")).otherwise(_name(n))
    kind = evaluate.pick(("PERSON", "LOCATION", "IBAN_CODE"), F.floor(n / 4))
    rows = _customers(spark, sf_dir).select("n", F.array(_finding(0, F.length(value), kind, value, 0.5, "model")).alias("found"))
    return rows.select("n", F.explode(detect.confirmed("found", ("anna", "bernd"), ("kondor",))).alias("f")).select("n", F.col("f.source").alias("source"))


D_CONFIRMED = """
select c_custkey as n, case when c_custkey // 4 % 3 = 0 and c_custkey % 4 < 2 then 'given_name' when c_custkey // 4 % 3 < 2 and c_custkey % 4 = 2 then 'product_gazetteer' else 'model' end as source from customer"""


def d_worth_asking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text is given to a model: three characters and a letter at least."""
    value = evaluate.pick(("ab", "abc", "12345", "  a ", "1é2", ""), F.col("n"))
    return _customers(spark, sf_dir).select("n", model.worth_asking(value).alias("asked"))


D_ASKED = "select c_custkey as n, length(trim(v)) >= 3 and regexp_matches(v, '\\p{L}') as asked from (select c_custkey, ['ab', 'abc', '12345', '  a ', '1é2', ''][c_custkey % 6 + 1] v from customer)"


def d_title_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in a sheet's title count only with more than a model's guess behind them."""
    n = F.col("n")
    kind = evaluate.pick(("PERSON", "IBAN_CODE", "LOCATION"), n)
    source = evaluate.pick((detect.MODEL_SOURCE, "PatternRecognizer"), F.floor(n / 3))
    proven = F.when(F.floor(n / 6) % 2 == 1, True)
    found = document.title_findings(F.array(_finding(0, F.lit(5), kind, F.lit("Hanke"), 0.9, source, proven)))
    return _customers(spark, sf_dir).select("n", F.size(found).alias("kept"))


D_TITLES = "select c_custkey as n, case when c_custkey % 3 <> 1 and c_custkey // 3 % 2 = 0 and c_custkey // 6 % 2 = 0 then 0 else 1 end as kept from customer"

_TAGS = "array<struct<start:int,end:int,pos:string>>"


def d_tagger_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a tagger reads as no noun, and nominalizations, are vetoed; without a verdict nothing is."""
    n = F.col("n")
    value = F.concat(_name(n), evaluate.pick(("", "ung", "schaft"), n))
    pos = evaluate.pick(("NOUN", "PROPN", "VERB", "ADV"), F.floor(n / 3))
    wide = F.floor(n / 12) % 3 == 0  # the value lies inside a longer token
    tags = F.when(F.floor(n / 36) % 3 != 0, F.array(F.struct(F.lit(0).alias("start"), (F.length(value) + F.when(wide, 3).otherwise(0)).cast("int").alias("end"), pos.alias("pos"))).cast(_TAGS))
    f = _finding(0, F.length(value), "PERSON", value, 0.85, detect.MODEL_SOURCE)
    rejected = detect.gate(f, vetoed=detect.pos_veto(tags))
    return _customers(spark, sf_dir).select("n", value.alias("value"), rejected.alias("rejected"))


D_TAGGER = f"""
with c as (select c_custkey n from customer), d as (select n, {_NAME} || ['', 'ung', 'schaft'][n % 3 + 1] as v, ['NOUN', 'PROPN', 'VERB', 'ADV'][n // 3 % 4 + 1] pos, n // 12 % 3 <> 0 and n // 36 % 3 <> 0 as told from c)
select n, v as value, told and (pos in ('VERB', 'ADV') or (pos = 'NOUN' and length(v) >= 8 and regexp_matches(v, '(ung|schaft)$'))) as rejected from d"""

# --- E, F: documents --------------------------------------------------------------------------------------------------


def e_sheet_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of sheets, by all of their cells and headers."""
    from .scan import sheet_languages

    docs = _read(spark, sf_dir, "documents")
    return sheet_languages(docs.select(F.lit("d").alias("doc_id"), F.concat("source", F.lit("/"), F.col("lang")).alias("sheet"), F.lit("the").alias("header"), "text"))


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


E_SHEETS = f"""
with t as (select source || '/' || lang sheet, text from documents union all select distinct source || '/' || lang, 'the' from documents),
w as (select sheet, regexp_extract_all(lower(text), '[a-zäöüß]+') w from t),
c as (select sheet, sum(len(list_filter(w, lambda x: list_contains({_sql_list(text.GERMAN)}, x)))) de, sum(len(list_filter(w, lambda x: list_contains({_sql_list(text.ENGLISH)}, x)))) en,
  sum(len(list_filter(w, lambda x: regexp_matches(x, '[äöüß]')))) um, case when sum(len(w)) <= {text.SHORT_WORDS} then {text.FLOOR_SHORT} else {text.FLOOR} end f from w group by sheet)
select 'd' as doc_id, sheet, case when de + least(um, f - 1) >= en then 'de' else 'en' end as lang from c"""


def e_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first guess at the language of a source's texts; German and unsure where it cannot be told."""
    from .scan import sniff_language

    docs = _read(spark, sf_dir, "documents")
    told = [(lang, *sniff_language(docs.where(F.col("lang") == lang))) for lang in ("de", "en", "none")]
    told.append(("no text", *sniff_language(docs.select("doc_id"))))
    return spark.createDataFrame(told, "source string, lang string, confident boolean")


def _sniffed_sql() -> str:
    return f"""
with t as (select v.lang source, text from (values ('de'), ('en'), ('none')) v(lang) left join documents d on d.lang = v.lang),
w as (select source, regexp_extract_all(lower(coalesce(text, '')), '[a-zäöüß]+') w from t),
c as (select source, sum(len(list_filter(w, lambda x: list_contains({_sql_list(text.GERMAN)}, x)))) de, sum(len(list_filter(w, lambda x: list_contains({_sql_list(text.ENGLISH)}, x)))) en,
  sum(len(list_filter(w, lambda x: regexp_matches(x, '[äöüß]')))) um, case when sum(len(w)) <= {text.SHORT_WORDS} then {text.FLOOR_SHORT} else {text.FLOOR} end f from w group by source),
s as (select source, de + least(um, f - 1) de, en, f from c),
r as (select *, greatest(de, en) >= f and greatest(de, en) >= greatest(1, least(de, en)) * {text.MARGIN} as sure from s)
select source, case when sure and en > de then 'en' else 'de' end as lang, sure as confident from r union all select 'no text', 'de', false"""


def f_topical_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of topical columns that are looked for elsewhere."""
    n = F.col("n")
    header = evaluate.pick(("System", "Projekt", "Beschreibung", "Betrag"), n)
    value = F.when(F.floor(n / 4) % 4 == 0, F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" "))).when(F.floor(n / 4) % 4 == 1, F.lit("Feld_Name")).when(F.floor(n / 4) % 4 == 2, F.lit("x")).otherwise(F.rpad(F.col("c_name"), 41, "y"))
    cells = _customers(spark, sf_dir).select((n % 7).cast("string").alias("doc_id"), header.alias("header"), value.alias("text"))
    return document.topical_seeds(cells, terms={"TOOL": ["Murano"]})


F_SEEDS = """
select distinct (c_custkey % 7)::varchar as doc_id, ['TOOL', 'PROJECT'][c_custkey % 4 + 1] as entity_type, c_mktsegment as seed from customer where c_custkey % 4 < 2 and c_custkey // 4 % 4 = 0
union all select distinct (c_custkey % 7)::varchar, 'TOOL', 'Murano' from customer"""

# --- G, H, I: review --------------------------------------------------------------------------------------------------


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    return _customers(spark, sf_dir).select(
        (n % 11).cast("string").alias("doc_id"), evaluate.pick(("PERSON", "IBAN_CODE", "NRP", "TOOL"), n).alias("entity_type"), F.col("c_name").alias("value_key"), (n % 5 + 1).alias("count"), (F.lit(1.0) - (n % 9) / 10).alias("max_score"),
        (n % 7 == 0).alias("demoted"), (n % 2 == 0).alias("is_ner_guess"), taxonomy.data_class(evaluate.pick(("PERSON", "IBAN_CODE", "NRP", "TOOL"), n)).alias("data_class"), taxonomy.tier(F.lit(1.0) - (n % 9) / 10).alias("tier"),
    )


_GROUPS = """
with g as (select (c_custkey % 11)::varchar doc_id, ['PERSON', 'IBAN_CODE', 'NRP', 'TOOL'][c_custkey % 4 + 1] entity_type, c_name value_key, c_custkey % 5 + 1 as count, 1.0 - (c_custkey % 9) / 10.0 max_score, c_custkey % 7 = 0 demoted,
  c_custkey % 2 = 0 is_ner_guess, [1, 4, 2, 7][c_custkey % 4 + 1] class_at from customer)"""


def g_review_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts above a review."""
    misses = _customers(spark, sf_dir).where("n % 3 = 0")
    return review.stats(_read(spark, sf_dir, "orders"), _groups(spark, sf_dir), misses)


G_STATS = (
    _GROUPS
    + """ select (select count(*) from orders) as units_scanned, (count(*) filter (where not demoted))::bigint as distinct_findings, (coalesce(sum(count) filter (where not demoted), 0))::bigint as total_occurrences,
  count(*) filter (where not demoted and max_score >= 0.9) as auto_accept, count(*) filter (where not demoted and max_score < 0.9) as needs_review, count(*) filter (where not demoted and is_ner_guess) as model_guess,
  count(*) filter (where not demoted and not is_ner_guess) as likely_pii, count(*) filter (where demoted) as demoted, (select count(*) from customer where c_custkey % 3 = 0) as possible_misses from g"""
)


def _placed(ordered: DataFrame) -> DataFrame:
    """What stands in front of each row of an ordered table: pairs of neighbours within a partition of its sort."""
    rows = materialized(ordered.withColumn("_id", F.monotonically_increasing_id()))
    after = rows.select((F.col("_id") + 1).alias("_id"), F.col("value_key").alias("before"))
    return rows.join(after, "_id", "left")


def _in_order(which: Callable[[DataFrame], DataFrame], keep: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        few = _groups(spark, sf_dir).where(f"doc_id = '3' and {keep}").coalesce(1)
        rows = which(few).coalesce(1)
        return _placed(rows).select("entity_type", "value_key", "before")

    return run


def _in_order_sql(order: str, keep: str) -> str:
    return _GROUPS + f" select entity_type, value_key, lag(value_key) over (order by {order}) as before from g where doc_id = '3' and {keep}"


def miss_texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Units with risky shapes, and findings that cover some of them."""
    n = F.col("n")
    said = (
        F.when(n % 6 == 0, F.concat(F.lit("Mail an Kunde"), (n % 4).cast("string"), F.lit("@example.org, bitte")))
        .when(n % 6 == 1, F.concat(F.lit("Akte AB-"), F.lpad((n % 5).cast("string"), 5, "7"), F.lit(" liegt vor")))
        .when(n % 6 == 2, F.concat(F.lit("BIC DEUTDEFF"), evaluate.pick(("ABC", "abc"), F.floor(n / 6)), F.lit(" gilt")))
        .when(n % 6 == 3, F.concat(F.lit("siehe www.x"), (n % 3).cast("string"), F.lit(".example dort")))
        .when(n % 6 == 4, F.concat(F.lit("10000"), (n % 10).cast("string")))
        .otherwise(F.lit("nichts zu sehen, 12 mal"))
    )
    units = _customers(spark, sf_dir).select((n % 8).cast("string").alias("doc_id"), n.cast("string").alias("unit_id"), n.alias("unit_ord"), said.alias("text"))
    covered = units.where("unit_ord % 6 = 1 and unit_ord % 4 = 1").select("doc_id", "unit_id", F.lit(6).alias("start"), F.lit(8).alias("end"))
    return units, covered


def h_misses_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may have been missed, counted by document, and the three most frequent of each."""
    misses = review.possible_misses(*miss_texts(spark, sf_dir), ["DE", "FR"])
    return review.top_misses(misses, 3).select("doc_id", "value_key", "count", "value", "context")


H_MISSES = """
with c as (select c_custkey n, (c_custkey % 8)::varchar d from customer),
m as (select n, d, 'Kunde' || n % 4 || '@example.org' v, 'Mail an [' || 'Kunde' || n % 4 || '@example.org], bitte' x, 8 s, 1 p from c where n % 6 = 0 union all
 select n, d, 'AB-' || lpad((n % 5)::varchar, 5, '7'), 'Akte [AB-' || lpad((n % 5)::varchar, 5, '7') || '] liegt vor', 5, 2 from c where n % 6 = 1 and n % 4 <> 1 union all
 select n, d, 'DEUTDEFFABC', 'BIC [DEUTDEFFABC] gilt', 4, 3 from c where n % 6 = 2 and n // 6 % 2 = 0 union all
 select n, d, 'www.x' || n % 3 || '.example', 'siehe [www.x' || n % 3 || '.example] dort', 6, 4 from c where n % 6 = 3),
g as (select d, lower(v) k, count(*) n_, min(n) first_, arg_min(v, n) v, arg_min(x, n) x from m group by 1, 2),
r as (select *, row_number() over (partition by d order by n_ desc, first_, k) rank from g)
select d as doc_id, k as value_key, n_ as count, v as value, x as context from r where rank <= 3"""

# --- J, K, L ----------------------------------------------------------------------------------------------------------


def _carved_text(n: Column) -> tuple[Column, Column, Column]:
    name, iban = _name(n), F.concat(F.lit("DE"), F.lpad(n.cast("string"), 8, "0"))
    said = F.when(n % 3 == 0, F.concat(F.lit("polnisch "), name, F.lit(" und mehr"))).when(n % 3 == 1, F.concat(name, F.lit(" -- "), iban)).otherwise(F.concat(F.lit("kurz "), iban, F.lit(", "), name))
    return said, name, iban


def j_carved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding of a special category is cut around names and proven identifiers that it swallows, if a letter is left of it."""
    n = F.col("n")
    said, name, iban = _carved_text(n)
    at = lambda v: F.position(v, F.col("text")) - 1
    person = _finding(at(F.col("name")), at(F.col("name")) + F.length("name"), "PERSON", F.col("name"), 0.9, "PatternRecognizer")
    account = _finding(at(F.col("iban")), at(F.col("iban")) + F.length("iban"), "IBAN_CODE", F.col("iban"), 0.98, "PatternRecognizer", F.when(n % 2 == 0, True).otherwise(False))
    special = _finding(0, F.length("text"), "NRP", F.col("text"), 0.86, "PatternRecognizer")
    units = _customers(spark, sf_dir).select("n", said.alias("text"), name.alias("name"), iban.alias("iban"))
    found = F.when(n % 3 == 0, F.array(special, person)).otherwise(F.array(special, person, account)).cast(detect.FINDINGS)
    kept = units.withColumn("found", found).select("n", F.explode(resolved("found", "text")).alias("f"))
    return kept.select("n", F.col("f.entity_type").alias("entity_type"), F.col("f.start").alias("start_at"), F.col("f.value").alias("value"))


J_CARVED = f"""
with c as (select c_custkey n from customer), d as (select n, {_NAME} v, 'DE' || lpad(n::varchar, 8, '0') i from c)
select n, 'NRP' as entity_type, 0::int as start_at, 'polnisch' as value from d where n % 3 = 0 union all select n, 'PERSON', 9, v from d where n % 3 = 0 union all select n, 'NRP', 10 + length(v), 'und mehr' from d where n % 3 = 0 union all
select n, 'NRP', 0, v || ' -- ' || i from d where n % 3 = 1 and n % 2 = 0 union all select n, 'PERSON', 0, v from d where n % 3 = 1 and n % 2 = 1 union all select n, 'NRP', length(v) + 1, '-- ' || i from d where n % 3 = 1 and n % 2 = 1 union all
select n, 'PERSON', 7 + length(i), v from d where n % 3 = 2 union all select n, 'IBAN_CODE', 5, i from d where n % 3 = 2 and n % 2 = 0 union all
select n, 'NRP', 0, 'kurz' from d where n % 3 = 2 and n % 2 = 0 union all select n, 'NRP', 0, 'kurz ' || i || ',' from d where n % 3 = 2 and n % 2 = 1"""

_TIES = (
    (("PERSON", 0.8, None), ("DE_PHONE", 0.8, None), "DE_PHONE"), (("PERSON", 0.9, None), ("DE_PHONE", 0.8, None), "PERSON"), (("CREDIT_CARD", 0.3, True), ("DE_PHONE", 0.9, None), "CREDIT_CARD"),
    (("BIC_CODE", 0.5, None), ("DE_KONTONUMMER", 0.5, None), "BIC_CODE"), (("LOCATION", 0.5, None), ("PERSON", 0.5, None), "LOCATION"), (("DATE_TIME", 0.99, None), ("NRP", 0.5, None), "NRP"),
)


def j_same_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two types on one span: which stays."""
    n = F.col("n")
    pairs = F.array(*[F.array(*[_finding(0, F.lit(8), t, F.lit("Hakebcde"), s, "PatternRecognizer", F.lit(v).cast("boolean")) for t, s, v in pair[:2]]).cast(detect.FINDINGS) for pair in _TIES])
    one = F.element_at(pairs, (n % len(_TIES) + 1).cast("int"))
    turned = F.when(F.floor(n / len(_TIES)) % 2 == 0, one).otherwise(F.reverse(one))
    units = _customers(spark, sf_dir).select("n", F.lit("Hakebcde").alias("text"), turned.alias("found"))
    return units.select("n", F.explode(resolved("found", "text")).alias("f")).select("n", F.col("f.entity_type").alias("entity_type"))


J_SAME = f"select c_custkey as n, {_sql_list([t[2] for t in _TIES])}[c_custkey % {len(_TIES)} + 1] as entity_type from customer"


def _own_mapping(spark: SparkSession, sf_dir: str, shift: int) -> pseudonymize.Mapping:
    """Placeholders out of customers' keys, some of them moved by `shift`."""
    n = F.col("n")
    rows = _customers(spark, sf_dir).select(F.lit("PERSON").alias("label"), F.lower("c_name").alias("value_key"), F.col("c_name").alias("original_value"), F.concat(F.lit("PERSON_"), (n + F.when(n % 10 == 0, shift).otherwise(0)).cast("string")).alias("placeholder"))
    return pseudonymize.Mapping(rows, spark.sql("select 'PERSON' as label, 10000000L as next_n"))


def k_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands in the way of merging two mappings."""
    return _own_mapping(spark, sf_dir, 0).conflicts(_own_mapping(spark, sf_dir, 1))


K_CONFLICTS = """
select 'PERSON:' || lower(c_name) as conflict from customer where c_custkey % 10 = 0 union all
select 'PERSON_' || (c_custkey + 1) from customer where c_custkey % 10 = 0 and c_custkey + 1 in (select c_custkey from customer)"""


def k_encrypted_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping written with a key, given another one, and read again."""
    folder = _folder(spark)
    _own_mapping(spark, sf_dir, 0).save(folder, "a" * 16)
    turned = pseudonymize.Mapping.rotate(spark, folder, "a" * 16, "b" * 32, f"{folder}-new")
    plain = spark.read.parquet(f"{folder}-new/entries").select("placeholder", F.col("original_value").alias("stored"))
    return turned.entries.join(plain, "placeholder").select("placeholder", "value_key", "original_value", (F.col("stored") == F.col("original_value")).alias("readable"))


K_ENCRYPTED = "select 'PERSON_' || c_custkey as placeholder, lower(c_name) as value_key, c_name as original_value, false as readable from customer"


def k_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of columns that numbered tokens can be read back by."""
    header = F.concat(evaluate.pick(("Straße & Nr ", "größe/", " ", "-Über ", "Name"), F.col("n")), F.when(F.col("n") % 5 != 2, F.col("c_mktsegment")).otherwise(F.lit("")))
    label = pseudonymize.column_label(header, F.lit("C"))
    token = F.concat(F.lit("["), pseudonymize.checked_label(label), F.lit("_"), F.col("n").cast("string"), F.lit("]"))
    return _customers(spark, sf_dir).select("n", label.alias("label"), F.regexp_extract(token, pseudonymize.NUMBERED, 1).alias("read"))


K_LABELS = """
with h as (select c_custkey n, ['STRASSE_NR_', 'GROESSE_', 'COLUMN_C', 'UEBER_', 'NAME'][c_custkey % 5 + 1] || case when c_custkey % 5 <> 2 then upper(c_mktsegment) else '' end label from customer)
select n, label, label || '_' || n as read from h"""


def l_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of an output whose value was to be removed."""
    n = F.col("n")
    found = _customers(spark, sf_dir).select("n", evaluate.pick(("PERSON", "NRP"), n).alias("entity_type"), F.concat(F.lit(" "), F.upper("c_mktsegment")).alias("value"))
    decisions = _customers(spark, sf_dir).groupBy(F.lower("c_mktsegment").alias("value_key")).agg(F.min("n").alias("n")).select(evaluate.pick(("PERSON", "NRP"), n).alias("entity_type"), "value_key", evaluate.pick(("skip", "anonymize", "pseudonymize"), n).alias("action"))
    return verify.leaks(found, decisions).select("n", "entity_type", "value_key")


L_LEAKS = """
with d as (select lower(c_mktsegment) k, min(c_custkey) m from customer group by 1)
select c_custkey as n, ['PERSON', 'NRP'][c_custkey % 2 + 1] as entity_type, k as value_key from customer join d on lower(c_mktsegment) = k where m % 3 <> 0 and m % 2 = c_custkey % 2"""


def l_header_exemption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a written workbook still holds; what its first row says is left alone."""
    books = _documents(spark, sf_dir, "xlsx")
    removed = books.select(F.col("path").alias("doc_id"), F.explode(F.array(F.lit("Name"), F.lit("Konto"), F.lit("nirgends"), F.lit("Akte"), F.concat(F.lit("100"), F.lpad(F.regexp_extract("path", r"^(\d+)", 1), 4, "0")))).alias("value"))
    return ooxml_write.residuals(books, removed)


L_HEADERS = "select n_nationkey || '.xlsx' as path, 'akte' as value from nation union all select n_nationkey || '.xlsx', (1000000 + n_nationkey)::varchar from nation"


def l_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action and threshold of the entity types of customers' values under each profile."""
    rows = [(name, e, a, float(t), made.sensitivity) for name in cfg.PROFILES if (made := cfg.apply_profile(cfg.Config(), name)) for e, (a, t) in made.settings.items()]
    table = F.broadcast(spark.createDataFrame(rows, "profile string, entity_type string, action string, threshold double, sensitivity double"))
    kinds = _customers(spark, sf_dir).groupBy(evaluate.pick(tuple(taxonomy.ENTITY_SETTINGS), F.col("n")).alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))
    return kinds.join(table, "entity_type")


def _profiles_sql() -> str:
    quoted = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else "null" if x is None else str(x) for x in r) + ")" for r in rows)
    entities = quoted([(k, e, a, t) for k, (e, (a, t)) in enumerate(taxonomy.ENTITY_SETTINGS.items())])
    classes = quoted([(c, e) for c, es in taxonomy.CLASS_ENTITIES.items() for e in es.split()])
    actions = quoted([(p, c, a) for p, told in cfg.PROFILES.items() if told for c, a in told[4].items()])
    profiles = quoted([(p, told[0] if told else 0.0) for p, told in cfg.PROFILES.items()])
    return f"""
with e(k, entity_type, action, threshold) as (values {entities}), c(class, entity_type) as (values {classes}), a(profile, class, action) as (values {actions}), p(profile, sensitivity) as (values {profiles}),
n as (select c_custkey % {len(taxonomy.ENTITY_SETTINGS)} k, count(*) n from customer group by 1)
select p.profile, e.entity_type, coalesce(a.action, e.action) as action, e.threshold::double as threshold, p.sensitivity::double as sensitivity, n.n from n join e using (k) cross join p left join c on c.entity_type = e.entity_type
  left join a on a.profile = p.profile and a.class = coalesce(c.class, 'other_entities')"""


_CUSTOM = [{"name": "SEGMENT", "patterns": [{"regex": r"\bmöbel\w*\b", "score": 0.7}], "umlaut_variants": True}, {"name": "CLERK", "patterns": [{"regex": r"\bClerk#\d+\b", "score": 0.9}], "case_sensitive": True}]


def l_custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a configuration, with umlauts in either spelling."""
    n = F.col("n")
    said = F.concat(evaluate.pick(("Die Möbel, ", "Das MOEBELHAUS, ", "Der Mobel, "), n), evaluate.pick(("Clerk#", "clerk#"), F.floor(n / 3)), n.cast("string"))
    units = _customers(spark, sf_dir).select("n", said.alias("text"), F.lit("de").alias("lang"))
    found = detect.candidates(units, custom_rules(_CUSTOM)).select("n", F.explode("found").alias("f"))
    return found.select("n", F.col("f.entity_type").alias("entity_type"), F.col("f.start").alias("start_at"), F.col("f.value").alias("value"), F.col("f.score").alias("score"))


L_CUSTOM = """
select c_custkey as n, 'SEGMENT' as entity_type, 4 as start_at, ['Möbel', 'MOEBELHAUS'][c_custkey % 3 + 1] as value, 0.7::double as score from customer where c_custkey % 3 < 2 union all
select c_custkey, 'CLERK', [11, 16, 11][c_custkey % 3 + 1], 'Clerk#' || c_custkey, 0.9 from customer where c_custkey // 3 % 2 = 0"""


class _Shouting:
    """A stand-in for a model: words in capitals are tools, the first word with a capital letter a person."""

    def predict(self, texts: list[str], labels: list[str]) -> list[list[dict]]:
        import re

        return [[{"label": "tool" if m[0].isupper() else "person", "start": m.start(), "end": m.end(), "score": 0.9 if m[0].isupper() else 0.2} for m in re.finditer(r"\b[A-Z]\w*", t)] for t in texts]


def l_model_backend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of a model backend: asked once for each distinct text, answers below the least score left out."""
    n = F.col("n")
    units = _customers(spark, sf_dir).select(F.concat(evaluate.pick(("Anna nutzt ", "wir nutzen ", "12"), n), F.when(n % 3 < 2, F.col("c_mktsegment")).otherwise(F.lit(""))).alias("text"))
    found = model.findings(units, _Shouting, batch=4)
    return found.select("text", F.explode("model_found").alias("f")).select("text", F.col("f.entity_type").alias("entity_type"), F.col("f.start").alias("start_at"), F.col("f.value").alias("value"), F.col("f.source").alias("source"))


L_MODEL = """
select distinct ['Anna nutzt ', 'wir nutzen '][c_custkey % 3 + 1] || c_mktsegment as text, 'TOOL' as entity_type, 11 as start_at, c_mktsegment as value, 'GLiNER' as source from customer where c_custkey % 3 < 2"""


def l_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many planted secrets were caught and decoys claimed."""
    n = F.col("n")
    unit = _customers(spark, sf_dir).select("n", n.cast("string").alias("doc_id"), F.lit("u").alias("unit_id"))
    secret = F.concat(F.lit("Anna "), _name(n))
    manifest = unit.select("doc_id", "unit_id", F.when(n % 2 == 0, "must_catch").otherwise("must_not_catch").alias("kind"), secret.alias("value"))
    kind = evaluate.pick(("PERSON", "DATE_TIME"), F.floor(n / 8))
    found = unit.where("n % 8 < 6").select("doc_id", "unit_id", kind.alias("entity_type"), F.when(F.floor(n / 2) % 4 == 0, F.upper(secret)).when(F.floor(n / 2) % 4 == 1, F.lit("anna")).otherwise(F.lit("Bernd")).alias("value"))
    return evaluate.score(manifest, found)


L_SCORER = """
with c as (select c_custkey n, c_custkey // 2 % 4 k, c_custkey // 8 % 2 = 0 as person from customer)
select 'must_catch' as kind, count(*) as total, count(*) filter (where k = 0 and person) as claimed from c where n % 2 = 0 union all
select 'must_not_catch', count(*), count(*) filter (where k < 2 and person) from c where n % 2 = 1"""


def l_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration's hash changes with any of its settings, and not without."""
    base = cfg.Config()
    told = {"same": cfg.Config(), "deny": cfg.Config(deny=("x",)), "sensitivity": cfg.Config(sensitivity=0.1), "allow": cfg.Config(allow=()), "languages": cfg.Config(languages=("en", "de"))}
    rows = [(k, cfg.config_hash(c) != cfg.config_hash(base), cfg.provenance(c) != cfg.provenance(base)) for k, c in told.items()]
    table = spark.createDataFrame(rows, "setting string, other_hash boolean, other_line boolean")
    terms = cfg.new_terms(("alt",), ("Alt", "neu", "auch neu"), ("AUCH NEU",))
    return table.withColumn("new_terms", F.lit(",".join(terms))).withColumn("umlauts", F.lit(expand_umlauts("süß"))).crossJoin(F.broadcast(_customers(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))))


L_PROVENANCE = """
select setting, other_hash, other_line, 'neu' as new_terms, 's(?:ü|ue)(?:ß|ss)' as umlauts, (select count(*) from customer) as n
from (values ('same', false, false), ('deny', true, false), ('sensitivity', true, true), ('allow', true, false), ('languages', true, false)) v(setting, other_hash, other_line)"""


def l_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted names by stratum and context: how many, and how many words of them must go."""
    planted = evaluate.planted_names(_customers(spark, sf_dir))
    return planted.groupBy("stratum", "context_kind").agg(F.count(F.lit(1)).alias("total"), F.sum(F.size(evaluate.identifying(F.col("planted")))).alias("words"))


def _strata_sql() -> str:
    places = [(s, c) for s in evaluate.STRATA for c in evaluate.CONTEXTS]
    values = ", ".join(f"({k}, '{s}', '{c}', {_sql_list([str(len([w for w in name.replace('-', ' ').split() if w not in text.PARTICLES])) for name in evaluate.STRATA[s]])}::int[], {int(evaluate.CONTEXTS[c][2] == 'upper')})" for k, (s, c) in enumerate(places))
    # a particle in capitals is not taken for one
    upper = ", ".join(f"('{s}', {_sql_list([str(len(name.replace('-', ' ').split())) for name in names])}::int[])" for s, names in evaluate.STRATA.items())
    return f"""
with p(k, stratum, context_kind, words, up) as (values {values}), u(stratum, words) as (values {upper}),
c as (select c_custkey % {len(places)} k, c_custkey // {len(places)} turn from customer)
select p.stratum, p.context_kind, count(*) as total, sum(case when up = 1 then u.words[turn % len(u.words) + 1] else p.words[turn % len(p.words) + 1] end)::bigint as words
from c join p using (k) join u on u.stratum = p.stratum group by 1, 2"""


def _names_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = evaluate.planted_names(_customers(spark, sf_dir)).withColumn("lang", F.lit("de"))
    found = detect.candidates(planted, [r for r in default_rules() if r.entity == "PERSON"]).withColumn("found", resolved("found", "text"))
    told = F.transform("found", lambda f: f["value"])
    return found.withColumn("hit", evaluate.covered(F.col("planted"), told))


def l_strata_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by stratum and context of names that something announces, and of names that nothing does."""
    return _names_found(spark, sf_dir).groupBy("stratum", "context_kind").agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("found"))


def _recall_sql() -> str:
    places = [(s, c) for s in evaluate.STRATA for c in evaluate.CONTEXTS]
    values = ", ".join(f"({k}, '{s}', '{c}', {str(c in evaluate.ANCHORED).lower()})" for k, (s, c) in enumerate(places))
    return f"with p(k, stratum, context_kind, sure) as (values {values}) select stratum, context_kind, count(*) as total, count(*) filter (where sure) as found from customer join p on c_custkey % {len(places)} = k group by 1, 2"


def l_special_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of facts of special categories that are told in plain sentences."""
    planted = evaluate.planted_facts(_customers(spark, sf_dir)).withColumn("lang", F.lit("de"))
    found = detect.candidates(planted, [r for r in default_rules() if r.entity in taxonomy.SPECIAL]).withColumn("found", resolved("found", "text"))
    told = F.transform(F.filter("found", lambda f: f["entity_type"] == F.col("entity_type")), lambda f: f["value"])
    return found.withColumn("hit", evaluate.covered(F.col("planted"), told)).groupBy("context_kind", "entity_type").agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("found"))


def _special_sql() -> str:
    values = ", ".join(f"({k}, '{name}', '{e}')" for k, (name, (e, _, _)) in enumerate(evaluate.SPECIAL_PROBES.items()))
    return f"with p(k, context_kind, entity_type) as (values {values}) select context_kind, entity_type, count(*) as total, count(*) filter (where context_kind <> 'inverted_illness') as found from customer join p on c_custkey % {len(evaluate.SPECIAL_PROBES)} = k group by 1, 2"


QUERIES: dict[str, tuple[Query, str | None]] = {
    "a_docx_units": (_read_back("docx"), A_DOCX),
    "a_pptx_units": (_read_back("pptx"), A_PPTX),
    "a_xlsx_units": (_read_back("xlsx"), A_XLSX),
    "a_pdf_units": (_read_back("pdf"), A_PDF),
    "a_docx_rewritten": (_rewritten("docx"), _rewritten_sql(A_DOCX)),
    "a_pptx_rewritten": (_rewritten("pptx"), _rewritten_sql(A_PPTX)),
    "a_xlsx_rewritten": (_rewritten("xlsx"), _rewritten_sql(A_XLSX)),
    "a_pdf_rewritten": (_rewritten("pdf"), A_PDF_COPY),
    "a_page_policy": (a_page_policy, A_PAGES),
    "a_written_tables": (a_written_tables, A_WRITTEN),
    "a_csv_units": (a_csv_units, A_CSV),
    "a_metadata": (a_metadata, A_METADATA),
    "a_published": (a_published, A_PUBLISHED),
    "d_trim": (d_trim, D_TRIM),
    "d_confirmed": (d_confirmed, D_CONFIRMED),
    "d_worth_asking": (d_worth_asking, D_ASKED),
    "d_title_findings": (d_title_findings, D_TITLES),
    "d_tagger_veto": (d_tagger_veto, D_TAGGER),
    "e_sheet_languages": (e_sheet_languages, E_SHEETS),
    "e_sniffed": (e_sniffed, _sniffed_sql()),
    "f_topical_seeds": (f_topical_seeds, F_SEEDS),
    "g_review_stats": (g_review_stats, G_STATS),
    "g_review_order": (_in_order(review.in_order, "not demoted"), _in_order_sql("class_at, max_score desc, entity_type, value_key", "not demoted")),
    "g_demoted_order": (_in_order(review.demoted_in_order, "demoted"), _in_order_sql("count desc, entity_type, value_key", "demoted")),
    "h_misses_by_document": (h_misses_by_document, H_MISSES),
    "j_carved": (j_carved, J_CARVED),
    "j_same_span": (j_same_span, J_SAME),
    "k_conflicts": (k_conflicts, K_CONFLICTS),
    "k_encrypted_mapping": (k_encrypted_mapping, K_ENCRYPTED),
    "k_labels": (k_labels, K_LABELS),
    "l_leaks": (l_leaks, L_LEAKS),
    "l_header_exemption": (l_header_exemption, L_HEADERS),
    "l_profiles": (l_profiles, _profiles_sql()),
    "l_custom_rules": (l_custom_rules, L_CUSTOM),
    "l_model_backend": (l_model_backend, L_MODEL),
    "l_scorer": (l_scorer, L_SCORER),
    "l_provenance": (l_provenance, L_PROVENANCE),
    "l_strata": (l_strata, _strata_sql()),
    "l_strata_recall": (l_strata_recall, _recall_sql()),
    "l_special_recall": (l_special_recall, _special_sql()),
}
