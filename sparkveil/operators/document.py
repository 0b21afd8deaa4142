"""What a document as a whole says about its units: known names elsewhere, scanned spellings, headers, people columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .detect import FINDINGS, SEED_SOURCE, finding, gate, none

SEED_SCORE = 0.85
COLUMN_SCORE, TOPICAL_SCORE = 0.8, 0.9
INFER_LEAST, INFER_DISTINCT, INFER_NAMES, INFER_HITS, INFER_SHARE = 4, 0.5, 0.8, 2, 0.2
#: So many rows of a column must hold distinct values among themselves.
INFER_BLOCK = 500

# Headers of topical columns, in this order.
TOPICAL = {
    "TOOL": "tool|tools|system|systeme|systems|software|applikation|application|applications|app|apps|plattform|platform|framework|service",
    "DIVISION": "division|divisions|bereich|geschäftsbereich|geschaeftsbereich|sparte|ressort|business unit|business area|segment",
    "DEPARTMENT": "abteilung|team|teams|referat|fachbereich|organisationseinheit|department|departments|unit|org unit|cost centre|cost center",
    "LICENSEE": "lizenzgeber|lizenznehmer|lizenz|anbieter|hersteller|vendor|vendors|dienstleister|zulieferer|licensee|licensor|licence|license|supplier|suppliers|provider|manufacturer|counterparty",
    "PROJECT": "projekt|projektname|projekttitel|vorhaben|initiative|project|projects|project name|project title|programme|program|workstream",
    "DESCRIPTION": "beschreibung|projektbeschreibung|kurzbeschreibung|nutzenbeschreibung|notiz|notizen|kommentar|kommentare|bemerkung|bemerkungen|freitext|details|inhalt|oldvalue|newvalue|altervalue|neuervalue|description|descriptions|notes|note|comment|comments|remark|remarks|summary|free text|additional information",
}
# Stems and whole words of headers of people columns.
NAME_STEMS = (
    "name|kunde|kundin|inhaber|empfänger|empfaenger|sachbearbeiter|ansprechpartner|berater|beraterin|mitarbeiter|antragsteller|vertragspartner|begünstigter|beguenstigter|projektleiter|leiter|betreuer|verantwortlich|referent|"
    "gesellschafter|geschäftsführer|geschaeftsfuehrer|prokurist|zeichnungsberechtigt|bevollmächtigt|bevollmaechtigt|berechtigt|unterzeichner|auftraggeber|eigentümer|eigentuemer|vorname|nachname|familienname|teilnehmer|kontaktperson"
)
NAME_WORDS = "owner|einreicher|lead|leads|proxy|submitter|requester|assignee|reporter|approver|author|creator|manager|contact|kontakt|responsible|holder|beneficiary|signatory|employee|participant|bearbeiter|sponsor|recipient|applicant|user|users|bearbeitet|geaendert"


def topical_category(header: Column, categories: dict[str, str] | None = None) -> Column:
    """The first category that a header names by a whole word."""
    out = F.lit(None).cast("string")
    for kind, terms in reversed(list((categories or TOPICAL).items())):
        out = F.when(header.rlike(rf"(?iuU)(?<![\p{{L}}\d])(?:{terms})(?![\p{{L}}\d])"), kind).otherwise(out)
    return out


def is_name_header(header: Column, extra: Iterable[str] = ()) -> Column:
    """A column about people, by its header. extra: further stems."""
    import re

    stems = "|".join([NAME_STEMS, *[re.escape(t.strip().lower()) for t in extra if t.strip()]])
    return F.coalesce(header.rlike(rf"(?iu)(?:{stems})|(?<![a-z])(?:{NAME_WORDS})(?![a-z])"), F.lit(False))


def seeds(findings: DataFrame) -> DataFrame:
    """doc_id, entity_type, seed: the names of a document, whole and by surname, to look for in all of its units."""
    lines = findings.where("entity_type = 'PERSON'").select("doc_id", "entity_type", F.explode(F.split("value", r"[\r\n]+")).alias("line"))
    named = lines.select("doc_id", "entity_type", text.clean(text.without_honorific(text.clean(F.col("line")))).alias("name"))
    long = F.filter(F.split("name", r"(?U)\s+"), lambda t: F.length(t) >= 4)
    surname = F.when(F.size(long) > 1, F.array("name", F.element_at(long, -1))).otherwise(F.array("name"))
    return named.select("doc_id", "entity_type", F.explode(surname).alias("seed")).where(F.length("seed") >= 4).distinct()


def topical_seeds(cells: DataFrame, categories: dict[str, str] | None = None, terms: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, entity_type, seed of cells (doc_id, header, text) in topical columns. Descriptions are no seeds."""
    kind = topical_category(F.col("header"), categories)
    value = text.clean(F.col("text"))
    found = cells.select("doc_id", kind.alias("entity_type"), value.alias("seed"))
    found = found.where("entity_type is not null and entity_type <> 'DESCRIPTION'").where(F.length("seed").between(2, 40) & F.col("seed").rlike(r"\p{L}") & ~F.col("seed").rlike(r"(?U)^\w*_\w[\w-]*$"))
    own = [(k, t) for k, ts in (terms or {}).items() for t in ts]
    if own:
        listed = F.array(*[F.struct(F.lit(k).alias("entity_type"), F.lit(t).alias("seed")) for k, t in own])
        found = found.unionByName(cells.select("doc_id").distinct().select("doc_id", F.explode(listed).alias("s")).select("doc_id", "s.entity_type", "s.seed"))
    return found.distinct()


def _words(units: DataFrame) -> DataFrame:
    """Every run of letters and digits of a unit with its place, and without the unit's text."""
    return units.select("doc_id", "unit_id", F.explode_outer(text.spans(F.col("text"), r"[\p{L}\p{N}]+")).alias("w")).where("w is not null")


def propagated(units: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, unit_id, found: where the seeds of a document stand in its units.

    Words are joined to the first words of seeds, and only then are the whole seed and its ends compared: an equi-join in
    place of an expression for each document. Both sides grow with the input, and the planner takes words and units for as small
    as the file that they were read from, so the joins are told to sort: a broadcast of either does not fit the driver.
    """
    led = known.withColumn("first", F.regexp_extract("seed", r"[\p{L}\p{N}]+", 0)).withColumn("lead", F.position(F.col("first"), F.col("seed")) - 1).where("first <> ''")
    here = _words(units.join(led.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"))
    joined = here.join(led.hint("merge"), (here["doc_id"] == led["doc_id"]) & (here["w"]["value"] == led["first"])).drop(led["doc_id"])
    start = F.col("w.start") - F.col("lead")
    end = start + F.length("seed")
    # the text comes back once for each unit that has a word of a seed, and not with every word
    hits = joined.select("doc_id", "unit_id", F.struct("entity_type", "seed", start.alias("start"), end.alias("end")).alias("h")).where("h.start >= 0")
    hits = hits.groupBy("doc_id", "unit_id").agg(F.collect_set("h").alias("h"))
    told = units.select("doc_id", "unit_id", "text").join(hits.hint("merge"), ["doc_id", "unit_id"])
    placed = told.select("doc_id", "unit_id", "text", F.explode("h").alias("h")).select("doc_id", "unit_id", "text", "h.*").where(F.expr("substring(text, start + 1, length(seed))") == F.col("seed"))
    before = F.expr("if(start > 0, substring(text, start, 1), '')")
    after = F.expr("substring(text, `end` + 1, 1)")
    bounded = placed.where(~before.rlike(r"[\p{L}\p{N}]") & ~after.rlike(r"[\p{L}\p{N}]"))
    made = bounded.select("doc_id", "unit_id", finding(F.col("start"), F.col("end"), F.col("entity_type"), F.col("seed"), SEED_SCORE, SEED_SOURCE).alias("f"))
    # the gate judges them as if nothing had been said for them yet
    kept = made.where(~gate(F.struct(*[F.col("f")[n].alias(n) if n != "source" else F.lit("").alias(n) for n in ("start", "end", "entity_type", "value", "score", "source", "validated")])))
    return kept.groupBy("doc_id", "unit_id").agg(F.array_distinct(F.collect_list("f")).cast(FINDINGS).alias("found"))


def scanned_variants(units: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, unit_id, found: words that a scan has made of a seed, where a document's seeds leave no doubt which."""
    single = known.where(F.length("seed") >= 5).where(~F.col("seed").contains(" ")).withColumn("skeleton", text.ocr_skeleton(F.col("seed"))).where(F.length("skeleton") >= 5)
    sure = single.groupBy("doc_id", "skeleton").agg(F.count_distinct(F.lower("seed")).alias("n"), F.min("seed").alias("seed"), F.min("entity_type").alias("entity_type")).where("n = 1").drop("n")
    here = _words(units.join(sure.select("doc_id").distinct(), "doc_id", "left_semi")).where(F.length("w.value") >= 5).withColumn("skeleton", text.ocr_skeleton(F.col("w.value")))
    joined = here.join(sure, ["doc_id", "skeleton"]).where(F.lower("w.value") != F.lower("seed"))
    return joined.groupBy("doc_id", "unit_id").agg(F.collect_list(finding(F.col("w.start"), F.col("w.end"), F.col("entity_type"), F.col("w.value"), SEED_SCORE, SEED_SOURCE)).cast(FINDINGS).alias("found"))


def with_seeds(units: DataFrame, known: DataFrame) -> DataFrame:
    """units (with `found`) and, in `found`, what the document's seeds add; a scanned spelling only where nothing else is."""
    exact, scanned = propagated(units, known).withColumnRenamed("found", "_exact"), scanned_variants(units, known).withColumnRenamed("found", "_scanned")
    joined = units.join(exact, ["doc_id", "unit_id"], "left").join(scanned, ["doc_id", "unit_id"], "left")
    joined = joined.withColumn("found", F.concat("found", F.coalesce("_exact", none())))
    free = lambda s: ~F.exists("found", lambda f: (f["start"] < s["end"]) & (s["start"] < f["end"]))
    return joined.withColumn("found", F.concat("found", F.filter(F.coalesce("_scanned", none()), free))).drop("_exact", "_scanned")


def proprietary(words: DataFrame, vocabulary: Iterable[str], depth: int = 3, least: int = 4) -> DataFrame:
    """Distinct words (column word) that are no vocabulary and no compound of it: candidates for names of products.

    Compounds of up to three parts of `least` letters or more, joined by nothing, s, n, es or en, are vocabulary. The
    recursion runs over distinct words only.
    """
    known = frozenset(w.lower() for w in vocabulary)

    def splits(word: str, left: int) -> bool:
        if word in known:
            return True
        if left == 1 or len(word) < 2 * least:
            return False
        for k in range(least, len(word) - least + 1):
            if word[:k] in known:
                for joint in ("", "s", "n", "es", "en"):
                    rest = word[k + len(joint) :]
                    if word[k:].startswith(joint) and len(rest) >= least and splits(rest, left - 1):
                        return True
        return False

    def unknown(batches):
        for frame in batches:
            low = frame["word"].str.lower()
            back = low.str.replace("ae", "ä").str.replace("oe", "ö").str.replace("ue", "ü")
            yield frame[[not splits(a, depth) and not splits(b, depth) for a, b in zip(low, back, strict=True)]]

    shaped = words.select("word").where(text.is_proprietary_shape(F.col("word"))).distinct()
    return shaped.mapInPandas(unknown, "word string") if known else shaped.limit(0)


def people_columns(cells: DataFrame, given_names: Iterable[str], categories: dict[str, str] | None = None, rows: int | None = None) -> DataFrame:
    """doc_id, sheet, col of columns whose content is people, though the header does not say so.

    cells: doc_id, sheet, col, row, header, text. rows: how many of a column count, where a quick look is enough; None: all.

    Values must be distinct for the greater part in every 500 rows, taken over all of them: names repeat in a long column too, and of a
    given stock of names any share is too small from some length on. A column of up to 500 rows is judged as a whole.
    """
    given = sorted({g.lower() for g in given_names})
    value = text.clean(F.col("text"))
    own = cells.where(~is_name_header(F.col("header")) & topical_category(F.col("header"), categories).isNull())
    own = own.select("doc_id", "sheet", "col", "row", value.alias("v")).where("v <> ''")
    if rows is not None:
        own = own.where(F.col("row") <= rows + 1)
    shape, hit = text.looks_like_name(F.col("v")), F.expr(text.listed_sql(text.first_token_sql("v"), given))
    on = ["doc_id", "sheet", "col"]
    # cells without a row are dealt by value, which counts their distinct values over the whole column
    block = F.coalesce(F.floor((F.col("row") - 2) / INFER_BLOCK), F.pmod(F.xxhash64("v"), F.lit(1 << 20)) - (1 << 21))
    blocks = own.groupBy(*on, block.alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("v").alias("vs"), F.sum(shape.cast("int")).alias("names"), F.sum((shape & hit).cast("int")).alias("hits")
    )
    # blocks of a few values are one block together, or a thinly filled column would be distinct whatever it holds
    few = F.when(F.col("n") < INFER_LEAST, F.col("vs"))
    told = blocks.select(*on, "n", "names", "hits", F.when(F.col("n") >= INFER_LEAST, F.size("vs")).alias("d"), F.posexplode_outer(few).alias("k", "v"))
    once = lambda c: F.sum(F.when(F.coalesce("k", F.lit(0)) == 0, F.col(c)))
    facts = told.groupBy(*on).agg(once("n").alias("n"), (F.coalesce(F.sum("d"), F.lit(0)) + F.count_distinct("v")).alias("d"), once("names").alias("names"), once("hits").alias("hits"))
    n = F.col("n")
    kept = (n >= INFER_LEAST) & (F.col("d") / n >= INFER_DISTINCT) & (F.col("names") / n >= INFER_NAMES) & (F.col("hits") >= INFER_HITS) & (F.col("hits") / n >= INFER_SHARE)
    return facts.where(kept).select(*on)


def whole_cells(header: Column, value: Column, found: Column, people: Column, categories: dict[str, str] | None = None) -> Column:
    """Findings of a cell with what its column says: names of a people column part by part, a topical value as a whole."""
    parts = F.filter(text.segments(value), lambda p: text.looks_like_name(p["value"]) & ~text.is_no_name(p["value"]) & ~text.is_token(p["value"]))
    declared = is_name_header(header)
    source = F.when(declared, "whole_cell_override").otherwise("inferred_name_column")
    covered = lambda p: F.exists(found, lambda f: (f["entity_type"] != "PERSON") & f["validated"].isNotNull() & (f["start"] <= p["start"]) & (p["end"] <= f["end"]))
    named = F.transform(F.filter(parts, lambda p: ~covered(p)), lambda p: finding(p["start"], p["end"], "PERSON", p["value"], COLUMN_SCORE, source))
    kind = topical_category(header, categories)
    v = text.clean(value)
    lead = F.length(value) - F.length(F.regexp_replace(value, r"(?U)^\s+", ""))
    whole = finding(lead, lead + F.length(v), kind, v, TOPICAL_SCORE, "topical_header")
    free = (F.length(v) > 0) & ~text.is_token(v) & ~text.is_no_name(v) & ~F.exists(found, lambda f: (f["start"] <= lead) & (lead + F.length(v) <= f["end"]))
    topical = F.when(kind.isNotNull() & free, F.array(whole)).otherwise(none())
    return F.concat(found, F.when(declared | people, named).otherwise(none()), topical).cast(FINDINGS)


def header_context(header: Column, value: Column) -> Column:
    """The text that a cell is scanned as."""
    return F.when(F.coalesce(header, F.lit("")) == "", value).otherwise(F.concat_ws(": ", header, value))


def clip(found: Column, header: Column) -> Column:
    """Findings of header_context on the value's side, with its places."""
    off = F.when(F.coalesce(header, F.lit("")) == "", 0).otherwise(F.length(header) + 2)
    cut = lambda f: F.struct(
        F.greatest(f["start"] - off, F.lit(0)).alias("start"), (f["end"] - off).alias("end"), f["entity_type"].alias("entity_type"),
        F.substring(f["value"], F.greatest(off - f["start"], F.lit(0)) + 1, F.length(f["value"])).alias("value"), f["score"].alias("score"), f["source"].alias("source"), f["validated"].alias("validated"),
    )
    return F.transform(F.filter(found, lambda f: f["end"] > off), cut).cast(FINDINGS)


def title_findings(found: Column) -> Column:
    """Findings of a sheet's title that may rename it: names only with more than a guess behind them."""
    from ..functions import taxonomy
    from .detect import GATED_SOURCES

    bare = lambda f: f["entity_type"].isin(*taxonomy.NER_ENTITIES) & f["source"].isin(*GATED_SOURCES) & ~F.coalesce(f["validated"], F.lit(False))
    return F.filter(found, lambda f: ~bare(f))


def with_proprietary(units: DataFrame, vocabulary: Iterable[str]) -> DataFrame:
    """units with, in `found`, words that look like names of products and that nothing else claims. No vocabulary: unchanged."""
    from .detect import OOV_SOURCE

    known = sorted({v.lower() for v in vocabulary})
    if not known:
        return units
    words = units.select("doc_id", "unit_id", F.explode_outer(text.spans(F.col("text"), r"[\p{L}]{5,}")).alias("w")).where("w is not null")
    names = proprietary(words.select(F.col("w.value").alias("word")), known)
    hits = words.join(names, F.col("w.value") == F.col("word"))
    told = hits.groupBy("doc_id", "unit_id").agg(F.collect_list(finding(F.col("w.start"), F.col("w.end"), "NER_MISC", F.col("word"), SEED_SCORE, OOV_SOURCE)).cast(FINDINGS).alias("_oov"))
    free = lambda s: ~F.exists("found", lambda f: (f["start"] < s["end"]) & (s["start"] < f["end"]))
    joined = units.join(told, ["doc_id", "unit_id"], "left")
    return joined.withColumn("found", F.concat("found", F.filter(F.coalesce("_oov", none()), free))).drop("_oov")
