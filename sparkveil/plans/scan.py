"""The whole scan and the whole application of decisions, as plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checksums, text
from ..operators import detect, document, pseudonymize, review, verify
from ..operators.resolve import resolved
from ..sources.tables import free_name, publish
from .config import Config
from .materialize import materialized


@dataclass(frozen=True)
class ScanFrames:
    units: DataFrame
    findings: DataFrame
    groups: DataFrame
    misses: DataFrame
    stats: DataFrame


def with_language(units: DataFrame, languages: tuple[str, ...] = ("de", "en")) -> DataFrame:
    """units with `lang`, one for each document: that of all its units, the first configured one if unsure."""
    counted = units.groupBy("doc_id").agg(*_markers())  # no document is put together in one task
    found = counted.select("doc_id", _verdict().alias("_l")).select("doc_id", F.when(F.col("_l.confident"), F.col("_l.lang")).otherwise(languages[0]).alias("lang"), F.col("_l.confident").alias("lang_confident"))
    return units.join(found, "doc_id", "left").withColumn("lang", F.coalesce("lang", F.lit(languages[0])))


def _markers() -> list[Column]:
    """Sums over texts: words, German and English marker words, words with umlauts."""
    words = lambda listed: F.sum(F.size(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-zäöüß]+)"), F.lit(1)), listed)))
    return [words(lambda w: F.lit(True)).alias("n"), words(lambda w: w.isin(*text.GERMAN)).alias("de"), words(lambda w: w.isin(*text.ENGLISH)).alias("en"), words(lambda w: w.rlike("[äöüß]")).alias("um")]


def _verdict() -> Column:
    """struct<lang, confident> of such sums."""
    floor = F.when(F.col("n") <= text.SHORT_WORDS, text.FLOOR_SHORT).otherwise(text.FLOOR)
    de = F.col("de") + F.least(F.col("um"), floor - 1)
    lead, other = F.greatest(de, F.col("en")), F.least(de, F.col("en"))
    sure = (lead >= floor) & (lead >= F.greatest(F.lit(1), other) * text.MARGIN)
    return F.struct(F.when(de >= F.col("en"), "de").otherwise("en").alias("lang"), sure.alias("confident"))


def with_cell_language(units: DataFrame, languages: tuple[str, ...] = ("de", "en")) -> DataFrame:
    """units of workbooks with `lang`: a long cell's own if it is plain, else its sheet's; units of no sheet have their document's."""
    sheets = sheet_languages(units.where("sheet is not null")).withColumnRenamed("lang", "_sheet")
    known = lambda lang: F.when(lang.isin(*languages), lang)
    joined = with_language(units, languages).join(sheets, ["doc_id", "sheet"], "left")
    own = cell_language(F.col("text"), F.coalesce(F.col("_sheet"), F.col("lang")))
    return joined.withColumn("lang", F.when(F.col("sheet").isNull(), F.col("lang")).otherwise(F.coalesce(known(own), known(F.col("_sheet")), F.col("lang")))).drop("_sheet")


def sniff_language(units: DataFrame) -> tuple[str, bool]:
    """Language and certainty of units before a scan; never an error: ("de", False) where it cannot be told."""
    try:
        found = units.agg(*_markers()).select(_verdict().alias("l")).first()["l"]
    except Exception:  # a first guess for a dialogue; the scan itself reports what is wrong
        return "de", False
    return (found["lang"], True) if found["confident"] else ("de", False)


def sheet_languages(cells: DataFrame) -> DataFrame:
    """doc_id, sheet, lang: by a sheet's headers and all of its cells; doubt is no bar, a sheet without marker words is German.

    Marker words are counted cell by cell and added up, so neither is a sheet put together nor are some of its rows taken for it.
    """
    heads = cells.select("doc_id", "sheet", F.col("header").alias("text")).distinct()
    both = heads.unionByName(cells.select("doc_id", "sheet", "text")).where("text is not null")
    return both.groupBy("doc_id", "sheet").agg(*_markers()).select("doc_id", "sheet", _verdict()["lang"].alias("lang"))


def cell_language(value: Column, sheet: Column) -> Column:
    """A long cell's own language if it is plain, else its sheet's."""
    # named once: each mention of an expression would be worked out on its own
    sure = F.element_at(F.transform(F.array(text.language(value)), lambda own: F.when(own["confident"], own["lang"])), 1)
    return F.coalesce(F.when(F.length(value) >= 40, sure), sheet)


def scan(units: DataFrame, config: Config | None = None, codes: list[str] | None = None, extra: Column | None = None) -> ScanFrames:
    """Findings, their groups and what may have been missed. Equal texts of a language are scanned once.

    units: doc_id, unit_id, unit_ord, text (and header, sheet, col, row of cells). extra: findings of a model backend.
    """
    config = config or Config()
    spark = units.sparkSession
    codes = codes or checksums.countries(spark)
    has_cells = "header" in units.columns
    routed = with_cell_language if "sheet" in units.columns else with_language
    lang = units if "lang" in units.columns else routed(units, config.languages)
    lang = lang if has_cells else lang.withColumn("header", F.lit(None).cast("string"))
    seen = document.header_context(F.col("header"), F.col("text"))
    # dealt by a stated number: adaptive planning goes by bytes, and rules cost seconds for a megabyte
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    distinct = lang.select(F.coalesce("header", F.lit("")).alias("header"), "text", "lang").distinct().repartition(n)
    scanned = distinct.withColumn("_value", F.col("text")).withColumn("text", seen)
    scanned = detect.candidates(scanned, config.rules(), config.allow, config.languages, extra, config.given_names, config.products, config.settings, config.sensitivity, config.stopwords)
    # The rules are the cost of a scan. A condition on what they found would be moved below this and run them twice, so it
    # waits until they have run; texts are known by their hash from here.
    scanned = scanned.select("header", F.sha2("_value", 256).alias("_hash"), "lang", document.clip(F.col("found"), F.col("header")).alias("found"))
    scanned = materialized(scanned).where(F.size("found") > 0)
    joined = lang.withColumns({"header": F.coalesce("header", F.lit("")), "_hash": F.sha2("text", 256)})
    joined = joined.join(scanned, ["header", "_hash", "lang"], "left").drop("_hash").withColumn("found", F.coalesce("found", detect.none()))
    if has_cells:
        people = F.lit(False)
        if config.infer_name_columns and config.given_names and {"sheet", "col", "row"} <= set(units.columns):
            cols = document.people_columns(lang.where("kind = 'cell'") if "kind" in units.columns else lang, config.given_names, config.topical).withColumn("_people", F.lit(True))
            joined = joined.join(cols, ["doc_id", "sheet", "col"], "left")
            people = F.coalesce("_people", F.lit(False))
        joined = joined.withColumn("found", document.whole_cells(F.col("header"), F.col("text"), F.col("found"), people, config.topical)).drop("_people")
    if config.propagate:
        joined = materialized(joined)
        first = joined.where(F.exists("found", lambda f: f["entity_type"] == "PERSON")).withColumn("found", resolved("found", "text"))
        known = document.seeds(detect.rows(first).select("doc_id", "entity_type", "value"))
        if has_cells:
            known = known.unionByName(document.topical_seeds(lang, config.topical, config.topical_terms)).distinct()
        joined = document.with_seeds(joined, materialized(known))
    joined = document.with_proprietary(joined, config.vocabulary)
    if "kind" in units.columns:
        joined = joined.withColumn("found", F.when(F.col("kind") == "sheet_title", document.title_findings(F.col("found"))).otherwise(F.col("found")))
    few = F.when(F.size("found") > 1, resolved("found", "text")).otherwise(F.col("found"))
    found = materialized(joined.withColumn("found", F.array_distinct("found")).withColumn("found", few))
    findings = detect.rows(found)
    groups = review.grouped(findings, config.settings, high=config.tier_high, medium=config.tier_medium)
    groups = review.corroborated(groups) if config.corroboration else groups.withColumn("demoted", F.lit(False))
    groups = materialized(groups)
    misses = materialized(review.possible_misses(lang, findings, codes))
    return ScanFrames(found, findings, groups, misses, review.stats(lang, groups, misses))


def decisions_of(groups: DataFrame) -> DataFrame:
    """The groups' actions as decisions; what is demoted is left alone."""
    return groups.select("entity_type", "value_key", F.when(F.col("demoted"), "skip").otherwise(F.col("action")).alias("action")).groupBy("entity_type", "value_key").agg(F.min("action").alias("action"))


def apply(frames: ScanFrames, decisions: DataFrame, mapping: pseudonymize.Mapping, folder: str, config: Config | None = None, key: str | None = None) -> tuple[str, pseudonymize.Mapping]:
    """Write the units with replacements to a folder, if a second scan and a search find nothing of what was removed.

    The findings of the scan are used as they are, so what was reviewed is what is replaced. The mapping is written
    before the output gets its name.
    """
    config = config or Config()
    folder = free_name(decisions.sparkSession, folder)
    out, minted = pseudonymize.apply(frames.units.drop("found"), frames.findings, decisions, mapping)
    removed = pseudonymize.decided(frames.findings, decisions).where(F.col("action").isin(*verify.REMOVING)).select("doc_id", "value")

    def check(written: DataFrame) -> None:
        again = scan(written.drop("text").withColumnRenamed("output", "text"), config).findings
        verify.demand_clean(verify.leaks(again, decisions), verify.literal_residual(written, removed, always=config.deny))
        minted.save(f"{folder}._mapping", key)

    return publish(out, folder, check), minted
