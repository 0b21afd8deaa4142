"""Queries of the shipped rules over planted texts, with SQL that knows by construction what must be found.

A case is a text of three parts, of which the middle one, worked out from the customer's key by an expression that Spark and
SQL read alike, is the value; customers take the cases in turn. A case without an entity type must not be found. Each query
runs all shipped rules of its entity type with context words, precision gate, checksums and thresholds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Rule, default_rules, deny_rule
from ..operators import detect
from ..operators.resolve import resolved


@dataclass(frozen=True)
class Case:
    before: str
    #: An expression over n, the customer's key.
    value: str
    after: str
    entity: str | None
    #: Null where a checksum has the last word.
    score: float | None = None


def _d(width: int, of: str = "n", lead: str = "0") -> str:
    """Digits out of a number, of a fixed width."""
    return f"substr(lpad(cast({of} as string), {width}, '{lead}'), 1, {width})"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _word(*options: str) -> str:
    """One of some words in turn."""
    return "case " + " ".join(f"when n % {len(options)} = {k} then {_q(o)}" for k, o in enumerate(options)) + " end"


#: Capitalised names that differ by customer, in letters alone.
_NAME = "concat('Ha', chr(cast(97 + n % 26 as int)), 'ke', chr(cast(97 + n % 7 as int)))"
_FULL = f"concat({_word('Anna', 'Bernd', 'Clara')}, ' ', {_NAME})"
_ILL = "concat(upper(chr(cast(97 + n % 26 as int))), 'stose')"

DE, EN = "de", "en"
_PLAIN = 0.86

#: query: (language, entity types, cases)
CASES: dict[str, tuple[str, tuple[str, ...], tuple[Case, ...]]] = {
    "b_steuer_id": (DE, ("DE_STEUER_ID",), (
        Case("Steuer-ID: ", "concat('1', " + _d(10, "n * 7919 + 13") + ")", " laut Bescheid", "DE_STEUER_ID"),
        Case("Die Nummer ", "concat('81 ', " + _d(3, "n * 7") + ", ' 451 ', " + _d(3, "n") + ")", ".", "DE_STEUER_ID"),
        Case("Zu kurz ist ", _d(10, "n"), " hier.", None),
        Case("Mit Buchstaben A", "concat('81', " + _d(9, "n") + ")", "B", None),
    )),
    "b_sv_nummer": (DE, ("DE_SV_NUMMER",), (
        Case("Rentenversicherung ", "concat('15', '07', '06', '49', chr(cast(65 + n % 26 as int)), '10', cast(n % 10 as string))", " gemeldet", "DE_SV_NUMMER"),
        Case("SV-Nummer: ", "concat('65 170839 ', chr(cast(65 + n % 26 as int)), ' 00 ', cast(n % 10 as string))", ";", "DE_SV_NUMMER"),
        Case("Kleiner Buchstabe ", "concat('15070649', chr(cast(97 + n % 26 as int)), '103')", "", None),
    )),
    "b_iban_code": (DE, ("IBAN_CODE",), (
        Case("Konto ", "concat('DE', " + _d(2, "n % 97") + ", '50010517', " + _d(10, "n") + ")", " bitte", "IBAN_CODE"),
        Case("an ", "concat('DE', " + _d(2, "n % 97") + ", ' 5001 0517 ', " + _d(4, "n") + ", ' 1234 56')", ", danke", "IBAN_CODE"),
        Case("NO: ", "concat('NO', " + _d(2, "n % 97") + ", '86011117', " + _d(3, "n") + ")", "", "IBAN_CODE"),
        Case("x", "concat('DE', " + _d(2, "n % 97") + ", '50010517', " + _d(10, "n") + ")", "", None),
        Case("klein ", "concat('de', " + _d(2, "n % 97") + ", '50010517', " + _d(10, "n") + ")", "", None),
    )),
    "b_credit_card": (DE, ("CREDIT_CARD",), (
        Case("Karte ", "concat('4111 1111 ', " + _d(4, "n") + ", ' 1111')", " gesperrt", "CREDIT_CARD"),
        Case("mit ", "concat('3782-', " + _d(6, "n") + ", '-10005')", "", "CREDIT_CARD"),
        Case("Kreditkarte: ", "concat('555555555555', " + _d(4, "n") + ")", "", "CREDIT_CARD"),
        Case("Keine Karte ist ", "concat('9111 1111 ', " + _d(4, "n") + ", ' 1111')", "", None),
    )),
    "b_kontonummer": (DE, ("DE_KONTONUMMER",), (
        Case("Konto ", _d(8, "n * 31 + 10000000"), " gekündigt", "DE_KONTONUMMER", 0.65),
        Case("Kto. ", _d(10, "n + 1000000000"), "", "DE_KONTONUMMER", 0.65),
        Case("Stück ", _d(8, "n + 10000000"), "", None),
        Case("Konto ", _d(5, "n % 100000"), "", None),
    )),
    "b_depotnummer": (DE, ("DE_DEPOTNUMMER",), (
        Case("Depot ", _d(12, "n + 100000000000"), "", "DE_DEPOTNUMMER", 0.65),
        Case("Das Depot mit der Nummer ", _d(6, "n % 900000 + 100000"), " läuft", "DE_DEPOTNUMMER", 0.65),
        Case("Nummer ", _d(9, "n + 100000000"), "", None),
        Case("Depot eins zwei drei vier fünf sechs ", _d(9, "n + 100000000"), "", None),
    )),
    "b_bank_ref": (DE, ("BANK_INTERNAL_REF",), (
        Case("Vorgang ", "concat('AB-', " + _d(6, "n") + ")", " erledigt", "BANK_INTERNAL_REF", 0.65),
        Case("Referenz: ", "concat('KRED-', " + _d(10, "n") + ")", "", "BANK_INTERNAL_REF", 0.65),
        Case("Zug ", "concat('AB-', " + _d(6, "n") + ")", "", None),
        Case("Vorgang ", "concat('ab-', " + _d(6, "n") + ")", "", None),
        Case("Vorgang ", "concat('ABCDE-', " + _d(6, "n") + ")", "", None),
    )),
    "b_de_phone": (DE, ("DE_PHONE",), (
        Case("Telefon ", "concat('030 ', " + _d(7, "n + 1000000") + ")", "", "DE_PHONE", 0.95),
        Case("unter ", "concat('+49 (89) ', " + _d(6, "n + 100000") + ")", " erreichbar", "DE_PHONE", 0.6),
        Case("Fax: ", "concat('0049-221/', " + _d(6, "n + 100000") + ")", "", "DE_PHONE", 0.95),
        Case("Wert ", "concat('9', " + _d(8, "n") + ")", "", None),
        Case("Wert A", "concat('030', " + _d(7, "n + 1000000") + ")", "", None),
    )),
    "b_bic_code": (DE, ("BIC_CODE",), (
        Case("BIC ", "concat('DEUTDEF', chr(cast(65 + n % 26 as int)))", "", "BIC_CODE", 0.75),
        Case("SWIFT: ", "concat('COBADEFF', " + _d(3, "n % 1000") + ")", ".", "BIC_CODE", 0.75),
        Case("Wort ", "concat('DEUTDEF', chr(cast(65 + n % 26 as int)))", "", None),
        Case("BIC ", "concat('deutdef', chr(cast(97 + n % 26 as int)))", "", None),
    )),
    "b_address": (DE, ("DE_ADDRESS",), (
        Case("wohnt in der ", "concat(" + _word("Hauptstraße", "Gartenstr.", "Lindenallee", "Marktplatz") + ", ' ', cast(n % 300 + 1 as string))", ", seit Mai", "DE_ADDRESS", _PLAIN),
        Case("Lieferung: ", "concat('Am Anger ', cast(n % 90 + 1 as string))", ", hinten", "DE_ADDRESS", 0.55),
        Case("nach ", "concat(" + _d(5, "n % 90000 + 10000") + ", ' ', " + _word("Berlin", "Köln", "Ulm") + ")", "", "DE_ADDRESS", 0.5),
        Case("kostet ", "concat(" + _d(5, "n % 90000 + 10000") + ", ' Euro')", "", None),
        Case("Frist: ", "concat('Im Jahr ', cast(n % 90 + 10 as string))", ", dann", None),
    )),
    "b_kundennummer": (DE, ("DE_KUNDENNUMMER",), (
        Case("Kunde ", _d(7, "n + 1000000"), "", "DE_KUNDENNUMMER", 0.65),
        Case("Kd-Nr. ", _d(5, "n % 90000 + 10000"), " offen", "DE_KUNDENNUMMER", 0.65),
        Case("Menge ", _d(7, "n + 1000000"), "", None),
    )),
    "b_date_time": (DE, ("DATE_TIME",), (
        Case("am ", "concat(cast(n % 28 + 1 as string), '.', cast(n % 12 + 1 as string), '.19', " + _d(2, "n % 100") + ")", " fällig", "DATE_TIME", 0.5),
        Case("Am ", "concat(cast(n % 28 + 1 as string), '. ', " + _word("Januar", "März", "Dezember") + ", ' 20', " + _d(2, "n % 100") + ")", "", "DATE_TIME", 0.6),
        Case("Jahrgang ", "concat('19', " + _d(2, "n % 100") + ")", "", "DATE_TIME", 0.6),
        Case("im Jahr ", "concat('19', " + _d(2, "n % 100") + ")", "", None),
        Case("Version ", "concat(cast(n % 28 + 32 as string), '.', cast(n % 12 + 13 as string), '.1999')", "", None),
    )),
    "b_health_de": (DE, ("DE_HEALTH_DATA",), (
        Case("Diagnose: ", f"concat({_ILL}, ' im Knie')", "", "DE_HEALTH_DATA", _PLAIN),
        Case("Er war ", _word("arbeitsunfähig", "krankgeschrieben", "schwanger", "pflegebeduerftig"), " im Mai", "DE_HEALTH_DATA", _PLAIN),
        Case("Sie leidet an ", _ILL, ".", "DE_HEALTH_DATA", _PLAIN),
        Case("Pflegegrad ", "cast(n % 5 + 1 as string)", " wurde bewilligt", "DE_HEALTH_DATA", _PLAIN),
        Case("Diagnose: ", _word("keine", "unbekannt", "entfällt"), "", None),
        Case("Das Wetter leidet ", _word("kaum", "sehr"), " darunter", None),
    )),
    "b_religion_de": (DE, ("DE_RELIGION",), (
        Case("Konfession: ", _word("ev-luth", "griechisch", "ohnehin keine Angst"), "", "DE_RELIGION", _PLAIN),
        Case("Er ist ", _word("katholisch", "muslimisch", "römisch-katholisch", "juedisch"), " getauft", "DE_RELIGION", _PLAIN),
        Case("Sie ist konvertiert vor drei Jahren zum ", _word("Islam", "Judentum"), " dort", "DE_RELIGION", _PLAIN),
        Case("zu ", _word("Ramadan", "Pessach", "Jom Kippur"), " frei", "DE_RELIGION", _PLAIN),
        Case("Religion: ", _word("keine Angabe", "n/a"), "", None),
        Case("Er ist konvertiert, vor drei Jahren, zum ", _word("Chef", "Leiter"), " dort", None),
    )),
    "b_origin_de": (DE, ("NRP",), (
        Case("Staatsangehörigkeit: ", _word("polnisch", "deutsch", "von Geburt an türkisch"), "", "NRP", _PLAIN),
        Case("ein ", _word("Spätaussiedler", "Asylbewerber", "Kontingentflüchtling"), " kam", "NRP", _PLAIN),
        Case("von ", _word("kurdischer Abstammung", "syrischer Herkunft", "polnischen Wurzeln"), " her", "NRP", _PLAIN),
        Case("Muttersprache: ", _word("Türkisch", "Polnisch"), "", "NRP", _PLAIN),
        Case("Nationalität: ", _word("unbekannt", "k.A."), "", None),
        Case("Der Ton ist ", _word("rau", "freundlich"), " dort", None),
    )),
    "b_sex_life_de": (DE, ("DE_SEX_LIFE",), (
        Case("Er ist ", _word("schwul", "bisexuell", "homosexuell"), " und froh", "DE_SEX_LIFE", _PLAIN),
        Case("Sie rief ", _word("ihre Ehefrau", "ihre Partnerin"), " an", "DE_SEX_LIFE", _PLAIN),
        Case("in ", _word("eingetragener Lebenspartnerschaft", "eingetragener Partnerschaft"), " lebend", "DE_SEX_LIFE", _PLAIN),
        Case("Sie rief ", _word("ihren Ehemann", "ihren Mann"), " an", None),
    )),
    "b_union_party_de": (DE, ("DE_UNION_PARTY",), (
        Case("Gewerkschaft: ", _word("Cockpit West", "Bahn Nord"), "", "DE_UNION_PARTY", _PLAIN),
        Case("Der ", _word("Betriebsrat", "Personalrat", "Warnstreik"), " tagt", "DE_UNION_PARTY", _PLAIN),
        Case("bei der ", _word("IG Metall", "SPD", "ver.di"), " aktiv", "DE_UNION_PARTY", _PLAIN),
        Case("Sie ist Mitglied im ", _word("Aufsichtskreis", "Ortsverein"), " dort", "DE_UNION_PARTY", _PLAIN),
        Case("Partei: ", _word("keine", "n/a"), "", None),
        Case("Der ", _word("Beirat", "Verein"), " tagt", None),
    )),
    "b_special_en": (EN, ("DE_HEALTH_DATA", "DE_RELIGION", "NRP", "DE_SEX_LIFE", "DE_UNION_PARTY"), (
        Case("Diagnosis: ", _word("asthma since May", "diabetes"), "", "DE_HEALTH_DATA", _PLAIN),
        Case("He was diagnosed with ", _word("asthma", "gout"), "", "DE_HEALTH_DATA", _PLAIN),
        Case("A ", _word("Catholic", "Muslim", "Greek Orthodox"), " family", "DE_RELIGION", _PLAIN),
        Case("Nationality: ", _word("Polish", "German"), "", "NRP", _PLAIN),
        Case("She is ", _word("bisexual", "lesbian", "transgender"), " and glad", "DE_SEX_LIFE", _PLAIN),
        Case("a member of the ", _word("Labour Party", "Green Party", "Teamsters"), " there", "DE_UNION_PARTY", _PLAIN),
        Case("Medication: ", _word("none", "not stated"), "", None),
        Case("a ", _word("catholic", "muslim"), " taste", None),
    )),
    "b_person_anchors": (DE, ("PERSON",), (
        Case("Sehr geehrter Herr ", _NAME, ", guten Tag", "PERSON", _PLAIN),
        Case("Kunde: ", _FULL, "", "PERSON", _PLAIN),
        Case("der Notar ", _FULL, ", heute", "PERSON", _PLAIN),
        Case("Anna, geb. ", _NAME, ", heute", "PERSON", _PLAIN),
        Case("an K. ", _NAME, ", heute", "PERSON", _PLAIN),
        Case("Frau ", f"concat('von der ', {_NAME})", ", heute", "PERSON", _PLAIN),
        Case("das Haus ", _NAME, ", heute", None),
        Case("der notar ", f"lower({_NAME})", ", heute", None),
    )),
    "b_url": (DE, ("URL",), (
        Case("siehe ", "concat('https://a.example/', cast(n as string), '?q=1')", ", dort", "URL", 0.7),
        Case("Link: ", "concat('www.x', cast(n as string), '.example')", ".", "URL", 1.0),
        Case("kein ", "concat('ftp://a.example/', cast(n as string))", "", None),
    )),
    "b_portable": (EN, ("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD"), (
        Case("to ", "concat('user.', cast(n as string), '@mail.example.org')", ", please", "EMAIL_ADDRESS", 1.0),
        Case("dial ", "concat('+1 202 555 ', " + _d(4, "n") + ")", "", "PHONE_NUMBER", 0.6),
        Case("phone ", "concat('+44 20 794 ', " + _d(4, "n") + ")", " now", "PHONE_NUMBER", 0.95),
        Case("with visa ", "concat('411111111111', " + _d(4, "n") + ")", " paid", "CREDIT_CARD"),
        Case("not ", "concat('user.', cast(n as string), '@localhost')", "", None),
        Case("not ", "concat('+1 ', " + _d(4, "n") + ")", "", None),
    )),
}


def planted(customer: DataFrame, lang: str, cases: tuple[Case, ...]) -> DataFrame:
    """The texts as units."""
    k = F.pmod(F.floor(F.col("n") / 7), F.lit(len(cases)))
    said = None
    for j, c in enumerate(cases):
        part = F.concat(F.lit(c.before), F.expr(c.value), F.lit(c.after))
        said = F.when(k == j, part) if said is None else said.when(k == j, part)
    key = F.col("n").cast("string")
    return customer.select(F.col("c_custkey").alias("n")).select("n", key.alias("doc_id"), key.alias("unit_id"), F.col("n").alias("unit_ord"), said.alias("text"), F.lit(lang).alias("lang"))


def planted_sql(cases: tuple[Case, ...], where: str = "true") -> str:
    """n, entity_type, start_at, value, score of what must be found."""
    told = " union all ".join(f"select n, {_q(c.entity)} as entity_type, {len(c.before)} as start_at, {c.value} as value, {'null' if c.score is None else c.score}::double as score from c where (n // 7) % {len(cases)} = {j}" for j, c in enumerate(cases) if c.entity)
    return f"with c as (select c_custkey n from customer), t as ({told}) select n, entity_type, start_at::int as start_at, value, round(score, 4) as score from t where {where}"


def _rules(entities: tuple[str, ...]) -> list[Rule]:
    return [r for r in default_rules() if r.entity in entities]


def shown(found: DataFrame) -> DataFrame:
    """n, entity_type, start_at, value, score (null behind a checksum) of findings without overlaps."""
    f = found.select("n", F.explode_outer(resolved("found", "text")).alias("f")).where("f is not null")
    return f.select("n", F.col("f.entity_type").alias("entity_type"), F.col("f.start").alias("start_at"), F.col("f.value").alias("value"), F.round(F.when(F.col("f.validated").isNull(), F.col("f.score")), 4).alias("score"))


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    lang, entities, cases = CASES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        units = planted(spark.read.parquet(f"{sf_dir}/customer.parquet"), lang, cases)
        return shown(detect.candidates(units, _rules(entities)))

    return run


# --- lists, context, language -----------------------------------------------------------------------------------------

_DENIED = ("Kranich", "Projekt Falke")
_DENY_CASES = (
    Case("zum ", _word("Kranich", "KRANICH", "projekt falke"), " heute", "DENY_LIST", 1.0),
    Case("im ", "'kranich'", "nest", "DENY_LIST", 1.0),
    Case("kein ", _word("Storch", "Projekt Adler"), " heute", None),
)


def b_deny_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Denied terms wherever they stand, in any case."""
    units = planted(spark.read.parquet(f"{sf_dir}/customer.parquet"), DE, _DENY_CASES)
    return shown(detect.candidates(units, [deny_rule(list(_DENIED))]))


_ALLOW_CASES = (
    Case("Kunde: ", _FULL, "", "PERSON", _PLAIN),
    Case("Herr ", "'Feldmann'", ", heute", None),
    Case("Herr ", "'FELDMANN'", ", heute", None),
    Case("Herr ", f"concat('Feldmann', {_NAME})", ", heute", "PERSON", _PLAIN),
)


def b_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed terms are no findings, whole values without regard to case."""
    units = planted(spark.read.parquet(f"{sf_dir}/customer.parquet"), DE, _ALLOW_CASES)
    return shown(detect.candidates(units, _rules(("PERSON",)), allow=("feldmann",)))


_BOOST_RULES = (Rule("PROJECT", r"\bP\d{4,12}\b", 0.3, "p", context=("projekt",), case_sensitive=True),)
_BOOST_CASES = (
    Case("Projekt ", "concat('P', " + _d(6) + ")", "", "PROJECT", 0.65),
    Case("Im Großprojekt eins zwei drei ", "concat('P', " + _d(6) + ")", "", "PROJECT", 0.65),
    Case("Projekt eins zwei drei vier ", "concat('P', " + _d(6) + ")", "", "PROJECT", 0.65),
    Case("Projekt eins zwei drei vier fünf ", "concat('P', " + _d(6) + ")", "", None),
    Case("Ein ", "concat('P', " + _d(6) + ")", " Projekt", None),
)


def b_context_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context word among the five tokens before a match lifts its score over the threshold."""
    units = planted(spark.read.parquet(f"{sf_dir}/customer.parquet"), DE, _BOOST_CASES)
    return shown(detect.candidates(units, list(_BOOST_RULES)))


_SAME_RULES = (
    Rule("TOOL", r"\bT\d{3}\b", 0.6, "short"), Rule("TOOL", r"\bT\d{3}-\d{6}\b", 0.9, "long"), Rule("TOOL", r"-\d{6}\b", 0.95, "tail"), Rule("PROJECT", r"\bT\d{3}\b", 0.6, "other"),
)


def b_same_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of findings of one type, those that a better one contains go; other types stay beside them."""
    text = F.concat(F.lit("an T123-"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))
    found = detect.none()
    for r in _SAME_RULES:
        found = F.concat(found, detect.scan("text", r))
    units = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", text.alias("text")).withColumn("found", found)
    kept = units.select("c_custkey", F.explode(detect.drop_same_type(F.col("found"))).alias("f"))
    return kept.select("c_custkey", F.col("f.entity_type").alias("entity_type"), F.col("f.start").alias("start_at"), F.col("f.value").alias("value"))


B_SAME = """
with c as (select c_custkey, lpad(c_custkey::varchar, 6, '0') d from customer)
select c_custkey, 'TOOL' as entity_type, 3 as start_at, 'T123-' || d as value from c union all
select c_custkey, 'TOOL', 7, '-' || d from c union all select c_custkey, 'PROJECT', 3, 'T123' from c"""


def b_language_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of a language run on texts of that language alone; rules of none run on all."""
    texts = F.when(F.col("c_custkey") % 2 == 0, F.lit("Er ist katholisch, 12.05.1990, A Catholic")).otherwise(F.lit("A Catholic, 12.05.1990, katholisch"))
    units = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("n"), texts.alias("text"), F.when(F.col("c_custkey") % 2 == 0, DE).otherwise(EN).alias("lang"))
    return shown(detect.candidates(units, _rules(("DE_RELIGION", "DATE_TIME"))))


B_LANGUAGE = """
select c_custkey as n, entity_type, start_at::int as start_at, value, score from customer, (values
  (0, 'DE_RELIGION', 7, 'katholisch', 0.86::double), (0, 'DATE_TIME', 19, '12.05.1990', 0.5), (1, 'DE_RELIGION', 2, 'Catholic', 0.86), (1, 'DATE_TIME', 12, '12.05.1990', 0.5)) v(k, entity_type, start_at, value, score)
where c_custkey % 2 = k"""


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    **{name: (_query(name), planted_sql(cases)) for name, (_, _, cases) in CASES.items()},
    "b_deny_list": (b_deny_list, planted_sql(_DENY_CASES)),
    "b_allow_list": (b_allow_list, planted_sql(_ALLOW_CASES)),
    "b_context_boost": (b_context_boost, planted_sql(_BOOST_CASES)),
    "b_same_type": (b_same_type, B_SAME),
    "b_language_rules": (b_language_rules, B_LANGUAGE),
}
