import random

import pytest
import regex
from pyspark.sql import functions as F

from sparkveil.functions import checksums, rules, taxonomy, text


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["x"] for r in df.select("k", expression(F.col("v")).alias("x")).orderBy("k").collect()]


def test_checksums(spark):
    assert column(spark, ["4111 1111 1111 1111", "4111111111111112", "79927398713", "", "4111-1111-1111-1111"], checksums.luhn_valid) == [True, False, False, False, True]
    assert column(spark, ["DE89 3704 0044 0532 0130 00", "DE89370400440532013001", "GB82WEST12345698765432", "de89370400440532013000", "DE8937", "NO9386011117947"], checksums.iban_valid) == [True, False, True, True, False, True]
    assert column(spark, ["86095742719", "86095742718", "01234567890", "11111111111", "860 957 427 19"], checksums.steuer_id_valid) == [True, False, False, False, True]
    codes = checksums.countries(spark)
    assert 240 < len(codes) < 260
    assert column(spark, ["DEUTDEFF", "DEUTDEFF500", "DEUTXXFF", "deutdeff", "DEUTDE"], lambda v: checksums.bic_valid(v, codes)) == [True, True, False, True, False]


def sv(value):
    letter = f"{ord(value[8]) - 64:02d}"
    total = sum(sum(divmod(int(d) * w, 10)) for d, w in zip(value[:8] + letter + value[9:11], checksums.SV_WEIGHTS))
    return 2 <= int(value[:2]) <= 89 and 1 <= int(value[2:4]) <= 31 and 1 <= int(value[4:6]) <= 12 and total % 10 == int(value[11])


def test_sv_nummer(spark):
    rng = random.Random(1)
    values = [f"{rng.randrange(100):02d}{rng.randrange(34):02d}{rng.randrange(14):02d}{rng.randrange(100):02d}{rng.choice('AKZ')}{rng.randrange(1000):03d}" for _ in range(400)]
    want = [sv(v) for v in values]
    assert any(want) and column(spark, values, checksums.sv_nummer_valid) == want


def test_verdicts_and_scores(spark):
    df = spark.createDataFrame([("IBAN_CODE", "DE89370400440532013000", 0.5), ("IBAN_CODE", "DE00", 0.5), ("PERSON", "x", 0.5)], "t string, v string, s double")
    verdict = checksums.validate(F.col("t"), F.col("v"))
    assert [(r["a"], r["b"]) for r in df.select(verdict.alias("a"), checksums.refine(F.col("s"), verdict).alias("b")).collect()] == [(True, 0.98), (False, 0.4), (None, 0.5)]


def test_every_rule_compiles_and_the_jvm_takes_it(spark):
    df = spark.createDataFrame([("Öl, ein Text",)], "t string")
    for r in rules.default_rules():
        df.select(F.col("t").rlike(rules.compile_rule(r))).collect()


def test_rules_find_what_python_finds(spark):
    texts = [
        "Diagnose: Diabetes mellitus Typ 2, insulinpflichtig. Ende", "Diagnose: keine Angabe", "Er leidet an einer chronischen Bronchitis seit 2001", "wegen Grippe krankgeschrieben", "krankgeschrieben wegen der schweren Grippe",
        "Religion: römisch-katholisch; ledig", "Sie ist zum Islam konvertiert, übergetreten zur Kirche", "Herr Dr. Müller-Lüdenscheid und Frau von der Leyen", "Kunde: Hans Meier", "Notar Weber", "geb. Schulze", "H. Schmidt",
        "IBAN DE89 3704 0044 0532 0130 00.", "Tel. +49 89 1234567, 0170/1234567", "Hauptstraße 5a, 80331 München", "am 12.03.2020 und 3. März 2021, *1980", "Jahrgang 1975", "https://example.com/a?b=1, www.foo.de.", "Diagnosis: asthma", "suffers from migraine.",
        "Mitglied der IG Metall, ver.di und SPD", "türkischer Herkunft, Nationalität: deutsch", "homosexuell", "BIC DEUTDEFF500", "Kreditkarte: 4111111111111111", "4111 1111 1111 1111", "a.b@example.com und x@y", "In der Heide 12, Berlin", "in den Betriebsrat gewählt",
        "arbeitsunfaehig; Gehhilfe", "\U0001f600 Herr Koch\nFrau Winter",
    ]
    from sparkveil.operators.detect import scan

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    total = 0
    for r in rules.default_rules():
        got = {x["k"]: [(f["start"], f["end"], f["value"]) for f in x["f"]] for x in df.select("k", scan("t", r).alias("f")).collect()}
        flags = regex.MULTILINE | regex.DOTALL | (0 if r.case_sensitive else regex.IGNORECASE)
        own = regex.compile(rules.expand_umlauts(r.pattern) if r.umlaut_variants else r.pattern, flags)
        for k, t in enumerate(texts):
            want = [(m.start(), m.end(), m.group()) for m in own.finditer(t)]
            total += len(want)
            assert got[k] == want, (r.name, t)
    assert total > 60


def test_rules_refuse_what_would_miss():
    for pattern in (r"(?<=\bx\s+)y", r"(?<=a*)b", r"(?<=(?:a)?b)c", r"(?<!(?:ab){2})c", r"(?<=a{2,})b"):
        with pytest.raises(rules.RuleError):
            rules.compile_rule(rules.Rule("X", pattern, 0.5, "x"))
    with pytest.raises(rules.RuleError):
        rules.expand_umlauts("[äö]x")
    assert rules.expand_umlauts(r"Öl\ä") == r"(?:Ö|Oe)l\ä"
    assert rules.custom_rules([{"name": "N", "patterns": [{"regex": "a+", "score": 0.5}], "case_sensitive": True}])[0].case_sensitive
    assert rules.deny_rule(["", " "]) is None and rules.deny_rule(["a.b"]).pattern == r"a\.b"


def skeleton(value):
    s = value.lower()
    for a, b in text.OCR_VOWELS + text.OCR_PAIRS:
        s = s.replace(a, b)
    s = s.translate(str.maketrans(text.OCR_FROM, text.OCR_TO))
    for a, b in text.OCR_PAIRS:
        s = s.replace(a, b)
    return "".join(c for c in s if c.isalnum())


def test_skeletons(spark):
    words = ["Müller", "Miiller", "Mueller", "Kretschmar", "Kretschrnar", "Straße", "Clara", "VVolf", "l1I|!", "a-b c"]
    assert column(spark, words, text.ocr_skeleton) == [skeleton(w) for w in words]
    assert skeleton("Müller") == skeleton("Miiller") == skeleton("Mueller")


def test_languages(spark):
    texts = ["Sehr geehrte Damen und Herren", "Dear Sir, please find the report", "", "Björn Müller, Düsseldorf", "12345", "the und"]
    got = [(r["lang"], r["confident"]) for r in column(spark, texts, text.language)]
    assert got == [("de", True), ("en", True), ("de", False), ("de", False), ("de", False), ("de", False)]


def test_spans_and_summaries(spark):
    got = column(spark, ["\U0001f600 a1 b22", "", "none"], lambda v: text.spans(v, "[0-9]+"))
    assert [[(m["start"], m["end"], m["value"]) for m in ms] for ms in got] == [[(3, 4, "1"), (6, 8, "22")], [], []]
    assert column(spark, ["Eins. Zwei! Drei", "a\nb\n\nc", "", "  x "], text.structural_summary) == ["3 Sätze, ~16 Zeichen", "Liste, 3 Einträge", "1 Satz, ~0 Zeichen", "1 Satz, ~1 Zeichen"]
    assert column(spark, ["- Punkt", "-Punkt\n##Zwei _x001E_ drei", "a-b"], text.neutralize) == ["- Punkt", " Punkt\n  Zwei         drei", "a-b"]


def test_taxonomy(spark):
    kinds = ["PERSON", "NRP", "CUSTOM", "GPE", None]
    assert column(spark, kinds, taxonomy.data_class) == ["people", "special_category", "other_entities", "org_places", "other_entities"]
    assert column(spark, kinds[:4], taxonomy.token_label) == ["PERSON", "ORIGIN", "CUSTOM", "LOCATION"]
    assert column(spark, kinds[:3], taxonomy.default_action) == ["pseudonymize", "anonymize", "anonymize"]
    assert column(spark, [0.95, 0.9, 0.5, 0.49], taxonomy.tier, "double") == ["high", "high", "medium", "low"]
