"""Scan, review, replace, verify, restore."""

import pytest
from pyspark.sql import functions as F

from sparkveil.operators import detect, document, evaluate, model, pseudonymize, review, verify
from sparkveil.operators.detect import FINDINGS
from sparkveil.plans import config as cfg
from sparkveil.plans import scan as plans

UNITS = "doc_id string, unit_id string, unit_ord long, text string, lang string"
TEXTS = [
    ("d1", "a", 0, "Sehr geehrter Herr Bergmann, Ihre IBAN DE89 3704 0044 0532 0130 00 ist bekannt.", "de"),
    ("d1", "b", 1, "Bergmann zahlte am 12.03.2020, die AKTE_Bergmann_2 liegt bei.", "de"),
    ("d1", "c", 2, "Diagnose: Asthma; IBAN DE89370400440532013001 falsch", "de"),
    ("d1", "d", 3, "Bergrnann schrieb an info@example.com und Projekt Geheimnis.", "de"),
    ("d2", "a", 0, "Bergmann ohne Anrede. Vertrag 99887766 und Tel. 089 1234567.", "de"),
    ("d2", "b", 1, "", "de"),
]


@pytest.fixture(scope="module")
def frames(spark):
    return plans.scan(spark.createDataFrame(TEXTS, UNITS), cfg.Config(deny=("Geheimnis",)))


def found(frames):
    return {(r["doc_id"], r["unit_id"], r["entity_type"], r["value"]) for r in frames.findings.collect()}


def test_findings(frames):
    got = found(frames)
    for want in [
        ("d1", "a", "PERSON", "Bergmann"), ("d1", "a", "IBAN_CODE", "DE89 3704 0044 0532 0130 00"), ("d1", "b", "PERSON", "Bergmann"), ("d1", "b", "DATE_TIME", "12.03.2020"), ("d1", "c", "DE_HEALTH_DATA", "Asthma"),
        ("d1", "c", "IBAN_CODE", "DE89370400440532013001"), ("d1", "d", "PERSON", "Bergrnann"), ("d1", "d", "EMAIL_ADDRESS", "info@example.com"), ("d1", "d", "DENY_LIST", "Geheimnis"), ("d2", "a", "DE_PHONE", "089 1234567"),
    ]:
        assert want in got, want
    assert not any(g[0] == "d2" and g[2] == "PERSON" for g in got), "names do not cross documents"
    assert sum(g[:3] == ("d1", "b", "PERSON") for g in got) == 1
    rows = {(r["entity_type"], r["value"]): r for r in frames.findings.collect()}
    assert rows["IBAN_CODE", "DE89 3704 0044 0532 0130 00"]["validated"] is True and rows["IBAN_CODE", "DE89370400440532013001"]["score"] == 0.4
    assert rows["EMAIL_ADDRESS", "info@example.com"]["context"].startswith("Bergrnann schrieb an [info@example.com] und")


def test_review(frames, spark):
    groups = {(r["doc_id"], r["entity_type"], r["value_key"]): r for r in frames.groups.collect()}
    name = groups["d1", "PERSON", "bergmann"]
    assert name["count"] == 3 and not name["is_ner_guess"] and not name["demoted"] and name["action"] == "pseudonymize"
    assert groups["d1", "DE_HEALTH_DATA", "asthma"]["action"] == "anonymize"
    assert {r["value_key"] for r in frames.misses.collect()} == {"vertrag 99887766"[8:]} or {r["value_key"] for r in frames.misses.collect()} == {"99887766"}
    s = frames.stats.first()
    assert s["units_scanned"] == 6 and s["distinct_findings"] == len(groups) and s["demoted"] == 0
    assert review.export_rows(frames.groups, frames.misses).count() == len(groups) + 1
    assert [r["data_class"] for r in review.in_order(frames.groups).collect()][0] == "people"
    assert review.summary(frames.groups).where("entity_type is null and data_class is null and tier is null").first()["findings"] == len(groups)
    assert {r["token"] for r in review.preview(frames.groups).collect()} >= {"[PERSON_#]", "[HEALTH_DATA]", "[REDACTED]"}


def test_apply_verify_restore(frames, spark, tmp_path):
    decisions = plans.decisions_of(frames.groups)
    folder, mapping = plans.apply(frames, decisions, pseudonymize.Mapping.empty(spark), f"file://{tmp_path}/out", cfg.Config(deny=("Geheimnis",)))
    out = {(r["doc_id"], r["unit_id"]): r["output"] for r in spark.read.parquet(folder).collect()}
    assert out["d1", "a"] == "Sehr geehrter Herr [PERSON_1], Ihre IBAN [IBAN_1] ist bekannt."
    assert out["d1", "b"].startswith("[PERSON_1] zahlte am [DATE_1], die AKTE_[PERSON_1]_2") or "[PERSON_1] zahlte" in out["d1", "b"]
    assert "[HEALTH_DATA]" in out["d1", "c"] and out["d2", "b"] == ""
    kept = pseudonymize.Mapping.load(spark, f"file://{tmp_path}/out._mapping")
    back = {(r["doc_id"], r["unit_id"]): r for r in pseudonymize.reidentify(spark.read.parquet(folder), kept, "output").collect()}
    assert back["d1", "a"]["restored"] == TEXTS[0][3] and back["d1", "a"]["restored_count"] == 2
    again, _ = plans.apply(frames, decisions, kept, f"file://{tmp_path}/out", cfg.Config(deny=("Geheimnis",)))
    assert again.endswith("out (2)")


def test_nothing_is_published_that_still_holds_a_value(frames, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pseudonymize, "spliced", lambda source, changes: source)
    with pytest.raises(verify.ResidualError):
        plans.apply(frames, plans.decisions_of(frames.groups), pseudonymize.Mapping.empty(spark), f"file://{tmp_path}/bad")
    assert not any(p.name.startswith("bad") for p in tmp_path.iterdir())


def test_residuals(spark):
    out = spark.createDataFrame([("d", "1", "see DE89 3704 0044 here"), ("d", "2", "[PERSON_1] and [IBAN_2]"), ("d", "3", "[Person]"), ("d", "4", "x ab y"), ("e", "1", "DE8937040044")], "doc_id string, unit_id string, output string")
    gone = spark.createDataFrame([("d", "DE8937040044"), ("d", "PERSON"), ("d", "ban_"), ("d", "ab")], "doc_id string, value string")
    got = {(r["doc_id"], r["unit_id"], r["value_key"]) for r in verify.literal_residual(out, gone).collect()}
    assert got == {("d", "1", "de8937040044"), ("d", "3", "person")}
    assert ("d", "4", "ab") in {(r["doc_id"], r["unit_id"], r["value_key"]) for r in verify.literal_residual(out, gone, always=("AB",)).collect()}
    assert verify.literal_residual(out, gone, headers=("Person", "de8937040044")).count() == 0


def test_mapping(spark, tmp_path):
    want = lambda rows: spark.createDataFrame([(t, v, (k,)) for k, (t, v) in enumerate(rows)], "entity_type string, value string, at struct<a:int>")
    entries = lambda m: {r["placeholder"]: r["original_value"] for r in m.entries.collect()}
    one = pseudonymize.Mapping.empty(spark).mint(want([("PERSON", "Bo"), ("PHONE_NUMBER", "1"), ("PERSON", " bo "), ("PERSON", "Al"), ("DE_PHONE", "2")]))
    assert entries(one) == {"PERSON_1": "Bo", "PERSON_2": "Al", "PHONE_1": "1", "PHONE_2": "2"}
    two = one.erase(["PERSON_2"]).mint(want([("PERSON", "Cy"), ("PERSON", "BO")]))
    assert entries(two) == {"PERSON_1": "Bo", "PERSON_3": "Cy", "PHONE_1": "1", "PHONE_2": "2"}, "numbers are never used again"
    assert entries(two.reset().mint(want([("PERSON", "Di")]))) == {"PERSON_4": "Di"} and entries(two.reset(True).mint(want([("PERSON", "Di")]))) == {"PERSON_1": "Di"}
    other = pseudonymize.Mapping.empty(spark).mint(want([("PERSON", "Zoe")]))
    with pytest.raises(ValueError):
        one.merge(other)
    assert entries(one.merge(pseudonymize.Mapping.empty(spark))) == entries(one)
    one.save(f"{tmp_path}/m", key="0123456789abcdef")
    assert entries(pseudonymize.Mapping.load(spark, f"{tmp_path}/m", key="0123456789abcdef")) == entries(one)
    assert "Bo" not in {r["original_value"] for r in spark.read.parquet(f"{tmp_path}/m/entries").collect()}
    with pytest.raises(Exception):
        pseudonymize.Mapping.load(spark, f"{tmp_path}/m", key="fedcba9876543210").entries.collect()
    with pytest.raises(Exception, match="could not be read back"):
        one.mint(want([("PRÜFUNG", "x")])).entries.collect()
    assert one.reverse("PERSON_2").first()[0] == "Al"


def test_corroboration(spark):
    rows = [
        ("PERSON", "Mueller", "AnchoredNameRecognizer"), ("PERSON", "Muellers", "SpacyRecognizer"), ("LOCATION", "mueller", "SpacyRecognizer"), ("PERSON", "Miiller", "SpacyRecognizer"), ("PERSON", "Hans-Mueller", "SpacyRecognizer"),
        ("PERSON", "Unbekannter", "SpacyRecognizer"), ("NER_MISC", "Kondoria", "oov_candidate"), ("IBAN_CODE", "X", "PatternRecognizer"), ("PERSON", "Seedling", "propagation"),
    ]
    df = spark.createDataFrame([("d", k, 0, 1, t, v, 0.86, s, None, "") for k, (t, v, s) in enumerate(rows)], "doc_id string, unit_ord int, start int, end int, entity_type string, value string, score double, source string, validated boolean, context string")
    got = {r["value_key"] + ":" + r["entity_type"]: r["demoted"] for r in review.corroborated(review.grouped(df)).collect()}
    assert {k for k, v in got.items() if v} == {"unbekannter:PERSON", "kondoria:NER_MISC", "seedling:PERSON"}


def test_cells(spark):
    cells = [("d", f"B{r}", r, "Kundenname", f"Hans Meier {chr(64 + r)}er") for r in range(2, 7)] + [("d", f"C{r}", r, "Projekt", v) for r, v in enumerate(["Nordlicht", "feld_name", "---"], 2)] + [("d", f"D{r}", r, "Notiz", "Freier Text") for r in (2,)] + [("d", "E2", 2, "IBAN", "DE89370400440532013000"), ("d", "F2", 2, "Text", "Nordlicht lief gut; 123456")]
    df = spark.createDataFrame([(d, u, r * 10, t, h, "s", u[0], r, "cell", "de") for d, u, r, h, t in cells], "doc_id string, unit_id string, unit_ord int, text string, header string, sheet string, col string, row int, kind string, lang string")
    got = {(r["unit_id"], r["entity_type"], r["value"]) for r in plans.scan(df, cfg.Config()).findings.collect()}
    assert ("B2", "PERSON", "Hans Meier Ber") in got and ("C2", "PROJECT", "Nordlicht") in got and ("D2", "DESCRIPTION", "Freier Text") in got and ("E2", "IBAN_CODE", "DE89370400440532013000") in got
    assert ("F2", "PROJECT", "Nordlicht") in got and ("C4", "PROJECT", "---") not in got


def test_context_and_model(spark):
    df = spark.createDataFrame([("1", "a", 0, "Konto 12345678", "de"), ("1", "b", 1, "Zahl 12345678", "de")], UNITS)
    from sparkveil.functions.rules import default_rules

    got = {r["unit_id"]: [f["entity_type"] for f in r["found"]] for r in detect.candidates(df, default_rules()).collect()}
    assert "DE_KONTONUMMER" in got["a"] and got["b"] == []

    def load():
        class Fake:
            def predict(self, texts, labels):
                return [[{"label": "person", "start": 0, "end": 5, "score": 0.9}, {"label": "person", "start": 0, "end": 1, "score": 0.1}] for _ in texts]

        return Fake()

    told = {r["text"]: r["model_found"] for r in model.findings(df, load).collect()}
    assert [(f["value"], f["source"]) for f in told["Konto 12345678"]] == [("Konto", "GLiNER")]
    joined = df.join(model.findings(df, load), "text", "left")
    rows = detect.candidates(joined, [], extra=F.col("model_found")).collect()
    assert all([f["entity_type"] for f in r["found"]] == ["PERSON"] for r in rows)


def test_gate(spark):
    cases = [
        (("LOCATION", "abdeckung", "SpacyRecognizer", 0.85), True), (("PERSON", "abdeckung", "SpacyRecognizer", 0.85), False), (("PERSON", "UI_Label", "SpacyRecognizer", 0.85), True), (("ORGANIZATION", "CAPEX", "", 0.85), True),
        (("PERSON", "BP-002", "propagation", 0.85), True), (("PERSON", "Hans\nStr 5", "SpacyRecognizer", 0.85), False), (("PERSON", "BP-002", "whole_cell_override", 0.8), False), (("NER_MISC", "CAPEX", "GLiNER", 0.9), False),
        (("DATE_TIME", "a_1", "SpacyRecognizer", 0.85), True), (("IBAN_CODE", "DE12", "SpacyRecognizer", 0.5), False),
    ]
    df = spark.createDataFrame([(k, (0, 1, t, v, s, src, None)) for k, ((t, v, src, s), _) in enumerate(cases)], f"k int, f {FINDINGS[6:-1]}")
    assert [r["g"] for r in df.orderBy("k").select(detect.gate(F.col("f")).alias("g")).collect()] == [w for _, w in cases]


def test_scores(spark):
    manifest = spark.createDataFrame([("d", "u", "Hans Meier", "must_catch"), ("d", "v", "Meier", "must_catch"), ("d", "u", "Hansestadt", "must_not_catch"), ("d", "u", "Berg", "must_not_catch")], "doc_id string, unit_id string, value string, kind string")
    findings = spark.createDataFrame([("d", "u", "PERSON", "Hans"), ("d", "u", "PERSON", "Meier"), ("d", "u", "DATE_TIME", "Bergbau")], "doc_id string, unit_id string, entity_type string, value string")
    assert {r["kind"]: (r["total"], r["claimed"]) for r in evaluate.score(manifest, findings).collect()} == {"must_catch": (2, 1), "must_not_catch": (2, 1)}


def test_config(tmp_path):
    base = cfg.Config()
    for name in cfg.PROFILES:
        made = cfg.apply_profile(base, name, sensitivity=0.2)
        assert made.sensitivity == 0.2 and made.profile == name and not made.ml
    assert cfg.apply_profile(base, "HR documents").settings["PERSON"] == ("anonymize", 0.6) and cfg.apply_profile(base, "Contracts", ml_available=True).ml
    cfg.save_config(base, f"{tmp_path}/c.json")
    assert cfg.config_hash(cfg.load_config(f"{tmp_path}/c.json")) == cfg.config_hash(base) != cfg.config_hash(cfg.Config(sensitivity=0.1))
    (tmp_path / "bad.json").write_text('{"nonsense": 1}')
    with pytest.raises(ValueError):
        cfg.load_config(f"{tmp_path}/bad.json")
    rules = base.rules()
    assert cfg.merge_new_rules([], rules, {r.entity for r in rules}) == [] and len(cfg.merge_new_rules(rules[:1], rules, set())) > 50
    assert cfg.new_terms(("a",), ("A", "b"), ()) == ["b"] and "sensitivity=0" in cfg.provenance(base)


def test_seeds(spark):
    df = spark.createDataFrame([("d", "PERSON", "Herr Hans von Meier\nX"), ("d", "PERSON", "Bo"), ("d", "LOCATION", "Berlin")], "doc_id string, entity_type string, value string")
    assert {r["seed"] for r in document.seeds(df).collect()} == {"Hans von Meier", "Meier"}


def test_language_counts_every_unit(spark):
    from sparkveil.plans.scan import with_language

    # more than 200,000 characters in 1,000 units: those of even place are English, the others German and more
    rows = [("d", str(k), k, ("the and of to " if k % 2 == 0 else "der das und sie nicht ein eine ") + "x" * 250) for k in range(1000)]
    units = spark.createDataFrame(rows, "doc_id string, unit_id string, unit_ord int, text string")
    assert {(r["lang"], r["lang_confident"]) for r in with_language(units, ("en", "de")).collect()} == {("de", True)}


def test_pos_veto(spark):
    tags = "array<struct<start:int,end:int,pos:string>>"
    rows = [
        ("genehmigt", "PERSON", [(0, 9, "VERB")], True), ("Bauer", "PERSON", [(0, 5, "NOUN")], False), ("Schmidt", "PERSON", [(0, 7, "PROPN")], False), ("alle Ziele", "PERSON", [(0, 4, "DET"), (5, 10, "NOUN")], False),
        ("Mueller", "PERSON", [(0, 12, "CONJ")], False), ("Genehmigung", "LOCATION", [(0, 11, "NOUN")], True), ("Genehmigung", "LOCATION", [(0, 11, "PROPN")], False), ("Nutzung", "LOCATION", [(0, 7, "NOUN")], False),
        ("genehmigt", "PERSON", None, False), ("Genehmigung", "PERSON", None, False),
    ]
    df = spark.createDataFrame([(k, v, e, t, w) for k, (v, e, t, w) in enumerate(rows)], f"k int, v string, e string, tags {tags}, want boolean")
    f = detect.finding(F.lit(0), F.length("v"), F.col("e"), F.col("v"), 0.85, detect.MODEL_SOURCE)
    for r in df.withColumn("got", detect.gate(f, vetoed=detect.pos_veto(F.col("tags")))).collect():
        assert r["got"] == r["want"] or (r["v"].islower() and r["e"] == "LOCATION"), r
    units = df.select(F.col("v").alias("text"), F.lit("de").alias("lang"), "tags", "want", F.array(f).alias("model"))
    for r in detect.candidates(units, [], extra=F.col("model"), tags="tags").collect():
        assert (len(r["found"]) == 0) == r["want"], r


def test_languages_of_sheets_and_cells(spark):
    from sparkveil.plans.scan import scan, sniff_language, with_cell_language

    german, english = "Der Vertrag und die Anlage sind nicht bei uns.", "The contract and the annex are with you, please."
    rows = [("d", f"u{k}", k, t, "Text", s, "A", k + 2) for k, (s, t) in enumerate([("de", german)] * 3 + [("en", english)] * 3 + [("de", "kurz"), ("en", "short"), ("de", english), ("leer", "12345")])]
    rows.append(("d", "title", 99, "Titel", None, None, None, None))
    units = spark.createDataFrame(rows, "doc_id string, unit_id string, unit_ord int, text string, header string, sheet string, col string, row int")
    got = {r["unit_id"]: r["lang"] for r in with_cell_language(units).collect()}
    assert [got[f"u{k}"] for k in range(10)] == ["de"] * 3 + ["en"] * 3 + ["de", "en", "en", "de"] and got["title"] in ("de", "en")
    assert {r["unit_id"]: r["lang"] for r in scan(units).units.select("unit_id", "lang").collect()} == got
    assert sniff_language(units.where("sheet = 'en'")) == ("en", True) and sniff_language(units.limit(0)) == ("de", False) and sniff_language(spark.range(1)) == ("de", False)


def test_keys_of_mappings(spark, tmp_path):
    key, other = "k" * 16, "o" * 32
    mapping = pseudonymize.Mapping.empty(spark).mint(spark.createDataFrame([("PERSON", "Anna", (1,)), ("PERSON", "Bo", (2,))], "entity_type string, value string, at struct<a:int>"))
    folder = f"file://{tmp_path}/m"
    mapping.save(folder, key)
    rows = lambda m: sorted(map(tuple, m.entries.collect()))
    assert rows(pseudonymize.Mapping.load(spark, folder, key)) == rows(mapping)
    plan = pseudonymize.Mapping.load(spark, folder, key).entries._jdf.queryExecution().toString()
    assert key not in plan
    for wrong in (None, other):
        with pytest.raises(pseudonymize.KeyLost):
            pseudonymize.Mapping.load(spark, folder, wrong)
    turned = pseudonymize.Mapping.rotate(spark, folder, key, other, f"{folder}2")
    assert rows(turned) == rows(mapping)
    with pytest.raises(pseudonymize.KeyLost):
        pseudonymize.Mapping.load(spark, f"{folder}2", key)
    mapping.save(f"{folder}3", key)
    import shutil

    shutil.rmtree(tmp_path / "m3" / "entries")
    with pytest.raises(pseudonymize.MappingDamaged):
        pseudonymize.Mapping.load(spark, f"{folder}3", key)
    with pseudonymize.lock(spark, folder), pytest.raises(TimeoutError):
        with pseudonymize.lock(spark, folder, timeout=0.3):
            pass
    with pseudonymize.lock(spark, folder, timeout=0.3):
        pass


def test_sealed_lists(spark, tmp_path):
    config = cfg.Config(deny=("Hans Meier",), allow=("Feldmann",), sensitivity=0.1)
    cfg.save_sealed(spark, config, f"{tmp_path}/c.json", "k" * 16)
    said = (tmp_path / "c.json").read_text()
    assert "Meier" not in said and "Feldmann" not in said and "0.1" in said
    assert cfg.config_hash(cfg.load_sealed(spark, f"{tmp_path}/c.json", "k" * 16)) == cfg.config_hash(config)
    with pytest.raises(ValueError, match="does not fit"):
        cfg.load_sealed(spark, f"{tmp_path}/c.json", "x" * 16)


def test_long_lists(spark):
    import time

    names = [f"name{k}" for k in range(50_000)] + ["anna", "o'neil", "back\\slash"]
    units = spark.createDataFrame([("Kunde: Anna Koch", "de"), ("Kunde: Bernd Koch", "de")], "text string, lang string")
    began = time.time()
    found = detect.candidates(units, [r for r in detect_rules() if r.entity == "PERSON"], given_names=names, products=names)
    got = {r["found"][0]["value"]: r["found"][0]["source"] for r in found.collect()}
    assert got == {"Anna Koch": detect.GIVEN_NAME, "Bernd Koch": "AnchoredNameRecognizer"} and time.time() - began < 60


def detect_rules():
    from sparkveil.functions.rules import default_rules

    return default_rules()
