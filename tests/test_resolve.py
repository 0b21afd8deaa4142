"""The fold against a plain version of the rule."""

import random

from pyspark.sql import functions as F

from sparkveil.functions import taxonomy
from sparkveil.operators.detect import FINDINGS
from sparkveil.operators.resolve import resolved

NAMES = ("start", "end", "entity_type", "value", "score", "source", "validated")
WEAK = ("SpacyRecognizer", "propagation")


def over(a, b):
    return a["start"] < b["end"] and b["start"] < a["end"]


def plain(found, text):
    rank = lambda f: (f["entity_type"] not in taxonomy.SPECIAL, f["start"] - f["end"], f["validated"] is None, -f["score"], f["entity_type"] in taxonomy.NER_ENTITIES, f["entity_type"], f["start"], f["end"], f["value"], f["source"], f["validated"] is not None, bool(f["validated"]))
    kept = []
    for f in sorted(found, key=rank):
        f = dict(f, carved=[])
        met = [k for k in kept if over(f, k)]
        home = [k for k in met if k["start"] <= f["start"] and f["end"] <= k["end"]]
        first = home[0] if home else met[0] if met else None
        if first is None:
            kept.append(f)
            continue
        if first["source"] in WEAK and f["source"] not in (*WEAK, ""):
            first["source"] = f["source"]
        if home:
            if first["entity_type"] in taxonomy.SPECIAL and (f["entity_type"] == "PERSON" or f["validated"]):
                first["carved"].append(f)
            continue
        kept = [k for k in kept if k is first or k not in met]
        first["start"], first["end"] = min(f["start"], *(k["start"] for k in met)), max(f["end"], *(k["end"] for k in met))
        first["value"], first["validated"] = text[first["start"] : first["end"]], None
    out = []
    for p in kept:
        chosen = []
        for s in p["carved"]:
            if p["start"] <= s["start"] and s["end"] <= p["end"] and not any(over(s, c) for c in chosen):
                chosen.append(s)
        chosen.sort(key=lambda s: s["start"])
        gaps, at = [], p["start"]
        for s in [*chosen, {"start": p["end"], "end": p["end"]}]:
            raw = text[at : s["start"]] if s["start"] > at else ""
            if any(c.isalpha() for c in raw):
                a = at + len(raw) - len(raw.lstrip())
                gaps.append(dict(p, start=a, end=a + len(raw.strip()), value=raw.strip()))
            at = s["end"]
        out += gaps + chosen if chosen and gaps else [p]
    return sorted((tuple(f[n] for n in NAMES) for f in out), key=lambda t: t[0])


def test_against_a_plain_version(spark):
    rng = random.Random(7)
    units = []
    for k in range(1500):
        text = "".join(rng.choice("ab ,.é") for _ in range(24))
        found = []
        for _ in range(rng.randrange(9)):
            a = rng.randrange(23)
            b = rng.randrange(a + 1, 25)
            kind = rng.choice(("PERSON", "LOCATION", "IBAN_CODE", "DE_HEALTH_DATA", "NRP", "DE_PHONE"))
            found.append((a, b, kind, text[a:b], rng.choice((0.4, 0.6, 0.85)), rng.choice((*WEAK, "", "pattern", "given_name")), rng.choice((None, None, True, False))))
        units.append((k, text, found))
    df = spark.createDataFrame(units, f"k int, text string, found {FINDINGS}")
    got = {r["k"]: [tuple(f) for f in r["f"]] for r in df.select("k", resolved("found", "text").alias("f")).collect()}
    for k, text, found in units:
        assert got[k] == plain([dict(zip(NAMES, f)) for f in found], text), (text, found)


def test_a_name_in_health_data_stays_reversible(spark):
    text = "Diagnose: Asthma bei Hans Meier, schwer"
    found = [(10, 39, "DE_HEALTH_DATA", text[10:], 0.86, "p", None), (21, 31, "PERSON", "Hans Meier", 0.86, "p", None)]
    df = spark.createDataFrame([(text, found)], f"text string, found {FINDINGS}")
    (r,) = df.select(resolved("found", "text").alias("f")).collect()
    assert [(f["entity_type"], f["value"]) for f in r["f"]] == [("DE_HEALTH_DATA", "Asthma bei"), ("PERSON", "Hans Meier"), ("DE_HEALTH_DATA", ", schwer")]
