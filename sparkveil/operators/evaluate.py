"""Measuring: planted values in generated letters and cells, and a scorer for what must and must not be found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Our own: names that letters are addressed to.
GIVEN = ("Anna", "Bernd", "Clara", "Dieter", "Emma", "Frank", "Greta", "Hans", "Ida", "Jonas")
SURNAMES = ("Mueller", "Koch", "Bergmann", "Stark", "Winter", "Okafor", "Lindqvist", "Yilmaz", "Petrov", "Sanchez")
#: Our own: surnames by what makes them hard. All of a stratum are asked for in all contexts.
STRATA = {
    "common_noun": ("Zimmermann", "Winter", "Stern", "Vogt", "Kaiser", "Linde"),
    "rare": ("Oelschlegel", "Brinkhaus", "Tiedemann", "Rautenstrauch", "Hellwege"),
    "foreign": ("Okafor", "Lindqvist", "Yilmaz", "Petrov", "Sanchez", "Kowalska"),
    "particle": ("von Arnstedt", "van der Meulen", "de Boer", "zu Rantzau", "von der Heide"),
    "hyphenated": ("Stark-Winter", "Voss-Albrecht", "Lange-Reimann"),
    "transliterated": ("Đukić", "Šimková", "Ångström", "Phạm", "Þorsteinsson"),
    "scanned": ("Bergrnann", "Lirnbach", "Wlnter", "Tiedernann"),
}
#: Contexts: what stands before and after the name, with {g} for the given name; whether the name is written otherwise.
CONTEXTS = {
    "salutation": ("Guten Tag, Frau ", ", wir haben Post für Sie.", None),
    "full_name": ("{g} ", " ruft morgen wieder an.", None),
    "oblique": ("Das Gutachten hat ", " selbst gelesen.", None),
    "label": ("Ansprechpartner: ", "", None),
    "bare": ("", "", None),
    "signature": ("Viele Grüße, Herr {g} ", "", None),
    "initial": ("gez. {i}. ", ", am Montag", None),
    "role": ("Der Notar ", " ist verreist.", None),
    "list": ("An: Einkauf, ", ", Lager", None),
    "birth_name": ("Sie heißt heute anders, geb. ", ", und wohnt in Ulm.", None),
    "preposition": ("Das klären wir gemeinsam mit ", " im Mai.", None),
    "bare_upper": ("", "", "upper"),
    "bare_lower": ("", "", "lower"),
    "label_upper": ("ANSPRECHPARTNER: ", "", "upper"),
    "file_name": ("Ordner_", "_alt", None),
    "path": ("/ablage/Rechnung_", "_3.xlsx", None),
}
#: Contexts whose words alone give the name away.
ANCHORED = ("salutation", "label", "signature", "initial", "role", "birth_name", "label_upper")
#: Facts of special categories: entity type, what must go, and the sentence around it. The last ones name nothing that any list of a rule holds;
#: in the inverted one the words of a frame do not stand together, and no rule finds it.
SPECIAL_PROBES = {
    "aid": ("DE_HEALTH_DATA", "Rollstuhl", "Für den {v} fehlt am Eingang eine Rampe."),
    "therapy": ("DE_HEALTH_DATA", "Dialyse", "Montags ist sie bei der {v} und nicht im Büro."),
    "place": ("DE_RELIGION", "Synagoge", "Das Fest war in der {v} am Markt."),
    "feast": ("DE_RELIGION", "Pessach", "An {v} bleibt der Laden zu."),
    "body": ("DE_UNION_PARTY", "Personalrat", "Der {v} hat am Freitag zugestimmt."),
    "party": ("DE_UNION_PARTY", "SPD", "Sie tritt im Herbst für die {v} an."),
    "partner": ("DE_SEX_LIFE", "ihrer Partnerin", "Sie kam mit {v} zum Gespräch."),
    "origin": ("NRP", "Aussiedler", "Als {v} kamen die Eltern nach Kassel."),
    "unlisted_illness": ("DE_HEALTH_DATA", "Zöliakie", "Der Arzt meint, dass er erkrankt an {v}."),
    "inverted_illness": ("DE_HEALTH_DATA", "Zöliakie", "Seit Jahren litt sie unter einer {v}."),
    "unlisted_state": ("DE_HEALTH_DATA", "Schulterluxation", "Im April war er arbeitsunfähig wegen einer {v}."),
    "unlisted_faith": ("DE_RELIGION", "Taoismus", "Schon lange ist sie übergetreten zum {v}."),
    "unlisted_body": ("DE_UNION_PARTY", "Vertreterversammlung", "Man hat ihn in die {v} berufen."),
    "unlisted_descent": ("NRP", "usbekischstämmig", "Sie ist {v} und wohnt in Ulm."),
}


def pick(values: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(n, F.lit(len(values))) + 1).cast("int"))


def check_digits(bban: Column) -> Column:
    """The two check digits of a German IBAN with an 18-digit account part."""
    rest = F.aggregate(F.split(F.concat(bban, F.lit("131400")), ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def letters(customer: DataFrame) -> DataFrame:
    """Five units for each customer: salutation, prose with an account, a labelled field, a bare name, a signature; and what is planted."""
    n = F.col("c_custkey")
    given, surname = pick(GIVEN, n), pick(SURNAMES, F.floor(n / 10))
    bban = F.concat(F.lit("50010517"), F.lpad(n.cast("string"), 10, "0"))
    iban = F.concat(F.lit("DE"), check_digits(bban), bban)
    full = F.concat_ws(" ", given, surname)
    units = F.array(
        *[
            F.struct(F.lit(k).alias("k"), said.alias("text"), planted.alias("planted"), F.lit(kind).alias("entity_type"), F.lit(context).alias("context_kind"))
            for k, (said, planted, kind, context) in enumerate((
                (F.concat(F.lit("Sehr geehrter Herr "), surname, F.lit(", wir danken für Ihre Nachricht.")), surname, "PERSON", "salutation"),
                (F.concat(F.lit("Bitte überweisen Sie auf das Konto "), iban, F.lit(" und nennen Sie den Zweck.")), iban, "IBAN_CODE", "prose"),
                (F.concat(F.lit("Kunde: "), full), full, "PERSON", "label"),
                (F.concat(F.lit("Das Schreiben an "), surname, F.lit(" liegt bei.")), surname, "PERSON", "bare"),
                (F.concat(F.lit("Mit freundlichen Grüßen, Frau "), full), full, "PERSON", "signature"),
            ))
        ]
    )
    made = customer.select(F.col("c_custkey").cast("string").alias("doc_id"), F.explode(units).alias("u"))
    return made.select("doc_id", F.concat(F.lit("p"), F.col("u.k").cast("string")).alias("unit_id"), F.col("u.k").cast("long").alias("unit_ord"), "u.text", "u.planted", "u.entity_type", "u.context_kind")


def identifying(name: Column) -> Column:
    """The words of a name that must go: without particles in front, and both halves of a double name."""
    from ..functions.text import PARTICLES

    bare = F.regexp_replace(name, rf"^(?:(?:{'|'.join(PARTICLES)}) )+", "")
    return F.filter(F.split(bare, r"(?U)[\s-]+"), lambda w: w != "")


def planted_names(customers: DataFrame) -> DataFrame:
    """A name of each stratum in each context, in turn by customer (column n): units, with planted, stratum, context_kind."""
    places = [(k, s, c, *CONTEXTS[c], list(STRATA[s])) for k, (s, c) in enumerate((s, c) for s in STRATA for c in CONTEXTS)]
    table = customers.sparkSession.createDataFrame(places, "k int, stratum string, context_kind string, before string, after string, written string, names array<string>")
    n = F.col("n")
    joined = customers.join(F.broadcast(table), F.pmod(n, F.lit(len(places))) == F.col("k"))  # a row for each place
    given = pick(GIVEN, n)
    name = F.element_at("names", (F.pmod(F.floor(n / len(places)), F.size("names")) + 1).cast("int"))
    name = F.when(F.col("written") == "upper", F.upper(name)).when(F.col("written") == "lower", F.lower(name)).otherwise(name)
    lead = F.replace(F.replace(F.col("before"), F.lit("{g}"), given), F.lit("{i}"), F.substring(given, 1, 1))
    return joined.select(
        n.cast("string").alias("doc_id"), F.lit("u").alias("unit_id"), F.lit(0).cast("long").alias("unit_ord"), F.lit("PERSON").alias("entity_type"), F.concat(lead, name, "after").alias("text"), name.alias("planted"), "stratum", "context_kind"
    )


def planted_facts(customers: DataFrame) -> DataFrame:
    """A sentence with a fact of a special category, in turn by customer (column n): units, with planted, entity_type, context_kind."""
    made = [F.struct(F.lit(said.replace("{v}", v)).alias("text"), F.lit(v).alias("planted"), F.lit(e).alias("entity_type"), F.lit(k).alias("context_kind")) for k, (e, v, said) in SPECIAL_PROBES.items()]
    one = F.element_at(F.array(*made), (F.pmod("n", F.lit(len(made))) + 1).cast("int"))
    return customers.select(F.col("n").cast("string").alias("doc_id"), F.lit("u").alias("unit_id"), F.lit(0).cast("long").alias("unit_ord"), one.alias("u")).select("doc_id", "unit_id", "unit_ord", "u.*")


def covered(value: Column, found: Column) -> Column:
    """Whether findings, taken together, cover all words of a value. found: array of texts."""
    words = identifying(F.lower(value))
    told = F.flatten(F.transform(found, lambda f: F.split(F.lower(f), r"(?U)[\s-]+")))
    return F.forall(words, lambda w: F.array_contains(told, w))


def recall(planted: DataFrame, findings: DataFrame) -> DataFrame:
    """Per entity type and context: planted occurrences, those found in their own unit, and the share."""
    told = findings.groupBy("doc_id", "unit_id").agg(F.collect_list("value").alias("_found"))
    scored = planted.join(told, ["doc_id", "unit_id"], "left").withColumn("hit", covered(F.col("planted"), F.coalesce("_found", F.array().cast("array<string>"))))
    out = scored.groupBy("entity_type", "context_kind").agg(F.count(F.lit(1)).alias("total"), F.count_if("hit").alias("found"))
    return out.withColumn("recall", F.col("found") / F.col("total"))


def score(manifest: DataFrame, findings: DataFrame, harmless: tuple[str, ...] = ("dates_other", "unmatched")) -> DataFrame:
    """Per kind (must_catch, must_not_catch): how many values were claimed, occurrence by occurrence.

    A secret counts as caught if findings of its unit cover it; a decoy as claimed if a finding holds it or it holds one.
    """
    from ..functions import taxonomy

    kept = findings.where(~taxonomy.data_class(F.col("entity_type")).isin(*harmless))
    told = kept.groupBy("doc_id", "unit_id").agg(F.collect_list("value").alias("_found"))
    joined = manifest.join(told, ["doc_id", "unit_id"], "left").withColumn("_found", F.coalesce("_found", F.array().cast("array<string>")))
    low = F.lower("value")
    either = F.exists("_found", lambda f: F.contains(F.lower(f), low) | F.contains(low, F.lower(f)))
    hit = F.when(F.col("kind") == "must_catch", covered(F.col("value"), F.col("_found"))).otherwise(either)
    return joined.groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("claimed"))


__all__ = ["check_digits", "covered", "identifying", "letters", "pick", "planted_facts", "planted_names", "recall", "score"]
