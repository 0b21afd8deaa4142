"""Check digits and shapes of identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VALID_SCORE, INVALID_SCORE = 0.98, 0.4
# Fixed value: weights of the social security number's twelve digits.
SV_WEIGHTS = (2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _chars(value: Column) -> Column:
    return F.split(value, "")


def luhn_valid(value: Column) -> Column:
    """At least 12 digits, and the mod-10 sum."""
    d = digits(value)
    return F.coalesce((F.length(d) >= 12) & F.call_function("luhn_check", d), F.lit(False))


def iban_valid(value: Column) -> Column:
    """Shape and mod 97; the remainder is carried from character to character."""
    compact = F.upper(F.regexp_replace(value, r"(?U)\s+", ""))
    turned = F.concat(F.substring(compact, 5, 40), F.substring(compact, 1, 4))
    code = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(_chars(turned), F.lit(0), lambda a, c: F.when(c.between("0", "9"), a * 10 + code(c)).otherwise(a * 100 + F.ascii(c) - 55) % 97)
    return F.when(compact.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}$"), rest == 1).otherwise(False)


def countries(spark: SparkSession) -> list[str]:
    """The two-letter country codes of ISO 3166, as the JVM knows them."""
    return sorted(spark._jvm.java.util.Locale.getISOCountries())


def bic_valid(value: Column, codes: list[str]) -> Column:
    """8 or 11 characters with a country in places 5 and 6."""
    v = F.upper(F.trim(value))
    return F.coalesce(v.rlike(r"^[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?$") & F.substring(v, 5, 2).isin(*codes), F.lit(False))


def steuer_id_valid(value: Column) -> Column:
    """11 digits, no leading zero, one digit two or three times among the first ten, check digit by ISO 7064 MOD 11,10."""
    d = digits(value)
    ten = F.slice(_chars(d), 1, 10)
    counts = F.transform(F.array_distinct(ten), lambda x: F.size(F.filter(ten, lambda y: y == x)))
    one_repeats = (F.size(F.filter(counts, lambda n: n >= 2)) == 1) & ~F.exists(counts, lambda n: n > 3)
    step = lambda p, c: F.when((c.cast("int") + p) % 10 == 0, 20).otherwise(2 * ((c.cast("int") + p) % 10)) % 11
    product = F.aggregate(ten, F.lit(10), step)
    return F.when((F.length(d) == 11) & ~d.startswith("0"), one_repeats & ((11 - product) % 10 == F.substring(d, 11, 1).cast("int"))).otherwise(False)


def sv_nummer_valid(value: Column) -> Column:
    """Area 02 to 89, a possible day and month, and the weighted digit sums mod 10."""
    v = F.upper(F.regexp_replace(value, r"(?U)[\s.\-/]", ""))
    part = lambda at, n: F.substring(v, at, n).cast("int")
    body = F.concat(F.substring(v, 1, 8), F.lpad((F.ascii(F.substring(v, 9, 1)) - 64).cast("string"), 2, "0"), F.substring(v, 10, 2))
    weights = F.array(*[F.lit(w) for w in SV_WEIGHTS])
    products = F.zip_with(_chars(body), weights, lambda c, w: c.cast("int") * w)
    total = F.aggregate(products, F.lit(0), lambda a, p: a + F.floor(p / 10).cast("int") + p % 10)
    fits = part(1, 2).between(2, 89) & part(3, 2).between(1, 31) & part(5, 2).between(1, 12)
    return F.when(v.rlike(r"^[0-9]{8}[A-Z][0-9]{3}$"), fits & (total % 10 == part(12, 1))).otherwise(False)


def validate(entity_type: Column, value: Column) -> Column:
    """True or false where a checksum applies, else null."""
    return (
        F.when(entity_type == "IBAN_CODE", iban_valid(value))
        .when(entity_type == "CREDIT_CARD", luhn_valid(value))
        .when(entity_type == "DE_STEUER_ID", steuer_id_valid(value))
        .when(entity_type == "DE_SV_NUMMER", sv_nummer_valid(value))
    )


def refine(score: Column, validated: Column) -> Column:
    """A passed checksum lifts the score, a failed one lowers it."""
    return F.when(validated, F.greatest(score, F.lit(VALID_SCORE))).when(~validated, F.least(score, F.lit(INVALID_SCORE))).otherwise(score)
