"""Data classes, entity types, tiers and token labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Data classes as (key, display, sensitivity), in display order.
DATA_CLASSES = (
    ("people", "People", "high"),
    ("special_category", "Special category (GDPR Art. 9)", "high"),
    ("government_ids", "Government IDs", "high"),
    ("financial_ids", "Financial IDs", "high"),
    ("contact", "Contact details", "medium"),
    ("bank_internal", "Bank-internal refs", "medium"),
    ("internal_topical", "Internal / topical", "medium"),
    ("org_places", "Organizations & places", "medium"),
    ("other_entities", "Other named entities", "medium"),
    ("dates_other", "Dates & other", "low"),
    ("topical_candidates", "Possible internal/topical terms", "low"),
    ("unmatched", "Possible misses (unmatched)", "low"),
)
# Entity types of each class. Any other type is in other_entities.
CLASS_ENTITIES = {
    "people": "PERSON",
    "special_category": "NRP DE_HEALTH_DATA DE_RELIGION DE_UNION_PARTY DE_SEX_LIFE",
    "government_ids": "DE_STEUER_ID DE_SV_NUMMER",
    "financial_ids": "IBAN_CODE CREDIT_CARD DE_KONTONUMMER DE_DEPOTNUMMER BIC_CODE",
    "contact": "EMAIL_ADDRESS PHONE_NUMBER DE_PHONE DE_ADDRESS",
    "bank_internal": "BANK_INTERNAL_REF DE_KUNDENNUMMER DENY_LIST URL",
    "internal_topical": "TOOL DIVISION DEPARTMENT LICENSEE PROJECT DESCRIPTION",
    "org_places": "ORGANIZATION ORG LOCATION GPE",
    "other_entities": "NER_MISC",
    "dates_other": "DATE_TIME",
    "topical_candidates": "POSSIBLE_TOPICAL",
    "unmatched": "POSSIBLE_MISS",
}
OTHER = "other_entities"
SPECIAL = tuple(CLASS_ENTITIES["special_category"].split())
NER_ENTITIES = ("PERSON", "LOCATION", "ORGANIZATION", "GPE", "NRP", "NER_MISC")
GATED_NOISE = ("NER_MISC", "ORGANIZATION", "LOCATION")
CORROBORATION_ONLY = ("NER_MISC", "ORGANIZATION", "LOCATION", "PERSON")
TIER_HIGH, TIER_MEDIUM = 0.9, 0.5

# Token labels; a type that is not listed is its own label.
TOKEN_LABELS = {
    "ORGANIZATION": "ORG", "GPE": "LOCATION", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "DE_PHONE": "PHONE", "IBAN_CODE": "IBAN", "CREDIT_CARD": "CARD",
    "DE_STEUER_ID": "STEUER_ID", "DE_SV_NUMMER": "SV_NUMMER", "DE_KONTONUMMER": "KONTO", "DE_DEPOTNUMMER": "DEPOT", "BIC_CODE": "BIC", "DE_ADDRESS": "ADDRESS",
    "DE_KUNDENNUMMER": "KUNDENNR", "BANK_INTERNAL_REF": "REF", "URL": "LINK", "DATE_TIME": "DATE", "NER_MISC": "ENTITY", "DENY_LIST": "REDACTED",
    "DE_HEALTH_DATA": "HEALTH_DATA", "DE_RELIGION": "RELIGION", "DE_UNION_PARTY": "UNION_PARTY", "DE_SEX_LIFE": "SEX_LIFE", "NRP": "ORIGIN", "DEPARTMENT": "DEPT",
    "PROJECT": "PROJEKT", "DESCRIPTION": "TEXT",
}

# Fixed values: (default action, confidence threshold) of entity types; the default is (anonymize, 0.5).
ENTITY_SETTINGS = {
    "PERSON": ("pseudonymize", 0.6), "ORGANIZATION": ("pseudonymize", 0.6), "LOCATION": ("pseudonymize", 0.6), "EMAIL_ADDRESS": ("pseudonymize", 0.5), "PHONE_NUMBER": ("pseudonymize", 0.5),
    "DE_PHONE": ("pseudonymize", 0.5), "URL": ("pseudonymize", 0.5), "DATE_TIME": ("pseudonymize", 0.5), "IBAN_CODE": ("pseudonymize", 0.4), "CREDIT_CARD": ("anonymize", 0.4),
    "DE_STEUER_ID": ("anonymize", 0.6), "DE_SV_NUMMER": ("anonymize", 0.7), "DE_KONTONUMMER": ("pseudonymize", 0.6), "DE_DEPOTNUMMER": ("pseudonymize", 0.6), "BANK_INTERNAL_REF": ("pseudonymize", 0.5),
    "NER_MISC": ("pseudonymize", 0.75), "NRP": ("anonymize", 0.5), "DE_HEALTH_DATA": ("anonymize", 0.5), "DE_RELIGION": ("anonymize", 0.5), "DE_UNION_PARTY": ("anonymize", 0.5),
    "DE_SEX_LIFE": ("anonymize", 0.5), "BIC_CODE": ("pseudonymize", 0.5), "DE_ADDRESS": ("pseudonymize", 0.5), "DE_KUNDENNUMMER": ("pseudonymize", 0.6), "TOOL": ("pseudonymize", 0.5),
    "DIVISION": ("pseudonymize", 0.5), "DEPARTMENT": ("pseudonymize", 0.5), "LICENSEE": ("pseudonymize", 0.5), "PROJECT": ("pseudonymize", 0.5), "DESCRIPTION": ("summarize", 0.5),
    "POSSIBLE_TOPICAL": ("skip", 0.5),
}


def lookup(key: Column, values: dict, default: Column) -> Column:
    """A literal map applied to a column."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default) if pairs else default


def data_class(entity_type: Column) -> Column:
    return lookup(entity_type, {e: c for c, es in CLASS_ENTITIES.items() for e in es.split()}, F.lit(OTHER))


def class_order(key: Column) -> Column:
    return lookup(key, {c[0]: k for k, c in enumerate(DATA_CLASSES)}, F.lit(len(DATA_CLASSES)))


def is_special(entity_type: Column) -> Column:
    return entity_type.isin(*SPECIAL)


def tier(score: Column, high: float = TIER_HIGH, medium: float = TIER_MEDIUM) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def token_label(entity_type: Column) -> Column:
    return lookup(entity_type, TOKEN_LABELS, entity_type)


def default_action(entity_type: Column, settings: dict | None = None) -> Column:
    return lookup(entity_type, {e: a for e, (a, _) in (settings or ENTITY_SETTINGS).items()}, F.lit("anonymize"))


def threshold(entity_type: Column, settings: dict | None = None) -> Column:
    return lookup(entity_type, {e: t for e, (_, t) in (settings or ENTITY_SETTINGS).items()}, F.lit(0.5))


def class_table(spark: SparkSession) -> DataFrame:
    """data_class, display, sensitivity, class_order."""
    return spark.createDataFrame([(*c, k) for k, c in enumerate(DATA_CLASSES)], "data_class string, display string, sensitivity string, class_order int")
