"""Configuration: defaults, profiles, merging, provenance."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import taxonomy
from ..functions.rules import Rule, custom_rules, default_rules, deny_rule
from ..operators.document import TOPICAL

# Terms that are never findings.
ALLOW = tuple(
    "IBAN|BIC|Kunde|Kundin|Konto|Kontonummer|Depot|Depotnummer|Steuer-ID|Steuernummer|Sozialversicherungsnummer|Betrag|Datum|EUR|Euro|GmbH|Vertraulich|CAPEX|OPEX|RAG|DORA|GRC|DMS|CRM|KPI|ROI|LTV|FTE|PoC|MVP|RFP|OCR|LLM|KI|API|"
    "Baseline|Build|Backlog|Roadmap|Alerting|Onboarding|Reporting|Dashboard|Workflow|Review|Research|Status|Gate|To-Be|As-Is|Lessons Learned|Human-in-the-Loop|ReadOnly|Personas|Persona".split("|")
)


@dataclass(frozen=True)
class Config:
    languages: tuple[str, ...] = ("de", "en")
    allow: tuple[str, ...] = ALLOW
    deny: tuple[str, ...] = ()
    settings: dict = field(default_factory=lambda: dict(taxonomy.ENTITY_SETTINGS))
    sensitivity: float = 0.0
    tier_high: float = taxonomy.TIER_HIGH
    tier_medium: float = taxonomy.TIER_MEDIUM
    corroboration: bool = True
    topical: dict = field(default_factory=lambda: dict(TOPICAL))
    topical_terms: dict = field(default_factory=dict)
    name_headers: tuple[str, ...] = ()
    infer_name_columns: bool = True
    propagate: bool = True
    custom: tuple = ()
    given_names: tuple[str, ...] = ()
    products: tuple[str, ...] = ()
    stopwords: tuple[str, ...] = ()
    #: Ordinary words; with them, capitalised words that are none of them nor their compounds are candidates for products.
    vocabulary: tuple[str, ...] = ()
    ml_min_score: float = 0.3
    ml_trust: float = 0.85
    ml: bool = False
    profile: str | None = None

    def rules(self) -> list[Rule]:
        """Shipped and own rules, and the deny list."""
        own = custom_rules([dict(c) for c in self.custom])
        denied = deny_rule(list(self.deny))
        return [*default_rules(), *own, *([denied] if denied else [])]


# Fixed values: (sensitivity, least score and trust of a model, whether it asks for one, actions by class) of each profile.
_A, _P, _S = "anonymize", "pseudonymize", "skip"
PROFILES = {
    "Balanced (default)": None,
    "Contracts": (0.0, 0.5, 0.9, True, {"people": _P, "other_entities": _P, "special_category": _A, "org_places": _P, "contact": _P, "financial_ids": _P, "government_ids": _A, "bank_internal": _P, "dates_other": _S}),
    "Client statements": (0.05, 0.6, 0.9, True, {"people": _P, "other_entities": _P, "special_category": _A, "org_places": _P, "contact": _A, "financial_ids": _A, "government_ids": _A, "bank_internal": _P, "dates_other": _P}),
    "HR documents": (0.1, 0.35, 0.8, True, {"people": _A, "other_entities": _A, "special_category": _A, "org_places": _P, "contact": _A, "financial_ids": _A, "government_ids": _A, "bank_internal": _A, "dates_other": _P}),
    "Maximize recall (strip everything)": (0.15, 0.25, 0.7, True, {c[0]: _A for c in taxonomy.DATA_CLASSES}),
}


def apply_profile(config: Config, name: str, ml_available: bool = False, **call: object) -> Config:
    """A profile over a configuration; what the call names comes before both. It never turns a model off."""
    told = PROFILES.get(name)
    if told is None:
        return replace(config, profile=name, **call)
    sensitivity, least, trust, wants, actions = told
    settings = {e: (actions.get(_class_of(e), a), t) for e, (a, t) in config.settings.items()}
    made = replace(config, sensitivity=sensitivity, ml_min_score=least, ml_trust=trust, settings=settings, profile=name, ml=config.ml or (wants and ml_available))
    return replace(made, **call)


def _class_of(entity: str) -> str:
    return next((c for c, es in taxonomy.CLASS_ENTITIES.items() if entity in es.split()), taxonomy.OTHER)


def load_config(path: str | None) -> Config:
    """A JSON configuration over the defaults; unknown keys are an error. Own rules of a shipped name replace nothing: they are added."""
    return Config() if path is None else _made(json.loads(Path(path).read_text(encoding="utf-8")))


def _made(told: dict) -> Config:
    unknown = set(told) - set(Config.__dataclass_fields__)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    fixed = {k: tuple(v) if isinstance(v, list) and k != "custom" else v for k, v in told.items()}
    if "settings" in fixed:
        fixed["settings"] = dict(taxonomy.ENTITY_SETTINGS) | {k: tuple(v) for k, v in fixed["settings"].items()}
    made = replace(Config(), **fixed)
    made.rules()  # a rule that cannot run fails here
    return made


def save_config(config: Config, path: str) -> None:
    Path(path).write_text(json.dumps(asdict(config), ensure_ascii=False, indent=1, sort_keys=True), encoding="utf-8")


#: Lists that may name people, and are not written in the clear where there is a key.
SECRET_LISTS = ("allow", "deny", "given_names")


def save_sealed(spark: SparkSession, config: Config, path: str, key: str) -> None:
    """A configuration whose lists of names are encrypted with a key (16, 24 or 32 characters)."""
    plain = asdict(config)
    lists = json.dumps({name: plain.pop(name) for name in SECRET_LISTS}, ensure_ascii=False)
    # as data of a local row, so that no plan shows the key
    sealed = spark.createDataFrame([(lists, key)], "t string, k string").select(F.base64(F.aes_encrypt("t", "k")).alias("s")).first()["s"]
    Path(path).write_text(json.dumps(plain | {"sealed": sealed}, ensure_ascii=False, indent=1, sort_keys=True), encoding="utf-8")


def load_sealed(spark: SparkSession, path: str, key: str) -> Config:
    """The configuration of such a file; a wrong key is an error, and never an empty list."""
    told = json.loads(Path(path).read_text(encoding="utf-8"))
    lists = spark.createDataFrame([(told.pop("sealed"), key)], "s string, k string").select(F.expr("cast(try_aes_decrypt(unbase64(s), k) as string)").alias("t")).first()["t"]
    if lists is None:
        raise ValueError(f"the key does not fit {path}")
    return _made(told | json.loads(lists))


def config_hash(config: Config) -> str:
    """16 digits that change with any setting."""
    return hashlib.sha256(json.dumps(asdict(config), sort_keys=True, default=str).encode()).hexdigest()[:16]


def rule_fingerprint(rules: list[Rule]) -> str:
    return hashlib.sha256(json.dumps([asdict(r) for r in rules], sort_keys=True).encode()).hexdigest()[:16]


def merge_new_rules(own: list[Rule], shipped: list[Rule], known: set[str]) -> list[Rule]:
    """Own rules and those shipped groups (by entity) that this configuration has never seen. A group that was deleted stays so."""
    groups = {r.entity for r in own} | known
    return [*own, *[r for r in shipped if r.entity not in groups]]


def new_terms(own: tuple[str, ...], shipped: tuple[str, ...], seen: tuple[str, ...]) -> list[str]:
    """Shipped terms that are new since a list was last looked at."""
    have = {t.lower() for t in (*own, *seen)}
    return [t for t in shipped if t.lower() not in have]


def provenance(config: Config) -> str:
    """How findings were made, in a line without values."""
    parts = [f"rules={rule_fingerprint(default_rules())}", f"profile={config.profile or '-'}", f"sensitivity={config.sensitivity:g}", f"tiers={config.tier_high:g}/{config.tier_medium:g}", f"corroboration={'on' if config.corroboration else 'off'}", f"model={'on' if config.ml else 'off'}"]
    return "; ".join(parts)
