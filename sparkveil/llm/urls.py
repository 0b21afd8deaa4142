"""URL filter: host rules first, then a weighted vocabulary counted by an Aho-Corasick automaton.

A rule (host, path, verdict) fits a URL whose host is the rule's or a subdomain of it and whose path starts with the
rule's; of those that fit, the longest (host, then path) decides. Where none fits, the lower-cased URL is searched for
all terms at once. A hit counts if no ASCII letter or digit touches it. Every term has a weight; the weights of the different
terms found are added up, and `limit` or more reject. A term of that weight alone is a strict one, the others are soft, so
that several different ones reject. `read_vocabulary` reads a larger table from a file.

Defined results: null or no `://`: host and path are empty and no rule fits; a null URL is allowed; repeated rows are
judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: What rejects: the weight of one strict term, or of two soft ones.
LIMIT = 2
#: term -> weight
VOCABULARY = {
    **dict.fromkeys(
        "adult adultes adultos camgirl camgirls cialis erotica erotik hentai keygen keygens malware milf nsfw onlyfans phishing porn porno pornografia pornographie pornos pornstar spam viagra warez webcamgirls xxx".split(), LIMIT
    ),
    **dict.fromkeys(
        "ads affiliate apuestas baccarat bet bets betting bingo blackjack bonus bookmaker cams casino casinos cheap clickbait clicks coupon coupons crack cracked credito dating deals discount "
        "discounts doorway escort escorts forex free freispiele gambling gratis gratuit gratuite guenstig hack hookup jackpot jackpots keno kredit kredite loan loans lottery lotto naked nude "
        "nudes payday pharma pharmacy pills poker popunder popup promo rabatt refinance replica replicas roulette serial sex sexe sexo sexy singles slot slots sportwetten steroids swinger torrent torrents "
        "track tracker tracking vape wetten win winner".split(),
        1,
    ),
}
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    lower = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]), len(r[1]), r)):  # the last that fits stands
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, h + p).otherwise(text), F.when(fits, v).otherwise(verdict)
    return text, verdict


def read_vocabulary(path: str, limit: int = LIMIT) -> dict[str, int]:
    """A vocabulary from a text file of lines `term,weight`; a line without a weight is a strict term."""
    with open(path, encoding="utf-8") as lines:
        told = [line.strip().lower().partition(",") for line in lines if line.strip()]
    return {term.strip(): int(weight or limit) for term, _, weight in told}


def automaton(vocabulary: Mapping[str, int] = VOCABULARY) -> ahocorasick.Automaton:
    terms = ahocorasick.Automaton()
    for word, weight in vocabulary.items():
        terms.add_word(word, (weight, word))
    if len(terms):
        terms.make_automaton()
    return terms


def count_terms(url: str | None, terms: ahocorasick.Automaton, limit: int = LIMIT) -> tuple[int, int, int]:
    """Strict hits, different soft terms, and the weight of all different terms of a URL, boundaries kept."""
    if not url or not len(terms):
        return 0, 0, 0
    text = url.lower()
    strict, found = 0, {}
    for last, (weight, word) in terms.iter(text):
        first = last - len(word) + 1
        if (first and text[first - 1] in _ALNUM) or (last + 1 < len(text) and text[last + 1] in _ALNUM):
            continue
        strict += weight >= limit
        found[word] = weight
    return strict, sum(w < limit for w in found.values()), sum(found.values())


def _count_batches(batches: Iterator[pa.RecordBatch], vocabulary: Mapping[str, int], limit: int) -> Iterator[pa.RecordBatch]:
    terms = automaton(vocabulary)
    for batch in batches:
        found = [count_terms(u, terms, limit) for u in batch.column(1).to_pylist()]
        counts = [pa.array([f[i] for f in found], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *counts], names=["page_id", "url", "strict_hits", "soft_terms", "weight"])


def judge(pages: DataFrame, rules=RULES, vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_terms, weight of every row."""
    fields = "page_id long, url string, strict_hits int, soft_terms int, weight int"
    counted = pages.select("page_id", "url").mapInArrow(partial(_count_batches, vocabulary=dict(vocabulary), limit=limit), fields)
    host, path = split_url(F.col("url"))
    split = counted.withColumns({"host": host, "path": path})
    text, verdict = match_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("weight") >= limit, "block").otherwise("allow")
    return split.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "strict_hits", "soft_terms", "weight")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    return judge(table(spark, sf_dir, "pages"))


def oracle(rules=RULES, vocabulary: Mapping[str, int] = VOCABULARY, limit: int = LIMIT) -> str:
    """The same in DuckDB SQL."""
    text = verdict = ""
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0]), -len(r[1]), r)):
        fits = f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
        text, verdict = text + f" when {fits} then '{h}{p}'", verdict + f" when {fits} then '{v}'"
    strict, soft = [w for w, n in vocabulary.items() if n >= limit], [w for w, n in vocabulary.items() if n < limit]
    hit = lambda w: f"regexp_matches(u, '(^|[^a-z0-9]){w}($|[^a-z0-9])')::int"
    # strict hits are counted by cutting each hit out one by one: a term's boundary may be the next hit's boundary too
    many = lambda w: f"len(regexp_extract_all(replace(regexp_replace(u, '([^a-z0-9])', '\\1\\1', 'g'), '\n', ' '), '(^|[^a-z0-9]){w}($|[^a-z0-9])'))"
    return f"""
with s as (select page_id, lower(coalesce(url, '')) u,
  coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
c as (select *, ({" + ".join(map(many, strict))})::int strict_hits, ({" + ".join(map(hit, soft))})::int soft_terms,
  ({" + ".join(f"{n} * {hit(w)}" for w, n in vocabulary.items())})::int weight from s)
select page_id, host, path, case{text} end as rule,
  coalesce(case{verdict} end, case when weight >= {limit} then 'block' else 'allow' end) as verdict, strict_hits, soft_terms, weight
from c"""
