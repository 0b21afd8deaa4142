"""Units to candidates: every rule over every text, inside one row. No shuffle.

units: doc_id, unit_id, unit_ord, text, lang and what else there is (header, sheet, col). Candidates stay with their unit
as an array, so that the precision gate, checksums, thresholds and overlap resolution are expressions of the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checksums, taxonomy, text
from ..functions.rules import Rule, compile_rule, for_language, presence

FINDING = "struct<start:int,end:int,entity_type:string,value:string,score:double,source:string,validated:boolean>"
FINDINGS = f"array<{FINDING}>"
#: Our own: what a context word near a match adds to its score, and how many tokens before it are near.
CONTEXT_BOOST, CONTEXT_TOKENS = 0.35, 5
MODEL_SOURCE, ML_SOURCE, OOV_SOURCE, SEED_SOURCE = "SpacyRecognizer", "GLiNER", "oov_candidate", "propagation"
GATED_SOURCES = (MODEL_SOURCE, SEED_SOURCE, ML_SOURCE, OOV_SOURCE, "")
GIVEN_NAME, PRODUCT = "given_name", "product_gazetteer"


def none() -> Column:
    return F.array().cast(FINDINGS)


def finding(start: Column, end: Column, entity: Column | str, value: Column, score: Column | float, source: Column | str) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(start.alias("start"), end.alias("end"), lit(entity).alias("entity_type"), value.alias("value"), lit(score).cast("double").alias("score"), lit(source).alias("source"), F.lit(None).cast("boolean").alias("validated")).cast(FINDING)


def changed(f: Column, **fields: Column) -> Column:
    """A finding with some fields replaced."""
    names = ("start", "end", "entity_type", "value", "score", "source", "validated")
    return F.struct(*[fields.get(n, f[n]).alias(n) for n in names]).cast(FINDING)


def _paired(pattern: str) -> str:
    """A match with the gap before it, anchored at the end of the last one; flags first."""
    flags, rest = pattern[: pattern.index(")") + 1], pattern[pattern.index(")") + 1 :]
    return rf"{flags}\G([\s\S]*?)({rest})"


def scan_sql(column: str, rule: Rule, boost: float = CONTEXT_BOOST, near: int = CONTEXT_TOKENS) -> str:
    """A rule's findings in a column, as SQL: one text to parse in place of some sixty calls to the JVM for each rule."""
    pattern = compile_rule(rule)
    both = f"arrays_zip(regexp_extract_all({column}, {text.quoted(_paired(pattern))}, 1), regexp_extract_all({column}, {text.quoted(_paired(pattern))}, 2))"
    start, end = "a.at + length(m.`0`)", "a.at + length(m.`0`) + length(m.`1`)"
    step = f"named_struct('at', {end}, 'found', concat(a.found, array(named_struct('start', {start}, 'end', {end}, 'value', m.`1`))))"
    places = f"aggregate({both}, named_struct('at', 0, 'found', cast(array() as array<struct<start:int,end:int,value:string>>)), (a, m) -> {step}, a -> a.found)"
    score = f"{rule.score}D"
    if rule.context:
        tokens = f"split(lower(regexp_replace(substring(substring({column}, 1, m.start), -120, 120), {text.quoted(r'(?U)^[\s,;()]+|[\s,;()]+$')}, '')), {text.quoted(r'(?U)[\s,;()]+')})"
        said = " or ".join(f"contains(t, {text.quoted(c.lower())})" for c in rule.context)
        score = f"if(exists(slice(reverse({tokens}), 1, {near}), t -> {said}), {min(1.0, rule.score + boost)}D, {rule.score}D)"
    fields = f"named_struct('start', m.start, 'end', m.`end`, 'entity_type', {text.quoted(rule.entity)}, 'value', m.value, 'score', {score}, 'source', {text.quoted(rule.source)}, 'validated', cast(null as boolean))"
    there = [f"contains({column}, {text.quoted(rule.needs)})"] if rule.needs else []
    there += [f"{column} rlike {text.quoted(cheap)}"] if (cheap := presence(rule)) else []
    there.append(f"{column} rlike {text.quoted(pattern)}")
    return f"case when {' and '.join(there)} then transform({places}, m -> {fields}) else cast(array() as {FINDINGS}) end"


def scan(column: str, rule: Rule) -> Column:
    """A rule's findings in a column."""
    return F.expr(f"cast({scan_sql(column, rule)} as {FINDINGS})")


def drop_same_type(found: Column) -> Column:
    """Without what a better finding of the same type contains."""
    better = lambda c: F.exists(found, lambda d: (d["entity_type"] == c["entity_type"]) & (d["start"] <= c["start"]) & (c["end"] <= d["end"]) & ((d["score"] > c["score"]) | ((d["score"] == c["score"]) & (d["end"] - d["start"] > c["end"] - c["start"]))))
    return F.filter(found, lambda c: ~better(c))


def gate(f: Column, stopwords: Iterable[str] = (), trust: float = 0.85, vetoed: Callable[[Column], Column] | None = None) -> Column:
    """Whether the precision gate rejects a finding; `vetoed`: a tagger's verdict, abstaining where there is none."""
    kind, value, source = f["entity_type"], f["value"], f["source"]
    noise = kind.isin(*taxonomy.GATED_NOISE) & (text.is_lower_word(value) | text.key(value).isin(*stopwords) if tuple(stopwords) else text.is_lower_word(value))
    names = kind.isin(*taxonomy.NER_ENTITIES)
    shape = names & (text.is_structural(value) | text.is_digit_code(value))
    rejected = noise | shape
    if vetoed is not None:
        rejected = rejected | (names & vetoed(f))
    gated = source.isin(*GATED_SOURCES)
    return (
        F.when((source == ML_SOURCE) & (f["score"] >= trust), False)
        .when((kind == "DATE_TIME") & gated, value.contains("_"))
        .when(names & ~gated, False)
        .otherwise(rejected)
    )


def pos_veto(tags: Column) -> Callable[[Column], Column]:
    """A veto for `gate` out of a tagger's verdicts: array<struct<start, end, pos>> of a text's tokens, null without a tagger.

    A name is vetoed if none of the tokens that lie wholly inside it is a noun, proper noun or unknown word; and if it has eight
    letters or more, ends like a German nominalization, and is a noun with no proper noun in it. A value inside a single
    token has no verdict, and neither has a text without tags: the veto abstains.
    """

    def vetoed(f: Column) -> Column:
        inside = F.filter(F.coalesce(tags, F.array().cast("array<struct<start:int,end:int,pos:string>>")), lambda t: (t["start"] >= f["start"]) & (t["end"] <= f["end"]))
        of = lambda *kinds: F.exists(inside, lambda t: t["pos"].isin(*kinds))
        value = text.clean(f["value"])
        nominal = (F.length(value) >= 8) & value.rlike(text.NOMINAL_SUFFIX) & of("NOUN") & ~of("PROPN")
        return (F.size(inside) > 0) & (~of("NOUN", "PROPN", "X") | nominal)

    return vetoed


def trim(f: Column) -> Column:
    """Names without noise or a title in front, their start moved along."""
    names = f["entity_type"].isin(*taxonomy.NER_ENTITIES)
    bare = F.when(names, F.regexp_replace(f["value"], r"(?U)^[^\w]+", "")).otherwise(f["value"])
    titled = f["entity_type"].isin("PERSON", "NER_MISC")
    bare = F.when(titled, text.without_honorific(bare)).otherwise(bare)
    return changed(f, start=f["start"] + F.length(f["value"]) - F.length(bare), value=bare)


def confirmed(found: str, given_names: Iterable[str] = (), products: Iterable[str] = ()) -> Column:
    """Findings with the sources of names that a list confirms. found: the name of a column."""
    given, known = tuple(given_names), tuple(products)
    if not given and not known:
        return F.col(found)
    names = ", ".join(map(text.quoted, taxonomy.NER_ENTITIES))
    source = f"""case when f.entity_type = 'PERSON' and {text.listed_sql(text.first_token_sql("f.value"), given)} then {text.quoted(GIVEN_NAME)}
      when f.entity_type in ({names}) and {text.listed_sql(text.key_sql("f.value"), known)} then {text.quoted(PRODUCT)} else f.source end"""
    fields = f"'start', f.start, 'end', f.`end`, 'entity_type', f.entity_type, 'value', f.value, 'score', f.score, 'source', {source}, 'validated', f.validated"
    return F.expr(f"cast(transform({found}, f -> named_struct({fields})) as {FINDINGS})")


def settle(f: Column) -> Column:
    """With the checksum's verdict and the score it leads to."""
    verdict = checksums.validate(f["entity_type"], f["value"])
    return changed(f, score=checksums.refine(f["score"], verdict), validated=verdict)


def passes(f: Column, settings: dict | None = None, sensitivity: float = 0.0) -> Column:
    """A failed checksum stays for review; all else needs its type's score."""
    limit = F.greatest(F.lit(0.0), taxonomy.threshold(f["entity_type"], settings) - sensitivity)
    return (F.coalesce(~f["validated"], F.lit(False))) | (f["score"] >= limit)


def candidates(units: DataFrame, rules: list[Rule], allow: Iterable[str] = (), languages: tuple[str, ...] = ("de", "en"), extra: Column | None = None, given_names: Iterable[str] = (), products: Iterable[str] = (), settings: dict | None = None, sensitivity: float = 0.0, stopwords: Iterable[str] = (), tags: str | None = None) -> DataFrame:
    """units with `found`: the findings of all rules of the unit's language that pass the gate.

    extra: findings of a model. tags: a column with a tagger's verdicts (see pos_veto).
    """
    plain = text.neutralize(F.coalesce(F.col("text"), F.lit("")))
    told = [scan_sql("_plain", r) for r in rules if not r.languages]
    for lang in languages:
        own = [scan_sql("_plain", r) for r in for_language(rules, lang) if r.languages]
        if own:  # the rules of other languages are not run
            told.append(f"case when lang = {text.quoted(lang)} then concat({', '.join(own)}) else cast(array() as {FINDINGS}) end")
    parts = [F.expr(f"cast(concat({', '.join(told)}) as {FINDINGS})")] if told else [none()]
    if extra is not None:
        parts.append(F.coalesce(extra, none()))
    allowed = sorted({a.lower() for a in allow})
    out = units.withColumn("_plain", plain)
    # a step each, so that an expression is not written out again by the next
    out = out.withColumn("found", F.array_distinct(F.concat(*parts)))
    out = out.withColumn("found", drop_same_type(F.col("found")))
    if allowed:
        out = out.withColumn("found", F.filter("found", lambda f: ~text.key(f["value"]).isin(*allowed)))
    out = out.withColumn("found", F.transform("found", trim))
    out = out.withColumn("found", confirmed("found", given_names, products))
    veto = None if tags is None else pos_veto(F.col(tags))
    out = out.withColumn("found", F.filter("found", lambda f: (F.length(f["value"]) > 0) & ~gate(f, stopwords, vetoed=veto)))
    out = out.withColumn("found", F.transform("found", settle))
    return out.withColumn("found", F.filter("found", lambda f: passes(f, settings, sensitivity))).drop("_plain")


def rows(units: DataFrame, column: str = "found") -> DataFrame:
    """A row for each finding, with the unit's keys and a snippet."""
    keys = [c for c in ("doc_id", "unit_id", "unit_ord", "lang", "header", "sheet", "col", "row") if c in units.columns]
    # the outer form, as the other one would have the findings counted, and so made, a second time beforehand
    made = units.select(*keys, "text", F.explode_outer(column).alias("_f")).where("_f is not null").select(*keys, "text", "_f.*")
    return made.withColumn("context", text.snippet(F.col("text"), F.col("start"), F.col("end"))).drop("text")
