"""Proof that removed values are gone: a second scan, and a search for the values themselves."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .pseudonymize import TOKEN

REMOVING = ("pseudonymize", "anonymize", "redact", "summarize")


class ResidualError(RuntimeError):
    """The output still holds what was to be removed; nothing may be published."""


def leaks(output_findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """Findings of the output whose value was to be removed."""
    gone = decisions.where(F.col("action").isin(*REMOVING)).select("entity_type", "value_key")
    return output_findings.withColumn("value_key", text.key(F.col("value"))).join(gone, ["entity_type", "value_key"], "left_semi")


def is_phantom(source: Column, start: Column, end: Column) -> Column:
    """A match strictly inside a token; one that covers all between the brackets is not."""
    tokens = text.spans(source, TOKEN)
    return F.exists(tokens, lambda t: (t["start"] + 1 <= start) & (end <= t["end"] - 1) & ~((start == t["start"] + 1) & (end == t["end"] - 1)))


def literal_residual(outputs: DataFrame, removed: DataFrame, column: str = "output", headers: Iterable[str] = (), always: Iterable[str] = (), least: int = 4) -> DataFrame:
    """doc_id, unit_id, value_key: removed values (of four characters or more, or always checked) that an output still holds.

    removed: doc_id, value. Compared without case, once as it stands and once without white space. Within a document the
    values are joined to its units by the first three characters of their shortest form: a shingle join, not all pairs.
    """
    forced = sorted({a.lower() for a in always})
    exempt = sorted({h.lower() for h in headers} - set(forced))
    values = removed.select("doc_id", text.key(F.col("value")).alias("value_key")).distinct()
    long = F.length("value_key") >= least
    values = values.where(long | F.col("value_key").isin(*forced) if forced else long)
    if exempt:
        values = values.where(~F.col("value_key").isin(*exempt))
    bare = lambda c: F.regexp_replace(F.lower(c), r"(?U)\s+", "")
    values = values.withColumn("_bare", bare("value_key")).where("_bare <> ''").withColumn("_k", F.substring("_bare", 1, 3)).withColumn("_n", F.length("_k"))
    units = outputs.join(values.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "unit_id", F.col(column).alias("_text"))
    units = units.withColumn("_flat", bare("_text"))
    # all the pieces of one, two and three characters that a text has; the text itself stays behind
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.when(F.length("_flat") >= n, F.transform(F.sequence(F.lit(1), F.length("_flat") - n + 1), lambda k: F.substring(F.col("_flat"), k, n))).otherwise(F.array().cast("array<string>")))))
    keyed = units.select("doc_id", "unit_id", F.explode(grams).alias("_k"))
    asked = keyed.join(values, ["doc_id", "_k"]).groupBy("doc_id", "unit_id").agg(F.collect_set(F.struct("value_key", "_bare")).alias("_v"))
    pairs = units.join(asked, ["doc_id", "unit_id"]).withColumn("_v", F.explode("_v")).select("doc_id", "unit_id", "_text", "_flat", "_v.*")
    plain = pairs.withColumn("_at", F.expr("instr(lower(_text), value_key)")).withColumn("_flat_at", F.expr("instr(_flat, _bare)"))
    real = F.col("_at") > 0
    outside = _survives(F.col("_text"), F.col("value_key"))
    flat = _survives(F.col("_flat"), F.col("_bare"))
    return plain.where((real & outside) | ((F.col("_flat_at") > 0) & flat)).select("doc_id", "unit_id", "value_key").distinct()


def _survives(source: Column, value: Column) -> Column:
    """Whether a value is still there once tokens that merely contain it are taken away."""
    # a token whose whole inside is the value is no phantom and stays
    kept = F.transform(F.split(source, r"(?=\[)|(?<=\])"), lambda p: F.when(p.rlike(rf"(?i)^{TOKEN}$") & (F.lower(F.regexp_replace(p, r"^\[|\]$", "")) != value), "\u0000").otherwise(p))
    return F.contains(F.lower(F.array_join(kept, "")), value)


def demand_clean(*residuals: DataFrame) -> None:
    """Raise unless all are empty."""
    for r in residuals:
        if not r.isEmpty():
            raise ResidualError("a removed value is still in the output; it was not published")
