"""Replacement of decided values: reversible numbered tokens, one-way tokens, shape summaries; and the way back.

The mapping is a table (label, value_key, original_value, placeholder) with a table of counters (label, next_n). Numbers are
given out in one pass in document order and never again. Write a mapping to a new place before any text that uses it.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import taxonomy, text
from ..plans.materialize import materialized

MAPPING = "label string, value_key string, original_value string, placeholder string"
COUNTERS = "label string, next_n long"
TOKEN = r"\[([A-Z0-9_]+?)(?:_([0-9]+))?\]"
NUMBERED = r"\[([A-Z0-9_]+_[0-9]+)\]"


def one_way_token(entity_type: Column) -> Column:
    """A token that can never be mistaken for a numbered one."""
    label = taxonomy.token_label(entity_type)
    return F.when(label.rlike(r"_[0-9]+$"), F.concat(F.lit("["), label, F.lit("_REDACTED]"))).otherwise(F.concat(F.lit("["), label, F.lit("]")))


def checked_label(label: Column) -> Column:
    """The label, or an error if a token with it could not be found again."""
    return F.when(label.rlike("^[A-Z0-9_]+$"), label).otherwise(F.raise_error(F.concat(F.lit("a numbered token could not be read back for the label "), label)).cast("string"))


def column_label(header: Column, letter: Column) -> Column:
    """A label out of a header: transliterated capitals, digits and underscores; else the column's letter."""
    out = header
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss"), ("Ä", "AE"), ("Ö", "OE"), ("Ü", "UE")):
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(F.regexp_replace(F.upper(out), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(out, F.lit("")) == "", F.concat(F.lit("COLUMN_"), letter)).otherwise(out)


@dataclass(frozen=True)
class Mapping:
    entries: DataFrame
    counters: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> Mapping:
        return Mapping(spark.createDataFrame([], MAPPING), spark.createDataFrame([], COUNTERS))

    def mint(self, wanted: DataFrame) -> Mapping:
        """The mapping with new entries for (entity_type, value, order...) that it lacks, numbered by label in that order.

        wanted: entity_type, value and the struct column `at` by which values are first seen. Numbering runs over one row
        per new value and label, in ranges: no label is gathered in one task.
        """
        label = checked_label(taxonomy.token_label(F.col("entity_type")))
        fresh = wanted.select(label.alias("label"), text.key(F.col("value")).alias("value_key"), "value", "at")
        fresh = fresh.groupBy("label", "value_key").agg(F.min_by("value", "at").alias("original_value"), F.min("at").alias("at"))
        fresh = fresh.join(self.entries.select("label", "value_key"), ["label", "value_key"], "left_anti")
        numbered = _ranked(fresh)
        seeded = self.entries.select("label", (F.regexp_extract("placeholder", "_([0-9]+)$", 1).cast("long") + 1).alias("next_n"))
        base = self.counters.unionByName(seeded).groupBy("label").agg(F.max("next_n").alias("next_n"))
        placed = numbered.join(base, "label", "left").withColumn("n", F.coalesce("next_n", F.lit(1)) + F.col("rank"))
        added = placed.select("label", "value_key", "original_value", F.concat_ws("_", "label", F.col("n").cast("string")).alias("placeholder"), F.col("n").alias("_n"))
        used = added.groupBy("label").agg((F.max("_n") + 1).alias("next_n"))
        counters = base.unionByName(used).groupBy("label").agg(F.max("next_n").alias("next_n"))
        return Mapping(self.entries.unionByName(added.drop("_n")), counters)

    def reverse(self, placeholder: str) -> DataFrame:
        return self.entries.where(F.col("placeholder") == placeholder).select("original_value")

    def in_order(self) -> DataFrame:
        return self.entries.orderBy("placeholder")

    def erase(self, placeholders: Iterable[str]) -> Mapping:
        """Without some entries; their numbers stay used."""
        counted = self.mint(self.entries.sparkSession.createDataFrame([], "entity_type string, value string, at struct<a:int>")).counters
        return Mapping(self.entries.where(~F.col("placeholder").isin(*placeholders)), counted)

    def reset(self, restart: bool = False) -> Mapping:
        """Without entries; numbers go on unless restarted."""
        kept = self.erase([])
        return Mapping(self.entries.limit(0), kept.counters.limit(0) if restart else kept.counters)

    def conflicts(self, other: Mapping) -> DataFrame:
        """What stands in the way of a merge: a value with two placeholders, a placeholder with two values."""
        both = self.entries.unionByName(other.entries)
        values = both.groupBy("label", "value_key").agg(F.count_distinct("placeholder").alias("n")).where("n > 1").select(F.concat_ws(":", "label", "value_key").alias("conflict"))
        tokens = both.groupBy("placeholder").agg(F.count_distinct("label", "value_key").alias("n")).where("n > 1").select(F.col("placeholder").alias("conflict"))
        return values.unionByName(tokens)

    def merge(self, other: Mapping) -> Mapping:
        if not self.conflicts(other).isEmpty():
            raise ValueError("the mappings give one value two placeholders, or one placeholder to two values")
        counters = self.counters.unionByName(other.counters).groupBy("label").agg(F.max("next_n").alias("next_n"))
        return Mapping(self.entries.unionByName(other.entries).distinct(), counters)

    def save(self, folder: str, key: str | None = None) -> None:
        """Write to a new folder; with a key (16, 24 or 32 characters), values are encrypted."""
        spark, entries = self.entries.sparkSession, self.entries
        if key is not None:
            entries = _with_key(entries, key)
            for c in ("value_key", "original_value"):
                entries = entries.withColumn(c, F.base64(F.aes_encrypt(c, "_key")))
            proof = _with_key(spark.createDataFrame([(PROOF,)], "proof string"), key)
            proof.select(F.base64(F.aes_encrypt("proof", "_key")).alias("proof")).write.parquet(f"{folder}/proof")
        entries.drop("_key").write.parquet(f"{folder}/entries")
        self.counters.write.parquet(f"{folder}/counters")

    @staticmethod
    def load(spark: SparkSession, folder: str, key: str | None = None) -> Mapping:
        """Read a folder. A missing or wrong key and a damaged mapping are different errors, and never an empty mapping."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/proof")
        locked = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        if locked and key is None:
            raise KeyLost(f"{folder} is encrypted and no key was given")
        if locked:
            proof = _with_key(spark.read.parquet(f"{folder}/proof"), key)
            told = proof.select(F.expr("cast(try_aes_decrypt(unbase64(proof), _key) as string)").alias("proof")).collect()
            if [r["proof"] for r in told] != [PROOF]:
                raise KeyLost(f"the key does not fit {folder}")
        try:
            entries, counters = spark.read.parquet(f"{folder}/entries"), spark.read.parquet(f"{folder}/counters")
            if {f.split()[0] for f in MAPPING.split(", ")} != set(entries.columns):
                raise ValueError("columns are missing")
            if locked:
                entries = _with_key(entries, key)
                for c in ("value_key", "original_value"):
                    entries = entries.withColumn(c, F.expr(f"cast(aes_decrypt(unbase64({c}), _key) as string)"))
                entries = entries.drop("_key")
        except Exception as e:
            raise MappingDamaged(f"{folder} cannot be read: {e}") from e
        return Mapping(entries, counters)

    @staticmethod
    def rotate(spark: SparkSession, folder: str, old: str | None, new: str, target: str) -> Mapping:
        """The mapping of a folder under a new key in a new one, which is read again before the old one may go."""
        before = Mapping.load(spark, folder, old)
        before.save(target, new)
        after = Mapping.load(spark, target, new)
        if not before.entries.exceptAll(after.entries).isEmpty() or before.entries.count() != after.entries.count():
            raise MappingDamaged(f"{target} does not hold what {folder} does")
        return after


#: What an encrypted mapping proves its key with.
PROOF = "mapping"


class KeyLost(ValueError):
    """An encrypted mapping without its key."""


class MappingDamaged(ValueError):
    """A mapping that cannot be read although its key fits."""


def _with_key(frame: DataFrame, key: str) -> DataFrame:
    """frame with the key as a column: as data of a local row, so that no plan, log or page of the interface shows it."""
    return frame.join(F.broadcast(frame.sparkSession.createDataFrame([(key,)], "_key string")))


@contextmanager
def lock(spark: SparkSession, folder: str, timeout: float = 10.0) -> Iterator[None]:
    """Hold a mapping's folder against other writers: a file beside it that only one of them can create."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}._lock")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path.getParent())
    until = time.monotonic() + timeout
    while not store.createNewFile(path):
        if time.monotonic() > until:
            raise TimeoutError(f"{folder} is held by another writer (if that one is gone, delete {folder}._lock)")
        time.sleep(0.1)
    try:
        yield
    finally:
        store.delete(path, False)


def _ranked(fresh: DataFrame) -> DataFrame:
    """fresh with `rank`, from 0 within each label by `at`: ranks within ranges of rows, plus how many of the label come before."""
    order = [F.col("label"), F.col("at"), F.col("value_key")]
    # written, so that both branches below see the same ranges whatever is computed again
    dealt = materialized(fresh.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    dealt = dealt.withColumn("_part", part)
    within = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("label", "_part").orderBy("_at")) - 1)
    before = dealt.groupBy("label", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("label").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return within.join(before, ["label", "_part"]).withColumn("rank", F.col("rank") + F.col("_before")).drop("_before", "_part", "_at", "at")


def decided(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """findings with `action`; what nobody decided is skipped. decisions: entity_type, value_key, action."""
    keyed = findings.withColumn("value_key", text.key(F.col("value")))
    return keyed.join(decisions.select("entity_type", "value_key", "action"), ["entity_type", "value_key"], "left").withColumn("action", F.coalesce("action", F.lit("skip")))


def wanted(chosen: DataFrame) -> DataFrame:
    """What a mapping needs for decided findings: units in order, in a unit from right to left."""
    return chosen.where("action = 'pseudonymize'").select("entity_type", "value", F.struct("doc_id", "unit_ord", (-F.col("start")).alias("right")).alias("at"))


def replacement(entity_type: Column, value: Column, action: Column, placeholder: Column) -> Column:
    """The text that stands for a value; null leaves it."""
    return (
        F.when(action == "skip", F.lit(None).cast("string"))
        .when(action == "pseudonymize", F.concat(F.lit("["), placeholder, F.lit("]")))
        .when(action == "summarize", F.concat(F.lit("["), taxonomy.token_label(entity_type), F.lit(": "), text.structural_summary(value), F.lit("]")))
        .otherwise(one_way_token(entity_type))
    )


def spliced(source: Column, changes: Column) -> Column:
    """A text with array<struct<start, end, token>>, in order and without overlaps, written in."""
    kind = "struct<at:int,out:string>"
    step = lambda a, c: F.struct(c["end"].alias("at"), F.concat(a["out"], F.substring(source, a["at"] + 1, c["start"] - a["at"]), c["token"]).alias("out")).cast(kind)
    nothing = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(kind)
    return F.aggregate(changes, nothing, step, lambda a: F.concat(a["out"], F.substring(source, a["at"] + 1, F.length(source))))


def changes(findings: DataFrame, decisions: DataFrame, mapping: Mapping) -> tuple[DataFrame, Mapping]:
    """doc_id, unit_id, start, end, token of what is replaced, and the mapping that the tokens are in."""
    chosen = decided(findings, decisions).where("action <> 'skip'")
    minted = mapping.mint(wanted(chosen))
    keyed = chosen.withColumn("label", taxonomy.token_label(F.col("entity_type")))
    held = keyed.join(minted.entries.select("label", "value_key", "placeholder"), ["label", "value_key"], "left")
    return held.select("doc_id", "unit_id", "start", "end", replacement(F.col("entity_type"), F.col("value"), F.col("action"), F.col("placeholder")).alias("token")), minted


def apply(units: DataFrame, findings: DataFrame, decisions: DataFrame, mapping: Mapping) -> tuple[DataFrame, Mapping]:
    """units with `output`, and the mapping that its tokens are in. findings: of resolved units, so without overlaps."""
    told, minted = changes(findings, decisions, mapping)
    gathered = told.groupBy("doc_id", "unit_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "token"))).alias("_changes"))
    out = units.join(gathered, ["doc_id", "unit_id"], "left")
    return out.withColumn("output", F.when(F.col("_changes").isNull(), F.col("text")).otherwise(spliced(F.col("text"), F.col("_changes")))).drop("_changes"), minted


def reidentify(texts: DataFrame, mapping: Mapping, column: str = "text") -> DataFrame:
    """texts with `restored` and `restored_count`: numbered tokens of the mapping replaced, others left.

    Tokens become rows and are joined to the mapping, so the mapping may be of any size.
    """
    numbered = texts.withColumn("_row", F.monotonically_increasing_id())
    tokens = numbered.select("_row", F.explode(text.spans(F.col(column), NUMBERED)).alias("m"))
    known = tokens.withColumn("placeholder", F.expr("substring(m.value, 2, length(m.value) - 2)")).join(mapping.entries.select("placeholder", "original_value"), "placeholder")
    changes = known.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("original_value").alias("token")))).alias("_changes"))
    out = numbered.join(changes, "_row", "left")
    return out.withColumns({"restored": F.when(F.col("_changes").isNull(), F.col(column)).otherwise(spliced(F.col(column), F.col("_changes"))), "restored_count": F.coalesce(F.size("_changes"), F.lit(0))}).drop("_row", "_changes")


def column_policy(value: Column, header: Column, letter: Column, policy: Column, placeholder: Column) -> Column:
    """A cell of a column with a policy: every value that is not blank goes, found or not."""
    label = column_label(header, letter)
    token = replacement(label, value, policy, placeholder)
    return F.when(text.clean(F.coalesce(value, F.lit(""))) == "", value).otherwise(F.coalesce(token, value))


def policy_of(cell_policy: Column, column_policy: Column, value_action: Column) -> Column:
    """A cell's policy comes before its column's, and that before the decision on the value."""
    return F.coalesce(cell_policy, column_policy, value_action, F.lit("skip"))


def safe_link(original: Column, redacted: Column) -> Column:
    """A link target that stays one: the scheme is kept, brackets are escaped."""
    scheme = F.regexp_extract(original, r"^([A-Za-z][A-Za-z0-9+.-]*:(?://)?)", 1)
    bare = F.replace(F.replace(redacted, F.lit("["), F.lit("%5B")), F.lit("]"), F.lit("%5D"))
    return F.when((scheme != "") & ~bare.startswith(scheme), F.concat(scheme, bare)).otherwise(bare)
