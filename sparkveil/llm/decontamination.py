"""Benchmark passages in training text: spaced-seed hashes, verified by substitution-tolerant overlaps. Native plans only.

A window of `span` successive tokens of a benchmark item is leaked if a text has a window at which all but `slack` tokens are
equal. The positions of a window are dealt in turn into slack + 2 classes; each mask ignores slack of the classes, so
whichever `slack` positions are substituted, some mask sees none of them. Every window of a text is hashed under every
mask and joined to the hashes of the items' windows; at a hit the two windows are compared token by token.

Items shorter than the span are sought whole: with one substitution if they have at least `tolerant` tokens, with none if they
have at least `least`; shorter ones are no evidence, as a phrase of four words stands in clean text too, and never match. Tokens are runs of letters, marks and digits of the lower-cased text.

The items' hashes are broadcast in blocks of at most `block_windows` windows, each joined to all rows, so that a larger
benchmark means more joins and not a larger broadcast. Text windows are made, hashed and joined inside one generated
stage; no window but a hit leaves it.

Defined results: null texts and items have no tokens; a null doc_id or item_id is reported as it is; of repeated rows the best
overlap is reported once; empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

SPAN = 13
SLACK = 2
LEAST = 5
TOLERANT = 7
BLOCK_WINDOWS = 20_000
#: 16 bytes each.
BROADCAST_ROWS = 500_000
BREAK = r"[^\p{L}\p{M}\p{Nd}]+"


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def classes(span: int, slack: int) -> list[list[int]]:
    """The positions of each class; a mask keeps all classes but `slack`."""
    n = slack + 2 if slack else 1
    return [list(range(c, span, n)) for c in range(n)]


def masks(span: int, slack: int) -> list[tuple[int, ...]]:
    """The classes that each mask keeps."""
    n = len(classes(span, slack))
    return list(combinations(range(n), n - slack))


def _windows(rows: DataFrame, names: list[str], span: int, slack: int) -> DataFrame:
    """Each row's windows under each mask: names, words, at, hash.

    Every class of a window is hashed once, a mask mixes its classes' hashes. All of this stays in one generated method
    that is short enough to be compiled.
    """
    placed = rows.select(*names, "words", F.explode(F.when(F.size("words") >= span, F.sequence(F.lit(0), F.size("words") - span))).alias("at"))
    own = [f"_c{c}" for c in range(len(classes(span, slack)))]
    hashed = placed.select(*names, "words", "at", *[F.xxhash64(*[F.get("words", F.col("at") + p) for p in kept]).alias(c) for c, kept in zip(own, classes(span, slack), strict=True)])
    mixed = []
    for kind, kept in enumerate(masks(span, slack)):
        value = F.lit(kind).cast("long")
        for turn, c in enumerate(kept):  # rotations by different steps, so that no two classes cancel out
            value = value.bitwiseXOR(F.shiftleft(own[c], 7 * turn + 1)).bitwiseXOR(F.shiftrightunsigned(own[c], 63 - 7 * turn))
        mixed.append(value)
    return hashed.select(*names, "words", "at", F.explode(F.array(*mixed)).alias("hash"))


def _equal(span: int) -> Column:
    """How many tokens of the two windows are equal."""
    same = F.lit(0)
    for p in range(span):
        same = same + (F.get("words", F.col("at") + p) == F.get("item_words", F.lit(p))).cast("int")
    return same


def allowed(length: int, span: int = SPAN, slack: int = SLACK, tolerant: int = TOLERANT) -> int:
    """Substitutions that a window of `length` tokens may have."""
    return slack if length >= span else min(slack, 1) if length >= tolerant else 0


def leaks(docs: DataFrame, benchmark: DataFrame, names: list[str], span: int = SPAN, slack: int = SLACK, least: int = LEAST, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """names, item_id, overlap (most equal tokens of a window), doc_start (first token of the first such window)."""
    items = cut(benchmark.select("item_id", tokens(F.col("text")).alias("words")))
    short = [r["n"] for r in items.select(F.size("words").alias("n")).where(F.col("n").between(least, span - 1)).distinct().collect()]  # span - least values at most
    texts = docs.select(*names, tokens(F.col("text")).alias("words"))
    found = None
    for length in [*sorted(short), span]:
        spare = allowed(length, span, slack)
        own = items if length == span else items.where(F.size("words") == length)
        seeds = _windows(own, ["item_id"], length, spare).select("item_id", F.slice("words", F.col("at") + 1, length).alias("item_words"), "hash")
        seeds = cut(seeds.distinct())
        blocks = max(1, -(-seeds.count() // (block_windows * len(masks(length, spare)))))
        for b in range(blocks):
            part = seeds if blocks == 1 else seeds.where(F.pmod(F.col("hash"), F.lit(blocks)) == b)
            hits = _windows(texts, names, length, spare).join(F.broadcast(part), "hash")
            enough = F.lit(length - spare)
            verified = hits.select(*names, "item_id", "at", _equal(length).alias("overlap"), enough.alias("enough"))
            found = verified if found is None else found.unionByName(verified)
    # a condition on the overlap before this would move into the join, which would then compare every window twice
    best = found.groupBy(*names, "item_id").agg(F.max(F.when(F.col("overlap") >= F.col("enough"), F.col("overlap"))).alias("overlap"), F.min(F.when(F.col("overlap") >= F.col("enough"), F.col("at"))).alias("doc_start"))
    return best.where("overlap is not null")


def remove_leaks(docs: DataFrame, benchmark: DataFrame, broadcast_rows: int = BROADCAST_ROWS, **options) -> DataFrame:
    """The rows, with all their columns, in which no benchmark passage is found.

    Up to `broadcast_rows` leaks are sent to all tasks, so that no text moves; more of them are joined by a shuffle.
    """
    mark = F.xxhash64("text")
    marked = docs.select("doc_id", "text", mark.alias("_mark"))
    leaked = cut(leaks(marked, benchmark, ["doc_id", "_mark"], **options).select(F.col("doc_id").alias("_id"), "_mark").distinct())
    if leaked.count() <= broadcast_rows:
        leaked = F.broadcast(leaked)
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["_id"]) & (mark == leaked["_mark"]), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, overlap, doc_start of every benchmark item that leaked into a document."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


ORACLE = f"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]+'), lambda x: x <> '') w from documents),
b as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]+'), lambda x: x <> '') w from benchmark),
dt as (select doc_id, len(w) n, unnest(w) t, unnest(range(len(w))) p from d),
bt as (select item_id, len(w) n, unnest(w) t, unnest(range(len(w))) p from b where len(w) >= {LEAST}),
same as (select distinct doc_id, item_id, bt.n as item_n, dt.n as doc_n, dt.p - bt.p as diag, bt.p as pos from dt join bt using (t)),
runs as (select *, count(*) over (partition by doc_id, item_id, diag order by pos range between current row and {SPAN - 1} following) c from same),
starts as (select s.doc_id, s.item_id, s.diag, j as pos, s.item_n, s.doc_n from (select doc_id, item_id, diag, item_n, doc_n, max(c) m from runs group by all
   having max(c) >= least(item_n, {SPAN}) - case when item_n < {TOLERANT} then 0 when item_n < {SPAN} then 1 else {SLACK} end) s, unnest(range(greatest(item_n - {SPAN}, 0) + 1)) u(j)
   where j + diag >= 0 and j + diag + least(item_n, {SPAN}) <= doc_n),
full_ as (select s.doc_id, s.item_id, s.diag, s.pos, s.item_n, count(e.pos) c from starts s join same e
   on e.doc_id is not distinct from s.doc_id and e.item_id is not distinct from s.item_id and e.diag = s.diag and e.pos between s.pos and s.pos + {SPAN - 1} group by all)
select doc_id, item_id, max(c)::int as overlap, min(diag + pos)::int as doc_start from full_
where c >= case when item_n < {TOLERANT} then item_n when item_n < {SPAN} then item_n - 1 else {SPAN - SLACK} end group by doc_id, item_id"""
