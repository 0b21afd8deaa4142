"""Preference pairs for training: a shared prompt and two masked completions. Native plans only.

A pair is a chosen and a rejected conversation. The turns with which both begin (equal role and text) are rendered once,
as the prompt; what follows is rendered as the chosen and the rejected completion. A completion's mask is a list of
(n_chars, train) runs that cover it: an assistant's words and their end mark are trained on, headers and the other
roles' turns are not.

All turns of a pair meet in one row, as its text does: a conversation is one training example. Turns reach it in one
shuffle by pair; there is no join.

Defined results: turns are ordered by number, role and text (nulls first), so ties and repeated rows have a fixed order
and are all rendered; a null role or text counts as empty; a row without conv_id belongs to no pair and is left out; a pair
that lacks one side has null for it, no prompt, and the whole other side as completion; equal conversations give two
empty completions; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

HEAD, BODY, END = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), turn["role"], F.lit(BODY))


def _said(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END))


def render(turns: Column) -> Column:
    """The text of an array of turns."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _said(t))), "")


def mask(turns: Column, trained: str = TRAINED) -> Column:
    """The runs of an array of turns: (n_chars, train)."""
    run = lambda text, on: F.struct(F.length(text).alias("n_chars"), on.alias("train"))
    return F.flatten(F.transform(turns, lambda t: F.array(run(_head(t), F.lit(False)), run(_said(t), t["role"] == trained))))


def pairs(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """One row for each pair_id of turns with pair_id, side (0 chosen, 1 rejected), conv_id, turn, role, text."""
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.groupBy("pair_id").agg(
        *[F.max(F.when(F.col("side") == k, F.col("conv_id"))).alias(f"{name}_conv") for k, name in ((0, "chosen"), (1, "rejected"))],
        *[F.array_sort(F.collect_list(F.when(F.col("side") == k, said))).alias(name) for k, name in ((0, "c"), (1, "r"))],
    )
    plain = lambda c: F.transform(F.col(c), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    bare = gathered.withColumns({"c": plain("c"), "r": plain("r")})
    shorter = F.least(F.size("c"), F.size("r"))
    same = F.when(shorter == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), shorter))
    first = F.aggregate(same, F.lit(0), lambda n, k: F.when((n == k - 1) & (F.get("c", k - 1) == F.get("r", k - 1)), k).otherwise(n))
    split = bare.withColumn("n_shared", first)
    rest = lambda c: F.slice(F.col(c), F.col("n_shared") + 1, F.greatest(F.size(c), F.lit(1)))
    split = split.withColumns({"prompt": render(F.slice("c", 1, F.col("n_shared"))), "c": rest("c"), "r": rest("r")})
    there = lambda side, value: F.when(F.col(f"{side}_conv").isNotNull(), value)
    return split.select(
        "pair_id", "chosen_conv", "rejected_conv", "n_shared", "prompt",
        there("chosen", render(F.col("c"))).alias("chosen"), there("chosen", mask(F.col("c"), trained)).alias("chosen_mask"),
        there("rejected", render(F.col("r"))).alias("rejected"), there("rejected", mask(F.col("r"), trained)).alias("rejected_mask"),
    )


def neighbours(conversations: DataFrame) -> DataFrame:
    """Turns of pairs: conversation 2k is chosen against 2k + 1."""
    known = conversations.where("conv_id is not null")
    return known.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), F.pmod("conv_id", F.lit(2)).alias("side"), "conv_id", "turn", "role", "text")


def op6_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in a preference pair; the masks as text of (n_chars:train) runs."""
    made = pairs(neighbours(table(spark, sf_dir, "conversations")))
    shown = lambda c: F.array_join(F.transform(F.col(c), lambda r: F.concat(r["n_chars"].cast("string"), F.lit(":"), r["train"].cast("int").cast("string"))), " ")
    return made.withColumns({"chosen_mask": shown("chosen_mask"), "rejected_mask": shown("rejected_mask")})


ORACLE = """
with t as (select conv_id // 2 as pair_id, conv_id % 2 as side, conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
n as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as k from t),
s as (select pair_id, k, count(distinct side) = 2 and count(distinct role) = 1 and count(distinct text) = 1 as same from n group by pair_id, k),
l as (select pair_id, coalesce(min(k) filter (where not same) - 1, max(k)) as n_shared from s group by pair_id),
r as (select n.*, n_shared, '<|' || role || '|>' || chr(10) as head, text || '<|end|>' || chr(10) as said from n join l using (pair_id)),
g as (select pair_id, any_value(n_shared) as n_shared,
  max(conv_id) filter (where side = 0) as chosen_conv, max(conv_id) filter (where side = 1) as rejected_conv,
  string_agg(head || said, '' order by k) filter (where side = 0 and k <= n_shared) as prompt,
  string_agg(head || said, '' order by k) filter (where side = 0 and k > n_shared) as c,
  string_agg(length(head) || ':0 ' || length(said) || ':' || (role = 'assistant')::int, ' ' order by k) filter (where side = 0 and k > n_shared) as cm,
  string_agg(head || said, '' order by k) filter (where side = 1 and k > n_shared) as r,
  string_agg(length(head) || ':0 ' || length(said) || ':' || (role = 'assistant')::int, ' ' order by k) filter (where side = 1 and k > n_shared) as rm
  from r group by pair_id)
select pair_id, chosen_conv, rejected_conv, n_shared::int as n_shared, coalesce(prompt, '') as prompt,
  case when chosen_conv is not null then coalesce(c, '') end as chosen, case when chosen_conv is not null then coalesce(cm, '') end as chosen_mask,
  case when rejected_conv is not null then coalesce(r, '') end as rejected, case when rejected_conv is not null then coalesce(rm, '') end as rejected_mask
from g"""
