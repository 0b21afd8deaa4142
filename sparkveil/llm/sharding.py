"""Reproducible shuffle by a Feistel permutation of global row numbers; shard and slot follow by arithmetic.

Rows are numbered 0..N-1 in the order of (id, checksum, size). The number goes through a Feistel network over the
smallest power of two that holds N numbers; a result of N or more walks through the network again until it falls
below N, which makes the whole a permutation of 0..N-1. Place p belongs to shard p mod S at slot p div S, so shard
sizes differ by one at most, and `row_at` finds the row of a shard and slot without a look at the data.

Defined results: a null text has no bytes (size 1, checksum 0); a null id comes first in the order; equal ids are
ordered by checksum and size, rows equal in all of these are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import number_rows, table

ROUNDS = 6
SEED = 20_260_101
#: A walk leaves 0..N-1 with a chance under 1/2 at each step; 128 steps fail with a chance under 2**-128, and then loudly.
WALK = 128
MASK31 = (1 << 31) - 1
#: Multiplier and shift of each step of the round function; products stay under 2**62.
STEPS = ((1_103_515_245, 13), (1_664_525_001, 16))


def _halves(n: int) -> tuple[int, int]:
    bits = max(2, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _mix(value, key):
    """31 mixed bits of a value and a round's key, both under 2**31, from the middle bits of products."""
    if isinstance(value, int):
        x = value ^ key
        for m, shift in STEPS:
            x = (x * m >> shift) & MASK31
        return x
    x = value.bitwiseXOR(key)
    for m, shift in STEPS:
        x = F.shiftright(x * F.lit(m), shift).bitwiseAND(F.lit(MASK31))
    return x


def round_keys(seed: int) -> list[int]:
    return [(seed * 2_654_435_761 + r * 40_503_637 + 12_345) % MASK31 for r in range(ROUNDS)]


def _network(x: Column, n: int, seed: int) -> Column:
    left, right = _halves(n)
    keys = round_keys(seed)
    low, high = F.lit((1 << right) - 1), F.lit((1 << left) - 1)
    pairs = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for a, b in zip(keys[::2], keys[1::2], strict=True)])
    # each half round changes one part of the number by a function of the other
    first = lambda v, k: v.bitwiseXOR(F.shiftleft(_mix(v.bitwiseAND(low), k["a"]).bitwiseAND(high), right))
    second = lambda v, k: v.bitwiseXOR(_mix(F.shiftright(v, right), k["b"]).bitwiseAND(low))
    return F.aggregate(pairs, x, lambda v, k: second(first(v, k), k))


def permute(number: Column, n: int, seed: int = SEED) -> Column:
    """The place of a row number among n rows."""
    if n > 1 << 60:
        raise ValueError("more than 2**60 rows")
    if n <= 1:
        return F.lit(0).cast("long")
    walk = F.sequence(F.lit(1), F.lit(WALK))
    first = _network(number.cast("long"), n, seed)
    place = F.aggregate(walk, first, lambda at, _: F.when(at < n, at).otherwise(_network(at, n, seed)))
    return F.when(place < n, place).otherwise(F.raise_error(F.lit("the walk did not end")).cast("long"))


def permute_int(number: int, n: int, seed: int = SEED) -> int:
    """`permute` for one number."""
    left, right = _halves(n)
    while n > 1:
        for r, key in enumerate(round_keys(seed)):
            if r % 2 == 0:
                number ^= (_mix(number & ((1 << right) - 1), key) & ((1 << left) - 1)) << right
            else:
                number ^= _mix(number >> right, key) & ((1 << right) - 1)
        if number < n:
            return number
    return 0


def row_at(shard: int, slot: int, shards: int, n: int, seed: int = SEED) -> int:
    """The global row number that `permute` puts at a slot of a shard."""
    number = slot * shards + shard
    if not 0 <= number < n:
        raise IndexError("no such slot")
    left, right = _halves(n)
    while n > 1:
        for r, key in reversed(list(enumerate(round_keys(seed)))):
            if r % 2 == 0:
                number ^= (_mix(number & ((1 << right) - 1), key) & ((1 << left) - 1)) << right
            else:
                number ^= _mix(number >> right, key) & ((1 << right) - 1)
        if number < n:
            return number
    return 0


def assign(docs: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot of every row. Texts stay where they are; narrow rows are dealt."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    numbered, n = number_rows(narrow, ["doc_id", "text_crc32", "size"], "row_number")
    placed = numbered.withColumn("_placed", permute(F.col("row_number"), n, seed))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        "row_number",
        (F.col("_placed") % shards).cast("int").alias("shard"),
        F.expr(f"_placed div {shards}").alias("slot"),
    )


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 by the law `rows`: counts differ by one at most."""
    placed = assign(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
