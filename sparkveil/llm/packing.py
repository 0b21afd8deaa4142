"""Packing of tokenised documents into fixed sequences: first-fit decreasing with a tournament tree.

Each document becomes its token ids and one end id, and is cut into pieces of the sequence length; only the last
piece can be shorter. A full piece is a sequence of its own. The short pieces are dealt into randomised groups of
about `group_size`; in each group they go, longest first, into the leftmost bin with room. A tournament tree over
the bins' free space finds that bin in a logarithmic number of steps.

The vocabulary is read with tiktoken, which gives the same ids as the tokenizers file of that vocabulary (tests
compare them) in a fifth of its CPU time. Texts that hold an added token of that file (`<|endoftext|>`) go to
tokenizers itself, which cuts them there.

Defined results: a null or empty text is its end id alone; rows with equal or null ids are packed one by one; an
empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

LENGTH = 2048
END = 1
GROUP_SIZE = 8192
SEED = 20_260_102
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(path: str | None = None):
    """The encoder of a vocabulary file; None: the public byte-level vocabulary where it is installed."""
    import public_tokenizers as public
    import tiktoken

    with open(path or public.path(VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def plain_encoder(path: str | None = None):
    """The tokenizers encoder of the same vocabulary, for the few texts that the faster one refuses or would read otherwise."""
    import public_tokenizers as public
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or public.path(VOCABULARY.replace(".tiktoken", ".json")))


@lru_cache(maxsize=2)
def added_tokens(path: str | None = None) -> tuple[str, ...]:
    """What the tokenizers file takes out of a text before its merges."""
    return tuple(t.content for t in plain_encoder(path).get_added_tokens_decoder().values())


def encode(text: str, path: str | None = None) -> list[int]:
    """Token ids of a whole text."""
    plain = path and path.replace(".tiktoken", ".json")
    if not any(t in text for t in added_tokens(plain)):
        try:
            return encoder(path).encode_ordinary(text)
        except BaseException as e:  # its pattern engine gives up on blanks by the hundred thousand, as a panic
            if type(e).__name__ != "PanicException":
                raise
    return plain_encoder(plain).encode(text, add_special_tokens=False).ids


def _cut_batches(batches: Iterator[pa.RecordBatch], length: int, end: int, path: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = encode(text.as_py() or "", path)
            ids.append(end)
            data, n = memoryview(np.array(ids, "<u4")).cast("B"), len(ids)
            for start in range(0, n, length):
                stop = min(start + length, n)
                out.append((key, start, stop - start, zlib.crc32(data[4 * start : 4 * stop]), n))
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def pieces(docs: DataFrame, length: int = LENGTH, end: int = END, path: str | None = None) -> DataFrame:
    """The pieces of every document."""
    return docs.select("doc_id", "text").mapInArrow(partial(_cut_batches, length=length, end=end, path=path), PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; items of equal length keep their order."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    width = 1 << max(0, (n - 1).bit_length())
    free = [capacity] * (2 * width)  # free[k]: the most free space of a bin below node k; the bins are the last `width`
    for item in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[item]), 1
        while node < width:
            node *= 2
            if free[node] < need:
                node += 1
        bins[item], offsets[item] = node - width, capacity - free[node]
        free[node] -= need
        while node > 1:
            node //= 2
            most = free[2 * node] if free[2 * node] >= free[2 * node + 1] else free[2 * node + 1]
            if free[node] == most:
                break
            free[node] = most
    return bins, offsets


def pack(cuts: DataFrame, length: int = LENGTH, group_size: int = GROUP_SIZE, seed: int = SEED) -> DataFrame:
    """Add sequence_id and offset to pieces (rows with a `length` of at most the sequences')."""
    kept = cut(cuts).withColumn("_row", F.monotonically_increasing_id())
    whole, short = kept.where(F.col("length") == length), kept.where(F.col("length") < length)
    groups = max(1, -(-short.count() // group_size))
    short = short.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(groups)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cuts.schema.fields)
    names = [f.name for f in cuts.schema.fields]

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row", kind="stable")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        return rows[names].assign(sequence_id=rows["_group"] * (1 << 32) + bins, offset=offsets)

    packed = short.groupBy("_group").applyInPandas(fill, f"{fields}, sequence_id long, offset long")
    alone = whole.select(*names, (F.lit(1 << 61) + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(packed)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    return pack(pieces(table(spark, sf_dir, "documents")))
