import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkveil.llm import packing

DOCS = "doc_id long, text string, length string, offset string, _row long"


@lru_cache(maxsize=1)
def untouched():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_by_tokenizers(text):
    return untouched().encode(text, add_special_tokens=False).ids


def test_same_ids_as_tokenizers():
    for text in ["", "Hello, wörld!  It's 3 o'clock\n\n\tyes", "<|endoftext|> is text", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext|", "<|endoftext|>" + "word " * 4000, "\U0001f600 漢字\u0301", "a" * 5000, " " * 3000 + "x", "e\u0301\r\n\x00\x1f"]:
        assert packing.encode(text) == ids_by_tokenizers(text)


def test_same_ids_on_the_table(spark, sf):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert packing.encode(r["text"]) == ids_by_tokenizers(r["text"])


def test_a_million_blanks():
    text = "x" + " " * 1_000_000 + "y"
    ids = packing.encode(text)
    assert packing.plain_encoder().decode(ids) == text


@pytest.mark.parametrize("seed", range(4))
def test_first_fit_decreasing_against_a_scan(seed):
    lengths = np.random.RandomState(seed).randint(1, 100, [0, 1, 50, 400][seed])
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    free = []
    for item in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at = next((b for b, f in enumerate(free) if f >= lengths[item]), len(free))
        if at == len(free):
            free.append(100)
        assert (bins[item], offsets[item]) == (at, 100 - free[at])
        free[at] -= lengths[item]


def test_every_id_once(spark):
    rows = [(k, "word " * (k * 37 % 900), "x", None, 1) for k in range(300)] + [(5, "same", None, None, 0)] * 40 + [(None, None, None, None, None)] * 40 + [(1000, "long text " * 20_000, None, None, None)]
    got = packing.pack(packing.pieces(spark.createDataFrame(rows, DOCS)), group_size=64).collect()
    fills = defaultdict(list)
    for r in got:
        fills[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in fills.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    for i, text, *_ in rows:
        ids = [*packing.encode(text or ""), 1]
        own = [r for r in by_doc[i] if r["doc_tokens"] == len(ids)]
        copies = sum((j, t) == (i, text) for j, t, *_ in rows)
        for start in range(0, len(ids), 2048):
            part = ids[start : start + 2048]
            found = [r for r in own if r["start"] == start]
            assert len(found) >= copies and all(r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) for r in found)
    assert len(got) == sum(-(-(len(packing.encode(t or "")) + 1) // 2048) for _, t, *_ in rows)
    assert packing.pack(packing.pieces(spark.createDataFrame([], DOCS))).count() == 0


def test_little_padding(spark, sf):
    got = packing.op7_packing(spark, sf.replace("sf0.001", "sf0.1")).toPandas()
    assert got.length.sum() / (2048 * got.sequence_id.nunique()) > 0.99
