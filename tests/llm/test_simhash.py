import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkveil.llm import simhash
from sparkveil.llm.components import components

from . import brute

DOCS = "doc_id long, text string, m0 string, key string, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", None, None) for i, t in rows], DOCS)


def collected(df):
    return [(r["doc_id"], r["m0"] & (2**64 - 1), r["component_id"]) for r in df.collect()]


def test_fingerprints_of_odd_texts():
    for text in [None, "", " \n\t", "one", "A b C", "a b c d", "x y z w v " * 3000, "Äpfel\x0bund\x0cBirnen\u00a0und mehr Worte hier", "a\x1cb c d e f"]:
        assert simhash.fingerprint(text) == [brute.simhash(text, 4)], text


def test_components_against_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    base = [[rng.choice(words) for _ in range(400)] for _ in range(30)]
    rows = []
    for k in range(240):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((k, " ".join(text)))
    rows += [(500, None), (501, ""), (None, " "), (7, rows[7][1]), (None, rows[9][1])]
    marks = [brute.simhash(t, 4) for _, t in rows]
    want = brute.components([i for i, _ in rows], lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 4)
    assert len(set(want)) < len(set(marks)), "some links join different fingerprints"
    for crowd in (2048, 3):
        got = collected(simhash.classes(frame(spark, rows), crowd=crowd))
        key = lambda r: (r[0] is None, r[0] or 0, r[1])
        assert sorted(got, key=key) == sorted([(i, m, w) for (i, _), m, w in zip(rows, marks, want)], key=key)


@pytest.mark.parametrize("distance,words,total,crowd", [(4, 1, None, 2048), (4, 1, None, 2), (8, 1, None, 2048), (8, 2, 14, 2048), (8, 2, 14, 4), (6, 1, None, 5)])
def test_links_lose_nothing(spark, distance, words, total, crowd):
    rng = np.random.RandomState(distance + words)
    seeds = rng.randint(0, 2**62, (40, words)).astype(np.uint64)
    marks = {tuple(int(m) for m in s) for s in seeds}
    for s in seeds:
        for _ in range(8):
            flips = rng.randint(0, 14)
            marks.add(tuple(int(m) ^ sum(1 << int(b) for b in set(rng.randint(0, 64, flips // words))) for m in s))
    marks = sorted(marks)
    signed = [tuple(m - 2**64 if m >= 2**63 else m for m in row) for row in marks]
    nodes = spark.createDataFrame([(k, *row) for k, row in enumerate(signed)], "node long, " + ", ".join(f"m{w} long" for w in range(words)))
    apart = lambda i, j: [(a ^ b).bit_count() for a, b in zip(marks[i], marks[j])]
    near = lambda i, j: min(apart(i, j)) <= distance and (total is None or sum(apart(i, j)) <= total)
    want = brute.components(list(range(len(marks))), near)
    for hot in (simhash.HOT_ROWS, 3):
        root = {r["node"]: r["root"] for r in components(simhash.link(nodes, distance, words, total, crowd, hot_rows=hot)).collect()}
        assert [root.get(k, k) for k in range(len(marks))] == want


def test_hot_keys(spark):
    rows = spark.range(5000).select((F.col("id") % 1000).alias("key"), F.col("id").alias("node")).unionByName(spark.range(400).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node")))
    assert [r["key"] for r in simhash._hot_keys(rows, 100).collect()] == [7] and simhash._hot_keys(rows, 1000) is None and simhash._hot_keys(rows.limit(0), 1) is None


def test_long_chain_and_no_edges(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)], "u long, v long")
    assert {r["root"] for r in components(chain).collect()} == {0}
    assert components(chain.limit(0)).count() == 0


def test_query_on_the_table(spark, sf):
    from sparkveil.llm.queries import queries

    got = queries()["op1_simhash"](spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs)
    marks = [brute.simhash(docs[i], 4) for i in ids]
    want = brute.components(ids, lambda i, j: (marks[i] ^ marks[j]).bit_count() <= 4)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == [(i, f"{m:016x}", w) for i, m, w in zip(ids, marks, want)]
