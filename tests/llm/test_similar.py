import random
from fractions import Fraction

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from sparkveil.llm import simhash, similar

from . import brute
from .test_simhash import frame


def near_texts(pairs, words, least, most):
    """Pairs of texts of random words, the second with some words changed: similarities on both sides of 0.8."""
    rng, rows = random.Random(pairs), []
    for k in range(pairs):
        text = [f"t{rng.randrange(9000)}" for _ in range(words)]
        near = list(text)
        for p in rng.sample(range(words), rng.randint(least, most)):
            near[p] = "changed"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(near))]
    return rows


def test_stage_decides_by_similarity(spark, sf):
    rows = near_texts(150, 200, 3, 9)
    likeness = [brute.jaccard(rows[i][1], rows[i + 1][1]) for i in range(0, len(rows), 2)]
    assert sum(Fraction(7, 10) <= x < Fraction(4, 5) for x in likeness) > 20 and sum(Fraction(4, 5) <= x < Fraction(17, 20) for x in likeness) > 20
    want = {2 * k for k in range(len(likeness))} | {2 * k + 1 for k, x in enumerate(likeness) if x < Fraction(4, 5)}
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, frame(spark, rows), sf).select("doc_id").collect()} == want


@pytest.mark.parametrize("crowd,block,hubs", [(2048, 1 << 21, 32), (3, 400, 32), (3, 400, 1)])
def test_components_against_brute_force(spark, monkeypatch, crowd, block, hubs):
    monkeypatch.setattr(simhash, "HUBS", hubs)
    rng = random.Random(4)
    words, rows = [f"w{k}" for k in range(400)], []
    for _ in range(8):
        text = [rng.choice(words) for _ in range(120)]
        for _ in range(20):  # chains and clouds around the limit
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rng.randint(1, 3)):
                text[rng.randrange(len(text))] = rng.choice(words)
    rows += [(900, "a b c d e f g h"), (901, "a b c d e f g h i"), (902, "one two"), (903, "ONE two"), (904, None), (905, " "), (906, rows[5][1])]
    want = brute.components([i for i, _ in rows], lambda i, j: brute.jaccard(rows[i][1], rows[j][1]) >= Fraction(4, 5))
    found = similar.classes(frame(spark, rows), crowd=crowd, block=block).collect()
    least = {}
    for r in found:
        least[r["root"]] = min(least.get(r["root"], r["doc_id"]), r["doc_id"])
    assert {r["doc_id"]: least[r["root"]] for r in found} == dict(zip([i for i, _ in rows], want))
    assert len(set(want)) < len(rows) - 40


def test_keep_one(spark):
    text = " ".join(f"a{k}" for k in range(400))
    rows = [(3, text), (1, text), (1, text), (2, "another text of its own words"), (None, text), (None, "lonely words that have no id")]
    kept = similar.keep_one(frame(spark, rows))
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == sorted([(1, text), (2, rows[3][1]), (-1, rows[5][1])])
    assert kept.columns == ["doc_id", "text", "m0", "key", "lang"]
    assert similar.keep_one(frame(spark, [])).count() == 0


def test_a_large_group_is_compared_in_linear_work(spark):
    """Near copies that are all alike: rows compared grow with the group. With strangers among them: each stranger meets all."""
    n, strangers, block = 3000, 5, 50
    told = []

    def among(rows):
        rows = rows.withColumn("kin", F.col("node") >= strangers).cache()
        told.append(rows.count())
        least = rows.where("kin").groupBy("key").agg(F.min("node").alias("u"))
        return rows.where("kin").join(least, "key").select("u", F.col("node").alias("v")).where("u <> v")

    members = spark.range(n).select(F.lit(7).cast("long").alias("group"), F.col("id").alias("node"), F.lit(1).alias("size"))
    edges = simhash.in_blocks(members, among, block)
    assert edges.where(f"u < {strangers} or v < {strangers}").count() == 0
    assert told[0] <= n + 2 * simhash.HUBS * n / block and told[1] <= n + strangers * n / block
