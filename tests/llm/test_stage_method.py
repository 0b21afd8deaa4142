"""The near-duplicate stage takes op1's method: SimHash proposes, the sets decide."""

import numpy as np
from pyspark.sql import functions as F
from sparkveil.llm import similar

from . import brute
from .test_simhash import frame


def rows():
    """Texts of one refrain with endings of their own: near by SimHash, which counts repeats, and unlike by their sets; the last two are near copies."""
    refrain = " ".join(["one two three four five six seven"] * 60)
    said = [(k, f"{refrain} " + " ".join(f"e{k}x{j}" for j in range(20))) for k in range(6)]
    copy = " ".join(f"w{j}" for j in range(300))
    return [*said, (6, copy), (7, copy + " more"), (8, "something else of its own altogether here")]


def test_fingerprints_propose(spark):
    text = dict(rows())
    print_ = {k: brute.simhash(v, similar.SHINGLE) for k, v in text.items()}
    signed = lambda x: int(np.array(x, np.uint64).view(np.int64))
    nodes = spark.createDataFrame([(k, signed(x)) for k, x in print_.items()], "node long, print long")
    got = similar.components(similar.near_prints(nodes)).collect()
    root = {k: k for k in text} | {r["node"]: r["root"] for r in got}
    assert [root[k] for k in sorted(text)] == brute.components(sorted(text), lambda i, j: (print_[i] ^ print_[j]).bit_count() <= 4)
    assert {root[k] for k in range(6)} == {0}


def test_candidates_hold_them_and_the_sets_decide(spark, monkeypatch):
    made, tried = similar.candidates, []
    monkeypatch.setattr(similar, "candidates", lambda nodes, *a: tried.append(made(nodes, *a)) or tried[-1])
    found = {r["doc_id"]: r["root"] for r in similar.classes(frame(spark, rows())).collect()}
    roots = similar.components(tried[0].select(F.col("u"), F.col("v"))).collect()
    assert sorted(sum(r["root"] == k for r in roots) for k in {r["root"] for r in roots}) == [2, 6]
    assert len(set(found.values())) == 8 and found[6] == found[7]
