import numpy as np
from pyspark.sql import functions as F

from sparkveil.llm import neighbours
from sparkveil.llm.neighbours import Settings

from . import brute

VECTORS = "vec_id long, embedding array<float>, list string, score string"


def run(spark, rows, **settings):
    df = spark.createDataFrame([(i, v, "x", None) for i, v in rows], VECTORS)
    return neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20, Settings(**settings)).collect()


def recall(got, ids, x, k=20):
    x = np.asarray(x, float)
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        s = x @ x[ids.index(q)]
        s[ids.index(q)] = -np.inf
        best = {ids[j] for j in np.lexsort((ids, -s))[:k]}
        hits += len(best & {r["vec_id"] for r in got if r["query_id"] == q})
        total += len(best)
    return hits / total


def test_odd_vectors(spark):
    rng = np.random.RandomState(0)
    rows = [(k, rng.randn(8).tolist()) for k in range(45)]
    rows += [(100, None), (120, [0.0] * 8), (140, [float("nan")] * 8), (160, [None] * 8), (180, [float("inf")] * 8), (200, []), (220, [1.0, 2.0]), (None, [1.0] * 8)]
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, rows[3][1]), (3, rows[3][1])]  # ties and a repeated row
    ids = sorted({i for i, v in rows if i is not None and v and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v) and any(v)})
    x = [next(np.float32(v).tolist() for i, v in rows if i == k) for k in ids]
    got = run(spark, rows)
    for q in (0, 20, 40, 60):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [r["vec_id"] for r in own] == brute.nearest(ids, x, q, 20)
        for r in own:
            assert abs(r["score"] - np.dot(np.array(x[ids.index(q)]), np.array(x[ids.index(r["vec_id"])]))) < 1e-12
    assert {r["query_id"] for r in got} == {0, 20, 40, 60}


def test_few_and_none(spark):
    assert run(spark, []) == [] and run(spark, [(20, [1.0, 2.0])]) == []
    (r,) = run(spark, [(20, [1.0, 2.0]), (21, [3.0, -1.0])])
    assert (r["query_id"], r["rank"], r["vec_id"], r["score"]) == (20, 1, 21, 1.0)


def test_a_third_are_equal(spark):
    rng = np.random.RandomState(1)
    rows = [(k, [1.0] * 16 if k % 3 == 0 else rng.randn(16).tolist()) for k in range(1500)]
    ids, x = [i for i, _ in rows], [np.float32(v).tolist() for _, v in rows]
    for parts in ({"block": 50}, {"block": 50, "block_queries": 7}):
        got = run(spark, rows, **parts)
        own = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 60]
        assert own == brute.nearest(ids, x, 60, 20)


def test_recall_on_the_table(spark, sf):
    folder = sf.replace("sf0.001", "sf0.1")
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    got = neighbours.op10_nearest(spark, folder).collect()
    assert recall(got, [r["vec_id"] for r in rows], [r["embedding"] for r in rows]) >= 0.93


def test_recall_in_clusters_of_any_norm(spark):
    rng = np.random.RandomState(2)
    centres = rng.randn(60, 24) * 3
    x = (centres[rng.randint(0, 60, 4000)] + rng.randn(4000, 24)) * rng.uniform(0.5, 1.5, (4000, 1))
    rows = [(k, v) for k, v in enumerate(np.float32(x).tolist())]
    got = run(spark, rows)
    assert recall(got, list(range(4000)), np.float32(x)) >= 0.9


def test_graph_reaches_all():
    rng = np.random.RandomState(3)
    x = np.concatenate([rng.randn(50, 4), rng.randn(50, 4) + 100])
    graph, start = neighbours._graph(x, 3)
    seen, todo = {start}, [start]
    while todo:
        for k in graph[todo.pop()]:
            if k not in seen:
                seen.add(k)
                todo.append(k)
    assert len(seen) == 100
