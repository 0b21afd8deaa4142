"""Approximate nearest neighbours by largest inner product: balanced posting lists under a graph of centroids.

Vectors get one more coordinate that makes all norms equal, so that the largest inner product is the least distance. A
bounded sample is split, largest cluster first, into balanced clusters; their centroids are joined by a graph of near
neighbours that is kept in memory. A vector goes to the list of its nearest centroid and, near a boundary, to further
lists whose centroid is almost as near (distance ratio) and lies on another side of it. A query walks the graph
from a fixed start towards itself, visits all centroids within a distance ratio of the nearest one found, and searches
their lists; scores are exact.

A list of more than `block` vectors is cut into blocks by a hash of the id, and the queries that look into it likewise, in
blocks of `block_queries`; each pair of blocks is a task's work of its own, so a list that holds a third of all vectors, or
that a third of all queries look into, is many pieces of work. A piece yields the nearest `k` for each of its queries.

The lists are as many as a sample of that size can place (`most_lists`); past `most_lists * per_list` vectors lists grow and
are cut into more blocks, which are all searched.

Defined results: vectors that are null, empty, zero, hold a null or non-finite component, or have another dimension
than most (ties: the smaller) take no part, neither do rows without an id; of rows that repeat an id, as queries and
as candidates, the one with the smallest array counts; equal scores rank by the smaller id; a query without candidates has no rows;
an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table


@dataclass(frozen=True)
class Settings:
    #: Rows that the centroids are fitted on, at most.
    sample: int = 20_000
    #: Lists: one for so many vectors, within the bounds.
    per_list: int = 4096
    least_lists: int = 64
    #: About five sampled vectors make a centroid; a larger sample can place more lists.
    most_lists: int = 4096
    #: Vectors that a list holds on average, at least; fewer lists are made of a small table.
    least_per_list: int = 64
    #: Vectors in the lists that a query looks into, at least about, however far they are.
    least_seen: int = 400
    #: Neighbours of a centroid in the graph, before links back.
    degree: int = 16
    #: A vector is replicated to lists within this ratio of its nearest centroid's distance.
    boundary: float = 1.04
    #: Lists that one vector can be in.
    copies: int = 3
    #: A query searches lists within this ratio of its nearest centroid's distance.
    reach: float = 1.18
    #: Vectors of a list that one task searches, at most about.
    block: int = 4096
    #: Queries of a list that are searched together, at most about.
    block_queries: int = 16_384
    seed: int = 20_260_103


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    graph: list[list[int]]
    start: int
    norm2: float
    settings: Settings
    #: Vectors of each list, estimated from the sample.
    sizes: np.ndarray


def balanced_clusters(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids of at most `lists` clusters: the largest is split in two halves of equal size, again and again."""
    parts: list[tuple[int, int, np.ndarray]] = [(-len(x), 0, np.arange(len(x)))]
    made = 1
    while len(parts) < lists and -parts[0][0] > 1:
        _, _, rows = heapq.heappop(parts)
        own = x[rows]
        axis = own - own.mean(axis=0)
        direction = axis[int(np.argmax((axis**2).sum(axis=1)))]
        for _ in range(rounds):  # power iterations towards the widest direction
            direction = axis.T @ (axis @ direction)
            norm = np.linalg.norm(direction)
            if norm == 0:
                break
            direction = direction / norm
        side = np.argsort(axis @ direction, kind="stable")
        for half in (side[: len(side) // 2], side[len(side) // 2 :]):
            made += 1
            heapq.heappush(parts, (-len(half), made, rows[half]))
    centroids = np.stack([x[rows].mean(axis=0) for _, _, rows in sorted(parts, key=lambda p: p[1])])
    for _ in range(rounds):  # settle, without empty clusters
        near = np.argmin(_distances(x, centroids), axis=1)
        sums, counts = np.zeros_like(centroids), np.bincount(near, minlength=len(centroids))
        np.add.at(sums, near, x)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    return np.unique(centroids, axis=0)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y**2).sum(axis=1)[None, :], 0))


def _graph(centroids: np.ndarray, degree: int) -> tuple[list[list[int]], int]:
    """Near neighbours both ways, with a chain through all centroids by nearness so that each can be reached; and a central start."""
    d = _distances(centroids, centroids)
    order = np.argsort(d, axis=1, kind="stable")
    links: list[set[int]] = [set() for _ in centroids]
    for a in range(len(centroids)):
        for b in order[a, 1 : degree + 1].tolist():
            links[a].add(b)
            links[b].add(a)
    start = int(np.argmin(d.sum(axis=1)))
    reached, todo = {start}, [start]
    while True:
        while todo:
            fresh = links[todo.pop()] - reached
            reached |= fresh
            todo += fresh
        rest = [k for k in range(len(centroids)) if k not in reached]
        if not rest:
            return [sorted(s) for s in links], start
        inside = sorted(reached)
        a, b = divmod(int(np.argmin(d[np.ix_(rest, inside)])), len(inside))
        links[rest[a]].add(inside[b])
        links[inside[b]].add(rest[a])
        todo = [rest[a]]
        reached.add(rest[a])


def _lifted(x: np.ndarray, norm2: float) -> np.ndarray:
    """With a coordinate that makes all squared norms norm2."""
    return np.concatenate([x, np.sqrt(np.maximum(norm2 - (x**2).sum(axis=1), 0))[:, None]], axis=1)


def fit(sample: np.ndarray, rows: int, norm2: float, settings: Settings = Settings()) -> Index:
    lists = min(settings.most_lists, max(settings.least_lists, rows // settings.per_list), max(1, rows // settings.least_per_list))
    lifted = _lifted(sample, norm2)
    centroids = balanced_clusters(lifted, lists)
    sizes = np.bincount(np.argmin(_distances(lifted, centroids), axis=1), minlength=len(centroids)) * (rows / len(sample))
    return Index(centroids, *_graph(centroids, settings.degree), norm2, settings, sizes)


def lists_of(index: Index, x: np.ndarray) -> list[list[int]]:
    """For each vector the lists that hold it, its nearest one first."""
    s, d = index.settings, _distances(_lifted(x, index.norm2), index.centroids)
    between = _distances(index.centroids, index.centroids)
    out = []
    for row in d:
        near = np.argsort(row, kind="stable")[: 4 * s.copies]
        kept = [int(near[0])]
        for c in near[1:].tolist():
            if len(kept) == s.copies or row[c] > s.boundary * row[kept[0]]:
                break
            if all(between[c, k] >= row[c] for k in kept):  # on another side of the vector
                kept.append(c)
        out.append(kept)
    return out


def search_lists(index: Index, query: np.ndarray) -> list[int]:
    """The lists that a query looks into: best first over the graph, down to where nothing within reach is left to visit."""
    q = np.append(query, 0.0)
    far = lambda ids: np.sqrt(((index.centroids[ids] - q) ** 2).sum(axis=1))
    first = float(far([index.start])[0])
    seen, todo, found, best = {index.start}, [(first, index.start)], [], first
    held = 0.0
    while todo:
        d, at = heapq.heappop(todo)
        best = min(best, d)
        if d > index.settings.reach * best and len(found) >= index.settings.degree and held >= index.settings.least_seen:
            break
        found.append((d, at))
        held += index.sizes[at]
        fresh = [k for k in index.graph[at] if k not in seen]
        seen.update(fresh)
        if fresh:
            for dist, k in zip(far(fresh).tolist(), fresh, strict=True):
                heapq.heappush(todo, (dist, k))
    out, held = [], 0.0
    for d, k in sorted(found):
        if d > index.settings.reach * best and held >= index.settings.least_seen:
            break
        out.append(k)
        held += index.sizes[k]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _place_batches(batches: Iterator[pa.RecordBatch], index: Index, queries: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(1))
        places = [search_lists(index, q) for q in x] if queries else lists_of(index, x)
        rows = np.repeat(np.arange(len(x)), [len(p) for p in places])
        lists = pa.array([k for p in places for k in p], pa.int32())
        yield pa.RecordBatch.from_arrays([lists, batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))], names=["list", "vec_id", "embedding"])


def top(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, id and exact score of each query's k nearest among different ids (its own left out)."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    outs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(0, len(q), 256):
        rough = q[i : i + 256] @ x.T
        for query, vector, row in zip(query_ids[i : i + 256], q[i : i + 256], rough, strict=True):
            own = np.searchsorted(ids, query)
            if own < len(ids) and ids[own] == query:
                row[own] = -np.inf
            able = len(ids) - (own < len(ids) and ids[own] == query)
            n = min(k, able)
            if n <= 0:
                continue
            # rounding may order rough scores otherwise than exact ones: all that could be among the first n are scored again
            edge = np.partition(row, len(row) - n)[len(row) - n]
            near = np.flatnonzero(row >= edge - 1e-9 * max(1.0, abs(edge)))
            score = exact(vector, x[near])
            best = np.lexsort((ids[near], -score))[:n]
            outs.append((np.full(n, query), ids[near][best], score[best]))
    if not outs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*outs, strict=True))


def exact(vector: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal rows get equal results wherever they stand."""
    return np.add.reduce(np.ascontiguousarray(x * vector), axis=1)


def _search_block(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(queries) or not len(vectors):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    stack = lambda column: np.stack(column.to_list()).astype(np.float64)
    got = top(queries["vec_id"].to_numpy(), stack(queries["embedding"]), vectors["vec_id"].to_numpy(), stack(vectors["embedding"]), k)
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got, strict=True)))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) of the vectors that take part, each id once."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = whole.where(fine & F.exists("embedding", lambda v: v != 0))
    sizes = whole.groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "n").limit(1).collect()
    if not sizes:
        return whole.limit(0)
    return whole.where(F.size("embedding") == sizes[0]["n"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(vectors: DataFrame, is_query, k: int = 20, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest vectors found for each vector for which the condition is_query holds."""
    spark = vectors.sparkSession
    fit_for = cut(usable(vectors))
    square = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v * v)
    facts = fit_for.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("norm2")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = fit_for.orderBy(F.xxhash64("vec_id", F.lit(settings.seed)), "vec_id").limit(settings.sample).select("embedding").toArrow()
    index = fit(_matrix(sample.column(0)), facts["n"], facts["norm2"], settings)
    placed = lambda df, queries: df.mapInArrow(partial(_place_batches, index=index, queries=queries), "list int, vec_id long, embedding array<double>")
    posted = cut(placed(fit_for, False))
    asked = cut(placed(fit_for.where(is_query), True))
    # a row for each list, most_lists at most
    blocks = posted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / settings.block).cast("int").alias("blocks"))
    parts = asked.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / settings.block_queries).cast("int").alias("parts"))
    sizes = F.broadcast(cut(blocks.join(parts, "list")))  # lists that no query looks into are left out
    mine = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = posted.join(sizes, "list").select("list", "vec_id", "embedding", mine("blocks").alias("block"), each("parts").alias("part"))
    asked = asked.join(sizes, "list").select("list", "vec_id", "embedding", each("blocks").alias("block"), mine("parts").alias("part"))
    found = asked.groupBy("list", "block", "part").cogroup(dealt.groupBy("list", "block", "part")).applyInPandas(partial(_search_block, k=k), "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
