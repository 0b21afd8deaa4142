"""Near-duplicates by the Jaccard similarity of word shingles: candidates by SimHash and MinHash, each decided on the whole sets.

Two texts are linked if their sets of 5-word shingles have a similarity of 0.8 or more; groups are the connected components of
these links. Texts with equal sets are one node.

Candidates are what op1's method links, SimHash fingerprints of the same shingles (with repeats) that differ in 4 bits or fewer, and
what MinHash adds to it, since at 0.8 only some 3 % of pairs are that near: these share the least values of 5 hashes in one of 40 bands, which a pair with a similarity of exactly 0.8 does in none with
a probability of 1.2e-7, and differ in 56 of 256 sketch bits at most, one for each of 256 hashes: such a pair differs in 26 on
average, with a deviation of 4.8. Components of candidates are brought together with their texts, and their links are found again
on the sets themselves, between all members, so candidates never decide. A component with more than `block` shingles, and a
band's value with more than `crowd` sketches, go through `simhash.in_blocks`.

Words, short and odd texts are as in simhash; a blank text has an empty set, and all of these are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .simhash import CROWD, Plan, in_blocks, link, linked, majority, shingle_hashes

SHINGLE = 5
#: A similarity of 4 / 5, compared in whole numbers.
SHARED, OF = 4, 5
BANDS, ROWS = 40, 5
WORDS, APART = 4, 56
#: So many shingles are compared in one go.
BLOCK = 1 << 21
_DRAWN = np.random.RandomState(5)
_FACTORS = _DRAWN.randint(0, 1 << 32, 64 * WORDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_BAND_FACTORS = (_DRAWN.randint(0, 1 << 62, (BANDS, ROWS), dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_NAMES = [f"m{k}" for k in range(WORDS)]


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """A text's set of shingle hashes, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def least_hashes(own: np.ndarray) -> np.ndarray:
    """The least value of each of the hashes over a set that is not empty."""
    least = np.full(len(_FACTORS), 0xFFFFFFFF, np.uint32)
    high = (own >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(high), 256):
        np.minimum(least, np.minimum.reduce(high[i : i + 256, None] * _FACTORS, axis=0), out=least)
    return least


def _mark_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, sizes, prints, marks, keys = [], [], [], np.zeros((batch.num_rows, WORDS), np.uint64), np.zeros((batch.num_rows, BANDS), np.uint64)
        for k, text in enumerate(batch.column(2)):
            hashes = shingle_hashes(text.as_py(), shingle)
            own = np.unique(hashes)
            prints.append(majority(hashes))
            node.append(xxhash.xxh3_64_intdigest(own.tobytes()))
            sizes.append(len(own))
            if len(own):
                least = least_hashes(own)
                marks[k] = np.packbits((least >> np.uint32(8)).astype(np.uint8) & 1, bitorder="little").view(np.uint64)
                keys[k] = (least[: BANDS * ROWS].reshape(BANDS, ROWS) * _BAND_FACTORS).sum(axis=1, dtype=np.uint64)
        listed = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * np.int32(BANDS)), pa.array(keys.ravel().view(np.int64)))
        shown = [*[pa.array(np.array(x, np.uint64).view(np.int64)) for x in (node, prints)], pa.array(sizes, pa.int64()), *[pa.array(np.ascontiguousarray(m).view(np.int64)) for m in marks.T], listed]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *shown], names=["doc_id", "_text", "node", "print", "n", *_NAMES, "keys"])


def similar(a: int, b: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Whether sets of sizes a and b with `both` elements in common have the similarity."""
    return both * OF >= (a + b - both) * SHARED


def tied(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the first one of its connected component, over the links of all pairs."""
    sizes = np.array([len(s) for s in sets], np.int64)
    label = np.full(len(sets), -1)
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(int(place.max()) + 1 if len(place) else 0, bool)
    # what is left in order of size: those that can be similar to a set stand in a row
    order = np.argsort(sizes, kind="stable")
    left, held = order, np.concatenate([place[starts[k] : starts[k + 1]] for k in order])
    for first in range(len(sets)):
        if label[first] >= 0:
            continue
        label[first], todo = first, [first]
        while todo:
            k = todo.pop()
            gone = label[left] >= 0
            if gone.sum() * 4 > len(left):
                held, left = held[np.repeat(~gone, sizes[left])], left[~gone]
            own, ends = place[starts[k] : starts[k + 1]], np.cumsum(sizes[left])
            lo, hi = np.searchsorted(sizes[left] * OF, sizes[k] * SHARED), np.searchsorted(sizes[left] * SHARED, sizes[k] * OF, side="right")
            if lo >= hi:
                continue
            begin = ends[lo] - sizes[left[lo]]
            marked[own] = True
            both = np.add.reduceat(marked[held[begin : ends[hi - 1]]], ends[lo:hi] - sizes[left[lo:hi]] - begin, dtype=np.int64)
            marked[own] = False
            near = left[lo:hi][similar(sizes[k], sizes[left[lo:hi]], both)]
            near = near[label[near] < 0]
            label[near] = first
            todo += near.tolist()
    return label


def _verify_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """Rows key, node, text sorted by key and node: u, v that are tied."""
    key, nodes, sets = None, [], []

    def settle() -> pa.RecordBatch:
        label = tied(sets) if len(sets) > 1 else np.zeros(len(sets), np.int64)
        node = np.array(nodes, np.int64)
        other = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[label[other]]), pa.array(node[other])], names=["u", "v"])

    for batch in batches:
        for k, node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if k != key:
                yield settle()
                key, nodes, sets = k, [], []
            if not nodes or nodes[-1] != node:
                nodes.append(node)
                sets.append(shingles(text.as_py(), shingle))
    yield settle()


def near_prints(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """u, v: edges that tie together the nodes (node, print) whose fingerprints op1's method links, equal ones too."""
    one = cut(nodes.groupBy("print").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("many")))
    equal = nodes.join(one.where("many > 1"), "print").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    return equal.unionByName(link(one.select(F.col("least").alias("node"), F.col("print").alias("m0")), crowd=crowd))


def candidates(nodes: DataFrame, crowd: int = CROWD) -> DataFrame:
    """u, v: edges that tie together the nodes (node, print, m0, ..., keys) that may be similar."""
    keyed = nodes.select(F.explode("keys").alias("key"), "node", *_NAMES)
    more = linked(nodes.select("node", *_NAMES), keyed, Plan(64, WORDS, APART, crowd, 63, ()))
    return near_prints(nodes.select("node", "print"), crowd).unionByName(more)


def classes(docs: DataFrame, shingle: int = SHINGLE, crowd: int = CROWD, block: int = BLOCK) -> DataFrame:
    """doc_id, _text (a hash of the text), root (the same for all rows of a component) of every row."""
    text = F.xxhash64("text")
    fields = "doc_id long, _text long, node long, print long, n long, " + ", ".join(f"{m} long" for m in _NAMES) + ", keys array<long>"
    marked = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"), "text").mapInArrow(partial(_mark_batches, shingle=shingle), fields))
    # what a node's rows have in common, and one of them, gathered before anything is moved
    same = [F.min("print").alias("print"), *[F.first(c).alias(c) for c in ("n", *_NAMES, "keys")]]
    nodes = cut(marked.where("n > 0").groupBy("node").agg(F.min(F.struct("doc_id", "_text")).alias("one"), *same))
    found = components(candidates(nodes, crowd))
    # each node of a component of candidates with one of its texts
    found = cut(found.join(nodes.select("node", "n", "one"), "node"))
    large = cut(found.groupBy("root").agg(F.sum("n").alias("size")).where(F.col("size") > block).select("root"))
    shown = found.select("node", "root", F.col("one.doc_id").alias("_id"), F.col("one._text").alias("_hash"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(shown, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))).select("node", "root", "text")

    def among(rows: DataFrame) -> DataFrame:
        return rows.select("key", "node", "text").repartition("key").sortWithinPartitions("key", "node").mapInArrow(partial(_verify_batches, shingle=shingle), "u long, v long")

    if large.isEmpty():  # each node has been given the first one of its component
        roots = among(texts.withColumnRenamed("root", "key")).select(F.col("v").alias("node"), F.col("u").alias("root"))
    else:
        few = among(texts.join(large, "root", "left_anti").withColumnRenamed("root", "key"))
        members = found.join(large, "root").select(F.col("root").alias("group"), "node", F.col("n").alias("size"))
        many = in_blocks(members, lambda rows: among(rows.join(texts.drop("root"), "node")), block)
        roots = components(few.unionByName(many))
    return cut(marked.select("doc_id", "_text", "node").join(cut(roots), "node", "left").select("doc_id", "_text", F.coalesce("root", "node").alias("root")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, with all its columns: that with the least id, a null one last, and of these the least text."""
    found = classes(docs, **options)
    one = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text")).alias("one"))
    one = cut(one.select(F.col("one.doc_id").alias("_id"), F.col("one._text").alias("_hash")))
    same = lambda doc_id, text: doc_id.eqNullSafe(one["_id"]) & (text == one["_hash"])
    out = docs.join(one, same(docs["doc_id"], F.xxhash64("text")), "left_semi")
    if found.join(one, same(found["doc_id"], found["_text"]), "left_semi").count() == one.count():
        return out
    # an id and a text repeat: rows of one id and text are the same document
    return out.withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"]).select(*docs.columns)
