"""SimHash near-duplicates: fingerprints of 64-bit words, linked where few bits differ, candidates by pigeonring filtering.

A fingerprint's bit is 1 if over half of the text's word shingles have it in their XXH64; further words take the bits of
further mixes of that hash. Two fingerprints are linked if some word differs in `distance` bits at most and all words
together in `total` bits at most.

A word is cut into distance + 1 segments on a ring. If it differs in t = distance bits at most, some segment starts a chain in
which the first l segments differ in l - 1 bits at most, for every l up to t (the pigeonring principle: each prefix
stays within its share of the budget). So the first segment agrees, and the second differs in one bit at most, which leaves
one of its two halves untouched. (First segment, one half of the next, ...) is the key under which candidates meet; the
rest of the chain is checked before the whole distance. A deeper key takes a third segment, cut into three, and so on.

Equal fingerprints are one node. Nodes of a key are compared in a stream of rows sorted by key, in which only what ties a
key's nodes together leaves the task, never all pairs. The nodes of a key with more than `crowd` of them go another,
exact way. For distances up to 4, each is noted under all points within half the distance of its word, and nodes that share a
point are linked. For greater ones see `in_blocks`.

Defined results: A-Z is lower-cased, words are runs of anything but the six ASCII blanks; fewer words than a shingle
make one shingle; a null, empty or blank text has fingerprint zero and is linked like any other; rows with a null id are
linked too, and never give a component its name unless all its ids are null; repeated rows get equal results; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import partial
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import components

SHINGLE = 4
DISTANCE = 4
CROWD = 2048
#: Rows of a key, and values that keys are counted by.
HOT_ROWS, BUCKETS = 100_000, 1 << 16
#: Members, about, that every block of a large group is compared with.
HUBS = 32
#: Segments that a key takes parts of. With a distance of 4 three make 30 keys of 23 bits a fingerprint, so a key of unlike
#: fingerprints stays below `CROWD` up to some 10 billion of them.
DEPTH = 3


def _further(hashes: np.ndarray) -> np.ndarray:
    """Another 64 mixed bits of each hash."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 of each of a text's word shingles, in its order and with repetitions; none of a blank text."""
    said = (text or "").encode().lower().split()
    if not said:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(said), xxhash.xxh64_intdigest
    if len(said) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts, ends = [0, *[g + 1 for g in gaps]], [*gaps, len(joined)]
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE, words: int = 1) -> list[int]:
    """The words of a text's fingerprint, unsigned."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return [0] * words
    out = []
    for _ in range(words):
        out.append(majority(hashes))
        hashes = _further(hashes)
    return out


def _names(words: int) -> list[str]:
    return [f"m{k}" for k in range(words)]


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.columns
        marks = np.array([fingerprint(t.as_py(), shingle, words) for t in texts], np.uint64).reshape(-1, words)
        yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.ascontiguousarray(m).view(np.int64)) for m in marks.T]], names=["doc_id", *_names(words)])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, words: int = 1) -> DataFrame:
    """doc_id and the fingerprint's words m0, m1, ... as signed longs, of every row."""
    fields = ", ".join(f"{m} long" for m in ["doc_id", *_names(words)])
    shown = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return shown.mapInArrow(partial(_fingerprint_batches, shingle=shingle, words=words), fields)


def segments(distance: int) -> list[tuple[int, int]]:
    """First bit and width of each of distance + 1 segments."""
    n = distance + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _parts(first: int, width: int, n: int) -> list[tuple[int, int]]:
    edges = [first + width * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def key_layouts(distance: int, depth: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each kind of key: the segment that its chain starts at, and the bit ranges that must agree."""
    ring = segments(distance)
    out = []
    for start, (first, width) in enumerate(ring):
        # up to the k-th segment after the first k bits differ at most: of its k + 1 parts one is untouched
        choices = [_parts(*ring[(start + k) % len(ring)], k + 1) for k in range(1, depth)]
        out += [(start, [(first, width), *chosen]) for chosen in product(*choices)]
    return out


def _key(mark: Column, kind: int, ranges: list[tuple[int, int]]) -> Column:
    value = F.lit(kind).cast("long")
    for first, width in ranges:
        value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned(mark, first).bitwiseAND(F.lit((1 << width) - 1)))
    return value


def _tie(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give tied positions the least label among them. labels[k] <= k leads to the label of k's group."""
    while len(a):
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (deeper := labels[labels]).tobytes() != labels.tobytes():
            labels[:] = deeper


def viable(apart: np.ndarray, start: np.ndarray, distance: int) -> np.ndarray:
    """Positions of the differing bits whose chain from segment `start` keeps to its budgets, and so the whole distance."""
    ring = segments(distance)
    masks = np.array([((1 << w) - 1) << f for f, w in ring], np.uint64)
    left, total = np.arange(len(apart)), np.zeros(len(apart), np.int64)
    for k in range(len(ring)):
        total = total + np.bitwise_count(apart & masks[(start + k) % len(ring)])
        kept = total <= (distance * (k + 1)) // len(ring)
        left, apart, total, start = left[kept], apart[kept], total[kept], start[kept]
    return left


@dataclass(frozen=True)
class Plan:
    """What the tasks need to compare the rows of a key."""

    distance: int
    words: int
    total: int
    crowd: int
    #: The bits of a key below its kind.
    width: int
    #: Of each kind: the word, and the segment that its chain starts at. None: only the total counts.
    kinds: tuple[tuple[int, int], ...]
    #: Whether rows have their kind in a column; else it is what stands above a key's width.
    told: bool = False


def _ties(keys: np.ndarray, kinds: np.ndarray, marks: np.ndarray, plan: Plan) -> np.ndarray:
    """Rows sorted by key: for each row the first row that links tie it to."""
    labels, at, step = np.arange(len(keys)), np.arange(len(keys)), 0
    word, start = (np.array([k[i] for k in plan.kinds])[kinds] for i in (0, 1)) if plan.kinds else (None, None)
    while True:
        step += 1
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            return labels
        open_ = at[labels[at] != labels[at + step]]
        apart = marks[open_] ^ marks[open_ + step]
        near = viable(apart[np.arange(len(open_)), word[open_]], start[open_], plan.distance) if plan.kinds else np.arange(len(open_))
        if plan.words > 1:
            near = near[np.bitwise_count(apart[near]).sum(axis=1, dtype=np.int64) <= plan.total]
        _tie(labels, open_[near], open_[near] + step)


def _tie_batches(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    """Rows key, node, m0, ... (kind) sorted by key: u, v that are tied; and, with v = key, the nodes of crowded keys."""
    names = ["u", "v", "kind", "crowded"]
    held: np.ndarray | None = None  # the rows of the last key so far
    passing = None  # the crowded key whose rows pass on as they come

    def out(u: np.ndarray, v: np.ndarray, kind: np.ndarray, crowded: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(kind.astype(np.int32)), pa.array(np.full(len(u), crowded))], names=names)

    def alone(rows: np.ndarray) -> pa.RecordBatch:
        return out(rows[:, 2], rows[:, 0], rows[:, 1], True)

    def settle(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, where, counts = np.unique(rows[:, 0], return_inverse=True, return_counts=True)
        many = (counts > plan.crowd)[where] if len(rows) else np.zeros(0, bool)
        yield alone(rows[many])
        rows = rows[~many]
        labels = _ties(rows[:, 0], rows[:, 1], np.ascontiguousarray(rows[:, 3:]).view(np.uint64), plan)
        tied = np.flatnonzero(labels != np.arange(len(rows)))
        yield out(rows[labels[tied], 2], rows[tied, 2], rows[tied, 1], False)

    for batch in batches:
        key, node, *marks = [c.to_numpy().astype(np.int64, copy=False) for c in batch.columns]
        kind = marks.pop() if plan.told else key >> plan.width
        rows = np.stack([key, kind, node, *marks], axis=1)
        if held is not None:
            rows = np.concatenate([held, rows])
        if passing is not None:
            yield alone(rows[rows[:, 0] == passing])
            rows = rows[rows[:, 0] != passing]
        if not len(rows):
            continue
        passing, last = None, rows[:, 0] == rows[-1, 0]
        held = rows[last]
        yield from settle(rows[~last])
        if len(held) > plan.crowd:
            passing = held[0, 0]
            yield alone(held)
            held = held[:0]
    if held is not None:
        yield from settle(held)


def _ball_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    masks = np.array([sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(64), r)], np.uint64)
    for batch in batches:
        marks = batch.column(0).to_numpy().view(np.uint64)
        for i in range(0, len(marks), 64):
            points = (marks[i : i + 64, None] ^ masks[None, :]).ravel()
            nodes = np.repeat(batch.column(1).to_numpy()[i : i + 64], len(masks))
            yield pa.RecordBatch.from_arrays([pa.array(points.view(np.int64)), pa.array(nodes)], names=["point", "node"])


def link(nodes: DataFrame, distance: int = DISTANCE, words: int = 1, total: int | None = None, crowd: int = CROWD, depth: int = DEPTH, hot_rows: int = HOT_ROWS) -> DataFrame:
    """u, v: edges that tie together all that links tie together, of different fingerprints (node, m0, m1, ...)."""
    layouts = [(w, start, ranges) for w in range(words) for start, ranges in key_layouts(distance, depth)]
    width = max(sum(n for _, n in ranges) for _, _, ranges in layouts)
    keys = []
    for kind, (w, _, ranges) in enumerate(layouts):
        short = width - sum(n for _, n in ranges)
        keys.append(F.shiftleft(_key(F.col(f"m{w}"), kind, ranges), short))
    plan = Plan(distance, words, 64 * words if total is None else total, crowd, width, tuple((w, start) for w, start, _ in layouts))
    keyed = nodes.select(F.explode(F.array(*keys)).alias("key"), "node", *_names(words))
    return linked(nodes, keyed, plan, hot_rows)


def _hot_keys(keyed: DataFrame, hot_rows: int) -> DataFrame | None:
    """Keys of more than `hot_rows` rows that stand out, which go the exact other way before any task has gathered them.

    Rows are counted by 65,536 values of a hash, in the tasks that make them; only where a value has many more than the others
    are its keys counted one by one.
    """
    value = F.pmod(F.xxhash64("key"), F.lit(BUCKETS))
    counts = cut(keyed.groupBy(value.alias("_value")).agg(F.count(F.lit(1)).alias("n")))  # a row for each value
    total = counts.agg(F.sum("n")).first()[0] or 0
    heavy = counts.where(F.col("n") > hot_rows + 1.2 * total / BUCKETS).select("_value")
    if heavy.isEmpty():
        return None
    some = keyed.withColumn("_value", value).join(F.broadcast(heavy), "_value")
    return cut(some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("key"))


def linked(nodes: DataFrame, keyed: DataFrame, plan: Plan, hot_rows: int = HOT_ROWS) -> DataFrame:
    """u, v: edges that tie together what links tie together, of nodes (node, m0, m1, ...) that meet under a key (key, node, m0, ...)."""
    words, distance, crowd = plan.words, plan.distance, plan.crowd
    own = _names(words)
    edge = "u long, v long, kind int, crowded boolean"

    def compare(keyed: DataFrame, how: Plan) -> DataFrame:
        kind = ["kind"] if how.told else []  # a column less to move where the key says it
        sorted_ = keyed.select("key", "node", *own, *kind).repartition("key").sortWithinPartitions("key", "node")
        return sorted_.mapInArrow(partial(_tie_batches, plan=how), edge)

    hot = _hot_keys(keyed, hot_rows)
    tied = cut(compare(keyed if hot is None else keyed.join(hot, "key", "left_anti"), plan))
    edges = tied.where("not crowded").select("u", "v")
    crowded = tied.where("crowded").select(F.col("u").alias("node"), F.col("v").alias("key"), "kind")
    if hot is not None:
        crowded = cut(crowded.unionByName(keyed.join(hot, "key").select("node", "key", F.shiftright("key", plan.width).cast("int").alias("kind"))))
    if crowded.isEmpty():
        return edges
    if words == 1 and distance <= 4:
        points = crowded.select("node").distinct().join(nodes, "node").select("m0", "node").repartition("node").mapInArrow(partial(_ball_batches, radius=distance // 2), "point long, node long")
        if distance % 2:
            raise ValueError("the distance must be even")
        least = points.groupBy("point").agg(F.min("node").alias("u"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        shared = points.join(least, "point").where(F.col("u") != F.col("node")).select("u", F.col("node").alias("v"))
        return edges.unionByName(shared)
    kinds = crowded.groupBy("key").agg(F.min("kind").alias("kind"))  # a key is of one kind
    told = replace(plan, crowd=1 << 62, told=True)

    def among(rows: DataFrame) -> DataFrame:
        return compare(rows.join(kinds, rows["group"] == kinds["key"]).select(rows["key"], "node", "kind").join(nodes, "node"), told).select("u", "v")

    members = crowded.select(F.col("key").alias("group"), "node", F.lit(1).alias("size"))
    return edges.unionByName(in_blocks(members, among, crowd, edges))


def in_blocks(members: DataFrame, among: Callable[[DataFrame], DataFrame], block: int, edges: DataFrame | None = None) -> DataFrame:
    """u, v: what ties together the members (group, node, size) of groups that are too large for a task, beyond `edges`.

    among(rows group, node, key): the edges between nodes of a key, all of which one task compares. A group is dealt into
    blocks of a size of about `block`. First each block is compared with itself and with HUBS members or so of the whole group. In a
    group of near copies this ties all but a few together, and what is tied is not compared again: only the
    rest, those outside the group's largest component, are compared with every block. So the work grows with the
    group, and not with its square, as long as the rest is small; no pair of different components goes without comparison.
    """
    sizes = members.groupBy("group").agg(F.ceil(F.sum("size") / block).cast("long").alias("blocks"), F.count(F.lit(1)).alias("_n"))
    dealt = members.join(sizes, "group")
    dealt = cut(dealt.withColumn("mine", F.pmod(F.xxhash64("node"), "blocks")).withColumn("hub", F.pmod(F.xxhash64("node", F.lit(1)), "_n") < HUBS))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    first = dealt.withColumn("at", F.explode(F.when(F.col("hub"), upto("blocks")).otherwise(F.array("mine"))))
    found = cut(among(first.select("group", "node", F.xxhash64("group", "at").alias("key"))))
    if sizes.where("blocks > 1").isEmpty():
        return found
    roots = components(found if edges is None else found.unionByName(edges))
    placed = cut(dealt.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    most = placed.groupBy("group", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("group").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    placed = placed.join(most, "group").withColumn("rest", F.col("root") != F.col("main"))
    left = cut(placed.where("rest and blocks > 1").groupBy("group").agg(F.ceil(F.sum("size") / block).cast("long").alias("parts")))
    if left.isEmpty():
        return found
    again = placed.join(left, "group").withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), "parts"))
    pair = lambda part, at: F.struct(part.alias("part"), at.alias("at"))
    own = F.transform(upto("parts"), lambda k: pair(k, F.col("mine")))
    rest = F.when(F.col("rest"), F.transform(upto("blocks"), lambda k: pair(F.col("part"), k)))
    again = again.withColumn("to", F.explode(F.array_distinct(F.concat(own, F.coalesce(rest, F.array().cast("array<struct<part:bigint,at:bigint>>"))))))
    return found.unionByName(among(again.select("group", "node", F.xxhash64("group", "to.part", "to.at", F.lit(3)).alias("key"))))


def classes(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, words: int = 1, total: int | None = None, crowd: int = CROWD) -> DataFrame:
    """doc_id, m0, m1, ..., component_id of every row."""
    own = _names(words)
    marked = cut(fingerprints(docs, shingle, words))
    nodes = cut(marked.groupBy(*own).agg(F.min("doc_id").alias("least")).withColumn("node", F.col("m0") if words == 1 else F.monotonically_increasing_id()))
    roots = components(link(nodes.drop("least"), distance, words, total, crowd))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.select(*own, "root").join(named, "root").drop("root"), own)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: 4-word shingles, links of 4 differing bits or fewer."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("m0"), 16, "0")).alias("fingerprint"), "component_id")
