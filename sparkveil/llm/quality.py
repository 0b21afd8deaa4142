"""Quality scores from compression: zstandard dictionaries of good and bad text.

A text is cut into blocks of `block_bytes` bytes (all of it, the last block may be shorter). Each block is
compressed once with a dictionary trained on good labelled text and once with one trained on bad text. The
difference of the compressed sizes, divided by the text's bytes and drawn towards the training mean for short
texts, goes through a logistic curve fitted on labelled rows that no dictionary has seen.

Defined results: a null text counts as empty; an empty text has the training mean as its difference, so its score
is the prior's; repeated rows and rows with a null id are scored one by one; without labels of both kinds every score
is 1.0 (all labels good), 0.0 (all bad) or 0.5 (none). Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_text, table


@dataclass(frozen=True)
class Settings:
    #: Bound of the labelled rows that the model is fitted on, for each label.
    per_label: int = 1500
    #: Bound of what the fit reads of each of them: a window of so many characters, at a place drawn from its id.
    fit_chars: int = 20_000
    #: Of these, every n-th calibrates; the others make the dictionaries.
    calibrate_every: int = 3
    dict_bytes: int = 65536
    block_bytes: int = 512
    level: int = 3
    #: Bytes of average text that a text's own difference is mixed with.
    shrink_bytes: int = 128


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    mean: float
    slope: float
    offset: float
    settings: Settings
    constant: float | None = None


def _dictionary(texts: list[bytes], s: Settings) -> bytes:
    blocks = [t[i : i + s.block_bytes] for t in texts for i in range(0, len(t), s.block_bytes)]
    try:
        return zstandard.train_dictionary(s.dict_bytes, blocks).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself serves as the dictionary
        return b"".join(blocks)[-s.dict_bytes :]


def _compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    out = []
    for data in (model.good, model.bad):
        made = zstandard.ZstdCompressionDict(data)
        made.precompute_compress(level=model.settings.level)
        out.append(zstandard.ZstdCompressor(level=model.settings.level, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def _gain(text: bytes, good, bad, step: int) -> int:
    """Bytes that the good dictionary saves against the bad one over the whole text."""
    total = 0
    for i in range(0, len(text), step):
        block = text[i : i + step]
        total += len(bad.compress(block)) - len(good.compress(block))
    return total


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression of y on one column, by Newton steps with a weak ridge."""
    z = (x - (centre := x.mean())) / (spread := x.std() or 1.0)
    a = np.stack([z, np.ones_like(z)], axis=1)
    beta, ridge = np.zeros(2), np.array([1e-2, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (w * (y - p)) - ridge * beta)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return float(beta[0] / spread), float(beta[1] - beta[0] * centre / spread)


def fit(good: list[str], bad: list[str], good_rows: int, bad_rows: int, settings: Settings = Settings()) -> Model:
    """A model from labelled texts; good_rows and bad_rows: how many rows of all have either label."""
    if not good or not bad:
        return Model(b"", b"", 0.0, 0.0, 0.0, settings, constant=1.0 if good else 0.0 if bad else 0.5)
    texts = {1: [t.encode() for t in good], 0: [t.encode() for t in bad]}
    every = settings.calibrate_every
    held = {k: v[::every] for k, v in texts.items()}
    seen = {k: [t for i, t in enumerate(v) if i % every] or v for k, v in texts.items()}
    model = Model(_dictionary(seen[1], settings), _dictionary(seen[0], settings), 0.0, 0.0, 0.0, settings)
    pair = _compressors(model)
    size = {k: np.array([len(t) for t in v], float) for k, v in held.items()}
    gain = {k: np.array([_gain(t, *pair, settings.block_bytes) for t in v], float) for k, v in held.items()}
    share = good_rows / (good_rows + bad_rows)
    mean = sum(p * float((gain[k] / np.maximum(size[k], 1)).mean()) for k, p in ((1, share), (0, 1 - share)))
    x = np.concatenate([(gain[k] + settings.shrink_bytes * mean) / (size[k] + settings.shrink_bytes) for k in (1, 0)])
    y = np.concatenate([np.full(len(held[k]), float(k)) for k in (1, 0)])
    w = np.concatenate([np.full(len(held[k]), p * len(x) / len(held[k])) for k, p in ((1, share), (0, 1 - share))])
    slope, offset = _logistic(x, y, w)
    return Model(model.good, model.bad, mean, slope, offset, settings)


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on at most settings.per_label rows of each label outside the held-out third, chosen by a hash of their id.

    The driver gets 2 * per_label * fit_chars characters at most (60 million by the defaults).
    """
    lab = labels.where("quality in (0, 1)").where(crc32_text(F.col("doc_id")) % 3 != 1).select("doc_id", "quality")
    counts = {r["quality"]: r["n"] for r in lab.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for k in (0, 1):
        some = lab.where(F.col("quality") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.per_label)
        chosen = some if chosen is None else chosen.unionByName(some)
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality"))  # at most 2 * per_label rows
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    room = F.greatest(F.length("text") - settings.fit_chars, F.lit(0))
    texts = texts.withColumn("text", F.substr("text", (F.pmod(F.xxhash64("doc_id", F.lit(1)), room + 1) + 1).cast("int"), F.lit(settings.fit_chars)))
    rows = sorted(((r["doc_id"], r["quality"], r["text"] or "") for r in texts.collect()), key=lambda r: (hash(r[0]) * 2654435761 % 2**32, r[0]))
    return fit([r[2] for r in rows if r[1] == 1], [r[2] for r in rows if r[1] == 0], counts.get(1, 0), counts.get(0, 0), settings)


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    """Scores of texts in one process."""
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    pair, s = _compressors(model), model.settings
    data = [(t or "").encode() for t in texts]
    gain = np.array([_gain(t, *pair, s.block_bytes) for t in data], float)
    size = np.array([len(t) for t in data], float)
    x = (gain + s.shrink_bytes * model.mean) / (size + s.shrink_bytes)
    return 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -40, 40)))


def _score_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *kept, texts = batch.columns
        score = pa.array(score_texts(model, texts.to_pylist()), pa.float64())
        yield pa.RecordBatch.from_arrays([*kept, score], names=[*batch.schema.names[:-1], "_score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row."""
    out = docs.select("doc_id", "text").mapInArrow(partial(_score_batches, model=model), "doc_id long, _score double")
    return out.select("doc_id", F.col("_score").alias("score"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, whose score is at least 0.5."""
    kept = [c for c in docs.columns]
    fields = [f for f in docs.schema.fields]
    shown = docs.select(*kept, F.col("text").alias("_scored"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = score_texts(model, batch.column(batch.num_columns - 1).to_pylist()) >= 0.5
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(good))

    from pyspark.sql.types import StructType

    return shown.mapInArrow(keep, StructType(fields))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document; the rows whose crc32(doc_id) mod 3 is 1 are held out of training."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        F.coalesce(crc32_text(F.col("doc_id")) % 3 == 1, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
