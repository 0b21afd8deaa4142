"""A place for model backends: spans predicted for distinct texts, in Arrow batches, one model for each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .detect import FINDINGS, ML_SOURCE

# What a zero-shot model is asked for, and the entity types of its answers.
LABELS = {
    "person": "PERSON", "organization": "ORGANIZATION", "location": "LOCATION", "tool": "TOOL", "division": "DIVISION", "department": "DEPARTMENT", "licensee": "LICENSEE", "project": "PROJECT",
    "health condition": "DE_HEALTH_DATA", "religious belief": "DE_RELIGION", "trade union or political party membership": "DE_UNION_PARTY", "sexual orientation": "DE_SEX_LIFE", "nationality or ethnic origin": "NRP",
}


class Backend(Protocol):
    """A model: spans of texts, each (label, start, end, score). `batch` texts at a time."""

    def predict(self, texts: list[str], labels: list[str]) -> list[list[dict]]: ...


def worth_asking(text: Column, least: int = 3) -> Column:
    return (F.length(F.trim(text)) >= least) & text.rlike(r"\p{L}")


def findings(units: DataFrame, load: Callable[[], Backend], labels: dict[str, str] | None = None, min_score: float = 0.3, min_chars: int = 3, batch: int = 16, source: str = ML_SOURCE) -> DataFrame:
    """text, model_found of the distinct texts of units. load: makes the backend, once in each worker."""
    labels = labels or LABELS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = load()
        for frame in frames:
            texts, out = frame["text"].tolist(), []
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                for text, spans in zip(part, backend.predict(part, list(labels)), strict=True):
                    kept = [s for s in spans if s["score"] >= min_score and s["label"] in labels]
                    out.append([(int(s["start"]), int(s["end"]), labels[s["label"]], text[s["start"] : s["end"]], float(s["score"]), source, None) for s in kept])
            names = ("start", "end", "entity_type", "value", "score", "source", "validated")
            yield pd.DataFrame({"text": texts, "model_found": [[dict(zip(names, f, strict=True)) for f in fs] for fs in out]})

    asked = units.select("text").where(worth_asking(F.col("text"), min_chars)).distinct()
    return asked.mapInPandas(run, f"text string, model_found {FINDINGS}")
