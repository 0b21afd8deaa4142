"""Office documents from end to end: read, scanned, decided, written back, verified, saved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pseudonymize, verify
from ..sources import ooxml, ooxml_write
from .config import Config
from .materialize import materialized
from .scan import ScanFrames, scan


def scan_documents(documents: DataFrame, config: Config | None = None) -> ScanFrames:
    """The scan of documents (path, content)."""
    return scan(materialized(ooxml.unpack(documents)), config)


def apply_documents(documents: DataFrame, frames: ScanFrames, decisions: DataFrame, mapping: pseudonymize.Mapping, folder: str, config: Config | None = None, key: str | None = None) -> tuple[DataFrame, pseudonymize.Mapping]:
    """Write documents with replacements into a folder (a URI that driver and executors share); path, written of each.

    The written documents are read and scanned again, and all their texts, attributes and embedded packages are searched for
    every removed value, before any of them is saved. The mapping is saved first.
    """
    config = config or Config()
    changes, minted = pseudonymize.changes(frames.findings, decisions, mapping)
    removed = materialized(pseudonymize.decided(frames.findings, decisions).where(F.col("action").isin(*verify.REMOVING)).select("doc_id", "value").distinct())
    written = materialized(ooxml_write.rewritten(documents, changes, removed))
    again = scan(materialized(ooxml.unpack(written)), config).findings
    verify.demand_clean(verify.leaks(again, decisions), ooxml_write.residuals(written, removed, config.deny))
    minted.save(f"{folder}._mapping", key)
    return materialized(ooxml_write.save(written, folder)), minted
