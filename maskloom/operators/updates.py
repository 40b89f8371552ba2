"""Changes to documents, applied in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from maskloom.operators import validation

FIELDS = ["source_url", "capture_mode", "width", "height", "status", "source", "name", "source_domain",
          "original_asset_id", "working_asset_id", "history_index"]
_CHOICES = {
    "capture_mode": validation.CAPTURE_MODES,
    "status": validation.DOCUMENT_STATUSES,
    "source": validation.DOCUMENT_SOURCES,
}


def judged_updates(updates: DataFrame) -> DataFrame:
    """Add ``errors`` and ``valid``: a change with an unknown state, mode or source is refused whole."""
    rules = [validation.member(f, allowed) for f, allowed in _CHOICES.items() if f in updates.columns]
    return validation.checked(updates, validation.collected(*rules))


def folded(documents: DataFrame, updates: DataFrame) -> DataFrame:
    """Documents after all valid changes ``(document_id, seq, field...)``; null fields change nothing.

    The last non-null value of each field wins, which is a mergeable maximum per document: hot
    documents are combined before the shuffle. Changes to unknown documents are ignored.
    """
    fields = [f for f in FIELDS if f in updates.columns and f in documents.columns]
    last = [
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}") for f in fields
    ]
    changes = judged_updates(updates).filter("valid").groupBy("document_id").agg(*last)
    out = documents.join(changes, "document_id", "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"_{f}", f))
    return out.select(*documents.columns)


def latest(changes: DataFrame, key: str, version: str) -> DataFrame:
    """Newest row per key, as a mergeable maximum; also valid on a stream in update mode."""
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("row")).select(key, "row.*")
