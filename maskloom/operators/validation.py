"""Record validation: every rule yields a field and a message, and the report collects them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Allowed members and messages.
CAPTURE_MODES = ["direct_asset", "screenshot"]
DOCUMENT_STATUSES = ["loading", "ready", "error"]
DOCUMENT_SOURCES = ["extension", "upload"]
REGION_TYPES = ["text", "manual", "object"]
REGION_STATUSES = ["detected", "error"]
ASSET_KINDS = ["original", "working", "mask", "export"]
HISTORY_ACTIONS = ["restore"]
BLANK = "can't be blank"
INVALID = "is invalid"
TOO_LOW = "must be greater than or equal to %{number}"
TOO_HIGH = "must be less than or equal to %{number}"


def blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value.cast("string")) == "")


def _error(field: str, message: str) -> Column:
    return F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"))


def required(field: str, when: Column | None = None) -> Column:
    missing = blank(F.col(field))
    return F.when(missing if when is None else missing & when, _error(field, BLANK))


def member(field: str, allowed: list[str]) -> Column:
    """Blank values are not judged here."""
    return F.when(~blank(F.col(field)) & ~F.col(field).isin(allowed), _error(field, INVALID))


def collected(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def document_errors() -> Column:
    """A page address is needed unless the image was uploaded; an unknown source counts as a capture."""
    uploaded = F.coalesce(F.col("source") == "upload", F.lit(False))
    return collected(
        required("capture_mode"), member("capture_mode", CAPTURE_MODES),
        required("source_url", ~uploaded), member("status", DOCUMENT_STATUSES),
        member("source", DOCUMENT_SOURCES),
    )


def region_errors() -> Column:
    return collected(
        required("type"), member("type", REGION_TYPES), member("status", REGION_STATUSES),
        F.when(F.col("confidence") < 0, _error("confidence", TOO_LOW)),
        F.when(F.col("confidence") > 1, _error("confidence", TOO_HIGH)),
    )


def asset_errors() -> Column:
    return collected(
        required("document_id"), required("kind"), member("kind", ASSET_KINDS), required("storage_uri")
    )


def history_entry_valid(entry: Column) -> Column:
    return ~(blank(entry["image_path"]) | entry["timestamp"].isNull() | blank(entry["action"])) & F.coalesce(
        entry["action"].isin(HISTORY_ACTIONS), F.lit(False)
    )


def history_valid(history: Column) -> Column:
    """Every embedded entry has a path, a time and a known action."""
    return F.forall(F.coalesce(history, F.array().cast(
        "array<struct<image_path:string,timestamp:timestamp,action:string>>")), history_entry_valid)


def error_report(errors: Column) -> Column:
    """Map from field to its messages."""
    fields = F.array_distinct(F.transform(errors, lambda e: e["field"]))
    return F.map_from_entries(F.transform(fields, lambda f: F.struct(
        f, F.transform(F.filter(errors, lambda e: e["field"] == f), lambda e: e["message"])
    )))


def checked(df: DataFrame, errors: Column) -> DataFrame:
    """Add ``errors`` and ``valid``; split with ``filter("valid")`` and ``filter("not valid")``."""
    return df.withColumn("errors", errors).withColumn("valid", F.size("errors") == 0)
