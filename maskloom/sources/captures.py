"""Capture requests as JSON, in batch and as a stream; region and asset tables as sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "width", "height")])
_REGION_BOX = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "w", "h")])
_POINT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y")])

CAPTURE = T.StructType([
    T.StructField("request_id", T.LongType()),
    T.StructField("requested_at", T.TimestampType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("capture_mode", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("image_data", T.StringType()),
    T.StructField("bounding_rect", _BOX),
    T.StructField("image_width", T.IntegerType()),
    T.StructField("image_height", T.IntegerType()),
    T.StructField("text_regions", T.ArrayType(T.StructType([
        T.StructField("bbox", _REGION_BOX),
        T.StructField("polygon", T.ArrayType(_POINT)),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("original_text", T.StringType()),
    ]))),
    T.StructField("segment_regions", T.ArrayType(T.StructType([
        T.StructField("bbox", _REGION_BOX),
        T.StructField("mask_png", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("area", T.DoubleType()),
        T.StructField("stabilityScore", T.DoubleType()),
    ]))),
])


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CAPTURE).json(path)


def stream_captures(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(CAPTURE)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def append_rows(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append asset or region rows to a Parquet table."""
    writer = rows.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Document table laid out for lookups by state; rows are sorted by domain so that its statistics prune.

    Ranges end in a hash of the row, so a domain that holds much of the table is cut into several files.
    """
    cut = F.xxhash64(*documents.columns)
    (
        documents.repartitionByRange("status", "source_domain", cut).sortWithinPartitions("status", "source_domain")
        .write.mode("overwrite").partitionBy("status").parquet(path)
    )


def documents_where(spark: SparkSession, path: str, status: str | None = None, source_domain: str | None = None) -> DataFrame:
    """Lookup by state (partition pruning) and domain (row group statistics)."""
    out = spark.read.parquet(path)
    if status is not None:
        out = out.filter(out.status == status)
    if source_domain is not None:
        out = out.filter(out.source_domain == source_domain)
    return out
