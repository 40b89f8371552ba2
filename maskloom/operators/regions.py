"""Region tables: layering, metadata, views, deletion, and differences between versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from maskloom.functions import boxes as B, urls
from maskloom.operators import intake, ordering

# First layer of each kind of region, and where a region came from.
SEGMENT_LAYER = 1000
AUTO_LAYER = 1500
MANUAL_LAYER = 2000
TEXT_ORIGIN = "text_detection"
SEGMENT_ORIGIN = "extension_segmentation"
AUTO_ORIGIN = "auto_segmentation"
MANUAL_ORIGIN = "click_to_segment"


def either(values: Column, first: str, second: str) -> Column:
    """Map lookup under two possible spellings."""
    return F.coalesce(F.try_element_at(values, F.lit(first)), F.try_element_at(values, F.lit(second)))


def region_counts(documents: DataFrame, regions: DataFrame) -> DataFrame:
    """Number of regions per document, 0 where there is none."""
    n = regions.groupBy("document_id").agg(F.count("*").alias("regions"))
    return documents.select("document_id").join(n, "document_id", "left").withColumn(
        "regions", F.coalesce("regions", F.lit(0))
    )


def _numbered(new: DataFrame, order: Sequence[Column], coarse: Sequence[Column] | None) -> DataFrame:
    return ordering.ordinal(new, ["document_id"], order, coarse, "index")


def _after_existing(numbered: DataFrame, existing: DataFrame, extra: int) -> DataFrame:
    n = existing.groupBy("document_id").agg(F.count("*").alias("_n"))
    return (
        numbered.join(n, "document_id", "left")
        .withColumn("index", F.col("index") + F.coalesce("_n", F.lit(0)) + extra).drop("_n")
    )


def _row(df: DataFrame, kind: str, layer: Column, confidence: Column, polygon: Column, path: Column, meta: Column) -> DataFrame:
    return df.select(
        "document_id", "region_id", F.lit(kind).alias("type"), B.normalize_box(F.col("bbox")).alias("bbox"),
        polygon.alias("polygon"), path.alias("mask_path"), confidence.cast("double").alias("confidence"),
        meta.alias("metadata"), layer.cast("int").alias("z_index"), F.lit("detected").alias("status"),
    )


def _meta(**values: Column | str) -> Column:
    pairs = []
    for k, v in values.items():
        pairs += [F.lit(k), (F.lit(v) if isinstance(v, str) else v).cast("string")]
    return F.create_map(*pairs)


_NO_POLYGON = "array<struct<x:double,y:double>>"


def text_regions(new: DataFrame, order, coarse=None) -> DataFrame:
    """Layer = input position. Needs ``bbox``, ``polygon``, ``confidence`` and ``original_text``."""
    n = _numbered(new, order, coarse)
    return _row(
        n, "text", F.col("index"), F.coalesce("confidence", F.lit(1.0)), B.normalize_polygon(F.col("polygon")),
        F.lit(None).cast("string"), _meta(source=TEXT_ORIGIN, original_text=F.col("original_text")),
    )


def segment_regions(new: DataFrame, order, coarse=None) -> DataFrame:
    """Layer = 1000 + input position. Positions are given before undecodable masks go, so gaps stay.

    Needs ``bbox``, ``score``, ``mask_ok``, ``folder`` and the open map ``attributes``.
    """
    n = _numbered(new, order, coarse).filter("mask_ok")
    return _row(
        n, "object", F.col("index") + SEGMENT_LAYER, F.coalesce("score", F.lit(1.0)),
        F.array().cast(_NO_POLYGON), intake.segment_mask_path(F.col("folder"), F.col("index")),
        _meta(source=SEGMENT_ORIGIN, area=F.coalesce(F.try_element_at("attributes", F.lit("area")), F.lit("0")),
              stability_score=either(F.col("attributes"), "stabilityScore", "stability_score")),
    )


def auto_regions(new: DataFrame, existing: DataFrame, order, coarse, micros: Column) -> DataFrame:
    """Layer = 1500 + existing regions + input position, positions again before masks are dropped."""
    n = _after_existing(_numbered(new, order, coarse), existing, 0).filter("mask_ok")
    return _row(
        n, "object", F.col("index") + AUTO_LAYER, F.coalesce("score", F.lit(1.0)),
        F.array().cast(_NO_POLYGON), intake.auto_mask_path(F.col("folder"), micros, F.col("index")),
        _meta(source=AUTO_ORIGIN, area=F.coalesce(F.try_element_at("attributes", F.lit("area")), F.lit("0")),
              stability_score=either(F.col("attributes"), "stability_score", "stabilityScore"),
              centroid=F.to_json(B.centroid(B.normalize_box(F.col("bbox"))))),
    )


def manual_regions(new: DataFrame, existing: DataFrame, order, coarse, millis: Column) -> DataFrame:
    """Layer = 2000 + regions present when each is added; masks that fail add nothing and take no number."""
    n = _after_existing(_numbered(new.filter("mask_ok"), order, coarse), existing, -1)
    return _row(
        n, "manual", F.col("index") + MANUAL_LAYER, F.lit(1.0), F.array().cast(_NO_POLYGON),
        intake.manual_mask_path(F.col("folder"), millis), _meta(source=MANUAL_ORIGIN),
    )


def mask_views(regions: DataFrame) -> DataFrame:
    """What an editor needs of a region."""
    return regions.select("document_id", "region_id", "type", "bbox", "z_index",
                          urls.mask_url(F.col("mask_path")).alias("mask_url"))


def document_view(documents: DataFrame, assets: DataFrame, regions: DataFrame) -> DataFrame:
    """Document with its original and working asset and its regions, one row per region.

    The regions stay rows: nesting them per document would gather a crowded document in one task.
    """
    def side(name):
        return assets.select(F.col("asset_id").alias(f"{name}_asset_id"), F.col("storage_uri").alias(f"{name}_uri"))

    return (
        documents.join(side("original"), "original_asset_id", "left")
        .join(side("working"), "working_asset_id", "left")
        .join(regions, "document_id", "left")
    )


def delete_regions(regions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remaining regions, and deleted counts per document.

    A request names document and region; a region of another document is left alone.
    """
    on = ["document_id", "region_id"]
    gone = regions.join(requests.select(*on), on, "left_semi")
    counts = requests.select("document_id").distinct().join(
        gone.groupBy("document_id").agg(F.count("*").alias("deleted")), "document_id", "left"
    ).withColumn("deleted", F.coalesce("deleted", F.lit(0)))
    return regions.join(requests.select(*on), on, "left_anti"), counts


def not_in(rows: DataFrame, known: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a partner: new regions, candidates not yet tracked, stale cache entries."""
    return rows.join(known.select(*on), list(on), "left_anti")


def cascade_document_delete(documents: DataFrame, regions: DataFrame) -> DataFrame:
    """Regions of documents that still exist."""
    return regions.join(documents.select("document_id"), "document_id", "left_semi")


def cascade_asset_delete(documents: DataFrame, assets: DataFrame) -> DataFrame:
    """References to assets that no longer exist become null."""
    out = documents
    for name in ("original", "working"):
        there = assets.select(F.col("asset_id").alias(f"{name}_asset_id"), F.lit(True).alias("_there"))
        out = out.join(there, f"{name}_asset_id", "left").withColumn(
            f"{name}_asset_id", F.when(F.col("_there"), F.col(f"{name}_asset_id"))
        ).drop("_there")
    return out


def awaiting_text_detection(documents: DataFrame, regions: DataFrame) -> DataFrame:
    """Documents whose regions are all objects or manual (or that have none)."""
    texted = regions.filter(~F.col("type").isin("object", "manual")).select("document_id")
    return documents.join(texted, "document_id", "left_anti")
