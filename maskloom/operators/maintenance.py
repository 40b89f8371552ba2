"""Table maintenance: backfills, schema changes, uniqueness and duplicates, metric summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Retired states and job types with their successors.
STATUS_SUCCESSORS = {
    "awaiting_edits": "ready",
    "export_ready": "ready",
    "rendering": "ready",
    "processing": "loading",
    "queued_detection": "loading",
}
JOB_SUCCESSORS = {"text_detection": "detection", "font_guess": "detection"}

# Columns that were retired.
RETIRED_DOCUMENT_COLUMNS = ["metrics", "source_url_verified_at", "source_url_status"]
RETIRED_REGION_COLUMNS = ["inpainted_asset_id"]
RETIRED_JOB_COLUMNS = ["text_region_id", "subject_type"]


def _succeeded(value: Column, successors: dict[str, str]) -> Column:
    out = None
    for old, new in successors.items():
        out = (F if out is None else out).when(value == old, new)
    return out.otherwise(value)


def backfill_status(documents: DataFrame) -> DataFrame:
    return documents.withColumn("status", _succeeded(F.col("status"), STATUS_SUCCESSORS))


def backfill_job_types(jobs: DataFrame) -> DataFrame:
    return jobs.withColumn("type", _succeeded(F.col("type"), JOB_SUCCESSORS)).drop(*RETIRED_JOB_COLUMNS)


def add_document_columns(documents: DataFrame) -> DataFrame:
    """Source and history columns with their defaults, where still missing."""
    defaults = {
        "source": F.lit("extension"),
        "history": F.array().cast("array<struct<image_path:string,timestamp:timestamp,action:string,metadata:map<string,string>>>"),
        "history_index": F.lit(0),
    }
    missing = {c: v for c, v in defaults.items() if c not in documents.columns}
    return documents.withColumns(missing) if missing else documents


def split_dimensions(documents: DataFrame) -> DataFrame:
    """The old ``dimensions`` map gives way to empty ``width`` and ``height``; values are not taken over."""
    return documents.drop("dimensions").withColumns(
        {"width": F.lit(None).cast("int"), "height": F.lit(None).cast("int")})


def drop_retired(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def widen_address(documents: DataFrame) -> DataFrame:
    return documents.withColumn("source_url", F.col("source_url").cast("string"))


def merge_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows written before and after a schema change; missing columns read as null."""
    return old.unionByName(new, allowMissingColumns=True)


def name_conflicts(documents: DataFrame) -> DataFrame:
    """Names used more than once; documents without a name are free."""
    return (
        documents.filter(F.col("name").isNotNull()).groupBy("name")
        .agg(F.count("*").alias("uses")).filter(F.col("uses") > 1)
    )


def same_bytes(assets: DataFrame) -> DataFrame:
    """Fingerprints that occur more than once, with count and first asset.

    The ids of a group are not gathered: join the result back on ``sha256`` to list them as rows.
    """
    return (
        assets.filter(F.col("sha256").isNotNull()).groupBy("sha256")
        .agg(F.count("*").alias("copies"), F.min("asset_id").alias("first_asset_id")).filter(F.col("copies") > 1)
    )


def copies_of_assets(assets: DataFrame) -> DataFrame:
    """Every asset that repeats an earlier one, with the first of its kind."""
    return assets.join(same_bytes(assets), "sha256").filter(F.col("asset_id") != F.col("first_asset_id")).select(
        "asset_id", "first_asset_id")


def metric_summary(log: DataFrame, tags: list[str], value: str = "value") -> DataFrame:
    """Count, sum, extremes, mean and percentiles per tag.

    Percentiles are sketches of bounded size, so one dominant tag needs no more memory.
    """
    p = F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), 100000)
    return log.groupBy(*tags).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("lowest"),
        F.max(value).alias("highest"), F.avg(value).alias("mean"), p.alias("_p"),
    ).withColumns({"p50": F.col("_p")[0], "p95": F.col("_p")[1], "p99": F.col("_p")[2]}).drop("_p")


#: Size parameter of stored sketches, and the error of a rank it allows, as a part of all values.
SKETCH_SIZE, RANK_ERROR = 800, 0.01


def metric_sketches(log: DataFrame, tags: list[str], at: str = "at", value: str = "value") -> DataFrame:
    """Count, sum, extremes and a quantile sketch for each of ``tags`` and hour, to be stored and merged later.

    A sketch has some KB whatever it has seen. Null values count nowhere; an hour without values has no row.
    """
    return log.filter(F.col(value).isNotNull()).groupBy(*tags, F.date_trunc("hour", at).alias("hour")).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("lowest"), F.max(value).alias("highest"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH_SIZE).alias("sketch"))


def summary_of_sketches(sketches: DataFrame, tags: list[str], probabilities: dict[str, float]) -> DataFrame:
    """One summary for each of ``tags`` from any hours of :func:`metric_sketches`; the log is not read again.

    Each column of ``probabilities`` is a value whose rank is within ``RANK_ERROR`` of the probability.
    """
    merged = sketches.groupBy(*tags).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("lowest").alias("lowest"), F.max("highest").alias("highest"),
        F.kll_merge_agg_double("sketch", SKETCH_SIZE).alias("_sketch"))
    return merged.withColumns({c: F.kll_sketch_get_quantile_double("_sketch", F.lit(float(p))) for c, p in probabilities.items()}).withColumn(
        "mean", F.col("total") / F.col("n")).drop("_sketch")
