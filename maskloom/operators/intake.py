"""From capture requests to documents and assets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from maskloom.functions import images as I, texts, urls
from maskloom.functions.boxes import round_half_up
from maskloom.operators import ordering, spatial, validation

# Where files go, the export name without a document name, what a fetched image may
# answer, and the smallest candidate.
UPLOAD_ROOT = "priv/static/uploads"
MIN_CANDIDATE_SIDE = 100
RETRY_STATUS = 405
PARTIAL_STATUS = 206
UPRIGHT = "matrix(1, 0, 0, 1, 0, 0)"
EXPORT_FALLBACK = "export"


def with_dimensions(requests: DataFrame) -> DataFrame:
    """``image_width`` and ``image_height`` replace ``width`` and ``height`` only where present."""
    out = requests
    for side in ("width", "height"):
        own = F.col(side) if side in requests.columns else F.lit(None).cast("int")
        out = out.withColumn(side, F.coalesce(F.col(f"image_{side}"), own))
    return out.drop("image_width", "image_height")


def base64_refusal(data_url: Column, size: Column | None = None) -> Column:
    """First reason against an inline image, or null."""
    content = I.strict_base64(I.data_url_payload(data_url))
    size = I.image_size(content, jpeg=True) if size is None else size
    return (
        F.when(I.data_url_payload(data_url).isNull(), "invalid_data_url")
        .when(content.isNull(), "invalid_base64")
        .when(F.length(content) > I.MAX_ASSET_BYTES, "file_too_large")
        .when(~I.data_url_type(data_url).isin(I.ASSET_TYPES), "unsupported_content_type")
        .when(size["w"].isNull() | size["h"].isNull(), "identify_failed")
    )


def inline_assets(requests: DataFrame, data_url: str = "image_data") -> DataFrame:
    """Decode inline images: content, type, size, fingerprint and the first reason against each."""
    url = F.col(data_url)
    decoded = requests.withColumn("content", I.strict_base64(I.data_url_payload(url)))
    return (
        decoded.withColumn("content_type", I.data_url_type(url))
        .withColumn("size", I.image_size(F.col("content"), jpeg=True))
        .withColumn(
            "refusal",
            F.when(I.data_url_payload(url).isNull(), "invalid_data_url")
            .when(F.col("content").isNull(), "invalid_base64")
            .when(F.length("content") > I.MAX_ASSET_BYTES, "file_too_large")
            .when(~F.col("content_type").isin(I.ASSET_TYPES), "unsupported_content_type")
            .when(F.col("size.w").isNull() | F.col("size.h").isNull(), "identify_failed"),
        )
        .withColumn("sha256", I.fingerprint(F.col("content")))
    )


def fetched_assets(fetches: DataFrame) -> DataFrame:
    """Judge fetched images ``(image_url, http_status, error, content_type_header, content)``."""
    return (
        fetches.withColumn("content_type", I.header_type(F.col("content_type_header")))
        .withColumn("size", I.image_size(F.col("content"), jpeg=True))
        .withColumn(
            "refusal",
            F.coalesce(
                urls.fetch_refusal(F.col("image_url")),
                F.when(F.col("error").isNotNull(), F.col("error"))
                .when(F.col("http_status") != 200, F.concat(F.lit("HTTP "), F.col("http_status")))
                .when(F.length("content") > I.MAX_ASSET_BYTES, "file_too_large")
                .when(~F.col("content_type").isin(I.ASSET_TYPES), "unsupported_content_type")
                .when(F.col("size.w").isNull() | F.col("size.h").isNull(), "identify_failed"),
            ),
        )
        .withColumn("sha256", I.fingerprint(F.col("content")))
    )


def storage_path(name: Column, document_id: Column, kind: Column, region_id: Column | None = None,
                 root: str = UPLOAD_ROOT) -> Column:
    """``<root>/<name or id>/<kind>.png``; an inpainted patch carries its region id."""
    file = kind
    if region_id is not None:
        patched = (kind == "inpainted_patch") & region_id.isNotNull()
        file = F.when(patched, F.concat_ws("_", kind, region_id)).otherwise(kind)
    return F.concat(F.lit(root + "/"), F.coalesce(name, document_id.cast("string")), F.lit("/"), file, F.lit(".png"))


def mask_folder(name: Column, document_id: Column, root: str = UPLOAD_ROOT) -> Column:
    return F.concat(F.lit(root + "/"), F.coalesce(name, document_id.cast("string")), F.lit("/masks"))


def segment_mask_path(folder: Column, index: Column) -> Column:
    return F.format_string("%s/segment_%d.png", folder, index)


def auto_mask_path(folder: Column, micros: Column, index: Column) -> Column:
    return F.format_string("%s/auto_%d_%d.png", folder, micros, index)


def manual_mask_path(folder: Column, millis: Column) -> Column:
    return F.format_string("%s/manual_%d.png", folder, millis)


def taken_numbers(documents: DataFrame, prefix: str = texts.NAME_PREFIX) -> DataFrame:
    """Highest number per day among the existing names ``<prefix>YYYYMMDD-...``."""
    day_part = F.regexp_extract("name", f"^{prefix}([0-9]{{8}})-", 1)
    lead = F.concat(F.lit(prefix), day_part, F.lit("-"))
    return (
        documents.filter(F.col("name").rlike(f"^{prefix}[0-9]{{8}}-"))
        .groupBy(day_part.alias("day_key"))
        .agg(F.max(texts.sequence_number(F.col("name"), lead)).alias("taken"))
    )


def assign_names(new: DataFrame, existing: DataFrame, day: str, order: list[str], coarse: list[Column] | None = None,
                 prefix: str = texts.NAME_PREFIX) -> DataFrame:
    """Name a batch of documents: per day the numbers after the highest one among the names of ``existing``."""
    return assign_names_after(new, taken_numbers(existing, prefix), day, order, coarse, prefix)


def assign_names_after(new: DataFrame, taken: DataFrame, day: str, order: list[str], coarse: list[Column] | None = None,
                       prefix: str = texts.NAME_PREFIX) -> DataFrame:
    """Name a batch of documents: per day the numbers after ``taken(day_key, taken)``."""
    keyed = new.withColumn("day_key", F.date_format(day, "yyyyMMdd"))
    placed = ordering.ordinal(keyed, ["day_key"], [F.col(c) for c in order], coarse, "nth")
    return (
        placed.join(taken, "day_key", "left")
        .withColumn("number", F.coalesce("taken", F.lit(0)) + F.col("nth"))
        .withColumn("name", texts.document_name(F.col(day), F.col("number"), prefix))
        .drop("day_key", "nth", "taken", "number")
    )


def captured_documents(requests: DataFrame) -> DataFrame:
    """Typed documents from requests: state ``loading``, domain derived, errors listed."""
    out = with_dimensions(requests).withColumn("status", F.lit("loading"))
    if "source" not in out.columns:
        out = out.withColumn("source", F.lit("extension"))
    out = out.withColumn("source", F.coalesce("source", F.lit("extension")))
    out = out.withColumn("source_domain", urls.domain(F.col("source_url")))
    return validation.checked(out, validation.document_errors())


def fill_dimensions(documents: DataFrame, assets: DataFrame) -> DataFrame:
    """Asset size only fills what the document does not know yet; ``assets`` has one row per document."""
    a = assets.select("document_id", F.col("width").alias("_w"), F.col("height").alias("_h"))
    return (
        documents.join(a, "document_id", "left")
        .withColumn("width", F.coalesce("width", "_w")).withColumn("height", F.coalesce("height", "_h"))
        .drop("_w", "_h")
    )


def probe_verdicts(heads: DataFrame, gets: DataFrame) -> DataFrame:
    """Can an image be fetched? Judged from logged HEAD probes and, where needed, GET retries.

    Both logs have ``(url, status, content_type, error)``; ``error`` is null for an answer,
    ``AbortError`` for a timeout. The result adds ``accessible`` and ``reason``.
    """
    h, g = heads.alias("h"), gets.alias("g")

    def image(p):
        return F.coalesce(F.col(f"{p}.content_type"), F.lit("")).startswith("image/")

    def ok(p):
        return F.col(f"{p}.status").between(200, 299)

    def typed(p):
        return F.coalesce(F.col(f"{p}.content_type"), F.lit(""))

    retried = (
        F.when(F.col("g.error").isNotNull() | F.col("g.url").isNull(), F.coalesce("g.error", F.lit("Unknown error")))
        .when((ok("g") | (F.col("g.status") == PARTIAL_STATUS)) & image("g"), F.lit(None))
        .otherwise(F.concat(F.lit("HTTP "), F.col("g.status"), F.lit(", type: "), typed("g")))
    )
    reason = (
        F.when(urls.needs_login(F.col("h.url")), "Auth-required domain")
        .when(F.col("h.error") == "AbortError", "Timeout")
        .when(F.col("h.error").isNotNull() | (F.col("h.status") == RETRY_STATUS), retried)
        .when(ok("h") & image("h"), F.lit(None))
        .when(ok("h"), F.concat(F.lit("Not an image: "), typed("h")))
        .otherwise(F.concat(F.lit("HTTP "), F.col("h.status")))
    )
    return h.join(g, F.col("h.url") == F.col("g.url"), "left").select(
        F.col("h.url").alias("url"), reason.alias("reason")
    ).withColumn("accessible", F.col("reason").isNull())


def background_url(css: Column) -> Column:
    """Address inside ``url(...)`` of a CSS background; gradients and ``none`` have none."""
    usable = ~(css.startswith("linear-gradient") | css.startswith("radial-gradient") | (css == "none"))
    return F.when(usable, F.nullif(F.regexp_extract(css, r"""url\(['"]?([^'"]+)['"]?\)""", 1), F.lit("")))


def large_enough(w: Column, h: Column) -> Column:
    return (w >= MIN_CANDIDATE_SIDE) & (h >= MIN_CANDIDATE_SIDE)


def shown() -> Column:
    """Styles that hide an element; combine with the clip test for full visibility."""
    return (
        (F.col("w") != 0) & (F.col("h") != 0) & (F.col("display") != "none")
        & (F.col("visibility") != "hidden") & (F.col("opacity") != "0")
    )


def candidate_set(images: DataFrame, pictures: DataFrame, backgrounds: DataFrame, clips: DataFrame | None = None) -> DataFrame:
    """All candidates with their kind; an image inside a picture is listed twice on purpose.

    With ``clips``, candidates mostly hidden by a clipping ancestor are left out as well.
    """
    cols = ["element_id", "kind", "x", "y", "w", "h", "image_url", "natural_width", "natural_height"]

    def natural(side):
        return F.nullif(F.col(side), F.lit(0)).cast("int").alias(side)

    def seen(df, kind):
        found = df.filter(shown() & large_enough(F.col("w"), F.col("h"))).withColumn("kind", F.lit(kind))
        return found if clips is None else spatial.clip_visibility(found, clips).filter("visible")

    own = seen(images.filter(~F.coalesce("own_clone", F.lit(False))), "img")
    pics = seen(pictures, "picture")
    backs = (
        seen(backgrounds, "background").withColumn("image_url", background_url(F.col("background_image")))
        .filter(F.col("image_url").isNotNull())
        .withColumn("natural_width", F.lit(None).cast("int")).withColumn("natural_height", F.lit(None).cast("int"))
    )

    def shaped(df):
        return df.select(*cols[:7], natural("natural_width"), natural("natural_height"))

    return shaped(own).unionByName(shaped(pics)).unionByName(shaped(backs))


def untransformed(kind: Column, transform: Column) -> Column:
    """Backgrounds always; images when at most moved. Turned, scaled or skewed ones are not."""
    m = r"matrix\(([^,]+),\s*([^,]+),\s*([^,]+),\s*([^,]+),\s*([^,]+),\s*([^)]+)\)"
    parts = [F.regexp_extract(transform, m, i) for i in range(1, 5)]
    moved = (parts[0] == "1") & (parts[1] == "0") & (parts[2] == "0") & (parts[3] == "1")
    return (kind == "background") | transform.isin("none", UPRIGHT) | moved


def capture_plan(candidates: DataFrame, dpr: Column) -> DataFrame:
    """Mode, output size and crop rectangle per candidate.

    Needs ``image_url``, ``kind``, ``transform``, ``same_origin`` and ``accessible``.
    """
    direct = (
        F.coalesce(F.col("image_url") != "", F.lit(False)) & untransformed(F.col("kind"), F.col("transform"))
        & (F.col("same_origin") | F.coalesce("accessible", F.lit(False)))
    )

    def natural(col, rect):
        return F.coalesce(F.nullif(F.col(col), F.lit(0)).cast("long"), round_half_up(F.col(rect)))

    return (
        candidates.withColumn("capture_mode", F.when(direct, "direct_asset").otherwise("screenshot"))
        .withColumn("image_width", F.when(direct, natural("natural_width", "w")).otherwise(round_half_up(F.col("w") * dpr)))
        .withColumn("image_height", F.when(direct, natural("natural_height", "h")).otherwise(round_half_up(F.col("h") * dpr)))
        .withColumn("crop", F.when(~direct, F.struct(*[
            round_half_up(F.col(c) * dpr).alias(c) for c in ("x", "y", "w", "h")])))
    )


def export_manifest(documents: DataFrame, assets: DataFrame, fallback: str = EXPORT_FALLBACK) -> DataFrame:
    """Source file and download name per document: the working image, else the original.

    Two equi-joins on the asset key; a document without either image gets the error ``no_image``.
    """
    def side(name):
        return assets.select(
            F.col("asset_id").alias(f"{name}_asset_id"), urls.local_path(F.col("storage_uri")).alias(f"{name}_path"))

    joined = documents.join(side("working"), "working_asset_id", "left").join(
        side("original"), "original_asset_id", "left")
    path = F.coalesce("working_path", "original_path")
    return joined.select(
        "document_id", path.alias("source_path"),
        F.when(path.isNull(), "no_image").alias("error"),
        F.when(path.isNotNull(), F.concat(F.coalesce("name", F.lit(fallback)), F.lit(".png"))).alias("download_name"),
        (F.col("original_asset_id").isNotNull() | F.col("working_asset_id").isNotNull()).alias("ready"),
    )


def orphan_folders(folders: DataFrame, documents: DataFrame) -> DataFrame:
    """Upload folders named like a UUID for which no document exists."""
    uuid = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    ids = documents.select(F.lower("id").alias("_id"))
    return (
        folders.filter(F.col("folder").rlike(uuid)).withColumn("_id", F.lower("folder"))
        .join(ids, "_id", "left_anti").drop("_id")
    )
