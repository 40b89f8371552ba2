"""Streams over captures, documents, candidates and regions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, IntegerType, StructType

from maskloom.functions import images, urls
from maskloom.operators import intake, pacing, regions, suppression, updates, validation
from maskloom.session import fresh_dir, frugal
from maskloom.streaming.state import ASIDE, FILES, BucketTable

#: Boxes that a batch of survivors shuffles at once.
AT_ONCE = 1 << 25


def run_available(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available now into a Parquet table and read it back."""
    spark = stream.sparkSession
    out, state = fresh_dir(spark, f"{label}-out"), fresh_dir(spark, f"{label}-state")
    (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, label: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run ``handle`` on every micro-batch that is available now."""
    state = fresh_dir(stream.sparkSession, f"{label}-state")
    (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", state)
        .outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    )


def _write_batch(rows: DataFrame, path: str, batch: int) -> None:
    """A batch owns its folder, so a repeated batch replaces itself."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def start_intake(captures: DataFrame, out: str, checkpoint: str, fetches: DataFrame | None = None) -> StreamingQuery:
    """Continuous form of :func:`intake_batch`."""
    return (
        captures.writeStream.foreachBatch(lambda df, n: intake_batch(df, n, out, fetches))
        .option("checkpointLocation", checkpoint).start()
    )


def intake_batch(captures: DataFrame, batch: int, out: str, fetches: DataFrame | None = None) -> None:
    """Accept or reject, acknowledge as ``loading``, then process to ``ready`` or ``error``.

    Writes ``states`` (a change feed), ``documents``, ``assets``, ``regions``, ``rejected`` and ``taken`` below ``out``. Every
    document gets its name for the day; ``taken`` keeps the highest number of each day, which is all a batch reads of
    those before it. An inline image is decoded here. An image address passes the guard and,
    if there is a log ``fetches`` as :func:`intake.fetched_assets` takes it, is judged by its outcome (by the least of
    them if an address is there more than once, success before refusals); an address that the log lacks ends in ``not_fetched``. Without a log
    such a document stays ``loading``, and has no second row in ``states``. A saved image is an asset row; regions
    are saved for documents that become ``ready``.
    """
    docs = _decoded(intake.captured_documents(captures)).persist()
    _write_batch(
        docs.filter("NOT valid").select("request_id", F.to_json(validation.error_report(F.col("errors"))).alias("report")),
        f"{out}/rejected", batch)
    accepted = _named(docs.filter("valid").drop("errors", "valid"), batch, out)
    kept = ["content_type", "size", "sha256"]
    if fetches is None:
        fetched = accepted.withColumn("outcome", F.lit(None).cast("string"))
        there = F.col("decoded")
    else:
        judged = intake.fetched_assets(fetches).select(
            "image_url", F.struct(F.coalesce("refusal", F.lit("")).alias("outcome"), F.struct(*kept).alias("fetch")).alias("o")).groupBy(
            "image_url").agg(F.min("o").alias("o")).select("image_url", "o.outcome", "o.fetch")
        fetched = accepted.join(judged, "image_url", "left").withColumn("outcome", F.coalesce("outcome", F.lit("not_fetched")))
        by_address = F.col("image_url").isNotNull()
        fetched = fetched.withColumns({c: F.when(by_address, F.col("fetch")[c]).otherwise(F.col(c)) for c in kept})
        there = F.col("sha256").isNotNull()
    address = F.coalesce(urls.fetch_refusal(F.col("image_url")), F.nullif("outcome", F.lit("")))
    refusal = F.when(F.col("image_url").isNotNull(), address).when(F.col("inline"), F.col("refusal"))
    saved = there & refusal.isNull()
    done = fetched.select(
        "request_id", "name", "source_url", "capture_mode", "source", "source_domain",
        F.coalesce("width", "size.w").alias("width"), F.coalesce("height", "size.h").alias("height"),
        "sha256", refusal.alias("refusal"), F.when(saved, F.concat_ws("-", "request_id", F.lit("original"))).alias("original_asset_id"),
        "size", "content_type", "text_regions", "segment_regions",
        (F.lit(fetches is None) & F.col("image_url").isNotNull()).alias("waits"),
    ).withColumn("status", F.when(F.col("refusal").isNotNull(), "error").when(F.col("waits"), "loading").otherwise("ready")).drop("waits").persist()
    _write_batch(done.drop("size", "content_type", "text_regions", "segment_regions"), f"{out}/documents", batch)
    _write_batch(_assets(done.filter("original_asset_id IS NOT NULL")), f"{out}/assets", batch)
    _write_batch(_regions(done.filter("status = 'ready'")), f"{out}/regions", batch)
    _write_batch(_given(done, batch, out), f"{out}/taken", batch)
    feed = docs.filter("valid").select("request_id", F.lit(0).alias("step"), F.lit("loading").alias("status"))
    settled = done.filter("status <> 'loading'").select("request_id", F.lit(1).alias("step"), "status")
    _write_batch(feed.unionByName(settled), f"{out}/states", batch)
    done.unpersist()
    docs.unpersist()


def _decoded(docs: DataFrame) -> DataFrame:
    """Inline images of valid documents are judged where they are read: what is kept and shuffled has no payloads.

    ``inline`` tells whether there was one, ``decoded`` whether it could be decoded.
    """
    judged = intake.inline_assets(docs.withColumn("image_data", F.when(F.col("valid"), F.col("image_data"))))
    return judged.withColumns({"inline": F.col("image_data").isNotNull(), "decoded": F.col("content").isNotNull()}).drop("image_data", "content")


def _taken(spark: SparkSession, batch: int, out: str) -> DataFrame:
    """Highest number given so far on each day, as the batch before left it."""
    if not batch:
        return spark.range(0).select(F.lit("").alias("day_key"), F.lit(0).alias("taken"))  # known to be empty before it is joined
    return spark.read.schema("day_key string, taken int").parquet(f"{out}/taken/batch={batch - 1}")


def _given(named: DataFrame, batch: int, out: str) -> DataFrame:
    """Highest number given on each day, with those of this batch."""
    own = intake.taken_numbers(named).select("day_key", F.col("taken").cast("int").alias("taken"))
    return _taken(named.sparkSession, batch, out).unionByName(own).groupBy("day_key").agg(F.max("taken").alias("taken"))


def _named(docs: DataFrame, batch: int, out: str) -> DataFrame:
    """Names by the day of the request, after those of earlier batches; a request without a day stays unnamed.

    Slices are cut along days and ids together: cut along ids alone, every day would lie in every slice, which is a row of its
    own for nearly each request.
    """
    dated = intake.assign_names_after(docs.filter("requested_at IS NOT NULL"), _taken(docs.sparkSession, batch, out), "requested_at", ["request_id"])
    return dated.unionByName(docs.filter("requested_at IS NULL").withColumn("name", F.lit(None).cast("string")))


def _assets(done: DataFrame) -> DataFrame:
    return done.select(
        F.col("original_asset_id").alias("asset_id"), F.col("request_id").alias("document_id"), F.lit("original").alias("kind"),
        intake.storage_path(F.col("name"), F.col("request_id"), F.lit("original")).alias("storage_uri"),
        F.col("size.w").alias("width"), F.col("size.h").alias("height"), "sha256",
        F.create_map(F.lit("content_type"), F.col("content_type")).alias("metadata"))


def _regions(ready: DataFrame) -> DataFrame:
    """Text and segment regions of the payload, layered by their place in it."""
    def listed(column: str, kind: str) -> DataFrame:
        return ready.select(F.col("request_id").alias("document_id"), "name", F.posexplode(column).alias("place", "r")).select(
            "document_id", "name", "place", F.concat_ws("-", "document_id", F.lit(kind), "place").alias("region_id"), "r.*")

    order, coarse = [F.col("place")], [F.floor(F.col("place") / 1024)]
    texts = regions.text_regions(listed("text_regions", "text"), order, coarse)
    segments = listed("segment_regions", "segment").withColumns({
        "mask_ok": images.mask_bytes(F.col("mask_png")).isNotNull(),
        "folder": intake.mask_folder(F.col("name"), F.col("document_id")),
        "attributes": F.create_map(F.lit("area"), F.col("area").cast("string"), F.lit("stabilityScore"), F.col("stabilityScore").cast("string"))})
    return texts.unionByName(regions.segment_regions(segments, order, coarse))


def latest_states(changes: DataFrame, key: str, version: str) -> DataFrame:
    """Newest row per key of a change stream; write it in update mode."""
    return updates.latest(changes, key, version)


def unseen(candidates: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    """Only the first appearance of a key; the watermark bounds what is remembered."""
    return candidates.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def run_carried(events: DataFrame, label: str, step: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Run a stream of events ``(key, at, seq)`` whose batches hand rows on; across batches it must be in time order.

    ``step`` sees what the batch before handed on together with the new events and returns what is emitted and
    what is handed on, at most a row per key. Both are written per batch, so a repeated batch replaces
    itself. Returns everything emitted and what the last batch handed on. No key is gathered in one task.
    """
    spark, out = events.sparkSession, fresh_dir(events.sparkSession, label)
    done: list[int] = []

    def handle(new: DataFrame, batch: int) -> None:
        rows = new.withColumn("carried", F.lit(False))
        if batch:
            rows = rows.unionByName(spark.read.schema(new.schema).parquet(f"{out}/carried/after={batch - 1}").withColumn("carried", F.lit(True)))
        rows = rows.persist()
        emitted, carried = step(rows)
        _write_batch(emitted.select(*new.columns), f"{out}/emitted", batch)
        carried.select(*new.columns).write.mode("overwrite").parquet(f"{out}/carried/after={batch}")
        rows.unpersist()
        done.append(batch)

    run_batches(events, label, handle)
    if not done:
        none = spark.createDataFrame([], events.schema)
        return none, none
    read = spark.read.schema(events.schema)
    return read.parquet(*[f"{out}/emitted/batch={n}" for n in done]), read.parquet(f"{out}/carried/after={done[-1]}")


def _newest(events: DataFrame) -> DataFrame:
    at = F.struct("at", "seq")
    return events.groupBy("key").agg(F.max(at).alias("e")).select("key", "e.at", "e.seq")


def throttled(events: DataFrame, interval_ms: int) -> DataFrame:
    """Events ``(key, at, seq)`` of a stream that pass, over what is available; the last one that passed is handed on.

    That event is the earliest of its key in the next batch and passes there too, so every batch is the
    batch form of the question.
    """
    def step(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        passed = pacing.throttled(rows, interval_ms)
        return passed.filter("NOT carried"), _newest(passed)

    return run_carried(events, "throttle", step)[0]


def debounced(events: DataFrame, pause_ms: int, slice_ms: int | None = None) -> DataFrame:
    """Last event of each burst ``(key, at, seq)`` of a stream, over what is available.

    The newest event of a key is handed on, as its burst may go on; those still open at the end
    are the last events of theirs.
    """
    def step(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        newest = _newest(rows)
        lasts = pacing.debounced(rows, pause_ms, slice_ms)
        return lasts.join(newest, ["key", "at", "seq"], "left_anti"), newest

    emitted, open_ = run_carried(events, "debounce", step)
    return emitted.unionByName(open_)


def _survivors(spark: SparkSession, schema: StructType, out: str) -> BucketTable:
    return BucketTable(spark, f"{out}/survivors", StructType([schema[c] for c in suppression.BOX_COLUMNS]), "document_id", "region_id")


def _parts(sizes: dict[int, int]) -> list[list[int]]:
    """Buckets in parts of about ``AT_ONCE`` rows; a part has one bucket at least."""
    parts: list[list[int]] = [[]]
    held = 0
    for b, n in sorted(sizes.items()):
        if parts[-1] and held + n > AT_ONCE:
            parts.append([])
            held = 0
        parts[-1].append(b)
        held += n
    return parts


def progressive_batch(boxes: DataFrame, batch: int, out: str, iou_threshold: float) -> None:
    """Suppression over what survived so far and the new boxes; emits new survivors only.

    Survivors are a table in buckets of documents below ``out/survivors``; a batch reads and rewrites the buckets of its own
    documents. New survivors are written to ``out/emitted``, a folder a batch. What was emitted is never taken back, so the
    union of emissions can exceed the final survivors.

    A box is shuffled once, along the buckets, and written there with a mark if it is new; what is emitted is read back from there.
    Nothing is kept besides. Buckets are worked off in parts of about ``AT_ONCE`` boxes, so that the shuffle of one part is all that lies on
    disk; ``boxes`` is read once for the sizes of the buckets, and twice for a part, so it must give the same rows each time.
    """
    cols = suppression.BOX_COLUMNS
    spark, table = boxes.sparkSession, _survivors(boxes.sparkSession, boxes.schema, out)
    rows = boxes.select(*cols).withColumn("fresh", F.lit(True))
    with frugal(spark):
        sizes = table.sizes(rows)
        touched = sorted(sizes) if batch else None
        if batch:
            sizes = {b: n + sizes[b] for b, n in ({b: 0 for b in touched} | table.held(batch, touched)).items()}
        parts = _parts(sizes)
        bucket = F.when(F.col("copy"), F.lit(ASIDE)).otherwise(F.floor(F.col("place") / FILES).cast("int"))
        for n, part in enumerate(parts):
            own = rows.filter(table.bucket().isin(part)) if len(parts) > 1 else rows
            if batch:
                own = table.read(batch, part).withColumn("fresh", F.lit(False)).unionByName(own)
            judged = suppression.surviving_in_place(own, iou_threshold, batch > 0, table.place("document_id"), table.place("region_id"))
            table.lay(batch + 1, judged.withColumn("bucket", bucket).select(*cols, "fresh", "bucket").sortWithinPartitions(
                "bucket", "document_id", "region_id"), first=n == 0)
        table.settle(batch + 1, touched)
        emitted = spark.read.schema(StructType([*table.schema.fields]).add("fresh", BooleanType())).parquet(table.written(batch + 1))
        if batch:  # those with an id, as far as a survivor has it
            emitted = emitted.filter("fresh AND document_id IS NOT NULL AND region_id IS NOT NULL")
        _write_batch(emitted.select(*cols), f"{out}/emitted", batch)


def start_progressive(boxes: DataFrame, out: str, checkpoint: str, iou_threshold: float) -> StreamingQuery:
    """Emit survivors of a stream of boxes over what is available; started again with its checkpoint it goes on where it ended."""
    return (
        boxes.writeStream.foreachBatch(lambda df, n: progressive_batch(df, n, out, iou_threshold))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def progressive_survivors(boxes: DataFrame, iou_threshold: float, label: str = "progressive") -> DataFrame:
    """All boxes a stream emits over what is available now, with the batch that emitted them."""
    spark = boxes.sparkSession
    out = fresh_dir(spark, label)
    start_progressive(boxes, out, fresh_dir(spark, f"{label}-state"), iou_threshold).awaitTermination()
    schema = StructType([boxes.schema[c] for c in suppression.BOX_COLUMNS]).add("batch", IntegerType())
    return spark.read.schema(schema).parquet(f"{out}/emitted")


def update_batch(documents_path: str, out: str) -> Callable[[DataFrame, int], None]:
    """Handler that folds a batch of changes onto the newest document table and lists refused ones.

    The table is kept in buckets of documents below ``out/documents``, version 0 being ``documents_path``. Version ``n + 1``
    rewrites the buckets of the documents that batch n changes; all others stay the files they are.
    """
    def handle(changes: DataFrame, batch: int) -> None:
        spark = changes.sparkSession
        if batch == 0:
            first = spark.read.parquet(documents_path)
            BucketTable(spark, f"{out}/documents", first.schema, "document_id", "document_id").write(0, first)
        table = BucketTable.opened(spark, f"{out}/documents", "document_id", "document_id")
        changes = changes.persist()
        judged = updates.judged_updates(changes)
        _write_batch(judged.filter("NOT valid").select("document_id", "seq", F.to_json(validation.error_report(F.col("errors"))).alias("report")),
                     f"{out}/refused", batch)
        touched = table.touched(judged.filter("valid"))
        table.write(batch + 1, updates.folded(table.read(batch, touched), changes), touched)
        changes.unpersist()

    return handle


def newest_documents(spark: SparkSession, out: str) -> DataFrame:
    """The table after the last batch that :func:`update_batch` handled."""
    table = BucketTable.opened(spark, f"{out}/documents", "document_id", "document_id")
    return table.read(max(table.versions()))
