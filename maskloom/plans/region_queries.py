"""Region tables, history, maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskloom.functions import boxes as B, images as I
from maskloom.operators import history, intake, maintenance, regions as R
from maskloom.plans.registry import query, rounded, rounded_sql
from maskloom.session import fresh_dir
from maskloom.sources.adapters import table, view, view_sql

def _order():
    return [F.col("found_at"), F.col("region_id")], None


def _incoming(spark, sf, kind):
    r = view(spark, sf, "regions").filter(F.col("type") == kind)
    b = F.when(F.col("score") < 0.92, F.lit(None)).otherwise(F.struct(
        F.when(F.col("x") >= 5, F.col("x")).alias("x"), "y", "w", "h"))
    attributes = F.when(F.col("w") % 2 == 0, F.create_map(
        F.lit("stabilityScore"), F.col("stability").cast("string"), F.lit("area"), (F.col("w") * F.col("h")).cast("int").cast("string"),
    )).otherwise(F.create_map(F.lit("stability_score"), F.col("stability").cast("string")))
    name = F.when(F.col("document_id") % 2 == 0, F.concat(F.lit("shot-"), F.col("document_id")))
    return r.withColumns({
        "bbox": b, "attributes": attributes, "folder": intake.mask_folder(name, F.col("document_id")),
        "confidence": F.when(F.col("score") > 0.95, F.col("score")), "original_text": F.concat(F.lit("t"), F.col("region_id")),
        "polygon": F.when(F.col("score") > 0.93, B.corners(B.box("x", "y", "w", "h"))),
    })


_BBOX = """CASE WHEN score < 0.92 OR x < 5 THEN 0 ELSE x END AS bx, CASE WHEN score < 0.92 THEN 0 ELSE w END AS bw"""
_FOLDER = "concat('priv/static/uploads/', CASE WHEN document_id % 2 = 0 THEN 'shot-' ELSE '' END, document_id, '/masks')"


@query("text_region_rows", f"""{view_sql('regions')}
SELECT region_id, row_number() OVER (PARTITION BY document_id ORDER BY found_at, region_id) AS z_index, {_BBOX},
  {rounded_sql('CASE WHEN score > 0.95 THEN score ELSE 1 END')} AS confidence,
  CASE WHEN score > 0.93 THEN 4 ELSE 0 END AS corners, concat('t', region_id) AS original_text
FROM regions WHERE type = 'text'""")
def text_region_rows(spark, sf):
    out = R.text_regions(_incoming(spark, sf, "text"), *_order())
    return out.select("region_id", "z_index", F.col("bbox.x").alias("bx"), F.col("bbox.w").alias("bw"),
                      rounded(F.col("confidence")).alias("confidence"), F.size("polygon").alias("corners"),
                      F.col("metadata")["original_text"].alias("original_text"))


_NUMBERED = """n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY found_at, region_id) AS i
  FROM regions WHERE type = '{kind}')"""


@query("segment_region_rows", f"""{view_sql('regions')}, {_NUMBERED.format(kind='object')}
SELECT region_id, 1000 + i AS z_index, {_BBOX}, concat({_FOLDER}, '/segment_', i, '.png') AS mask_path,
  CASE WHEN w % 2 = 0 THEN cast(floor(w * h) AS bigint) ELSE 0 END AS area, {rounded_sql('stability')} AS stability
FROM n WHERE mask_ok""")
def segment_region_rows(spark, sf):
    out = R.segment_regions(_incoming(spark, sf, "object"), *_order())
    return out.select("region_id", "z_index", F.col("bbox.x").alias("bx"), F.col("bbox.w").alias("bw"), "mask_path",
                      F.col("metadata")["area"].cast("long").alias("area"),
                      rounded(F.col("metadata")["stability_score"].cast("double")).alias("stability"))


_EXISTING = """x AS (SELECT document_id, count(*) AS e FROM regions WHERE type = 'text' OR (type = 'object' AND mask_ok)
  GROUP BY document_id)"""


def _existing(spark, sf):
    return view(spark, sf, "regions").filter("type = 'text' OR (type = 'object' AND mask_ok)")


@query("auto_region_rows", f"""{view_sql('regions')}, {_NUMBERED.format(kind='manual')}, {_EXISTING}
SELECT region_id, 1500 + coalesce(e, 0) + i AS z_index,
  concat({_FOLDER}, '/auto_1700000000000000_', coalesce(e, 0) + i, '.png') AS mask_path
FROM n LEFT JOIN x ON x.document_id = n.document_id WHERE mask_ok""".replace("priv/static/uploads/', CASE WHEN document_id", "priv/static/uploads/', CASE WHEN n.document_id").replace("'' END, document_id", "'' END, n.document_id"))
def auto_region_rows(spark, sf):
    out = R.auto_regions(_incoming(spark, sf, "manual"), _existing(spark, sf), *_order(), F.lit(1700000000000000))
    return out.select("region_id", "z_index", "mask_path")


@query("manual_region_rows", f"""{view_sql('regions')}, {_NUMBERED.format(kind="manual' AND mask_ok AND 'a' = 'a")}, {_EXISTING}
SELECT region_id, 2000 + coalesce(e, 0) + i - 1 AS z_index, 1.0::DOUBLE AS confidence
FROM n LEFT JOIN x ON x.document_id = n.document_id""")
def manual_region_rows(spark, sf):
    out = R.manual_regions(_incoming(spark, sf, "manual"), _existing(spark, sf), *_order(), F.lit(1700000000000))
    return out.select("region_id", "z_index", "confidence")


@query("mask_views", f"""{view_sql('regions')}, {_NUMBERED.format(kind='object')}
SELECT region_id, 'object' AS type, cast(1000 + i AS int) AS z_index,
  concat('/uploads/', CASE WHEN document_id % 2 = 0 THEN 'shot-' ELSE '' END, document_id, '/masks/segment_', i, '.png') AS mask_url
FROM n WHERE mask_ok""")
def mask_views(spark, sf):
    out = R.mask_views(R.segment_regions(_incoming(spark, sf, "object"), *_order()))
    return out.select("region_id", "type", "z_index", "mask_url")


@query("document_view", f"""{view_sql('captured', 'assets', 'working_assets', 'regions')}
SELECT c.document_id, o.storage_uri AS original_uri, w.storage_uri AS working_uri, r.region_id
FROM captured c LEFT JOIN assets o ON o.asset_id = c.original_asset_id
LEFT JOIN working_assets w ON w.asset_id = c.working_asset_id LEFT JOIN regions r ON r.document_id = c.document_id""")
def document_view(spark, sf):
    assets = view(spark, sf, "assets").unionByName(view(spark, sf, "working_assets"))
    regions = view(spark, sf, "regions").select("document_id", "region_id")
    return R.document_view(view(spark, sf, "captured"), assets, regions).select(
        "document_id", "original_uri", "working_uri", "region_id")


@query("region_counts", f"""{view_sql('captured', 'regions')}
SELECT c.document_id, cast(count(r.region_id) AS bigint) AS regions
FROM captured c LEFT JOIN regions r ON r.document_id = c.document_id GROUP BY c.document_id""")
def region_counts(spark, sf):
    return R.region_counts(view(spark, sf, "captured"), view(spark, sf, "regions"))


# Requests name a region and a document; a third of them name the wrong document.
_DELETES = """d AS (SELECT CASE WHEN w % 3 = 0 THEN document_id + 1 ELSE document_id END AS document_id, region_id
  FROM regions WHERE stability < 0.96)"""


def _delete_requests(spark, sf):
    return view(spark, sf, "regions").filter("stability < 0.96").selectExpr(
        "CASE WHEN w % 3 = 0 THEN document_id + 1 ELSE document_id END AS document_id", "region_id")


@query("regions_after_delete", f"""{view_sql('regions')}, {_DELETES}
SELECT document_id, region_id FROM regions r WHERE NOT EXISTS
  (SELECT 1 FROM d WHERE d.document_id = r.document_id AND d.region_id = r.region_id)""")
def regions_after_delete(spark, sf):
    left, _ = R.delete_regions(view(spark, sf, "regions"), _delete_requests(spark, sf))
    return left.select("document_id", "region_id")


@query("deleted_counts", f"""{view_sql('regions')}, {_DELETES}
SELECT d.document_id, cast(count(r.region_id) AS bigint) AS deleted FROM d LEFT JOIN regions r
  ON d.document_id = r.document_id AND d.region_id = r.region_id GROUP BY d.document_id""")
def deleted_counts(spark, sf):
    return R.delete_regions(view(spark, sf, "regions"), _delete_requests(spark, sf))[1]


@query("new_regions", f"""{view_sql('regions')} SELECT region_id FROM regions WHERE found_at >= TIMESTAMP '1998-01-01'
EXCEPT SELECT region_id FROM regions WHERE found_at < TIMESTAMP '1999-01-01'""")
def new_regions(spark, sf):
    r = view(spark, sf, "regions")
    now, before = r.filter("found_at >= TIMESTAMP '1998-01-01'"), r.filter("found_at < TIMESTAMP '1999-01-01'")
    return R.not_in(now, before, ["region_id"]).select("region_id")


@query("untracked_candidates", f"""{view_sql('elements')} SELECT element_id FROM elements e
WHERE NOT EXISTS (SELECT 1 FROM elements t WHERE t.element_id = e.element_id AND t.w < 100)""")
def untracked_candidates(spark, sf):
    e = view(spark, sf, "elements")
    return R.not_in(e, e.filter("w < 100"), ["element_id"]).select("element_id")


@query("stale_cache_entries", f"""{view_sql('regions', 'rasters')}
SELECT vec_id AS mask_id FROM embeddings EXCEPT SELECT cast(split_part(region_id, '-', 4) AS bigint) FROM regions""")
def stale_cache_entries(spark, sf):
    shown = view(spark, sf, "regions").select(F.split_part("region_id", F.lit("-"), F.lit(4)).cast("long").alias("mask_id"))
    return R.not_in(view(spark, sf, "rasters").select("mask_id"), shown, ["mask_id"])


@query("regions_after_document_delete", f"""{view_sql('captured', 'regions')}
SELECT region_id FROM regions WHERE document_id IN (SELECT document_id FROM captured WHERE owner % 4 <> 0)""")
def regions_after_document_delete(spark, sf):
    docs = view(spark, sf, "captured").filter("owner % 4 <> 0")
    return R.cascade_document_delete(docs, view(spark, sf, "regions")).select("region_id")


@query("documents_after_asset_delete", f"""{view_sql('captured', 'assets', 'working_assets')},
l AS (SELECT asset_id FROM assets WHERE width % 2 = 0 UNION ALL SELECT asset_id FROM working_assets WHERE height % 2 = 0)
SELECT document_id, CASE WHEN original_asset_id IN (SELECT asset_id FROM l) THEN original_asset_id END AS original_asset_id,
  CASE WHEN working_asset_id IN (SELECT asset_id FROM l) THEN working_asset_id END AS working_asset_id FROM captured""")
def documents_after_asset_delete(spark, sf):
    left = view(spark, sf, "assets").filter("width % 2 = 0").unionByName(
        view(spark, sf, "working_assets").filter("height % 2 = 0"))
    return R.cascade_asset_delete(view(spark, sf, "captured"), left).select(
        "document_id", "original_asset_id", "working_asset_id")


@query("awaiting_text_detection", f"""{view_sql('regions')}
SELECT DISTINCT document_id FROM regions WHERE document_id NOT IN (SELECT document_id FROM regions WHERE type = 'text')""")
def awaiting_text_detection(spark, sf):
    r = view(spark, sf, "regions")
    return R.awaiting_text_detection(r.select("document_id").distinct(), r)


_REPLAY = f"""{view_sql('actions')},
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at", seq) AS rn FROM actions),
walk AS (SELECT key, rn, CASE WHEN action = 'add' THEN [image_path] ELSE []::VARCHAR[] END AS hist,
    CASE WHEN action = 'add' THEN 1 ELSE 0 END AS idx, CASE WHEN action = 'add' THEN 'added' ELSE 'cannot_undo' END AS outcome,
    seq, NULL::VARCHAR AS restored FROM o WHERE rn = 1
  UNION ALL SELECT o.key, o.rn, CASE WHEN action = 'add' THEN list_append(hist[1:idx], image_path) ELSE hist END,
    CASE WHEN action = 'add' THEN idx + 1 WHEN idx > 0 THEN idx - 1 ELSE 0 END,
    CASE WHEN action = 'add' THEN 'added' WHEN idx > 0 THEN 'undone' ELSE 'cannot_undo' END, o.seq,
    CASE WHEN action = 'undo' AND idx > 0 THEN hist[idx] END
  FROM walk w JOIN o ON o.key = w.key AND o.rn = w.rn + 1)"""


@query("history_replay", f"""{_REPLAY} SELECT key, seq, cast(idx AS bigint) AS level, outcome, restored AS restored_path FROM walk""")
def history_replay(spark, sf):
    out = history.replay(view(spark, sf, "actions"), F.to_date("at"))
    return out.select("key", "seq", "level", "outcome", "restored_path")


@query("history_final_state", f"""{_REPLAY} SELECT key, cast(idx AS bigint) AS history_index, cast(len(hist) AS bigint) AS history_length,
  CASE WHEN idx BETWEEN 1 AND len(hist) THEN hist[idx] END AS current_path, idx > 0 AS can_undo, idx < len(hist) AS can_redo
FROM walk QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1""")
def history_final_state(spark, sf):
    return history.final_state(history.levelled(view(spark, sf, "actions"), F.to_date("at")))


@query("embedded_history", """WITH h AS (SELECT o_orderkey AS document_id, cast(o_custkey % 5 AS int) AS n,
  cast(o_orderkey % 6 AS int) AS idx FROM orders)
SELECT document_id, CASE WHEN idx > 0 AND idx <= n THEN concat('s/', idx, '.png') END AS current_path,
  idx > 0 AS can_undo, idx < n AS can_redo, cast(least(idx, n) + 1 AS int) AS length_after_add,
  CASE WHEN idx > 0 AND idx <= n THEN concat('s/', idx, '.png') END AS restored_path,
  cast(greatest(idx - 1, 0) AS int) AS new_index, CASE WHEN idx > 0 THEN 'ready' ELSE 'loading' END AS new_status,
  CASE WHEN idx = 0 THEN 'cannot_undo' END AS refusal, n > 0 AND n % 3 = 0 OR n = 0 AS history_valid FROM h""")
def embedded_history(spark, sf):
    docs = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS document_id", "'loading' AS status", "cast(o_orderkey % 6 AS int) AS history_index",
        "cast(o_custkey % 5 AS int) AS n", "o_orderdate AS at")
    n = F.col("n")
    entries = F.transform(F.slice(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1), n), lambda i: F.struct(
        F.format_string("s/%d.png", i).alias("image_path"), F.col("at").alias("timestamp"),
        F.when(n % 3 == 0, "restore").otherwise("paint").alias("action")))
    docs = docs.withColumn("history", entries)
    h, i = F.col("history"), F.col("history_index")
    extra = F.struct(F.lit("s/new.png").alias("image_path"), F.col("at").alias("timestamp"), F.lit("restore").alias("action"))
    from maskloom.operators.validation import history_valid

    return history.undone(docs).select(
        "document_id", history.current_path(h, i).alias("current_path"), history.can_undo(i).alias("can_undo"),
        history.can_redo(h, i).alias("can_redo"), F.size(history.add_entry(h, i, extra)).alias("length_after_add"),
        "restored_path", "new_index", "new_status", "refusal", history_valid(h).alias("history_valid"))


@query("status_backfill", f"""{view_sql('captured')} SELECT document_id,
  CASE WHEN status IN ('awaiting_edits', 'export_ready', 'rendering') THEN 'ready'
    WHEN status IN ('processing', 'queued_detection') THEN 'loading' ELSE status END AS status FROM captured""")
def status_backfill(spark, sf):
    return maintenance.backfill_status(view(spark, sf, "captured")).select("document_id", "status")


@query("job_type_backfill", """SELECT event_id, CASE event_type WHEN 'click' THEN 'detection' WHEN 'view' THEN 'detection'
  ELSE event_type END AS type FROM events""")
def job_type_backfill(spark, sf):
    jobs = table(spark, sf, "events").selectExpr(
        "event_id", "CASE event_type WHEN 'click' THEN 'text_detection' WHEN 'view' THEN 'font_guess' ELSE event_type END AS type",
        "user_id AS text_region_id", "'document' AS subject_type")
    return maintenance.backfill_job_types(jobs)


@query("schema_migration", f"""{view_sql('captured')} SELECT document_id, 'extension' AS source, 0 AS history_index,
  0 AS history_entries, cast(NULL AS int) AS width, cast(NULL AS int) AS height, 'old' AS version FROM captured
UNION ALL SELECT document_id, 'upload', 3, 0, width, height, 'new' FROM captured WHERE owner % 2 = 0""")
def schema_migration(spark, sf):
    c = view(spark, sf, "captured")
    old = c.select("document_id", F.create_map(F.lit("w"), "width").alias("dimensions"), F.lit("{}").alias("metrics"),
                   F.lit("not_checked").alias("source_url_status"), F.lit("old").alias("version"))
    old = maintenance.drop_retired(maintenance.split_dimensions(old), maintenance.RETIRED_DOCUMENT_COLUMNS)
    new = c.filter("owner % 2 = 0").select("document_id", "width", "height", F.lit("upload").alias("source"),
                                            F.lit(3).alias("history_index"), F.lit("new").alias("version"))
    both = maintenance.merge_versions(maintenance.add_document_columns(old), maintenance.add_document_columns(new))
    return both.select("document_id", "source", "history_index", F.size("history").alias("history_entries"),
                       "width", "height", "version")


@query("name_conflicts", f"""{view_sql('captured')}, n AS (SELECT CASE WHEN name IS NULL THEN NULL ELSE concat('shot-', owner) END AS name FROM captured)
SELECT name, cast(count(*) AS bigint) AS uses FROM n WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1""")
def name_conflicts(spark, sf):
    named = view(spark, sf, "captured").withColumn(
        "name", F.when(F.col("name").isNotNull(), F.concat(F.lit("shot-"), F.col("owner"))))
    return maintenance.name_conflicts(named)


def _text_assets(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("asset_id"), I.fingerprint(F.encode("text", "UTF-8")).alias("sha256"))


@query("same_bytes", """SELECT sha256(text) AS sha256, cast(count(*) AS bigint) AS copies, min(doc_id) AS first_asset_id
FROM documents GROUP BY 1 HAVING count(*) > 1""")
def same_bytes(spark, sf):
    return maintenance.same_bytes(_text_assets(spark, sf))


@query("copies_of_assets", """WITH f AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS first_asset_id FROM documents)
SELECT doc_id AS asset_id, first_asset_id FROM f WHERE doc_id <> first_asset_id""")
def copies_of_assets(spark, sf):
    return maintenance.copies_of_assets(_text_assets(spark, sf))


@query("metric_summary", f"""SELECT event_type, cast(count(value) AS bigint) AS n, {rounded_sql('sum(value)', 3)} AS total, min(value) AS lowest,
  max(value) AS highest, {rounded_sql('avg(value)', 4)} AS mean, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95,
  quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type""")
def metric_summary(spark, sf):
    out = maintenance.metric_summary(table(spark, sf, "events"), ["event_type"])
    return out.withColumns({"total": rounded(F.col("total"), 3), "mean": rounded(F.col("mean"), 4)})


@query("documents_of_domain", f"""{view_sql('requests')} SELECT concat('site', o % 50, '.example.com') AS source_domain, cast(count(*) AS bigint) AS documents
FROM (SELECT request_id AS r, o_custkey AS o FROM requests JOIN orders ON o_orderkey = request_id WHERE source_url LIKE 'https:%')
GROUP BY 1""")
def documents_of_domain(spark, sf):
    docs = intake.captured_documents(view(spark, sf, "requests").drop("state"))
    return docs.filter(F.col("source_domain").isNotNull()).groupBy("source_domain").agg(F.count("*").alias("documents"))


@query("sketched_metrics", f"""SELECT event_type, count(value) AS n, {rounded_sql('sum(value)', 3)} AS total, min(value) AS lowest, max(value) AS highest,
  true AS p50_near, true AS p95_near, true AS p99_near
FROM events WHERE date_trunc('hour', ts) >= date_trunc('hour', (SELECT min(ts) FROM events) + INTERVAL 3 DAY) GROUP BY event_type""")
def sketched_metrics(spark, sf):
    """A summary of some days from stored hourly sketches; each quantile's rank is held against the exact one."""
    e = table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp").alias("at"), "value")
    path = fresh_dir(spark, "sketches")
    maintenance.metric_sketches(e, ["event_type"]).write.parquet(path)
    stored = spark.read.parquet(path)
    first = F.date_trunc("hour", F.min("at") + F.expr("INTERVAL 3 DAYS"))
    since = e.agg(first.alias("since"))
    asked = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    summary = maintenance.summary_of_sketches(stored.join(F.broadcast(since), F.col("hour") >= F.col("since")), ["event_type"], asked)
    exact = e.join(F.broadcast(since), F.date_trunc("hour", "at") >= F.col("since")).join(summary.select("event_type", *asked), "event_type")
    below = exact.groupBy("event_type").agg(F.count("value").alias("all"), *[
        c for p in asked for c in (F.count_if(F.col("value") < F.col(p)).alias(f"{p}_low"), F.count_if(F.col("value") <= F.col(p)).alias(f"{p}_high"))])
    near = [((F.col(f"{p}_low") / F.col("all") <= v + maintenance.RANK_ERROR) & (F.col(f"{p}_high") / F.col("all") >= v - maintenance.RANK_ERROR)).alias(f"{p}_near")
            for p, v in asked.items()]
    return summary.join(below, "event_type").select("event_type", "n", rounded(F.col("total"), 3).alias("total"), "lowest", "highest", *near)
