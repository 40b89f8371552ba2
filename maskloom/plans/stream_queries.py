"""Streams over the given tables, each run over what is available, and their batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskloom.operators import pacing, suppression, updates
from maskloom.plans.registry import query
from maskloom.plans.spatial_queries import suppression_sql
from maskloom.session import fresh_dir
from maskloom.sources import captures as C
from maskloom.sources.adapters import VIEWS, table, view, view_sql
from maskloom.streaming import jobs

_SIX_HOURS = 6 * 3600 * 1000


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a file stream. As a pattern the path serves a single file and a folder of part files alike."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _stream_view(spark, sf, name):
    source, columns = VIEWS[name]
    return _stream(spark, sf, source).selectExpr(*[f"{e if isinstance(e, str) else e[0]} AS `{c}`" for c, e in columns])


_EVENTS = "WITH RECURSIVE e AS (SELECT user_id AS key, ts, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"
_PASSED = f"""{_EVENTS}, walk AS (SELECT key, rn, seq, ts AS last, TRUE AS pass FROM e WHERE rn = 1
  UNION ALL SELECT e.key, e.rn, e.seq, CASE WHEN e.ts - w.last >= INTERVAL 6 HOUR THEN e.ts ELSE w.last END,
    e.ts - w.last >= INTERVAL 6 HOUR FROM walk w JOIN e ON e.key = w.key AND e.rn = w.rn + 1)
SELECT key, seq FROM walk WHERE pass"""
_LASTS = f"""{_EVENTS} SELECT a.key, a.seq FROM e a LEFT JOIN e b ON b.key = a.key AND b.rn = a.rn + 1
WHERE b.ts IS NULL OR b.ts - a.ts >= INTERVAL 6 HOUR"""


def _events(df):
    return df.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))


@query("throttled_events", _PASSED)
def throttled_events(spark, sf):
    return pacing.throttled(_events(table(spark, sf, "events")), _SIX_HOURS).select("key", "seq")


@query("throttled_events_stream", _PASSED)
def throttled_events_stream(spark, sf):
    return jobs.throttled(_events(_stream(spark, sf, "events")), _SIX_HOURS).select("key", "seq")


@query("debounced_events", _LASTS)
def debounced_events(spark, sf):
    return pacing.debounced(_events(table(spark, sf, "events")), _SIX_HOURS, 5 * 24 * 3600 * 1000).select("key", "seq")


@query("debounced_events_stream", _LASTS)
def debounced_events_stream(spark, sf):
    return jobs.debounced(_events(_stream(spark, sf, "events")), _SIX_HOURS, 5 * 24 * 3600 * 1000).select("key", "seq")


@query("unseen_candidates_stream", "SELECT DISTINCT user_id * 10 + event_id % 7 AS element FROM events")
def unseen_candidates_stream(spark, sf):
    seen = _stream(spark, sf, "events").select(
        (F.col("user_id") * 10 + F.col("event_id") % 7).alias("element"), F.col("ts").cast("timestamp").alias("at"))
    return jobs.run_available(jobs.unseen(seen, "element", "at", "3650 days"), "unseen").select("element")


@query("latest_document_states", f"""{view_sql('captured')} SELECT owner, max_by(document_id, captured_at::VARCHAR || lpad(document_id::VARCHAR, 12, '0')) AS document_id
FROM captured GROUP BY owner""")
def latest_document_states(spark, sf):
    changes = _stream_view(spark, sf, "captured").select("owner", "document_id", "status", F.struct("captured_at", "document_id").alias("version"))
    out = fresh_dir(spark, "latest")
    jobs.run_batches(jobs.latest_states(changes, "owner", "version"), "latest",
                     lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), "update")
    # Every batch wrote the keys it changed; the newest version of a key is the current one.
    return updates.latest(spark.read.parquet(out), "owner", "version").select("owner", "document_id")


@query("emitted_survivors_stream", f"{view_sql('regions')}, {suppression_sql('regions', 0.5)} SELECT document_id, region_id FROM survivors")
def emitted_survivors_stream(spark, sf):
    """Whole table as one batch, so the emitted set equals the final one."""
    boxes = _stream_view(spark, sf, "regions").select(*suppression.BOX_COLUMNS)
    return jobs.progressive_survivors(boxes, 0.5).select("document_id", "region_id")


_BATCHES = f"""{view_sql('regions')}, one AS (SELECT * FROM regions WHERE cast(x AS int) % 2 = 0), {suppression_sql('one', 0.5)},
two AS (SELECT document_id, region_id, x, y, w, h, score FROM survivors
  UNION ALL SELECT document_id, region_id, x, y, w, h, score FROM regions WHERE cast(x AS int) % 2 = 1),
{suppression_sql('two', 0.5).replace('survivors', 'later').replace('walk', 'walk_on').replace('ranked', 'ranked_on')}"""


@query("emitted_in_batches_stream", f"""{_BATCHES} SELECT document_id, region_id, 0 AS batch FROM survivors
UNION ALL SELECT document_id, region_id, 1 FROM later WHERE cast(x AS int) % 2 = 1""")
def emitted_in_batches_stream(spark, sf):
    """Two batches: the second meets what survived of the first, emits its own survivors, and takes nothing back."""
    out = fresh_dir(spark, "emitted-in-batches")
    boxes = view(spark, sf, "regions").select(*suppression.BOX_COLUMNS)
    for batch in (0, 1):
        jobs.progressive_batch(boxes.filter(F.col("x").cast("int") % 2 == batch), batch, out, 0.5)
    return spark.read.parquet(f"{out}/emitted").select("document_id", "region_id", F.col("batch").cast("int").alias("batch"))


def _write_captures(spark, sf):
    r = view(spark, sf, "requests").drop("state")
    docs = view(spark, sf, "inline").select(F.col("doc_id").alias("request_id"), "payload")
    data = F.when(F.col("request_id") % 3 == 0, F.concat(F.lit("data:text/plain;base64,"), "payload")).otherwise(
        F.concat(F.lit("data:image/png;base64,"), "payload"))
    url = F.when(F.col("payload").isNull() & (F.col("request_id") % 2 == 0), F.concat(
        F.when(F.col("request_id") % 4 == 0, "http://10.0.0.1/").otherwise("https://img.example.com/"), F.col("request_id")))
    path = fresh_dir(spark, "captures")
    box = "'bbox', named_struct('x', i * 10D, 'y', 5D, 'w', 20D, 'h', 8D)"
    texts = F.expr(f"""CASE WHEN request_id % 4 = 1 THEN transform(sequence(0L, request_id % 3), i -> named_struct({box},
      'confidence', CASE WHEN i % 2 = 0 THEN 0.75D END, 'original_text', concat('t', request_id, '-', i))) END""")
    segments = F.expr(f"""CASE WHEN request_id % 5 = 2 THEN transform(sequence(0L, 2L), i -> named_struct({box},
      'mask_png', CASE WHEN (request_id + i) % 3 = 0 THEN '???' ELSE 'AAAA' END, 'score', 0.5D, 'area', i * 3D)) END""")
    (r.join(docs, "request_id", "left").withColumn("image_data", data).withColumn("image_url", url)
     .withColumn("text_regions", texts).withColumn("segment_regions", segments).drop("payload").write.json(path))
    return path


_INTAKE = f"""{view_sql('requests')}, v AS (SELECT *, request_id IN (SELECT doc_id FROM documents) AS inline FROM requests
  WHERE capture_mode IN ('direct_asset', 'screenshot') AND coalesce(source, 'extension') IN ('extension', 'upload')
  AND (source = 'upload' OR trim(source_url) <> '')),
s AS (SELECT request_id, CASE WHEN inline AND request_id % 3 = 0 THEN 'error' WHEN NOT inline AND request_id % 4 = 0 THEN 'error'
  WHEN NOT inline AND request_id % 4 = 2 THEN 'loading' ELSE 'ready' END AS status FROM v)"""


_NAMES = """n AS (SELECT s.request_id, s.status, printf('shot-%s-%03d', strftime(requested_at, '%Y%m%d'),
  row_number() OVER (PARTITION BY requested_at ORDER BY s.request_id)) AS name FROM s JOIN requests r ON r.request_id = s.request_id)"""


def _taken_in(spark, sf):
    out = fresh_dir(spark, "intake")
    stream = C.stream_captures(spark, _write_captures(spark, sf))
    jobs.run_batches(stream, "intake", lambda df, n: jobs.intake_batch(df, n, out))
    return out


@query("intake_stream", f"""{_INTAKE} SELECT request_id, 0 AS step, 'loading' AS status FROM s UNION ALL SELECT request_id, 1, status FROM s WHERE status <> 'loading'""")
def intake_stream(spark, sf):
    return spark.read.parquet(f"{_taken_in(spark, sf)}/states").select("request_id", "step", "status")


@query("intake_assets", f"""{_INTAKE}, {_NAMES}
SELECT request_id AS document_id, request_id || '-original' AS asset_id, 'priv/static/uploads/' || name || '/original.png' AS storage_uri,
  d.n_chars % 2000 + 1 AS width, request_id % 1000 + 1 AS height FROM n JOIN documents d ON d.doc_id = n.request_id WHERE status = 'ready'""")
def intake_assets(spark, sf):
    return spark.read.parquet(f"{_taken_in(spark, sf)}/assets").select(
        "document_id", "asset_id", "storage_uri", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


@query("intake_regions", f"""{_INTAKE}, {_NAMES}
SELECT request_id AS document_id, request_id || '-text-' || i AS region_id, 'text' AS type, i + 1 AS z_index, NULL AS mask_path,
  CASE WHEN i % 2 = 0 THEN 0.75 ELSE 1.0 END::DOUBLE AS confidence, 't' || request_id || '-' || i AS original_text
FROM n, range(3) AS t(i) WHERE status = 'ready' AND request_id % 4 = 1 AND i <= request_id % 3
UNION ALL SELECT request_id, request_id || '-segment-' || i, 'object', 1001 + i,
  'priv/static/uploads/' || name || '/masks/segment_' || (i + 1) || '.png', 0.5::DOUBLE, NULL
FROM n, range(3) AS t(i) WHERE status = 'ready' AND request_id % 5 = 2 AND (request_id + i) % 3 <> 0""")
def intake_regions(spark, sf):
    return spark.read.parquet(f"{_taken_in(spark, sf)}/regions").select(
        "document_id", "region_id", "type", F.col("z_index").cast("long").alias("z_index"), "mask_path", "confidence",
        F.try_element_at("metadata", F.lit("original_text")).alias("original_text"))


@query("captures_from_json", f"""{view_sql('requests')} SELECT request_id, source_url, capture_mode, source, image_width, image_height FROM requests""")
def captures_from_json(spark, sf):
    return C.read_captures(spark, _write_captures(spark, sf)).select(
        "request_id", "source_url", "capture_mode", "source", "image_width", "image_height")


_CHANGES = """c AS (SELECT o_custkey AS document_id, o_orderkey AS seq,
  CASE o_orderkey % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'error' WHEN 2 THEN 'lost' ELSE NULL END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderkey % 2000 AS int) END AS width FROM orders),
g AS (SELECT document_id, max_by(status, seq) FILTER (status IS NOT NULL) AS ns, max_by(width, seq) FILTER (width IS NOT NULL) AS nw
  FROM c WHERE status IS NULL OR status <> 'lost' GROUP BY 1)"""
_FOLDED = f"""{view_sql('captured')}, {_CHANGES} SELECT d.document_id, coalesce(ns, status) AS status, coalesce(nw, width) AS width
FROM captured d LEFT JOIN g ON g.document_id = d.document_id"""


def _changes(df):
    return df.selectExpr(
        "o_custkey AS document_id", "o_orderkey AS seq",
        "CASE o_orderkey % 4 WHEN 0 THEN 'ready' WHEN 1 THEN 'error' WHEN 2 THEN 'lost' ELSE NULL END AS status",
        "CASE WHEN o_orderkey % 3 = 0 THEN cast(o_orderkey % 2000 AS int) END AS width")


@query("folded_updates", _FOLDED)
def folded_updates(spark, sf):
    out = updates.folded(view(spark, sf, "captured"), _changes(table(spark, sf, "orders")))
    return out.select("document_id", "status", "width")


@query("folded_updates_stream", _FOLDED)
def folded_updates_stream(spark, sf):
    base, out = fresh_dir(spark, "documents"), fresh_dir(spark, "updates")
    view(spark, sf, "captured").write.parquet(base)
    jobs.run_batches(_changes(_stream(spark, sf, "orders")), "updates", jobs.update_batch(base, out))
    return jobs.newest_documents(spark, out).select("document_id", "status", "width")


@query("refused_updates", f"WITH {_CHANGES} SELECT document_id, seq FROM c WHERE status = 'lost'")
def refused_updates(spark, sf):
    return updates.judged_updates(_changes(table(spark, sf, "orders"))).filter("NOT valid").select("document_id", "seq")


@query("documents_by_state", f"""{view_sql('requests')}, d AS (SELECT request_id, CASE WHEN image_width IS NULL THEN 'error' ELSE 'ready' END AS status,
  CASE WHEN starts_with(source_url, 'https:') THEN 'site' || split_part(split_part(source_url, '.', 2), 'Site', 2) || '.example.com' END AS source_domain FROM requests)
SELECT request_id FROM d WHERE status = 'ready' AND source_domain = 'site7.example.com'""")
def documents_by_state(spark, sf):
    from maskloom.functions import urls

    docs = view(spark, sf, "requests").select(
        "request_id", F.when(F.col("image_width").isNull(), "error").otherwise("ready").alias("status"),
        urls.domain(F.col("source_url")).alias("source_domain"))
    path = fresh_dir(spark, "documents-by-state")
    C.write_documents(docs, path)
    return C.documents_where(spark, path, "ready", "site7.example.com").select("request_id")
