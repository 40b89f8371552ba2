"""Streams that keep a table between batches: what a batch reads and writes, restarts, repeated batches."""

import time

import pytest
from pyspark.sql import functions as F
from test_groups import boxes, crowd, greedy

from maskloom.operators import suppression
from maskloom.session import fresh_dir
from maskloom.streaming import jobs
from maskloom.streaming.state import BucketTable


def files(spark, path):
    """Every file below a folder, as Spark lists it."""
    return {r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path").collect()}


def in_order(spark, parts, schema):
    path = fresh_dir(spark, "stream")
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.05)  # file streams order files by their time stamp
    return path


def stream_of(spark, path, schema):
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_bucket_table_keeps_untouched_buckets(spark):
    schema = spark.createDataFrame([], "document_id long, v long").schema
    table = BucketTable(spark, fresh_dir(spark, "table"), schema, "document_id", "v", buckets=16)
    rows = spark.range(500).select(F.col("id").alias("document_id"), (F.col("id") * 2).alias("v"))
    table.write(0, rows)
    assert table.read(0).count() == 500 and len(table.manifest(0)) == 16
    one = spark.createDataFrame([(7, 70)], schema)
    touched = table.touched(one)
    kept = table.read(0, touched).filter("document_id <> 7")
    table.write(1, kept.unionByName(one), touched)
    table.write(1, kept.unionByName(one), touched)  # a repeated batch
    assert [table.manifest(1)[b] for b in sorted(table.manifest(1))].count(1) == 1
    assert {r.document_id: r.v for r in table.read(1).collect()} == {**{i: 2 * i for i in range(500)}, 7: 70}
    # A bucket that loses its last row leaves the manifest; an older version stays readable.
    table.write(2, table.read(1, touched).limit(0), touched)
    assert table.read(2, touched).count() == 0 and table.read(2).count() == 500 - table.read(1, touched).count()
    assert table.read(0).count() == 500 and table.versions() == [0, 1, 2]


def test_twenty_batches_of_survivors_read_their_own_buckets(spark, monkeypatch):
    rows = [(d, *r[1:]) for d in range(10) for r in crowd(24, 40 + d, copies=0.0)]
    parts = [[r for r in rows if r[0] in (n % 10, (n + 1) % 10)][n % 3::3] for n in range(20)]
    schema = "document_id long, region_id string, x double, y double, w double, h double, score double"
    seen, read = [], BucketTable.read
    monkeypatch.setattr(BucketTable, "read", lambda self, version, buckets=None: seen.append(buckets) or read(self, version, buckets))
    want, alive = set(), {}
    for n, part in enumerate(parts):
        for d in {r[0] for r in part}:
            own = [r for r in part if r[0] == d]
            together = list({r[1]: r for r in alive.get(d, []) + own}.values())
            keep = greedy(together, 0.3)
            want |= {(n, d, r[1]) for r in own if r[1] in keep}
            alive[d] = [r for r in together if r[1] in keep]
    path = in_order(spark, parts, schema)
    got = jobs.progressive_survivors(stream_of(spark, path, schema), 0.3)
    assert {(r.batch, r.document_id, r.region_id) for r in got.collect()} == want
    assert len(seen) == 19 and all(b is not None and len(b) <= 2 for b in seen)


def test_survivors_go_on_after_a_restart(spark):
    rows = crowd(60, 2, copies=0.0)
    schema = "document_id long, region_id string, x double, y double, w double, h double, score double"
    path, out, state = in_order(spark, [rows[:20], rows[20:40]], schema), fresh_dir(spark, "out"), fresh_dir(spark, "state")
    jobs.start_progressive(stream_of(spark, path, schema), out, state, 0.3).awaitTermination()
    first = spark.read.parquet(f"{out}/emitted").collect()
    spark.createDataFrame(rows[40:], schema).coalesce(1).write.mode("append").parquet(path)
    for _ in range(2):  # the second start finds nothing new
        jobs.start_progressive(stream_of(spark, path, schema), out, state, 0.3).awaitTermination()
    emitted = spark.read.parquet(f"{out}/emitted").collect()
    assert len({r.region_id for r in emitted}) == len(emitted) and {r.region_id for r in first} <= {r.region_id for r in emitted}
    alive, want = [], set()
    for part in (rows[:20], rows[20:40], rows[40:]):
        keep = greedy(alive + part, 0.3)
        want |= {r[1] for r in part if r[1] in keep}
        alive = [r for r in alive + part if r[1] in keep]
    assert {r.region_id for r in emitted} == want
    # A batch that runs again, as after a failure before its commit, replaces what it wrote.
    jobs.progressive_batch(boxes(spark, rows[40:]), 2, out, 0.3)
    assert sorted(map(str, spark.read.parquet(f"{out}/emitted").collect())) == sorted(map(str, emitted))


def test_a_change_to_one_document_rewrites_one_bucket(spark):
    docs = spark.range(2000).select(F.col("id").alias("document_id"), F.lit("loading").alias("status"), F.lit(1).alias("width"))
    base, out = fresh_dir(spark, "base"), fresh_dir(spark, "out")
    docs.write.parquet(base)
    handle = jobs.update_batch(base, out)
    schema = "document_id long, seq long, status string, width int"
    handle(spark.createDataFrame([(5, 1, "ready", 3), (9, 2, "lost", 3)], schema), 0)
    before = files(spark, f"{out}/documents/rows")
    changes = spark.createDataFrame([(5, 3, "error", None), (5, 4, None, 8)], schema)
    for _ in range(2):  # the batch is repeated
        handle(changes, 1)
    new = files(spark, f"{out}/documents/rows") - before
    assert {p.split("/version=")[1].split("/")[0] for p in new} == {"2"} and len({p.split("/bucket=")[1].split("/")[0] for p in new}) == 1
    got = {r.document_id: (r.status, r.width) for r in jobs.newest_documents(spark, out).collect()}
    assert len(got) == 2000 and got[5] == ("error", 8) and got[9] == ("loading", 1)
    handle(spark.createDataFrame([(10_000, 5, "ready", 1), (3, 6, "lost", 1)], schema), 2)  # nothing valid for a known document
    assert {r.document_id: (r.status, r.width) for r in jobs.newest_documents(spark, out).collect()} == got
    assert spark.read.parquet(f"{out}/refused").count() == 2


def test_throttle_and_debounce_hand_on_one_row_a_key(spark):
    schema = "key long, ms long, seq long"
    rows = [(n % 3, 1_700_000_000_000 + 130 * n, n) for n in range(60)]
    path = in_order(spark, [rows[:20], rows[20:40], rows[40:]], schema)
    as_events = lambda df: df.select("key", F.timestamp_millis("ms").alias("at"), "seq")
    handed = []
    jobs.run_carried(as_events(stream_of(spark, path, schema)), "carried",
                     lambda df: handed.append(df.filter("carried").count()) or (df, jobs._newest(df)))
    assert handed == [0, 3, 3]


@pytest.mark.parametrize("again", [False, True])
def test_names_go_on_from_the_numbers_kept(spark, again):
    """A batch reads the highest number of each day, not the names before; a repeated batch gives the same names."""
    out = fresh_dir(spark, "intake")
    schema = "request_id long, requested_at timestamp"
    import datetime as dt
    day = lambda d: dt.datetime(2024, 5, d, 10)
    names = {}
    for batch, part in enumerate([[(1, day(1)), (2, day(1)), (3, day(2))], [(4, day(1)), (5, day(3))], [(6, day(2)), (7, None)]]):
        for _ in range(1 + again):
            done = jobs._named(spark.createDataFrame(part, schema), batch, out)
            given = jobs._given(done, batch, out)
            jobs._write_batch(given, f"{out}/taken", batch)
        names |= {r.request_id: r.name for r in done.collect()}
    assert names == {1: "shot-20240501-001", 2: "shot-20240501-002", 3: "shot-20240502-001", 4: "shot-20240501-003",
                     5: "shot-20240503-001", 6: "shot-20240502-002", 7: None}


def test_first_batch_emits_and_keeps_the_surviving_rows_themselves(spark):
    rows = [(1, "a", 0.0, 0.0, 10.0, 10.0, 0.9), (1, "a", 0.0, 0.0, 10.0, 9.0, 0.8), (1, "b", 50.0, 0.0, 10.0, 10.0, 0.5), (2, "c", 0.0, 0.0, 4.0, 4.0, 0.0)]
    boxes = spark.createDataFrame(rows, "document_id long, region_id string, x double, y double, w double, h double, score double")
    out = fresh_dir(spark, "first-batch")
    jobs.progressive_batch(boxes, 0, out, 0.5)
    want = sorted(rows[:1] + rows[2:])
    assert sorted(tuple(r)[:7] for r in spark.read.parquet(f"{out}/emitted").collect()) == want
    assert sorted(map(tuple, jobs._survivors(spark, boxes.schema, out).read(1).collect())) == want


def test_intake_hands_on_no_payloads(spark, monkeypatch):
    """What is kept, shuffled and named has neither the image as it came nor its bytes."""
    import base64

    from maskloom.sources.captures import CAPTURE

    png = base64.b64encode(bytes.fromhex("89504E470D0A1A0A0000000D49484452000000070000000900")).decode()
    rows = [{"request_id": n, "source_url": u, "capture_mode": "screenshot", "image_data": d} for n, u, d in [
        (1, "https://a.example.com/", f"data:image/png;base64,{png}"), (2, "https://a.example.com/", "data:image/png;base64,?"),
        (3, "https://a.example.com/", None), (4, " ", f"data:image/png;base64,{png}"), (5, "https://a.example.com/", "no comma")]]
    seen, name = [], jobs._named
    monkeypatch.setattr(jobs, "_named", lambda docs, *rest: seen.append(docs.columns) or name(docs, *rest))
    out = fresh_dir(spark, "no-payloads")
    jobs.intake_batch(spark.createDataFrame(rows, CAPTURE), 0, out)
    got = {r.request_id: (r.status, r.refusal, r.width, r.original_asset_id) for r in spark.read.parquet(f"{out}/documents").collect()}
    assert got == {1: ("ready", None, 7, "1-original"), 2: ("error", "invalid_base64", None, None), 3: ("ready", None, None, None),
                   5: ("error", "invalid_data_url", None, None)}
    assert [r.request_id for r in spark.read.parquet(f"{out}/rejected").collect()] == [4]
    assert not {"image_data", "content"} & set(seen[0])


def _plain_batch(boxes, stood, t):
    """What a batch emits and what stands after it, by joins: the definition that ``progressive_batch`` works off bucket by bucket."""
    cols, on = suppression.BOX_COLUMNS, ["document_id", "region_id"]
    new = boxes.select(*cols)
    if stood is None:
        kept = suppression.surviving_boxes(new, t)
        return kept, kept
    mine = new.select("document_id").distinct()
    kept = suppression.surviving_boxes(stood.join(mine, "document_id", "left_semi").unionByName(new), t)
    return new.join(kept.select(*on), on, "left_semi"), stood.join(mine, "document_id", "left_anti").unionByName(kept)


@pytest.mark.parametrize("t, at_once", [(0.4, 1 << 25), (0.4, 40), (1.0, 40)])
def test_batches_in_parts_without_checkpoints(spark, monkeypatch, t, at_once):
    """Rows that come twice, ids that come again, null ids and a crowded document; a batch leaves no checkpoint, and shuffles a part at once."""
    import glob

    schema = "document_id long, region_id string, x double, y double, w double, h double, score double"
    rows = [(d, *r[1:]) for d in range(30) for r in crowd(6, 90 + d)] + [(500, *r[1:]) for r in crowd(560, 5)]
    rows += [(d, *r[1:]) for d in (3, 4, 5) for r in rows[6 * d:6 * d + 4]] + [(None, *r[1:]) for r in rows[:9]] + [(d, None, *r[2:]) for d in (1, 2) for r in rows[:4]]
    rows += [(d, rows[6 * d][1], 300.0 + d, 300.0, 9.0, 9.0, 0.5) for d in range(9)]  # the id of another box
    parts = [rows[::2], rows[1::2], [r for r in rows if r[0] in (500, 3, None)][::3], []]
    monkeypatch.setattr(jobs, "AT_ONCE", at_once)
    shuffled, judge = [], suppression.surviving_in_place
    monkeypatch.setattr(suppression, "surviving_in_place", lambda boxes, *a: shuffled.append(boxes.groupBy("document_id").count().count()) or judge(boxes, *a))
    out, stood = fresh_dir(spark, "parts"), None
    ordered = lambda df: sorted(map(str, df.select(*suppression.BOX_COLUMNS).collect()))
    emitted = []
    for n, part in enumerate(parts):
        boxes, below = spark.createDataFrame(part, schema), f"{spark.sparkContext.getCheckpointDir().removeprefix('file:')}/rdd-*"
        before = set(glob.glob(below))
        jobs.progressive_batch(boxes, n, out, t)
        crowded = any(r[0] == 500 for r in part) and t < 1  # rounds of a crowded document keep their checkpoints
        assert crowded or set(glob.glob(below)) == before
        want, stood = _plain_batch(boxes, stood, t)
        stood = stood.localCheckpoint()
        emitted.append(ordered(want))
        assert ordered(spark.read.schema(schema).parquet(f"{out}/emitted/batch={n}")) == emitted[-1]
        assert ordered(jobs._survivors(spark, boxes.schema, out).read(n + 1)) == ordered(stood)
    assert all(emitted[:3]) and not emitted[3] and (len(shuffled) > 12 if at_once == 40 else len(shuffled) == 4)
