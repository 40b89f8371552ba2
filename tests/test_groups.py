"""Suppression, pacing, history and updates, with crowded keys and several batches."""

import random

import numpy as np
import pytest
from pyspark.sql import Window, functions as F

from maskloom.operators import history, ordering, pacing, spatial, suppression as S, updates
from maskloom.session import fresh_dir
from maskloom.streaming import jobs


def iou(a, b):
    dx = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    dy = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inter = max(0, dx) * max(0, dy)
    union = a[2] * a[3] + b[2] * b[3] - inter
    return inter / union if union > 0 else 0


def greedy(rows, t):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[6], r[1])):
        if all(iou(r[2:6], k[2:6]) <= t for k in kept):
            kept.append(r)
    return {r[1] for r in kept}


def boxes(spark, rows):
    return spark.createDataFrame(rows, "document_id long, region_id string, x double, y double, w double, h double, score double")


def crowd(n, seed, copies=0.3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < copies:
            x, y, w, h = rows[rng.randrange(len(rows))][2:6]
        else:
            w, h = rng.choice([1, 3, 8, 20, 64, 0]) + rng.random(), rng.choice([2, 8, 30]) + rng.random()
            x, y = rng.random() * 120 - 10, rng.random() * 90
            if rng.random() < 0.1:
                w = 0.0
        rows.append((7, f"r{i:04d}", x, y, w, h, rng.randrange(20) / 20))
    return rows


@pytest.mark.parametrize("t", [0.3, 0.7])
def test_crowded_document(spark, t):
    rows = crowd(160, 11)
    df = boxes(spark, rows)
    want = greedy(rows, t)
    assert {r.region_id for r in S.surviving_boxes(df, t).collect()} == want
    spread = S.surviving_boxes(df, t, array_limit=20, frontier=8)
    assert {r.region_id for r in spread.collect()} == want


def test_keepers_of_a_crowded_document(spark):
    rows = crowd(120, 21)
    df = boxes(spark, rows)
    keep = greedy(rows, 0.3)
    kept = df.filter(F.col("region_id").isin(sorted(keep)))
    by_id = {r[1]: r for r in rows}
    want = {}
    for r in rows:
        if r[1] not in keep:
            over = [k for k in keep if iou(by_id[k][2:6], r[2:6]) > 0.3]
            want[r[1]] = min(over, key=lambda k: (-by_id[k][6], k))
    for limit in (512, 10):
        got = {r.region_id: r.keeper_id for r in S.pair_with_keeper(df, kept, 0.3, array_limit=limit).collect()}
        assert got == want


def test_suppression_is_idempotent(spark):
    df = boxes(spark, crowd(80, 5))
    once = S.surviving_boxes(df, 0.5)
    assert S.surviving_boxes(once, 0.5).count() == once.count()
    assert S.keep_non_overlapping(df, 0.5).count() == once.count()
    assert S.surviving_boxes(df, 1.0).count() == 80
    with pytest.raises(ValueError):
        S.surviving_boxes(df, 0.0)


def test_progressive_batches(spark):
    rows = crowd(60, 2, copies=0.0)
    path = fresh_dir(spark, "boxes")
    emitted, alive = set(), []
    for i in range(3):
        part = rows[i::3]
        boxes(spark, part).coalesce(1).write.mode("append").parquet(path)
        keep = greedy(alive + part, 0.3)
        emitted |= {r[1] for r in part if r[1] in keep}
        alive = [r for r in alive + part if r[1] in keep]
        import time
        time.sleep(1.1)  # file streams order files by their time stamp
    stream = spark.readStream.schema(boxes(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.region_id for r in jobs.progressive_survivors(stream, 0.3).collect()}
    assert got == emitted
    assert emitted > {r[1] for r in alive} or emitted == {r[1] for r in alive}


def events(spark, rows):
    return spark.createDataFrame(rows, "key long, ms long, seq long").select("key", F.timestamp_millis("ms").alias("at"), "seq")


def _log(seed, n=600):
    rng = random.Random(seed)
    rows, t = [], 1_700_000_000_000
    for i in range(n):
        t += rng.choice([0, 1, 30, 90, 150, 399, 400, 401, 900]) if i % 50 else 5000
        rows.append((1 if rng.random() < 0.7 else rng.randrange(2, 6), t, i))
    return rows


def passing(rows, gap):
    out, last = set(), {}
    for k, t, s in sorted(rows, key=lambda r: (r[1], r[2])):
        if k not in last or t - last[k] >= gap:
            out.add(s)
            last[k] = t
    return out


def test_throttle(spark):
    rows = _log(4)
    df = events(spark, rows)
    assert {r.seq for r in pacing.throttled(df, 400).collect()} == passing(rows, 400)
    assert {r.seq for r in pacing.throttled(df, 200).collect()} == passing(rows, 200)


def test_throttle_stream_keeps_state_between_batches(spark):
    import time

    rows = _log(9, 240)
    path = fresh_dir(spark, "events")
    for i in range(0, 240, 80):
        events(spark, rows[i:i + 80]).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(events(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = {r.seq for r in jobs.throttled(stream, 400).collect()}
    assert got == passing(rows, 400)


def test_debounce(spark):
    rows = _log(6)
    got = {r.seq for r in pacing.debounced(events(spark, rows), 150, 2000).collect()}
    want = set()
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        want |= {a[2] for a, b in zip(mine, mine[1:] + [None]) if b is None or b[1] - a[1] >= 150}
    assert got == want


def test_history_replay(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 2]), 1_700_000_000_000 + i * 1000, i, rng.choice(["add", "undo", "undo"]), f"p{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "key long, ms long, seq long, action string, image_path string").withColumn("at", F.timestamp_millis("ms"))
    out = history.replay(df, F.floor(F.col("ms") / 40000))
    got = {r.seq: (r.level, r.outcome, r.restored_path) for r in out.collect()}
    state, want = {}, {}
    for key, _, seq, action, path in rows:
        hist, idx = state.get(key, ([], 0))
        if action == "add":
            hist, idx = hist[:idx] + [path], idx + 1
            want[seq] = (idx, "added", None)
        elif idx:
            idx -= 1
            want[seq] = (idx, "undone", hist[idx])
        else:
            want[seq] = (0, "cannot_undo", None)
        state[key] = (hist, idx)
    assert got == want
    for r in history.final_state(out).collect():
        hist, idx = state[r.key]
        assert (r.history_index, r.history_length) == (idx, len(hist))
        assert r.current_path == (hist[idx - 1] if idx else None)
        assert (r.can_undo, r.can_redo) == (idx > 0, idx < len(hist))


def test_ordinal_matches_plain_numbering(spark):
    rng = np.random.default_rng(0)
    rows = [(int(k), int(v), i) for i, (k, v) in enumerate(zip(rng.integers(0, 2, 200), rng.integers(0, 1000, 200)))]
    df = spark.createDataFrame(rows, "k long, v long, i long")
    got = {r.i: r.position for r in ordering.ordinal(df, ["k"], [F.col("v"), F.col("i")], [F.floor(F.col("v") / 100)]).collect()}
    for k in (0, 1):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        assert [got[r[2]] for r in mine] == list(range(1, len(mine) + 1))


def test_window_edges_touch(spark):
    r = spark.createDataFrame([(1, "a", "object", 0.0, 0.0, 64.0, 10.0), (1, "b", "object", 65.0, 0.0, 5.0, 5.0), (1, "c", "text", -10.0, -10.0, 10.0, 10.0)],
                              "document_id long, region_id string, type string, x double, y double, w double, h double")
    m = spark.createDataFrame([(1, 64.0, 0.0, 10.0, 10.0), (1, 0.0, 0.0, 0.0, 0.0)], "document_id long, x double, y double, w double, h double")
    got = sorted(x.region_id for x in spatial.regions_in_window(r, m).collect())
    assert got == ["a", "a", "b", "c"]
    p = spark.createDataFrame([(1, 64.0, 10.0)], "document_id long, px double, py double")
    assert [x.region_id for x in spatial.point_hits(r, p).collect()] == ["a"]


def test_updates(spark):
    docs = spark.createDataFrame([(1, "loading", 10), (2, "ready", None)], "document_id long, status string, width int")
    ch = spark.createDataFrame([(1, 1, "ready", None), (1, 2, "nonsense", 99), (1, 3, None, 20), (3, 1, "ready", 5)],
                               "document_id long, seq long, status string, width int")
    assert {tuple(r) for r in updates.folded(docs, ch).collect()} == {(1, "ready", 20), (2, "ready", None)}
    assert updates.judged_updates(ch).filter("NOT valid").count() == 1


def _foldered(spark, rows, parts):
    import time

    path = fresh_dir(spark, "events")
    for i in range(0, len(rows), -(-len(rows) // parts)):
        events(spark, rows[i:i - (-len(rows) // parts)]).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # file streams order files by their time stamp
    return spark.readStream.schema(events(spark, rows[:1]).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_debounce_stream_over_several_batches_ends_every_burst(spark):
    rows = _log(6, 240)
    got = {r.seq for r in jobs.debounced(_foldered(spark, rows, 3), 150, 2000).collect()}
    assert got == {r.seq for r in pacing.debounced(events(spark, rows), 150, 2000).collect()}


def test_streams_read_files_and_folders_alike(spark):
    from maskloom.plans.stream_queries import _stream

    df = events(spark, _log(1, 30))
    home = fresh_dir(spark, "tables")
    df.repartition(3).write.parquet(f"{home}/events.parquet")
    assert jobs.run_available(_stream(spark, home, "events"), "folder").count() == 30
    single = "/root/testdata/sf0.001"
    assert jobs.run_available(_stream(spark, single, "events"), "file").count() == spark.read.parquet(f"{single}/events.parquet").count()


def test_updates_over_several_batches(spark):
    docs = spark.createDataFrame([(i, "loading", 1) for i in range(6)], "document_id long, status string, width int")
    changes = spark.createDataFrame([(i % 6, n, "ready" if n % 2 else "error", n) for n, i in enumerate(range(18))],
                                    "document_id long, seq long, status string, width int")
    base, out, path = (fresh_dir(spark, k) for k in ("base", "out", "changes"))
    docs.write.parquet(base)
    import time
    for k in range(3):
        changes.filter(f"seq >= {6 * k} AND seq < {6 * k + 6}").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.run_batches(stream, "updates", jobs.update_batch(base, out))
    from maskloom.operators import updates
    want = {tuple(r) for r in updates.folded(docs, changes).select("document_id", "status", "width").collect()}
    assert {tuple(r) for r in jobs.newest_documents(spark, out).select("document_id", "status", "width").collect()} == want


def test_unknown_sides_and_scores_on_both_sides_of_the_size_switch(spark):
    rows = [(1, f"r{i}", 10.0 * (i % 4), 5.0, None if i == 3 else 12.0, None if i == 5 else 9.0, None if i % 6 == 4 else 1 - i / 50)
            for i in range(20)] + [(1, "f", 0.0, 0.0, 0.0, 5.0, 0.9), (1, "n", None, 1.0, 5.0, 5.0, 0.2)]
    df = spark.createDataFrame(rows, "document_id long, region_id string, x double, y double, w double, h double, score double")
    few, many = ({r.region_id for r in S.surviving_boxes(df, 0.4, array_limit=n).collect()} for n in (2, 512))
    assert few == many and {"r3", "r5", "f", "n"} <= few


def test_ordinal_splits_one_document_with_one_time_stamp(spark):
    """A million rows of one key that differ in the tie-breaker only: many slices, none of them large, the same numbers."""
    n = 1_000_000
    df = spark.range(n).select(F.lit(7).alias("document_id"), F.lit("2024-05-01").cast("timestamp").alias("found_at"),
                               ((F.col("id") * 7919) % n).alias("region_id"))
    order = [F.col("found_at"), F.col("region_id")]
    points = ordering.split_points(df, order, 16)
    sizes = [r["count"] for r in df.groupBy(ordering.slice_number(df, order, points).alias("s")).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < n / 8
    got = ordering.ordinal(df, ["document_id"], order, slices=16)
    assert got.filter(F.col("position") != F.col("region_id") + 1).isEmpty() and got.count() == n


def test_ordinal_orders_like_one_window(spark):
    """Nulls, strings, repeated keys and tables smaller than the number of slices."""
    rng = np.random.default_rng(3)
    rows = [(None if k == 2 else f"d{k}", None if v == 0 else float(v), f"r{i:03d}") for i, (k, v) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 6, 300)))]
    for part in (rows, rows[:3], rows[:1], []):
        df = spark.createDataFrame(part, "k string, v double, i string")
        want = df.withColumn("position", F.row_number().over(Window.partitionBy("k").orderBy("v", "i")))
        got = ordering.ordinal(df, ["k"], [F.col("v"), F.col("i")], slices=8)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("t, leading", [(0.3, 8), (0.5, 64), (0.7, 2048)])
def test_groups_of_a_crowded_document(spark, t, leading):
    rows = crowd(220, 31, copies=0.1)
    df = boxes(spark, rows)
    assert {r.region_id for r in S.surviving_boxes(df, t, array_limit=50, frontier=leading).collect()} == greedy(rows, t)


def test_a_falling_chain_needs_few_rounds(spark, monkeypatch):
    """10,000 boxes, each overlapping the next with a lower score: every other one stays, after some rounds and not thousands."""
    rows = [(7, f"r{i:05d}", i * 2.0, 0.0, 10.0, 10.0, 1.0 - i / 20_000) for i in range(10_000)]
    rounds = []
    folding = S._folding
    monkeypatch.setattr(S, "_folding", lambda t: rounds.append(t) or folding(t))
    df = boxes(spark, rows)
    got = sorted(r.region_id for r in S.surviving_boxes(df, 0.6).collect())
    assert got == [f"r{i:05d}" for i in range(0, 10_000, 2)] and len(rounds) < 20


@pytest.mark.parametrize("crowd", [spatial.CROWD, 12])
def test_windows_and_pointers_meet_like_plain_loops(spark, monkeypatch, crowd):
    """Ordinary documents meet without a repeated row; crowded ones by tiles; both as plain loops over all pairs."""
    monkeypatch.setattr(spatial, "CROWD", crowd)
    rng = random.Random(5)
    at = lambda: float(rng.randrange(-100, 400))
    r = [(d, f"{d}-{i}", rng.choice(["text", "object", "manual"]), at(), at(), float(rng.randrange(0, 200)), float(rng.randrange(0, 200)))
         for d in (1, 2, 3) for i in range({1: 4, 2: 60, 3: 8}[d])] + [(4, "4-0", "object", None, 1.0, 1.0, 1.0), (None, "n", "object", 0.0, 0.0, 9.0, 9.0)]
    m = [(d, at(), at(), 60.0, 50.0) for d in (1, 2, 2, 2, 3, 4)] + [(None, 0.0, 0.0, 9.0, 9.0)]
    regions = spark.createDataFrame(r, "document_id long, region_id string, type string, x double, y double, w double, h double")
    windows = spark.createDataFrame(m, "document_id long, x double, y double, w double, h double")
    known = [b for b in r if b[0] is not None and b[3] is not None]
    found = spatial.regions_in_window(regions, windows)
    assert sorted(x.region_id for x in found.collect()) == sorted(
        b[1] for b in known for w in m if b[0] == w[0] and b[3] <= w[1] + w[3] and w[1] <= b[3] + b[5] and b[4] <= w[2] + w[4] and w[2] <= b[4] + b[6])
    points = spark.createDataFrame([(d, x, y) for d, x, y, *_ in m], "document_id long, px double, py double")
    hits = spatial.point_hits(regions, points)
    assert sorted(x.region_id for x in hits.collect()) == sorted(
        b[1] for b in known for w in m if b[0] == w[0] and b[2] != "text" and b[3] <= w[1] <= b[3] + b[5] and b[4] <= w[2] <= b[4] + b[6])
    for df in (found, hits):
        assert ("Generate" in df._jdf.queryExecution().optimizedPlan().toString()) == (crowd == 12)
