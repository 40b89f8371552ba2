"""Throttle and debounce over event tables ``(key, at, seq)``; ``seq`` is unique.

Both answer the question per key without handing a key's events to one task: events are cut into
time buckets, and only neighbouring buckets are looked at together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from maskloom.session import cut_lineage

# Fixed values, in milliseconds: pause between scans, between box requests, and end of scrolling.
SCAN_INTERVAL_MS = 400
BOX_INTERVAL_MS = 200
SCROLL_PAUSE_MS = 150


def throttled(events: DataFrame, interval_ms: int = SCAN_INTERVAL_MS) -> DataFrame:
    """Events that pass when each needs ``interval_ms`` since the last one that passed.

    With buckets as long as the interval, an event that passes in bucket ``b`` is followed by the
    first event at least one interval later. That event lies in bucket ``b + 1`` or ``b + 2``, or
    the key was silent for an interval, after which the next event passes anyway. So events form
    chains of single successors that start after silences; the events on those chains are marked
    by pointer doubling, in rounds that grow with the logarithm of the longest chain.
    """
    n = int(interval_ms) * 1000
    t = F.unix_micros(F.col("at").cast("timestamp"))
    base = events.select("key", "seq", t.alias("t")).withColumn(
        "bucket", ((F.col("t") - F.pmod(F.col("t"), F.lit(n))) / n).cast("long"))
    ends = cut_lineage(base.groupBy("key", "bucket").agg(
        F.min(F.struct("t", "seq")).alias("first"), F.max("t").alias("last_t")))

    # Starts: no event within one interval before.
    in_bucket = Window.partitionBy("key", "bucket").orderBy("t", "seq")
    before = ends.select("key", (F.col("bucket") + 1).alias("bucket"), F.col("last_t").alias("prev_last"))
    starts = (
        base.withColumn("prev", F.lag("t").over(in_bucket)).join(before, ["key", "bucket"], "left")
        .withColumn("prev", F.coalesce("prev", "prev_last"))
        .filter(F.col("prev").isNull() | (F.col("t") - F.col("prev") >= n)).select("key", "seq")
    )

    # Successors: the earliest event at or after t + interval, looked up in the bucket of that moment.
    targets = base.select("key", "bucket", "t", F.lit(0).alias("probe"), "seq")
    probes = base.select("key", (F.col("bucket") + 1).alias("bucket"), (F.col("t") + n).alias("t"), F.lit(1).alias("probe"), "seq")
    later = Window.partitionBy("key", "bucket").orderBy(F.desc("t"), "probe", F.desc("seq")).rowsBetween(
        Window.unboundedPreceding, 0)
    found = targets.unionByName(probes).withColumn(
        "next", F.last(F.when(F.col("probe") == 0, F.col("seq")), ignorenulls=True).over(later)).filter("probe = 1")
    after = ends.select("key", (F.col("bucket") - 1).alias("bucket"), F.col("first.seq").alias("next_first"))
    jumps = cut_lineage(
        found.join(after, ["key", "bucket"], "left")
        .select("key", "seq", F.coalesce("next", "next_first").alias("next")).filter("next IS NOT NULL"))

    passed = cut_lineage(starts)
    reached = passed.count()
    while True:
        step = jumps.join(passed, ["key", "seq"], "left_semi").select("key", F.col("next").alias("seq"))
        passed = cut_lineage(passed.unionByName(step).distinct())
        now = passed.count()
        if now == reached:
            return events.join(passed, ["key", "seq"], "left_semi")
        reached = now
        onward = jumps.select("key", F.col("seq").alias("next"), F.col("next").alias("further"))
        jumps = cut_lineage(jumps.join(onward, ["key", "next"]).select("key", "seq", F.col("further").alias("next")))


def debounced(events: DataFrame, pause_ms: int = SCROLL_PAUSE_MS, slice_ms: int | None = None) -> DataFrame:
    """Last events of bursts: those with no further event of the key within ``pause_ms``.

    The next event is looked up inside a time slice, else it is the first one of the next slice,
    so a busy key is sorted slice by slice.
    """
    pause, width = int(pause_ms) * 1000, int(slice_ms or pause_ms * 1000) * 1000
    t = F.unix_micros(F.col("at").cast("timestamp"))
    keyed = events.withColumn("_t", t).withColumn("_slice", ((F.col("_t") - F.pmod(F.col("_t"), F.lit(width))) / width).cast("long"))
    in_slice = Window.partitionBy("key", "_slice").orderBy("_t", "seq")
    over = Window.partitionBy("key").orderBy("_slice")
    firsts = keyed.groupBy("key", "_slice").agg(F.min("_t").alias("_first")).select(
        "key", "_slice", F.lead("_first").over(over).alias("_next_first"))
    gap = F.coalesce("_next", "_next_first") - F.col("_t")
    return (
        keyed.withColumn("_next", F.lead("_t").over(in_slice)).join(firsts, ["key", "_slice"])
        .filter(gap.isNull() | (gap >= pause)).select(*events.columns)
    )
