"""Edit history: column functions on an embedded history, and the replay of an action log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

REDO_REFUSAL = "redo_not_supported"
UNDO_REFUSAL = "cannot_undo"


def add_entry(history: Column, index: Column, entry: Column) -> Column:
    """Drop what lies beyond ``index``, append; the new index is the new length."""
    return F.concat(F.slice(history, F.lit(1), index), F.array(entry))


def current_path(history: Column, index: Column) -> Column:
    inside = (index > 0) & (index <= F.size(history))
    return F.when(inside, F.get(history, index - 1)["image_path"])


def can_undo(index: Column) -> Column:
    return F.coalesce(index, F.lit(0)) > 0


def can_redo(history: Column, index: Column) -> Column:
    return F.coalesce(index, F.lit(0)) < F.size(F.coalesce(history, F.array()))


def undone(documents: DataFrame) -> DataFrame:
    """One undo per document: path to restore, new index and state, or a refusal."""
    possible = can_undo(F.col("history_index"))
    return documents.select(
        "*",
        F.when(possible, F.get("history", F.col("history_index") - 1)["image_path"]).alias("restored_path"),
        F.when(possible, F.col("history_index") - 1).otherwise(F.col("history_index")).alias("new_index"),
        F.when(possible, "ready").otherwise(F.col("status")).alias("new_status"),
        F.when(~possible, UNDO_REFUSAL).alias("refusal"),
    )


def levelled(actions: DataFrame, slice_of: Column) -> DataFrame:
    """Apply a log of ``add`` and ``undo`` per ``key`` in order of ``(at, seq)``: ``level`` and ``outcome``.

    The index is a walk that goes up on ``add``, down on ``undo`` and stops at zero, which is the
    running sum minus its running minimum (when negative). Both are prefix aggregates, so the log
    is cut into slices (``slice_of`` must grow with ``at``), each slice is summed apart, and only
    slice totals are chained per key: no key is folded row by row in one task. ``level`` is the
    index after the action.
    """
    step = F.when(F.col("action") == "add", 1).otherwise(-1)
    order = ["at", "seq"]
    local = Window.partitionBy("key", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        actions.withColumn("slice", slice_of).withColumn("step", step)
        .withColumn("s", F.sum("step").over(local))
        .withColumn("low", F.min("s").over(local))
    )
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        rows.groupBy("key", "slice").agg(F.sum("step").alias("total"), F.min("s").alias("slice_low"))
        .withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
        .withColumn("reached", F.col("base") + F.col("slice_low"))
        .withColumn("base_low", F.least(F.lit(0), F.coalesce(F.min("reached").over(before), F.lit(0))))
        .select("key", "slice", "base", "base_low")
    )
    height = F.col("base") + F.col("s")
    earlier = Window.partitionBy("key", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("low_before", F.min("s").over(earlier))
        .join(slices, ["key", "slice"])
        .withColumn("level", (height - F.least("base_low", F.col("base") + F.col("low"))).cast("long"))
        # An undo at zero pushes the raw sum to a new minimum; least() skips the null of a first row.
        .withColumn("at_zero", height < F.least("base_low", F.col("base") + F.col("low_before")))
        .withColumn(
            "outcome",
            F.when(F.col("action") == "add", "added").when(F.col("at_zero"), UNDO_REFUSAL).otherwise("undone"),
        )
        .select(*actions.columns, "slice", "level", "outcome")
    )


def replay(actions: DataFrame, slice_of: Column) -> DataFrame:
    """As :func:`levelled`, with the ``restored_path`` of every successful undo.

    An undo returns to the entry last added at the level it leaves; that entry is carried along
    each level, again slice by slice.
    """
    order = ["at", "seq"]
    moves = levelled(actions, slice_of)
    spot = F.when(F.col("outcome") == "undone", F.col("level") + 1).when(F.col("outcome") == "added", F.col("level"))
    added = F.when(F.col("outcome") == "added", F.col("image_path"))
    in_slice = Window.partitionBy("key", "spot", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = moves.withColumn("spot", spot).withColumn("near", F.last(added, ignorenulls=True).over(in_slice))
    over_slices = Window.partitionBy("key", "spot").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        placed.filter("spot IS NOT NULL").groupBy("key", "spot", "slice")
        .agg(F.max_by("near", F.struct("at", "seq")).alias("last_here"))
        .withColumn("far", F.last("last_here", ignorenulls=True).over(over_slices))
        .select("key", "spot", "slice", "far")
    )
    return (
        placed.join(carried, ["key", "spot", "slice"], "left")
        .withColumn("restored_path", F.when(F.col("outcome") == "undone", F.coalesce("near", "far")))
        .select(*actions.columns, "level", "outcome", "restored_path")
    )


def final_state(moves: DataFrame) -> DataFrame:
    """Index, length, current image and possible moves per key after the whole log.

    Takes the result of :func:`levelled` (or :func:`replay`). Rows are first reduced per key and
    level, then per key; both steps are mergeable aggregates.
    """
    moment = F.struct("at", "seq")
    added = F.col("outcome") == "added"
    add_moment = F.when(added, moment)
    per_level = moves.groupBy("key", "level").agg(
        F.max(moment).alias("any_at"), F.max(add_moment).alias("add_at"), F.max_by("image_path", add_moment).alias("path"))
    return per_level.groupBy("key").agg(
        F.max_by(F.struct("level", "path"), F.col("any_at")).alias("now"),
        F.coalesce(F.max_by("level", F.col("add_at")), F.lit(0)).alias("history_length"),
    ).select(
        "key", F.col("now.level").alias("history_index"), "history_length",
        F.when(F.col("now.level") > 0, F.col("now.path")).alias("current_path"),
        (F.col("now.level") > 0).alias("can_undo"), (F.col("now.level") < F.col("history_length")).alias("can_redo"),
    )
