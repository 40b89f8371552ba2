"""Quality rules: text statistics, and decision lists learned from labelled ones by sequential covering."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from maskloom.llm.records import REGION_ID, TEXT, stored

_BLANK = " \t\n\x0b\f\r"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_upper", "n_marks"]

#: What a condition may test: shares and means of the counts, so that long and short texts compare.
STATISTICS = {
    "n_words": "cast(n_words AS double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "cast(n_dup_lines AS double)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
}


def text_statistics(regions: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Counts of each whole ``original_text``, beside ``keep`` (default: ``region_id``); one row per row.

    ``n_words``; ``word_chars``, code points in words; ``n_symbols``, characters of ``#*$%&|<>``; ``n_dup_lines``,
    lines with a word that equal an earlier line; ``n_repeat_words``, words in five-word windows that occur
    twice or more in the text, the first included; ``n_distinct_words``; ``n_upper``, letters A to Z; ``n_marks``,
    ``!`` and ``?``. All are 0 for a null or empty text. ``keep`` columns must not bear these names.

    Column expressions only. Windows are compared by a 64-bit hash; a text without two equal hashes is not
    looked at again, others sort their windows once, so a text of n words costs n log n at most.
    """
    keep = [f"`{c}`" for c in (keep if keep is not None else [REGION_ID])]
    text = F.coalesce(TEXT, F.lit(""))
    trimmed = F.btrim(text, F.lit(_BLANK))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != "")

    def kept_only(signs: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{signs}]+", ""))

    first = regions.select(
        *keep, words.alias("_words"), lines.alias("_lines"), kept_only("#*$%&|<>").alias("n_symbols"),
        kept_only("A-Z").alias("n_upper"), kept_only("!?").alias("n_marks"))
    starts = F.sequence(F.lit(0), F.size("_words") - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)]))
    second = first.select(
        *keep, "n_symbols", "n_upper", "n_marks",
        F.size("_words").alias("n_words"), F.length(F.array_join("_words", "")).alias("word_chars"),
        F.size(F.array_distinct("_words")).alias("n_distinct_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("n_dup_lines"),
        F.when(F.size("_words") >= WINDOW, hashes).alias("_hashes"))
    third = second.select(
        *keep, "n_symbols", "n_upper", "n_marks", "n_words", "word_chars", "n_distinct_words", "n_dup_lines",
        F.when(F.size("_hashes") > F.size(F.array_distinct("_hashes")),
               F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"))

    def hash_at(k: Column) -> Column:
        return F.get(F.col("_sorted"), k)["h"]

    repeated = F.filter("_sorted", lambda s, k: s["h"].eqNullSafe(hash_at(k + 1)) | ((k > 0) & s["h"].eqNullSafe(hash_at(k - 1))))
    fourth = third.select(
        *keep, "n_symbols", "n_upper", "n_marks", "n_words", "word_chars", "n_distinct_words", "n_dup_lines",
        F.sort_array(F.transform(repeated, lambda s: s["i"])).alias("_places"))
    covered = F.aggregate(
        F.transform("_places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_places"), k + 1) - p, F.lit(WINDOW)))),
        F.lit(0), lambda a, n: a + n)
    # A generator of one row keeps conditions on the counts above it: pushed below, each would count anew.
    row = F.struct(*[F.col(c).cast("bigint").alias(c) for c in COUNTS if c != "n_repeat_words"],
                   F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))
    return fourth.select(*keep, F.inline_outer(F.array(row))).select(*keep, *COUNTS)


@dataclass(frozen=True)
class Condition:
    """``statistic >= threshold``, or ``<`` if ``below``."""
    statistic: str
    below: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(STATISTICS[self.statistic])
        return value < self.threshold if self.below else value >= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'<' if self.below else '>='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one conditional expression over the counts: the first rule that holds rejects."""
    return reduce(lambda case, rule: case.when(_holds(rule), F.lit(False)), rules, F.when(F.lit(False), F.lit(False))).otherwise(F.lit(True))


def _holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.column() for c in rule])


def learn_rules(statistics: DataFrame, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.97,
                min_covered: int = 3, quantiles: int = 24) -> list[Rule]:
    """Rules that reject, from the counts of ``text_statistics`` and ``quality`` (1 keep, 0 reject; others ignored).

    Thresholds are quantiles of each statistic within either class. Two thirds of the rows grow a rule, adding
    the condition with the best information gain until no row to keep is left; the others prune it, dropping
    last conditions as long as (rejected - kept) / (rejected + kept) does not fall. A rule joins the list if
    its share of rows to reject among the pruning rows is at least ``min_precision`` and it covers
    ``min_covered`` of them; its rows are then set aside and the next rule is grown. Learning ends
    at the first rule that fails, or at ``max_rules``.

    All labelled rows count. They are binned and added up into cells once; each step is one small
    aggregation over the cells, of which the driver sees at most two rows per threshold. No labelled rows, or
    one class only, gives no rules. Equal gains are settled by the order of ``STATISTICS``. Repeated rows count
    as often as they occur.
    """
    rows = statistics.filter("quality IN (0, 1)")
    steps = [(k + 0.5) / quantiles for k in range(quantiles)]
    cuts = rows.groupBy("quality").agg(*[
        F.percentile_approx(F.expr(e), steps, 10000).alias(s) for s, e in STATISTICS.items()]).collect()
    if len(cuts) < 2:
        return []
    thresholds = {s: sorted({v for row in cuts for v in row[s]}) for s in STATISTICS}
    binned = rows.select(
        F.col("quality").cast("int").alias("quality"), (F.pmod(F.xxhash64(REGION_ID), F.lit(3)) == 0).alias("prune"),
        *[reduce(lambda a, b: a + b, [(F.expr(e) >= t).cast("int") for t in thresholds[s]]).alias(s)
          for s, e in STATISTICS.items()])
    cells = stored(binned.groupBy("quality", "prune", *STATISTICS).agg(F.count("*").alias("n")), "cells")

    rules: list[Rule] = []
    left = cells
    while len(rules) < max_rules:
        grown = _grow(left, thresholds, max_conditions)
        if not grown:
            break
        rule, good = _pruned(left, grown, min_precision, min_covered)
        if not good:
            break
        rules.append(tuple(Condition(s, below, thresholds[s][k]) for s, below, k in rule))
        left = left.filter(~_in_bins(rule))
    return rules


def _in_bins(rule: list[tuple]) -> Column:
    # A value in bin b has passed b thresholds, so it is below threshold k if b <= k.
    return reduce(lambda a, b: a & b, [F.col(s) <= k if below else F.col(s) > k for s, below, k in rule], F.lit(True))


def _grow(cells: DataFrame, thresholds: dict, most: int) -> list[tuple]:
    rule: list[tuple] = []
    growing = cells.filter("NOT prune")
    pairs = F.array(*[F.struct(F.lit(s).alias("statistic"), F.col(s).alias("bin")) for s in STATISTICS])
    while len(rule) < most:
        seen = (growing.filter(_in_bins(rule)).select("quality", "n", F.inline(pairs))
                .groupBy("statistic", "bin").agg(
                    F.sum(F.when(F.col("quality") == 0, F.col("n")).otherwise(0)).alias("p"),
                    F.sum(F.when(F.col("quality") == 1, F.col("n")).otherwise(0)).alias("n")).collect())
        count = {(r.statistic, r.bin): (r.p, r.n) for r in seen}
        whole_p, whole_n = (sum(v[i] for (s, _), v in count.items() if s == "n_words") for i in (0, 1))
        if not whole_p or not whole_n:
            break
        best, best_gain = None, 1e-9
        for s in STATISTICS:
            p = n = 0
            for k in range(len(thresholds[s])):
                add_p, add_n = count.get((s, k), (0, 0))
                p, n = p + add_p, n + add_n
                for below, a, b in ((True, p, n), (False, whole_p - p, whole_n - n)):
                    if a and a + b < whole_p + whole_n:
                        gain = a * (math.log2(a / (a + b)) - math.log2(whole_p / (whole_p + whole_n)))
                        if gain > best_gain:
                            best, best_gain = (s, below, k), gain
        if best is None:
            break
        rule.append(best)
    return rule


def _pruned(cells: DataFrame, rule: list[tuple], min_precision: float, min_covered: int) -> tuple[list[tuple], bool]:
    sums = []
    for k in range(1, len(rule) + 1):
        for q in (0, 1):
            sums.append(F.coalesce(F.sum(F.when(_in_bins(rule[:k]) & (F.col("quality") == q), F.col("n"))), F.lit(0)))
    row = cells.filter("prune").agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).first()
    worth = [((row[2 * k] - row[2 * k + 1]) / max(row[2 * k] + row[2 * k + 1], 1), -k) for k in range(len(rule))]
    k = -max(worth)[1]
    p, n = row[2 * k], row[2 * k + 1]
    return rule[:k + 1], p >= min_covered and p >= min_precision * (p + n)


def base_failed() -> Column:
    """Fewer than ten words, or over a fifth of the words in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
