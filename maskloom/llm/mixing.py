"""Mixing by soft membership: domain posteriors of each text, and rates whose expected totals meet targets."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from maskloom.llm.records import REGION_ID, TEXT, stored

#: Hashed word bins of the classifier, and about how many labelled texts its bin counts are taken from.
BINS, SAMPLE = 2048, 20_000
#: The part by which the default budget exceeds the least one, the factor by which it is raised, and steps between two written tables.
SLACK, RAISE, WRITTEN = 0.01, 1.1, 8
_BLANK = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class DomainModel:
    """Domains in order, with the log prior and the log probability of each word bin."""
    domains: list[str]
    priors: list[float]
    weights: list[list[float]]


def _words() -> Column:
    trimmed = F.btrim(F.coalesce(TEXT, F.lit("")), F.lit(_BLANK))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))


def _bin(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(BINS)).cast("int")


def fit_domains(labelled: DataFrame, regions: DataFrame, sample: int = SAMPLE) -> DomainModel:
    """Naive Bayes over hashed words, from ``labelled(region_id, domain)`` and the texts of ``regions``.

    Priors are the shares of the domains in all labelled rows; a null domain is no label. Bin counts come from about
    ``sample`` labelled texts, as many of each domain, or all that it has, chosen by the hash of their id, with one added to
    every bin. Without labels
    there is one domain, ``all``.
    """
    labelled = labelled.select(REGION_ID, F.col("domain").cast("string").alias("domain")).filter("domain IS NOT NULL")
    shares = {r.domain: r.n for r in labelled.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if not shares:
        return DomainModel(["all"], [0.0], [[0.0] * BINS])
    domains, total = sorted(shares), sum(shares.values())
    part = F.create_map(*[F.lit(v) for d in domains for v in (d, (1 << 30) * sample / len(domains) / shares[d])])[F.col("domain")]
    drawn = labelled.filter(F.pmod(F.xxhash64(REGION_ID, F.lit(3)), F.lit(1 << 30)) < part).limit(2 * sample)
    counts = (regions.select(REGION_ID, _words().alias("words")).join(F.broadcast(drawn), REGION_ID)
              .select("domain", F.explode("words").alias("word")).select("domain", _bin(F.col("word")).alias("bin"))
              .groupBy("domain", "bin").agg(F.count("*").alias("n")).collect())
    table = {d: [1.0] * BINS for d in domains}
    for r in counts:
        table[r.domain][r.bin] += r.n
    return DomainModel(domains, [math.log(shares[d] / total) for d in domains],
                       [[math.log(n / sum(table[d])) for n in table[d]] for d in domains])


def memberships(regions: DataFrame, model: DomainModel, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default ``region_id``), ``n_tokens`` and ``posterior``, an array in the order of ``model.domains``.

    The evidence of a text's n words counts as that of sqrt(n), as words of one text depend on each other, so
    membership stays soft. A null or empty text has no words and gets the priors. One row per row; column
    expressions only.
    """
    keep = [f"`{c}`" for c in (keep if keep is not None else [REGION_ID])]
    bins = regions.select(*keep, F.transform(_words(), _bin).alias("_bins"))
    scale = F.sqrt(F.greatest(F.size("_bins"), F.lit(1)))

    def evidence(prior: float, weights: list[float]) -> Column:
        literal = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
        return F.lit(prior) + F.aggregate("_bins", F.lit(0.0), lambda sum_, b: sum_ + F.get(literal, b)) / scale

    scored = bins.select(*keep, F.size("_bins").cast("bigint").alias("n_tokens"),
                         F.array(*[evidence(p, w) for p, w in zip(model.priors, model.weights)]).alias("_score"))
    shifted = scored.select(*keep, "n_tokens", F.transform("_score", lambda s: F.exp(s - F.array_max("_score"))).alias("_odds"))
    return shifted.select(*keep, "n_tokens", F.transform(
        "_odds", lambda o: o / F.aggregate("_odds", F.lit(0.0), lambda a, b: a + b)).alias("posterior"))


@dataclass(frozen=True)
class Rates:
    """A rate begins at 1. A step ``(momentum, c_1, .., c_k)`` moves it on by ``momentum`` of its last change, takes ``posterior . c`` from
    it, and puts it back to ``least`` if it falls below.

    ``totals`` are the expected token totals of the domains, ``missed`` is the largest miss as a part of the budget.
    """
    steps: list[list[float]]
    totals: list[float]
    targets: list[float]
    least: float = 0.0
    missed: float = 0.0

    def column(self) -> Column:
        """The rate as an expression of ``n_tokens`` and ``posterior``; a text without tokens keeps rate 1."""
        start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("before"))
        return F.when(F.col("n_tokens") > 0, _stepped(start, self.steps, self.least)["rate"]).otherwise(F.lit(1.0))


def _stepped(state: Column, steps: list[list[float]], least: float) -> Column:
    """``state(rate, before)`` after these steps: a fold over a constant array, as nested expressions of many steps would not compile."""
    if not steps:
        return state

    def moved(s: Column, step: Column) -> Column:
        dot = reduce(lambda a, b: a + b, [F.get("posterior", F.lit(k - 1)) * F.get(step, F.lit(k)) for k in range(1, len(steps[0]))])
        ahead = s["rate"] + F.get(step, F.lit(0)) * (s["rate"] - s["before"])
        return F.struct(F.greatest(F.lit(least), ahead - dot).alias("rate"), s["rate"].alias("before"))

    whole = F.array(*[F.array(*[F.lit(float(v)) for v in step]) for step in steps])
    return F.aggregate(whole, state, moved)


def _descended(members: DataFrame, targets: np.ndarray, present: np.ndarray, used: np.ndarray, least: float, steps: int, goal: float) -> tuple:
    """Steps of the accelerated projected gradient on ``sum_k (total_k - target_k)^2 / size_k``, and the totals they lead to.

    The size of a domain is its target or its present total, whichever is larger. The gradient for a text is ``posterior . miss /
    size``, the same few numbers for all texts, so a step is one aggregation. As posteriors sum to 1 and no size is below what is
    present, a plain step of length 1 never raises the loss. Steps have momentum; one that raises the loss is taken
    back and momentum begins anew. Rates are written every ``WRITTEN`` steps. Steps end when they lower the loss no more.
    """
    p = [F.get("posterior", F.lit(i)) for i in range(len(targets))]
    scale = np.where(used, 1.0 / np.where(used, np.maximum(present, targets), 1.0), 0.0)
    one = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("before"))
    rated, since = members.filter("n_tokens > 0").select("n_tokens", "posterior", one.alias("_state")), []
    taken, totals, before, pace = [], present, present, 1.0

    def loss(of: np.ndarray) -> float:
        return float(scale @ (of - targets) ** 2)

    losses = [loss(totals)]
    for _ in range(steps):
        if np.abs(totals - targets)[used].max() <= goal:
            break
        faster = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        momentum = (pace - 1) / faster
        step = [momentum, *(scale * (totals + momentum * (totals - before) - targets)).tolist()]
        after = rated.select("n_tokens", "posterior", _stepped(F.col("_state"), [*since, step], least)["rate"].alias("_rate"))
        found = np.array(after.agg(*[F.sum(F.col("n_tokens") * q * F.col("_rate")) for q in p]).first(), float)
        if loss(found) > losses[-1]:
            if not momentum:
                break
            pace = 1.0
            continue
        taken.append(step)
        since.append(step)
        before, totals, pace = totals, found, faster
        losses.append(loss(found))
        if len(losses) > 10 and losses[-1] > (1 - 1e-5) * losses[-10]:
            break
        if len(since) == WRITTEN:
            rated, since = stored(rated.select("n_tokens", "posterior", _stepped(F.col("_state"), since, least).alias("_state")), "rates"), []
    return taken, totals


def fit_rates(members: DataFrame, model: DomainModel, weights: dict[str, float], budget: float | None = None,
              steps: int = 60, tolerance: float = 1e-4) -> Rates:
    """Rates whose expected token totals are ``weights`` of ``budget`` tokens, by projected-gradient least squares from rate 1.

    With ``t`` the tokens and ``p`` the posterior of a text, the total of domain k is ``sum r t p_k``. Every step goes against the
    gradient of the squared misses, each over the larger of the domain's target and present total, with momentum, and rates are put back to the allowed
    ones. All texts count. Steps end when every miss is under ``tolerance`` of the budget, when they no longer lower the loss, or
    after ``steps`` of them. Where targets cannot be met, they lead towards the nearest mix in this measure. Rates stay
    finite, as no step kept raises the loss; ``missed`` says by how much they miss, and there is a warning.

    Without ``budget`` no text is lost: rates are 1 at least, domains that ``weights`` does not name keep their share, and
    the budget is the least at which no present domain has to shrink. It is raised by ``RAISE`` as long as targets are missed and
    a raise lowers the largest miss by a tenth; of all budgets tried the one with the least miss is kept. A given budget, or
    a present domain with weight 0, allows rates down to 0, and with a budget a domain without weight has target 0. Domains that
    no text belongs to are left out. Without tokens all rates stay 1, and a text without tokens keeps rate 1.
    """
    k = len(model.domains)
    first = members.agg(*[F.sum(F.col("n_tokens") * F.get("posterior", F.lit(i))).alias(f"s{i}") for i in range(k)]).first()
    present = np.array([first[f"s{i}"] or 0.0 for i in range(k)])
    whole = float(present.sum())
    asked = np.array([max(weights.get(d, 0.0), 0.0) for d in model.domains])
    if not whole or not asked.sum():
        return Rates([], present.tolist(), present.tolist())
    used = present > 1e-9 * whole
    if budget is None:
        named = np.array([d in weights for d in model.domains])
        rest = np.where(named, 0.0, present / whole)
        shares = rest + asked / asked.sum() * (1 - rest.sum())
        least = 0.0 if (used & (shares <= 0)).any() else 1.0
        budget = (1 + SLACK) * float((present[shares > 0] / shares[shares > 0]).max())
        raised = bool(least)
    else:
        shares, least, raised = asked / asked.sum(), 0.0, False
    best = None
    while True:
        targets = shares * budget
        taken, totals = _descended(members, targets, present, used, least, steps, tolerance * budget)
        missed = float(np.abs(totals - targets)[used].max()) / budget
        last, found = best, Rates(taken, totals.tolist(), targets.tolist(), least, missed)
        best = found if best is None or missed < best.missed else best
        if missed <= tolerance or not raised or (last is not None and missed > 0.9 * last.missed):
            break
        budget *= RAISE
    if best.missed > tolerance:
        warnings.warn(f"rates miss their targets by up to {best.missed:.2%} of the budget", stacklevel=2)
    return best


def copies(rate: Column, region_id: Column) -> Column:
    """How often a text enters the mix: the whole part of its rate, and one more with the probability of the rest."""
    draw = F.pmod(F.xxhash64(region_id, F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def mixed_rates(regions: DataFrame, labelled: DataFrame, weights: dict[str, float],
                budget: float | None = None) -> tuple[DataFrame, DomainModel, Rates]:
    """Memberships of all regions in a stored table, the classifier, and the rates that meet ``weights``."""
    model = fit_domains(labelled, regions)
    members = stored(memberships(regions, model), "memberships")
    return members, model, fit_rates(members, model, weights, budget)
