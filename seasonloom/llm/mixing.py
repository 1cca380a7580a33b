"""Document rates that bring the expected tokens of each domain to target weights.

A document belongs to domains softly.  A naive Bayes classifier over hashed words, fitted
on a labelled table, gives its posteriors p; with n tokens and rate r it adds r * n * p to
the domains' totals E.  Rates minimise the sum over domains of (E - target)^2 / (E at rate
one) under r >= ``least`` (0 or more), by projected gradient descent from r = 1.  Measured
in tokens, the gradient at a document is its posteriors times (E - target) / (E at one), and
the largest curvature is 1, so the step is 1 and needs no tuning.

A step needs the totals of all documents, one aggregate of as many numbers as domains; the
rate after any number of steps is a function of p and of the steps' gradients, so nothing
per document is kept for the result.  Steps go on until they converge; only soft posteriors
of skewed domains take more than ``REPLAY``, and those keep rates on the way.  Everything is column expressions: no shuffle beyond
the partial sums, and no join but with the labelled sample, which ``sample_rows`` bounds.

Defined cases: a text without words has no tokens, takes the domains' shares of the sample
as posteriors, and a rate from those; repeated rows repeat their rate; labelled rows with a
null id, an unknown domain or no document are ignored; a sample without any usable row gives
equal posteriors; an empty table has no rates and totals of zero.  Extra columns stay, and
one named like an output column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonloom.llm import rules
from seasonloom.session import stage, unstage

REPLAY = 60
SPACE = r"[\x20\x09-\x0D]+"


def _plus(terms: Sequence[Column]) -> Column:
    return reduce(Column.__add__, terms)


def words(text: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), upper, lower), SPACE), "")


def _numbers(values: Sequence[float]) -> Column:
    """An array constant; a delimited string keeps the plan small until it is folded."""
    return F.split(F.lit(",".join(f"{v:.7g}" for v in values)), ",").cast("array<double>")


@dataclass
class Classifier:
    """Log prior and log word weights per domain; ``strength`` words count at most."""

    domains: list[str]
    prior: list[float]
    weights: list[list[float]]
    strength: float = 20.0

    def measured(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``n_tokens`` and ``posterior`` (one number per domain)."""
        buckets = len(self.weights[0])
        hashed = F.transform(words(F.col(f"`{text}`")), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))

        def weighed(found: Column, weights: Column) -> Column:
            return F.aggregate(found, F.lit(0.0), lambda total, b: total + F.get(weights, b))

        def sums(found: Column) -> Column:
            total = [weighed(found, _numbers(w)) for w in self.weights]
            return F.struct(F.size(found).cast("long").alias("n"), F.array(*total).alias("s"))

        # Bound through a one-element array, so that the words are hashed once.
        kept = docs.drop("n_tokens", "posterior")
        # Helper columns under names that no column of the input has.
        found, log, odds = (rules.free_name(n, docs.columns) for n in ("sums", "log", "odds"))
        rows = kept.withColumn(found, F.element_at(F.transform(F.array(hashed), sums), 1))
        weight = F.lit(self.strength) / F.greatest(F.col(f"{found}.n").cast("double"), F.lit(self.strength))
        rows = rows.withColumn(log, F.zip_with(f"{found}.s", _numbers(self.prior), lambda s, prior: s * weight + prior))
        rows = rows.withColumn(odds, F.transform(log, lambda x: F.exp(x - F.array_max(log))))
        whole = F.aggregate(odds, F.lit(0.0), lambda total, x: total + x)
        rows = rows.withColumn("posterior", F.transform(odds, lambda x: x / whole))
        return rows.withColumn("n_tokens", F.col(f"{found}.n")).drop(found, log, odds)


def classifier(
    docs: DataFrame,
    labelled: DataFrame,
    domains: Sequence[str],
    sample_rows: int = 5000,
    buckets: int = 4096,
    text: str = "text",
) -> Classifier:
    """Naive Bayes from (doc_id, domain) rows of ``labelled``, ``sample_rows`` of them at most."""
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(*domains))
    known = known.groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id")).limit(sample_rows)
    sample = docs.select("doc_id", F.col(f"`{text}`").alias("t")).join(F.broadcast(known), "doc_id")
    bucket = F.pmod(F.xxhash64("w"), F.lit(buckets)).cast("int").alias("bucket")
    found = sample.select("domain", F.explode(words(F.col("t"))).alias("w")).groupBy("domain", bucket).count()
    counts = {d: [0.5] * buckets for d in domains}
    # At most buckets rows per domain.
    for row in found.collect():
        counts[row["domain"]][row["bucket"]] += row["count"]
    share = {d: 1.0 for d in domains}
    for row in known.groupBy("domain").count().collect():
        share[row["domain"]] += row["count"]
    total = sum(share.values())
    weights = []
    for d in domains:
        whole = sum(counts[d])
        weights.append([math.log(c / whole) for c in counts[d]])
    return Classifier(list(domains), [math.log(share[d] / total) for d in domains], weights)


@dataclass
class Rates:
    """The gradients that were stepped along, and how it ended."""

    least: float
    targets: list[float]
    gradients: list[list[float]] = field(default_factory=list)
    totals: list[float] = field(default_factory=list)
    converged: bool = False

    def column(self, posterior: str = "posterior", since: int = 0) -> Column:
        """Rate of a document, from its posteriors and, after ``since`` steps, its ``rate``."""
        if not self.gradients:
            return F.greatest(F.lit(1.0), F.lit(self.least))
        flat = [_numbers_row(g) for g in self.gradients[since:]]
        steps = F.split(F.lit(";".join(flat)), ";")
        steps = F.transform(steps, lambda s: F.split(s, ",").cast("array<double>"))

        def step(rate: Column, gradient: Column) -> Column:
            move = F.aggregate(
                F.zip_with(F.col(posterior), gradient, lambda p, g: p * g), F.lit(0.0), lambda total, x: total + x
            )
            return F.greatest(rate - move, F.lit(self.least))

        return F.aggregate(steps, F.col("rate") if since else F.lit(1.0), step)


def _numbers_row(values: Sequence[float]) -> str:
    return ",".join(repr(float(v)) for v in values)


def _totals(measured: DataFrame, rate: Column, n: int, least: float | None = None) -> tuple[list[float], np.ndarray]:
    """Expected tokens per domain; and, given ``least``, their curvature over rates above it.

    The curvature is the sum of tokens times posterior times posterior, domain by domain: how
    much the totals move with a step along the posteriors that no bound holds back.
    """
    rows = measured.select(F.col("n_tokens").alias("n"), F.col("posterior").alias("p"), rate.alias("r"))
    p = [F.get("p", F.lit(k)) for k in range(n)]
    sums = [F.sum(F.col("n") * F.col("r") * p[k]).alias(f"t{k}") for k in range(n)]
    pairs = [(k, j) for k in range(n) for j in range(k, n)] if least is not None else []
    free = F.when(F.col("r") > F.lit(least), F.col("n")) if pairs else None
    sums += [F.sum(free * p[k] * p[j]).alias(f"c{k}_{j}") for k, j in pairs]
    found = [x or 0.0 for x in rows.agg(*sums).first()]
    curvature = np.zeros((n, n))
    for (k, j), x in zip(pairs, found[n:], strict=True):
        curvature[k, j] = curvature[j, k] = x
    return found[:n], curvature


def _scaled(error: list[float], curvature: np.ndarray, one: list[float]) -> list[float]:
    """The step along the posteriors that would take the totals to their targets at once."""
    # Domains without tokens cannot be moved, and those that move together share the step.
    size = np.sqrt(np.array([o if o > 0 else np.inf for o in one]))
    step = np.linalg.lstsq(curvature / np.outer(size, size), np.array(error) / size, rcond=1e-9)[0]
    return (step / size).tolist()


def fit(
    measured: DataFrame,
    weights: dict[str, float],
    least: float = 0.0,
    budget: float | None = None,
    steps: int = 20_000,
    tolerance: float = 1e-6,
    must_converge: bool = True,
    scaled: bool = False,
) -> Rates:
    """Rates for staged rows of ``n_tokens`` and ``posterior`` (in the order of ``weights``).

    ``budget`` is the total of expected tokens, by default the tokens there are; with
    ``least`` of 1 it is the smallest total at which no domain has to give up tokens.
    It ends when no total moves by more than ``tolerance`` of itself.  If ``steps`` did not
    suffice it raises, or is only marked with ``must_converge`` off.  Rates are written every
    ``REPLAY`` steps, so that a step's cost does not grow with the steps before it.

    Each step is one pass.  A plain gradient step divides each domain's error by its tokens;
    soft posteriors then need hundreds.  ``scaled`` divides by the curvature that the same
    pass measures over the documents whose rates may still move, halves a step that does not
    bring the totals closer, and takes the plain step where halving does not help: a few to
    a few tens of passes.
    """
    share = [w / sum(weights.values()) for w in weights.values()]
    bound = least if scaled else None
    one, curvature = _totals(measured, F.lit(1.0), len(share), bound)
    if scaled and least >= 1:
        # Every rate starts at the bound, from which the first step may move all of them.
        curvature = _totals(measured, F.lit(1.0), len(share), -1.0)[1]
    if budget is None:
        budget = sum(one) if least < 1 else max((t / s for t, s in zip(one, share, strict=True) if s), default=0.0)
    result = Rates(least, [s * budget for s in share])
    error = lambda totals: [e - t for e, t in zip(totals, result.targets, strict=True)]
    apart = lambda totals: sum((x / o) ** 2 for x, o in zip(error(totals), one, strict=True) if o)
    at, rows, done = one, measured, 0

    def totals() -> tuple[list[float], np.ndarray]:
        return _totals(rows, result.column(since=done), len(share), bound)

    for _ in range(steps):
        if len(result.gradients) - done == REPLAY:
            rate = result.column(since=done).alias("rate")
            before, rows = rows, stage(rows.select("n_tokens", "posterior", rate), "mixing-rates")
            if done:
                unstage(before)
            done = len(result.gradients)
        plain = [x / o if o else 0.0 for x, o in zip(error(at), one, strict=True)]
        step = _scaled(error(at), curvature, one) if scaled else plain
        result.gradients.append(step)
        new, bent = totals()
        for _ in range(6 if scaled else 0):
            if apart(new) <= apart(at):
                break
            result.gradients[-1] = [x / 2 for x in result.gradients[-1]]
            new, bent = totals()
        if scaled and apart(new) > apart(at):
            result.gradients[-1] = plain
            new, bent = totals()
        moved = max((abs(a - b) / max(abs(b), 1e-9) for a, b in zip(new, at, strict=True)), default=0.0)
        at, curvature = new, bent
        if moved <= tolerance:
            result.converged = True
            break
    if done:
        unstage(rows)
    result.totals = at
    if must_converge and not result.converged:
        raise ValueError(f"mixing rates did not converge in {steps} steps: totals {at}, targets {result.targets}")
    return result


def replicated(rated: DataFrame, seed: int = 29, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row as often as its ``rate``: the whole part, and once more with the rest as odds.

    Every row draws for itself: by its key and text, and, where rows share both, by a number
    that tells them apart within their partition.
    """
    known = [F.col(f"`{c}`") for c in (key, text) if c in rated.columns]
    row = F.struct(F.monotonically_increasing_id().alias("at"), *known)
    draw = (F.pmod(F.xxhash64(F.lit(seed), row), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    kept = [F.col(f"`{c}`") for c in rated.columns if c != "rate"]
    return rated.select(F.struct(*kept).alias("row"), F.explode(F.array_repeat(F.lit(True), copies))).select("row.*")
