"""Mixing rates against a dense solver, the classifier, replication and edge rows."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonloom.llm import mixing, queries

SF = f"{os.environ.get('TEST_SF_ROOT', '/root/testdata')}/sf0.01"


def dense(n, p, targets, least, steps):
    one = (n[:, None] * p).sum(axis=0)
    r = np.ones(len(n))
    for _ in range(steps):
        e = ((n * r)[:, None] * p).sum(axis=0)
        r = np.maximum(r - p @ ((e - targets) / one), least)
    return r


@pytest.mark.parametrize("least", [0.0, 1.0])
def test_rates_meet_targets_and_equal_the_dense_descent(spark, least):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.1, 0.2, 0.3], size=400)
    n = rng.integers(0, 500, size=400).astype(float)
    rows = [(k, int(a), b.tolist()) for k, (a, b) in enumerate(zip(n, p, strict=True))]
    measured = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>")
    weights = {"a": 2, "b": 1, "c": 1}
    rates = mixing.fit(measured, weights, least=least, tolerance=1e-4)
    if least == 0:
        assert rates.converged and np.allclose(rates.totals, rates.targets, rtol=1e-3)
    found = dict(measured.select("doc_id", rates.column()).collect())
    expected = dense(n, p, np.array(rates.targets), least, len(rates.gradients))
    assert np.allclose([found[k] for k in range(400)], expected, atol=1e-9)
    assert min(found.values()) >= least


def test_soft_posteriors_of_skewed_domains_reach_the_targets(spark):
    rng = np.random.default_rng(3)
    domain = rng.choice(4, size=400, p=[0.01, 0.01, 0.01, 0.97])
    p = np.full((400, 4), 0.05)
    p[np.arange(400), domain] = 0.85
    rows = [(k, int(a), b.tolist()) for k, (a, b) in enumerate(zip(rng.integers(50, 500, size=400), p, strict=True))]
    measured = spark.createDataFrame(rows, "doc_id long, n_tokens long, posterior array<double>").coalesce(1)
    rates = mixing.fit(measured, {"a": 2, "b": 1, "c": 1, "d": 1})
    assert rates.converged and len(rates.gradients) > 60
    assert np.allclose(rates.totals, rates.targets, rtol=1e-3)
    total = sum(r.n_tokens * r.rate * np.array(r.posterior) for r in measured.select("*", rates.column().alias("rate")).collect())
    assert np.allclose(total, rates.targets, rtol=1e-3)
    with pytest.raises(ValueError, match="did not converge"):
        mixing.fit(measured, {"a": 2, "b": 1, "c": 1, "d": 1}, steps=3)
    assert not mixing.fit(measured, {"a": 2, "b": 1, "c": 1, "d": 1}, steps=3, must_converge=False).converged


def test_query_reaches_the_language_weights(spark):
    rows = queries.op9_soft_mixing(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in queries.table(spark, SF, "documents").collect()}
    assert len(rows) == len(lang)
    total = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in queries.LANGUAGE_WEIGHTS}
    for d, w in queries.LANGUAGE_WEIGHTS.items():
        assert total[d] / sum(total.values()) == pytest.approx(w, abs=1e-3)
    right = [max(queries.LANGUAGE_WEIGHTS, key=lambda d: r[f"p_{d}"]) == lang[r.doc_id] for r in rows if r.n_tokens >= 20]
    assert np.mean(right) > 0.95
    assert all(abs(sum(r[f"p_{d}"] for d in queries.LANGUAGE_WEIGHTS) - 1) < 1e-9 for r in rows)


def test_edge_rows(spark):
    docs = spark.createDataFrame(
        [(1, "uno dos tres", 9), (2, "one two three", 9), (2, "one two three", 9), (3, None, 9), (None, "", 9), (4, "one " * 200_000, 9)],
        "doc_id long, text string, posterior int",
    )
    labelled = spark.createDataFrame([(1, "es"), (2, "en"), (None, "en"), (4, None), (9, "xx")], "doc_id long, domain string")
    model = mixing.classifier(docs, labelled, ["en", "es"])
    out = model.measured(docs).collect()
    assert [r.n_tokens for r in out] == [3, 3, 3, 0, 0, 200_000]
    assert out[0].posterior[1] > 0.5 > out[1].posterior[1]
    assert out[1].posterior == out[2].posterior and out[3].posterior == out[4].posterior
    none = mixing.classifier(docs, labelled.limit(0), ["en", "es"]).measured(docs).collect()
    assert all(r.posterior == pytest.approx([0.5, 0.5]) for r in none)
    empty = mixing.fit(model.measured(docs.limit(0)), {"en": 1, "es": 1})
    assert empty.totals == [0, 0]


def test_rows_are_replicated_by_rate(spark):
    rated = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 4 * 0.75).alias("rate"), F.lit(1).alias("x"))
    count = {r.doc_id: r["count"] for r in mixing.replicated(rated).groupBy("doc_id").count().collect()}
    assert all(int(k % 4 * 0.75) <= count.get(k, 0) <= int(k % 4 * 0.75) + 1 for k in range(2000))
    assert sum(count.values()) == pytest.approx(2000 * 1.125, rel=0.05)


def test_posteriors_by_brute_force_beside_columns_of_any_name(spark):
    import math
    import re

    texts = ["ein Haus und ein Hund", "a house and a dog", None, "", "the dog the dog " * 30, "Haus"]
    docs = spark.createDataFrame(
        [(k, t, k, k + 1, k + 2) for k, t in enumerate(texts)], "doc_id long, text string, sums int, log int, odds int"
    )
    labelled = spark.createDataFrame([(0, "de"), (1, "en"), (4, "en"), (5, "de")], "doc_id long, domain string")
    model = mixing.classifier(docs, labelled, ["en", "de"], buckets=64)
    out = {r.doc_id: r for r in model.measured(docs).collect()}
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, t in enumerate(texts)}
    hashed = {w: int(h) for w, h in spark.createDataFrame([(w,) for ws in words.values() for w in set(ws)], "w string").select(
        "w", F.pmod(F.xxhash64("w"), F.lit(64))).collect()}
    counts = {"en": [0.5] * 64, "de": [0.5] * 64}
    for k, domain in ((0, "de"), (1, "en"), (4, "en"), (5, "de")):
        for w in words[k]:
            counts[domain][hashed[w]] += 1
    for k, ws in words.items():
        score = []
        for domain in ("en", "de"):
            total = sum(math.log(counts[domain][hashed[w]] / sum(counts[domain])) for w in ws)
            score.append(math.log(3 / 6) + total * 20 / max(len(ws), 20))
        odds = [math.exp(x - max(score)) for x in score]
        assert out[k].posterior == pytest.approx([o / sum(odds) for o in odds], rel=1e-5)
        assert (out[k].n_tokens, out[k].sums, out[k].log, out[k].odds) == (len(ws), k, k + 1, k + 2)


@pytest.mark.parametrize("least", [0.0, 1.0])
@pytest.mark.parametrize("softness", [0.05, 0.3, 0.5])
def test_scaled_steps_reach_the_targets_in_few_passes(spark, least, softness):
    rng = np.random.default_rng(8)
    domain = rng.choice(4, size=600, p=[0.01, 0.02, 0.3, 0.67])
    p = np.full((600, 4), softness / 4)
    p[np.arange(600), domain] += 1 - softness
    n = rng.integers(1, 900, size=600)
    rows = [(int(a), b.tolist()) for a, b in zip(n, p, strict=True)]
    measured = spark.createDataFrame(rows, "n_tokens long, posterior array<double>")
    rates = mixing.fit(measured, {"a": 0.2, "b": 0.2, "c": 0.2, "d": 0.4}, least=least, scaled=True)
    assert rates.converged and len(rates.gradients) <= 40
    assert min(r[0] for r in measured.select(rates.column()).collect()) >= least
    if least == 0:
        assert np.allclose(rates.totals, rates.targets, rtol=1e-4)


def test_scaled_steps_without_documents_or_domains(spark):
    schema = "n_tokens long, posterior array<double>"
    for rows in ([], [(0, [0.5, 0.5])], [(10, [1.0, 0.0])]):
        rates = mixing.fit(spark.createDataFrame(rows, schema), {"a": 1, "b": 1}, scaled=True)
        assert rates.converged
