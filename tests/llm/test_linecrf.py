"""The line field: messages against enumeration, measures, held-out accuracy, edge cases."""

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa

from seasonloom.llm import linecrf as crf
from seasonloom.llm import queries

SF = f"{os.environ.get('TEST_SF_ROOT', '/root/testdata')}/sf0.01"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    bounds = np.array([0, 4, 4, 5, 8])
    score, switch = rng.normal(size=8), rng.normal(size=(2, 2))
    good, expected = crf.marginals(score, switch, crf.Chains.of(bounds), pairs=True)
    total = np.zeros((2, 2))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if a == b:
            continue
        weight, ones, moves = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(s for s, label in zip(score[a:b], y, strict=True) if label) + sum(switch[p, q] for p, q in itertools.pairwise(y)))
            weight += w
            ones += w * np.array(y)
            for p, q in itertools.pairwise(y):
                moves[p, q] += w
        assert np.allclose(good[a:b], ones / weight)
        total += moves / weight
    assert np.allclose(expected, total)


def test_measures_of_lines():
    lines = crf.measure(pa.array(["One two two\n\n a|b #1\nOne two two", None, "", " \n"]))
    assert lines.bounds.tolist() == [0, 3, 3, 3, 3]
    named = {n: lines.measures[:, k].tolist() for k, n in enumerate(crf.MEASURES)}
    assert named["seen_before"] == [0, 0, 1]
    assert np.allclose(named["repeat_1"], [1 / 3, 0, 1 / 3])
    assert np.allclose(named["distinct"], [2 / 3, 1, 2 / 3])
    assert np.allclose(named["pipe"], [0, 0.5, 0]) and np.allclose(named["symbol"], [0, 0.5, 0])


def test_held_out_accuracy_and_edge_rows(spark):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    model = crf.train(docs, labels, sample_rows=400)
    out = crf.score(docs, model).join(labels, "doc_id").select("quality", "score", crf.held_out().alias("h")).collect()
    test = [(r.quality, r.score >= 0.3) for r in out if r.h]
    assert len(test) > 40 and np.mean([q == p for q, p in test]) > 0.95
    edge = spark.createDataFrame(
        [(1, None, 0.5), (2, "", 0.5), (3, "plain words here", 0.1), (3, "plain words here", 0.1), (None, "x " * 300_000, 0.0)],
        "doc_id long, text string, score double",
    )
    rows = crf.score(edge, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert [r.score for r in rows if r.doc_id in (1, 2)] == [0, 0]
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert crf.score(edge.limit(0), model).count() == 0


def test_one_class_or_no_label(spark):
    docs = spark.createDataFrame([(k, f"words {k}") for k in range(20)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert {r.score for r in crf.score(docs, crf.train(docs, none)).collect()} == {0.5}
    good = spark.createDataFrame([(k, 1) for k in range(20)], "doc_id long, quality int")
    assert {r.score for r in crf.score(docs, crf.train(docs, good)).collect()} == {1.0}


def test_short_ids_hot_ids_and_struct_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(k, "a plain line of words\n" * 900 if k % 2 else "### $$$ !!\n" * 900) for k in range(1, 30)] + [(1, "copy of one\n")] * 50
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)], "doc_id int, quality int")
    seen = []
    original = crf.fit
    monkeypatch.setattr(crf, "fit", lambda parts, chain: seen.extend(parts) or original(parts, chain, steps=5))
    model = crf.train(docs, labels, sample_lines=64)
    learned = [k for k in range(1, 30) if zlib.crc32(str(k).encode()) % 5]
    assert len(seen) == len(learned) and max(len(lines) for _, lines in seen) <= 64
    plain = sorted((r.doc_id, r.score) for r in crf.score(docs, model).collect())
    packed = crf.score(docs.select(F.struct("*").alias("row")), model, "row.text")
    assert sorted((r.row.doc_id, r.score) for r in packed.collect()) == plain
