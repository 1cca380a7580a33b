"""Collision counting against brute force, and its edge rows."""

import os

import numpy as np
import pytest

from seasonloom.llm import collide, queries

ROOT = os.environ.get("TEST_SF_ROOT", "/root/testdata")


def exact(rows, k=20):
    ids = np.array([r[0] for r in rows])
    vectors = np.array([r[1] for r in rows], dtype=float)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[q]][:k]
        out[ids[q]] = [(ids[i], score[i]) for i in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    folder = f"{ROOT}/{sf}"
    rows = [(r.vec_id, r.embedding) for r in queries.table(spark, folder, "embeddings").collect()]
    truth = exact(rows)
    found = {}
    for r in queries.op1_collision_counting(spark, folder).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(found) == set(truth)
    hits = [len({v for v, _ in found[q].values()} & {v for v, _ in truth[q]}) / 20 for q in truth]
    assert np.mean(hits) >= 0.92
    at = {r[0]: np.array(r[1], dtype=float) for r in rows}
    for q, ranked in found.items():
        assert sorted(ranked) == list(range(1, 21))
        order = [ranked[k] for k in range(1, 21)]
        assert order == sorted(order, key=lambda x: (-x[1], x[0]))
        assert all(abs(at[q] @ at[v] - s) < 1e-12 for v, s in order)


def test_rows_that_take_no_part_ties_and_copies(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(1, 60)]
    same = [0.5] * 8
    rows += [(100 + k, same) for k in range(40)]
    bad = [(200, None), (220, [0.0] * 8), (240, [float("nan")] * 8), (260, [None] * 8), (280, [float("inf")] * 8), (None, same), (300, [])]
    lone = [(400, [1.0, 2.0]), (401, [3.0, 1.0])]
    table = spark.createDataFrame([(*r, 1) for r in rows + bad + lone], "vec_id long, embedding array<double>, score int")
    out = collide.search(table, table.where("vec_id % 20 = 0"), vector_block=16, query_block=2).collect()
    by = {}
    for r in out:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert set(by) == {20, 40, 100, 120, 400}
    assert [v for _, v in sorted(by[400])] == [401]
    others = [v for _, v in sorted(by[120]) if v >= 100]
    assert others == sorted(others) and 120 not in others and len(by[120]) == 20
    assert not {r.vec_id for r in out} & {200, 220, 240, 260, 280, 300, None}


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert collide.search(none, none).count() == 0
