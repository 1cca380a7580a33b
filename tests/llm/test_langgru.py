import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from seasonloom.llm import langgru, queries

FOLDER = f"{os.environ.get('TEST_SF_ROOT', '/root/testdata')}/sf0.01"
TINY = langgru.Settings(width=16, units=4, epochs=60, batch=8)


def _plain_states(weights, side, window):
    """One window, one unit at a time."""
    gate_in, gate_state, new_in, new_state, bias = (weights[f"{side}_{n}"].astype(float) for n in langgru._NAMES[:5])
    units = len(bias)
    h, out = [0.0] * units, {}
    sigma = lambda x: 1 / (1 + math.exp(-x))
    for t in range(len(window)) if side == "forward" else reversed(range(len(window))):
        byte = window[t]
        gate = [sigma(gate_in[byte][k] + sum(h[m] * gate_state[m][k] for m in range(units))) for k in range(2 * units)]
        new = [
            math.tanh(new_in[byte][k] + gate[units + k] * (bias[k] + sum(h[m] * new_state[m][k] for m in range(units))))
            for k in range(units)
        ]
        h = [(1 - gate[k]) * new[k] + gate[k] * h[k] for k in range(units)]
        out[t] = h
    return [out[t] for t in range(len(window))]


def _plain_document(model, text):
    """Mean probabilities of a text, window by window and byte by byte."""
    raw = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in text.encode())
    sums, n = [0.0] * len(model.languages), 0
    for k in range(0, len(raw), model.width):
        window = raw[k : k + model.width]
        size = min(model.width, max(8, 1 << (len(window) - 1).bit_length()))
        window += b"\n" * (size - len(window))
        sides = {s: _plain_states(model.weights, s, window) for s in ("forward", "backward")}
        for t, byte in enumerate(window):
            if not (97 <= byte <= 122 or byte >= 128):
                continue
            score = [
                float(model.weights["bias"][c])
                + sum(h * float(model.weights[f"{s}_out"][m][c]) for s in sides for m, h in enumerate(sides[s][t]))
                for c in range(len(model.languages))
            ]
            odds = [math.exp(x - max(score)) for x in score]
            sums = [x + o / sum(odds) for x, o in zip(sums, odds, strict=True)]
            n += 1
    return [x / max(n, 1) for x in sums]


def test_slopes_equal_differences():
    rng = np.random.default_rng(1)
    weights = langgru.initial(3, 4, 5, np.float64)
    data = rng.integers(97, 104, (9, 6)).astype(np.uint8)
    data[6:, 2] = 0x0A
    label = rng.integers(0, 3, 6)
    _, slope = langgru.gradient(weights, data, label)
    for name, w in weights.items():
        places = [np.unravel_index(k, w.shape) for k in rng.integers(0, w.size, 6)]
        places += [np.unravel_index(np.abs(slope[name]).argmax(), w.shape)]
        for at in places:
            loss = []
            for step in (1e-5, -1e-5):
                w[at] += step
                loss.append(langgru.gradient(weights, data, label)[0])
                w[at] -= step
            assert slope[name][at] == pytest.approx((loss[0] - loss[1]) / 2e-5, abs=1e-7, rel=1e-4)


def test_pooled_probabilities_equal_a_plain_network():
    model = langgru.Model(["a", "b", "c"], langgru.initial(3, 4, 2), 16)
    texts = ["Plain words, seventeen+ bytes of them: ÄÖ.", "x", "", "12 34", "été " * 20, "abc def"]
    got = model.pooled(pa.array(texts), block=2)
    for row, text in zip(got, texts, strict=True):
        assert row.tolist() == pytest.approx(_plain_document(model, text), abs=2e-5)


def test_held_out_accuracy_and_rows_of_the_query(spark):
    docs = {r.doc_id: r for r in queries.table(spark, FOLDER, "documents").collect()}
    rows = queries.op11_byte_gru(spark, FOLDER).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert set(rows[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    for held in (True, False):
        part = [r for r in rows if r.held_out == held]
        assert sum(r.lang_pred == docs[r.doc_id].lang for r in part) >= 0.97 * len(part)


def test_only_sampled_rows_are_learned_from(spark):
    schema = "doc_id long, text string, lang string"
    docs = [(k, "alpha beta " * 5, "x") if k % 2 else (k, "ωμέγα δέλτα " * 5, "y") for k in range(20)]
    docs += [(50, "zzz", None), (51, None, "q"), (52, "", "q"), (53, "123", "q"), (54, "alpha " * 1000, "x")]
    model = langgru.train(spark.createDataFrame(docs, schema), TINY)
    assert model.languages == ["q", "x", "y"]
    asked = [None, "", "123 !?", "alpha", "ωμέγα", "×÷", "日本", "Alpha " * 50_000]
    rows = spark.createDataFrame([(k, t, "z", 3.0) for k, t in enumerate(asked)], "doc_id int, text string, lang_pred string, width double")
    out = {r.doc_id: r for r in langgru.predict(rows, model).collect()}
    assert [out[k].lang_pred for k in (0, 1, 2, 5)] == ["und"] * 4 and {out[k].score for k in (0, 1, 2, 5)} == {0.0}
    assert out[3].lang_pred == out[7].lang_pred == "x" and out[4].lang_pred == "y" and out[6].lang_pred != "und"
    assert out[3].width == 3.0
    assert langgru.predict(rows.limit(0), model).count() == 0


def test_nothing_or_one_language_to_learn(spark):
    schema = "doc_id long, text string, lang string"
    nothing = langgru.train(spark.createDataFrame([(1, "words", None)], schema), TINY)
    rows = spark.createDataFrame([(1, "words"), (1, "words"), (None, None)], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in langgru.predict(rows, nothing).collect()} == {("und", 0.0)}
    one = langgru.train(spark.createDataFrame([(1, "words", "en")], schema), TINY)
    assert sorted((r.lang_pred, r.score) for r in langgru.predict(rows, one).collect()) == [("en", 1.0), ("en", 1.0), ("und", 0.0)]


def test_the_sample_is_bounded_per_language(spark):
    rows = [(k, f"text number {k} " * 40, "en" if k % 3 else "fr") for k in range(60)] + [(99, "same text " * 9, "fr")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = {}
    original = langgru.fit
    langgru.fit = lambda data, label, languages, settings: seen.update(n=np.bincount(label).tolist(), d=data.shape) or original(data, label, languages, settings)
    try:
        langgru.train(docs, langgru.Settings(width=16, units=2, epochs=1, sample_texts=5, sample_windows=3))
    finally:
        langgru.fit = original
    assert all(n <= 15 for n in seen["n"]) and seen["d"] == (16, sum(seen["n"]))
