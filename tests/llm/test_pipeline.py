"""The pipeline's stages on their own input, against the operators' brute-force forms."""

import os

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from seasonloom.llm import queries
from seasonloom.session import stage
from tests.llm.test_neardup import brute

ROOT = os.environ.get("TEST_SF_ROOT", "/root/testdata")


@pytest.fixture(scope="module")
def stages(spark):
    folder = f"{ROOT}/sf0.001"
    docs, out = queries.table(spark, folder, "documents"), {}
    out["documents"] = docs
    for name, step in pipeline.STAGES:
        docs = out[name] = stage(step(spark, docs, folder), f"test-{name}")
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "mixing", "sentencepiece"]
    for name in list(stages)[1:-1]:
        assert stages[name].dtypes == stages["documents"].dtypes


def test_classifier_drops_bad_and_keeps_good(spark, stages):
    labels = queries.table(spark, f"{ROOT}/sf0.001", "labels")
    kept = {r.doc_id for r in stages["quality_classifier"].select("doc_id").collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    bad = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(good & kept) >= 0.97 * len(good) and len(bad & kept) <= 0.1 * len(bad)


def test_rules_and_dedup_follow_their_operators(spark, stages):
    before = {r.doc_id: r.text for r in stages["quality_classifier"].collect()}
    after = {r.doc_id: r.text for r in stages["quality_rules"].collect()}
    assert all(after[i] == before[i] for i in after) and all(len(t.split()) >= 50 for t in after.values())
    expected = {i for i, (_, c) in brute(list(after.items())).items() if i == c}
    assert {r.doc_id for r in stages["near_dedup"].collect()} == expected


def test_mixing_keeps_all_and_reaches_the_weights(stages):
    before = {r.doc_id for r in stages["near_dedup"].collect()}
    mixed = stages["mixing"].collect()
    assert {r.doc_id for r in mixed} == before and len(mixed) > len(before)
    # Single documents are repeated at random, so a small table comes only near.
    tokens = {d: sum(len(r.text.split()) for r in mixed if r.lang == d) for d in queries.LANGUAGE_WEIGHTS}
    for d, w in queries.LANGUAGE_WEIGHTS.items():
        assert abs(tokens[d] / sum(tokens.values()) - w) < 0.15


def test_last_stage_equals_the_library(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    text = {r.doc_id: r.text for r in stages["mixing"].collect()}
    rows = stages["sentencepiece"].collect()
    assert len(rows) == stages["mixing"].count()
    assert all(list(r.ids) == library.encode(text[r.doc_id]) for r in rows)


def test_edge_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, rate int, kept int"
    folder = f"{ROOT}/sf0.001"
    clean = "This is a plain clean line of words that goes on with further different terms number " + " ".join(f"w{k}" for k in range(60))
    rows = [(None, clean, None, None, None, 1, 1, 1), (1, clean, "en", "a", 3, 1, 1, 1), (1, clean, "en", "a", 3, 1, 1, 1), (2, None, "en", "a", 0, 1, 1, 1), (3, "", None, "a", 0, 1, 1, 1)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = table
        for name, step in pipeline.STAGES:
            docs = stage(step(spark, docs, folder), f"test-edge-{name}")
            if name != "sentencepiece":
                assert docs.columns == table.columns
        assert docs.where(F.col("n_tokens") == 0).count() == 0
