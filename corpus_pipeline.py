"""A training corpus from raw documents: each stage is one operator of ``seasonloom.llm``.

A stage is ``(name, function)``; the function takes (spark, docs, sf_dir) and returns a
frame that is written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns they were given.

Defined cases: nulls, empty texts, ties and further columns as in the operators; a text
without words is rejected by the first stage; rows that share an id stay or go together; an
empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonloom.llm import linecrf, mixing, neardup, pieces, queries, rules
from seasonloom.session import stage


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores at the threshold or above."""
    model = linecrf.train(docs, queries.table(spark, sf_dir, "labels"))
    scored = linecrf.score(docs.select(F.struct("*").alias("row")), model, "row.text")
    return scored.where(F.col("score") >= queries.QUALITY_THRESHOLD).select("row.*")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the latest rule policy keeps."""
    verdicts = rules.apply_policy(rules.ledger(docs.select(F.struct("*").alias("_row"), "text")), queries.RULE_POLICY)
    return verdicts.where("kept").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of every component of near-duplicates.

    The stage is the op3 operator as it stands: shingles of four words, similarity 0.8.
    """
    removed = neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(removed, "doc_id", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated until the languages' expected tokens have the target weights.

    Rates are one at least, so that no document is lost: the total grows to the smallest
    at which no language has to give up tokens.
    """
    labelled = queries.language_labels(spark, sf_dir, docs)
    model = mixing.classifier(docs, labelled, list(queries.LANGUAGE_WEIGHTS))
    rows = docs.select(F.struct("*").alias("row"), "text")
    # Measured once, beside the rows; the fit reads the two columns it needs.
    measured = stage(model.measured(rows).select("row", "n_tokens", "posterior"), "pipeline-posteriors")
    rates = mixing.fit(measured, queries.LANGUAGE_WEIGHTS, least=1.0, scaled=True)
    rated = measured.select("row", rates.column().alias("rate"))
    return mixing.replicated(rated, key="row").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the digests of the encoding query."""
    rows = docs.select("doc_id", "lang", "source", "text")
    return pieces.digests(pieces.encode(rows, queries.piece_model()), keep=["lang", "source", "ids"])


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("sentencepiece", encode),
]

# Trained models and BPE merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
