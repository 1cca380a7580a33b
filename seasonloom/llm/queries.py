"""The operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonloom.llm import alignment, collide, divergence, katz, langgru, linecrf, mixing, neardup, pagetext, pieces, rules, shards, warc
from seasonloom.session import scratch_path, stage

RULE_POLICY = "v2"
N_SHARDS = 40
LANGUAGE_WEIGHTS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
QUALITY_THRESHOLD = 0.3
PIECE_MODEL = "piece_bpe_32k.model"
BYTE_MODEL = "byte_bpe_50k.json"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_model() -> str:
    return tokenizer(PIECE_MODEL)


def op1_collision_counting(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return collide.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The measures and failure bits of every document, stored once and read back."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return rules.load(spark, rules.store(rules.ledger(docs).drop("text"), scratch_path(spark, "rule-ledger")))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Measures, failure bits and verdict of every document under the latest policy."""
    verdicts = rules.apply_policy(rule_ledger(spark, folder), RULE_POLICY)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return verdicts.select("doc_id", *counts, "base_failed", "kept", "fail_bits")


def rule_ablations(spark: SparkSession, folder: str) -> DataFrame:
    """What each rule of each policy version decides over all documents, from the stored bits."""
    return rules.ablations(rule_ledger(spark, folder))


def op3_hyperminhash(spark: SparkSession, folder: str) -> DataFrame:
    """Component of near-duplicates of every document."""
    return neardup.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


def op4_external_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's shard and place after the two-pass shuffle, read from the shards."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    written = shards.write(shards.shuffled(docs, N_SHARDS, seed=17), scratch_path(spark, "shards"))
    return written.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every text and of their decoded form, as digests."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pieces.digests(pieces.encode(docs, piece_model()))


def op6_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = linecrf.train(docs, table(spark, folder, "labels"))
    return linecrf.score(docs, model).select(
        "doc_id",
        linecrf.held_out().alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"),
    )


def op7_page_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return pagetext.extract(pages, pagetext.train(pages)).select("page_id", "url", "text", "n_chars")


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as a record of dictionary-compressed archives, read back from them."""
    pages = table(spark, folder, "pages")
    rows = warc.classified(pages)
    manifest = stage(warc.write(rows, scratch_path(spark, "warc"), warc.dictionary(pages)), "warc-manifest")
    return warc.read(spark, manifest).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op10_katz_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every document under the model of those that are not held out.

    The model stores every bigram, those seen once too.
    """
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1
    model = katz.train(docs.where(~held_out))
    return katz.score(docs, model).select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def language_labels(spark: SparkSession, folder: str, docs: DataFrame) -> DataFrame:
    """The labelled documents with their language as the domain."""
    labelled = table(spark, folder, "labels").select("doc_id").distinct()
    return docs.select("doc_id", F.col("lang").alias("domain")).join(labelled, "doc_id")


def op9_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Posteriors and rate of every document for the target weights of the languages."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = mixing.classifier(docs, language_labels(spark, folder, docs), list(LANGUAGE_WEIGHTS))
    measured = stage(model.measured(docs).select("doc_id", "n_tokens", "posterior"), "mixing")
    rates = mixing.fit(measured, LANGUAGE_WEIGHTS, scaled=True)
    share = [F.get("posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(LANGUAGE_WEIGHTS)]
    return measured.select("doc_id", "n_tokens", *share, rates.column().alias("rate"))


def op11_byte_gru(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    model = langgru.train(docs.where(~langgru.held_out()))
    return langgru.predict(docs.select("doc_id", langgru.held_out().alias("held_out"), "text"), model)


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens over every text, with corpus-wide counts."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return alignment.align(docs, tokenizer(BYTE_MODEL), piece_model())


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How the sources of each language differ, by pairs and by their most unusual terms."""
    return divergence.audit(table(spark, folder, "documents").select("lang", "source", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_collision_counting, op2_quality_rules, rule_ablations, op3_hyperminhash, op4_external_shuffle, op5_sentencepiece, op6_line_crf, op7_page_text, op8_warc, op9_soft_mixing, op10_katz_backoff, op11_byte_gru, op12_token_alignment, op13_source_divergence]
    return {f.__name__: f for f in named}
