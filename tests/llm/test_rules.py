"""The rule ledger against its SQL and by hand."""

import os

import duckdb
import pytest

from seasonloom.llm import oracle, queries, rules

SF = f"{os.environ.get('TEST_SF_ROOT', '/root/testdata')}/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    result = duck.execute(oracle.statements()[name])
    columns = [c[0] for c in result.description]
    frame = queries.queries()[name](spark, SF)
    assert sorted(frame.columns) == sorted(columns)
    assert sorted(tuple(r) for r in frame.select(columns).collect()) == sorted(result.fetchall())


def test_measures_by_hand(spark):
    texts = [None, "", "a b c a b c", "a a a a", "x y z", "One\nTwo #\n\nOne\nOne \n", "Ü#$ \x1f\xa0", "w " * 100_000]
    docs = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in rules.ledger(docs).collect()}
    pick = lambda k: (got[k].n_words, got[k].word_chars, got[k].n_symbols, got[k].n_dup_lines, got[k].n_repeat_words)
    assert pick(0) == pick(1) == (0, 0, 0, 0, 0)
    assert pick(2) == (6, 6, 0, 0, 6) and pick(3) == (4, 4, 0, 0, 4) and pick(4) == (3, 3, 0, 0, 0)
    assert pick(5) == (5, 13, 1, 1, 0)
    assert pick(6) == (2, 5, 2, 0, 0)
    assert pick(7) == (100_000, 100_000, 0, 0, 100_000)
    assert dict(rules.ledger(docs).dtypes)["n_words"] == "bigint"


def test_policies_and_ablations_read_bits_only(spark):
    bits = [0, 0, 1, 3, 4, 5, 8]
    ledger = spark.createDataFrame([(k, b) for k, b in enumerate(bits)], "doc_id long, fail_bits long")
    kept = {r.doc_id for r in rules.apply_policy(ledger, "v2").collect() if r.kept}
    assert kept == {0, 1}
    assert {r.doc_id for r in rules.apply_policy(ledger, "v1").collect() if r.base_failed} == {2, 3, 5}
    row = {(r.policy, r.rule): r for r in rules.ablations(ledger).collect()}
    few, symbols = row["v2", "few_words"], row["v2", "symbols"]
    assert (few.n_docs, few.n_kept, few.n_kept_without, few.n_only) == (7, 2, 3, 1)
    assert (symbols.n_kept_without, symbols.n_only) == (3, 1)
    assert rules.ablations(ledger.limit(0)).count() == 0


def test_stored_ledger_is_versioned_and_read_without_texts(spark, monkeypatch):
    from seasonloom.session import scratch_path

    docs = spark.createDataFrame([(k, "word " * k, 1, 2, 3) for k in range(60)], "doc_id long, text string, _words int, _marks int, measured int")
    path = rules.store(rules.ledger(docs).drop("text"), scratch_path(spark, "test-ledger"))
    stored = rules.load(spark, path)
    assert {"_words", "_marks", "measured"} <= set(stored.columns) and "text" not in stored.columns
    measured = {r.doc_id: r.fail_bits for r in rules.ledger(docs).collect()}
    assert {r.doc_id: r.fail_bits for r in stored.collect()} == measured
    assert sorted(rules.ablations(stored).collect()) == sorted(rules.ablations(rules.ledger(docs)).collect())
    monkeypatch.setitem(rules.RULES, "another", "n_words > 1000")
    with pytest.raises(ValueError):
        rules.load(spark, path)
