"""The backoff model against a dictionary version, its normalisation, and edge rows."""

import collections
import math
import os
import re
import zlib

import pytest
from pyspark.sql import functions as F

from seasonloom.llm import katz, queries

SF = f"{os.environ.get('TEST_SF_ROOT', '/root/testdata')}/sf0.001"


def split(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), "</s>"]


class Plain:
    """The same model with dictionaries, evaluated by the recursion itself."""

    def __init__(self, texts, min_count=1):
        one, two = collections.Counter(), collections.Counter()
        for t in map(split, texts):
            one.update(t)
            two.update(zip(["<s>", *t[:-1]], t, strict=True))
        self.one, self.n = one, sum(one.values())
        before = collections.Counter({w: c for w, c in one.items() if w != "</s>"})
        before["<s>"] = len(texts)
        d1 = katz.discounts(collections.Counter(one.values()))
        d2 = katz.discounts(collections.Counter(two.values()))
        cut = lambda c, d: c * d[c - 1] if c <= len(d) else c
        self.p1 = {w: cut(c, d1) / self.n for w, c in one.items()}
        self.unknown = 1 - sum(self.p1.values())
        if self.unknown < 1e-9:
            self.p1 = {w: p * self.n / (self.n + 1) for w, p in self.p1.items()}
            self.unknown = 1 / (self.n + 1)
        self.p2 = {g: cut(c, d2) / before[g[0]] for g, c in two.items() if c >= min_count}
        self.alpha = {}
        by = collections.defaultdict(list)
        for h, w in self.p2:
            by[h].append(w)
        for h, ws in by.items():
            used = sum(self.p2[h, w] for w in ws)
            if used > 1 - 1e-9:
                for w in ws:
                    self.p2[h, w] *= before[h] / (before[h] + 1)
                used *= before[h] / (before[h] + 1)
            self.alpha[h] = (1 - used) / (1 - sum(self.p1[w] for w in ws))

    def p(self, h, w):
        return self.p2.get((h, w)) or self.alpha.get(h, 1.0) * self.p1.get(w, self.unknown)

    def score(self, text):
        t = split(text)
        base = sum(math.log10((self.one.get(w, 0) + 0.5) / (self.n + 0.5 * (len(self.one) + 1))) for w in t)
        total = sum(math.log10(self.p(h, w)) for h, w in zip(["<s>", *t[:-1]], t, strict=True))
        return len(t), sum(w in self.one for w in t), base, total


def test_plain_model_sums_to_one():
    model = Plain(["a b a c", "a b d", "b b b", "a b a c", "c a b"])
    for h in [*model.one, "<s>", "new"]:
        assert sum(model.p(h, w) for w in model.one) + model.alpha.get(h, 1.0) * model.unknown == pytest.approx(1)


def test_query_equals_the_dictionary_version(spark):
    docs = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    model = Plain([t for i, t in docs.items() if not held(i)])
    out = queries.op10_katz_backoff(spark, SF).collect()
    assert len(out) == len(docs)
    for r in out:
        n, known, base, total = model.score(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), n, known, model.n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(total, rel=1e-9)
    test = [r for r in out if r.held_out]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)


def test_query_stores_bigrams_seen_once(spark):
    docs = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    model = Plain([t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 5 != 1], min_count=1)
    for r in queries.op10_katz_backoff(spark, SF).collect():
        assert r.score == pytest.approx(model.score(docs[r.doc_id])[3], rel=1e-9)


def test_stored_tables_sum_to_one(spark):
    docs = spark.createDataFrame([(k, f"a b{k % 3} c a b{k % 2}") for k in range(40)], "doc_id long, text string")
    model = katz.train(docs)
    two, one = model.ngrams(spark, 2), model.ngrams(spark, 1)
    p = lambda df: df.withColumn("p", F.pow(F.lit(10.0), "logp"))
    one, two = p(one), p(two)
    assert one.agg(F.sum("p")).first()[0] + model.unknown == pytest.approx(1)
    back = one.select(F.col("w").alias("h"), F.pow(F.lit(10.0), "weight").alias("backoff"))
    kept = two.groupBy("h").agg(F.sum("p").alias("used")).join(back, "h")
    lower = two.join(one.select("w", F.col("p").alias("p1")), "w").groupBy("h").agg(F.sum("p1").alias("p1"))
    for r in kept.join(lower, "h").collect():
        assert r.used + r.backoff * (1 - r.p1) == pytest.approx(1)


def test_edge_rows(spark):
    rows = [(1, "Some words some WORDS some words"), (2, None), (2, ""), (None, "some words"), (3, "new"), (3, "some"), (1, "Some words some WORDS some words"), (4, "some words " * 60_000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    model = Plain([t for _, t in rows if t != "new"])
    out = katz.score(docs, katz.train(docs.where("coalesce(text, '') <> 'new'"))).collect()
    got = sorted((r.doc_id or 0, r.n_tokens, r.n_known, round(r.score, 6)) for r in out)
    assert got == sorted((i or 0, *model.score(t)[:2], round(model.score(t)[3], 6)) for i, t in rows)
    assert katz.score(docs.limit(0), katz.train(docs)).count() == 0
    untrained = katz.score(docs.where("doc_id = 3"), katz.train(docs.limit(0))).collect()
    assert [r.score for r in untrained] == pytest.approx([2 * math.log10(0.5)] * 2)
