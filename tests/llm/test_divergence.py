import re
from collections import Counter, defaultdict
from dataclasses import replace

import pytest

from seasonloom.llm import divergence

WORD = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows, least=3, top=200):
    """The audit with dictionaries and Python's whole numbers."""
    docs = [(r[0] or "", r[1] or "", WORD.findall(_lower(r[2] or ""))) for r in rows]
    out = []
    for lang in {d[0] for d in docs}:
        found, used = Counter(), Counter()
        for name, _, words in docs:
            if name == lang:
                found.update(set(words))
                used.update(words)
        kept = {w: used[w] for w, n in found.items() if n >= least}
        counts = defaultdict(Counter)
        for name, source, words in docs:
            if name == lang:
                counts[source].update(w for w in words if w in kept)
        share = lambda n, total: 1 + 10**9 * (n + 1) // (total + len(kept))
        p = {s: {w: share(c[w], sum(c.values())) for w in kept} for s, c in counts.items()}
        q = {w: share(n, sum(kept.values())) for w, n in kept.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in p:
            pairs = [(sum(f(p[s][w], p[t][w]) for w in kept), t) for t in p if t != s]
            terms = [(f(p[s][w], q[w]), w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found_, limit in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found_, key=lambda x: (-x[0], x[1].encode()))[:limit]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ordered, 1)]
    return sorted(out)


ROWS = [
    ("en", "a", "The cat_sat on the MAT. the"),
    ("en", "a", "the cat; été Été"),
    ("en", "b", "the dog sat on the cat's été"),
    ("en", "b", "the dog sat on the cat's été"),
    ("en", None, "dog dog dog on sat on"),
    ("en", "quiet", None),
    ("en", "quiet2", "1234 ___"),
    (None, "a", "one two"),
    (None, "b", ""),
    ("fr", "a", "le la le"),
    ("", "a", "one two one"),
    ("", "c", "One TWO"),
    ("de", "x" * 50, "wort " * 3000 + "w" * 70000),
    ("de", "y", "wort " + "w" * 70000),
    ("de", "y", "wort" + chr(1) + "w" * 70000),
]
SCHEMA = "lang string, source string, text string"


def _rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("change", [{}, {"bits": 3}, {"bits": 1}, {"cells": 4}, {"top": 2}, {"slice_bytes": 1, "remembered": 1}])
def test_audit_equals_dictionaries(spark, change):
    got = _rows(divergence.audit(spark.createDataFrame(ROWS, SCHEMA), replace(divergence.Settings(), **change)))
    assert got == plain(ROWS, top=change.get("top", 200))
    assert [r for r in got if r[2] == "term"]


def test_further_columns_and_an_empty_table(spark):
    docs = spark.createDataFrame([(*r, 7, "z") for r in ROWS], SCHEMA + ", digest int, term string")
    assert _rows(divergence.audit(docs)) == plain(ROWS)
    empty = divergence.audit(docs.limit(0))
    assert empty.columns == ["lang", "source", "part", "item", "value", "rank"] and empty.count() == 0


def test_ties_at_the_last_place_go_to_the_smallest_term(spark):
    words = [chr(97 + i) + chr(97 + j) for i in range(20) for j in range(20)]
    rows = [("en", s, " ".join(words) if s == "a" else "zzz " * 400) for s in "aaabbb"]
    got = _rows(divergence.audit(spark.createDataFrame(rows, SCHEMA)))
    assert got == plain(rows) and len([r for r in got if r[1] == "a" and r[2] == "term"]) == 200


def test_shares_are_exact_for_large_counts(spark):
    from pyspark.sql import functions as F

    cases = [(10**15 - 1, 9 * 10**15 - 1), (7 * 10**14, 3 * 10**15 + 1), (0, 1), (2, 3)]
    frame = spark.createDataFrame(cases, "n long, total long").select("n", "total", divergence._share("n", F.col("total")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.n + 1) // r.total for r in frame.collect())
