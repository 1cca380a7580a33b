"""Near-duplicates against brute force on planted copies, and the sketch itself."""

import collections
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from seasonloom.llm import neardup, queries, sketch

SF = f"{os.environ.get('TEST_SF_ROOT', '/root/testdata')}/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(lowered)
    if len(words) < 4:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 4]) for k in range(len(words) - 3)}


def brute(rows):
    found = {name: shingle_set(text) for name, text in rows}
    where = collections.defaultdict(list)
    for name, elements in found.items():
        for e in elements:
            where[e].append(name)
    parent = {name: name for name in found}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for name, elements in found.items():
        common = collections.Counter(o for e in elements for o in where[e] if o < name)
        for other, n in common.items():
            if 100 * n >= 80 * (len(elements) + len(found[other]) - n):
                a, b = sorted((root(name), root(other)))
                parent[b] = a
    return {name: (len(elements), root(name)) for name, elements in found.items()}


def planted(seed):
    """Chains of small edits, many exact copies, short texts, and a passage in every text."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(40)]
    texts = []
    for _ in range(12):
        words = [word() for _ in range(rng.choice([3, 5, 12, 40, 200]))]
        for _ in range(rng.choice([1, 2, 25])):
            texts.append(" ".join(words))
            if len(words) > 4:
                words = list(words)
                words[rng.randrange(len(words))] = word()
    base = [word() for _ in range(60)]
    for _ in range(60):  # a family around the threshold
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = word()
        texts.append(" ".join(words))
    texts += [" ".join(passage + [word() for _ in range(rng.randint(5, 60))]) for _ in range(30)]
    texts += ["Same Text of some words here"] * 40 + ["same text\nof some  words HERE"] * 3
    texts += [None, "", " \n\t", "a", "A", "a b", "a b c", "a b c d", "x " * 50_000]
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [7, 512])
def test_components_equal_brute_force(spark, block):
    rows = planted(block)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, kept int")
    out = neardup.near_duplicates(docs, neardup.Settings(block=block)).collect()
    expected = brute(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in out) and len(out) == len(rows)


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "one two three four five"), (None, "one two three four five"), (7, "one two three four five"), (7, "one two three four five"), (8, "ONE two three four five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = neardup.near_duplicates(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [(0, 0, True), (0, 0, True), (7, 7, True), (7, 7, True), (8, 7, False)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    out = queries.op3_hyperminhash(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows)


def test_registers_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(0)
    layout = sketch.Layout()
    for size, shared in ((12, 10), (60, 54), (2000, 1700)):
        same, guess = [], []
        for _ in range(60):
            pool = np.sort(rng.integers(0, 2**64, size=2 * size - shared, dtype=np.uint64))
            pick = rng.permutation(len(pool))
            a, b = np.sort(pool[pick[:size]]), np.sort(pool[pick[size - shared :]])
            rows = sketch.registers(np.concatenate((a, b)), np.array([0, size, 2 * size]), layout)
            guess.append(sketch.estimate(rows[:1], rows[1:], np.array([size]), np.array([size]))[0])
            same.append(shared / (2 * size - shared))
        assert abs(np.mean(guess) - np.mean(same)) < 0.04


def test_shingles_of_short_and_repeated_texts():
    values, bounds = sketch.shingles(pa.array(["a b c d a b c d", "a b", None, "A  B", "a b c d"]))
    assert np.diff(bounds).tolist() == [4, 1, 0, 1, 1]
    assert values[bounds[1]] == values[bounds[3]] and values[bounds[4]] in values[: bounds[1]]


def test_slices_with_any_number_of_words():
    import pyarrow as pa

    from seasonloom.llm.sketch import shingles

    for width in (1, 2, 4, 5, 6):
        for n in range(10):
            for texts in ([" ".join("abcdefghij"[:n])], ["a b c d e f g", " ".join("abcdefghij"[:n])]):
                values, bounds = shingles(pa.array(texts), width)
                assert bounds[-1] - bounds[-2] == (max(n - width + 1, 1) if n else 0) and len(values) == bounds[-1]


def test_a_table_of_one_short_text(spark):
    for text in ("hello world", "hello", "a b c"):
        rows = neardup.near_duplicates(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows] == [(1, 1, 1, True)]
