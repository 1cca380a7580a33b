"""Katz backoff language model over words: counted, stored and evaluated as Spark tables.

Tokens are the words of a text, letters A-Z in lower case, and one end.  Training counts
unigrams and bigrams (a text's first word follows a start) and stores all of them.  Counts up
to ``CUT`` are discounted by Good-Turing.  Unigrams leave their discounted mass to all unknown
words together.  A history's backoff weight is (1 - sum of its bigrams' probabilities) /
(1 - sum of their words' unigram probabilities), so the model sums to one after every history,
unknown word included.

    P(w | h) = discount * c(h w) / c(h)      where the bigram is stored
             = backoff(h) * P(w)             elsewhere; an unknown history backs off with 1

The tables are partitioned by order.  Unigrams have one row each; bigrams lie in chunks, each
a list of histories with the words and counts that follow.  A bigram's probability follows
from its count and its history, so only counts are stored, and nothing is joined to bigrams.

Tasks turn texts into lists of n-grams per bucket.  A bucket is chosen by the history, or the
word, that the next step sums over; one that holds a share of all tokens of half a bucket or
more is spread over several buckets by the other word of the pair.  Scoring sends the
different words and bigrams of a slice of texts to their buckets, which answer with counts
and weights in the order asked, and the slice evaluates the recursion for every token.  It
goes in ``rounds`` over parts of the texts, which bounds the scratch space.

Defined cases: a null text is empty and has one token, its end; rows that repeat an id and
text repeat their score; an id with several texts is scored for each; a null id is an id.
Words are identified by 64-bit hashes.  A model without training text gives every token of
a text, end included, the probability one half (to the unknown, and to the end).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonloom.llm.bytetext import LOWER, combine, hashes, joined, mix, slices, spans
from seasonloom.llm.shipping import shipped
from seasonloom.session import scratch_path, stage, unstage, write_once

CUT = 5
START, END = (int(x) for x in mix(np.array([1, 2], dtype=np.uint64)).view(np.int64))
_POSITIVE = np.uint64(0x7FFFFFFFFFFFFFFF)
_LONGS = "array<long>"
# Pairs that a task gathers, and that a chunk holds, at most (one history at least).
_GATHER = 1 << 20


@dataclass
class Tokens:
    """Tokens of a batch (words as unsigned hashes) and how many each text has."""

    token: np.ndarray
    n: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    data, bounds = joined(texts)
    data = LOWER[data]
    starts, ends = spans(data)
    text_of = np.searchsorted(bounds, starts, side="right") - 1
    n = np.bincount(text_of, minlength=len(bounds) - 1) + 1
    token = np.full(int(n.sum()), np.int64(END).astype(np.uint64), dtype=np.uint64)
    token[np.arange(len(starts)) + text_of] = hashes(data, starts, ends)
    return Tokens(token, n)


@dataclass
class Pairs:
    """Different (history, word) pairs of a slice as places in its list of words.

    The place after the last word stands for the start.  ``of`` is the pair of every token.
    """

    history: np.ndarray
    word: np.ndarray
    of: np.ndarray
    count: np.ndarray


def pairs_of(words: int, at: np.ndarray, n: np.ndarray) -> Pairs:
    history = np.empty_like(at)
    history[1:] = at[:-1]
    history[np.cumsum(n) - n] = words
    code, of, count = np.unique(history * (words + 1) + at, return_inverse=True, return_counts=True)
    return Pairs(code // (words + 1), code % (words + 1), of, count)


def with_start(words: np.ndarray) -> np.ndarray:
    return np.append(words, np.array([START]).view(np.uint64))


@dataclass
class Deal:
    """Buckets of words: by their hash, and by a second word for those that are ``hot``.

    ``hot`` (ascending) holds words with at least half a bucket's share of all tokens, so no
    more than two a bucket, and ``spread`` the number of buckets of each.
    """

    buckets: int
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def first(self, word: np.ndarray) -> np.ndarray:
        return ((word & _POSITIVE) % np.uint64(self.buckets)).astype(np.int64)

    def width(self, word: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.ones(len(word), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.hot, word), len(self.hot) - 1)
        return np.where(self.hot[at] == word, self.spread[at], 1)

    def pair(self, word: np.ndarray, other: np.ndarray) -> np.ndarray:
        turn = (mix(other) >> np.uint64(1)) % self.width(word).astype(np.uint64)
        return (self.first(word) + turn.astype(np.int64)) % self.buckets

    @classmethod
    def of(cls, counted: DataFrame, total: int, buckets: int) -> Deal:
        """Deal for the words ``w`` with counts ``c`` that add up to ``total``."""
        often = counted.where(F.col("c") * 2 * buckets >= total).select("w", "c").collect()
        often = sorted((int(np.int64(r.w).astype(np.uint64)), r.c) for r in often)
        spread = [min(buckets, -(-2 * buckets * c // total)) for _, c in often]
        return cls(buckets, np.array([w for w, _ in often], dtype=np.uint64), np.array(spread, dtype=np.int64))


def _starts(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(kind.to_pandas_dtype(), copy=False)))


def _flat(table: pa.Table, name: str) -> np.ndarray:
    """All elements of a column of lists, or a column of numbers."""
    column = table[name].combine_chunks()
    if pa.types.is_list(column.type):
        column = column.flatten()
    return column.to_numpy(zero_copy_only=False)


def _hashes(table: pa.Table, name: str) -> np.ndarray:
    return _flat(table, name).astype(np.int64, copy=False).view(np.uint64)


def _dealt(bucket: np.ndarray, key: np.ndarray, **more: np.ndarray) -> dict[str, pa.Array]:
    """Columns with one row per bucket: its keys in runs, and per entry what ``more`` holds.

    The entries must be in order of bucket and key.
    """
    cut = np.append(_starts(bucket), len(bucket))
    run = _starts(bucket, key)
    inner = np.searchsorted(run, cut)
    out = {"bucket": pa.array(bucket[cut[:-1]].astype(np.int32))}
    out["key"] = _lists(key[run].view(np.int64), inner, pa.int64())
    out["n"] = _lists(np.diff(np.append(run, len(key))), inner, pa.int32())
    for name, values in more.items():
        wide = values.dtype == np.uint64
        out[name] = _lists(values.view(np.int64) if wide else values, cut, pa.int64() if wide else pa.int32())
    return out


def _by_bucket(bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order by bucket and key."""
    order = np.argsort(key)
    return order[np.argsort(bucket[order].astype(np.int32), kind="stable")]


def word_counts(docs: DataFrame) -> DataFrame:
    """``w`` and its count ``c`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 8 << 20):
                word, count = np.unique(tokens(part.column(0)).token, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(count)], ["w", "c"])

    found = docs.select("text").mapInArrow(run, "w long, c long")
    return found.groupBy("w").agg(F.sum("c").alias("c"))


_CHUNK = f"bucket int, key {_LONGS}, n array<int>, w {_LONGS}, c array<int>"


def pair_counts(docs: DataFrame, deal: Deal) -> DataFrame:
    """Chunks of the corpus's bigrams: histories ``key``, ``n`` words ``w`` after each, counts ``c``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, 8 << 20):
                t = tokens(part.column(0))
                words, at = np.unique(t.token, return_inverse=True)
                p = pairs_of(len(words), at, t.n)
                h, w = with_start(words)[p.history], words[p.word]
                bucket = deal.pair(h, w)
                # Pairs come in order of their histories' places.
                order = np.argsort(bucket.astype(np.int32), kind="stable")
                dealt = _dealt(bucket[order], h[order], w=w[order], c=p.count[order])
                yield pa.RecordBatch.from_arrays(list(dealt.values()), ["bucket", "key", "n", "w", "c"])

    def merge(group: pa.Table) -> Iterator[pa.Table]:
        runs, n = _hashes(group, "key"), _flat(group, "n")
        w, c = _hashes(group, "w"), _flat(group, "c").astype(np.int64)
        h, place = np.unique(runs, return_inverse=True)
        place = np.repeat(place, n)
        order = np.argsort(combine(h[place], w))
        order = order[np.argsort(place[order], kind="stable")]
        place, w, c = place[order], w[order], c[order]
        edge = _starts(place, w)
        place, w, c = place[edge], w[edge], np.add.reduceat(c, edge)
        cut = _starts(place)
        part = cut // _GATHER
        ends = np.append(cut, len(place))
        for a, b in zip(*(lambda e: (e, np.append(e[1:], len(cut))))(_starts(part)), strict=True):
            x, y = ends[a], ends[b]
            bucket = np.full(y - x, group["bucket"][0].as_py(), dtype=np.int64)
            yield pa.table(_dealt(bucket, h[place[x:y]], w=w[x:y], c=c[x:y]))

    dealt = docs.select("text").mapInArrow(run, _CHUNK)

    def merged(group: pa.Table) -> pa.Table:
        return pa.concat_tables(list(merge(group)))

    return dealt.groupBy("bucket").applyInArrow(merged, _CHUNK)


def discounts(of: dict[int, int]) -> list[float]:
    """Good-Turing factors for counts 1 to CUT, from how many n-grams have each count.

    Where the counts of counts give no factor between 0 and 1, half a count is taken off.
    """
    n = [of.get(r, 0) for r in range(CUT + 2)]
    rest = (CUT + 1) * n[CUT + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, CUT + 1):
        factor = ((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if n[r] and rest < 1 else 0.0
        out.append(factor if 0 < factor < 1 else (r - 0.5) / r)
    return out


def discounted(count: np.ndarray, factors: list[float]) -> np.ndarray:
    table = np.array([0.0, *factors, 1.0])
    return count * table[np.minimum(count, CUT + 1)]


def _discounted(count: Column, factors: list[float]) -> Column:
    factor = F.lit(1.0)
    for r, d in enumerate(factors, start=1):
        factor = F.when(count == r, F.lit(d)).otherwise(factor)
    return count * factor


@dataclass
class Model:
    """``path`` holds the n-grams, partitioned by order.

    Unigrams (w, c, logp, weight, full): ``weight`` is the log10 backoff of the word as a
    history, ``full`` says that its bigrams used all its mass, so that they are spread over
    one token more.  Bigrams are chunks as ``pair_counts`` gives them.
    """

    path: str
    train_tokens: int
    types: int
    unknown: float
    one: list[float]
    two: list[float]
    scale: float
    deal: Deal
    texts: int
    start_weight: float
    start_full: bool

    def chunks(self, spark) -> DataFrame:
        return spark.read.schema(_CHUNK).parquet(f"{self.path}/order=2")

    def ngrams(self, spark, order: int) -> DataFrame:
        """Rows of unigrams, or of bigrams (h, w, c, logp)."""
        if order == 1:
            return spark.read.schema("w long, c long, logp double, weight double, full boolean").parquet(f"{self.path}/order=1")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                chunk = pa.Table.from_batches([batch])
                h = np.repeat(_flat(chunk, "key"), _flat(chunk, "n"))
                columns = [h, _flat(chunk, "w"), _flat(chunk, "c").astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["h", "w", "c"])

        rows = self.chunks(spark).mapInArrow(run, "h long, w long, c long")
        own = self.ngrams(spark, 1).select(F.col("w").alias("h"), (F.col("c") + F.col("full").cast("int")).alias("n"))
        start = spark.range(1).select(F.lit(START).alias("h"), F.lit(self.texts + self.start_full).cast("long").alias("n"))
        rows = rows.join(own.where(F.col("h") != END).union(start), "h")
        return rows.select("h", "w", "c", (F.log10(_discounted(F.col("c"), self.two)) - F.log10("n")).alias("logp"))


_WORDS = f"bucket int, key {_LONGS}, c {_LONGS}, weight array<double>, full array<byte>"


def _word_lists(words: DataFrame, deal: Deal, spread: bool) -> DataFrame:
    """Words with counts, and weights where there are any, as lists per bucket.

    With ``spread`` a hot word is in each of its buckets, else in the first alone.
    """
    weighted = "weight" in words.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            copies = deal.width(w) if spread else np.ones(len(w), dtype=np.int64)
            at = np.repeat(np.arange(len(w)), copies)
            turn = np.arange(len(at)) - np.repeat(np.cumsum(copies) - copies, copies)
            bucket = (deal.first(w)[at] + turn) % deal.buckets
            order = np.argsort(bucket, kind="stable")
            bucket, at = bucket[order], at[order]
            cut = np.append(_starts(bucket), len(bucket))
            c = batch.column(1).to_numpy(zero_copy_only=False)
            weight = batch.column(2).to_numpy(zero_copy_only=False) if weighted else np.zeros(len(w))
            full = batch.column(3).cast(pa.int8()).to_numpy(zero_copy_only=False) if weighted else np.zeros(len(w))
            columns = [pa.array(bucket[cut[:-1]].astype(np.int32)), _lists(w.view(np.int64)[at], cut, pa.int64())]
            columns += [_lists(c[at], cut, pa.int64()), _lists(weight[at], cut, pa.float64()), _lists(full[at], cut, pa.int8())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "key", "c", "weight", "full"])

    columns = ["w", "c", "weight", "full"] if weighted else ["w", "c"]
    return words.select(columns).mapInArrow(run, _WORDS)


_SUMS = f"bucket int, key {_LONGS}, used array<double>, lower array<double>"


def _sum_lists(h: np.ndarray, used: np.ndarray, lower: np.ndarray, deal: Deal) -> list[pa.Array]:
    """Sums per history, one row per bucket of histories."""
    place, at = np.unique(h, return_inverse=True)
    sums = [np.bincount(at, weights=x, minlength=len(place)) for x in (used, lower)]
    bucket = deal.first(place)
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    cut = np.append(_starts(bucket[order]), len(order))
    columns = [pa.array(bucket[order][cut[:-1]].astype(np.int32)), _lists(place[order].view(np.int64), cut, pa.int64())]
    return columns + [_lists(x[order], cut, pa.float64()) for x in sums]


def _history_sums(chunks: DataFrame, words: DataFrame, deal: Deal, p1, two: list[float]) -> DataFrame:
    """Lists per bucket of histories: partial sums of discounted counts and of unigram probabilities."""

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(3).flatten())
            if size >= _GATHER:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in gathered(batches):
            h = np.repeat(_hashes(chunk, "key"), _flat(chunk, "n"))
            used = discounted(_flat(chunk, "c").astype(np.int64), two)
            if len(h):
                yield pa.RecordBatch.from_arrays(_sum_lists(h, used, np.zeros(len(h)), deal), ["bucket", "key", "used", "lower"])

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in gathered(batches):
            h, w = np.repeat(_hashes(chunk, "key"), _flat(chunk, "n")), _hashes(chunk, "w")
            if not len(h):
                continue
            bucket = deal.pair(w, h)
            order = _by_bucket(bucket, w)
            dealt = _dealt(bucket[order], w[order], h=h[order])
            yield pa.RecordBatch.from_arrays(list(dealt.values()), ["bucket", "key", "n", "h"])

    def lower(asked: pa.Table, known: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "key": pa.array([], pa.list_(pa.int64())), "used": pa.array([], pa.list_(pa.float64())), "lower": pa.array([], pa.list_(pa.float64()))})
        w = _hashes(known, "key")
        order = np.argsort(w)
        c = _flat(known, "c")[order]
        at = np.searchsorted(w[order], _hashes(asked, "key"))
        p = np.repeat(p1(c[at]), _flat(asked, "n"))
        return pa.table(_sum_lists(_hashes(asked, "h"), np.zeros(len(p)), p, deal), names=["bucket", "key", "used", "lower"])

    asked = chunks.mapInArrow(by_word, f"bucket int, key {_LONGS}, n array<int>, h {_LONGS}")
    known = _word_lists(words, deal, spread=True)
    met = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(lower, _SUMS)
    return met.union(chunks.mapInArrow(own, _SUMS))


def train(docs: DataFrame, bucket_pairs: int = 2_000_000) -> Model:
    """Count, discount and store the model of the texts of ``docs``."""
    spark = docs.sparkSession
    shipped(spark)
    words = stage(word_counts(docs), "katz-words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    texts = words.where(F.col("w") == END).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    path = scratch_path(spark, "katz-ngrams")
    if not total["n"]:
        for order, schema in ((1, "w long, c long, logp double, weight double, full boolean"), (2, _CHUNK)):
            write_once(spark.createDataFrame([], schema), f"{path}/order={order}")
        return Model(path, 0, 0, 0.5, discounts({}), discounts({}), 1.0, Deal(1), 0, 0.0, False)
    n = total["n"]
    start = spark.range(1).select(F.lit(START).alias("w"), F.lit(texts).cast("long").alias("c"))
    deal = Deal.of(words.union(start), n, max(24, -(-n // bucket_pairs)))
    write_once(pair_counts(docs, deal), f"{path}/order=2")
    chunks = spark.read.schema(_CHUNK).parquet(f"{path}/order=2")
    of_words = dict(words.where(F.col("c") <= CUT + 1).groupBy("c").count().collect())
    seen = chunks.select(F.explode("c").alias("c")).where(F.col("c") <= CUT + 1)
    one, two = discounts(of_words), discounts(dict(seen.groupBy("c").count().collect()))
    given = words.agg(F.sum(_discounted(F.col("c"), one) / n)).first()[0]
    unknown, scale = 1.0 - given, 1.0
    if unknown < 1e-9:
        # No count is discounted: one token's share goes to the unknown.
        unknown, scale = 1.0 / (n + 1.0), n / (n + 1.0)
    p1 = lambda c: discounted(c, one) / n * scale

    def weights(sums: pa.Table, known: pa.Table) -> pa.Table:
        h, at = np.unique(_hashes(sums, "key"), return_inverse=True)
        used, lower = (np.bincount(at, weights=_flat(sums, k), minlength=len(h)) for k in ("used", "lower"))
        w, c = _hashes(known, "key"), _flat(known, "c")
        place = np.minimum(np.searchsorted(h, w), max(len(h) - 1, 0))
        has = h[place] == w if len(h) else np.zeros(len(w), dtype=bool)
        full, weight = np.zeros(len(w), dtype=bool), np.zeros(len(w))
        share, mass = used[place[has]] / c[has], lower[place[has]]
        # A history whose bigrams use all its mass gives one token's share of it back.
        all_used = share > 1 - 1e-9
        share = np.where(all_used, share * c[has] / (c[has] + 1.0), share)
        full[has], weight[has] = all_used, np.log10((1 - share) / (1 - mass))
        logp = np.where(w == np.int64(START).astype(np.uint64), 0.0, np.log10(np.maximum(p1(c), 1e-300)))
        return pa.table({"w": w.view(np.int64), "c": c, "logp": logp, "weight": weight, "full": full})

    sums = _history_sums(chunks, words, deal, p1, two)
    # The start is a history of its own, and the end is none.
    histories = _word_lists(words.union(start), deal, spread=False)
    rows = sums.groupBy("bucket").cogroup(histories.groupBy("bucket")).applyInArrow(
        weights, "w long, c long, logp double, weight double, full boolean"
    )
    rows = stage(rows, "katz-unigrams")
    write_once(rows.where(F.col("w") != START), f"{path}/order=1")
    begin = rows.where(F.col("w") == START).select("weight", "full").first()
    unstage(words, rows)
    return Model(path, n, total["v"], unknown, one, two, scale, deal, texts, begin["weight"], begin["full"])


_REPLY = f"slice long, kind int, bucket int, c {_LONGS}, weight array<double>, full array<byte>"


def _word_order(words: np.ndarray, deal: Deal) -> np.ndarray:
    return np.argsort(deal.first(words).astype(np.int32), kind="stable")


def _pair_order(words: np.ndarray, p: Pairs, deal: Deal) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets, histories and words of a slice's pairs in the order asked, and that order."""
    h, w = with_start(words)[p.history], words[p.word]
    bucket = deal.pair(h, w)
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    return bucket[order], h[order], w[order], order


def _questions(coded: DataFrame, deal: Deal) -> tuple[DataFrame, DataFrame]:
    """What the slices ask: words and pairs, per slice and bucket."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(k, 1)])
                w = _hashes(row, "words")
                order = _word_order(w, deal)
                bucket = deal.first(w)[order]
                cut = np.append(_starts(bucket), len(bucket))
                name = np.full(len(cut) - 1, row["slice"][0].as_py(), dtype=np.int64)
                columns = [pa.array(name), pa.array(bucket[cut[:-1]].astype(np.int32)), _lists(w[order].view(np.int64), cut, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "bucket", "key"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(k, 1)])
                w = _hashes(row, "words")
                p = pairs_of(len(w), _flat(row, "at").astype(np.int64), _flat(row, "n"))
                bucket, first, second, _ = _pair_order(w, p, deal)
                dealt = _dealt(bucket, first, w=second)
                name = pa.array(np.full(len(dealt["bucket"]), row["slice"][0].as_py(), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([name, *dealt.values()], ["slice", "bucket", "key", "n", "w"])

    return (
        coded.select("slice", "words").mapInArrow(words, f"slice long, bucket int, key {_LONGS}"),
        coded.select("slice", "words", "at", "n").mapInArrow(pairs, f"slice long, bucket int, key {_LONGS}, n array<int>, w {_LONGS}"),
    )


def _reply(asked: pa.Table, size: np.ndarray, kind: int, c: np.ndarray, weight: np.ndarray, full: np.ndarray) -> pa.Table:
    """One answer per question; ``size`` is how many entries each question has."""
    cut = np.concatenate(([0], np.cumsum(size)))
    whole = cut if len(weight) else np.zeros_like(cut)
    return pa.table(
        {
            "slice": asked["slice"],
            "kind": pa.array(np.full(asked.num_rows, kind, dtype=np.int32)),
            "bucket": asked["bucket"],
            "c": _lists(c, cut, pa.int64()),
            "weight": _lists(weight, whole, pa.float64()),
            "full": _lists(full, whole, pa.int8()),
        }
    )


def _looked_up(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each asked key among ascending known ones, and whether it is there."""
    at = np.minimum(np.searchsorted(known, asked), max(len(known) - 1, 0))
    return at, known[at] == asked if len(known) else np.zeros(len(asked), dtype=bool)


def _answer_words(asked: pa.Table, known: pa.Table) -> pa.Table:
    w = _hashes(known, "key")
    order = np.argsort(w)
    at, found = _looked_up(w[order], _hashes(asked, "key"))
    pick = lambda k: np.where(found, _flat(known, k)[order][at], 0) if len(w) else np.zeros(len(at))
    size = np.asarray(asked["key"].combine_chunks().value_lengths())
    return _reply(asked, size, 0, pick("c"), pick("weight"), pick("full"))


def _answer_pairs(asked: pa.Table, known: pa.Table) -> pa.Table:
    both = lambda t: combine(np.repeat(_hashes(t, "key"), _flat(t, "n")), _hashes(t, "w"))
    key = both(known)
    order = np.argsort(key)
    at, found = _looked_up(key[order], both(asked))
    c = np.where(found, _flat(known, "c")[order][at], 0) if len(key) else np.zeros(len(at))
    none = np.zeros(0)
    return _reply(asked, np.asarray(asked["w"].combine_chunks().value_lengths()), 1, c, none, none)


def score(docs: DataFrame, model: Model, rounds: int = 4, slice_bytes: int = 4 << 20) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every row."""
    spark = docs.sparkSession
    shipped(spark)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key = docs.schema["doc_id"].dataType
    deal = model.deal
    many = lambda kind: T.ArrayType(kind)
    coded_as = T.StructType(
        [T.StructField("slice", T.LongType()), T.StructField("ids", many(key)), T.StructField("n", many(T.IntegerType()))]
        + [T.StructField("words", many(T.LongType())), T.StructField("at", many(T.IntegerType()))]
    )
    result = T.StructType(
        [T.StructField("doc_id", key), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType())]
        + [T.StructField(k, T.DoubleType()) for k in ("base_score", "score")]
    )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, 1, slice_bytes):
                t = tokens(part.column(1))
                words, at = np.unique(t.token, return_inverse=True)
                whole = lambda x, kind: _lists(x, np.array([0, len(x)]), kind)
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                columns = [pa.array([name], pa.int64()), ids, whole(t.n, pa.int32()), whole(words.view(np.int64), pa.int64()), whole(at, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, coded_as.fieldNames())
                name += 1

    whole_mass = model.train_tokens + 0.5 * (model.types + 1)

    def evaluate(coded: pa.Table, replies: pa.Table) -> pa.Table:
        words, at, n = _hashes(coded, "words"), _flat(coded, "at").astype(np.int64), _flat(coded, "n").astype(np.int64)
        p = pairs_of(len(words), at, n)
        replies = replies.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        kind = _flat(replies, "kind")
        of_words = replies.filter(pa.array(kind == 0))
        order = _word_order(words, deal)
        put = lambda x: np.concatenate((x, x[:1]))[np.argsort(np.append(order, len(words)))]
        c, weight, full = (put(_flat(of_words, k)) for k in ("c", "weight", "full"))
        c, weight = c.astype(np.int64), weight.astype(np.float64)
        c2 = np.empty(len(p.count), dtype=np.int64)
        c2[_pair_order(words, p, deal)[3]] = _flat(replies.filter(pa.array(kind == 1)), "c")
        # The last place is the start.
        own, seen = np.maximum(c, 1) + (full > 0), c > 0
        own[-1], weight[-1] = max(model.texts, 1) + model.start_full, model.start_weight
        unigram = np.where(seen, np.log10(np.maximum(discounted(c, model.one) / max(model.train_tokens, 1) * model.scale, 1e-300)), math.log10(model.unknown))
        known = c2 > 0
        gain = np.where(
            known,
            np.log10(np.maximum(discounted(c2, model.two), 1e-300)) - np.log10(own[p.history]),
            unigram[p.word] + weight[p.history],
        )
        first = np.cumsum(n) - n
        sums = lambda x: np.add.reduceat(x, first)
        base = sums(np.log10(c[at] + 0.5)) - n * math.log10(whole_mass)
        return pa.table(
            [coded["ids"].combine_chunks().flatten(), pa.array(n), pa.array(sums(seen[at].astype(np.int64))), pa.array(base), pa.array(sums(gain[p.of]))],
            names=result.fieldNames(),
        )

    unigrams = model.ngrams(spark, 1)
    turn = F.pmod(F.xxhash64("text", F.col("doc_id").cast("string")), F.lit(rounds))

    def scored(part: DataFrame) -> DataFrame:
        coded = stage(part.mapInArrow(code, coded_as), "katz-coded")
        words, pairs = _questions(coded, deal)
        known = _word_lists(unigrams, deal, spread=False)
        replies = words.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_answer_words, _REPLY)
        found = pairs.groupBy("bucket").cogroup(model.chunks(spark).groupBy("bucket")).applyInArrow(_answer_pairs, _REPLY)
        replies = replies.union(found).withColumnRenamed("slice", "of")
        done = coded.groupBy("slice").cogroup(replies.groupBy("of")).applyInArrow(evaluate, result)
        done = stage(done, "katz-scores")
        unstage(coded)
        return done

    return reduce(DataFrame.union, [scored(docs.where(turn == k)) for k in range(rounds)])
