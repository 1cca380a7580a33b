"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad.  A line's evidence is a weighted sum of
its own measures and those of its neighbours; a transition weight per pair of labels links
consecutive lines.  Forward-backward gives each line's probability of being good, and a
document's score is the mean of these, weighted by line length in bytes.

The model is fitted by gradient ascent on the likelihood of lines that carry their
document's label, on at most ``sample_rows`` labelled documents (those first by a hash of
their id; chains are cut to ``chain`` lines for fitting only).  Executors measure the
sample; the driver receives the measures of its lines and never a text: of a labelled id one
text, the first by hash, and at most ``sample_lines`` lines, spread evenly over it.

Defined cases: a text without words, null or empty, scores 0; repeated rows repeat their
score; rows without a label, or with a null one, are not learned from; a document labelled
twice counts as bad if either label says so.  A sample with one class, or none, gives every
text with words that class's share (or 0.5).  Extra columns are passed through, and one
named like an output column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonloom.llm.bytetext import LOWER, SEPARATORS, combine, hashes, joined, released, slices, spans
from seasonloom.llm.shipping import shipped

_NEWLINE = 0x0A


def _class(characters: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.float32)
    out[list(characters.encode())] = 1
    return out


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CLASSES = {
    "upper": _class(_LETTERS.upper()),
    "lower": _class(_LETTERS),
    "digit": _class("0123456789"),
    "symbol": _class("#*$%&<>@^~=+_\\"),
    "pipe": _class("|"),
    "stop": _class(".,;:"),
    "shout": _class("!?"),
    "bracket": _class("()[]{}\"'/"),
    "wide": (np.arange(256) >= 0x80).astype(np.float32),
}
MEASURES = [*_CLASSES, "length", "words", "word_length", "repeat_1", "repeat_2", "distinct", "seen_before"]


@dataclass
class Lines:
    """Measures of the lines of a batch; ``bounds`` delimits each text's lines."""

    measures: np.ndarray
    weight: np.ndarray
    bounds: np.ndarray


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[ends] - total[starts]


def measure(texts: pa.Array) -> Lines:
    data, bounds = joined(texts, _NEWLINE)
    breaks = np.flatnonzero(data == _NEWLINE)
    starts = np.concatenate(([0], breaks[:-1] + 1)) if len(breaks) else breaks
    word_start, word_end = spans(data)
    first = np.searchsorted(word_start, starts)
    last = np.searchsorted(word_start, breaks)
    full = last > first
    starts, ends, first, last = starts[full], breaks[full], first[full], last[full]
    text_of = np.searchsorted(bounds, starts, side="right") - 1
    per_text = np.bincount(text_of, minlength=len(bounds) - 1)
    n = (last - first).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    columns = [_sums(table[data], starts, ends) / n for table in _CLASSES.values()]

    word = hashes(LOWER[data], word_start, word_end)
    line_of = np.repeat(np.arange(len(starts)), (last - first))
    same = lambda k: np.concatenate(
        (np.zeros(min(k, len(word))), (word[k:] == word[:-k]) & (line_of[k:] == line_of[:-k]))
    )
    order = np.lexsort((word, line_of))
    new = np.ones(len(word))
    new[1:] = (word[order][1:] != word[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])
    letters = _sums(~SEPARATORS[data], starts, ends)
    columns += [np.log1p(length), np.log1p(n), letters / n]
    columns += [_sums(same(k), first, last) / n for k in (1, 2)]
    columns.append(_sums(new, first, last) / n)

    line = combine(hashes(data, starts, ends), text_of.astype(np.uint64))
    _, earliest, which = np.unique(line, return_index=True, return_inverse=True)
    columns.append((earliest[which] < np.arange(len(line))).astype(np.float64))
    return Lines(
        np.stack(columns, axis=1).astype(np.float32),
        length.astype(np.float32),
        np.concatenate(([0], np.cumsum(per_text))),
    )


def evidence(lines: Lines, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Measures of each line, of the line before and of the line after, and edge flags."""
    own = np.clip((lines.measures - mean) / scale, -6, 6)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edges = np.zeros((len(own), 2), dtype=np.float32)
    full = lines.bounds[1:] > lines.bounds[:-1]
    begin, end = lines.bounds[:-1][full], lines.bounds[1:][full] - 1
    before[begin], after[end] = 0, 0
    edges[begin, 0], edges[end, 1] = 1, 1
    ones = np.ones((len(own), 1), dtype=np.float32)
    return np.concatenate((own, before, after, edges, ones), axis=1)


@dataclass
class Chains:
    """Chains of lines, longest first, so that step t concerns a prefix of them."""

    start: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, bounds: np.ndarray) -> Chains:
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        order = order[length[order] > 0]
        return cls(bounds[:-1][order], length[order])

    def steps(self) -> Iterator[np.ndarray]:
        alive = len(self.length)
        for t in range(int(self.length[0]) if alive else 0):
            while self.length[alive - 1] <= t:
                alive -= 1
            yield self.start[:alive] + t


def marginals(score: np.ndarray, switch: np.ndarray, chains: Chains, pairs: bool = False):
    """Probability that each line is good; with ``pairs`` also the expected transitions.

    ``score`` is the log-odds a line's evidence gives to good, ``switch`` the 2 x 2
    transition weights.  Messages are scaled to sum to one at each line.
    """
    odds = np.exp(np.clip(score, -30, 30)).astype(np.float64)
    local = np.stack((1 / (1 + odds), odds / (1 + odds)), axis=1)
    step = np.exp(switch)
    forward, backward = np.zeros_like(local), np.ones_like(local)
    rows = list(chains.steps())
    for t, at in enumerate(rows):
        message = local[at] if t == 0 else local[at] * (forward[at - 1] @ step)
        forward[at] = message / message.sum(axis=1, keepdims=True)
    for at in reversed(rows[1:]):
        message = (local[at] * backward[at]) @ step.T
        backward[at - 1] = message / message.sum(axis=1, keepdims=True)
    both = forward * backward
    good = both[:, 1] / np.maximum(both.sum(axis=1), 1e-300)
    if not pairs:
        return good
    expected = np.zeros((2, 2))
    for at in rows[1:]:
        joint = forward[at - 1][:, :, None] * step * (local[at] * backward[at])[:, None, :]
        expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    return good, expected


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    switch: np.ndarray
    prior: float | None = None

    def scores(self, texts: pa.Array) -> np.ndarray:
        lines = measure(texts)
        total = np.zeros(len(texts))
        some = lines.bounds[1:] > lines.bounds[:-1]
        if self.prior is not None:
            return np.where(some, self.prior, 0.0)
        if some.any():
            good = marginals(
                evidence(lines, self.mean, self.scale) @ self.weights, self.switch, Chains.of(lines.bounds)
            )
            begin = lines.bounds[:-1][some]
            weighted = np.add.reduceat(good * lines.weight, begin)
            total[some] = weighted / np.add.reduceat(lines.weight.astype(np.float64), begin)
        return np.clip(total, 0.0, 1.0)


def fit(parts: list[tuple[int, np.ndarray]], chain: int = 32, steps: int = 100, penalty: float = 1e-3) -> Model:
    """Model of (label, line measures) pairs: Adam on the penalised likelihood."""
    width = len(MEASURES)
    parts = [p for p in parts if len(p[1])]
    labels = np.array([label for label, _ in parts])
    if not len(labels) or labels.min() == labels.max():
        flat = np.zeros(3 * width + 3)
        prior = float(labels[0]) if len(labels) else 0.5
        return Model(np.zeros(width), np.ones(width), flat, np.zeros((2, 2)), prior)
    measures = np.concatenate([m for _, m in parts])
    mean, scale = measures.mean(axis=0), measures.std(axis=0) + 1e-3
    size = np.array([len(m) for _, m in parts])
    bounds = np.concatenate(([0], np.cumsum(size)))
    features = evidence(Lines(measures, np.ones(len(measures)), bounds), mean, scale)
    cut = np.unique(np.concatenate([bounds, *(np.arange(b, e, chain) for b, e in zip(bounds[:-1], bounds[1:], strict=True))]))
    chains = Chains.of(cut)
    target = np.repeat(labels, size).astype(np.float64)
    # A document counts once however many lines it has.
    share = np.repeat(1.0 / np.sqrt(size), size)
    share *= len(share) / share.sum()
    inner = np.setdiff1d(np.arange(len(target)), cut[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (target[inner - 1].astype(int), target[inner].astype(int)), 1)
    weights, switch = np.zeros(features.shape[1]), np.zeros((2, 2))
    state = [np.zeros(weights.size + 4), np.zeros(weights.size + 4)]
    for k in range(1, steps + 1):
        good, expected = marginals(features @ weights, switch, chains, pairs=True)
        slope = features.T @ (share * (target - good)) / len(target) - penalty * weights
        turn = (seen - expected) / len(target) - 10 * penalty * switch
        gradient = np.concatenate((slope, turn.ravel()))
        state[0] = 0.9 * state[0] + 0.1 * gradient
        state[1] = 0.99 * state[1] + 0.01 * gradient**2
        move = 0.05 * (state[0] / (1 - 0.9**k)) / (np.sqrt(state[1] / (1 - 0.99**k)) + 1e-8)
        weights = weights + move[:-4]
        switch = switch + move[-4:].reshape(2, 2)
    return Model(mean, scale, weights, switch)


def held_out(column: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text is divisible by five."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def train(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, chain: int = 32, sample_lines: int = 512
) -> Model:
    """Model of at most ``sample_rows`` labelled documents that are not held out."""
    shipped(docs.sparkSession)
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(sample_rows)
    )
    # At most sample_rows pairs of numbers.
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                lines = measure(part.column(1))
                rows = []
                for a, b in zip(lines.bounds[:-1].tolist(), lines.bounds[1:].tolist(), strict=True):
                    at = np.arange(a, b) if b - a <= sample_lines else np.linspace(a, b - 1, sample_lines).astype(int)
                    rows.append(lines.measures[at].tobytes())
                columns = [part.column(0), part.column(2), part.column(3), pa.array(rows, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "mark", "measures"])

    chosen = texts.select(F.col("doc_id").cast("long"), "text", F.col("label").cast("int"), F.xxhash64("text"))
    measured = chosen.mapInArrow(run, "doc_id long, label int, mark long, measures binary")
    # One text of each id, however many rows carry it.
    first = measured.groupBy("doc_id", "label").agg(F.min(F.struct("mark", "measures")).alias("m"))
    rows = sorted(first.select("doc_id", "label", "m.measures").collect(), key=lambda r: r.doc_id)
    shape = (-1, len(MEASURES))
    return fit([(int(r.label > 0), np.frombuffer(r.measures, np.float32).reshape(shape)) for r in rows], chain)


def _field(batch: pa.RecordBatch, path: list[str]) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(path[0]))
    for name in path[1:]:
        column = pc.struct_field(column, name)
    return column


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``; one pass, no shuffle.  The text may be a field of a struct (``row.text``)."""
    shipped(docs.sparkSession)
    kept = docs.drop("score")
    schema = T.StructType([*kept.schema, T.StructField("score", T.DoubleType(), False)])
    path = [text] if text in kept.columns else text.split(".")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in slices(batch, _field(batch, path)):
                values = pa.array(model.scores(_field(part, path)))
                yield pa.RecordBatch.from_arrays([*part.columns, values], schema.fieldNames())

    return kept.mapInArrow(run, schema)
