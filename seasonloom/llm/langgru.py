"""Language of a text from a bidirectional gated recurrent network over its bytes.

Every text is cut into windows of at most ``width`` bytes that together cover it.  Two gated
recurrent layers read a window, one from either end; both states at a byte give the
probabilities of each language at that position.  A document's probabilities are the means
over its positions inside words (letters A-Z and the bytes of characters beyond ASCII), and
its language is the likeliest, of equals the first in byte order.

The network is written in NumPy.  Training runs backpropagation through time with Adam on the
driver, over a bounded sample: per language at most ``sample_texts`` different texts, those
first by a hash of the text, and of each at most ``sample_windows`` windows spread evenly over
it.  Prediction reads whole texts, in tasks, without a shuffle.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text
where nothing can be learned (no row has a text with a word and a language).  With one
language, that language has probability 1.  Repeated rows repeat their result; an empty table
gives an empty result.
Columns other than the text are passed through, and one named like an output is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonloom.llm.bytetext import LOWER, joined, slices
from seasonloom.llm.shipping import shipped
from seasonloom.session import stage, unstage

UNDETERMINED = "und"
_PAD = 0x0A
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[0x61:0x7B] = _INSIDE[0x80:] = True
_ASCII = np.zeros(256, dtype=bool)
_ASCII[0x61:0x7B] = True


@dataclass(frozen=True)
class Settings:
    width: int = 64
    units: int = 10
    sample_texts: int = 400
    sample_windows: int = 4
    epochs: int = 8
    batch: int = 256
    rate: float = 0.02
    seed: int = 11


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


# Weights of one direction: byte tables and recurrent matrices of the gates (update and
# reset side by side) and of the candidate, and the output weights.
_NAMES = ["gate_in", "gate_state", "new_in", "new_state", "new_bias", "out"]


def initial(languages: int, units: int, seed: int, kind=np.float32) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(kind)
    weights = {}
    for side in ("forward", "backward"):
        shapes = [(256, 2 * units), (units, 2 * units), (256, units), (units, units), (units,), (units, languages)]
        weights |= {f"{side}_{n}": draw(*s) for n, s in zip(_NAMES, shapes, strict=True)}
    return weights | {"bias": np.zeros(languages, dtype=kind)}


def states(weights: dict[str, np.ndarray], side: str, data: np.ndarray, keep: bool = False):
    """States after each byte of ``data`` (steps x windows), read from the side's own end.

    With ``keep`` also what backpropagation needs of each step.
    """
    gate_in, gate_state, new_in, new_state, new_bias = (weights[f"{side}_{n}"] for n in _NAMES[:5])
    units = new_state.shape[0]
    h = np.zeros((data.shape[1], units), dtype=new_in.dtype)
    out = np.empty((*data.shape, units), dtype=h.dtype)
    kept = [None] * len(data)
    for t in range(len(data)) if side == "forward" else range(len(data) - 1, -1, -1):
        gates = h @ gate_state
        gates += np.take(gate_in, data[t], axis=0)
        gates = _sigmoid(gates)
        z, r = gates[:, :units], gates[:, units:]
        inner = h @ new_state
        inner += new_bias
        n = r * inner
        n += np.take(new_in, data[t], axis=0)
        np.tanh(n, out=n)
        before, h = h, out[t]
        np.subtract(before, n, out=h)
        h *= z
        h += n
        if keep:
            kept[t] = (before, z, r, inner, n)
    return (out, kept) if keep else out


def position_probabilities(weights: dict[str, np.ndarray], data: np.ndarray) -> np.ndarray:
    """Probability of each language at each byte (languages x steps x windows)."""
    score = weights["bias"][:, None, None] + sum(
        np.tensordot(weights[f"{side}_out"], states(weights, side, data), axes=(0, 2)) for side in ("forward", "backward")
    )
    score -= score.max(axis=0)
    np.exp(score, out=score)
    score /= score.sum(axis=0)
    return score


def gradient(weights: dict[str, np.ndarray], data: np.ndarray, label: np.ndarray):
    """Mean loss over positions inside words, and its slope by every weight."""
    inside = _INSIDE[data]
    share = inside / max(int(inside.sum()), 1)
    passes = {side: states(weights, side, data, keep=True) for side in ("forward", "backward")}
    score = weights["bias"] + sum(passes[s][0] @ weights[f"{s}_out"] for s in passes)
    score = score - score.max(axis=-1, keepdims=True)
    odds = np.exp(score)
    p = odds / odds.sum(axis=-1, keepdims=True)
    windows = np.arange(len(label))
    loss = -(share * np.log(np.maximum(p[:, windows, label], 1e-30))).sum()
    p[:, windows, label] -= 1
    slope = (p * share[:, :, None]).astype(score.dtype)
    out = {"bias": slope.sum(axis=(0, 1))}
    for side, (state, kept) in passes.items():
        w = {n: weights[f"{side}_{n}"] for n in _NAMES}
        g = {n: np.zeros_like(x) for n, x in w.items()}
        g["out"] = np.tensordot(state, slope, axes=([0, 1], [0, 1]))
        toward = slope @ w["out"].T
        later = np.zeros_like(state[0])
        into_gates = np.empty((*data.shape, w["gate_in"].shape[1]), dtype=later.dtype)
        into_new = np.empty((*data.shape, later.shape[1]), dtype=later.dtype)
        for t in range(len(data) - 1, -1, -1) if side == "forward" else range(len(data)):
            before, z, r, inner, n = kept[t]
            dh = toward[t] + later
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            di = dn * r
            dg = np.concatenate((dz, dr), axis=1)
            into_gates[t], into_new[t] = dg, dn
            g["gate_state"] += before.T @ dg
            g["new_state"] += before.T @ di
            g["new_bias"] += di.sum(axis=0)
            later = dh * z + dg @ w["gate_state"].T + di @ w["new_state"].T
        flat = data.ravel()
        for name, into in (("gate_in", into_gates), ("new_in", into_new)):
            rows = into.reshape(len(flat), -1)
            g[name] = np.stack([np.bincount(flat, weights=c, minlength=256) for c in rows.T], axis=1).astype(rows.dtype)
        out |= {f"{side}_{n}": x for n, x in g.items()}
    return loss, out


def windows_of(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts in lower case, and text, start and length of their windows."""
    data, bounds = joined(texts)
    data = LOWER[data]
    size = np.diff(bounds) - 1
    count = -(-size // width)
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[:-1][text] + nth * width
    return data, text, start, np.minimum(width, bounds[1:][text] - 1 - start)


def laid_out(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Windows as columns of ``width`` bytes, filled up with line ends."""
    at = np.arange(width)[:, None]
    inside = at < length
    return np.where(inside, data[np.where(inside, at + start, 0)], np.uint8(_PAD))


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray]
    width: int

    def pooled(self, texts: pa.Array, block: int = 4096) -> np.ndarray:
        """Mean probability of each language over the positions inside words of each text."""
        data, text, start, length = windows_of(texts, self.width)
        total = np.zeros((len(texts), len(self.languages)))
        positions = np.zeros(len(texts))
        # Windows of like length together: short ones need few steps.
        steps = np.maximum(8, 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
        for width in np.unique(steps).tolist():
            alike = np.flatnonzero(steps == width)
            for k in range(0, len(alike), block):
                at = alike[k : k + block]
                laid = laid_out(data, start[at], length[at], min(width, self.width))
                p = position_probabilities(self.weights, laid)
                inside = _INSIDE[laid]
                for c, of_language in enumerate(p):
                    sums = (of_language * inside).sum(axis=0, dtype=np.float64)
                    total[:, c] += np.bincount(text[at], weights=sums, minlength=len(total))
                positions += np.bincount(text[at], weights=inside.sum(axis=0), minlength=len(total))
        return total / np.maximum(positions, 1)[:, None]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and its probability per text."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        p = self.pooled(texts)
        best = p.argmax(axis=1)
        found = lettered(texts)
        score = np.clip(np.where(found, p[np.arange(len(p)), best], 0.0), 0.0, 1.0)
        return [self.languages[b] if f else UNDETERMINED for b, f in zip(best.tolist(), found.tolist(), strict=True)], score


def lettered(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, bounds = joined(texts)
    data = LOWER[data]
    count = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[bounds]) > 0
    found, beyond = count(_ASCII[data]), count(data >= 0x80)
    for k in np.flatnonzero(beyond & ~found).tolist():
        found[k] = any(map(str.isalpha, texts[k].as_py()))
    return found


def fit(data: np.ndarray, label: np.ndarray, languages: list[str], settings: Settings = Settings()) -> Model:
    """Network of the labelled windows (columns of ``data``)."""
    if not languages or not len(label):
        return Model([], {}, settings.width)
    weights = initial(len(languages), settings.units, settings.seed)
    rng = np.random.default_rng(settings.seed)
    slow = {n: np.zeros_like(w) for n, w in weights.items()}
    square = {n: np.zeros_like(w) for n, w in weights.items()}
    parts = max(1, -(-len(label) // settings.batch))
    steps, k = settings.epochs * parts, 0
    for _ in range(settings.epochs):
        for at in np.array_split(rng.permutation(len(label)), parts):
            k += 1
            _, slope = gradient(weights, data[:, at], label[at])
            norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in slope.values())))
            cut = min(1.0, 1.0 / max(norm, 1e-12))
            rate = settings.rate * (1 - 0.9 * k / steps)
            for n, g in slope.items():
                slow[n] = 0.9 * slow[n] + 0.1 * cut * g
                square[n] = 0.99 * square[n] + 0.01 * (cut * g) ** 2
                weights[n] -= (rate * (slow[n] / (1 - 0.9**k)) / (np.sqrt(square[n] / (1 - 0.99**k)) + 1e-8)).astype(weights[n].dtype)
    return Model(languages, weights, settings.width)


def held_out(column: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text is two more than a multiple of four."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Network of a bounded sample of the rows of ``docs`` that have ``lang`` and ``text``."""
    shipped(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    rows = rows.withColumn("mark", F.xxhash64("text"))
    first = Window.partitionBy("lang").orderBy("mark")
    chosen = rows.select("lang", "mark").distinct().withColumn("place", F.row_number().over(first))
    # Written out, so that the join knows its size and need not move the texts.
    chosen = stage(chosen.where(F.col("place") <= settings.sample_texts).drop("place"), "langgru-sample")
    width, most = settings.width, settings.sample_windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                data, text, start, length = windows_of(part.column(2), width)
                out = []
                for k, n in enumerate(np.bincount(text, minlength=part.num_rows).tolist()):
                    at = np.flatnonzero(text == k)[np.unique(np.linspace(0, n - 1, min(n, most)).astype(int))]
                    out.append(laid_out(data, start[at], length[at], width).T.tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], ["lang", "mark", "windows"])

    picked = rows.join(chosen, ["lang", "mark"]).select("lang", "mark", "text")
    found = picked.mapInArrow(run, "lang string, mark long, windows binary").groupBy("lang", "mark").agg(F.min("windows").alias("windows"))
    found = sorted(found.collect(), key=lambda r: (r.lang.encode(), r.mark))
    unstage(chosen)
    languages = list(dict.fromkeys(r.lang for r in found))
    data = np.frombuffer(b"".join(bytes(r.windows) for r in found), dtype=np.uint8).reshape(-1, width)
    count = np.array([len(r.windows) // width for r in found], dtype=np.int64)
    label = np.repeat(np.array([languages.index(r.lang) for r in found], dtype=np.int64), count)
    useful = _INSIDE[data].any(axis=1)
    return fit(np.ascontiguousarray(data[useful].T), label[useful], languages, settings)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``lang_pred`` and ``score``; one pass, no shuffle."""
    shipped(docs.sparkSession)
    passed = [f for f in docs.schema.fields if f.name not in {text, "lang_pred", "score"}]
    schema = T.StructType(
        [*passed, T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(passed)):
                found, score = model.predict(part.column(len(passed)))
                columns = [*part.columns[: len(passed)], pa.array(found, pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return docs.select(*(F.col(f"`{f.name}`") for f in passed), F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)
