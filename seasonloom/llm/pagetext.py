"""Main text of web pages: a bidirectional LSTM labels every block of a page.

A page is cut into its leaf blocks (runs of text without a block element between them).  A
block is described by its tag path (element names, classes, ids and roles, hashed), its
words (hashed), and a few measures; the network reads the blocks of the whole page in both
directions and labels each as main text or not.  The text of a page is its main blocks.

The network is trained in NumPy on at most ``sample_pages`` pages, those first by a hash of
id and html, and at most ``sample_windows`` stretches of ``WINDOW`` blocks of each, spread
evenly over it, with labels that page landmarks give: inside ``article`` or ``main`` and in no
element whose name, class, id or role names a menu, header, footer, sidebar, notice, advert,
form or comments.  On pages without landmarks, long blocks with few links count as main.  In
training the landmarks are hidden from a tenth of the pages, so that words and context are
learned too.  Executors describe the sample; the driver receives numbers only.

Only scripts, styles, comments and tags are taken out of a page; formulas, fallback content and
the like are text that the network judges.  A quote delimits an attribute's value only after
an equals sign.  Elements share their path's description with what lies inside them, so a
page costs its length however deep its elements nest.

Defined cases: null html is an empty page with an empty text; what a page cut off inside a
tag or comment leaves is dropped, markup that is never closed counts as closed at the end
(so does a script, which then is the rest of the page); repeated rows repeat their text; an empty table trains nothing and gives no rows; a sample
with no main block gives empty texts.  Columns named like an output column are replaced.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonloom.llm.bytetext import slices
from seasonloom.llm.shipping import shipped
from seasonloom.session import stage, unstage

# Element names of HTML.
BLOCK = set(
    "address article aside blockquote body button caption dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style"}
LANDMARKS = {"article", "main"}
ASIDE = set("nav header footer aside form menu dialog button select fieldset head template textarea title".split())
ASIDE_WORDS = set(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "form header login menu modal nav navbar navigation newsletter notice pagination popup promo related reply "
    "replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*?)(?:>|(?=<)|\Z)|<[!?][^>]*(?:>|\Z)", re.S
)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PART = re.compile(r"[a-z]+")

PATHS, WORDS, MEASURES = 96, 64, 6
WIDTH = PATHS + WORDS + MEASURES
# Blocks of a stretch that is learned from at a time.
WINDOW = 48


@dataclass(frozen=True)
class Element:
    """An open element: its name, and what it and the elements around it say.

    ``slots`` are the hashed words of the whole path as bits, ``main`` says that a landmark is
    in it, ``aside`` that something else than main text is.
    """

    name: str
    depth: int
    slots: int
    main: bool
    aside: bool

    def within(self, name: str, attributes: str) -> Element:
        slots, main, aside = _described(name, attributes)
        return Element(name, self.depth + 1, self.slots | slots, self.main or main, self.aside or aside)


ROOT = Element("", 0, 0, False, False)


@dataclass
class Block:
    text: str
    inside: Element
    linked: int


@lru_cache(maxsize=1 << 14)
def _slot(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


def _described(name: str, attributes: str) -> tuple[int, bool, bool]:
    """Slots of an element's name and of the words of its class, id and role; main; aside."""
    found = [value.strip("\"'").lower() for _, value in _NAMED.findall(attributes)] if "=" in attributes else []
    words = {w for value in found for w in _PART.findall(value)}
    slots = 0
    for word in {name, *words}:
        slots |= 1 << _slot(word, PATHS)
    return slots, name in LANDMARKS, name in ASIDE or not ASIDE_WORDS.isdisjoint(words)


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, without empty ones."""
    out: list[Block] = []
    stack: list[Element] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, stack[-1] if stack else ROOT, linked))
        parts.clear()
        linked = 0

    def close(name: str) -> None:
        if opened[name]:
            while True:
                last = stack.pop().name
                opened[last] -= 1
                if last == name:
                    return

    at, n = 0, len(page)
    while at < n:
        tag = _TOKEN.search(page, at)
        text = page[at : tag.start()] if tag else page[at:]
        if text:
            parts.append(text)
            if opened["a"]:
                linked += len(text)
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            continue
        name, closing = tag[2].lower(), bool(tag[1])
        if name in RAW:
            if not closing:
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else n
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
        if name in BLOCK:
            flush()
        if closing:
            close(name)
        elif name not in VOID and not tag[3].endswith("/"):
            if name in BLOCK:
                close("p")
            if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1].name == name:
                close(name)
            stack.append((stack[-1] if stack else ROOT).within(name, tag[3]))
            opened[name] += 1
    flush()
    return out


def landmark_labels(page: list[Block]) -> list[bool]:
    """Training labels: what landmarks say, or length and links where there are none."""

    if any(b.inside.main for b in page):
        return [b.inside.main and not b.inside.aside for b in page]
    return [len(b.text) >= 80 and 4 * b.linked < len(b.text) and not b.inside.aside for b in page]


def describe(page: list[Block]) -> np.ndarray:
    """One row of ``WIDTH`` numbers per block."""
    out = np.zeros((len(page), WIDTH), dtype=np.float32)
    slots = b"".join(b.inside.slots.to_bytes(PATHS // 8, "little") for b in page)
    out[:, :PATHS] = np.unpackbits(np.frombuffer(slots, np.uint8).reshape(len(page), PATHS // 8), axis=1, bitorder="little")
    for k, b in enumerate(page):
        if b.inside is not ROOT:
            out[k, _slot("leaf " + b.inside.name, PATHS)] = 1.0
        words = [zlib.crc32(w) % WORDS for w in b.text.lower().encode().split()]
        out[k, PATHS : PATHS + WORDS] = np.bincount(words, minlength=WORDS) / max(len(words), 1)
        n = len(b.text)
        out[k, PATHS + WORDS :] = (
            np.log1p(n) / 8,
            b.linked / max(n, 1),
            sum(b.text.count(c) for c in ".,;:") * 10 / max(n, 1),
            k / len(page),
            1.0,
            min(b.inside.depth, 50) / 10,
        )
    return out


class Cells:
    """Steps over sequences of different lengths, longest first."""

    def __init__(self, bounds: np.ndarray):
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        self.order = order[length[order] > 0]
        self.first, self.length = bounds[:-1][self.order], length[self.order]

    def steps(self, backward: bool) -> Iterator[np.ndarray]:
        alive = len(self.length)
        for t in range(int(self.length[0]) if alive else 0):
            while self.length[alive - 1] <= t:
                alive -= 1
            yield (self.first + (self.length - 1 - t if backward else t))[:alive]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pass(x: np.ndarray, cells: Cells, w: dict[str, np.ndarray], side: str, keep: list | None) -> np.ndarray:
    """Hidden states of one direction; ``keep`` receives what the way back needs."""
    size = w[f"u{side}"].shape[0]
    given = x @ w[f"w{side}"] + w[f"b{side}"]
    hidden = np.zeros((len(x), size))
    h = c = np.zeros((0, size))
    for at in cells.steps(side == "r"):
        h, c = (np.zeros((len(at), size)),) * 2 if not len(h) else (h[: len(at)], c[: len(at)])
        gates = given[at] + h @ w[f"u{side}"]
        i, f, o = (_sigmoid(gates[:, k * size : (k + 1) * size]) for k in range(3))
        g = np.tanh(gates[:, 3 * size :])
        new = f * c + i * g
        out = o * np.tanh(new)
        if keep is not None:
            keep.append((at, h, c, i, f, o, g, new))
        h, c = out, new
        hidden[at] = out
    return hidden


def _back(x: np.ndarray, slope: np.ndarray, w: dict[str, np.ndarray], side: str, kept: list) -> dict[str, np.ndarray]:
    size = w[f"u{side}"].shape[0]
    d_given = np.zeros((len(x), 4 * size))
    d_u = np.zeros_like(w[f"u{side}"])
    d_h = d_c = np.zeros((0, size))
    for at, h, c, i, f, o, g, new in reversed(kept):
        grow = lambda d: np.concatenate((d, np.zeros((len(at) - len(d), size))))
        dh, dc = slope[at] + grow(d_h), grow(d_c)
        t = np.tanh(new)
        dc = dc + dh * o * (1 - t**2)
        gates = np.concatenate(
            (dc * g * i * (1 - i), dc * c * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - g**2)), axis=1
        )
        d_given[at] = gates
        d_u += h.T @ gates
        d_h, d_c = gates @ w[f"u{side}"].T, dc * f
    return {f"w{side}": x.T @ d_given, f"b{side}": d_given.sum(axis=0), f"u{side}": d_u}


@dataclass
class Labeller:
    weights: dict[str, np.ndarray]

    def main(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probability of each block to be main text."""
        cells = Cells(bounds)
        states = [_pass(features, cells, self.weights, side, None) for side in "lr"]
        return _sigmoid(np.concatenate(states, axis=1) @ self.weights["v"] + self.weights["a"])


def fit(
    pages: list[tuple[np.ndarray, np.ndarray]], hidden: int = 16, rounds: int = 10, batch: int = 16, window: int = WINDOW, seed: int = 5
) -> Labeller:
    """Labeller of (block features, labels) pairs: Adam on the mean cross-entropy."""
    rng = np.random.default_rng(seed)
    shapes = {"w": (WIDTH, 4 * hidden), "u": (hidden, 4 * hidden), "b": (4 * hidden,)}
    w = {k + side: rng.normal(size=s) * 0.15 * (k != "b") for side in "lr" for k, s in shapes.items()}
    w |= {"v": rng.normal(size=2 * hidden) * 0.3, "a": np.zeros(1)}
    parts = [(x[k : k + window], y[k : k + window]) for x, y in pages for k in range(0, len(x), window)]
    moments = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in w.items()}
    marks = [_slot(word, PATHS) for word in LANDMARKS]
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(parts))
        for start in range(0, len(order), batch):
            chosen = [parts[k] for k in order[start : start + batch]]
            x = np.concatenate([p[0] for p in chosen]).astype(np.float64)
            y = np.concatenate([p[1] for p in chosen]).astype(np.float64)
            bounds = np.cumsum([0, *(len(p[0]) for p in chosen)])
            veiled = np.repeat(rng.random(len(chosen)) < 0.1, np.diff(bounds))
            x[np.ix_(veiled, marks)] = 0
            cells, kept = Cells(bounds), {"l": [], "r": []}
            states = np.concatenate([_pass(x, cells, w, side, kept[side]) for side in "lr"], axis=1)
            error = (_sigmoid(states @ w["v"] + w["a"]) - y) / len(y)
            slope = error[:, None] * w["v"]
            gradient = {"v": states.T @ error, "a": error.sum(keepdims=True)}
            gradient |= _back(x, slope[:, :hidden], w, "l", kept["l"])
            gradient |= _back(x, slope[:, hidden:], w, "r", kept["r"])
            step += 1
            for k, d in gradient.items():
                m, v = moments[k]
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                w[k] = w[k] - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Labeller(w)


def train(pages: DataFrame, sample_pages: int = 300, sample_windows: int = 20) -> Labeller:
    """Labeller from at most ``sample_pages`` pages."""
    shipped(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("mark", F.xxhash64("page_id", "html"))
    marks = rows.select("mark").distinct().orderBy("mark").limit(sample_pages)
    # Written out, so that the join knows its size and need not move the pages.
    marks = stage(marks, "pagetext-sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                x, y = [], []
                for page in map(blocks, (t or "" for t in part.column(1).to_pylist())):
                    starts = np.arange(0, len(page), WINDOW)
                    if len(starts) > sample_windows:
                        starts = starts[np.linspace(0, len(starts) - 1, sample_windows).astype(int)]
                    picked = [k for s in starts for k in range(s, min(s + WINDOW, len(page)))]
                    x.append(describe(page)[picked].tobytes())
                    y.append(np.array(landmark_labels(page), dtype=np.uint8)[picked].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.binary()), pa.array(y, pa.binary())], ["mark", "x", "y"])

    found = rows.join(marks, "mark").select("mark", "html").mapInArrow(run, "mark long, x binary, y binary")
    found = found.groupBy("mark").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    found = sorted(found.collect(), key=lambda r: r.mark)
    unstage(marks)
    return fit([(np.frombuffer(r.x, np.float32).reshape(-1, WIDTH), np.frombuffer(r.y, np.uint8)) for r in found])


def extract(pages: DataFrame, labeller: Labeller, threshold: float = 0.5) -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars``; one pass, no shuffle."""
    shipped(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name not in {"html", "text", "n_chars"}]
    schema = T.StructType([*kept, T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])
    last = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, last, 2 << 20):
                found = [blocks(t or "") for t in part.column(last).to_pylist()]
                bounds = np.cumsum([0, *map(len, found)])
                features = np.concatenate([np.zeros((0, WIDTH), np.float32), *map(describe, found)])
                main = labeller.main(features, bounds) >= threshold
                texts = [
                    "\n".join(b.text for b, own in zip(page, main[a:], strict=False) if own)
                    for page, a in zip(found, bounds, strict=False)
                ]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                columns = [*part.columns[:last], pa.array(texts, pa.string()), sizes]
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    source = pages.select(*(F.col(f"`{f.name}`") for f in kept), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(run, schema)
