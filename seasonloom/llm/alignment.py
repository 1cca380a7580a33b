"""Alignment of two tokenizers' tokens over the same bytes, with corpus-wide link counts.

A text with a space in front is cut into tokens by a byte-level BPE (A) and by a SentencePiece
model (B, which adds the space).  Offsets where a token of both ends cut the text into groups;
an A and a B token are linked where their byte ranges overlap.

Token ends of a slice of texts form two sorted lists.  Merging them is a path through a grid,
which diagonals at equal distances cut into pieces of equal work: a binary search finds where
each diagonal meets the path.  A piece needs only its own ends and emits the overlaps that end
in it; an end that both lists share may lie on the border of two pieces, and is stitched by a
look at the last end before the piece.  Shared ends of all pieces delimit the groups.

A slice keeps its different id pairs with totals, and which text holds which pair how often.
It travels as rows of bounded size, stored in small row groups, as readers and writers hold a
group at once.  Pair totals are added over all slices.  Only a slice's different pairs meet the
corpus counts, so the most frequent pair of a corpus costs a slice one row however many texts
hold it.

Defined cases: a text that is null or empty, or whose A or B tokens do not spell space and
text (one that spells the mark U+2581, say), has no tokens: zeros and an empty digest string.
Rows that repeat an id are aligned and counted each; a null id is an id; the strings of
special tokens are plain text; an empty table gives an empty result.  Only ``doc_id`` and
``text`` are read, so further columns cannot clash.  A single very long text is one slice.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonloom.llm import pieces
from seasonloom.llm.bytetext import SEPARATORS, joined, ragged, released, slices, spans
from seasonloom.llm.shipping import shipped
from seasonloom.session import stage, unstage

# How the byte-level model cuts a text before merging (fixed by the tokenizer).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Texts of Latin letters have lead bytes below this one; beyond, character classes may
# differ between Unicode versions, so the tokenizer's own library cuts the text.
_LATIN = 0xCD
_LONG = 512
_LOW = (1 << 32) - 1
# Entries of a slice's lists in one row, and bytes of a row group of such rows.
_ENTRIES = 1 << 14
_ROW_GROUP = 8 << 20


def _byte_of_character() -> dict[str, int]:
    """Byte-level alphabet: printing bytes of Latin-1 as themselves, the others from U+0100 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printing]
    return {chr(b): b for b in printing} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Spellings:
    """Bytes of every token id, in one pool."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def unlike(self, ids: np.ndarray, data: np.ndarray, step: int = 1 << 18) -> np.ndarray:
        """Positions of ``data`` that the tokens spell otherwise; both have the same length."""
        end = np.cumsum(self.length[ids])
        wrong, at = [np.zeros(0, dtype=np.int64)], 0
        for k in range(0, len(ids), step):
            part = ids[k : k + step]
            spelled = self.pool[ragged(self.start[part], self.length[part])]
            wrong.append(np.flatnonzero(spelled != data[at : at + len(spelled)]) + at)
            at = int(end[min(k + step, len(ids)) - 1])
        return np.concatenate(wrong)


class ByteLevel:
    """Ids of the byte-level model.

    The same merges run in two libraries: the faster one takes texts whose characters both
    class alike, the tokenizer's own all others, and texts with very long words.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path, self.library = path, None
        byte_of = _byte_of_character()
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        vocabulary = {bytes(byte_of[c] for c in t): i for t, i in described["model"]["vocab"].items()}
        added = {t["id"]: t["content"].encode() for t in described["added_tokens"]}
        by_id = {i: t for t, i in vocabulary.items()} | added
        self.spellings = Spellings([by_id.get(i, b"") for i in range(max(by_id) + 1)])
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})

    def own(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = True
        return self.library.encode(text, add_special_tokens=False).ids

    def batch(self, texts: list[str], data: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
        start, end = spans(np.append(data, np.uint8(0x20)))
        odd = np.flatnonzero(data >= _LATIN)
        odd = np.concatenate((odd, start[end - start > _LONG]))
        blank = SEPARATORS[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], blank, [False])).astype(np.int8)))
        odd = np.concatenate((odd, edge[0::2][edge[1::2] - edge[0::2] > _LONG]))
        slow = np.zeros(len(texts), dtype=bool)
        slow[np.searchsorted(bounds, odd, side="right") - 1] = True
        return [self.own(" " + t) if s else self.fast.encode_ordinary(" " + t) for t, s in zip(texts, slow.tolist(), strict=True)]


def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How many of a and of b precede each cut of their merge, ``piece`` steps apart.

    Of equal ends that of a comes first.  All binary searches advance together.
    """
    total = len(a) + len(b)
    at = np.append(np.arange(0, total, piece), total)
    low, high = np.maximum(at - len(b), 0), np.minimum(at, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        here, other = middle[open_], (at - 1 - middle)[open_]
        takes = a[here] <= b[other]
        low[open_] = np.where(takes, here + 1, low[open_])
        high[open_] = np.where(takes, high[open_], here)
    return low, at - low


def overlaps(a: np.ndarray, b: np.ndarray, i: tuple[int, int], j: tuple[int, int]):
    """Overlapping tokens whose shared range ends in a piece, and the piece's shared ends.

    The piece holds the ends ``a[i[0]:i[1]]`` and ``b[j[0]:j[1]]``.  Returned are token
    indices into a and b, and those of tokens that end together.
    """
    of_a, of_b = a[i[0] : i[1]], b[j[0] : j[1]]
    in_a = np.arange(*i)
    facing = j[0] + np.searchsorted(of_b, of_a)
    together = b[facing] == of_a
    in_b = np.arange(*j)
    covering = i[0] + np.searchsorted(of_a, of_b)
    shared = a[np.minimum(covering, len(a) - 1)] == of_b
    if len(of_b) and i[0]:
        shared[0] |= a[i[0] - 1] == of_b[0]
    alone = ~shared
    return (
        np.concatenate((in_a, covering[alone])),
        np.concatenate((facing, in_b[alone])),
        in_a[together],
        facing[together],
    )


def merged(a: np.ndarray, b: np.ndarray, piece: int = 1 << 16):
    """Overlaps and shared ends of two ascending lists of ends with the same last end."""
    i, j = diagonals(a, b, piece)
    parts = [
        overlaps(a, b, (int(i[k]), int(i[k + 1])), (int(j[k]), int(j[k + 1]))) for k in range(len(i) - 1)
    ]
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([none, *(p[k] for p in parts)]).astype(np.int64) for k in range(4))


class Aligner:
    def __init__(self, byte_level: str, piece_model: str):
        self.a = ByteLevel(byte_level)
        self.b = pieces.encoder(piece_model)
        library = self.b.library
        spelled = []
        for k in range(library.get_piece_size()):
            piece = library.id_to_piece(k)
            byte = library.is_byte(k)
            spelled.append(bytes([int(piece[3:5], 16)]) if byte else piece.replace("▁", " ").encode())
        self.b_spellings = Spellings(spelled)
        most = max(len(self.a.spellings.length), len(spelled))
        mark = lambda end: np.array([b"%d%b" % (k, end) for k in range(most)], dtype=object)
        self.comma, self.bar, self.semicolon = mark(b","), mark(b"|"), mark(b";")

    def encoded(self, texts: list[str]):
        """Ids of both models, their ends in the bytes of all texts, and each text's token counts.

        Texts that a model does not spell have no tokens.
        """
        column = pa.array(texts, pa.large_string())
        data, bounds = joined(column, 0x20)
        # One blank in front of every text.
        data = np.concatenate((np.array([0x20], np.uint8), data[:-1])) if len(data) else data
        a = self.a.batch(texts, data, bounds)
        n_a = np.array([len(x) for x in a], dtype=np.int64)
        a = np.fromiter(chain.from_iterable(a), dtype=np.int64, count=int(n_a.sum()))
        b, _, _, cut = self.b.batch(column)
        n_b = np.diff(cut)
        b = b.astype(np.int64)
        text = np.arange(len(texts))
        size = np.diff(bounds)
        fits = size > 1
        for ids, n, table in ((a, n_a, self.a.spellings), (b, n_b, self.b_spellings)):
            length = np.bincount(np.repeat(text, n), weights=table.length[ids], minlength=len(texts))
            fits &= length == size
        for ids, n, table in ((a, n_a, self.a.spellings), (b, n_b, self.b_spellings)):
            inside = np.repeat(fits, size)
            owner = np.repeat(text, size)[inside]
            fits[owner[table.unlike(ids[np.repeat(fits, n)], data[inside])]] = False
        a, b = a[np.repeat(fits, n_a)], b[np.repeat(fits, n_b)]
        n_a, n_b = np.where(fits, n_a, 0), np.where(fits, n_b, 0)
        return a, b, np.cumsum(self.a.spellings.length[a]), np.cumsum(self.b_spellings.length[b]), n_a, n_b

    def digests(self, a, b, n_a, n_b, end_a, end_b) -> list[str]:
        """SHA-256 of each text's groups, written out; ``end_a``, ``end_b`` end them together."""
        group_a = np.searchsorted(end_a, np.arange(len(a)))
        group_b = np.searchsorted(end_b, np.arange(len(b)))
        before_b = np.concatenate(([0], end_b + 1))[:-1] if len(end_b) else end_b
        items = np.empty(len(a) + len(b), dtype=object)
        last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
        last_a[end_a], last_b[end_b] = True, True
        items[np.arange(len(a)) + before_b[group_a]] = np.where(last_a, self.bar[a], self.comma[a])
        items[np.arange(len(b)) + end_a[group_b] + 1] = np.where(last_b, self.semicolon[b], self.comma[b])
        edge = np.concatenate(([0], np.cumsum(n_a + n_b))).tolist()
        return [
            hashlib.sha256(b"".join(items[x:y])[:-1]).hexdigest() if y > x else "" for x, y in zip(edge[:-1], edge[1:], strict=True)
        ]


@lru_cache(maxsize=2)
def aligner(byte_level: str, piece_model: str) -> Aligner:
    return Aligner(byte_level, piece_model)


_PER_TEXT = ["n_a", "n_b", "n_groups", "n_links"]


def _cut(values: pa.Array, rows: int) -> pa.ListArray:
    """Values dealt over rows in order, about equally many to each."""
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * len(values) // rows, pa.int32()), values)


def _aligned(part: pa.RecordBatch, tool: Aligner, name: int, entries: int) -> list[pa.Array]:
    """Rows for a slice of (doc_id, text); none holds more than ``entries`` of any list.

    Every list of the slice is cut over its rows in order, each for itself.
    """
    texts = [t or "" for t in part.column(1).to_pylist()]
    a, b, end_a, end_b, n_a, n_b = tool.encoded(texts)
    link_a, link_b, cut_a, cut_b = merged(end_a, end_b)
    text_of = np.repeat(np.arange(len(texts)), n_a)
    sha = tool.digests(a, b, n_a, n_b, cut_a, cut_b)
    owner = text_of[link_a]
    pair, code = np.unique(a[link_a] << 32 | b[link_b], return_inverse=True)
    width = max(len(pair), 1).bit_length()
    packed = np.sort(owner << width | code)
    first = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1]))) if len(packed) else packed
    held = packed[first]
    count = lambda x: np.bincount(x, minlength=len(texts))
    rows = max(1, -(-max(len(texts), len(held)) // entries))
    cut = lambda x, kind: _cut(pa.array(x, kind), rows)
    return [
        pa.array([name] * rows, pa.int64()),
        pa.array(range(rows), pa.int32()),
        pa.array(np.arange(rows) * len(pair) // rows, pa.int64()),
        _cut(part.column(0), rows),
        *(cut(x, pa.int64()) for x in (n_a, n_b, count(text_of[cut_a]), count(owner))),
        cut(sha, pa.string()),
        cut(pair, pa.int64()),
        cut(np.bincount(code, minlength=len(pair)).astype(np.int64), pa.int64()),
        cut(count(held >> width).astype(np.int32), pa.int32()),
        cut((held & ((1 << width) - 1)).astype(np.int32), pa.int32()),
        cut(np.diff(np.append(first, len(packed))).astype(np.int32), pa.int32()),
    ]


def _sums(rows: pa.Table, known: pa.Table) -> pa.Table:
    """Texts of a slice with their links' counts; ``known`` holds its pairs' (pos, n, best)."""
    rows = rows.take(pa.array(np.argsort(rows["row"].to_numpy())))
    flat = lambda t, k: t[k].combine_chunks().to_numpy(zero_copy_only=False)
    inner = lambda k: rows[k].combine_chunks().flatten()
    n = np.zeros(known.num_rows, dtype=np.int64)
    best = np.zeros(known.num_rows, dtype=np.int64)
    at = flat(known, "pos")
    n[at], best[at] = flat(known, "n"), flat(known, "best")
    held, code, times = (inner(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("held", "code", "times"))
    edge = np.concatenate(([0], np.cumsum(held)))
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x[code] * times)))[edge])
    ids = inner("doc_id")
    columns = {"doc_id": ids} | {k: inner(k) for k in _PER_TEXT}
    columns |= {"n_best": pa.array(total(best)), "count_sum": pa.array(total(n)), "groups_sha256": inner("groups_sha256")}
    return pa.table(columns)


def align(
    docs: DataFrame, byte_level: str, piece_model: str, slice_bytes: int = 2 << 20, entries: int = _ENTRIES
) -> DataFrame:
    """Per row ``doc_id``, token, group and link counts, ``n_best``, ``count_sum`` and the groups' digest."""
    shipped(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key = docs.schema["doc_id"].dataType
    per = lambda kind: T.ArrayType(kind)
    longs, ints = per(T.LongType()), per(T.IntegerType())
    schema = T.StructType(
        [T.StructField("slice", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("first", T.LongType())]
        + [T.StructField("doc_id", per(key))]
        + [T.StructField(k, longs) for k in _PER_TEXT]
        + [T.StructField("groups_sha256", per(T.StringType())), T.StructField("pair", longs), T.StructField("total", longs)]
        + [T.StructField(k, ints) for k in ("held", "code", "times")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(byte_level, piece_model)
        name = TaskContext.get().partitionId() << 33
        for batch in released(batches):
            for part in slices(batch, 1, slice_bytes):
                yield pa.RecordBatch.from_arrays(_aligned(part, tool, name, entries), schema.fieldNames())
                name += 1

    rows = stage(docs.mapInArrow(run, schema), "alignment-slices", row_group=_ROW_GROUP)
    totals = rows.select(F.explode(F.arrays_zip("pair", "total")).alias("t"))
    counts = totals.groupBy(F.col("t.pair").alias("pair")).agg(F.sum("t.total").alias("n"))
    counts = counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(_LOW)))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    counts = counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    counts = stage(counts, "alignment-counts")
    known = rows.select(F.col("slice").alias("of"), "first", F.posexplode("pair").alias("at", "pair"))
    known = known.withColumn("pos", F.col("first") + F.col("at")).join(counts, "pair")
    result = T.StructType(
        [T.StructField("doc_id", key)]
        + [T.StructField(k, T.LongType()) for k in (*_PER_TEXT, "n_best", "count_sum")]
        + [T.StructField("groups_sha256", T.StringType())]
    )
    kept = rows.drop("first", "pair", "total").groupBy("slice")
    done = kept.cogroup(known.select("of", "pos", "n", "best").groupBy("of")).applyInArrow(_sums, result)
    done = stage(done, "alignment")
    unstage(rows, counts)
    return done
