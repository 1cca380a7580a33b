"""SentencePiece encoding that keeps, for every piece, the bytes of the text it stands for.

The text is normalised here, through the model's compiled character map: at each
position the longest key of the map that prefixes the rest of the text is replaced
by its value, and every byte produced remembers the source byte it came from.  The
library merges pieces over the same normal form; laying its pieces over the recorded
alignment gives each piece's byte span in the original text.

Where the model allows it, a batch is cut at blanks and every different segment is
encoded once: no piece continues past a blank that follows another character, so
merges never cross such a cut and the result is the library's on the whole text.

Defined results: a null text counts as empty and has no pieces; an empty table gives
an empty table; columns of the input other than the text are passed through, and an
input column named like an output column is replaced by it.  Rows are independent, so
repeated rows repeat their result, and a text of any length is encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonloom.llm.bytetext import hashes, joined, ragged, released, slices
from seasonloom.llm.shipping import shipped

SPACE = "▁".encode()
_SPACES = np.frombuffer(SPACE, dtype=np.uint8)
NORMAL_SPACE = 0x20


class CharacterMap:
    """Longest-prefix replacement through a compiled character map.

    The map is a 4-byte length, a double-array trie of that many bytes, and a pool of
    NUL-terminated replacements; a trie value is an offset into the pool.
    """

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], dtype="<u4").tolist()
        self.pool = compiled[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that starts at ``at``."""
        if not self.units:
            return None
        node, found = self._offset(self.units[0]), None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit & 0x100:
                found = (self.units[node] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start, length = found
        return self.pool[start : self.pool.index(b"\0", start)], length


def _character(text: bytes, at: int) -> int:
    lead = text[at]
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


class Normaliser:
    """Normal form of a text and, for each of its bytes, the source byte."""

    def __init__(self, spec):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix
        self.squeeze = spec.remove_extra_whitespaces
        self.space = SPACE if spec.escape_whitespaces else b" "

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The array has one entry more than the normal form: the end of the text."""
        if not text:
            return b"", np.zeros(1, dtype=np.int64)
        if not self.map.units and not self.squeeze:
            return self._plain(text)
        return self._mapped(text)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        data = np.frombuffer(text, dtype=np.uint8)
        blank = data == NORMAL_SPACE
        width = np.where(blank, len(self.space), 1)
        source = np.repeat(np.arange(len(data)), width)
        out = data[source]
        if len(self.space) > 1:
            starts = (np.cumsum(width) - width)[blank]
            for k, byte in enumerate(_SPACES):
                out[starts + k] = byte
        head = self.space if self.prefix else b""
        source = np.concatenate((np.zeros(len(head), dtype=np.int64), source, [len(data)]))
        return head + out.tobytes(), source

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        produced: list[tuple[bytes, int]] = []
        at = 0
        while at < len(text):
            hit = self.map.longest(text, at)
            if hit is None:
                length = _character(text, at)
                produced.append((text[at : at + length], at))
            else:
                length = hit[1]
                produced.append((hit[0], at))
            at += length
        end = len(text)
        if self.squeeze:
            produced, end = _squeezed(produced, end)
        if not produced:
            return b"", np.array([end], dtype=np.int64)
        out, source = [], []
        if self.prefix:
            out.append(self.space)
            source += [produced[0][1]] * len(self.space)
        for part, start in produced:
            part = part.replace(b" ", self.space)
            out.append(part)
            source += [start] * len(part)
        return b"".join(out), np.array([*source, end], dtype=np.int64)


def _squeezed(parts: list[tuple[bytes, int]], end: int) -> tuple[list[tuple[bytes, int]], int]:
    """Without leading and trailing blanks, and with one blank for each inner run."""
    out: list[tuple[bytes, int]] = []
    blank = True
    for part, start in parts:
        while blank and part.startswith(b" "):
            part = part[1:]
        if part:
            out.append((part, start))
            blank = part.endswith(b" ")
    while out and out[-1][0].endswith(b" "):
        part, start = out.pop()
        end = start
        if part := part[:-1]:
            out.append((part, start))
    return out, end


class Segments:
    """Pieces of the segments met so far; emptied when it holds ``limit`` of them."""

    def __init__(self, encoder: Encoder, limit: int = 1 << 18):
        self.encoder, self.limit = encoder, limit
        self.lone = [encoder.library.piece_to_id("▁")]
        self._empty()

    def _empty(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.row = self.head = self.size = np.zeros(0, dtype=np.int64)
        self.ids = self.width = self.end = np.zeros(0, dtype=np.int32)

    def rows(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row of each segment ``data[starts:ends]``, given ascending different hashes."""
        if len(self.keys) > self.limit:
            self._empty()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), dtype=bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            self._add(data, starts[new], ends[new])
            row = np.arange(len(self.head) - int(new.sum()), len(self.head))
            merged = np.concatenate((self.keys, keys[new]))
            order = np.argsort(merged, kind="stable")
            self.keys, self.row = merged[order], np.concatenate((self.row, row))[order]
        return self.row[np.searchsorted(self.keys, keys)]

    def _add(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = data.tobytes()
        words = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        found = self.encoder.library.encode(words, num_threads=1)
        for k in np.flatnonzero(starts == ends).tolist():
            found[k] = self.lone
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        ids = np.fromiter(chain.from_iterable(found), dtype=np.int64, count=int(size.sum()))
        head = np.cumsum(size) - size
        width = self.encoder.source_width[ids]
        for k, word in enumerate(words):
            if "▁" in word:
                begin, end = self.encoder.spans(word, found[k])
                width[head[k] : head[k] + size[k]] = end - begin
                width[head[k]] += 1
        end = np.cumsum(width)
        end -= np.repeat((end - width)[head], size)
        self.head = np.concatenate((self.head, head + len(self.ids)))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.width = np.concatenate((self.width, width.astype(np.int32)))
        self.end = np.concatenate((self.end, end.astype(np.int32)))


class Encoder:
    """The library's pieces of a text, with spans."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        self.normalise = Normaliser(proto.normalizer_spec)
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        self.width = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces])
        # Source bytes of a piece when every blank of it stands for one space.
        self.source_width = self.width - 2 * np.array(
            [0 if p.type == kinds.BYTE else p.piece.count("▁") for p in proto.pieces]
        )
        spec = proto.normalizer_spec
        inner = any(p.type != kinds.BYTE and re.search("[^▁]▁", p.piece) for p in proto.pieces)
        self.by_segment = (
            not (self.normalise.map.units or self.normalise.squeeze or inner)
            and spec.add_dummy_prefix
            and spec.escape_whitespaces
            and proto.trainer_spec.byte_fallback
            and not any(p.type == kinds.USER_DEFINED for p in proto.pieces)
        )
        self.known = Segments(self)
        self.unknown = next((i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN), -1)

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte of each piece in the UTF-8 text."""
        normal, source = self.normalise(text.encode())
        piece = np.array(ids, dtype=np.int64)
        width = self.width[piece] if len(piece) else np.zeros(0, dtype=np.int64)
        if self.unknown >= 0 and (piece == self.unknown).any():
            width = np.array([len(p.encode()) for p in self.library.encode(text, out_type=str)])
        edges = np.concatenate(([0], np.cumsum(width)))
        if edges[-1] != len(normal):
            raise ValueError("the pieces do not add up to the normal form of the text")
        return source[edges[:-1]], source[edges[1:]]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first and end bytes of all texts, and the n + 1 bounds of each text's ids."""
        if self.by_segment:
            return self._segments(texts)
        rows = [t or "" for t in texts.to_pylist()]
        ids = self.library.encode(rows, num_threads=1)
        placed = [self.spans(t, i) for t, i in zip(rows, ids, strict=True)]
        flat = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts])
        bounds = np.cumsum([0, *map(len, ids)])
        return flat(ids).astype(np.int64), flat(b for b, _ in placed), flat(e for _, e in placed), bounds

    def _segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data, bounds = joined(texts, NORMAL_SPACE)
        # One blank in front of every text: its dummy prefix.
        data = np.concatenate((np.array([NORMAL_SPACE], np.uint8), data[:-1])) if len(data) else data
        blank = data == NORMAL_SPACE
        first = np.zeros(len(data), dtype=bool)
        first[bounds[:-1]] = True
        # A blank joins the one before it, also one that the text spells as its own mark.
        joins = np.concatenate(([False], blank[:-1]))
        mark = np.ones(max(len(data) - 3, 0), dtype=bool)
        for k, byte in enumerate(_SPACES):
            mark &= data[k : len(data) - 3 + k] == byte
        joins[3:] |= mark
        cut = blank & (first | ~joins)
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        empty = np.diff(bounds) == 1
        text_of = np.searchsorted(bounds, starts, side="right") - 1
        keep = ~empty[text_of]
        starts, ends, text_of = starts[keep], ends[keep], text_of[keep]
        key, one, same = np.unique(hashes(data, starts + 1, ends), return_index=True, return_inverse=True)
        at = self.known.rows(key, data, starts[one] + 1, ends[one])[same]
        head, size = self.known.head[at], self.known.size[at]
        picked = ragged(head, size)
        base = np.repeat(starts - bounds[text_of] - 1, size)
        counts = np.bincount(text_of, weights=size, minlength=len(bounds) - 1).astype(np.int64)
        end = self.known.end[picked] + base
        return (
            self.known.ids[picked],
            np.maximum(end - self.known.width[picked], 0),
            end,
            np.concatenate(([0], np.cumsum(counts))),
        )


@lru_cache(maxsize=4)
def encoder(model_file: str) -> Encoder:
    return Encoder(model_file)


OUTPUT = [
    ("ids", T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32())),
    ("begins", T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32())),
    ("ends", T.ArrayType(T.IntegerType(), False), pa.list_(pa.int32())),
    ("decoded", T.StringType(), pa.string()),
]


def encode(docs: DataFrame, model_file: str, text: str = "text", step_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` without ``text``, with ``ids``, ``begins``, ``ends`` and ``decoded``.

    ``begins`` and ``ends`` are byte offsets into the UTF-8 text; ``decoded`` is the
    library's decode of the ids.  One pass over the rows, no shuffle; a task works on
    about ``step_bytes`` of text at a time.
    """
    shipped(docs.sparkSession)
    names = [name for name, _, _ in OUTPUT]
    passed = [f for f in docs.schema.fields if f.name not in {*names, text}]
    schema = T.StructType([*passed, *(T.StructField(n, t, False) for n, t, _ in OUTPUT)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model_file)
        for batch in released(batches):
            for part in slices(batch, len(passed), step_bytes):
                ids, begins, ends, bounds = tool.batch(part.column(len(passed)))
                flat, edges = ids.tolist(), bounds.tolist()
                rows = [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                lists = [
                    pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))
                    for values in (ids, begins, ends)
                ]
                decoded = pa.array(tool.library.decode(rows, num_threads=1), pa.string())
                columns = [*part.columns[: len(passed)], *lists, decoded]
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])

    return docs.select(*(F.col(f"`{f.name}`") for f in passed), F.col(f"`{text}`")).mapInArrow(run, schema)


def digests(encoded: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Count of ids, and digests of the ids and of the decoded text; columns ``keep`` stay."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    whole = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0))
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        whole.cast("long").alias("n_bytes"),
        *keep,
    )
