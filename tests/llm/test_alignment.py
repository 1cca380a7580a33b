import hashlib
import os
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seasonloom.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tools():
    own = Tokenizer.from_file(A)
    own.encode_special_tokens = True
    return own, sentencepiece.SentencePieceProcessor(model_file=B)


def _alphabet():
    """The byte-level alphabet, one byte after the other."""
    table, spare = {}, 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b:
            table[chr(b)] = b
        else:
            table[chr(spare)] = b
            spare += 1
    return table


BYTE = _alphabet()


def tokens(text, tools):
    """(id, bytes) lists of both models, straight from the libraries."""
    own, pieces = tools
    if not text:
        return [], []
    found = own.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(map(BYTE.get, t))) for i, t in zip(found.ids, found.tokens, strict=True)]
    b = []
    for i in pieces.encode(text):
        p = pieces.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    same = all(b"".join(x for _, x in side) == whole for side in (a, b))
    return (a, b) if same else ([], [])


def plain(texts, tools):
    """Every text by testing all ranges, and counts over all texts."""
    sides, links = [], []
    for text in texts:
        a, b = tokens(text, tools)
        spans = []
        for side in (a, b):
            end = np.cumsum([len(x) for _, x in side]).tolist()
            spans.append([(i, e - len(x), e) for (i, x), e in zip(side, end, strict=True)])
        sides.append(spans)
        links.append([(i, j) for i, s, e in spans[0] for j, t, f in spans[1] if s < f and t < e])
    count = Counter(x for each in links for x in each)
    most = {}
    for (_, j), n in count.items():
        most[j] = max(n, most.get(j, 0))
    out = []
    for (a, b), each in zip(sides, links, strict=True):
        shared = sorted({e for *_, e in a} & {e for *_, e in b})
        at, groups = 0, []
        for cut in shared:
            groups.append("|".join(",".join(str(i) for i, s, e in side if at <= s and e <= cut) for side in (a, b)))
            at = cut
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(each), sum(count[x] == most[x[1]] for x in each), sum(count[x] for x in each), sha))
    return out


TEXTS = [
    None, "", " ", "a", "Hello world", "Hello world", "the the  the\tthe\n\nthe", "▁marked ▁text", "naïve café ÜBER", "日本語 テキスト 🙂🙂",
    "<|endoftext|> <s> <unk> </s> <0x41>", "x" * 3000, " " * 700 + "end", "no break space\u0085line", "\x00\x01 nul", "don't we'll I'm 123,456.78 ++--",
    "Straße\r\nNeue Zeile ", "ʼn ǅ ˈa ̈́ ͉",
]
NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _got(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(alignment.align(docs, A, B, **options).collect())
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    return [tuple(r[n] for n in NAMES) for r in rows]


@pytest.mark.parametrize("slice_bytes", [1, 200, 2 << 20])
def test_alignment_equals_all_ranges(spark, tools, slice_bytes):
    assert _got(spark, TEXTS, slice_bytes=slice_bytes) == plain(TEXTS, tools)


def test_query_equals_all_ranges_on_its_first_scale(spark, tools):
    folder = f"{os.environ.get('TEST_SF_ROOT', '/root/testdata')}/sf0.001"
    docs = {r.doc_id: r.text for r in queries.table(spark, folder, "documents").collect()}
    keys = sorted(docs, key=lambda k: len(docs[k] or ""))
    got = {r.doc_id: r for r in queries.op12_token_alignment(spark, folder).collect()}
    assert set(got) == set(docs)
    for k in keys[:60]:
        a, b = tokens(docs[k], tools)
        assert (got[k].n_a, got[k].n_b) == (len(a), len(b))
        assert got[k].n_links == len(a) + len(b) - got[k].n_groups
    # Sums over texts of what each link counts are sums of squares over pairs.
    assert sum(r.count_sum for r in got.values()) >= sum(r.n_links for r in got.values()) > 0


def test_pieces_of_any_size_give_the_same_overlaps():
    rng = np.random.default_rng(7)
    for size in (1, 2, 3, 10, 200):
        a = np.unique(np.append(rng.integers(1, 4 * size + 2, size), 4 * size + 2))
        b = np.unique(np.append(rng.integers(1, 4 * size + 2, size), 4 * size + 2))
        starts = [np.append(0, x[:-1]) for x in (a, b)]
        expected = {
            (i, j) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < b[j] and starts[1][j] < a[i]
        }
        shared = [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]]
        for piece in (1, 2, 3, 7, 64, 10_000):
            i, j, cut_a, cut_b = alignment.merged(a, b, piece)
            assert len(i) == len(expected) and set(zip(i.tolist(), j.tolist(), strict=True)) == expected
            assert list(zip(cut_a.tolist(), cut_b.tolist(), strict=True)) == shared
            at, other = alignment.diagonals(a, b, piece)
            assert (np.diff(at + other)[:-1] == piece).all()


def test_both_libraries_cut_latin_texts_alike(tools):
    tool = alignment.ByteLevel(A)
    random.seed(3)
    latin = [chr(k) for k in range(0x340)]
    texts = [f"a{c}b {c}{c} {c} 1{c}\n{c}" for c in latin]
    texts += ["".join(random.choices(latin + [" "] * 200, k=80)) for _ in range(3000)]
    assert [tool.fast.encode_ordinary(t) for t in texts] == [x.ids for x in tools[0].encode_batch(texts, add_special_tokens=False)]


def test_repeated_ids_and_further_columns(spark, tools):
    docs = spark.createDataFrame([(1, "one two", 5), (1, "one two", 6), (None, "one", 7)], "doc_id int, text string, pair int")
    rows = alignment.align(docs, A, B).collect()
    expected = plain(["one two", "one two", "one"], tools)
    assert sorted(tuple(r[n] for n in NAMES) for r in rows) == sorted(expected)
    assert sorted(r.doc_id for r in rows if r.doc_id) == [1, 1]
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_slices_are_stored_in_bounded_rows_and_row_groups(spark, tools, monkeypatch):
    """However many texts a task reads, neither a row nor a row group grows with them."""
    sizes, groups, stage = [], [], alignment.stage

    def seen(df, label, **options):
        staged = stage(df, label, **options)
        if label == "alignment-slices":
            lists = [F.max(F.size(n)) for n, kind in staged.dtypes if kind.startswith("array")]
            sizes.append((staged.count(), staged.select("slice").distinct().count(), max(staged.select(*lists).first())))
            for file in Path(staged.staged_at.removeprefix("file:")).glob("*.parquet"):
                parts = pq.ParquetFile(file).metadata
                groups.extend(parts.row_group(k).num_rows for k in range(parts.num_row_groups))
        return staged

    monkeypatch.setattr(alignment, "stage", seen)
    monkeypatch.setattr(alignment, "_ROW_GROUP", 1 << 12)
    assert _got(spark, TEXTS, entries=7) == plain(TEXTS, tools)
    words = random.Random(5).sample("abcdefghijklmnopqrstuvwxyz" * 400, 4000)
    texts = [" ".join("".join(words[k + i : k + i + 4]) for i in range(0, 400, 4)) for k in range(0, 3600, 90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = sorted(alignment.align(docs, A, B, entries=20).collect())
    assert [tuple(r[n] for n in NAMES) for r in rows] == plain(texts, tools)
    assert [n for *_, n in sizes] == [7, 20]
    n_rows, n_slices, _ = sizes[-1]
    assert n_slices == 1 and n_rows > 200 and sum(groups) == sum(n for n, *_ in sizes)
    assert max(groups) <= 200


def test_default_rows_of_a_large_slice(tools):
    tool = alignment.aligner(A, B)
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=20_000)) for _ in range(12)]
    part = pa.RecordBatch.from_arrays([pa.array(range(12)), pa.array(texts)], ["doc_id", "text"])
    slice_, row, first, doc_id, *lists = alignment._aligned(part, tool, 5, alignment._ENTRIES)
    n_rows = len(row)
    assert n_rows > 1 and set(slice_.to_pylist()) == {5} and row.to_pylist() == list(range(n_rows))
    assert doc_id.flatten().to_pylist() == list(range(12))
    assert all(max(x.value_lengths().to_pylist()) <= alignment._ENTRIES for x in (doc_id, *lists))
    pair = lists[5]
    assert first.to_pylist() == [0, *np.cumsum(pair.value_lengths().to_pylist())[:-1].tolist()]
