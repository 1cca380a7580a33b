"""Encoding against the library, spans against its own offsets, and edge rows."""

import hashlib
import os

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from seasonloom.llm import bytetext, pieces, queries

SF = f"{os.environ.get('TEST_SF_ROOT', '/root/testdata')}/sf0.001"
MODEL = queries.piece_model()
HARD = ["", None, " ", "  ", "   a  b ", "\n", " \n x", "▁", "a▁b ▁ x", "a ▁", "x  ▁▁y", "\x00 \x00", "日本 𠮷 é", "<s> </s>", "́e"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def check(texts, library):
    tool = pieces.encoder(MODEL)
    assert tool.by_segment
    ids, begins, ends, bounds = tool.batch(pa.array(texts, pa.string()))
    for k, text in enumerate(texts):
        part = slice(bounds[k], bounds[k + 1])
        assert ids[part].tolist() == library.encode(text or "")
        first, end = tool.spans(text or "", ids[part].tolist())
        assert begins[part].tolist() == first.tolist() and ends[part].tolist() == end.tolist()
        if len(ids[part]):
            size = len((text or "").encode())
            assert end[-1] == size and first[0] == 0 and (first[1:] == end[:-1]).all()


def test_hard_texts(library):
    check(HARD, library)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é▁\n\t𠮷-<>0"), max_size=40), min_size=1, max_size=5))
def test_any_text_equals_the_library(texts):
    check(texts, sentencepiece.SentencePieceProcessor(model_file=MODEL))


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf", "identity"])
def test_character_maps_equal_the_library(rule):
    from sentencepiece import sentencepiece_model_pb2

    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(theirs.serialized_model_proto())
    mine = pieces.Normaliser(proto.normalizer_spec)
    for text in ["ﬁne  ﾊﾟ  ½ ", "  Ａbc é", "x\t\ny", "㍿ ㍿", "ß İ", "plain words", "", " "]:
        normal, source = mine(text.encode())
        assert normal.decode() == theirs.normalize(text)
        assert len(source) == len(normal) + 1 and (source[1:] >= source[:-1]).all()


def test_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, SF, "documents").collect()}
    rows = queries.op5_sentencepiece(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == digest(",".join(map(str, ids)))
        assert r.decoded_sha256 == digest(library.decode(ids)) and r.n_bytes == len(texts[r.doc_id].encode())


def test_edge_rows_and_clashing_columns(spark, library):
    rows = [(None if k == 3 else k, t, k) for k, t in enumerate([*HARD, "word " * 100_000])]
    docs = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string, ids int")
    out = pieces.encode(docs, MODEL).collect()
    assert len(out) == len(rows) + 1
    for r, (_, text, _) in zip(out, [*rows, rows[4]], strict=True):
        assert list(r.ids) == library.encode(text or "") and r.decoded == library.decode(list(r.ids))
    assert pieces.encode(docs.limit(0), MODEL).count() == 0


def test_words_of_a_batch():
    data, bounds = bytetext.joined(pa.array(["ab  c", None, "\x1fé\x0b\r"]))
    starts, ends = bytetext.spans(data)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["ab", "c", "\x1fé"]
    assert bounds.tolist() == [0, 6, 7, 13]
    same = bytetext.hashes(data, starts, ends, step=1).tolist()
    assert same == bytetext.hashes(data, starts, ends).tolist() and len(set(same)) == 3
