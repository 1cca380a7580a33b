"""The external shuffle and the WARC archives, on small tables and by round trip."""

import base64
import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from seasonloom.llm import shards, warc
from seasonloom.session import scratch_path

DOCS = "doc_id long, text string, size string, extra int"


def placed(spark, rows, n_shards=5, **options):
    docs = spark.createDataFrame(rows, DOCS)
    out = shards.write(shards.shuffled(docs, n_shards, seed=3, **options), scratch_path(spark, "test-shards"))
    return out.collect()


def test_shards_hold_every_row_once_and_counts_differ_by_one(spark):
    rows = [(k, "x" * (k % 50), "own", k) for k in range(997)] + [(None, None, None, None), (3, "", None, 1), (3, "", None, 1)]
    out = placed(spark, rows, bucket_bytes=2000)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.extra or 0) for r in out) == sorted(
        (r[0] is None, r[0] or 0, r[3] or 0) for r in rows
    )
    by_shard = {}
    for r in out:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.size == len((r.text or "").encode()) + 16
        assert r.text_crc32 == zlib.crc32((r.text or "").encode())
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    counts = [len(s) for s in by_shard.values()]
    assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_shuffle_depends_on_the_seed_and_not_on_the_layout(spark):
    docs = spark.createDataFrame([(k, str(k)) for k in range(300)], "doc_id long, text string")
    run = lambda d, seed: {r.doc_id: (r.shard, r.slot) for r in shards.shuffled(d, 4, seed).collect()}
    assert run(docs, 1) == run(docs.repartition(7), 1)
    assert run(docs, 1) != run(docs, 2)


def test_columns_of_any_name_pass_through(spark):
    names = ["bucket", "order", "offset", "null_key", "key", "row", "rows", "run"]
    docs = spark.createDataFrame([(k, f"t{k}", *(f"{n}{k}" for n in names)) for k in range(50)], ["doc_id", "text", *names])
    out = shards.shuffled(docs, 3, 1).collect()
    assert {tuple(r[n] for n in names) for r in out} == {tuple(f"{n}{k}" for n in names) for k in range(50)}
    assert out[0].__fields__ == ["doc_id", "text", *names, *shards.OUTPUT]


def test_very_long_texts(spark):
    out = placed(spark, [(k, "ü" * (k * 1_000_000), "own", k) for k in range(4)], bucket_bytes=1 << 20)
    assert sorted(r.size for r in out) == [2_000_000 * k + 16 for k in range(4)]


def test_empty_table_has_no_shards(spark):
    assert shards.shuffled(spark.createDataFrame([], DOCS), 3, 1).count() == 0


def archived(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder = scratch_path(spark, "test-warc")
    manifest = warc.write(warc.classified(pages, **options), folder, warc.dictionary(pages), archive_bytes=2000)
    manifest = spark.createDataFrame(manifest.collect(), warc.MANIFEST)
    return warc.read(spark, manifest).collect(), [r.path for r in manifest.collect()]


def test_archives_give_back_every_page(spark):
    rows = [(k, f"http://a b/{k}\r\n", f"<p>page {k % 40} " + "ü" * (k % 7) + "\r\n\r\n</p>", k) for k in range(280)]
    rows += [(500, None, None, 1), (501, "u", "", 1), (None, "n", "<p>null</p>", 1), (502, "n", "<p>null</p>", 1)]
    rows += [(600, "long", "word " * 200_000, 0)]
    out, paths = archived(spark, rows)
    assert len(out) == len(rows) and len(paths) > 1
    largest = {}
    for page, _, html, _ in rows:
        largest[html or ""] = max(largest.get(html or "", -1), -1 if page is None else page)
    html_of = {r[0]: r[2] or "" for r in rows}
    for r in out:
        payload = html_of[r.page_id].encode()
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = largest[html_of[r.page_id]]
        if r.page_id == first:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, payload)
        else:
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", first, None)


def test_short_payloads_may_stay_responses(spark):
    out, _ = archived(spark, [(1, "a", "x", 0), (2, "b", "x", 0), (3, "c", "yy", 0), (4, "d", "yy", 0)], min_payload=2)
    assert {r.page_id: r.refers_to for r in out} == {1: None, 2: None, 3: 4, 4: None}


def test_an_archive_starts_with_its_dictionary(spark):
    rows = [(k, "u", "".join(chr(97 + (k * j) % 26) for j in range(400)), 0) for k in range(200)]
    _, paths = archived(spark, rows)
    for path in paths:
        with warc._open(path, "rb") as f:
            assert f.read(4) == (0x184D2A5D).to_bytes(4, "little")


def test_dictionary_is_made_of_whole_records(spark):
    rows = [(k, f"http://host/{k}", "<p>" + "".join(chr(97 + (k * j) % 26) for j in range(9000)) + f"</p><!-- tail of page {k % 3} -->", 0) for k in range(150)]
    rows += [(1000 + k, f"http://host/{k}", rows[k][2], 0) for k in range(50)]
    trained = warc.dictionary(spark.createDataFrame(rows, "page_id long, url string, html string, digest int"))
    assert b"WARC-Payload-Digest: sha1:" in trained or b"WARC-Type: " in trained
    assert b"revisit" in trained and b"tail of page" in trained


def test_archives_lie_where_spark_resolves_their_folder(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x</p>", 0)], "page_id long, url string, html string, digest int")
    manifest = warc.write(warc.classified(pages), scratch_path(spark, "test-warc"), b"").collect()
    assert all(r.path.startswith("file:/") for r in manifest)


def test_no_pages_no_archive(spark):
    assert archived(spark, []) == ([], [])


def test_shuffle_query_by_brute_force(spark):
    from seasonloom.llm import queries

    folder = f"{os.environ.get('TEST_SF_ROOT', '/root/testdata')}/sf0.001"
    texts = {r.doc_id: (r.text or "").encode() for r in queries.table(spark, folder, "documents").collect()}
    slots = {}
    for r in queries.op4_external_shuffle(spark, folder).collect():
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id]), "rows", None)
        slots.setdefault(r.shard, []).append(r.slot)
    n = len(texts)
    assert set(slots) <= set(range(40)) and sum(map(len, slots.values())) == n
    assert all(sorted(s) == list(range(len(s))) and len(s) in (n // 40, -(-n // 40)) for s in slots.values())


def test_archive_query_by_brute_force(spark):
    from seasonloom.llm import queries

    folder = f"{os.environ.get('TEST_SF_ROOT', '/root/testdata')}/sf0.001"
    payload = {r.page_id: (r.html or "").encode() for r in queries.table(spark, folder, "pages").collect()}
    largest = {}
    for k, p in payload.items():
        largest[p] = max(k, largest.get(p, k))
    for r in queries.op8_warc(spark, folder).collect():
        p = payload[r.page_id]
        assert r.payload_bytes == len(p) and r.payload_digest == base64.b32encode(hashlib.sha1(p).digest()).decode()
        first = largest[p] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", largest[p]))


@pytest.mark.parametrize("name", ["op4_external_shuffle", "op8_warc"])
def test_registered_queries_cover_their_table(spark, name):
    from seasonloom.llm import queries

    folder = f"{os.environ.get('TEST_SF_ROOT', '/root/testdata')}/sf0.001"
    source, key = ("documents", "doc_id") if "op4" in name else ("pages", "page_id")
    out = queries.queries()[name](spark, folder)
    ids = queries.table(spark, folder, source).select(key)
    assert out.count() == ids.count() == out.join(ids, key).count()
    assert out.where(F.col(key).isNull()).count() == 0
