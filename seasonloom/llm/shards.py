"""Two-pass external shuffle of a table into shards whose row counts differ by at most one.

Pass one scatters rows into buckets of about ``bucket_bytes`` with a seeded hash of the
key and the text; a bucket is what one task shuffles in memory.  Pass two puts a bucket
into a fixed order, runs Fisher-Yates over it with a generator seeded by (seed, bucket),
and writes it.  Buckets laid end to end are one permutation of the table, and the shards
are equal ranges of it.  The table moves once; its sizes come from a scan of two columns.

Results depend on the rows, the seed and the two sizes alone, not on the input's layout or
on task retries.  Defined cases: null keys and null texts are ordinary values (a null text
has size 16 and checksum 0); copies of a text lie in different buckets when their keys
differ, and rows equal in both share one; an empty table writes no row.  Input columns
named like an output column are replaced by it; other names cannot clash, as a row travels
packed in one column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonloom.llm.shipping import shipped

OVERHEAD = 16
_RUN = 1024
OUTPUT = ["size", "text_crc32", "shard", "slot"]


def row_size(text: str = "text") -> Column:
    return (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + OVERHEAD).cast("long")


def _offsets(counts: DataFrame) -> DataFrame:
    """Rows before each bucket: running totals inside runs of buckets and over the runs."""
    run = F.floor(F.col("bucket") / _RUN)
    inner = Window.partitionBy("run").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("run", run)
    before = counts.groupBy("run").agg(F.sum("rows").alias("all")).withColumn("base", F.sum("all").over(outer))
    within = counts.withColumn("before", F.sum("rows").over(inner))
    start = F.coalesce("before", F.lit(0)) + F.coalesce("base", F.lit(0))
    return within.join(before, "run").select("bucket", start.alias("offset"))


def _fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    order = np.arange(n)
    np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, bucket])).shuffle(order)
    return order


def shuffled(
    docs: DataFrame,
    n_shards: int,
    seed: int,
    bucket_bytes: int = 16 << 20,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with ``size``, ``text_crc32``, ``shard`` and ``slot``."""
    shipped(docs.sparkSession)
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    scattered = F.xxhash64(F.lit(seed), F.col(f"`{key}`"), value)
    total = docs.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_size(text)), F.lit(0)).alias("bytes")).first()
    n_rows, n_buckets = total["rows"], max(2 * n_shards, -(-total["bytes"] // bucket_bytes))
    bucket = F.pmod(scattered, F.lit(n_buckets)).alias("bucket")
    counts = docs.select(bucket).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    kept = [c for c in docs.columns if c not in OUTPUT]
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"),
        F.col(f"`{key}`").alias("key"),
        row_size(text).alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"),
        F.xxhash64(scattered).alias("order"),
        bucket,
    )
    schema = T.StructType([rows.schema["row"], *(T.StructField(n, T.LongType()) for n in OUTPUT)])
    names = schema.fieldNames()

    def shuffle(group: pa.Table) -> pa.Table:
        number, offset = group["bucket"][0].as_py(), group["offset"][0].as_py()
        fixed = group.select(["order", "key", "text_crc32"]).append_column("null_key", pc.is_null(group["key"]))
        by = ["order", "null_key", "key", "text_crc32"]
        at = pc.sort_indices(fixed, [(name, "ascending") for name in by])
        chosen = at.take(pa.array(_fisher_yates(len(at), seed, number)))
        rank = offset + np.arange(len(at))
        shard = rank * n_shards // max(n_rows, 1)
        slot = rank - (shard * n_rows + n_shards - 1) // n_shards
        out = group.take(chosen)
        return out.append_column("shard", pa.array(shard)).append_column("slot", pa.array(slot)).select(names)

    dealt = rows.join(_offsets(counts), "bucket")
    return dealt.groupBy("bucket").applyInArrow(shuffle, schema).select("row.*", *OUTPUT)


def write(rows: DataFrame, path: str) -> DataFrame:
    """Write one folder per shard, rows in slot order inside a file; returns what was written."""
    ordered = rows.sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    read = rows.sparkSession.read.schema(rows.schema).parquet(path)
    return read.select(rows.columns)
