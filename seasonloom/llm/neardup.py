"""Near-duplicate documents over word shingles, found with HyperMinHash sketches.

1. Each text's set of shingles becomes a row of HyperMinHash registers (``sketch``), and
   two hashes of the whole set.  Equal sets are one class; its smallest id stands for it.
2. Representatives meet in bands of compressed registers.  A band's bucket never lists its
   pairs: every member is paired with one hub, a member drawn by the band's own hash.
3. The collision-corrected estimate of the pairs' similarity drops those that lie more than
   ``margin`` standard errors below the threshold; the rest are verified on full sets.
   Verified links are joined into components.
4. A bucket whose members are in one component has nothing left to find.  In every other
   bucket all pairs across components are compared on full sets, in blocks of bounded size,
   and only links leave a block; they are verified again and components joined once more.

So within a bucket no link is lost, whatever its size.  Two sets of similarity s >= 0.8 share
no bucket with probability (1 - s^6)^40, at most 6 in a million.  A set's elements are 64-bit
hashes of shingles.

Defined cases: a text without words, or null, has no shingle, is linked with nothing and
kept; a null id is linked with nothing, has a null component and is kept; an id that occurs
in several rows stands for all its texts; an empty table gives an empty result.  Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonloom.llm.bytetext import released, slices
from seasonloom.llm.sketch import Layout, estimate, registers, shingles
from seasonloom.llm.shipping import shipped
from seasonloom.session import stage

SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, registers binary"


@dataclass(frozen=True)
class Settings:
    width: int = 4
    percent: int = 80
    layout: Layout = Layout()
    margin: float = 6.0
    block: int = 512


def _set_hashes(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes per set that do not depend on order: sums of mixed elements."""
    full = bounds[1:] > bounds[:-1]
    out = []
    with np.errstate(over="ignore"):
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            mixed = (values ^ (values >> np.uint64(29))) * np.uint64(factor)
            mixed ^= mixed >> np.uint64(32)
            sums = np.zeros(len(full), dtype=np.uint64)
            if full.any():
                sums[full] = np.add.reduceat(mixed, bounds[:-1][full])
            out.append(sums.view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, settings: Settings, text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in slices(batch, 1):
                values, bounds = shingles(part.column(1), settings.width)
                rows = registers(values, bounds, settings.layout)
                a, b = _set_hashes(values, bounds)
                width = rows.shape[1] * rows.itemsize
                packed = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]
                ).cast(pa.binary())
                columns = [part.column(0), pa.array(np.diff(bounds)), pa.array(a), pa.array(b), packed]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_a", "set_b", "registers"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, SIGNATURE)


def sets(docs: DataFrame, settings: Settings, text: str = "text") -> DataFrame:
    """``doc_id`` and its shingle hashes, ascending as unsigned numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in slices(batch, 1):
                values, bounds = shingles(part.column(1), settings.width)
                lists = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(values.view(np.int64)))
                lists = lists.cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "elements"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, "doc_id long, elements array<long>")


def bands(signed: DataFrame, layout: Layout) -> DataFrame:
    """One row per representative and band: the band's key and the id."""
    bytes_per_band = 2 * layout.rows

    def key(k: Column) -> Column:
        return F.xxhash64(k, F.substring(F.col("registers"), k * bytes_per_band + 1, F.lit(bytes_per_band)))

    keys = F.transform(F.sequence(F.lit(0), F.lit(layout.bands - 1)), key)
    return signed.select(F.explode(keys).alias("band"), "doc_id")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def probable(pairs: DataFrame, signed: DataFrame, settings: Settings) -> DataFrame:
    """Pairs whose estimated similarity does not rule a link out."""
    sketch = signed.select("doc_id", "n_shingles", "registers")
    side = lambda name: sketch.select(
        F.col("doc_id").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("registers").alias(f"r_{name}")
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")
    least = settings.percent / 100

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, n_b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            r_a, r_b = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(len(a), -1) for k in (4, 5)
            )
            guess = estimate(r_a, r_b, n_a, n_b)
            # Copied registers repeat each other: no more independent ones than elements.
            error = np.sqrt(least * (1 - least) / np.minimum(r_a.shape[1], np.minimum(n_a, n_b)))
            sized = 100 * np.minimum(n_a, n_b) >= settings.percent * np.maximum(n_a, n_b)
            kept = pa.array(sized & (guess >= least - settings.margin * error))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(kept)

    return both.mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, elements: DataFrame, settings: Settings) -> DataFrame:
    """Pairs that reach the threshold on their full sets."""
    side = lambda name: elements.select(F.col("doc_id").alias(name), F.col("elements").alias(f"e_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("e_a", "e_b"))
    sizes = both.select("a", "b", common.alias("i"), (F.size("e_a") + F.size("e_b")).alias("n"))
    return sizes.where(100 * F.col("i") >= settings.percent * (F.col("n") - F.col("i"))).select("a", "b").distinct()


def components(links: DataFrame, label: str) -> DataFrame:
    """``doc_id`` and ``component`` (the smallest id reachable) of every id with a link.

    Each round every id takes the smallest label among its neighbours and itself, then the
    label of that label, until nothing changes.
    """
    both = stage(links.union(links.select("b", "a")).toDF("doc_id", "other"), f"{label}-links")
    labels = both.groupBy("doc_id").agg(F.min("other").alias("m"))
    labels = stage(labels.select("doc_id", F.least("doc_id", "m").alias("component")), f"{label}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("doc_id", "other"), "other")
        near = near.groupBy("doc_id").agg(F.min("component").alias("near"))
        stepped = labels.join(near, "doc_id").withColumn("next", F.least("component", "near"))
        up = labels.select(F.col("doc_id").alias("next"), F.col("component").alias("up"))
        new = stepped.join(up, "next", "left").select(
            "doc_id",
            F.least("next", F.coalesce("up", "next")).alias("component"),
            F.col("component").alias("old"),
        )
        new = stage(new, f"{label}-labels")
        labels = new.select("doc_id", "component")
        if new.where("component <> old").isEmpty():
            return labels


def _block_links(asked: pa.Table, members: pa.Table, percent: int) -> pa.Table:
    """Links between askers and members of other components, on 32-bit element hashes.

    Shortened hashes can only add common elements, so no link is missed here; an allowance of
    two elements covers hashes that fall together inside a set.
    """
    empty = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not asked.num_rows or not members.num_rows:
        return empty
    lists = members["elements"].combine_chunks()
    size = np.asarray(lists.value_lengths())
    owner = np.repeat(np.arange(len(lists)), size)
    value = lists.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    group = members["component"].to_numpy()
    ids = members["doc_id"].to_numpy()
    found = []
    for name, mine, elements in zip(
        asked["doc_id"].to_pylist(), asked["component"].to_pylist(), asked["elements"].combine_chunks(), strict=True
    ):
        elements = np.asarray(elements.values)
        low, high = np.searchsorted(value, elements, "left"), np.searchsorted(value, elements, "right")
        length = high - low
        at = np.arange(int(length.sum())) + np.repeat(low - (np.cumsum(length) - length), length)
        common = np.bincount(owner[at], minlength=len(size)) + 2
        hit = (100 * common >= percent * (size + len(elements) - common)) & (group != mine)
        found += [(min(name, other), max(name, other)) for other in ids[hit].tolist()]
    if not found:
        return empty
    pairs = np.unique(np.array(found, dtype=np.int64), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def across(members: DataFrame, labels: DataFrame, elements: DataFrame, settings: Settings) -> DataFrame:
    """Probable links between different components that share a bucket."""
    placed = members.join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = stage(placed.select("band", "hub", "doc_id", "component"), "neardup-placed")
    # The hub's component is the bucket's main one; the others ask, and meet every member.
    main = placed.where("doc_id = hub").select("band", F.col("component").alias("main")).distinct()
    sized = placed.join(main, "band").withColumn("asks", F.col("component") != F.col("main"))
    counts = sized.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("n_asks"))
    mixed = stage(sized.join(counts.where("n_asks > 0"), "band"), "neardup-mixed")
    blocks = lambda n: F.ceil(F.col(n) / settings.block).cast("int")
    own = lambda n: F.pmod(F.xxhash64("doc_id"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    low = F.transform("elements", lambda e: e.bitwiseAND(F.lit(0xFFFFFFFF)))
    short = stage(elements.select("doc_id", low.alias("elements")).join(mixed.select("doc_id").distinct(), "doc_id"), "neardup-short")
    columns = ["band", "doc_id", "component"]
    right = mixed.select(*columns, own("n").alias("mb"), every("n_asks").alias("ab")).join(short, "doc_id")
    left = mixed.where("asks").select(*columns, own("n_asks").alias("ab"), every("n").alias("mb")).join(short, "doc_id")
    left = left.toDF(*left.columns)  # columns of its own, for the cogroup
    groups = ["band", "ab", "mb"]
    percent = settings.percent
    found = (
        left.groupBy(*groups)
        .cogroup(right.groupBy(*groups))
        .applyInArrow(lambda asked, block: _block_links(asked, block, percent), "a long, b long")
    )
    return found.distinct()


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``docs``."""
    shipped(docs.sparkSession)
    signed = stage(signatures(docs, settings, text), "neardup-signatures")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    key = ["set_a", "set_b", "n_shingles"]
    classes = stage(full.groupBy(*key).agg(F.min("doc_id").alias("first")), "neardup-classes")
    alone = full.join(classes.select(F.col("first").alias("doc_id"), *key), ["doc_id", *key], "left_semi")

    rows = bands(alone, settings.layout)
    # A member drawn by the band's own key: the id closest to it bit by bit.
    buckets = rows.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("doc_id").bitwiseXOR(F.col("band"))).alias("x")
    )
    hubs = buckets.where("n > 1").select("band", F.col("x").bitwiseXOR(F.col("band")).alias("hub"))
    members = stage(rows.join(hubs, "band"), "neardup-members")
    stars = members.where("doc_id <> hub").select(*_ordered("doc_id", "hub")).distinct()
    likely = stage(probable(stars, alone, settings), "neardup-pairs")
    involved = members.select("doc_id").distinct()
    elements = stage(sets(docs.join(involved, "doc_id", "left_semi"), settings, text), "neardup-sets")
    links = stage(verified(likely, elements, settings), "neardup-links")
    labels = components(links, "neardup")
    more = stage(across(members, labels, elements, settings), "neardup-across")
    named = classes.join(labels.withColumnRenamed("doc_id", "first"), "first", "left")
    named = named.select(*key, F.coalesce("component", "first").alias("part"))
    # Links across components join whole components: one edge for each pair of them.
    part = lambda name: labels.select(F.col("doc_id").alias(name), F.col("component").alias(f"part_{name}"))
    edges = verified(more, elements, settings).join(part("a"), "a", "left").join(part("b"), "b", "left")
    edges = edges.select(F.coalesce("part_a", "a").alias("a"), F.coalesce("part_b", "b").alias("b"))
    whole = components(edges.where("a <> b").distinct(), "neardup-across")
    named = named.join(whole.withColumnRenamed("doc_id", "part"), "part", "left")
    named = named.select(*key, F.coalesce("component", "part").alias("class_component"))
    found = signed.drop("registers").join(named, key, "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"),
    )
