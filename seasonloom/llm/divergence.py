"""Source divergence audit: how far the sources of a language differ in their terms.

A term is a run of bytes that are letters A-Z, a-z or part of a character beyond ASCII, with
A-Z in lower case.  A language keeps the terms found in at least ``least`` of its documents.
Every (language, source) group and every language gives each kept term a share in billionths,
smoothed by one occurrence; ``pair`` rows compare each two sources of a language over all
its terms, ``term`` rows list what a source uses more than its language does.

Strings are materialised late.  Tasks turn texts into term digests with counts, and only
these fixed-width digests are shuffled and joined.  A task also spells each digest out once;
the smallest and the largest spelling of every kept digest are compared, and a digest that
stands for several terms is counted again under a variant number per spelling.  Text joins
the rows only where an output needs it.

All arithmetic is on whole numbers: shares come from long division, three digits at a time.
Pair sums work on blocks of a language's terms with one column per source, so a block's size
does not follow any group's, and a block sends on one number per two sources.

Defined cases: null text, language and source count as empty; every row is a document of its
own, so repeated rows count each time; a group without terms has count zero for every term; a
language that keeps no term has pair rows of value 0 and no term rows; an empty table gives
an empty result.  Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonloom.llm.bytetext import LOWER, hashes, joined, ragged, slices, spans
from seasonloom.llm.shipping import shipped
from seasonloom.session import stage, unstage

# Bytes outside every term (fixed by the definition of a term).
OUTSIDE = np.ones(256, dtype=bool)
OUTSIDE[0x41:0x5B] = OUTSIDE[0x61:0x7B] = OUTSIDE[0x80:] = False

BILLION = 1_000_000_000
_GROUP = ["lang", "source"]
_TERM = ["digest", "variant"]
_RESULT = "lang string, source string, part string, item string, value long, rank int"


@dataclass(frozen=True)
class Settings:
    least: int = 3
    top: int = 200
    # Bits of a digest; fewer only to test how collisions are split.
    bits: int = 64
    # Terms times sources that a block of the pair sums holds.
    cells: int = 1 << 18
    slice_bytes: int = 4 << 20
    # Spellings that a task remembers having sent.
    remembered: int = 1 << 19


@dataclass
class Terms:
    """Tokens of a slice: digests, and the text and byte span of each."""

    data: np.ndarray
    digest: np.ndarray
    text: np.ndarray
    start: np.ndarray
    length: np.ndarray

    def spelled(self, token: int) -> bytes:
        at = int(self.start[token])
        return self.data[at : at + int(self.length[token])].tobytes()


def terms(texts: pa.Array, bits: int = 64) -> Terms:
    data, bounds = joined(texts)
    data = LOWER[data]
    start, end = spans(data, OUTSIDE)
    digest = hashes(data, start, end) >> np.uint64(64 - bits)
    return Terms(data, digest, np.searchsorted(bounds, start, side="right") - 1, start, end - start)


def _unlike(t: Terms, first: np.ndarray, step: int = 1 << 19) -> np.ndarray:
    """Tokens whose bytes differ from those of token ``first`` (one per token)."""
    unlike = t.length != t.length[first]
    same = np.flatnonzero(~unlike)
    part = np.cumsum(t.length[same]) // step
    for at in np.split(same, np.flatnonzero(np.diff(part)) + 1):
        size = t.length[at]
        wrong = t.data[ragged(t.start[at], size)] != t.data[ragged(t.start[first[at]], size)]
        if wrong.any():
            unlike[at[np.unique(np.repeat(np.arange(len(at)), size)[wrong])]] = True
    return unlike


def _runs(packed: np.ndarray) -> np.ndarray:
    new = np.ones(len(packed), dtype=bool)
    new[1:] = packed[1:] != packed[:-1]
    return np.flatnonzero(new)


def _tallies(code: np.ndarray, text: np.ndarray, group_of: np.ndarray):
    """Per (group, code): occurrences and texts, ordered by group."""
    width = np.int64(max(int(code.max()), 1)).item().bit_length()
    packed = np.sort(text.astype(np.int64) << width | code)
    edge = _runs(packed)
    times = np.diff(np.append(edge, len(packed)))
    packed = packed[edge]
    packed = group_of[packed >> width] << width | packed & ((1 << width) - 1)
    order = np.argsort(packed, kind="stable")
    edge = _runs(packed[order])
    key = packed[order][edge]
    return key >> width, key & ((1 << width) - 1), np.add.reduceat(times[order], edge), np.diff(np.append(edge, len(order)))


def _groups(part: pa.RecordBatch) -> tuple[np.ndarray, list[tuple[str, str]]]:
    pairs = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
    names = {p: k for k, p in enumerate(dict.fromkeys(pairs))}
    return np.array([names[p] for p in pairs], dtype=np.int64), list(names)


def _digested(docs: DataFrame, settings: Settings) -> DataFrame:
    """Per slice and group: digests, occurrences, documents; and spellings the task has not sent."""
    schema = "lang string, source string, digest array<long>, n array<int>, df array<int>, new array<long>, spelled array<binary>"

    def slice_rows(part: pa.RecordBatch, sent: dict[int, bytes]) -> list[tuple]:
        t = terms(part.column(2), settings.bits)
        if not len(t.digest):
            return []
        digest, first, code = np.unique(t.digest, return_index=True, return_inverse=True)
        signed = digest.view(np.int64)
        if len(sent) > settings.remembered:
            sent.clear()
        new = []
        for d, at in zip(signed.tolist(), first.tolist(), strict=True):
            word = t.spelled(at)
            if sent.get(d) != word:
                sent[d] = word
                new.append((d, word))
        odd = np.flatnonzero(_unlike(t, first[code]))
        new += sorted({(int(signed[code[k]]), t.spelled(k)) for k in odd.tolist()})
        group_of, names = _groups(part)
        group, word, n, df = _tallies(code, t.text, group_of)
        cut = np.append(_runs(group), len(group)).tolist()
        rows = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            spelled = ([d for d, _ in new], [w for _, w in new]) if not a else ([], [])
            rows.append((*names[group[a]], signed[word[a:b]], n[a:b], df[a:b], *spelled))
        return rows

    kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 2, pa.list_(pa.int64()), pa.list_(pa.binary())]
    names = ["lang", "source", "digest", "n", "df", "new", "spelled"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, bytes] = {}
        for batch in batches:
            for part in slices(batch, 2, settings.slice_bytes):
                rows = slice_rows(part, sent)
                if rows:
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


def _spelled_out(docs: DataFrame, settings: Settings) -> DataFrame:
    """Per slice and group: digest, spelling, occurrences and documents, for digests to split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, settings.slice_bytes):
                t = terms(part.column(2), settings.bits)
                if not len(t.digest):
                    continue
                words = np.array([t.spelled(k) for k in range(len(t.digest))], dtype=object)
                word, first, code = np.unique(words, return_index=True, return_inverse=True)
                group_of, names = _groups(part)
                group, at, n, df = _tallies(code, t.text, group_of)
                picked = [names[g] for g in group.tolist()]
                columns = [pa.array([p[k] for p in picked], pa.string()) for k in (0, 1)]
                columns += [pa.array(t.digest[first[at]].view(np.int64)), pa.array(word[at].tolist(), pa.binary())]
                columns += [pa.array(n.astype(np.int32)), pa.array(df.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "digest", "term", "n", "df"])

    return docs.mapInArrow(run, "lang string, source string, digest long, term binary, n int, df int")


def _kept(tallies: DataFrame, least: int) -> DataFrame:
    """Terms of each language found in enough documents, with their occurrences."""
    per = tallies.groupBy("lang", *_TERM).agg(F.sum("df").alias("df"), F.sum("n").alias("lang_n"))
    return per.where(F.col("df") >= least).drop("df")


def _counted(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged: tallies per group, kept terms per language, and the terms' spellings."""
    slices_ = stage(_digested(docs, settings), "divergence-slices")
    zipped = F.explode(F.arrays_zip("digest", "n", "df")).alias("t")
    tallies = slices_.select(*_GROUP, zipped).select(*_GROUP, "t.digest", F.lit(0).alias("variant"), "t.n", "t.df")
    kept = stage(_kept(tallies, settings.least), "divergence-kept")

    spelled = slices_.select(F.explode(F.arrays_zip("new", "spelled")).alias("t")).select(
        F.col("t.new").alias("digest"), F.col("t.spelled").alias("term")
    )
    wanted = kept.select("digest").distinct()
    ends = spelled.join(wanted, "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("lo"), F.max("term").alias("hi"))
    ends = stage(ends, "divergence-ends")
    words = ends.where("lo = hi").select("digest", F.lit(0).alias("variant"), F.col("lo").alias("term"))
    shared = ends.where("lo <> hi").select("digest")
    if not shared.isEmpty():
        counted = stage(_spelled_out(docs, settings).join(shared, "digest", "left_semi"), "divergence-split")
        by_spelling = Window.partitionBy("digest").orderBy("term")
        variants = counted.select("digest", "term").distinct().withColumn("variant", F.row_number().over(by_spelling))
        variants = stage(variants.select("digest", "variant", "term"), "divergence-variants")
        split = counted.join(variants, ["digest", "term"]).select(*_GROUP, *_TERM, "n", "df")
        tallies = tallies.join(shared, "digest", "left_anti").select(split.columns).union(split)
        kept = stage(_kept(tallies, settings.least), "divergence-kept")
        words = words.union(variants)
    # Joined first: rare terms never reach the grouping, and one shuffle by term serves both.
    counted = tallies.join(kept, ["lang", *_TERM]).groupBy(*_GROUP, *_TERM)
    counts = stage(counted.agg(F.sum("n").alias("n"), F.max("lang_n").alias("lang_n")), "divergence-counts")
    unstage(slices_)
    return counts, kept, words


def _share(count: Column | str, total: Column) -> Column:
    """1 + floor(10^9 (count + 1) / total) by long division, exact for totals below 9 * 10^15."""
    rest = (F.col(count) if isinstance(count, str) else count) + F.lit(1).cast("long")
    whole = F.lit(1).cast("long")
    for weight in (1_000_000, 1_000, 1):
        scaled = rest * F.lit(1000)
        rest = scaled % total
        whole = whole + F.call_function("div", scaled, total) * F.lit(weight)
    return whole


def _ranked(rows: DataFrame, *more: str) -> DataFrame:
    order = Window.partitionBy(*_GROUP, *more).orderBy(F.desc("value"), F.asc("item"))
    return rows.withColumn("rank", F.row_number().over(order))


def _pair_sums(block: pa.Table) -> pa.Table:
    """Sums over a block's terms for each two sources of its language."""
    flat = lambda k: block[k].combine_chunks().to_numpy(zero_copy_only=False)
    number, share = flat("number"), flat("p")
    base = flat("digest_null").astype(bool)
    sources = np.sort(number[base])
    smallest = share[base][np.argsort(number[base])]
    counted = block.filter(pa.array(~base))
    key = np.stack([counted[k].combine_chunks().to_numpy(zero_copy_only=False) for k in _TERM])
    _, code = np.unique(key, axis=1, return_inverse=True) if key.size else (None, np.zeros(0, np.int64))
    table = np.tile(smallest, (int(code.max()) + 1 if len(code) else 0, 1))
    table[code, np.searchsorted(sources, number[~base])] = share[~base]
    value = np.zeros((len(sources), len(sources)), dtype=np.int64)
    for s in range(len(sources)):
        gap = table[:, s, None] - table
        value[s] = (gap * gap // table).sum(axis=0)
    one, other = (x.ravel() for x in np.meshgrid(sources, sources, indexing="ij"))
    apart = one != other
    lang = pa.array([block["lang"][0].as_py()] * int(apart.sum()), pa.string())
    return pa.table({"lang": lang, "one": one[apart], "other": other[apart], "value": value.ravel()[apart]})


def audit(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` of all pairs and top terms."""
    shipped(docs.sparkSession)
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (*_GROUP, "text")]
    docs = docs.select(*blank)
    counts, kept, words = _counted(docs, settings)

    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = counts.groupBy(*_GROUP).agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = docs.select(*_GROUP).distinct().join(totals, _GROUP, "left").join(langs, "lang", "left")
    groups = groups.select(*_GROUP, *(F.coalesce(c, zero).alias(c) for c in ("total", "v", "lang_total")))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).alias("number")
    groups = stage(groups.select("*", number), "divergence-groups")

    rows = counts.join(groups, _GROUP)
    p = _share("n", F.col("total") + F.col("v"))
    q = _share("lang_n", F.col("lang_total") + F.col("v"))

    # Blocks of terms: each holds every source's share of a term that it lacks, and the counts.
    per_lang = groups.groupBy("lang").agg(F.max("number").cast("long").alias("s"), F.max("v").alias("w"))
    room = F.greatest(F.lit(settings.cells).cast("long"), F.lit(4) * F.col("s") * F.col("s"))
    per_lang = per_lang.select("lang", (F.call_function("div", F.col("w") * F.col("s"), room) + 1).alias("blocks"))
    least = F.when(F.col("v") > 0, _share(zero, F.greatest(F.col("total") + F.col("v"), F.lit(1)))).otherwise(F.lit(1).cast("long"))
    empty = groups.join(per_lang, "lang").select(
        "lang", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), "number", zero.alias("digest"),
        F.lit(0).alias("variant"), least.alias("p"), F.lit(True).alias("digest_null"),
    )
    filled = rows.join(per_lang, "lang").select(
        "lang", F.pmod(F.xxhash64(*_TERM), F.col("blocks")).alias("block"), "number", *_TERM, p.alias("p"),
        F.lit(False).alias("digest_null"),
    )
    sums = empty.union(filled).groupBy("lang", "block").applyInArrow(_pair_sums, "lang string, one int, other int, value long")
    sums = sums.groupBy("lang", "one", "other").agg(F.sum("value").alias("value"))
    named = groups.select("lang", "source", "number")
    pairs = sums.join(named.select("lang", "source", F.col("number").alias("one")), ["lang", "one"]).join(
        named.select("lang", F.col("source").alias("item"), F.col("number").alias("other")), ["lang", "other"]
    )
    pairs = _ranked(pairs.select(*_GROUP, F.lit("pair").alias("part"), "item", "value"))

    more = rows.select(*_GROUP, *_TERM, p.alias("p"), q.alias("q")).where("p > q")
    more = more.withColumn("value", F.expr("(p - q) * (p - q) div q")).withColumn("salt", F.pmod("digest", F.lit(64)))
    # All that may reach the top, ties with its last value included, before any text is joined.
    for by in (["salt"], []):
        place = F.rank().over(Window.partitionBy(*_GROUP, *by).orderBy(F.desc("value")))
        more = more.withColumn("place", place).where(F.col("place") <= settings.top).drop("place")
    listed = more.join(words, _TERM).select(
        *_GROUP, F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "salt"
    )
    for by in (["salt"], []):
        listed = _ranked(listed, *by).where(F.col("rank") <= settings.top)
    return pairs.union(listed.select(pairs.columns)).to(_schema(docs))


def _schema(docs: DataFrame):
    return docs.sparkSession.createDataFrame([], _RESULT).schema
