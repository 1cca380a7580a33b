"""Nearest neighbours by largest inner product, through collision-counting hashing.

A vector is hashed by ``projections`` random lines; along each line the vectors of a block
are kept as one sorted array.  A query opens a window around its own position on every
line.  A vector inside a query's window collides with it on that line; all windows widen
together by ``growth`` (virtual rehashing: no table is rebuilt, two bounds move), and the
vectors that collide on at least ``threshold`` of the lines are verified by their exact
inner product.  A query stops at the first level at which ``k + verify * block rows``
vectors collide that often, or at which its windows hold the block.

Inner product is turned into distance by one more component that gives all vectors the
length of the longest and all queries none of it.

The query set meets all vectors in blocks: vectors and queries are dealt by hash into
blocks of bounded size, and each pair of blocks is one group, so a group's memory does not
grow with the table and copies of one vector spread over all blocks.  A query's best per
block are merged by a windowed rank over at most ``k`` rows per vector block.

Vectors that are null, zero, or hold a null or non-finite component take no part, as query
or as candidate; a query meets only vectors of its own number of components.  Equal scores
are ordered by the smaller id; a row never answers its own id.  Rows with a null id take
no part; repeated ids are answered and listed once per row they occur in.  Extra columns
are ignored.  Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonloom.llm.shipping import shipped

RESULT = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Search:
    k: int = 20
    projections: int = 128
    threshold: float = 0.75
    growth: float = 1.1
    verify: float = 0.2
    seed: int = 11


def _lines(width: int, search: Search) -> np.ndarray:
    return np.random.default_rng([search.seed, width]).normal(size=(width, search.projections))


class Block:
    """Sorted arrays of one block of vectors."""

    def __init__(self, vectors: np.ndarray, longest: float, search: Search):
        self.vectors, self.search, self.longest = vectors, search, longest
        rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0.0))
        self.lines = _lines(vectors.shape[1] + 1, search)
        values = np.column_stack((vectors, rest)) @ self.lines
        order = np.argsort(values, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(values, order, axis=0).T)
        place = np.argsort(order, axis=0, kind="stable").T
        self.place = np.ascontiguousarray(place, dtype=np.uint16 if len(vectors) < 1 << 16 else np.uint32)
        n = len(vectors)
        spread = self.sorted[:, (3 * n) // 4] - self.sorted[:, n // 4]
        whole = self.sorted[:, -1] - self.sorted[:, 0]
        self.unit = np.where(spread > 0, spread, np.where(whole > 0, whole, 1.0)) / 8

    def candidates(self, queries: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of the block to verify, for each query in turn."""
        search, n = self.search, len(self.vectors)
        length = np.linalg.norm(queries, axis=1, keepdims=True)
        at = ((queries / length * self.longest) @ self.lines[:-1]).T
        need = int(np.ceil(search.threshold * search.projections))
        enough = min(n, search.k + int(np.ceil(search.verify * n)))
        reach = np.maximum(np.abs(at).max(axis=1), 0) + np.abs(self.sorted).max(axis=1)
        last = max(0, int(np.ceil(np.log((reach / self.unit).max()) / np.log(search.growth))))
        gap, inside = np.empty_like(self.place), np.empty(self.place.shape, dtype=bool)
        total = np.uint8 if search.projections < 256 else np.uint32
        windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def window(level: int) -> tuple[np.ndarray, np.ndarray]:
            """First place and number of places in every query's window on every line."""
            if level not in windows:
                half = self.unit * search.growth**level
                ends = [
                    (np.searchsorted(s, a - h, "left"), np.searchsorted(s, a + h, "right"))
                    for s, a, h in zip(self.sorted, at, half, strict=True)
                ]
                low, high = (np.array(x).T for x in zip(*ends, strict=True))
                kind = self.place.dtype
                windows[level] = low.astype(kind), (high - low).astype(kind)
            return windows[level]

        def colliding(q: int, level: int) -> np.ndarray:
            low, size = (x[q][:, None] for x in window(level))
            # Unsigned, so a place before the window is a large gap.
            np.less(np.subtract(self.place, low, out=gap), size, out=inside)
            return np.add.reduce(inside.view(np.uint8), axis=0, dtype=total) >= need

        level = last // 2
        for q in range(len(queries)):
            # Windows of successive levels are nested, so the first wide enough one is bisected,
            # from the level of the query before, which is seldom far.
            narrow, wide, chosen, step = -1, last, None, 1
            while wide - narrow > 1 or chosen is None:
                hit = colliding(q, level)
                if level == last or np.count_nonzero(hit) >= enough:
                    wide, chosen = level, hit
                    level = max(level - step, narrow + 1) if narrow < 0 else (narrow + wide) // 2
                else:
                    narrow = level
                    level = min(level + step, wide - (chosen is not None)) if chosen is None else (narrow + wide) // 2
                step *= 2
            level = wide
            yield np.flatnonzero(chosen)

    def nearest(self, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray) -> tuple[list, list, list]:
        out: tuple[list, list, list] = ([], [], [])
        for query, name, rows in zip(queries, query_ids, self.candidates(queries), strict=True):
            rows = rows[ids[rows] != name]
            score = self.vectors[rows] @ query
            best = np.lexsort((ids[rows], -score))[: self.search.k]
            for column, values in zip(out, (np.full(len(best), name), ids[rows][best], score[best]), strict=True):
                column.append(values)
        return out


def _usable(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """Id, components as doubles, their number, and the length; only vectors that take part."""
    value = F.col(f"`{embedding}`").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), value.alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    squared = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    return rows.select("*", F.size("v").alias("width"), F.sqrt(squared).alias("length")).where("length > 0")


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    return table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    settings: Search = Search(),
    key: str = "vec_id",
    embedding: str = "embedding",
    vector_block: int = 4096,
    query_block: int = 512,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's best among ``vectors``."""
    shipped(vectors.sparkSession)
    some = _usable(vectors, key, embedding)
    asked = _usable(queries, key, embedding)
    facts = some.agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).first()
    n_queries = asked.count()
    longest = facts["longest"] or 1.0
    v_blocks, q_blocks = max(1, -(-facts["n"] // vector_block)), max(1, -(-n_queries // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    right = some.select("id", "v", "width", own(v_blocks).alias("vb"), every(q_blocks).alias("qb"))
    left = asked.select("id", "v", "width", own(q_blocks).alias("qb"), every(v_blocks).alias("vb"))

    def pair(asked: pa.Table, block: pa.Table) -> pa.Table:
        parts: tuple[list, list, list] = ([], [], [])
        if asked.num_rows and block.num_rows:
            width = block["width"][0].as_py()
            ids = block["id"].to_numpy()
            tree = Block(_matrix(block, width), longest, settings)
            parts = tree.nearest(ids, _matrix(asked, width), asked["id"].to_numpy())
        flat = [np.concatenate([np.zeros(0, kind), *p]) for kind, p in zip((np.int64, np.int64, np.float64), parts, strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), flat, strict=True)))

    groups = ["width", "qb", "vb"]
    found = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(pair, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
