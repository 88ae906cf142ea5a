"""Exact top-k inner-product search with a vector-approximation file.

Each component is quantised to a cell (its value shifted right by ``CELL_BITS``). A query's score
with a vector lies between bounds taken from the vector's cells alone. A block of vectors is searched
in two steps: the cells are scanned for bounds, then exact vectors are read in descending order of
their upper bounds until the k-th best exact score is above every bound that is left (ties included).

Data and queries are dealt to a grid of (data block, query block) cells, each bounded by
``BLOCK_ROWS`` rows; every cell gives k candidates a query and a top-k over the blocks follows.
No vector is broadcast and no pair is materialised beyond the k of each block.

Defined cases: vectors that are NULL, hold a NULL or non-finite component, or whose dimension differs
from a query's take no part; the zero-dimension vector scores 0; equal scores go to the smaller
id; equal ids are ranked as separate rows, but a query never meets a row of its own id (rows of one id count as
one and the same vector); an empty table, or one without queries, gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 16_384  # vectors in a data block
QUERY_ROWS = 2_048  # queries in a query block
CELL_BITS = 5  # integer values in a cell: 2 ** CELL_BITS
QUERIES_AT_ONCE = 64
EXACT = 1 << 53  # integer sums of doubles are exact below


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v): floor(scale * component, as double), without the vectors that take no part."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(F.col(id_col).alias("id"), whole.alias("v"))


class VaFile:
    """Approximations and exact vectors of one block (rows by ascending id)."""

    def __init__(self, ids: np.ndarray, exact: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.exact = ids[order], exact[order]
        self.cells = self.exact >> CELL_BITS
        self.low = (self.cells << CELL_BITS).astype(np.float64)
        self.largest = int(np.abs(exact).max(initial=0)) + (1 << CELL_BITS)

    def upper_bounds(self, queries: np.ndarray) -> np.ndarray:
        """No score of a vector exceeds: score of its cell's low corner + width * positive part."""
        q = queries.astype(np.float64)
        bounds = q @ self.low.T + (((1 << CELL_BITS) - 1) * np.maximum(q, 0).sum(axis=1))[:, None]
        room = self.largest * np.abs(q).sum(axis=1)
        return bounds + np.where(room < EXACT, 0, room * 1e-9)[:, None]

    def scores(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        if float(np.abs(query).sum()) * self.largest < EXACT:
            return (self.exact[at].astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
        return self.exact[at] @ query

    def search(self, query_id: int, query: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (id, score) of the block, the query's own id left out."""
        bounds = np.where(self.ids == query_id, -np.inf, bounds)
        n = int(np.count_nonzero(bounds > -np.inf))
        ids = scores = np.zeros(0, np.int64)
        done, step = 0, min(4 * k, n)
        while done < n:
            reach = min(n, done + step)
            if reach < n:  # a bound is reached as a whole, so the rest is strictly lower
                level = np.partition(bounds, len(bounds) - reach)[len(bounds) - reach]
                at = np.flatnonzero((bounds >= level) & (bounds > -np.inf))
            else:
                level, at = -np.inf, np.flatnonzero(bounds > -np.inf)
            found = self.scores(query, at)
            ids, scores = np.r_[ids, self.ids[at]], np.r_[scores, found]
            bounds[at] = -np.inf
            done += len(at)
            step *= 4
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(scores) == k and scores[-1] >= level:
                break
        return list(zip(ids.tolist(), scores.tolist()))


def search_cell(data: pd.DataFrame, queries: pd.DataFrame, k: int) -> Iterator[tuple[int, int, int, int]]:
    """(query row, query id, id, score) of the k best in one grid cell, by dimension."""
    for dim, qs in queries.groupby(queries["v"].map(len)):
        block = data[data["v"].map(len) == dim]
        if block.empty:
            continue
        shape = (-1, dim) if dim else (len(block), 0)
        file = VaFile(block["id"].to_numpy(), np.concatenate(block["v"].to_numpy()).reshape(shape).astype(np.int64))
        vectors = np.concatenate(qs["v"].to_numpy()).reshape((-1, dim) if dim else (len(qs), 0)).astype(np.int64)
        rows, ids = qs["row"].to_numpy(), qs["id"].to_numpy()
        for a in range(0, len(qs), QUERIES_AT_ONCE):
            bounds = file.upper_bounds(vectors[a : a + QUERIES_AT_ONCE])
            for j, bound in enumerate(bounds, a):
                for vec, score in file.search(int(ids[j]), vectors[j], bound, k):
                    yield int(rows[j]), int(ids[j]), vec, score


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k highest inner products of each query row (all, if fewer)."""
    flagged = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v"), F.coalesce(is_query, F.lit(False)).alias("_q"))
    data = integer_vectors(flagged, "_id", "_v", scale)
    queries = integer_vectors(flagged.where("_q"), "_id", "_v", scale)
    n = flagged.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_q"), 1)).alias("q")).first()
    blocks, query_blocks = max(1, -(-n["n"] // BLOCK_ROWS)), max(1, -(-n["q"] // QUERY_ROWS))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # every data block meets every query block: the grid deals both sides, none is sent whole to one task
    data = data.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("part", each(query_blocks))
    queries = queries.withColumn("row", F.monotonically_increasing_id()).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int")).withColumn("block", each(blocks))

    def cell(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = list(search_cell(own, asked, k)) if len(own) and len(asked) else []
        return pd.DataFrame(found, columns=["row", "query_id", "id", "score"]).astype("int64")

    found = data.groupBy("block", "part").cogroup(queries.groupBy("block", "part")).applyInPandas(cell, "row long, query_id long, id long, score long")
    best = Window.partitionBy("row", "query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
