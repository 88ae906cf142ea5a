"""Hard negatives for contrastive training, with exact scores by the Four-Russians method.

Every component is a whole number (``floor(scale * x)``). Over the least value ``low`` of the table it is
a non-negative number of ``bits`` bits, and a vector is stored as packed bit planes: for each bit, one
byte for each group of eight dimensions. For an anchor, a table of 256 entries a group holds the sums of
all subsets of the group's eight components; a candidate's bytes index these tables, and shifting and
adding over the bits gives its whole, exact inner product:

    score = sum over bits of 2^bit * sum over groups of table[group][byte]  +  low * sum(anchor)

Anchors meet all rows in a grid of (row block, anchor block) cells of bounded size; packed planes travel,
not vectors. Two passes run over the grid: the first keeps each anchor's best rows of its own label (only
these are scored), the second each positive's best rows of other labels within the score band. Each
chunk of ``SCORED_AT_ONCE`` candidates gives at most ``positives`` rows an anchor, or ``negatives`` rows a
positive, and a top-k over the chunks follows. Blocks are dealt by a row number, so labels, ids or copies that hold many rows don't matter.

Defined cases: rows with a NULL id, label or vector, or with a NULL or non-finite component take no part,
the zero-dimension vector scores 0, vectors of different dimensions are never compared. Rows of equal id
are separate rows (one may be the other's positive or negative; each is an anchor of its own). A positive
with a score below 0 has no negatives, as the band is empty. An empty table, or one without
anchors, gives no rows. Columns of other names are ignored. Scores must fit a signed 64-bit integer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import materialize, pa_schema
from riskspark.llm.topk import integer_vectors

BLOCK_ROWS = 32_768  # rows of a grid cell
ANCHOR_ROWS = 2_048  # anchors of a grid cell
TABLES_AT_ONCE = 64  # anchors whose subset sums are held together
SCORED_AT_ONCE = 4_096  # candidates scored together
DIMS = 8  # dimensions of a group: one byte of a bit plane


def pack_planes(values: np.ndarray, low: int, bits: int) -> np.ndarray:
    """(rows, bits, groups) bytes of whole numbers (rows, dims); missing dimensions of the last group are 0 bits."""
    shifted = (values - low).astype(np.uint64)
    planes = [np.packbits((shifted >> np.uint64(b)).astype(np.uint8) & 1, axis=1, bitorder="little") for b in range(bits)]
    groups = -(-values.shape[1] // DIMS)
    return np.stack(planes, axis=1) if bits else np.zeros((len(values), 0, groups), np.uint8)


def unpack_planes(planes: np.ndarray, low: int, dim: int) -> np.ndarray:
    """The whole numbers (rows, dims) of packed planes."""
    out = np.full((len(planes), dim), low, np.int64)
    for b in range(planes.shape[1]):
        out += np.unpackbits(planes[:, b], axis=1, count=dim, bitorder="little").astype(np.int64) << b
    return out


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): for every group of eight dimensions, the sum of each subset of its components."""
    n, dim = anchors.shape
    groups = -(-dim // DIMS)
    padded = np.zeros((n, groups * DIMS), kind)
    padded[:, :dim] = anchors
    parts = padded.reshape(n, groups, DIMS).transpose(1, 2, 0)
    out = np.zeros((groups, 1 << DIMS, n), kind)
    for d in range(DIMS):  # subsets with dimension d: those without it, plus its component
        out[:, 1 << d : 2 << d] = out[:, : 1 << d] + parts[:, d, None]
    return out


def score_rows(planes: np.ndarray, tables: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """(rows, anchors) exact inner products: lookups by plane bytes, shifted and added from the highest bit on."""
    total = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    for b in range(planes.shape[1] - 1, -1, -1):
        total <<= 1
        for g in range(tables.shape[0]):
            total += tables[g].take(planes[:, b, g], axis=0)
    return total.astype(np.int64) + shift


def best_places(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    at = np.arange(len(scores))
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def scored(rows: pd.DataFrame, anchors: pd.DataFrame, low: int, bits: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray]]:
    """(candidates, anchors, scores) in chunks, for rows and anchors of one dimension."""
    dim = int(rows["dim"].iloc[0])
    shape = (-1, bits, -(-dim // DIMS))
    own = np.frombuffer(b"".join(anchors["planes"]), np.uint8).reshape(len(anchors), *shape[1:])
    vectors = unpack_planes(own, low, dim)
    reach = int(np.abs(vectors).sum(axis=1, dtype=np.float64).max(initial=0))
    kind = np.int32 if reach << bits < 1 << 31 else np.int64
    for a in range(0, len(anchors), TABLES_AT_ONCE):
        some = vectors[a : a + TABLES_AT_ONCE]
        tables, shift = subset_sums(some, kind), low * some.sum(axis=1)
        for c in range(0, len(rows), SCORED_AT_ONCE):
            chunk = rows.iloc[c : c + SCORED_AT_ONCE]
            planes = np.frombuffer(b"".join(chunk["planes"]), np.uint8).reshape(len(chunk), *shape[1:])
            yield chunk, anchors.iloc[a : a + TABLES_AT_ONCE], score_rows(planes, tables, shift)


def cell_positives(rows: pd.DataFrame, anchors: pd.DataFrame, low: int, bits: int, k: int) -> Iterator[tuple]:
    """(anchor row, positive row, its id, score): the k best other rows of each anchor's label, chunk by chunk."""
    asked = dict(list(anchors.groupby(["dim", "label"])))
    for kind, own in rows.groupby(["dim", "label"]):
        if kind in asked:
            for chunk, some, scores in scored(own, asked[kind], low, bits):
                ids, places = chunk["id"].to_numpy(), chunk["row"].to_numpy()
                for j, anchor in enumerate(some["row"].to_numpy()):
                    at = np.flatnonzero(places != anchor)
                    for p in at[best_places(scores[at, j], ids[at], k)]:
                        yield anchor, places[p], ids[p], scores[p, j]


def cell_negatives(rows: pd.DataFrame, anchors: pd.DataFrame, low: int, bits: int, k: int, least: int, most: int) -> Iterator[tuple]:
    """(anchor row, positive row, id, score): for each positive of an anchor (``positives``: row and score), the k
    best rows of other labels with least * positive <= 100 * score <= most * positive, chunk by chunk."""
    asked = dict(list(anchors.groupby("dim")))
    for dim, own in rows.groupby("dim"):
        if dim not in asked:
            continue
        for chunk, some, scores in scored(own, asked[dim], low, bits):
            ids, labels = chunk["id"].to_numpy(), chunk["label"].to_numpy()
            for j, (anchor, label, positives) in enumerate(zip(some["row"], some["label"], some["positives"])):
                bands = [(p["positive"], -(-least * int(p["score"]) // 100), most * int(p["score"]) // 100) for p in positives]
                bands = [b for b in bands if b[1] <= b[2]]
                if not bands:
                    continue
                mine = scores[:, j]
                at = np.flatnonzero((mine >= min(b[1] for b in bands)) & (mine <= max(b[2] for b in bands)) & (labels != label))
                for positive, first, last in bands:
                    inside = at[(mine[at] >= first) & (mine[at] <= last)]
                    for p in inside[best_places(mine[inside], ids[inside], k)]:
                        yield anchor, positive, ids[p], mine[p]


def packed_rows(vectors: DataFrame, label: Column, is_anchor: Column, scale: int, id_col: str, vector_col: str) -> tuple[DataFrame, int, int]:
    """(row, id, label, anchor, dim, planes) of the rows that take part, stored once; with low and bits."""
    flagged = vectors.select(
        F.struct(F.col(id_col).alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")).alias("_id"),
        F.col(vector_col).alias("_v"),
    ).where(F.col("_id.id").isNotNull() & F.col("_id.label").isNotNull())
    whole = integer_vectors(flagged, "_id", "_v", scale).select(F.monotonically_increasing_id().alias("row"), "id.*", "v")
    found = whole.agg(F.min(F.array_min("v")).alias("low"), F.max(F.array_max("v")).alias("high")).first()
    low = found["low"] or 0
    bits = ((found["high"] or 0) - low).bit_length()
    schema = pa_schema(vectors.sparkSession, "row long, id long, label long, anchor boolean, dim int, planes binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            dims = np.diff(v.offsets.to_numpy())
            flat = v.values.to_numpy(zero_copy_only=False)
            starts = v.offsets.to_numpy()[:-1]
            planes: list[bytes] = [b""] * b.num_rows
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                values = flat[starts[at][:, None] + np.arange(dim)[None, :]].astype(np.int64).reshape(len(at), dim)
                for i, p in zip(at, pack_planes(values, low, bits)):
                    planes[i] = p.tobytes()
            cols = [b.column("row"), b.column("id").cast(pa.int64()), b.column("label"), b.column("anchor"), pa.array(dims, pa.int32()), pa.array(planes, pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

    return materialize(whole.mapInArrow(pack, "row long, id long, label long, anchor boolean, dim int, planes binary"), "hard-negatives"), low, bits


def mine(vectors: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100,
         scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its ``positives`` highest-scoring other rows of the same label; a positive's
    negatives the ``negatives`` highest-scoring rows of other labels with a score between ``least`` and
    ``most`` percent of the positive's. Ties go to the smaller id."""
    rows, low, bits = packed_rows(vectors, label, is_anchor, scale, id_col, vector_col)
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("anchor"), 1)).alias("a")).first()
    blocks, parts = max(1, -(-n["n"] // BLOCK_ROWS)), max(1, -(-n["a"] // ANCHOR_ROWS))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    data = rows.drop("anchor").withColumn("block", dealt(blocks)).withColumn("part", every(parts))
    anchors = rows.where("anchor").select(*[F.col(c).alias(c) for c in ("row", "id", "label", "dim", "planes")]).withColumn("part", dealt(parts))

    def over_grid(asked: DataFrame, found: Callable[[pd.DataFrame, pd.DataFrame], Iterator[tuple]], names: str) -> DataFrame:
        columns = [c.split()[0] for c in names.split(", ")]

        def cell(own: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
            got = list(found(own, some)) if len(own) and len(some) else []
            return pd.DataFrame(got, columns=columns).astype("int64")

        grid = asked.withColumn("block", every(blocks))
        return data.groupBy("block", "part").cogroup(grid.groupBy("block", "part")).applyInPandas(cell, names)

    def first_k(df: DataFrame, by: list[str], k: int, *ties: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "id", *ties)
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = over_grid(anchors, lambda own, some: cell_positives(own, some, low, bits, positives), "anchor long, positive long, id long, score long")
    near = materialize(first_k(near, ["anchor"], positives, "positive"), "positives")
    chosen = near.groupBy("anchor").agg(F.collect_list(F.struct("positive", "score")).alias("positives"))  # ``positives`` at most
    asked = anchors.join(chosen.withColumnRenamed("anchor", "row"), "row")
    hard = over_grid(asked, lambda own, some: cell_negatives(own, some, low, bits, negatives, least, most), "anchor long, positive long, id long, score long")
    ids = rows.where("anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    pairs = near.select("anchor", "positive", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = first_k(hard, ["anchor", "positive"], negatives).join(pairs, ["anchor", "positive"]).join(ids, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
