"""Order-dependent building blocks that never put one whole group into one task.

* ``row_index``: dense 0-based position in a total order (optionally per group).
* ``running_totals``: inclusive running sums in a total order (optionally per group).
* ``suffix_scan``: the linear recurrence ``y_t = b_t + a_t * y_{t+1}`` (GAE, discounted returns).

All three range-partition on (group, order), so a hot group is spread over many partitions,
work inside each partition, and stitch partitions together with a table of per-partition
totals whose size is bounded by ``partitions + groups``. The order columns must form a total
order (add a unique tie key) so that a recomputed partition after an executor loss numbers
its rows exactly as before.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized

_PID = "_rs_pid"
_LOCAL = "_rs_local"
GROUP_ROWS = 512  # groups up to so many rows are numbered whole in a task


def _n_parts(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _as_cols(xs: Sequence[str | Column]) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _ranged(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    """Range-partition, sort inside partitions, number rows, and store the table as Parquet.

    The partition id and in-partition position are read twice (per-partition totals and the rows
    themselves). Two plan branches over a range exchange are not guaranteed to see the same
    partitioning, and a lost executor would renumber recomputed rows, so the numbered table is
    written once to the shared folder and both branches read the columns they need from it."""
    from ..session import checkpoint_path

    keys = _as_cols(by) + _as_cols(order)
    numbered = (
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn(_PID, F.spark_partition_id())
        # position inside the sorted partition: the low 33 bits of the monotonically increasing id
        .withColumn(_LOCAL, F.monotonically_increasing_id() - F.shiftleft(F.col(_PID).cast("long"), 33))
    )
    path = checkpoint_path(df.sparkSession, f"ordered-{uuid.uuid4().hex}")
    numbered.write.parquet(path)
    return df.sparkSession.read.schema(numbered.schema).parquet(path)


def _offsets(ranged: DataFrame, by: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Per (partition, group): first local position and the totals of all earlier partitions."""
    per_part = ranged.groupBy(_PID, *by).agg(
        F.min(_LOCAL).alias("_rs_first"), *[F.sum(c).alias(f"_rs_tot_{k}") for k, c in sums.items()]
    )
    # rows per group in this table <= number of partitions, so the window is small
    w = Window.partitionBy(*by).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        _PID, *by, "_rs_first", *[F.coalesce(F.sum(f"_rs_tot_{k}").over(w), F.lit(0)).alias(f"_rs_off_{k}") for k in sums]
    )


def join_groups(rows: DataFrame, per_group: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join one row per group to its rows; a NULL group is a group. Without groups ``per_group`` is one row."""
    by = list(by)
    if not by:
        return rows.crossJoin(F.broadcast(per_group))
    named = per_group.withColumnsRenamed({c: f"_rs_by_{i}" for i, c in enumerate(by)})
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_rs_by_{i}")) for i, c in enumerate(by)]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return rows.join(named, cond, how).drop(*[f"_rs_by_{i}" for i in range(len(by))])


def _join_small(big: DataFrame, small: DataFrame, on: list[str], bounded: bool) -> DataFrame:
    # ``bounded``: the small side has at most one row per partition (no groups), a proven bound.
    # With groups its size grows with the number of groups, so AQE decides at runtime.
    return join_groups(big, F.broadcast(small) if bounded else small, on)


def _has_large_group(df: DataFrame, by: Sequence[str], n: int) -> bool:
    sizes = df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.count(F.lit(1)).alias("_rs_n"))
    most, total = sizes.agg(F.max("_rs_n"), F.sum("_rs_n")).first()
    return most is not None and most > max(GROUP_ROWS, total // n)


def row_index(
    df: DataFrame,
    order: Sequence[str | Column],
    by: Sequence[str] = (),
    name: str = "row_idx",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``name`` = 0-based position of the row in ``order`` (within ``by`` groups).

    Groups are counted first. Where none has more than ``GROUP_ROWS`` rows or the even share of a task, rows are dealt by group and numbered in
    one shuffle; a larger group is spread over range partitions. Either way the numbered table is stored."""
    by = list(by)
    if by and not _has_large_group(df, by, _n_parts(df, num_partitions)):
        place = F.row_number().over(Window.partitionBy(*[F.col(f"`{c}`") for c in by]).orderBy(*_as_cols(order)))
        return materialized(df.withColumn(name, (place - 1).cast("long")), "ordered")
    r = _ranged(df, by, order, _n_parts(df, num_partitions))
    off = _offsets(r, by, {"n": F.lit(1)})
    out = _join_small(r, off, [_PID, *by], bounded=not by)
    return out.withColumn(name, (F.col("_rs_off_n") + F.col(_LOCAL) - F.col("_rs_first")).cast("long")).drop(
        _PID, _LOCAL, "_rs_first", "_rs_off_n"
    )


def running_totals(
    df: DataFrame,
    order: Sequence[str | Column],
    sums: dict[str, str | Column],
    by: Sequence[str] = (),
    num_partitions: int | None = None,
) -> DataFrame:
    """Add inclusive running sums ``{out_name: value}`` in ``order`` (within ``by`` groups)."""
    by = list(by)
    sums_c = {k: (F.col(v) if isinstance(v, str) else v) for k, v in sums.items()}
    r = _ranged(df, by, order, _n_parts(df, num_partitions))
    for k, c in sums_c.items():
        r = r.withColumn(f"_rs_v_{k}", c)
    off = _offsets(r, by, {k: F.col(f"_rs_v_{k}") for k in sums_c})
    # running sum inside one range partition: the window key includes the partition id,
    # so a window task never holds more than one range partition of a group
    w = Window.partitionBy(_PID, *by).orderBy(_LOCAL).rowsBetween(Window.unboundedPreceding, 0)
    local = r.select("*", *[F.sum(f"_rs_v_{k}").over(w).alias(f"_rs_loc_{k}") for k in sums_c])
    out = _join_small(local, off, [_PID, *by], bounded=not by)
    for k in sums_c:
        out = out.withColumn(k, F.col(f"_rs_off_{k}") + F.col(f"_rs_loc_{k}"))
    drop = [_PID, _LOCAL, "_rs_first"] + [f"_rs_{p}_{k}" for k in sums_c for p in ("v", "loc", "off")]
    return out.drop(*drop)


def suffix_scan(df: DataFrame, keys: Sequence[str], step: str, a: str, b: str, out: str, block: int = 256) -> DataFrame:
    """Add ``out`` with ``out_t = b_t + a_t * out_{t+1}`` (0 after the last step of each key; a NULL key is a key).

    ``step`` must be the dense 0-based position within ``keys`` (see ``row_index``).
    Rows are grouped into blocks of ``block`` consecutive steps that carry their whole row, and a block is folded from its end:
    each row's value for a carry of 0, and the product of ``a`` to the block's end. The blocks are stored once. What enters a
    block from behind is the same recurrence over the blocks' first rows, one row a block, and so on until every key is one
    block. So a key of any length never meets one task whole, rows are shuffled once, and only block rows are joined. Up to
    ``block`` steps a key's result is the plain sequential fold, bit for bit."""
    keys, names = list(keys), df.columns
    row = F.struct(F.col(f"`{step}`").alias("s"), F.col(f"`{a}`").cast("double").alias("a"), F.col(f"`{b}`").cast("double").alias("b"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    blk = F.floor(F.col(f"`{step}`") / F.lit(block)).cast("long").alias("_rs_blk")
    # steps are distinct within a key, so the order never looks at the rest of a row
    grouped = df.groupBy(*[F.col(f"`{k}`").alias(f"_rs_key_{i}") for i, k in enumerate(keys)], blk).agg(F.collect_list(row).alias("_rs_rows"))
    by = [f"_rs_key_{i}" for i in range(len(keys))]

    def fold(acc: Column, x: Column) -> Column:
        y, p = x["b"] + x["a"] * acc["y"], x["a"] * acc["p"]
        return F.struct(y.alias("y"), p.alias("p"), F.array_append(acc["out"], F.struct(y.alias("y"), p.alias("p"))).alias("out"))

    start = F.struct(F.lit(0.0).alias("y"), F.lit(1.0).alias("p"), F.array().cast("array<struct<y:double,p:double>>").alias("out"))
    last_first = F.array_sort("_rs_rows", lambda x, z: (z["s"] - x["s"]).cast("int"))
    folded = grouped.select(*by, "_rs_blk", last_first.alias("_rs_rows"))
    folded = folded.select(*by, "_rs_blk", "_rs_rows", F.aggregate("_rs_rows", start, fold)["out"].alias("_rs_done"))
    blocks = materialized(folded, "scan-blocks")
    carried = blocks.withColumn("_rs_carry", F.lit(0.0))
    if blocks.agg(F.max("_rs_blk")).first()[0]:  # a look at one stored column
        # a block's first step is the last of its array
        firsts = blocks.select(*by, "_rs_blk", F.element_at("_rs_done", -1)["y"].alias("_rs_y"), F.element_at("_rs_done", -1)["p"].alias("_rs_p"))
        behind = suffix_scan(firsts, by, "_rs_blk", "_rs_p", "_rs_y", "_rs_carry", block).select(*by, (F.col("_rs_blk") - 1).alias("_rs_blk"), "_rs_carry")
        carried = join_groups(blocks, behind, [*by, "_rs_blk"], "left").withColumn("_rs_carry", F.coalesce("_rs_carry", F.lit(0.0)))
    rows = carried.select("_rs_carry", F.explode(F.arrays_zip("_rs_rows", "_rs_done")).alias("_rs_x"))
    value = F.col("_rs_x._rs_done.y") + F.col("_rs_x._rs_done.p") * F.col("_rs_carry")
    return rows.select(*[F.col(f"_rs_x._rs_rows.row.`{c}`").alias(c) for c in names if c != out], value.alias(out))
