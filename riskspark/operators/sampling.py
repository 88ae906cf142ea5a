"""Sampling and splitting with an engine-independent random order (M-01 ... M-11).

The random order is the md5 rank: rows sorted by md5(key ':' seed). Every engine computes the
same order, it does not depend on partitioning, and recomputation after an executor loss gives
the same rows. Exact counts use ``row_index`` (range-partitioned, no single-task sort).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ordered import join_groups, row_index

PREFIXES = 4096  # md5 prefixes that rows are counted by: three hexadecimal digits


def md5_key(key: str | Sequence[str], seed: int) -> Column:
    keys = [key] if isinstance(key, str) else list(key)
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def md5_rank(df: DataFrame, key: str | Sequence[str], seed: int, by: Sequence[str] = (), name: str = "_rank") -> DataFrame:
    """0-based position in md5 order (within ``by``). The key must be unique (within ``by``)."""
    keys = [key] if isinstance(key, str) else list(key)
    d = df.withColumn("_h", md5_key(keys, seed))
    return row_index(d, ["_h", *keys], by=by, name=name).drop("_h")


def md5_parts(df: DataFrame, cuts: Sequence[Column], key: str | Sequence[str], seed: int, by: Sequence[str] = (), name: str = "_part") -> DataFrame:
    """Add ``name``: how many of the ``cuts`` (expressions over ``_n``, the rows of the group) are at or
    before the row's position in md5 order (within ``by``).

    Rows are counted per md5 prefix (``PREFIXES`` counts per group). Only the prefixes in which a cut
    falls are sorted, 1 / PREFIXES of a group's rows each; every other row is decided by its prefix."""
    keys, by = [key] if isinstance(key, str) else list(key), list(by)
    digits = len(f"{PREFIXES - 1:x}")
    d = df.withColumn("_h", md5_key(keys, seed)).withColumn("_b", F.conv(F.substring("_h", 1, digits), 16, 10).cast("int"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = d.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumn("_n", F.sum("_c").over(group))

    def passed(position: Column) -> Column:
        return sum(((c <= position).cast("int") for c in cuts), F.lit(0))

    counts = counts.withColumn("_first", passed(F.col("_before"))).withColumn("_last", passed(F.col("_before") + F.col("_c") - 1))
    # without groups there are at most PREFIXES counts
    rows = join_groups(d, counts if by else F.broadcast(counts), [*by, "_b"])
    known = rows.where("_first = _last").withColumn(name, F.col("_first"))
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", *keys)) - 1
    cut = rows.where("_first <> _last").withColumn("_place", F.col("_before") + place).withColumn(name, passed(F.col("_place"))).drop("_place")
    return known.unionByName(cut).drop("_h", "_b", "_c", "_before", "_n", "_first", "_last")


def cut_points(df: DataFrame, cuts: Sequence[Column], key: str | Sequence[str], seed: int) -> list[tuple | None]:
    """For each of the ``cuts`` (expressions over ``_n``, the rows), the (md5, keys) of the row at the cut's position in md5 order, NULL past
    the last row. The key must be unique. Rows are counted per md5 prefix, and only prefixes that hold a cut are sorted; one tuple a cut comes back."""
    keys = [key] if isinstance(key, str) else list(key)
    digits = len(f"{PREFIXES - 1:x}")
    # hexadecimal digits of one length are in the order of their numbers
    d = df.select(*keys, md5_key(keys, seed).alias("_h")).withColumn("_b", F.substring("_h", 1, digits))
    order = Window.partitionBy(F.lit(0))
    counts = d.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))  # PREFIXES rows at most
    before = F.coalesce(F.sum("_c").over(order.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumn("_n", F.sum("_c").over(order))
    at = F.array(*[F.struct(F.lit(i).alias("_i"), F.greatest(F.ceil(c), F.lit(0)).cast("long").alias("_p")) for i, c in enumerate(cuts)])
    at = counts.select("_b", "_c", "_before", F.inline(at)).where("_p >= _before and _p < _before + _c").drop("_c")
    place = F.row_number().over(Window.partitionBy("_i", "_b").orderBy("_h", *keys)) - 1
    found = d.join(F.broadcast(at), "_b").withColumn("_place", F.col("_before") + place).where("_place = _p")  # one row a cut
    points = {r["_i"]: (r["_h"], *[r[k] for k in keys]) for r in found.select("_i", "_h", *keys).collect()}
    return [points.get(i) for i in range(len(cuts))]


def part_of(points: Sequence[tuple | None], schema: StructType, key: str | Sequence[str], seed: int) -> Column:
    """How many of the ``points`` (see ``cut_points``) are at or before a row in md5 order: what ``md5_parts`` adds, as a column of the row alone."""
    keys = [key] if isinstance(key, str) else list(key)
    row = F.struct(*[F.col(k) for k in keys])
    known = [(F.lit(p[0]), F.struct(*[F.lit(v).cast(schema[k].dataType).alias(k) for k, v in zip(keys, p[1:])])) for p in points if p is not None]

    def passed(h: Column) -> Column:
        return sum((((h > at) | ((h == at) & (row >= last))).cast("int") for at, last in known), F.lit(0))

    # the md5 is computed once a row: the transform of a one-element array gives it a name
    return F.get(F.transform(F.array(md5_key(keys, seed)), passed), F.lit(0))


def take_first(df: DataFrame, cut: Column, key: str | Sequence[str], seed: int, by: Sequence[str] = ()) -> DataFrame:
    """The rows before ``cut`` in md5 order (within ``by``)."""
    return md5_parts(df, [cut], key, seed, by).where("_part = 0").drop("_part")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """F-07."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def stratified_sample(df: DataFrame, by: str, frac: float, key: str | Sequence[str] = "id", seed: int = 0) -> DataFrame:
    """M-01: per class keep the first round(frac * n_class) rows in md5 order."""
    return take_first(df, F.round(F.col("_n") * F.lit(frac)), key, seed, by=[by])


def split_three(df: DataFrame, train: float, dev: float, key: str | Sequence[str] = "id", seed: int = 0, of: DataFrame | None = None) -> DataFrame:
    """M-02: tag rows 'train' / 'dev' / 'test' with exact counts int(n*train), int(n*dev), rest. With ``of`` the split is that of the table ``of``, whose
    keys are unique and hold those of ``df``: its two cut rows are looked up, and a row is tagged by its own key, without a join."""
    n_train, n_dev = F.floor(F.col("_n") * F.lit(train)), F.floor(F.col("_n") * F.lit(dev))
    cuts = [n_train, n_train + n_dev]
    if of is None:
        parts = md5_parts(df, cuts, key, seed)
    else:
        parts = df.withColumn("_part", part_of(cut_points(of, cuts, key, seed), df.schema, key, seed))
    return parts.withColumn("split", F.element_at(F.array(F.lit("train"), F.lit("dev"), F.lit("test")), F.col("_part") + 1)).drop("_part")


def balance_to_total(df: DataFrame, label: str, positive, total: int = 1000, key: str | Sequence[str] = "id", seed: int = 0) -> DataFrame:
    """M-03: all positive rows plus md5-sampled negatives up to ``total`` rows; more than ``total``
    positives is an error (a scalar check)."""
    k = df.filter(F.col(label) == F.lit(positive)).count()
    if k > total:
        raise ValueError(f"too many positive rows ({k}) for a balanced set of {total}")
    pos = df.filter(F.col(label) == F.lit(positive))
    return pos.unionByName(take_first(df.filter(F.col(label) != F.lit(positive)), F.lit(total - k), key, seed))


def undersample(df: DataFrame, label: str, key: str | Sequence[str] = "id", seed: int = 0) -> DataFrame:
    """M-04: every class (NULL is one) cut to the size of the smallest class, md5 order."""
    smallest = class_counts(df, label).agg(F.min("n")).first()[0] or 0
    return take_first(df, F.lit(smallest), key, seed, by=[label])


def top_up(df: DataFrame, is_negative: Column, target: int, key: str | Sequence[str] = "id", seed: int = 0) -> DataFrame:
    """M-05: keep all negatives, add md5-sampled positives up to ``target`` rows; error when there
    are more negatives than that or too few positives."""
    d = df.withColumn("_neg", is_negative)
    n_neg, n_pos = d.agg(F.count(F.when(F.col("_neg"), 1)), F.count(F.when(~F.col("_neg"), 1))).first()
    if n_neg > target or n_neg + n_pos < target:
        raise ValueError(f"{n_neg} negative and {n_pos} positive rows can't give {target}")
    picked = take_first(d.filter(~F.col("_neg")), F.lit(target - n_neg), key, seed)
    return d.filter("_neg").unionByName(picked).drop("_neg")


def shuffle(df: DataFrame, key: str | Sequence[str] = "id", seed: int = 0, num_partitions: int | None = None) -> DataFrame:
    """M-06: md5 order. Spread by hash, then sorted inside partitions: the concatenation of
    partitions is a global random order with no single-task sort."""
    h = md5_key(key, seed)
    d = df.withColumn("_h", h)
    d = d.repartition(num_partitions, "_h") if num_partitions else d.repartition("_h")
    return d.sortWithinPartitions("_h").drop("_h")


def few_shot(df: DataFrame, k: int, key: str | Sequence[str] = "id", seed: int = 0) -> DataFrame:
    """M-07 / M-08: min(k, n) rows, the first k in md5 order (a top-k: partial top-k per task)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("_h", md5_key(keys, seed)).orderBy("_h", *keys).limit(k).drop("_h")


def holdout(df: DataFrame, mode: str, size: float, key: str | Sequence[str] = "id", seed: int = 0, order: Sequence[str] = ()) -> DataFrame:
    """M-09: tag rows 'eval' / 'train'.
    mode 'first_frac': first ceil(n * size) rows in md5 order are eval;
    mode 'last_n': the last ``size`` rows in ``order`` are eval;
    mode 'fraction': md5 bucket below ``size`` is eval (independent per row);
    mode 'overlap': every row is train, and the first ``size`` rows in md5 order are eval as well."""
    if mode == "overlap":
        both = take_first(df, F.lit(int(size)), key, seed).withColumn("split", F.lit("eval"))
        return df.withColumn("split", F.lit("train")).unionByName(both)
    if mode == "fraction":
        u = F.conv(F.substring(md5_key(key, seed), 1, 8), 16, 10).cast("double") / F.lit(float(16**8))
        return df.withColumn("split", F.when(u < F.lit(size), "eval").otherwise("train"))
    if mode == "first_frac":
        parts = md5_parts(df, [F.ceil(F.col("_n") * F.lit(size))], key, seed)
        return parts.withColumn("split", F.when(F.col("_part") == 0, "eval").otherwise("train")).drop("_part")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    if mode == "last_n":
        r = row_index(df, list(order), name="_rank").crossJoin(F.broadcast(total))
        ev = F.col("_rank") >= F.col("_n") - F.lit(int(size))
    else:
        raise ValueError(f"unknown holdout mode {mode!r}")
    return r.withColumn("split", F.when(ev, "eval").otherwise("train")).drop("_rank", "_n")


def minibatches(df: DataFrame, size: int, order: Sequence[str], shuffled: bool = False, key: str | Sequence[str] = "id", seed: int = 0) -> DataFrame:
    """M-11: batch = floor(position / size). Contiguous in ``order``; or in md5 order with the
    incomplete last batch dropped."""
    if shuffled:
        r = md5_rank(df, key, seed, name="_pos")
        total = df.agg(F.count(F.lit(1)).alias("_n"))
        full = F.floor(F.col("_n") / F.lit(size)) * F.lit(size)
        return r.crossJoin(F.broadcast(total)).filter(F.col("_pos") < full).withColumn(
            "batch", F.floor(F.col("_pos") / F.lit(size)).cast("long")
        ).drop("_pos", "_n")
    r = row_index(df, list(order), name="_pos")
    return r.withColumn("batch", F.floor(F.col("_pos") / F.lit(size)).cast("long")).drop("_pos")


def split_even(df: DataFrame, n_parts: int, order: Sequence[str]) -> DataFrame:
    """S-09: parts of ceil(n / n_parts) consecutive rows, numbered from 1 (tail parts may be short
    or absent)."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    r = row_index(df, list(order), name="_pos").crossJoin(F.broadcast(total))
    per = F.ceil(F.col("_n") / F.lit(n_parts))
    return r.withColumn("part", (F.floor(F.col("_pos") / per) + 1).cast("int")).drop("_pos", "_n")


def split_chunks(df: DataFrame, size: int, order: Sequence[str]) -> DataFrame:
    """S-10: parts of ``size`` consecutive rows numbered from 1."""
    r = row_index(df, list(order), name="_pos")
    return r.withColumn("part", (F.floor(F.col("_pos") / F.lit(size)) + 1).cast("int")).drop("_pos")
