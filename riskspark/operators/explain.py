"""Feature attributions and local surrogates (A-10 ... A-14).

* Linear models: exact Shapley values in log-odds, w_j * (x_j - mean_j), as column arithmetic.
* Other models: sampled Shapley values. Rows x permutations x positions are exploded, the two
  hybrid vectors of every position are scored by the model's own ``transform`` (distributed; one
  point serves both neighbouring features), and contributions are averaged per (row, feature).
* Tree ensembles: exact values, see ``trees``.
* Local linear surrogate: perturbations per explained row, scored in one pass, then a weighted ridge
  fit per row from summed normal equations, solved by Cholesky factors in numpy.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .features import quoted
from .ordered import row_index


def _bound(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once a row: a later reference reads the value, where the optimiser would otherwise repeat the
    expression in every place that uses it."""
    once = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.explode(F.array(once)).alias("_once")).select(*df.columns, "_once.*")


def _u01(*parts: Column) -> Column:
    """Deterministic uniform (0, 1) from an md5 of the parts."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("double")
    return (h + F.lit(0.5)) / F.lit(float(16**12))


def linear_attributions(df: DataFrame, features: Sequence[str], weights: Sequence[float], background: DataFrame, key: str = "id") -> DataFrame:
    """A-10 (linear): long table (key, feature, value, attribution) with w_j * (x_j - mean_j);
    means over ``background`` (one aggregate row, read once to build the expression)."""
    means = background.agg(*[F.avg(quoted(f)).cast("double").alias(f"_m{i}") for i, f in enumerate(features)]).first()  # one row
    # only plain numbers are exploded: the name, the weight and the mean follow from the place
    long = df.select(key, F.posexplode(F.array(*[quoted(f).cast("double") for f in features])).alias("_at", "value"))
    name, weight, mean = (F.get(F.array(*[F.lit(v).cast(t) for v in all_]), F.col("_at")) for all_, t in ((features, "string"), (map(float, weights), "double"), (means, "double")))
    return long.select(key, name.alias("feature"), "value", (weight * (F.col("value") - mean)).alias("attribution"))


def sampled_shapley(model, df: DataFrame, features: Sequence[str], background: DataFrame, n_perm: int = 8, key: str = "id", seed: int = 0) -> DataFrame:
    """A-10 (any model): permutation-sampling Shapley values of P(class 1)."""
    k = len(features)
    x = df.select(key, F.array(*[F.col(f).cast("double") for f in features]).alias("_x"))
    bg = background.select(F.array(*[F.col(f).cast("double") for f in features]).alias("_b"))
    bg = row_index(bg.withColumn("_h", F.md5(F.concat_ws(",", F.col("_b").cast("array<string>")))), ["_h"], name="_bn")
    bg = bg.select("_b", (F.col("_bn") + 1).cast("int").alias("_bn"))
    n_bg = bg.count()
    rows = x.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("_p"))
    # background row and permutation of each (row, draw): both from md5, so reproducible
    rows = rows.withColumn("_bn", (F.floor(_u01(F.col(key), F.col("_p"), F.lit(seed), F.lit("bg")) * n_bg) + 1).cast("int"))
    perm = F.transform(
        F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.struct(_u01(F.col(key), F.col("_p"), i, F.lit(seed)).alias("u"), i.alias("i")))),
        lambda s: s["i"],
    )
    rows = rows.join(bg, "_bn").withColumn("_perm", perm)
    # place of each feature in the permutation, once per draw
    place = F.transform(F.array_sort(F.transform("_perm", lambda f, p: F.struct(f.alias("f"), p.alias("p")))), lambda s: s["p"])
    rows = rows.withColumn("_place", place)
    # k + 1 points from the background to the row; neighbours share one
    points = rows.select(key, "_x", "_b", "_perm", "_place", F.explode(F.sequence(F.lit(0), F.lit(k))).alias("_at"))
    # place by place: a lambda over the array is interpreted
    hybrid = F.array(*[F.when(F.get("_place", F.lit(i)) < F.col("_at"), F.get("_x", F.lit(i))).otherwise(F.get("_b", F.lit(i))) for i in range(k)])
    scored = model.transform(points.select(key, "_perm", "_at", array_to_vector(hybrid).alias("features")))
    p1 = vector_to_array("probability")[1]
    # a point ends the step of the feature before it and starts the step of the one after it
    ends = F.when(F.col("_at") > 0, F.array(F.struct(F.get("_perm", F.col("_at") - 1).alias("f"), F.lit(1).alias("s")))).otherwise(F.array().cast("array<struct<f:int,s:int>>"))
    starts = F.when(F.col("_at") < k, F.array(F.struct(F.get("_perm", F.col("_at")).alias("f"), F.lit(-1).alias("s")))).otherwise(F.array().cast("array<struct<f:int,s:int>>"))
    steps = scored.select(key, p1.alias("_p1"), F.explode(F.concat(ends, starts)).alias("e")).select(key, F.col("e.f").alias("_feat"), (F.col("e.s") * F.col("_p1")).alias("_d"))
    phi = steps.groupBy(key, "_feat").agg((F.sum("_d") / F.lit(float(n_perm))).alias("attribution"))
    names = F.array(*[F.lit(f) for f in features])
    return phi.select(key, F.element_at(names, F.col("_feat") + 1).alias("feature"), "attribution")


def importance(attr: DataFrame) -> DataFrame:
    """A-11: mean |attribution| per feature with its rank (1 = top feature)."""
    imp = attr.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
    w = Window.orderBy(F.desc("mean_abs"), "feature")
    # one row per feature: a tiny table
    return imp.withColumn("rank", F.row_number().over(w))


def dependence_table(attr: DataFrame, imp: DataFrame) -> DataFrame:
    """A-12: (value, attribution) pairs of the top feature."""
    top = imp.filter(F.col("rank") == 1).select("feature")
    return attr.join(top, "feature", "left_semi")


# ----------------------------------------------------------------------------- local surrogates


POINTS = 10_000  # points made at a time
SOLVED = 256  # systems solved at a time


def gaussian_stats(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: arrays ``mean`` and ``scale`` (population deviation, 1 for a constant feature) over ``train``."""
    row = train.agg(*[F.avg(quoted(f)).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(quoted(f)).alias(f"s{i}") for i, f in enumerate(features)])
    scale = [F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0) for i in range(len(features))]
    return row.select(F.array(*[F.coalesce(f"m{i}", F.lit(0.0)) for i in range(len(features))]).alias("mean"), F.array(*scale).alias("scale"))


def quantile_cuts(train: DataFrame, shares: Sequence[float], accuracy: int = 10_000) -> list[list[float] | None]:
    """For every (double) column of ``train`` its values at ``shares`` of its rows, missing ones left out; None where there are none. The rank error is at most
    1 / accuracy, and 0 where no task has more than ``4 * accuracy`` rows.

    A task sorts ``16 * accuracy`` values at a time and keeps the second of every four, then does so with what it kept (numpy): each time is an error of
    1 / (8 * accuracy) at most, and six times hold 600 million rows at the usual accuracy. Its samples, thinned to ``4 * accuracy``, meet those of the
    other tasks by column."""
    import pyarrow as pa

    size, k = 16 * accuracy, len(train.columns)

    def keep(levels: list[list[np.ndarray]], at: int, v: np.ndarray) -> None:
        if at == len(levels):
            levels.append([])
        levels[at].append(v)
        if sum(map(len, levels[at])) >= size:
            held = np.concatenate(levels[at])
            whole = len(held) // 4 * 4
            levels[at] = [held[whole:]]
            keep(levels, at + 1, np.sort(held[:whole])[1::4])

    def samples(batches):
        columns: list[list[list[np.ndarray]]] = [[] for _ in range(k)]
        for b in batches:
            for levels, c in zip(columns, b.columns):
                keep(levels, 0, c.drop_null().to_numpy(zero_copy_only=False).copy())
        for i, levels in enumerate(columns):
            held = [np.concatenate(x) for x in levels]
            v, w = np.concatenate([*held, []]), np.concatenate([*[np.full(len(x), 4.0**j) for j, x in enumerate(held)], []])
            if len(v) > size // 4:
                order = np.argsort(v)
                up_to, n = w[order].cumsum(), size // 4
                v = v[order][np.searchsorted(up_to, (np.arange(n) + 0.5) * (up_to[-1] / n))]
                w = np.full(n, up_to[-1] / n)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), *[pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (v, w)]], names=["at", "v", "w"])

    def cuts(batches):
        found: dict[int, list] = {}
        for b in batches:
            for i, v, w in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                found.setdefault(i, []).append((v.values.to_numpy(), w.values.to_numpy()))
        for i, parts in found.items():
            v, w = (np.concatenate(x) for x in zip(*parts))
            if len(v):
                order = np.argsort(v)
                up_to = w[order].cumsum()
                places = np.searchsorted(up_to, np.ceil(np.array(shares) * round(up_to[-1])) * (1 - 1e-12))
                yield pa.RecordBatch.from_pydict({"at": pa.array([i], pa.int32()), "c": [v[order][places].tolist()]})

    # one row a task and column, then one a column
    each = train.mapInArrow(samples, "at int, v array<double>, w array<double>").repartition("at").mapInArrow(cuts, "at int, c array<double>")
    got = {r["at"]: list(r["c"]) for r in each.collect()}
    return [got.get(i) for i in range(k)]


def quartile_stats(train: DataFrame, features: Sequence[str], accuracy: int = 10_000) -> DataFrame:
    """One row: for every feature its quartile cuts and, for the four buckets (value <= cut), cumulated share, mean, deviation, least
    and greatest value over ``train``. Cuts are ``quantile_cuts`` (rank error at most 1 / accuracy). ``train`` is read once for the
    cuts of all features and once for their buckets (numpy; one row a task), and should be stored."""
    import pyarrow as pa

    names = list(features)
    values = train.select(*[quoted(f).cast("double").alias(f"v{i}") for i, f in enumerate(names)])
    cuts = quantile_cuts(values, [0.25, 0.5, 0.75], accuracy)
    without = [f for f, c in zip(names, cuts) if c is None]
    if without:
        raise ValueError(f"no values of {without}: they have no quartiles")
    cuts = np.array(cuts)

    def merged(total: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Count, mean, sum of squared differences from it, least and greatest value (by feature and bucket) of two parts together."""
        (n, m, q, l, h), (n2, m2, q2, l2, h2) = total, part
        both = np.maximum(n + n2, 1)
        return np.stack([n + n2, np.where(n2 > 0, m + (m2 - m) * (n2 / both), m), q + q2 + (m2 - m) ** 2 * (n * n2 / both), np.fmin(l, l2), np.maximum(h, h2)])

    def nothing() -> np.ndarray:
        out = np.zeros((5, len(names), 4))
        out[3], out[4] = np.inf, -np.inf
        return out

    def parts(batches):
        total = nothing()
        for b in batches:
            part = nothing()
            for i in range(len(names)):
                v = np.sort(b.column(i).drop_null().to_numpy(zero_copy_only=False))  # NaN comes last
                ends = [0, *np.searchsorted(v, cuts[i], side="right"), len(v)]
                for j, (lo, hi) in enumerate(zip(ends, ends[1:])):
                    if lo < hi:
                        own = v[lo:hi]
                        mean = own.mean()
                        part[:, i, j] = hi - lo, mean, ((own - mean) ** 2).sum(), own[0], own[-1]
            total = merged(total, part)
        yield pa.RecordBatch.from_pydict({"s": [total.ravel().tolist()]})

    def whole(batches):
        total = nothing()
        for b in batches:
            for s in b.column(0).to_pylist():
                total = merged(total, np.array(s).reshape(total.shape))
        n, mean, square, least, most = total
        with np.errstate(invalid="ignore"):
            tables = {"share": n.cumsum(axis=1) / n.sum(axis=1)[:, None], "mean": mean, "deviation": np.sqrt(square / np.maximum(n, 1))}
        tables |= {"least": np.where(n > 0, least, 0.0), "most": np.where(n > 0, most, 0.0)}
        row = [{"at": i, "cuts": cuts[i].tolist(), **{name: t[i].tolist() for name, t in tables.items()}} for i in range(len(names))]
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.list_(pa.struct([("at", pa.int32()), *[(c, pa.list_(pa.float64())) for c in ("cuts", *tables)]])))], names=["buckets"])

    lists = ", ".join(f"{c}: array<double>" for c in ("cuts", "share", "mean", "deviation", "least", "most"))
    return values.mapInArrow(parts, "s array<double>").repartition(1).mapInArrow(whole, f"buckets array<struct<at: int, {lists}>>")  # one row a task


def model_score(model) -> Callable[[DataFrame], DataFrame]:
    """P(class 1) of a fitted MLlib model as a scorer: takes rows with an array ``_v``, adds ``_y``."""

    def score(df: DataFrame) -> DataFrame:
        points = model.transform(df.withColumn("features", array_to_vector("_v")))
        return points.withColumn("_y", vector_to_array("probability")[1]).select(*df.columns, "_y")

    return score


#: md5: its additive constants, its rotations, and where each step takes its word.
_MD5_ADD = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_MD5_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_MD5_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
MD5_CELLS = 32_768  # hashes computed together: their few arrays stay in the processor's cache


def _md5_block(words: list, shape: tuple) -> np.ndarray:
    """The first 48 bits of the md5 of messages of one block, as doubles: ``words`` are its 16 words, arrays that broadcast to ``shape`` or plain numbers."""
    a, b, c, d = (np.full(shape, v, "uint32") for v in _MD5_START)
    f, turned = np.empty(shape, "uint32"), np.empty(shape, "uint32")
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        word, add = words[_MD5_WORD[i]], _MD5_ADD[i]
        if isinstance(word, np.ndarray):
            f += word
        else:
            add = (add + word) % 2**32
        f += np.uint32(add)
        by = _MD5_TURN[i // 16][i % 4]
        np.left_shift(f, np.uint32(by), out=turned)
        f >>= np.uint32(32 - by)
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += np.uint32(_MD5_START[0])
    b += np.uint32(_MD5_START[1])
    return a.byteswap() * 65536.0 + (b.byteswap() >> np.uint32(16))


def _md5_heads(starts: Sequence[bytes], tails: Sequence[bytes]) -> np.ndarray:
    """(tails, starts): the first 48 bits of ``md5(start + tail)`` as doubles. Messages that fit one block (55 bytes) are hashed together in numpy."""
    out = np.empty((len(tails), len(starts)))
    sizes, tail_sizes = np.array([len(x) for x in starts]), np.array([len(x) for x in tails])
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        base = np.zeros((len(at), 64), "uint8")
        if n <= 55:
            base[:, :n] = np.frombuffer(b"".join(starts[i] for i in at), "uint8").reshape(len(at), n)
        words = np.ascontiguousarray(base.view("<u4").T)
        for m in np.unique(tail_sizes):
            rows = np.flatnonzero(tail_sizes == m)
            if n + m > 55:
                for t in rows:
                    out[t, at] = [int.from_bytes(hashlib.md5(starts[i] + tails[t]).digest()[:6], "big") for i in at]
                continue
            rest = np.zeros((len(rows), 64), "uint8")
            rest[:, n : n + m] = np.frombuffer(b"".join(tails[t] for t in rows), "uint8").reshape(len(rows), m)
            rest[:, n + m] = 0x80
            rest[:, 56:58] = divmod(8 * (n + m), 256)[::-1]
            first, last, more = n // 4, (n + m) // 4, rest.view("<u4").T  # the words that a tail has a part of
            step = max(1, MD5_CELLS // len(at))
            for lo in range(0, len(rows), step):
                some = more[:, lo : lo + step]
                block = [words[w] if w < first else words[w] | some[w][:, None] if w <= last else int(some[w, 0]) for w in range(16)]
                out[np.ix_(rows[lo : lo + step], at)] = _md5_block(block, (some.shape[1], len(at)))
    return out


def _draws(starts: Sequence[bytes], places: Sequence[int], seed: int, kind: str) -> np.ndarray:
    """(places, starts): ``_u01`` of (key, sample, place, seed, kind) for points whose text starts ``key:sample:``."""
    return (_md5_heads(starts, [f"{i}:{seed}:{kind}".encode() for i in places]) + 0.5) / float(16**12)


def _normal_draws(starts: Sequence[bytes], places: Sequence[int], seed: int) -> np.ndarray:
    """(places, starts): a normal draw of the uniform ones of kinds ``a`` and ``b``."""
    return np.sqrt(-2 * np.log(_draws(starts, places, seed, "a"))) * np.cos(2 * math.pi * _draws(starts, places, seed, "b"))


def _with_draws(points: DataFrame, k: int, seed: int, uniform: bool) -> DataFrame:
    """Adds arrays of ``k`` draws to points (``_key``, ``_s``): ``_n`` normal ones and, with ``uniform``, ``_u``."""
    import pyarrow as pa

    text, column = points.select("*", F.col("_key").cast("string").alias("_text")), points.columns

    def run(batches):
        for b in batches:
            starts = [_point_start(key, s) for key, s in zip(b.column(len(column)).to_pylist(), b.column(column.index("_s")).to_pylist())]
            offsets = pa.array(np.arange(0, b.num_rows * k + 1, k, dtype="int32"))
            found = [_normal_draws(starts, range(k), seed), *([_draws(starts, range(k), seed, "u")] if uniform else [])]
            drawn = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(d.T).ravel())) for d in found]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(column)], *drawn], names=[*column, "_n", "_u"][: len(column) + len(drawn)])

    numbers = [StructField(n, ArrayType(DoubleType())) for n in (["_n", "_u"] if uniform else ["_n"])]
    return text.mapInArrow(run, StructType([*points.schema.fields, *numbers]))


def _point_start(key: str | None, s: int) -> bytes:
    return (f"{s}:" if key is None else f"{key}:{s}:").encode()


def _bucket_points(rows: DataFrame, buckets: Sequence, n_samples: int, seed: int) -> DataFrame:
    """The points of ``perturbed`` for rows (``_key``, ``_x``) on quartile buckets, made in numpy: about as many at a time as an Arrow batch has.
    A normal draw is made only where some bucket of the feature has a deviation; elsewhere it would be multiplied by 0."""
    import pyarrow as pa

    k = len(buckets)
    cuts, share, mean, deviation, least, most = (np.array([b[name] for b in buckets], "float64") for name in ("cuts", "share", "mean", "deviation", "least", "most"))
    wide, places = [i for i in range(k) if not (deviation[i] == 0).all()], np.arange(k)
    text = rows.select("_key", "_x", F.col("_key").cast("string").alias("_text"))

    def points(key: pa.Array, x: np.ma.MaskedArray, starts: list[bytes], first: np.ndarray) -> pa.RecordBatch:
        """``x`` is (features, points); ``first`` marks the rows themselves."""
        # a missing value is over no cut, NaN is over all
        own = sum((~(x.data <= cuts[:, j, None]) & ~x.mask).astype("int8") for j in range(3))
        u = _draws(starts, range(k), seed, "u")
        drawn = sum((u > share[:, j, None]).astype("int8") for j in range(3))
        at = np.where(first, own, drawn)
        of = lambda table: table[places[:, None], at]
        v = of(mean)
        if wide:
            v[wide] += of(deviation)[wide] * _normal_draws(starts, wide, seed)
        v = np.where(first, x.data, np.minimum(np.maximum(v, of(least)), of(most)))
        z = (at == own).astype("float64")
        offsets = pa.array(np.arange(0, len(starts) * k + 1, k, dtype="int32"))
        lists = [pa.ListArray.from_arrays(offsets, a) for a in (pa.array(z.T.ravel()), pa.array(v.T.ravel(), mask=(x.mask & first).T.ravel()))]
        return pa.RecordBatch.from_arrays([key, *lists, pa.array(k - z.sum(axis=0))], names=["_key", "_z", "_v", "_d2"])

    def run(batches):
        for b in batches:
            flat = b.column(1).flatten()
            values = flat.to_numpy(zero_copy_only=False).reshape(b.num_rows, k).T
            missing = flat.is_null().to_numpy(zero_copy_only=False).reshape(b.num_rows, k).T
            text = b.column(2).to_pylist()
            every = b.num_rows * n_samples
            for lo in range(0, every, POINTS):
                row, s = np.divmod(np.arange(lo, min(every, lo + POINTS)), n_samples)
                starts = [_point_start(text[i], j) for i, j in zip(row, s)]
                yield points(b.column(0).take(pa.array(row)), np.ma.MaskedArray(values[:, row], missing[:, row]), starts, s == 0)

    numbers = [StructField(n, ArrayType(DoubleType())) for n in ("_z", "_v")]
    return text.mapInArrow(run, StructType([rows.schema["_key"], *numbers, StructField("_d2", DoubleType())]))


def perturbed(rows: DataFrame, stats: DataFrame, features: Sequence[str], n_samples: int, key: str, seed: int) -> DataFrame:
    """(key, _z, _v, _d2): ``n_samples`` points a row, the row itself first; ``_z`` what the surrogate sees, ``_v`` what the model sees, ``_d2`` the
    squared distance to the row.

    With ``gaussian_stats``: normal draws by the train table's mean and scale, ``_z`` standardised. With ``quartile_stats``: a bucket
    by its share and a normal draw of its mean and deviation, held between its least and greatest value; ``_z`` is 1 where the bucket is the row's."""
    # a few rows make many points: they are dealt out by number first
    rows = rows.select(F.col(key).alias("_key"), F.array(*[quoted(f).cast("double") for f in features]).alias("_x"))
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key")
    if "buckets" in stats.columns:
        return _bucket_points(rows, stats.first()["buckets"], n_samples, seed)  # one row
    s = rows.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    s = _with_draws(s, len(features), seed, False).crossJoin(F.broadcast(stats))  # one row
    is_row = F.col("_s") == 0
    z0 = F.transform("_x", lambda x, i: (x - F.get("mean", i)) / F.get("scale", i))
    s = _bound(s, _z0=z0).withColumn("_z", F.when(is_row, F.col("_z0")).otherwise(F.col("_n")))
    v = F.when(is_row, F.col("_x")).otherwise(F.transform("_z", lambda z, i: z * F.get("scale", i) + F.get("mean", i)))
    d2 = F.aggregate(F.zip_with("_z", "_z0", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return s.select("_key", "_z", v.alias("_v"), d2.alias("_d2"))


def cholesky_solve(matrix: Column, right: Column, k: int) -> Column:
    """x of ``A x = b`` as an array: A symmetric, its lower triangle packed by rows in ``matrix``; entries are NULL where A isn't positive definite.
    Rows are factored and solved together in numpy, ``SOLVED`` at a time."""
    import pyarrow as pa

    low, pairs = np.tril_indices(k), k * (k + 1) // 2

    def solved(packed: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(x, whether A is positive definite) of every row."""
        a = np.zeros((len(packed), k, k))
        a[:, low[0], low[1]] = packed
        good, x = np.ones(len(packed), bool), b.copy()
        with np.errstate(all="ignore"):
            for j in range(k):  # the factor takes the place of the triangle, column by column
                a[:, j:, j] -= np.einsum("nij,nj->ni", a[:, j:, :j], a[:, j, :j])
                good &= ~(a[:, j, j] <= 0)
                a[:, j, j] = np.sqrt(a[:, j, j])
                a[:, j + 1 :, j] /= a[:, j, j, None]
                x[:, j] = (x[:, j] - np.einsum("nj,nj->n", a[:, j, :j], x[:, :j])) / a[:, j, j]
            for j in reversed(range(k)):
                x[:, j] = (x[:, j] - np.einsum("nj,nj->n", a[:, j + 1 :, j], x[:, j + 1 :])) / a[:, j, j]
        return x, good

    def solve(matrix: pa.Array, right: pa.Array) -> pa.Array:
        out, fine = np.empty((len(matrix), k)), np.empty(len(matrix), bool)
        for lo in range(0, len(matrix), SOLVED):
            m, b = matrix.slice(lo, SOLVED), right.slice(lo, SOLVED)
            a, y = (c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), n) for c, n in ((m, pairs), (b, k)))
            out[lo : lo + SOLVED], fine[lo : lo + SOLVED] = solved(a, y)
        offsets = pa.array(np.arange(0, out.size + 1, k, dtype="int32"))
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), mask=np.repeat(~fine, k)))

    solve.__annotations__ = {"matrix": pa.Array, "right": pa.Array, "return": pa.Array}
    return F.arrow_udf(solve, ArrayType(DoubleType()))(matrix, right)


def weighted_ridge(samples: DataFrame, k: int, ridge: float, top: int | None = None) -> DataFrame:
    """(key, coef): intercept and k weights of a ridge fit for every ``_key`` of samples (``_z``, ``_y``, ``_w``), the intercept free.

    The normal equations are sums of the packed lower triangle of ``w a a'`` and of ``w y a`` (a: 1 and z): each Arrow batch of samples gives one
    array a key (numpy), and the arrays of a key are added up, so its samples are neither shuffled nor in one task. With ``top`` only the features of the largest absolute weights (the
    first listed on ties) stay: they are solved again from the same sums; the others get NULL."""
    import pyarrow as pa

    n = k + 1
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    low, width = np.tril_indices(n), len(pairs) + n

    def sums(batches):
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)  # a NULL key is a key
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
            a = np.ones((b.num_rows, n))
            a[:, 1:] = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, k)
            y, w = (b.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            a, y, w = a[order], y[order], w[order]
            out = np.empty((len(starts), width))
            for i, (lo, hi) in enumerate(zip(starts, [*starts[1:], b.num_rows])):
                weighted = a[lo:hi] * w[lo:hi, None]
                out[i, : len(pairs)] = (weighted.T @ a[lo:hi])[low]
                out[i, len(pairs) :] = weighted.T @ y[lo:hi]
            offsets = pa.array(np.arange(0, out.size + 1, width, dtype="int32"))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(order[starts])), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], names=["_key", "_t"])

    rows = samples.select("_key", "_z", F.col("_y").cast("double").alias("_y"), F.col("_w").cast("double").alias("_w"))
    parts = rows.mapInArrow(sums, StructType([rows.schema["_key"], StructField("_t", ArrayType(DoubleType()))]))
    # dealt out by number: the rows are few and small, the fits are work
    packed = parts.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key").groupBy("_key").agg(F.collect_list("_t").alias("_c"))
    packed = _bound(packed, _all=F.aggregate("_c", F.array_repeat(F.lit(0.0), width), lambda t, s: F.zip_with(t, s, lambda x, y: x + y)))
    penalty = F.array(*[F.lit(ridge if i == j and i > 0 else 0.0) for i, j in pairs])
    m = _bound(packed.select("_key", "_all"), _m=F.zip_with(F.slice("_all", 1, len(pairs)), penalty, lambda a, b: a + b), _b=F.slice("_all", len(pairs) + 1, n))
    m = _bound(m, coef=cholesky_solve(F.col("_m"), F.col("_b"), n))
    if top is None or top >= k:
        return m.select(F.col("_key").alias("key"), "coef")
    order = F.array_sort(F.transform(F.slice("coef", 2, k), lambda c, i: F.struct((-F.abs(c)).alias("c"), i.alias("i"))))
    m = _bound(m, _top=F.transform(F.slice(order, 1, top), lambda s: s["i"] + 1))
    stays = lambda i: (i == 0) | F.array_contains("_top", i)
    # what goes keeps a diagonal of its own, so that its weight is 0 and the rest are solved without it
    held = F.zip_with("_m", places, lambda a, p: F.when(stays(p["i"]) & stays(p["j"]), a).when(p["i"] == p["j"], F.lit(1.0)).otherwise(0.0))
    m = _bound(m.select("_key", "_top", "_m", "_b"), _m2=held, _b2=F.transform("_b", lambda b, i: F.when(stays(i), b).otherwise(0.0)))
    again = F.transform(cholesky_solve(F.col("_m2"), F.col("_b2"), n), lambda c, i: F.when(stays(i), c))
    return m.select(F.col("_key").alias("key"), again.alias("coef"))


def local_surrogate(score: Callable[[DataFrame], DataFrame], rows: DataFrame, stats: DataFrame, features: Sequence[str], n_samples: int = 500, key: str = "id", seed: int = 0,
                    ridge: float = 1.0, top: int | None = None) -> DataFrame:
    """A-13: (key, feature, weight) of a weighted ridge fit to the scores of points around each row, with the intercept; kernel
    sqrt(exp(-d^2 / width^2)), width 0.75 * sqrt(features). ``stats`` is ``gaussian_stats`` or ``quartile_stats`` of the train
    table, ``score`` adds ``_y`` to points ``_v`` (see ``model_score``). With ``top``, only the features of the largest weights."""
    k = len(features)
    points = score(perturbed(rows, stats, features, n_samples, key, seed))
    samples = points.withColumn("_w", F.exp(-F.col("_d2") / F.lit(2 * 0.75**2 * k)))
    names = F.array(*[F.lit(f) for f in ["intercept", *features]])
    fits = weighted_ridge(samples, k, ridge, top)
    out = fits.select("key", F.posexplode("coef").alias("at", "weight")).where(F.col("weight").isNotNull())
    return out.select(F.col("key").alias(key), F.get(names, F.col("at")).alias("feature"), "weight")


def score_formula(df: DataFrame, formula: str, label: str = "label", threshold: float | None = 0.5) -> DataFrame:
    """A-14: score rows with a closed-form expression (Spark SQL text) and report accuracy. The class is score > threshold; with
    ``threshold=None`` the score rounded half to even, where any other value than the label (2, -1, NULL) is wrong."""
    s = df.withColumn("_score", F.expr(formula).cast("double"))
    pred = F.rint("_score") if threshold is None else F.when(F.col("_score") > F.lit(threshold), 1).otherwise(0)
    return s.agg(F.avg(F.when(pred == F.col(label), 1.0).otherwise(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def score_logits(df: DataFrame, formulas: Sequence[str], label: str = "label") -> DataFrame:
    """A-14: one closed-form logit a class, scored together; the largest wins, the first listed on ties; a row with a NULL logit counts as wrong."""
    logits = F.array(*[F.expr(f).cast("double") for f in formulas])
    s = df.select(F.col(label).alias("_label"), logits.alias("_logits"))
    pred = F.when(~F.exists("_logits", lambda v: v.isNull()), F.array_position("_logits", F.array_max("_logits")) - 1)
    return s.agg(F.avg(F.when(pred == F.col("_label"), 1.0).otherwise(0.0)).alias("accuracy"), F.count(F.lit(1)).alias("n"))
