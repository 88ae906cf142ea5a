"""User-function surface (U-01 ... U-04).

A user's model (scorer, step scorer) runs inside ``mapInPandas``: Spark hands each task Arrow
batches, the factory loads the model once per Python worker and later tasks of the worker find it there,
and outputs come back as columns. Reward functions are Column expressions (or pandas UDFs)."""

import hashlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT_ROWS = 10_000  # scored rows that go back to Spark together
KEPT_SCORERS = 2  # loaded scorers that a Python worker keeps, the last used
_scorers: OrderedDict[str, Callable] = OrderedDict()


def worker_scorer(key: str, load_fn: Callable[[], Callable]) -> Callable:
    """The scorer of ``key``, loaded on first use in this worker; the one unused longest goes when there are more than ``KEPT_SCORERS``."""
    if key not in _scorers:
        while len(_scorers) >= KEPT_SCORERS:
            _scorers.popitem(last=False)
        _scorers[key] = load_fn()
    _scorers.move_to_end(key)
    return _scorers[key]


def rebatched(frames: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """The same rows in frames of ``size`` rows, across the edges of the given ones; the last may be short."""
    held: list[pd.DataFrame] = []
    n = 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= size:
            rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            whole = n - n % size
            for start in range(0, whole, size):
                part = rows.iloc[start : start + size]
                part.index = pd.RangeIndex(len(part))
                yield part
            held, n = [rows.iloc[whole:]], n - whole
    if n:
        yield pd.concat(held, ignore_index=True)


def joined(frames: list[pd.DataFrame]) -> pd.DataFrame:
    """The rows of the frames one after another. Frames without rows have no say in the types, and a column that has no value in some frame keeps the others' type."""
    some = [f for f in frames if len(f)] or frames[:1]
    if len(some) == 1:
        return some[0]
    return pd.DataFrame({c: _stacked([f[c] for f in some]) for c in some[0].columns})


def _stacked(parts: list[pd.Series]) -> pd.Series:
    if len({p.dtype for p in parts}) > 1:  # pandas would turn whole numbers into floats where a frame has none
        parts = [p.astype(object).where(p.notna(), None) for p in parts]
    return pd.concat(parts, ignore_index=True)


def score_partitions(
    df: DataFrame,
    load_fn: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: str,
    batch_size: int = 64,
    key: str | None = None,
) -> DataFrame:
    """U-01: ``load_fn()`` builds the scorer once per Python worker; the scorer maps a pandas batch to a
    pandas frame with ``schema``. Batches have ``batch_size`` rows whatever the Arrow batches hold; only the last of a
    partition may be short. ``key`` names the loaded scorer (default: a hash of the pickled factory). Results go back in frames of about
    ``OUT_ROWS`` rows, since a frame costs about as much to hand over as some thousand rows."""
    name = key or hashlib.sha256(cloudpickle.dumps(load_fn)).hexdigest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = worker_scorer(name, load_fn)
        held: list[pd.DataFrame] = []
        n = 0
        for b in rebatched(batches, batch_size):
            held.append(scorer(b))
            n += len(held[-1])
            if n >= OUT_ROWS:
                yield joined(held)
                held, n = [], 0
        if held:
            yield joined(held)

    return df.mapInPandas(run, schema=schema)


def score_steps(df: DataFrame, load_fn: Callable[[], Callable[[pd.Series], pd.Series]], text: str = "response", out: str = "step_probs",
                batch_size: int = 64) -> DataFrame:
    """U-03: a step scorer maps texts to lists of step scores -> array<double> column."""
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    schema = f"{fields}, `{out}` array<double>"

    def factory():
        fn = load_fn()

        def scorer(pdf: pd.DataFrame) -> pd.DataFrame:
            res = pdf.copy()
            res[out] = fn(pdf[text]).tolist()
            return res

        return scorer

    return score_partitions(df, factory, schema, batch_size)


def map_rows(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """U-04: row map that adds or replaces columns."""
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, *[c.alias(k) for k, c in columns.items()])


def pandas_reward(fn: Callable[[pd.Series, pd.Series], pd.Series]):
    """U-02: wrap a vectorised Python reward (completion, label) -> score as a pandas UDF."""

    def reward(completion: pd.Series, label: pd.Series) -> pd.Series:
        return pd.Series(fn(completion, label), index=completion.index, dtype="float64")

    return F.pandas_udf(reward, "double")
