"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from riskspark.session import checkpoint_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder of ``spark.checkpoint.dir`` and read it back.

    Later reads neither recompute the lineage nor depend on the executors that wrote it."""
    spark = df.sparkSession
    path = checkpoint_path(spark, f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000
_STATE: dict[str, object] = {}


def worker_state(key: str, build: Callable[[], object]) -> object:
    """What an operator keeps in a Python worker between batches; only the last operator's is held, so that
    the memos of earlier stages of a job don't add up."""
    if key not in _STATE:
        _STATE.clear()
        release_memory()
        _STATE[key] = build()
    return _STATE[key]


def release_memory() -> None:
    """Give freed memory back to the system: Arrow's pool and the C library keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in the GNU C library
    if trim:
        trim(0)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo ``modulus`` (NULL id counts as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def map_rows(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str) -> DataFrame:
    """Apply a batch function (columns as Python lists in and out) to every Arrow batch."""
    out_schema = pa_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = fn({name: b.column(i).to_pylist() for i, name in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_pydict({f.name: got[f.name] for f in out_schema}, schema=out_schema)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, keep: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Rows of ``df`` (all columns, untouched) for which the batch predicate is true."""

    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(keep(b), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """Arrow schema of a mapInArrow result. Texts are long, so the session's Arrow batches are kept to
    ``BATCH_ROWS`` rows: that bounds the memory of a worker and of its executor's buffers."""
    bound_batches(spark)
    return to_arrow_schema(StructType.fromDDL(ddl))


def bound_batches(spark: SparkSession) -> None:
    rows = int(spark.conf.get(BATCH_CONF))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def groups_of(texts: list[str | None], most: int, chars: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most ``most`` texts and about ``chars`` characters (one text at least)."""
    first = held = 0
    for i, t in enumerate(texts):
        if i > first and (i - first >= most or held + len(t or "") > chars):
            yield first, i
            first, held = i, 0
        held += len(t or "")
    if texts:
        yield first, len(texts)
