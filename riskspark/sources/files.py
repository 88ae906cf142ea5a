"""Scans and sinks (S-01 ... S-12). Schemas are explicit so no pass over the data is spent on
inference; writes go through Spark's committers, so a lost executor never leaves half files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.prep import RAW_COLUMNS

LOAN_SCHEMA = T.StructType(
    [
        T.StructField(c, T.StringType() if c in {"purpose", "application_type", "grade", "addr_state", "emp_length",
                                                 "home_ownership", "verification_status", "loan_status"} else T.DoubleType())
        for c in RAW_COLUMNS
    ]
)

PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("reasoning_steps", T.StringType()),
        T.StructField("pred_prob", T.ArrayType(T.DoubleType())),
        T.StructField("pred_label", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("gold_label", T.IntegerType()),
    ]
)

COMPLETION_LOG_SCHEMA = T.StructType(
    [T.StructField("completions", T.ArrayType(T.StringType())), T.StructField("label", T.ArrayType(T.StringType()))]
)


def read_loans(spark: SparkSession, path: str) -> DataFrame:
    """S-01: loans CSV with a header; the 22 used columns in fixed order (others pruned).
    Columns are looked up by name, so a file with more columns in any order works. A cell that isn't of
    its column's type is NULL, as in a lenient reader."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    missing = [c for c in RAW_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"loans file lacks columns: {missing}")
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in LOAN_SCHEMA.fields])


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """S-02."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths)


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S-03 / S-04: '.json' = one JSON array (or object) per file, '.jsonl' = one record per line.
    Any other suffix is an error."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if path.endswith(".jsonl"):
        return reader.json(path)
    if path.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    raise ValueError(f"unsupported record file {path!r}: expected .json or .jsonl")


def read_parts(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """S-05: many JSONL part folders as one table, with the source file of every record."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.json(list(paths)).withColumn("source_file", F.input_file_name())


def read_checked(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """S-03 / S-04 / S-05: records of ``.json`` (one array or object a file) or JSONL files and folders, none of them lost: ``source_file``
    names a record's file and ``bad_record`` holds the text that isn't a record of ``schema`` (its fields are NULL then)."""
    several = {p.endswith(".json") for p in paths}
    if len(several) != 1:
        raise ValueError("give files of one kind: .json arrays, or JSON lines")
    reader = spark.read.schema(T.StructType([*schema.fields, T.StructField("bad_record", T.StringType())]))
    rows = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_record").option("multiLine", several.pop()).json(list(paths))
    return rows.withColumn("source_file", F.input_file_name())


def good_records(checked: DataFrame) -> DataFrame:
    """The records of ``read_checked``, with their source file."""
    return checked.where(F.col("bad_record").isNull()).drop("bad_record")


def file_report(checked: DataFrame) -> DataFrame:
    """Records and bad records of every file of ``read_checked``."""
    field = next(c for c in checked.columns if c not in ("bad_record", "source_file"))
    bad = F.col("bad_record").isNotNull()
    # Spark reads no file for the bad-record column alone, so a field is looked at too
    good = F.when(~bad, F.coalesce(F.col(f"`{field}`").cast("string"), F.lit("")))
    return checked.groupBy("source_file").agg(F.count(good).alias("records"), F.count(F.when(bad, 1)).alias("bad_records"))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """S-06."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_records(df: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    """S-07: JSON lines, non-ASCII text kept as is (one part file per task; no single array file). With ``compression`` (a codec of
    Spark's text sources) the files are compressed; the readers here take both."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path, compression=compression)


def append_records(df: DataFrame, path: str, compression: str | None = None) -> None:
    """S-08: append finished units to a JSON-lines folder."""
    df.write.mode("append").json(path, compression=compression)


def append_batch(df: DataFrame, path: str, batch: str, fmt: str = "json") -> None:
    """S-08, repeatable: the units of one batch, in a folder of the batch's own under ``path``. A retried job writes its batch
    anew in place of what the first try left, so nothing is there twice; other batches stay. As a streaming sink: ``foreachBatch`` with
    the batch id as ``batch``."""
    rows = df.withColumn("batch", F.lit(str(batch)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").format(fmt).save(path)


def write_parts(df: DataFrame, path: str, part_col: str = "part", compression: str | None = None) -> None:
    """S-09 / S-10 sink: one folder per part number."""
    df.write.mode("overwrite").partitionBy(part_col).json(path, compression=compression)


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S-11: write only when nothing is there yet; an existing output stays as it is."""
    df.write.mode("ignore").format(fmt).save(path)


def passed_ids(df: DataFrame, ok: str = "passed", key: str = "question_id") -> DataFrame:
    """S-12: ids of units that passed the filter, as a side output."""
    return df.filter(F.col(ok)).select(key).distinct()
