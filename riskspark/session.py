"""Session helpers.

Library functions never create sessions; they take DataFrames and return DataFrames.
`local_session` is for tests and the bench only. On a cluster the job's own session is used
and the settings below are expected to come from the cluster configuration.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job of this library relies on (AQE re-plans joins at runtime: it turns a join
# into a broadcast only after measuring the small side, and splits skewed shuffle partitions).
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot does not JIT-compile methods above 8000 bytes of bytecode; wide text-parsing
    # projections would otherwise run one interpreted giant method (measured 2x slower)
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def small_methods(spark: SparkSession) -> None:
    """Where the session leaves ``spark.sql.codegen.hugeMethodLimit`` at Spark's default, it becomes that of ``RECOMMENDED_CONF``: a larger generated
    method is never compiled by HotSpot. The setting stays with the session; a value of the user's own is kept."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == "65535":
        spark.conf.set(name, RECOMMENDED_CONF[name])


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "riskspark", memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names shared storage and is only read. A private folder is
    created only when it is unset (local tests)."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder (a machine-local folder cannot survive executor loss)")
        d = tempfile.mkdtemp(prefix="riskspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server reads spark.checkpoint.dir itself
        return d
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def materialized(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """``df`` written once as Parquet under the shared folder, and read back; with ``by`` in a folder a value of that column, so that a filter on it
    reads its own files only (the column comes last then)."""
    path = checkpoint_path(df.sparkSession, f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for a written intermediate table."""
    return os.path.join(ensure_checkpoint_dir(spark), name)
