"""K-01: completion logs ingested as they arrive, parsed and rewarded (stateless), appended.

Structured Streaming: a JSON-lines folder source with an explicit schema, the same Column
expressions as the batch rewards, and an append sink with a checkpoint (exactly-once file sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rl as L
from ..sources.files import COMPLETION_LOG_SCHEMA


def reward_stream(spark: SparkSession, source_dir: str) -> DataFrame:
    """Streaming DataFrame of (completion, label, rewards...). Each log record holds parallel
    lists of completions and labels; they are zipped and exploded."""
    logs = spark.readStream.schema(COMPLETION_LOG_SCHEMA).json(source_dir)
    pairs = logs.select(F.explode(F.arrays_zip("completions", "label")).alias("p")).select(
        F.col("p.completions").alias("completion"), F.col("p.label").alias("label")
    )
    return L.with_rewards(
        pairs,
        {
            "r_format": L.reward_format("completion"),
            "r_accuracy": L.reward_accuracy("completion", "label"),
            "r_risk": L.reward_risk("completion", "label"),
        },
    )


def run_reward_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str, available_now: bool = True):
    """Start the stream into a parquet sink. ``available_now`` processes what is there and stops
    (tests, batch back-fills); otherwise it keeps running with a 10 s trigger."""
    q = reward_stream(spark, source_dir).writeStream.format("parquet").option("checkpointLocation", checkpoint_dir).outputMode("append")
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start(sink_dir)
