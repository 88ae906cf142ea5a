"""Sharding by sampled splitters: near-equal bytes per shard, built-in DataFrame functions only.

Records are ordered by (hash of the text, id, copy), so records with equal texts stand side by side; ``copy`` is a
number stored with each record, which tells repeated rows and rows without an id apart.

1. A size-weighted sample of that order gives the quantile boundaries of many small ranges. A
   boundary inside a group of equal texts moves to the group's start; but where several boundaries
   fall into one group, they stay, and this overfull range is subdivided by id and copy. No range
   holds a hot group whole, not even one of rows that are equal in all columns.
2. Bytes and rows of each range are counted exactly, which gives each range its first byte and row.
3. Inside its range each record gets its own first byte and row. A record goes to the shard in which
   the middle byte of its group of equal texts lies. Records of subdivided groups, and of groups
   above ``GROUP_SHARE`` of a shard, go by their own middle byte, so sizes stay near equal.

The law is ``bytes``: a shard's size is off by at most about the largest group that is kept together.

Defined cases: NULL text has size 1 and crc32 0, and stands apart from the empty text's group; NULL and
repeated ids and repeated rows are separate records; very long texts weigh what they hold; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.llm.common import materialize

ROWS_PER_RANGE = 5_000
FEWEST_RANGES, MOST_RANGES = 64, 4_096
SAMPLE_PER_RANGE = 32  # expected sampled records behind each boundary
PREFIX_BITS = 12  # boundaries are looked up by the leading bits of the hash
GROUP_SHARE = 1 / 64  # of a shard: heavier groups of equal texts are split
NO_ID = -(1 << 63)


def sized_records(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, text_crc32, key, rank_id, copy): UTF-8 bytes plus one, checksum and hash of the text, and what orders its group."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.col(text_col).isNull()).alias("key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rank_id"),
        F.monotonically_increasing_id().alias("copy"),
    )


def sampled_splitters(records: DataFrame, ranges: int, total: int) -> DataFrame:
    """(key, rank_id, copy, inside): boundaries of about equal bytes; ``inside`` counts those of one key.

    The sample has about ``ranges * SAMPLE_PER_RANGE`` rows, bounded by the constants above, so that
    its windows may run in one task. The draw is a hash: a recomputed task draws the same records."""
    chance = F.col("size") * F.lit(ranges * SAMPLE_PER_RANGE / max(total, 1))
    draw = F.pmod(F.xxhash64("key", "rank_id", "copy", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = records.where(draw < chance).select("key", "rank_id", "copy", F.greatest(chance, F.lit(1.0)).alias("weight"))
    order = Window.partitionBy(F.lit(0)).orderBy("key", "rank_id", "copy")
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0))
    quantile = F.floor(upto * ranges / F.sum("weight").over(Window.partitionBy(F.lit(0))))
    passed = sample.withColumn("quantile", quantile).withColumn("was", F.lag("quantile", 1, 0).over(order))
    cuts = passed.where((F.col("quantile") > F.col("was")) & (F.col("quantile") < ranges))
    inside = cuts.groupBy("key").agg(F.count(F.lit(1)).alias("inside"), F.collect_list(F.struct("rank_id", "copy")).alias("ids"))
    # one boundary in a group: the group's start; several: where they are
    start = F.array(F.struct(F.lit(NO_ID).alias("rank_id"), F.lit(-1).cast("long").alias("copy")))
    at = F.explode(F.when(F.col("inside") > 1, F.col("ids")).otherwise(start))
    return inside.select("key", at.alias("at"), "inside").select("key", "at.rank_id", "at.copy", "inside")


def prefix(key: Column) -> Column:
    return F.shiftright(key, 64 - PREFIX_BITS)


def with_range(records: DataFrame, splitters: DataFrame) -> DataFrame:
    """Add ``range`` (number of boundaries at or before the record) and ``hot`` (its group is subdivided)."""
    spark = records.sparkSession
    half = 1 << (PREFIX_BITS - 1)
    boundary = F.struct("key", "rank_id", "copy", "inside")
    by_prefix = splitters.groupBy(prefix(F.col("key")).alias("prefix")).agg(F.collect_list(boundary).alias("cuts"))
    every = spark.range(-half, half).withColumnRenamed("id", "prefix").join(by_prefix, "prefix", "left")
    before = Window.partitionBy(F.lit(0)).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    none = F.array().cast("array<struct<key:bigint,rank_id:bigint,copy:bigint,inside:bigint>>")
    lookup = every.withColumn("cuts", F.coalesce("cuts", none)).withColumn("base", F.coalesce(F.sum(F.size("cuts")).over(before), F.lit(0)))
    # 2 ** PREFIX_BITS rows and at most MOST_RANGES boundaries in all: safe to broadcast
    found = records.withColumn("prefix", prefix(F.col("key"))).join(F.broadcast(lookup), "prefix")
    key, rank_id, copy = F.col("key"), F.col("rank_id"), F.col("copy")
    in_group = lambda c: (c["rank_id"] < rank_id) | ((c["rank_id"] == rank_id) & (c["copy"] <= copy))
    passed = F.filter("cuts", lambda c: (c["key"] < key) | ((c["key"] == key) & in_group(c)))
    hot = F.exists("cuts", lambda c: (c["key"] == key) & (c["inside"] > 1))
    return found.select(*records.columns, (F.col("base") + F.size(passed)).alias("range"), hot.alias("hot"))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", label: str = "shards") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard): every record's shard and place there."""
    records = materialize(sized_records(docs, id_col, text_col), f"{label}-records")
    whole = records.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    ranges = min(MOST_RANGES, max(FEWEST_RANGES, whole["rows"] // ROWS_PER_RANGE))
    ranged = with_range(records, sampled_splitters(records, ranges, whole["bytes"]))
    before = Window.partitionBy(F.lit(0)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    starts = starts.select("range", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"first_{c}") for c in ("bytes", "rows")))
    order = Window.partitionBy("range").orderBy("key", "rank_id", "copy")
    group = Window.partitionBy("range", "key")
    own = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.withColumn("own", own).withColumn("row", F.row_number().over(order) - 1)
    placed = placed.withColumn("group_bytes", F.sum("size").over(group)).withColumn("group_first", F.min("own").over(group))
    # at most MOST_RANGES + 1 rows: safe to broadcast
    placed = placed.join(F.broadcast(starts), "range")
    apart = F.col("hot") | (F.col("group_bytes") > F.lit(whole["bytes"] * GROUP_SHARE / shards))
    middle = F.col("first_bytes") + F.when(apart, F.col("own") + F.col("size") / 2).otherwise(F.col("group_first") + F.col("group_bytes") / 2)
    number = F.least(F.floor(middle * shards / F.lit(max(whole["bytes"], 1))), F.lit(shards - 1)).cast("int")
    dealt = placed.select("id", "size", "text_crc32", number.alias("shard"), (F.col("first_rows") + F.col("row")).alias("place"))
    dealt = materialize(dealt, f"{label}-dealt")
    first = dealt.groupBy("shard").agg(F.min("place").alias("first"))
    return dealt.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
