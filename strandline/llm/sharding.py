"""Sharding by rendezvous hashing of stable record keys over weighted shards, in DataFrame operations only.

Every (key, shard) pair has a score -weight / ln(u), u uniform from a hash of both; the record goes to its best shard. A further
shard changes no score of the others, so it only takes rows into itself, in proportion to its weight.

Slots number the rows of a shard from 0 without gaps. A shard may hold any number of rows, so they are numbered in ``buckets``
buckets by another hash of the key; bucket counts give each bucket's first slot.

Defined cases: a null text has no bytes (size 8) and crc32 0; rows with a null key share one hash and thus one shard, in buckets
by their text's hash; repeated rows get different slots; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settled, starts

#: Two to the power of 53, so that the hash becomes a double exactly.
STEPS = float(1 << 53)


def score(key: Column, shard: int, weight: float) -> Column:
    high = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double")
    return F.lit(-float(weight)) / F.log((high + F.lit(0.5)) / F.lit(STEPS))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (from 0) with the highest score; the smaller number on a tie."""
    best = F.greatest(*[F.struct(score(key, i, w).alias("s"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]) if len(weights) > 1 else F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i"))
    return (-best["i"]).cast("int")


def shard(docs: DataFrame, weights: Sequence[float], grown_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text", buckets: int = 1024) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard (its shard if one more shard joined)."""
    key = F.col(id_col)
    named = docs.select(
        key.alias(id_col),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8).alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, grown_weight]).alias("grown_shard"),
        F.pmod(F.when(key.isNull(), F.xxhash64(F.col(text_col))).otherwise(F.xxhash64(key, F.lit("slot"))), F.lit(buckets)).alias("_bucket"),
    )
    rows = settled(named)  # narrow, and read three times: the texts are read once
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each shard and bucket: as many as the parameters say, whatever the input
    first = starts(counts, ["shard"], "_bucket", "_n", "_first").select(F.col("shard").alias("_s"), F.col("_bucket").alias("_b"), "_first")
    order = Window.partitionBy("shard", "_bucket").orderBy(F.col(id_col).asc_nulls_last(), "text_crc32", "size")
    numbered = rows.withColumn("_rank", F.row_number().over(order))
    placed = numbered.join(first, (F.col("shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return placed.select(id_col, "size", "text_crc32", "law", "shard", (F.col("_first") + F.col("_rank") - 1).cast("long").alias("slot"), "grown_shard")
