"""Rendezvous (highest random weight) hashing of record keys over weighted shards.

Every shard gets a score from the hash of (seed, key, shard) and its weight; the best score wins. A new shard
can only win records for itself, so growing from n to n + 1 shards moves about weight / total weight of them and
none between old shards. All expressions are Spark built-ins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import small, written

#: Parts of each shard within which slots are counted; bounds the table of offsets to shards * SLOT_PARTS rows.
SLOT_PARTS = 512
#: Bytes added to the UTF-8 size of each record, for its framing.
RECORD_OVERHEAD = 8


def shard_score(key: Column, shard: Column, weight: Column, seed: int) -> Column:
    """-weight / ln(u), u uniform in (0, 1) from 52 bits of the hash of key and shard."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), shard, key), 12).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
    return -weight / F.log(u)


def best_shard(key: Column, weights: Sequence[float], seed: int = 7) -> Column:
    """Struct (score, minus) of the winning shard; its number is -minus. Ties go to the lower shard."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    given = F.array(*[F.lit(float(w)) for w in weights])
    return F.array_max(
        F.transform(given, lambda w, i: F.struct(shard_score(key, i.cast("long"), w, seed).alias("score"), (-i).alias("minus")))
    )


def assign_shards(df: DataFrame, key: str, weights: Sequence[float], seed: int = 7, shard: str = "shard", grown: str | None = None, grown_weight: float = 1.0) -> DataFrame:
    """Adds the shard of each row (int) and, if asked for, the shard with one more shard of grown_weight.

    Rows with equal keys share a shard, null keys included. Empty input gives an empty output.
    """
    out = df.withColumn("_best", best_shard(F.col(key), weights, seed)).withColumn(shard, (-F.col("_best.minus")).cast("int"))
    if grown:
        n = len(weights)
        newer = shard_score(F.col(key), F.lit(n).cast("long"), F.lit(float(grown_weight)), seed)
        out = out.withColumn(grown, F.when(newer > F.col("_best.score"), F.lit(n)).otherwise(F.col(shard)).cast("int"))
    return out.drop("_best")


def number_slots(df: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", parts: int = SLOT_PARTS) -> DataFrame:
    """Numbers the rows of each shard from 0 without gaps.

    Rows are dealt to (shard, part) by a hash of the order columns; a small table of part sizes gives each part its
    offset and row_number() counts inside a part, so that no task holds a whole shard. df should be a written table.
    """
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = small(written(sizes.select(shard, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from")), "slot-offsets"))
    inside = Window.partitionBy(shard, "_part").orderBy(*order)
    return (
        dealt.join(offsets, [shard, "_part"])
        .withColumn(slot, (F.col("_from") + F.row_number().over(inside) - 1).cast("long"))
        .drop("_part", "_from")
    )


def shard_documents(documents: DataFrame, shards: int = 24, seed: int = 7) -> DataFrame:
    """doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard of all documents over equal weights.

    Null or empty text has size 8 and checksum 0. Null doc_ids share a shard; repeated rows keep a slot each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text).cast("long") + RECORD_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = written(assign_shards(rows, "doc_id", [1.0] * shards, seed, grown="grown_shard"), "sharded")
    return number_slots(rows, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
