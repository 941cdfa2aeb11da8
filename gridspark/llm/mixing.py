"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: the weights share all words; a target stops at `most` times its source's size and the excess is shared
   again by weight (one row per source: kept on the driver, it doesn't grow with the documents).
2. Seats: blocks of `block` words are seats; highest quotients target / (2 k + 1) hand them to sources, then each
   source's seats down a tree of its shards with FAN branches to a node, by size, so that no group grows with the data.
3. Selection: the documents of a shard lie in seeded order on a line cut into blocks. A quota of q seats over m blocks
   takes every block q // m times and, of the rest, the first q % m blocks of a seeded permutation once more.
4. Rows: the shares of documents that are taken in part are added up along the shard in order of size; a document gets
   one more copy where the sum passes a whole number. So the words of a shard's copies differ from those that it takes
   by less than its longest document.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import n_words, small, written

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 64
SEED = 20
#: A source is dealt into a shard for each SHARD_DOCS documents; a window lays out one shard.
SHARD_DOCS = 2_000
FAN = 64
#: A prime above any number of blocks in a shard, so that j -> (PRIME * j + shift) mod m permutes them.
PRIME = 2147483647
#: Shares of documents are whole numbers of 1 / UNIT, so that sums of them are exact.
UNIT = 2**32


def share_targets(sizes: Mapping[object, int], weights: Mapping[object, float], most: float = MOST) -> dict[object, float]:
    """Words per source: the weights' shares of all words, each at most `most` times the size, excess reshared."""
    left, free, out = float(sum(sizes.values())), set(sizes), {}
    while free:
        total = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / total > most * sizes[s]}
        if not over:
            out |= {s: left * weights[s] / total for s in free}
            break
        out |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        free -= over
    return out


def sainte_lague(votes: Sequence[float], seats: int, limits: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / 1, votes / 3, votes / 5, ..., none above its limit; ties to the first.

    A threshold on the quotient is bisected, so the work doesn't grow with the number of seats.
    """
    limits = [seats] * len(votes) if limits is None else list(limits)
    seats = min(seats, sum(n for v, n in zip(votes, limits, strict=True) if v > 0))

    def given(least: float) -> list[int]:
        return [min(n, int(v / least / 2 + 0.5)) if v > 0 else 0 for v, n in zip(votes, limits, strict=True)]

    low, high = 0.0, max(votes, default=0) * 2.0 + 1
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= low or mid >= high:
            break
        low, high = (mid, high) if sum(given(mid)) >= seats else (low, mid)
    out = given(high)
    open_ = [(-v / (2 * out[i] + 1), i) for i, v in enumerate(votes) if v > 0 and out[i] < limits[i]]
    for _ in range(seats - sum(out)):
        open_.sort()
        _, i = open_.pop(0)
        out[i] += 1
        if out[i] < limits[i]:
            open_.append((-votes[i] / (2 * out[i] + 1), i))
    return out


def _shard_quotas(shards: DataFrame, plan: DataFrame, most: int, levels: int) -> DataFrame:
    """(_s, _shard, _blocks, _quota) of all shards (_s, _shard, words, blocks): the seats of source _s in plan, handed down
    a tree in which node k of one level is the parent of FAN * k to FAN * k + FAN - 1 of the next."""

    def hand_down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        given = sainte_lague(pdf["words"].tolist(), int(pdf["quota"].iloc[0]), (pdf["blocks"] * most).tolist())
        return pdf[["_s", "node", "words", "blocks"]].assign(quota=given)

    above = plan.select("_s", F.lit(0).cast("long").alias("parent"), F.col("seats").alias("quota"))
    for level in range(levels - 1, -1, -1):
        node = F.expr(f"_shard div {FAN**level}L")
        own = shards.groupBy("_s", node.alias("node")).agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks"))
        own = own.withColumn("parent", F.expr(f"node div {FAN}L")).join(above, ["_s", "parent"])
        quotas = own.groupBy("_s", "parent").applyInPandas(hand_down, "_s int, node long, words long, blocks long, quota long")
        above = quotas.select("_s", F.col("node").alias("parent"), "quota")
    return quotas.select("_s", F.col("node").alias("_shard"), F.col("blocks").alias("_blocks"), F.col("quota").alias("_quota"))


def _taken(rows: DataFrame, weights, most, block, seed, shard_docs, spark) -> DataFrame:
    # the shard of a document: seeded hash; a source has so many shards that each lays out about shard_docs rows
    key = F.xxhash64(F.lit(seed), "doc_id", "size")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")).collect()
    names = sorted((r for r in sizes if r.source is not None), key=lambda r: r.source) + [r for r in sizes if r.source is None]
    by = {r.source: r.words for r in names}
    weigh = {r.source: weights[i % len(weights)] for i, r in enumerate(names)}
    target = share_targets(by, weigh, most)
    shards = {r.source: math.ceil(r.docs / shard_docs) for r in names}
    # seats of sources: as many as the whole holds blocks
    limits = [most * math.ceil(by[r.source] / block) for r in names]
    seats = sainte_lague([target[r.source] for r in names], round(sum(target.values()) / block), limits)
    plan = spark.createDataFrame(
        [(i, r.source, by[r.source], float(target[r.source]), shards[r.source], seats[i]) for i, r in enumerate(names)],
        "_s int, source string, source_size long, target double, shards long, seats long",
    )
    rows = rows.join(small(plan), rows["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    rows = rows.withColumn("_key", key).withColumn("_shard", F.pmod("_key", "shards"))
    parts = rows.groupBy("_s", "_shard").agg(F.sum("size").alias("words")).withColumn("blocks", F.ceil(F.col("words") / block))
    levels = max(1, math.ceil(math.log(max(shards.values(), default=1), FAN) - 1e-9))
    quotas = written(_shard_quotas(written(parts, "shards"), plan, most, levels), "quotas")
    line = Window.partitionBy("_s", "_shard").orderBy("_key", "doc_id", "size")
    laid = rows.withColumn("_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))).join(small(quotas), ["_s", "_shard"])
    first, last = F.col("_end") - F.col("size"), F.col("_end")
    passes, rest = F.expr("_quota div greatest(_blocks, 1L)"), F.expr("_quota % greatest(_blocks, 1L)")
    shift = F.pmod(F.xxhash64(F.lit(seed), "source", "_shard"), F.lit(PRIME))
    touched = F.sequence(F.floor(first / block), F.floor((last - 1) / block))
    within = lambda j: F.least(last, (j + 1) * block) - F.greatest(first, j * block)
    chosen = lambda j: F.pmod(j * PRIME + shift, F.col("_blocks")) < rest
    more = F.aggregate(touched, F.lit(0).cast("long"), lambda n, j: n + F.when(chosen(j), within(j)).otherwise(0))
    taken = F.when(F.col("size") > 0, passes * F.col("size") + more).otherwise(0).cast("long")
    return laid.withColumn("taken", taken).drop("_end", "_blocks", "_quota", "shards", "seats")


def mix_documents(documents: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes, repeats counted) of all documents.

    Sources by code point, null last, weigh `weights` in turn. Null or blank text has size 0 and taken 0; repeated
    rows count each, an empty table gives an empty one. Other columns are ignored.
    """
    slim = written(documents.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    out = _taken(slim, weights, most, block, seed, shard_docs, documents.sparkSession)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def repeat_documents(documents: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = SEED, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The mix itself: each row of documents taken / size times, rounded down or up so that each shard's words add up
    to those it takes, with all its columns, whatever those are called. Rows without words go; repeated rows count each;
    an empty table gives an empty one."""
    rows = documents.select(F.struct("*").alias("_doc"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = _taken(rows, weights, most, block, seed, shard_docs, documents.sparkSession).filter("taken > 0")
    whole, rest = F.expr("taken div size"), F.expr(f"taken % size * {UNIT}L div size")
    line = Window.partitionBy("_s", "_shard").orderBy("size", "_key", "doc_id", "taken").rowsBetween(Window.unboundedPreceding, 0)
    offset = F.pmod(F.xxhash64(F.lit(seed + 1), "source", "_shard"), F.lit(UNIT))
    passed = mixed.withColumn("_rest", rest).withColumn("_sum", F.sum("_rest").over(line) + offset)
    more = F.expr(f"_sum div {UNIT}L - (_sum - _rest) div {UNIT}L")
    copies = passed.withColumn("_copies", whole + more).filter("_copies > 0")
    return copies.select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_doc.*")
