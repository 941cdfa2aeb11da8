"""Phrase collocation mining: counts of word n-grams from suffix arrays of shards, then scores of their cuts.

1. A task reads its texts in shards of SHARD_WORDS words. Words get the shard's own ids; the pieces of all its texts of a
   language stand one after another, a mark between them. NumPy prefix doubling sorts the suffixes by their first words,
   and maximal intervals of the suffix array whose neighbours share n words (their LCP) are the n-grams of the shard, their
   lengths the counts. Nothing beyond a shard is held. A shard's phrases leave it packed by bucket, a hash of the words.
2. Spark brings the packs of a bucket together, whose counts are added by phrase. Parts of a candidate occur as often as it
   does, so that only n-grams with the least count are kept: what the joins of the next step read.
3. Candidates are joined with the counts of the two parts of each cut, scored in exact decimals, dropped if a longer
   candidate explains them, and ranked within each language: first in parts, then the best of the parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import written

#: Words of a shard, about: a text is never cut, so that a longer one makes a longer shard.
SHARD_WORDS = 1 << 20
#: Parts in which the candidates of a language are ranked first.
PARTS = 64
#: Characters that end a piece, as a regular expression. Words are what blanks and tabs leave of a piece.
ENDS = r"[.,;:!?\x0A-\x0D]"
#: Text, in bytes, whose phrases share a bucket, about.
BUCKET_BYTES = 4 << 20
PACKED = ["bucket", "lang", "n", "phrases", "counts"]
#: Stands between packed phrases; as white space that ends pieces it can't be in one.
BREAK = "\n"
#: Stands between pieces; as an end of pieces it can't be a word.
MARK = "."


def suffix_array(ids: np.ndarray, words: int) -> np.ndarray:
    """Places of ids in the order of the ids from there on, of which the first `words` count at least."""
    rank, reach = ids.astype(np.int64), 1
    while reach < words:
        after = np.zeros_like(rank)
        after[:-reach] = rank[reach:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.cumsum(np.append(False, key[order][1:] != key[order][:-1]))
        rank, reach = np.empty_like(rank), 2 * reach
        rank[order] = new
    return np.argsort(rank, kind="stable")


def common_prefixes(ids: np.ndarray, order: np.ndarray, mark: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a suffix array how many words before a mark its suffix begins with, and how many of these it
    shares with the suffix before; `words` at most."""
    padded = np.append(ids, np.full(words, mark, ids.dtype))
    length, shared = np.zeros(len(order), np.int8), np.zeros(len(order), np.int8)
    for k in range(words):
        here = padded[order + k]
        length += (here != mark) & (length == k)
        shared[1:] += (here[1:] != mark) & (here[1:] == here[:-1]) & (shared[1:] == k)
    return length, shared


def ngram_counts(ids: np.ndarray, mark: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n from 1 to longest the distinct n-grams of ids between marks, a row for each, and their counts."""
    order = suffix_array(ids, longest)
    length, shared = common_prefixes(ids, order, mark, longest)
    for n in range(1, longest + 1):
        held = length >= n
        at, heads = order[held], np.flatnonzero(shared[held] < n)
        counts = np.diff(np.append(heads, len(at)))
        yield ids[at[heads][:, None] + np.arange(n)], counts


def _hashes(names: pa.Array, grams: np.ndarray) -> np.ndarray:
    """A hash of each row of word ids that depends on the words alone."""
    of_words = np.fromiter((xxhash.xxh3_64_intdigest(w.as_buffer()) for w in names), np.uint64, len(names))
    out = np.full(len(grams), grams.shape[1], np.uint64)
    for k in range(grams.shape[1]):
        out = out * np.uint64(0x9E3779B97F4A7C15) + of_words[grams[:, k]]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _shard(texts: pa.Array, lang: str, longest: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The phrases of the texts of one shard and language with their counts, packed by bucket and length."""
    lower = pc.ascii_lower(texts.cast(pa.large_string()))
    marked = pc.replace_substring_regex(lower, pattern=ENDS, replacement=f" {MARK} ")
    ended = pc.binary_join_element_wise(marked, pa.scalar(MARK, pa.large_string()), pa.scalar(" ", pa.large_string()))
    tokens = pc.list_flatten(pc.ascii_split_whitespace(ended))  # blanks and tabs: the other white space ends pieces
    words = tokens.filter(pc.not_equal(tokens, "")).dictionary_encode()
    ids, names = words.indices.to_numpy(), words.dictionary
    mark = pc.index(names, pa.scalar(MARK, pa.large_string())).as_py()
    pack = zstandard.ZstdCompressor(level=1).compress
    for grams, counts in ngram_counts(ids, mark, longest):
        if not len(grams):
            continue
        bucket = (_hashes(names, grams) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, grams, counts = bucket[order], grams[order], counts[order].astype("<i8")
        columns = [names.take(pa.array(grams[:, k])) for k in range(grams.shape[1])]
        phrases = columns[0] if len(columns) == 1 else pc.binary_join_element_wise(*columns, pa.scalar(" ", names.type))
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        ends = np.append(starts[1:], len(bucket))
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(np.append(starts, len(bucket))), phrases), pa.scalar(BREAK, names.type))
        packed = [pa.array([pack(memoryview(j.as_buffer())) for j in joined], pa.binary()), pa.array([pack(counts[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.binary())]
        rows = len(starts)
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int64)), pa.repeat(lang, rows), pa.repeat(pa.scalar(grams.shape[1], pa.int32()), rows), *packed], names=PACKED)


def packed_counts(documents: DataFrame, longest: int, buckets: int) -> DataFrame:
    """How often each phrase of up to longest words occurs within pieces, by shards, whose counts are yet to be added: rows
    of bucket, lang (und where it is null), n, and compressed phrases and counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            blanks = pc.add(pc.count_substring(batch.column(1), " "), 1)
            at = np.append(0, np.cumsum(blanks.to_numpy()))
            start = 0
            while start < batch.num_rows:  # pieces of batches that fill the shard
                stop = max(start + 1, int(np.searchsorted(at, at[start] + SHARD_WORDS - size, "right")) - 1)
                held.append(batch.slice(start, stop - start))
                size += int(at[stop] - at[start])
                start = stop
                if size >= SHARD_WORDS or start < batch.num_rows:
                    yield from counted(held)
                    held, size = [], 0
        if held:
            yield from counted(held)

    def counted(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        for lang in pc.unique(table.column(0)):
            yield from _shard(table.filter(pc.equal(table.column(0), lang)).column(1).combine_chunks(), lang, longest, buckets)

    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(count, "bucket long, lang string, n int, phrases binary, counts binary")


def frequent_phrases(documents: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, n, phrase, f) of the phrases that occur least times or more; a row with a null phrase has the sum of the
    other words of a language in a bucket. Phrases are dealt by hash to buckets of BUCKET_BYTES of text each, about; a
    phrase comes once from each shard at most, so that no bucket is hot."""
    size = documents.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("size")).first().size or 0

    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        unpack, out = zstandard.ZstdDecompressor().decompress, []
        for (lang, n), part in _by_phrase_kind(rows):
            joined = BREAK.encode().join(unpack(memoryview(p.as_buffer())) for p in part.column("phrases"))
            phrases = pc.list_flatten(pc.split_pattern(pa.array([joined], pa.large_binary()).cast(pa.large_string()), BREAK))
            counts = np.frombuffer(b"".join(unpack(memoryview(c.as_buffer())) for c in part.column("counts")), "<i8")
            sums = pa.table({"phrase": phrases, "f": counts}).group_by("phrase").aggregate([("f", "sum")])
            kept = sums.filter(pc.greater_equal(sums.column("f_sum"), least))
            rest = pc.sum(sums.column("f_sum")).as_py() - (pc.sum(kept.column("f_sum")).as_py() or 0)
            names, f = kept.column("phrase").cast(pa.string()).combine_chunks(), kept.column("f_sum").combine_chunks()
            if n == 1 and rest:
                names, f = pa.concat_arrays([names, pa.array([None], pa.string())]), pa.concat_arrays([f, pa.array([rest], pa.int64())])
            out.append(pa.table({"lang": pa.repeat(lang, len(f)), "n": pa.repeat(pa.scalar(n, pa.int32()), len(f)), "phrase": names, "f": f}))
        return pa.concat_tables(out)

    packed = packed_counts(documents, longest, max(1, -(-size // BUCKET_BYTES)))
    return packed.groupBy("bucket").applyInArrow(add, "lang string, n int, phrase string, f long")


def _by_phrase_kind(rows: pa.Table) -> Iterator[tuple[tuple[str, int], pa.Table]]:
    """The rows of each language and length."""
    for kind in rows.group_by(["lang", "n"]).aggregate([]).to_pylist():
        here = pc.and_(pc.equal(rows.column("lang"), kind["lang"]), pc.equal(rows.column("n"), kind["n"]))
        yield (kind["lang"], kind["n"]), rows.filter(here)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole decimals, exact for counts below 10 ** 16."""
    exact = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", exact(a) * exact(a) * F.lit(1_000_000).cast("decimal(7,0)"), exact(left) * exact(right)).cast("long")


def candidate_scores(grams: DataFrame, longest: int, percent: int) -> DataFrame:
    """(lang, n, phrase, a, l, r, score) of the phrases of 2 words and more in grams (lang, n, phrase, f) that no longer
    one explains: none that contains them and occurs in percent of their places."""
    word = F.split("phrase", " ")
    part = lambda start, size: F.concat_ws(" ", F.slice(word, start, size))
    candidates = grams.filter("n > 1").withColumnRenamed("f", "a")
    cuts = []
    for n in range(2, longest + 1):
        for k in range(1, n):
            cuts.append(candidates.filter(F.col("n") == n).select("lang", "n", "phrase", "a", F.lit(k).alias("k"), part(1, k).alias("left"), part(k + 1, n - k).alias("right")))
    cuts = reduce(DataFrame.unionByName, cuts)
    counts = lambda side, f: grams.select("lang", F.col("phrase").alias(side), F.col("f").alias(f))
    scored = cuts.join(counts("left", "l"), ["lang", "left"]).join(counts("right", "r"), ["lang", "right"])
    scored = scored.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    lowest = scored.groupBy("lang", "n", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    scored = lowest.select("lang", "n", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")
    inside = []
    for n in range(3, longest + 1):
        for m in range(2, n):
            for start in range(1, n - m + 2):
                inside.append(candidates.filter(F.col("n") == n).select("lang", part(start, m).alias("phrase"), F.col("a").alias("longer")))
    if not inside:
        return scored
    longer = reduce(DataFrame.unionByName, inside).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    explained = (F.lit(100).cast("decimal(3,0)") * F.col("longer").cast("decimal(19,0)")) >= F.lit(percent).cast("decimal(3,0)") * F.col("a").cast("decimal(19,0)")
    return scored.join(longer, ["lang", "phrase"], "left").filter(~F.coalesce(explained, F.lit(False))).drop("longer")


def collocations(documents: DataFrame, longest: int = 3, least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the top phrases of 2 to longest words of each language.

    a is how often the phrase occurs, least at least; l and r the counts of its parts at the cut of lowest score (ties:
    the shorter first part), score floor(1000000 * a * a / (l * r)), n the words of the language. Phrases inside a longer
    candidate with percent of their count are dropped. Ranks go by score and a, falling, then by phrase in the order of its
    UTF-8 bytes. Null and empty texts have no words, a null lang is und; repeated rows count as often as they occur. A
    language without candidates, and an empty table, give no rows. Other columns are ignored, whatever their names.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases need two words and one occurrence at least")
    grams = written(frequent_phrases(documents, longest, least), "grams")
    words = grams.filter("n = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    scored = candidate_scores(grams.filter("phrase is not null"), longest, percent)
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    in_parts = Window.partitionBy("lang", "_part").orderBy(*order)
    best = scored.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("_rank", F.row_number().over(in_parts)).filter(F.col("_rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)  # PARTS * top rows of a language
    return ranked.drop("n").join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
