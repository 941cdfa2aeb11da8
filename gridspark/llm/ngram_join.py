"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. Word n-grams become 64-bit hashes, a document the sorted set of them. N-grams are counted over all documents; the
   most frequent ones, whose counts are exact but for one in each stretch of COUNTED n-grams, come last in a set's order
   (count, hash).
2. Equal sets are one class, a node named by a digest; it takes part in the join once.
3. Two sets of at least the threshold share an n-gram of both prefixes. The prefix rows are dealt by ranges of (n-gram,
   length band, ...), and each row of a run (n-gram, length band) is a candidate with the run's first row: as many
   candidates as rows, whatever the size of the group. Verified, they give first components.
4. What remains are pairs of different components that share a prefix n-gram, are in neighbouring length bands and pass
   the length and positional filters: an equi-join, whose new pairs are verified too. Groups of near copies are one
   component by then, so that they don't meet pair by pair.
5. A suffix filter bounds each candidate's overlap from the sizes of both sets in ranges of the hash: a byte for
   about eight n-grams, so that few sets travel. What it leaves is verified once per pair by intersection.
Texts compare as sets of 64-bit hashes, sets by 64-bit digests: two different ones pass as equal with probability
2 ** -64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import small, written
from gridspark.plans.components import connected_components

#: Frequent n-grams whose counts are broadcast, at most: 16 bytes each. The bound touches the order alone, no result.
FREQUENT = 1 << 18
#: N-grams that a task counts at once; those that occur there once only are not passed on.
COUNTED = 1 << 20
#: Representatives whose ids are broadcast to fetch their texts; more of them are joined.
FETCH_ROWS = 500_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: The suffix filter has a range of the hash for so many n-grams of a set, in powers of two.
PER_RANGE = 8


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams: A-Z in lower case, words split at U+0020 and U+0009-000D.

    With fewer words than size the whole sequence is one n-gram; without words there is none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(size, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mixed(h * MULTIPLIER + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def overlap_needed(n: Column, m: Column, percent: int) -> Column:
    """Least intersection of sets of n and m with 100 * intersection >= percent * union."""
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _frequent(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent n-grams over all texts, FREQUENT at most, and in how many texts they are."""

    def repeated(sets: list[np.ndarray]) -> pa.RecordBatch:
        grams, n = np.unique(np.concatenate(sets), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(grams[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = [], 0
        for piece in _pieces(batches):
            sets += [shingles(t, size) for t in piece.column(0).to_pylist()]
            held += sum(map(len, sets[-piece.num_rows :]))
            if held >= COUNTED:
                yield repeated(sets)
                sets, held = [], 0
        if sets:
            yield repeated(sets)

    counts = written(texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    level = F.floor(F.log2("n") * 16).cast("int")
    levels = counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()  # 16 to a doubling: under 1,000 rows
    least, held = None, 0
    for r in levels:
        held += r["count"]
        if held > FREQUENT:
            break
        least = r.level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = counts.filter(level >= least).select("gram", "n").toArrow()
    grams, n = got.column("gram").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def rare_first(s: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sorted set s in the order (count, hash); n-grams that aren't among the frequent ones count 0."""
    if not len(grams):
        return s
    at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
    return s[np.argsort(np.where(grams[at] == s, counts[at], 0), kind="stable")]


def range_sizes(s: np.ndarray) -> bytes:
    """Sizes of a sorted set in 2 ** k equal ranges of the hash, a byte each; none if a size exceeds a byte."""
    bits = max(0, (len(s) // PER_RANGE).bit_length() - 1)
    if not bits:
        return bytes([len(s)])
    sizes = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return sizes.astype(np.uint8).tobytes() if sizes.max() < 256 else b""


def overlap_bound(x: np.ndarray, y: np.ndarray) -> int:
    """Most n-grams that sets of these range sizes can share."""
    x, y = x.astype(np.int64), y.astype(np.int64)
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(n, -1).sum(axis=1), y.reshape(n, -1).sum(axis=1)).sum())


def needed(n: int, m: int, percent: int) -> int:
    return -(-(n + m) * percent // (100 + percent))


def _profiles(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, id and copy of rows, the set's size n and digest node, its range sizes, and the prefix, rare first."""
    frequent = rows.sparkSession.sparkContext.broadcast(_frequent(rows.select("text"), size))  # FREQUENT rows at most

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            n, node, ranges, prefixes = [], [], [], []
            for text in piece.column(3).to_pylist():
                s = shingles(text, size)
                n.append(len(s))
                node.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                ranges.append(range_sizes(s))
                prefixes.append(rare_first(s, *frequent.value)[: prefix_length(len(s), percent)].view(np.int64) if len(s) else s.view(np.int64))
            arrays = [piece.column(0), piece.column(1), piece.column(2), pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(ranges, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "id", "copy", "n", "node", "ranges", "prefix"])

    return rows.mapInArrow(profile, "doc_id long, id long, copy long, n int, node long, ranges binary, prefix array<long>")


RUNS = {"gram": pa.int64(), "band": pa.int32(), "pos": pa.int32(), "n": pa.int32(), "node": pa.int64()}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives each row of rows sorted by gram and length band an anchor: the first row of its band, and for that one
    the first row of the gram's band before. A gram's very first row is its own anchor; grams of one row go, except for
    a partition's first and last one, which may go on in another partition."""
    carried, given = None, True  # the anchor of the last row so far, and whether it has been given out
    types = [*RUNS.values(), pa.int32(), pa.int32(), pa.int64()]
    names = [*RUNS, "a_pos", "a_n", "a_node"]
    for batch in batches:
        if not batch.num_rows:
            continue
        x = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(RUNS))]
        if carried is not None:
            x = [np.concatenate([[c], v]) for c, v in zip(carried, x, strict=True)]
        new_gram = np.append(True, x[0][1:] != x[0][:-1])
        new_band = new_gram | np.append(True, x[1][1:] != x[1][:-1])
        head = np.maximum.accumulate(np.where(new_band, np.arange(len(new_band)), 0))
        anchor = np.where(new_band & ~new_gram, np.append(0, head[:-1]), head)
        out = ~(new_gram & np.append(new_gram[1:], True))
        out[0] |= carried is None
        late = out[head[-1]] or (carried is not None and head[-1] == 0 and given)
        if carried is not None and given:
            out[0] = False
        carried, given = [v[head[-1]] for v in x], late
        rows = [v[out] for v in x] + [v[anchor[out]] for v in x[2:]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r), k) for r, k in zip(rows, types, strict=True)], names=names)
    if not given:
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([*carried, *carried[2:]], types, strict=True)], names=names)


def _suffix_filtered(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their range sizes don't rule out."""
    a, b = (classes.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("ranges").alias(f"r{c}")) for c in "ab")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches, 1024):
            good = []
            for n, m, x, y in zip(*(piece.column(i).to_pylist() for i in range(2, 6))):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                good.append(not len(x) or not len(y) or overlap_bound(x, y) >= needed(n, m, percent))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([piece.column(0).filter(mask), piece.column(1).filter(mask)], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ra", "rb").mapInArrow(keep, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union. One text of each class is read."""
    pairs = written(pairs, "candidates")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    nodes = written(nodes.join(classes.select("node", "id", "copy"), "node"), "wanted")
    wanted = texts.join(small(nodes, FETCH_ROWS), ["id", "copy"]).select("node", "text").dropDuplicates(["node"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([shingles(t, size).tobytes() for t in piece.column(1).to_pylist()], pa.binary())], names=["node", "grams"])

    grams = written(wanted.mapInArrow(sets, "node long, grams binary"), "grams")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            good = []
            for x, y in zip(piece.column(2), piece.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([piece.column(0).filter(keep), piece.column(1).filter(keep)], names=["a", "b"])

    a, b = grams.select(F.col("node").alias("a"), F.col("grams").alias("x")), grams.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    links = pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")
    return written(links.distinct(), "links")


def _linked(rows: DataFrame, size: int, percent: int, link_ids: bool) -> tuple[DataFrame, DataFrame]:
    """Written tables: the profiles of rows (doc_id, id, copy, text), and (node, label) of all sets with n-grams, where
    sets of a component share a label. With link_ids, sets of rows with equal ids link too."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    texts = rows.select("id", "copy", "text")
    profiles = written(_profiles(rows.select("doc_id", "id", "copy", "text"), size, percent), "profiles")
    full = profiles.filter("n > 0")
    one = F.min(F.struct("id", "copy")).alias("one")  # what else a class needs is the same in all its rows
    classes = full.groupBy("node").agg(one, *[F.first(c).alias(c) for c in ("n", "ranges", "prefix")])
    classes = written(classes.select("node", "one.*", "n", "ranges", "prefix"), "classes")
    band = F.floor(F.log("n") / F.lit(math.log(100 / percent) if percent < 100 else 1.0)).cast("int").alias("band")
    grams = classes.select(F.posexplode("prefix").alias("pos", "gram"), band, "n", "node").select("gram", "band", "pos", "n", "node")
    order = ["gram", "band", "pos", "n", "node"]
    dealt = grams.repartitionByRange(*order).sortWithinPartitions(*order)
    runs = written(dealt.mapInArrow(_runs, "gram long, band int, pos int, n int, node long, a_pos int, a_n int, a_node long"), "runs")
    # candidates with anchors, then first components
    fits = lambda n, pos, m, at: F.least(n - pos, m - at) >= overlap_needed(n, m, percent)
    near = runs.filter((F.col("node") != F.col("a_node")) & fits(F.col("n"), F.col("pos"), F.col("a_n"), F.col("a_pos")))
    tried = written(near.select(F.least("node", "a_node").alias("a"), F.greatest("node", "a_node").alias("b")).distinct(), "tried")
    links = _verified(_suffix_filtered(tried, classes, percent), classes, texts, size, percent)
    labels = connected_components(links, written)
    # the join proper: pairs across components that share a prefix n-gram, in the same length band or the next
    found = written(runs.select("gram", "band", "pos", "n", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    mixed = found.groupBy("gram").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    x = written(found.join(mixed.select("gram"), "gram", "left_semi"), "mixed")
    y = x.select("gram", F.col("band").alias("b_band"), *[F.col(c).alias(f"b_{c}") for c in ("pos", "n", "node", "label")], F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"))
    once = (F.col("b_band") != F.col("band")) | (F.col("node") < F.col("b_node"))
    across = x.join(y, ["gram", "band"]).filter(once & (F.col("label") != F.col("b_label")) & fits(F.col("n"), F.col("pos"), F.col("b_n"), F.col("b_pos")))
    pairs = across.select(F.least("node", "b_node").alias("a"), F.greatest("node", "b_node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = _verified(_suffix_filtered(pairs, classes, percent), classes, texts, size, percent)
    if link_ids:
        ids = full.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("high")).filter("a <> high").select("id", "a")
        more = written(more.unionByName(full.join(ids, "id").select("a", F.col("node").alias("b")).filter("a <> b").distinct()), "links")
    nodes = classes.select("node").join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))
    if not more.isEmpty():
        la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("_a")), labels.select(F.col("node").alias("b"), F.col("label").alias("_b"))
        merged = more.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).distinct()
        tops = connected_components(written(merged, "merged"), written).select(F.col("node").alias("label"), F.col("label").alias("top"))
        nodes = nodes.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return profiles, written(nodes, "nodes")


def _identified(documents: DataFrame, *more) -> DataFrame:
    """more, doc_id, id (doc_id, a hash of the text where it is null), copy (a hash of the text) and text."""
    copy = F.xxhash64("text")
    return documents.select(*more, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), copy).alias("id"), copy.alias("copy"), "text")


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of all documents; component_id is the smallest doc_id reachable by links.

    Two documents link when 100 * intersection >= percent * union of their n-gram sets. Null and wordless texts have
    no n-gram and link with nothing: their component is their own doc_id. Rows with words that share a doc_id count as
    linked, whatever their texts. A null doc_id is named by a hash of its text where its component has no other.
    """
    profiles, nodes = _linked(_identified(documents), size, percent, True)
    lows = profiles.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.min("id").alias("low_id"))
    lows = written(lows.join(nodes, "node"), "lows")
    names = lows.groupBy("label").agg(F.coalesce(F.min("low"), F.min("low_id")).alias("component_id"))
    found = lows.join(names, "label").select("node", "component_id")
    own = profiles.select("doc_id", "id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("node")).alias("node"))
    return own.join(found, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def distinct_documents(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of documents, with all its columns, of each group of texts that link: that with the smallest doc_id (null
    last), then text hash. Rows link by their texts alone, so that rows which share a doc_id stay if their texts differ;
    of rows with equal doc_id and text one stays. Wordless texts link with nothing but their copies."""
    profiles, nodes = _linked(_identified(documents), size, percent, False)
    labelled = profiles.withColumn("node", F.when(F.col("n") > 0, F.col("node"))).join(nodes, "node", "left")
    group = F.struct(F.col("label"), F.when(F.col("label").isNull(), F.struct("id", "copy")).alias("own"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "id", "copy")).alias("first")
    chosen = written(labelled.groupBy(group.alias("g")).agg(first).select("first.id", "first.copy", "first.unnamed"), "chosen")
    rows = _identified(documents, F.struct("*").alias("_doc")).withColumn("unnamed", F.col("doc_id").isNull())
    order = F.xxhash64(F.to_json("_doc") if "map<" in documents.schema.simpleString() else F.col("_doc"))  # maps have no hash
    rows = rows.groupBy("id", "copy", "unnamed").agg(F.min_by("_doc", order).alias("_doc"))
    return rows.join(chosen, ["id", "copy", "unnamed"], "left_semi").select("_doc.*")
