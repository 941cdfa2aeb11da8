"""SimHash near-duplicates by anchor-point covering.

A text's fingerprint has 64 bits, each the majority of that bit in the hashes of its word n-grams. Fingerprints link if
they differ in DISTANCE bits at most; then they differ in one bit at most in one of their two halves. The words of a
code that covers 32 bits with radius 1 (a perfect Hamming code of 31 bits, times the bit left over) are the anchors of
each half: a fingerprint goes to every anchor within the radius plus one bit, that is 2 or 17 a half, and has its home at
the nearest. So two halves that differ in one bit at most meet at the home of either.

1. Equal fingerprints are one node.
2. Each anchor with homes names one of them, that of most documents; what comes to the anchor is compared with that one.
   As many comparisons as rows, whatever the size of the group; the links give first components.
3. What remains are fingerprints of different components at an anchor: homes meet what came there. Of an anchor's
   largest component only what meets another one is compared, so that groups of near copies don't meet pair by pair.

An anchor code for all 64 bits and three differing ones was not taken: the best products of perfect codes have some 3,500
anchors within radius plus threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import written
from gridspark.plans.components import connected_components

#: Most differing bits that link; a larger one would need a larger radius about the anchors.
DISTANCE = 3
SEED = 42
#: Hashes whose bits are counted at once; 64 bytes each.
COUNTED = 1 << 16
HALF, CODE = 32, 31


def hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of the space-joined word n-grams of a text, repeats included: A-Z in lower case, words split at U+0020 and
    U+0009-000D. With fewer words than size the whole sequence is one n-gram; without words there is none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    n = min(size, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first, last = np.append(0, ends)[: len(words) - n + 1].tolist(), (ends[n - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(first))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), COUNTED):
        part = np.ascontiguousarray(h[at : at + COUNTED].astype("<u8"))
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed number, of every document; 0 for a text without words or null."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [majority(hashes(text.as_py(), size)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(read, "doc_id long, fp long")


def _flip(place: Column) -> Column:
    """The bit of a place of the code, counted from 1."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place - 1).cast("int"))


def anchors(half: Column) -> Column:
    """The anchors of a half (a number below 2 ** 32) within two bits, the nearest one first.

    The exclusive or of the places of a word's bits, counted from 1, is 0 for words of the code; otherwise it is the
    place to flip for the nearest word, and places i < j whose exclusive or it is lead to those two bits away.
    """
    low = half.bitwiseAND(F.lit((1 << CODE) - 1).cast("long"))
    syndrome = F.lit(0)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, CODE + 1) if i >> k & 1)
        syndrome = syndrome + F.bit_count(low.bitwiseAND(F.lit(mask).cast("long"))) % 2 * F.lit(1 << k)

    def found(s: Column) -> Column:
        nearest = F.when(s == 0, half).otherwise(half.bitwiseXOR(_flip(F.greatest(s, F.lit(1)))))
        pairs = F.filter(F.sequence(F.lit(1), F.lit(CODE)), lambda i: i.bitwiseXOR(s) > i)
        far = F.transform(pairs, lambda i: half.bitwiseXOR(_flip(i)).bitwiseXOR(_flip(i.bitwiseXOR(s))))
        return F.concat(F.array(nearest, nearest.bitwiseXOR(F.lit(1 << CODE).cast("long"))), far)

    return F.element_at(F.transform(F.array(syndrome), found), 1)


def covered(nodes: DataFrame) -> DataFrame:
    """A row for each anchor of each fingerprint (fp, and other columns): anchor, and home, whether it is the nearest."""
    low = F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1).cast("long"))
    halves = F.array(F.struct(F.lit(0).cast("long").alias("side"), low.alias("half")), F.struct(F.lit(1 << HALF).cast("long").alias("side"), F.shiftrightunsigned("fp", HALF).alias("half")))
    sides = nodes.select("*", F.explode(halves).alias("_s"))
    rows = sides.select(*nodes.columns, "_s.side", F.posexplode(anchors(F.col("_s.half"))).alias("_n", "_anchor"))
    return rows.select(*nodes.columns, (F.col("side") + F.col("_anchor")).alias("anchor"), (F.col("_n") == 0).alias("home"))


def _near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def _joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that shuffles both tables. Spark takes a fingerprint's anchors for one row, and written tables for no larger
    than their files, and would send tables that grow with the input through the driver."""
    return left.join(right.hint("merge"), on, how)


def fingerprint_components(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, label) of distinct fingerprints nodes (fp, n): label is the smallest one that links reach. n says how many
    documents have the fingerprint."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"distance must be from 0 to {DISTANCE}: {distance}")
    homes = written(covered(nodes).filter("home").select("anchor", "fp", "n"), "homes")
    named = homes.groupBy("anchor").agg(F.max_by("fp", F.struct("n", "fp")).alias("named"), F.count(F.lit(1)).alias("homes"))
    came = _joined(covered(nodes).select("anchor", "fp"), named, "anchor").filter("homes > 1 or fp <> named")
    came = written(came.select("anchor", "fp", "named"), "came")
    near = came.filter((F.col("fp") != F.col("named")) & _near("fp", "named", distance))
    links = written(near.select(F.least("fp", "named").alias("a"), F.greatest("fp", "named").alias("b")).distinct(), "links")
    first = connected_components(links, written, _joined)

    def labelled(rows: DataFrame) -> DataFrame:
        return _joined(rows, first.select(F.col("node").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))

    came = written(labelled(came.select("anchor", "fp")), "labelled")
    sizes = came.groupBy("anchor", "label").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("anchor").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    main = written(main, "main")
    came = _joined(came, main, "anchor").select("anchor", "fp", "label", (F.col("label") == F.col("main")).alias("in_main"))
    home = _joined(labelled(homes.select("anchor", "fp")), main, "anchor").select("anchor", F.col("fp").alias("b"), F.col("label").alias("b_label"), (F.col("label") == F.col("main")).alias("b_main"))
    came, home = written(came, "came"), written(home, "home")
    across = _joined(came, home.filter("not b_main"), "anchor").unionByName(_joined(came.filter("not in_main"), home.filter("b_main"), "anchor"))
    across = across.filter((F.col("label") != F.col("b_label")) & _near("fp", "b", distance))
    more = written(across.select(F.least("label", "b_label").alias("a"), F.greatest("label", "b_label").alias("b")).distinct(), "more")
    tops = connected_components(more, written, _joined).select(F.col("node").alias("label"), F.col("label").alias("top"))
    return _joined(labelled(nodes.select("fp")), tops, "label", "left").select("fp", F.coalesce("top", "label").alias("label"))


def near_duplicates(documents: DataFrame, size: int = 3, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of all documents; component_id is the smallest doc_id
    reachable by links, itself included.

    Fingerprints of texts link if they differ in distance bits at most. Null, empty and blank texts have the fingerprint
    0, which links as any other. Rows may share a doc_id: each has its own row in the result, and links by its text
    alone. A null doc_id stays null and names no component; a component of such rows alone has a null component_id. No
    documents give no rows. Other columns are ignored, whatever their names.
    """
    rows = written(fingerprints(documents, size), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")), "nodes")
    labels = written(_joined(nodes, fingerprint_components(nodes.select("fp", "n"), distance), "fp"), "labels")
    names = written(labels.groupBy("label").agg(F.min("low").alias("component_id")), "names")
    named = _joined(labels, names, "label").select("fp", "component_id")
    return _joined(rows, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
