"""Context-triggered piecewise hashing: fingerprints whose likeness is an edit distance of chunk signatures.

A rolling hash of the last seven bytes ends a chunk where it meets the block size; each chunk gives one of 64 letters.
The block size grows with the text so that about 32 to 64 chunks arise; a second signature uses twice the block size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import written

#: Fixed values of the method: window, least block size, letters of a signature.
WINDOW, LEAST_BLOCK, LENGTH = 7, 3, 64
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: A run of this many letters, or half of a shorter signature, must be common to two before they count as alike.
COMMON = 7


def rolling(data: bytes) -> np.ndarray:
    """At each byte: sum, weighted sum and shifted exclusive or of the last seven bytes, added in 32 bits."""
    x = np.zeros(len(data) + WINDOW - 1, np.uint32)
    x[WINDOW - 1 :] = np.frombuffer(data, np.uint8)
    n = len(data)
    total, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for k in range(WINDOW):
        part = x[WINDOW - 1 - k : WINDOW - 1 - k + n]
        total += part * np.uint32(WINDOW - k + 1)
        mixed ^= part << np.uint32(5 * k)
    return total + mixed


def signature(data: bytes, ends: np.ndarray, length: int) -> str:
    """A letter for each chunk; what follows the last possible end is one chunk."""
    cuts = [0, *(ends[: length - 1] + 1).tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    return "".join([LETTERS[zlib.crc32(data[a:b]) & 63] for a, b in zip(cuts, cuts[1:])])


def fingerprint(data: bytes) -> str:
    """block size : signature : signature at twice the block size. Equal bytes have equal fingerprints."""
    block = LEAST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    hashes = rolling(data)
    while True:
        ends = np.flatnonzero(hashes % np.uint32(block) == block - 1)
        if block == LEAST_BLOCK or len(ends) >= LENGTH // 2 - 1:
            break
        block //= 2
    wide = ends[hashes[ends] % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{signature(data, ends, LENGTH)}:{signature(data, wide, LENGTH // 2)}"


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each letter of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = rest = (1 << len(a)) - 1
    for c in b:
        hit = rest & places.get(c, 0)
        rest = (rest + hit | rest - hit) & full
    return len(a) - rest.bit_count()


def signature_likeness(a: str, b: str) -> float:
    """1 - distance / (len(a) + len(b)); the distance has inserts and deletes at 1, changes at 2."""
    if a == b:
        return 1.0 if a else 0.0
    run = min(COMMON, (len(a) + 1) // 2, (len(b) + 1) // 2)
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not run or not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    return 2 * common_letters(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1, of two fingerprints: the best of their signatures at a common block size, 0 if there is none."""
    if a == b:
        return 1.0
    (n, a1, a2), (m, b1, b2) = a.split(":"), b.split(":")
    p, q = int(n), int(m)
    if p == q:
        return max(signature_likeness(a1, b1), signature_likeness(a2, b2))
    if p == 2 * q:
        return signature_likeness(a1, b2)
    if q == 2 * p:
        return signature_likeness(a2, b1)
    return 0.0


FIELDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
EDGE = {"part": pa.int32(), "first": pa.bool_(), "last": pa.bool_(), "text": pa.string()}


def _finished(doc_id, text: str, mark: str, after: str, after_mark: str) -> dict:
    n = len(text)
    edited = (text[: n - n // 3] + after[: n // 3]).encode()
    other = fingerprint(edited)
    return {"doc_id": doc_id, "n_chars": n, "edited_sha256": hashlib.sha256(edited).hexdigest(), "fingerprint": mark, "edited_fingerprint": other, "near_edited": likeness(mark, other), "near_next": likeness(mark, after_mark)}


def _batch(rows: list[dict], fields: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in fields.items()], names=list(fields))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams one sorted partition; its first row is also kept as an edge, its last row only as one."""
    part, fields = TaskContext.get().partitionId(), FIELDS | EDGE
    made: list[dict] = []
    before, first = None, True
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                text = text or ""
                mark = fingerprint(text.encode())
                if before is not None:
                    made.append(_finished(*before, text, mark))
                if first:
                    made.append({"fingerprint": mark, "part": part, "first": True, "last": False, "text": text})
                before, first = (doc_id, text, mark), False
            if len(made) >= 256:
                yield _batch(made, fields)
                made = []
    if before is not None:
        made.append({"doc_id": before[0], "fingerprint": before[2], "part": part, "first": False, "last": True, "text": before[1]})
        yield _batch(made, fields)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _batch([_finished(r["doc_id"], r["text"], r["fingerprint"], r["after"], r["after_mark"]) for r in batch.to_pylist()], FIELDS)


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and the likeness to those and to the next document's.

    Documents are sorted by descending doc_id (nulls last, then by text hash) in one range shuffle; each partition is
    streamed, and the edges between partitions, two rows each, are joined afterwards. Null text counts as empty: its
    fingerprint is '3::'. A single document is its own next one; an empty table stays empty.
    """
    spark = documents.sparkSession
    order = [F.col("doc_id").desc_nulls_last(), F.col("_tie")]
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = written(rows.mapInArrow(_neighbours, f"{SCHEMA}, part int, first boolean, last boolean, text string"), "fingerprints")
    parts = sorted(r.part for r in made.filter("first").select("part").collect())  # one number per partition
    following = spark.createDataFrame([(p, q) for p, q in zip(parts, parts[1:] + parts[:1])], "part int, following int")
    firsts = made.filter("first").select(F.col("part").alias("following"), F.col("text").alias("after"), F.col("fingerprint").alias("after_mark"))
    edges = made.filter("last").select("doc_id", "text", "fingerprint", "part").join(following, "part").join(firsts, "following")
    edges = edges.select("doc_id", "text", "fingerprint", "after", "after_mark").mapInArrow(_joined, SCHEMA)
    return made.filter("part is null").select(*FIELDS).unionByName(edges)
