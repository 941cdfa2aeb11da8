"""Toxicity: a factorization machine over hashed terms.

A document's terms are its lower-cased words and their beginnings, hashed and taken once. The score is a logistic
factorization machine: a weight per term plus an interaction of each pair by the product of two short vectors, so
that terms that are harmless alone can count together. It is fitted on a bounded sample of labelled documents. Terms
take part that tell labels apart alone, and words that do so in pairs: these are sought among all pairs of hashed slots.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import written

#: Bits of a hashed term.
BITS = 20
#: Labelled rows that are fitted at most, of each label, in order of a hash of doc_id: the bound of the sample.
TRAIN_TOXIC, TRAIN_CLEAN = 6_000, 10_000
#: Terms of LEAST_DOCS sampled documents at least take part if their own effect has LEAST_Z standard errors, or if they
#: are words in a pair of slots whose rate of toxic documents is LEAST_PAIR_Z standard errors above those of both slots. Copies of a text
#: count once in this.
LEAST_DOCS, LEAST_Z, LEAST_PAIR_Z = 4, 4.0, 8.0
#: Slots that words are hashed to when pairs are sought: 2 ** 12, 8 million pairs.
SLOT_BITS = 12
FACTORS, ROUNDS, RATE, DECAY = 4, 300, 0.05, 2e-5
#: Lengths of word beginnings that are terms of their own.
BEGINNINGS = (4, 5, 6)
MEMO_WORDS = 300_000
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


def word_terms(word: str) -> tuple[int, ...]:
    """Hashes of a word, trimmed of ASCII punctuation (odd), and of its beginnings (even)."""
    w = word.strip(_EDGES)
    if not w:
        return ()
    mask = (1 << BITS) - 2
    return (zlib.crc32(b"w" + w.encode("utf-8", "replace")) & mask | 1, *(zlib.crc32(b"%d" % k + w[:k].encode("utf-8", "replace")) & mask for k in BEGINNINGS if len(w) >= k))


def text_words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            made = [sorted({t for w in text_words(x) for t in word_terms(w)}) for x in piece.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1).cast(pa.int32()), pa.array(made, pa.list_(pa.int32()))], names=["key", "label", "terms"])


def _slot(term: np.ndarray) -> np.ndarray:
    return (term.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def _first_copies(rows: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
    """Of rows that share their three least word hashes, as most near copies do, the first: a mask of n rows."""
    hashed = words.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    least = np.zeros((n, 3), np.uint64)
    order = np.lexsort((hashed, rows))
    starts = np.searchsorted(rows[order], np.arange(n))
    ends = np.searchsorted(rows[order], np.arange(n), side="right")
    for k in range(3):
        there = starts + k < ends
        least[there, k] = hashed[order[starts[there] + k]]
    first = np.unique(least, axis=0, return_index=True)[1]
    return np.isin(np.arange(n), first)


def paired_slots(labels: np.ndarray, rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Slots in a pair that is toxic more often than either of its slots, of words (row, term). Rows without words don't
    count."""
    n, slots, step = len(labels), 1 << SLOT_BITS, 1024
    together = {k: np.zeros((slots, slots), np.float32) for k in (0, 1)}
    at = _slot(words).astype(np.int64)
    for k in (0, 1):
        chosen = np.flatnonzero(labels == k)
        place = np.full(n, -1)
        place[chosen] = np.arange(len(chosen))
        own = place[rows] >= 0
        r, c = place[rows[own]], at[own]
        order = np.argsort(r, kind="stable")
        r, c = r[order], c[order]
        for first in range(0, len(chosen), step):
            a, b = np.searchsorted(r, [first, first + step])
            x = np.zeros((step, slots), np.float32)
            x[r[a:b] - first, c[a:b]] = 1
            together[k] += x.T @ x
    both = together[0] + together[1]
    alone = np.diag(together[1]) / np.maximum(np.diag(both), 1)
    rate = np.clip(np.maximum(np.maximum(alone[:, None], alone[None, :]), labels.mean()), 1e-3, 1 - 1e-3)
    z = (together[1] - both * rate) / np.sqrt(np.maximum(both * rate * (1 - rate), 1))
    np.fill_diagonal(z, 0)
    return np.flatnonzero((z >= LEAST_PAIR_Z).any(axis=1))


def train(labels: np.ndarray, terms: list[np.ndarray], rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kept terms, their weights (the bias last) and vectors; rate is the share of toxic rows to calibrate to."""
    sizes = np.array([len(t) for t in terms])
    flat = np.concatenate([*terms, np.zeros(0, np.int32)]).astype(np.int64)
    row = np.repeat(np.arange(len(terms)), sizes)
    word = flat & 1 == 1
    once = _first_copies(row[word], flat[word], len(labels))
    counted = once[row]
    n = np.bincount(flat[counted], minlength=1 << BITS)
    pos = np.bincount(flat[counted], weights=labels[row[counted]], minlength=1 << BITS)
    p = labels[once].mean()
    z = np.abs(pos - n * p) / np.sqrt(np.maximum(n * p * (1 - p), 1e-9))
    often = n >= LEAST_DOCS
    word &= often[flat] & counted
    pairs = np.zeros(1 << SLOT_BITS, bool)
    pairs[paired_slots(labels, row[word], flat[word])] = True
    p, every = labels.mean(), np.arange(1 << BITS)
    kept = np.flatnonzero(often & ((z >= LEAST_Z) | ((every & 1 == 1) & pairs[_slot(every)])))
    place = np.full(1 << BITS, -1)
    place[kept] = np.arange(len(kept))
    inside = place[flat] >= 0
    row, at = row[inside], place[flat[inside]]
    share = np.where(labels == 1, rate / max(p, 1e-9), (1 - rate) / max(1 - p, 1e-9))
    share = share / share.mean()
    rng = np.random.default_rng(7)
    sums = lambda index, values, size: np.stack([np.bincount(index, v, minlength=size) for v in values.T], axis=1)
    params = [np.array([np.log(max(rate, 1e-6) / max(1 - rate, 1e-6))]), np.zeros((len(kept), 1)), rng.normal(0, 0.05, (len(kept), FACTORS))]
    first, second = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    for step in range(1, ROUNDS + 1):
        w0, w, v = params
        own = np.hstack([w, v, (v * v).sum(axis=1, keepdims=True)])[at]
        out = sums(row, own, len(labels))
        xv = out[:, 1:-1]
        margin = w0[0] + out[:, 0] + 0.5 * ((xv * xv).sum(axis=1) - out[:, -1])
        g = share * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels) / len(labels)
        back = sums(at, np.hstack([g[:, None], g[:, None] * xv])[row], len(kept))
        grads = [g.sum(keepdims=True), back[:, :1] + DECAY * w, back[:, 1:] - v * back[:, :1] + DECAY * v]
        for q, d, a, b in zip(params, grads, first, second, strict=True):
            a += 0.1 * (d - a)
            b += 0.001 * (d * d - b)
            q -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return kept, np.append(params[1][:, 0], params[0][0]), params[2]


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fits on the texts of TRAIN_TOXIC and TRAIN_CLEAN keys at most, in one task; the shares of labels count all keys.

    labels has one row per key. The keys are chosen first, so that texts travel for these alone; of several texts of a
    key the one with the smallest terms counts.
    """
    ids = documents.select(F.col(key).alias("key")).distinct()
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).filter("label in (0, 1)")
    known = written(known.join(ids, "key", "left_semi").withColumn("at", F.xxhash64("key")), "labelled")
    counts = {r.label: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = counts.get(1, 0) / max(sum(counts.values()), 1)
    both = [known.filter(F.col("label") == k).orderBy("at", "key").limit(n) for k, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    chosen = F.broadcast(both[0].unionByName(both[1]).select("key", "label"))  # TRAIN_TOXIC + TRAIN_CLEAN rows at most
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(chosen, "key").select("key", "label", "text")
    key_type = texts.schema["key"].dataType.simpleString()
    sample = texts.mapInArrow(_terms, f"key {key_type}, label int, terms array<int>").groupBy("key", "label").agg(F.min("terms").alias("terms"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key")
        kept, w, v = train(pdf["label"].to_numpy(float), [np.asarray(t, np.int32) for t in pdf["terms"]], rate)
        return pd.DataFrame({"kept": [kept.astype("<i8").tobytes()], "w": [w.astype("<f8").tobytes()], "v": [v.astype("<f8").tobytes()]})

    got = sample.groupBy().applyInPandas(run, "kept binary, w binary, v binary").collect()
    if not got:
        return np.zeros(0, int), np.zeros(1), np.zeros((0, FACTORS))
    return np.frombuffer(got[0].kept, "<i8"), np.frombuffer(got[0].w, "<f8"), np.frombuffer(got[0].v, "<f8").reshape(-1, FACTORS)


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], keep: list) -> DataFrame:
    """The columns keep, score (0 to 1) and predicted of all rows; texts without kept terms, null or empty ones
    included, get the bias alone."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS terms at most
    rows = documents.select(F.struct(*keep).alias("kept"), F.col("text"))
    schema = "kept " + rows.schema["kept"].dataType.simpleString() + ", score double, predicted int"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, w, v = sent.value
        place = {int(t): i for i, t in enumerate(kept)}
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                made = []
                for text in piece.column(1).to_pylist():
                    on: set[int] = set()
                    for word in text_words(text):
                        found = memo.get(word)
                        if found is None:
                            if len(memo) >= MEMO_WORDS:
                                memo.clear()
                            found = memo[word] = tuple(place[t] for t in word_terms(word) if t in place)
                        if found:
                            on.update(found)
                    margin = w[-1]
                    if on:
                        i = np.array(sorted(on))
                        s = v[i]
                        margin += w[i].sum() + 0.5 * ((s.sum(axis=0) ** 2).sum() - (s * s).sum())
                    made.append(1 / (1 + np.exp(-min(max(margin, -30), 30))))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(made, pa.float64()), pa.array([int(x >= 0.5) for x in made], pa.int32())], names=["kept", "score", "predicted"])

    return rows.mapInArrow(apply, schema).select("kept.*", "score", "predicted")


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents, learned from labels.toxic of those not held out.

    Rows whose crc32(doc_id as text) mod 5 is 0 are held out; a null doc_id isn't and has no label. Of several labels
    of a doc_id the highest counts. Null and empty texts score the bias; repeated rows score alike; an empty table gives
    an empty one; without labels every score is that of a rate near 0; other columns are ignored.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    known = labels.select("doc_id", "toxic").filter(~held_out & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    model = fit(documents, known)
    return score(documents, model, [F.col("doc_id"), held_out.alias("held_out")])
