"""Language identification by multilingual mixture inference.

Training counts hashed byte trigrams of every labelled document per language. A document is a mixture: expectation
maximisation finds the language proportions under which its trigrams are likeliest, languages leave the set as long
as the penalised likelihood gains, and the largest remaining proportion names the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a trigram's bucket; the model has 2 ** BITS numbers per language.
BITS = 15
SMOOTH = 0.5
ROUNDS = 12
#: Trigrams overlap, so that a document's log-likelihood counts as a third.
OVERLAP = 3.0
UNKNOWN = "und"
_PLAIN = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256))


def trigram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the text's lower-cased byte trigrams; what isn't a letter in ASCII separates words."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split()) + b" "
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0)
    h = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    counts = np.bincount(h, minlength=0)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(float)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            piece = batch.slice(at, 256)
            for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                at_, n = trigram_counts(text or "")
                sums.setdefault(lang, np.zeros(1 << BITS))[at_] += n
    for lang, all_ in sums.items():
        found = np.flatnonzero(all_)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found.astype(np.int32)), pa.array(all_[found].astype(np.int64))], names=["lang", "bucket", "n"])


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, trigram probabilities (language, bucket) and each language's share of the trigrams.

    All rows count; null languages and texts are left out. The result has 2 ** BITS numbers per language.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang is not null and text is not null")
    sums = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toPandas()
    names = sorted(got["lang"].unique())
    counts = np.zeros((len(names), 1 << BITS))
    counts[got["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(int), got["bucket"].to_numpy(int)] = got["n"]
    totals = counts.sum(axis=1)
    shares = totals / max(totals.sum(), 1)
    return names, (counts + SMOOTH) / (totals + SMOOTH * (1 << BITS))[:, None], shares


def _maximise(p: np.ndarray, n: np.ndarray, prior: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    mix, total = start, n.sum() + prior.sum()
    for _ in range(rounds):
        mix = (mix * (p @ (n / (mix @ p))) + prior) / total
    return mix, float(n @ np.log(mix @ p))


def infer(p: np.ndarray, n: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Proportions of all languages (0 for those outside the chosen set) for trigram counts n with columns p."""
    alive = np.arange(len(shares))
    prior = np.maximum(shares, 1e-6)
    mix, best = _maximise(p, n, prior, np.full(len(alive), 1 / len(alive)), ROUNDS)
    cost = 0.5 * np.log(max(n.sum(), 2.0))
    while len(alive) > 1:
        keep = np.delete(np.arange(len(alive)), mix.argmin())
        q = p[keep]
        less, likely = _maximise(q, n, prior[alive[keep]], mix[keep] / mix[keep].sum(), ROUNDS // 2) if len(keep) > 1 else (np.ones(1), float(n @ np.log(q[0])))
        if likely / OVERLAP + cost < best / OVERLAP:
            break
        alive, p, mix, best = alive[keep], q, less, likely
    out = np.zeros(len(shares))
    out[alive] = mix / mix.sum()
    return out


def predict(documents: DataFrame, names: list[str], probabilities: np.ndarray, shares: np.ndarray, keep: list[Column]) -> DataFrame:
    """The columns keep, lang_pred, score (the proportion of lang_pred) and languages (all chosen, with proportions).

    lang_pred is 'und' with score 0 where the text is null or has no letter, and where no language was learned.
    """
    model = documents.sparkSession.sparkContext.broadcast((names, probabilities, shares))  # languages * 2 ** BITS doubles
    rows = documents.select(F.struct(*keep).alias("kept"), F.col("text"))
    schema = "kept " + rows.schema["kept"].dataType.simpleString() + ", lang_pred string, score double, languages map<string,double>"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, probabilities, shares = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                made = []
                for text in piece.column(1).to_pylist():
                    if not names or not text or not any(map(str.isalpha, text)):
                        made.append((UNKNOWN, 0.0, []))
                        continue
                    found, n = trigram_counts(text)
                    mix = infer(probabilities[:, found], n, shares) if len(found) else shares
                    best = int(mix.argmax())
                    made.append((names[best], float(min(mix[best], 1.0)), [(names[i], float(mix[i])) for i in np.flatnonzero(mix)]))
                pred, score, langs = zip(*made, strict=True) if made else ((), (), ())
                arrays = [piece.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(langs, pa.map_(pa.string(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["kept", "lang_pred", "score", "languages"])

    return rows.mapInArrow(apply, schema).select("kept.*", "lang_pred", "score", "languages")


def identify_documents(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and languages of all documents.

    Learned from the documents whose crc32(doc_id as text) mod 4 is not 2; a null doc_id is not held out.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    names, probabilities, shares = fit(documents.filter(~held_out))
    return predict(documents, names, probabilities, shares, [F.col("doc_id"), held_out.alias("held_out")])
