"""Queries that SQL can't express, against versions written out step by step."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import bpe, fingerprints, language, mixing, ngram_join, quality, sharding, toxicity
from tests.llm.test_pairs_and_shards import components, near_copies, word_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_documents(spark):
    """Null and repeated ids, null and empty texts, ties, a long text, and columns whose names the operators use."""
    r = random.Random(9)
    words = [f"word{i}" for i in range(90)] + ["É.", "x,"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(r.randint(1, 200)), r.choice(["en", "de", None]), r.choice(["a", "b", None])) for i in range(60)]
    rows += [(100, None, "en", "a"), (101, "", None, None), (102, " \n\t", "en", "a"), (None, text(70), "en", "a"), (None, text(70), "en", "b"), (None, None, None, None)]
    rows += [(7, rows[7][1], "en", "a")] * 2 + [(8, text(80), "en", "a"), (103, text(60_000), "en", "a")]
    df = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], SCHEMA)
    return df.selectExpr("*", "1 as id", "'n' as node", "2 as label", "3 as copy", "'d' as _doc", "4 as size", "5 as shard", "6 as part")


# language: every set of languages, by plain sums


def plain_trigrams(text):
    text = "".join(c if c.isalpha() or ord(c) >= 128 else " " for c in text.lower())
    data = f" {' '.join(text.split(' '))} ".encode("utf-8", "replace")
    data = re.sub(b" +", b" ", data)
    out = Counter()
    for a, b, c in zip(data, data[1:], data[2:]):
        out[((a << 16 | b << 8 | c) * 2654435761 & 0xFFFFFFFF) >> (32 - language.BITS)] += 1
    return out


def plain_mixture(grams, counts, totals, shares):
    """The set of languages of highest penalised likelihood, all sets tried, and its proportions."""
    langs, best = sorted(totals), (-math.inf, None)
    p = {k: {g: (counts[k][g] + language.SMOOTH) / (totals[k] + language.SMOOTH * 2**language.BITS) for g in grams} for k in langs}
    n = sum(grams.values())
    for size in range(1, len(langs) + 1):
        for chosen in itertools.combinations(langs, size):
            mix = {k: 1 / size for k in chosen}
            for _ in range(60 if size > 1 else 0):
                got = {k: shares[k] for k in chosen}
                for g, c in grams.items():
                    whole = sum(mix[k] * p[k][g] for k in chosen)
                    for k in chosen:
                        got[k] += c * mix[k] * p[k][g] / whole
                mix = {k: v / (n + sum(shares[j] for j in chosen)) for k, v in got.items()}
            likely = sum(c * math.log(sum(mix[k] * p[k][g] for k in chosen)) for g, c in grams.items())
            value = likely / language.OVERLAP - 0.5 * math.log(max(n, 2)) * size
            if value > best[0]:
                best = (value, mix)
    return best[1]


def test_languages_equal_the_best_of_all_sets(spark):
    r = random.Random(5)
    kinds = {"aa": ["the", "ing", "er", "ou", "st"], "bb": ["sch", "ung", "ei", "ß", "er"], "cc": ["ción", "que", "ado", "ll", "es"]}
    babble = lambda k, n: " ".join("".join(r.choice(kinds[k]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(i, babble(k, r.randint(1, 50)), k) for i, k in enumerate(list(kinds) * 30)]
    rows += [(200 + i, babble("aa", 40) + ". " + babble(k, 30), None) for i, k in enumerate(["bb", "cc"] * 5)]
    rows += [(300, None, "aa"), (301, "12 ?", "bb"), (None, "the sting", "aa"), (5, "eischung sch", "bb"), (5, "eischung sch", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as held_out", "2 as kept", "3 as score").repartition(3)
    got = sorted(((x.doc_id, x.held_out, x.lang_pred, x.score) for x in language.identify_documents(df).collect()), key=str)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts, want = defaultdict(Counter), []
    for i, text, k in rows:
        if k and text is not None and not held(i):
            counts[k].update(plain_trigrams(text))
    totals = {k: sum(c.values()) for k, c in counts.items()}
    shares = {k: max(t / sum(totals.values()), 1e-6) for k, t in totals.items()}
    for i, text, _ in rows:
        if not text or not any(map(str.isalpha, text)):
            want.append((i, held(i), "und", 0.0))
            continue
        mix = plain_mixture(plain_trigrams(text), counts, totals, shares)
        name = max(mix, key=mix.get)
        want.append((i, held(i), name, mix[name]))
    want.sort(key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert sum(a[2] == b[2] for a, b in zip(got, want, strict=True)) >= len(want) - 1
    assert sum(abs(a[3] - b[3]) < 0.02 for a, b in zip(got, want, strict=True)) >= len(want) - 3


# fingerprints: byte by byte, and the whole table of edit distances


def plain_fingerprint(data):
    hashes, window, a, b, c = [], [0] * 7, 0, 0, 0
    for x in data:
        b = b - a + 7 * x
        a = a + x - window.pop(0)
        window.append(x)
        c = (c << 5 ^ x) & 0xFFFFFFFF
        hashes.append((a + b + c) & 0xFFFFFFFF)

    def letters(size, most):
        out, start = "", 0
        for i, h in enumerate(hashes):
            if h % size == size - 1 and len(out) < most - 1:
                out += fingerprints.LETTERS[zlib.crc32(data[start : i + 1]) & 63]
                start = i + 1
        return out + (fingerprints.LETTERS[zlib.crc32(data[start:]) & 63] if start < len(data) else "")

    size = 3
    while size * 64 < len(data):
        size *= 2
    while size > 3 and sum(h % size == size - 1 for h in hashes) < 31:
        size //= 2
    return f"{size}:{letters(size, 64)}:{letters(2 * size, 32)}"


def plain_likeness(one, other):
    def alike(s, t):
        if s == t:
            return 1.0 if s else 0.0
        run = min(7, (len(s) + 1) // 2, (len(t) + 1) // 2)
        if not run or not any(s[i : i + run] in t for i in range(len(s) - run + 1)):
            return 0.0
        cost = [[i + j for j in range(len(t) + 1)] for i in range(len(s) + 1)]
        for i in range(1, len(s) + 1):
            for j in range(1, len(t) + 1):
                cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (0 if s[i - 1] == t[j - 1] else 2))
        return 1 - cost[-1][-1] / (len(s) + len(t))

    if one == other:
        return 1.0
    (n, *a), (m, *b) = one.split(":"), other.split(":")
    sizes = {(int(n) << i, int(m) << j): (a[i], b[j]) for i in (0, 1) for j in (0, 1)}
    return max([alike(*pair) for (x, y), pair in sizes.items() if x == y], default=0.0)


def test_fingerprints_byte_by_byte(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("alpha beta gamma délta ε zeta eta".split()) + str(r.randrange(40)) for _ in range(n)) for n in (0, 1, 2, 5, 30, 90, 400, 1500, 4000)]
    texts += [texts[6] + " more", texts[6], None, "x" * 3000, "ab" * 90_000]
    df = spark.createDataFrame([(3 * i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "'p' as part", "1 as first", "'f' as fingerprint").repartition(4)
    rows = {x.doc_id: x for x in fingerprints.fingerprint_documents(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        mark, edited_mark = plain_fingerprint(t.encode()), plain_fingerprint(edited.encode())
        x = rows[3 * i]
        assert (x.n_chars, x.edited_sha256, x.fingerprint, x.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), mark, edited_mark)
        assert x.near_edited == pytest.approx(plain_likeness(mark, edited_mark)) and x.near_next == pytest.approx(plain_likeness(mark, plain_fingerprint(after.encode())))


def test_fingerprints_of_repeated_and_unnamed_rows(spark):
    df = odd_documents(spark)
    got = Counter((x.doc_id, x.fingerprint) for x in fingerprints.fingerprint_documents(df.repartition(3)).collect())
    assert got == Counter((x.doc_id, plain_fingerprint((x.text or "").encode())) for x in df.collect())


# shards: every score of every shard


def plain_shard(key, shards, seed=7):
    best = (-math.inf, 0)
    for s in range(shards):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", s), h)
        h = h if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), h)
        best = max(best, (-1 / math.log(((h >> 12) + 0.5) / 2**52), -s))
    return -best[1]


def test_shards_equal_plain_rendezvous_hashing(spark):
    df = odd_documents(spark)
    got = sharding.shard_documents(df.repartition(3), 24).collect()
    want = Counter()
    for x in df.collect():
        data = (x.text or "").encode()
        want[x.doc_id, len(data) + 8, zlib.crc32(data), plain_shard(x.doc_id, 24), plain_shard(x.doc_id, 25)] += 1
    assert Counter((x.doc_id, x.size, x.text_crc32, x.shard, x.grown_shard) for x in got) == want
    slots = defaultdict(list)
    for x in got:
        slots[x.shard].append(x.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    empty = sharding.shard_documents(df.limit(0))
    assert empty.count() == 0


# toxicity: the sum over all pairs of terms


def test_scores_equal_a_plain_factorization_machine(spark):
    r = np.random.default_rng(3)
    df = odd_documents(spark)
    seen = sorted({t for x in df.collect() for w in (x.text or "").lower().split() for t in toxicity.word_terms(w)})
    kept = np.array(sorted(r.choice(seen, 60, replace=False)))
    w, v = r.normal(0, 0.5, 61), r.normal(0, 0.4, (60, 4))
    for x in toxicity.score(df, (kept, w, v), [F.col("doc_id"), F.col("text")]).collect():
        on = sorted({int(np.searchsorted(kept, t)) for word in (x.text or "").lower().split() for t in toxicity.word_terms(word) if t in set(kept.tolist())})
        margin = w[-1] + sum(w[i] for i in on) + sum(float(v[i] @ v[j]) for i, j in itertools.combinations(on, 2))
        assert x.score == pytest.approx(1 / (1 + math.exp(-min(max(margin, -30), 30))), abs=1e-12) and x.predicted == (x.score >= 0.5)


# the pipeline: each stage on a table of odd rows


def test_each_stage_on_odd_rows(spark):
    from tokenizers import Tokenizer

    docs = odd_documents(spark)
    verdicts = {(x.doc_id, x.n_words): x.kept for x in quality.document_quality(docs).collect()}
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = lambda df: Counter((x.doc_id, x.text, x.lang, x.source) for x in df.collect())
    first = corpus_pipeline.quality_rules(spark, docs, "")
    assert rows(first) == Counter({k: n for k, n in rows(docs).items() if verdicts[k[0], words(k[1])]})
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_duplicates, corpus_pipeline.personal_data, corpus_pipeline.source_mix):
        assert stage(spark, docs, "").columns == docs.columns and stage(spark, docs.limit(0), "").count() == 0
    assert sum(rows(corpus_pipeline.personal_data(spark, docs, "")).values()) == docs.count()
    ids = corpus_pipeline.token_ids(spark, docs, "").collect()
    library = Tokenizer.from_file(bpe.default_path())
    assert Counter((x.doc_id, tuple(x.ids)) for x in ids) == Counter((x.doc_id, tuple(library.encode(x.text or "", add_special_tokens=False).ids)) for x in docs.collect())
    assert corpus_pipeline.token_ids(spark, docs.limit(0), "").count() == 0


def test_near_duplicates_stage_equals_brute_force(spark):
    texts = near_copies(11)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    want = components(word_sets(texts, 5), 80)
    wordless = {}  # texts without words link with copies of themselves alone
    for i, t in enumerate(texts):
        if not (t or "").split():
            want[i] = wordless.setdefault(t, i)
    assert sorted(x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(set(want))


def test_source_mix_stage_takes_what_the_mix_says(spark):
    docs = odd_documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    taken = {x.doc_id: (x.taken, x.size) for x in mixing.mix_documents(docs).collect()}
    times = Counter(x.doc_id for x in corpus_pipeline.source_mix(spark, docs, "").collect())
    for i, (n, size) in taken.items():
        assert math.floor(n / max(size, 1)) <= times[i] <= math.ceil(n / max(size, 1)) or size == 0
    sources = {x.doc_id: x.source for x in docs.collect()}
    for source in set(sources.values()):
        longest = max(s for i, (_, s) in taken.items() if sources[i] == source)
        held = sum(times[i] * s for i, (_, s) in taken.items() if sources[i] == source)
        assert abs(held - sum(n for i, (n, _) in taken.items() if sources[i] == source)) <= longest
