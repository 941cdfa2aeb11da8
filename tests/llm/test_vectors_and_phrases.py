import collections
import math
import random
import re

import numpy as np
import pytest
import xxhash

from gridspark.llm import collocations, simhash, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# whitening


def vectors(seed, n=300, d=6):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(d, d))
    rows = (r.normal(size=(n, d)) @ mix * 0.1 + r.normal(size=d)).astype(np.float32)
    rows[10:40] = rows[9]  # a third of the table may be one vector
    return rows


def test_whitening_equals_the_plain_covariance(spark):
    rows = vectors(1)
    odd = [None, [], [1.0] * 5, [None] * 6, [math.nan] * 6, [math.inf] + [0.0] * 5]
    table = [(i, v.tolist(), 7, "x") for i, v in enumerate(rows)] + [(1000 + i, v, 7, "x") for i, v in enumerate(odd)] + [(None, rows[0].tolist(), 7, "x"), (5, rows[1].tolist(), 7, "x")]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, n int, component string").repartition(5)
    got = whitening.whiten(df, components=4).collect()
    kept = [(t[0], t[1]) for t in table[:300]] + [(t[0], t[1]) for t in table[-2:]]
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in kept], dtype=object)
    n, s = len(x), x.sum(axis=0)
    off = (n * x - s).astype(object)
    cov = ((off.T @ off) / (n * n * n)).astype(float)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    white = (off / n).astype(float) @ axes[:, :4] / np.sqrt(values[:4])
    assert len(got) == 4 * n
    want = collections.Counter((i, k + 1, n, int((off[j] ** 2).sum())) for j, (i, _) in enumerate(kept) for k in range(4))
    assert collections.Counter((r.vec_id, r.component, r.n, r.deviation) for r in got) == want
    for k in range(4):
        mine = {r.deviation: r.whitened for r in got if r.component == k + 1}
        plain = {int((off[j] ** 2).sum()): white[j, k] for j in range(n)}
        sign = np.sign(mine[max(plain)] * plain[max(plain)])
        assert max(abs(mine[d] - sign * plain[d]) for d in plain) < 1e-9
        assert {r.explained for r in got if r.component == k + 1}.pop() == pytest.approx(values[k] / np.trace(cov), rel=1e-9)
    assert {r.identity_error for r in got}.pop() < 1e-9


def test_whitening_of_few_and_flat_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    empty = spark.createDataFrame([], schema)
    assert whitening.whiten(empty).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)
    assert whitening.whiten(same).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 3.0]) for i in range(5)], schema)  # one direction only
    got = whitening.whiten(flat).collect()
    assert {r.component for r in got} == {1} and {r.explained for r in got}.pop() == pytest.approx(1.0)
    with pytest.raises(Exception, match="(?i)overflow"):
        whitening.whiten(spark.createDataFrame([(1, [9e15]), (2, [-9e15])], schema)).collect()


def test_upper_triangle_is_exact(spark):
    rows = np.arange(24.0).reshape(6, 4) % 7
    df = spark.createDataFrame([(r.tolist(),) for r in rows], "c array<double>")
    assert (whitening.upper_triangle(df, 4) == rows.T @ rows).all()


# SimHash


def plain_fingerprint(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance):
    top = list(range(len(prints)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= distance:
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(50)] + ["É", "Ab", "aB"]
    texts = [None, "", " \n\t", "one", "two words", "Two\x0bWORDS", "a\x00b c d", "x " * 70000]
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randint(3, 400))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 12)):
            c = list(base)
            c[r.randrange(len(c))] = r.choice(words)
            texts.append("  ".join(c))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == plain_components(prints, 3)


def crowd(seed):
    """Fingerprints in chains and balls about few centres, among scattered ones."""
    r = random.Random(seed)
    out = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(6):
        p = r.getrandbits(64)
        for _ in range(120):
            q = p
            for _ in range(r.randint(0, 4)):
                q ^= 1 << r.randrange(64)
            out.add(q)
            if r.random() < 0.1:
                p = q
    return sorted(out | {r.getrandbits(64) for _ in range(200)})


@pytest.mark.parametrize("distance", [0, 1, 3])
def test_links_of_fingerprints_equal_brute_force(spark, distance):
    prints = crowd(distance)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p, 1 + i % 5) for i, p in enumerate(signed)], "fp long, n long")
    got = {r.fp: r.label for r in simhash.fingerprint_components(nodes, distance).collect()}
    groups = collections.defaultdict(list)
    for p, top in zip(signed, plain_components(prints, distance), strict=True):
        groups[top].append(p)
    assert got == {p: min(g) for g in groups.values() for p in g}


def test_anchors_cover_and_meet(spark):
    r = random.Random(5)
    halves = [0, 1, (1 << 32) - 1, 1 << 31, *[r.getrandbits(32) for _ in range(100)]]
    df = spark.createDataFrame([(h,) for h in halves], "half long")
    found = {x.half: x.a for x in df.select("half", simhash.anchors(df.half).alias("a")).collect()}
    code = {a for v in found.values() for a in v[:1]}
    for h, a in found.items():
        distances = [bin(h ^ x).count("1") for x in a]
        assert len(set(a)) == len(a) in (2, 17) and distances[0] <= 1 and max(distances) <= 2
    again = spark.createDataFrame([(c,) for c in code], "half long")
    assert all(x.a[0] == x.half for x in again.select("half", simhash.anchors(again.half).alias("a")).collect())  # words of the code
    flips = [(h, h ^ (1 << b)) for h in halves[:20] for b in range(32)]
    near = spark.createDataFrame(flips, "half long, other long")
    for x in near.select(simhash.anchors(near.half).alias("a"), simhash.anchors(near.other).alias("b")).collect():
        assert x.a[0] in x.b and x.b[0] in x.a


def test_simhash_of_odd_rows(spark):
    rows = [(None, "a b c d", "en", "s", 1), (4, "a b c d", "en", "s", 1), (4, "a b c d", "en", "s", 1), (4, "q r s t", "en", "s", 1), (None, "lonely words here now", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as fp", "2 as anchor", "3 as label", "4 as n")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (4, 4), (None, None)], key=str)
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError, match="distance"):
        simhash.near_duplicates(df, distance=4)


def test_simhash_sends_no_table_through_the_driver(spark, monkeypatch):
    plans = collections.defaultdict(list)

    def planned(df, name):
        plans[name].append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df, name)

    write = simhash.written
    monkeypatch.setattr(simhash, "written", planned)
    rows = [(i, " ".join(f"w{i * j % 97}" for j in range(1 + i % 9)), "en", "s", 1) for i in range(60)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    plans["result"].append(found._jdf.queryExecution().sparkPlan().toString())
    assert found.count() == 60
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) > 1 << 20  # these tables stay below it
    came = plans["came"][0]
    assert "Join" in came and "Broadcast" not in came
    assert {"homes", "came", "labelled", "main", "more", "labels"} <= set(plans)
    assert [name for name, made in plans.items() if "Broadcast" in "".join(made)] == []

def test_components_of_fingerprints_send_no_table_through_the_driver(spark, monkeypatch):
    plans = collections.defaultdict(list)

    def planned(df, name):
        plans[name].append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df, name)

    write = simhash.written
    monkeypatch.setattr(simhash, "written", planned)
    prints = crowd(4)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that the links have several partitions
    try:
        got = {r.fp: r.label for r in simhash.fingerprint_components(spark.createDataFrame([(p, 1) for p in signed], "fp long, n long")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    groups = collections.defaultdict(list)
    for p, top in zip(signed, plain_components(prints, 3), strict=True):
        groups[top].append(p)
    assert got == {p: min(g) for g in groups.values() for p in g}
    assert {"pointers", "contracted"} <= set(plans)
    assert [name for name, made in plans.items() if "Broadcast" in "".join(made)] == []


# collocations


def plain_collocations(rows, longest, least, percent, top):
    counts, words = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    frequent = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, p), a in frequent.items():
        if any(x == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * f >= percent * a for (x, q), f in frequent.items()):
            continue
        cuts = [(1000000 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, words[lang], -s) for lang, v in out.items() for i, (s, a, p, left, right) in enumerate(sorted(v)[:top]))


def phrases(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["É", "Z", "z", "\u0001x", "-", "a" * 300, "\U0001f600", "ﬁ"]
    rows = [(None, "en"), ("", "en"), (" \t ", "fr"), ("...", None), ("a.b\x0bc\x1cd e", "en"), ("w1\tw2 w3\rw1 w2\nw3", "en")]
    for _ in range(150):
        rows.append((r.choice((" ", "  ", ", "))[:2].join(r.choice(words) + r.choice(("", "", "", ".", "!")) for _ in range(r.randint(1, 60))), r.choice(("en", "en", "fr", None))))
    return rows + [rows[-1]] * 5 + [("to be " * 30000, "en")]


@pytest.mark.parametrize(("longest", "least", "percent", "top", "shard"), [(3, 10, 50, 2000, 1 << 20), (3, 10, 50, 7, 100), (4, 3, 30, 2000, 500), (2, 1, 50, 50, 1)])
def test_collocations_equal_brute_force(spark, monkeypatch, longest, least, percent, top, shard):
    monkeypatch.setattr(collocations, "SHARD_WORDS", shard)
    rows = phrases(longest)
    df = spark.createDataFrame([(i, t, lang, "s", 1) for i, (t, lang) in enumerate(rows)], SCHEMA).selectExpr("*", "1 as f", "2 as phrase", "3 as n").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, longest, least, percent, top).collect())
    assert got == plain_collocations(rows, longest, least, percent, top)


def test_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    rare = spark.createDataFrame([(1, "all words once", "en", "s", 1), (2, None, None, None, None)], SCHEMA)
    assert collocations.collocations(rare).count() == 0
    with pytest.raises(ValueError, match="two words"):
        collocations.collocations(rare, longest=1)


def test_scores_beyond_64_bits_are_exact(spark):
    a, left, right = 3_000_000_000_001, 3_000_000_000_007, 4_000_000_000_003
    grams = spark.createDataFrame([("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a)], "lang string, n int, phrase string, f long")
    assert [r.score for r in collocations.candidate_scores(grams, 3, 50).collect()] == [1000000 * a * a // (left * right)]


def test_suffix_array_orders_by_the_first_words():
    r = np.random.default_rng(1)
    for words in (1, 2, 3, 5):
        ids = r.integers(0, 4, 300)
        order = collocations.suffix_array(ids, words)
        keys = [tuple(ids[i : i + words]) for i in order]
        assert sorted(order) == list(range(300)) and keys == sorted(keys)
