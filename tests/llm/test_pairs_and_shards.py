import collections
import random
import re
import zlib

import pytest

from gridspark.llm import fingerprints, mixing, ngram_join, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, source=lambda i: f"s{i % 3}"):
    return spark.createDataFrame([(i, t, "en", source(i), len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def word_sets(texts, size):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    return out


def components(sets, percent):
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def near_copies(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    base = [[r.choice(words) for _ in range(n)] for n in (3, 8, 30, 60, 60, 120)]
    texts = ["", None, " \n", "Two words", "two  WORDS", "one", "É one", "é one"]
    for b in base:
        texts.append(" ".join(b))
        for _ in range(9):
            c = list(b)
            for _ in range(r.choice((0, 1, 1, 2, 4))):
                c[r.randrange(len(c))] = r.choice(words)
            if r.random() < 0.3:
                c = c[: -r.randint(1, 3)] or c
            texts.append(" ".join(c))
    common = " ".join(r.choice(words) for _ in range(40))
    texts += [common + " " + " ".join(r.choice(words) for _ in range(n)) for n in (1, 1, 2, 3, 3, 4, 5, 40)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_ngram_join_equals_all_pairs(spark, size, percent):
    texts = near_copies(size)
    sets = word_sets(texts, size)
    got = {r.doc_id: r for r in ngram_join.near_duplicates(documents(spark, texts), size, percent).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == components(sets, percent)


def test_ngram_join_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, None)], "doc_id long, text string")
    rows = ngram_join.near_duplicates(df, 3, 90).collect()
    assert len(rows) == 4 and len({r.component_id for r in rows if r.n_shingles}) == 1
    assert ngram_join.near_duplicates(df.limit(0), 3, 90).count() == 0


def test_rows_that_share_a_doc_id(spark):
    r = random.Random(40)
    new = lambda n: [f"t{r.randrange(10**9)}" for _ in range(n)]
    near = lambda w: " ".join(w[:-1] + new(1))
    rows = []
    for i in range(0, 90, 3):  # id i has the texts A and B, i + 1 is near A, i + 2 near B
        a, b = new(50), new(70)
        rows += [(i, " ".join(a)), (i, " ".join(b)), (i + 1, near(a)), (i + 2, near(b))]
    rows += [(1000, "x y z"), (1005, "x y z"), (1005, "p q r s"), (1007, "p q r s"), (None, "lone words here"), (None, "x y z"), (2000, None), (2000, "")]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, "kept", k, [k]) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _id string, label int, prefix array<int>").repartition(5)
    got = ngram_join.near_duplicates(df, 3, 90).collect()
    assert len(got) == len(rows) and all(x.component_id == x.doc_id // 3 * 3 for x in got if x.doc_id is not None and x.doc_id < 90)
    assert {x.component_id for x in got if x.doc_id and x.doc_id >= 1000} == {1000, 2000}
    # the stage links texts alone: A and B stay, of near texts the one with the smaller doc_id
    kept = ngram_join.distinct_documents(df, 3, 90)
    assert kept.columns == df.columns
    texts = {x.text for x in kept.collect()}
    want = {t for i, t in rows if i is not None and i < 90 and i % 3 == 0} | {"x y z", "p q r s", "lone words here", None, ""}
    assert texts == want and kept.count() == len(want)
    again = kept.unionByName(kept)
    assert ngram_join.distinct_documents(again, 3, 90).count() == len(want)


def test_many_copies_and_one_frequent_ngram(spark):
    r = random.Random(41)
    common = "every text starts with these nine common words here"
    texts = [common] * 300 + [f"{common} " + " ".join(f"u{r.randrange(10**9)}" for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += [f"{common} same tail {i % 3}" for i in range(200)] + [" ".join(f"v{k}" for k in range(30_000)), " ".join(f"v{k}" for k in range(29_900))]
    sets = word_sets(texts, 3)
    got = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(documents(spark, texts).repartition(6), 3, 90).collect()}
    assert [got[i] for i in range(len(texts))] == components(sets, 90)


def test_runs_across_batches():
    import pyarrow as pa

    rows = [(1, 0, 0, 9, 1), (2, 0, 0, 9, 2), (2, 0, 1, 9, 3), (2, 1, 0, 12, 4), (3, 0, 0, 9, 5), (4, 0, 0, 9, 6), (4, 5, 0, 9, 7)]
    last = [r for b in ngram_join._runs(iter([pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[:5]), ngram_join.RUNS.values())], names=list(ngram_join.RUNS))])) for r in b.to_pylist()]
    assert [(r["gram"], r["node"], r["a_node"]) for r in last] == [(1, 1, 1), (2, 2, 2), (2, 3, 2), (2, 4, 2), (3, 5, 5)]
    names = ["gram", "band", "pos", "n", "node"]

    def batches(cuts):
        for a, b in zip([0, *cuts], [*cuts, len(rows)]):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a:b]), ngram_join.RUNS.values())], names=names)

    want = {(1, 1): 1, (2, 2): 2, (2, 3): 2, (2, 4): 2, (4, 6): 6, (4, 7): 6}
    for cuts in ([], [1], [2], [3], [2, 3], [1, 2, 3, 4, 5, 6], [5], [6]):
        out = [r for b in ngram_join._runs(batches(cuts)) for r in b.to_pylist()]
        assert {(r["gram"], r["node"]): r["a_node"] for r in out} == want and len(out) == 6


def test_fingerprints_and_neighbours(spark):
    r = random.Random(1)
    texts = [" ".join(r.choice("alpha beta gamma délta ε zeta eta".split()) + str(r.randrange(50)) for _ in range(n)) for n in (0, 1, 3, 40, 200, 200, 900, 2500)] + [None, "x" * 5000]
    got = {x.doc_id: x for x in fingerprints.fingerprint_documents(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        n = len(t)
        edited = t[: n - n // 3] + after[: n // 3]
        mark, next_mark, edited_mark = (fingerprints.fingerprint(x.encode()) for x in (t, after, edited))
        x = got[i]
        assert (x.n_chars, x.fingerprint, x.edited_fingerprint) == (n, mark, edited_mark)
        assert x.near_edited == fingerprints.likeness(mark, edited_mark) and x.near_next == fingerprints.likeness(mark, next_mark)
    assert got[7].near_edited > 0.5 and got[7].near_next < 0.2
    one = fingerprints.fingerprint_documents(documents(spark, ["only one text here"])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.fingerprint_documents(documents(spark, ["a"]).limit(0)).count() == 0


def test_rolling_hash_sees_seven_bytes_only():
    data = bytes(random.Random(2).randrange(256) for _ in range(400))
    a, b = fingerprints.rolling(data), fingerprints.rolling(b"prefix" + data)
    assert (a[7:] == b[13:]).all()
    assert fingerprints.common_letters("ABCBDAB", "BDCABA") == 4


def test_shards(spark):
    texts = [None, "", *[f"text {i} é" for i in range(500)], "text 1 é"]
    rows = sharding.shard_documents(documents(spark, texts), 6).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"key"}
    by = collections.defaultdict(list)
    for r in rows:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 8, zlib.crc32(t))
        assert r.grown_shard in (r.shard, 6)
        by[r.shard].append(r.slot)
    assert set(by) == set(range(6)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    more = {r.doc_id: r.shard for r in sharding.shard_documents(documents(spark, texts), 7).collect()}
    assert all(more[r.doc_id] == r.grown_shard for r in rows)
    assert sharding.shard_documents(documents(spark, texts).limit(0)).count() == 0


def test_weighted_shards_are_in_proportion(spark):
    df = sharding.assign_shards(spark.range(20_000), "id", [1, 2, 1])
    n = {r.shard: r["count"] for r in df.groupBy("shard").count().collect()}
    assert abs(n[1] / 20_000 - 0.5) < 0.02 and abs(n[0] / 20_000 - 0.25) < 0.02
    with pytest.raises(ValueError):
        sharding.assign_shards(spark.range(1), "id", [1, 0])


def quotients(votes, seats, limits):
    out = [0] * len(votes)
    for _ in range(min(seats, sum(limits))):
        i = max((i for i in range(len(votes)) if out[i] < limits[i]), key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[i] += 1
    return out


def test_sainte_lague_equals_the_quotients():
    r = random.Random(4)
    for _ in range(200):
        votes = [r.choice((1.0, r.random() * 50 + 0.1)) for _ in range(r.randint(1, 7))]
        limits = [r.randint(0, 40) for _ in votes]
        seats = r.randint(0, 120)
        assert mixing.sainte_lague(votes, seats, limits) == quotients(votes, seats, limits)


def test_targets_stop_at_three_times_the_size():
    got = mixing.share_targets({"a": 10, "b": 100, "c": 1000}, {"a": 5, "b": 2, "c": 1})
    assert got["a"] == 30 and got["b"] == 300 and abs(sum(got.values()) - 1110) < 1e-9


def test_mix(spark):
    r = random.Random(6)
    texts = [None, " ", *[" ".join(["w"] * r.randint(1, 90)) for _ in range(400)]]
    names = ["b", "a", None, "ä", "z"]
    df = documents(spark, texts, lambda i: names[i % 5 if i > 40 else 1])
    rows = mixing.mix_documents(df, shard_docs=50).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_documents(df.repartition(7), shard_docs=50).collect()))
    assert len(rows) == len(texts) and all(0 <= x.taken <= 3 * x.size for x in rows)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for x in rows:
        assert x.size == len((texts[x.doc_id] or "").split())
        s = names[x.doc_id % 5 if x.doc_id > 40 else 1]
        size[s] += x.size
        taken[s] += x.taken
        target[s] = x.target
    want = mixing.share_targets(size, {"a": 5, "b": 2, "z": 1, "ä": 5, None: 2})
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - target[s]) <= 64 * 8 for s in target)
    assert mixing.repeat_documents(df).columns == df.columns
    assert mixing.mix_documents(df.limit(0)).count() == 0 and mixing.repeat_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard_docs,fan", [(60, 64), (10, 4)])
def test_taken_words_equal_a_plain_version(spark, monkeypatch, shard_docs, fan):
    monkeypatch.setattr(mixing, "FAN", fan)  # a small tree of several levels
    r = random.Random(26)
    texts = [" ".join(["w"] * r.choice((0, 5, 90, r.randint(1, 700)))) for _ in range(500)]
    names = ["b", "a", None, "c"]
    df = documents(spark, texts, lambda i: names[min(i % 9, 3)])
    keys = {x.doc_id: x.k for x in df.selectExpr("doc_id", f"xxhash64({mixing.SEED}, doc_id, cast(n_chars - length(replace(text, 'w')) as bigint)) as k").collect()}
    size = {i: len(t.split()) for i, t in enumerate(texts)}
    source = {i: names[min(i % 9, 3)] for i in size}
    order = ["a", "b", "c", None]
    total = {s: sum(size[i] for i in size if source[i] == s) for s in order}
    target = mixing.share_targets(total, dict(zip(order, (5, 2, 1, 5))))
    seats = quotients([target[s] for s in order], round(sum(target.values()) / 64), [3 * -(-total[s] // 64) for s in order])
    want = {}
    for s, q in zip(order, seats):
        n = -(-sum(source[i] == s for i in size) // shard_docs)
        shard = collections.defaultdict(list)
        for i in size:
            if source[i] == s:
                shard[keys[i] % n].append(i)
        words = {k: sum(size[i] for i in v) for k, v in shard.items()}
        blocks = {k: -(-w // 64) for k, w in words.items()}
        depth = 1
        while fan**depth < n:
            depth += 1
        given = {0: q}
        for level in range(depth - 1, -1, -1):
            below = {}
            for parent, quota in given.items():
                nodes = sorted({k // fan**level for k in words if k // fan ** (level + 1) == parent})
                of = lambda d, node: sum(v for k, v in d.items() if k // fan**level == node)
                below |= dict(zip(nodes, quotients([of(words, x) for x in nodes], quota, [3 * of(blocks, x) for x in nodes])))
            given = below
        for k, ids in shard.items():
            m = blocks[k]
            shift = spark.sql(f"select pmod(xxhash64({mixing.SEED}, cast({repr(s) if s else 'null'} as string), {k}L), {mixing.PRIME})").first()[0]
            at = 0
            for i in sorted(ids, key=lambda i: (keys[i], i, size[i])):
                hits = [given[k] // m + ((w // 64 * mixing.PRIME + shift) % m < given[k] % m) for w in range(at, at + size[i])] if m else []
                want[i], at = sum(hits), at + size[i]
    assert {x.doc_id: x.taken for x in mixing.mix_documents(df, shard_docs=shard_docs).collect()} == want


def test_mix_of_odd_columns(spark):
    df = spark.createDataFrame([(i % 3, "a b c " * i, None if i % 2 else "s", i, "x", 2.5) for i in range(40)], "doc_id long, text string, source string, _s int, _shard string, target double")
    out = mixing.repeat_documents(df)
    assert out.columns == df.columns and out.count() > 0
    assert {x._s for x in out.collect()} <= set(range(1, 40)) and mixing.mix_documents(df).count() == 40


@pytest.mark.parametrize("shard_docs", [2000, 100])
def test_copies_of_long_documents_hit_the_target(spark, shard_docs):
    r = random.Random(12)
    texts = [" ".join(["w"] * r.choice((30, 700, r.randint(400, 3000)))) for _ in range(600)]
    names = ["a", "b", "c", "d"]
    df = documents(spark, texts, lambda i: names[min(i % 8, 3)])
    taken, target, sizes, emitted = collections.Counter(), {}, {}, collections.Counter()
    for x in mixing.mix_documents(df, shard_docs=shard_docs).collect():
        s = names[min(x.doc_id % 8, 3)]
        taken[s] += x.taken
        target[s], sizes[x.doc_id] = x.target, (x.size, x.taken)
    copies = collections.Counter(x.doc_id for x in mixing.repeat_documents(df, shard_docs=shard_docs).collect())
    for i, n in copies.items():
        emitted[names[min(i % 8, 3)]] += n * sizes[i][0]
    assert all(t // n <= copies[i] <= -(-t // n) for i, (n, t) in sizes.items())
    for s, t in target.items():
        shards = -(-sum(names[min(i % 8, 3)] == s for i in sizes) // shard_docs)
        assert abs(emitted[s] - taken[s]) <= 3000 * shards, (s, emitted[s], taken[s])
        assert abs(emitted[s] - t) <= 0.1 * t, (s, emitted[s], t)
