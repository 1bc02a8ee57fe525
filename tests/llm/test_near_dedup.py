import random
import re

from orthoplan.llm import near_dedup
from orthoplan.llm.components import components

SCHEMA = "doc_id long, text string, n int, component string"


def sets(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset([tuple(words)] if len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def brute(rows):
    s = [(i, sets(t)) for i, t in rows]
    parent = {i: i for i, _ in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(s):
        for j, b in s[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in parent}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    texts = [None, "", " \t\n", "one two", "ONE  two", "one two three", "İstanbul ÄÖ é", "a b c d e", "A b\x0bc d E"]
    for g in range(40):
        base = [word() for _ in range(rng.choice([6, 40, 150]))]
        for _ in range(rng.choice([1, 2, 5])):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 15) + 1)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w + (passage if g % 3 == 0 else [])))
    hot = [word() for _ in range(120)]
    for _ in range(150):  # a large group about the threshold, far beyond a small node
        w = list(hot)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [" ".join(hot)] * 100
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts))


def test_matches_brute_force(spark):
    rows = corpus(4)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(4)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    want = brute(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (r.component_id == i) and r.n_shingles == len(sets(dict(rows)[i])) for i, r in got.items())


def test_null_and_repeated_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f", None, None), (5, "a b c d e f", None, None), (3, "a b c d e f", None, None), (5, "other words are here too now", None, None), (7, "other words are here too now", None, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == [("3", 3, True), ("5", 3, False), ("5", 3, False), ("7", 3, False), ("None", None, True)]
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).selectExpr("300 - id AS a", "299 - id AS b")
    assert components(chain.unionByName(spark.createDataFrame([(1000, 2000), (7, 7)], "a long, b long"))).groupBy("component").count().orderBy("component").collect() == [(0, 301), (1000, 2)]


def test_roots_reach_the_stated_recall():
    for percent in (40, 75, 95):
        for seed in range(20):
            roots = near_dedup.roots_of(seed, percent / 100)
            assert all(len(near_dedup.picks(v, percent / 100)) for v in roots)
            assert 1 - (1 - percent / 100) ** len(set(near_dedup.slots(seed, percent / 100))) >= 0.99999


def test_large_nodes_lose_no_pair(spark, monkeypatch):
    """Pairs just over the threshold that share a passage with many texts: their common values lie in large nodes only."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage, rows = [word() for _ in range(100)], []
    for g in range(400):
        own = [word() for _ in range(42)]
        for _ in range(2):
            rows.append((rng.randrange(10**12), " ".join(passage + own), 1, "x"))
            own = own[:24] + [word() for _ in range(18)]
    monkeypatch.setattr(near_dedup, "SMALL", 32, raising=False)
    monkeypatch.setattr(near_dedup, "CHUNK", 64)
    want = brute([r[:2] for r in rows])
    assert len(set(want.values())) == 400
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == want
