"""Operator 5 against all pairs of full shingle sets."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wardstream.llm import near_dup as N
from wardstream.llm.queries import op5_near_duplicates


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", low) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, percent=85):
    """(set size, component) by id: every pair that shares a shingle is compared."""
    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i] = parent[parent[i]]
        return i

    posts = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            posts[x].append(i)
    seen = set()
    for ids in posts.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    n = len(sets[a] & sets[b])
                    if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in docs}


def check(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_tables(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(op5_near_duplicates(spark, sf).collect(), brute(docs))


def test_chains_hubs_and_blocks(spark):
    """Chains whose ends are far apart, groups around a text that isn't the smallest, and lists of several blocks."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, common = [], [word() for _ in range(40)]
    for _ in range(8):
        base = [word() for _ in range(rng.randint(60, 120))] + common
        for _ in range(rng.randint(3, 25)):
            t = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
            if rng.random() < 0.3:
                base = t
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    check(N.near_duplicates(df, N.Settings(block=7, broadcast_rows=3, around=4)).collect(), brute(docs))


def test_odd_rows(spark):
    texts = [None, "", " \n", "one", "ONE", "one two three four", "one two three four", "one two three four five", "x " * 50_000, "X " * 40_000, "é", "É"]
    df = spark.createDataFrame([*enumerate(texts), (3, "one"), (None, "one")], "doc_id long, text string").withColumn("rep", F.lit("clash")).withColumn("n", F.lit(0))
    rows = N.near_duplicates(df).collect()
    assert len(rows) == len(texts) + 2
    want = brute(dict(enumerate(texts)))
    for r in rows:
        assert r["doc_id"] is None or (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    left = N.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(r["doc_id"] or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 3, 5, 7, 8, 10, 11]
    assert N.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("large", [1, 120])
def test_a_list_of_many_components(spark, monkeypatch, large):
    """No group of rows that meet holds more than about two blocks, and yet all pairs across components are found."""
    size, s = 300, N.Settings(block=20)
    rows = [(i, max(i, large - 1), 600, list(range(s.coords)), b"\1" * 512, [(0, 77)]) for i in range(size)]
    df = spark.createDataFrame(rows, "rep long, comp long, n long, sig array<int>, bins binary, p array<struct<coord: int, list: long>>")
    comp, sketch = df.select("rep", "comp"), df.drop("comp")
    want = {(i, j) for i in range(size) for j in range(i + 1, size) if j >= large}
    found = N.across(comp, sketch, s).collect()
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    monkeypatch.setattr(N, "agreeing", lambda rows, s, partners: rows)
    dealt = N.across(comp, sketch, s)
    groups = dealt.groupBy([x for x in ("list", "part", "low", "high") if x in dealt.columns]).count().collect()
    assert max(r["count"] for r in groups) <= 4 * s.block


def test_ids_with_several_texts(spark):
    """Rows of one id and different texts are one document: no row is doubled, and reruns agree."""
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abc"]
    rows = [(5, texts[0]), (5, texts[1]), (5, texts[1]), (7, texts[0]), (8, texts[1]), (9, texts[2]), (9, None), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in N.near_duplicates(df.repartition(k)).collect()) for k in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)
    by = {r[0]: r[2] for r in got[0]}
    assert by["5"] == "5" and by["9"] == "9" and {by["7"], by["8"]} in ({"5", "7"}, {"5", "8"}, {"5"})


def test_recall_of_planted_pairs(spark):
    """Pairs just above the bound: each is found, of 3,000."""
    rng = random.Random(8)
    rows, n = [], 3000
    for k in range(n):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(150, 400))]
        t = base[:]
        # of m shingles 5 go with each word changed: the share left is (m - 5c) / (m + 5c)
        m = len(base) - 4
        for at in rng.sample(range(5, len(base) - 5, 6), max(1, int(m * 0.15 / 1.85 / 5))):
            t[at] = f"x{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(t))]
    want = {i: c for i, (_, c) in brute(dict(rows)).items()}
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert sum(i != c for i, c in want.items()) > 0.9 * n
    assert got == want


def test_each_id_with_several_texts_links_the_copies_of_one(spark):
    """Forty ids with two unrelated texts each, and a near copy of either: exactly one of the two copies is linked."""
    rng, rows = random.Random(6), []
    for k in range(40):
        for side in (0, 1):
            words = [f"v{rng.randrange(10**6)}" for _ in range(200)]
            rows += [(k, " ".join(words)), (1000 + 10 * k + side, " ".join([*words[:-1], "end"]))]
    by = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert all(by[k] == k and sorted([by[1000 + 10 * k] == k, by[1001 + 10 * k] == k]) == [False, True] for k in range(40))
