"""Operator 8 against a search of every window in every text."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstream.llm import decontaminate as D
from wardstream.llm.queries import op8_decontaminate


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(texts, items, width=10):
    windows = {}
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(name)
    lengths = {len(w) for w in windows}
    for t in texts:
        w, hit, names = words(t), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    names |= own
        yield len(w), hit, sorted(names)


def test_every_document(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = dict(zip(docs, brute(docs.values(), items), strict=True))
    rows = op8_decontaminate(spark, sf_dir).collect()
    assert len(rows) == len(docs) and any(r["contaminated"] for r in rows)
    for r in rows:
        n, hit, names = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, len(hit), len(names))
        assert r["items_sha256"] == hashlib.sha256(",".join(names).encode()).hexdigest()


ITEMS = [(1, "a b c"), (2, "B, c d"), (2, "x y x y x"), (3, None), (None, "É ü"), (4, "--"), (10, "k")]
TEXTS = [None, "", "  ", "a b c d", "A-b.C  c", "x y x y x y x", "é Ü É ü", "q k k q", "a b", "a b c " * 3000, "x y x y x" * 2]


@pytest.mark.parametrize("width,block", [(3, 1 << 20), (2, 1 << 20), (3, 5)])
def test_odd_rows_and_several_blocks(spark, width, block):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("items", F.lit("clash"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    named = [("" if i is None else str(i), t) for i, t in ITEMS]
    want = list(brute(TEXTS, named, width))
    for r in D.find_benchmark(df, bench, width, block_bytes=block).collect():
        n, hit, names = want[r["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["items"]) == (n, len(hit), names)
        assert {k for s in r["spans"] for k in range(s["start"], s["end"])} == hit
    assert D.find_benchmark(df, bench.limit(0)).where("n_hit > 0").count() == 0
    assert D.find_benchmark(df.limit(0), bench).count() == 0
    left = {r["doc_id"]: r["text"] for r in D.remove_benchmark(df, bench, 3).collect()}
    assert left[0] is None and left[3] == "" and left[4] == "  c" and left[8] == "a b" and left[7] == "q  q"
    assert D.remove_benchmark(df, bench, 3).columns == df.columns
    assert {r["doc_id"]: r["text"] for r in D.remove_benchmark(df, bench, 3, block_bytes=5).collect()} == left


def test_index_against_counting():
    rng = np.random.default_rng(1)
    for _ in range(20):
        text = rng.integers(0, 4, rng.integers(2, 200)).astype(np.int32)
        text[-1] = 0
        index = D.FMIndex(text, 4, every=3)
        phrases = rng.integers(1, 4, (30, 3))
        lengths = rng.integers(1, 4, 30)
        lo, hi = index.search(phrases, lengths)
        for p, n, a, b in zip(phrases, lengths, lo, hi, strict=True):
            own = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[3 - n :]).all()]
            assert sorted(index.locate(np.arange(a, b))) == own
