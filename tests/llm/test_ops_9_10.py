"""Operators 9 and 10: held-out accuracy, odd rows, and forward-backward against enumeration."""

import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from wardstream.llm import language, toxicity
from wardstream.llm.queries import op9_toxicity, op10_language_id

ODD = [None, "", "123 !!", "a", "word " * 30_000, "x" * 100_000, "日本語 テキスト", "the and of in to"]


def part(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in op9_toxicity(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert set(rows) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [i for i in labels if part(i, 4) == 2]
    assert all(rows[i]["held_out"] == (part(i, 4) == 2) for i in rows)
    pos, neg = ([rows[i]["score"] for i in held if labels[i] == y] for y in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9 and np.mean(np.array(neg) >= 0.3) < 0.06
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows.values())


def test_toxicity_odd_rows(spark):
    texts = ["you are an awful grumbler", "what a lovely morning here", "awful grumblers again", "the garden is green"] * 8
    m = toxicity.fit(texts, [1, 0, 1, 0] * 8, toxicity.Settings(steps=30))
    df = spark.createDataFrame([*enumerate(ODD), (None, "an awful grumbbler"), (7, "again")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    rows = toxicity.score_toxicity(df, m).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    score = {r["doc_id"]: r["score"] for r in rows}
    assert score[None] > score[1]  # a misspelling that training never saw
    assert toxicity.score_toxicity(df.limit(0), m).count() == 0
    one = toxicity.fit([], [])
    assert 0 <= one.score("x") <= 1


def test_toxicity_of_words_used_before():
    """A passage at the end of a long text counts, though each of its words stands somewhere before it."""
    bad, good = [f"grumble{c}" for c in "abcdefghijklmnop"], [f"garden{i}" for i in range(400)]
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(bad if i % 2 else good, 16, False)) for i in range(80)]
    m = toxicity.fit(texts, [0, 1] * 40, toxicity.Settings(steps=30))
    scattered = " ".join(w for i in range(16) for w in [*good[25 * i : 25 * i + 24], bad[i]])
    passage = " ".join(bad)
    assert m.score(scattered) < 0.5 < m.score(passage)
    assert np.isclose(m.score(f"{scattered} {passage}"), m.score(passage))
    ws = [*good[:20], *bad, *good[5:30], *bad[:4] * 6]
    d = np.array([[*good, *bad].index(w) for w in ws])
    value = rng.normal(size=len(good) + len(bad))
    assert np.allclose(toxicity.window_sums(d, value, 16), [value[list(set(d[a : a + 16]))].sum() for a in range(len(d) - 15)])
    assert toxicity.window_sums(d[:0], value, 16).tolist() == [0.0]


def test_toxicity_gradients():
    """Derivatives against finite differences, in a window that repeats a word and one with empty words."""
    s = toxicity.Settings(buckets=64, dim=3, window=4)
    known: dict[str, int] = {}
    docs = toxicity.numbered(["a bad bad thing here", "good", "so good a day", "bad day"], known)
    words = toxicity.Words(known, s)
    win, doc = toxicity.half_windows(docs, s, len(known))
    m, want = toxicity.Model(s), np.array([1, 0, 0, 1])[doc]
    _, grads = toxicity.gradients(m, words, win, want)
    for name in ("embed", "out", "bias"):
        value, numeric = getattr(m, name), np.zeros_like(getattr(m, name))
        for at in np.ndindex(value.shape):
            loss = []
            for step in (1e-5, -1e-5):
                value[at] += step
                loss.append(toxicity.gradients(m, words, win, want)[0])
                value[at] -= step
            numeric[at] = (loss[0] - loss[1]) / 2e-5
        assert np.allclose(grads[name], numeric, atol=1e-7), name


def test_toxicity_query_is_the_worst_window(spark):
    """The query's scores against a plain loop over all windows of each whole text, by the same model."""
    from wardstream.llm.common import crc_of_id

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    learn = F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) != 2
    m = toxicity.fit_sample(docs, labels, learn)
    rows = toxicity.sample(docs, labels, learn, toxicity.Settings()).collect()
    own = toxicity.fit([r["t"] for r in sorted(rows, key=lambda r: (r["key"], r["t"] or "", r["y"]))], [r["y"] for r in sorted(rows, key=lambda r: (r["key"], r["t"] or "", r["y"]))])
    assert np.allclose(own.one, m.one) and (own.scale, own.shift) == (m.scale, m.shift)
    k = m.s.window

    def plain(text):
        ws = toxicity.words(text)
        value = {}
        for w in set(ws):
            f, _ = toxicity.features([w], m.s)
            value[w] = m.one[f].mean()
        worst = max(sum(value[w] for w in set(ws[a : a + k])) for a in range(max(1, len(ws) - k + 1)))
        return 1 / (1 + np.exp(-np.clip(m.scale * (worst / k + m.bias[1] - m.bias[0]) + m.shift, -40, 40)))

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in op9_toxicity(spark, sf).collect():
        assert np.isclose(r["score"], plain(texts[r["doc_id"]])), r["doc_id"]


def test_language_query_is_forward_backward(spark):
    """The query against its own model applied to one text at a time, with marginals by plain sums over chains."""
    from wardstream.llm.common import crc_of_id

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = language.fit_sample(docs, F.pmod(crc_of_id(F.col("doc_id")), F.lit(5)) != 0)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    def plain(text):
        ws = language.words(text)
        if not ws:
            return "und", 0.0
        total = np.zeros(len(m.labels))
        for a in range(0, len(ws), m.s.chain):
            part = ws[a : a + m.s.chain]
            f, w = language.features(part, m.lexicon, m.s)
            scores = np.stack([np.bincount(w, m.weight[f, c], len(part)) for c in range(len(m.labels))], 1)
            alpha = [np.exp(m.start + scores[0])]
            for x in scores[1:]:
                y = (alpha[-1] @ np.exp(m.move)) * np.exp(x)
                alpha.append(y / y.sum())
            beta = [np.ones(len(m.labels))]
            for x in scores[:0:-1]:
                y = np.exp(m.move) @ (np.exp(x) * beta[-1])
                beta.append(y / y.sum())
            post = np.array(alpha) * np.array(beta[::-1])
            total += (post / post.sum(1, keepdims=True)).sum(0)
        return m.labels[int(total.argmax())], total.max() / len(ws)

    for r in op10_language_id(spark, sf).collect():
        lang, score = plain(texts[r["doc_id"]])
        assert r["lang_pred"] == lang and np.isclose(r["score"], score), r["doc_id"]


def test_numbers_are_no_letters():
    assert language.words("½ ² ① Ⅳ 12") == [] and language.words("a½b é2") == ["a", "b", "é"]
    m = language.fit(["the cat", "der Hund"] * 10, ["en", "de"] * 10)
    assert m.predict(["½ ²", "①"]) == (["und", "und"], [0.0, 0.0])


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in op10_language_id(spark, sf).collect()}
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert set(rows) == set(docs) and all(r["held_out"] == (part(i, 5) == 0) for i, r in rows.items())
    held = [i for i in docs if part(i, 5) == 0 and docs[i]["lang"]]
    assert np.mean([rows[i]["lang_pred"] == docs[i]["lang"] for i in held]) > 0.97


def test_language_odd_rows(spark):
    m = language.fit(["the cat and the dog", "der Hund und die Katze", "le chien et le chat"] * 10, ["en", "de", "fr"] * 10)
    df = spark.createDataFrame([*enumerate(ODD), (None, "der Hund")], "doc_id long, text string").withColumn("lang_pred", F.lit(1))
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df, m).collect()}
    assert [rows[i][0] == "und" for i in range(len(ODD))] == [True, True, True, False, False, False, False, False]
    assert rows[0][1] == 0 and all(0 <= s <= 1 for _, s in rows.values()) and rows[None][0] == "de" and rows[7][0] == "en"
    assert language.identify(df.limit(0), m).count() == 0
    assert language.fit([], []).predict(["a"]) == (["und"], [0.0])


def test_forward_backward_enumerated():
    rng = np.random.default_rng(0)
    k, n = 3, 4
    scores, start, move = rng.normal(size=(2, n, k)), rng.normal(size=k), rng.normal(size=(k, k))
    live = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool)
    post, pairs = language.forward_backward(scores, live, start, move, pairs=True)
    want_pairs = np.zeros((k, k))
    for c in range(2):
        size = live[c].sum()
        total, marginal, trans = 0.0, np.zeros((n, k)), np.zeros((k, k))
        for path in itertools.product(range(k), repeat=int(size)):
            w = np.exp(start[path[0]] + sum(scores[c, t, y] for t, y in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path)))
            total += w
            for t, y in enumerate(path):
                marginal[t, y] += w
            for a, b in itertools.pairwise(path):
                trans[a, b] += w
        assert np.allclose(post[c, :size], marginal[:size] / total)
        want_pairs += trans / total
    assert np.allclose(pairs, want_pairs)
