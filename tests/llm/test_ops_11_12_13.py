"""Operators 11, 12 and 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardstream.llm import periodic, resampling, winnowing
from wardstream.llm.queries import op11_resample, op12_periodic_runs, op13_fingerprints

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD_11 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ODD = [None, "", " \t\n", "a", "naïve  CAFÉ İ ﬁ é\x80 x", "x" * 5000, "日本語テキスト🙂🙂", "\x00 a\x00b", "ha " * 40, "a b c " * 30 + "d", "very long text " * 30_000]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def texts_of(spark, sf_dir, name="documents", key="doc_id"):
    return [(r[key], r["text"]) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 11 ----------------------------------------------------------------------------------------------


def brute_resample(docs, target, high=1, buckets=10_000, least=20, share=(10, 100)):
    def features(text):
        w = re.findall(WORD_11, lowered(text))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, high + 1) for i in range(len(w) - k + 1)]

    each = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in each for b in f), Counter(b for x in target for b in features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, n, f in each:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    rank = {id(r): k for k, r in enumerate(fit[: share[0] * len(fit) // share[1]], 1)}
    return sorted(((i, n, w, sc, rank.get(id(r))) for r in out for i, _, n, w, sc in [r]), key=repr)


def test_resample_equals_brute_force(spark, sf_dir):
    got = op11_resample(spark, sf_dir)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    rows = got.collect()
    assert sorted(map(tuple, rows), key=repr) == brute_resample(texts_of(spark, sf_dir), [t for _, t in texts_of(spark, sf_dir, "benchmark", "item_id")])
    assert sum(r["rank"] is not None for r in rows) > 10


def test_resample_runs_of_words_ties_and_odd_rows(spark):
    rows = [*enumerate(ODD), (None, "q " * 25), (None, "q " * 25), (7, "b " * 21), (7, "b " * 21), (8, "A b C d " * 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("buckets", F.lit(1))
    aim = spark.createDataFrame([("a b c d",), (None,), ("",)], "text string")
    for high, share in ((1, (10, 100)), (3, (50, 100)), (2, (100, 100))):
        got = resampling.resample(df, aim, high=high, buckets=97, share=share).collect()
        assert sorted(map(tuple, got), key=repr) == brute_resample(rows, ["a b c d", None, ""], high, 97, share=share)
    assert resampling.resample(df.limit(0), aim).count() == 0
    assert [r["weight"] < 0 for r in resampling.resample(df, aim.limit(0)).where("n_features > 100").collect()]


def test_splitter_forgets_and_keeps_its_words(monkeypatch):
    monkeypatch.setattr(resampling, "REMEMBERED", 3)
    s = resampling.Splitter(1, 1, 100)
    for t in ("a-b c.d E f g h", "a-b x", "", "--- a-b a-b"):
        assert s.words(t) == [w.encode() for w in re.findall(WORD_11, lowered(t))]


# 12 ----------------------------------------------------------------------------------------------


def brute_runs(x):
    """Maximal stretches for each period; smaller periods go first, so a stretch that one of them fills is known."""
    n, out = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(p < q and a <= i and i + length <= a + m and q % p == 0 for a, m, p in out):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted_words(key, words):
    h = zlib.crc32(str(key).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]


def test_runs_equal_brute_force(spark, sf_dir):
    got, some = {r["doc_id"]: r for r in op12_periodic_runs(spark, sf_dir).collect()}, 0
    for key, text in texts_of(spark, sf_dir):
        words = planted_words(key, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        runs, r = brute_runs(words), got[key]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (best[0] is not None and 1000 * best[1] // best[2] or None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
        some += len(runs) > 0
    assert some > 5


def test_runs_of_random_texts():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, letters = rng.choice([0, 1, 5, 20, 60, 150]), rng.choice([1, 2, 3, 30])
            w = [rng.randrange(letters) for _ in range(n)]
            for _ in range(rng.randint(0, 3) if n else 0):
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 4))
                for i in range(a, rng.randint(a, n)):
                    w[i] = w[a + (i - a) % p]
            texts.append([b"%d" % v for v in w])
        assert periodic.runs_of(texts) == [brute_runs(t) for t in texts]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 400:
        a, b = b, b + a
    assert periodic.runs_of([b]) == [brute_runs(b)]
    with pytest.raises(ValueError):
        periodic.runs_of([b], exponent=3)


def test_runs_of_odd_rows(spark):
    df = documents(spark, [*ODD, "ha " * 40]).withColumn("runs", F.lit(1))
    rows = {r["doc_id"]: r for r in periodic.periodic_runs(df).collect()}
    assert all(rows[i]["runs"] == [] for i in range(8)) and rows[0]["collapsed"] == rows[1]["collapsed"] == rows[2]["collapsed"] == ""
    assert [tuple(r) for r in rows[8]["runs"]] == [(0, 40, 1)] == [tuple(r) for r in rows[11]["runs"]] and rows[8]["collapsed"] == "ha"
    assert [tuple(r) for r in rows[9]["runs"]] == [(0, 90, 3)] and rows[9]["collapsed"] == "a b c d"
    assert [tuple(r) for r in rows[10]["runs"]] == [(0, 90_000, 3)] and rows[10]["collapsed"] == "very long text"
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    got = df.select(F.array().cast(periodic.RUNS).alias("r")).select(periodic.longest_run(F.col("r")).alias("x"), periodic.runs_text(F.col("r")).alias("t")).first()
    assert got["x"] is None and got["t"] == ""


# 13 ----------------------------------------------------------------------------------------------


def brute_prints(text, k=winnowing.GRAM, window=winnowing.WINDOW):
    def gram(s):
        h = 0
        for c in s:
            h = (h * winnowing.BASE + ord(c) + 1) % (1 << 64)
        h = (h ^ (h >> 33)) * 0xFF51AFD7ED558CCD % (1 << 64)
        h = (h ^ (h >> 29)) * 0xC4CEB9FE1A85EC53 % (1 << 64)
        return h >> 32

    if not text:
        return []
    k = min(k, len(text))
    h = [gram(text[i : i + k]) for i in range(len(text) - k + 1)]
    w = min(window, len(h))
    at = sorted({max(j for j in range(i, i + w) if h[j] == min(h[i : i + w])) for i in range(len(h) - w + 1)})
    return [(p, h[p]) for p in at]


def brute_compare(rows):
    rows = sorted(rows, key=lambda r: r[1] or "")
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    alike = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
    out = []
    for k, (key, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        new = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        a, b, c = (brute_prints(t) for t in (text, new, after))
        shown = ["".join(f"{h:08x}{p - q:02x}" for (p, h), q in zip(x, [0, *(p for p, _ in x)])) for x in (a, b)]
        a, b, c = ({h for _, h in x} for x in (a, b, c))
        out.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), *shown, alike(a, b), alike(a, c)))
    return sorted(out, key=repr)


def test_fingerprints_equal_brute_force(spark, sf_dir, monkeypatch):
    docs = [(i, (t or "")[-700:]) for i, t in texts_of(spark, sf_dir)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    want = brute_compare(docs)
    for size in (winnowing.RANGE_BYTES, 5_000, 1):
        monkeypatch.setattr(winnowing, "RANGE_BYTES", size)
        assert sorted(map(tuple, winnowing.compare_edited(df).collect()), key=repr) == want


def test_fingerprints_of_whole_texts(spark, sf_dir):
    docs = dict(texts_of(spark, sf_dir))
    rows = {r["doc_id"]: r for r in op13_fingerprints(spark, sf_dir).collect()}
    ids = sorted(docs, reverse=True)
    assert sorted(rows) == sorted(docs)
    for k, i in enumerate(ids):
        t, after, r = docs[i] or "", docs[ids[(k + 1) % len(ids)]] or "", rows[i]
        new = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r["fingerprint"] == winnowing.printed(*winnowing.prints(t)) and r["edited_fingerprint"] == winnowing.printed(*winnowing.prints(new))
    long = [r for r in rows.values() if r["n_chars"] > 600]
    assert sorted(r["near_edited"] for r in long)[len(long) // 10] > 0.5 and sorted(r["near_next"] for r in long)[len(long) // 2] < 0.2


def test_shared_passages_share_a_print():
    rng, least = random.Random(3), winnowing.GRAM + winnowing.WINDOW - 1
    word = lambda n: "".join(rng.choice("abcdefgh ü🙂") for _ in range(n))
    for _ in range(200):
        shared = word(least)
        a, b = (word(rng.randrange(300)) + shared + word(rng.randrange(300)) for _ in range(2))
        (pa_, ha), (pb, hb) = winnowing.prints(a), winnowing.prints(b)
        ia, ib = a.index(shared), b.index(shared)
        inside = lambda p, h, i: {(int(x) - i, int(y)) for x, y in zip(p, h) if i <= x <= i + least - winnowing.GRAM}
        assert inside(pa_, ha, ia) & inside(pb, hb, ib)


def test_fingerprints_of_odd_rows(spark):
    rows = [(3, None), (None, "x" * 100), (None, None), (3, "tie " * 20), (3, "tie " * 20), (9, ""), (1, "ab"), (2, "日本語🙂" * 40), (2, "w " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("range", F.lit(1))
    want = brute_compare([r for r in rows if len(r[1] or "") < 1000])
    assert sorted(map(tuple, winnowing.compare_edited(df.where("text IS NULL OR length(text) < 1000")).collect()), key=repr) == want
    assert winnowing.compare_edited(df).count() == len(rows)
    for few in (rows[:1], rows[2:3], rows[6:7], [(None, "a" * 50), (None, "b" * 50)]):
        assert sorted(map(tuple, winnowing.compare_edited(spark.createDataFrame(few, "doc_id long, text string")).collect()), key=repr) == brute_compare(few)
    assert winnowing.compare_edited(df.limit(0)).count() == 0 and winnowing.fingerprints(df.limit(0)).count() == 0
    made = winnowing.fingerprints(df).where("doc_id = 2 AND n_chars = 160").first()
    assert [*zip(made["positions"], made["hashes"])] == brute_prints("日本語🙂" * 40)
    texts = spark.createDataFrame([("b", "q" * 90), ("a", "r" * 90), ("é", "s" * 90)], "doc_id string, text string")
    assert {r["doc_id"]: r["edited_sha256"] for r in winnowing.compare_edited(texts).collect()}["é"] == hashlib.sha256(("s" * 60 + "q" * 30).encode()).hexdigest()
