"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of itself and of its character n-grams, so that misspellings that
no one has seen share vectors with words that were. A window of words is the mean of its words, and
a linear softmax scores it; a text is as toxic as its worst window. Labels are known for texts, not
windows: training starts from all windows and then keeps, of each toxic text, those that score high.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import subwords
from .common import fitted, map_rows

WORDS = re.compile(r"[^\W_]+")
#: A task forgets its words beyond this many, so that its memory stays bounded.
REMEMBERED = 150_000


@dataclass(frozen=True)
class Settings:
    """What is fitted is a sample of labelled rows, chosen by a hash of their ids: of each class about `rows` texts and
    `volume` bytes at most, from texts of up to `longest` bytes. A chosen text is fitted as a whole."""

    rows: int = 2000
    volume: int = 2_500_000
    longest: int = 200_000
    buckets: int = 1 << 16
    dim: int = 4
    window: int = 16
    grams: tuple[int, int] = (3, 5)
    rounds: int = 2
    steps: int = 50
    rate: float = 0.1
    decay: float = 0.1
    seed: int = 11


def features(ws: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the words themselves and of their character n-grams, ends marked."""
    x = subwords.Words(ws)
    return subwords.buckets([x.whole(), *(x.grams(n) for n in range(s.grams[0], s.grams[1] + 1))], s.buckets)


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def numbered(texts: list[str | None], known: dict[str, int]) -> list[np.ndarray]:
    """Each text's words as numbers; new ones are added to known."""
    return [np.array([known.setdefault(w, len(known)) for w in words(t)], np.int32) for t in texts]


def window_sums(d: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """For each window of k words of d the sum of its words' values; a word that a window repeats counts once in it."""
    n = len(d)
    order = np.argsort(d, kind="stable")
    before = np.full(n, -1)
    again = d[order[1:]] == d[order[:-1]]
    before[order[1:][again]] = order[:-1][again]
    at = np.arange(n)
    v = value[d]
    # a word counts in the windows that begin after its last use and hold it
    change = np.bincount(np.maximum(before + 1, np.maximum(at - k + 1, 0)), v, n + 1) - np.bincount(at + 1, v, n + 1)
    return np.cumsum(change)[: max(1, n - k + 1)]


def group_sum(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(index, values[:, k], n) for k in range(values.shape[1])], 1)


class Model:
    """embed: a vector for each bucket; out: the softmax' weights by class; scale and shift: from a window's logit to a text's."""

    def __init__(self, s: Settings):
        rng = np.random.default_rng(s.seed)
        self.s, self.embed, self.out = s, rng.normal(0, 0.1, (s.buckets, s.dim)), rng.normal(0, 0.5, (s.dim, 2))
        self.bias, self.scale, self.shift, self.known = np.zeros(2), 1.0, 0.0, {}

    def ready(self) -> Model:
        self.one, self.known = self.embed @ (self.out[:, 1] - self.out[:, 0]), {}
        return self

    def bare(self) -> Model:
        """What scoring needs."""
        m = Model.__new__(Model)
        m.s, m.one, m.bias, m.scale, m.shift, m.known = self.s, self.one, self.bias, self.scale, self.shift, {}
        return m

    def learn_words(self, used: dict[str, int]) -> None:
        """Remembers the share of each word in a window's logit."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [w for w in used if w not in self.known]
        if new:
            f, w = features(new, self.s)
            n = len(new)
            self.known |= zip(new, (np.bincount(w, self.one[f], n) / np.bincount(w, minlength=n)).tolist(), strict=True)

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """The highest logit of any window of each text; texts shorter than a window are padded with empty words."""
        k, used = self.s.window, {}
        docs = numbered(texts, used)
        self.learn_words(used)
        value = np.fromiter(map(self.known.__getitem__, used), float, len(used))
        out = [window_sums(d, value, k).max() for d in docs]
        return np.array(out) / k + self.bias[1] - self.bias[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.worst(texts) + self.shift, -40, 40)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


class Words:
    """The words of the texts fitted: their buckets end to end, and how many each has."""

    def __init__(self, known: dict[str, int], s: Settings):
        every, step = list(known), 20_000  # in parts, which bounds what hashing needs beside its result
        found = [(f.astype(np.int32), (w + a).astype(np.int32)) for a in range(0, len(every), step) for f, w in [features(every[a : a + step], s)]]
        self.bucket, self.word_of = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        self.size = np.bincount(self.word_of, minlength=len(known))

    def of(self, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, position in used) of these words, which are sorted."""
        place = np.full(len(self.size), -1, np.int32)
        place[used] = np.arange(len(used))
        at = place[self.word_of]
        mask = at >= 0
        return self.bucket[mask], at[mask]


def half_windows(docs: list[np.ndarray], s: Settings, empty: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, text of each): windows that overlap by half. Words beyond the end are empty, and so are a word's repetitions within a window."""
    half = s.window // 2
    starts = [np.arange(0, max(1, len(d) - half), half) for d in docs]
    spans, at = np.full((sum(map(len, starts)), s.window), empty, np.int32), 0
    for d, a in zip(docs, starts, strict=True):
        for x in a.tolist():
            w = d[x : x + s.window]
            spans[at, : len(w)] = w
            at += 1
    again = np.zeros(spans.shape, bool)
    for d in range(1, s.window):
        again[:, d:] |= spans[:, d:] == spans[:, :-d]
    spans[again] = empty
    return spans, np.repeat(np.arange(len(docs)), list(map(len, starts)))


def gradients(m: Model, words: Words, win: np.ndarray, want: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss of these windows, both classes weighing alike, and its derivatives by embeddings, weights and biases."""
    s, empty = m.s, len(words.size)
    used, at = np.unique(win, return_inverse=True)
    used_words = used[used < empty]
    f, w = words.of(used_words)
    vec = group_sum(w, m.embed[f], len(used_words)) / words.size[used_words, None]
    vec = np.concatenate([vec, np.zeros((len(used) - len(used_words), s.dim))])
    bag = vec[at.reshape(win.shape)].mean(1)
    z = bag @ m.out + m.bias
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    weight = np.where(want == 1, 0.5 / max(1, (want == 1).sum()), 0.5 / max(1, (want == 0).sum()))
    loss = -(weight * np.log(p[np.arange(len(want)), want])).sum() + s.decay * (m.embed**2).sum() / 2 / s.buckets
    g = (p - np.eye(2)[want]) * weight[:, None]
    d_bag = (g @ m.out.T) / s.window
    d_vec = group_sum(at.ravel(), np.repeat(d_bag, s.window, 0), len(used))[: len(used_words)] / words.size[used_words, None]
    return float(loss), {"embed": group_sum(f, d_vec[w], s.buckets) + s.decay * m.embed / s.buckets, "out": bag.T @ g, "bias": g.sum(0)}


def fit(texts: list[str | None], labels: list[int], s: Settings = Settings()) -> Model:
    """Trains on the given texts; one text in four only sets scale and shift."""
    y = np.array(labels, int)
    m = Model(s)
    if len(set(labels)) < 2:  # nothing to tell apart: the share of label 1
        m.embed[:] = 0
        m.shift = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return m.ready()
    known: dict[str, int] = {}
    docs = numbered(texts, known)
    parts = Words(known, s)
    spans, doc_of = half_windows(docs, s, len(known))
    used = np.arange(len(y)) % 4 != 3
    rng = np.random.default_rng(s.seed)
    keep = used[doc_of]
    moment = {k: [np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))] for k in ("embed", "out", "bias")}
    t = 0
    for _ in range(s.rounds):
        rows = np.flatnonzero(keep)
        pos, neg = rows[y[doc_of[rows]] == 1], rows[y[doc_of[rows]] == 0]
        for _ in range(s.steps):
            t += 1
            part = np.concatenate([rng.choice(x, min(len(x), 2000), False) for x in (pos, neg)])
            for k, grad in gradients(m, parts, spans[part], y[doc_of[part]])[1].items():  # Adam
                a, b = moment[k]
                a += 0.1 * (grad - a)
                b += 0.01 * (grad**2 - b)
                setattr(m, k, getattr(m, k) - s.rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8))
        m.ready()
        of_word = np.append(np.bincount(parts.word_of, m.one[parts.bucket], len(known)) / parts.size, 0.0)
        value = np.concatenate([of_word[spans[a : a + 20_000]].mean(1) for a in range(0, len(spans), 20_000)]) + m.bias[1] - m.bias[0]
        top = np.full(len(y), -np.inf)
        np.maximum.at(top, doc_of, value)
        # of toxic texts, the windows near the worst one; of the others, all
        keep = used[doc_of] & ((y[doc_of] == 0) | (value >= top[doc_of] - 0.3 * np.abs(top[doc_of])) & (value > 0) | (value == top[doc_of]))
    m.ready()
    held = [i for i in range(len(y)) if not used[i]]
    m.scale, m.shift = calibrated(m.worst([texts[i] for i in held]), y[held])
    return m


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Scale and shift of a logistic curve through (x, y) by Newton's steps, drawn a little to 1 and 0."""
    a, b = 1.0, 0.0
    spread = max(1e-6, float(np.std(x))) if len(x) else 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        w = p * (1 - p)
        g = np.array([((p - y) * x).sum() + ridge * 1e-2 * (a - 1), (p - y).sum() + ridge * 1e-2 * b])
        h = np.array([[(w * x * x).sum() + ridge * 1e-2, (w * x).sum()], [(w * x).sum(), w.sum() + ridge * 1e-2]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step * np.array([spread, 1.0])).max()))
        a, b = max(0.05, a - step[0]), b - step[1]
    return float(a), float(b)


def sample(docs: DataFrame, labels: DataFrame, learn: Column, s: Settings, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(key, t, y): texts and labels of the rows to fit, bounded as Settings says; the ids chosen are few enough to broadcast.

    Rows of null id or label are left out; of an id with several labels the highest counts. How many
    rows and bytes there are in each class is counted over all of them.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & learn).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    size = F.coalesce(F.octet_length(text_col), F.lit(0))
    have = docs.select(F.col(id_col).alias("i"), size.alias("size")).where(F.col("size") <= s.longest).join(known, "i").groupBy("y").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    share = {r["y"]: min(s.rows / max(1, r["n"]), s.volume / max(1, r["bytes"])) for r in have.collect()}
    part = F.pmod(F.xxhash64(F.col("i").cast("string"), F.lit(s.seed)), F.lit(1_000_000)) / 1e6
    most = F.create_map(*[F.lit(float(x)) for y in (0, 1) for x in (y, share.get(y, 0))])
    ids = known.where(part < most[F.col("y").cast("double")])
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), size.alias("size")).where(F.col("size") <= s.longest)
    return rows.join(F.broadcast(ids), "i").select(F.crc32(F.col("i").cast("string").cast("binary")).alias("key"), "t", "y")


def fit_sample(docs: DataFrame, labels: DataFrame, learn: Column, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """The model of a bounded sample, fitted in one task of an executor."""
    return fitted(sample(docs, labels, learn, s, id_col, text_col, label_col), lambda rows: fit([t for _, t, _ in rows], [y for *_, y in rows], s).bare())


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, predicted. Whole texts; a null or empty text is a window of empty words.

    Equal texts get equal scores, whatever their ids; repeated rows are scored each, and a null id
    stays. The model, whose size doesn't depend on the data, goes to the tasks. Other columns,
    whatever their names, are not read.
    """
    held, made = docs.sparkSession.sparkContext.broadcast(model.bare()), []

    def rows(batch):
        if not made:
            made.append(held.value.bare())  # the words that a task remembers go with it
        score = made[0].scores(batch.column(1).to_pylist()).tolist()
        return {id_col: batch.column(0), "score": score, "predicted": [int(x >= threshold) for x in score]}

    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return map_rows(docs.select(id_col, F.col(text_col)), rows, schema, 500)
