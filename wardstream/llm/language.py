"""Language identification by a linear-chain conditional random field over the words of a text.

A word's features are itself, its affixes, its character n-grams and the lexicons that list it;
together with learned transitions between neighbouring words they label the words of code-switched
text by forward-backward. A text's language is the one with the highest mean marginal.
"""

from __future__ import annotations

import copy
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from . import subwords
from .common import fitted, map_rows

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
#: A task forgets its words beyond this many, so that its memory stays bounded.
REMEMBERED = 150_000


@dataclass(frozen=True)
class Settings:
    """What is fitted is a sample of labelled rows, chosen by a hash of their ids: of each language about `rows` texts and
    `volume` bytes at most, from texts of up to `longest` bytes. A chosen text is fitted as a whole."""

    rows: int = 400
    volume: int = 800_000
    longest: int = 50_000
    buckets: int = 1 << 16
    chain: int = 64
    lexicon: int = 200
    epochs: int = 3
    batch: int = 400
    rate: float = 0.2
    seed: int = 5


def words(text: str | None) -> list[str]:
    """Runs of letters; what counts as a number only, such as ½ or ①, is no letter."""
    found = LETTERS.findall(text.lower()) if text else []
    return found if all(map(str.isalpha, found)) else [x for w in found for x in ("".join(c if c.isalpha() else " " for c in w).split())]


def features(ws: list[str], lexicon: dict[str, list[int]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of the words themselves, their affixes, n-grams and lexicons."""
    x = subwords.Words(ws)
    listed = [(k, i) for i, w in enumerate(ws) for k in lexicon.get(w, ())]
    lists = np.array(listed, np.int64).reshape(-1, 2)
    return subwords.buckets([x.whole(), *x.affixes(3), *x.affixes(4), x.grams(2), x.grams(3), (subwords.mixed(lists[:, 0].astype(np.uint64), 300), lists[:, 1])], s.buckets)


def forward_backward(scores: np.ndarray, live: np.ndarray, start: np.ndarray, move: np.ndarray, pairs: bool = False):
    """Marginals of chains (chain, position, label), and on request the expected transitions.

    scores are of words, live says which positions hold one: words first, padding after them.
    """
    n, length, k = scores.shape
    emit = np.exp(scores - scores.max(2, keepdims=True))
    a = np.exp(move - move.max())
    alpha, beta = np.empty_like(emit), np.ones_like(emit)
    x = np.exp(start - start.max()) * emit[:, 0]
    alpha[:, 0] = x / x.sum(1, keepdims=True)
    for t in range(1, length):
        x = (alpha[:, t - 1] @ a) * emit[:, t]
        alpha[:, t] = np.where(live[:, t, None], x / x.sum(1, keepdims=True), alpha[:, t - 1])
    for t in range(length - 2, -1, -1):
        x = (emit[:, t + 1] * beta[:, t + 1]) @ a.T
        beta[:, t] = np.where(live[:, t + 1, None], x / x.sum(1, keepdims=True), 1.0)
    post = alpha * beta
    post /= post.sum(2, keepdims=True)
    if not pairs:
        return post
    both = alpha[:, :-1, :, None] * a * (emit * beta)[:, 1:, None, :]
    both /= both.sum((2, 3), keepdims=True)
    return post, (both * live[:, 1:, None, None]).sum((0, 1))


class Model:
    def __init__(self, s: Settings, labels: list[str], lexicon: dict[str, list[int]]):
        k = max(1, len(labels))
        self.s, self.labels, self.lexicon = s, labels, lexicon
        self.weight, self.start, self.move = np.zeros((s.buckets, k)), np.zeros(k), np.zeros((k, k))
        self.ready()

    def ready(self) -> Model:
        self.known, self.fresh, self.table = {}, [], np.zeros((1024, len(self.start)))
        return self

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "fresh", "table")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.ready()

    def number(self, w: str) -> int:
        i = self.known.get(w)
        if i is None:
            i = self.known[w] = len(self.known)
            self.fresh.append(w)
        return i

    def settle(self) -> None:
        """Scores of the words that are new since the last call."""
        if self.fresh:
            n, new = len(self.known), len(self.fresh)
            while len(self.table) < n:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            f, w = features(self.fresh, self.lexicon, self.s)
            for k in range(self.table.shape[1]):
                self.table[n - new : n, k] = np.bincount(w, self.weight[f, k], new)
            self.fresh = []

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A text without letters is `und` with score 0; so is every text if nothing was learned."""
        if len(self.known) > REMEMBERED:
            self.ready()
        docs = [np.fromiter(map(self.number, ws := words(t)), np.int64, len(ws)) for t in texts]
        self.settle()
        sizes = np.array([len(d) for d in docs], np.int64)
        c, k = self.s.chain, len(self.start)
        sums = np.zeros((len(docs), k))
        if len(self.labels) and sizes.sum():
            flat = np.concatenate(docs)
            chains = -(-sizes // c)
            doc = np.repeat(np.arange(len(docs)), chains)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(chains) - chains, chains)
            first = np.repeat(np.cumsum(sizes) - sizes, chains) + nth * c
            held = np.minimum(c, np.repeat(sizes, chains) - nth * c)
            for a in range(0, len(doc), 4096):
                live = np.arange(c) < held[a : a + 4096, None]
                at = np.where(live, first[a : a + 4096, None] + np.arange(c), 0)
                post = forward_backward(self.table[flat[at]], live, self.start, self.move) * live[:, :, None]
                np.add.at(sums, doc[a : a + 4096], post.sum(1))
        best = sums.argmax(1)
        found = (sizes > 0) & (sums.sum(1) > 0)
        return [self.labels[b] if f else UNKNOWN for b, f in zip(best, found, strict=True)], [min(1.0, float(sums[i, b] / sizes[i])) if f else 0.0 for i, (b, f) in enumerate(zip(best, found, strict=True))]


def fit(texts: list[str | None], langs: list[str], s: Settings = Settings()) -> Model:
    """Trains on texts that are mostly in one language each; half of the chains are joined from two texts, so that switches are seen."""
    labels = sorted(set(langs))
    number = {x: i for i, x in enumerate(labels)}
    docs = [(words(t), number[y]) for t, y in zip(texts, langs, strict=True)]
    docs = [(d, y) for d, y in docs if d]
    heard = [Counter() for _ in labels]
    for d, y in docs:
        heard[y].update(set(d))
    lexicon: dict[str, list[int]] = {}
    for k, own in enumerate(heard):
        for w, _ in sorted(own.items(), key=lambda x: (-x[1], x[0]))[: s.lexicon]:
            lexicon.setdefault(w, []).append(k)
    m = Model(s, labels, lexicon)
    if len(labels) < 2 or not docs:
        return m
    rng = np.random.default_rng(s.seed)
    known: dict[str, int] = {}
    half = 16
    pieces = [(np.array([known.setdefault(w, len(known)) for w in d[a : a + half]]), y) for d, y in docs for a in range(0, len(d), half)]
    flat, word_of = features(list(known), lexicon, s)
    k = len(labels)
    adapt = [np.full((s.buckets, k), 1e-6), np.full(k, 1e-6), np.full((k, k), 1e-6)]
    for _ in range(s.epochs):
        order = rng.permutation(len(pieces))
        # the next piece is another text's, or as often the same piece once more
        after = np.where(rng.random(len(pieces)) < 0.5, order, rng.permutation(len(pieces)))
        for a in range(0, len(order), s.batch):
            part = list(zip(order[a : a + s.batch], after[a : a + s.batch], strict=True))
            ids, want, live = (np.zeros((len(part), 2 * half), np.int64) for _ in range(3))
            for r, (i, j) in enumerate(part):
                (d, y), (e, z) = pieces[i], pieces[j]
                row = np.concatenate([d, e])
                ids[r, : len(row)], live[r, : len(row)] = row, 1
                want[r, : len(d)], want[r, len(d) : len(row)] = y, z
            live = live.astype(bool)
            used, at = np.unique(ids, return_inverse=True)
            chosen = np.zeros(len(known), bool)
            chosen[used] = True
            mask = chosen[word_of]
            f, w = flat[mask], np.searchsorted(used, word_of[mask])
            scores = np.stack([np.bincount(w, m.weight[f, c], len(used)) for c in range(k)], 1)[at.reshape(ids.shape)]
            post, moved = forward_backward(scores, live, m.start, m.move, pairs=True)
            truth = np.eye(k)[want]
            pair = np.zeros((k, k))
            np.add.at(pair, (want[:, :-1][live[:, 1:]], want[:, 1:][live[:, 1:]]), 1)
            off = ((post - truth) * live[:, :, None]) / len(part)
            word_off = np.stack([np.bincount(at.ravel(), off[:, :, c].ravel(), len(used)) for c in range(k)], 1)
            grads = [np.stack([np.bincount(f, word_off[w, c], s.buckets) for c in range(k)], 1), off[:, 0].sum(0), (moved - pair) / len(part)]
            for value, sq, g in zip((m.weight, m.start, m.move), adapt, grads, strict=True):  # Adagrad
                sq += g * g
                value -= s.rate * g / np.sqrt(sq)
    return m.ready()


def sample(docs: DataFrame, learn: Column, s: Settings, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(key, t, y): the rows to fit, bounded as Settings says; null languages and texts are left out.

    How many rows and bytes there are of each language is counted over all of them. Languages are few
    by nature: one row for each comes to the driver.
    """
    size = F.octet_length(text_col)
    known = docs.where(F.col(lang_col).isNotNull() & (size <= s.longest) & learn).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("y"))
    have = known.groupBy("y").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("bytes")).collect()
    share = {r["y"]: min(s.rows / r["n"], s.volume / max(1, r["bytes"])) for r in have}
    most = F.create_map(*[F.lit(x) for y in sorted(share) for x in (y, float(share[y]))]) if share else F.create_map(F.lit(""), F.lit(0.0))
    part = F.pmod(F.xxhash64("i", F.lit(s.seed)), F.lit(1_000_000)) / 1e6
    return known.where(part < most[F.col("y")]).select(F.crc32(F.coalesce("i", F.lit("")).cast("binary")).alias("key"), "t", "y")


def fit_sample(docs: DataFrame, learn: Column, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of a bounded sample, fitted in one task of an executor."""
    return fitted(sample(docs, learn, s, id_col, text_col, lang_col), lambda rows: fit([t for _, t, _ in rows], [y for *_, y in rows], s))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (mean marginal of the predicted language over all words).

    Whole texts, cut into chains of at most Settings.chain words. A null text, or one without a
    letter, is `und` with score 0; of languages that are equally likely the first by name is taken.
    Equal texts get equal answers, whatever their ids; repeated rows get one each, and a null id
    stays. The model, whose size doesn't depend on the data, goes to the tasks. Other columns,
    whatever their names, are not read.
    """
    held, made = docs.sparkSession.sparkContext.broadcast(model), []

    def rows(batch):
        if not made:
            made.append(copy.copy(held.value).ready())  # the words that a task remembers go with it
        lang, score = made[0].predict(batch.column(1).to_pylist())
        return {id_col: batch.column(0), "lang_pred": lang, "score": score}

    schema = StructType([StructField(id_col, docs.schema[id_col].dataType), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return map_rows(docs.select(id_col, F.col(text_col)), rows, schema, 500)
