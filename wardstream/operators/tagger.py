"""A learned tagger of entities: an averaged perceptron over words, trained on spans by Spark, decoded by Viterbi.

Training is iterative: each task runs through its texts from the common weights, and what the tasks
changed is averaged by (feature, tag) in one aggregation; as many rounds as asked for. Features are hashed
into a fixed number of buckets, so the model has a proven size (buckets x tags), whatever the corpus holds,
and may be kept by the driver and sent to every task. Every labelled text is used, whole.

Texts are dealt out with their copies, equal texts with equal spans: a task takes one of each text, then one
more of each that has more, and so on. Once all were decoded right in a row, so are the rest, which are
passed over at once. So the weights are those of all rows, while a copied text costs what it has to teach;
where labels contradict each other, it costs a step for each copy, in one task. A task keeps what it has to
take again: of some 4,000,000 characters.

Texts that are null or empty have no spans. A text's words are one chain, whatever its length; memory grows
with a text's words times tags. Equal texts get equal spans. Ties go to the earlier tag.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stages import stage

#: Words, numbers and single signs, with their places in code points.
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:\.\d+)?|\S")
SPANS = "array<struct<start:int,end:int,label:string>>"
#: Below every score that weights can add up to.
NEVER = -1e18
#: Features of a word.
WIDTH = 14


@dataclass(frozen=True)
class Tagger:
    """tags: O first, then B- and I- of each label. emit: buckets x tags. move: (tags + 1) x tags, the last row for the start."""

    tags: tuple[str, ...]
    emit: np.ndarray
    move: np.ndarray


def tags_of(labels: list[str]) -> tuple[str, ...]:
    return ("O", *[k + x for x in sorted(labels) for k in ("B-", "I-")])


def allowed(tags: tuple[str, ...]) -> np.ndarray:
    """Zero where a tag may follow another (the last row: the start), NEVER where I- would follow anything but its own label."""
    out = np.zeros((len(tags) + 1, len(tags)))
    for j, t in enumerate(tags):
        if t.startswith("I-"):
            out[:, j] = NEVER
            out[[i for i, s in enumerate(tags) if s[2:] == t[2:] and s != "O"], j] = 0
    return out


@lru_cache(1 << 15)
def shape_of(word: str) -> str:
    """a for each letter, 0 for each digit, of the first twelve."""
    return re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "0", word[:12]))


def features(words: list[str], buckets: int) -> np.ndarray:
    """Buckets of each word's features: the word, its shape, its ends, its neighbours up to two words away, and pairs of them."""
    low = ["<<", "<", *[w.lower() for w in words], ">", ">>"]
    shape = [shape_of(w) for w in low]
    out = np.empty((len(words), WIDTH), np.int64)
    for i in range(len(words)):
        j = i + 2
        made = (
            "1" + low[j], "2" + shape[j], "3" + low[j][:3], "4" + low[j][-3:], "5" + low[j - 1], "6" + low[j + 1], "7" + low[j - 2], "8" + low[j + 2], "9" + shape[j - 1] + " " + shape[j], "a" + shape[j] + " " + shape[j + 1],
            "b" + low[j - 1] + " " + low[j], "c" + low[j] + " " + low[j + 1], "d" + low[j - 2] + " " + low[j - 1] + " " + shape[j], "e" + shape[j] + " " + low[j + 1] + " " + low[j + 2],
        )
        out[i] = [zlib.crc32(f.encode("utf-8", "surrogatepass")) % buckets for f in made]
    return out


def scored(weights: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Words x tags: the sums of the weights of each word's features, one feature after the other, as a text may have any number of words."""
    out = np.zeros((len(found), weights.shape[1]))
    for j in range(found.shape[1]):
        out += weights[found[:, j]]
    return out


def viterbi(emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best path of tags: emit is words x tags, move as in Tagger, with NEVER where a step isn't allowed."""
    n, k = emit.shape
    if not n:
        return np.zeros(0, np.int64)
    best, back = move[-1] + emit[0], np.empty((n, k), np.int16)
    for t in range(1, n):
        through = best[:, None] + move[:-1]
        back[t] = through.argmax(0)
        best = through[back[t], np.arange(k)] + emit[t]
    path = np.empty(n, np.int64)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def gold(words: list[tuple[int, int]], spans: list, at: dict[str, int]) -> np.ndarray:
    """Tags of words from spans; a word belongs to the first span, by place, that it overlaps, and opens it if it is its first word."""
    out, marked = np.zeros(len(words), np.int64), sorted(((s["start"], s["end"], s["label"]) for s in spans))
    i, opened = 0, -1
    for t, (a, b) in enumerate(words):
        while i < len(marked) and marked[i][1] <= a:
            i += 1
        if i < len(marked) and marked[i][0] < b:
            out[t] = at[("I-" if opened == i else "B-") + marked[i][2]]
            opened = i
    return out


def spans_of(words: list[tuple[int, int]], path: np.ndarray, tags: tuple[str, ...]) -> list[dict]:
    out = []
    for (a, b), g in zip(words, path):
        if g and tags[g][0] == "B":
            out.append({"start": a, "end": b, "label": tags[g][2:]})
        elif g:
            out[-1]["end"] = b
    return out


def copied(df: DataFrame, text: str, spans: str, key: str) -> DataFrame:
    """(text, spans, copies, key): each pair of a text and its spans once, with the number of its rows and the least hash of their keys."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.coalesce(F.col(spans), F.array()).alias("spans"), F.xxhash64(F.col(key).cast("string")).alias("key"))
    return stage(rows.groupBy("text", "spans").agg(F.count("*").alias("copies"), F.min("key").alias("key")))


def prepared(rows: DataFrame, tasks: int, tags: tuple[str, ...], buckets: int) -> DataFrame:
    """(key, copies, found, right): the features of a text's words and their tags, made once for all rounds."""
    at = {t: i for i, t in enumerate(tags)}

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            out = []
            for k, n, s, marks in zip(b["key"], b["copies"], b["text"], b["spans"]):
                found = [(x.start(), x.end(), x.group()) for x in TOKEN.finditer(s)]
                if found:
                    right = gold([x[:2] for x in found], marks, at)
                    out.append((k, n, features([x[2] for x in found], buckets).astype(np.int32).tobytes(), right.astype(np.int16).tobytes()))
            yield pd.DataFrame(out, columns=["key", "copies", "found", "right"])

    return stage(rows.repartition(tasks, "key").mapInPandas(read, "key long, copies long, found binary, right binary"))


def fitted(df: DataFrame, text: str, spans: str, key: str, rounds: int = 8, buckets: int = 1 << 15, rows_a_task: int = 25_000) -> Tagger:
    """A tagger from texts with arrays of struct(start, end, label). Equal rows give equal weights, however they are partitioned: texts are dealt by a hash of `key` and read in its order.

    A round's tasks hold some `rows_a_task` different texts each, or 160 times as many characters, and at least four share them. Without a single span every word is O.
    """
    texts = copied(df, text, spans, key)
    n, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    tasks = max(4, -(-n // rows_a_task), -(-size // (160 * rows_a_task)))
    labels = [r[0] for r in texts.select(F.explode(F.col("spans")["label"]).alias("l")).where("l IS NOT NULL").distinct().collect()]
    tags = tags_of(labels)
    k, bars = len(tags), allowed(tags)
    dealt = prepared(texts, tasks, tags, buckets).repartition(tasks, "key").sortWithinPartitions("key", "found", "right")
    emit, move, total_e, total_m = np.zeros((buckets, k)), np.zeros((k + 1, k)), np.zeros((buckets, k)), np.zeros((k + 1, k))

    for _ in range(rounds):
        sent = df.sparkSession.sparkContext.broadcast((emit, move))
        done = dealt.mapInPandas(_pass(sent, k, bars), "bucket long, weights array<double>, mean array<double>")
        each = [F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in ("weights", "mean") for i in range(k)]
        got = {r[0]: np.array(r[1:]) for r in done.groupBy("bucket").agg(*each).collect()}  # at most one row a bucket
        sent.unpersist()
        n = got.pop(-1, np.ones(2 * k))[0]
        emit, move = np.zeros_like(emit), np.zeros_like(move)
        for r, v in got.items():
            to, total, i = (emit, total_e, r) if r < buckets else (move, total_m, r - buckets)
            to[i] = v[:k] / n
            total[i] += v[k:] / n
    return Tagger(tags, total_e / max(rounds, 1), total_m / max(rounds, 1) + bars)


def _pass(sent, k: int, bars: np.ndarray):
    """A task's run through its texts, each as often as it has copies, in turn: its last weights and their mean over its steps, a row for each bucket in use, then one for each row of `move`, and -1 to count tasks."""

    def train(batches: Iterator) -> Iterator:
        import pandas as pd

        w, m = (x.copy() for x in sent.value)
        # what was added, times when it was: the mean over all steps is the last value less this by the steps
        late_w, late_m, step = np.zeros_like(w), np.zeros_like(m), 0

        def right(f: np.ndarray, y: np.ndarray) -> bool:
            """A step: decodes a text, and corrects the weights where that is wrong."""
            nonlocal step
            p = viterbi(scored(w, f), m + bars)
            if wrong := (p != y).any():
                for t in np.flatnonzero(p != y):
                    for d, g in ((1.0, y[t]), (-1.0, p[t])):
                        np.add.at(w, (f[t], g), d)
                        np.add.at(late_w, (f[t], g), d * step)
                for path, d in ((y, 1.0), (p, -1.0)):
                    before = np.concatenate(([k], path[:-1]))
                    np.add.at(m, (before, path), d)
                    np.add.at(late_m, (before, path), d * step)
            step += 1
            return not wrong

        again, clean = [], True
        for b in batches:
            for f, y, n in zip(b["found"], b["right"], b["copies"]):
                f, y = np.frombuffer(f, np.int32).reshape(-1, WIDTH), np.frombuffer(y, np.int16).astype(np.int64)
                clean &= right(f, y)
                if n > 1:
                    again.append((f, y, n - 1))
        while again and not clean:
            clean = all([right(f, y) for f, y, _ in again])
            again = [(f, y, n - 1) for f, y, n in again if n > 1]
        step += sum(n for *_, n in again)  # whose texts were all decoded right with weights that are those of now
        if step:
            mean_w, mean_m = w - late_w / step, m - late_m / step
            used = np.flatnonzero((w != 0).any(1) | (mean_w != 0).any(1))
            out = [(int(r), w[r].tolist(), mean_w[r].tolist()) for r in used]
            out += [(len(w) + i, m[i].tolist(), mean_m[i].tolist()) for i in range(k + 1)]
            yield pd.DataFrame([*out, (-1, [1.0] * k, [1.0] * k)], columns=["bucket", "weights", "mean"])

    return train


def tagged(df: DataFrame, text: str, model: Tagger, name: str = "entities") -> DataFrame:
    """df and an array of struct(start, end, label, text), in code points of the text, in their order; empty for null texts."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SPANS)
    def tag(col):
        m = sent.value

        def one(s):
            found = [(x.start(), x.end(), x.group()) for x in TOKEN.finditer(s or "")]
            if not found:
                return []
            f = features([x[2] for x in found], len(m.emit))
            return spans_of([x[:2] for x in found], viterbi(scored(m.emit, f), m.move), m.tags)

        return col.map(one, na_action=None)

    found = tag(F.col(text))
    return df.withColumn(name, F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), F.substr(F.col(text), s["start"] + 1, s["end"] - s["start"]).alias("text"))))


def agreement(df: DataFrame, found: str, marked: str) -> DataFrame:
    """(label, n_marked, n_found, n_both, precision, recall, f1) of spans that agree in place and label, null label for all."""
    bare = lambda n: F.coalesce(F.array_distinct(F.transform(F.col(n), lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"), s["label"].alias("label")))), F.array().cast(SPANS))
    d = df.select(bare(found).alias("f"), bare(marked).alias("m"))
    each = d.select(F.explode(F.array_union("f", "m")).alias("s"), "f", "m").select(F.col("s.label").alias("label"), F.array_contains("f", F.col("s")).cast("long").alias("f"), F.array_contains("m", F.col("s")).cast("long").alias("m"))
    a = each.rollup("label").agg(F.sum("m").alias("n_marked"), F.sum("f").alias("n_found"), F.sum(F.col("f") * F.col("m")).alias("n_both"))
    part = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return a.withColumns({"precision": part(F.col("n_both"), F.col("n_found")), "recall": part(F.col("n_both"), F.col("n_marked")), "f1": part(2 * F.col("n_both"), F.col("n_found") + F.col("n_marked"))})
