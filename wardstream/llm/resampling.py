"""Importance resampling towards a target distribution over hashed words.

A word split that needs no training, the `tokenizers` library's Regex Split, cuts the ASCII-lowered
text into words with offsets. Features are windows over those offsets: runs of consecutive words,
from the first one's start to the last one's end in the words' joined text. Their CRC buckets form
one histogram of the raw and one of the target texts; a bucket's gain compares the two, a
document's weight is the mean gain of its features, and Gumbel noise on the weights turns the
highest scores into a sample without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .common import all_of, map_rows, written

#: Fixed value: a word is a run of anything but ASCII characters that are neither digits nor letters.
SPLIT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A task forgets the pieces between spaces that it has split once it holds this many.
REMEMBERED = 150_000


class Splitter:
    """Words and features of texts; built on a worker."""

    def __init__(self, low: int, high: int, buckets: int):
        from tokenizers import Regex, pre_tokenizers

        self.low, self.high, self.buckets, self.known = low, high, buckets, {}
        self.split = pre_tokenizers.Split(Regex(SPLIT), "removed", invert=True).pre_tokenize_str

    def words(self, text: str) -> list[bytes]:
        """No word holds a space, so that a piece between spaces that recurs is split once."""
        known, pieces = self.known, text.encode("utf-8", "surrogatepass").translate(LOWER).split(b" ")
        fresh = list({p for p in pieces if p not in known})
        if fresh:
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
                fresh = list(set(pieces))
            known.update(self.split_all(fresh))
        out = list(chain.from_iterable(map(known.__getitem__, pieces)))
        if len(known) > REMEMBERED:  # one text has more
            known.clear()
        return out

    def split_all(self, pieces: list[bytes]) -> dict[bytes, tuple[bytes, ...]]:
        """All pieces are split as one text, and the offsets tell which piece a word came from."""
        found = [[] for _ in pieces]
        texts = [p.decode("utf-8", "surrogatepass") for p in pieces]
        edge = np.cumsum([len(t) + 1 for t in texts])
        words = self.split(" ".join(texts))
        home = np.searchsorted(edge, np.array([start for _, (start, _) in words], np.int64), "right")
        for k, (w, _) in zip(home.tolist(), words, strict=True):
            found[k].append(w.encode("utf-8", "surrogatepass"))
        return dict(zip(pieces, map(tuple, found), strict=True))

    def features(self, words: list[bytes]) -> Iterator[bytes]:
        """Runs of low to high words as slices of the joined words: from offset to offset."""
        if self.low <= 1:
            yield from words
        if self.high > 1:
            joined = b" ".join(words)
            end = np.cumsum([len(w) + 1 for w in words]) - 1
            start = (end - [len(w) for w in words]).tolist() if words else []
            for k in range(max(2, self.low), self.high + 1):
                yield from (joined[a:b] for a, b in zip(start, end[k - 1 :].tolist(), strict=False))

    def counted(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """(words, buckets, how often each occurs)."""
        words = self.words(text) if text else []
        at = np.fromiter((zlib.crc32(f) for f in self.features(words)), np.int64) % self.buckets
        return len(words), *np.unique(at, return_counts=True)


def bucket_counts(df: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_features, and its features' distinct buckets with their counts. Null and empty texts have none."""
    made = []

    def rows(batch):
        if not made:
            made.append(Splitter(low, high, buckets))
        each = [made[0].counted(t) for t in batch.column(1).to_pylist()]
        ends = pa.array(np.cumsum([0, *[len(b) for _, b, _ in each]]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *[x[i] for x in each]]), pa.int32())) for i in (1, 2)]
        return {"id": batch.column(0), "n_words": [n for n, _, _ in each], "n_features": [int(c.sum()) for _, _, c in each], "buckets": lists[0], "counts": lists[1]}

    ints = ArrayType(IntegerType())
    schema = StructType([
        StructField("id", df.schema[id_col].dataType), StructField("n_words", LongType()), StructField("n_features", LongType()), StructField("buckets", ints), StructField("counts", ints),
    ])
    return map_rows(df.select(id_col, F.col(text_col)), rows, schema, 500)


def flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def histogram(counted: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Features in each bucket: a task adds up its rows, and the driver gets one row per bucket."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            np.add.at(total, flat(b.column(0)), flat(b.column(1)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    rows = counted.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of each bucket's share, one added to each count."""
    s_all, t_all = float(raw.sum() + len(raw)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def weights(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean gain of a row's features; without features 0."""
    held = counted.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def rows(batch):
        n, lists = batch.column(2).to_numpy(), batch.column(3)
        sums = np.concatenate([[0], np.cumsum(held.value[flat(lists)] * flat(batch.column(4)))])
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        return {"id": batch.column(0), "n_words": batch.column(1), "n_features": batch.column(2), "weight": (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)}

    fields = [counted.schema[c] for c in ("id", "n_words", "n_features")]
    return map_rows(counted, rows, StructType([*fields, StructField("weight", LongType())]), 10_000)


def noise(id_: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the hash of seed and id; a null id counts as the empty text."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


#: Scores that the first level of ranking takes together.
SPAN = 256


def ranked(rows: DataFrame, score: str, order: list[Column], share: tuple[int, int], among: Column) -> DataFrame:
    """rows with rank 1, 2, 3 … by falling score, then order, for the floor(share) first of those that `among` names; else null.

    Sums over spans of scores and over scores say how many rows stand above each score; only rows of
    one score are sorted together, and only from the lowest drawn score on. A score lies within some
    66,000 of 0 (a log ratio of longs, and noise of 32 bits), so the table of scores, which is
    broadcast, is small whatever the input; its first level has a few hundred rows.
    """
    per = written(rows.where(among).groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("_n")).withColumn("_span", F.floor(F.col("_s") / SPAN)))
    higher = lambda by, *keys: Window.partitionBy(*keys).orderBy(F.desc(by)).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda n, w: F.coalesce(F.sum(n).over(w), F.lit(0))
    spans = per.groupBy("_span").agg(F.sum("_n").alias("_m")).withColumn("_over", before("_m", higher("_span"))).drop("_m")
    most = per.agg(F.expr(f"coalesce(sum(_n), 0) * {share[0]} div {share[1]}").alias("_most"))  # one row
    above = per.join(F.broadcast(spans), "_span").crossJoin(F.broadcast(most)).withColumn("_above", F.col("_over") + before("_n", higher("_s", "_span")))
    above = written(above.where("_above < _most").select("_s", "_above", "_most"))
    joined = rows.join(F.broadcast(above), among & (F.col(score) == F.col("_s")), "left")
    rank = F.col("_above") + F.row_number().over(Window.partitionBy(score).orderBy(*order))
    near = joined.where("_s IS NOT NULL").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= F.col("_most"), F.col("rank")))
    return all_of([near, joined.where("_s IS NULL").withColumn("rank", F.lit(None).cast("long"))]).drop("_s", "_above", "_most")


def resample(
    docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = 10_000, seed: int = 2024, least_words: int = 20, share: tuple[int, int] = (10, 100),
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, n_features, weight, score, rank (null where not drawn).

    Whole texts are read, however long; null and empty texts have no features and weigh 0. Of the
    rows with at least `least_words` words the floor of that share is drawn, highest scores first;
    ties go to the smaller id, and repeated rows of one id take ranks of their own, ordered by
    features and weight. Null ids come before others of their score. An empty target or an empty
    table counts as zeros; an empty table gives none back. Other columns are not read, whatever
    their names.

    Texts are split once: what is kept for the second pass is each row's buckets. No text is shuffled.
    """
    counted = written(bucket_counts(docs, low, high, buckets, id_col, text_col))
    aim = histogram(bucket_counts(target.select(F.lit(0).alias("id"), F.col(target_text_col).alias("text")), low, high, buckets, "id"), buckets)
    scored = written(weights(counted, gains(histogram(counted, buckets), aim)).withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    out = ranked(scored, "score", [F.col("id").asc_nulls_first(), F.col("n_features"), F.col("weight")], share, F.col("n_words") >= least_words)
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
