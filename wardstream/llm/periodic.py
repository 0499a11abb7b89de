"""Periodic run detection by string synchronising sets.

A run is a maximal stretch of words that repeats with a smallest period. For each dyadic scale t, a
position is in the synchronising set if the least hash among the t + 1 windows of t words from there
on is the first or the last of them. Whether it is depends on the 2t words from there on alone, so
positions with equal contexts are both in the set or both not, and each stretch of t positions has
one unless a period of at most t / 4 fills it. A run of period q, t <= q < 2t, and four periods long
therefore shows as two successive set positions with equal contexts, q apart: only such pairs are
proposals. Windows inside runs of small periods, which smaller scales have found, take no part:
those runs are already known, and they can't hide a larger period.

All texts of a part of a batch are handled at once, as one sequence of word numbers in which a
number of its own follows each text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import map_rows

#: Texts that a task takes at once.
TOGETHER = 400
#: Constants that mix hashes: odd, and without short cycles of bits.
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def doubled(h: np.ndarray, t: int) -> np.ndarray:
    """Hashes of windows of 2t words from those of t words."""
    return stirred(h[: len(h) - t] * MIX[0] + h[t:] + np.uint64(t)) if len(h) > t else h[:0]


def least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum over each `width` neighbours, by doubling."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def synchronised(h: np.ndarray, t: int) -> np.ndarray:
    """Positions whose t + 1 windows of t words have their least hash first or last; windows marked NEVER don't count."""
    if len(h) <= t:
        return np.zeros(0, np.int64)
    low = least(h, t + 1)
    first, last = h[: len(low)], h[t : t + len(low)]
    return np.flatnonzero((low != NEVER) & ((low == first) | (low == last)))


def proposals(at: np.ndarray, context: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period): set positions and how far the next with an equal context is, where that is t to 2t - 1."""
    order = np.lexsort((at, context))
    c, p = context[order], at[order]
    gap = np.diff(p)
    hit = np.flatnonzero((c[1:] == c[:-1]) & (gap >= t) & (gap < 2 * t))
    return p[hit], gap[hit]


def grown(x: np.ndarray, a: int, b: int, q: int, reach: int) -> tuple[int, int]:
    """The stretch of positions i with x[i] == x[i + q] around a to b, which is one; the ends are at most `reach` away, or the search goes on."""
    while a > 0:
        lo = max(0, a - reach)
        odd = np.flatnonzero(x[lo:a] != x[lo + q : a + q])
        if len(odd):
            a = lo + int(odd[-1]) + 1
            break
        a = lo
    n = len(x) - q
    while b < n:
        hi = min(n, b + reach)
        odd = np.flatnonzero(x[b:hi] != x[b + q : hi + q])
        if len(odd):
            b += int(odd[0])
            break
        b = hi
    return a, b


def find_runs(x: np.ndarray, longest: int, exponent: int = 4, shortest: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of x, by start and period; x is word numbers, `longest` the longest text in it.

    exponent is at least 4: that is what makes each run show at its scale.
    """
    if exponent < 4:
        raise ValueError("runs of fewer than four periods may not show")
    found, h, t = [], stirred(x.astype(np.uint64) + MIX[0]), 1
    while 4 * t <= longest and len(h):
        ids = h
        small = [(a, n) for a, n, q in found if 4 * q <= t <= n]
        if small:
            inside = np.zeros(len(h) + 1, np.int32)
            for a, n in small:
                inside[a] += 1
                inside[min(len(h), a + n - t + 1)] -= 1
            ids = np.where(np.cumsum(inside[:-1]) > 0, NEVER, h)
        context = doubled(h, t)
        at = synchronised(ids, t)
        at = at[at < len(context)]
        where, period = proposals(at, context[at], t)
        if len(where):
            order = np.lexsort((where, period))
            where, period = where[order], period[order]
            # proposals of one period whose contexts overlap are one stretch
            new = np.concatenate([[True], (np.diff(period) != 0) | (np.diff(where) > 2 * t)])
            edge = np.append(np.flatnonzero(new), len(where))
            for i, j in zip(edge[:-1], edge[1:], strict=True):
                a, b, q = int(where[i]), int(where[j - 1]) + 2 * t, int(period[i])
                if not np.array_equal(x[a:b], x[a + q : b + q]):
                    continue  # two contexts hashed alike
                a, b = grown(x, a, b, q, 2 * t)
                if b - a + q >= 4 * q:
                    found.append((a, b - a + q, q))
        h, t = context, 2 * t
    return sorted({(a, n, q) for a, n, q in found if n >= max(shortest, exponent * q)}, key=lambda r: (r[0], r[2]))


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of all texts, each followed by a number of its own; where each text starts)."""
    known: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes + 1)])
    x = np.empty(start[-1], np.int64)
    for k, t in enumerate(texts):
        x[start[k] : start[k + 1] - 1] = [known.setdefault(w, len(known)) for w in t]
    x[start[1:] - 1] = len(known) + np.arange(len(texts))
    return x, start[:-1]


def runs_of(texts: list[list[bytes]], exponent: int = 4, shortest: int = 6) -> list[list[tuple[int, int, int]]]:
    """The runs of each text."""
    x, start = numbered(texts)
    out = [[] for _ in texts]
    found = find_runs(x, max(map(len, texts), default=0), exponent, shortest)
    home = np.searchsorted(start, [a for a, _, _ in found], "right") - 1
    for k, (a, n, q) in zip(home.tolist(), found, strict=True):
        out[k].append((a - int(start[k]), n, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds beyond its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int32)
    for a, n, q in runs:
        gone[a + q] += 1
        gone[a + n] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


RUNS = ArrayType(StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())]))


def periodic_runs(df: DataFrame, exponent: int = 4, shortest: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, runs (array of start, length, period by start and period), collapsed (the kept words, joined by a space).

    Words are runs of anything but space and the five control characters from tab on. A run is
    maximal, `period` its smallest period, its length at least `shortest` words and `exponent`
    periods. Null and empty texts have no words and no runs, and collapse to ''. Whole texts are
    read, however long; repeated rows are searched each; the empty table gives an empty result;
    other columns are not read. Nothing is shuffled, and equal texts get equal runs.
    """

    def rows(batch):
        texts = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in batch.column(1).to_pylist()]
        each = runs_of(texts, exponent, shortest)
        return {
            id_col: batch.column(0), "n_words": [len(t) for t in texts], "runs": [[{"start": a, "length": n, "period": q} for a, n, q in r] for r in each],
            "collapsed": [b" ".join(collapsed(t, r)).decode("utf-8", "surrogatepass") for t, r in zip(texts, each, strict=True)],
        }

    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("n_words", LongType()), StructField("runs", RUNS), StructField("collapsed", StringType())])
    return map_rows(df.select(id_col, F.col(text_col)), rows, schema, TOGETHER)


def longest_run(runs: Column) -> Column:
    """The struct of the longest run; ties go to the smallest start, then period; null without runs."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("o"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(order)


def runs_text(runs: Column) -> Column:
    """start,length,period and a line feed for each run."""
    return F.array_join(F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")


def planted(df: DataFrame, of: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): in one of `of` texts, by a hash of the id, the words from some point on repeat with some period; their words are joined by a space.

    A null id hashes as the empty text; null and empty texts stay as they are.
    """
    import zlib

    def rows(batch):
        out = batch.column(1).to_pylist()
        for k, key in enumerate(batch.column(0).to_pylist()):
            h = zlib.crc32(b"" if key is None else str(key).encode())
            words = out[k].encode("utf-8", "surrogatepass").split() if out[k] and h % of == 0 else []
            if words:
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                out[k] = b" ".join(words[:a] + [words[a + i % p] for i in range(n - a)]).decode("utf-8", "surrogatepass")
        return {id_col: batch.column(0), text_col: out}

    return map_rows(df.select(id_col, text_col), rows, StructType([StructField(id_col, df.schema[id_col].dataType), StructField(text_col, StringType())]))
