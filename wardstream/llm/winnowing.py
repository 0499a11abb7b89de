"""Document fingerprints by winnowing.

Rolling hashes of all k-grams of code points; of each window of successive hashes the minimum is
chosen, the rightmost of equal ones, and kept with its position. Any passage of `k + window - 1`
code points that two texts share gives both at least one common hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from ..functions.frames import edges
from .common import map_rows, pieces

#: Letters in a k-gram, hashes in a window: a shared passage of 43 letters is never missed.
GRAM, WINDOW = 12, 32
#: Odd, so that it has an inverse among the numbers modulo 2**64.
BASE = 0x2545F4914F6CDD1D
HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


@lru_cache(8)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**0 … BASE**n and the inverses' powers, modulo 2**64."""
    up, down = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def rolling(points: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k-gram: sums over prefixes roll from one gram to the next; a last stir spreads the bits."""
    n = len(points)
    up, down = powers(1 << max(10, int(n + k).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * down[:n], dtype=np.uint64)])
    h = (sums[k:] - sums[: n - k + 1]) * up[k - 1 : n]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (h >> np.uint64(32)).astype(np.uint32)


def chosen(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the windows' minima, the rightmost of equal ones, each once; fewer hashes than a window are one window."""
    window = min(window, len(h))
    # hash and falling position in one number: its minimum is the rightmost of the least
    key = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    have = 1
    while have < window:
        step = min(have, window - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    at = (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64)
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def prints(text: str, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes); a text shorter than a gram is one gram, the empty text has none."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    h = rolling(points, min(k, len(points)))
    at = chosen(h, window)
    return at, h[at]


def printed(at: np.ndarray, h: np.ndarray) -> str:
    """Prints as text, 8 hex digits of hash and 2 of how far it is from the last one; successive ones are at most a window apart, so that two digits hold the distance."""
    gap = np.diff(at, prepend=0).astype(np.uint32)
    digits = [h >> np.uint32(4 * i) & np.uint32(15) for i in range(7, -1, -1)] + [gap >> np.uint32(4), gap & np.uint32(15)]
    return HEX[np.stack(digits, 1).astype(np.uint8)].tobytes().decode() if len(at) else ""


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the common distinct hashes by the sum of both's; 1 for two empty ones."""
    return 2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b)) if len(a) or len(b) else 1.0


def fingerprints(df: DataFrame, k: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, positions, hashes, and fingerprint, which writes both as text.

    Whole texts, code point by code point; null and empty texts have no prints and the fingerprint
    ''. Equal texts have equal fingerprints, repeated rows are printed each, the empty table gives
    an empty result, and other columns are not read. Nothing is shuffled.
    """
    if not 1 <= window <= 255:
        raise ValueError("a window has 1 to 255 hashes")

    def rows(batch):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        each = [prints(t, k, window) for t in texts]
        return {id_col: batch.column(0), "n_chars": [len(t) for t in texts], "positions": [a for a, _ in each], "hashes": [h for _, h in each], "fingerprint": [printed(*x) for x in each]}

    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("n_chars", LongType()), StructField("positions", ArrayType(LongType())), StructField("hashes", ArrayType(LongType())), StructField("fingerprint", StringType())])
    return map_rows(df.select(id_col, F.col(text_col)), rows, schema)


#: Texts of a range of ids, in bytes; and how many ranges there are at most: beyond some 160 GB they grow instead.
RANGE_BYTES, RANGES = 16 << 20, 10_000


def tops(df: DataFrame, id_col: str, text_col: str) -> list:
    """The highest id of each range, falling: ids that exist, so that a range's first row is known. The driver gets some 64 ids for each of at most RANGES ranges."""
    row = df.agg(F.sum(F.octet_length(text_col)), F.max(id_col)).first()
    n = max(1, min(RANGES, -(-(row[0] or 0) // RANGE_BYTES)))
    return sorted({row[1], *(edges(df, id_col, n) if n > 1 else [])} - {None}, reverse=True)


def range_of(id_: Column, high: list) -> Column:
    """Which range holds an id: the last whose top isn't below it, by bisection. Null ids belong to the last."""
    if len(high) < 2:
        return F.lit(0)
    all_ = F.array(*map(F.lit, high))
    steps = F.array(*[F.lit(1 << i) for i in range(len(high).bit_length() - 1, -1, -1)])
    at = F.aggregate(steps, F.lit(0), lambda r, s: F.when((r + s < len(high)) & (F.get(all_, r + s) >= id_), r + s).otherwise(r))
    return F.when(id_.isNull(), len(high) - 1).otherwise(at)


def edited(text: str, after: str) -> str:
    """The text with its last third replaced by as much of the start of another."""
    m = len(text) // 3
    return text[: len(text) - m] + after[:m]


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, _range, _guest), dealt by ranges of falling ids and sorted: each row is followed by the next one of the whole table.

    The first row of a range closes the range before it as a guest, and the first of all closes the
    last. Texts are shuffled once.
    """
    high = tops(df, id_col, text_col) or [None]
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_r", range_of(F.col("id"), high))
    head = F.coalesce(F.get(F.array(*[F.lit(x).cast(df.schema[id_col].dataType) for x in high]), F.col("_r")).eqNullSafe(F.col("id")), F.lit(False))
    own, guest = F.struct(F.col("_r").alias("range"), F.lit(False).alias("guest")), F.struct(F.pmod(F.col("_r") - 1, F.lit(len(high))).alias("range"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("_p", F.explode(F.when(head, F.array(own, guest)).otherwise(F.array(own)))).select("id", "text", "_p.range", "_p.guest")
    # as many tasks as ranges, so that one gets no more than the few ranges that hash alike
    return dealt.repartition(len(high), "range").sortWithinPartitions("range", "guest", F.desc_nulls_last("id"), "text")


def compare_edited(df: DataFrame, k: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by as much of the next document's start, or by all
    of that; the next document is the one with the next smaller id, after the last the first. Rows
    of equal id follow each other by text; null ids come last; a lone row is its own next. Null and
    empty texts have fingerprint '', alike to '' by 1 and to any other by 0; a table without rows
    gives none. Other columns are not read, whatever their names. Texts are shuffled once, by ranges
    of ids; a task holds two documents at a time and the batch that it reads.
    """
    if not 1 <= window <= 255:
        raise ValueError("a window has 1 to 255 hashes")
    schema = StructType([
        StructField("id", df.schema[id_col].dataType), StructField("n_chars", LongType()), *[StructField(c, StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")],
        *[StructField(c, DoubleType()) for c in ("near_edited", "near_next")],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        to, before = to_arrow_schema(schema), None
        for batch in batches:
            for piece in pieces(batch, 500):
                out = []
                for id_, text, at, guest in zip(*(piece.column(i).to_pylist() for i in range(4)), strict=True):
                    made = prints(text, k, window)
                    alike = np.unique(made[1])
                    if before and before[2] == at:
                        key, old, _, (was, was_alike) = before
                        new = edited(old, text)
                        new_made = prints(new, k, window)
                        out.append((key, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), printed(*was), printed(*new_made), likeness(was_alike, np.unique(new_made[1])), likeness(was_alike, alike)))
                    before = None if guest else (id_, text, at, (made, alike))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(to)], schema=to)

    out = with_next(df, id_col, text_col).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
