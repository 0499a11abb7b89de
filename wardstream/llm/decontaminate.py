"""Benchmark decontamination: an FM-index for each training shard.

A shard is a part of an Arrow batch of documents. Its words become symbols of the benchmark's vocabulary;
words that the benchmark never uses are breaks, and a run between breaks that is shorter than the
shortest phrase can hold none, so the index is built over the other runs. Phrases are searched
backwards, all at once, through the ranks of a wavelet matrix over the Burrows-Wheeler transform;
occurrences are located by walking to sampled suffix positions, and overlapping ones are merged into
spans to remove.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import map_rows

#: A-Z to a-z; digits, a-z and all beyond ASCII stay; the rest is space.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[^ ]+")
#: Bytes of benchmark text that go to the tasks at once, some 700,000 windows; a larger benchmark takes several passes.
BLOCK_BYTES = 4 << 20
#: Documents of one shard at most.
SHARD = 2000


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(BYTES).split() if text else []


class WaveletMatrix:
    """Ranks in a sequence of small integers, for arrays of queries."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            one = (symbols >> bit & 1).astype(bool)
            ones = np.concatenate([[0], np.cumsum(one)]).astype(np.int32)
            self.levels.append((bit, ones, len(symbols) - int(ones[-1])))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, c: np.ndarray, *ends: np.ndarray) -> list[np.ndarray]:
        """How often c[k] occurs before each of ends[.][k]."""
        start, at = np.zeros(len(c), np.int64), list(ends)
        for bit, ones, zeros in self.levels:
            up = (c >> bit & 1).astype(bool)
            start, *at = (np.where(up, zeros + ones[x], x - ones[x]) for x in (start, *at))
        return [x - start for x in at]


class FMIndex:
    """Over symbols from 1; 0 is a break, the last symbol is one, and breaks order by position."""

    def __init__(self, text: np.ndarray, sigma: int, every: int = 8):
        n = len(text)
        breaks = text == 0
        rank = np.where(breaks, np.cumsum(breaks) - 1, text.astype(np.int64) + breaks.sum() - 1)
        k, order = 1, None
        while order is None or rank[order[-1]] < n - 1:  # prefix doubling
            after = np.zeros(n, np.int64)
            after[: n - k] = rank[k:] + 1 if k < n else 0
            key = rank * (n + sigma + 2) + after
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
            k *= 2
        last = text[order - 1]
        self.last, self.ranks = last.astype(np.int64), WaveletMatrix(last.astype(np.int64), sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        # every eighth position and each run's first are known, so that no walk crosses a break
        self.sampled = (order % every == 0) | (last == 0)
        self.position = np.where(self.sampled, order, -1)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that start with each phrase; phrases are right-aligned rows of symbols."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.last), np.int64)
        for step in range(1, phrases.shape[1] + 1):
            live = np.flatnonzero((lengths >= step) & (lo < hi))
            c = phrases[live, -step]
            a, b = self.ranks.rank(c, lo[live], hi[live])
            lo[live], hi[live] = self.before[c] + a, self.before[c] + b
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, walked, left = rows.copy(), np.zeros(len(rows), np.int64), np.arange(len(rows))
        while len(left := left[~self.sampled[at[left]]]):
            c = self.last[at[left]]
            at[left] = self.before[c] + self.ranks.rank(c, at[left])[0]
            walked[left] += 1
        return self.position[at] + walked


class Phrases:
    """The distinct windows of a block of benchmark items, and the items that each belongs to, as arrays.

    table holds the windows, right-aligned, in `lengths` words each; window k belongs to the items
    names[owner[first[k]:first[k + 1]]].
    """

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {x: i for i, x in enumerate(self.names)}
        texts = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t)], np.int32) for _, t in items]
        # items stand end to end, with room before each for the zeros of one that is short
        flat = np.concatenate([np.zeros(0, np.int32), *[np.pad(t, (max(0, width - len(t)), 0)) for t in texts if len(t)]])
        sizes = np.array([max(width, len(t)) for t in texts if len(t)], np.int64)
        start = np.cumsum(sizes) - sizes
        item = np.repeat(np.array([number[name] for (name, _), t in zip(items, texts, strict=True) if len(t)], np.int32), sizes)
        at = np.flatnonzero(np.arange(len(flat)) + width <= np.repeat(start + sizes, sizes))
        every = np.lib.stride_tricks.sliding_window_view(flat, width)[at] if len(at) else np.zeros((0, width), np.int32)
        order = np.lexsort((item[at], *every.T[::-1]))
        every, item = every[order], item[at][order]
        new = np.ones(len(every), bool)
        new[1:] = (every[1:] != every[:-1]).any(1)
        fresh = new.copy()
        fresh[1:] |= item[1:] != item[:-1]
        self.table, self.owner = every[new], item[fresh]
        self.lengths = (self.table > 0).sum(1)
        self.first = np.append(np.flatnonzero(new[fresh]), len(self.owner))
        self.shortest = int(self.lengths.min()) if len(self.table) else 0

    def items(self, window: int) -> list[int]:
        return self.owner[self.first[window] : self.first[window + 1]].tolist()


def spans_of(hit: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def search_shard(texts: list[str | None], p: Phrases) -> tuple[list[int], dict[int, np.ndarray], dict[int, list[str]]]:
    """Words of each text; for texts with occurrences, which words are hit, and the items found."""
    get, parts, sizes = p.vocabulary.get, [], []
    for t in texts:
        ws = words(t)
        sizes.append(len(ws))
        parts.append(np.fromiter((get(w, 0) for w in ws), np.int32, len(ws)))
        parts.append(np.zeros(1, np.int32))
    hits, items = {}, {}
    if not p.shortest or not texts:
        return sizes, hits, items
    whole = np.concatenate(parts)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (whole > 0).view(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    long = ends - starts >= p.shortest
    if not long.any():
        return sizes, hits, items
    kept = np.zeros(len(whole) + 1, np.int32)
    np.add.at(kept, starts[long], 1)
    np.add.at(kept, ends[long] + 1, -1)  # each run with the break behind it
    kept = np.flatnonzero(np.cumsum(kept[:-1]))
    index = FMIndex(whole[kept], len(p.vocabulary) + 1)
    lo, hi = index.search(p.table, p.lengths)
    found = np.flatnonzero(hi > lo)
    if not len(found):
        return sizes, hits, items
    many = hi[found] - lo[found]
    which = np.repeat(found, many)
    rows = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    at = kept[index.locate(rows)]
    cover = np.zeros(len(whole) + 1, np.int32)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + p.lengths[which], -1)
    hit = np.cumsum(cover[:-1]) > 0
    offset = np.concatenate([[0], np.cumsum(np.array(sizes) + 1)])
    doc = np.searchsorted(offset, at, "right") - 1
    for pair in np.unique(doc * len(p.lengths) + which):
        items.setdefault(int(pair) // len(p.lengths), set()).update(p.items(int(pair) % len(p.lengths)))
    for d in items:
        hits[d] = hit[offset[d] : offset[d + 1] - 1]
        items[d] = sorted(p.names[i] for i in items[d])
    return sizes, hits, items


SPANS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """The benchmark's items in parts of about block_bytes each; one part, if it is no larger than that."""
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], r["t"]) for r in part.collect()]


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep_text: bool = False,
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, spans (of words, end exclusive, merged), items (sorted), and the text if asked for.

    Windows are `width` consecutive words of an item; a shorter item is one window. Null or empty
    texts and items have no words. Items of equal id are one item; a null id is ''. Repeated rows
    are searched each; other columns are not read. Nothing is shuffled: each pass over the documents
    takes one block of the benchmark, whose size is bounded, to the tasks.
    """
    sc = docs.sparkSession.sparkContext
    schema = StructType([
        StructField(id_col, docs.schema[id_col].dataType), StructField("text", StringType()), StructField("n_words", LongType()),
        StructField("spans", SPANS), StructField("items", ArrayType(StringType())),
    ])
    out = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    for items in benchmark_blocks(benchmark, item_col, item_text_col, block_bytes):
        held = sc.broadcast(Phrases(items, width))

        def rows(batch, held=held):
            texts, before = batch.column(1).to_pylist(), batch.num_columns > 2
            sizes, hits, items = search_shard(texts, held.value)
            spans = batch.column(3).to_pylist() if before else [[] for _ in texts]
            names = batch.column(4).to_pylist() if before else [[] for _ in texts]
            for d, hit in hits.items():
                hit = hit.copy()
                for s in spans[d]:
                    hit[s["start"] : s["end"]] = True
                spans[d], names[d] = spans_of(hit), sorted({*names[d], *items[d]})
            return {id_col: batch.column(0), "text": batch.column(1), "n_words": sizes, "spans": spans, "items": names}

        out = map_rows(out, rows, schema, SHARD)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select(id_col, *["text"] * keep_text, "n_words", n_hit.alias("n_hit"), "spans", "items")


def without_spans(text: str, spans: list) -> str:
    """The text without these spans of words, each with what stands between its words."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.translate(BYTES))]
    out, end = [], 0
    for s in spans:
        out.append(raw[end : at[s["start"]][0]])
        end = at[s["end"] - 1][1]
    return b"".join([*out, raw[end:]]).decode("utf-8", "surrogatepass")


def remove_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The same rows and columns with every occurrence of a window cut out of the text; nulls stay null.

    Empty texts stay empty, a text that is all benchmark becomes empty, repeated rows and whatever
    other columns there are stay as they are; an empty benchmark changes nothing. A long text is
    searched as a whole.

    A benchmark of one block, as usual, is searched and cut in one pass over whole rows. For a larger
    one, the spans of all blocks are gathered first.
    """
    at, names, schema = docs.columns.index(text_col), docs.columns, docs.schema
    blocks = benchmark_blocks(benchmark, item_col, item_text_col, block_bytes)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        held = docs.sparkSession.sparkContext.broadcast(Phrases(first, width))

        def one_pass(batch):
            texts = batch.column(at).to_pylist()
            for d, hit in search_shard(texts, held.value)[1].items():
                texts[d] = without_spans(texts[d], spans_of(hit.copy()))
            return {n: batch.column(i) for i, n in enumerate(names)} | {text_col: texts}

        return map_rows(docs, one_pass, schema, SHARD)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("t"))
    found = find_benchmark(packed, benchmark, width, id_col="row", text_col="t", item_col=item_col, item_text_col=item_text_col, block_bytes=block_bytes)

    def rows(batch):
        cols, spans = batch.column(0).flatten(), batch.column(1).to_pylist()
        texts = cols[at].to_pylist()
        for i, s in enumerate(spans):
            if s:
                texts[i] = without_spans(texts[i], s)
        return dict(zip(names, cols, strict=True)) | {text_col: texts}

    return map_rows(found.select("row", "spans"), rows, schema)
