"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are made."""

from __future__ import annotations

import heapq
import json
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .common import map_rows

#: How this kind of vocabulary cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
#: A task forgets its words beyond this many, so that its memory stays bounded.
REMEMBERED = 150_000


def load_merges(path: str) -> tuple[dict[tuple[str, str], int], str, list[str]]:
    """Ranks of the merges, the mark at the end of a word, and the special strings of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in t["model"]["merges"]]
    return {p: i for i, p in enumerate(pairs)}, t["model"]["end_of_word_suffix"] or "", [a["content"] for a in t["added_tokens"]]


def byte_names() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def merged(symbols: list[str], rank: dict[tuple[str, str], int]) -> int:
    """Symbols left after repeatedly joining the lowest-ranked adjacent pair, leftmost first."""
    n = len(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := rank.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    live = list(symbols)
    count = n
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if j >= n or live[i] != a or live[j] != b:
            continue  # one side has been joined since
        live[i], live[j] = a + b, ""
        count -= 1
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := rank.get((live[i], live[k]))) is not None:
                heapq.heappush(heap, (r, i, live[i], live[k]))
        if (h := left[i]) >= 0 and (r := rank.get((live[h], live[i]))) is not None:
            heapq.heappush(heap, (r, h, live[h], live[i]))
    return count


class Counter:
    """Counts the tokens of texts; built on a worker from what the driver has read."""

    def __init__(self, rank: dict, end: str, special: list[str]):
        import regex

        self.rank, self.end, self.names, self.known = rank, end, byte_names(), {}
        self.words = regex.compile(WORDS).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def word(self, w: str) -> int:
        n = self.known.get(w)
        if n is None:
            symbols = [self.names[b] for b in w.encode("utf-8", "surrogatepass")]
            symbols[-1] += self.end
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[w] = merged(symbols, self.rank)
        return n

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        # lower-casing goes letter by letter: sigma has no final form here
        return len(parts) - 1 + sum(sum(map(self.word, self.words(unicodedata.normalize("NFC", p).replace("Σ", "σ").lower()))) for p in parts)


def count_tokens(df: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit.

    `vocabulary` is a path on the driver; its merges, a fixed few MB, go to the tasks. Texts count
    whole; a null or empty text has 0 bytes and 0 tokens. Repeated rows count each; other columns
    are not read.
    """
    held = df.sparkSession.sparkContext.broadcast(load_merges(vocabulary))
    made = []

    def rows(batch):
        if not made:
            made.append(Counter(*held.value))
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n = [made[0].count(t) for t in texts]
        return {id_col: batch.column(0), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])
    return map_rows(df.select(id_col, F.col(text_col)), rows, schema)
