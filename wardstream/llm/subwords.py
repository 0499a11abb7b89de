"""Hash buckets of words' parts, for many words at once.

Words are laid end to end as code points with an opening and a closing mark each; polynomial hashes
of windows that don't cross a word's end are its n-grams. Every n-gram counts as often as it occurs.
"""

from __future__ import annotations

import numpy as np

K = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray, kind: int) -> np.ndarray:
    h = h + np.uint64(kind * 0xD6E8FEB86659FD93 % (1 << 64))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The code points of a list of words."""

    def __init__(self, words: list[str]):
        raw = "".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass")
        self.codes = np.frombuffer(raw, np.uint32).astype(np.uint64)
        self.size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        self.word_of = np.repeat(np.arange(len(words)), self.size)
        self.left = np.repeat(self.end, self.size) - np.arange(len(self.codes))

    def window(self, n: int) -> np.ndarray:
        """Hashes of the n code points from each place on (of less at the very end)."""
        h = np.zeros(len(self.codes), np.uint64)
        for i in range(n):
            h = h * K
            if i < len(h):
                h[: len(h) - i] += self.codes[i:]
        return h

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, word) of all n-grams."""
        inside = self.left >= n
        return mixed(self.window(n)[inside], n), self.word_of[inside]

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        power = np.cumprod(np.full(int(self.size.max(initial=1)), K))
        at = np.arange(len(self.codes)) - np.repeat(self.start, self.size)
        h = np.add.reduceat(self.codes * power[at], self.start) if len(self.start) else np.zeros(0, np.uint64)
        return mixed(h, 1), np.arange(len(self.start))

    def affixes(self, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """First and last n code points, marks included; of shorter words the whole."""
        h, which = self.window(n), np.arange(len(self.start))
        long = self.size >= n
        return [(mixed(h[self.start[long]], 100 + n), which[long]), (mixed(h[self.end[long] - n], 200 + n), which[long])]


def buckets(parts: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of all parts, by word."""
    h, w = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(w, kind="stable")
    return (h[order] % np.uint64(n)).astype(np.int64), w[order]
