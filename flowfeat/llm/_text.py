"""Texts as flat code point arrays: words and their hashes for a whole batch at once, in numpy inside tasks."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
CHARS = 1_000_000  # code points handled at once; a longer text is handled alone


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def release() -> None:
    """Gives freed memory back to the system: workers stay alive between tasks, next to the executor's heap."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


def slices(texts: list[str | None], chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that together hold about ``chars`` code points."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and held + n > chars:
            yield at, i
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, len(texts)
    release()


def flat(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets): text i is points[offsets[i]:offsets[i + 1]]; null is empty."""
    texts = [t or "" for t in texts]
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), off


@cache
def word_points() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter or digit, lower-case code point) of every code point."""
    is_word = np.zeros(0x110000, bool)
    low = np.arange(0x110000, dtype=np.uint32)
    for start in range(0, 0x110000, 0x4000):
        for i in range(start, start + 0x4000):
            c = chr(i)
            if c.isalnum():
                is_word[i] = True
                c = c.lower()
                if len(c) == 1:
                    low[i] = ord(c)
    return is_word, low


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(STEP), -1, 1 << 64))
        for i, base in enumerate((STEP, inverse)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0], _powers[1]


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each points[start:end], the same for the same content at any place."""
    up, down = _powers_to(len(points) + 1)
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(0x51ED)) * up[: len(points)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true points; a run never spans two texts."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    return np.flatnonzero(inside & (~before | first[:-1])), np.flatnonzero(inside & (~after | first[1:])) + 1


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets of texts among the words); words are runs of letters and digits in lower case."""
    points, off = flat(texts)
    is_word, low = word_points()
    s, e = runs(is_word[points], off)
    h = span_hashes(low[points], s, e) if len(s) else np.zeros(0, np.uint64)
    return h, np.searchsorted(s, off)


def shingles(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct word shingles of each text, sorted; a text of fewer words has one, of no words none."""
    h, off = words(texts)
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), off
    acc = np.zeros(n, np.uint64)
    count = np.diff(off)
    left = np.repeat(off[1:], count) - np.arange(n)  # words from here to the text's end
    for k in range(size):
        at = np.minimum(np.arange(n) + k, n - 1)
        acc = np.where(left > k, acc * STEP + h[at], acc)
    text = np.repeat(np.arange(len(count)), count)
    full = (left >= size) | ((np.arange(n) == off[:-1][text]) & (count[text] < size))
    acc, text = mix(acc[full]), text[full]
    order = np.lexsort((acc, text))
    acc, text = acc[order], text[order]
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (text[1:] != text[:-1])
    acc, text = acc[new], text[new]
    return acc, np.searchsorted(text, np.arange(len(count) + 1))
