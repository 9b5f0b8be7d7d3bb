"""Vectorised text primitives shared by the operators of this subpackage.

A *word* is a maximal run of Unicode alphanumeric characters (or ``_``) of the
lower-cased text.  Words are hashed with a polynomial over mixed code points,
so the hash of any sub-range of a text (a word, an affix, a character n-gram)
comes from two entries of one prefix-sum array; nothing loops over characters
in Python.  Texts are processed in sub-batches of bounded size; a single text
longer than the bound is a sub-batch of its own and is still processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Characters handled at once; bounds the temporary arrays of a Python worker.
CHARS_AT_ONCE = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """For every code point, whether it belongs to a word."""
    return np.fromiter((c == 95 or chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int, name: str) -> np.ndarray:
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = max(n, 2 * CHARS_AT_ONCE + 2)
        steps = np.full(size, U64(base))
        steps[0] = U64(1)
        have = _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


@dataclass
class Words:
    """The words of a sub-batch of texts.

    ``start``/``end`` are character positions in the joined texts, ``offset``
    those of each text's first word (one more entry at the end) and ``origin``
    the position at which each text begins.
    """

    first: int
    codes: np.ndarray
    prefix: np.ndarray
    start: np.ndarray
    end: np.ndarray
    offset: np.ndarray
    origin: np.ndarray

    @property
    def n_texts(self) -> int:
        return len(self.offset) - 1

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the character ranges [start, end)."""
        back = _powers(BASE_INVERSE, len(self.prefix), "inverse")[start]
        return mix((self.prefix[end] - self.prefix[start]) * back + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), np.diff(self.offset))


def word_batches(texts: list[str | None], fold: bool = True, at_once: int = CHARS_AT_ONCE) -> Iterator[Words]:
    """Splits texts into sub-batches and finds their words; null counts as empty."""
    first, size, held = 0, 0, []
    for i, t in enumerate(texts):
        t = (t.lower() if fold else t) if t else ""
        if held and size + len(t) > at_once:
            yield _words(held, first)
            first, size, held = i, 0, []
        held.append(t)
        size += len(t) + 1
    if held:
        yield _words(held, first)


def _words(texts: list[str], first: int) -> Words:
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    origin = np.concatenate([[0], np.cumsum(lengths)])
    inside = word_characters()[np.minimum(codes, 0x10FFFF)]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    values = mix(codes.astype(np.uint64) + U64(1)) * _powers(BASE, len(codes), "base")
    prefix = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(values, out=prefix[1:])
    return Words(first, codes, prefix, start, end, np.searchsorted(start, origin), origin)


def shingle_hashes(words: np.ndarray, offset: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside each text.

    Returns the hashes and each text's offset among them.  A text with fewer
    words, but at least one, has a single shingle of all its words.
    """
    counts = np.diff(offset)
    n = len(words)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    step = U64(0xD6E8FEB86659FD93)
    for k in range(width):
        rolled = rolled * step + words[k : k + len(rolled)]
    rolled = mix(rolled)
    made = np.where(counts >= width, counts - width + 1, (counts > 0).astype(counts.dtype))
    out_offset = np.concatenate([[0], np.cumsum(made)])
    which = np.repeat(np.arange(len(counts)), made)
    at = np.arange(out_offset[-1]) - out_offset[which] + offset[:-1][which]
    out = np.zeros(len(at), np.uint64)
    long = counts[which] >= width
    out[long] = rolled[at[long]]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = U64(counts[i])
        with np.errstate(over="ignore"):
            for w in words[offset[i] : offset[i + 1]]:
                h = h * step + w
        out[out_offset[i]] = mix(np.array([h], np.uint64))[0]
    return out, out_offset
