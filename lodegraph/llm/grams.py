"""Texts as arrays: the characters that count, their rolling hashes and the positions chosen among them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from lodegraph.llm.invisible import INVISIBLE

_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@lru_cache(maxsize=1)
def kept_characters() -> np.ndarray:
    """Per code point the character it is compared as: letters and marks in lower case, digits of any script as ASCII
    digits; 0 for all else (spacing, punctuation, symbols, characters that show nothing)."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for cp in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x1F000)]:
        ch = chr(cp)
        cat = unicodedata.category(ch)
        if cat == "Nd":
            table[cp] = ord("0") + unicodedata.digit(ch)
        elif cat[0] in "LNM" and cp not in INVISIBLE:
            low = ch.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    for a, b in ((0x3400, 0xA000), (0xAC00, 0xD800), (0x1F000, 0x323B0)):
        table[a:b] = np.arange(a, b) if a < 0x1F000 else 0
    table[0x20000:0x323B0] = np.arange(0x20000, 0x323B0)
    return table


def kept(text: str) -> np.ndarray:
    """A text's characters that count."""
    x = kept_characters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    return x[x != 0]


def hashes(chars: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` characters, by doubling; fewer than k characters give none."""
    with np.errstate(over="ignore"):
        v = chars.astype(np.uint64) + np.uint64(1)
        v ^= v << np.uint64(23)
        v *= np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(32)
        done, size, power, rest = None, 0, _BASE, k
        block, length = v, 1
        while True:
            if rest & 1:
                if done is None:
                    done, size = block, length
                else:
                    n = len(chars) - size - length + 1
                    if n <= 0:
                        return np.empty(0, np.uint64)
                    done = done[:n] * power + block[size : size + n]
                    size += length
            rest >>= 1
            if not rest:
                break
            n = len(block) - length
            if n <= 0:
                return np.empty(0, np.uint64)
            block = block[:n] * power + block[length : length + n]
            power = power * power
            length *= 2
        h = done[: max(0, len(chars) - k + 1)].copy()
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _sliding(h: np.ndarray, w: int, op) -> np.ndarray:
    """The minimum or maximum over every window of ``w``, by doubling."""
    length, m = 1, h
    while length * 2 <= w:
        m = op(m[: len(m) - length], m[length:])
        length *= 2
    if length < w:
        m = op(m[: len(m) - (w - length)], m[w - length :])
    return m


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the least of some window of ``w`` hashes (all of the least where they tie; with fewer than w
    hashes, the least of all). Equal runs of w hashes always have an equal choice."""
    n = len(h)
    if n == 0:
        return np.empty(0, np.int64)
    if n <= w:
        return np.flatnonzero(h == h.min())
    low = _sliding(h, w, np.minimum)
    pad = np.zeros(w - 1, np.uint64)
    top = _sliding(np.concatenate([pad, low, pad]), w, np.maximum)
    return np.flatnonzero(top == h)


def chunks(ids: list, texts: list[str], most_chars: int = 1_000_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Documents in runs of about ``most_chars`` characters, so that arrays stay in the cache."""
    a, b, n = [], [], 0
    for i, t in zip(ids, texts):
        x = kept(t)
        a.append(i)
        b.append(x)
        n += len(x)
        if n >= most_chars:
            yield a, b
            a, b, n = [], [], 0
    if a:
        yield a, b


def chosen(parts: list[np.ndarray], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document index, position, hash) of the winnowed k-grams of several documents at once."""
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    starts = np.cumsum(lengths) - lengths
    h = hashes(flat, k)
    if not len(h):
        e = np.empty(0, np.int64)
        return e, e, np.empty(0, np.uint64)
    # runs over a document's end belong to none; as the greatest value they are never the least of a window but of
    # windows that hold nothing else
    ends = starts + lengths
    for a in range(1, k):
        at = ends - a
        at = at[(at >= starts) & (at >= 0) & (at < len(h))]
        h[at] = _NONE
    pos = winnow(h, w)
    pos = pos[h[pos] != _NONE]
    doc = np.searchsorted(ends, pos, side="right")
    return doc, pos - starts[doc], h[pos]
