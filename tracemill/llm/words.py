"""Words of whole texts as 64-bit hashes in flat numpy arrays; shared by the operators that run Python inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
# A-Z, digits and everything beyond ASCII stay; other ASCII becomes a space.
LETTERS_AND_DIGITS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def encoded(text) -> bytes:
    """UTF-8 of a text; a null is an empty text, and lone surrogates do not fail."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def spaced(text) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z."""
    return encoded(text).lower().split()


def alphanumeric(text) -> list[bytes]:
    """Words of letters, digits and characters beyond ASCII, after lower-casing A-Z."""
    return encoded(text).lower().translate(LETTERS_AND_DIGITS).split()


def hashed(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def distinct(h: np.ndarray) -> np.ndarray:
    """The distinct values in rising order."""
    h = np.sort(h)
    return h[np.r_[True, h[1:] != h[:-1]]] if len(h) else h


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words; a shorter text is one run, an empty one has none."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = acc * MULTIPLIER + h[j : j + n]
    return mixed(acc)


def pieces(batches: Iterable[pd.DataFrame], text: str, limit: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Cuts batches of rows so that a piece holds about ``limit`` characters, or one row. No text is cut."""
    for b in batches:
        size = b[text].str.len().fillna(0).to_numpy()
        part = (np.cumsum(size) // limit).astype(np.int64)
        for start, end in _runs(part):
            yield b.iloc[start:end]


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(values):
        cuts = np.flatnonzero(np.diff(values)) + 1
        yield from zip(np.r_[0, cuts], np.r_[cuts, len(values)])
