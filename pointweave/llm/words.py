"""Words of a text and their hashes, for the operators that run in Python tasks."""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

#: ASCII letters to lower case, ASCII digits kept, any other ASCII byte to a blank; bytes of longer characters kept.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The same without digits.
_LETTERS = bytes(32 if 48 <= c <= 57 else _PLAIN[c] for c in range(256))


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def plain_words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z in lower case."""
    return utf8(text).translate(_PLAIN).split()


def letter_words(text: str | None) -> list[bytes]:
    """Runs of letters and non-ASCII characters, A-Z in lower case."""
    return utf8(text).translate(_LETTERS).split()


def blank_words(text: str | None) -> list[bytes]:
    """Runs between blanks (space and \\x09-\\x0D), A-Z in lower case."""
    return utf8(text).lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of x changes every bit of the result."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each n consecutive words, in order; none if there are fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.full(count, n, np.uint64)
    for i in range(n):
        out = mix(out + hashes[i : i + count])
    return out


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of n-word runs; of the whole sequence if it is shorter; none without words."""
    words = blank_words(text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(ngram_hashes(word_hashes(words), min(n, len(words))))
