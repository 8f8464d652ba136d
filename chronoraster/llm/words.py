"""Words of marked-up text and hashes of word runs, in whole Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

# A doubled backslash is a line break, not the start of a command name.
COMMAND = re.compile(r"\\(?:\\|[A-Za-z]+)")
LETTERS_OR_DIGITS = re.compile(r"[^\W_]+")
LETTERS = re.compile(r"[^\W\d_]+")


def words(text: str | None, pattern: re.Pattern = LETTERS_OR_DIGITS) -> list[str]:
    """Words without case, command names passed over; none for null and empty texts."""
    return pattern.findall(COMMAND.sub(" ", text).lower()) if text else []


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 1_000_000

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, ws: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.LIMIT:
            known.clear()
        for w in set(ws).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode())
        return np.fromiter((known[w] for w in ws), np.uint64, len(ws))


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words, as int64; empty for shorter texts."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + m]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)
