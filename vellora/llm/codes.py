"""Many texts as one array of code points, and hashes of their words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def points(s: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    up, down = np.full(size, BASE), np.full(size, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def run_hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each run of code points, by differences of one running sum."""
    n = len(cp)
    up, down = _powers(1 << max(13, n.bit_length()))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * down[:n])])
    return (total[end] - total[start]) * up[end - 1]


def join_hashes(a: int, b: int, length: int) -> int:
    """Hash of a run from those of its two parts, the second of ``length`` code points."""
    return (a * pow(int(BASE), length, 1 << 64) + b) % (1 << 64)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true places."""
    edge = np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


@lru_cache
def _alphanumeric() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache
def _lower() -> np.ndarray:
    return np.fromiter((ord(low) if len(low := chr(c).lower()) == 1 else c for c in range(0x110000)), dtype=np.uint32, count=0x110000)


def terms(cp: np.ndarray, ideographs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of each term of a text, in order: runs of letters and digits in lower case, and single ideographs."""
    alone = np.zeros(len(cp), dtype=bool)
    for a, b in ideographs:
        alone |= (cp >= a) & (cp <= b)
    start, end = runs(_alphanumeric()[cp] & ~alone)
    one = np.flatnonzero(alone)
    start, end = np.concatenate([start, one]), np.concatenate([end, one + 1])
    order = np.argsort(start, kind="stable")
    return start[order], run_hashes(_lower()[cp], start, end)[order]


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts in order (int64), and where the words of each text begin and end among them.

    A word is a longest run of letters and digits, in folded case.
    """
    folded = [t.casefold() if t else "" for t in texts]
    cp = points("\n".join(folded) + "\n")
    start, end = runs(_alphanumeric()[cp])
    sizes = np.fromiter(map(len, folded), dtype=np.int64, count=len(folded))
    borders = np.concatenate([[0], np.cumsum(sizes + 1)])
    return run_hashes(cp, start, end).view(np.int64), np.searchsorted(start, borders)
