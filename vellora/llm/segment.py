"""Splitting oversized texts at natural boundaries by lexical cohesion."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellora.functions.text import estimate_tokens
from vellora.llm import codes

LEVELS = ("line", "sentence", "clause", "word", "char")
#: Characters that end a sentence or a clause.
_STOPS, _CLAUSES = ".!?。！？…", ",;:，、；："
_IDEOGRAPHS = [(0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF)]
_BUCKETS = 512


def _weights(cp: np.ndarray) -> np.ndarray:
    """Weight of each character in 1/20 of the size estimate's unit."""
    w = np.full(len(cp), 8, dtype=np.int64)
    w[(cp >= 0x4E00) & (cp <= 0x9FA5)] = 15
    w[np.isin(cp, [ord(c) for c in '[]",{}'])] = 20
    return w


def budget(limit: int) -> int:
    """Largest weight, in 1/20 units, whose size estimate does not exceed ``limit``."""
    return (limit - 2) * 400 // 21


def _levels(cp: np.ndarray) -> np.ndarray:
    """For each place p, how natural a cut before character p is (index into LEVELS)."""
    n = len(cp)
    lv = np.full(n + 1, 4, dtype=np.int8)
    lv[[0, n]] = 0
    if n < 2:
        return lv
    prev, here = cp[:-1], cp[1:]
    blank = np.isin(cp, [9, 10, 11, 12, 13, 32, 160, 0x3000]) | ((cp >= 0x2000) & (cp <= 0x200A))
    after_blank = blank[:-1] & ~blank[1:]
    # what stands before the run of blanks that ends here
    last = np.maximum.accumulate(np.where(~blank, np.arange(n), -1))[:-1]
    solid = np.where(last >= 0, cp[np.maximum(last, 0)], 0)
    wide = prev > 0x2E7F
    stop, clause = np.isin(solid, [ord(c) for c in _STOPS]), np.isin(solid, [ord(c) for c in _CLAUSES])
    inner = lv[1:n]
    inner[after_blank] = 3
    inner[clause & (after_blank | (wide & ~blank[1:]))] = 2
    inner[stop & (after_blank | (wide & ~blank[1:] & ~np.isin(here, [ord(c) for c in _STOPS + '”’」』）)'])))] = 1
    inner[(prev == 0x20) & (solid == 0x2C) & (here == 0x5B)] = 1  # next row of a table
    # a line break belongs to the piece before it
    line = np.isin(prev, [10, 13]) & ~np.isin(here, [10, 13])
    inner[line] = 0
    # never before a mark or joiner that belongs to the character before
    stuck = ((here >= 0x300) & (here <= 0x36F)) | ((here >= 0xFE00) & (here <= 0xFE0F)) | (here == 0x200D) | (prev == 0x200D) | ((here >= 0x1F3FB) & (here <= 0x1F3FF))
    inner[stuck & (inner == 4)] = 5
    return lv


class _Terms:
    """Hashed terms of a text with their places, for similarities at gaps."""

    def __init__(self, text: str) -> None:
        self.at, term = codes.terms(codes.points(text), _IDEOGRAPHS)
        self.term = (term >> np.uint64(64 - _BUCKETS.bit_length() + 1)).astype(np.int64)

    def similarity(self, places: np.ndarray, width: int) -> np.ndarray:
        """Cosine of the ``width`` terms before and after each place; 0 where a side is empty."""
        out = np.zeros(len(places))
        for at in range(0, len(places), 256):  # bounded tables, however many places
            mid = np.searchsorted(self.at, places[at : at + 256])
            low, high = np.maximum(mid - width, 0), np.minimum(mid + width, len(self.at))
            stops = np.unique(np.concatenate([low, mid, high]))
            # terms counted between neighbouring stops, then summed up to each stop
            inside = np.searchsorted(stops, np.arange(stops[0], stops[-1]), side="right")
            counts = np.bincount(inside * _BUCKETS + self.term[stops[0] : stops[-1]], minlength=(len(stops) + 1) * _BUCKETS)
            upto = counts.astype(np.float32).reshape(-1, _BUCKETS)
            for before, row in zip(upto, upto[1:]):
                row += before
            a, b, c = (upto[np.searchsorted(stops, x)] for x in (low, mid, high))
            left, right = b - a, c - b
            norm = np.sqrt((left * left).sum(axis=1) * (right * right).sum(axis=1))
            out[at : at + 256] = np.where(norm > 0, (left * right).sum(axis=1) / np.maximum(norm, 1e-9), 0.0)
        return out


def depths(sim: np.ndarray) -> np.ndarray:
    """Depth of the valley at each gap: the climbs to the next peaks on both sides."""

    def climb(s: np.ndarray) -> np.ndarray:
        peak = s.copy()
        for i in range(1, len(s)):
            if s[i - 1] >= s[i]:
                peak[i] = peak[i - 1]
        return peak

    return climb(sim) + climb(sim[::-1])[::-1] - 2 * sim


def cuts(text: str, limit: int, overlap: int, least: float = 0.5, width: int = 60) -> list[tuple[int, int, int]]:
    """Pieces (start, end, level of the cut at end) of a text, each at most ``limit`` in the size estimate.

    Each cut lies in the window between ``least`` and all of the limit, at the deepest valley of lexical cohesion among
    the natural places there: ends of lines and sentences, else of clauses, else of words, else between characters.
    How natural a place is decides only between valleys within a tenth of the deepest, then their depth, then the later. The next piece
    starts up to ``overlap`` estimated tokens before the cut, at the most natural place giving at least half of it.
    """
    n = len(text)
    cp = codes.points(text)
    cum = np.concatenate([[0], np.cumsum(_weights(cp))])
    most, lap = budget(limit), overlap * 400 // 21
    if cum[n] <= most:
        return [(0, n, 0)]
    lv, terms = _levels(cp), _Terms(text)
    out: list[tuple[int, int, int]] = []
    start = done = 0
    while True:
        if cum[n] - cum[start] <= most:
            out.append((start, n, 0))
            return out
        hi = int(np.searchsorted(cum, cum[start] + most, side="right")) - 1
        lo = max(int(np.searchsorted(cum, cum[start] + int(most * least))), done + 1)
        window = lv[lo : hi + 1]
        level = int(window.min()) if len(window) else 4
        if level >= 4:
            c = next((p for p in range(hi, lo - 1, -1) if lv[p] == 4), hi)
        else:
            # valleys are judged against all gaps from the piece's start to just past the window
            reach = int(np.searchsorted(cum, cum[min(hi, n)] + most // 8))
            gaps = np.flatnonzero(lv[start + 1 : reach + 1] <= max(level, 1)) + start + 1
            depth = depths(terms.similarity(gaps, width))
            ok = (gaps >= lo) & (gaps <= hi)
            gaps, depth = gaps[ok], depth[ok]
            near = depth >= 0.9 * depth.max() - 1e-9
            gaps, depth = gaps[near], depth[near]
            c = int(gaps[np.lexsort((gaps, depth, -lv[gaps]))[-1]])
            level = int(lv[c])
        out.append((start, c, min(level, 4)))
        done = c
        nxt = c
        if lap:
            first = max(int(np.searchsorted(cum, cum[c] - lap)), start + 1)
            half = max(int(np.searchsorted(cum, cum[c] - lap // 2)), first)
            for want in range(5):
                p = np.flatnonzero(lv[first : half + 1] <= want)
                if len(p):
                    nxt = first + int(p[0])
                    break
        start = min(nxt, c)


def split_oversized(df: DataFrame, text: str, limit: int = 8000, overlap: int = 200, keep: list[str] | None = None) -> DataFrame:
    """Pieces of the rows whose text is above ``limit`` in the size estimate; other rows are not here.

    Every piece carries the columns ``keep`` (default: all but the text; a column named like one added here is left
    out) and adds piece_no, n_pieces, start_at and end_at (characters of the whole text, end exclusive), overlap (characters shared with the piece before), cut (kind of
    boundary at its end) and piece (text). Joining the pieces without their overlaps gives the text back. Whole texts
    are used; a text without any boundary is cut between characters. Null and empty texts are never oversized.
    """
    if not 0 <= overlap < limit // 4 or limit < 40:
        raise ValueError("overlap must be less than a quarter of a limit of at least 40")
    added = T.StructType(
        [T.StructField(c, T.IntegerType()) for c in ("piece_no", "n_pieces", "start_at", "end_at", "overlap")]
        + [T.StructField(c, T.StringType()) for c in ("cut", "piece")]
    )
    kept = [c for c in (keep if keep is not None else df.columns) if c != text and c not in added.names]
    schema = T.StructType([df.schema[c] for c in kept] + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = partial(cuts, limit=limit, overlap=overlap)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for i in range(b.num_rows):  # few and large: a row at a time bounds the memory
                t = texts[i].as_py()
                pieces = cut(t)
                rows = [b.column(k).take(pa.array([i] * len(pieces))) for k in range(len(kept))]
                laps = [0] + [max(0, p[1] - q[0]) for p, q in zip(pieces, pieces[1:])]
                new = [
                    pa.array(range(len(pieces)), pa.int32()), pa.array([len(pieces)] * len(pieces), pa.int32()),
                    pa.array([p[0] for p in pieces], pa.int32()), pa.array([p[1] for p in pieces], pa.int32()), pa.array(laps, pa.int32()),
                    pa.array([LEVELS[p[2]] if p[1] < len(t) else "end" for p in pieces]), pa.array([t[p[0] : p[1]] for p in pieces]),
                ]
                yield pa.RecordBatch.from_arrays(rows + new, names=schema.names)

    big = df.filter(estimate_tokens(F.col(text)) > limit)
    return big.select(*kept, F.col(text).alias("__text")).mapInArrow(run, schema)


def pieces(df: DataFrame, text: str, limit: int = 8000, overlap: int = 200, keep: list[str] | None = None) -> DataFrame:
    """All rows with non-null text as pieces: those within the limit are one whole piece."""
    big = split_oversized(df, text, limit, overlap, keep)
    kept = big.columns[:-7]
    n = F.length(text).cast("int")
    small = df.filter(F.col(text).isNotNull() & (estimate_tokens(F.col(text)) <= limit)).select(
        *kept, F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), F.lit(0).alias("start_at"), n.alias("end_at"), F.lit(0).alias("overlap"), F.lit("end").alias("cut"), F.col(text).alias("piece")
    )
    return small.unionByName(big)
