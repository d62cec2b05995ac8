"""Scans of UTF-8 text by numpy over Arrow buffers: words, shingles, lines and their 64-bit hashes.

All hashes are fixed functions of the bytes, equal on every machine. A span's hash is a polynomial
in a fixed odd base over a table of random 64-bit values, taken from running sums, then mixed. Regular
spans of a thousand bytes and more can agree in such a polynomial modulo 2 ** 64 whatever the base, so a
span of ``LONG_SPAN`` bytes or more is hashed by BLAKE2 instead.
Memory is about 60 bytes for each byte of a piece; a piece is about half a megabyte, or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from parcelry.llm.common import SPACE_BYTES

PIECE_BYTES = 1 << 19
LONG_SPAN = 128
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection whose output bits each depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def counter_hash(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1_000_003)) * U(0x9E3779B97F4A7C15))


BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = counter_hash(256, 1)
LOWERED_VALUES = BYTE_VALUES.copy()
LOWERED_VALUES[65:91] = BYTE_VALUES[97:123]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACE_BYTES)] = True


class Powers:
    """Powers of the base and of its inverse, grown to the longest piece seen by a task."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, PIECE_BYTES + (PIECE_BYTES >> 2))
            up, down = np.full(size, BASE, dtype=U), np.full(size, INVERSE, dtype=U)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
        return self.up[:n], self.down[:n]


@dataclass
class Piece:
    """Some consecutive rows of a batch: their bytes end to end, and where each row begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Spans:
    """Words or lines of a piece in order; ``bounds[r]:bounds[r + 1]`` are those of row r."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cuts a string column into pieces of whole rows, about ``limit`` bytes each; null is empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(filled)
    if not n:
        return
    _, where, values = filled.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[filled.offset : filled.offset + n + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield Piece(first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(piece: Piece, separates: np.ndarray = IS_SPACE) -> Spans:
    """Maximal runs of bytes that don't separate; a run never crosses a row's end."""
    size = len(piece.data)
    inside = np.zeros(size + 1, dtype=bool)
    inside[:size] = ~separates[piece.data]
    edge = np.zeros(size + 1, dtype=bool)
    edge[piece.offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:]
    ends = inside[:-1] & (~inside[1:] | edge[1:])
    starts = np.flatnonzero(begins[:size])
    return Spans(starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, piece.offsets))


def span_hashes(piece: Piece, spans: Spans, powers: Powers, lowered: bool = False) -> np.ndarray:
    """A hash of the bytes of each span; ``lowered`` takes A-Z as a-z."""
    values = LOWERED_VALUES if lowered else BYTE_VALUES
    up, down = powers.upto(len(piece.data) + 1)
    running = np.zeros(len(piece.data) + 1, dtype=U)
    sizes = spans.ends - spans.starts
    with np.errstate(over="ignore"):
        np.cumsum(values[piece.data] * up[:-1], dtype=U, out=running[1:])
        sums = (running[spans.ends] - running[spans.starts]) * down[spans.starts]
        hashes = mix(sums + sizes.astype(U) * U(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(sizes >= LONG_SPAN):
        raw = piece.data[spans.starts[k] : spans.ends[k]].tobytes()
        hashes[k] = int.from_bytes(hashlib.blake2b(raw.lower() if lowered else raw, digest_size=8).digest(), "little")
    return hashes


def windows(hashes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every window of ``width`` spans within a row, by place of its first span.

    The first result marks the spans that begin a whole window; the second has a hash for each span,
    of use only where marked.
    """
    n = len(hashes)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    joined = np.full(n, width, dtype=U)
    with np.errstate(over="ignore"):
        for k in range(width):
            ahead = np.zeros(n, dtype=U)
            ahead[: max(0, n - k)] = hashes[k:]
            joined = mix(joined * U(0x9E3779B97F4A7C15) + ahead)
    return left >= width, joined


def whole_hash(hashes: np.ndarray) -> np.ndarray:
    """One hash for a sequence shorter than a window; sequences of other lengths differ."""
    joined = np.full(1, len(hashes), dtype=U)
    with np.errstate(over="ignore"):
        for value in hashes:
            joined = mix(joined * U(0x9E3779B97F4A7C15) + value)
    return joined


def shingle_sets(column: pa.Array, width: int, powers: Powers) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, its place and the sorted distinct hashes of its ``width``-word shingles, A-Z lower-cased.

    Fewer words than ``width`` are one shingle; no words give an empty set.
    """
    for piece in pieces(column):
        found = words(piece)
        hashes = span_hashes(piece, found, powers, lowered=True)
        _, joined = windows(hashes, found.bounds, width)
        for row in range(piece.rows):
            a, b = int(found.bounds[row]), int(found.bounds[row + 1])
            if b - a >= width:
                yield piece.first + row, np.unique(joined[a : b - width + 1])
            elif b > a:
                yield piece.first + row, whole_hash(hashes[a:b])
            else:
                yield piece.first + row, joined[:0]
