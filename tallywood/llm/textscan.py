"""Vectorised scanning of Arrow string columns: words, word hashes and shingles.

Every function works on UTF-8 bytes, so a word is a maximal run of bytes other than
blank, tab, newline, vertical tab, form feed and carriage return, with A-Z lowered.
A batch is cut into pieces of whole texts (a text is never split), so the memory in
use depends on the piece size and on the longest text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20
_U = np.uint64

_BYTE = np.arange(256, dtype=np.uint8)
SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_EACH = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_VALUE = _EACH[LOWER]
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 4096)
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, dtype=_U)
            up[0] = 1
            down = np.full(size, _INVERSE, dtype=_U)
            down[0] = 1
            _powers[:] = [np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)]
    return _powers[0], _powers[1]


@dataclass
class Piece:
    """Texts lo..hi of a batch; offs are byte offsets into data."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo


def pieces(column: pa.Array | pa.ChunkedArray, size: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cut a string column into pieces of whole texts of about ``size`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    raw = column.buffers()
    offs = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Piece(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


_LETTER = ((_BYTE >= 97) & (_BYTE <= 122)) | ((_BYTE >= 65) & (_BYTE <= 90)) | (_BYTE >= 128) | ((_BYTE >= 48) & (_BYTE <= 57))


def stripped(piece: Piece) -> Piece:
    """The piece with marks that are neither letters nor digits blanked, so that 'x,' and 'x' are one word."""
    data = np.where(_LETTER[piece.data], piece.data, np.uint8(32)).astype(np.uint8)
    return Piece(piece.lo, piece.hi, data, piece.offs)


@dataclass
class Words:
    """Word spans and 64-bit hashes of a piece; text d has words offs[d]..offs[d+1]."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offs: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), np.diff(self.offs))


def words(piece: Piece, lower: bool = True) -> Words:
    """Word spans and hashes; hashes are of the lower-cased words unless told otherwise."""
    data, n = piece.data, len(piece.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, _U), np.zeros(len(piece) + 1, np.int64))
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = piece.offs[1:-1]
    at = edge[(edge > 0) & (edge < n)]
    first[at] = solid[at]
    last[at - 1] = solid[at - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    up, down = _power_tables(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, _U)
        np.cumsum((_VALUE if lower else _EACH)[data] * up[:n], out=total[1:], dtype=_U)
        hashes = mix((total[ends] - total[starts]) * down[starts])
    return Words(starts, ends, hashes, np.searchsorted(starts, piece.offs))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive entries (positions 0..n-k)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = np.zeros(n, _U)
        for j in range(k):
            out = mix(out * _U(0xD6E8FEB86659FD93) + hashes[j : j + n] + _U(j + 1))
    return out


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-shingles of one text; with fewer words the sequence is one shingle; no words: empty."""
    n = len(hashes)
    if not n:
        return np.zeros(0, _U)
    if n < k:
        return mix(shingle_hashes(hashes, n) ^ _U(n))
    return np.unique(shingle_hashes(hashes, k))


def word_strings(piece: Piece, w: Words, index: np.ndarray) -> list[str]:
    """Lower-cased words at the given positions."""
    raw = LOWER[piece.data].tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.starts[index].tolist(), w.ends[index].tolist())]
