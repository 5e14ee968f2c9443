"""Vectorised text features over Arrow string columns.

A text is read as its UTF-8 bytes, never as Python characters: a batch of rows
is one byte array plus row offsets, and words, shingles and n-grams are found
and hashed by array arithmetic.  Work is cut into blocks of about ``BLOCK``
bytes so that memory stays bounded whatever the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = (1 << 20) - 1
U64 = np.uint64
_RNG = np.random.default_rng(20240229)
#: One random 64-bit value a byte, and an odd multiplier with its inverse mod 2**64.
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
MULT = 0x9E3779B97F4A7C15
INV = pow(MULT, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The white space of a word ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything but ASCII letters and digits and the bytes of other characters.
NOT_ALNUM = np.ones(256, dtype=bool)
NOT_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    np.multiply.accumulate(out, out=out)
    return out


_POW: list[np.ndarray] = [_powers(MULT, 1 << 16), _powers(INV, 1 << 16)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and MULT**-i for i < n."""
    if len(_POW[0]) < n:
        size = 1 << (n - 1).bit_length()
        if size > 1 << 23:
            return _powers(MULT, n), _powers(INV, n)
        _POW[0], _POW[1] = _powers(MULT, size), _powers(INV, size)
    return _POW[0][:n], _POW[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U64(33))
    h = h * U64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U64(33))


class Prefix:
    """Hashes of any substring of one buffer, from one cumulative sum."""

    def __init__(self, lowered: np.ndarray):
        p, self.inv = powers(len(lowered) + 1)
        self.sums = np.zeros(len(lowered) + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[lowered] * p[:-1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inv[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """The words of one block: their hashes, the row of each, their places."""

    hashes: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    #: Per requested length, the hash of the word's first bytes, 0 for a word that is no longer.
    heads: tuple[np.ndarray, ...] = ()


def text_array(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = int(offsets[0]) if len(offsets) else 0
    return raw[lo : int(offsets[-1]) if len(offsets) else 0], offsets - lo


def blocks(column, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of about ``size`` bytes each; a long text stands alone."""
    raw, offsets = text_array(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        hi = min(hi, n, lo + 4096)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _scan(lowered: np.ndarray, offsets: np.ndarray, sep: np.ndarray, heads: tuple[int, ...]) -> Words:
    inside = ~sep[lowered]
    n = len(lowered)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets[:-1]] = True
    first[n] = True
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = True
        np.logical_or(~inside[:-1], first[1:n], out=before[1:])
    start = np.flatnonzero(inside & before)
    after = np.empty(n, dtype=bool)
    if n:
        after[-1] = True
        np.logical_or(~inside[1:], first[1:n], out=after[:-1])
    end = np.flatnonzero(inside & after) + 1
    row = np.searchsorted(offsets[1:], start, side="right")
    p = Prefix(lowered)
    first_bytes = tuple(np.where(end - start > k, p.hash(start, np.minimum(end, start + k)), U64(0)) for k in heads)
    return Words(p.hash(start, end), row, start, end, first_bytes)


def words(raw: np.ndarray, offsets: np.ndarray, sep: np.ndarray = SPACE, heads: tuple[int, ...] = ()) -> Words:
    """Lower-cased (A-Z) words of a block, in order.

    A text longer than four blocks is scanned in pieces cut at separators, so
    its temporaries stay small; only its word hashes and places are kept.
    """
    lowered = LOWER[raw]
    if len(raw) <= 4 * BLOCK or len(offsets) > 2:
        return _scan(lowered, offsets, sep, heads)
    parts, at = [], 0
    while at < len(raw):
        cut = min(at + 4 * BLOCK, len(raw))
        while cut < len(raw):
            gaps = np.flatnonzero(sep[lowered[at:cut]])
            if len(gaps):
                cut = at + int(gaps[-1]) + 1
                break
            cut = min(cut + 4 * BLOCK, len(raw))
        w = _scan(lowered[at:cut], np.array([0, cut - at]), sep, heads)
        parts.append((w.hashes, w.start + at, w.end + at, *w.heads))
        at = cut
    hashes, start, end, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
    return Words(hashes, np.zeros(len(hashes), dtype=np.int64), start, end, tuple(rest))


_SHINGLE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)


def shingles(w: Words, rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of each row, sorted by (row, hash).

    A row with fewer words than ``width`` has its whole sequence as one shingle;
    a row without words has none.
    """
    n = len(w.hashes)
    count = np.bincount(w.row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    short = (count > 0) & (count < width)
    if n >= width:
        whole = n - width + 1
        h = np.zeros(whole, dtype=np.uint64)
        for i in range(width):
            h += w.hashes[i : i + whole] * _SHINGLE[i]
        same = w.row[:whole] == w.row[width - 1 :]
        h, row = mix(h[same]), w.row[:whole][same]
    else:
        h, row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if short.any():
        extra = np.empty(int(short.sum()), dtype=np.uint64)
        at = np.flatnonzero(short)
        for k, r in enumerate(at):
            own = w.hashes[first[r] : first[r] + count[r]]
            extra[k] = mix(np.array([int((own * _SHINGLE[: len(own)]).sum(dtype=np.uint64)) ^ (0x5A5A << 32 | len(own))], dtype=np.uint64))[0]
        h, row = np.concatenate([h, extra]), np.concatenate([row, at])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]
