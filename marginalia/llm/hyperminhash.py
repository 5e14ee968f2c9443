"""HyperMinHash sketches: leading-zero counts plus mantissa bits per bucket.

The shingle hashes of a set are dealt to ``BUCKETS`` buckets by their top bits;
of the smallest in each, the number of leading zeros (6 bits) and the next
``MANTISSA`` bits are stored, 16 bits a register.  A bucket without a hash
borrows from one that has, in an order fixed for each bucket, so registers of
two sets agree with the probability of their Jaccard similarity however small
the sets are.
"""

from __future__ import annotations

import numpy as np

from marginalia.llm.textblocks import mix

BUCKET_BITS = 8
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
REST = 64 - BUCKET_BITS

_ORDER = np.random.default_rng(77).permuted(np.tile(np.arange(BUCKETS, dtype=np.uint16), (BUCKETS, 1)), axis=1)


def compress(rest: np.ndarray) -> np.ndarray:
    """(leading zeros, mantissa) of values below 2**REST, as one 16-bit number."""
    value = np.maximum(rest, np.uint64(1))
    top = np.floor(np.log2(value.astype(np.float64))).astype(np.int64)
    # The float may round up to the next power of two.
    top -= (np.uint64(1) << top.astype(np.uint64)) > value
    zeros = (REST - 1 - top).astype(np.uint64)
    shift = top - MANTISSA
    low = np.where(shift >= 0, value >> np.maximum(shift, 0).astype(np.uint64), value << np.maximum(-shift, 0).astype(np.uint64))
    return ((zeros << np.uint64(MANTISSA)) | (low & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set of distinct hashes in ascending order."""
    bucket = (hashes >> np.uint64(REST)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    full = bucket[first]
    smallest = hashes[first] & np.uint64((1 << REST) - 1)
    out = np.empty(BUCKETS, dtype=np.uint16)
    packed = compress(smallest)
    out[full] = packed
    if len(full) < BUCKETS:
        empty = np.ones(BUCKETS, dtype=bool)
        empty[full] = False
        bare = np.flatnonzero(empty)
        out[bare] = packed[_ORDER[np.ix_(bare, full)].argmin(axis=1)]
    return out


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key a band for each sketch of a (n, BUCKETS) matrix."""
    bands = BUCKETS // rows
    r = registers[:, : bands * rows].reshape(len(registers), bands, rows).astype(np.uint64)
    h = np.arange(bands, dtype=np.uint64)[None, :] + np.uint64(0x1234567)
    h = np.broadcast_to(h, (len(registers), bands))
    for k in range(rows):
        h = mix(h * np.uint64(0x100000001B3) + r[:, :, k])
    return h


_EDGES = 2.0 ** -np.arange(0, REST + 1)


def levels(size: np.ndarray) -> np.ndarray:
    """For sets of these sizes, the probability of each count of leading zeros in a register."""
    load = np.maximum(np.asarray(size, dtype=np.float64) / BUCKETS, 1.0)[:, None]
    below = -np.expm1(load * np.log1p(-np.minimum(_EDGES, 1 - 1e-12))[None])
    return below[:, :-1] - below[:, 1:]


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers of two disjoint sets that agree by accident.

    For each count of leading zeros, the probability that both smallest hashes
    have it, over the mantissas that could differ.
    """
    return (levels(n) * levels(m)).sum(1) / (1 << MANTISSA)


def jaccard(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected estimates for the rows of two register matrices of sets of sizes n and m."""
    agree = (a == b).mean(axis=1)
    accident = chance(n, m)
    return np.clip((agree - accident) / (1 - accident), 0, 1)
