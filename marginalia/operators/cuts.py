"""Words of whole texts in Arrow batches: offsets, distinct words, runs of words, places of listed surfaces.

A batch is worked through in slices of bounded size, and what a slice gives
leaves at once, so a worker holds a slice whatever the table's size.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

#: Bytes of text that are cut together; a longer text is a slice of its own.
SLICE = 2 << 20
#: Bits of a filter (of listed surfaces, of shared ids): 4 MB whatever their number.
BITS = 1 << 25
#: Words that a worker counts at a time before it passes their counts on.
HELD = 1 << 19
#: Words of a row of counts.
ROW = 1 << 12
#: Has a character whose lower case may depend on its neighbours, be two characters, or differ between Python's and Spark's tables.
DOUBTFUL = re.compile("[^\x00-\u012f\u0131-\u03a2\u03a4-\u109f\u2000-\u20ff\u2190-\u245f\u2500-\u2bff\u3000-\u9fff\uac00-\ud7a3\ue000-\uf8ff\ufe00-\ufeff\ufff0-\uffff\U0001f000-\U0001faff]")


@functools.cache
def space() -> np.ndarray:
    """By code point: white space."""
    out = np.zeros(0x110000, bool)
    out[[*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
    return out


@functools.cache
def letter() -> np.ndarray:
    """By code point: letters, digits and the underscore."""
    out = np.fromiter((unicodedata.category(c)[0] in "LN" for c in map(chr, range(0x110000))), bool, 0x110000)
    out[ord("_")] = True
    return out


def slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of each slice; a null text is empty."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, ends = 0, np.cumsum(sizes, dtype=np.int64)
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
        yield at, [t or "" for t in texts.slice(at, to - at).to_pylist()]
        at = to


def cut(texts: list[str], letters: bool) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts put together, and of each word its row, its start and end there, and its row's start.

    Words are runs of letters, digits and underscores, or else of anything but white space.
    """
    whole = "".join(texts)
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    inside = letter()[codes] if letters else ~space()[codes]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    firsts = np.cumsum(sizes) - sizes
    # A word begins where none goes on from the character before, or where its text begins.
    fresh = np.zeros(len(codes) + 1, bool)
    fresh[firsts] = True
    behind = np.concatenate(([False], inside, [False]))
    starts = np.flatnonzero(inside & (~behind[:-2] | fresh[:-1]))
    fresh[len(codes)] = True
    ends = np.flatnonzero(inside & (~behind[2:] | fresh[1:])) + 1
    row = np.searchsorted(firsts, starts, side="right") - 1
    return whole, row, starts, ends, firsts


def code_points(raw: bytes, n: int) -> np.ndarray:
    """Where each of the ``n`` code points of UTF-8 bytes begins, and where the last ends."""
    if len(raw) == n:
        return np.arange(n + 1)
    return np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))


def strings(whole: str, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces from start to end, which do not meet, as one array."""
    raw = whole.encode()
    at = code_points(raw, len(whole))
    lo, hi = at[starts], at[ends]
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[lo] += 1
    edge[hi] -= 1
    kept = np.frombuffer(raw, np.uint8)[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    offsets = np.concatenate(([0], np.cumsum(hi - lo))).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(kept.tobytes()))


def tokens(passages: DataFrame, pid: str, text: str, before: int = 0, bits: np.ndarray | None = None) -> DataFrame:
    """pid, pos, start, end, word of every run of anything but white space.

    ``before`` adds the words that precede it, ``before1`` the nearest; ``bits``
    (of :func:`listed_bits`) adds ``listed``, whether the filter lets it through.
    """
    fields = [StructField(c, IntegerType()) for c in ("pos", "start", "end")] + [StructField(c, StringType()) for c in ("word", *[f"before{k}" for k in range(1, before + 1)])]
    fields += [] if bits is None else [StructField("listed", BooleanType())]
    kind = StructType([passages.schema[pid], *fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                whole, row, starts, ends, firsts = cut(texts, letters=False)
                n = np.searchsorted(row, np.arange(len(texts)))
                pos = np.arange(len(row)) - n[row]
                words = strings(whole, starts, ends)
                nearest = [words.take(pa.array(np.arange(len(row)) - k, pa.int64(), mask=pos < k)) for k in range(1, before + 1)]
                own = [pa.array(x.astype(np.int32)) for x in (pos, starts - firsts[row], ends - firsts[row])]
                passed = [] if bits is None else [pa.array(Pieces(whole).let_through(starts, ends, bits))]
                columns = [batch.column(0).take(pa.array(row + first)), *own, words, *nearest, *passed]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kind])

    return passages.select(pid, text).mapInArrow(read, kind)


def terms(passages: DataFrame, pid: str = "pid", text: str = "text") -> DataFrame:
    """pid, term: the distinct words of each text in lower case, each once in its row."""
    kind = StructType([passages.schema[pid], StructField("words", ArrayType(StringType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                # str.split() parts at the same white space.
                words = pa.array([list(dict.fromkeys(t.split())) for t in texts], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), words], names=[pid, "words"])

    each = passages.select(pid, text).mapInArrow(read, kind)
    return each.select(pid, F.explode(F.array_distinct(F.transform("words", F.lower))).alias("term"))


def term_counts(passages: DataFrame, pid: str = "pid", text: str = "text", apart: np.ndarray | None = None) -> DataFrame:
    """pid, term, n: in how many texts the lower-case words stand, added up in the worker over texts that follow one another.

    ``pid`` is null there.  Ids that the filter ``apart`` (of :func:`id_bits`)
    has keep theirs: a row for each word of each of their texts.
    """
    kind = StructType([passages.schema[pid], StructField("words", ArrayType(StringType())), StructField("ns", ArrayType(LongType()))])
    kind[0].nullable = True
    names = [f.name for f in kind]

    def added_up(held: Counter, ids: pa.DataType) -> pa.RecordBatch:
        offsets = pa.array([*range(0, len(held), ROW), len(held)], pa.int32())
        words, ns = (pa.ListArray.from_arrays(offsets, pa.array(list(x), t)) for x, t in ((held.keys(), pa.string()), (held.values(), pa.int64())))
        return pa.RecordBatch.from_arrays([pa.nulls(len(words), ids), words, ns], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        ids = None
        for batch in batches:
            ids = batch.column(0).type
            own = np.zeros(len(batch), bool) if apart is None else has(apart, batch.column(2).to_numpy())
            for first, texts in slices(batch.column(1)):
                # What is not added up leaves as it is written: Spark lowers it and makes it single within its row.
                rows = []
                for i, t in enumerate(texts):
                    if own[first + i] or (not t.isascii() and DOUBTFUL.search(t)):
                        rows.append(i)
                    else:
                        held.update(set(t.lower().split()))  # str.split() parts at the same white space
                        if len(held) > HELD:
                            yield added_up(held, ids)
                            held.clear()
                if rows:
                    at = np.array(rows)
                    words = pa.array([list(dict.fromkeys(texts[i].split())) for i in rows], pa.list_(pa.string()))
                    keys = batch.column(0).take(pa.array(at + first, pa.int64(), mask=~own[at + first]))
                    yield pa.RecordBatch.from_arrays([keys, words, pa.nulls(len(rows), pa.list_(pa.int64()))], names=names)
        if held:
            yield added_up(held, ids)

    each = passages.select(pid, text, *([] if apart is None else [id_spot(pid).alias("__at")])).mapInArrow(read, kind)
    once = F.transform(F.array_distinct(F.transform("words", F.lower)), lambda w: F.struct(w.alias("term"), F.lit(1).cast("long").alias("n")))
    counted = F.transform(F.arrays_zip("words", "ns"), lambda x: F.struct(x["words"].alias("term"), x["ns"].alias("n")))
    return each.select(pid, F.inline(F.when(F.col("ns").isNull(), once).otherwise(counted)))


def runs_of_words(passages: DataFrame, key: str, width: int, text: str = "text") -> DataFrame:
    """key, shingle: the distinct runs of ``width`` words of each text, one space between; each once in its row."""
    kind = StructType([passages.schema[key], StructField("shingle", StringType())])

    def made(t: str) -> list[str]:
        w = t.split()
        return list(dict.fromkeys(map(" ".join, zip(*[w[i:] for i in range(width)], strict=False))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                each = [made(t) for t in texts]
                at = np.repeat(np.arange(first, first + len(texts)), [len(x) for x in each])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([s for x in each for s in x], pa.string())], names=[key, "shingle"])

    return passages.select(key, text).mapInArrow(read, kind)


@functools.cache
def folded() -> np.ndarray:
    """By code point: its lower case; both small sigmas are one."""
    out = np.fromiter((ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(0x110000))), np.uint64, 0x110000)
    out[ord("ς")] = ord("σ")
    return out


@functools.cache
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    out = np.full((2, size + 1), 1, np.uint64)
    out[0, 1:], out[1, 1:] = base, pow(base, -1, 1 << 64)
    return tuple(np.multiply.accumulate(out, axis=1))


class Pieces:
    """Bits in the filter of pieces of a text: a sum over its code points gives each in a few steps, however long it is.

    Pieces that are equal in lower case share their bit.
    """

    def __init__(self, whole: str):
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        self.up, self.down = powers(SLICE) if len(codes) <= SLICE else powers.__wrapped__(len(codes))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(folded()[codes] * self.up[: len(codes)], out=self.sums[1:])
        #: The one letter that is two in lower case.
        self.double = np.flatnonzero(codes == ord("İ")) if "İ" in whole else None

    def spots(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)

    def let_through(self, starts: np.ndarray, ends: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Whether the filter has the bit of each piece from start to end; what holds the double letter always passes."""
        out = has(bits, self.spots(starts, ends))
        return out if self.double is None else out | (np.searchsorted(self.double, ends) > np.searchsorted(self.double, starts))


@F.pandas_udf(LongType())
def placed(surfaces: pd.Series) -> pd.Series:
    texts = [s.replace("İ", "i̇") for s in surfaces]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    return pd.Series(Pieces("".join(texts)).spots(ends - sizes, ends))


def listed_bits(surfaces: DataFrame) -> np.ndarray:
    """The filter of column ``surface``, a bit for each; it is made where they are, and at most 4 MB reach the driver."""
    return filter_of(surfaces, placed("surface"))


def id_spot(pid: str) -> Column:
    """An id's bit in the filter."""
    return F.pmod(F.xxhash64(pid), F.lit(BITS))


def id_bits(ids: DataFrame, pid: str) -> np.ndarray | None:
    """The same of ids of any kind; none if there is no id."""
    bits = filter_of(ids, id_spot(pid))
    return bits if bits.any() else None


def filter_of(rows: DataFrame, spot: Column) -> np.ndarray:
    at = rows.select((spot + 1).alias("at"))  # bitmap functions count from 1
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for r in parts:
        lo = (r["k"] - 1) * len(r["bits"])
        out[lo : lo + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return out


def has(bits: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Whether the filter has each bit."""
    return (bits[spots >> 3] >> (spots & 7).astype(np.uint8) & 1).astype(bool)


def places(passages: DataFrame, bits: np.ndarray, widths: list[int], pid: str, text: str) -> DataFrame:
    """pid, start, gram of the runs of as many words as ``widths`` say that the filter lets through, with what stands between.

    Few that are not listed pass, and none that is listed is kept back.
    """
    kind = StructType([passages.schema[pid], StructField("start", IntegerType()), StructField("gram", StringType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                whole, row, starts, ends, firsts = cut(texts, letters=True)
                pieces = Pieces(whole)
                rows, begins, grams = [], [], []
                for k in widths:
                    if len(starts) < k:
                        continue
                    one = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :])
                    lo, hi = starts[one], ends[one + k - 1]
                    met = np.flatnonzero(pieces.let_through(lo, hi, bits))
                    rows.append(row[one[met]])
                    begins.append(lo[met])
                    grams += [whole[a:b] for a, b in zip(lo[met].tolist(), hi[met].tolist(), strict=True)]
                if grams:
                    own, start = np.concatenate(rows), np.concatenate(begins)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own + first)), pa.array((start - firsts[own]).astype(np.int32)), pa.array(grams, pa.string())], names=[f.name for f in kind])

    return passages.select(pid, text).mapInArrow(read, kind)
