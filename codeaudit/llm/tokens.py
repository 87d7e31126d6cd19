"""Words and shingles of Arrow text columns, as arrays of 64-bit codes.

Used inside ``mapInArrow``: Spark cuts the table into batches, this module turns a few
rows at a time into numpy arrays.  Texts are read as UTF-8 bytes.  Every byte of a
character beyond ASCII is a word byte in both word classes, and lower-casing touches A-Z
only, so bytes and characters give the same words.

A word's code is a polynomial of its bytes, taken from running sums over the block and
scrambled; a shingle's code combines the codes of its words.  Equal words have equal
codes; different ones collide with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at a time; a longer text is handled in blocks that end between words.
BLOCK = 1 << 20

_U = np.uint64


def scramble(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit values in which every input bit reaches every output bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE_CODE = scramble(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _U(0x2545F4914F6CDD1D)


class WordClass(NamedTuple):
    """Which bytes belong to words, and the byte that each is read as."""

    inside: np.ndarray
    read_as: np.ndarray


def _word_class(separators: list[int]) -> WordClass:
    inside = np.ones(256, bool)
    inside[separators] = False
    read_as = np.arange(256)
    read_as[ord("A"):ord("Z") + 1] += 32
    return WordClass(inside, read_as.astype(np.uint8))


#: Runs of letters and digits; bytes beyond ASCII count as letters.
LETTERS = _word_class([
    b for b in range(128) if not (chr(b).isdigit() or chr(b).isalpha())
])
#: Runs of anything but blanks.
NONBLANK = _word_class([0x20, *range(0x09, 0x0E)])

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, up to the longest block so far."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK) + 1
        out = []
        for base in (_BASE, _BASE_INVERSE):
            powers = np.full(size, base, dtype=_U)
            powers[0] = 1
            out.append(np.multiply.accumulate(powers, dtype=_U))
        _powers[0] = have = (out[0], out[1])
    return have


class Words(NamedTuple):
    """Words of some rows: bounds in ``data`` and code of each, and each row's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    first: np.ndarray

    def text(self, lo: int, hi: int, read_as: np.ndarray) -> str:
        """Words lo to hi (exclusive), lower-cased, with one blank between them."""
        parts = [read_as[self.data[self.start[i]:self.end[i]]].tobytes() for i in range(lo, hi)]
        return b" ".join(parts).decode("utf-8", "replace")


def _block_words(block: np.ndarray, breaks: np.ndarray, kind: WordClass):
    """Bounds and codes of the words of a block; ``breaks`` are row starts inside it."""
    inside = kind.inside[block]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    cuts = breaks[(breaks > 0) & (breaks < len(block))]
    before[cuts] = False
    after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _power_tables(len(block))
    sums = np.zeros(len(block) + 1, dtype=_U)
    np.cumsum(_BYTE_CODE[kind.read_as[block]] * power[:len(block)], dtype=_U, out=sums[1:])
    code = (sums[end] - sums[start]) * inverse[start]
    return start, end, scramble(code + (end - start).astype(_U) * _STEP)


def _words(data: np.ndarray, offsets: np.ndarray, kind: WordClass) -> Words:
    starts, ends, codes, at = [], [], [], 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        if stop < len(data):
            gaps = np.flatnonzero(~kind.inside[data[at:stop]])
            while not len(gaps) and stop < len(data):  # a word longer than a block
                stop = min(stop + BLOCK, len(data))
                gaps = np.flatnonzero(~kind.inside[data[at:stop]])
            if stop < len(data):
                stop = at + int(gaps[-1]) + 1
        start, end, code = _block_words(data[at:stop], offsets - at, kind)
        starts.append(start + at)
        ends.append(end + at)
        codes.append(code)
        at = stop
    if not starts:
        empty = np.zeros(0, np.int64)
        return Words(data, empty, empty, np.zeros(0, _U), np.zeros(len(offsets), np.int64))
    start = np.concatenate(starts)
    return Words(data, start, np.concatenate(ends), np.concatenate(codes),
                 np.searchsorted(start, offsets))


def words_of(column: pa.Array, kind: WordClass) -> Iterator[tuple[int, Words]]:
    """(number of the first row, words) for consecutive runs of rows; a null text is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, bounds, values = column.buffers()
    offsets = np.frombuffer(bounds, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = int(np.searchsorted(offsets, offsets[row] + BLOCK, "right")) - 1
        stop = min(max(stop, row + 1), n)
        part = offsets[row:stop + 1] - offsets[row]
        yield row, _words(data[offsets[row]:offsets[stop]], part, kind)
        row = stop


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, code) of every run of ``k`` words inside one row."""
    n = len(words.code) - k + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, _U)
    rows = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    at = np.flatnonzero(rows[:n] == rows[k - 1:])
    return rows[at], at, _combined(words.code, at, k)


def _combined(code: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    total = np.full(len(at), k, dtype=_U)
    for j in range(k):
        total = total * _STEP + code[at + j]
    return scramble(total)


def whole_code(code: np.ndarray) -> np.uint64:
    """Code of a word sequence of any length as one shingle."""
    return _combined(code, np.zeros(1, np.int64), len(code))[0]


def signed(code: np.ndarray) -> np.ndarray:
    """Codes as Spark's longs."""
    return code.view(np.int64)


# --- a set of codes as a bitmap of bounded size -------------------------------------------

#: Largest bitmap, in bits (16 MB); more codes only raise the share of false positives.
MAX_BITS = 1 << 27


def bitmap_of(codes, column: str = "code") -> np.ndarray:
    """Bitmap of the codes of a DataFrame, made by Spark and small enough to send to all tasks.

    A bit that is not set proves that a code is not there; a set one must be checked.
    """
    from pyspark.sql import functions as F

    count = codes.count()
    bits = 1 << 16
    while bits < 64 * count and bits < MAX_BITS:
        bits *= 2
    place = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1
    parts = (
        codes.select(F.bitmap_bucket_number(place).alias("bucket"),
                     F.bitmap_bit_position(place).alias("bit"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
        .collect()  # 4 KB for each 32,768 bits: never more than MAX_BITS
    )
    out = np.zeros(bits // 8, np.uint8)
    for part in parts:
        at = (part.bucket - 1) * 4096
        out[at:at + 4096] = np.frombuffer(bytes(part.bits), np.uint8)[:len(out) - at]
    return out


def in_bitmap(bitmap: np.ndarray, code: np.ndarray) -> np.ndarray:
    place = (code & _U(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
