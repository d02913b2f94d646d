"""Words of a block of UTF-8 texts as numpy arrays: where they stand and a 64-bit hash of each.

All operators of this package that look at words share these few functions. They work on the
bytes of an Arrow string column, without a Python object per word, and run inside Spark tasks.
Hashes are polynomial sums over random byte values, finished by a mixing step; texts are taken
as equal where their 64-bit hashes are (for n compared texts the odds of one wrong pair are
about n * n / 2**65).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_P = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = U64(pow(int(_P), -1, 2**64))
_RANDOM = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=U64) | U64(1)
_powers: dict[int, np.ndarray] = {}
#: Bytes hashed at once; bounds the memory of the arrays below at about 40 bytes for each.
SEGMENT = 1 << 21


def _class_table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)])


#: Words between white space: all bytes but the space and the controls 9 to 13.
SPACED = _class_table(lambda b: b != 0x20 and not 9 <= b <= 13)
#: Letters, digits and everything outside ASCII.
ALNUM = _class_table(lambda b: b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)
SAME = np.arange(256, dtype=np.uint8)
#: A-Z in lower case, all else as it is.
LOWER = np.where((SAME >= 65) & (SAME <= 90), SAME + 32, SAME).astype(np.uint8)


class Block(NamedTuple):
    """Texts of some rows of an Arrow batch. Row i of the block has data[offsets[i]:offsets[i + 1]]."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


class Words(NamedTuple):
    """doc: row of the block; starts and ends: bytes of the block; hashes: of the folded word."""

    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def per_doc(self, rows: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=rows).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = np.atleast_1d(x)
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        base = np.full(max(n, SEGMENT + 1), _P_INV if inverse else _P, dtype=U64)
        base[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(base)
    return have[:n]


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def blocks(column: pa.Array, limit: int = SEGMENT) -> Iterator[Block]:
    """The column cut into runs of rows with up to `limit` bytes; one longer text is a block of its own."""
    data, offsets = string_buffers(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield Block(row, data[offsets[row] : offsets[to]], offsets[row : to + 1] - offsets[row])
        row = to


def _segments(block: Block, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of a long block at bytes that are in no word."""
    at, n = 0, len(block.data)
    while at < n:
        to = at + SEGMENT
        while to < n and is_word[block.data[to]]:
            to += 1
        yield at, min(to, n)
        at = to


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with (H[j] - H[i]) * inverse_powers[i] a hash of data[i:j]."""
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum(_RANDOM[data] * powers(len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts] + (ends - starts).astype(U64))


def words(block: Block, is_word: np.ndarray, fold: np.ndarray = SAME) -> Words:
    """All words of the block, in order. No word runs across the end of a text."""
    parts = []
    for at, to in _segments(block, is_word):
        data = block.data[at:to]
        inside = is_word[data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        cuts = block.offsets[(block.offsets > at) & (block.offsets < to)] - at
        begins[cuts] = inside[cuts]
        stops[cuts - 1] = inside[cuts - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        parts.append((starts + at, ends + at, span_hashes(prefix_hashes(fold[data]), starts, ends)))
    starts, ends, hashes = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64 if i < 2 else U64) for i in range(3))
    doc = np.searchsorted(block.offsets, starts, "right") - 1
    return Words(doc, starts, ends, hashes)


def lines(block: Block) -> Words:
    """The \\n-split lines of each text, empty ones included (an empty text has one)."""
    breaks = np.flatnonzero(block.data == 10)
    starts = np.sort(np.concatenate([breaks + 1, block.offsets[:-1]]), kind="stable")
    # A text that ends in a break has an empty last line, which begins where the next text does.
    doc = np.sort(np.concatenate([np.searchsorted(block.offsets, breaks, "right") - 1, np.arange(block.rows)]), kind="stable")
    ends = np.append(starts[1:] - 1, len(block.data))
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.zeros(0, bool)
    ends[last] = block.offsets[1:]
    return Words(doc, starts, ends, span_hashes(prefix_hashes(block.data), starts, ends))


def window_hashes(hashes: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words within one text, and the index of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = np.zeros(n, U64)
    for k in range(size):
        out = out * _P + hashes[k : k + n]
    first = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(out[first]), first


def with_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts, to find repeats inside each."""
    return hashes ^ mix(doc.astype(U64) + U64(0x51ED2701))
