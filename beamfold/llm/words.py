"""Word tables of whole texts, computed over the bytes of an Arrow batch at once.

A batch is cut into blocks of whole texts of about ``BLOCK`` bytes. Within a block every word gets its text, its byte
range and a 64-bit hash from prefix sums, so that nothing runs word by word. Two words of one content have one hash
wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def series(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * _ODD)


_BYTE = series(1, 256)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LONG = BLOCK + BLOCK // 2
_kept: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n. Only tables of the usual size are kept, as this module's state can be sent along
    with a function that uses it."""
    if n <= _LONG and _kept:
        return _kept[0]
    p = 0x5851F42D4C957F2D
    tables = tuple(
        np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, _LONG) - 1, x, np.uint64))])
        for x in (p, pow(p, -1, 1 << 64)))
    if n <= _LONG:
        _kept.append(tables)
    return tables


@dataclass
class Block:
    """Whole texts next to each other: text i is data[offsets[i]:offsets[i + 1]]; first is its row in the batch."""
    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def blocks(texts: pa.Array | pa.ChunkedArray, size: int = BLOCK) -> Iterator[Block]:
    """Cut a string column; a null counts as an empty text, and a text is never cut."""
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        chunk = pc.fill_null(chunk.cast(pa.large_string()), "")
        if not len(chunk):
            continue
        _, index, data = chunk.buffers()
        offsets = np.frombuffer(index, np.int64)[chunk.offset:chunk.offset + len(chunk) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        at = 0
        while at < len(chunk):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield Block(at, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at])
            at = end


@dataclass
class Words:
    """Words of a block in order: text (row in the block), byte range, hash; counts: words of each text."""
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    counts: np.ndarray
    firsts: np.ndarray

    def index(self) -> np.ndarray:
        """Place of each word within its text."""
        return np.arange(len(self.text)) - self.firsts[self.text]


def prefix(block: Block, lower: bool = False) -> np.ndarray:
    """Running hash before each byte of the block."""
    n = len(block.data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[block.data] * _powers(n + 1)[0][:n], out=total[1:])
    return total


def ranges_hash(block: Block, start: np.ndarray, end: np.ndarray, lower: bool = False, total: np.ndarray | None = None) -> np.ndarray:
    """Hash of each byte range of the block; total: its prefix(), if at hand."""
    total = prefix(block, lower) if total is None else total
    return mix((total[end] - total[start]) * _powers(len(block.data) + 1)[1][start] + (end - start).astype(np.uint64) * _ODD)


def words(block: Block, kind: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of bytes that kind marks; runs end with their text."""
    inside = np.zeros(len(block.data) + 2, bool)
    inside[1:-1] = kind[block.data]
    edge = inside[1:] != inside[:-1]
    # Where two texts meet inside a run, one word ends and the next one starts.
    meet = block.offsets[1:-1]
    meet = np.unique(meet[inside[meet] & inside[meet + 1]]) if len(meet) else meet
    at = np.flatnonzero(edge)
    if len(meet):
        at = np.sort(np.concatenate([at, meet, meet]))
    start, end = at[::2], at[1::2]
    text = np.searchsorted(block.offsets, start, "right") - 1
    counts = np.bincount(text, minlength=block.rows)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return Words(text, start, end, ranges_hash(block, start, end, lower), counts, firsts)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of a text, and the index of the first word of each."""
    many = len(w.hash) - n + 1
    if many <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keep = np.flatnonzero(w.text[:many] == w.text[n - 1:])
    factor = series(2, n)
    h = np.zeros(len(keep), np.uint64)
    for i in range(n):
        h += mix(w.hash[keep + i] + factor[i]) * (factor[i] | np.uint64(1))
    return mix(h), keep


def per_text(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values over consecutive runs of the given lengths (empty runs give 0)."""
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]
