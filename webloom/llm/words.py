"""Words of whole texts as hashes, computed on UTF-8 bytes with numpy.

Both word patterns in use split on ASCII only and every byte of a non-ASCII character is 0x80 or more, so bytes decide exactly what the pattern on code points decides. Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK = 1 << 18  #: bytes hashed at once; bounds memory, for very long texts too
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 5

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
PLAIN = np.zeros(256, dtype=bool)
PLAIN[48:58] = PLAIN[97:123] = PLAIN[128:] = True


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, base, U)]), dtype=U)


_POW: dict[str, np.ndarray] = {}


def _pow_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW["up"]) < n:
        n = max(n, 2 * BLOCK)
        _POW["up"], _POW["down"] = _powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n)
    return _POW["up"], _POW["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pack(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column, and where each begins and ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _looked_up(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """table[data] for bytes, without an index of 8 bytes each."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


class Words:
    """starts, ends: bytes of each word; first[i]:first[i+1] are the words of text i; hash: one for each word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, pattern: np.ndarray, lower: bool = True):
        self.data = _looked_up(LOWER, data) if lower else data
        n = len(data)
        inside = _looked_up(pattern, self.data)
        cut = np.zeros(n + 1, bool)  # a text begins here
        cut[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut[1:n]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.hash = self._hashes(np.where(pattern, _BYTE, U(0)))

    def _hashes(self, weight: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.starts), U)
        k = 0
        while k < len(self.starts):
            at = self.starts[k]
            stop = max(k + 1, int(np.searchsorted(self.ends, at + BLOCK, "right")))
            to = self.ends[stop - 1]
            up, down = _pow_tables(to - at)
            value = np.take(weight, self.data[at:to])
            value *= up[: to - at]
            total = np.cumsum(value, out=value)  # outside words all weigh 0
            own = self.starts[k:stop] - at
            out[k:stop] = np.diff(total[self.ends[k:stop] - at - 1], prepend=U(0)) * down[own] + (self.ends[k:stop] - self.starts[k:stop]).astype(U)
            k = stop
        return mix(out)

    def text(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace")


_STEP = (_rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2)) + U(1)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words."""
    if len(words) < k:
        return np.zeros(0, U)
    total = words[: len(words) - k + 1] * _STEP[0]
    for j in range(1, k):
        total = total + words[j : len(words) - k + 1 + j] * _STEP[j % 64]
    return mix(total)


def grams_at(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The hashes of grams() at some places only."""
    total = np.zeros(len(at), U)
    for j in range(k):
        total += words[at + j] * _STEP[j % 64]
    return mix(total)


def whole(words: np.ndarray) -> int:
    """A hash of a whole sequence that is shorter than a gram."""
    return int(mix(np.array([(words * _STEP[: len(words)]).sum() + U(len(words))], U))[0])


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of a piece take about so many bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
