"""Vectorised word hashing for the operators that may leave the JVM.

A batch of texts becomes one byte buffer; words are the maximal runs of bytes
outside ``0x20`` and ``0x09-0x0D`` (UTF-8 never uses those bytes inside a longer
code point, so byte runs and code point runs agree).  Every word gets a 64-bit
hash from prefix sums of a polynomial over its bytes, so no Python loop runs
over words.  Hashes do not depend on the batch, the process or the machine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C13)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes, or hashes, that are summed at a time; the tables of powers are of this length.
_CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _byte_values(fold_ascii: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    if fold_ascii:
        values = values.copy()
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


@lru_cache(maxsize=1)
def _space() -> np.ndarray:
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return space


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of them."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, dtype=np.uint64)])) for b in (_BASE, _BASE_INV)]
    return _powers[0], _powers[1]


class Words:
    """Words of a batch: ``hashes`` of all of them and ``bounds`` of each text's."""

    __slots__ = ("hashes", "bounds", "blob", "starts", "ends")

    def __init__(self, hashes, bounds, blob, starts, ends):
        self.hashes, self.bounds, self.blob, self.starts, self.ends = hashes, bounds, blob, starts, ends

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]

    def word_bytes(self, i: int) -> list[bytes]:
        lo, hi = self.bounds[i], self.bounds[i + 1]
        return [self.blob[s:e] for s, e in zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist())]


def _long_word(values: np.ndarray, data: np.ndarray) -> np.uint64:
    """The polynomial of one word, piece by piece: a piece at ``i`` counts base**i times."""
    power, _ = _power_tables(_CHUNK)
    total = 0
    for i in range(0, len(data), _CHUNK):
        piece = data[i : i + _CHUNK]
        total += int(np.sum(values[piece] * power[: len(piece)], dtype=np.uint64)) * pow(int(_BASE), i, 1 << 64)
    return np.uint64(total % (1 << 64))


def hash_words(texts, fold_ascii: bool = False) -> Words:
    """``Words`` of ``texts`` (None counts as empty)."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else bytes(t) for t in texts]
    blob = b"\n".join(raw) + b"\n"
    data = np.frombuffer(blob, dtype=np.uint8)
    edge = np.diff(_space()[data].view(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    values = _byte_values(fold_ascii)
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    while lo < len(starts):  # in pieces that begin at a word, so that the tables of powers stay short
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + _CHUNK, side="right")))
        at, to = int(starts[lo]), int(ends[hi - 1])
        if to - at > _CHUNK:  # one word longer than a piece
            out[lo] = _long_word(values, data[at:to])
            lo = hi
            continue
        power, inverse = _power_tables(to - at + 1)
        sums = np.zeros(to - at + 1, dtype=np.uint64)
        np.cumsum(values[data[at:to]] * power[: to - at], out=sums[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = (sums[e] - sums[s]) * inverse[s]
        lo = hi
    lengths = np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw))
    borders = np.concatenate([[0], np.cumsum(lengths)])
    bounds = np.searchsorted(starts, borders)
    return Words(mix(out + (ends - starts).astype(np.uint64)), bounds, blob, starts, ends)


def text_pieces(column, limit: int = 1 << 20):
    """(lo, hi, texts) of an Arrow string column in even pieces of about ``limit`` bytes, one text at least.

    Only one piece exists as Python strings at a time.
    """
    import pyarrow.compute as pc

    sizes = np.cumsum(np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(float)))
    total = sizes[-1] if len(sizes) else 0
    parts = max(1, round(total / limit))
    inner = np.searchsorted(sizes, total * np.arange(1, parts) / parts) + 1
    cuts = np.unique(np.concatenate([[0], inner, [len(column)]])).astype(int).tolist()
    for lo, hi in zip(cuts, cuts[1:]):
        yield lo, hi, column.slice(lo, hi - lo).to_pylist()


def release() -> None:
    """Give memory that this worker no longer uses back to the system; idle workers stay alive for a while."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@lru_cache(maxsize=16)
def _window_factors(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive entries (none if there are fewer)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    if n <= 16:
        total = np.zeros(count, dtype=np.uint64)
        for j, f in enumerate(_window_factors(n)):
            total += hashes[j : j + count] * f
        return mix(total)
    out = np.empty(count, dtype=np.uint64)
    for lo in range(0, count, _CHUNK):  # a window's value does not depend on where its piece begins
        part = hashes[lo : min(count, lo + _CHUNK) + n - 1]
        power, inverse = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        out[lo : lo + len(part) - n + 1] = (sums[n:] - sums[:-n]) * inverse[: len(part) - n + 1]
    return mix(out)
