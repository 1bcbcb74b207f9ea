"""Array kernels over the bytes of an Arrow text column.

Every function here works on whole columns of bytes with numpy; none loops over characters or
tokens in Python.  A null text is an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial token hash, and the finaliser's constants.
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)

#: Bytes handled at a time; a longer text is a chunk of its own.
CHUNK = 1 << 20


def column(arr) -> pa.Array:
    """One large_string array without nulls."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    arr = arr.cast(pa.large_string())
    return arr.fill_null("") if arr.null_count else arr


def text_buffers(arr) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets[i]:offsets[i+1] are text i."""
    arr = column(arr)
    bufs = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes each."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


_pow = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        full = np.full(n, _P, np.uint64)
        full[0] = 1
        _pow = np.cumprod(full)
    return _pow[:n]


_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_inv = np.ones(1, np.uint64)


def _inverses(n: int) -> np.ndarray:
    global _inv
    if len(_inv) < n:
        full = np.full(n, _INV, np.uint64)
        full[0] = 1
        _inv = np.cumprod(full)
    return _inv[:n]


def hash_ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[starts[i]:ends[i]]; equal byte strings have equal hashes."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(n), out=total[1:])
    h = (total[ends] - total[starts]) * _inverses(n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _M2)


def runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that no index of ``breaks`` falls inside."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    end = mask.copy()
    end[:-1] &= ~mask[1:]
    b = breaks[(breaks > 0) & (breaks < len(mask))]
    begin[b] = mask[b]
    end[b - 1] = mask[b - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def owner(off: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Index of the text that holds each position (positions ascend)."""
    counts = np.diff(np.searchsorted(pos, off))
    return np.repeat(np.arange(len(off) - 1), counts)


#: Lower case of ASCII bytes; other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: White space inside a line, and the line end.
SPACE = np.zeros(256, bool)
SPACE[[9, 11, 12, 13, 32]] = True
LINE_END = 10


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte letters U+00C0 to U+00DE."""
    out = LOWER[data]
    if len(out) > 1:
        up = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][up] += 0x20
    return out


def add_per(off_idx: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    return np.bincount(off_idx, weights=weights, minlength=n)


def segment_reduce(ufunc, values: np.ndarray, counts: np.ndarray, empty) -> np.ndarray:
    """ufunc.reduce over consecutive segments of ``counts`` values each; ``empty`` for none."""
    out = np.full(len(counts), empty, values.dtype)
    some = counts > 0
    if some.any():
        at = (np.cumsum(counts) - counts)[some]
        out[some] = ufunc.reduceat(values, at)
    return out
