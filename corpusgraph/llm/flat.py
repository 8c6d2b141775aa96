"""Text columns as flat byte buffers: the numpy view that the vectorised operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; bounds the temporaries of a worker (a single longer text is handled alone).
CHUNK_BYTES = 1 << 19

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(0, np.uint64), np.ones(0, np.uint64)]

_rng = np.random.default_rng(20240607)
RAW = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _freer():
    """What hands the allocator's free pages back to the system; nothing where the C library has no such call."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return lambda _: 0


_free = _freer()


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What an operator keeps from task to task, made once a worker; ``tidy`` lets it go when another operator's task begins."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def tidy(batches: Iterator[pa.RecordBatch], name: str | None = None) -> Iterator[pa.RecordBatch]:
    """The batches of an operator that keeps what it named, if anything.

    What other operators kept goes first, and after each batch memory that its work has left free goes back, so that a worker's
    size doesn't add up over operators.
    """
    if _kept.keys() - {name}:
        for other in _kept.keys() - {name}:
            del _kept[other]
        gc.collect()
        _free(0)
    for batch in batches:
        yield batch
        del batch
        if len(_powers[0]) > CHUNK_BYTES + 1:  # grown for a long text
            _powers[:] = [np.ones(0, np.uint64), np.ones(0, np.uint64)]
        pa.default_memory_pool().release_unused()
        _free(0)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty. The bytes are not copied."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def groups(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of at most ``limit`` bytes together (one text at least)."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums from which ``span_hash`` gets the hash of any span in one step."""
    if len(_powers[0]) < len(data):
        n = max(len(data), CHUNK_BYTES)
        for k, b in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(RAW[data] * _powers[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, the same wherever the span stands."""
    return mix((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the text that each is in."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~WHITE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    filled = off[:-1] < off[1:]
    first[off[:-1][filled]] = solid[off[:-1][filled]]
    last[off[1:][filled] - 1] = solid[off[1:][filled] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off[1:], starts, "right")


def shingles(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of k words inside one text, and the window's first word."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[k - 1 :])
    acc = hashes[at]
    for j in range(1, k):
        acc = acc * np.uint64(0x9FB21C651E98DF25) + hashes[at + j]
    return mix(acc), at


def per_text(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Sum of integer values by text."""
    return np.bincount(doc, weights=values, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of a value per byte by text; empty texts give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def later_copies(keys: np.ndarray) -> np.ndarray:
    """Mask of the keys that occur twice or more (True for every occurrence)."""
    order = np.argsort(keys)
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    mask = np.zeros(len(keys), bool)
    mask[order[1:]] |= same
    mask[order[:-1]] |= same
    return mask
