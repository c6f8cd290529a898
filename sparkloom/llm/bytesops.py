"""Vectorised work on the UTF-8 bytes of an Arrow text column: words, lines, hashes.

Every function takes whole texts.  Batches are cut between documents into pieces of
a few MB, so memory follows the longest document and not the batch.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
PIECE = 2 << 20
#: One random 64-bit value for each byte value.
VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z are lower-cased.
WORDISH = np.zeros(256, bool)
WORDISH[0x30:0x3A] = WORDISH[0x61:0x7B] = WORDISH[0x80:] = True

_powers: dict[str, np.ndarray] = {}
_libc: list = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** j and its inverse, modulo 2 ** 64, for j up to n."""
    if len(_powers.get("up", ())) <= n:
        m = max(n + 1, PIECE // 2, 2 * len(_powers.get("up", ())))
        for name, b in (("up", BASE), ("down", INVERSE)):
            p = np.full(m, b, U)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def give_back() -> None:
    """Return what the allocator has kept of freed arrays to the system, where it can:
    a worker's memory then follows the block it works on, not the largest so far."""
    if not _libc:
        _libc.append(ctypes.CDLL(None))
    pa.default_memory_pool().release_unused()
    if hasattr(_libc[0], "malloc_trim"):
        _libc[0].malloc_trim(0)


def tidied(mapper):
    """A mapper of Arrow batches that gives memory back when its task is over: its
    worker stays, and waits for another."""

    @functools.wraps(mapper)
    def run(*args):
        yield from mapper(*args)
        give_back()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(29))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def prefix(buf: np.ndarray) -> np.ndarray:
    """prefix[i]: the polynomial of the first i bytes; see span_hash()."""
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(VALUES[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, wherever it stands."""
    _, down = powers(len(pre))
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


def text_column(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column (null: empty) and where each text starts."""
    col = pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")
    col = col.cast(pa.large_string()) if pa.types.is_string(col.type) else col
    n = len(col)
    offsets = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]) if n and data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return buf, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, name: str = "text", most: int = PIECE):
    """(first row, rows, bytes, offsets) of consecutive rows with about ``most`` bytes."""
    buf, off = text_column(batch, name)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j - i, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def spans(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every run of True, cut at document borders."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[off] = True
    before = np.empty(len(mask), bool)
    before[0] = False
    before[1:] = mask[:-1]
    before &= ~edge[:-1]
    after = np.empty(len(mask), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    after &= ~edge[1:]
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def owner(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The document of each byte position that starts a span (empty documents own none)."""
    return np.searchsorted(off, starts, "right") - 1


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a value for each byte, by document."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))
