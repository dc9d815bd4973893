"""Vectorised work on the UTF-8 bytes of Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere here. A batch is cut into slabs of
whole texts (about ``SLAB_BYTES`` each, one longer text is a slab of its own),
so the temporary arrays stay small whatever the batch holds. A null text
counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once by the vectorised functions.
SLAB_BYTES = 1 << 19
#: Rows per Arrow batch: bounds what a Python worker holds of long texts.
ARROW_ROWS = 500

_SEED = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _SEED.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)


def small_batches(spark) -> None:
    """Keep Arrow batches small; texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets start at 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, kind)[arr.offset:arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slabs(arr: pa.Array, target: int = SLAB_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive whole texts."""
    raw, offsets = string_buffers(arr)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + target, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse modulo 2**64 for i < n."""
    if len(_POW[0]) < n:
        size = max(n, SLAB_BYTES + 1)
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p, dtype=np.uint64)
    return _POW[0][:n], _POW[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Word spans of a slab, with the row that each belongs to.

    ``gap`` says which bytes part the words.
    """

    __slots__ = ("starts", "ends", "row", "first")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_SPACE):
        rows = len(offsets) - 1
        inside = ~gap[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(raw), bool)
        after = np.empty(len(raw), bool)
        if len(raw):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        #: Word index at which each row starts (rows + 1 entries).
        self.first = np.searchsorted(self.starts, offsets)
        self.row = np.repeat(np.arange(rows), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.starts)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of every byte span; A-Z count as a-z if ``lower``."""
    pw, inv = powers(len(raw) + 1)
    codes = BYTE_CODES[LOWER] if lower else BYTE_CODES
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(codes[raw] * pw[:-1], out=sums[1:], dtype=np.uint64)
    h = (sums[ends] - sums[starts]) * inv[starts]
    return mix64(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive entries of ``h`` (len - width + 1)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x100000001B3) + h[k:k + n] * np.uint64(2 * k + 0x9E3779B1)
    return mix64(out)


def windows_in_rows(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(window start, row) of the windows that stay inside one row."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    start = first[:-1][row] + np.arange(len(row)) - begin[row]
    return start, row


def code_points(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte position (len + 1 entries)."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out


def crc_mod(ids, mod: int) -> np.ndarray:
    """crc32 of each id's decimal text modulo ``mod`` (null: of the empty text)."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % mod for i in ids], np.int64)
