"""Numpy over the flat byte buffer of an Arrow string column: no Python object per text or word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that numpy temporaries cover at a time; texts longer than this are worked through in several blocks.
BLOCK = 1 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 offsets of the texts in them.  Null counts as empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def groups(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of whole texts, each of at most ``most`` bytes or of one text."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i + 1]], 0 for empty ones, in 64-bit integers."""
    out = np.zeros(len(offsets) - 1, np.int64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], dtype=np.int64)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(seed: int, n: int) -> np.ndarray:
    """n pseudo-random unsigned 64-bit integers that depend on the seed alone."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = drawn(1, 256)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, BLOCK), b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes; ``table`` gives each byte value its number."""
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_numbers(fold: bool) -> np.ndarray:
    """Numbers of the byte values; with ``fold`` A-Z count as a-z."""
    table = _BYTE.copy()
    if fold:
        table[65:91] = table[97:123]
    return table


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one non-zero kind of byte, cut at text ends.  ``kind``: 256 small numbers, 0 outside."""
    k = kind[data]
    first = np.empty(len(k), bool)
    if not len(k):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first[0] = True
    np.not_equal(k[1:], k[:-1], out=first[1:])
    inner = offsets[:-1]
    first[inner[inner < len(k)]] = True
    at = np.flatnonzero(first)
    ends = np.append(at[1:], len(k))
    word = k[at] > 0
    return at[word], ends[word]


def white() -> np.ndarray:
    """Kinds for words [^\\x20\\x09-\\x0D]+."""
    kind = np.ones(256, np.uint8)
    kind[[32, 9, 10, 11, 12, 13]] = 0
    return kind
