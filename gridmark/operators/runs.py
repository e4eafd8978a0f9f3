"""Sorted groups inside a task: batches cut where groups end, and the pairs of rows of a group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of rows made at a time.
PAIRS = 1 << 20


def _starts(columns: list[pa.Array]) -> np.ndarray:
    """Rows that differ from the one before in a column; nulls are equal, and NaNs."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n > 1:
        new[1:] = False
        for c in columns:
            a, b = c.slice(0, n - 1), c.slice(1)
            same = pc.fill_null(pc.equal(a, b), False)
            both = pc.and_(pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True))
            new[1:] |= ~pc.or_(same, both).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups (equal values in the first ``groups`` columns) and the places where these begin, and end.  Rows
    come sorted; the last group of a batch is held until it ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        full = pa.concat_batches([*held, batch]) if held else batch
        first = _starts(full.columns[:groups])
        last = int(first[-1])
        held = [full.slice(last)]
        if last:
            yield full.slice(0, last), first
    if held:
        yield held[0], np.array([0, held[0].num_rows])


def pairs_within(first: np.ndarray, together: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j), i < j, of every two rows of a group, ascending by i, about ``PAIRS`` at a time; a group's pairs come
    ``together`` if asked for."""
    sizes = np.diff(first)
    behind = np.repeat(first[1:], sizes) - np.arange(first[-1]) - 1  # rows of the group after each row
    total = np.cumsum(behind)
    at = 0
    while at < len(behind):
        done = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        if together:
            end = int(first[max(np.searchsorted(first, end, "right") - 1, np.searchsorted(first, at, "right"))])
        many = behind[at:end]
        i = np.repeat(np.arange(at, end), many)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        if len(i):
            yield i, j
        at = end
