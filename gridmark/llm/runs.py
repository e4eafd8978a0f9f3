"""Scans over sorted Arrow batches: runs of rows with equal keys, one after the other, whatever batch they stand in."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows that a task's partial sums hold before they are merged, and after which they are passed on.
MERGE_ROWS, FLUSH_ROWS = 1_500_000, 600_000


def starts(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a run of equal ``keys`` (no nulls) begins."""
    n = batch.num_rows
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in keys:
            column = batch.column(k)
            new[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, n - 1)))
    return np.flatnonzero(new)


def whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole runs; the last run of a batch is held until it has ended."""
    held: list[pa.RecordBatch] = []
    key = lambda batch, i: tuple(batch.column(k)[i].as_py() for k in keys)
    for batch in batches:
        if not batch.num_rows:
            continue
        at = starts(batch, keys)
        if held and key(held[-1], held[-1].num_rows - 1) != key(batch, 0):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(at) > 1:
            yield pa.Table.from_batches([*held, batch.slice(0, int(at[-1]))]).combine_chunks()
            held = []
        held.append(batch.slice(int(at[-1])))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def summed(batches: Iterator[pa.RecordBatch], keys: list[str], values: list[str]) -> Iterator[pa.RecordBatch]:
    """One row a run with the sums of the integers ``values``.  Only the last run's sums are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch.select([*keys, *values])]).combine_chunks()
        at = starts(table, keys)
        first = table.select(keys).take(pa.array(at))
        for v in values:
            first = first.append_column(v, pa.array(np.add.reduceat(table.column(v).to_numpy(), at)))
        ready = first.combine_chunks().to_batches()[0]
        yield ready.slice(0, ready.num_rows - 1)
        held = [ready.slice(ready.num_rows - 1)]
    yield from held


class Sums:
    """Sums of the integers ``values`` by ``keys`` of tables added one after the other, in bounded memory: where too many
    keys are held they are passed on as partial sums."""

    def __init__(self, keys: list[str], values: list[str]):
        self.keys, self.values, self.parts, self.rows = keys, values, [], 0

    def add(self, table: pa.Table) -> Iterator[pa.RecordBatch]:
        self.parts.append(table)
        self.rows += table.num_rows
        if self.rows > MERGE_ROWS:
            merged = self._merged()
            if merged.num_rows > FLUSH_ROWS:
                self.parts, self.rows = [], 0
                yield from merged.to_batches(max_chunksize=10_000)
            else:
                self.parts, self.rows = [merged], merged.num_rows

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield from self._merged().to_batches(max_chunksize=10_000)

    def _merged(self) -> pa.Table:
        out = pa.concat_tables(self.parts).group_by(self.keys).aggregate([(v, "sum") for v in self.values])
        return out.select([*self.keys, *(f"{v}_sum" for v in self.values)]).rename_columns([*self.keys, *self.values])
