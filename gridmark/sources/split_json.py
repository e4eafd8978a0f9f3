"""Documents of any size: the elements of a JSON object's top-level arrays, read by many tasks.

Spark's text source splits a file at a separator of our own, "}", so each task gets a byte range that starts behind an
object, from any store that Spark reads.  What a range begins with (inside a string or not, how deep) isn't known to its
task; so a first scan notes, for both cases, whether the range ends inside a string and how much deeper it ends.  Folding
these notes along the file (one row a range) gives every range its state.  A second scan tokenises the ranges, a few
megabytes at a time, and emits elements; an element that a border cuts comes as fragments of neighbouring ranges, which
are put together by their number in the array.  The array at the start of a range, and how many of its elements lie before
it, follow from a second fold over the pieces of arrays in each range.

States meet ranges by a broadcast while they are ``FEW_RANGES`` or fewer (about 100 bytes a range), else by a shuffle that
restores the order.

A document counts as an object if it begins with "{" and its brackets and strings close; words behind them are let
pass, as ``from_json`` does; its inside isn't checked further, and an element that isn't what the schema says is null or has null fields, as with ``from_json``.  Of an
array whose key comes again, the last one counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import scratch

#: Bytes tokenised at a time, and ranges whose states are broadcast.
CHUNK, FEW_RANGES = 1 << 22, 100_000
_KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:')
_QUOTE, _BACK, _COMMA = 34, 92, 44
_DEEPER = np.zeros(256, np.int8)
_DEEPER[[123, 91]], _DEEPER[[125, 93]] = 1, -1
_BLANK = b" \t\r\n"

RANGE = ["path", "begin"]
_NOTE = "path string, begin bigint, size bigint, flips boolean, outside bigint, inside bigint, bytes bigint, lead string"
_PIECE = "path string, begin bigint, run int, name string, kind string, place bigint, starts boolean, ends boolean, body string"
#: Place of a row that says that an array or object begins.
_BEGINS = -2


def _quotes(a: np.ndarray) -> np.ndarray:
    """Which bytes are quotes that no backslash escapes; the part begins behind a "}" or at the file's start."""
    quote = a == _QUOTE
    back = np.flatnonzero(a == _BACK)
    if len(back):
        first = np.concatenate([[True], np.diff(back) > 1])
        start = back[np.flatnonzero(first)][np.cumsum(first) - 1]
        after = back[(back - start) % 2 == 0] + 1  # bytes behind an odd number of backslashes
        quote[after[after < len(a)]] = False
    return quote


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, bytes]]:
    """(range with its state, whether it is the range's first part, bytes) in parts of about CHUNK bytes that end behind
    a separator.  Rows: value, then the range's columns."""
    held: list[bytes] = []
    size, now, fresh = 0, None, True
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for column in batch.columns[1:3]:
            new[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, n - 1)))
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        values = batch.column(0).cast(pa.binary())
        for i, j in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[i].as_py() for c in batch.columns[1:])
            if now is not None and (key != now or size >= CHUNK):
                yield now, fresh, b"".join(held)
                held, size, fresh = [], 0, key != now
            now = key
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), values.slice(i, j - i)), b"}")[0].as_py()
            held += (joined, b"}")
            size += len(joined) + 1
    if now is not None:
        yield now, fresh, b"".join(held)


def _noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Notes of each range: whether it ends inside a string if it begins outside one (and the other way round), how much
    deeper it ends in both cases, its bytes, and its first byte that isn't blank."""
    now, notes = None, None
    for key, fresh, data in _ranges(batches):
        if fresh and now is not None:
            yield _row(now, notes)
        if fresh:
            now, notes = key, [False, 0, 0, 0, data.lstrip(_BLANK)[:1].decode("ascii", "replace")]
        a = np.frombuffer(data, np.uint8)
        inside = np.bitwise_xor.accumulate(_quotes(a)) ^ notes[0]
        deeper = _DEEPER[a]
        within = int(deeper[inside].sum())
        notes[1] += int(deeper.sum()) - within
        notes[2] += within
        notes[0] = bool(inside[-1])
        notes[3] += len(data)
    if now is not None:
        yield _row(now, notes)


def _row(now: tuple, notes: list) -> pa.RecordBatch:
    values = [*now, *notes]
    return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=[c.split()[0] for c in _NOTE.split(", ")])


class _Tokeniser:
    """Elements of depth-2 arrays of one range, part by part.  ``pieces``: (run, name, kind, place, starts, ends, body); run 0
    is what the range begins in, later runs have a name and a kind (array or not)."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth, self.run, self.place, self.kind = inside, depth, 0, 0, None
        self.name, self.open, self.started, self.before = None, depth > 1, False, b""
        self.body: list[bytes] = []

    def _emit(self, end: bytes, starts: bool, ends: bool):
        body = b"".join([*self.body, end])
        self.body = []
        return self.run, self.name, self.kind, self.place - 1, starts, ends, body

    def feed(self, data: bytes) -> Iterator[tuple]:
        a = np.frombuffer(data, np.uint8)
        inside = np.bitwise_xor.accumulate(_quotes(a)) ^ self.inside
        deeper = np.where(inside, 0, _DEEPER[a])
        depth = self.depth + np.cumsum(deeper, dtype=np.int64)
        cuts = np.flatnonzero(((a == _COMMA) & ~inside & (depth == 2)) | ((deeper > 0) & (depth == 2)) | ((deeper < 0) & (depth == 1)))
        at = 0
        for cut in cuts:
            sign = a[cut]
            if sign == _COMMA or deeper[cut] < 0:
                if self.open and self.kind != "object":
                    yield self._emit(data[at:cut], self.started, True)
                self.open = self.started = sign == _COMMA
                self.place += bool(self.open)
            else:  # an array or object begins; its name stands before it
                names = _KEY.findall(self.before + data[at:cut])
                self.run, self.place, self.kind = self.run + 1, 1, "array" if sign == 91 else "object"
                self.name = names[-1].decode("utf-8", "replace") if names else None
                yield self.run, self.name, self.kind, _BEGINS, False, False, b""
                self.open = self.started = True
                self.before = b""
            at = cut + 1
        if self.open and self.kind != "object":
            self.body.append(data[at:])
        elif not self.open:
            self.before += data[at:]
        self.inside, self.depth = bool(inside[-1]), int(depth[-1])

    def rest(self) -> Iterator[tuple]:
        if self.open and self.kind != "object" and self.body:
            yield self._emit(b"", self.started, False)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a range's arrays; rows: value, path, begin, in_string, depth.  Elements and fragments of them count from the
    run's start in the range, so a fragment of one that began before has place -1."""
    names = [c.split()[0] for c in _PIECE.split(", ")]

    def batch(key: tuple, pieces: list[tuple]) -> pa.RecordBatch:
        run, name, kind, place, starts, ends, body = zip(*pieces, strict=True)
        columns = [pa.array([key[0]] * len(run)), pa.array([key[1]] * len(run)), pa.array(run, pa.int32()), pa.array(name, pa.string()), pa.array(kind, pa.string()), pa.array(place, pa.int64()), pa.array(starts), pa.array(ends), pa.array(body, pa.binary()).cast(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=names)

    now, reader = None, None
    for key, fresh, data in _ranges(batches):
        if fresh:
            if reader and (left := list(reader.rest())):
                yield batch(now, left)
            now, reader = key, _Tokeniser(key[2], key[3])
        if pieces := list(reader.feed(data)):
            yield batch(now, pieces)
    if reader and (left := list(reader.rest())):
        yield batch(now, left)


def records(spark: SparkSession, folder: str, glob: str, least_bytes: int, wanted: Column | None = None) -> DataFrame:
    """Text between "}" (value, path, begin, size) of the files below ``folder`` of more than ``least_bytes``.  ``wanted`` is a
    condition on ``_metadata``; files that fail it are never opened."""
    found = spark.read.format("text").option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "}").load(folder)
    kept = found.where(F.col("_metadata.file_size") > least_bytes)
    meta = {"path": "file_path", "begin": "file_block_start", "size": "file_size"}
    return (kept if wanted is None else kept.where(wanted)).select("value", *(F.col(f"_metadata.{v}").alias(k) for k, v in meta.items()))


def elements(lines: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(path, name, place, body): the elements of the arrays ``names`` of each document, numbered from 0, as JSON text;
    and (path, is_object, keys): whether a document is an object, and the names of its top-level arrays and objects.
    ``lines`` is a table of ``records``."""
    notes = scratch.written(lines.mapInArrow(_noted, _NOTE), "ranges")
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(F.col("flips").cast("int")).over(before), F.lit(0)) % 2 == 1
    stated = notes.withColumn("in_string", first).withColumn("gain", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    stated = scratch.written(stated.withColumn("depth", F.coalesce(F.sum("gain").over(before), F.lit(0)).cast("long")), "states")
    states = stated.select(*RANGE, "in_string", "depth")
    if stated.count() <= FEW_RANGES:
        known = lines.join(F.broadcast(states), RANGE)
    else:
        known = lines.withColumn("_row", F.monotonically_increasing_id()).join(states, RANGE).repartition(*RANGE).sortWithinPartitions(*RANGE, "_row")
    pieces = scratch.written(known.select("value", *RANGE, "in_string", "depth").mapInArrow(_pieces, _PIECE), "pieces")

    # runs of a range, in order: run 0 goes on with the last array before the range
    runs = pieces.groupBy(*RANGE, "run").agg(F.max("name").alias("name"), F.max("kind").alias("kind"), F.count_if("starts").alias("begun"))
    order = Window.partitionBy("path").orderBy("begin", "run")
    placed = runs.withColumn("array", F.count_if(F.col("run") > 0).over(order))
    within = Window.partitionBy("path", "array")
    placed = placed.withColumns({"name": F.max("name").over(within), "kind": F.max("kind").over(within), "offset": F.coalesce(F.sum("begun").over(within.orderBy("begin", "run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    last = placed.withColumn("last", F.max("array").over(Window.partitionBy("path", "name"))).where((F.col("kind") == "array") & (F.col("array") == F.col("last")) & F.col("name").isin(names))
    located = scratch.written(last.select(*RANGE, "run", F.col("name").alias("of"), "offset"), "runs")
    numbered = pieces.where(F.col("place") != _BEGINS).join(located, [*RANGE, "run"]).select("path", F.col("of").alias("name"), (F.col("offset") + F.col("place")).alias("place"), "begin", "starts", "ends", "body")
    whole = numbered.where("starts AND ends").select("path", "name", "place", "body")
    cut = numbered.where("NOT (starts AND ends)").groupBy("path", "name", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "body"))), lambda x: x["body"]), "").alias("body"))
    both = whole.unionByName(cut).withColumn("body", F.trim(F.col("body"), F.lit(" \t\r\n"))).where("body <> ''")

    numbers = {"_last": F.row_number().over(Window.partitionBy("path").orderBy(F.desc("begin"))), "end": F.col("depth") + F.col("gain"), "open": F.col("in_string") != F.col("flips")}
    at_end = lambda c: F.max(F.when(F.col("_last") == 1, F.col(c))).alias(c)
    told = stated.withColumns(numbers).groupBy("path").agg(F.sum("bytes").alias("bytes"), F.max("size").alias("size"), *map(at_end, ("end", "open")), F.min_by("lead", "begin").alias("lead"))
    keys = runs.where("run > 0").groupBy("path").agg(F.collect_set("name").alias("keys"))
    closed = ((F.col("bytes") == F.col("size")) & (F.col("end") == 0)) | ((F.col("bytes") == F.col("size") + 1) & (F.col("end") == -1))
    is_object = F.coalesce(closed & ~F.col("open") & (F.col("lead") == "{"), F.lit(False)).alias("is_object")
    return both, told.join(keys, "path", "left").select("path", is_object, F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))
