"""Importance resampling towards a target distribution, by hashed n-gram features.

Texts are grouped by their full text: features are made once for each different text and kept with the number of its
copies, which multiplies its counts.  A task adds up its features in one array of ``BUCKETS`` numbers; the sums are one
row a bucket, all that reaches the driver.  Weights are computed once for each different text and joined back to
documents by the text's SHA-256; then each document gets its own noise.

Features are all runs of 1 to ``ORDER`` consecutive words, A-Z lower-cased, joined by one space; a feature's bucket is
the CRC-32 of its bytes modulo BUCKETS.  The CRC-32 of a run is put together from those of its words (a CRC is linear:
shift the head's by the tail's length, add the tail's), so a feature costs a few table look-ups and no string.

Ranks come from a sort by range: a task's rows count from the offset that the tasks before it leave, so no task holds
the ranking.

Null text counts as empty: no features, weight 0.  Null ids are written as nothing in the noise's key and rank last
among ties; repeated rows are documents of their own and may get neighbouring ranks in any order.  An empty table, on
either side, has sums of 0.  Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .flat import groups, spans, text_bytes
from .store import small_batches, written

BUCKETS, ORDER, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Lengths whose CRC shift has a table of its own; longer ones take one look-up a set bit of the length.
_NEAR = 128


def word_kind() -> np.ndarray:
    """Kinds of bytes for words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing."""
    kind = np.zeros(256, np.uint8)
    kind[48:58] = kind[65:91] = kind[97:123] = kind[128:] = 1
    return kind


def folded(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts in order, and for each text its first word's number (n + 1 of them)."""
    begin, end = spans(data, offsets, kind)
    at = np.concatenate([[0], np.cumsum(end - begin)])
    letters = folded(data[kind[data] > 0])
    found = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))])
    return found.dictionary_encode(), np.searchsorted(begin, offsets)


@cache
def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """[length, byte of the CRC, value]: what a CRC-32 becomes behind so many zero bytes, for lengths below _NEAR and for
    powers of two."""
    byte = np.arange(256, dtype=np.uint32)
    crc = byte.copy()
    for _ in range(8):
        crc = np.where(crc & np.uint32(1), (crc >> np.uint32(1)) ^ np.uint32(0xEDB88320), crc >> np.uint32(1))
    near = np.zeros((_NEAR, 4, 256), np.uint32)
    near[0] = [byte << np.uint32(8 * k) for k in range(4)]
    for n in range(1, _NEAR):
        near[n] = (near[n - 1] >> np.uint32(8)) ^ crc[near[n - 1] & np.uint32(255)]
    far = np.zeros((48, 4, 256), np.uint32)
    far[0] = near[1]
    for k in range(1, 48):
        far[k] = _applied(far[k - 1], far[k - 1])
    return near, far


def _applied(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def _behind(crc: np.ndarray, lengths: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """CRC-32 of a + b from that of a, b's length and that of b."""
    near, far = _shifts()
    n = np.minimum(lengths, _NEAR - 1)
    out = near[n, 0, crc & 255] ^ near[n, 1, (crc >> 8) & 255] ^ near[n, 2, (crc >> 16) & 255] ^ near[n, 3, crc >> 24]
    for i in np.flatnonzero(lengths >= _NEAR):
        x = crc[i]
        for k in range(int(lengths[i]).bit_length()):
            if int(lengths[i]) >> k & 1:
                x = _applied(far[k], x)
        out[i] = x
    return out ^ tail


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features, text by text and rising within a text; their n + 1 offsets; words of every text."""
    found, first = words(data, offsets, word_kind())
    n_words = np.diff(first)
    listed = found.dictionary.to_pylist()
    number = found.indices.to_numpy()
    alone, spaced = (np.array([zlib.crc32(before + w) for w in listed], np.uint32)[number] for before in (b"", b" "))
    length = np.array([len(w) + 1 for w in listed], np.int64)[number]
    doc = np.repeat(np.arange(len(n_words)), n_words)
    keys, run = [doc * BUCKETS + alone % BUCKETS], alone
    for k in range(1, ORDER):
        run = _behind(run[:-1], length[k:], spaced[k:])
        inside = doc[k:] == doc[: len(doc) - k]
        keys.append((doc[k:] * BUCKETS + run % BUCKETS)[inside])
    every = np.sort(np.concatenate(keys))
    return (every % BUCKETS).astype(np.uint16), np.searchsorted(every, np.arange(len(n_words) + 1) * BUCKETS), n_words


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, copies, digest) to (digest, copies, n_words, n_features, buckets)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for i, j in groups(offsets):
            found, at, n_words = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            own = pa.array([found[at[k] : at[k + 1]].tobytes() for k in range(j - i)], pa.binary())
            rest = [batch.column(c).slice(i, j - i) for c in (2, 1)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n_words.astype(np.int64)), pa.array(np.diff(at).astype(np.int64)), own], names=["digest", "copies", "n_words", "n_features", "buckets"])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = text_bytes(column)
    return data.view(np.uint16), offsets // 2


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(copies, buckets) to the task's sums (bucket, n)."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        found, at = _lists(batch.column(1))
        np.add.at(total, found, np.repeat(batch.column(0).to_numpy(), np.diff(at)))
    full = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["bucket", "n"])


def _weighed(gains: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, n_words, n_features, buckets) to (digest, n_words, n_features, weight)."""
    for batch in batches:
        found, at = _lists(batch.column(3))
        run = np.concatenate([[0], np.cumsum(gains[found])])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(run[at[1:]] - run[at[:-1]])], names=["digest", "n_words", "n_features", "weight"])


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """One row a different text: digest, copies, n_words, n_features, buckets (their numbers, 16 bits each)."""
    small_batches(df.sparkSession)
    grouped = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))
    marked = grouped.select("text", "copies", _digest(F.col("text")).alias("digest"))
    return written(marked.mapInArrow(_featured, "digest binary, copies bigint, n_words bigint, n_features bigint, buckets binary"), "texts")


def totals(texts_: DataFrame) -> np.ndarray:
    """Occurrences of every bucket's features in all documents; BUCKETS rows come to the driver at most."""
    sums = texts_.select("copies", "buckets").mapInArrow(_totals, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in sums.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of a bucket's smoothed share in the target over that in the source)."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(source, target, strict=True)], np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of SHA-256 of ``seed:doc_id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 1, 2, 3... in the order given, over all rows."""
    placed = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")  # partition << 33 | row
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row a task of the sort
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(offsets, part == F.col("_part")).withColumn(name, F.col("_before") + row + 1).drop("_at", "_part", "_before")


def resample(docs: DataFrame, target: DataFrame, doc_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Per document: its id, n_words, n_features, weight, score, rank (null if not drawn): of the documents with
    ``least_words`` words, ``percent`` of a hundred are drawn by score, rounded down."""
    own = texts(docs, text_col)
    gain = gains(totals(own), totals(texts(target, text_col)))
    weighed = own.select("digest", "n_words", "n_features", "buckets").mapInArrow(partial(_weighed, gain), "digest binary, n_words bigint, n_features bigint, weight bigint")
    keyed = docs.select(F.col(doc_col).alias("doc"), _digest(F.col(text_col)).alias("digest"))
    scored = written(keyed.join(weighed, "digest").select("doc", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc"), seed)).alias("score")), "scored")
    full = F.col("n_words") >= least_words
    drawn = scored.where(full).count() * percent // 100
    placed = ranked(scored.where(full), [F.desc("score"), F.asc_nulls_last("doc")], "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return placed.unionByName(scored.where(~full).withColumn("rank", F.lit(None).cast("long"))).withColumnRenamed("doc", doc_col)
