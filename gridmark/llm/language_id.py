"""Language identification by prediction by partial matching (PPM).

Every language has a context tree over bytes with contexts of 0 to 3 bytes.  Symbol and escape probabilities follow
PPM's method C with exclusion: a symbol seen n times in a context with t occurrences and d distinct symbols has
n / (t + d), the escape to the next shorter context d / (t + d); symbols met on the way are excluded below, and the
shortest context is uniform over the 256 byte values.  The trees are frozen after training, so the code length of a
byte depends on its context alone; a text's code length is the exact sum, in 1/640 bit units, and the language with
the smallest one wins.

Frozen trees flatten into one table [context node, byte] of code lengths for each language.  The node set is shared and
of variable order: of all contexts of up to three bytes in the training sample (of three bytes those seen ``LEAST``
times) the most frequent ones, as many as ``most_cells`` numbers for all languages together allow; a context that is no
node has its longest suffix that is one.  So the model's size is bounded whatever the number of languages.
Scoring is a numpy gather over a batch's flat byte buffer, in blocks, so memory doesn't grow with text length.

Training reads a bounded sample: about ``sample_bytes`` of text for each language, drawn by text hash (repeated texts
count as often as they occur), of every language at least one text, of every text at most ``sample_bytes``
characters.  Scoring reads all of every text.

Null texts, texts without a letter and models without languages give ``und``; null or repeated ids and other columns
play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import BLOCK, groups, text_bytes
from .store import small_batches

UNIT = 640
UNKNOWN = "und"
LEAST = 8
#: Most languages whose sampling limits are broadcast to the texts; more are joined as Spark plans it.
BROADCAST_LANGUAGES = 10_000


@dataclass(frozen=True)
class LanguageModel:
    """``symbol``: byte value to symbol, 0 is the time before a text; ``node``: three context symbols to node (16 bits);
    ``cost``: for each language, code lengths by node * width + symbol (16 bits)."""

    languages: tuple[str, ...]
    symbol: np.ndarray
    node: np.ndarray
    cost: tuple[np.ndarray, ...]
    width: int


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, three context bytes, byte) by block; bytes count from 1, 0 stands before a text."""
    for batch in batches:
        names = batch.column(0).dictionary_encode()
        data, offsets = text_bytes(batch.column(1))
        number = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in groups(offsets):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            rank = np.arange(len(part)) - np.repeat(at[:-1], np.diff(at))
            key = np.repeat(number[i:j], np.diff(at))
            for back in (3, 2, 1, 0):
                past = np.zeros(len(part), np.int64)
                past[back:] = part[: len(part) - back]
                key = key << 9 | np.where(rank >= back, past + 1, 0)
            keys, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(keys >> 36)), pa.array(keys & (1 << 36) - 1), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])


def _lengths(levels: list[np.ndarray], known: int) -> np.ndarray:
    """Code lengths for rows of contexts, from their counts at falling orders; columns are symbols."""
    rows, width = levels[0].shape
    p, escape, seen = np.zeros((rows, width)), np.ones(rows), np.zeros((rows, width), bool)
    for counts in levels:
        counts = np.where(seen, 0, counts)
        total, distinct = counts.sum(1), (counts > 0).sum(1)
        share = np.where(total > 0, escape / np.maximum(total + distinct, 1), 0)
        p += share[:, None] * counts
        escape = np.where(total > 0, share * distinct, escape)
        seen |= counts > 0
    p = np.where(seen, p, (escape / (256 - seen.sum(1)))[:, None])
    return np.rint(-np.log2(np.maximum(p, 1e-30)) * UNIT).astype(np.uint16)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_bytes: int = 2_000_000, most_cells: int = 16_000_000) -> LanguageModel:
    """Trees from the non-null, non-empty labelled texts.  With none, a model without languages.

    ``sample_bytes`` bounds the expected training text of each language, ``most_cells`` the model: two bytes a cell.
    What reaches the driver are gram counts of that sample.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND length(text) > 0")
    draw = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 20))
    share = F.least(F.lit(1.0), F.lit(float(sample_bytes)) / F.sum(F.octet_length("text")))
    per_lang = rows.groupBy("lang").agg(F.greatest(F.min(draw) + 1, (share * (1 << 20)).cast("bigint")).alias("limit")).toArrow()
    limits = labelled.sparkSession.createDataFrame(per_lang)
    sample = rows.join(F.broadcast(limits) if len(per_lang) <= BROADCAST_LANGUAGES else limits, "lang").where(draw < F.col("limit")).select("lang", F.substring("text", 1, sample_bytes).alias("text"))
    counts = sample.mapInArrow(_grams, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = tuple(sorted(per_lang["lang"].to_pylist()))
    if not names:
        return LanguageModel((), np.zeros(256, np.int32), np.zeros(1, np.uint16), (), 1)
    lang = np.searchsorted(np.array(names, object), np.array(counts["lang"].to_pylist(), object))
    gram, n = counts["gram"].to_numpy(), counts["n"].to_numpy()
    past = [gram >> 9 * k & 511 for k in (3, 2, 1, 0)]
    known = np.unique(past[3]) - 1
    width = len(known) + 2
    symbol = np.full(256, width - 1, np.int32)
    symbol[known] = np.arange(1, len(known) + 1)
    *context, s = (np.where(x > 0, symbol[np.maximum(x, 1) - 1], 0).astype(np.int64) for x in past)
    c3, c2, c1 = context

    # keys of the contexts of 0 to 3 bytes that end in a byte, and the most frequent contexts of all orders
    keys = [np.zeros(len(s), np.int64), c1, c2 * width + c1, (c3 * width + c2) * width + c1]
    found = [np.unique(k, return_inverse=True) for k in keys]
    weights = [np.bincount(place, weights=n) for _, place in found]
    order = np.concatenate([np.full(len(w), k) for k, w in enumerate(weights)])
    every, which = np.concatenate(weights), np.concatenate([k for k, _ in found])
    full = (order < 3) | (every >= LEAST)
    most = max(1, min(most_cells // (len(names) * width), (1 << 16) - 1))
    chosen = np.lexsort((which, order, -every))
    chosen = np.sort(chosen[full[chosen]][:most])  # by order, then by key
    order, which = order[chosen], which[chosen]
    nodes = [which[order == k] for k in range(4)]
    base = np.concatenate([[0], np.cumsum([len(x) for x in nodes])])

    node = np.zeros(1, np.uint16)
    for k in (1, 2, 3):
        node = np.tile(node, width)
        node[nodes[k]] = base[k] + np.arange(len(nodes[k]))
    node = node if len(node) == width**3 else np.tile(node, width**3 // len(node))

    # for every node its suffixes that are nodes, shortest last; those missing count nothing
    costs, size = [], len(which)
    suffix = [[np.zeros(0, np.int64)] * 4 for _ in range(4)]
    for k in range(4):
        for j in range(k + 1):
            key = nodes[k] % width**j
            at = np.minimum(np.searchsorted(nodes[j], key), max(len(nodes[j]) - 1, 0))
            suffix[k][j] = np.where(nodes[j][at] == key, base[j] + at, -1) if len(nodes[j]) else np.full(len(key), -1)
    back = np.stack([np.concatenate([suffix[k][j] if j <= k else np.full(len(nodes[k]), -1) for k in range(4)]) for j in range(4)], 1)
    places = []
    for k in range(4):
        at = np.minimum(np.searchsorted(nodes[k], keys[k]), max(len(nodes[k]) - 1, 0))
        places.append(np.where(nodes[k][at] == keys[k], base[k] + at, -1) if len(nodes[k]) else np.full(len(s), -1))
    for m in range(len(names)):
        table = np.zeros(size * width, np.int64)
        for at in places:
            own = (lang == m) & (at >= 0)
            table += np.bincount(at[own] * width + s[own], weights=n[own], minlength=size * width).astype(np.int64)
        table = table.reshape(size, width)
        cost = np.empty((size, width), np.uint16)
        for a in range(0, size, 4096):
            part = back[a : a + 4096]
            cost[a : a + 4096] = _lengths([np.where((part[:, j] >= 0)[:, None], table[part[:, j]], 0) for j in (3, 2, 1, 0)], len(known))
        costs.append(cost.ravel())
    return LanguageModel(names, symbol, node, tuple(costs), width)


def code_lengths(model: LanguageModel, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """[text, language] code lengths, ``UNIT`` to a bit."""
    out = np.zeros((len(offsets) - 1, len(model.languages)), np.int64)
    width = model.width
    for a in range(0, len(data), BLOCK):
        b = min(a + BLOCK, len(data))
        s = model.symbol[data[max(a - 3, 0) : b]]
        lead = a - max(a - 3, 0)
        now = s[lead:]
        past = [np.concatenate([np.zeros(max(k - lead, 0), np.int32), s[max(lead - k, 0) : len(s) - k]]) for k in (1, 2, 3)]
        first, last = np.searchsorted(offsets, [a - 3, b], "left")
        starts = offsets[first:last]
        for k in (1, 2, 3):
            for ahead in range(k):
                at = starts + ahead - a
                past[k - 1][at[(at >= 0) & (at < b - a)]] = 0
        place = model.node[(past[2] * width + past[1]) * width + past[0]].astype(np.int32) * width + now
        i = int(np.searchsorted(offsets, a, "right")) - 1
        j = int(np.searchsorted(offsets, b, "left"))
        cut = np.clip(offsets[i : j + 1], a, b) - a
        full = np.flatnonzero(cut[1:] > cut[:-1])
        for k, cost in enumerate(model.cost):
            out[i + full, k] += np.add.reduceat(cost[place], cut[full], dtype=np.int64)
    return out


def identify(model: LanguageModel, spark, text: Column | str) -> Column:
    """A struct column lang_pred, score, bits_per_byte.

    ``und`` with score 0 for a null text, a text without a letter, or a model without languages.  ``score`` is the
    winner's posterior at equal priors; equal code lengths go to the first language by code point.  The model is
    broadcast: two bytes for each of ``most_cells`` cells, and for each of at most 258^3 contexts.
    """
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,bits_per_byte:double>")
    def predicted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for column in texts:
            data, offsets = text_bytes(column)
            size = np.diff(offsets)
            if not m.languages:
                n = len(column)
                yield pa.StructArray.from_arrays([pa.array([UNKNOWN] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n))], names=["lang_pred", "score", "bits_per_byte"])
                continue
            cost = code_lengths(m, data, offsets)
            best = cost.argmin(1)
            least = cost[np.arange(len(best)), best]
            odds = np.exp2(np.maximum(least[:, None] - cost, -64 * UNIT) / UNIT).sum(1)
            yield pa.StructArray.from_arrays([pa.array(list(m.languages)).take(pa.array(best)), pa.array(1 / odds), pa.array(least / UNIT / np.maximum(size, 1))], names=["lang_pred", "score", "bits_per_byte"])

    text = F.col(text) if isinstance(text, str) else text
    unknown = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    guess = predicted(text)
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), guess).otherwise(unknown)


def held_out(doc_id: Column | str, folds: int, fold: int) -> Column:
    """Whether crc32 of doc_id as text leaves this remainder; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))
