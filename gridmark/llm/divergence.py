"""Source divergence audit: which sources of a language write alike, and which terms set a source apart.

Sort-based streaming.  A task first adds up its own documents of each (lang, term, source), so that a frequent term is
one row a task and source and not one a document; those rows are partitioned by (lang, term), sorted by (lang, term,
source) and scanned once: a run gives a cell's document frequency and count, and the cells of one term, as many as its
sources, say whether it stays.  Another scan over the kept runs emits, summed up in the task, partial sums for pairs of
sources.

Only sources that hold a term meet in its run.  With p0 for the share of a term that a group doesn't hold, a pair's
value is  sum over terms of a of f(p, q0) + sum over terms of b of f(p0, q) + (V - |a| - |b|) f(p0, q0) + sum over common
terms of [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)].  The first two sums need no term, only how many terms a group holds
how often; the last one comes from the runs.  So work follows the cells, not sources times vocabulary; the result itself
has a row for every two sources of a language.

Shares are exact integers p = 1 + floor(SCALE (count + 1) / (N + V)), and f = floor((p - q)^2 / q).

Null text, lang and source are ''.  A group without terms, or in a language that keeps none, has value 0 or the value of
its constant shares.  Repeated rows are documents of their own; document ids play no part, nor do other columns.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import runs
from .flat import groups, text_bytes
from .resampling import words
from .store import small_batches, written

SCALE, LEAST_DOCS, TOP = 1_000_000_000, 3, 200
#: Pairs of cells that a task makes at a time, and groups by which languages are dealt when their sources are paired.
PAIRS, SALT = 1 << 20, 16


def letter_kind() -> np.ndarray:
    """Kinds of bytes for terms [^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+."""
    kind = np.zeros(256, np.uint8)
    kind[65:91] = kind[97:123] = kind[128:] = 1
    return kind


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) to the task's (lang, term, source, docs, n)."""
    sums, kind = runs.Sums(["lang", "term", "source"], ["docs", "n"]), letter_kind()
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        owners = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for i, j in groups(offsets):
            found, first = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], kind)
            if not len(found):
                continue
            named = list(dict.fromkeys(owners[i:j]))
            number = {o: k for k, o in enumerate(named)}
            size = len(found.dictionary)
            doc = np.repeat(np.arange(j - i), np.diff(first))
            cells, times = np.unique(doc * size + found.indices.to_numpy(), return_counts=True)
            group = np.array([number[o] for o in owners[i:j]])[cells // size] * size + cells % size
            keys, of = np.unique(group, return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, of, times)
            terms = found.dictionary.take(pa.array(keys % size)).cast(pa.binary()).cast(pa.string())
            lang, source = (pa.array([named[k][side] for k in keys // size], pa.string()) for side in (0, 1))
            yield from sums.add(pa.table({"lang": lang, "term": terms, "source": source, "docs": np.bincount(of), "n": n}))
    yield from sums.rest()


def _kept(least: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, docs, n) sorted so, summed up by run, to the cells of the terms in at least so many
    documents of their language, with the term's count there."""
    cells = runs.summed(batches, ["lang", "term", "source"], ["docs", "n"])
    for table in runs.whole(cells, ["lang", "term"]):
        at = runs.starts(table, ["lang", "term"])
        size = np.diff(np.append(at, table.num_rows))
        docs, n = (np.add.reduceat(table.column(c).to_numpy(), at) for c in ("docs", "n"))
        head = np.zeros(table.num_rows, bool)
        head[at] = True
        out = table.select(["lang", "term", "source", "n"]).append_column("total", pa.array(np.repeat(n, size))).append_column("head", pa.array(head))
        yield from out.filter(pa.array(np.repeat(docs >= least, size))).to_batches()


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (count + 1) / whole), by three digits of the quotient at a time, so that nothing overflows."""
    left, out = count.astype(np.int64) + 1, np.zeros(len(count), np.int64)
    out, left = left // whole, left % whole
    for _ in range(3):
        out, left = out * 1000 + left * 1000 // whole, left * 1000 % whole
    return out + 1


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, n, whole) by runs of (lang, term) to the task's sums (lang, source, item, d) over common
    terms.  A group's shares add up to about SCALE, so no sum of f passes 4 SCALE^2, and 64 bits hold it."""
    f = lambda p, q: (p - q) * (p - q) // q
    sums = runs.Sums(["lang", "source", "item"], ["d"])
    for table in runs.whole(batches, ["lang", "term"]):
        at = runs.starts(table, ["lang", "term"])
        size = np.diff(np.append(at, table.num_rows))
        whole = table.column("whole").to_numpy()
        p, p0 = shares(table.column("n").to_numpy(), whole), shares(np.zeros(len(whole), np.int64), whole)
        begin, many = np.repeat(at, size), np.repeat(size, size)
        owners = list(zip(table.column("lang").to_pylist(), table.column("source").to_pylist(), strict=True))
        named = list(dict.fromkeys(owners))
        number = {o: k for k, o in enumerate(named)}
        own = np.array([number[o] for o in owners])
        behind = np.concatenate([[0], np.cumsum(many)])
        i = 0
        while i < len(many):
            j = max(i + 1, int(np.searchsorted(behind, behind[i] + PAIRS, "right")) - 1)
            a = np.repeat(np.arange(i, j), many[i:j])
            b = np.arange(len(a)) - np.repeat(behind[i:j] - behind[i] - begin[i:j], many[i:j])
            a, b = a[a != b], b[a != b]
            keys, of = np.unique(own[a] * len(named) + own[b], return_inverse=True)
            d = np.zeros(len(keys), np.int64)
            np.add.at(d, of, f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]))
            x, y = [named[k] for k in keys // len(named)], [named[k] for k in keys % len(named)]
            yield from sums.add(pa.table({"lang": pa.array([o[0] for o in x], pa.string()), "source": pa.array([o[1] for o in x], pa.string()), "item": pa.array([o[1] for o in y], pa.string()), "d": d}))
            i = j
    yield from sums.rest()


def _share(count: str, whole: str) -> Column:
    return F.expr(f"1 + CAST({SCALE} AS DECIMAL(10)) * ({count} + 1) DIV nullif({whole}, 0)")


def _f(p: str, q: str) -> Column:
    return F.expr(f"({p} - {q}) * ({p} - {q}) DIV {q}")


def cells(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, source, n, total, head) of the kept terms: occurrences in the source and in the language; head marks one
    row a term."""
    small_batches(docs.sparkSession)
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    part = plain.mapInArrow(_partials, "lang string, term string, source string, docs bigint, n bigint")
    cell = part.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return written(cell.mapInArrow(lambda batches: _kept(least_docs, batches), "lang string, term string, source string, n bigint, total bigint, head boolean"), "cells")


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the lang, part ``term`` the
    ``top`` kept terms that the source uses more than the lang does."""
    kept = cells(docs, lang_col, source_col, text_col, least_docs)
    terms = kept.where("head").groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n"))
    every = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source")))).groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    held = kept.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count("*").alias("held"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    sized = every.join(held, ["lang", "source"], "left").join(terms.select("lang", "v", F.col("n").alias("all")), "lang", "left")
    named = written(sized.select("lang", "source", zero("held").alias("held"), zero("v").alias("v"), (zero("words") + zero("v")).alias("whole"), (zero("all") + zero("v")).alias("lang_whole")), "sources")

    own = kept.join(named.select("lang", "source", "whole", "lang_whole"), ["lang", "source"])
    common = own.select("lang", "term", "source", "n", "whole").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_paired, "lang string, source string, item string, d bigint")
    common = common.groupBy("lang", "source", "item").agg(F.sum(F.col("d").cast("decimal(38,0)")).alias("d"))
    bare = named.withColumn("p0", F.coalesce(_share("0L", "whole"), F.lit(1)))
    left = bare.select("lang", "source", "held", "v", "p0", F.pmod(F.xxhash64("source"), F.lit(SALT)).alias("_s"))
    right = bare.select("lang", F.col("source").alias("item"), F.col("held").alias("item_held"), F.col("p0").alias("q0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("_s"))
    pairs = left.join(right, ["lang", "_s"]).where("source <> item").drop("_s")
    counted = own.groupBy("lang", "source", "whole", "n").agg(F.count("*").alias("h")).withColumn("p", _share("n", "whole")).select("lang", "source", "p", "h")
    many = lambda value: F.sum(F.col("h") * value.cast("decimal(38,0)"))
    first = pairs.select("lang", "source", "item", "q0").join(counted, ["lang", "source"]).groupBy("lang", "source", "item").agg(many(_f("p", "q0")).alias("x"))
    second = pairs.select("lang", "source", "item", "p0").join(counted.withColumnRenamed("source", "item"), ["lang", "item"]).groupBy("lang", "source", "item").agg(many(_f("p0", "p")).alias("y"))
    keys = ["lang", "source", "item"]
    full = pairs.join(first, keys, "left").join(second, keys, "left").join(common, keys, "left")
    wide = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(38,0)"))
    neither = (F.col("v") - F.col("held") - F.col("item_held")) * _f("p0", "q0").cast("decimal(38,0)")
    value = (wide("x") + wide("y") + wide("d") + neither).cast("decimal(38,0)").cast("long")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    near = full.select(*keys, value.alias("value")).withColumn("rank", F.row_number().over(by_value)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")

    told = own.where("n > 0").withColumns({"p": _share("n", "whole"), "q": _share("total", "lang_whole")}).where("p > q")
    apart = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    return near.unionByName(apart.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top))
