"""Dataset profile: counts, totals, box sizes and histograms over resolved annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import scratch

#: Size of the quantile sketch, whose ranks are off by about 0.004 of all rows, and what its bracket leaves on both sides.
SKETCH, MARGIN = 800, 0.02


def class_counts(resolved: DataFrame, by: list[str], first: Column) -> DataFrame:
    """``n`` per group, and ``place`` by count descending, first-seen order breaking ties.  ``first`` orders rows as
    they were seen.  The ranking window runs over the groups only."""
    return placed(resolved.groupBy(*by).agg(F.count("*").alias("n"), F.min(first).alias("_first")))


def placed(counted: DataFrame) -> DataFrame:
    """The ranking of counts ``n`` that were first seen at ``_first``."""
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "_first"))).drop("_first")


def counts_with_total(counts: DataFrame, name: str = "name", n: str = "n", total: str = "TOTAL") -> DataFrame:
    """Counts per name and one row for all of them."""
    rolled = counts.rollup(name).agg(F.sum(n).alias(n), F.grouping(name).alias("is_total"))
    return rolled.withColumn(name, F.when(F.col("is_total") == 1, total).otherwise(F.col(name))).where(F.col(n).isNotNull())


def sheet_counts(resolved: DataFrame, keys: list[str], first: str | None = None) -> DataFrame:
    """Sheets with a resolvable annotation: objects and distinct classes, and as ``_first`` the smallest of a column if one is named.

    Annotations of a sheet lie anywhere, so counting before the shuffle would hold about a row an annotation in a task, and
    tasks that read files grow with these.  Sheets are dealt first; Spark cuts what it shuffled into tasks of one size."""
    more = [first] if first else []
    dealt = resolved.select(*keys, "name", *more).repartition(*([k for k in keys if k in ("file_id", "image_id")] or keys))
    return dealt.groupBy(*keys).agg(F.count("*").alias("num_objects"), F.count_distinct("name").alias("num_classes"), *(F.min(c).alias("_first") for c in more))


def totals(files: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: files, sheets, annotations, classes of all and of each discipline that a report names.

    Annotations are read once, into one row a sheet with its set of classes; all figures come from those rows, so no row
    is repeated for the distinct counts."""
    sheets = scratch.written(resolved.groupBy("file_id", "image_id", "discipline").agg(F.count("*").alias("n"), F.collect_set("name").alias("names")), "sheets")
    of = lambda d: F.count_if(F.array_contains("disciplines", d)).alias(f"num_classes_{d}")
    names = sheets.select("discipline", F.explode("names").alias("name")).groupBy("name").agg(F.collect_set("discipline").alias("disciplines"))
    classes = names.agg(F.count("*").alias("num_classes_combined"), of("mechanical"), of("electrical"))
    counts = sheets.agg(F.count("*").alias("num_sheets"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_annotations"))
    return files.agg(F.count("*").alias("num_coco_files")).crossJoin(counts).crossJoin(classes)


def box_sizes(resolved: DataFrame) -> DataFrame:
    """Width, height and area of every box, rounded to two places; the area is of the unrounded sides."""
    two = lambda c: F.round(c.cast("double"), 2)
    return resolved.select("discipline", "name", two(F.col("w")).alias("w"), two(F.col("h")).alias("h"), two(F.col("w") * F.col("h")).alias("area"), F.col("width").alias("img_w"), F.col("height").alias("img_h"))


def spread(values: DataFrame, value: str, buckets: int = 1024, rounds: int = 2) -> DataFrame:
    """min, upper median and max of a column: the value at place n // 2 of the ascending order.

    Two scans.  The first one makes a quantile sketch, which brackets the middle; the second counts the values below the
    bracket and each value inside it.  Where the sketch missed (it may, rarely) the bracket is everything.  The counts
    are a table of the distinct values of a few hundredths of the rows; equal buckets of them are bracketed by running sums
    over at most ``buckets`` counts, and only the values of the last bucket are ranked.
    """
    v = F.col(value).cast("double")
    full = values.where(F.col(value).isNotNull()).select(value)
    sketch = F.kll_sketch_agg_double(v, F.lit(SKETCH))
    first = full.agg(F.count("*").alias("n"), F.min(value).alias("min_value"), F.max(value).alias("max_value"), sketch.alias("_s")).first()
    spark = values.sparkSession
    kind = full.schema[value].dataType.simpleString()
    result = f"n bigint, min_value {kind}, median_value {kind}, max_value {kind}"
    if not first["n"]:
        return spark.createDataFrame([(0, None, None, None)], result)
    rank = first["n"] // 2
    one = spark.createDataFrame([(first["_s"],)], "s binary")
    low, high = one.select(*(F.kll_sketch_get_quantile_double("s", F.lit(q)) for q in (0.5 - MARGIN, 0.5 + MARGIN))).first()
    for lo, hi in ((low, high), (-float("inf"), float("inf"))):
        inside = F.when(v >= lo, F.col(value))
        counted = scratch.written(full.where(v <= hi).groupBy(inside.alias("_v")).agg(F.count("*").alias("_n")), "middle")
        below, held = counted.agg(F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0))).first()
        if below <= rank < below + held:
            break
    middle = _at_place(counted.where("_v IS NOT NULL"), rank - below, buckets, rounds)
    return spark.createDataFrame([(first["n"], first["min_value"], middle, first["max_value"])], result)


def _at_place(counted: DataFrame, rank: int, buckets: int, rounds: int):
    """The value at a place of the ascending order of values (``_v``, each ``_n`` times)."""
    v = F.col("_v").cast("double")
    for _ in range(rounds):
        lo, hi, many = counted.agg(F.min(v), F.max(v), F.count("*")).first()
        if many <= buckets or not hi > lo:
            break
        bucket = F.least(F.lit(buckets - 1), F.floor((v - lo) * buckets / (hi - lo))).alias("_b")
        sums = sorted((r["_b"], r["_n"]) for r in counted.groupBy(bucket).agg(F.sum("_n").alias("_n")).collect())  # at most ``buckets``
        for at, n in sums:
            if rank < n:
                break
            rank -= n
        counted = counted.where(bucket == at)
    running = F.sum("_n").over(Window.orderBy("_v"))
    return counted.withColumn("_r", running).where(F.col("_r") > rank).agg(F.min("_v")).first()[0]


def histogram(values: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n) of equal bins between the smallest and the largest value, the last one closed.  Bounds are one row."""
    v = F.col(value).cast("double")
    bounds = values.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((v - F.col("_lo")) * bins / (F.col("_hi") - F.col("_lo")))))
    placed = values.where(F.col(value).isNotNull()).crossJoin(F.broadcast(bounds)).select(at.cast("int").alias("bin"))
    return placed.groupBy("bin").agg(F.count("*").alias("n"))
