"""The registered queries on annotation tables, one per operator or closely related group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N
from ..operators import accuracy, profile, resolve, stitch, tiles
from ..sources import scratch
from .fixtures import KEYS, Fixture

SHEET = ["file_id", "image_id"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[Fixture], DataFrame]) -> Callable[[Fixture], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
    return f


def _files(fx: Fixture) -> DataFrame:
    return fx.files.withColumns({"discipline": N.discipline("path"), "coco_file": N.basename("path")})


def _images(fx: Fixture) -> DataFrame:
    return fx.images.join(_files(fx).select("file_id", "coco_file", "discipline"), "file_id")


def _resolved(fx: Fixture) -> DataFrame:
    joined = resolve.annotations_resolved(fx.annotations, fx.images, fx.categories)
    return joined.join(_files(fx).select("file_id", "path", "coco_file", "discipline"), "file_id")


def _first() -> F.Column:
    return F.struct(F.lower("path"), "path", *KEYS)


def _classes(fx: Fixture) -> DataFrame:
    return resolve.class_map(fx.categories)


def _assigned(fx: Fixture) -> DataFrame:
    return tiles.assign(fx.annotations.join(fx.images.select(*SHEET, "width", "height"), SHEET))


def _detections(fx: Fixture) -> DataFrame:
    """Tile detections in sheet coordinates: clipped boxes with a made score."""
    c = F.col
    score = ((c("l_partkey") * 7919 + c("l_orderkey") * 104729 + c("t_idx") * 31) % 10000).cast("double") / 10000
    return _assigned(fx).select(
        *SHEET, "t_idx", *KEYS, c("category_id").alias("label"), score.alias("score"),
        (c("cx") + c("x0")).alias("x1"), (c("cy") + c("y0")).alias("y1"), (c("cx") + c("x0") + c("cw")).alias("x2"), (c("cy") + c("y0") + c("ch")).alias("y2"),
    )


def _kept(fx: Fixture, shown: list[str] | None = None) -> DataFrame:
    return stitch.nms(_detections(fx), [*SHEET, "label"], [*KEYS, "t_idx"], shown=shown)


def _placed(fx: Fixture) -> DataFrame:
    """The same, ordered by place instead of by keys; numbering and records read it more than once."""
    return scratch.written(_kept(fx, [*SHEET, "label", *stitch.PLACED]), "kept")


def _label_classes(fx: Fixture) -> DataFrame:
    """A class map of 20 of the 25 labels, so that some labels have no name."""
    return fx.spark.range(20).select(F.concat(F.lit("Class "), F.lpad(F.col("id").cast("string"), 2, "0")).alias("name"), F.col("id").cast("int").alias("class_id"))


def _predicted(fx: Fixture) -> DataFrame:
    """Predictions that miss some boxes and call others by another label."""
    d = _detections(fx).where("l_partkey % 13 <> 0")
    return d.withColumn("label", F.when(F.col("l_partkey") % 17 == 0, (F.col("label") + 1) % 25).otherwise(F.col("label")))


def _errors(fx: Fixture) -> DataFrame:
    by = [*SHEET, "name"]
    classes = _label_classes(fx)
    truth = fx.annotations.select(*SHEET, F.col("category_id").alias("label"))
    kept = stitch.nms(_predicted(fx), [*SHEET, "label"], [*KEYS, "t_idx"], shown=[*SHEET, "label"])
    return accuracy.count_errors(stitch.sheet_class_counts(truth, classes, SHEET), stitch.sheet_class_counts(kept, classes, SHEET), by)


@query
def resolve_annotations(fx: Fixture) -> DataFrame:
    return _resolved(fx).select(*SHEET, *KEYS, "name", "x", "y", "w", "h", "discipline")


@query
def orphan_annotations(fx: Fixture) -> DataFrame:
    return resolve.annotations_orphaned(fx.annotations, fx.images, fx.categories).select(*SHEET, *KEYS, "category_id", "missing")


@query
def object_files(fx: Fixture) -> DataFrame:
    single = (F.col("file_id") % 5 == 0) | ((F.col("file_id") % 5 == 1) & (F.col("category_id") % 2 == 0))
    categories = fx.categories.withColumn("name", F.when(single, "duct_segment").otherwise(F.col("name")))
    return resolve.object_files(fx.files, categories).select("file_id", "path")


@query
def discipline_files(fx: Fixture) -> DataFrame:
    return _files(fx).groupBy("discipline").agg(F.count("*").alias("n"))


@query
def class_map_combined(fx: Fixture) -> DataFrame:
    return resolve.class_map(fx.categories)


@query
def class_map_by_mode(fx: Fixture) -> DataFrame:
    named = fx.categories.join(_files(fx).select("file_id", "discipline"), "file_id")
    return resolve.class_map(named, ["discipline"])


@query
def mode_annotations(fx: Fixture) -> DataFrame:
    kept = resolve.in_discipline(_resolved(fx), "mechanical")
    return resolve.with_class(kept, resolve.class_map(kept)).groupBy("name", "class_id").agg(F.count("*").alias("n"))


@query
def class_counts(fx: Fixture) -> DataFrame:
    return profile.class_counts(_resolved(fx), ["name"], _first())


@query
def class_counts_by_discipline(fx: Fixture) -> DataFrame:
    return profile.class_counts(_resolved(fx), ["discipline", "name"], _first())


@query
def class_counts_total(fx: Fixture) -> DataFrame:
    return profile.counts_with_total(_resolved(fx).groupBy("name").agg(F.count("*").alias("n")))


@query
def sheet_counts(fx: Fixture) -> DataFrame:
    return profile.sheet_counts(_resolved(fx), ["discipline", "coco_file", *SHEET, "file_name", "width", "height"])


@query
def report_totals(fx: Fixture) -> DataFrame:
    return profile.totals(_files(fx), _resolved(fx))


@query
def box_sizes(fx: Fixture) -> DataFrame:
    return profile.box_sizes(_resolved(fx))


@query
def area_stats(fx: Fixture) -> DataFrame:
    return profile.spread(_resolved(fx).select((F.col("w") * F.col("h")).alias("area")), "area")


@query
def area_histogram(fx: Fixture) -> DataFrame:
    return profile.histogram(_resolved(fx).select(F.sqrt((F.col("w") * F.col("h")).cast("double")).alias("side")), "side", 60)


@query
def objects_per_sheet_hist(fx: Fixture) -> DataFrame:
    return profile.histogram(profile.sheet_counts(_resolved(fx), SHEET), "num_objects", 30)


@query
def safe_stem(fx: Fixture) -> DataFrame:
    return fx.table("documents").select("doc_id", N.safe_stem("text").alias("safe"))


@query
def stem(fx: Fixture) -> DataFrame:
    return fx.table("pages").select("page_id", N.basename("url").alias("base"), N.stem(N.basename("url")).alias("stem"))


@query
def tile_grid(fx: Fixture) -> DataFrame:
    return tiles.grid(fx.images)


@query
def tile_names(fx: Fixture) -> DataFrame:
    grid = tiles.grid(fx.images, keep=[*SHEET, "file_name"])
    return grid.select(*SHEET, "t_idx", N.tile_name(N.stem("file_name"), "t_idx", "x0", "y0").alias("tile_name"))


@query
def tile_batches(fx: Fixture) -> DataFrame:
    return tiles.batches(tiles.grid(fx.images))


@query
def resolve_pdf(fx: Fixture) -> DataFrame:
    images = fx.images.join(fx.pdfs.select("file_id", "folder").distinct(), "file_id")
    return resolve.source_pdf(images, fx.pdfs).select(*SHEET, "pdf_path", "page")


@query
def page_default(fx: Fixture) -> DataFrame:
    missing = fx.images.withColumns({"page": F.when(F.col("image_id") % 7 != 0, F.col("page")), "width": F.when(F.col("image_id") % 5 != 0, F.col("width"))})
    return missing.select("image_id", N.page_or_first("page").alias("page"), N.size_or_zero("width").alias("width"), ((N.size_or_zero("width") != 0) & (N.size_or_zero("height") != 0)).alias("resized"))


@query
def last_wins_dedupe(fx: Fixture) -> DataFrame:
    lines = fx.annotations.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return resolve.last_wins(lines, ["l_orderkey", "l_linenumber"], F.struct("l_partkey", "l_suppkey", "l_extendedprice"))


@query
def tile_assign(fx: Fixture) -> DataFrame:
    return _assigned(fx).select(*SHEET, "t_idx", *KEYS, "cx", "cy", "cw", "ch")


@query
def yolo_labels(fx: Fixture) -> DataFrame:
    named = fx.annotations.join(_resolved(fx).select(*SHEET, *KEYS, "name"), [*SHEET, *KEYS])  # before tiles repeat the boxes
    placed = tiles.assign(named.join(fx.images.select(*SHEET, "width", "height"), SHEET))
    return resolve.with_class(tiles.yolo_labels(placed), _classes(fx)).select(*SHEET, "t_idx", *KEYS, "class_id", "xc", "yc", "yw", "yh")


@query
def yolo_roundtrip(fx: Fixture) -> DataFrame:
    back = tiles.back_on_sheet(tiles.yolo_labels(_assigned(fx)))
    return back.select(*SHEET, "t_idx", *KEYS, *(F.round(c, 6).alias(c) for c in ("bx1", "by1", "bx2", "by2")))


@query
def sheet_split(fx: Fixture) -> DataFrame:
    return tiles.with_split(_images(fx)).select(*SHEET, "sheet_key", "split")


@query
def split_summary(fx: Fixture) -> DataFrame:
    counted = tiles.with_split(_images(fx)).groupBy("split").agg(F.count("*").alias("num_sheets"))
    return counted.withColumn("rate", F.col("num_sheets") / F.sum("num_sheets").over(Window.partitionBy()))


@query
def tile_stats(fx: Fixture) -> DataFrame:
    return tiles.split_stats(_assigned(fx).join(tiles.with_split(_images(fx)).select(*SHEET, "split"), SHEET))


@query
def empty_tiles(fx: Fixture) -> DataFrame:
    return tiles.empty_tiles(tiles.grid(fx.images), _assigned(fx))


@query
def empty_tile_sample(fx: Fixture) -> DataFrame:
    keyed = tiles.with_split(_images(fx)).select(*SHEET, "sheet_key")
    return tiles.sampled_empty(tiles.empty_tiles(tiles.grid(fx.images), _assigned(fx)).join(keyed, SHEET)).select(*SHEET, "t_idx", "sheet_key")


@query
def offset_boxes(fx: Fixture) -> DataFrame:
    c = F.col
    local = _assigned(fx).select(*SHEET, "t_idx", *KEYS, c("cx").alias("x1"), c("cy").alias("y1"), (c("cx") + c("cw")).alias("x2"), (c("cy") + c("ch")).alias("y2"))
    return tiles.offset(local, tiles.grid(fx.images)).select(*SHEET, "t_idx", *KEYS, "x1", "y1", "x2", "y2")


@query
def iou_pairs(fx: Fixture) -> DataFrame:
    pairs = stitch.iou_pairs(_detections(fx), [*SHEET, "label"], F.struct(*KEYS, "t_idx"))
    return pairs.select(*SHEET, "label", *(F.col(f"key_{s}.{k}").alias(f"{k}_{s}") for s in "ab" for k in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "t_idx")), "iou")


@query
def nms_single_class(fx: Fixture) -> DataFrame:
    return stitch.nms(_detections(fx).where("label = 7"), SHEET, [*KEYS, "t_idx"]).select(*SHEET, "t_idx", *KEYS, "label", "score")


@query
def nms_class_aware(fx: Fixture) -> DataFrame:
    return _kept(fx).select(*SHEET, "t_idx", *KEYS, "label", "score")


@query
def confident_detections(fx: Fixture) -> DataFrame:
    return stitch.confident(_detections(fx)).groupBy("label").agg(F.count("*").alias("n"))


@query
def sheet_class_counts(fx: Fixture) -> DataFrame:
    return stitch.sheet_class_counts(_kept(fx, [*SHEET, "label"]), _label_classes(fx), SHEET)


@query
def object_records(fx: Fixture) -> DataFrame:
    return stitch.object_records(_placed(fx), _label_classes(fx), SHEET, [stitch.PLACE]).select(*SHEET, "object_id", "type", "score", "x1", "y1", "x2", "y2")


@query
def sheet_records(fx: Fixture) -> DataFrame:
    kept, classes = _placed(fx), _label_classes(fx)
    objects = stitch.object_records(kept, classes, SHEET, [stitch.PLACE])
    sheets = fx.images.select(*SHEET, N.sheet_id(N.stem("file_name"), N.page_or_first("page")).alias("sheet_id"), "width", "height", F.lit(150).alias("dpi"))
    records = stitch.sheet_records(objects, stitch.sheet_class_counts(kept, classes, SHEET), sheets, SHEET)
    counted = F.array_join(F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ";")
    return records.select("sheet_id", *SHEET, "width", "height", "dpi", counted.alias("counts"), F.size("objects").alias("num_objects"), F.array_join(F.transform("objects", lambda o: o["type"]), ";").alias("types"))


@query
def count_errors(fx: Fixture) -> DataFrame:
    return _errors(fx)


@query
def count_accuracy(fx: Fixture) -> DataFrame:
    return accuracy.count_accuracy(_errors(fx))


@query
def count_accuracy_overall(fx: Fixture) -> DataFrame:
    return accuracy.count_accuracy_overall(_errors(fx))


@query
def legend_rows(fx: Fixture) -> DataFrame:
    return stitch.legend(stitch.sheet_class_counts(_kept(fx, [*SHEET, "label"]), _label_classes(fx), SHEET), _label_classes(fx))


@query
def average_precision(fx: Fixture) -> DataFrame:
    c = F.col
    truth = fx.annotations.select(*SHEET, c("category_id").alias("label"), *KEYS, c("x").alias("x1"), c("y").alias("y1"), (c("x") + c("w")).alias("x2"), (c("y") + c("h")).alias("y2"))
    kept = stitch.nms(_predicted(fx), [*SHEET, "label"], [*KEYS, "t_idx"], shown=[*SHEET, "label", *stitch.PLACED])
    scored = accuracy.average_precision(kept, truth, SHEET, [stitch.PLACE], KEYS)
    return scored.withColumn("average_precision", F.round("average_precision", 6))


