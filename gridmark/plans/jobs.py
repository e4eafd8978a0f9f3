"""Whole jobs: profile a dataset, build training tiles, run a detector over PDFs, score counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import accuracy, profile, resolve, stitch, tiles
from ..sources import coco, rasters, scratch, sinks

SHEET = ["file_id", "image_id"]
SEEN = ("path", "ann_seq")


def _resolved(data: coco.Dataset) -> DataFrame:
    joined = resolve.annotations_resolved(data.annotations, data.images, data.categories)
    return joined.join(data.files.select("file_id", "path", "coco_file", "discipline"), "file_id")


def _seen() -> F.Column:
    return F.struct(F.lower("path"), *SEEN)


def analyze(spark: SparkSession, root: str, out: str) -> dict:
    """Class, sheet and box tables, class maps, and the report in JSON and Markdown; returns the report."""
    data = coco.load(spark, root)
    resolved = scratch.written(_resolved(data), "resolved")
    seen = scratch.written(resolved.groupBy("discipline", "name").agg(F.count("*").alias("n"), F.min(_seen()).alias("_first")), "classes")
    by_class = profile.placed(seen).orderBy("place")
    by_name = profile.placed(seen.groupBy("name").agg(F.sum("n").alias("n"), F.min("_first").alias("_first")))
    sinks.csv(by_class.select(F.col("name").alias("class"), "discipline", F.col("n").alias("instances")), f"{out}/class_counts.csv")
    sheets = scratch.written(profile.sheet_counts(resolved, ["discipline", "coco_file", *SHEET, "file_name", "width", "height"], "ann_seq"), "sheets")
    ordered = sheets.orderBy(F.lower("file_id"), "file_id", "_first")  # a file's path is its id
    sinks.csv(ordered.select("discipline", "coco_file", "file_name", "width", "height", "num_objects", "num_classes"), f"{out}/sheet_counts.csv", parts=True)
    sinks.csv(profile.box_sizes(resolved).withColumnRenamed("name", "class"), f"{out}/box_sizes.csv", parts=True)
    maps = {mode: resolve.class_map(_category_names(data, mode)) for mode in ("combined", "mechanical", "electrical")}
    listed = {mode: [r["name"] for r in m.orderBy("class_id").collect()] for mode, m in maps.items()}
    for mode, m in maps.items():
        sinks.class_map(m, f"{out}/classes_{mode}.json")
    rows = by_class.collect()
    total = profile.totals(data.files, resolved).first()
    report = {
        "dataset_root": root, "num_coco_files": total["num_coco_files"],
        "files_per_discipline": {r["discipline"]: r["n"] for r in data.files.groupBy("discipline").agg(F.count("*").alias("n")).orderBy("discipline").collect()},
        "num_sheets": total["num_sheets"], "total_annotations": total["total_annotations"],
        **{f"num_classes_{mode}": len(names) for mode, names in listed.items()}, "classes_mechanical": listed["mechanical"], "classes_electrical": listed["electrical"],
        "instances_per_class": {r["name"]: r["n"] for r in by_name.orderBy("place").collect()},
    }
    sinks.report_json(spark, report, f"{out}/dataset_report.json")
    tables = {d: [(r["name"], r["n"]) for r in rows if r["discipline"] == d] for d in ("mechanical", "electrical")}
    area = profile.spread(resolved.select((F.col("w") * F.col("h")).alias("area")), "area").first()
    sinks.report_markdown(spark, report, tables, (area["min_value"], area["median_value"], area["max_value"]) if area["n"] else None, f"{out}/dataset_report.md")
    for name, values, column, bins in (("box_side", resolved.select(F.sqrt(F.col("w") * F.col("h")).alias("v")), "v", 60), ("objects_per_sheet", sheets, "num_objects", 30)):
        sinks.csv(profile.histogram(values, column, bins).orderBy("bin"), f"{out}/hist_{name}.csv")
    return report


def _category_names(data: coco.Dataset, mode: str) -> DataFrame:
    kept = resolve.in_discipline(data.files, mode).select("file_id")
    return data.categories.join(kept, "file_id", "left_semi")


def prepare(spark: SparkSession, root: str, out: str, mode: str = "combined", tile: int = 1280, overlap: float = 0.2, dpi: int = 150, val_frac: float = 0.2, empty_frac: float = 0.1, least_visible: float = 0.3, renderer: rasters.Renderer | None = None, seed: int = 0) -> DataFrame:
    """Label rows and label files, class map and dataset.yaml, and with a renderer the tiles' images; returns tiles
    and boxes per split.  Without a renderer the recorded sizes stand for the rasters'.  Pages that can't be rendered are
    left out.  ``seed`` chooses among the empty tiles."""
    data = coco.load(spark, root)
    files = resolve.in_discipline(data.files, mode)
    classes = resolve.class_map(_category_names(data, mode))
    images = resolve.source_pdf(data.images.join(files.select("file_id", "folder", "coco_file", "discipline"), "file_id"), coco.pdfs(spark, root)).where("pdf_path IS NOT NULL")
    images = tiles.with_split(images.withColumns({"width": N.size_or_zero("width"), "height": N.size_or_zero("height")}), val_frac)
    if renderer is not None:
        sizes = rasters.page_sizes(images, renderer, dpi).select("pdf_path", "page", F.col("width").alias("_w"), F.col("height").alias("_h"))
        sized = (F.col("width") > 0) & (F.col("height") > 0)
        known, unknown = images.where(sized), images.where(~sized).join(sizes.where("_w > 0"), ["pdf_path", "page"])
        images = scratch.written(known.unionByName(unknown.withColumns({"width": F.col("_w"), "height": F.col("_h")}).drop("_w", "_h")), "pages")
    boxes = resolve.with_class(resolve.annotations_resolved(data.annotations, images, data.categories), classes)
    shown = tiles.yolo_labels(tiles.assign(boxes, tile, overlap, least_visible))
    name = N.tile_name(N.stem("file_name"), "t_idx", "x0", "y0").alias("tile_name")
    full = shown.select("split", *SHEET, "t_idx", "x0", "y0", "x1", "y1", name, "ann_seq", "class_id", "xc", "yc", F.col("yw").alias("w"), F.col("yh").alias("h"))
    grid = tiles.grid(images, tile, overlap, [*SHEET, "file_name", "split", "sheet_key"])
    empty = tiles.sampled_empty(tiles.empty_tiles(grid, shown), empty_frac, seed)
    bare = empty.select("split", *SHEET, "t_idx", "x0", "y0", "x1", "y1", name)
    everything = full.unionByName(bare, allowMissingColumns=True)
    if renderer is not None:
        everything = scratch.written(everything, "tiles")
        wanted = everything.select(*SHEET, "tile_name", "x0", "y0", "x1", "y1").distinct().groupBy(*SHEET).agg(F.collect_list(F.struct("tile_name", "x0", "y0", "x1", "y1")).alias("tiles"))
        pages = images.join(wanted, SHEET).groupBy("pdf_path", "page", "width", "height").agg(F.flatten(F.collect_list("tiles")).alias("tiles"))
        rasters.tile_images(pages, renderer, dpi).write.mode("overwrite").parquet(f"{out}/images")
        failed = spark.read.parquet(f"{out}/images").where("error IS NOT NULL").select("pdf_path", "page").join(images, ["pdf_path", "page"]).select(*SHEET)
        everything = everything.join(failed, SHEET, "left_anti")
    sinks.labels(everything, f"{out}/tiles")
    written = spark.read.parquet(f"{out}/tiles")
    sinks.label_files(sinks.label_lines(written, ["ann_seq"]), f"{out}/labels")
    sinks.class_map(classes, f"{out}/classes.json")
    sinks.dataset_yaml(classes, f"{out}/dataset.yaml", out)
    return tiles.split_stats(written.where("class_id IS NOT NULL"))


def _stitched(found: DataFrame, conf: float, nms_iou: float) -> DataFrame:
    """Confident detections of pages, moved to the sheet and suppressed by class."""
    confident = stitch.confident(found.where("label IS NOT NULL"), conf)
    placed = confident.withColumns({k: F.col(k) + F.col(k[0] + "0") for k in ("x1", "y1", "x2", "y2")}).drop("x0", "y0", "width", "height", "error")
    return stitch.nms(placed, [*SHEET, "label"], ["t_idx"], nms_iou)


def predict(spark: SparkSession, pdfs: DataFrame | str | list[str], class_map_path: str, out: str, renderer: rasters.Renderer, detector: rasters.Detector, tile: int = 1280, overlap: float = 0.2, dpi: int = 150, conf: float = 0.25, nms_iou: float = 0.5, pages: list[int] | None = None, batch: int = 16, preview: bool = False) -> DataFrame:
    """Sheet records and counts of every page: rendered, tiled and detected once, moved to the sheet, stitched.  ``pdfs``: a
    table (pdf_path), a folder whose PDFs are taken, or a few paths.  ``preview``: also images with the detections drawn, for
    which pages are rendered again."""
    classes = coco.class_map(spark, class_map_path)
    if isinstance(pdfs, str):
        pdfs = coco.pdfs(spark, pdfs, "").select("pdf_path")
    elif isinstance(pdfs, list):
        pdfs = spark.createDataFrame([(p,) for p in pdfs], "pdf_path string")
    listed = rasters.page_list(pdfs, renderer, pages).withColumns({"width": F.lit(0), "height": F.lit(0)})
    drawn = scratch.written(rasters.page_detections(listed, renderer, detector, tile, overlap, dpi, batch), "detections").withColumnsRenamed({"pdf_path": "file_id", "page": "image_id"})
    sheets = drawn.where("label IS NULL AND error IS NULL").select(*SHEET, "width", "height")
    kept = scratch.written(_stitched(drawn, conf, nms_iou), "kept")
    objects = stitch.object_records(kept, classes, SHEET, ["t_idx", "x1", "y1", "x2", "y2"])
    counts = stitch.sheet_class_counts(kept, classes, SHEET)
    ident = N.sheet_id(N.stem(N.basename("file_id")), "image_id").alias("sheet_id")
    records = stitch.sheet_records(objects, counts, sheets.select(*SHEET, ident, "width", "height", F.lit(dpi).alias("dpi")), SHEET)
    shaped = scratch.written(records.select("sheet_id", F.col("file_id").alias("source"), F.col("image_id").alias("page"), "width", "height", "dpi", "scale", "counts", "objects"), "records")
    sinks.records(shaped, f"{out}/records")
    summary = counts.select(N.basename("file_id").alias("source"), ident, F.col("name").alias("class"), F.col("n").alias("count"))
    sinks.counts_summary(summary, f"{out}/counts_summary.csv")
    if preview:
        named = {"file_id": "pdf_path", "image_id": "page"}
        rasters.previews(sheets.withColumnsRenamed(named), renderer, kept.withColumnsRenamed(named), ["pdf_path", "page"], dpi=dpi).write.mode("overwrite").parquet(f"{out}/previews")
    return shaped


def count_scores(truth: coco.Dataset, predicted: DataFrame, classes: DataFrame, out: str | None = None) -> DataFrame:
    """Count accuracy per class and overall; ``predicted`` has file_id, image_id, name, n.  Errors per sheet go to a
    CSV below ``out``."""
    named = resolve.with_class(_resolved(truth), classes)
    counted = named.groupBy(*SHEET, "name").agg(F.count("*").alias("n"))
    errors = accuracy.count_errors(counted, predicted, [*SHEET, "name"])
    if out:
        listed = errors.join(truth.files.select("file_id", "discipline", "coco_file"), "file_id")
        sinks.csv(listed.select("discipline", "coco_file", "image_id", F.col("name").alias("class"), "gt", "pred", "abs_err").orderBy("coco_file", "image_id", "class"), f"{out}/count_accuracy.csv", parts=True)
    return accuracy.count_accuracy_overall(errors)


def _detected(spark: SparkSession, root: str, renderer: rasters.Renderer, detector: rasters.Detector, mode: str, tile: int, overlap: float, dpi: int, conf: float, nms_iou: float, split: str | None) -> tuple[coco.Dataset, DataFrame]:
    """The dataset's part that a detector saw (of one split if named), and its stitched detections."""
    data = coco.load(spark, root)
    files = resolve.in_discipline(data.files, mode)
    images = resolve.source_pdf(data.images.join(files.select("file_id", "folder", "coco_file"), "file_id"), coco.pdfs(spark, root)).where("pdf_path IS NOT NULL")
    images = tiles.with_split(images)
    images = images.where(F.col("split") == split) if split else images
    drawn = scratch.written(rasters.page_detections(images, renderer, detector, tile, overlap, dpi), "detections")
    sheets = images.select(*SHEET, "pdf_path", "page").join(drawn.where("label IS NULL AND error IS NULL").select("pdf_path", "page"), ["pdf_path", "page"])
    kept = scratch.written(_stitched(drawn.join(sheets, ["pdf_path", "page"]), conf, nms_iou), "kept")
    seen = sheets.select(*SHEET).distinct()
    return coco.Dataset(files, data.images.join(seen, SHEET, "left_semi"), data.categories, data.annotations, data.quarantine), kept


def evaluate(spark: SparkSession, root: str, class_map_path: str, out: str, renderer: rasters.Renderer, detector: rasters.Detector, mode: str = "combined", tile: int = 1280, overlap: float = 0.2, dpi: int = 150, conf: float = 0.25, nms_iou: float = 0.5, split: str | None = None) -> DataFrame:
    """Count accuracy of a detector over the dataset's own sheets, of one split if named."""
    classes = coco.class_map(spark, class_map_path)
    truth, kept = _detected(spark, root, renderer, detector, mode, tile, overlap, dpi, conf, nms_iou, split)
    return count_scores(truth, stitch.sheet_class_counts(kept, classes, SHEET), classes, out)


def mean_precision(spark: SparkSession, root: str, class_map_path: str, renderer: rasters.Renderer, detector: rasters.Detector, mode: str = "combined", tile: int = 1280, overlap: float = 0.2, dpi: int = 150, conf: float = 0.001, nms_iou: float = 0.5, split: str | None = "val") -> DataFrame:
    """(class, n_truth, ap50, ap50_95) of a detector over the dataset's own sheets, of the validation split unless told
    otherwise, and a row without a class: the means over classes."""
    classes = coco.class_map(spark, class_map_path)
    truth, kept = _detected(spark, root, renderer, detector, mode, tile, overlap, dpi, conf, nms_iou, split)
    boxes = resolve.with_class(_resolved(truth), classes).select(*SHEET, "ann_seq", F.col("class_id").alias("label"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))
    scored = accuracy.mean_average_precision(kept, scratch.written(boxes, "truth"), SHEET, ["t_idx", "x1", "y1", "x2", "y2"], ["ann_seq"])
    named = scored.join(classes, F.col("label") == F.col("class_id")).select(F.col("name").alias("class"), "n_truth", "ap50", "ap50_95")
    mean = scored.agg(F.lit(None).cast("string").alias("class"), F.sum("n_truth").alias("n_truth"), F.avg("ap50").alias("ap50"), F.avg("ap50_95").alias("ap50_95"))
    return named.unionByName(mean)
