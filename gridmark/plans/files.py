"""Registered queries on sources, sinks and jobs: a set of annotation files is written from the test tables, read,
worked on, and what was written is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import accuracy, resolve, stitch, tiles
from ..sources import coco, scratch, sinks
from . import jobs
from .catalogue import QUERIES, SHEET, _detections, _label_classes, _placed, _predicted
from .fixtures import KEYS, Fixture

#: What unusable files hold, by nation key modulo 5.
BROKEN = {0: "{nope", 1: "[1]", 2: '{"images": []}'}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixture(spark, sf_dir))
    return f


def annotation_files(fx: Fixture) -> str:
    """The folder of a set: one document a file of the fixture, unusable files, and a PDF in every folder but ``misc``."""
    single = F.col("file_id") % 11 == 5
    inside = F.regexp_replace("path", "^/data/", "")
    named = fx.categories.withColumn("name", F.when(single, "duct_segment").otherwise(F.col("name")))
    stale = named.withColumns({"name": F.when(single, "duct_segment").otherwise("Old"), "turn": F.lit(0)})
    box = F.array(*(F.col(c).cast("double") for c in "xywh")).alias("bbox")
    long, none = lambda c: N.col(c).cast("long"), F.lit(None)

    def section(k: int, df: DataFrame, order: list, *item) -> DataFrame:
        """Elements of the k-th array, with as many columns to sort by as the annotations have; then the text decides."""
        places = [long(c) for c in order] + [none.cast("long")] * (4 - len(order))
        price = F.col("l_extendedprice") if k == 2 else none.cast("double")
        return df.select("file_id", F.lit(k).alias("section"), *(c.alias(f"o{i}") for i, c in enumerate([*places, price])), F.to_json(F.struct(*item)).alias("body"))

    images = section(0, fx.images, ["image_id"], F.col("image_id").alias("id"), "file_name", "width", "height", "page")
    categories = section(1, named.withColumn("turn", F.lit(1)).unionByName(stale), ["turn", "category_id"], F.col("category_id").alias("id"), "name")
    annotations = section(2, fx.annotations, KEYS[:4], F.col("l_orderkey").alias("id"), "image_id", "category_id", box)
    every = fx.files.select("file_id", F.lit(0).alias("section"))
    items = images.unionByName(categories).unionByName(annotations).unionByName(every, allowMissingColumns=True)
    rows = items.join(F.broadcast(fx.files.select("file_id", inside.alias("name"))), "file_id")
    root = scratch.folder(fx.spark, "set")
    sinks.json_documents(rows, root, ["images", "categories", "annotations"], [f"o{i}" for i in range(5)] + ["body"])
    nations = fx.table("nation").withColumn("k", (F.col("n_nationkey") % 5).cast("int")).where("k < 3")
    broken = nations.select(F.concat(F.lit("training/broken/"), "n_name", F.lit(".json")).alias("name"), F.element_at(F.create_map(*(F.lit(x) for pair in BROKEN.items() for x in pair)), F.col("k")).alias("body"))
    pdfs = fx.files.select(F.concat(N.folder(inside), F.lit("/plan.pdf")).alias("name"), F.lit("%PDF").alias("body")).distinct().where("name NOT LIKE '%misc%'")
    sinks.files(broken.unionByName(pdfs), root)
    return root


def _dataset(fx: Fixture) -> coco.Dataset:
    return coco.load(fx.spark, annotation_files(fx))


def _of_file(data: coco.Dataset, table: DataFrame) -> DataFrame:
    return table.join(data.files.select("file_id", "coco_file"), "file_id").drop("file_id")


@query
def coco_files(fx: Fixture) -> DataFrame:
    return _dataset(fx).files.select("coco_file", "discipline", N.basename("folder").alias("folder"))


@query
def coco_quarantine(fx: Fixture) -> DataFrame:
    return _dataset(fx).quarantine.select(N.basename("path").alias("file"), "reason")


@query
def coco_images(fx: Fixture) -> DataFrame:
    data = _dataset(fx)
    return _of_file(data, data.images).select("coco_file", "image_id", "file_name", "width", "height", "page")


@query
def coco_categories(fx: Fixture) -> DataFrame:
    data = _dataset(fx)
    return _of_file(data, data.categories).select("coco_file", "category_id", "name")


@query
def coco_annotations(fx: Fixture) -> DataFrame:
    data = _dataset(fx)
    return _of_file(data, data.annotations).select("coco_file", "ann_seq", "image_id", "category_id", "x", "y", "w", "h")


@query
def pdf_listing(fx: Fixture) -> DataFrame:
    root = scratch.folder(fx.spark, "pdfs")
    sinks.files(fx.pdfs.select(F.regexp_replace("pdf_path", "^/data/", "").alias("name"), F.lit("%PDF").alias("body")), root)
    return coco.pdfs(fx.spark, root).select(N.basename("folder").alias("folder"), N.basename("pdf_path").alias("pdf"))


def _text(fx: Fixture, path: str) -> DataFrame:
    return fx.spark.read.text(path, wholetext=True).select(F.col("value").alias("body"))


@query
def class_map_read(fx: Fixture) -> DataFrame:
    path = scratch.folder(fx.spark, "classes")
    sinks.class_map(resolve.class_map(fx.categories), path)
    return coco.class_map(fx.spark, path)


@query
def class_map_inverted(fx: Fixture) -> DataFrame:
    path = scratch.folder(fx.spark, "classes")
    mapped = resolve.class_map(fx.categories).agg(F.to_json(F.struct(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "class_id")))).alias("name_to_id"))).alias("body"))
    sinks.text_file(fx.spark, path, mapped.first()["body"])
    return coco.class_map(fx.spark, path)


@query
def class_map_text(fx: Fixture) -> DataFrame:
    path = scratch.folder(fx.spark, "classes")
    sinks.class_map(resolve.class_map(fx.categories), path)
    return _text(fx, path)


@query
def dataset_yaml_text(fx: Fixture) -> DataFrame:
    path = scratch.folder(fx.spark, "yaml")
    sinks.dataset_yaml(resolve.class_map(fx.categories.withColumn("name", F.replace("name", F.lit(" "), F.lit(' "')))), path, "C:\\data\\set")
    return _text(fx, path)


def _analysis(fx: Fixture) -> str:
    out = scratch.folder(fx.spark, "analysis")
    jobs.analyze(fx.spark, annotation_files(fx), out)
    return out


@query
def analyze_report(fx: Fixture) -> DataFrame:
    counts = ("num_coco_files", "num_sheets", "total_annotations", "num_classes_combined", "num_classes_mechanical", "num_classes_electrical")
    kinds = ", ".join(f"{c} bigint" for c in counts) + ", files_per_discipline map<string,bigint>, classes_mechanical array<string>, classes_electrical array<string>, instances_per_class map<string,bigint>"
    report = fx.spark.read.schema(kinds).json(f"{_analysis(fx)}/dataset_report.json", multiLine=True)
    listed = lambda c: F.array_join(F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ";").alias(c)
    return report.select(*counts, listed("files_per_discipline"), *(F.array_join(f"classes_{d}", ",").alias(d) for d in ("mechanical", "electrical")), listed("instances_per_class"))


@query
def analyze_markdown(fx: Fixture) -> DataFrame:
    return fx.spark.read.text(f"{_analysis(fx)}/dataset_report.md").select(F.col("value").alias("line"))


@query
def csv_class_counts(fx: Fixture) -> DataFrame:
    return fx.spark.read.csv(f"{_analysis(fx)}/class_counts.csv", header=True)


@query
def csv_sheet_counts(fx: Fixture) -> DataFrame:
    return fx.spark.read.csv(f"{_analysis(fx)}/sheet_counts.csv", header=True)


@query
def csv_box_sizes(fx: Fixture) -> DataFrame:
    return fx.spark.read.schema("discipline string, class string, w double, h double, area double, img_w int, img_h int").csv(f"{_analysis(fx)}/box_sizes.csv", header=True)


@query
def prepare_stats(fx: Fixture) -> DataFrame:
    return jobs.prepare(fx.spark, annotation_files(fx), scratch.folder(fx.spark, "prepared"))


def _label_rows(fx: Fixture) -> DataFrame:
    """Rows of labels, and empty tiles (class_id null) of the sample."""
    images = tiles.with_split(fx.images.join(fx.files.select("file_id", N.basename("path").alias("coco_file")), "file_id"))
    boxes = fx.annotations.join(images.select(*SHEET, "width", "height", "file_name", "split"), SHEET)
    shown = tiles.yolo_labels(tiles.assign(boxes))
    name = N.tile_name(N.stem("file_name"), "t_idx", "x0", "y0").alias("tile_name")
    full = shown.select("split", name, *KEYS, F.col("category_id").alias("class_id"), "xc", "yc", F.col("yw").alias("w"), F.col("yh").alias("h"))
    grid = tiles.grid(images, keep=[*SHEET, "file_name", "split", "sheet_key"])
    return full.unionByName(tiles.sampled_empty(tiles.empty_tiles(grid, shown)).select("split", name), allowMissingColumns=True)


@query
def label_text(fx: Fixture) -> DataFrame:
    return sinks.label_lines(_label_rows(fx), KEYS)


@query
def label_files_read(fx: Fixture) -> DataFrame:
    root = scratch.folder(fx.spark, "labels")
    sinks.label_files(sinks.label_lines(_label_rows(fx), KEYS), root)
    return coco.label_files(fx.spark, root)


def _sheets(fx: Fixture) -> tuple[DataFrame, DataFrame]:
    """Records of the stitched sheets, and their counts by class."""
    kept, classes = _placed(fx), _label_classes(fx)
    counts = stitch.sheet_class_counts(kept, classes, SHEET)
    ident = N.sheet_id(N.stem("file_name"), N.page_or_first("page")).alias("sheet_id")
    sheets = fx.images.join(fx.files.select("file_id", N.basename("path").alias("source")), "file_id").select(*SHEET, ident, "source", N.page_or_first("page").alias("page"), "width", "height", F.lit(150).alias("dpi"))
    records = stitch.sheet_records(stitch.object_records(kept, classes, SHEET, [stitch.PLACE]), counts, sheets, SHEET)
    return records, counts.join(sheets.select(*SHEET, "sheet_id", "source"), SHEET)


@query
def predict_records(fx: Fixture) -> DataFrame:
    out = scratch.folder(fx.spark, "records")
    sinks.records(_sheets(fx)[0].select("sheet_id", "source", "page", "width", "height", "dpi", "scale", "counts", "objects"), out, "gzip")
    kinds = "sheet_id string, source string, page int, width int, height int, dpi int, scale double, counts map<string,int>, objects array<struct<id:string,type:string,geometry:struct<kind:string,coords:array<double>>,confidence:double>>"
    counted = F.array_join(F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ";")
    number = lambda v, by: F.round(v * by).cast("long").cast("string")
    shown = lambda o: F.concat_ws(" ", o["id"], o["type"], o["geometry"]["kind"], F.array_join(F.transform(o["geometry"]["coords"], lambda v: number(v, 100)), ","), number(o["confidence"], 10_000))
    records = fx.spark.read.schema(kinds).json(out)
    return records.select("sheet_id", "source", "page", "width", "height", "dpi", F.col("scale").isNull().alias("unscaled"), counted.alias("counts"), F.array_join(F.transform("objects", shown), ";").alias("objects"))


@query
def csv_counts_summary(fx: Fixture) -> DataFrame:
    out = scratch.folder(fx.spark, "counts")
    sinks.counts_summary(_sheets(fx)[1].select("source", "sheet_id", F.col("name").alias("class"), F.col("n").alias("count")), out)
    return fx.spark.read.csv(out, header=True, schema="sheet_id string, class string, count int, source string")


@query
def csv_count_accuracy(fx: Fixture) -> DataFrame:
    data = _dataset(fx)
    classes = resolve.class_map(data.categories)
    resolved = jobs._resolved(data)
    predicted = resolved.where("ann_seq % 7 <> 0").groupBy(*SHEET, "name").agg(F.count("*").alias("n"))
    out = scratch.folder(fx.spark, "accuracy")
    jobs.count_scores(data, predicted, classes, out)
    return fx.spark.read.csv(f"{out}/count_accuracy.csv", header=True, schema="discipline string, coco_file string, image_id long, class string, gt long, pred long, abs_err long")


@query
def accuracy_listing(fx: Fixture) -> DataFrame:
    by = [*SHEET, "name"]
    named = fx.annotations.join(_label_classes(fx), F.col("category_id") == F.col("class_id"))
    truth, found = (df.groupBy(*by).agg(F.count("*").alias("n")) for df in (named, named.where("l_partkey % 13 <> 0")))
    return accuracy.listing(accuracy.count_accuracy(accuracy.count_errors(truth, found, by)))


@query
def mean_average_precision(fx: Fixture) -> DataFrame:
    c = F.col
    truth = fx.annotations.select(*SHEET, c("category_id").alias("label"), *KEYS, c("x").alias("x1"), c("y").alias("y1"), (c("x") + c("w")).alias("x2"), (c("y") + c("h")).alias("y2"))
    moved = _predicted(fx).withColumns({k: c(k) + c("l_partkey") % 9 for k in ("x1", "x2")})
    scored = accuracy.mean_average_precision(moved, truth, SHEET, [*KEYS, "t_idx"], KEYS)
    return scored.withColumns({k: F.round(k, 6) for k in ("ap50", "ap50_95")})


@query
def greedy_matches(fx: Fixture) -> DataFrame:
    c = F.col
    truth = fx.annotations.select(*SHEET, c("category_id").alias("label"), *KEYS, c("x").alias("x1"), c("y").alias("y1"), (c("x") + c("w")).alias("x2"), (c("y") + c("h")).alias("y2"))
    hits = accuracy.greedy_matches(_detections(fx), truth, SHEET, [*KEYS, "t_idx"], KEYS, [0.5, 0.75])
    return hits.groupBy("label", "threshold").agg(F.count("*").alias("n"))
