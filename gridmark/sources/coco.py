"""Annotation documents (COCO JSON) as tables.

Documents of up to ``WHOLE`` bytes are read whole, one row a file; larger ones are split between tasks (``split_json``), so
a document of any size is read.  Overlay files, and files that a caller's condition on their path excludes, are dropped
while files are listed and never opened.  What isn't a JSON object with an ``annotations`` key goes to quarantine instead
of failing the job.  A file's path is its id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import names as N
from ..operators import resolve
from . import named_files, scratch, split_json

#: Bytes up to which a document is one row.
WHOLE = 32 << 20
ITEMS = {"images": schema.IMAGE, "categories": schema.CATEGORY, "annotations": schema.ANNOTATION}


@dataclass(frozen=True)
class Dataset:
    """files (file_id, path, coco_file, folder, discipline), images, categories, annotations, and quarantine (path,
    reason)."""

    files: DataFrame
    images: DataFrame
    categories: DataFrame
    annotations: DataFrame
    quarantine: DataFrame


def plain(path: Column) -> Column:
    """A path as users write it: decoded, local ones without a scheme."""
    return F.url_decode(F.replace(F.regexp_replace(path, "^file:/+", "/"), F.lit("+"), F.lit("%2B")))


def _wanted(only: Callable[[Column], Column] | None) -> Column:
    path = plain(F.col("_metadata.file_path"))
    return ~N.is_overlay(path) if only is None else ~N.is_overlay(path) & only(path)


def documents(spark: SparkSession, root: str, split: str = "training", only: Callable[[Column], Column] | None = None, most_bytes: int | None = None) -> DataFrame:
    """(path, content) of every ``*.json`` below <root>/<split> that is no overlay, fulfils ``only`` (a condition on its
    path) and has ``most_bytes`` at most."""
    found = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(f"{root.rstrip('/')}/{split}").where(_wanted(only))
    kept = found if most_bytes is None else found.where(F.col("_metadata.file_size") <= most_bytes)
    return kept.select(plain(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("content"))


def parsed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``doc`` (null where unusable) and ``reason`` (null where usable)."""
    keys = F.json_object_keys("content")
    reason = F.when(keys.isNull(), "no JSON object").when(~F.array_contains(keys, "annotations"), "no annotations")
    return docs.withColumn("reason", reason).withColumn("doc", F.when(F.col("reason").isNull(), F.from_json("content", schema.DOCUMENT)))


def _row_tables(rows: DataFrame) -> list[DataFrame]:
    """Images, categories and annotations (file_id, seq, item) of parsed documents."""
    good = rows.where("reason IS NULL")
    return [good.select(F.col("path").alias("file_id"), F.posexplode(f"doc.{name}").alias("seq", "item")).withColumn("seq", F.col("seq").cast("long")) for name in ITEMS]


def _split_tables(spark: SparkSession, root: str, split: str, only: Callable[[Column], Column] | None, least_bytes: int) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """The same of documents of more than ``least_bytes``; (path) of the usable ones, and (path, reason) of the others."""
    lines = split_json.records(spark, f"{root.rstrip('/')}/{split}", "*.json", least_bytes, _wanted(only))
    found, told = split_json.elements(lines, list(ITEMS))
    reason = F.when(~F.col("is_object"), "no JSON object").when(~F.array_contains("keys", "annotations"), "no annotations")
    judged = scratch.written(told.select(plain(F.col("path")).alias("path"), reason.alias("reason")), "judged")
    good = judged.where("reason IS NULL").select("path")
    items = scratch.written(found.withColumn("path", plain(F.col("path"))).join(good, "path", "left_semi"), "elements")
    tables = [items.where(F.col("name") == name).select(F.col("path").alias("file_id"), F.col("place").alias("seq"), F.from_json("body", kind).alias("item")) for name, kind in ITEMS.items()]
    return tables, good, judged.where("reason IS NOT NULL")


def load(spark: SparkSession, root: str, split: str = "training", only: Callable[[Column], Column] | None = None, whole: int = WHOLE, single: str = "duct_segment") -> Dataset:
    """The tables of the documents below <root>/<split>, whatever their size."""
    small = documents(spark, root, split, only, whole)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(f"{root.rstrip('/')}/{split}").where(_wanted(only))
    if listed.where(F.col("length") > whole).select("length").isEmpty():
        return dataset(small, single)
    tables, good, bad = _split_tables(spark, root, split, only, whole)
    return dataset(small, single, (tables, good, bad))


def dataset(docs: DataFrame, single: str = "duct_segment", large: tuple[list[DataFrame], DataFrame, DataFrame] | None = None) -> Dataset:
    """The tables of the usable documents that hold object annotations, of ``large`` ones too (``load``).  JSON is parsed
    once, into a scratch table.

    Of images or categories that repeat an id within a file, the last one counts.
    """
    rows = scratch.written(parsed(docs).drop("content"), "documents")
    tables, good, bad = _row_tables(rows), rows.where("reason IS NULL").select("path"), rows.where("reason IS NOT NULL").select("path", "reason")
    if large:
        tables, good, bad = [a.unionByName(b) for a, b in zip(tables, large[0], strict=True)], good.unionByName(large[1]), bad.unionByName(large[2])
    listed, named, boxes = tables
    objects = named.where(F.col("item.name") != single).select(F.col("file_id").alias("path")).distinct()
    kept = good.join(objects, "path", "left_semi")
    files = kept.select(F.col("path").alias("file_id"), "path", N.basename("path").alias("coco_file"), N.folder("path").alias("folder"), N.discipline("path").alias("discipline"))
    of_objects = lambda t: t.join(objects.withColumnRenamed("path", "file_id"), "file_id", "left_semi")
    images = of_objects(listed).select("file_id", F.col("item.id").alias("image_id"), F.col("seq").alias("img_seq"), "item.file_name", "item.width", "item.height", "item.page")
    categories = of_objects(named).select("file_id", F.col("item.id").alias("category_id"), "seq", "item.name")
    side = lambda k, name: F.get("item.bbox", F.lit(k)).alias(name)
    annotations = of_objects(boxes).select("file_id", F.col("seq").alias("ann_seq"), "item.image_id", "item.category_id", side(0, "x"), side(1, "y"), side(2, "w"), side(3, "h"))
    return Dataset(
        files,
        resolve.last_wins(images, ["file_id", "image_id"], "img_seq"),
        resolve.last_wins(categories, ["file_id", "category_id"], "seq").drop("seq"),
        annotations,
        bad,
    )


def pdfs(spark: SparkSession, root: str, split: str = "training") -> DataFrame:
    """(folder, pdf_path) of every PDF below <root>/<split>; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(f"{root.rstrip('/')}/{split}".rstrip("/"))
    path = plain(F.col("path"))
    return found.select(N.folder(path).alias("folder"), path.alias("pdf_path"))


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, class_id) of a class map file: its ``names`` in order, else its ``name_to_id``."""
    doc = spark.read.schema(schema.CLASS_MAP).json(path, multiLine=True)
    listed = doc.select(F.posexplode("names").alias("class_id", "name")).select("name", "class_id")
    mapped = doc.where("names IS NULL").select(F.explode("name_to_id").alias("name", "class_id"))
    return listed.unionByName(mapped)


def label_files(spark: SparkSession, path: str) -> DataFrame:
    """(tile_name, class_id, xc, yc, w, h) of YOLO label files below a folder.  There is a file a tile, so tasks list and open
    them."""
    lines = named_files.lines(spark, path, ".txt")
    parts = F.split(F.trim("value"), " +")
    name = N.stem(N.basename("path"))
    number = lambda k, out: F.get(parts, F.lit(k)).cast("double").alias(out)
    return lines.where(F.trim("value") != "").select(name.alias("tile_name"), F.get(parts, F.lit(0)).cast("int").alias("class_id"), number(1, "xc"), number(2, "yc"), number(3, "w"), number(4, "h"))
