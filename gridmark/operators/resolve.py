"""Lookups: annotations to images, categories and classes; images to source PDFs.

Category and image ids are local to a file, so every lookup carries ``file_id``; classes are merged by name.  The
dimension tables (images, categories, classes) are small next to annotations and Spark broadcasts them when their
size allows; nothing forces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names as N


def last_wins(df: DataFrame, keys: list[str], position: Column | str) -> DataFrame:
    """One row a key: the one with the largest position."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), N.col(position)).alias("_row"))
    return best.select(*keys, "_row.*")


def annotations_resolved(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations whose image and category both exist and have a name; adds the image's columns and ``name``."""
    extra = [c for c in images.columns if c not in ("file_id", "image_id") and c not in annotations.columns]
    return annotations.join(images.select("file_id", "image_id", *extra), ["file_id", "image_id"]).join(categories.where("name IS NOT NULL").select("file_id", "category_id", "name"), ["file_id", "category_id"])


def annotations_orphaned(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """Annotations without an image, or without a named category, and which of the two is missing."""
    image = images.select("file_id", "image_id", F.lit(True).alias("_image"))
    category = categories.where("name IS NOT NULL").select("file_id", "category_id", F.lit(True).alias("_category"))
    joined = annotations.join(image, ["file_id", "image_id"], "left").join(category, ["file_id", "category_id"], "left")
    missing = F.when(F.col("_image").isNull(), "image").when(F.col("_category").isNull(), "category")
    return joined.withColumn("missing", missing).where("missing IS NOT NULL").drop("_image", "_category")


def object_files(files: DataFrame, categories: DataFrame, single: str = "duct_segment") -> DataFrame:
    """Files that hold object annotations: no overlay by name, some category names, and not ``single`` alone."""
    named = categories.where("name IS NOT NULL").groupBy("file_id").agg(F.collect_set("name").alias("_names"))
    kept = files.where(~N.is_overlay("path")).join(named, "file_id")
    return kept.where(F.size(F.array_except("_names", F.array(F.lit(single)))) > 0).drop("_names")


def in_discipline(df: DataFrame, mode: str | None, column: str = "discipline") -> DataFrame:
    """Rows of a discipline; all for ``combined``, empty or None."""
    return df if mode in (None, "", "combined") else df.where(F.col(column) == mode)


def class_map(resolved_names: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(name, class_id): distinct names numbered from 0 in code point order, apart for each value of ``by``.  The
    window runs over distinct names only."""
    by = by or []
    order = Window.partitionBy(*by).orderBy("name") if by else Window.orderBy("name")
    return resolved_names.select(*by, "name").where("name IS NOT NULL").distinct().withColumn("class_id", F.row_number().over(order) - 1)


def with_class(resolved: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows whose name is in the class map, with its id."""
    return resolved.join(classes.select("name", "class_id"), "name")


def label_name(detections: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """``type``: the label's class name, or the label as text; ``known``: whether it has one."""
    named = classes.select(F.col("class_id").alias("_id"), F.col("name").alias("_name"))
    joined = detections.join(named, F.col(label) == F.col("_id"), "left")
    return joined.withColumns({"type": F.coalesce("_name", F.col(label).cast("string")), "known": F.col("_id").isNotNull()}).drop("_id", "_name")


def source_pdf(images: DataFrame, pdfs: DataFrame) -> DataFrame:
    """Images with ``pdf_path`` of their folder and ``page``: none without a candidate, the only one, or of several
    the first (by path) whose stem is part of the image's, else the first.  Overlays are no candidates.

    The parts of an image's stem that are as long as a stem among its folder's PDFs meet those stems by equality, so the
    work follows the names' lengths and not images times PDFs; of a folder only the lengths of its stems are one row."""
    clean = pdfs.where(~N.is_overlay("pdf_path", ".pdf")).select("folder", "pdf_path", N.stem(N.basename("pdf_path")).alias("_part"))
    by_stem = clean.groupBy("folder", "_part").agg(F.min("pdf_path").alias("_named"))
    folders = clean.groupBy("folder").agg(F.min("pdf_path").alias("_first"), F.collect_set(F.length("_part")).alias("_lengths"))
    stem = N.stem("file_name")
    several = images.where("file_name IS NOT NULL").select("folder", "file_name").distinct().join(folders.select("folder", "_lengths"), "folder")
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length(stem) - n + 1), lambda k: F.substring(stem, k, n))
    fitting = F.filter("_lengths", lambda n: n <= F.length(stem))
    parts = several.select("folder", "file_name", F.explode(F.array_distinct(F.flatten(F.transform(fitting, cut)))).alias("_part"))
    named = parts.join(by_stem, ["folder", "_part"]).groupBy("folder", "file_name").agg(F.min("_named").alias("_named"))
    chosen = F.coalesce("_named", "_first").alias("pdf_path")
    joined = images.join(named, ["folder", "file_name"], "left").join(folders.select("folder", "_first"), "folder", "left")
    return joined.select(*[c for c in images.columns if c != "page"], chosen, N.page_or_first("page").alias("page"))
