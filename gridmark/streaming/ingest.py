"""Continuous ingest: class counts of annotation documents as they arrive in a folder.

A document is one row, so names are looked up within the row and no stream is joined; the only state is one counter
a class.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..sources.coco import parsed


def documents(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of (path, content)."""
    stream = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return stream.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).where(~N.is_overlay("path"))


def class_counts(docs: DataFrame) -> DataFrame:
    """Instances per (discipline, class) of the resolvable annotations so far; for output mode update or complete."""
    good = parsed(docs).where("reason IS NULL").select(N.discipline("path").alias("discipline"), "doc")
    last = lambda items, key, value: F.element_at(F.filter(items, lambda i: i[key] == value), -1)
    seen = lambda items, value: F.exists(items, lambda i: i["id"] == value)
    usable = F.filter("doc.annotations", lambda a: seen(F.col("doc.images"), a["image_id"]) & seen(F.col("doc.categories"), a["category_id"]))
    names = F.transform(usable, lambda a: last(F.col("doc.categories"), "id", a["category_id"])["name"])
    return good.select("discipline", F.explode(names).alias("name")).where("name IS NOT NULL").groupBy("discipline", "name").agg(F.count("*").alias("n"))
