"""Tiles of a sheet, boxes on tiles, and label rows.

The spatial join makes candidates by arithmetic: a box can only meet tiles whose start lies in a computed interval, so
every box is exploded to the few tiles around it and verified; there is no range join.  A tile's number follows from
its column and row, because tiles are numbered by (x0, y0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import names as N
from ..functions import splits as S

TILE, OVERLAP, LEAST_VISIBLE = 1280, 0.2, 0.3


def grid(images: DataFrame, tile: int = TILE, overlap: float = OVERLAP, keep: list[str] | None = None) -> DataFrame:
    """Every tile of every sheet: t_idx, x0, y0, x1, y1, numbered column by column from 0."""
    keep = keep or ["file_id", "image_id"]
    wide = images.select(*keep, "width", "height", F.explode(G.indices(F.col("width"), tile, overlap)).alias("_i"))
    deep = wide.select(*keep, "width", "height", "_i", F.explode(G.indices(F.col("height"), tile, overlap)).alias("_j"))
    x0, y0 = G.start(F.col("_i"), F.col("width"), tile, overlap), G.start(F.col("_j"), F.col("height"), tile, overlap)
    number = F.col("_i") * G.n_starts(F.col("height"), tile, overlap) + F.col("_j")
    return deep.select(*keep, number.alias("t_idx"), x0.alias("x0"), y0.alias("y0"), F.least(x0 + tile, "width").alias("x1"), F.least(y0 + tile, "height").alias("y1"))


def batches(tiles: DataFrame, size: int = 16) -> DataFrame:
    """Tiles of a sheet in runs of ``size`` by number: batch, first and last tile, n."""
    return tiles.groupBy("file_id", "image_id", F.floor(F.col("t_idx") / size).cast("int").alias("batch")).agg(F.min("t_idx").alias("first_tile"), F.max("t_idx").alias("last_tile"), F.count("*").alias("n"))


def assign(boxes: DataFrame, tile: int = TILE, overlap: float = OVERLAP, least: float = LEAST_VISIBLE) -> DataFrame:
    """Boxes on each tile that shows at least ``least`` of them: ``boxes`` (x, y, w, h, width, height, other columns)
    with t_idx, x0, y0, x1, y1 and the clipped box in tile coordinates cx, cy, cw, ch.  A box may be on several."""
    c = F.col
    wide = boxes.withColumn("_i", F.explode(G.touching(c("x"), c("x") + c("w"), c("width"), tile, overlap))).withColumn("x0", G.start(c("_i"), c("width"), tile, overlap))
    wide = wide.withColumn("x1", F.least(c("x0") + tile, c("width"))).where((c("x") < c("x1")) & (c("x") + c("w") > c("x0")))
    near = wide.withColumn("_j", F.explode(G.touching(c("y"), c("y") + c("h"), c("height"), tile, overlap))).withColumn("y0", G.start(c("_j"), c("height"), tile, overlap))
    near = near.withColumn("y1", F.least(c("y0") + tile, c("height")))
    sides = [c(k) for k in ("x", "y", "w", "h", "x0", "y0", "x1", "y1")]
    shown = near.where(G.visible(*sides, least=least))
    a, b, d, e = G.overlap_sides(*sides)
    number = c("_i") * G.n_starts(c("height"), tile, overlap) + c("_j")
    return shown.withColumns({"t_idx": number, "cx": a - c("x0"), "cy": b - c("y0"), "cw": d - a, "ch": e - b}).drop("_i", "_j")


def yolo_labels(assigned: DataFrame) -> DataFrame:
    """``assigned`` with centre and size as shares of the tile: xc, yc, yw, yh."""
    c = F.col
    names = ("xc", "yc", "yw", "yh")
    return assigned.withColumns(dict(zip(names, G.to_yolo(c("cx"), c("cy"), c("cw"), c("ch"), c("x1") - c("x0"), c("y1") - c("y0")), strict=True)))


def back_on_sheet(labels: DataFrame) -> DataFrame:
    """Corners on the sheet of label rows: bx1, by1, bx2, by2."""
    c = F.col
    corners = G.from_yolo(c("xc"), c("yc"), c("yw"), c("yh"), c("x0"), c("y0"), c("x1") - c("x0"), c("y1") - c("y0"))
    return labels.withColumns(dict(zip(("bx1", "by1", "bx2", "by2"), corners, strict=True)))


def offset(detections: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile detections (x1, y1, x2, y2 in tile coordinates) moved to the sheet.  Tiles are sorted for the join: Spark takes them
    for as few as the sheets that they are exploded from, and would broadcast them."""
    origin = tiles.select("file_id", "image_id", "t_idx", F.col("x0").alias("_x0"), F.col("y0").alias("_y0")).hint("merge")
    joined = detections.join(origin, ["file_id", "image_id", "t_idx"])
    return joined.withColumns({k: F.col(k) + F.col("_x0" if k[0] == "x" else "_y0") for k in ("x1", "y1", "x2", "y2")}).drop("_x0", "_y0")


def with_split(images: DataFrame, val_frac: float = 0.2) -> DataFrame:
    """Images with sheet_key (file name # image id) and split."""
    keyed = images.withColumn("sheet_key", N.sheet_key("coco_file", "image_id"))
    return keyed.withColumn("split", S.split_of("sheet_key", val_frac))


def empty_tiles(tiles: DataFrame, assigned: DataFrame) -> DataFrame:
    """Tiles without a box."""
    return tiles.join(assigned.select("file_id", "image_id", "t_idx").distinct(), ["file_id", "image_id", "t_idx"], "left_anti")


def sampled_empty(empty: DataFrame, frac: float = 0.1, seed: int = 0) -> DataFrame:
    """About ``frac`` of the empty tiles, by hash of sheet key, tile number and seed."""
    return empty.where(S.sampled(F.concat_ws("#", "sheet_key", F.col("t_idx").cast("string")), frac, seed))


def split_stats(assigned: DataFrame) -> DataFrame:
    """Tiles with a box, and boxes, per split."""
    per_tile = assigned.groupBy("split", "file_id", "image_id", "t_idx").agg(F.count("*").alias("n"))
    return per_tile.groupBy("split").agg(F.count("*").alias("num_tiles"), F.sum("n").alias("num_boxes"))
