"""Box geometry as column expressions.  Boxes are (x, y, w, h) from the top left, or corners (x1, y1, x2, y2)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-6


def step(tile: int, overlap: float) -> int:
    """Distance between tiles: tile * (1 - overlap), half to even, at least 1."""
    return max(1, round(tile * (1 - overlap)))


def last_start(length: Column, tile: int) -> Column:
    return F.greatest(F.lit(0), length - tile)


def n_starts(length: Column, tile: int, overlap: float) -> Column:
    """How many tiles cover a side."""
    return (F.ceil(last_start(length, tile) / step(tile, overlap)) + 1).cast("int")


def start(index: Column, length: Column, tile: int, overlap: float) -> Column:
    """Where tile ``index`` of a side begins; the last one is moved inward to end with the side."""
    return F.least(index * step(tile, overlap), last_start(length, tile))


def indices(length: Column, tile: int, overlap: float) -> Column:
    return F.sequence(F.lit(0), n_starts(length, tile, overlap) - 1)


def touching(low: Column, high: Column, length: Column, tile: int, overlap: float) -> Column:
    """Numbers of the tiles that may meet the open interval (low, high); computed, not searched."""
    s, most = step(tile, overlap), n_starts(length, tile, overlap) - 1
    first = F.least(F.greatest(F.lit(0), F.floor((low - tile) / s).cast("int")), most)
    end = F.when(high > last_start(length, tile), most).otherwise(F.greatest(first, F.floor(high / s).cast("int")))
    return F.sequence(first, end)


def starts(length: Column, tile: int, overlap: float) -> Column:
    """Sorted starts of the tiles that cover a side."""
    return F.transform(indices(length, tile, overlap), lambda i: start(i, length, tile, overlap))


def touching_starts(low: Column, high: Column, length: Column, tile: int, overlap: float) -> Column:
    """Starts of the tiles that may meet the open interval (low, high)."""
    return F.transform(touching(low, high, length, tile, overlap), lambda i: start(i, length, tile, overlap))


def start_list(length: int, tile: int, overlap: float) -> list[int]:
    """``start`` of every tile, for code inside workers."""
    last = max(0, length - tile)
    return [min(k, last) for k in range(0, last + step(tile, overlap), step(tile, overlap))]


def overlap_sides(x: Column, y: Column, w: Column, h: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column, Column, Column]:
    """Corners of the part of a box inside a tile, in sheet coordinates."""
    return F.greatest(x, x0), F.greatest(y, y0), F.least(x + w, x1), F.least(y + h, y1)


def visible(x: Column, y: Column, w: Column, h: Column, x0: Column, y0: Column, x1: Column, y1: Column, least: float = 0.3) -> Column:
    """Whether a box meets a tile with at least this share of its area."""
    a, b, c, d = overlap_sides(x, y, w, h, x0, y0, x1, y1)
    return (c > a) & (d > b) & ((c - a) * (d - b) / F.greatest(F.lit(TINY), w * h) >= least)


def to_yolo(x: Column, y: Column, w: Column, h: Column, tile_w: Column, tile_h: Column) -> tuple[Column, Column, Column, Column]:
    """Centre and size as shares of the tile."""
    return (x + w / 2.0) / tile_w, (y + h / 2.0) / tile_h, w / tile_w, h / tile_h


def from_yolo(xc: Column, yc: Column, w: Column, h: Column, x0: Column, y0: Column, tile_w: Column, tile_h: Column) -> tuple[Column, Column, Column, Column]:
    """Corners in sheet coordinates."""
    bw, bh, cx, cy = w * tile_w, h * tile_h, xc * tile_w, yc * tile_h
    return x0 + cx - bw / 2.0, y0 + cy - bh / 2.0, x0 + cx + bw / 2.0, y0 + cy + bh / 2.0


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two struct columns with x1, y1, x2, y2."""
    inter = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])) * F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda q: F.greatest(F.lit(0), q["x2"] - q["x1"]) * F.greatest(F.lit(0), q["y2"] - q["y1"])
    return inter / F.greatest(area(a) + area(b) - inter, F.lit(TINY))


def iou_arrays(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """``iou`` of two lists of corners x1, y1, x2, y2, for code inside workers: the same steps, NaN larger than all else."""
    with np.errstate(all="ignore"):
        wide, high = (np.maximum(0.0, np.fmin(a[k + 2], b[k + 2]) - np.maximum(a[k], b[k])) for k in (0, 1))
        inter = wide * high
        one, two = (np.maximum(0.0, q[2] - q[0]) * np.maximum(0.0, q[3] - q[1]) for q in (a, b))
        return inter / np.maximum(one + two - inter, TINY)
