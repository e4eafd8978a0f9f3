"""Raster adapters: pages rendered, tiles cut and written, detectors run, inside Arrow batches.

A renderer and a detector are plain callables that a caller injects; heavy libraries are imported by the workers that
need them.  Failures become an ``error`` column instead of a failed job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.geometry import start_list


class Renderer(Protocol):
    def pages(self, pdf_path: str) -> int: ...

    def __call__(self, pdf_path: str, page: int, dpi: int, size: tuple[int, int] | None) -> np.ndarray: ...


#: Takes tiles of one batch, returns for each of them rows (label, score, x1, y1, x2, y2) in tile coordinates.
Detector = Callable[[list[np.ndarray]], list[list[tuple[int, float, float, float, float, float]]]]


class FitzRenderer:
    """Pages by PyMuPDF: zoom dpi / 72, grey and alpha turned to RGB, resized (bilinear) to a recorded size."""

    def pages(self, pdf_path: str) -> int:
        import fitz

        with fitz.open(pdf_path) as doc:
            return doc.page_count

    def __call__(self, pdf_path: str, page: int, dpi: int, size: tuple[int, int] | None) -> np.ndarray:
        import fitz

        with fitz.open(pdf_path) as doc:
            if not 1 <= page <= doc.page_count:
                raise ValueError(f"page {page} of {doc.page_count}")
            zoom = dpi / 72
            pix = doc[page - 1].get_pixmap(matrix=fitz.Matrix(zoom, zoom), alpha=False)
            image = np.frombuffer(pix.samples, np.uint8).reshape(pix.height, pix.width, pix.n)
        image = np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image[:, :, :3]
        if size and (image.shape[1], image.shape[0]) != size:
            from PIL import Image

            image = np.asarray(Image.fromarray(np.ascontiguousarray(image)).resize(size, Image.BILINEAR))
        return image


class YoloDetector:
    """A trained detector's weights; the model is loaded once a worker."""

    def __init__(self, weights: str, conf: float = 0.25):
        self.weights, self.conf, self._model = weights, conf, None

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "conf": self.conf, "_model": None}

    def __call__(self, tiles: list[np.ndarray]) -> list[list[tuple[int, float, float, float, float, float]]]:
        if self._model is None:
            from ultralytics import YOLO

            self._model = YOLO(self.weights)
        found = self._model.predict([t[:, :, ::-1] for t in tiles], conf=self.conf, verbose=False)
        return [[(int(c), float(s), *map(float, b)) for c, s, b in zip(r.boxes.cls, r.boxes.conf, r.boxes.xyxy, strict=True)] for r in found]


def page_list(pdfs: DataFrame, renderer: Renderer, pages: list[int] | None = None) -> DataFrame:
    """(pdf_path, page) of every page, or of ``pages`` only (none given: all)."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"pdf_path": frame["pdf_path"], "n": [renderer.pages(p) for p in frame["pdf_path"]]})

    listed = pdfs.select("pdf_path").mapInPandas(counted, "pdf_path string, n int").where("n > 0").select("pdf_path", F.explode(F.sequence(F.lit(1), "n")).alias("page"))
    return listed.where(F.col("page").isin(pages)) if pages else listed


def rendered(pages: DataFrame, renderer: Renderer, dpi: int = 150) -> DataFrame:
    """Rasters of (pdf_path, page, width, height); a size of 0 or null leaves the rendered one.  Repeated pages are
    rendered once."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                image, error = _drawn(renderer, r, dpi)
                row = [r.pdf_path, r.page, 0, 0, 0, b"", error] if image is None else [r.pdf_path, r.page, image.shape[1], image.shape[0], image.shape[2], image.tobytes(), None]
                yield pd.DataFrame([row], columns=["pdf_path", "page", "width", "height", "channels", "pixels", "error"])

    sized = pages.select("pdf_path", "page", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"))
    return sized.distinct().mapInPandas(draw, schema.RASTERS)


def png(image: np.ndarray) -> bytes:
    """A grey or RGB image as PNG."""
    h, w = image.shape[:2]
    lines = np.zeros((h, 1 + image[0].size), np.uint8)
    lines[:, 1:] = image.reshape(h, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 4)) + chunk(b"IEND", b"")


def _drawn(renderer: Renderer, r, dpi: int) -> tuple[np.ndarray | None, str | None]:
    """The page's raster, or what it raised."""
    try:
        size = (int(r.width), int(r.height)) if r.width and r.height else None
        return np.ascontiguousarray(renderer(r.pdf_path, int(r.page), dpi, size), np.uint8), None
    except Exception as e:  # what a page raises is the page's result
        return None, f"{type(e).__name__}: {e}"


def tile_images(pages: DataFrame, renderer: Renderer, dpi: int = 150) -> DataFrame:
    """(pdf_path, page, tile_name, image as PNG, error) of the wanted tiles of pages (pdf_path, page, width, height,
    tiles: array of tile_name, x0, y0, x1, y1).  A page is rendered and cut in one task, so no pixels are moved; a page
    that can't be rendered gives one row with its error."""
    columns = ["pdf_path", "page", "tile_name", "image", "error"]

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                image, error = _drawn(renderer, r, dpi)
                if image is None:
                    yield pd.DataFrame([(r.pdf_path, r.page, None, None, error)], columns=columns)
                    continue
                for t in r.tiles:
                    yield pd.DataFrame([(r.pdf_path, r.page, t["tile_name"], png(image[t["y0"] : t["y1"], t["x0"] : t["x1"]]), None)], columns=columns)

    return pages.select("pdf_path", "page", "width", "height", "tiles").mapInPandas(cut, "pdf_path string, page int, tile_name string, image binary, error string")


def page_sizes(pages: DataFrame, renderer: Renderer, dpi: int = 150) -> DataFrame:
    """``pages`` (pdf_path, page, width, height) with the rendered size where none is recorded: only those pages are
    rendered for it.  What can't be rendered has size 0."""

    def sized(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                image, _ = _drawn(renderer, r, dpi)
                rows.append((r.pdf_path, r.page, 0 if image is None else image.shape[1], 0 if image is None else image.shape[0]))
            yield pd.DataFrame(rows, columns=["pdf_path", "page", "width", "height"])

    known = (F.col("width") > 0) & (F.col("height") > 0)
    keys = pages.select("pdf_path", "page", "width", "height").distinct()
    return keys.where(known).unionByName(keys.where(~F.coalesce(known, F.lit(False))).mapInPandas(sized, "pdf_path string, page int, width int, height int"))


def page_detections(pages: DataFrame, renderer: Renderer, detector: Detector, tile: int = 1280, overlap: float = 0.2, dpi: int = 150, batch: int = 16) -> DataFrame:
    """Every page (pdf_path, page, width, height) rendered, tiled and detected in one task: one row a page with its
    rendered size (label null) or its error, and one row a detection in tile coordinates with its tile's number and
    origin."""
    columns = ["pdf_path", "page", "width", "height", "t_idx", "x0", "y0", "label", "score", "x1", "y1", "x2", "y2", "error"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                image, error = _drawn(renderer, r, dpi)
                high, wide = (0, 0) if image is None else image.shape[:2]
                rows = [(r.pdf_path, r.page, wide, high, *[None] * 9, error)]
                places = [] if image is None else [(x, y) for x in start_list(wide, tile, overlap) for y in start_list(high, tile, overlap)]
                for a in range(0, len(places), batch):
                    found = detector([image[y : y + tile, x : x + tile] for x, y in places[a : a + batch]])
                    rows += [(r.pdf_path, r.page, wide, high, a + k, *places[a + k], *box, None) for k, boxes in enumerate(found) for box in boxes]
                out = pd.DataFrame(rows, columns=columns)
                yield out.astype({c: "Int64" for c in ("t_idx", "x0", "y0", "label")} | {c: "float64" for c in ("score", "x1", "y1", "x2", "y2")})

    kinds = "pdf_path string, page int, width int, height int, t_idx int, x0 int, y0 int, label int, score double, x1 double, y1 double, x2 double, y2 double, error string"
    return pages.select("pdf_path", "page", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height")).distinct().mapInPandas(run, kinds)


#: Colours of classes, red, green, blue, by class number modulo 22.
PALETTE = (
    (230, 25, 75), (60, 180, 75), (0, 130, 200), (245, 130, 48), (145, 30, 180), (70, 240, 240), (240, 50, 230), (210, 245, 60),
    (250, 190, 190), (0, 128, 128), (170, 110, 40), (128, 0, 0), (170, 255, 195), (128, 128, 0), (255, 215, 180), (0, 0, 128),
    (128, 128, 128), (255, 225, 25), (0, 200, 200), (100, 100, 255), (200, 100, 0), (0, 160, 90),
)


def outlined(image: np.ndarray, boxes: list[tuple[int, float, float, float, float]], width: int = 3) -> np.ndarray:
    """A copy of an RGB image with the outlines of (label, x1, y1, x2, y2) in their class's colour, clipped to it."""
    out = image.copy()
    high, wide = out.shape[:2]
    for label, *corners in boxes:
        x1, y1, x2, y2 = (round(c) for c in corners)
        for a, b, c, d in ((x1, y1, x2, y1 + width), (x1, y2 - width, x2, y2), (x1, y1, x1 + width, y2), (x2 - width, y1, x2, y2)):
            out[max(b, 0) : max(min(d, high), 0), max(a, 0) : max(min(c, wide), 0)] = PALETTE[label % len(PALETTE)]
    return out


#: Lit segments of the digits 0 to 9 on a seven-segment display, a at the top, clockwise, g in the middle.
SEGMENTS = "abcdef bc abged abgcd fgbc afgcd afgedc abc abcdefg abcdfg".split()
_SEGMENT_BOX = {"a": (0, 0, 4, 1), "b": (3, 0, 4, 4), "c": (3, 3, 4, 7), "d": (0, 6, 4, 7), "e": (0, 3, 1, 7), "f": (0, 0, 1, 4), "g": (0, 3, 4, 4)}


def numerals(text: str) -> np.ndarray:
    """[row, column] mask of digits, dots and blanks as a seven-segment display shows them, 7 rows by 5 columns each."""
    out = np.zeros((7, 5 * len(text)), bool)
    for i, c in enumerate(text):
        for segment in SEGMENTS[int(c)] if c.isdigit() else "":
            x0, y0, x1, y1 = _SEGMENT_BOX[segment]
            out[y0:y1, 5 * i + x0 : 5 * i + x1] = True
        if c == ".":
            out[6, 5 * i + 1] = True
    return out


def stamped(image: np.ndarray, x: int, y: int, text: str, colour: tuple[int, int, int], scale: int = 2) -> None:
    """Writes ``text`` in white on a plate of ``colour`` with its upper left corner at (x, y), clipped to the image."""
    mask = np.pad(np.kron(numerals(text), np.ones((scale, scale), bool)), scale)
    high, wide = image.shape[:2]
    x, y = max(0, min(x, wide - mask.shape[1])), max(0, min(y, high - mask.shape[0]))
    mask = mask[: high - y, : wide - x]
    plate = image[y : y + mask.shape[0], x : x + mask.shape[1]]
    plate[:] = colour
    plate[mask] = 255


def annotated(image: np.ndarray, boxes: list[tuple[int, float, float, float, float, float]], width: int = 3) -> np.ndarray:
    """``outlined`` (label, score, x1, y1, x2, y2), each box with a tag of its class number and score above it, and a
    legend at the upper right: a row a class with its number and count, and the total on black."""
    out = outlined(image, [(label, *corners) for label, _, *corners in boxes], width)
    for label, score, x1, y1, *_ in boxes:
        stamped(out, round(x1), round(y1) - 18, f"{label} {score:.2f}", PALETTE[label % len(PALETTE)])
    counts: dict[int, int] = {}
    for label, *_ in boxes:
        counts[label] = counts.get(label, 0) + 1
    rows = [(f"{label} {counts[label]}", PALETTE[label % len(PALETTE)]) for label in sorted(counts)]
    rows += [(str(len(boxes)), (0, 0, 0))] if boxes else []
    for i, (text, colour) in enumerate(rows):
        stamped(out, out.shape[1] - 10 * len(text) - 8, 4 + 20 * i, text, colour)
    return out


def previews(pages: DataFrame, renderer: Renderer, detections: DataFrame, by: list[str], width: int = 3, dpi: int = 150) -> DataFrame:
    """(pdf_path, page, image as PNG) of each page with its detections (by, label, score, x1, y1, x2, y2) outlined and
    tagged, and a legend; pages without any keep their plain image.  Boxes join the page, which is rendered and drawn on
    in one task.  Tags and legend show class numbers; their names and counts are ``stitch.legend``."""
    listed = detections.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("label", "score", "x1", "y1", "x2", "y2"))).alias("boxes"))

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                image, _ = _drawn(renderer, r, dpi)
                if image is not None:
                    found = [tuple(b[c] for c in ("label", "score", "x1", "y1", "x2", "y2")) for b in (r.boxes if r.boxes is not None else [])]
                    yield pd.DataFrame({"pdf_path": [r.pdf_path], "page": [r.page], "image": [png(annotated(image, found, width))]})

    return pages.join(listed, by, "left").select("pdf_path", "page", "width", "height", "boxes").mapInPandas(draw, "pdf_path string, page int, image binary")
