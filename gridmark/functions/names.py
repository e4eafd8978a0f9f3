"""Column functions on paths, file names and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Disciplines in the order in which they win.
DISCIPLINES = ("mechanical", "electrical", "plumbing")
OVERLAY = "_detected_hvac"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def discipline(path: Column | str) -> Column:
    """The first of DISCIPLINES that is a whole component of the path, whatever its case; else ``unknown``."""
    parts = F.split(F.lower(col(path)), r"[/\\]")
    out = F.lit("unknown")
    for name in reversed(DISCIPLINES):
        out = F.when(F.array_contains(parts, name), name).otherwise(out)
    return out


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), r"[/\\]"), -1)


def folder(path: Column | str) -> Column:
    return F.regexp_replace(col(path), r"[/\\][^/\\]*$", "")


def stem(name: Column | str) -> Column:
    """A file name without its last suffix; a leading dot is part of the stem."""
    return F.regexp_replace(col(name), r"(?<=.)\.[^.]+$", "")


def safe_stem(name: Column | str, most: int = 120) -> Column:
    """Letters, digits, ``-`` and ``_`` kept, all else ``_``; at most ``most`` characters."""
    return F.substring(F.regexp_replace(col(name), r"[^\p{L}\p{N}_-]", "_"), 1, most)


def sheet_key(coco_file: Column | str, image_id: Column | str) -> Column:
    return F.concat_ws("#", col(coco_file), col(image_id).cast("string"))


def tile_name(name: Column | str, t_idx: Column | str, x0: Column | str, y0: Column | str) -> Column:
    return F.concat(safe_stem(name), F.lit("__t"), F.concat_ws("_", *(col(c).cast("string") for c in (t_idx, x0, y0))))


def sheet_id(name: Column | str, page: Column | str) -> Column:
    return F.concat(safe_stem(name), F.lit("_p"), col(page).cast("string"))


def object_id(index: Column | str) -> Column:
    """obj_ and the number with five digits at least."""
    text = col(index).cast("string")
    return F.concat(F.lit("obj_"), F.when(F.length(text) < 5, F.lpad(text, 5, "0")).otherwise(text))


def page_or_first(page: Column | str) -> Column:
    """The page; 1 for null and 0."""
    return F.coalesce(F.nullif(col(page), F.lit(0)), F.lit(1))


def size_or_zero(side: Column | str) -> Column:
    return F.coalesce(col(side), F.lit(0))


def is_overlay(path: Column | str, suffix: str = ".json") -> Column:
    return col(path).endswith(OVERLAY + suffix)


def colour_index(class_id: Column | str, colours: int = 22) -> Column:
    return F.pmod(col(class_id), F.lit(colours))
