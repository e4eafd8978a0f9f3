"""Writers: CSV, JSON and text as the consumers of these files expect them.

Single files are written through Hadoop's file system API, so paths may be in any store.  Tables that go into single
files (class maps, reports, counts of classes) are aggregates; tables of boxes or sheets are written in parts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runs
from . import named_files


def text_file(spark: SparkSession, path: str, text: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def csv(df: DataFrame, path: str, partition_by: list[str] | None = None, parts: bool = False) -> None:
    """A folder with one CSV file (or one a value of ``partition_by``), or with as many as ``df`` has partitions: header,
    CRLF, quotes doubled, null as empty."""
    writer = (df if parts else df.repartition(*partition_by) if partition_by else df.coalesce(1)).write.mode("overwrite").options(header=True, escape='"', emptyValue="", nullValue="", lineSep="\r\n")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def _classes(classes: DataFrame) -> list[str]:
    return [r["name"] for r in classes.orderBy("class_id").collect()]


def class_map(classes: DataFrame, path: str) -> None:
    names = _classes(classes)
    body = {"num_classes": len(names), "names": names, "name_to_id": {n: i for i, n in enumerate(names)}}
    text_file(classes.sparkSession, path, json.dumps(body, indent=2, ensure_ascii=False))


def dataset_yaml(classes: DataFrame, path: str, root: str) -> None:
    names = _classes(classes)
    lines = [f"path: {root.replace(chr(92), '/')}", "train: images/train", "val: images/val", f"nc: {len(names)}", "names:"]
    quoted = [name.replace('"', "'") for name in names]
    text_file(classes.sparkSession, path, "\n".join([*lines, *(f'  {i}: "{n}"' for i, n in enumerate(quoted))]) + "\n")


def report_json(spark: SparkSession, report: dict, path: str) -> None:
    text_file(spark, path, json.dumps(report, indent=2, ensure_ascii=False))


def report_markdown(spark: SparkSession, report: dict, by_discipline: dict[str, list[tuple[str, int]]], areas: tuple | None, path: str) -> None:
    """Totals, a table of classes for each discipline with its TOTAL, and the spread of box areas."""
    out = ["# Annotated sheets at a glance", "", "| What | How many |", "|---|---:|"]
    out += [f"| annotation files | {report['num_coco_files']} |", *(f"| of them {k} | {n} |" for k, n in report["files_per_discipline"].items()), f"| sheets | {report['num_sheets']} |", f"| boxes | {report['total_annotations']} |"]
    out += [f"| classes, {mode} | {report[f'num_classes_{mode}']} |" for mode in ("combined", "mechanical", "electrical")] + [""]
    for name, rows in by_discipline.items():
        out += [f"## Boxes by class: {name.title()}", "", "| Class | Boxes |", "|---|---:|", *(f"| {c} | {n} |" for c, n in rows), f"| **TOTAL** | **{sum(n for _, n in rows)}** |", ""]
    if areas:
        out += ["## Box areas in pixels", "", "smallest {:.0f}, upper median {:.0f}, largest {:.0f}".format(*areas), ""]
    text_file(spark, path, "\n".join(out))


def labels(rows: DataFrame, path: str) -> None:
    """Label rows (split, tile_name, class_id, xc, yc, w, h, ...) as Parquet by split."""
    rows.write.mode("overwrite").partitionBy("split").parquet(path)


def label_lines(rows: DataFrame, order: list[str]) -> DataFrame:
    """(split, tile_name, body): a tile's lines ``class xc yc w h`` with six places each, as C's printf rounds, joined
    by newlines in the given order; tiles without a box (class_id null) have an empty body.  A tile's boxes are one
    group."""
    shown = ["split", "tile_name", "class_id", "xc", "yc", "w", "h"]
    ordered = rows.select(*shown, *order).repartition("split", "tile_name").sortWithinPartitions("split", "tile_name", *order, "class_id", "xc", "yc", "w", "h")
    return ordered.select(shown).mapInArrow(_formatted, "split string, tile_name string, body string")


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bodies of sorted tiles."""
    for batch, first in runs.whole_groups(batches, 2):
        numbers = (batch.column(k).to_pylist() for k in range(2, 7))
        lines = [None if c is None else "%d %.6f %.6f %.6f %.6f" % (c, *sides) for c, *sides in zip(*numbers, strict=True)]
        body = ["\n".join(x for x in lines[i:j] if x is not None) for i, j in zip(first, first[1:], strict=False)]
        at = pa.array(first[:-1])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(body, pa.string())], names=["split", "tile_name", "body"])


def files(rows: DataFrame, folder: str) -> None:
    """One file for each row (name, body) below a folder, all of them or none; names may have folders of their own."""
    named_files.write(rows, folder)


def json_documents(rows: DataFrame, folder: str, arrays: list[str], order: list[str]) -> None:
    """A JSON object for each name of the rows (name, section, body, ...): section k's bodies, JSON texts, are the elements of the
    k-th of ``arrays`` in the given order.  Elements are streamed, so a document of any size is no single row."""
    keys = [json.dumps(a) for a in arrays]
    named_files.write_framed(rows, folder, [f"{'],' if k else '{'}{key}:[" for k, key in enumerate(keys)] + ["]}"], order)


def label_files(lines: DataFrame, folder: str) -> None:
    """One ``<split>/<tile_name>.txt`` a tile; very many of them stay in archives (``named_files.LOOSE``)."""
    named_files.write_packed(lines.select(F.concat("split", F.lit("/"), "tile_name", F.lit(".txt")).alias("name"), "body"), folder)


def records(sheets: DataFrame, path: str, compression: str = "none") -> None:
    """Nested sheet records as JSON, one line a sheet, null fields kept; in parts, not a file or folder a sheet.  The same keys
    stand in every object, so ``gzip`` makes parts several times smaller; Spark and most readers open them as they are."""
    sheets.write.mode("overwrite").options(ignoreNullFields=False, compression=compression).json(path)


def counts_summary(counts: DataFrame, path: str) -> None:
    """(source, sheet_id, class, count): one CSV a source, so sources don't overwrite each other."""
    csv(counts, path, ["source"])
