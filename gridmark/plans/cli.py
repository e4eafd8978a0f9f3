"""Command line: python -m gridmark.plans.cli {analyze,prepare,predict,counts,map,train} ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..sources import coco, rasters
from . import jobs


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridmark")
    commands = top.add_subparsers(dest="command", required=True)

    def command(command: str, *required: str, **defaults) -> argparse.ArgumentParser:
        p = commands.add_parser(command)
        for r in required:
            p.add_argument(f"--{r}", required=True)
        for k, v in defaults.items():
            p.add_argument(f"--{k.replace('_', '-')}", default=v, type=type(v) if v is not None else str)
        return p

    tiling = {"tile": 1280, "overlap": 0.2, "dpi": 150}
    command("analyze", "dataset", out="outputs/analysis")
    command("prepare", "dataset", out="data/yolo", mode="combined", val_frac=0.2, empty_frac=0.1, min_visibility=0.3, seed=0, **tiling).add_argument("--render", action="store_true")
    command("predict", "weights", "classes", "pdf", out="outputs/detections", conf=0.25, nms_iou=0.5, pages="", **tiling).add_argument("--preview", action="store_true")
    command("counts", "weights", "classes", "dataset", mode="combined", conf=0.25, out="outputs/eval", **tiling)
    command("map", "weights", "classes", "dataset", mode="combined", conf=0.001, split="val", **tiling)
    command("train", "data", model="yolov8s.pt", imgsz=1280, epochs=100, batch=8, device=None, project="runs", name="level1", patience=25).add_argument("--resume", action="store_true")
    return top


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    if a.command == "train":
        from ultralytics import YOLO

        YOLO(a.model).train(data=a.data, imgsz=a.imgsz, epochs=a.epochs, batch=a.batch, device=a.device, project=a.project, name=a.name, patience=a.patience, resume=a.resume)
        return
    spark = SparkSession.builder.appName("gridmark").getOrCreate()
    if a.command == "analyze":
        print(jobs.analyze(spark, a.dataset, a.out))
    elif a.command == "prepare":
        jobs.prepare(spark, a.dataset, a.out, a.mode, a.tile, a.overlap, a.dpi, a.val_frac, a.empty_frac, a.min_visibility, rasters.FitzRenderer() if a.render else None, a.seed).show()
    elif a.command == "predict":
        pages = [int(p) for p in a.pages.split(",") if p]
        jobs.predict(spark, [a.pdf] if a.pdf.lower().endswith(".pdf") else a.pdf, a.classes, a.out, rasters.FitzRenderer(), rasters.YoloDetector(a.weights, a.conf), a.tile, a.overlap, a.dpi, a.conf, a.nms_iou, pages, preview=a.preview).show()
    elif a.command == "map":
        jobs.mean_precision(spark, a.dataset, a.classes, rasters.FitzRenderer(), rasters.YoloDetector(a.weights, a.conf), a.mode, a.tile, a.overlap, a.dpi, a.conf, split=a.split or None).show(1000, truncate=False)
    else:
        jobs.evaluate(spark, a.dataset, a.classes, a.out, rasters.FitzRenderer(), rasters.YoloDetector(a.weights, a.conf), a.mode, a.tile, a.overlap, a.dpi, a.conf).show()


if __name__ == "__main__":
    main()
