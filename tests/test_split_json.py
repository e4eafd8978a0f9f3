import json
import random

import pytest
from pyspark.sql import functions as F

from gridmark.sources import coco, split_json

ODD = ['a "quoted" } name', "back\\slash \\\\", "{[,]}", "日本 ü", "", "line\nbreak\ttab", 'x\\"', "}", "\\", "],\"annotations\":[{"]


def document(rng, n):
    box = lambda: [rng.randint(0, 9) + 0.5 for _ in range(4)]
    extra = lambda: rng.choice([{}, {"segmentation": [[1, 2, [3]]]}, {"segmentation": {"counts": [1, 2], "size": {"h": 1, "w": [2, {"deep": "}"}]}}}, {"attributes": {"a": rng.choice(ODD)}}])
    parts = {
        "info": {"year": 1, "notes": [1, {"x": "},{"}], "text": rng.choice(ODD)},
        "images": [{"id": k, "file_name": rng.choice(ODD) + str(k), "width": 10, "height": 20, "page": k % 3} | extra() for k in range(rng.randint(0, n))],
        "licenses": [], "version": rng.choice(ODD), "n": 3, "flag": None,
        "categories": [{"id": k, "name": rng.choice(["duct_segment", *ODD])} | extra() for k in range(rng.randint(0, 5))],
        "annotations": [rng.choice([{"id": k, "image_id": k % 5, "category_id": k % 4, "bbox": box()} | extra(), {"id": k, "bbox": []}, None, {}]) for k in range(rng.randint(0, n))],
        "numbers": [1, 2, 3],
    }
    keys = list(parts)
    rng.shuffle(keys)
    style = rng.choice([{}, {"indent": 1}, {"separators": (",", ":")}, {"ensure_ascii": False}])
    return rng.choice(["", " \n", "\n\t"]) + json.dumps({k: parts[k] for k in keys}, **style) + rng.choice(["", "\n", " \n "])


BROKEN = {
    "text": "{nope", "array": '[{"annotations": []}]', "none": '{"images": []}', "cut": '{"annotations": [{"id": 1}, {"id"', "cut2": '{"annotations": [{"id": 1}]', "tail": '{"annotations": [{"id": 1}]} x', "open": '{"annotations": ["}]}',
    "blank": "  ", "string": '"annotations"',
}
TABLES = ("files", "images", "categories", "annotations", "quarantine")


def written(tmp_path, seed, sizes):
    rng = random.Random(seed)
    for i, n in enumerate(sizes):
        folder = tmp_path / "training" / rng.choice(["mechanical", "electrical"])
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"doc {i}+%.json").write_text(document(rng, n))
    for name, body in BROKEN.items():
        (tmp_path / "training" / f"{name}.json").write_text(body)
    (tmp_path / "training" / "twice.json").write_text('{"annotations": [{"id": 1, "bbox": [1, 2]}], "categories": [{"id": 1, "name": "A"}], "annotations": [{"id": 7}, {"id": 8}]}')
    (tmp_path / "training" / "x_detected_hvac.json").write_text("{}")


def rows(data):
    return {t: sorted(map(repr, getattr(data, t).collect())) for t in TABLES}


@pytest.mark.parametrize(("bytes_", "chunk", "few"), [(500, 64, split_json.FEW_RANGES), (900, 1 << 22, 0)])
def test_split_documents_equal_whole_ones(spark, tmp_path, monkeypatch, bytes_, chunk, few):
    monkeypatch.setattr(split_json, "CHUNK", chunk)
    monkeypatch.setattr(split_json, "FEW_RANGES", few)
    written(tmp_path, bytes_ + few, [0, 1, 5, 20, 30])
    whole = rows(coco.load(spark, str(tmp_path)))
    assert whole["annotations"] and whole["images"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", bytes_)
    try:
        split, mixed = rows(coco.load(spark, str(tmp_path), whole=-1)), rows(coco.load(spark, str(tmp_path), whole=2000))
        parts = split_json.records(spark, f"{tmp_path}/training", "*.json", -1).select("path", "begin").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert parts > 10
    for t in TABLES:
        assert split[t] == whole[t] == mixed[t], t


def test_files_that_a_condition_excludes_are_not_opened(spark, tmp_path):
    written(tmp_path, 1, [5, 9, 20, 30])
    for name in ("secret", "secret2"):
        locked = tmp_path / "training" / "plumbing" / f"{name}.json"
        locked.parent.mkdir(exist_ok=True)
        locked.write_text("{}")
        locked.unlink()
        locked.symlink_to("/proc/self/mem")  # reading it fails
    only = lambda path: ~path.contains("/plumbing/")
    for whole in (-1, 1 << 20):
        files = coco.load(spark, str(tmp_path), only=only, whole=whole).files.collect()
        assert len(files) >= 2 and all("/plumbing/" not in r["path"] for r in files)
    scan = split_json.records(spark, f"{tmp_path}/training", "*.json", -1, coco._wanted(only))
    assert scan.select(F.col("path")).where("path LIKE '%plumbing%' OR path LIKE '%detected_hvac%'").count() == 0
