import json
import uuid
from pathlib import Path

import numpy as np
import pytest

from gridmark.plans import cli, jobs
from gridmark.sources import coco, rasters, sinks


def document(images, categories, annotations):
    return {"images": images, "categories": categories, "annotations": annotations}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("set")
    mech, elec = base / "training" / "Mechanical" / "18 a+b", base / "training" / "electrical"
    for d in (mech, elec):
        d.mkdir(parents=True)
        (d / "sheet.pdf").write_bytes(b"%PDF")
    image = {"id": 1, "file_name": "sheet_page1.png", "width": 2000, "height": 1280}
    boxes = [{"id": 1, "image_id": 1, "category_id": 7, "bbox": [10, 10, 100, 100]}, {"id": 2, "image_id": 1, "category_id": 8, "bbox": [1500, 20, 50, 60]}, {"id": 3, "image_id": 1, "category_id": 99, "bbox": [0, 0, 5, 5]}]
    (mech / "m.json").write_text(json.dumps(document([image], [{"id": 7, "name": "Old"}, {"id": 7, "name": "Fan"}, {"id": 8, "name": "Grille, \"x\""}], boxes)))
    (mech / "m_detected_hvac.json").write_text(json.dumps(document([image], [{"id": 7, "name": "Overlay"}], boxes)))
    (elec / "e.json").write_text(json.dumps(document([{"id": 1, "file_name": "other.png", "width": 1280, "height": 1280, "page": 0}, {"id": 2, "file_name": "bare.png", "width": 1280, "height": 1280}], [{"id": 7, "name": "Panel"}], [{"image_id": 1, "category_id": 7, "bbox": [0, 0, 20, 10]}])))
    (elec / "duct.json").write_text(json.dumps(document([image], [{"id": 7, "name": "duct_segment"}], boxes)))
    (elec / "bad.json").write_text("{nope")
    (elec / "list.json").write_text("[1]")
    (elec / "none.json").write_text(json.dumps({"images": []}))
    return str(base)


def test_dataset(spark, root):
    data = coco.dataset(coco.documents(spark, root))
    assert sorted((r["coco_file"], r["discipline"]) for r in data.files.collect()) == [("e.json", "electrical"), ("m.json", "mechanical")]
    assert sorted(r["name"] for r in data.categories.collect()) == ["Fan", 'Grille, "x"', "Panel"]
    assert sorted((Path(r["path"]).name, r["reason"]) for r in data.quarantine.collect()) == [("bad.json", "no JSON object"), ("list.json", "no JSON object"), ("none.json", "no annotations")]
    assert data.annotations.count() == 4


def test_analyze(spark, root, tmp_path):
    report = jobs.analyze(spark, root, str(tmp_path))
    assert (report["num_coco_files"], report["num_sheets"], report["total_annotations"], report["num_classes_combined"]) == (2, 2, 3, 3)
    csv = next((tmp_path / "class_counts.csv").glob("part-*.csv")).read_bytes()
    assert csv == b'class,discipline,instances\r\nFan,mechanical,1\r\n"Grille, ""x""",mechanical,1\r\nPanel,electrical,1\r\n' or csv.count(b"\r\n") == 4
    assert json.loads((tmp_path / "classes_combined.json").read_text())["name_to_id"] == {"Fan": 0, 'Grille, "x"': 1, "Panel": 2}
    assert "| **TOTAL** | **2** |" in (tmp_path / "dataset_report.md").read_text()


class Blank:
    """A renderer of grey pages that knows no files."""

    def pages(self, pdf_path):
        return 2

    def __call__(self, pdf_path, page, dpi, size):
        if page > 2:
            raise ValueError("no such page")
        w, h = size or (1500, 1280)
        image = np.full((h, w, 3), 90, np.uint8)
        image[100:140, 100:160] = 255
        return image


class Counted(Blank):
    """Leaves a file for every page that it renders."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, pdf_path, page, dpi, size):
        Path(self.folder, uuid.uuid4().hex).write_text(f"{pdf_path} {page}")
        return super().__call__(pdf_path, page, dpi, size)


@pytest.mark.parametrize("job", ["prepare", "predict", "evaluate"])
def test_every_page_is_rendered_once(spark, root, tmp_path, job):
    seen = tmp_path / "seen"
    seen.mkdir()
    sinks.class_map(spark.createDataFrame([("Fan", 0)], "name string, class_id int"), str(tmp_path / "classes.json"))
    if job == "prepare":
        jobs.prepare(spark, root, str(tmp_path), renderer=Counted(str(seen))).collect()
    elif job == "predict":
        jobs.predict(spark, ["/x/plan.pdf"], str(tmp_path / "classes.json"), str(tmp_path / "out"), Counted(str(seen)), bright).collect()
    else:
        jobs.evaluate(spark, root, str(tmp_path / "classes.json"), str(tmp_path), Counted(str(seen)), bright).collect()
    pages = [f.read_text() for f in seen.iterdir()]
    assert pages and len(pages) == len(set(pages))


def bright(images):
    """Finds the bounding box of white pixels; scores by tile width."""
    out = []
    for image in images:
        ys, xs = np.nonzero(image[:, :, 0] == 255)
        out.append([(0, 0.9, float(xs.min()), float(ys.min()), float(xs.max() + 1), float(ys.max() + 1)), (5, 0.6, 0.0, 0.0, 3.0, 3.0), (0, 0.1, 0.0, 0.0, 2.0, 2.0)] if len(xs) else [])
    return out


def test_prepare(spark, root, tmp_path):
    stats = jobs.prepare(spark, root, str(tmp_path), empty_frac=1.0, renderer=Blank())
    assert sum(r["num_boxes"] for r in stats.collect()) == 3
    files = sorted((tmp_path / "labels").rglob("*.txt"))
    # the wide sheet has two tiles, the two electrical sheets one each; one is empty
    assert len(files) == 4 and sum(f.read_text() == "" for f in files) == 1
    assert any(f.read_text() == "0 0.046875 0.046875 0.078125 0.078125" for f in files)
    lines = coco.label_files(spark, str(tmp_path / "labels"))
    assert lines.count() == 3 and set(lines.columns) == {"tile_name", "class_id", "xc", "yc", "w", "h"}
    assert spark.read.parquet(str(tmp_path / "images")).count() == 4
    yaml = (tmp_path / "dataset.yaml").read_text()
    assert "nc: 3" in yaml and "  1: \"Grille, 'x'\"" in yaml


def test_predict_and_class_map_forms(spark, tmp_path):
    classes = tmp_path / "classes.json"
    classes.write_text(json.dumps({"num_classes": 1, "name_to_id": {"Light": 0}}))
    records = jobs.predict(spark, ["/x/plan.pdf"], str(classes), str(tmp_path / "out"), Blank(), bright)
    rows = {r["sheet_id"]: r for r in records.collect()}
    assert set(rows) == {"plan_p1", "plan_p2"}
    first = rows["plan_p1"]
    # the mark lies on both tiles of the sheet: one box is left of it, the stray label has no name and no count
    assert first["counts"] == {"Light": 1} and [o["type"] for o in first["objects"]] == ["Light", "5"] or [o["type"] for o in first["objects"]].count("Light") == 1
    written = [json.loads(x) for f in (tmp_path / "out" / "records").rglob("*.json") for x in f.read_text().splitlines()]
    assert {w["sheet_id"] for w in written} == set(rows) and all("scale" in w and w["scale"] is None for w in written)
    summary = spark.read.option("header", True).csv(str(tmp_path / "out" / "counts_summary.csv"))
    assert sorted((r["sheet_id"], r["class"], r["count"], r["source"]) for r in summary.collect()) == [("plan_p1", "Light", "1", "plan.pdf"), ("plan_p2", "Light", "1", "plan.pdf")]
    pages = jobs.predict(spark, ["/x/plan.pdf"], str(classes), str(tmp_path / "one"), Blank(), bright, pages=[2])
    assert [r["page"] for r in pages.collect()] == [2]


def test_evaluate(spark, root, tmp_path):
    sinks.class_map(spark.createDataFrame([("Fan", 0), ('Grille, "x"', 1), ("Panel", 2)], "name string, class_id int"), str(tmp_path / "classes.json"))
    scores = {r["name"]: r for r in jobs.evaluate(spark, root, str(tmp_path / "classes.json"), str(tmp_path), Blank(), bright).collect()}
    assert (scores["Fan"]["gt"], scores["Panel"]["gt"], scores["Panel"]["accuracy"], scores["OVERALL"]["gt"]) == (1, 1, 0.0, 3)


def test_mean_precision(spark, root, tmp_path):
    """Every sheet shows one white mark; the detector finds it where no truth box is, so nothing matches."""
    sinks.class_map(spark.createDataFrame([("Fan", 0), ('Grille, "x"', 1), ("Panel", 2)], "name string, class_id int"), str(tmp_path / "classes.json"))
    rows = {r["class"]: r for r in jobs.mean_precision(spark, root, str(tmp_path / "classes.json"), Blank(), bright, split=None).collect()}
    assert (rows["Fan"]["n_truth"], rows["Fan"]["ap50"], rows[None]["n_truth"], rows[None]["ap50_95"]) == (1, 0.0, 3, 0.0)
    exact = lambda images: [[(0, 0.9, 10.0, 10.0, 110.0, 110.0)] for _ in images]
    rows = {r["class"]: r for r in jobs.mean_precision(spark, root, str(tmp_path / "classes.json"), Blank(), exact, split=None).collect()}
    assert 0 < rows["Fan"]["ap50"] <= 1 and rows["Panel"]["ap50"] == 0.0


def test_predict_takes_a_folder_or_a_table(spark, root, tmp_path):
    sinks.class_map(spark.createDataFrame([("Fan", 0)], "name string, class_id int"), str(tmp_path / "classes.json"))
    folder = jobs.predict(spark, root, str(tmp_path / "classes.json"), str(tmp_path / "a"), Blank(), bright).collect()
    table = jobs.predict(spark, coco.pdfs(spark, root).select("pdf_path"), str(tmp_path / "classes.json"), str(tmp_path / "b"), Blank(), bright).collect()
    assert len(folder) == len(table) == 4


def test_samples_have_seeds(spark):
    from gridmark.functions import splits

    keys = spark.range(4000).selectExpr("CAST(id AS STRING) AS key")
    drawn = [{r["key"] for r in keys.where(splits.sampled("key", 0.2, seed)).collect()} for seed in (0, 1, 1)]
    assert drawn[0] != drawn[1] == drawn[2] and all(600 < len(d) < 1000 for d in drawn)


def test_render_failures_are_rows(spark):
    pages = spark.createDataFrame([("/a.pdf", 3, 0, 0), ("/a.pdf", 1, 50, 40)], "pdf_path string, page int, width int, height int")
    rows = {r["page"]: r for r in rasters.rendered(pages, Blank()).collect()}
    assert rows[3]["error"] == "ValueError: no such page" and (rows[1]["width"], rows[1]["height"]) == (50, 40)


def test_command_line():
    a = cli.parser().parse_args(["prepare", "--dataset", "d", "--tile", "640"])
    assert (a.tile, a.overlap, a.mode, a.min_visibility) == (640, 0.2, "combined", 0.3)


def test_stream_counts(spark, root, tmp_path):
    from gridmark.streaming import ingest

    query = ingest.class_counts(ingest.documents(spark, root + "/training")).writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
    query.awaitTermination(120)
    rows = {(r["discipline"], r["name"]): r["n"] for r in spark.table("arrived").collect()}
    assert rows[("mechanical", "Fan")] == 1 and rows[("electrical", "Panel")] == 1


def test_previews(spark):
    pages = spark.createDataFrame([("/a.pdf", 1, 60, 40), ("/a.pdf", 2, 60, 40)], "pdf_path string, page int, width int, height int")
    found = spark.createDataFrame([("/a.pdf", 1, 23, 0.5, 5.0, -2.0, 20.0, 30.0)], "pdf_path string, page int, label int, score double, x1 double, y1 double, x2 double, y2 double")
    rows = {r["page"]: bytes(r["image"]) for r in rasters.previews(pages, Plain(), found, ["pdf_path", "page"]).collect()}
    assert rows[1] != rows[2] and all(x.startswith(b"\x89PNG") for x in rows.values())
    image = rasters.outlined(np.zeros((40, 60, 3), np.uint8), [(23, 5.0, -2.0, 20.0, 30.0)])
    assert tuple(image[10, 5]) == rasters.PALETTE[1] and tuple(image[10, 10]) == (0, 0, 0) and tuple(image[29, 10]) == rasters.PALETTE[1]


class Plain(Blank):
    def __call__(self, pdf_path, page, dpi, size):
        return np.full((size[1], size[0], 3), 90, np.uint8)


def test_numerals_tags_and_legend():
    shown = ["".join("#" if x else "." for x in row) for row in rasters.numerals("12.")]
    assert shown == ["...#.####......", "...#....#......", "...#....#......", "...#.####......", "...#.#.........", "...#.#.........", "...#.####..#..."]
    image = rasters.annotated(np.zeros((200, 300, 3), np.uint8), [(1, 0.91, 20.0, 60.0, 80.0, 90.0), (1, 0.5, 20.0, 120.0, 80.0, 150.0), (2, 0.7, 120.0, 60.0, 180.0, 90.0)])
    assert tuple(image[43, 21]) == rasters.PALETTE[1] and tuple(image[60, 40]) == rasters.PALETTE[1]
    legend = image[:70, 230:]
    assert all((legend == np.array(rasters.PALETTE[k])).all(2).any() for k in (1, 2)) and (legend == 255).all(2).any()
    tiny = rasters.annotated(np.zeros((5, 6, 3), np.uint8), [(0, 1.0, 0.0, 0.0, 5.0, 5.0)])
    assert tiny.shape == (5, 6, 3)


def test_prepare_keeps_very_many_labels_in_archives(spark, root, tmp_path, monkeypatch):
    from gridmark.sources import named_files

    monkeypatch.setattr(named_files, "LOOSE", 2)
    stats = jobs.prepare(spark, root, str(tmp_path), empty_frac=1.0)
    assert sum(r["num_boxes"] for r in stats.collect()) == 3 and not list((tmp_path / "labels").rglob("*.txt"))
    assert list((tmp_path / "labels").glob(f"*{named_files.PACKED}")) and coco.label_files(spark, str(tmp_path / "labels")).count() == 3


def test_analyze_reads_annotations_no_more_than_needed(spark, root, tmp_path, monkeypatch):
    """Counts of classes and sheets are made once; CSVs, the report and the histogram go on from them."""
    from gridmark.operators import profile
    from gridmark.sources import scratch

    kept, seen = [], []
    monkeypatch.setattr(scratch, "written", lambda df, name, f=scratch.written: (kept.append(name), f(df, name))[1])
    monkeypatch.setattr(sinks, "csv", lambda df, path, *a, f=sinks.csv, **k: (seen.append((Path(path).name, df._jdf.queryExecution().optimizedPlan().toString())), f(df, path, *a, **k))[1])
    monkeypatch.setattr(profile, "class_counts", None)
    report = jobs.analyze(spark, root, str(tmp_path))
    assert list(report["instances_per_class"].items()) == [("Panel", 1), ("Fan", 1), ('Grille, "x"', 1)]
    assert {"classes", "sheets"} <= set(kept)
    assert all("num_classes#" in p and "Aggregate" not in p for name, p in seen if name == "sheet_counts.csv")
    rows = [x.split(",")[2] for f in sorted((tmp_path / "sheet_counts.csv").glob("part-*.csv")) for x in f.read_text().split("\n")[1:] if x]
    assert rows == ["other.png", "sheet_page1.png"]
