import math

from gridmark.operators import accuracy, profile, resolve, stitch, tiles


def boxes(spark, rows):
    return spark.createDataFrame(rows, "sheet string, label int, k int, x1 double, y1 double, x2 double, y2 double, score double")


def kept(df, by=("sheet", "label")):
    return sorted(r["k"] for r in stitch.nms(df, list(by), ["k"]).collect())


def test_equal_iou_is_kept(spark):
    assert kept(boxes(spark, [("s", 0, 1, 0.0, 0.0, 10.0, 10.0, 0.9), ("s", 0, 2, 0.0, 0.0, 10.0, 5.0, 0.8)])) == [1, 2]


def test_suppressed_box_suppresses_nothing(spark):
    assert kept(boxes(spark, [("s", 0, 1, 0.0, 0.0, 10.0, 10.0, 0.9), ("s", 0, 2, 3.0, 0.0, 13.0, 10.0, 0.8), ("s", 0, 3, 6.0, 0.0, 16.0, 10.0, 0.7)])) == [1, 3]


def test_labels_are_apart_ties_by_key_and_nan_left_out(spark):
    df = boxes(spark, [("s", 0, 2, 0.0, 0.0, 9.0, 9.0, 0.5), ("s", 0, 1, 0.0, 0.0, 9.0, 9.0, 0.5), ("s", 1, 3, 0.0, 0.0, 9.0, 9.0, 0.5), ("s", 1, 4, math.nan, 0.0, 9.0, 9.0, 0.9), ("s", 1, 5, None, 0.0, 9.0, 9.0, 0.9)])
    assert kept(df) == [1, 3]
    assert kept(df.limit(0)) == []


def test_suppression_is_idempotent(spark):
    df = boxes(spark, [("s", 0, i, float(i * 7 % 40), float(i * 11 % 40), float(i * 7 % 40 + 20), float(i * 11 % 40 + 20), (i * 37 % 100) / 100) for i in range(60)])
    once = stitch.nms(df, ["sheet", "label"], ["k"])
    assert kept(once) == kept(df)
    assert stitch.iou_pairs(once, ["sheet", "label"], once["k"]).count() == 0


def test_grid_is_column_major(spark):
    df = spark.createDataFrame([(1, 1, 6300, 4500)], "file_id long, image_id long, width int, height int")
    rows = {r["t_idx"]: (r["x0"], r["y0"]) for r in tiles.grid(df).collect()}
    assert len(rows) == 30 and rows[6] == (1024, 1024) and rows[1] == (0, 1024)
    small = spark.createDataFrame([(1, 1, 1000, 3000), (1, 2, 0, 0)], "file_id long, image_id long, width int, height int")
    assert sorted((r["image_id"], r["y0"], r["x1"]) for r in tiles.grid(small).collect()) == [(1, 0, 1000), (1, 1024, 1000), (1, 1720, 1000), (2, 0, 0)]


def test_upper_median(spark):
    assert profile.spread(spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "v int"), "v").first()["median_value"] == 3
    assert profile.spread(spark.createDataFrame([], "v int"), "v").first()["median_value"] is None


def test_histogram_closes_last_bin(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 5, 10, 10)], "v int")
    assert {r["bin"]: r["n"] for r in profile.histogram(df, "v", 10).collect()} == {0: 1, 1: 1, 5: 1, 9: 2}
    assert {r["bin"]: r["n"] for r in profile.histogram(df.where("v = 10"), "v", 10).collect()} == {0: 2}


def test_counts_break_ties_by_first_seen(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3), ("c", 4)], "name string, seq int")
    assert [r["name"] for r in profile.class_counts(df, ["name"], df["seq"]).orderBy("place").collect()] == ["c", "b", "a"]


def test_accuracy(spark):
    by = ["sheet", "name"]
    truth = spark.createDataFrame([("s", "A", 10)], "sheet string, name string, n long")
    found = spark.createDataFrame([("s", "A", 8), ("s", "B", 1)], "sheet string, name string, n long")
    rows = {r["name"]: r["accuracy"] for r in accuracy.count_accuracy_overall(accuracy.count_errors(truth, found, by)).collect()}
    assert rows["A"] == 0.8 and math.isnan(rows["B"]) and abs(rows["OVERALL"] - 0.7) < 1e-12


def test_label_outside_the_map(spark):
    classes = spark.createDataFrame([("a", 0), ("b", 1)], "name string, class_id int")
    found = boxes(spark, [("s", 5, 1, 0.0, 0.0, 1.0, 1.0, 0.9), ("s", 1, 2, 0.0, 0.0, 1.0, 1.0, 0.8)])
    assert [(r["object_id"], r["type"]) for r in stitch.object_records(found, classes, ["sheet"], ["k"]).orderBy("object_id").collect()] == [("obj_00000", "b"), ("obj_00001", "5")]
    assert [(r["name"], r["n"]) for r in stitch.sheet_class_counts(found, classes, ["sheet"]).collect()] == [("b", 1)]


def test_object_files(spark):
    files = spark.createDataFrame([(1, "/a.json"), (2, "/b.json"), (3, "/c.json"), (4, "/d_detected_hvac.json")], "file_id long, path string")
    names = spark.createDataFrame([(1, "duct_segment"), (3, "duct_segment"), (3, "X"), (4, "X"), (2, None)], "file_id long, name string")
    assert [r["file_id"] for r in resolve.object_files(files, names).collect()] == [3]


def test_average_precision_of_a_perfect_and_an_empty_detector(spark):
    truth = boxes(spark, [("s", 0, i, i * 20.0, 0.0, i * 20.0 + 10, 10.0, 1.0) for i in range(4)])
    score = lambda d: [r["average_precision"] for r in accuracy.average_precision(d, truth, ["sheet"], ["k"], ["k"]).collect()]
    assert score(truth) == [1.0]
    assert score(truth.limit(0)) == [0.0]
    assert score(truth.where("k < 2")) == [0.5]
