"""What made queries fail at size, seen on small tables."""

import re

import numpy as np
import pyarrow as pa

from gridmark.operators import accuracy, overlaps, profile, runs, stitch, tiles
from gridmark.plans import catalogue, files  # noqa: F401 (its queries are registered too)
from gridmark.plans.fixtures import Fixture
from gridmark.sources import scratch, sinks

SF = "/root/testdata/sf0.001"


def test_stage_of_detections_is_compiled(spark):
    """The JVM leaves methods of 8,000 bytes and more uncompiled."""
    found = overlaps.whole(catalogue._detections(Fixture(spark, SF)), "score")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shown = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", shown))) < 8000


def test_groups_go_on_over_batches():
    keys, values = [1, 1, 2, 2, 2, None, None, 3], list(range(8))
    batches = [pa.record_batch({"k": keys[i : i + 3], "v": values[i : i + 3]}, pa.schema([("k", pa.int64()), ("v", pa.int64())])) for i in (0, 3, 6)]
    seen = [(b.column(1).slice(i, j - i).to_pylist()) for b, first in runs.whole_groups(iter(batches), 1) for i, j in zip(first, first[1:], strict=False)]
    assert seen == [[0, 1], [2, 3, 4], [5, 6], [7]]
    pairs = [(i, j) for a, b in runs.pairs_within(np.array([0, 3, 4, 6])) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert pairs == [(0, 1), (0, 2), (1, 2), (4, 5)]


def test_small_groups_are_not_collected(spark):
    kept = stitch.nms(catalogue._detections(Fixture(spark, SF)), ["file_id", "image_id", "label"], ["l_orderkey", "l_linenumber"])
    assert "collect_list" not in kept._jdf.queryExecution().toString()


def test_tiles_are_not_broadcast(spark):
    fx = Fixture(spark, SF)
    local = catalogue._assigned(fx).select("file_id", "image_id", "t_idx", *(tiles.F.lit(0).alias(c) for c in ("x1", "y1", "x2", "y2")))
    moved = tiles.offset(local, tiles.grid(fx.images))
    top = moved._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [file_id" in top


def test_matching_where_groups_lie_and_on_the_grid(spark):
    rows = [(None if i % 41 == 0 else f"s{i % 3}", i % 2, i, float(i * 37 % 60), float(i * 23 % 50), (i * 29 % 20) / 20) for i in range(240)]
    kinds = "sheet string, label int, k int, x double, y double, score double"
    made = lambda r, shift: spark.createDataFrame(r, kinds).selectExpr("sheet", "label", "k", f"x + {shift} x1", "y y1", f"x + 20 + {shift} x2", "y + 15 y2", "score")
    found, truth = made(rows, 1), made(rows[::2], 0)
    plain = lambda df: sorted(map(str, df.collect()))
    for f, more in ((accuracy.greedy_matches, ([0.3, 0.6],)), (accuracy.mean_average_precision, ()), (accuracy.average_precision, ())):
        one, other = (plain(f(found, truth, ["sheet"], ["k"], ["k"], *more, small=small)) for small in (0, 256))
        assert one and one == other


def test_detections_are_not_repeated_for_thresholds(spark):
    fx = Fixture(spark, SF)
    found = catalogue._predicted(fx)
    truth = fx.annotations.selectExpr("file_id", "image_id", "category_id label", "l_orderkey", "x x1", "y y1", "x + w x2", "y + h y2")
    scored = accuracy.mean_average_precision(found, truth, ["file_id", "image_id"], ["l_orderkey", "t_idx"], ["l_orderkey"])
    assert "explode" not in scored._jdf.queryExecution().optimizedPlan().toString()


def test_label_lines_are_formatted_in_streams(spark):
    rows = spark.createDataFrame([("train", "b", 2, 7, 0.5, 0.25, 0.0078125, 1.0), ("train", "b", 1, 3, 0.5, 0.25, 0.1, 1.0), ("val", "a", None, None, None, None, None, None)], "split string, tile_name string, k int, class_id int, xc double, yc double, w double, h double")
    lines = sinks.label_lines(rows, ["k"])
    assert "collect_list" not in lines._jdf.queryExecution().toString()
    assert sorted(lines.collect()) == [("train", "b", "3 0.500000 0.250000 0.100000 1.000000\n7 0.500000 0.250000 0.007812 1.000000"), ("val", "a", "")]


def test_sheets_are_dealt_before_they_are_counted(spark):
    rows = spark.createDataFrame([(1, 1, "a", "x"), (1, 1, "a", "y"), (1, 1, "a", "x"), (1, 2, None, "x")], "file_id long, image_id long, file_name string, name string")
    counted = profile.sheet_counts(rows, ["file_id", "image_id", "file_name"])
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("Aggregate") < plan.index("Exchange")
    assert sorted(counted.collect()) == [(1, 1, "a", 3, 2), (1, 2, None, 1, 1)]


def test_scratch_tables_are_packed(spark):
    assert all(".zstd." in f for f in scratch.written(spark.range(9), "packed").inputFiles())


def test_what_only_sorts_stays_out_of_python(spark):
    by, keys = ["file_id", "image_id", "label"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "t_idx"]
    found = catalogue._detections(Fixture(spark, SF))
    full = stitch.nms(found, by, keys)
    counted = lambda df: sorted(df.groupBy(*by).count().collect())
    for small in (2, 256):
        few = stitch.nms(found, by, keys, small=small, shown=by)
        assert few.columns == by and counted(few) == counted(full)
    node = few._jdf.queryExecution().optimizedPlan()
    while "MapInArrow" not in node.nodeName():
        node = node.children().head()
    assert [node.children().head().output().apply(k).name() for k in range(node.children().head().output().size())] == [*by, "x1", "y1", "x2", "y2"]


def test_suppression_runs_once_for_numbers(spark):
    plan = catalogue.QUERIES["object_records"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "MapInArrow" not in plan


def test_true_positives_are_not_broadcast(spark):
    """Packed, a million of them is less than a megabyte."""
    judged = spark.range(400).selectExpr("id % 3 label", "'s' sheet", "id / 400 score", "id _dk", "CAST(id % 4 AS INT) _hit")
    curve = accuracy._curve(judged, [accuracy.F.desc("score"), "sheet", "_dk"], 2)
    plan = curve._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and "Broadcast" not in plan  # the first join stands in the plan twice


def test_places_stand_for_keys(spark):
    by, keys = ["file_id", "image_id", "label"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "t_idx"]
    found = catalogue._detections(Fixture(spark, SF)).withColumn("score", tiles.F.floor(tiles.F.col("score") * 4) / 4)  # many ties
    for small in (2, 256):
        kept = stitch.nms(found, by, keys, small=small, shown=[*by, *keys, "score", stitch.PLACE]).collect()
        groups = {}
        for r in kept:
            groups.setdefault(tuple(r[c] for c in by), []).append(((-r["score"], *(r[k] for k in keys)), r[stitch.PLACE]))
        assert max(map(len, groups.values())) > 2
        assert all([p for _, p in sorted(g)] == sorted({p for _, p in g}) and len({p for _, p in g}) == len(g) for g in groups.values())


def test_scores_and_records_do_not_carry_keys(spark):
    for name in ("average_precision", "object_records", "predict_records"):
        carried = []
        before = scratch.written
        try:
            scratch.written = lambda df, what, f=before, seen=carried: (seen.append((what, df.schema.simpleString())), f(df, what))[1]
            catalogue.QUERIES[name](spark, SF)
        finally:
            scratch.written = before
        assert all("l_orderkey" not in kind for what, kind in carried if what == "kept") and not any("_dk:struct<l_orderkey" in kind for _, kind in carried)
        assert any(stitch.PLACE in kind for _, kind in carried)


def test_record_parts_are_packed_if_asked_for(spark, tmp_path):
    rows = spark.range(500).selectExpr("id", "CAST(null AS double) scale", "transform(sequence(1, 9), i -> named_struct('id', concat('obj_', i), 'v', i / 4.0D)) objects")
    size = {}
    for kind, ending in (("none", ".json"), ("gzip", ".json.gz")):
        out = tmp_path / kind
        sinks.records(rows, str(out), kind)
        parts = list(out.glob("part-*"))
        size[kind] = sum(p.stat().st_size for p in parts)
        assert all(p.name.endswith(ending) for p in parts)
        assert sorted(spark.read.schema(rows.schema).json(str(out)).collect()) == sorted(rows.collect())
        assert spark.read.text(str(out)).where("value LIKE '%\"scale\":null%'").count() == 500
    assert size["gzip"] * 4 < size["none"]
