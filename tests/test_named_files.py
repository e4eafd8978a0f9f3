import json
import os

import pytest
from pyspark.sql import functions as F

from gridmark.sources import coco, folders, named_files, sinks


def found(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if not f.startswith("_") and "/_attempts" not in d)


def test_all_files_or_none(spark, tmp_path):
    rows = spark.range(40).repartition(7).select(F.concat(F.lit("train/deep/"), "id", F.lit(" ü.txt")).alias("name"), F.when(F.col("id") > 0, F.repeat(F.lit("é"), F.col("id").cast("int"))).alias("body"))
    good, bad = tmp_path / "good", tmp_path / "bad"
    sinks.files(rows, str(good))
    assert len(found(good)) == 40 and (good / "_SUCCESS").exists() and not (good / "_attempts").exists()
    assert (good / "train/deep/7 ü.txt").read_text() == "é" * 7 and (good / "train/deep/0 ü.txt").read_text() == ""
    broken = rows.withColumn("body", F.when(F.col("name").contains("/39 "), F.raise_error(F.lit("killed"))).otherwise(F.col("body")))
    with pytest.raises(Exception, match="killed"):
        sinks.files(broken, str(bad))
    assert found(bad) == [] and not (bad / "_SUCCESS").exists()
    sinks.files(rows.limit(0), str(tmp_path / "none"))
    assert (tmp_path / "none/_SUCCESS").exists()


def test_attempts_that_do_not_count_go(tmp_path):
    writer = named_files._Writer((tmp_path / "out").as_uri(), "j")
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a.txt"]), pa.array(["one"])], names=["name", "body"])
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first.name != second.name
    writer.commit([second, None])
    assert sorted(os.listdir(tmp_path / "out/_attempts/j")) == sorted(["_kept", second.name])
    writer.abort([])
    assert found(tmp_path / "out") == []


def test_folders_are_qualified_with_the_default_file_system(spark):
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        for default, whole, arrow in (("s3a://bucket", "s3a://bucket/shared/x", "s3://bucket/shared/x"), ("hdfs://name:8020", "hdfs://name:8020/shared/x", "hdfs://name:8020/shared/x"), ("dbfs:///", "dbfs:/shared/x", "file:///dbfs/shared/x")):
            conf.set("fs.defaultFS", default)
            assert folders.qualified(spark, "/shared/x") == whole and folders.native(whole) == arrow
            assert folders.qualified(spark, "file:/own/x") == "file:/own/x"
    finally:
        conf.set("fs.defaultFS", before)
    for uri in ("viewfs://store/x", "wasb://c/x"):
        with pytest.raises(ValueError, match="can't open"):
            folders.native(uri)
    with pytest.raises(ValueError, match="no scheme"):
        folders.native("/shared/x")
    assert folders.native("file:/a b") == folders.native("file:///a b") == "file:///a b" and folders.native("s3n://b/x") == "s3://b/x"


def test_label_files_come_back(spark, tmp_path):
    lines = spark.createDataFrame([("train", "a b", "1 0.5 0.5 0.1 0.1\n2 0.25 0.5 0.1 0.2"), ("val", "c", "")], "split string, tile_name string, body string")
    sinks.label_files(lines, str(tmp_path / "labels"))
    assert sorted(found(tmp_path / "labels")) == ["train/a b.txt", "val/c.txt"]
    assert sorted((r["tile_name"], r["class_id"], r["xc"]) for r in coco.label_files(spark, str(tmp_path / "labels")).collect()) == [("a b", 1, 0.5), ("a b", 2, 0.25)]


def test_documents_are_streamed_from_their_elements(spark, tmp_path):
    """Elements come in any order, over several batches and partitions, and none of the rows holds a document."""
    n = F.col("id")
    rows = spark.range(100).repartition(5).select(F.concat(F.lit("d/"), (n % 3).cast("string"), F.lit(" ü.json")).alias("name"), F.when(n % 2 == 0, 0).otherwise(2).alias("section"), n.alias("at"), F.to_json(F.struct("id")).alias("body"))
    empty = spark.createDataFrame([("d/none.json", 0, None, None)], "name string, section int, at bigint, body string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
        sinks.json_documents(rows.unionByName(empty), str(tmp_path / "out"), ["a", "b", "c"], ["at"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found(tmp_path / "out") == ["d/0 ü.json", "d/1 ü.json", "d/2 ü.json", "d/none.json"]
    for k in range(3):
        ids = [i for i in range(100) if i % 3 == k]
        whole = {"a": [{"id": i} for i in ids if i % 2 == 0], "b": [], "c": [{"id": i} for i in ids if i % 2]}
        assert json.loads((tmp_path / f"out/d/{k} ü.json").read_text()) == whole
    assert json.loads((tmp_path / "out/d/none.json").read_text()) == {"a": [], "b": [], "c": []}


def test_small_files_are_listed_and_opened_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(named_files, "OPENED", 1)
    for name, body in {"a/b/x +%41.txt": "1 0 0 1 1\r\n2 0 0 1 1\r3 0 0 1 1\n", "a/y.txt": "\n 4  0 0 1 1", "z.txt": "", "z.csv": "5 0 0 1 1", "_h/n.txt": "6 0 0 1 1", "a/.n.txt": "7 0 0 1 1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(body.encode())
    read = coco.label_files(spark, str(tmp_path))
    assert not any(f.endswith(".txt") for f in read.inputFiles())
    assert sorted((r["tile_name"], r["class_id"]) for r in read.collect()) == [("x +%41", 1), ("x +%41", 2), ("x +%41", 3), ("y", 4)]
    assert [r["class_id"] for r in coco.label_files(spark, str(tmp_path / "a/y.txt")).collect()] == [4]


def test_very_many_label_files_stay_in_archives(spark, tmp_path, monkeypatch):
    """Sets of 30 files, of which 20 may be loose, over each other in one folder."""
    made = lambda n, first: spark.range(n).repartition(3).selectExpr("IF(id % 2 = 0, 'train', 'val') split", "concat('é ', repeat('x', 120), id) tile_name", f"IF(id = 7, '', concat('{first} 0.5 0.5 0.1 0.1\n', id, ' 0.25 0.5 0.1 0.2')) body")
    read = lambda: sorted((r["tile_name"][122:], r["class_id"]) for r in coco.label_files(spark, str(tmp_path)).collect())
    want = lambda n, first: sorted((str(i), k) for i in range(n) if i != 7 for k in (first, i))
    monkeypatch.setattr(named_files, "LOOSE", 20)
    sinks.label_files(made(20, 40), str(tmp_path))
    assert len(found(tmp_path)) == 20 and all(f.endswith(".txt") for f in found(tmp_path)) and read() == want(20, 40)
    for first in (50, 60):
        sinks.label_files(made(30, first), str(tmp_path))
        assert all(f.endswith(named_files.PACKED) for f in found(tmp_path)) and len(found(tmp_path)) <= 3
        assert read() == want(30, first) and (tmp_path / "_SUCCESS").exists() and not (tmp_path / "_attempts").exists()
    plain = tmp_path / "val" / ("é " + "x" * 120 + "7.txt")
    sinks.label_files(made(20, 70), str(tmp_path))
    assert len(found(tmp_path)) == 20 and read() == want(20, 70) and plain.read_text() == ""


def test_archives_end(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(named_files, "PACK", 3)
    monkeypatch.setattr(named_files, "PACK_BYTES", 5000)
    names, bodies = [f"val/{i}.txt" for i in range(8)] + ["val/big.txt", "val/last.txt"], [f"{i} 0 0 1 1" for i in range(8)] + ["1 0 0 1 1\n" * 1000, None]
    writer = named_files._PackedWriter((tmp_path / "out").as_uri(), "j")
    made = [writer.write(iter([pa.RecordBatch.from_arrays([pa.array(names[i : i + 4]), pa.array(bodies[i : i + 4])], names=["name", "body"]) for i in (0, 4, 8)])), writer.write(iter([]))]
    assert [m.files for m in made] == [10, 0]
    archives = sorted(os.listdir(tmp_path / "out/_attempts/j" / made[0].name))
    store, base = folders.opened((tmp_path / "out/_attempts/j" / made[0].name).as_uri())
    held = [[(name, file.read().decode()) for name, file in named_files._members(store, f"{base}/{a}")] for a in archives]
    assert [len(h) for h in held] == [3, 3, 3, 1] and [x for h in held for x in h] == [(n, b or "") for n, b in zip(names, bodies, strict=True)]
    writer.commit(made)
    assert (tmp_path / "out/_attempts/j/_files").read_text() == "10"


def test_odd_names_in_archives(spark, tmp_path):
    """As in folders: no name is the file ``None``, which isn't read; nor is what is hidden."""
    import pyarrow as pa

    names = [None, "train//a.txt", "train/.txt", "_h/b.txt"]
    made = named_files._PackedWriter((tmp_path / "out").as_uri(), "j").write(iter([pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(["1 0 0 1 1"] * 4)], names=["name", "body"])]))
    folder = tmp_path / "out/_attempts/j" / made.name
    assert made.files == 4 and [(r["tile_name"], r["class_id"]) for r in coco.label_files(spark, str(folder)).collect()] == [("a", 1)]
