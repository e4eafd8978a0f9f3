import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridmark.functions import geometry as G
from gridmark.functions import names as N
from gridmark.functions import splits as S


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_")).select(column).first()[0]


@pytest.mark.parametrize(
    "path, expected",
    [("/Electrical/mechanical/a.json", "mechanical"), ("/x/ELECTRICAL/b.json", "electrical"), ("c:\\Plumbing\\z.json", "plumbing"), ("/electrical_2/a.json", "unknown"), (None, "unknown")],
)
def test_discipline(spark, path, expected):
    assert one(spark, N.discipline(F.lit(path).cast("string"))) == expected


@pytest.mark.parametrize("name, expected", [("a.b.png", "a.b"), (".png", ".png"), ("abc", "abc"), ("x.", "x.")])
def test_stem(spark, name, expected):
    assert one(spark, N.stem(F.lit(name))) == expected


def test_safe_stem(spark):
    assert one(spark, N.safe_stem(F.lit("electrical (2) redacted_page1"))) == "electrical__2__redacted_page1"
    assert one(spark, N.safe_stem(F.lit("é" * 200))) == "é" * 120


@pytest.mark.parametrize("page, expected", [(None, 1), (0, 1), (3, 3)])
def test_page(spark, page, expected):
    assert one(spark, N.page_or_first(F.lit(page).cast("int"))) == expected


@pytest.mark.parametrize("i, expected", [(0, "obj_00000"), (123456, "obj_123456")])
def test_object_id(spark, i, expected):
    assert one(spark, N.object_id(F.lit(i))) == expected


@pytest.mark.parametrize(
    "key, bucket, split",
    [("instances_all.json#8", 1641, "val"), ("instances_all.json#14", 858, "val"), ("instances_all.json#19", 13, "val"), ("18) M-3.json#1", 1826, "val"), ("instances_all.json#1", 8315, "train"), ("instances_all.json#2", 6632, "train")],
)
def test_split(spark, key, bucket, split):
    assert one(spark, S.bucket(F.lit(key))) == bucket == int(hashlib.md5(key.encode()).hexdigest(), 16) % 10_000
    assert one(spark, S.split_of(F.lit(key))) == split


@pytest.mark.parametrize(
    "length, expected", [(6300, [0, 1024, 2048, 3072, 4096, 5020]), (1280, [0]), (1281, [0, 1]), (1000, [0]), (3000, [0, 1024, 1720]), (4500, [0, 1024, 2048, 3072, 3220]), (0, [0])]
)
def test_starts(spark, length, expected):
    assert one(spark, G.starts(F.lit(length), 1280, 0.2)) == expected == G.start_list(length, 1280, 0.2)


@settings(max_examples=15, deadline=None)
@given(st.integers(1, 9000), st.integers(0, 8999), st.integers(1, 3000), st.sampled_from([(1280, 0.2), (640, 0.5), (100, 0.0)]))
def test_touching_starts_miss_none(spark, length, low, size, tiling):
    low = min(low, length - 1)
    tile, overlap = tiling
    near, every = spark.range(1).select(G.touching_starts(F.lit(low), F.lit(low + size), F.lit(length), tile, overlap), G.starts(F.lit(length), tile, overlap)).first()
    assert set(near) <= set(every)
    assert {s for s in every if s < low + size and min(s + tile, length) > low} <= set(near)
    assert every[0] == 0 and every[-1] + tile >= length and all(b - a <= tile for a, b in zip(every, every[1:]))


@pytest.mark.parametrize("x0, kept", [(70, True), (71, False), (100, False)])
def test_visible(spark, x0, kept):
    sides = [F.lit(v) for v in (0, 0, 100, 100, x0, 0, x0 + 1280, 1280)]
    assert one(spark, G.visible(*sides)) is kept


def test_yolo(spark):
    assert list(spark.range(1).select(*G.to_yolo(*(F.lit(v) for v in (0, 0, 128, 128, 1280, 1280)))).first()) == pytest.approx([0.05, 0.05, 0.1, 0.1])
