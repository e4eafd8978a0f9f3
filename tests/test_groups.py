import random

import pytest
from pyspark.sql import functions as F

from gridmark.operators import accuracy, greedy, overlaps, stitch

CORNERS = ("x1", "y1", "x2", "y2")


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0, w) * max(0, h)
    return both / max(1e-9, (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both)


def boxes(rng, n, extent, size, labels=2, start=0):
    out = []
    for k in range(n):
        x, y = (rng.gauss(extent / 2, extent / 9) if k % 2 else rng.uniform(0, extent) for _ in "xy")
        out.append((start + k, rng.randrange(labels), round(rng.random(), 3), float(x), float(y), float(x + rng.uniform(0, size)), float(y + rng.uniform(0, size))))
    return out


def table(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], "sheet string, k long, label int, score double, x1 double, y1 double, x2 double, y2 double").repartition(5)


def kept(rows, threshold):
    out = []
    for r in sorted(rows, key=lambda r: (r[1], -r[2], r[0])):
        if all(o[1] != r[1] or iou(o[3:], r[3:]) <= threshold for o in out):
            out.append(r)
    return sorted(r[0] for r in out)


SETS = {
    "spread": lambda rng: boxes(rng, 500, 900, 60), "dense": lambda rng: boxes(rng, 250, 30, 60), "one cell": lambda rng: boxes(rng, 200, 0.5, 40), "points": lambda rng: boxes(rng, 60, 5, 0),
    "sizes": lambda rng: boxes(rng, 200, 900, 4) + boxes(rng, 20, 500, 900, start=1000), "copies": lambda rng: [(k, 0, 0.5, 1.0, 1.0, 9.0, 9.0) for k in range(120)], "negative": lambda rng: [(*r[:3], *(v - 700 for v in r[3:])) for r in boxes(rng, 200, 900, 90)],
}


@pytest.mark.parametrize("name", SETS)
def test_pairs_on_the_grid(spark, name):
    rows = SETS[name](random.Random(name))
    found = stitch.iou_pairs(table(spark, rows), ["sheet", "label"], F.col("k"), 0.1, bound=8).select("key_a", "key_b", F.round("iou", 9).alias("iou")).collect()
    want = [(a[0], b[0], round(iou(a[3:], b[3:]), 9)) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and iou(a[3:], b[3:]) > 0.1]
    assert sorted(map(tuple, found)) == sorted(want)


@pytest.mark.parametrize(("fold", "small"), [(0, 0), (40, 30), (1 << 20, 1 << 20)])
def test_suppression_in_rounds_equals_the_fold(spark, fold, small):
    rng = random.Random(fold)
    rows = boxes(rng, 300, 120, 50, labels=3) + boxes(rng, 40, 900, 60, labels=9, start=1000)
    rows += [(2000 + k, 5, 0.001 * k, 3.0 * k, 0.0, 3.0 * k + 10, 10.0) for k in range(25)]  # a chain: each box suppresses the next one
    odd = [(3000, 0, None, 1.0, 1.0, 2.0, 2.0), (3001, 0, 0.5, float("nan"), 1.0, 2.0, 2.0), (3002, 0, float("nan"), 1.0, 1.0, 2.0, 2.0), (3003, 0, 0.9, None, 1.0, 2.0, 2.0)]
    got = stitch.nms(table(spark, rows + odd), ["sheet", "label"], ["k"], 0.5, bound=16, fold=fold, small=small)
    assert got.columns == ["sheet", "label", "k", *CORNERS, "score"]
    assert sorted(r["k"] for r in got.collect()) == kept(rows, 0.5)
    assert stitch.nms(table(spark, rows).limit(0), ["sheet", "label"], ["k"]).count() == 0


@pytest.mark.parametrize("fold", [0, 1 << 20])
def test_matching_in_rounds_equals_the_fold(spark, fold):
    rng = random.Random(1 + fold)
    found, truth = boxes(rng, 150, 90, 40, labels=2), boxes(rng, 100, 90, 40, labels=2)
    want = set()
    for t in (0.3, 0.6):
        taken = set()
        for d in sorted(found, key=lambda d: (-d[2], d[0])):
            best = sorted((-iou(d[3:], g[3:]), g[0]) for g in truth if g[1] == d[1] and g[0] not in taken and iou(d[3:], g[3:]) >= t)
            if best:
                taken.add(best[0][1])
                want.add((d[1], t, d[0]))
    hits = accuracy.greedy_matches(table(spark, found), table(spark, truth), ["sheet"], ["k"], ["k"], [0.3, 0.6], fold)
    assert {(r["label"], r["threshold"], r["_dk"]["k"]) for r in hits.collect()} == want


def test_no_leaf_holds_more_than_its_share(spark):
    """One label of one sheet: rows of a cell and block stay near the bound."""
    rng = spark.range(60_000).select(F.lit("s").alias("sheet"), F.lit(1).alias("label"), F.col("id").alias("k"), (F.pow(F.rand(1), 3) * 20_000).alias("x1"), (F.rand(2) * 20_000).alias("y1"))
    df = rng.withColumns({"x2": F.col("x1") + 20, "y2": F.col("y1") + 20})
    left, right, on = overlaps.sides(df, df, ["sheet", "label"], 256)
    for side in (left, right):
        assert side.groupBy(*on).count().agg(F.max("count")).first()[0] <= 2 * 256


def test_large_group_of_copies_is_dealt_in_blocks(spark):
    df = table(spark, [(k, 0, 0.5, 1.0, 1.0, 9.0 + (k % 7), 9.0) for k in range(500)])
    left, _, on = overlaps.sides(df, df, ["sheet", "label"], 32)
    assert left.groupBy(*on).count().count() > 3


def test_fold_is_bounded():
    assert greedy.FOLD <= 1024


def test_pdfs_by_parts_of_names(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab_é.") for _ in range(n))
    folders = [f"/d/{k}" for k in range(6)]
    pdfs = [(f, f"{f}/{word(rng.randint(0, 3))}.pdf") for f in folders[:5] for _ in range(rng.randint(0, 6))] + [(folders[0], f"{folders[0]}/a_detected_hvac.pdf")]
    images = [(k, rng.choice(folders), rng.choice([None, word(rng.randint(1, 6)) + ".png"]), rng.choice([None, 0, 3])) for k in range(150)]
    stem = lambda name: name.rpartition(".")[0] if "." in name[1:] else name
    want = []
    for k, folder, name, page in images:
        own = sorted({p for f, p in pdfs if f == folder and not p.endswith("_detected_hvac.pdf")})
        fit = [p for p in own if name is not None and stem(p.rpartition("/")[2]) in stem(name)]
        want.append((k, (fit or own or [None])[0], page or 1))
    from gridmark.operators import resolve

    out = resolve.source_pdf(spark.createDataFrame(images, "image_id long, folder string, file_name string, page int"), spark.createDataFrame(pdfs, "folder string, pdf_path string").repartition(3))
    assert out.columns == ["image_id", "folder", "file_name", "pdf_path", "page"]
    assert sorted((r["image_id"], r["pdf_path"], r["page"]) for r in out.collect()) == want


def test_a_folder_with_many_pdfs_and_images(spark):
    from gridmark.operators import resolve

    n = 20_000
    pdfs = spark.range(n).select(F.lit("f").alias("folder"), F.concat(F.lit("f/plan"), F.lpad("id", 6, "0"), F.lit(".pdf")).alias("pdf_path"))
    images = spark.range(n).select(F.col("id").alias("image_id"), F.lit("f").alias("folder"), F.concat(F.lit("x plan"), F.lpad("id", 6, "0"), F.lit(" p1.png")).alias("file_name"), F.lit(1).alias("page"))
    out = resolve.source_pdf(images, pdfs)
    assert out.where(F.col("pdf_path") == F.concat(F.lit("f/plan"), F.lpad("image_id", 6, "0"), F.lit(".pdf"))).count() == n


def test_numbers_inside_a_hot_sheet(spark):
    from gridmark.operators import numbering

    rows = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.concat(F.lit("s"), (F.col("id") % 20).cast("string"))).otherwise("hot").alias("sheet"), (F.col("id") % 7).alias("label"), (F.col("id") % 11 / 11).alias("score"), "id")
    order = ["label", F.desc("score"), "id"]
    plain, split = (numbering.numbered(rows, ["sheet"], order, "i", bound) for bound in (10**6, 500))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, split.collect()))
    assert numbering.numbered(rows.limit(0), ["sheet"], order, "i", 0).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_middle_value_in_two_scans(spark, seed):
    from gridmark.operators import profile

    rng = random.Random(seed)
    values = [[rng.random() for _ in range(5001)], [rng.randint(0, 3) * 1.5 for _ in range(3000)], [rng.paretovariate(0.3) for _ in range(4000)], [7.0]][seed]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(4)
    row = profile.spread(df, "v", buckets=16).first()
    assert tuple(row) == (len(values), min(values), sorted(values)[len(values) // 2], max(values))
    assert tuple(profile.spread(df.limit(0), "v").first()) == (0, None, None, None)
    if seed != 2:
        assert profile.spread(df.withColumn("v", F.col("v").cast("int")), "v").first()["median_value"] == sorted(map(int, values))[len(values) // 2]


def test_totals_read_annotations_once(spark):
    from gridmark.operators import profile

    rows = spark.createDataFrame([(1, 1, "mechanical", "a"), (1, 2, "mechanical", "b"), (2, 1, "electrical", "b"), (2, 1, "electrical", "b"), (3, 1, "unknown", "c")], "file_id long, image_id long, discipline string, name string")
    out = profile.totals(spark.range(7), rows)
    assert tuple(out.first()) == (7, 4, 5, 3, 2, 1) and "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert tuple(profile.totals(spark.range(0), rows.limit(0)).first()) == (0, 0, 0, 0, 0, 0)
