import random
import time

import pytest
from pyspark.sql import functions as F

from gridmark.llm import mixing


def test_targets_stop_at_three_times_the_size():
    assert mixing.targets({"a": 10, "b": 1000, "c": 1000}) == {"a": 30.0, "b": pytest.approx(1980 * 2 / 3), "c": pytest.approx(1980 / 3)}
    assert mixing.targets({None: 5, "z": 5}) == {"z": pytest.approx(50 / 7), None: pytest.approx(20 / 7)}
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_flow_is_largest_and_cheapest():
    given = mixing.flow({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 25, "b": 5})
    assert sum(v for (p, s), v in given.items() if s == "a") == 25 and sum(v for (p, s), v in given.items() if s == "b") == 5
    # first uses are free: b takes from its own pattern, a takes 10 + 10 once and 5 more from either
    assert given[("b",), "b"] == 5 and given[("a",), "a"] + given[("a", "b"), "a"] == 25


def cost(used, size, costs=mixing.REPEAT_COSTS):
    total = 0
    for c in costs:
        total += c * min(used, size)
        used -= min(used, size)
    return total


def test_flow_against_all_splits():
    rng = random.Random(4)
    for _ in range(20):
        sizes = {("a",): rng.randint(1, 4), ("a", "b"): rng.randint(1, 4), ("b",): rng.randint(1, 4)}
        quotas = {"a": rng.randint(0, 12), "b": rng.randint(0, 12)}
        given = mixing.flow(sizes, quotas)
        used = {p: sum(v for (q, _), v in given.items() if q == p) for p in sizes}
        best = max(
            ((min(x, 3 * sizes[("a",)]) + y + z + w), -(cost(x, sizes[("a",)]) + cost(y + z, sizes[("a", "b")]) + cost(w, sizes[("b",)])))
            for x in range(3 * sizes[("a",)] + 1) for y in range(3 * sizes[("a", "b")] + 1) for z in range(3 * sizes[("a", "b")] + 1 - y) for w in range(3 * sizes[("b",)] + 1)
            if x + y <= quotas["a"] and z + w <= quotas["b"]
        )
        assert (sum(used.values()), -sum(cost(used[p], sizes[p]) for p in sizes)) == best


def documents(spark, n=3000):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)) if i % 50 else None, ["s0", "s1", "s2", None][i % 10 if i % 10 < 4 else 0], "t") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")


def test_mix_is_near_target_and_repeatable(spark):
    df = documents(spark)
    mixed, plan = mixing.mix(df, F.array("source"))
    rows = mixing.with_targets(mixed, plan, "source").collect()
    assert len(rows) == 3000
    for source in ("s0", "s1", "s2", None):
        own = [r for r in rows if r["source"] == source]
        assert own[0]["source_size"] == sum(r["size"] for r in own) == sum(len((r["text"] or "").split()) for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 30
        assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in own)
    again, _ = mixing.mix(df.repartition(7), F.array("source"))
    assert {r["doc_id"]: r["taken"] for r in rows} == {r["doc_id"]: r["taken"] for r in again.collect()}


def test_overlapping_sources_share_their_documents(spark):
    df = documents(spark).withColumn("sources", F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"))).when(F.col("doc_id") % 3 == 0, F.array(F.lit("y"), F.lit("x"))))
    mixed, plan = mixing.mix(df, F.col("sources"))
    assert set(plan.patterns) == {("x",), ("x", "y"), (None,)}
    assert abs(sum(r["taken"] for r in mixed.collect()) - sum(plan.targets.values())) < 200


def test_empty_and_repeated_rows(spark):
    df = documents(spark)
    mixed, plan = mixing.mix(df.limit(0), F.array("source"))
    assert mixing.with_targets(mixed, plan, "source").count() == 0
    twice = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, None, None)], "doc_id long, text string, source string")
    mixed, _ = mixing.mix(twice, F.array("source"))
    assert sorted(r["taken"] for r in mixed.collect()) == [0, 2, 2]


def test_a_long_document_early_in_the_order_stops_nothing(spark):
    rng = random.Random(5)
    sizes = {0: [5184] + [rng.randint(1, 200) for _ in range(180)], 1: [60_000]}
    rows = [(i, " ".join(["w"] * n), f"s{s}") for s, own in sizes.items() for i, n in enumerate(own)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for seed in range(6):
        mixed, plan = mixing.mix(df, F.array("source"), weights=(1, 2), seed=seed)
        own = mixed.where("source = 's0'").collect()
        gap = plan.targets["s0"] - sum(r["taken"] for r in own)
        base = min(r["copies"] for r in own)
        assert gap < 20 and all(r["size"] > gap - 1 for r in own if r["copies"] == base)  # targets are rounded to words


def test_buckets_that_do_not_fit_are_split(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    monkeypatch.setattr(mixing, "SPLIT", 50)
    df = documents(spark)
    mixed, plan = mixing.mix(df.union(df.limit(40)), F.array("source"))
    rows = mixing.with_targets(mixed, plan, "source").collect()
    for source in ("s0", "s1", "s2", None):
        own = [r for r in rows if r["source"] == source]
        gap = own[0]["target"] - sum(r["taken"] for r in own)
        base = min(r["copies"] for r in own if r["size"])
        together = {}
        for r in own:
            together[r["doc_id"]] = together.get(r["doc_id"], 0) + r["size"]
        assert abs(gap) < 20 and all(together[r["doc_id"]] > gap - 1 for r in own if r["size"] and r["copies"] == base)
    copies = {}
    assert all(copies.setdefault(r["doc_id"], r["copies"]) == r["copies"] for r in rows)


def test_many_patterns_and_a_slow_flow_agree(spark):
    rng = random.Random(12)
    for _ in range(40):
        names = "abcde"[: rng.randint(2, 5)]
        sizes = {tuple(sorted(rng.sample(names, rng.randint(1, min(3, len(names)))))): rng.randint(0, 6) for _ in range(rng.randint(1, 6))}
        quotas = {s: rng.randint(0, 20) for s in names}
        given = mixing.flow(sizes, quotas)
        used = {p: sum(v for (q, _), v in given.items() if q == p) for p in sizes}
        assert all(v >= 0 for v in given.values()) and all(sum(v for (_, s), v in given.items() if s == x) <= quotas[x] for x in quotas) and all(used[p] <= 3 * sizes[p] for p in sizes)
        assert (sum(used.values()), sum(cost(used[p], sizes[p]) for p in sizes)) == unit_flow(sizes, quotas)


def unit_flow(sizes, quotas):
    """Words and cost of a cheapest largest flow, one word at a time along a cheapest path found by Bellman and Ford."""
    arcs = []  # from, to, capacity, cost
    for p, n in sizes.items():
        arcs += [["start", p, n, c] for c in mixing.REPEAT_COSTS] + [[p, s, 99, 0] for s in p]
    arcs += [[s, "end", q, 0] for s, q in quotas.items()]
    arcs = [x for a, b, c, w in arcs for x in ([a, b, c, w], [b, a, 0, -w])]
    words = total = 0
    while True:
        far, via = {"start": 0}, {}
        for _ in range(len(sizes) + len(quotas) + 2):
            for i, (a, b, c, w) in enumerate(arcs):
                if c and a in far and far[a] + w < far.get(b, 10**9):
                    far[b], via[b] = far[a] + w, i
        if "end" not in far:
            return words, total
        x = "end"
        while x != "start":
            arcs[via[x]][2] -= 1
            arcs[via[x] ^ 1][2] += 1
            x = arcs[via[x]][0]
        words, total = words + 1, total + far["end"]


def test_flow_of_many_patterns_is_quick():
    rng = random.Random(2)
    single = {(f"s{i}",): rng.randint(1, 1000) for i in range(100_000)}
    mixed = {tuple(sorted({f"m{rng.randint(0, 3000)}" for _ in range(3)})): rng.randint(1, 1000) for _ in range(20_000)}
    patterns = single | mixed
    quotas = {s: rng.randint(1, 3000) for p in patterns for s in p}
    began = time.time()
    given = mixing.flow(patterns, quotas)
    assert time.time() - began < 60 and sum(given.values()) > 0


def test_clashing_names_and_patterns_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_PATTERNS", 1)
    df = documents(spark, 400).withColumns({"_pattern": F.lit(1), "_key": F.lit(2), "_row": F.lit(3), "source_name": F.lit(4), "target": F.lit(5)})
    mixed, plan = mixing.mix(df, F.array("source"))
    rows = mixing.with_targets(mixed, plan, "source").collect()
    assert len(rows) == 400 and all((r["_pattern"], r["_key"], r["_row"], r["source_name"]) == (1, 2, 3, 4) and r["target"] == plan.targets[r["source"]] for r in rows)
