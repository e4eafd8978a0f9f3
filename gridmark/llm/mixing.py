"""Mixing sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are aggregated by membership pattern (the sorted set of their
sources); the flow network has an arc from the start to each pattern for each repetition, with the pattern's words as
capacity and a convex cost (the first use is free, every further one dearer), arcs from a pattern to its sources, and
arcs from the sources to the end that hold the source's target words.  The cheapest largest flow says how many words
every pattern gives to which source.  Documents are then selected within each pattern: every document is taken
floor(flow / words) times, and what is left goes once more to documents in seeded order: to every hash bucket (16,384
a pattern) that fits what the ones before it left, then to documents of buckets that don't fit, a few buckets a round,
until no document fits that isn't selected; at last to the bucket that comes closest, if one does.

Targets: sources by code point, null last, get weights in rotation; a target stops at ``most_repeats`` times its
source's words and the excess is shared again by weight among the others.

The driver holds one row for each pattern; the flow's time is near-linear in them.  The result's thresholds are
broadcast for ``BROADCAST_PATTERNS`` patterns or fewer, else joined as Spark plans it.  Document rows meet partial
aggregation only, so a hot source is no hot task.  Null texts and texts without words have size 0; null ids and
repeated rows are documents like others, equal rows fare alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .quality_rules import WORD
from .store import settled, unused

BUCKETS = 1 << 14
#: Documents (more or less) of a pattern whose buckets are split in one round.
SPLIT = 1024
#: Patterns up to which the tables of thresholds (about 2 KB a pattern) are broadcast; with more, Spark plans the joins.
BROADCAST_PATTERNS = 4096
#: Weights in rotation, and what a document's first, second and third use cost.
WEIGHTS, REPEAT_COSTS = (5, 2, 1), (0, 1, 3)

Pattern = tuple[str | None, ...]


def size(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most_repeats: int = len(REPEAT_COSTS)) -> dict[str | None, float]:
    """Each source's target words; they sum to all sizes."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, free = {}, float(sum(sizes.values())), list(order)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most_repeats * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = float(most_repeats * sizes[s])
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


class _Network:
    """A flow network from node 0 to node 1; arcs in pairs, the reverse of arc i is i ^ 1."""

    def __init__(self, nodes: int):
        self.to, self.left, self.out = [], [], [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
        return len(self.to) - 2

    def fill(self) -> None:
        """Raises the flow to a largest one: blocking flows in layers by distance."""
        while True:
            depth, layer = [-1] * len(self.out), [0]
            depth[0] = 0
            for x in layer:
                for i in self.out[x]:
                    if self.left[i] and depth[self.to[i]] < 0:
                        depth[self.to[i]] = depth[x] + 1
                        layer.append(self.to[i])
            if depth[1] < 0:
                return
            at, path, x = [0] * len(self.out), [], 0
            while True:
                if x == 1:
                    push = min(self.left[i] for i in path)
                    for i in path:
                        self.left[i] -= push
                        self.left[i ^ 1] += push
                    keep = next(k for k, i in enumerate(path) if not self.left[i])
                    x = self.to[path[keep] ^ 1]
                    del path[keep:]
                while at[x] < len(self.out[x]):
                    i = self.out[x][at[x]]
                    if self.left[i] and depth[self.to[i]] == depth[x] + 1:
                        break
                    at[x] += 1
                else:
                    if not path:
                        break
                    x = self.to[path.pop() ^ 1]
                    at[x] += 1
                    continue
                path.append(i)
                x = self.to[i]


def flow(patterns: dict[Pattern, int], quotas: dict[str | None, int], costs: tuple[int, ...] = REPEAT_COSTS) -> dict[tuple[Pattern, str | None], int]:
    """Words that each pattern gives to each of its sources: a largest flow of least cost.  Ties fall by the order of
    the input.

    Only arcs from the start have costs, and use k costs the same in every pattern, never less than use k - 1.  So a
    shortest augmenting path is one that begins with the cheapest use left, and successive shortest paths are largest
    flows with the first uses alone, then with the second ones added, and so on.  Patterns of one source that no
    overlapping pattern touches give the least of all their uses and the quota.
    """
    if list(costs) != sorted(costs):
        raise ValueError("later uses must not be cheaper")
    touched = {s for p in patterns if len(p) > 1 for s in p}
    given = {(p, p[0]): min(words * len(costs), quotas[p[0]]) for p, words in patterns.items() if len(p) == 1 and p[0] not in touched}
    mixed = {p: words for p, words in patterns.items() if touched.intersection(p)}
    sources = {s: 2 + len(mixed) + i for i, s in enumerate(s for s in quotas if s in touched)}
    net = _Network(2 + len(mixed) + len(sources))
    uses = [net.arc(0, 2 + i, 0) for i in range(len(mixed))]
    gives = {(p, s): net.arc(2 + i, sources[s], words * len(costs)) for i, (p, words) in enumerate(mixed.items()) for s in p}
    for s, node in sources.items():
        net.arc(node, 1, quotas[s])
    for _ in costs:
        for use, words in zip(uses, mixed.values(), strict=True):
            net.left[use] += words
        net.fill()
    return given | {key: net.left[i ^ 1] for key, i in gives.items()}


@dataclass(frozen=True)
class Plan:
    """Per source: words and target; per pattern and source: words given; per pattern: words."""

    sizes: dict[str | None, int]
    targets: dict[str | None, float]
    given: dict[tuple[Pattern, str | None], int]
    patterns: dict[Pattern, int]


def first_fit(sizes: list[int], gap: int) -> tuple[list[int], int]:
    """Places of the sizes that are taken in order, each if it fits what is left, and what stays."""
    taken = []
    for i, n in enumerate(sizes):
        if n <= gap:
            taken.append(i)
            gap -= n
    return taken, gap


def _fill(column: str) -> Callable[[pa.Table], pa.Table]:
    """One pattern's rows (at most one a bucket, or the documents of a round) to the selected values of ``column``."""

    def filled(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(column)
        taken, gap = first_fit(rows["n"].to_pylist(), rows["_gap"][0].as_py())
        at = rows[column].to_numpy()[taken]
        if column == "_bucket":
            words = np.zeros(max(1, BUCKETS >> 6), np.uint64)
            np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            at = words.view(np.int64)
        return pa.table({"_pattern": rows["_pattern"][:1], "_taken": pa.array([at.tolist()], pa.list_(pa.int64())), "_gap": pa.array([gap], pa.int64())})

    return filled


def mix(df: DataFrame, sources: Column, doc_col: str = "doc_id", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, costs: tuple[int, ...] = REPEAT_COSTS, seed: int = 0) -> tuple[DataFrame, Plan]:
    """``df`` with size, copies and taken = copies * size, and the plan behind it.

    ``sources``: array column of a document's sources (null is a source of its own; an empty or null array counts as
    the null source).  The seeded order is by hash of (doc id, text), so reruns agree whatever the partitions, and
    repeated rows fare alike.  Documents without words are taken as often as their pattern's floor says.
    """
    spark = df.sparkSession
    members = F.array_sort(F.array_distinct(F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, sources).otherwise(F.array(F.lit(None).cast("string")))))
    key = F.xxhash64(F.lit(seed), doc_col, text_col)
    keyed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(text_col).alias("_text"), members.alias("_members"), F.to_json(members).alias("_pattern"), key.alias("_key"))
    keyed = keyed.withColumn("_bucket", F.shiftrightunsigned("_key", 65 - BUCKETS.bit_length()).cast("int"))
    rows = keyed.withColumn("size", size(F.col("_text")))
    worded = F.when(F.col("size") > 0, F.col("_key"))
    buckets = rows.groupBy("_pattern", "_bucket").agg(F.sum("size").alias("n"), F.first("_members").alias("members"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"), (F.min(worded) < F.max(worded)).alias("several"))
    buckets = settled(buckets)  # small (patterns times buckets), and used three times
    found = buckets.groupBy("_pattern").agg(F.first("members").alias("members"), F.sum("n").alias("n")).orderBy("_pattern").collect()
    small = (lambda table: F.broadcast(table)) if len(found) <= BROADCAST_PATTERNS else (lambda table: table)
    patterns = {tuple(r["members"]): r["n"] for r in found}
    sizes: dict[str | None, int] = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    goal = targets({s: n for s, n in sizes.items()}, weights, len(costs))
    scale = sum(patterns.values()) / max(1, sum(sizes.values()))  # overlapping sources count their documents twice
    goal = {s: t * scale for s, t in goal.items()}
    given = flow(patterns, {s: round(t) for s, t in goal.items()}, costs)
    parts = []
    for r in found:
        p, n = tuple(r["members"]), r["n"]
        words = sum(given[p, s] for s in p)
        base = min(len(costs), words // n) if n else 0
        parts.append((r["_pattern"], base, words - base * n if base < len(costs) else 0))
    table = spark.createDataFrame([(p, rest) for p, _, rest in parts if rest], "_pattern string, _gap bigint")
    shape = "_pattern string, _taken array<bigint>, _gap bigint"
    filled = settled(buckets.where("n > 0").join(small(table), "_pattern").select("_pattern", "_bucket", "n", "_gap").groupBy("_pattern").applyInArrow(_fill("_bucket"), shape))
    inside = F.coalesce(F.getbit(F.get("_taken", F.shiftright("_bucket", 6)), F.col("_bucket").bitwiseAND(63)) == 1, F.lit(False))
    gap = {r["_pattern"]: r["_gap"] for r in filled.where("_gap > 0").select("_pattern", "_gap").collect()}
    free = buckets.where("n > 0").join(small(filled.drop("_gap")), "_pattern").where(~inside).drop("_taken")
    split, extra = defaultdict(list), defaultdict(list)

    def behind() -> DataFrame:
        now = spark.createDataFrame([(p, g, split[p]) for p, g in gap.items() if g], "_pattern string, _gap bigint, _split array<int>")
        return free.join(small(now), "_pattern").where(~F.array_contains("_split", F.col("_bucket")))

    while any(gap.values()):
        first = Window.partitionBy("_pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        rough = F.coalesce(F.sum(F.ceil(F.col("n") / F.col("least"))).over(first), F.lit(0))
        next_ones = behind().where("several AND least <= _gap").withColumn("_rough", rough).where(F.col("_rough") < SPLIT).select("_pattern", "_bucket", "_gap").collect()
        if not next_ones:
            break
        for r in next_ones:
            split[r["_pattern"]].append(r["_bucket"])
        chosen = spark.createDataFrame(next_ones, "_pattern string, _bucket int, _gap bigint")
        parted = keyed.join(F.broadcast(chosen), ["_pattern", "_bucket"]).withColumn("size", size(F.col("_text"))).where("size > 0")
        single = parted.groupBy("_pattern", "_key").agg(F.sum("size").alias("n"), F.first("_gap").alias("_gap")).where("n <= _gap")
        for r in single.groupBy("_pattern").applyInArrow(_fill("_key"), shape).collect():
            extra[r["_pattern"]] += r["_taken"]
            gap[r["_pattern"]] = r["_gap"]
    miss = F.abs(F.col("_gap") - F.col("n"))
    closest = defaultdict(lambda: -1)
    if any(gap.values()):
        for r in behind().where(miss < F.col("_gap")).groupBy("_pattern").agg(F.min(F.struct(miss.alias("miss"), "_bucket")).alias("m")).collect():
            closest[r["_pattern"]] = r["m"]["_bucket"]
    cuts = spark.createDataFrame([(p, b, closest[p], split[p], extra[p]) for p, b, _ in parts], "_pattern string, _base int, _closest int, _split array<int>, _extra array<bigint>")
    cuts = cuts.join(filled.drop("_gap"), "_pattern", "left")
    again = inside | (F.col("_bucket") == F.col("_closest")) | (F.array_contains("_split", F.col("_bucket")) & F.array_contains("_extra", F.col("_key")))
    out = rows.join(small(cuts), "_pattern", "left").withColumn("copies", F.col("_base") + again.cast("int"))
    kept = [F.col(f"_row.`{c}`") for c in df.columns if c not in ("size", "copies", "taken")]
    return out.select(*kept, "size", "copies", (F.col("copies") * F.col("size")).alias("taken")), Plan(dict(sizes), goal, given, patterns)


def with_targets(mixed: DataFrame, plan: Plan, source: str) -> DataFrame:
    """``mixed`` with source_size and target of the source in the column ``source``, columns of these names replaced.
    One row a source is broadcast, or joined as Spark plans it where they are many."""
    plain = mixed.drop("source_size", "target")
    name = unused(plain, "source_name")
    table = mixed.sparkSession.createDataFrame([(s, n, plan.targets[s]) for s, n in plan.sizes.items()], f"{name} string, source_size bigint, target double")
    table = F.broadcast(table) if len(plan.sizes) <= BROADCAST_PATTERNS else table
    return plain.join(table, F.col(source).eqNullSafe(F.col(name)), "left").drop(name)
