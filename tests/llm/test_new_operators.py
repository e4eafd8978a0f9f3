import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridmark.llm import divergence, embedding_dedup, resampling, runs
from gridmark.llm.flat import text_bytes
from gridmark.llm.oracles import ORACLES
from gridmark.llm.queries import QUERIES

from ..compare import assert_equal, tables

CLUSTERED = "/root/testdata/check_s/embeddings.parquet"
NAMES = "op11_resampling", "op12_divergence", "op13_embedding_dedup"


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    assert_equal(QUERIES[name](spark, "/root/testdata/sf0.01"), tables("/root/testdata/sf0.01"), ORACLES[name])


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, name, tmp_path):
    for table in ("documents", "benchmark", "embeddings"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def grams(text):
    w = words(text)
    return Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1))


TEXTS = ["", None, "One", "one two", "a-b_c d9 ÉCOLE école", "x" * 5000 + " " + "Y" * 129 + " z" + "é" * 300, "word " * 40, "b" * 127 + " " + "c" * 128, *(" ".join(f"w{i % (k + 2)}" for i in range(k)) for k in range(15, 60, 5))]


def test_features():
    data, offsets = text_bytes(pa.array(TEXTS, pa.string()))
    found, at, n = resampling.features(data, offsets)
    for i, text in enumerate(TEXTS):
        assert Counter(found[at[i] : at[i + 1]].tolist()) == grams(text) and n[i] == len(words(text))


def test_resample_by_brute_force(spark):
    rows = [(i if i % 9 else None, t, "clash", 7) for i, t in enumerate([*TEXTS, *TEXTS[6:], *TEXTS[8:]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, weight string, copies int").repartition(5)
    target = spark.createDataFrame([("w1 w2 w3 w4",), (None,), ("one",)], "text string")
    source, goal = Counter(), Counter()
    for r in rows:
        source.update(grams(r[1]))
    for t in ("w1 w2 w3 w4", "one"):
        goal.update(grams(t))
    s, t = sum(source.values()) + 10_000, sum(goal.values()) + 10_000
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * s / ((source[b] + 1) * t))) for b in source}
    want = []
    for i, text, *_ in rows:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * n for b, n in grams(text).items())
        want.append((i, sum(grams(text).values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(text))))
    full = sorted((r for r in want if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(full) * 30 // 100
    got = resampling.resample(docs, target, percent=30).collect()
    assert sorted((r["doc_id"], r["n_features"], r["weight"], r["score"], r["n_words"]) for r in got if r["doc_id"] is not None) == sorted(r for r in want if r[0] is not None)
    assert Counter(r["weight"] for r in got) == Counter(r[2] for r in want)
    top = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in top] == list(range(1, drawn + 1)) and [r["score"] for r in top] == [r[3] for r in full[:drawn]]
    assert resampling.resample(docs, target.limit(0)).count() == len(rows)


def test_equal_texts_are_featured_once(spark):
    docs = spark.createDataFrame([(i, "same text again") for i in range(300)] + [(300, None), (301, "")], "doc_id long, text string").repartition(6)
    kept = resampling.texts(docs).collect()
    assert sorted((r["copies"], r["n_features"]) for r in kept) == [(2, 0), (300, 6)]


def audit(rows, least=3, top=200):
    docs = [(a or "", b or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in own for t in d[2])
        kept = {t for t, n in seen.items() if n >= least}
        count = {s: Counter() for s in {d[1] for d in own}}
        for _, s, words_ in own:
            count[s].update({t: n for t, n in words_.items() if t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // y
        for s in p:
            pairs = [("pair", o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in p if o != s]
            terms = [("term", t, f(p[s][t], q[t])) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, most in ((pairs, None), (terms, top)):
                ranked = sorted(part, key=lambda x: (-x[2], x[1].encode()))[:most]
                out += [(lang, s, *x, k) for k, x in enumerate(ranked, 1)]
    return sorted(out)


@pytest.mark.parametrize("pairs", [1 << 20, 7])
def test_audit_by_brute_force(spark, monkeypatch, pairs):
    rng = random.Random(5)
    letters = ["ab", "Cd", "é", "ü", "日本", "x", "yy", "zzz", "rare", "Ab1cd"]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "ß", None]), " ".join(rng.choices(letters[: rng.randint(1, 10)], k=rng.randint(0, 30)))) for _ in range(80)]
    rows += [("xx", "a", "only twice"), ("xx", "b", None), ("xx", "b", "only twice"), ("yy", "alone", ""), *[("en", "s1", "hot hot hot")] * 60, ("en", "bare", "1 2 3")]
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(7)
    got = divergence.audit(docs).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got) == audit(rows)
    few = divergence.audit(docs, top=2).where("part = 'term'").groupBy("lang", "source").count().collect()
    assert max(r["count"] for r in few) == 2


def test_exact_shares():
    count, whole = np.array([0, 1, 10**14, 3 * 10**15, 7]), np.array([1, 7, 10**14 + 5, 4 * 10**15, 8 * 10**14])
    assert divergence.shares(count, whole).tolist() == [1 + 10**9 * (c + 1) // w for c, w in zip(count.tolist(), whole.tolist(), strict=True)]


def test_runs_over_batches():
    rng = random.Random(2)
    rows = sorted((rng.choice("abcd"), rng.choice("xy"), rng.randint(0, 9)) for _ in range(300))
    table = pa.table({"k": [r[0] for r in rows], "l": [r[1] for r in rows], "v": [r[2] for r in rows]})
    for size in (1, 3, 50, 1000):
        batches = [table.slice(0, 0).combine_chunks().to_batches() or [], *([b] for b in table.to_batches(max_chunksize=size))]
        flat = [b for part in batches for b in part]
        want = Counter()
        for k, v, n in rows:
            want[k, v] += n
        assert [(r["k"], r["l"], r["v"]) for b in runs.summed(iter(flat), ["k", "l"], ["v"]) for r in b.to_pylist()] == [(*k, n) for k, n in sorted(want.items())]
        wholes = list(runs.whole(iter(flat), ["k"]))
        assert pa.concat_tables(wholes).equals(table.combine_chunks()) or pa.concat_tables(wholes).to_pylist() == table.to_pylist()
        assert [len(set(t["k"].to_pylist())) for t in wholes] and sum(len(set(t["k"].to_pylist())) for t in wholes) == 4


def linked(rows, threshold=0.98):
    def unit(v):
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        return embedding_dedup.unit(np.array([v], float))[0] if ok else None

    unit_of, parent, links = [unit(r[2]) if r[1] is not None else None for r in rows], list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = unit_of[i], unit_of[j]
            if a is not None and b is not None and rows[i][1] == rows[j][1] and len(a) == len(b) and a @ b >= threshold:
                parent[find(i)] = find(j)
                links[i] += 1
                links[j] += 1
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)].append(r[0])
    return sorted(((r[0], links[i], min(ids[find(i)], default=None)) for i, r in enumerate(rows)), key=repr)


def vectors(rng, d, n, spread):
    centre = rng.standard_normal((n // 4, d))
    return [(centre[rng.integers(len(centre))] + rng.standard_normal(d) * spread / math.sqrt(d)).tolist() for _ in range(n)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_by_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "WIDE_BLOCK", 24)
    rng = np.random.default_rng(4)
    rows = [(int(i), int(rng.integers(3)), v) for i, v in enumerate(vectors(rng, 48, 260, 0.9))]
    hot = rng.standard_normal(48)
    rows += [(int(1000 + i), 1, (hot + rng.standard_normal(48) * 0.05).tolist()) for i in range(90)]  # one key, many blocks
    rows += [(2000 + i, 2, rows[3][2]) for i in range(40)] + [(3000, 2, [2 * x for x in rows[3][2]]), (3001, 2, [-x for x in rows[3][2]])]
    bad = [None, [], [0.0] * 48, [float("nan")] + [1.0] * 47, [float("inf")] * 48, [None, *[1.0] * 47]]
    rows += [(4000 + i, 2, v) for i, v in enumerate([*bad, *bad])] + [(5000, None, rows[0][2]), (5001, None, rows[0][2]), (5002, 0, [1.0, 2.0]), (5003, 0, [1.0, 2.01]), (5004, 1, [7.0]), (5005, 1, [3.0]), (5006, 1, [-3.0])]
    rows += [(None, 2, rows[3][2]), (None, 0, [9.0, 1.0]), (7, 1, rows[-1][2]), (7, 1, rows[-1][2]), (6000, 1, [1e30, 1e-30, 1e30]), (6001, 1, [1e30, 1e30, 1e30])]
    rows = [(i, label, v and [None if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows]
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], f"vec_id long, label int, embedding array<{kind}>, digest string, node int").repartition(5)
    got = embedding_dedup.near_duplicates(df).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=repr) == linked(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_recall_against_all_pairs(spark):
    if not Path(CLUSTERED).exists():
        pytest.skip("needs a table with near copies")
    df = spark.read.parquet(CLUSTERED)
    rows = df.toPandas()
    unit = embedding_dedup.unit(np.stack(rows["embedding"]).astype(float))
    want = np.zeros(len(rows), int)
    for label in rows["label"].unique():
        own = np.flatnonzero(rows["label"] == label)
        near = unit[own] @ unit[own].T >= 0.98
        want[own] = near.sum(1) - 1
    got = embedding_dedup.near_duplicates(df).toPandas().set_index("vec_id")["n_links"]
    found = got.loc[rows["vec_id"]].to_numpy()
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum()


def test_rotations_balance_bits_and_keep_neighbours():
    rng = np.random.default_rng(1)
    x = embedding_dedup.unit(rng.standard_normal((3000, 64)) + 0.5)
    mean, planes = embedding_dedup.learn(x)
    bits = (x - mean) @ planes >= 0
    assert np.abs(bits.mean(0) - 0.5).max() < 0.1
    turned = planes[:, :64]
    assert np.allclose(turned.T @ turned, np.eye(64))
    lost = lambda r: ((np.where((x - mean) @ r >= 0, 1, -1) / 8 - (x - mean) @ r) ** 2).sum()
    plain = np.linalg.qr(np.random.default_rng(0).standard_normal((64, 64)))[0]
    assert lost(turned) < lost(plain)
    near = embedding_dedup.unit(x[:500] + 0.1 * embedding_dedup.unit(rng.standard_normal((500, 64))))
    model = {64: (mean, planes)}
    assert (embedding_dedup.codes(model, x[:500]) == embedding_dedup.codes(model, near)).any(1).all()


def test_no_null_id_multiplies_rows(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("vec_id"), F.lit(1).alias("label"), F.array(*(F.rand(k).cast("float") for k in range(8))).alias("embedding"))
    assert embedding_dedup.near_duplicates(rows).count() == 3000
