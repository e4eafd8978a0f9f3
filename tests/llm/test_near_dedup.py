import random
import time
from collections import defaultdict

import numpy as np
import pytest

from gridmark.llm import near_dedup


def brute(rows, width):
    """component by row number, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        sets.append(frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(i)
    out = {}
    for group in members.values():
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out[i] = (len(sets[i]), min(ids, default=None))
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(8):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text))
    rows += [" ".join(passage + [word() for _ in range(40)]) for _ in range(20)]
    chain = [word() for _ in range(80)]
    for k in range(50):  # each text is near the next one, not near those far away
        chain = chain[2:] + [word(), word()]
        rows.append(" ".join(chain))
    rows += [rows[0], rows[0].upper(), rows[5], "", None, " \n", "one two", "one two", "ONE two", "three"]
    rng.shuffle(rows)
    return [(i * 7 % 1000 if i % 11 else None, t) for i, t in enumerate(rows)]


def check(spark, rows, width):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int")
    key = lambda x: repr(x)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, width=width).collect()), key=key)
    found = brute(rows, width)
    want = sorted(((d, found[i][0], found[i][1] if found[i][0] else d) for i, (d, _) in enumerate(rows)), key=key)
    assert got == want


def test_components_equal_brute_force(spark):
    check(spark, corpus(), 4)


def test_large_groups_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 3)
    monkeypatch.setattr(near_dedup, "BLOCK_NODES", 8)
    check(spark, corpus(5), 5)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(df).count() == 0
    assert near_dedup.deduplicated(df).count() == 0
    assert [tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame([(4, "a b")], "doc_id long, text string")).collect()] == [(4, 1, 4, True)]


def test_one_row_of_each_component_stays(spark):
    rows = corpus(9)
    df = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, source string")
    kept = near_dedup.deduplicated(df, width=5).collect()
    found = brute(rows, 5)
    full = [i for i in found if found[i][0]]
    sets = {}
    assert len([r for r in kept if (r["text"] or "").split()]) == len({tuple(sorted(j for j in full if same(found, rows, i, j, sets))) for i in full})
    assert len([r for r in kept if not (r["text"] or "").split()]) == len(rows) - len(full)


def same(found, rows, i, j, memo):
    """Whether two rows are of one component, by a second run of the brute force that keeps the roots."""
    if not memo:
        ids = [(k, t) for k, (_, t) in enumerate(rows)]
        memo.update({k: v[1] for k, v in brute(ids, 5).items()})
    return memo[i] == memo[j]


def test_chunks_of_all_pairs_within_the_distance_meet():
    rng = np.random.default_rng(1)
    sig = rng.integers(0, 1 << 16, near_dedup.SYMBOLS).astype(np.uint16)
    for _ in range(200):
        other = sig.copy()
        at = rng.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)
        other[at] ^= 1
        keys = near_dedup._key_table(np.stack([sig, other]))
        shared = np.flatnonzero(keys[0] == keys[1])
        assert len(shared) and near_dedup._first_key((sig != other)[None])[0] == shared[0]


def test_similarity_below_the_range_is_refused(spark):
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), percent=50)


def test_null_ids_cost_what_ids_cost(spark):
    """Pairs of near-equal texts, without ids and under one repeated id: rows are joined by id and text, never by id alone."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(5))
    texts = []
    for _ in range(1000):
        base = [word() for _ in range(80)]
        texts += [" ".join(base), " ".join(base[:79] + [word()])]
    times, kept = {}, {}
    for name, ident in (("ids", lambda i: i), ("null", lambda i: None), ("same", lambda i: 7)):
        df = spark.createDataFrame([(ident(i), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
        began = time.time()
        rows = near_dedup.deduplicated(df, width=4)
        kept[name] = rows.count()
        times[name] = time.time() - began
    assert set(kept.values()) == {1000}
    assert max(times["null"], times["same"]) < 2 * times["ids"] + 5
