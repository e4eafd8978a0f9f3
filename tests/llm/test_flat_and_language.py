import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridmark.llm import flat, language_id

TEXTS = ["", None, "a", "der die das", "x" * 5000, "é ñ 日本", " \n\t", "ab\x0bcd"]


def test_spans_and_hashes_follow_words():
    data, offsets = flat.text_bytes(pa.array(TEXTS))
    starts, ends = flat.spans(data, offsets, flat.white())
    words = [bytes(data[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == [w for t in TEXTS for w in (t or "").split()]
    hashes = flat.span_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words))
    again, at = flat.text_bytes(pa.array(["zz der", "die das"]))
    found = dict(zip(words, hashes.tolist()))
    s, e = flat.spans(again, at, flat.white())
    assert [found.get(w) for w in ("der", "die", "das")] == flat.span_hashes(again, s, e).tolist()[1:]


def test_groups_cover_long_texts():
    offsets = np.array([0, 3, 3, 100, 101, 150])
    runs = list(flat.groups(offsets, 50))
    assert [i for a, b in runs for i in range(a, b)] == list(range(5))
    assert all(b == a + 1 or offsets[b] - offsets[a] <= 50 for a, b in runs)


def plain_ppm(train, text):
    """Code length in bits of a text under method C with exclusion, orders 3 to 0, written byte by byte."""
    counts = [defaultdict(Counter) for _ in range(4)]
    for t in train:
        raw = [0, 0, 0, *(b + 1 for b in t.encode())]
        for i in range(3, len(raw)):
            for k in range(4):
                counts[k][tuple(raw[i - k : i])][raw[i]] += 1
    weight = {c: sum(n.values()) for c, n in counts[3].items()}
    raw, total = [0, 0, 0, *(b + 1 for b in text.encode())], 0.0
    for i in range(3, len(raw)):
        orders = (3, 2, 1, 0) if weight.get(tuple(raw[i - 3 : i]), 0) >= 8 else (2, 1, 0)
        escape, seen, p = 1.0, set(), None
        for k in orders:
            c = {s: n for s, n in counts[k][tuple(raw[i - k : i])].items() if s not in seen}
            n, d = sum(c.values()), len(c)
            if not n:
                continue
            if raw[i] in c:
                p = escape * c[raw[i]] / (n + d)
                break
            escape *= d / (n + d)
            seen |= set(c)
        total -= math.log2(p if p is not None else escape / (256 - len(seen)))
    return total


def test_code_lengths_equal_a_plain_model(spark):
    train = ["the cat sat on the mat the cat sat " * 3, "a cat and a hat, the hat"]
    df = spark.createDataFrame([(t, "en") for t in train], "text string, lang string")
    model = language_id.train(df)
    probes = ["the cat", "", "zebra é!", "the mat sat on the hat " * 40, "a"]
    data, offsets = flat.text_bytes(pa.array(probes))
    got = language_id.code_lengths(model, data, offsets)[:, 0] / language_id.UNIT
    for t, bits in zip(probes, got):
        assert bits == pytest.approx(plain_ppm(train, t), abs=0.001 * (len(t.encode()) + 1))


def test_blocks_change_nothing(spark, monkeypatch):
    df = spark.createDataFrame([("der hund und die katze", "de"), ("le chat et le chien", "fr")], "text string, lang string")
    model = language_id.train(df)
    data, offsets = flat.text_bytes(pa.array(["der hund", "", "x", "le chien et la katze" * 9, "und"]))
    whole = language_id.code_lengths(model, data, offsets)
    monkeypatch.setattr(language_id, "BLOCK", 7)
    assert (language_id.code_lengths(model, data, offsets) == whole).all()


def test_edges(spark):
    rows = [(1, "der hund", "de", "x"), (1, "der hund", "de", "x"), (None, None, None, None), (2, "", "de", "x"), (3, "12 34 !", "fr", "x"), (4, "le chat", "fr", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = language_id.train(df)
    out = df.select("doc_id", language_id.identify(model, spark, "text").alias("g")).select("doc_id", "g.*").collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in out] == [(1, "de"), (1, "de"), (None, "und"), (2, "und"), (3, "und"), (4, "fr")]
    assert all(0 <= r["score"] <= 1 for r in out)
    empty = language_id.train(df.limit(0))
    assert {r[0] for r in df.select(language_id.identify(empty, spark, "text")["lang_pred"]).collect()} == {"und"}
    assert df.limit(0).select(language_id.identify(model, spark, "text")).count() == 0


def test_held_out_accuracy(spark):
    from gridmark.llm.queries import op1_language_id

    sf = "/root/testdata/sf0.01"
    out = op1_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_the_model_is_bounded_over_all_languages(spark):
    alphabets = [chr(0x4E00 + 3 * k) + chr(0x4E01 + 3 * k) + chr(0x4E02 + 3 * k) for k in range(70)]  # letters all
    text = lambda k, seed: " ".join("".join(alphabets[k][(i * seed + j) % 3] for j in range(4)) for i in range(60))
    df = spark.createDataFrame([(text(k, 5), f"l{k:02d}") for k in range(70)], "text string, lang string")
    probes = spark.createDataFrame([(k, text(k, 7)[:80]) for k in range(70)], "k int, text string")
    for cells in (100_000, 16_000_000):
        model = language_id.train(df, most_cells=cells)
        assert sum(c.size for c in model.cost) <= cells and model.node.dtype == np.uint16
        assert all(r["p"] == f"l{r['k']:02d}" for r in probes.select("k", language_id.identify(model, spark, "text")["lang_pred"].alias("p")).collect())


def test_a_language_of_one_long_text_is_learned(spark):
    df = spark.createDataFrame([("aaa bbb " * 40_000, "long"), *((f"ccc ddd {i}", "short") for i in range(50))], "text string, lang string")
    model = language_id.train(df, sample_bytes=200)
    assert model.languages == ("long", "short")
    probes = spark.createDataFrame([("bbb aaa bbb",), ("ddd ccc",)], "text string")
    assert [r[0] for r in probes.select(language_id.identify(model, spark, "text")["lang_pred"]).collect()] == ["long", "short"]


def test_limits_joined_give_the_model_of_limits_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(f"der hund {i} und die katze", "de") for i in range(40)] + [("le chat", "fr"), (None, "es"), ("", "it"), ("x", None)], "text string, lang string")
    whole = language_id.train(df, sample_bytes=300)
    monkeypatch.setattr(language_id, "BROADCAST_LANGUAGES", 0)
    again = language_id.train(df, sample_bytes=300)
    assert whole.languages == again.languages == ("de", "fr")
    assert all((a == b).all() for a, b in zip(whole.cost, again.cost)) and (whole.node == again.node).all()
