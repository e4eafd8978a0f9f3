import hashlib
import json
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gridmark.llm import flat, language_id, mixing, quality_model, quality_rules
from gridmark.llm.flat import text_bytes

from .test_native import repeated
from .test_near_dedup import brute

SF = "/root/testdata/sf0.01"


def test_held_out_scores(spark):
    from gridmark.llm.queries import op10_quality_model

    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality IS NOT NULL")
    rows = op10_quality_model(spark, SF).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_scores_do_not_depend_on_batches_and_edges():
    texts = ["good words here", "BAD!! BAD!! BAD!!", "", None, "x" * 3_000_000, "a b " * 10] * 10
    labels = np.array([1, 0, 1, 1, 0, 0] * 10)
    model = quality_model.fit(pa.array(texts), labels)
    whole = model.scores(*text_bytes(pa.array(texts)))
    single = [model.scores(*text_bytes(pa.array([t], pa.string())))[0] for t in texts[:6]]
    assert whole[:6].tolist() == single and whole[2] == whole[3]
    assert len(model.scores(*text_bytes(pa.array([], pa.string())))) == 0


def plain_score(model, text):
    """The score of a text, word by word in plain Python."""
    full, base = (1 << 64) - 1, 0x9E3779B97F4A7C15
    table = [int(x) for x in flat.byte_numbers(fold=True)]

    def bucket(word):
        h = sum(table[b] * pow(base, i, 1 << 64) for i, b in enumerate(word)) + len(word) & full
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & full
        h = (h ^ h >> 27) * 0x94D049BB133111EB & full
        return (h ^ h >> 31) % quality_model.BUCKETS

    words, forms = [], []
    for w in re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff \t-\r]+", (text or "").encode()):
        b = bucket(w)
        if re.match(rb"[A-Za-z\x80-\xff]", w):
            form = 2 if len(w) > 1 and 65 <= w[-1] <= 90 else 1 if 65 <= w[0] <= 90 else 0
        else:
            form = 3 if w[:1].isdigit() else 4
        forms.append(2 * form + (bool(words) and words[-1] == b))
        words.append(b)
    logit, n = model.offset, max(len(words), 1) * quality_model.UNIT
    for k in range(len(model.bias)):
        mean = (sum(int(model.by_word[k][b]) for b in words) + sum(int(model.by_form[k][f]) for f in forms)) / n
        logit += model.out[k] * math.tanh(mean + model.bias[k])
    return 1 / (1 + math.exp(-max(-60, min(60, logit / model.temperature))))


def test_scores_equal_a_plain_scorer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality_model.train(docs, labels)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(60).collect()] + ["", None, "é É Éa aÉ 12 12 !! !! Aa AA aA A", "\x0b x\x85y", "a" * 3000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", quality_model.score(model, spark, "text").alias("s")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain_score(model, text), abs=1e-9)


def test_no_labels_or_one_class(spark):
    assert quality_model.fit(pa.array([], pa.string()), np.zeros(0)).scores(*text_bytes(pa.array(["a"])))[0] == pytest.approx(0.5)
    one = quality_model.fit(pa.array(["a", "b"] * 20), np.ones(40))
    assert one.scores(*text_bytes(pa.array(["a"])))[0] > 0.9
    docs = spark.createDataFrame([(None, None, 1), (1, "a", 2)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 1), (1, 0)], "doc_id long, quality int")
    model = quality_model.train(docs, labels)
    assert docs.select(quality_model.score(model, spark, "text")).count() == 2


def test_word_vectors_cover_documents_outside_the_sample(spark):
    texts = [f"plain words number {i} here" for i in range(40)] + ["rareword beside unlabelled " * 3, "longest " + "farword nearword " * 5000, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality_model.train(docs, labels)
    for word in ("rareword", "farword"):
        data, offsets = text_bytes(pa.array([word]))
        assert model.by_word[:, quality_model.words(data, offsets)[0][0]].any()
    sums = np.zeros((quality_model.BUCKETS, quality_model.WIDTH), np.int64)
    quality_model.neighbour_sums(*text_bytes(pa.array(texts)), sums)
    assert np.array_equal(quality_model.word_vectors(docs), quality_model.normalised(sums))
    assert not quality_model.word_vectors(docs.limit(0)).any()
    index, slow = quality_model.index_vectors(quality_model.BUCKETS, 11), np.zeros_like(sums)
    for text in texts[:41]:
        own = quality_model.words(*text_bytes(pa.array([text])))[0]
        for i in range(len(own)):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(own):
                    slow[own[i]] += index[own[j]].astype(np.int64)
    sums[:] = 0
    quality_model.neighbour_sums(*text_bytes(pa.array(texts[:41])), sums)
    assert np.array_equal(sums, slow)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    edge = spark.createDataFrame([(9001, None, None, None, None), (None, "12 34", "en", "src0", 5), (9002, "", "en", None, 0), (9003, "12 34 56 " * 30, "en", "src0", 1)], docs.schema)
    rows = docs.union(edge).union(docs.limit(3)).withColumn("n", docs.doc_id)
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, "/root/testdata/sf0.001")
        rows = spark.createDataFrame(rows.collect(), rows.schema)
        sizes.append(rows.count())
        if name != "bpe":
            assert rows.columns == [*docs.columns, "n"]
        if name == "near_dedup":
            ids = [r["doc_id"] for r in rows.collect()]
            assert len(ids) == len(set(ids))
    assert 0 < sizes[2] <= sizes[1] <= sizes[0] <= docs.count() + 3
    assert set(rows.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_language_stage_equals_a_plain_model(spark):
    import corpus_pipeline

    docs = documents(spark)
    rows = docs.withColumn("out", language_id.held_out("doc_id", 3, 1)).collect()
    counts, total = defaultdict(lambda: [defaultdict(Counter) for _ in range(4)]), Counter()
    padded = lambda text: [0, 0, 0, *(b + 1 for b in text.encode())]
    for r in rows:
        if not r["out"] and r["lang"] is not None and r["text"]:
            raw = padded(r["text"])
            for i in range(3, len(raw)):
                total[tuple(raw[i - 3 : i])] += 1
                for k in range(4):
                    counts[r["lang"]][k][tuple(raw[i - k : i])][raw[i]] += 1

    def bits(lang, raw):
        out = 0.0
        for i in range(3, len(raw)):
            escape, seen, p = 1.0, set(), None
            for k in (3, 2, 1, 0) if total[tuple(raw[i - 3 : i])] >= language_id.LEAST else (2, 1, 0):
                c = {s: n for s, n in counts[lang][k].get(tuple(raw[i - k : i]), {}).items() if s not in seen}
                n, d = sum(c.values()), len(c)
                if n and raw[i] in c:
                    p = escape * c[raw[i]] / (n + d)
                    break
                if n:
                    escape *= d / (n + d)
                    seen |= set(c)
            out -= math.log2(p if p is not None else escape / (256 - len(seen)))
        return out

    stage = dict(corpus_pipeline.STAGES)["language_id"]
    kept = {r["doc_id"] for r in stage(spark, docs, "/root/testdata/sf0.001").collect()}
    checked = 0
    for r in [r for r in rows if r["text"] is None or len(r["text"]) < 1500][:90]:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert r["doc_id"] not in kept
            continue
        cost = sorted(bits(lang, padded(r["text"])) for lang in counts)
        score = 1 / sum(2 ** max(-64.0, cost[0] - c) for c in cost)
        if abs(score - corpus_pipeline.LEAST_SCORE) > 0.1:
            checked += 1
            assert (r["doc_id"] in kept) == (score >= corpus_pipeline.LEAST_SCORE)
    assert checked > 30


def plain_line_fails(line):
    words = re.findall(r"[^\x20\x09-\x0D]+", line)
    n = len(words)
    marks = max(sum(c in "#*$%&|<>" for c in line), len(re.findall(r"!!+|\?\?+", line)))
    furniture = n <= 25 and (sum(c in "»›•·" for c in line) >= 2 or any(p in line.lower() for p in quality_rules.BOILERPLATE))
    return n > 0 and (marks >= 0.3 * n or n >= 8 and sum(a == b for a, b in zip(words, words[1:])) >= 0.3 * n or furniture)


def test_quality_stage_equals_plain_rules(spark):
    import corpus_pipeline

    docs = documents(spark)
    want = {}
    for r in docs.collect():
        text = r["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = text.split("\n")
        lost = sum(len(x) for x in lines if plain_line_fails(x))
        if len(words) >= 20 and 100 * repeated(words) <= 30 * len(words) and lost <= 0.3 * len(text):
            want[r["doc_id"]] = "\n".join(x for x in lines if not plain_line_fails(x))
    got = dict(corpus_pipeline.STAGES)["quality_rules"](spark, docs, "").collect()
    assert {r["doc_id"]: r["text"] for r in got} == want and all(r["n_chars"] == len(r["text"]) for r in got)


def test_dedup_stage_equals_all_pairs(spark):
    import corpus_pipeline

    docs = documents(spark).withColumns({"root": quality_model.F.lit(1), "md5": quality_model.F.lit(2), "_key": quality_model.F.lit(3)})
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = brute(rows, 5)
    want = sorted(d for i, (d, _) in enumerate(rows) if not found[i][0] or found[i][1] == d)
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in got) == want and all((r["root"], r["md5"], r["_key"]) == (1, 2, 3) for r in got)


def test_mixing_stage_takes_what_the_flow_gives(spark, tmp_path):
    import corpus_pipeline

    docs = documents(spark)
    docs.union(docs.limit(40).withColumns({"doc_id": docs.doc_id + 5000, "source": quality_model.F.lit("twin")})).write.parquet(str(tmp_path / "documents.parquet"))
    everything = spark.read.parquet(str(tmp_path / "documents.parquet")).collect()
    sources = defaultdict(set)
    for r in everything:
        if r["text"]:
            sources[r["text"]].add(r["source"])
    order = lambda s: (s is None, s or "")
    pattern = {r["doc_id"]: tuple(sorted(sources[r["text"]] if r["text"] else {r["source"]}, key=order)) for r in everything}
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in everything}
    kept = docs.collect()
    words, sizes = Counter(), Counter()
    for r in kept:
        words[pattern[r["doc_id"]]] += size[r["doc_id"]]
    for p, n in words.items():
        for s in p:
            sizes[s] += n
    goal = mixing.targets(dict(sizes))
    scale = sum(words.values()) / sum(sizes.values())
    ordered = sorted(words, key=lambda p: json.dumps(p, separators=(",", ":")))
    given = mixing.flow({p: words[p] for p in ordered}, {s: round(t * scale) for s, t in goal.items()})
    taken = Counter()
    for r in dict(corpus_pipeline.STAGES)["mixing"](spark, docs, str(tmp_path)).collect():
        taken[pattern[r["doc_id"]]] += size[r["doc_id"]]
    assert any(len(p) > 1 for p in words)
    for p in words:
        largest = max(size[r["doc_id"]] for r in kept if pattern[r["doc_id"]] == p)
        assert abs(taken[p] - sum(given[p, s] for s in p)) <= largest


def test_encoding_stage_equals_the_library(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from gridmark.llm.queries import vocabulary

    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    library.no_padding()
    rows = documents(spark).limit(80)
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    for r in dict(corpus_pipeline.STAGES)["bpe"](spark, rows, "").collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_word_vectors_do_not_depend_on_tasks(spark, monkeypatch):
    df = spark.createDataFrame([(f"word{i % 7} near other{i % 5} and word{i % 3}",) for i in range(200)] + [(None,), ("",)], "text string")
    whole = quality_model.word_vectors(df.repartition(40))
    monkeypatch.setattr(quality_model, "TASKS", 1)
    assert (quality_model.word_vectors(df.repartition(40)) == whole).all() and (quality_model.word_vectors(df.coalesce(1)) == whole).all()
