import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridmark.llm import bpe
from gridmark.llm.flat import text_bytes
from gridmark.llm.queries import vocabulary

ODD = ["", None, "ab", " \n\t\x0b", "a\xa0b\x85c É é ́x", "<|endoftext|> <|startoftext|>x 's it's 123 ***,.", "x" * 9000, "é" * 4000 + " a b" * 4000, "日本語 テスト" * 300, "İ ẞ ΑΣ ΣΣ", "﻿a   b", "q\x00w"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(texts):
    own = bpe.encoder(vocabulary())
    return [np.frombuffer(x, "<u4").tolist() for x in own.encode(*text_bytes(pa.array(texts, pa.string())))]


def test_equals_the_library(library):
    for got, text in zip(ids_of(ODD), ODD):
        assert got == library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=400), max_size=4))
def test_any_text_equals_the_library(texts):
    t = bpe.encoder(vocabulary()).tokenizer
    texts = [x.encode(errors="ignore").decode() for x in texts]
    assert ids_of(texts) == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_small_stores_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 5)
    monkeypatch.setattr(bpe, "CHUNK_BYTES_KEPT", 500)
    monkeypatch.setattr(bpe, "CUT_BITS", 4)
    monkeypatch.setattr(bpe, "_encoders", {})
    texts = ["the quick brown fox " * 50 + f"jumps {i}" for i in range(20)]
    assert ids_of(texts) == [library.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("bits", [4, 7])
def test_long_words_beside_a_join(library, monkeypatch, bits):
    monkeypatch.setattr(bpe, "CUT_BITS", bits)
    monkeypatch.setattr(bpe, "_encoders", {})
    rng = np.random.default_rng(3)
    scripts = [(0x4E00, 0x9000), (0x3041, 0x3096), (0x0E01, 0x0E2E), (0x0430, 0x044F), (0x61, 0x7A)]

    def line():
        return "".join(chr(rng.integers(*scripts[rng.integers(len(scripts))])) for _ in range(rng.integers(20, 90)))

    texts = ["\n".join(line() for _ in range(200)) for _ in range(5)]
    assert ids_of(texts) == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_cuts_depend_on_content():
    own = bpe.encoder(vocabulary())
    rng = np.random.default_rng(0)
    shared = rng.integers(97, 123, 20_000).astype(np.uint8)
    a, b = (np.concatenate([rng.integers(97, 123, n).astype(np.uint8), shared]) for n in (100, 777))
    far = lambda cuts, n: {c - n for c in cuts if c - n > bpe.WINDOW}
    assert far(own.cuts(a), 100) == far(own.cuts(b), 777) and len(own.cuts(a)) > 5


def test_columns(spark, library):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ODD)], "doc_id long, text string, d int")
    out = df.select("doc_id", bpe.digests("text", vocabulary()).alias("d"), bpe.encode("text", vocabulary()).alias("ids"))
    for r in out.withColumn("back", bpe.decode("ids", vocabulary())).collect():
        ids = library.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["d"]["n_tokens"] == len(ids)
        assert r["back"] == library.decode(ids, skip_special_tokens=False)
        assert r["d"]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["d"]["decoded_sha256"] == hashlib.sha256(r["back"].encode()).hexdigest()
    assert df.limit(0).select(bpe.digests("text", vocabulary())).count() == 0


def test_a_vocabulary_with_white_space_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_chunks_in_many_documents_are_encoded_once(spark, library, monkeypatch):
    rng = np.random.default_rng(5)
    word = lambda: "".join(chr(c) for c in rng.integers(97, 123, rng.integers(2, 9)))
    passage = " ".join(word() for _ in range(3000))
    texts = [f"{i} {word()} " + passage + f" {word()} {i}" for i in range(300)] + [" ".join(word() for _ in range(800)) for _ in range(20)] + ODD + ODD
    df = spark.createDataFrame([(i % 200 or None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, d string").repartition(8)
    out = bpe.encoded(df, vocabulary()).collect()
    want = sorted((t or "", *(lambda ids: (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))(library.encode(t or "", add_special_tokens=False).ids)) for t in texts)
    assert sorted((r["row"]["text"] or "", r["d"]["n_tokens"], r["d"]["ids_sha256"]) for r in out) == want
    assert all(r["row"]["d"] == "x" for r in out) and bpe.encoded(df.limit(0), vocabulary()).count() == 0

    rows = df.selectExpr("coalesce(text, '') AS text", "unhex(md5(coalesce(text, ''))) AS md5")
    named = bpe.references(rows, vocabulary())
    chunks = {bytes(r["digest"]): bytes(r["ids"]) for r in bpe.shared_chunks(named, rows, vocabulary()).collect()}
    assert bpe.shared_chunks(named, rows, vocabulary()).count() == len(chunks) > 5  # one row a chunk, whatever the partitions
    own = bpe.Encoder(vocabulary())
    monkeypatch.setattr(own, "_learn", lambda words, learn=own._learn: asked.update(words) or learn(words))
    asked: set[bytes] = set()
    data, offsets = text_bytes(pa.array(texts[:1]))
    plan = next(own.parts(data, offsets))
    inside = {w for p in plan[::2] if len(p) > bpe.LEAST_SHARED and bpe.digest(p) in chunks for w in p.split()}
    starts = np.concatenate([[0], np.cumsum([len(p) for p in plan])])
    given = {int(starts[i]): chunks[bpe.digest(p)] for i, p in enumerate(plan) if i % 2 == 0 and bpe.digest(p) in chunks}
    assert own.encode(data, offsets, [given])[0] == np.array(library.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()
    assert len(inside) > 1000 and len(asked & inside) < 0.2 * len(inside)  # what is asked stands at joins and borders


def test_a_vocabulary_with_a_decoder_is_refused(tmp_path):
    import json

    file = json.loads(open(vocabulary()).read())
    file["decoder"] = {"type": "Metaspace", "replacement": "_", "prepend_scheme": "always", "split": True}
    (tmp_path / "v.json").write_text(json.dumps(file))
    with pytest.raises(ValueError, match="decoder"):
        bpe.Encoder(str(tmp_path / "v.json"))
