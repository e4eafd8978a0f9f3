"""BPE encoding and decoding with content-defined chunk reuse.

A gear rolling hash over the last 16 bytes cuts every text where the hash ends in ``CUT_BITS`` zeros, so equal
passages are cut alike wherever they stand.  A chunk's inside, from its first to its last white space, is encoded by
itself.  A join, the word that a cut runs through (over several cuts, if no white space lies between them), is re-encoded
whole, then again with a word more on each side, and so on with twice as many while that window's ids aren't the ids of
its words, at last the whole text.  Agreement within the words of a chunk holds because the vocabulary drops white space
and has no normalizer or pre-tokenizer that looks across it, which ``Encoder`` tries.

Chunks that several documents hold are encoded once for all of them (``encoded``): chunks are counted by digest, 16 bytes
for about 1,000 of text; the bodies of those in more than one document, one of each, are shuffled and encoded; their ids
come back to the documents by digest, and documents are joined from them and from the chunks that are theirs alone,
which are encoded where they stand.  Only documents with shared chunks are shuffled for that.  ``digests`` and ``encode`` are
columns without that exchange; they keep chunks by worker.

Words of a new chunk go through a memo of words, so the library encodes a word once while the memo holds it.  Both
stores are bounded, in two generations: when the young one is full, it becomes the old one and the old one goes.

Null and empty texts have no ids; a word of any length is one join or part of a chunk; repeated texts share all chunks;
ids and other columns, whatever their names, play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import drawn, groups, text_bytes, white
from .store import sifted, small_batches, written

WINDOW, CUT_BITS = 16, 10
WORDS_KEPT, CHUNK_BYTES_KEPT, TEXT_BYTES = 100_000, 6_000_000, 1 << 21
#: Bytes of a chunk's inside from which it is worth sharing.
LEAST_SHARED = 64


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()



class Kept:
    """A bounded dictionary of bytes to bytes in two generations."""

    def __init__(self, most: int, weigh=lambda value: 1):
        self.most, self.weigh, self.young, self.old, self.load = most, weigh, {}, {}, 0

    def get(self, key: bytes) -> bytes | None:
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: bytes, value: bytes) -> None:
        if self.load >= self.most:
            self.old, self.young, self.load = self.young, {}, 0
        self.young[key] = value
        self.load += self.weigh(value)


def _window(parts: list[bytes], i: int, words: int = 1) -> bytes:
    """The join ``parts[i]`` with the whole words before it and after it, of its neighbouring chunks."""
    before = parts[i - 1].rsplit(None, words)[-words:] if parts[i - 1].strip() else []
    after = parts[i + 1].split(None, words)[:words] if parts[i + 1].strip() else []
    return b" ".join([*before, parts[i], *after])


class Encoder:
    """Ids as bytes of little-endian unsigned 32-bit integers, for a tokenizer file that drops white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words, self.chunks = Kept(WORDS_KEPT), Kept(CHUNK_BYTES_KEPT, lambda ids: 2 * len(ids) + 200)
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(n)]
        self.gear = (drawn(5, 256) >> np.uint64(32)).astype(np.uint32)
        self.space = white() == 0
        if self.whole(b"ab \n\tcd") != self.whole(b"ab") + self.whole(b"cd"):
            raise ValueError("this vocabulary gives ids to white space; chunks couldn't be joined")
        if self.tokenizer.decoder is not None:
            raise ValueError("this vocabulary has a decoder of its own; pieces couldn't be joined by a space")
        for words in ("a b", "Ab C. d", "e\u0301 \u0301e", "don 't", "1 2", "\u65e5 \u672c"):
            if self.whole(words.encode()) != b"".join(self.whole(w.encode()) for w in words.split(" ")):
                raise ValueError("this vocabulary reads across white space; chunks couldn't be joined")

    def whole(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of the words; those not kept come from the library."""
        found = {w: ids for w in words if (ids := self.words.get(w)) is not None}
        new = [w for w in words if w not in found]
        for w, e in zip(new, self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
            found[w] = ids = array("I", e.ids).tobytes()
            self.words.put(w, ids)
        return found

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places after which the rolling hash of the last 16 bytes cuts."""
        h = self.gear[data]
        for k in (1, 2, 4, 8):
            h[k:] += h[:-k] << np.uint32(k)
        return np.flatnonzero((h >> np.uint32(12)) & np.uint32((1 << CUT_BITS) - 1) == 0) + 1

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[list[bytes]]:
        """For each text of a flat byte buffer chunks and joins in turn, a chunk first and last."""
        raw = data.tobytes()
        cuts, gaps = self.cuts(data), np.flatnonzero(self.space[data])
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = cuts[np.searchsorted(cuts, a + WINDOW) : np.searchsorted(cuts, b)]
            g = gaps[np.searchsorted(gaps, a) : np.searchsorted(gaps, b)]
            k = np.unique(np.searchsorted(g, own))  # cuts in one word are one join
            lefts = np.where(k > 0, g[np.maximum(k - 1, 0)] + 1, a) if len(g) else np.full(len(k), a)
            rights = np.where(k < len(g), g[np.minimum(k, len(g) - 1)], b) if len(g) else np.full(len(k), b)
            parts, at = [], a
            for left, right in zip(lefts.tolist(), rights.tolist(), strict=True):
                parts += [raw[at:left], raw[left:right]]
                at = right
            yield [*parts, raw[at:b]]

    def insides(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of the insides of chunks."""
        split = [c.split() for c in chunks]
        ids = self._learn({w for words in split for w in words})
        return [b"".join(map(ids.__getitem__, words)) for words in split]

    def encode(self, data: np.ndarray, offsets: np.ndarray, given: list[dict[int, bytes]] | None = None) -> list[bytes]:
        """Ids of the texts in a flat byte buffer; ``given``: for each text ids of some of its chunks by their start."""
        plans, new_chunks, new_words, known = list(self.parts(data, offsets)), set(), set(), {}
        for k, parts in enumerate(plans):
            shared, at = given[k] if given else {}, 0
            for i, part in enumerate(parts):
                if i % 2:
                    new_words.add(part)
                elif (ids := shared.get(at)) is not None:
                    known[part] = ids
                elif part not in new_chunks and part not in known and self.chunks.get(part) is None:
                    new_chunks.add(part)
                    new_words.update(part.split())
                at += len(part)
        new_words.discard(b"")
        ids = self._learn(new_words)
        ids[b""] = b""
        fresh = known
        for chunk in new_chunks:
            fresh[chunk] = b"".join(map(ids.__getitem__, chunk.split()))
            if len(chunk) > 64:
                self.chunks.put(chunk, fresh[chunk])
        got = lambda part, i: ids[part] if i % 2 else fresh[part] if part in fresh else self.chunks.get(part) or self.insides([part])[0]
        return self._agreed([([got(p, i) for i, p in enumerate(parts)], parts) for parts in plans])

    def _agreed(self, texts: list[tuple[list[bytes], list[bytes]]]) -> list[bytes]:
        """Joined ids of the texts, after their joins agree with re-encoded windows."""
        windows, odd = {}, set()
        for _, parts in texts:
            for i in range(1, len(parts), 2):
                windows[_window(parts, i)] = None
        keys = list(windows)
        for key, e in zip(keys, self.tokenizer.encode_batch_fast([k.decode() for k in keys], add_special_tokens=False), strict=True):
            windows[key] = array("I", e.ids).tobytes()
        known = self._learn({w for k in keys for w in k.split()})
        for key in keys:
            if windows[key] != b"".join(map(known.__getitem__, key.split())):
                odd.add(key)
        return [self._repaired(ids, parts, odd) if odd else b"".join(ids) for ids, parts in texts]

    def _repaired(self, ids: list[bytes], parts: list[bytes], odd: set[bytes]) -> bytes:
        """Joined ids, or the whole text's where a join's window never agrees with its words however wide it grows."""
        for i in range(1, len(parts), 2):
            words = 1
            while (window := _window(parts, i, words)) in odd or words > 1 and self.whole(window) != b"".join(map(self._learn(set(window.split())).__getitem__, window.split())):
                if window == _window(parts, i, 2 * words):  # no wider window within the chunks
                    return self.whole(b"".join(parts))
                words *= 2
        return b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, pieces joined by one space as the vocabulary (without a decoder of its own) asks."""
        return b" ".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file; its stores last as long as the worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encoded(path: str, column: pa.Array, given: list[dict[int, bytes]] | None = None) -> Iterator[bytes]:
    own = encoder(path)
    data, offsets = text_bytes(column)
    for i, j in groups(offsets, TEXT_BYTES):
        yield from own.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], given[i:j] if given else None)


_FIGURES = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"


def _figures(path: str, found: Iterator[bytes]) -> pa.StructArray:
    own, n, ids, back = encoder(path), [], [], []
    for x in found:
        n.append(len(x) // 4)
        ids.append(hashlib.sha256(x).hexdigest())
        back.append(hashlib.sha256(own.decode(x)).hexdigest())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])


_REFERENCE = "md5 binary, digest binary, start bigint, size bigint"


def _references(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(md5, text) to (md5, digest, start, size) of every chunk of a text."""
    own = encoder(path)
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for i, j in groups(offsets, TEXT_BYTES):
            of, digests_, starts, sizes = [], [], [], []
            for k, parts in enumerate(own.parts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), i):
                at = 0
                for n, part in enumerate(parts):
                    if n % 2 == 0 and len(part) > LEAST_SHARED:
                        of.append(k)
                        digests_.append(digest(part))
                        starts.append(at)
                        sizes.append(len(part))
                    at += len(part)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), pa.array(digests_, pa.binary()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["md5", "digest", "start", "size"])


def _chunk_ids(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, body) to (digest, ids)."""
    own = encoder(path)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.insides(batch.column(1).to_pylist()), pa.binary())], names=["digest", "ids"])


def _joined(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, starts, ids) to (row, d)."""
    for batch in batches:
        given = [dict(zip(x or (), y or (), strict=True)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), _figures(path, _encoded(path, batch.column(1), given))], names=["row", "d"])


def references(rows: DataFrame, path: str) -> DataFrame:
    """(md5, digest, start, size) of the chunks of rows (md5, text)."""
    return written(rows.select("md5", "text").mapInArrow(partial(_references, path), _REFERENCE), "references")


def shared_chunks(named: DataFrame, rows: DataFrame, path: str) -> DataFrame:
    """(digest, ids) of the chunks that ``references`` name more than once, each of them encoded once: its bytes are cut from
    one text that holds it."""
    first = named.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("md5", "start", "size")).alias("h")).where("n > 1")
    holders = written(first.groupBy("h.md5").agg(F.collect_list(F.struct("digest", "h.start", "h.size")).alias("held")), "holders")
    texts = sifted(rows.select("md5", "text"), "md5", holders.select("md5")).dropDuplicates(["md5"]).join(holders, "md5")
    cut = texts.select(F.col("text").cast("binary").alias("text"), F.explode("held").alias("c"))
    bodies = cut.select("c.digest", F.substring(F.col("text"), (F.col("c.start") + 1).cast("int"), F.col("c.size").cast("int")).alias("body"))
    return written(bodies.mapInArrow(partial(_chunk_ids, path), "digest binary, ids binary"), "chunks")


def encoded(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """(row, d): the rows of ``df`` as structs, and n_tokens, ids_sha256, decoded_sha256 of their texts' encoding.  Chunks that
    several rows hold are encoded once."""
    small_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.struct("*").alias("row"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("md5"))
    named = references(rows, path)
    chunks = shared_chunks(named, rows, path)
    placed = sifted(named, "digest", chunks.select("digest")).select("md5", "digest", "start").distinct().join(chunks, "digest")
    listed = placed.groupBy("md5").agg(F.collect_list(F.struct("start", "ids")).alias("p"))
    pieces = written(listed.select("md5", F.col("p.start").alias("starts"), F.col("p.ids").alias("ids")), "pieces")
    with_pieces = sifted(rows, "md5", pieces.select("md5")).join(pieces, "md5", "left")
    nothing = {c: F.lit(None).cast(pieces.schema[c].dataType) for c in ("starts", "ids")}
    without = sifted(rows, "md5", pieces.select("md5"), inside=False).withColumns(nothing)
    ready = [t.select("row", "text", "starts", "ids") for t in (with_pieces, without)]
    return ready[0].unionByName(ready[1]).mapInArrow(partial(_joined, path), f"row {rows.schema['row'].dataType.simpleString()}, d {_FIGURES}")


def encode(text: Column | str, path: str) -> Column:
    """The ids of a text, array<int>."""

    @F.arrow_udf("array<int>")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            found = list(_encoded(path, column))
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in found])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))

    return ids(text)


def decode(ids: Column | str, path: str) -> Column:
    """The text of an array of ids; null for null."""

    @F.arrow_udf("string")
    def texts(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(path)
        for column in lists:
            yield pa.array([None if x is None else own.decode(np.array(x, "<u4").tobytes()).decode() for x in column.to_pylist()], pa.string())

    return texts(ids)


def digests(text: Column | str, path: str) -> Column:
    """A struct n_tokens, ids_sha256, decoded_sha256 of the text's encoding and of its decoding."""

    @F.arrow_udf(_FIGURES)
    def figures(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield _figures(path, _encoded(path, column))

    return figures(text)
