"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, reranking with the original vectors.

Vectors are compared within their group (label and length), at unit length, in double precision.  Equal vectors of a
group are one node.  A bounded sample of nodes teaches, for every length, a mean, principal axes and rotations of them
that iterative quantisation turns until the signs of the rotated coordinates lose least: balanced bits.  Several
rotations, started differently, give ``TABLES`` chunks of ``CHUNK_BITS`` bits; each chunk is a table of the index, and two
nodes of a group are a candidate pair where a whole chunk agrees.  By the pigeonhole all pairs meet whose codes differ in
fewer than TABLES = 24 of the 384 bits; beyond that nearly all do: at cosine 0.98 a bit differs with probability 0.064, a
chunk of 16 agrees with probability 0.35, and all 24 disagree about 3 times in 10^5.

Two rounds, so that vectors are shuffled for few nodes only.  In the first, (key, node, 64-bit sketch) rows of a key meet,
and nodes stay that have a candidate within ``RADIUS`` bits of the sketch (about 4 differ at 0.98).  In the second they
meet again with their vectors, and a pair counts where its cosine reaches the threshold, under its first common table
alone.  A key's nodes fall into blocks by hash and each pair of blocks is a group of rows of its own, so no key, however
hot, is a task; a key with M nodes takes M^2 / BLOCK rows.  A task returns numbers of links by node and links enough to
connect what it connected, never pairs one by one.  Components come from ``near_dedup.components``.

Null labels and vectors, empty and zero vectors, and vectors with null, NaN or infinite components have no link.  Vectors
of different lengths are in different groups.  Labels are compared as text.  Ids may repeat or be null: every row counts;
``component_id`` is the smallest id reachable (null only where all are null).  Copies are linked with one another.  Other
columns, whatever their names, play no part.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import runs
from .flat import mix
from .near_dedup import components
from .store import settled, sifted, small_batches, written

TABLES, CHUNK_BITS, RADIUS = 24, 16, 16
#: Vectors in the sample that teaches the rotations, and turns of each.
SAMPLE, TURNS = 8192, 30
#: Nodes of a block in the first and the second round.
WIDE_BLOCK, BLOCK = 8192, 1024
_GOLD = np.uint64(0x9E3779B97F4A7C15)

Model = dict[int, tuple[np.ndarray, np.ndarray]]


def learn(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean, planes [length, bits]) of unit vectors, which may be none: rotations of the principal axes, each turned so
    that the signs are nearest to the coordinates."""
    d = x.shape[1]
    width = min(d, 64)
    mean = x.mean(0) if len(x) else np.zeros(d)
    centred = x - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :width] if len(x) > 1 else np.linalg.qr(np.random.default_rng(d).standard_normal((d, width)))[0]
    v, planes = centred @ axes, []
    for start in range(-(-TABLES * CHUNK_BITS // width)):
        r = np.linalg.qr(np.random.default_rng(start).standard_normal((width, width)))[0]
        for _ in range(TURNS if len(x) > 1 else 0):
            u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
            r = w.T @ u.T
        planes.append(axes @ r)
    return mean, np.concatenate(planes, 1)[:, : TABLES * CHUNK_BITS]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; the largest component goes first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def codes(model: Model, x: np.ndarray) -> np.ndarray:
    """[vector, table] 16-bit chunks of unit vectors."""
    mean, planes = model.get(x.shape[1]) or learn(np.zeros((0, x.shape[1])))
    return np.packbits((x - mean) @ planes >= 0, axis=1).view(np.uint16)


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the usable vectors of a list column, by length."""
    offsets = column.offsets.to_numpy()
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    flat = column.values.to_numpy(zero_copy_only=False)
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        x = flat[offsets[rows][:, None] + np.arange(d)] + flat.dtype.type(0)  # -0 becomes 0
        good = np.isfinite(x).all(1) & (x != 0).any(1)
        yield rows[good], x[good]


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, embedding) to (id, digest, grp, vec); digest, grp and vec are null where the vector can't be linked."""
    for batch in batches:
        label = batch.column(1).to_pylist()
        digest, grp, vec = ([None] * batch.num_rows for _ in range(3))
        for rows, x in _vectors(batch.column(2)):
            for i, own in zip(rows, x, strict=True):
                if label[i] is not None:
                    name = f"{x.shape[1]} {label[i]}".encode()
                    vec[i], grp[i] = own.tobytes(), int.from_bytes(blake2b(name, digest_size=8).digest(), "little", signed=True)
                    digest[i] = blake2b(name + b"\0" + vec[i], digest_size=16).digest()
        kinds = zip((digest, grp, vec), (pa.binary(), pa.int64(), pa.binary()), strict=True)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(values, kind) for values, kind in kinds)], names=["id", "digest", "grp", "vec"])


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of a column of raw vectors, by length."""
    listed = column.to_pylist()
    size = np.array([len(v) for v in listed])
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, unit(np.frombuffer(b"".join(listed[i] for i in rows), kind).reshape(len(rows), -1).astype(np.float64))


def _coded(model: Model, kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, grp, vec) to (node, grp, code)."""
    for batch in batches:
        code = np.zeros((batch.num_rows, TABLES), np.uint16)
        for rows, x in _matrix(batch.column(2), kind) if batch.num_rows else ():
            code[rows] = codes(model, x)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in code], pa.binary())], names=["node", "grp", "code"])


def _probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, grp, code) to (key, t, node, sketch), one row a table."""
    table = np.arange(TABLES, dtype=np.uint64)
    for batch in batches:
        code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, TABLES)
        grp = batch.column(1).to_numpy().view(np.uint64)[:, None]
        keys = mix(grp ^ mix((code.astype(np.uint64) + np.uint64(1)) * _GOLD + table))
        repeat = lambda v: pa.array(np.repeat(v, TABLES))
        columns = [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(table.astype(np.int32), len(code))), repeat(batch.column(0).to_numpy()), repeat(np.ascontiguousarray(code[:, :4]).view(np.int64).ravel())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "t", "node", "sketch"])


def _dealt(member: DataFrame, block: int) -> DataFrame:
    """``member`` (key, many, node, ...) with a row for each pair of blocks (x, y) of the key that has the node's block."""
    blocks = F.ceil(F.col("many") / block).cast("int")
    dealt = member.withColumn("_n", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.withColumns({"x": F.least("block", "_o"), "y": F.greatest("block", "_o")}).drop("_n", "_o", "many")


def _sides(block: np.ndarray, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(block == x), np.flatnonzero(block == y)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, x, y, block, t, node, sketch) by runs of (key, x, y) to (key, t, node) of the nodes with a candidate within
    RADIUS bits."""
    for table in runs.whole(batches, ["key", "x", "y"]):
        at = np.append(runs.starts(table, ["key", "x", "y"]), table.num_rows)
        sketch, node, block, x, y = (table.column(c).to_numpy() for c in ("sketch", "node", "block", "x", "y"))
        sketch, near = sketch.view(np.uint64), np.zeros(table.num_rows, bool)  # bits of negative numbers aren't counted
        size = np.diff(at)
        for n in np.unique(size[(size > 1) & (size <= 16)]):  # short runs of one size at once
            rows = at[:-1][size == n][:, None] + np.arange(n)
            rows = rows[(block[rows] == x[rows]).any(1) & (block[rows] == y[rows]).any(1)]
            differ = np.bitwise_count(sketch[rows][:, :, None] ^ sketch[rows][:, None, :]) <= RADIUS
            near[rows] |= (differ & (node[rows][:, :, None] != node[rows][:, None, :])).any(2)
        for i in np.flatnonzero(size > 16):
            left, right = (side + at[i] for side in _sides(block[at[i] : at[i + 1]], x[at[i]], y[at[i]]))
            for a in range(0, len(left), 128):
                rows = left[a : a + 128]
                hit = (np.bitwise_count(sketch[rows][:, None] ^ sketch[right][None, :]) <= RADIUS) & (node[rows][:, None] != node[right][None, :])
                near[rows] |= hit.any(1)
                near[right] |= hit.any(0)
        yield from table.select(["key", "t", "node"]).filter(pa.array(near)).to_batches()


def _linked(threshold: float, kind: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, x, y, block, t, node, times, code, vec) by runs of (key, x, y) to rows (a, b, n): n vectors linked with node
    a (b null), or a and b connected (n 0)."""
    for table in runs.whole(batches, ["key", "x", "y"]):
        at = np.append(runs.starts(table, ["key", "x", "y"]), table.num_rows)
        for i in np.flatnonzero(np.diff(at) > 1):
            own = table.slice(at[i], at[i + 1] - at[i])
            node, block, times = (own.column(c).to_numpy() for c in ("node", "block", "times"))
            code = np.frombuffer(b"".join(own.column("code").to_pylist()), np.uint16).reshape(-1, TABLES)
            _, vectors = next(_matrix(own.column("vec"), kind))
            x, y, t = (own.column(c)[0].as_py() for c in ("x", "y", "t"))
            left, right = _sides(block, x, y)
            links, root = np.zeros(len(node), np.int64), np.arange(len(node))
            for a in range(0, len(left), 256):
                rows = left[a : a + 256]
                hit = vectors[rows] @ vectors[right].T >= threshold
                if x == y:
                    hit &= node[rows][:, None] < node[right][None, :]
                p, q = np.nonzero(hit)
                p, q = rows[p], right[q]
                first = (code[p] == code[q]).argmax(1) == t
                p, q = p[first], q[first]
                np.add.at(links, p, times[q])
                np.add.at(links, q, times[p])
                while len(p):  # the smallest row number spreads along the links
                    before = root.copy()
                    np.minimum.at(root, p, root[q])
                    np.minimum.at(root, q, root[p])
                    root = root[root]
                    if (root == before).all():
                        break
            linked, joined = np.flatnonzero(links), np.flatnonzero(root != np.arange(len(root)))
            a, b = np.concatenate([node[linked], node[joined]]), pa.array([None] * len(linked) + node[root[joined]].tolist(), pa.int64())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([links[linked], np.zeros(len(joined), np.int64)]))], names=["a", "b", "n"])


def sample_model(nodes: DataFrame, kind: str) -> Model:
    """The model of every length that a sample of SAMPLE nodes (fewer where vectors are long) holds."""
    longest = nodes.agg(F.max(F.length("vec"))).first()[0] or 1
    drawn = nodes.orderBy(F.xxhash64("digest"), "digest").select("vec").limit(max(64, min(SAMPLE, (1 << 26) // longest))).toArrow()
    return {x.shape[1]: learn(x) for _, x in _matrix(drawn.column(0), kind)} if drawn.num_rows else {}


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """Per row of ``df``: its id, n_links (other vectors of its label found at a cosine of ``threshold`` or more),
    component_id, kept (the id is the component's).  RADIUS suits thresholds of 0.97 and more."""
    if not 0.97 <= threshold <= 1:
        raise ValueError("the tables are set for cosines of 0.97 and more")
    small_batches(df.sparkSession)
    base = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("embedding"))
    id_type, kind = base.schema["id"].dataType.simpleString(), "f4" if base.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"
    if kind == "f8":
        base = base.withColumn("embedding", F.col("embedding").cast("array<double>"))
    keyed = base.mapInArrow(_keyed, f"id {id_type}, digest binary, grp bigint, vec binary")
    rows = written(keyed.select("id", "digest"), "rows")
    nodes = keyed.where("digest IS NOT NULL").groupBy("digest", "grp").agg(F.min("id").alias("least"), F.count("*").alias("times"), F.first("vec").alias("vec"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    coded = written(nodes.select("node", "grp", "vec").mapInArrow(partial(_coded, sample_model(nodes, kind), kind), "node bigint, grp bigint, code binary"), "codes")

    probes = coded.mapInArrow(_probes, "key bigint, t int, node bigint, sketch bigint")
    shared = written(probes.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "keys")
    met = _dealt(sifted(probes, "key", shared.select("key")).join(shared, "key"), WIDE_BLOCK)
    run = ["key", "x", "y"]
    close = met.repartition(*run).sortWithinPartitions(*run).mapInArrow(_close, "key bigint, t int, node bigint").groupBy("key", "node").agg(F.first("t").alias("t"))
    close = written(close, "close")
    again = _dealt(close.join(close.groupBy("key").agg(F.count("*").alias("many")), "key"), BLOCK)
    full = nodes.select("node", "times", "vec").join(coded.select("node", "code"), "node")
    found = again.join(full, "node").repartition(*run).sortWithinPartitions(*run).select("key", "x", "y", "block", "t", "node", "times", "code", "vec")
    found = written(found.mapInArrow(partial(_linked, threshold, kind), "a bigint, b bigint, n bigint"), "found")

    links = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    rooted = components(settled(found.where("b IS NOT NULL").select("a", "b").distinct())).withColumnRenamed("id", "node")
    told = nodes.select("node", "digest", "least", "times").join(links, "node", "left").join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = told.groupBy("root").agg(F.min("least").alias("component_id"))
    told = told.join(least, "root").select("digest", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    out = rows.join(told, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
