"""Near-duplicate detection: b-bit MinHash signatures under a multi-index Hamming join, links confirmed on full sets.

A text's set holds the hashes (64 bits) of its distinct word shingles; a text of fewer words is one shingle; a text
without words has an empty set and no link.  Texts with equal sets (copies) share one node.

Signatures have ``SYMBOLS`` = 64 symbols of 16 bits.  Two sets of similarity s differ in a symbol with probability
1 - s, so at s = 0.8 more than ``DISTANCE`` = 27 symbols differ about once in 10^5 pairs.  All node pairs within that
distance meet: the symbols are split into ten chunks of four and eight chunks of three, and 27 errors leave one of the
former with at most one error or one of the latter with none (pigeonhole: 10 * 2 + 8 * 1 > 27), so every node is listed
under each chunk of three and under each chunk of four with each of its symbols left out (the errors enumerated):
``KEYS`` = 48 keys of three symbols.  Every pair that meets and is within the distance is confirmed on the full sets.

Candidates aren't all pairs under a key.  First every node is paired with the smallest node under each of its keys.
Links found give components; a key whose nodes are one component has nothing left to tell.  Under the other keys only
pairs between components are open.  Small groups (``SMALL`` nodes) join with themselves.  Large groups are dealt as
pairs of blocks of ``BLOCK_NODES`` nodes (fewer where sets are large: ``BLOCK_HASHES``) that carry the full sets.  Inside
a task all open pairs within the distance, each under its first common key alone, are confirmed at once, unless links
that the task has found connect them already.  Only such links leave the task, fewer than it has nodes.  So no link
between components is lost.  Near copies of one another are one component before blocks are dealt; a key that M nodes
of other components share takes M^2 / BLOCK_NODES rows, as each pair of blocks is a task of its own.

A link is confirmed on the full sets of both texts.  Components come from alternating large and small stars (minimum
labels), each round settled in the shared folder.  Keys, joins and counts are shuffles that AQE can split; nothing is
gathered to the driver.  Before wide rows are shuffled for a join, those without a partner are dropped by a broadcast
table of bits (``store.sifted``), of one size whatever the input; a full table only drops less.

Null text counts as empty.  ``component_id`` is the smallest doc_id reachable (null ids last: only components without
any id have none).  Repeated rows share a node and keep their rows.  Other columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import byte_numbers, drawn, groups, mix, span_hashes, spans, text_bytes, white
from .quality_rules import WORD
from .store import settled, sifted, small_batches, unused, written

SYMBOLS, DISTANCE = 64, 27
SMALL, BLOCK_NODES, BLOCK_HASHES, KEPT_HASHES = 32, 1024, 1 << 21, 2_000_000
_FACTORS = (drawn(7, SYMBOLS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
#: Chunks of symbols, and the errors allowed in each; errors and chunks together exceed DISTANCE.
_PARTS = [(np.arange(4 * k, 4 * k + 4), 1) for k in range(10)] + [(np.arange(40 + 3 * k, 43 + 3 * k), 0) for k in range(8)]
KEYS = sum(len(part) if errors else 1 for part, errors in _PARTS)
_PLACES = drawn(8, 64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text in a flat buffer, one after the other, and their n + 1 offsets."""
    starts, ends = spans(data, offsets, white())
    words = span_hashes(data, starts, ends, byte_numbers(fold=True)) if len(starts) else np.zeros(0, np.uint64)
    first = np.searchsorted(starts, offsets)
    n = np.diff(first)
    rolled = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled += words[k : len(words) - width + 1 + k] * _PLACES[k]
    rolled = mix(rolled)
    out, sizes = [], np.zeros(len(n), np.int64)
    for i in range(len(n)):
        if n[i] >= width:
            own = np.unique(rolled[first[i] : first[i + 1] - width + 1])
        elif n[i]:
            own = mix(np.array([(words[first[i] : first[i + 1]] * _PLACES[8 : 8 + n[i]]).sum() + np.uint64(n[i])], np.uint64))
        else:
            continue
        sizes[i] = len(own)
        out.append(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def _digests(hashes: np.ndarray, at: np.ndarray) -> list[bytes]:
    """16 bytes that equal sets share."""
    full = at[:-1][at[1:] > at[:-1]]
    out = np.zeros((len(at) - 1, 2), np.uint64)
    if len(full):
        own = at[1:] > at[:-1]
        out[own, 0] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), full)
        out[own, 1] = np.add.reduceat(mix(hashes ^ np.uint64(0x14057B7EF767814F)), full)
    return [x.tobytes() for x in out]


def signatures(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[text, symbol] 16-bit symbols: bits of the smallest hash under each of SYMBOLS multiplications modulo 2^32."""
    out = np.zeros((len(at) - 1, SYMBOLS), np.uint16)
    own = np.flatnonzero(at[1:] > at[:-1])
    short = (hashes >> np.uint64(16)).astype(np.uint32)
    for a in range(0, len(own), 256):
        rows = own[a : a + 256]
        part, base = short[at[rows[0]] : at[rows[-1] + 1]], at[rows] - at[rows[0]]
        for k in range(SYMBOLS):
            out[rows, k] = mix(np.minimum.reduceat(part * _FACTORS[k], base).astype(np.uint64)) & np.uint64(0xFFFF)
    return out


def _signed(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for i, j in groups(offsets):
            hashes, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
            sig = signatures(hashes, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(np.diff(at)), pa.array(_digests(hashes, at), pa.binary()), pa.array([x.tobytes() for x in sig], pa.binary())],
                names=["doc", "md5", "n", "digest", "sig"],
            )


def _bytes(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _key_table(sig: np.ndarray) -> np.ndarray:
    """[node, key number]: for every chunk of a signature the hash of its symbols, all of them or each one left out."""
    weighed = (sig.astype(np.uint64) + np.uint64(1)) * _PLACES
    left_out = [(part, out) for part, errors in _PARTS for out in (part if errors else [-1 - part[0]])]
    keys = [mix(weighed[:, [x for x in part if x != out]].sum(1) + np.uint64((int(out) + SYMBOLS + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) for part, out in left_out]
    return np.stack(keys, 1).view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id) for every key of a node."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            keys = _key_table(_bytes(batch.column(1).slice(a, 1024), np.uint16, SYMBOLS))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).slice(a, 1024).to_numpy(), KEYS))], names=["key", "id"])


def _near(percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, n_a, n_b, sig_a, sig_b) within the distance whose sizes allow a link."""
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            n, m = (part.column(k).to_numpy() for k in (2, 3))
            differ = (_bytes(part.column(4), np.uint16, SYMBOLS) != _bytes(part.column(5), np.uint16, SYMBOLS)).sum(1)
            fit = (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (differ <= DISTANCE)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(fit))


def _compared(percent: int, table: pa.Table) -> pa.Table:
    """Links between components within one pair of blocks (x, y) of a key's nodes: rows key, x, y, block, id, root, n,
    sig, own (the set).  Pairs with an earlier key in common are left to that key; of the others, links enough to
    connect what they connect."""
    ids, roots, n, block = (table[c].to_numpy() for c in ("id", "root", "n", "block"))
    sig = _bytes(table["sig"], np.uint16, SYMBOLS)
    sets = [np.frombuffer(own, np.uint64) for own in table["own"].to_pylist()]
    x, y = table["x"][0].as_py(), table["y"][0].as_py()
    left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
    number = int(np.flatnonzero(_key_table(sig[:1])[0] == table["key"][0].as_py())[0])
    above: dict[int, int] = {}
    links: list[tuple[int, int]] = []

    def top(root: int) -> int:
        while (up := above.get(root, root)) != root:
            above[root] = root = above.get(up, up)
        return root

    for a in range(0, len(left), 256):
        rows = left[a : a + 256]
        same = np.zeros((len(rows), len(right)), np.uint8)
        for k in range(SYMBOLS):
            same += sig[rows, k][:, None] == sig[right, k][None, :]
        open_ = (roots[rows][:, None] != roots[right][None, :]) & (same >= SYMBOLS - DISTANCE)
        open_ &= 100 * np.minimum(n[rows][:, None], n[right][None, :]) >= percent * np.maximum(n[rows][:, None], n[right][None, :])
        if x == y:
            open_ &= ids[rows][:, None] < ids[right][None, :]
        i, j = np.nonzero(open_)
        for c in range(0, len(i), 1 << 14):
            p, q = rows[i[c : c + (1 << 14)]], right[j[c : c + (1 << 14)]]
            fit = np.flatnonzero(_first_key(sig[p] != sig[q]) == number)
            shared = same[i[c : c + (1 << 14)], j[c : c + (1 << 14)]]
            for k in fit[np.argsort(-shared[fit].astype(np.int64), kind="stable")]:  # the likeliest links first: they spare others
                one, two = top(int(roots[p[k]])), top(int(roots[q[k]]))
                if one != two and _similar(sets[p[k]], sets[q[k]], percent):
                    above[one] = two
                    links.append((ids[p[k]], ids[q[k]]))
    return pa.table({k: pa.array([pair[side] for pair in links], pa.int64()) for side, k in enumerate("ab")})


def _first_key(differ: np.ndarray) -> np.ndarray:
    """Number of the first key that two signatures share, from where they differ; -1 for none."""
    out, base = np.full(len(differ), -1), 0
    for part, errors in _PARTS:
        wrong = differ[:, part]
        count = wrong.sum(1)
        hit = (out < 0) & (count <= errors)
        out[hit] = base + np.where(count[hit] == 0, 0, wrong[hit].argmax(1))
        base += len(part) if errors else 1
    return out


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sets meet 100 * intersection >= percent * union."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _sets(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, own): the set of every text as bytes."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for i, j in groups(offsets):
            hashes, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
            own = pa.array([hashes[at[k] : at[k + 1]].tobytes() for k in range(j - i)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), own], names=["id", "own"])


def _confirmed(width: int, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose sets meet 100 * intersection >= percent * union; rows a, b, text of a, text of b.  A text's
    set is made once while it is among the last ones used."""
    sets: dict[int, np.ndarray] = {}
    load = 0
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
            if load > KEPT_HASHES:
                sets, load = {}, 0
            new = {i: (side, r) for side, ids in ((2, a), (3, b)) for r, i in enumerate(ids) if i not in sets}
            for side in (2, 3):
                ids = [i for i, (k, _) in new.items() if k == side]
                data, offsets = text_bytes(part.column(side).take(pa.array([new[i][1] for i in ids], pa.int64())))
                for x, y in groups(offsets):
                    hashes, at = shingle_sets(data[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], width)
                    sets.update((ids[x + k], hashes[at[k] : at[k + 1]]) for k in range(y - x))
                    load += len(hashes)
            keep = [_similar(sets[i], sets[j], percent) for i, j in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root) for every node of a link table, root being the smallest id reachable; alternating stars."""
    stars = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        down = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        stars = settled(down.join(least, "u").select(ends).select("e.u", "e.v").where("u <> v").distinct())
        role = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("leaf")), F.struct(F.col("v").alias("x"), F.lit(0).alias("leaf")))).alias("e")
        both_roles = "leaves > 1 OR leaves = 1 AND hub = 1"
        unsettled = stars.select(role).select("e.x", "e.leaf").groupBy("x").agg(F.sum("leaf").alias("leaves"), F.max(1 - F.col("leaf")).alias("hub")).where(both_roles)
        if unsettled.isEmpty():
            return stars.select(F.col("u").alias("id"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _within(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) within the distance whose sizes allow a link."""
    for k in "ab":
        pairs = pairs.join(sifted(signed, "id", pairs.select(k)).toDF(k, f"n_{k}", f"sig_{k}"), k)
    return pairs.select("a", "b", "n_a", "n_b", "sig_a", "sig_b").mapInArrow(partial(_near, percent), "a bigint, b bigint")


def _in_blocks(opened: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of ``_compared`` over all (key, id, root, many, hashes): nodes of a key fall into blocks by hash, and each
    pair of blocks is a group of its own, of about 2 * BLOCK_NODES rows and 2 * BLOCK_HASHES hashes whatever the key
    holds."""
    blocks = F.ceil(F.greatest(F.col("many") / BLOCK_NODES, F.col("hashes") / BLOCK_HASHES)).cast("int")
    dealt = opened.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = dealt.withColumn("_o", other).select("key", F.least("block", "_o").alias("x"), F.greatest("block", "_o").alias("y"), "block", "id", "root")
    rows = spread.join(signed.join(sets, "id"), "id").select("key", "x", "y", "block", "id", "root", "n", "sig", "own")

    def compared(table: pa.Table) -> pa.Table:
        return _compared(percent, table)

    return rows.groupBy("key", "x", "y").applyInArrow(compared, "a bigint, b bigint")


def _texts(base: DataFrame, nodes: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, text) of the nodes named by ``ids``.  A node's text is read from a row of its own: that of the smallest doc id,
    then of the smallest digest, for ids may be null or stand on several texts."""
    asked = settled(nodes.select("id", "doc", F.col("md5").alias("_md5")).join(ids, "id", "left_semi"))
    near = sifted(base, "md5", asked.select("_md5")).select(F.col("doc").alias("_doc"), "md5", "text")
    texts = near.join(asked, (F.col("md5") == F.col("_md5")) & F.col("_doc").eqNullSafe(F.col("doc"))).select("id", "text")
    return written(texts.groupBy("id").agg(F.min("text").alias("text")), "texts")


def _confirm(base: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are links, a < b."""
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    texts = _texts(base, nodes, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), width)
    sides = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return sides.select("a", "b", "x", "y").mapInArrow(partial(_confirmed, width, percent), "a bigint, b bigint")


def linked(df: DataFrame, doc_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Per row of ``df``: doc (its id), md5 (of its text), n (its set's size), root (its component's number, null
    for an empty set), component_id; and the links confirmed between nodes (a, b, with the smallest doc ids of their
    copies as doc_a, doc_b): enough links to connect every component, not all within it.

    ``width`` words a shingle, links at 100 * intersection >= ``percent`` * union; DISTANCE suits percent >= 80.
    """
    if percent < 80:
        raise ValueError("the signature distance is set for similarities of 0.8 and more")
    small_batches(df.sparkSession)
    base = df.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text"))
    doc_type = base.schema["doc"].dataType.simpleString()
    hashed = base.withColumn("md5", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    signed = written(hashed.mapInArrow(partial(_signed, width), f"doc {doc_type}, md5 string, n bigint, digest binary, sig binary"), "signed")
    nodes = signed.where("n > 0").groupBy("digest", "n").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "md5")).alias("m"), F.first("sig").alias("sig"))
    nodes = written(nodes.select("digest", "n", "m.doc", "m.md5", "sig").withColumn("id", F.monotonically_increasing_id()), "nodes")
    marked = nodes.select("id", "n", "sig")
    probes = nodes.select("id", "sig").mapInArrow(_keys, "key bigint, id bigint")
    hubs = written(probes.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("many")).where("many > 1").select("key", "hub"), "hubs")
    member = written(sifted(probes, "key", hubs.select("key")).join(hubs, "key"), "member")
    asked = written(member.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "asked")
    stars = settled(_confirm(hashed, nodes, _within(asked, marked, percent), width, percent))
    placed = nodes.select("id", "n").join(components(stars), "id", "left").select("id", "n", F.coalesce("root", "id").alias("root"))
    rooted = member.select("key", "id").join(placed, "id")
    several = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("many"), F.sum("n").alias("hashes")).where("lo < hi").drop("lo", "hi")
    opened = written(rooted.drop("n").join(several, "key"), "open")
    large = opened.where(F.col("many") > SMALL)
    sets = _texts(hashed, nodes, large.select("id"), width).mapInArrow(partial(_sets, width), "id bigint, own binary")
    found = _in_blocks(large, marked, sets, percent)
    x, y = (opened.where(F.col("many") <= SMALL).select("key", F.col("id").alias(k), F.col("root").alias(f"root_{k}")) for k in "ab")
    few = x.join(y, "key").where("root_a <> root_b AND a < b").select("a", "b").distinct()
    few = written(few.join(asked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "few")
    links = settled(stars.unionByName(found).unionByName(_confirm(hashed, nodes, _within(few, marked, percent), width, percent)).distinct())
    rooted = components(links)
    named = nodes.select("id", "digest", "n", "doc").join(rooted, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "root").select("digest", F.col("n").alias("_n"), "root", "component_id")
    rows = signed.select("doc", "md5", "n", "digest").join(named, (signed["digest"] == named["digest"]) & (F.col("n") == F.col("_n")), "left")
    groups_ = rows.select("doc", "md5", "n", "root", F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))
    ends = [nodes.select(F.col("id").alias(k), F.col("doc").alias(f"doc_{k}")) for k in "ab"]
    return groups_, links.join(ends[0], "a").join(ends[1], "b")


def near_duplicates(df: DataFrame, doc_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``df``: its doc id, n_shingles, component_id, kept (the doc id is the component's)."""
    rows = linked(df, doc_col, text_col, width, percent)[0]
    result = rows.select(F.col("doc").alias(doc_col), F.col("n").alias("n_shingles"), "component_id")
    return result.withColumn("kept", F.col(doc_col).eqNullSafe(F.col("component_id")))


def deduplicated(df: DataFrame, doc_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df``, one of each component: that of the smallest doc id, then the smallest digest of the text.
    Repeated rows count once; rows without words stay, each one."""
    rows = linked(df, doc_col, text_col, width, percent)[0].where("n > 0")
    key, doc, digest = (unused(df, name) for name in ("dedup_key", "dedup_doc", "dedup_digest"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "md5")).alias("m"))
    first = settled(first.select(F.col("m.doc").alias(doc), F.col("m.md5").alias(digest)))
    md5 = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    full = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    marked = df.withColumn(key, F.when(full, md5))
    same = F.col(doc_col).eqNullSafe(F.col(doc)) & (F.col(key) == F.col(digest))
    chosen = marked.where(F.col(key).isNotNull()).join(first, same, "left_semi").dropDuplicates([doc_col, key])
    return chosen.unionByName(marked.where(F.col(key).isNull())).drop(key)
