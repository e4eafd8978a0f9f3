"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words are runs of letters (and all bytes from 128 on), of digits, or of punctuation, with A-Z lower-cased, in
``BUCKETS`` hash buckets.  Every bucket has a sparse ternary index vector; a bucket's word vector is the normalised
sum of its neighbours' index vectors (two to each side) over all documents, held out or not, as no label is read.  A
word also has a form (case, digit, punctuation; the word before repeated or not), and every form an index vector.  A
document is the mean of its words' vectors beside the mean of its forms' vectors.  A tanh layer and a logistic unit,
trained with Adam in numpy, give a logit; a temperature fitted on a fifth of the sample that training doesn't see turns
it into a probability.

The sample that the network and the temperature are fitted on is bounded: ``sample_rows`` labelled rows in hash order
whose texts have at most ``longest`` bytes.  Word vectors and scoring read all of every text.  As the first layer is
linear in the mean, the frozen model is one table [bucket, hidden unit] in fixed point, so scores don't depend on
batches, and scoring is a gather over flat bytes.

Null and empty texts have a mean of zero and get the score of that.  Long texts are read whole, in blocks; equal texts
score alike; null ids meet no label; other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .flat import byte_numbers, drawn, groups, span_hashes, spans, sums, text_bytes
from .store import small_batches

BUCKETS, FORMS, WIDTH, HIDDEN, UNIT = 1 << 15, 12, 64, 16, 1 << 16


def _kinds() -> np.ndarray:
    kind = np.full(256, 3, np.uint8)
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    kind[48:58] = 2
    kind[[32, *range(9, 14)]] = 0
    return kind


_KIND = _kinds()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and form of every word, and the n + 1 word offsets of the texts."""
    starts, ends = spans(data, offsets, _KIND)
    at = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), at
    bucket = (span_hashes(data, starts, ends, byte_numbers(fold=True)) % np.uint64(BUCKETS)).astype(np.int64)
    upper = lambda x: (data[x] >= 65) & (data[x] <= 90)
    kind = _KIND[data[starts]].astype(np.int64)
    case = np.where(upper(ends - 1) & (ends - starts > 1), 2, np.where(upper(starts), 1, 0))
    again = np.zeros(len(bucket), np.int64)
    again[1:] = bucket[1:] == bucket[:-1]
    again[at[:-1][at[:-1] < len(again)]] = 0
    return bucket, np.where(kind == 1, case, kind + 1) * 2 + again, at


def index_vectors(n: int, seed: int) -> np.ndarray:
    """n sparse ternary vectors: four ones of either sign."""
    out, draws = np.zeros((n, WIDTH), np.float32), drawn(seed, n * 4).reshape(n, 4)
    for k in range(4):
        out[np.arange(n), draws[:, k] % np.uint64(WIDTH)] += np.where(draws[:, k] >> np.uint64(40) & np.uint64(1), 1, -1)
    return out


#: Pairs of neighbours that are summed at a time, and tasks a core that sum.
PAIRS, TASKS = 1 << 18, 4


def neighbour_sums(data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    """Adds to ``out`` [bucket, WIDTH], integers, the index vectors of every word's neighbours in texts of a flat buffer."""
    index = index_vectors(BUCKETS, 11)
    places = np.argsort(index == 0, axis=1, kind="stable")[:, :4]  # of the non-zero numbers; zeros where there are fewer
    values = np.take_along_axis(index, places, 1)
    for i, j in groups(offsets):
        bucket, _, at = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        text = np.repeat(np.arange(j - i), np.diff(at))
        for away in (1, 2):
            near = np.flatnonzero(text[away:] == text[:-away])
            for k in range(0, len(near), PAIRS):
                left, right = bucket[near[k : k + PAIRS]], bucket[near[k : k + PAIRS] + away]
                cells = np.concatenate([(a[:, None] * WIDTH + places[b]).ravel() for a, b in ((left, right), (right, left))])
                found = np.bincount(cells, np.concatenate([values[right].ravel(), values[left].ravel()]), out.size)
                out += np.rint(found).astype(np.int64).reshape(out.shape)


def normalised(sums: np.ndarray) -> np.ndarray:
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1)).astype(np.float32)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Normalised sums of the neighbours' index vectors for every bucket, over all texts.

    Every task gives one row a bucket that it met, at most BUCKETS, and so many come to the driver.  Partitions are read
    together, ``TASKS`` tasks a core, so that these rows grow with the cluster and not with the number of files.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((BUCKETS, WIDTH), np.int64)
        for batch in batches:
            neighbour_sums(*text_bytes(batch.column(0)), out)
        met = np.flatnonzero(out.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(met), *(pa.array(out[met, d]) for d in range(WIDTH))], names=names)

    small_batches(docs.sparkSession)
    names = ["bucket", *(f"d{d}" for d in range(WIDTH))]
    few = TASKS * docs.sparkSession.sparkContext.defaultParallelism
    parts = docs.select(text_col).coalesce(few).mapInArrow(partial, ", ".join(f"{n} bigint" for n in names))
    rows = parts.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names[1:])).toArrow()
    out = np.zeros((BUCKETS, WIDTH), np.int64)
    if len(rows):
        out[rows["bucket"].to_numpy()] = np.stack([rows[n].to_numpy() for n in names[1:]], 1)
    return normalised(out)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray, forms: np.ndarray) -> np.ndarray:
    """[text, 2 * WIDTH] means of the words' and of the forms' vectors; zeros for texts without words."""
    out = np.zeros((len(offsets) - 1, 2 * WIDTH))
    for i, j in groups(offsets):
        bucket, form, at = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        full = np.flatnonzero(np.diff(at))
        for base, table, ids in ((0, vectors, bucket), (WIDTH, forms, form)):
            for d in range(WIDTH if len(full) else 0):
                out[i + full, base + d] = np.add.reduceat(table[ids, d].astype(np.float64), at[full]) / np.diff(at)[full]
    return out


@dataclass(frozen=True)
class QualityModel:
    """Fixed-point first layer by bucket and by form, [hidden, ...]; its bias; second layer; temperature."""

    by_word: np.ndarray
    by_form: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    offset: float
    temperature: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        result = np.empty(len(offsets) - 1)
        for i, j in groups(offsets):
            bucket, form, at = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            n = np.maximum(np.diff(at), 1) * UNIT
            logit = np.full(j - i, self.offset)
            for k in range(len(self.bias)):
                mean = (sums(self.by_word[k][bucket], at) + sums(self.by_form[k][form], at)) / n
                logit += self.out[k] * np.tanh(mean + self.bias[k])
            result[i:j] = 1 / (1 + np.exp(-np.clip(logit / self.temperature, -60, 60)))
        return result


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 0, epochs: int = 60, vectors: np.ndarray | None = None) -> QualityModel:
    """The model for a sample held in memory, whose own word vectors are taken if none are given.  Without texts, or with one class, scores are the smoothed share of 1."""
    data, offsets = text_bytes(texts)
    if vectors is None:
        own = np.zeros((BUCKETS, WIDTH), np.int64)
        neighbour_sums(data, offsets, own)
        vectors = normalised(own)
    forms = index_vectors(FORMS, 12)
    x = pooled(data, offsets, vectors, forms)
    y, share = labels.astype(np.float64), (labels.sum() + 1) / (len(labels) + 2)
    scale = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(2 * WIDTH)
    rng = np.random.default_rng(seed)
    w1, b1 = rng.normal(0, 1 / np.sqrt(2 * WIDTH), (2 * WIDTH, HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = rng.normal(0, 0.25, HIDDEN), np.array(float(np.log(share / (1 - share))))
    check = np.arange(len(y)) % 5 == 4
    if 0 < y.sum() < len(y) and len(y) >= 20:
        xs, ys = (x / scale)[~check], y[~check]
        params = [w1, b1, w2, b2]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(ys)), max(1, len(ys) // 64)):
                h = np.tanh(xs[rows] @ w1 + b1)
                e = (1 / (1 + np.exp(-(h @ w2 + b2))) - ys[rows]) / len(rows)
                back = np.outer(e, w2) * (1 - h * h)
                grads = [xs[rows].T @ back + 1e-4 * w1, back.sum(0), h.T @ e + 1e-4 * w2, e.sum()]
                step += 1
                for k, (p, g) in enumerate(zip(params, grads, strict=True)):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    else:
        w2 = np.zeros(HIDDEN)
    logits = np.tanh((x / scale)[check] @ w1 + b1) @ w2 + b2
    heat = np.exp(np.linspace(-2, 4, 61))
    ones, zeros = y[check].sum(), (1 - y[check]).sum()
    aim = np.where(y[check] > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))  # Platt's targets keep separable classes finite
    loss = [(np.logaddexp(0, logits / t) - aim * logits / t).sum() for t in heat]
    temperature = float(heat[int(np.argmin(loss))]) if check.any() and np.ptp(loss) else 1.0
    first = w1 / scale[:, None]
    fixed = lambda table: np.rint(np.clip(table, -1e4, 1e4) * UNIT).astype(np.int32).T.copy()
    return QualityModel(fixed(vectors @ first[:WIDTH]), fixed(forms @ first[WIDTH:]), b1, w2, float(b2), temperature)


def train(docs: DataFrame, labels: DataFrame, doc_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 4000, longest: int = 50_000, corpus: DataFrame | None = None) -> QualityModel:
    """A model from the labelled documents given (the caller keeps held-out rows away).

    ``corpus``: all documents, for the word vectors; ``docs`` if not given.

    A doc id with several labels counts with the largest; null labels and texts are left out.  At most ``sample_rows``
    labels, in hash order, are broadcast to the documents, and their texts of at most ``longest`` bytes come to the
    driver: 4,000 texts of a few KB.  Repeated documents count as often as they occur, up to ``sample_rows`` texts.
    """
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(doc_col).alias("_id")).agg(F.max(label_col).alias("y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    held = docs.where((F.octet_length(text_col) <= longest) & (F.octet_length(text_col) > 0)).join(F.broadcast(sample), F.col(doc_col) == F.col("_id"))
    rows = held.select(F.col(text_col).alias("text"), "y", F.xxhash64(F.col(text_col), "_id").alias("h")).orderBy("h", "text").limit(sample_rows).toArrow().combine_chunks()
    texts = pa.concat_arrays(rows["text"].chunks) if len(rows) else pa.array([], pa.string())
    return fit(texts, rows["y"].to_numpy(), vectors=word_vectors(docs if corpus is None else corpus, text_col))


def score(model: QualityModel, spark, text: Column | str) -> Column:
    """The probability of label 1.  The model's table is broadcast: BUCKETS * HIDDEN * 4 bytes."""
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array(shared.value.scores(*text_bytes(column)))

    return scored(text)
