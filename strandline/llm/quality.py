"""Quality classification: random-indexing word vectors, a two-layer network, temperature.

Words are runs of letters, of digits or of other marks; runs of capitals are
words of their own.  Random indexing: every word has a sparse ternary index vector made from its hash (two
signs among 32 places: one of some 2,000 vectors, so words can have the same one), and its word vector is the sum, over all its occurrences in all documents,
of the index vectors of the words up to ``WINDOW`` places away.  The sums are kept in ``BUCKETS``
hash buckets, which bounds the table that is broadcast (16 MB): words that fall into one bucket
share a word vector.  Tasks add up in integers and send the buckets
that they met, compressed, by key range, so the sums do not depend on the order of tasks.

A document is the mean and the spread of its unit word vectors and the mean cosine
of neighbours.  A network with
one hidden layer, in numpy, learns labels from a sample of at most
``sample_docs`` labelled documents, chosen by a hash of their identifiers; a
fifth of the sample is kept from it to fit the temperature that calibrates its
probabilities.  Word vectors, sample and network have fixed bounds, so the
labelled sample and the model can be broadcast.

Defined results: a null or empty text is the zero vector and gets the score that
the network gives it; null labels are not learned from; of repeated labels of a
document each counts; without labels of both kinds every score is the share of
label 1 (one half without any); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore
from .staging import fresh, with_fields

BUCKETS = 1 << 17
DIM = 32
NONZERO = 2
WINDOW = 2
SAMPLE_DOCS = 20_000
HIDDEN = 32
FEATURES = 2 * DIM + 1
BLOCKS = 32

_CLASS = np.full(256, 3, np.uint8)
_CLASS[textcore.SPACE] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[128:] = 1
_CLASS[48:58] = 2

_U = np.uint64


def index_vectors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each word's index vector."""
    bits = textcore.mix64(hashes)
    place, sign = np.empty((NONZERO, len(bits)), np.int64), np.empty((NONZERO, len(bits)), np.int64)
    for j in range(NONZERO):
        part = (bits >> _U(16 * j)) & _U(0xFFFF)
        place[j], sign[j] = (part >> _U(1)) % _U(DIM), (part & _U(1)).astype(np.int64) * 2 - 1
    return place, sign


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (capitals told apart) and the index of each document's first word."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    kind = _CLASS[data]
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change[offsets] = True
    edges = np.flatnonzero(change)
    starts, ends = edges[:-1], edges[1:]
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    capitals = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    shout = (ends - starts > 1) & (capitals[ends] - capitals[starts] == ends - starts)
    hashes = textcore.span_hashes(textcore.LOWER[data], starts, ends)
    return np.where(shout, textcore.mix64(hashes), hashes), np.searchsorted(starts, offsets)


def buckets_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(20)).astype(np.int64) % BUCKETS


def add_contexts(total: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> None:
    """Add each word's neighbours' index vectors to ``total`` (BUCKETS * DIM integers)."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rows, (place, sign) = buckets_of(hashes) * DIM, index_vectors(hashes)
    for gap in range(1, WINDOW + 1):
        if len(rows) <= gap:
            break
        same = owner[gap:] == owner[:-gap]
        left, right = np.flatnonzero(same), np.flatnonzero(same) + gap
        at = np.concatenate([rows[a] + place[j][b] for a, b in ((left, right), (right, left)) for j in range(NONZERO)])
        way = np.concatenate([sign[j][b] for b in (right, left) for j in range(NONZERO)])
        total += np.bincount(at, way, len(total)).astype(total.dtype)


@textcore.tidy
def _accumulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS * DIM, np.int32)
    for batch in batches:
        for _, _, data, offsets in textcore.slices(batch.column(0), 4 << 20):
            add_contexts(total, *words_of(data, offsets))
            if np.abs(total).max(initial=0) > 1 << 29:  # far from an overflow by one slice more
                yield _blocks(total)
                total[:] = 0
    yield _blocks(total)


BLOCK = "block int, sums binary"


def _blocks(total: np.ndarray) -> pa.RecordBatch:
    """Key ranges of the sums as compressed byte planes; ranges without a word are left out."""
    parts = [(i, x) for i, x in enumerate(np.split(total, BLOCKS)) if x.any()]
    packed = [zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes(), 1) for _, x in parts]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array(packed, pa.binary())], ["block", "sums"])


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8)
    size = len(planes) // (BUCKETS * DIM // BLOCKS)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(np.int32 if size == 4 else np.int64).ravel().astype(np.int64)


@textcore.tidy
def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit word vectors of each key range."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, raw in zip(batch.column(0), batch.column(1), strict=True):
            x = _unpacked(raw.as_py())
            sums[block.as_py()] = sums[block.as_py()] + x if block.as_py() in sums else x
    for block, x in sums.items():
        rows = x.reshape(-1, DIM).astype(np.float64)
        unit = (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zstandard.compress(unit.tobytes())], pa.binary())], ["block", "sums"])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit word vectors by bucket, from all documents."""
    parts = docs.select(F.col(text)).mapInArrow(_accumulate, BLOCK)
    rows = parts.repartition(BLOCKS, "block").mapInArrow(_add_blocks, BLOCK).collect()  # 16 MB at most
    out = np.zeros((BLOCKS, BUCKETS // BLOCKS, DIM), np.float32)
    for r in rows:
        out[r["block"]] = np.frombuffer(zstandard.decompress(bytes(r["sums"])), np.float32).reshape(-1, DIM)
    return out.reshape(BUCKETS, DIM)


def pooled(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean, spread and mean neighbour cosine of each document's word vectors."""
    hashes, first = words_of(data, offsets)
    buckets = buckets_of(hashes)
    out = np.zeros((len(first) - 1, FEATURES))
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if a == b:
            continue
        x = vectors[buckets[a:b]]
        mean = x.sum(0, dtype=np.float64) / (b - a)
        out[i, :DIM] = mean
        out[i, DIM : 2 * DIM] = np.sqrt(np.maximum(np.einsum("ij,ij->j", x, x) / (b - a) - mean**2, 0))
        out[i, -1] = np.einsum("ij,ij->", x[1:], x[:-1]) / max(1, b - a - 1)
    return out


class Network:
    """tanh hidden layer, logistic output divided by a temperature."""

    def __init__(self, seed: int = 3):
        self.seed, self.temperature, self.constant = seed, 1.0, None

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-4, batch: int = 256) -> Network:
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        r = np.random.Generator(np.random.PCG64(self.seed))
        self.shift, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.shift) / self.scale
        order = r.permutation(len(y))
        kept, rest = order[: len(y) // 5], order[len(y) // 5 :]
        p = [r.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), r.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(epochs):
            mixed = r.permutation(rest)
            for a in range(0, len(mixed), batch):
                i = mixed[a : a + batch]
                h = np.tanh(x[i] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
                back = e[:, None] * p[2] * (1 - h * h)
                g = [x[i].T @ back + decay * p[0], back.sum(0), h.T @ e + decay * p[2], e.sum(keepdims=True)]
                t += 1
                for k in range(4):
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] = p[k] - rate / (1 + epoch / 20) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p = p
        if len(kept):
            z, target = self._logit(x[kept]), y[kept]
            loss = lambda temp: np.mean(np.logaddexp(0, -np.where(target == 1, 1, -1) * z / temp))
            self.temperature = float(min(np.geomspace(0.25, 8, 121), key=loss))
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = self._logit((x - self.shift) / self.scale) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _features(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in textcore.slices(batch.column(1)):
                x = pooled(vectors.value, data, offsets).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([row.tobytes() for row in x], pa.binary())], ["label", "x"])

    return textcore.tidy(run)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample_docs: int = SAMPLE_DOCS, learn_from=None) -> tuple[np.ndarray, Network]:
    """``learn_from``: a Column over ``labels``; only those rows are learned from."""
    vectors = word_vectors(docs, text)
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
    if learn_from is not None:
        known = known.where(learn_from)
    n = known.count()
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("quality"), F.col(key)), 11) / float(1 << 53)
    id_, mark = fresh(docs.columns, "_key"), fresh(docs.columns, "_label")
    sample = known.where(draw < min(1.0, 0.95 * sample_docs / max(1, n))).select(F.col(key).alias(id_), F.col(label).cast("int").alias(mark))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = docs.join(F.broadcast(sample), F.col(key) == F.col(id_)).select(mark, F.col(text)).mapInArrow(_features(shared), "label int, x binary").collect()
    rows = sorted((r["x"], r["label"]) for r in rows)
    x = np.array([np.frombuffer(r[0]) for r in rows]) if rows else np.zeros((0, FEATURES))
    return vectors, Network().fit(x, np.array([r[1] for r in rows], float))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = model.value
        for batch in batches:
            scores = [network.probability(pooled(vectors, data, offsets)) for _, _, data, offsets in textcore.slices(batch.column(batch.num_columns - 1))]
            score = np.clip(np.concatenate(scores) if scores else np.zeros(0), 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*batch.schema.names[:-1], "score"])

    return textcore.tidy(run)


def score(docs: DataFrame, model: tuple[np.ndarray, Network], text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the calibrated probability of label 1."""
    base = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return base.withColumn(fresh(base.columns, "_text"), F.col(text)).mapInArrow(_score(shared), with_fields(base.schema, "score double"))
