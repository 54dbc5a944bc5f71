"""Operator 8: a quality classifier on random-indexing word vectors.

Words are hashed to ``BUCKETS`` rows. Each row has a fixed sparse index vector with ``NONZERO`` entries of +1 or -1. One
pass over all documents adds, to the row of each word, the index vectors of its left and right neighbours: integer sums,
so the order of documents doesn't matter. A document is the mean of its words' rows, each scaled to unit length, with
the share of rarer words, the likeness of neighbours, the share of distinct words and the length beside it. A network of two layers is trained in numpy on a bounded sample of
labelled rows, its temperature is fitted on rows that it didn't see, and every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, mix, text_bytes, word_hashes

BUCKETS, DIM, NONZERO = 1 << 14, 64, 4
SLICE = 256  # rows of vectors that travel together
FEATURES = DIM + 4
STEP = 1 << 16  # words of a text that are looked at together


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's index vector, drawn by a hash."""
    draw = mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(0xA5A5)).reshape(BUCKETS, NONZERO)
    return (draw % np.uint64(DIM)).astype(np.int64), np.where(draw >> np.uint64(63) == 0, 1, -1).astype(np.int64)


def _parts(raw: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A long text cut at white space; a word above ``size`` bytes is cut too, and counts as several."""
    at = 0
    while len(raw) - at > size:
        end = max(raw.rfind(c, at, at + size) for c in (b" ", b"\n", b"\t"))
        end = end if end > at else at + size
        yield raw[at:end]
        at = end
    yield raw[at:]


def _rows(raw: bytes) -> np.ndarray:
    return np.concatenate([(word_hashes(x)[0][0] >> np.uint64(50)).astype(np.int32) for x in _parts(raw)])


def neighbours(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of neighbours' index vectors, and counts, of every row, over all documents. ``docs``: text."""

    def add(batches):
        places, signs = index_vectors()
        total, count = np.zeros(BUCKETS * DIM, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        keys, weights, held = [], [], 0

        def flush():
            nonlocal keys, weights, held, total
            if keys:
                total += np.bincount(np.concatenate(keys), weights=np.concatenate(weights), minlength=BUCKETS * DIM).astype(np.int64)
            keys, weights, held = [], [], 0

        for batch in batches:
            for raw in text_bytes(batch.column(0)):
                rows = _rows(raw)
                count += np.bincount(rows, minlength=BUCKETS)
                for at in range(0, len(rows) - 1, STEP):
                    part = rows[at : at + STEP + 1]
                    for a, b in ((part[:-1], part[1:]), (part[1:], part[:-1])):
                        keys.append((a[:, None] * DIM + places[b]).ravel())
                        weights.append(signs[b].ravel())
                        held += len(a) * NONZERO
                    if held > 4_000_000:
                        flush()
        flush()
        table = np.concatenate([total.reshape(BUCKETS, DIM), count[:, None]], axis=1)
        for s in range(BUCKETS // SLICE):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([table[s * SLICE : (s + 1) * SLICE].astype("<i8").tobytes()], pa.binary())], names=["s", "v"])

    def total(batches):
        """Running sums by slice: a partition holds its slices' sums and nothing else."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(v, dtype="<i8")
                sums[s] = sums[s] + x if s in sums else x.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["s", "v"])

    table = np.zeros((BUCKETS, DIM + 1), dtype=np.int64)
    for r in docs.mapInArrow(frugal(add), "s int, v binary").repartition("s").mapInArrow(total, "s int, v binary").toLocalIterator():
        table[r["s"] * SLICE : (r["s"] + 1) * SLICE] += np.frombuffer(r["v"], dtype="<i8").reshape(SLICE, DIM + 1)
    return table[:, :DIM], table[:, DIM]


@dataclass(frozen=True)
class Vectors:
    rows: np.ndarray  # float32, of unit length
    rare: np.ndarray  # whether a row is in the rarer half of all words

    @staticmethod
    def of(sums: np.ndarray, counts: np.ndarray) -> Vectors:
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        order = np.argsort(counts, kind="stable")
        half = np.cumsum(counts[order]) <= counts.sum() / 2
        rare = np.zeros(len(counts), dtype=bool)
        rare[order] = half
        return Vectors((sums / np.maximum(length, 1)).astype(np.float32), rare)

    def pooled(self, raw: bytes) -> np.ndarray:
        out = np.zeros(FEATURES, dtype=np.float64)
        rows = _rows(raw)
        if n := len(rows):
            alike, seen = 0.0, np.zeros(len(self.rare), dtype=bool)
            for at in range(0, n, STEP):
                part = rows[at : at + STEP + 1]  # its last is the next part's first
                picked = self.rows[part]
                out[:DIM] += picked[:STEP].sum(axis=0, dtype=np.float64)
                alike += float((picked[1:] * picked[:-1]).sum(axis=1).sum(dtype=np.float64))
                seen[part] = True
            out[:DIM] /= n
            out[DIM:] = self.rare[rows].mean(), alike / max(1, n - 1), seen.sum() / n, np.log1p(n) / 10
        return out


@dataclass
class Network:
    """Two layers; ``probability`` is calibrated by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 256, rate: float = 0.005, decay: float = 1e-4, seed: int = 7) -> Network:
        """Adam on the log loss. Without both labels every document gets the share of label 1, 0.5 if there are none."""
        width = x.shape[1]
        if not len(y) or y.min() == y.max():
            share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
            return Network(np.zeros(width), np.ones(width), np.zeros((width, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
        draw = np.random.default_rng(seed)
        calibrate = np.zeros(len(y), dtype=bool)
        calibrate[draw.permutation(len(y))[: len(y) // 5]] = True
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z, t = ((x - mean) / scale)[~calibrate], y[~calibrate].astype(np.float64)
        p = [draw.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            order = draw.permutation(len(t))
            for at in range(0, len(order), batch):
                i = order[at : at + batch]
                h = np.tanh(z[i] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - t[i]) / len(i)
                back = np.outer(d, p[2]) * (1 - h * h)
                step += 1
                for k, g in enumerate((z[i].T @ back + decay * p[0], back.sum(axis=0), h.T @ d + decay * p[2], np.array([d.sum()]))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
        if calibrate.any():
            logits, t = net.logit(x[calibrate]), y[calibrate]
            loss = lambda k: np.logaddexp(0, np.where(t == 1, -1, 1) * logits / k).mean()
            net.temperature = float(min(np.exp(np.linspace(-1, 3, 81)), key=loss))
        return net


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", most_labelled: int = 20_000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``.

    The word vectors are of all documents. The network is fitted on ``most_labelled`` labelled rows at most, the first by
    a hash of the id, none of them held out. A null or empty text has all features 0 and still a score. Labels of null id
    or value are left out; an id labelled both ways counts as 0. Null ids are never held out nor learnt from. Repeated rows
    are scored each. Other columns are ignored; an empty table gives no rows. A long text is pooled part by part. Ids are
    whole numbers, or strings of such.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    vectors = spark.sparkContext.broadcast(Vectors.of(*neighbours(plain.select("text"))))
    known = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().where(~held_out(F.col("doc_id")))
    few = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    few = spark.createDataFrame([tuple(r) for r in few.collect()], "doc_id long, y int")

    def features(batches):
        for batch in batches:
            rows = [vectors.value.pooled(raw).astype("<f8").tobytes() for raw in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["doc_id", "y", "x"])

    sample = plain.join(F.broadcast(few), "doc_id").select("doc_id", "text", "y")
    got = sorted((r["doc_id"], bytes(r["x"]), r["y"]) for r in sample.mapInArrow(frugal(features), "doc_id long, y int, x binary").collect())
    x = np.array([np.frombuffer(r[1], dtype="<f8") for r in got]).reshape(-1, FEATURES)
    network = spark.sparkContext.broadcast(Network.fit(x, np.array([r[2] for r in got], dtype=np.int64)))

    def score(batches):
        for batch in batches:
            x = np.array([vectors.value.pooled(raw) for raw in text_bytes(batch.column(1))]).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.value.probability(x))], names=["doc_id", "score"])

    scored = plain.mapInArrow(frugal(score), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
