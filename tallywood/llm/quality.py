"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: tf weights of its words hashed into WORD_BUCKETS, structure
statistics of its text, and as metadata n_chars where the table has it (null and absent are
told apart from 0). lang, source, labels and doc_id are no inputs. The machine's score is w0 + sum w x + 1/2 sum_f ((sum v_f x)^2 - sum v_f^2 x^2): the
sum-of-squares identity makes it linear in the number of entries.

The sample that is learnt from: labelled rows whose crc32 remainder is not 0, kept by a
hash of the id at a rate that gives about MAX_LABELLED rows. Whole texts are encoded by the
tasks; a row that comes to the driver has at most WORD_BUCKETS + STATS entries, however long its text.

Defined cases: null and empty texts have no words and get the score of their statistics;
null labels and null ids are not learnt from; repeated labels of a document count as
often as they are given; without labels of both kinds the score is the share of label 1
(0.5 with none at all); very long texts count whole; repeated rows get equal scores; an
empty table gives an empty one; other columns, whatever their names, are passed over.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, tidy, uniform
from .textscan import SPACE, pieces, words

WORD_BUCKETS = 1 << 15
FACTORS = 8
MAX_LABELLED = 4000
EPOCHS = 12
THRESHOLD = 0.3
STATS = 18
PIECE = 1 << 18
_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_LINE = _BYTE == 10
_HIGH = _BYTE >= 128
_STOP = np.isin(_BYTE, [ord(c) for c in ".,;:?'\""])
_MARK = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _STOP | SPACE) & (_BYTE > 31)


def encode(column: pa.Array, chars: np.ndarray):
    """Sparse rows of a string column and its n_chars (nan: unknown), piece by piece: (row offsets, feature index, value)."""
    for piece in pieces(column, PIECE):
        w = words(piece)
        n, data = len(piece), piece.data
        counts = np.diff(w.offs)
        owner = np.repeat(np.arange(n), counts)
        bucket = (w.hashes & np.uint64(WORD_BUCKETS - 1)).astype(np.int64)
        key, tf = np.unique(owner * WORD_BUCKETS + bucket, return_counts=True)
        row, index = key // WORD_BUCKETS, key % WORD_BUCKETS
        value = np.log1p(tf)
        norm = np.sqrt(np.bincount(row, weights=value**2, minlength=n))
        value = value / np.maximum(norm, 1e-9)[row]

        size = np.diff(piece.offs).astype(np.float64)
        sums = np.concatenate([np.zeros((7, 1)), np.cumsum(np.stack([t[data] for t in (_UPPER, _LOWER, _DIGIT, _LINE, _HIGH, _STOP, _MARK)]), axis=1, dtype=np.float64)], axis=1)
        share = np.diff(sums[:, piece.offs], axis=1)
        distinct = np.bincount(row, minlength=n)
        repeats = np.zeros(n)
        if len(w.hashes) > 1:
            same = (w.hashes[1:] == w.hashes[:-1]) & (owner[1:] == owner[:-1])
            repeats = np.bincount(owner[1:], weights=same, minlength=n)
        length = np.bincount(owner, weights=w.ends - w.starts, minlength=n)
        given = chars[piece.lo : piece.hi]
        some, many = np.maximum(size, 1), np.maximum(counts, 1)
        stats = np.stack([np.ones(n), *(4 * share[[0, 1, 2, 4, 5, 6]] / some), 20 * share[3] / some, np.log1p(size) / 5, np.log1p(counts) / 5, 2 * distinct / many, 4 * repeats / many, length / many / 5, np.log1p(size / (share[3] + 1)) / 3, (counts == 0) * 1.0, np.minimum(counts, 8) / 8, np.isnan(given) * 1.0, np.log1p(np.maximum(np.nan_to_num(given), 0)) / 6])
        s_row = np.repeat(np.arange(n), STATS)
        order = np.argsort(np.concatenate([row, s_row]), kind="stable")
        rows = np.concatenate([row, s_row])[order]
        yield np.searchsorted(rows, np.arange(n + 1)), np.concatenate([index, np.tile(np.arange(STATS) + WORD_BUCKETS, n)])[order], np.concatenate([value, stats.T.ravel()])[order]


class Machine:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.w = 0.0, np.zeros(WORD_BUCKETS + STATS)
        self.v = rng.normal(0, 0.02, (WORD_BUCKETS + STATS, FACTORS))

    def raw(self, offs, index, value) -> np.ndarray:
        """Scores before the logistic function, in time linear in the number of entries."""
        if len(offs) < 2:
            return np.zeros(0)
        vx = self.v[index] * value[:, None]
        linear = np.add.reduceat(self.w[index] * value, offs[:-1])
        total = np.add.reduceat(vx, offs[:-1], axis=0)
        squares = np.add.reduceat(vx**2, offs[:-1], axis=0)
        return self.bias + linear + 0.5 * (total**2 - squares).sum(axis=1)

    def fit(self, data: list[tuple], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.08, decay: float = 1e-5, seed: int = 7) -> Machine:
        """Mini-batch AdaGrad on logistic loss; data: (index, value) of each row."""
        rng = np.random.default_rng(seed)
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.001, 0.999))
        self.bias = float(np.log(share / (1 - share)))
        if not 0 < labels.sum() < len(labels):
            return self
        seen_w, seen_v, seen_b = np.full(self.w.shape, 1e-4), np.full(self.v.shape, 1e-4), 1e-4
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for lo in range(0, len(order), batch):
                rows = order[lo : lo + batch]
                index = np.concatenate([data[r][0] for r in rows])
                value = np.concatenate([data[r][1] for r in rows])
                sizes = np.array([len(data[r][0]) for r in rows])
                offs = np.concatenate([[0], np.cumsum(sizes)])
                vx = self.v[index] * value[:, None]
                total = np.add.reduceat(vx, offs[:-1], axis=0)
                z = self.bias + np.add.reduceat(self.w[index] * value, offs[:-1]) + 0.5 * (total**2 - np.add.reduceat(vx**2, offs[:-1], axis=0)).sum(axis=1)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[rows]) / len(rows)
                e = np.repeat(error, sizes) * value
                used, at = np.unique(index, return_inverse=True)
                gw = np.bincount(at, weights=e) + decay * self.w[used]
                part = e[:, None] * (np.repeat(total, sizes, axis=0) - vx)
                gv = np.stack([np.bincount(at, weights=part[:, f]) for f in range(FACTORS)], axis=1) + decay * self.v[used]
                seen_w[used] += gw**2
                seen_v[used] += gv**2
                seen_b += error.sum() ** 2
                self.w[used] -= rate * gw / np.sqrt(seen_w[used])
                self.v[used] -= 0.5 * rate * gv / np.sqrt(seen_v[used])
                self.bias -= rate * error.sum() / np.sqrt(seen_b)
        return self

    def score(self, offs, index, value) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(offs, index, value), -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, text, label: about ``limit`` labelled rows outside the held-out fold, by a hash of the id."""
    marks = labels.select("doc_id", F.col(column).cast("int").alias("label")).where(F.col("label").isNotNull() & (remainder(5) != 0))
    n = marks.count()
    chosen = marks.where(uniform("doc_id", column) < min(1.0, limit / max(1, n)))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), _chars(docs)).join(F.broadcast(chosen), "doc_id")  # at most about limit rows


def _chars(docs: DataFrame):
    return (F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")).alias("n_chars__")


def _given(batch) -> np.ndarray:
    return batch.column("n_chars__").to_numpy(zero_copy_only=False).astype(np.float64)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", limit: int = MAX_LABELLED) -> Machine:
    def rows(batches):
        for batch in batches:
            lo = 0
            for offs, index, value in encode(batch.column("text"), _given(batch)):
                part = batch.slice(lo, len(offs) - 1)
                lo += len(offs) - 1
                at = pa.array(offs.astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.ListArray.from_arrays(at, pa.array(index.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32)))], ["doc_id", "label", "at", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = labelled_sample(docs, labels, column, limit).mapInArrow(tidy(rows), f"doc_id {kind}, label int, at array<int>, x array<float>").toArrow()
    at, x = (sample.column(c).combine_chunks() if len(sample) else pa.array([], pa.list_(pa.int32())) for c in ("at", "x"))
    data = [(np.asarray(a.values), np.asarray(b.values)) for a, b in zip(at, x)]
    ids, marks = sample.column("doc_id").to_pylist(), sample.column("label").to_pylist()
    order = sorted(range(len(data)), key=lambda i: (ids[i], marks[i], len(data[i][0]), data[i][0].tobytes(), data[i][1].tobytes()))  # one order in any partitioning
    return Machine().fit([data[i] for i in order], np.array([marks[i] for i in order], np.float64))


def score_quality(docs: DataFrame, labels: DataFrame | None = None, machine: Machine | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    machine = machine or fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, scores in _scores(shared.value, batch.column("text"), _given(batch)):
                rows = batch.slice(lo, len(scores))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", _chars(docs), F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, score double, predicted int")


def _scores(machine: Machine, column: pa.Array, chars: np.ndarray):
    lo = 0
    for offs, index, value in encode(column, chars):
        scores = np.round(machine.score(offs, index, value), 6)
        yield lo, scores
        lo += len(scores)


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with score >= threshold, all columns. A row is scored in place, so repeated ids are no matter."""
    shared, given = docs.sparkSession.sparkContext.broadcast(fit(docs, labels)), "n_chars" in docs.columns

    def run(batches):
        for batch in batches:
            chars = batch.column("n_chars").cast(pa.float64()).to_numpy(zero_copy_only=False) if given else np.full(batch.num_rows, np.nan)
            scores = [s for _, s in _scores(shared.value, batch.column("text"), chars)]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def accuracy(scored: DataFrame, labels: DataFrame, column: str) -> pd.DataFrame:
    """Held-out rows by label and prediction."""
    return scored.where("held_out").join(labels.select("doc_id", column), "doc_id").groupBy(column, "predicted").agg(F.count("*").alias("n")).orderBy(column, "predicted").toPandas()
