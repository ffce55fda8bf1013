"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own embedding (hashed) plus the scaled sum of embeddings of its hashed
character 3- and 5-grams (word edges included); of a weight for each gram the word's greatest
goes into one direction. Word embeddings and gram weights start from the training rows' lift
and are trained with the rest. Windows of WINDOW words, each starting half a window after the one
before, go through a gated recurrent unit in both directions; attention pools the states
of a window into one logit. A document's score is that of its most toxic window, so that
one passage in a long text counts as much as a short text does. Every overlapping window
of every whole text is scored.

The sample that is learnt from: labelled rows whose crc32 remainder is not 0, kept by a
hash of the id at a rate that gives about MAX_LABELLED rows. Training, as scoring, takes
all windows of a text: they go forward in batches, and the loss is put on the most toxic.

Defined cases: null and empty texts have no window and get the training rows' share of
label 1; null labels and ids are not learnt from; repeated labels count as often as they are
given; with labels of one kind only, every score is that share (0.5 without labels); ties
between windows go to the first; very long texts are scored whole, in batches of windows;
repeated rows get equal scores; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder
from .quality import labelled_sample
from .textscan import LOWER, Piece, mix, pieces, stripped, words

WINDOW = 32
STRIDE = WINDOW // 2
HIDDEN = 8
EMBED = 12
WORD_BUCKETS = 1 << 15
CHAR_BUCKETS = 1 << 16
MAX_LABELLED = 4000
BATCH_WINDOWS = 4096
THRESHOLD = 0.5
_U = np.uint64


class Vocabulary:
    """Distinct words of a piece: bucket of each, and hashed character grams in ragged form."""

    def __init__(self, piece: Piece):
        w = words(piece)
        kinds, first, where = np.unique(w.hashes, return_index=True, return_inverse=True)
        self.offs, self.where = w.offs, where.astype(np.int32)
        self.bucket = (kinds & _U(WORD_BUCKETS - 1)).astype(np.int64)
        data = LOWER[piece.data].astype(_U)
        starts, ends = w.starts[first], w.ends[first]
        size = ends - starts
        begin = np.concatenate([[0], np.cumsum(size + 4)])[:-1]  # two edge marks before and after each word
        inner = np.arange(int(size.sum()))
        word = np.repeat(np.arange(len(size)), size)
        at = inner + 4 * word + 2
        wide = np.zeros(int((size + 4).sum()) + 1, _U)
        wide[at] = data[inner - np.repeat(np.cumsum(size) - size - starts, size)]
        with np.errstate(over="ignore"):
            three = (wide[at - 1] << _U(16)) | (wide[at] << _U(8)) | wide[at + 1]
            five = (wide[at - 2] << _U(40)) | (three << _U(8)) | wide[at + 2] | _U(1 << 50)
            grams = (mix(np.stack([three, five], axis=1).ravel()) & _U(CHAR_BUCKETS - 1)).astype(np.int32)
        self.grams = grams
        begin, size = 2 * (np.cumsum(size) - size), 2 * size
        self.begin, self.size = begin, size


def windows(offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, words) of every window."""
    n = np.diff(offs)
    count = np.where(n > 0, np.maximum(1, -(-(n - STRIDE) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    begin = offs[:-1][text] + k * STRIDE
    return text, begin, np.minimum(WINDOW, offs[1:][text] - begin)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    NAMES = ("words", "chars", "uf", "ub", "wf", "wb", "bf", "bb", "att", "out", "last", "evidence")

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        f = np.float32
        self.words = rng.normal(0, 0.1, (WORD_BUCKETS, e)).astype(f)
        self.chars = rng.normal(0, 0.02, (CHAR_BUCKETS, e)).astype(f)
        self.wf, self.wb = (rng.normal(0, e**-0.5, (e, 3 * h)).astype(f) for _ in range(2))
        self.uf, self.ub = (rng.normal(0, 0.5 * h**-0.5, (h, 3 * h)).astype(f) for _ in range(2))
        self.bf, self.bb = np.zeros(3 * h, f), np.zeros(3 * h, f)
        self.att = rng.normal(0, 0.3, 2 * h).astype(f)
        self.out, self.last = rng.normal(0, 0.3, 2 * h).astype(f), np.zeros(1, f)
        self.evidence = np.zeros(CHAR_BUCKETS, f)
        self.prior, self.trained = 0.5, False

    def embed(self, v: Vocabulary) -> np.ndarray:
        if not len(v.bucket):
            return np.zeros((0, EMBED), np.float32)
        chars = np.add.reduceat(self.chars[v.grams], v.begin, axis=0) / np.sqrt(v.size)[:, None].astype(np.float32)
        out = self.words[v.bucket] + chars
        out[:, 1] += np.maximum.reduceat(self.evidence[v.grams], v.begin)
        return out

    def _strongest(self, v) -> np.ndarray:
        """Place of each word's gram of the greatest weight; of ties the first."""
        weight = self.evidence[v.grams]
        best = np.repeat(np.maximum.reduceat(weight, v.begin), v.size) == weight
        at = np.flatnonzero(best)
        owner = np.repeat(np.arange(len(v.begin)), v.size)[at]
        return at[np.unique(owner, return_index=True)[1]]

    @staticmethod
    def unroll(x, u, mask, keep: bool):
        """Gated recurrent unit over x (steps, windows, 3 hidden); masked steps carry the state on."""
        steps, n = x.shape[:2]
        h = np.zeros((n, HIDDEN), np.float32)
        states, saved = np.empty((steps, n, HIDDEN), np.float32), []
        for t in range(steps):
            pre = h @ u
            zr = _sigmoid(x[t, :, : 2 * HIDDEN] + pre[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            c = np.tanh(x[t, :, 2 * HIDDEN :] + r * pre[:, 2 * HIDDEN :])
            m = mask[t][:, None]
            if keep:
                saved.append((h, z, r, c, pre[:, 2 * HIDDEN :], m))
            h = h + m * (1 - z) * (c - h)
            states[t] = h
        return states, saved

    @staticmethod
    def unroll_back(grad, saved, u):
        """Gradients of x and u from those of the states."""
        steps, n = grad.shape[:2]
        dx, du, dh = np.empty((steps, n, 3 * HIDDEN), np.float32), np.zeros_like(u), np.zeros((n, HIDDEN), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, c, pre, m = saved[t]
            dh = dh + grad[t]
            dc = dh * m * (1 - z) * (1 - c * c)
            dz = -dh * m * (c - h) * z * (1 - z)
            dr = dc * pre * r * (1 - r)
            dpre = np.concatenate([dz, dr, dc * r], axis=1)
            dx[t] = np.concatenate([dz, dr, dc], axis=1)
            du += h.T @ dpre
            dh = dh * (1 - m * (1 - z)) + dpre @ u.T
        return dx, du

    def forward(self, xf, xb, index, size, keep: bool = False):
        """Logits of windows. index: (windows, WINDOW) rows of the projected embeddings xf and xb."""
        steps = index.shape[1]
        mask = (np.arange(steps)[:, None] < size[None, :]).astype(np.float32)
        sf, kf = self.unroll(xf[index.T], self.uf, mask, keep)
        sb, kb = self.unroll(xb[index.T[::-1]], self.ub, mask[::-1], keep)
        sb = sb[::-1]
        energy = np.where(mask > 0, sf @ self.att[:HIDDEN] + sb @ self.att[HIDDEN:], -1e9)
        a = np.exp(energy - energy.max(axis=0))
        a /= a.sum(axis=0)
        each = sf @ self.out[:HIDDEN] + sb @ self.out[HIDDEN:]
        logit = (a * each).sum(axis=0) + self.last[0]
        return (logit, (mask, sf, sb, kf, kb, a, each)) if keep else logit

    def backward(self, d, kept, index, steps_x):
        """Gradients of all parameters but the embeddings, and those of the projected inputs by vocabulary row."""
        mask, sf, sb, kf, kb, a, each = kept
        g = {"last": np.array([d.sum()], np.float32)}
        deach = a * d
        denergy = a * (each - (a * each).sum(axis=0)) * d
        g["out"] = np.concatenate([np.tensordot(deach, s, axes=([0, 1], [0, 1])) for s in (sf, sb)])
        g["att"] = np.concatenate([np.tensordot(denergy, s, axes=([0, 1], [0, 1])) for s in (sf, sb)])
        h = HIDDEN
        df = deach[..., None] * self.out[:h] + denergy[..., None] * self.att[:h]
        db = deach[..., None] * self.out[h:] + denergy[..., None] * self.att[h:]
        dxf, g["uf"] = self.unroll_back(df, kf, self.uf)
        dxb, g["ub"] = self.unroll_back(db[::-1], kb, self.ub)
        flat = index.T.ravel()
        sums = []
        for dx in (dxf, dxb[::-1]):
            rows = dx.reshape(-1, 3 * h)
            sums.append(np.stack([np.bincount(flat, weights=rows[:, j], minlength=steps_x) for j in range(3 * h)], axis=1).astype(np.float32))
        return g, sums

    def project(self, e):
        return e @ self.wf + self.bf, e @ self.wb + self.bb

    # --- training ---------------------------------------------------------------------
    def fit(self, column: pa.Array, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 3) -> Network:
        """Adam on the logistic loss of each document's most toxic window."""
        self.prior = float(labels.mean()) if len(labels) else 0.5
        if not 0 < labels.sum() < len(labels):
            return self
        self.trained = True
        rng = np.random.default_rng(seed)
        docs = _training_rows(column)
        assert len(docs) == len(labels), "one row for each label"
        self._warm(docs, labels)
        m = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        v = {k: np.zeros_like(getattr(self, k)) for k in self.NAMES}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for lo in range(0, len(order), batch):
                rows = [r for r in order[lo : lo + batch] if len(docs[r].size)]
                if not rows:
                    continue
                step += 1
                vocabulary, where, begin, size, owner = _join([docs[r] for r in rows])
                e = self.embed(vocabulary)
                xf, xb = self.project(e)
                parts = [slice(lo, lo + BATCH_WINDOWS) for lo in range(0, len(begin), BATCH_WINDOWS)]
                logit = np.concatenate([self.forward(xf, xb, _index(where, begin[p]), size[p]) for p in parts])
                best = np.array([np.flatnonzero(owner == i)[logit[owner == i].argmax()] for i in range(len(rows))])
                index, size = _index(where, begin[best]), size[best]
                logit, kept = self.forward(xf, xb, index, size, keep=True)
                d = ((_sigmoid(np.clip(logit, -30, 30)) - labels[rows]) / len(rows)).astype(np.float32)
                g, (gf, gb) = self.backward(d, kept, index, len(e))
                g["wf"], g["wb"], g["bf"], g["bb"] = e.T @ gf, e.T @ gb, gf.sum(axis=0), gb.sum(axis=0)
                de = gf @ self.wf.T + gb @ self.wb.T
                g["words"] = _scatter(vocabulary.bucket, de, WORD_BUCKETS)
                each = np.repeat(de / np.sqrt(vocabulary.size)[:, None], vocabulary.size, axis=0)
                g["chars"] = _scatter(vocabulary.grams, each, CHAR_BUCKETS)
                g["evidence"] = np.bincount(vocabulary.grams[self._strongest(vocabulary)], weights=de[:, 1], minlength=CHAR_BUCKETS).astype(np.float32)
                pace = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k in self.NAMES:
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] ** 2 - v[k])
                    setattr(self, k, getattr(self, k) - (pace * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32))
        return self

    def _warm(self, docs, labels) -> None:
        """Smoothed log lift of label 1 among the training documents with a word or gram."""
        lift = []
        for name, n in (("bucket", WORD_BUCKETS), ("grams", CHAR_BUCKETS)):
            seen = np.zeros((2, n))
            for doc, y in zip(docs, labels):
                seen[int(y), np.unique(getattr(doc.vocabulary, name))] += 1
            lift.append(np.log((seen[1] + 10 * self.prior) / (seen.sum(axis=0) + 10) / self.prior).astype(np.float32))
        self.words[:, 0] += lift[0]
        self.evidence = lift[1]

    # --- scoring ----------------------------------------------------------------------
    def scores(self, column: pa.Array) -> np.ndarray:
        """Score of each text: its most toxic window's; the prior without words."""
        out = []
        for piece in pieces(column, 1 << 20):
            best = np.full(len(piece), -np.inf, np.float32)
            if self.trained:
                v = Vocabulary(stripped(piece))
                xf, xb = self.project(self.embed(v))
                text, begin, size = windows(v.offs)
                order = np.argsort(size, kind="stable")
                for lo in range(0, len(order), BATCH_WINDOWS):
                    part = order[lo : lo + BATCH_WINDOWS]
                    steps = int(size[part].max())
                    at = np.minimum(begin[part][:, None] + np.arange(steps), len(v.where) - 1)
                    np.maximum.at(best, text[part], self.forward(xf, xb, v.where[at], size[part]))
            none = np.isneginf(best)
            out.append(np.where(none, self.prior, _sigmoid(np.clip(np.where(none, 0, best), -30, 30).astype(np.float64))))
        return np.round(np.concatenate(out), 6) if out else np.zeros(0)


class _Row:
    __slots__ = ("begin", "size", "vocabulary")

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        _, self.begin, self.size = windows(vocabulary.offs)


def _index(where: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Vocabulary rows of the windows; those behind a window's words are masked."""
    return where[np.minimum(begin[:, None] + np.arange(WINDOW), len(where) - 1)]


def _training_rows(column: pa.Array | pa.ChunkedArray) -> list[_Row]:
    """One row for each text, empty ones too: pieces() may join an empty text with its neighbour, so texts go in alone."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return [_Row(Vocabulary(stripped(p))) for i in range(len(column)) for p in pieces(column.slice(i, 1))]


class _Joined:
    pass


def _join(rows: list[_Row]):
    """One vocabulary for several rows, their words side by side; and (first word, words, row) of every window."""
    v = _Joined()
    v.bucket = np.concatenate([r.vocabulary.bucket for r in rows])
    v.grams = np.concatenate([r.vocabulary.grams for r in rows])
    v.size = np.concatenate([r.vocabulary.size for r in rows])
    v.begin = np.concatenate([[0], np.cumsum(v.size)])[:-1]
    shift = np.cumsum([0, *[len(r.vocabulary.bucket) for r in rows]])[:-1]
    where = np.concatenate([r.vocabulary.where + s for r, s in zip(rows, shift)])
    shift = np.cumsum([0, *[len(r.vocabulary.where) for r in rows]])[:-1]
    begin = np.concatenate([r.begin + s for r, s in zip(rows, shift)])
    return v, where, begin, np.concatenate([r.size for r in rows]), np.repeat(np.arange(len(rows)), [len(r.size) for r in rows])


def _scatter(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, weights=rows[:, j], minlength=n) for j in range(rows.shape[1])], axis=1).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Network:
    sample = labelled_sample(docs, labels, "toxic", limit).orderBy("doc_id", "label").toArrow()
    return Network().fit(sample.column("text"), np.array(sample.column("label").to_pylist(), np.float64))


def score_toxicity(docs: DataFrame, labels: DataFrame | None = None, network: Network | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    network = network or fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            scores = shared.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", "text", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
