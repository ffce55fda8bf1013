"""Language identification by interpolated Kneser-Ney character language models.

Texts become lower-cased letter sequences in which every run of other characters is one
boundary mark. For each language, counts of character n-grams up to ORDER give an
interpolated Kneser-Ney model; all languages' models share sorted arrays of n-gram hashes,
each with the list of languages that have it and their probabilities, and the same for
contexts and backoff weights. Memory follows what was seen, so any number of languages can be
learnt. A text takes the language with the lowest cross-entropy per character.
Its score is the softmax of the differences, times a temperature; where the entropy of the
best model exceeds that of nearly all rows of its language, the row is marked rejected. Both
are fitted on sampled rows (CALIBRATION of them, by a hash) that are kept out of the counts.

The sample that is learnt from: rows are kept by a hash of their id at a rate that gives
about PER_LANGUAGE rows a language, whole texts; n-grams are counted in Spark, and of the
calibration rows only entropies come to the driver.

Defined cases: null text or text without letters gives ``und`` with score 0; with no
training rows every text is ``und``; ties go to the language that sorts first; rows with
null lang or null id are never learnt from; null, repeated and large ids are carried through; an empty
table gives an empty one; very long texts count whole; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, remainder, settle, uniform
from .textscan import mix

ORDER = 4
PER_LANGUAGE = 2000
CALIBRATION = 0.15
CELLS = 1 << 22
PIECE_CHARS = 1 << 20
DISCOUNT = 0.75
REJECT_AT = 0.999
_U = np.uint64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point: its lower-case letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if unicodedata.category(char)[0] == "L":
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else code
    return out


def letter_sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts with single boundary marks (0) between words, before and after; and the ends of each text."""
    joined = "\x00".join(texts)
    codes = _letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0  # the first mark after a word
    at = np.flatnonzero(keep)
    cut = np.searchsorted(at, np.concatenate([starts, [len(codes) + 1]]))
    return codes[at], cut


def _chunks(texts: list[str]):
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PIECE_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def learnt_rows(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, text of the sample: about per_language rows of each language, by a hash of the id."""
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(4) != 2))
    sizes = settle(rows.groupBy("lang").agg(F.count("*").alias("n__")))
    drawn = rows.withColumn("draw__", uniform("doc_id", "langid"))
    return join_spread(drawn, sizes, "lang").where(F.col("draw__") < per_language / F.col("n__")).select("doc_id", "lang", "text")


def count_grams(sample: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram, n: character n-grams of the highest order, counted in Spark."""

    def run(frames):
        for frame in frames:
            for lang, part in frame.groupby("lang", sort=True):
                texts = part["text"].tolist()
                for lo, hi in _chunks(texts):
                    codes, cut = letter_sequences(texts[lo:hi])
                    if not len(codes):
                        continue
                    size = np.diff(cut)
                    wide = np.zeros(len(codes) + len(size) * (order - 1), np.uint32)
                    at = np.repeat(np.arange(len(size)) * (order - 1), size) + np.arange(len(codes)) + order - 1
                    wide[at] = codes
                    rows = np.lib.stride_tricks.sliding_window_view(wide, order)[at - order + 1]
                    grams, n = np.unique(np.ascontiguousarray(rows).view(f"V{4 * order}").ravel(), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": [g.tobytes() for g in grams], "n": n})

    return sample.select("lang", "text").mapInPandas(run, "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class _Ragged:
    """Sorted hashes, each with the languages that have it and a value for each of these."""

    def __init__(self, keys: np.ndarray, column: np.ndarray, values: np.ndarray):
        order = np.lexsort((column, keys))
        self.column, self.values = column[order].astype(np.int32), values[order]
        self.keys, first = np.unique(keys[order], return_index=True)
        self.offs = np.append(first, len(order))

    def fill(self, out: np.ndarray, keys: np.ndarray) -> None:
        """Put the values of known keys into out (rows: keys, columns: languages)."""
        if not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        row = np.flatnonzero(self.keys[at] == keys)
        begin, size = self.offs[at[row]], np.diff(self.offs)[at[row]]
        entry = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        out[np.repeat(row, size), self.column[entry]] = self.values[entry]


class Model:
    """Sorted hashes of n-grams with probabilities, and of contexts with backoff weights, by language."""

    def __init__(self, counts: pd.DataFrame, order: int = ORDER, discount: float = DISCOUNT):
        self.order = order
        self.langs = sorted(counts["lang"].unique())
        column = counts["lang"].map({x: i for i, x in enumerate(self.langs)}).to_numpy(np.int64)
        grams = np.frombuffer(b"".join(counts["gram"]), np.uint32).reshape(-1, order)
        n = counts["n"].to_numpy(np.float64)
        levels = []
        for size in range(order, 0, -1):  # raw counts at the top, numbers of distinct left neighbours below
            levels.append((size, grams, column, n))
            if size > 1:
                low, kinds = np.unique(np.concatenate([grams[:, 1:], column[:, None].astype(np.uint32)], axis=1), axis=0, return_counts=True)
                grams, column, n = low[:, :-1], low[:, -1].astype(np.int64), kinds.astype(np.float64)
        self.alphabet = max(2, len(np.unique(levels[-1][1])))
        self.grams: list[_Ragged] = []
        self.contexts: list[_Ragged] = []
        for size, rows, col, count in reversed(levels):
            context = _hash_rows(rows[:, :-1]) if size > 1 else np.zeros(len(rows), _U)
            pair, first, at = np.unique(np.stack([context, col.astype(_U)], axis=1), axis=0, return_index=True, return_inverse=True)
            at = at.ravel()
            total, kinds = np.bincount(at, weights=count), np.bincount(at)
            weight = discount * kinds / total
            base = np.full(len(rows), 1.0 / (self.alphabet + 1))
            if size > 1:
                step = max(1, CELLS // len(self.langs))
                for lo in range(0, len(rows), step):
                    part = slice(lo, lo + step)
                    base[part] = self.probability(rows[part, 1:], size - 1)[np.arange(len(rows[part])), col[part]]
            self.grams.append(_Ragged(_hash_rows(rows), col, np.maximum(count - discount, 0) / total[at] + weight[at] * base))
            self.contexts.append(_Ragged(pair[:, 0], pair[:, 1].astype(np.int64), weight))
        self.temperature, self.limit = 1.0, np.full(len(self.langs), np.inf)

    def probability(self, rows: np.ndarray, size: int) -> np.ndarray:
        """Probabilities, one column a language, of the last character of each row of ``size`` characters."""
        if size == 0:
            return np.full((len(rows), len(self.langs)), 1.0 / (self.alphabet + 1))
        out = self.probability(rows[:, 1:], size - 1)
        weight = np.ones_like(out)
        self.contexts[size - 1].fill(weight, _hash_rows(rows[:, :-1]) if size > 1 else np.zeros(len(rows), _U))
        out *= weight
        self.grams[size - 1].fill(out, _hash_rows(rows))
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character under every language (rows: texts), and the numbers of letters."""
        k, order = len(self.langs), self.order
        out, letters = np.zeros((len(texts), k)), np.zeros(len(texts), np.int64)
        for lo, hi in _chunks(texts):
            codes, cut = letter_sequences(texts[lo:hi])
            size = np.diff(cut)
            if not len(codes):
                continue
            wide = np.zeros(len(codes) + len(size) * (order - 1), np.uint32)
            at = np.repeat(np.arange(len(size)) * (order - 1), size) + np.arange(len(codes)) + order - 1
            wide[at] = codes
            alphabet, small = np.unique(wide, return_inverse=True)
            base = _U(len(alphabet))
            code = np.zeros(len(codes), _U)
            for j in range(order):  # distinct n-grams of this piece: exact, the base is small
                code = code * base + small[at - order + 1 + j].astype(_U)
            if len(alphabet) ** order < 1 << 63:
                where, kinds = pd.factorize(code)
            else:
                where, kinds = pd.factorize(_hash_rows(np.lib.stride_tricks.sliding_window_view(wide, order)[at - order + 1]))
            first = np.zeros(len(kinds), np.int64)
            first[where[::-1]] = np.arange(len(where))[::-1]
            rows = np.lib.stride_tricks.sliding_window_view(wide, order)[(at - order + 1)[first]]
            owner = np.repeat(np.arange(len(size)), size)
            step = max(1, CELLS // k)
            sort = np.argsort(where, kind="stable")
            edge = np.searchsorted(where[sort], np.arange(0, len(rows) + step, step))
            for at_row, (a, b) in zip(range(0, len(rows), step), zip(edge, edge[1:])):
                bits = -np.log2(self.probability(rows[at_row : at_row + step], order))
                part = sort[a:b]
                for j in range(k):
                    out[lo:hi, j] += np.bincount(owner[part], weights=bits[where[part] - at_row, j], minlength=len(size)) / np.maximum(size, 1)
            letters[lo:hi] = np.bincount(owner, weights=codes != 0, minlength=len(size))
        return out, letters

    def calibrate(self, h: np.ndarray, truth: np.ndarray) -> None:
        """Temperature by likelihood on rows that weren't counted (entropies by language, true column); rejection limits by a quantile."""
        if not len(h):
            return
        best = -np.inf
        for t in (0.5, 1, 2, 4, 8, 16, 32):
            z = -h * t
            z -= z.max(axis=1, keepdims=True)
            fit = (z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean()
            if fit > best:
                best, self.temperature = fit, float(t)
        own = h[np.arange(len(h)), truth]
        for j in range(len(self.langs)):
            if (truth == j).any():
                self.limit[j] = np.quantile(own[truth == j], REJECT_AT) * 1.25

    def predict(self, texts: list[str]) -> pd.DataFrame:
        h, letters = self.entropies(texts)
        best = h.argmin(axis=1) if len(self.langs) else np.zeros(len(texts), np.int64)
        z = np.exp(-(h - h.min(axis=1, keepdims=True)) * self.temperature)
        score = z[np.arange(len(z)), best] / z.sum(axis=1)
        none = letters == 0
        names = np.array(self.langs, dtype=object)[best]
        names[none] = "und"
        low = h[np.arange(len(h)), best]
        return pd.DataFrame({"lang_pred": names, "score": np.where(none, 0.0, np.round(score, 6)), "bits_per_char": np.where(none, 0.0, np.round(low, 6)), "rejected": none | (low > self.limit[best])})


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    out = np.full(len(rows), rows.shape[1], dtype=_U)
    with np.errstate(over="ignore"):
        for j in range(rows.shape[1]):
            out = mix(out * _U(0x9E3779B97F4A7C15) + rows[:, j].astype(_U))
    return out


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model from the sample; None without training rows."""
    sample = settle(learnt_rows(docs, per_language))
    aside = uniform("doc_id", "calibration") < CALIBRATION
    counts = count_grams(sample.where(~aside)).orderBy("lang", "gram").toPandas()
    if not len(counts):
        counts = count_grams(sample).orderBy("lang", "gram").toPandas()  # a handful of rows, all set aside by chance
    if not len(counts):
        return None
    model = Model(counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        places = {x: i for i, x in enumerate(shared.value.langs)}
        for batch in batches:
            h, letters = shared.value.entropies(batch.column("text").to_pylist())
            truth = np.array([places.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            use = (letters > 0) & (truth >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(truth[use]), pa.array(list(h[use]), pa.list_(pa.float64()))], ["truth", "h"])

    found = sample.where(aside).select("lang", "text").mapInArrow(run, "truth long, h array<double>").toPandas()
    if len(found):
        model.calibrate(np.stack(found["h"].to_list()), found["truth"].to_numpy(np.int64))
    return model


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_char, rejected for every document."""
    model = model or fit(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column("text").to_pylist()]
            if shared.value is None:
                out = pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0, "bits_per_char": 0.0, "rejected": True})
            else:
                out = shared.value.predict(texts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out["lang_pred"], pa.string()), *[pa.array(out[c]) for c in ("score", "bits_per_char", "rejected")]], ["doc_id", "held_out", "lang_pred", "score", "bits_per_char", "rejected"])

    rows = docs.select("doc_id", "text", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits_per_char double, rejected boolean")
