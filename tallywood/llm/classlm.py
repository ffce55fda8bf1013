"""Language-model scoring with Brown class-based bigrams found by exchange clustering.

Every word has a class of its own, found in two steps. At first a word belongs to a unit: each
of the WORDS most frequent words is one, all other words share GROUPS units by their last three
bytes, and the end of a text is one. The exchange algorithm moves units between CLASSES classes
as long as the likelihood of the class bigrams rises. From there every word of the training texts
is exchanged by itself in Spark, however rare: the classes before and after all its occurrences are
counted, and it goes to the class where the likelihood is highest, all words at once against
the counts of the first step (listed words by the exact change, all others by its first order,
which is a product of matrices). A word that isn't in the training texts has its unit's class. A token's probability is that of its class after the class before
it (counts smoothed with the class's own share) times that of the word in its class
(additive smoothing; all unseen words of a class share one type).

The corpus statistics come from all training rows. Counts and classes of the LISTED most frequent
words are broadcast; all other words stay in Spark: their occurrences, with both neighbours, are
shuffled by word, which gives the word's class and count, and then by document, where neighbours meet. A word outside the list
has a share of less than SHARE of the tokens, so no word gathers much of the corpus.

Defined cases: null text is empty; a text without words is its end token alone; null ids
are scored and not learnt from; equal rows get equal scores; with no training rows every
token has the base probability of an unseen one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import remainder, settle
from .textscan import LOWER, mix, pieces, words

WORDS = 768
GROUPS = 256
CLASSES = 48
UNITS = 1 + WORDS + GROUPS
LISTED = 1 << 16
SHARE = 2e-5
DELTA = 0.5
STRENGTH = 20.0
SWEEPS = 12
BLOCK = 512
_U = np.uint64


def row_key():
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def split(docs: DataFrame, *extra) -> DataFrame:
    """row, text, train and the named columns."""
    return docs.select(row_key().alias("row"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(remainder(7) != 2, F.lit(False)).alias("train"), *extra)


def frequent_words(docs: DataFrame) -> np.ndarray:
    """Hashes of listed words, the most frequent first.

    Counted in the pieces of text where they make up SHARE of the tokens; a word with that
    share of all tokens has it in some piece, in any partitioning.
    """

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column("text")):
                kinds, n = np.unique(words(piece).hashes, return_counts=True)
                some = n >= max(2, SHARE * n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(kinds[some].view(np.int64)), pa.array(n[some])], ["h", "n"])

    train = split(docs).where("train").select("text")
    found = train.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return found.orderBy(F.desc("n"), "h").limit(LISTED).toArrow().column("h").to_numpy().view(_U).copy()


@dataclass
class Vocabulary:
    """Sorted hashes of listed words and the unit of each (0: by its ending)."""

    hashes: np.ndarray
    units: np.ndarray

    @classmethod
    def of(cls, ranked: np.ndarray) -> Vocabulary:
        units = np.zeros(len(ranked), np.int64)
        units[:WORDS] = np.arange(min(WORDS, len(ranked))) + 1
        order = np.argsort(ranked)
        return cls(ranked[order], units[order])

    def find(self, piece, w):
        """(place in the list or -1, unit) of each word."""
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, w.hashes), len(self.hashes) - 1)
            at = np.where(self.hashes[at] == w.hashes, at, -1)
            unit = np.where(at >= 0, self.units[at], 0)
        else:
            at, unit = np.full(len(w.hashes), -1), np.zeros(len(w.hashes), np.int64)
        by_ending = unit == 0
        start, end = w.starts[by_ending], w.ends[by_ending]
        code = np.zeros(len(start), _U)
        for back in (1, 2, 3):
            code = (code << _U(8)) | np.where(end - back >= start, LOWER[piece.data[np.maximum(end - back, 0)]], 0).astype(_U)
        unit[by_ending] = 1 + WORDS + (mix(code) % _U(GROUPS)).astype(np.int64)
        return at, unit


def with_ends(values: np.ndarray, offs: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """Values of all texts with ``end`` behind each text; and the offsets."""
    n = len(offs) - 1
    out = np.full(len(values) + n, end, dtype=values.dtype)
    owner = np.repeat(np.arange(n), np.diff(offs))
    out[np.arange(len(values)) + owner] = values
    return out, offs + np.arange(n + 1)


def corpus_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows of two kinds: 0 unit bigrams (a, b, n), 1 listed words (a, b = unit, n)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocabulary = shared.value
        grams, listed, units = np.zeros(UNITS * UNITS, np.int64), np.zeros(len(vocabulary.hashes), np.int64), np.zeros(len(vocabulary.hashes), np.int64)
        for batch in batches:
            for piece in pieces(batch.column("text")):
                w = words(piece)
                at, unit = vocabulary.find(piece, w)
                line, _ = with_ends(unit, w.offs, 0)
                pair, n = np.unique(np.concatenate([[0], line[:-1]]) * UNITS + line, return_counts=True)  # each text stands behind the end of another or the start
                grams[pair] += n
                listed += np.bincount(at[at >= 0], minlength=len(listed))
                units[at[at >= 0]] = unit[at >= 0]
        for kind, some, a, b, n in ((0, np.flatnonzero(grams), lambda x: x // UNITS, lambda x: x % UNITS, grams), (1, np.flatnonzero(listed), lambda x: x, lambda x: units[x], listed)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(a(some)), pa.array(b(some)), pa.array(n[some])], ["kind", "a", "b", "n"])

    found = split(docs).where("train").select("text").mapInArrow(run, "kind int, a long, b long, n long")
    return found.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def _plogp(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(grams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit; unit 0 (the end) keeps class 0 alone.

    Maximises sum N(c,d) log N(c,d) - sum N(c,.) log N(c,.) - sum N(.,d) log N(.,d); a unit moves
    to the class that gains most, in order of falling frequency, until a sweep moves none.
    """
    n = len(grams)
    mass = grams.sum(axis=1) + grams.sum(axis=0)
    order = [u for u in np.argsort(-mass, kind="stable") if u and mass[u] > 0]
    where = np.zeros(n, np.int64)
    where[1:] = 1 + np.arange(n - 1) % (classes - 1)
    where[order] = 1 + np.arange(len(order)) % (classes - 1)
    one = np.zeros((n, classes))
    one[np.arange(n), where] = 1
    table = one.T @ grams @ one
    right, left = grams @ one, grams.T @ one  # of each unit: counts by the class after and before it
    for _ in range(sweeps):
        moved = 0
        for u in order:
            a, own = where[u], grams[u, u]
            r, l = right[u].copy(), left[u].copy()  # noqa: E741
            r[a] -= own
            l[a] -= own
            table[a] -= r
            table[:, a] -= l
            table[a, a] -= own
            row, col = table.sum(axis=1), table.sum(axis=0)
            gain = (_plogp(table + r) - _plogp(table)).sum(axis=1) + (_plogp(table + l[:, None]) - _plogp(table)).sum(axis=0)
            d = np.diagonal(table)
            gain += _plogp(d + r + l + own) - _plogp(d + r) - _plogp(d + l) + _plogp(d)
            gain -= _plogp(row + r.sum() + own) - _plogp(row) + _plogp(col + l.sum() + own) - _plogp(col)
            gain[0] = -np.inf
            b = int(gain.argmax()) if gain.max() > gain[a] + 1e-9 else a
            table[b] += r
            table[:, b] += l
            table[b, b] += own
            if b != a:
                moved += 1
                where[u] = b
                right[:, a] -= grams[:, u]
                right[:, b] += grams[:, u]
                left[:, a] -= grams[u]
                left[:, b] += grams[u]
        if not moved:
            break
    return where


def table_of(grams: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Class bigrams of unit bigrams."""
    one = np.zeros((len(grams), CLASSES))
    one[np.arange(len(grams)), where] = 1
    return one.T @ grams @ one


def likelihood(table: np.ndarray) -> float:
    """What the exchange raises: the class part of the log likelihood."""
    return float(_plogp(table).sum() - _plogp(table.sum(axis=0)).sum() - _plogp(table.sum(axis=1)).sum())


def best_exact(table: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Best class of each word, from counts of the classes after and before it; its own class is taken without it."""
    out = own.copy()
    row, col = table.sum(axis=1), table.sum(axis=0)
    for lo in range(0, len(own), 64):
        some = slice(lo, lo + 64)
        r, l, a = right[some], left[some], own[some]  # noqa: E741
        i = np.arange(len(a))
        to, of, n_to, n_of = (np.repeat(x[None], len(a), axis=0) for x in (table, table.T, row, col))
        to[i, a] -= r
        of[i, a] -= l
        n_to[i, a] -= r.sum(axis=1)
        n_of[i, a] -= l.sum(axis=1)
        to, of, n_to, n_of = (np.maximum(x, 0) for x in (to, of, n_to, n_of))
        gain = (_plogp(to + r[:, None]) - _plogp(to)).sum(axis=2) + (_plogp(of + l[:, None]) - _plogp(of)).sum(axis=2)
        gain -= _plogp(n_to + r.sum(axis=1)[:, None]) - _plogp(n_to) + _plogp(n_of + l.sum(axis=1)[:, None]) - _plogp(n_of)
        gain[:, 0] = -np.inf
        best = gain.argmax(axis=1)
        out[some] = np.where(gain[i, best] > gain[i, a] + 1e-9, best, a)
    return out


def best_first_order(table: np.ndarray, right: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Best class of words whose counts are small against the table's."""
    row, col = np.log(table.sum(axis=1) + CLASSES), np.log(table.sum(axis=0) + CLASSES)
    gain = right @ (np.log(table + 1) - row[:, None]).T + left @ (np.log(table + 1) - col)
    gain[:, 0] = -np.inf
    return gain.argmax(axis=1)


def listed_classes(docs: DataFrame, vocabulary: Vocabulary, units: np.ndarray, where: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Class of each listed word, exchanged by itself; blocks of BLOCK words are summed in Spark."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, where))
    width = BLOCK * 2 * CLASSES
    own = where[units]

    def run(batches):
        vocabulary, where = shared.value
        counts = np.zeros(-(-len(vocabulary.hashes) // BLOCK) * width, np.int32)
        for batch in batches:
            for piece in pieces(batch.column("text")):
                w = words(piece)
                at, unit = vocabulary.find(piece, w)
                line, _ = with_ends(where[unit], w.offs, 0)
                word, _ = with_ends(at, w.offs, -1)
                before = np.concatenate([[0], line[:-1]])
                after = np.concatenate([line[1:], [0]])
                place = word[word >= 0] * (2 * CLASSES)
                np.add.at(counts, place + after[word >= 0], 1)
                np.add.at(counts, place + CLASSES + before[word >= 0], 1)
        for block in range(len(counts) // width):
            part = counts[block * width : (block + 1) * width]
            some = np.flatnonzero(part)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([some.astype(np.uint16).tobytes()]), pa.array([part[some].tobytes()])], ["block", "place", "n"])

    def choose(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, place, n in zip(batch.column("block").to_pylist(), batch.column("place").to_pylist(), batch.column("n").to_pylist()):
                sums.setdefault(block, np.zeros(width))[np.frombuffer(place, np.uint16)] += np.frombuffer(n, np.int32)
        for block, n in sums.items():
            n = n.reshape(BLOCK, 2, CLASSES)[: len(own) - block * BLOCK]
            cls = best_exact(table, n[:, 0], n[:, 1], own[block * BLOCK : (block + 1) * BLOCK])
            yield pa.RecordBatch.from_arrays([pa.array(block * BLOCK + np.arange(len(cls))), pa.array(cls)], ["at", "cls"])

    blocks = split(docs).where("train").select("text").mapInArrow(run, "block long, place binary, n binary")
    found = blocks.repartition("block").mapInArrow(choose, "at long, cls long").toArrow()  # at most LISTED rows
    out = own.copy()
    out[found.column("at").to_numpy()] = found.column("cls").to_numpy()
    return out


def whole_groups(batches, names):
    """Columns of rows that are sorted by the first of names, with all rows of a value of it together."""
    held = None
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        other = np.flatnonzero(cols[0] != cols[0][-1]) if len(cols[0]) else []
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield [x[:cut] for x in cols]
        held = [x[cut:] for x in cols]
    if held is not None and len(held[0]):
        yield held


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin; and the run of each row."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new), np.cumsum(new) - 1


def others_of(docs: DataFrame, vocabulary: Vocabulary, units: np.ndarray, where: np.ndarray, table: np.ndarray, listed: np.ndarray) -> DataFrame:
    """For each row with words outside the list: row, copies, train, class pairs with such a word in them, its words' classes, classes of words that are counted here, base, emit, known."""
    n_listed = len(vocabulary.hashes)
    first = np.concatenate([where[units], where])  # class in the first step by code: a listed word's place, or n_listed + unit
    final = np.concatenate([listed, np.full(UNITS, -1)])  # -1: a word outside the list
    final[n_listed] = 0
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, first, final))

    def occurrences(batches):
        vocabulary, _, _ = shared.value
        for batch in batches:
            rows, train_all = batch.column("row").to_numpy(zero_copy_only=False), batch.column("train").to_numpy(zero_copy_only=False).astype(np.int64)
            for piece in pieces(batch.column("text")):
                w = words(piece)
                at, unit = vocabulary.find(piece, w)
                line, offs = with_ends(np.where(at >= 0, at, n_listed + unit), w.offs, n_listed)
                before, after = np.concatenate([[n_listed], line[:-1]]), np.concatenate([line[1:], [n_listed]])
                other = np.flatnonzero(at < 0)
                owner = w.owner()[other]
                place = other + owner  # in line, where each earlier text has its end
                near = before[place] | after[place] << 20 | unit[other] << 40 | train_all[piece.lo + owner] << 52
                yield pa.RecordBatch.from_arrays([pa.array(w.hashes[other].view(np.int64)), pa.array(rows[piece.lo + owner]), pa.array((place - offs[owner]).astype(np.int32)), pa.array(near)], ["word", "row", "pos", "near"])

    def by_word(batches):
        _, first, final = shared.value
        mask = (1 << 20) - 1
        for word, row, pos, near in whole_groups(batches, ["word", "row", "pos", "near"]):
            begin, run = runs(word)
            before, after, unit, train = near & mask, near >> 20 & mask, near >> 40 & 4095, near >> 52 & 1 > 0
            count = np.bincount(run[train], minlength=len(begin))
            cls = np.empty(len(begin), np.int64)
            for lo in range(0, len(begin), 8192):
                span = slice(*np.searchsorted(run, [lo, lo + 8192]))
                k, t = min(8192, len(begin) - lo), train[span]
                sums = [np.bincount((run[span][t] - lo) * CLASSES + first[x[span][t]], minlength=k * CLASSES).reshape(k, CLASSES).astype(float) for x in (after, before)]
                cls[lo : lo + k] = best_first_order(table, *sums)
            cls = np.where(count > 0, cls, first[n_listed + unit[begin]])
            one = np.zeros(len(word), np.int64)
            counted = np.flatnonzero(train)
            one[counted[runs(run[train])[0]] if len(counted) else counted] = 1
            packed = cls[run] | (final[before] + 1) << 6 | (final[after] + 1) << 12 | train.astype(np.int64) << 18 | one << 19 | count[run] << 20
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(pos), pa.array(packed)], ["row", "pos", "packed"])

    def by_row(batches):
        for row, pos, packed in whole_groups(batches, ["row", "pos", "packed"]):
            begin, run = runs(row, pos)
            copies, one = np.bincount(run), np.bincount(run, weights=packed >> 19 & 1) > 0
            row, pos, packed = row[begin], pos[begin], packed[begin]
            cls, before, after, count = packed & 63, (packed >> 6 & 63) - 1, (packed >> 12 & 63) - 1, (packed >> 20).astype(float)
            before = np.where(before < 0, np.concatenate([[0], cls[:-1]]), before)  # then the word before it is outside the list, too
            left, right = before * CLASSES + cls, np.where(after < 0, -1, cls * CLASSES + after)
            start, group = runs(row)
            sums = [np.bincount(group, weights=x) for x in (np.log10(count + 1.0), np.log10(count + DELTA), count > 0)]
            pairs, kinds, firsts = [], [], []
            for a, b in zip(start, np.append(start[1:], len(row))):
                both = np.concatenate([left[a:b], right[a:b]])
                pairs.append(both[both >= 0].astype(np.uint16).tobytes())
                kinds.append(cls[a:b].astype(np.uint8).tobytes())
                firsts.append(cls[a:b][one[a:b]].astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(row[start]), pa.array(copies[start]), pa.array((packed[start] >> 18 & 1) > 0), pa.array(pairs, pa.binary()), pa.array(kinds, pa.binary()), pa.array(firsts, pa.binary()), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2].astype(np.int64))], ["row", "copies", "train", "pairs", "cls", "firsts", "base", "emit", "known"])

    found = split(docs).select("row", "text", "train").mapInArrow(occurrences, "word long, row long, pos int, near long")
    found = found.repartition("word").sortWithinPartitions("word").mapInArrow(by_word, "row long, pos int, packed long")
    found = found.repartition("row").sortWithinPartitions("row", "pos", "packed").mapInArrow(by_row, "row long, copies long, train boolean, pairs binary, cls binary, firsts binary, base double, emit double, known long")
    return settle(found)


def final_counts(docs: DataFrame, vocabulary: Vocabulary, listed: np.ndarray, others: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Class bigrams of the training texts, and how many words outside the list each class has."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, listed))

    def rows_of(kind, counts):
        some = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(counts[some].astype(np.int64))], ["kind", "place", "n"])

    def near(batches):
        vocabulary, listed = shared.value
        counts = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for piece in pieces(batch.column("text")):
                line, offs = class_line(vocabulary, listed, piece, words(piece))
                before = np.concatenate([[0], line[:-1]])
                counts += np.bincount((before * CLASSES + line)[(before >= 0) & (line >= 0)], minlength=len(counts))
        yield rows_of(0, counts)

    def far(batches):
        counts, kinds = np.zeros(CLASSES * CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            for n, pairs, firsts in zip(*(batch.column(c).to_pylist() for c in ("copies", "pairs", "firsts"))):
                counts += n * np.bincount(np.frombuffer(pairs, np.uint16), minlength=len(counts))
                kinds += np.bincount(np.frombuffer(firsts, np.uint8), minlength=CLASSES)
        yield rows_of(0, counts)
        yield rows_of(1, kinds)

    schema = "kind int, place long, n long"
    found = split(docs).where("train").select("text").mapInArrow(near, schema).unionByName(others.where("train").select("copies", "pairs", "firsts").mapInArrow(far, schema))
    found = found.groupBy("kind", "place").agg(F.sum("n").alias("n")).toArrow()  # at most CLASSES^2 + CLASSES rows
    out = np.zeros(CLASSES * CLASSES), np.zeros(CLASSES)
    for kind, place, n in zip(*(found.column(c).to_pylist() for c in ("kind", "place", "n"))):
        out[kind][place] = n
    return out[0].reshape(CLASSES, CLASSES), out[1]


def class_line(vocabulary: Vocabulary, listed: np.ndarray, piece, w) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens, ends included; -1 for words outside the list."""
    at, _ = vocabulary.find(piece, w)
    return with_ends(np.where(at >= 0, listed[at] if len(listed) else -1, -1), w.offs, 0)


@dataclass
class Model:
    vocabulary: Vocabulary
    counts: np.ndarray  # of listed words
    classes: np.ndarray  # of listed words
    table: np.ndarray  # class bigrams
    start: np.ndarray  # class bigrams of the first step
    step: np.ndarray  # log10 of class transitions
    spread: np.ndarray  # log10 of the emission denominators; 0 for the end
    tokens: int
    kinds: int
    ends: int


def fit(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and what it needs of each row's words outside the list."""
    vocabulary = Vocabulary.of(frequent_words(docs))
    found = corpus_counts(docs, vocabulary).toArrow()  # at most UNITS^2 + LISTED rows
    kind, a, b, n = (found.column(c).to_numpy() for c in ("kind", "a", "b", "n"))
    grams, counts, units = np.zeros((UNITS, UNITS)), np.zeros(len(vocabulary.hashes), np.int64), np.where(vocabulary.units > 0, vocabulary.units, 1 + WORDS)
    grams[a[kind == 0], b[kind == 0]] = n[kind == 0]
    np.add.at(counts, a[kind == 1], n[kind == 1])
    units[a[kind == 1]] = b[kind == 1]
    where = exchange(grams)
    start = table_of(grams, where)
    listed = listed_classes(docs, vocabulary, units, where, start)
    others = others_of(docs, vocabulary, units, where, start, listed)
    table, rest = final_counts(docs, vocabulary, listed, others)

    seen, total, ends = counts > 0, table.sum(axis=0), int(grams[:, 0].sum())
    share = (total + 1) / (total.sum() + CLASSES)
    step = np.log10((table + STRENGTH * share) / (table.sum(axis=1, keepdims=True) + STRENGTH))
    spread = np.log10(total + DELTA * (np.bincount(listed[seen], minlength=CLASSES) + rest + 1))
    spread[0] = 0.0
    return Model(vocabulary, counts, listed, table, start, step, spread, int(grams.sum()), int(seen.sum() + rest.sum()) + (ends > 0), ends), others


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every document."""
    model, others = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        m = shared.value
        base, emit = np.log10(m.counts + 1.0), np.log10(m.counts + DELTA) - m.spread[m.classes]
        for batch in batches:
            for piece in pieces(batch.column("text")):
                w = words(piece)
                at, _ = m.vocabulary.find(piece, w)
                n, inside = len(piece), at >= 0
                owner, place = w.owner()[inside], at[inside]
                line, offs = class_line(m.vocabulary, m.classes, piece, w)
                before = np.concatenate([[0], line[:-1]])
                move = np.add.reduceat(np.where((before >= 0) & (line >= 0), m.step[np.maximum(before, 0), np.maximum(line, 0)], 0.0), offs[:-1])
                words_of = lambda x: np.bincount(owner, weights=x, minlength=n)
                known = words_of(m.counts[place] > 0) + (m.ends > 0)
                rows = batch.slice(piece.lo, n)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("row"), rows.column("held_out"), pa.array(np.diff(offs)), pa.array(known.astype(np.int64)), pa.array(words_of(base[place]) + np.log10(m.ends + 1.0)), pa.array(words_of(emit[place]) + move)], ["doc_id", "row", "held_out", "n_tokens", "known_listed", "s_base", "s_model"])

    def outside(batches):
        m = shared.value
        step = m.step.ravel()
        for batch in batches:
            pairs, cls = (batch.column(c).to_pylist() for c in ("pairs", "cls"))
            emit = [x + step[np.frombuffer(p, np.uint16)].sum() - m.spread[np.frombuffer(c, np.uint8)].sum() for x, p, c in zip(batch.column("emit").to_pylist(), pairs, cls)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("base"), pa.array(emit, pa.float64()), batch.column("known")], ["row", "base", "emit", "known"])

    rows = split(docs, "doc_id", F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"))
    local = rows.select("doc_id", "row", "held_out", "text").mapInArrow(run, f"doc_id {kind}, row long, held_out boolean, n_tokens long, known_listed long, s_base double, s_model double")
    sums = others.select("row", "base", "emit", "known", "pairs", "cls").mapInArrow(outside, "row long, base double, emit double, known long")
    both = local.join(sums, "row", "left")
    part = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    base = F.col("s_base") + part("base") - F.col("n_tokens") * float(np.log10(model.tokens + model.kinds + 1))
    score = F.col("s_model") + part("emit")
    return both.select("doc_id", "held_out", "n_tokens", (F.col("known_listed") + part("known").cast("long")).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), F.round(base, 6).alias("base_score"), F.round(score, 6).alias("score"), F.round(F.pow(F.lit(10.0), -score / F.col("n_tokens")), 4).alias("perplexity"))
