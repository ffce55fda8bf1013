"""Phrase collocation mining by Toivonen's scheme: a sample proposes, full passes count exactly, until nothing is left open.

A phrase is frequent when it occurs ``least`` times in its language; then so are all its contiguous
parts. A set K of phrases is held to be frequent; a pass counts each phrase of at most ``longest``
words all of whose parts are in K, so it counts K itself and its negative border. The sample
(SAMPLE_SHARE of the documents, by id) is mined first at a lowered count (SAMPLE_SLACK of
what its share leads one to expect, two at least) and its phrases are the first K. A pass over all documents then counts K and the border exactly. Frequent phrases of
the border are failures: they join K and a further pass counts what thereby came into the border,
until a pass finds none. The result doesn't depend on the sample; only the number of passes does.

K is broadcast as a bit table of fixed size (1 << FILTER_BITS bits, two bits a phrase). A phrase that
the table holds by chance is one more member of K: its border is counted too and nothing is lost.
Phrases themselves are counted as strings by Spark; a task sums its own before the shuffle.

Scores are of exact integers (38 digits). Ranks: each language's phrases are cut to the first
``top`` in salted parts and then once more, so no language has to meet in one task.

Defined cases: a null text is empty; a null language is 'und'; null and repeated ids are rows like
others; an empty table gives an empty one; very long texts need memory in proportion to one text;
columns other than doc_id, text and lang are not read. Within one task phrases are told apart by
64-bit hashes, between tasks by their words.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settle, uniform
from .textscan import LOWER, Piece, mix, pieces, words

SAMPLE_SHARE = 1 / 8
SAMPLE_SLACK = 0.8
FILTER_BITS = 26
CHUNK_BYTES = 8 << 20
EMIT_ROWS = 1 << 17
RANK_PARTS = 64
_U = np.uint64
_BYTE = np.arange(256)
_STOP = np.isin(_BYTE, [ord(c) for c in ".,;:!?\n\v\f\r"])
_TABLE = 1 << (FILTER_BITS - 6)


def _seed(lang: str) -> np.uint64:
    raw = lang.encode()
    return _U(zlib.crc32(raw) | zlib.adler32(raw) << 32)


class Scan:
    """Lower-cased words of some texts laid end to end: bytes joined by blanks, hashes that hold the language, and which words go on in the same piece."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.langs: dict[str, int] = {}
        self.bytes = 0

    def add(self, piece: Piece, langs: list[str]) -> None:
        stop = _STOP[piece.data]
        plain = Piece(piece.lo, piece.hi, np.where(stop, np.uint8(32), piece.data).astype(np.uint8), piece.offs)
        w = words(plain)
        if not len(w.hashes):
            return
        owner = w.owner()
        breaks = np.cumsum(stop)[w.starts]
        follows = np.zeros(len(owner), bool)  # does the next word stand in the same piece
        follows[:-1] = (owner[1:] == owner[:-1]) & (breaks[1:] == breaks[:-1])
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int32)[owner]
        with np.errstate(over="ignore"):
            hashes = mix(w.hashes ^ mix(np.array([_seed(x) for x in self.langs], _U))[lang])
        size = w.ends - w.starts
        at = np.concatenate([[0], np.cumsum(size + 1)])
        # each word's bytes and one blank behind it
        source = np.repeat(w.starts - at[:-1], size + 1) + np.arange(at[-1])
        flat = LOWER[plain.data[np.minimum(source, len(plain.data) - 1)]]
        flat[at[1:] - 1] = 32
        self.parts.append((flat, size.astype(np.int32), hashes, follows, lang))
        self.bytes += len(flat)

    def joined(self):
        flat, size, hashes, follows, lang = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        return flat, np.concatenate([[0], np.cumsum(size + 1)]).astype(np.int32), size, hashes, follows, lang


def chain(hashes: np.ndarray, follows: np.ndarray, longest: int):
    """For each length in turn: first words of the phrases, and their hashes."""
    at, h = np.arange(len(hashes), dtype=np.int32), hashes
    yield at, h
    for k in range(1, longest):
        go = at + k < len(hashes)
        go[go] &= follows[at[go] + k - 1]
        at, h = at[go], h[go]
        with np.errstate(over="ignore"):
            h = mix(h * _U(0xD6E8FEB86659FD93) + hashes[at + k] + _U(k))
        yield at, h


def holds(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Are the hashes in the bit table."""
    one = _U(1)
    first, second = h >> _U(64 - FILTER_BITS), (h >> _U(8)) & _U((1 << FILTER_BITS) - 1)
    bit = lambda x: (table[x >> _U(6)] >> (x & _U(63))) & one
    return (bit(first) & bit(second)).astype(bool)


def bit_table(phrases: DataFrame) -> np.ndarray:
    """The bit table of phrases (lang, phrase): at most 1 << (FILTER_BITS - 6) rows come to the driver, however many phrases there are."""

    def run(batches):
        table = np.zeros(_TABLE, _U)
        for batch in batches:
            for piece in pieces(batch.column("phrase")):
                scan = Scan()
                scan.add(piece, batch.column("lang").slice(piece.lo, len(piece)).to_pylist())
                if not scan.parts:
                    continue
                _, _, _, hashes, follows, _ = scan.joined()
                begins = np.concatenate([[True], ~follows[:-1]])
                ends = np.flatnonzero(~follows)
                length = ends - np.flatnonzero(begins) + 1
                for k, (at, h) in enumerate(chain(hashes, follows, int(length.max()))):
                    whole = begins[at] & np.isin(at + k, ends)
                    for x in (h[whole] >> _U(64 - FILTER_BITS), (h[whole] >> _U(8)) & _U((1 << FILTER_BITS) - 1)):
                        np.bitwise_or.at(table, x >> _U(6), _U(1) << (x & _U(63)))
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[some].view(np.int64))], ["at", "bits"])

    rows = phrases.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(_TABLE, _U)
    table[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(_U)
    return table


def counted(docs: DataFrame, known: np.ndarray | None, before: np.ndarray | None, longest: int) -> DataFrame:
    """lang, size, phrase, n: counts of the phrases whose parts are all in ``known`` but not all in ``before``.

    None stands for the empty set; before = None is the first pass, which counts words too, and in a
    row of size 0 all words of each language. A task has summed its own, so rows are dealt out as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast((known, before))
    first_pass = before is None

    class Known:
        """Which phrases have all parts in a table, and which are in it themselves, a length after the other."""

        def __init__(self, table: np.ndarray | None, n_words: int):
            self.table, self.inside = table, np.ones(n_words + 1, bool)

        def step(self, k: int, at: np.ndarray, h: np.ndarray) -> np.ndarray:
            every = self.inside[at] & self.inside[at + 1] if k else np.ones(len(at), bool)
            self.inside = np.zeros(len(self.inside), bool)
            if self.table is not None:
                self.inside[at[every]] = holds(self.table, h[every])
            return every

    def emit(scan: Scan):
        names = pa.array(list(scan.langs), pa.string())
        flat, at_byte, size, hashes, follows, lang = scan.joined()
        known, before = shared.value
        now, old = Known(known, len(hashes)), Known(before, len(hashes))
        if first_pass:
            n = np.bincount(lang, minlength=len(names))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(names, "", "\n"), pa.array(n.astype(np.int64))], ["key", "n"])
        for k, (at, h) in enumerate(chain(hashes, follows, longest)):
            take = now.step(k, at, h)
            if not first_pass:
                take &= ~old.step(k, at, h)
            at, h = at[take], h[take]
            if not len(at):
                continue
            _, index, n = np.unique(h, return_index=True, return_counts=True)
            for lo in range(0, len(index), EMIT_ROWS):
                some = at[index[lo : lo + EMIT_ROWS]]
                begin, length = at_byte[some], at_byte[some + k] + size[some + k] - at_byte[some]
                offs = np.concatenate([[0], np.cumsum(length)])
                data = flat[np.repeat(begin - offs[:-1], length) + np.arange(offs[-1])]
                phrase = pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(names.take(pa.array(lang[some])), phrase, "\n"), pa.array(n[lo : lo + EMIT_ROWS].astype(np.int64))], ["key", "n"])

    def run(batches):
        scan = Scan()
        for batch in batches:
            for piece in pieces(batch.column("text")):
                scan.add(piece, batch.column("lang").slice(piece.lo, len(piece)).to_pylist())
                if scan.bytes > CHUNK_BYTES:
                    yield from emit(scan)
                    scan = Scan()
        if scan.parts:
            yield from emit(scan)

    rows = docs.mapInArrow(run, "key string, n long").repartition("key").groupBy("key").agg(F.sum("n").alias("n"))
    phrase = F.substring_index("key", "\n", -1)  # no word holds a newline
    lang = F.expr("left(key, length(key) - length(substring_index(key, '\n', -1)) - 1)")
    return rows.select(lang.alias("lang"), F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("size"), phrase.alias("phrase"), "n")


def closed(docs: DataFrame, least: int, longest: int, known: np.ndarray | None = None) -> list[DataFrame]:
    """The frequent phrases with their exact counts, in one table for each pass: passes go on until no phrase of the border is frequent."""
    found, before = [], None
    while True:
        found.append(settle(counted(docs, known, before, longest).where((F.col("size") == 0) | (F.col("n") >= least))))
        before = np.zeros(_TABLE, _U) if known is None else known
        known = before | bit_table(found[-1].where((F.col("size") > 0) & (F.col("size") < longest)))  # the longest are no part of another
        if (known == before).all():
            return found


def frequent_phrases(docs: DataFrame, least: int, longest: int, share: float = SAMPLE_SHARE) -> DataFrame:
    """lang, size, phrase, n of all phrases that occur ``least`` times in a language, and a row of size 0 with each language's number of words."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"), uniform("doc_id", "phrases").alias("draw"))
    sample = settle(rows.where(F.col("draw") < share).select("text", "lang"))
    proposed = [x.where("size > 0") for x in closed(sample, max(2, int(SAMPLE_SLACK * share * least)), longest)]
    known = reduce(np.bitwise_or, map(bit_table, proposed))
    return settle(reduce(DataFrame.unionByName, closed(rows.select("text", "lang"), least, longest, known)).select("lang", "size", "phrase", "n"))


def _part(first: Column, last: Column) -> Column:
    """The words first..last of the phrase (from 1)."""
    return F.array_join(F.slice("words", first, last - first + 1), " ")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, scale: int = 1_000_000, within: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases of two words or more.

    score is floor(scale * a * a / (l * r)) at the cut (after k words) where it is least, ties to the smallest k;
    a phrase goes when a longer candidate that holds it occurs at least ``within`` percent as often.
    """
    found = frequent_phrases(docs, least, longest)
    totals = found.where("size = 0").select("lang", F.col("n").alias("total"))
    phrases = found.where("size > 0").select("lang", "phrase", "size", F.col("n").alias("a"))
    candidates = phrases.where("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", _part(F.lit(1), F.col("k")).alias("head"), _part(F.col("k") + 1, F.col("size")).alias("tail"))
    heads = cuts.join(phrases.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    both = heads.join(phrases.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    both = both.withColumns({"up": (F.lit(scale).cast("decimal(8,0)") * wide("a") * wide("a")).cast("decimal(38,0)"), "down": (wide("l") * wide("r")).cast("decimal(38,0)")})
    both = both.withColumn("score", F.expr("up div down"))
    worst = both.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "size")).alias("cut")).select("lang", "phrase", "cut.*")
    # phrases that stand in a longer candidate
    inner = candidates.where("size > 2").withColumn("span", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("span") + 1)))
    inner = inner.select("lang", _part(F.col("start"), F.col("start") + F.col("span") - 1).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = worst.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < within * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = left.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    for parts in (RANK_PARTS, 8, 1):
        salt = F.pmod("salt", F.lit(parts)).alias("salt")
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))
