"""Substring dedup: spans of ``least`` words or more that occur in an earlier document go.

Reference shards are passages of the corpus; each shard's suffix automaton (over words) is built
from its passages in the order of their documents, so that every state knows the first document in
which its word sequences occur. Documents stream through the automata: matching statistics give at
each word the longest match that ends there, and where it has ``least`` words and its state's first
document is an earlier one, the window goes. Maximal spans are unions of such windows.

An automaton of the whole corpus fits no executor, and sending every shard to every document would grow with
the square of the input. So passages are routed: each window has a marked place, its least hash of
MARK consecutive words, which equal windows have in common. Marks that occur in one document alone bring
nothing and go. The others name a home, the block of their first document in which they begin, and
homes are dealt to shards of about SHARD_WORDS words; a window's passages, earlier and later, all come to
its mark's shard. There the automaton of the shard's distinct passages is made, and the shard's
streams run through it. A shard that got more (a hot passage, a large group of near copies) is split:
its distinct passages into references of bounded size and its streams into parts, each part being sent
through each reference. Copies of a passage are one passage before anything is shuffled by shard.

Defined cases: a null or empty text has no words; rows with a null id are kept whole and are no
reference; rows of one id aren't earlier than each other; with fewer than ``least`` words nothing goes; repeats
within one document stay; an empty table gives an empty one; very long texts need memory in
proportion to one text; columns other than doc_id and text are kept by drop_repeats and not read
otherwise. Words are compared as they are; marks are told apart by 64-bit hashes (a collision only adds a
candidate), rows by id and a 64-bit hash of the text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_spread, settle
from .textscan import Piece, Words, mix, pieces, shingle_hashes, words

MARK = 5
BLOCK_WORDS = 256
SHARD_WORDS = 50_000
_U = np.uint64


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the first owner of each state's sequences.

    Sequences must be added in the order of their owners.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [None]

    def _state(self, length: int, first, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def _clone(self, p: int, symbol: int, q: int) -> int:
        """A state for the sequences of q that p's longest one reaches; p and its suffixes go there."""
        copy = self._state(self.length[p] + 1, self.first[q], self.next[q].copy())
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = copy
            p = self.link[p]
        return copy

    def add(self, symbols: list[int], owner) -> None:
        moves, link, length = self.next, self.link, self.length
        last = 0
        for symbol in symbols:
            q = moves[last].get(symbol)
            if q is not None:  # the sequence is there already
                last = q if length[q] == length[last] + 1 else self._clone(last, symbol, q)
                continue
            made = self._state(length[last] + 1, owner, {})
            p = last
            while p >= 0 and symbol not in moves[p]:
                moves[p][symbol] = made
                p = link[p]
            if p >= 0:
                q = moves[p][symbol]
                link[made] = q if length[q] == length[p] + 1 else self._clone(p, symbol, q)
            last = made

    def matches(self, symbols: list[int], least: int):
        """At each symbol: the state of the last ``least`` symbols if they occur, else -1."""
        moves, link, length = self.next, self.link, self.length
        state, size, out = 0, 0, []
        for symbol in symbols:
            while state and symbol not in moves[state]:
                state = link[state]
                size = length[state]
            q = moves[state].get(symbol)
            if q is None:
                state = size = 0
            else:
                state, size = q, size + 1
                while length[link[state]] >= least:  # the shortest state that still holds them
                    state = link[state]
                    size = length[state]
            out.append(state if size >= least else -1)
        return out


def word_scan(piece: Piece, least: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, the mark of each window (by its first word), and which words begin a window of their text."""
    w = words(piece, lower=False)
    n = len(w.hashes)
    left = np.repeat(w.offs[1:], np.diff(w.offs)) - np.arange(n)  # words from here to the text's end
    begins = left >= least
    size = min(MARK, least)
    grams = shingle_hashes(w.hashes, size)
    marks = np.full(n, np.iinfo(np.uint64).max, _U)
    if len(grams):
        best = grams
        span, reach = 1, least - size + 1
        while span * 2 <= reach:
            best = np.minimum(best[: len(best) - span], best[span:]) if len(best) > span else best[:0]
            span *= 2
        if reach > span and len(best) > reach - span:
            best = np.minimum(best[: len(best) - (reach - span)], best[reach - span :])
        elif reach > span:
            best = best[:0]
        marks[: len(best)] = best
    return w, marks, begins


def mark_rows(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, key (hash of the text), mark, at: the distinct marks of each document and the first window that has it."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column("text")):
                w, marks, begins = word_scan(piece, least)
                owner, at = w.owner()[begins], np.arange(len(marks))[begins]
                mark = marks[begins]
                new = np.ones(len(mark), bool)
                new[1:] = (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1])
                owner, at, mark = owner[new], at[new], mark[new]
                order = np.lexsort((at, mark, owner))
                owner, at, mark = owner[order], at[order], mark[order]
                new = np.ones(len(mark), bool)
                new[1:] = (mark[1:] != mark[:-1]) | (owner[1:] != owner[:-1])
                owner, at, mark = owner[new], at[new], mark[new]
                rows = pa.array(piece.lo + owner)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array(mark.view(np.int64)), pa.array((at - w.offs[owner]).astype(np.int32))], ["doc_id", "key", "mark", "at"])

    return docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, mark long, at int")


def routed(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, key, marks, homes: for each document the marks that another document has too, and a hash of each one's home."""
    rows = settle(mark_rows(docs, least))
    place = F.struct("doc_id", "at")
    shared = settle(rows.groupBy("mark").agg(F.min(place).alias("low"), F.max("doc_id").alias("high")).where("low.doc_id < high").select("mark", F.xxhash64("low.doc_id", F.floor(F.col("low.at") / BLOCK_WORDS)).alias("home")))
    found = join_spread(rows.select("doc_id", "key", "mark"), shared, "mark").where("home is not null")
    return found.groupBy("doc_id", "key").agg(F.collect_list(F.struct("mark", "home")).alias("held"))


def passages(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, key, home, at, n, words: runs of windows whose marks have one home, as their words joined by blanks; at is the first word, n their number."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = routed(docs, least)
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").join(held, ["doc_id", "key"])

    def run(batches):
        for batch in batches:
            lists = batch.column("held")
            mark_of, home_of = (lists.flatten().field(i).to_numpy() for i in (0, 1))
            offs = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for piece in pieces(batch.column("text")):
                w, marks, begins = word_scan(piece, least)
                raw = piece.data.tobytes()
                ids, out = [], {"home": [], "at": [], "n": [], "words": []}
                for row in range(len(piece)):
                    a, b = int(w.offs[row]), int(w.offs[row + 1])
                    some = slice(offs[piece.lo + row], offs[piece.lo + row + 1])
                    order = np.argsort(mark_of[some])
                    known, home = mark_of[some][order], home_of[some][order]
                    own = marks[a:b][begins[a:b]].view(np.int64)
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    is_held = known[at] == own
                    home = np.where(is_held, home[at], 0)
                    cut = np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (is_held[1:] != is_held[:-1])]))
                    for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(own)]):
                        if is_held[x]:
                            last = y - 1 + least
                            ids.append(piece.lo + row)
                            out["home"].append(home[x])
                            out["at"].append(x)
                            out["n"].append(last - x)
                            out["words"].append(b" ".join(raw[s:e] for s, e in zip(w.starts[a + x : a + last].tolist(), w.ends[a + x : a + last].tolist())).decode())
                rows = pa.array(ids, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), batch.column("key").take(rows), pa.array(out["home"], pa.int64()), pa.array(out["at"], pa.int32()), pa.array(out["n"], pa.int32()), pa.array(out["words"], pa.string())], ["doc_id", "key", "home", "at", "n", "words"])

    return rows.mapInArrow(run, f"doc_id {kind}, key long, home long, at int, n int, words string")


def repeated_windows(found: DataFrame, least: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, key, spans (begin and end words) of the windows that occur in an earlier document. found: a written table of passages."""
    total = found.agg(F.sum("n")).first()[0] or 0
    rows = found.withColumn("shard", F.pmod("home", F.lit(max(1, total // shard_words)))).drop("home")
    # copies of a passage are one, with its first document
    distinct = settle(rows.groupBy("shard", "words").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")))
    size = lambda df, name: df.groupBy("shard").agg(F.ceil(F.sum("n") / (4 * shard_words)).alias(name))
    large = settle(size(distinct, "references").join(size(rows, "parts"), "shard").where("parts > 1"))  # no more references than parts
    many = lambda df: df.join(large, "shard", "left").fillna(1, ["references", "parts"])
    each = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    reference = many(distinct).withColumns({"reference": F.pmod(F.xxhash64("words"), "references"), "part": each("parts")})
    streams = many(rows).withColumns({"part": F.pmod(F.xxhash64("doc_id", "key", "at"), "parts"), "reference": each("references")})
    group = ["shard", "reference", "part"]
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(refs: pa.Table, flows: pa.Table) -> pa.Table:
        number: dict[str, int] = {}
        automaton = SuffixAutomaton()
        refs = refs.sort_by("doc_id")
        for owner, text in zip(refs["doc_id"].to_pylist(), refs["words"].to_pylist()):
            automaton.add([number.setdefault(x, len(number)) for x in text.split(" ")], owner)
        keep, spans, seen = [], [], {}
        for k, (owner, at, text) in enumerate(zip(flows["doc_id"].to_pylist(), flows["at"].to_pylist(), flows["words"].to_pylist())):
            if text not in seen:  # copies stream through once
                states = automaton.matches([number.get(x, -1) for x in text.split(" ")], least)
                seen[text] = [(i, automaton.first[s]) for i, s in enumerate(states) if s >= 0]
            merged = []
            for i, first in seen[text]:
                if first < owner:
                    begin, end = at + i + 1 - least, at + i + 1
                    if merged and begin <= merged[-1]:
                        merged[-1] = end
                    else:
                        merged += [begin, end]
            if merged:
                keep.append(k)
                spans.append(merged)
        out = flows.select(["doc_id", "key"]).take(pa.array(keep, pa.int64()))
        return out.append_column("spans", pa.array(spans, pa.list_(pa.int32())))

    joined = reference.select(*group, "doc_id", "words").groupBy(*group).cogroup(streams.select(*group, "doc_id", "key", "at", "words").groupBy(*group))
    return joined.applyInArrow(run, f"doc_id {kind}, key long, spans array<int>").groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def find_repeats(docs: DataFrame, least: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, key, spans of the documents in which something goes."""
    return settle(repeated_windows(settle(passages(docs, least)), least, shard_words))


def rewritten(docs: DataFrame, gone: DataFrame, texts: bool) -> DataFrame:
    """n_words, n_removed and the words left, joined by blanks, as text or as their digest, beside the columns of docs but text."""
    rest = [c for c in docs.columns if c not in ("text", "n_words", "n_removed", "kept_sha256")]
    spans = gone.select(F.col("doc_id").alias("id__"), F.col("key").alias("mark__"), F.col("spans").alias("spans__"))
    rows = docs.withColumn("key__", F.xxhash64("text")).join(spans, (F.col("doc_id") == F.col("id__")) & (F.col("key__") == F.col("mark__")), "left")
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)

    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for piece in pieces(batch.column("text")):
                w = words(piece, lower=False)
                raw = piece.data.tobytes()
                for row, spans in enumerate(batch.column("spans__").slice(piece.lo, len(piece)).to_pylist()):
                    a, b = int(w.offs[row]), int(w.offs[row + 1])
                    stays = np.ones(b - a, bool)
                    for x, y in zip((spans or [])[::2], (spans or [])[1::2]):
                        stays[x:y] = False
                    at = a + np.flatnonzero(stays)
                    text = b" ".join([raw[s:e] for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist())])
                    n_words.append(b - a)
                    n_removed.append(b - a - len(at))
                    kept.append(text.decode() if texts else hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*rest, "n_words", "n_removed", "kept"])

    out = rows.select(*rest, "text", "spans__").mapInArrow(run, f"{kinds}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("kept", "text" if texts else "kept_sha256")


def drop_repeats(docs: DataFrame, least: int = 13) -> DataFrame:
    """All columns of docs, the text being the words left joined by blanks, and n_words, n_removed."""
    return rewritten(docs, find_repeats(docs, least), True)


def repeats(docs: DataFrame, least: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return rewritten(docs.select("doc_id", "text"), find_repeats(docs, least), False)
