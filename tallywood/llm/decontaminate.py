"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become sequences of word hashes (letters and digits, A-Z
lowered). Seeds, runs of MIN_TILE words that a text shares with an item, pick the pairs
to compare. A pair is tiled greedily: with running Karp-Rabin hashes the longest matches
among unmarked words are found and marked, again and again, down to MIN_TILE words; tiles
don't overlap and may stand in any order, so reordered passages are covered too. A text
is contaminated by an item when its tiles cover at least COVERAGE of the item's words.

The benchmark is taken in blocks of at most BLOCK_CHARS characters; the seeds of one block
are sent to the tasks, and all texts are compared with each block in turn.

Defined cases: null or empty texts match nothing; items without words are matched by
nothing; an item of fewer than MIN_TILE words is one tile, matched as a whole; repeated
items are compared one by one; repeated document ids give one row each, null ids are carried
through; an empty benchmark or table gives no rows (keep_clean: keeps all); very long texts
are compared whole, and in repetitive ones the windows of an item that are marked are passed over once.
keep_clean keeps all columns, whatever their names; contaminated reads doc_id and text alone.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .textscan import pieces, shingle_hashes, stripped, words

MIN_TILE = 5
COVERAGE = 0.5
BLOCK_CHARS = 4_000_000
_BITS = 22
_U = np.uint64
_BASE = _U(0xD6E8FEB86659FD93)


def sequences(column: pa.Array) -> Iterator[np.ndarray]:
    """Word hashes of each text."""
    for piece in pieces(column):
        w = words(stripped(piece))
        for a, b in zip(w.offs[:-1].tolist(), w.offs[1:].tolist()):
            yield w.hashes[a:b]


class _Rolling:
    """Hashes of all windows of any length, from prefix sums (Karp-Rabin)."""

    def __init__(self, seq: np.ndarray):
        n = len(seq)
        with np.errstate(over="ignore"):
            self.power = np.cumprod(np.concatenate([[_U(1)], np.full(n, _BASE, _U)]), dtype=_U)
            self.sums = np.concatenate([[_U(0)], np.cumsum(seq * self.power[:n], dtype=_U)])
            self.top = self.power[n]

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        """Hash of seq[a:a+size] for each a, comparable between sequences once aligned by the power table."""
        with np.errstate(over="ignore"):
            inverse = _inverse_powers(len(self.power))
            return (self.sums[at + size] - self.sums[at]) * inverse[at]


@functools.lru_cache(maxsize=8)
def _inverse_table(n: int) -> np.ndarray:
    step = _U(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[_U(1)], np.full(n, step, _U)]), dtype=_U)


def _inverse_powers(n: int) -> np.ndarray:
    return _inverse_table(1 << max(10, int(n).bit_length()))


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows without a marked word."""
    if len(marked) < size:
        return np.zeros(0, np.int64)
    sums = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(sums[size:] == sums[:-size])


def tile(text: np.ndarray, item: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (start in text, start in item, words), longest first; of equally long ones the first in the text."""
    least = max(1, min(least, len(item)))
    in_text, in_item = np.zeros(len(text), bool), np.zeros(len(item), bool)
    text_sums, item_sums = _Rolling(text), _Rolling(item)
    out, size = [], min(len(item), len(text))
    while size >= least:
        a, b = _free(in_text, size), _free(in_item, size)
        found = np.zeros(0, np.int64)
        if len(a) and len(b):
            left, right = text_sums.windows(a, size), item_sums.windows(b, size)
            order = np.argsort(right, kind="stable")
            lo, hi = np.searchsorted(right[order], left, "left"), np.searchsorted(right[order], left, "right")
            found = np.flatnonzero(hi > lo)
        open_from: dict[int, int] = {}  # of equal windows of the item those before this one are marked, and stay so
        for k in found:
            i, at, stop = int(a[k]), open_from.get(int(lo[k]), int(lo[k])), int(hi[k])
            if in_text[i : i + size].any():
                continue
            while at < stop and in_item[b[order[at]] : b[order[at]] + size].any():
                at += 1
            open_from[int(lo[k])] = at
            while at < stop:
                j = int(b[order[at]])
                if not in_item[j : j + size].any() and np.array_equal(text[i : i + size], item[j : j + size]):
                    in_text[i : i + size] = True
                    in_item[j : j + size] = True
                    out.append((i, j, size))
                    break
                at += 1
        size = _next_size(text_sums, item_sums, in_text, in_item, size - 1, least)
    return out


def _next_size(text_sums, item_sums, in_text, in_item, size: int, least: int) -> int:
    """The longest match of at most ``size`` words that is left (by halving: a match of n words holds one of n - 1)."""

    def some(n: int) -> bool:
        a, b = _free(in_text, n), _free(in_item, n)
        return bool(len(a) and len(b) and np.isin(item_sums.windows(b, n), text_sums.windows(a, n)).any())

    if size < least or not some(least):
        return 0
    low, high = least, size
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if some(mid) else (low, mid - 1)
    return low


class Benchmark:
    """Items of a block as hash sequences, and their seeds."""

    def __init__(self, ids: list, texts: list, least: int = MIN_TILE):
        self.ids, self.least = ids, least
        self.items = list(sequences(pa.array(texts, pa.string()))) if texts else []
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        by_size: dict[int, list] = {}
        for k, seq in enumerate(self.items):
            size = min(least, len(seq))
            if size:
                h = shingle_hashes(seq, size)
                by_size.setdefault(size, []).append((h, np.full(len(h), k), np.arange(len(h))))
        for size, parts in by_size.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            table = np.zeros(1 << _BITS, bool)
            table[(h & _U((1 << _BITS) - 1)).astype(np.int64)] = True
            self.seeds[size] = (h[order], item[order], at[order], table)

    def candidates(self, hashes: np.ndarray, offs: np.ndarray, coverage: float) -> set[tuple[int, int]]:
        """(text, item) whose seeds could cover enough of the item."""
        out: set[tuple[int, int]] = set()
        for size, (keys, item, at, table) in self.seeds.items():
            h = shingle_hashes(hashes, size)
            hit = np.flatnonzero(table[(h & _U((1 << _BITS) - 1)).astype(np.int64)])
            owner = np.searchsorted(offs, hit, "right") - 1
            inside = hit + size <= offs[owner + 1]
            hit, owner = hit[inside], owner[inside]
            lo, hi = np.searchsorted(keys, h[hit], "left"), np.searchsorted(keys, h[hit], "right")
            n = hi - lo
            take = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            text, item_of, place = np.repeat(owner, n), item[take], at[take]
            marks = np.unique(np.stack([text, item_of, place], axis=1), axis=0)
            if not len(marks):
                continue
            # words of the item under any seed: each seed adds what the one before does not reach
            new = np.ones(len(marks), bool)
            new[1:] = (marks[1:, 0] != marks[:-1, 0]) | (marks[1:, 1] != marks[:-1, 1])
            gain = np.full(len(marks), size)
            gain[1:] = np.where(new[1:], size, np.minimum(size, marks[1:, 2] - marks[:-1, 2]))
            begin = np.flatnonzero(new)
            total = np.add.reduceat(gain, begin)
            for k, words_covered in zip(begin, total):
                if words_covered >= coverage * len(self.items[marks[k, 1]]):
                    out.add((int(marks[k, 0]), int(marks[k, 1])))
        return out

    def matches(self, column: pa.Array, coverage: float) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, coverage, tiles, longest tile) of every contaminated pair."""
        for piece in pieces(column):
            w = words(stripped(piece))
            for text, item in sorted(self.candidates(w.hashes, w.offs, coverage)):
                seq = self.items[item]
                tiles = tile(w.hashes[w.offs[text] : w.offs[text + 1]], seq, self.least)
                share = sum(t[2] for t in tiles) / len(seq)
                if share >= coverage:
                    yield piece.lo + text, item, share, len(tiles), tiles[0][2]


def blocks(benchmark: DataFrame, least: int = MIN_TILE, size: int = BLOCK_CHARS) -> Iterator[Benchmark]:
    """The benchmark in blocks of about ``size`` characters. The driver gathers one at a time; what was broadcast lives until the query ends."""
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // size)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        found = part.orderBy("item_id", "text").collect()
        yield Benchmark([r["item_id"] for r in found], [r["text"] for r in found], least)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_TILE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest_tile of every document and item that it holds."""
    kind, item_kind = (x.simpleString() for x in (docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType))
    schema = f"doc_id {kind}, item_id {item_kind}, coverage double, n_tiles int, longest_tile int"
    out = None
    for block in blocks(benchmark, least):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                rows = list(shared.value.matches(batch.column("text"), coverage))
                ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                item = pa.array([shared.value.ids[r[1]] for r in rows], pa.int64()) if item_kind == "bigint" else pa.array([shared.value.ids[r[1]] for r in rows])
                yield pa.RecordBatch.from_arrays([ids, item, pa.array([round(r[2], 6) for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.int32())], ["doc_id", "item_id", "coverage", "n_tiles", "longest_tile"])

        part = docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = MIN_TILE) -> DataFrame:
    """The documents that hold no item, all columns."""
    for block in blocks(benchmark, least):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in shared.value.matches(batch.column("text"), coverage):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs
