"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how many documents link them.

Tokens of both encodings are spans of the same bytes. Offsets at which tokens of both end cut a
text into groups; an A and a B token are linked where their spans overlap. Between two
neighbouring ends (of either side) lies one stretch that belongs to one token of each side, and two
overlapping tokens share exactly one such stretch, so the links of a text are its stretches.

Fast path: an array made once from the vocabularies gives for each A id the B id of the same
bytes. Links that follow it (all exact one-to-one groups but those of a byte's second name) are
counted in a vector of the vocabulary's length, kept by each task and sent once; only the pairs of
irregular groups are counted by key and shuffled, after each task has summed its own.

Counts then go back to the documents. Vocabularies bound the number of pairs whatever the
input's size; they are broadcast in blocks of at most BLOCK_PAIRS, split by A id, and the number of
blocks is bounded by the vocabularies too. Texts are encoded once: ids are kept in the shared folder.

Defined cases: texts that are null or empty, or whose joined bytes of either side differ from blank
and text (a tokenizer that rewrites characters), have no tokens: zeros and an empty digest; null and repeated ids are
rows like others, and each row counts as a document; an empty table gives an empty one; very long
texts need memory in proportion to one text; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle
from .textscan import pieces

SLICE_BYTES = 1 << 21
KEPT_PAIRS = 1 << 21
BLOCK_PAIRS = 1 << 23
MAX_STRETCHES = 1 << 19
SHIFT = 20  # bits of a B id within a pair's key
_NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_vocabulary(path: str) -> dict[bytes, int]:
    """Token bytes to ids of a byte-level BPE file in JSON; its merges must be in the order of the ids they make."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(x >= y for x, y in zip(made, made[1:])):
        raise ValueError("merges are not in the order of their ids")
    return ranks


def piece_bytes(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """The bytes of each piece: the mark U+2581 is a blank, <0xHH> a byte; control pieces have none."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else piece.replace("▁", " ").encode())
    return out


class Pair:
    """Two tokenizers, with lengths of their tokens and the map from A ids to B ids of the same bytes (-1 where there is none)."""

    def __init__(self, a_file: str, b_file: str, pattern: str):
        ranks = byte_vocabulary(a_file)
        # a special token's string within a text is plain text: the encoding knows none
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.a_bytes[i] = raw
        self.b_bytes = piece_bytes(self.b)
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        first: dict[bytes, int] = {}
        for i, raw in enumerate(self.b_bytes):
            if raw and (raw not in first or self.b.is_byte(first[raw])):  # the piece itself before a byte's name
                first[raw] = i
        self.same = np.array([first.get(raw, -1) if raw else -1 for raw in self.a_bytes], np.int64)
        digits = [str(i).encode() for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.digits = np.array(digits, f"S{max(map(len, digits)) + 1}").view(np.uint8).reshape(len(digits), -1)
        self.n_digits = np.array([len(x) for x in digits], np.int64)

    def encode(self, stretches: list[str]):
        """Ids of blank and stretch on both sides, laid end to end, with their numbers, and whether both sides' bytes are those; there are no ids where they aren't."""
        one = self.a.encode_ordinary
        a, b = [one(" " + t) for t in stretches], self.b.encode(stretches, num_threads=1)
        raws = [(" " + t).encode() for t in stretches]
        true = np.ones(len(stretches), bool)
        size = np.array([len(x) for x in raws], np.int64)
        sides = []
        for ids, raw_of, n_of in ((a, self.a_bytes, self.a_size), (b, self.b_bytes, self.b_size)):
            flat = np.fromiter(chain.from_iterable(ids), np.int64)
            n = np.array([len(x) for x in ids], np.int64)
            ends = np.concatenate([[0], np.cumsum(n_of[flat])])[np.cumsum(n)]
            if b"".join([raw_of[i] for i in flat.tolist()]) != b"".join(raws) or (ends != np.cumsum(size)).any():
                true &= np.array([b"".join([raw_of[i] for i in x]) == raw for x, raw in zip(ids, raws)], bool)
            sides.append((flat, n))
        return [(flat[np.repeat(true, n)], np.where(true, n, 0)) for flat, n in sides], true


_pairs: dict[tuple, Pair] = {}


def pair_of(a_file: str, b_file: str, pattern: str) -> Pair:
    """The tokenizers, made once in each worker."""
    key = (a_file, b_file, pattern)
    if key not in _pairs:
        _pairs[key] = Pair(*key)
    return _pairs[key]


class Links:
    """Groups and links of stretches laid end to end: side by side arrays, a row for each link."""

    def __init__(self, pair: Pair, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]):
        (self.a, self.n_a), (self.b, self.n_b) = a, b
        self.pair, self.n = pair, len(self.n_a)
        self.a_end, self.b_end = np.cumsum(pair.a_size[self.a]), np.cumsum(pair.b_size[self.b])
        ends = np.union1d(self.a_end, self.b_end)
        at_a, at_b = np.searchsorted(self.a_end, ends), np.searchsorted(self.b_end, ends)
        self.owner = np.repeat(np.arange(self.n), self.n_a)[at_a] if len(ends) else ends
        self.keys = (self.a[at_a] << SHIFT) | self.b[at_b]

    def groups(self) -> tuple[np.ndarray, list[bytes]]:
        """Number of groups of each stretch, and their listing."""
        both = np.intersect1d(self.a_end, self.b_end, assume_unique=True)
        last_a, last_b = np.searchsorted(self.a_end, both), np.searchsorted(self.b_end, both)  # of each group
        n_groups = np.bincount(np.repeat(np.arange(self.n), self.n_a)[last_a], minlength=self.n) if len(both) else np.zeros(self.n, np.int64)
        group_a, group_b = np.searchsorted(last_a, np.arange(len(self.a))), np.searchsorted(last_b, np.arange(len(self.b)))
        before = np.concatenate([[-1], last_b])  # B tokens of the groups before stand before a group's A tokens
        place_a, place_b = np.arange(len(self.a)) + before[group_a] + 1, np.arange(len(self.b)) + last_a[group_b] + 1
        total = len(self.a) + len(self.b)
        ids, mark = np.zeros(total, np.int64), np.full(total, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a[last_a]], mark[place_b[last_b]] = ord("|"), ord(";")
        text = self.pair.digits[ids]
        size = self.pair.n_digits[ids]
        text[np.arange(total), size] = mark
        flat = text[np.arange(text.shape[1]) <= size[:, None]].tobytes()
        upto = np.concatenate([[0], np.cumsum(size + 1)])
        offs = upto[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])].tolist()
        return n_groups, [flat[x : max(x, y - 1)] for x, y in zip(offs, offs[1:])]


def spread(offs: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the rows in a table whose row k has entries offs[k]..offs[k+1], and the index of the row of each."""
    size = offs[rows + 1] - offs[rows]
    owner = np.repeat(np.arange(len(rows)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + offs[rows][owner], owner


class Stretches:
    """Distinct stretches between single blanks, each encoded and aligned once.

    A single blank between other characters begins a token on both sides: the pattern of A starts a
    match there, and no piece of B goes on from another character into a blank. So tokens, groups and
    links of a text are those of its stretches one after the other.
    """

    def __init__(self, pair: Pair):
        if any("▁" in x.lstrip("▁") for x in map(pair.b.id_to_piece, range(pair.b.get_piece_size()))):
            raise ValueError("a piece goes on into a blank: texts can't be cut at blanks")
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        none = np.zeros(0, np.int64)
        self.n_a, self.n_b, self.n_groups, self.true, self.keys, self.offs, self.listing = none, none, none, none.astype(bool), none, np.zeros(1, np.int64), []

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Stretches of all texts, one after the other, and the number of each text's; empty texts have none."""
        if len(self.index) > MAX_STRETCHES:
            self.clear()
        cut = [_SINGLE.split(t) if t else [] for t in texts]
        new = list(dict.fromkeys(x for own in cut for x in own if x not in self.index))
        if new:
            self._add(new)
        index = self.index
        return np.array([index[x] for own in cut for x in own], np.int64), np.array([len(own) for own in cut], np.int64)

    def _add(self, new: list[str]) -> None:
        sides, true = self.pair.encode(new)
        links = Links(self.pair, *sides)
        n_groups, listing = links.groups()
        for x in new:
            self.index[x] = len(self.index)
        n_links = np.bincount(links.owner, minlength=len(new))
        join = lambda x, y: np.concatenate([x, y])
        self.n_a, self.n_b, self.n_groups, self.true, self.keys = join(self.n_a, links.n_a), join(self.n_b, links.n_b), join(self.n_groups, n_groups), join(self.true, true), join(self.keys, links.keys)
        self.offs = join(self.offs, self.offs[-1] + np.cumsum(n_links))
        self.listing += listing


_stretches: dict[tuple, Stretches] = {}


def stretches_of(*files: str) -> Stretches:
    """The stretches that this worker has met; tasks that come later find them."""
    if files not in _stretches:
        _stretches[files] = Stretches(pair_of(*files))
    return _stretches[files]


def slices(batch: pa.RecordBatch):
    """(first row, texts) of some rows at a time."""
    for piece in pieces(batch.column("text"), SLICE_BYTES):
        raw = piece.data.tobytes()
        yield piece.lo, [raw[x:y].decode() for x, y in zip(piece.offs.tolist(), piece.offs[1:].tolist())]


def whole(found: Stretches, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of the texts of which every stretch kept its bytes, and the text of each."""
    owner = np.repeat(np.arange(len(size)), size)
    good = np.bincount(owner[~found.true[at]], minlength=len(size)) == 0
    return at[good[owner]], owner[good[owner]]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    kinds, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(kinds), np.int64)
    np.add.at(total, where, np.concatenate(counts))
    return kinds, total


def pair_counts(docs: DataFrame, a_file: str, b_file: str, pattern: str) -> DataFrame:
    """a, b, n: in how many documents the two ids are linked."""

    def run(batches):
        pair = pair_of(a_file, b_file, pattern)
        found, width = stretches_of(a_file, b_file, pattern), len(pair.same)
        vector = np.zeros(width, np.int64)
        keys, counts, held = [], [], 0

        def rows(a, b, n):
            return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "n"])

        for batch in batches:
            for _, texts in slices(batch):
                at, owner = whole(found, *found.of(texts))
                once = np.unique(owner * len(found.listing) + at)  # a stretch counts once in a text
                place, row = spread(found.offs, once % max(1, len(found.listing)))
                owner, key = (once // max(1, len(found.listing)))[row], found.keys[place]
                regular = pair.same[key >> SHIFT] == key & ((1 << SHIFT) - 1)
                vector += np.bincount(np.unique(owner[regular] * width + (key[regular] >> SHIFT)) % width, minlength=width)
                kinds, where = np.unique(key[~regular], return_inverse=True)
                once = np.unique(owner[~regular] * max(1, len(kinds)) + where)
                keys.append(kinds)
                counts.append(np.bincount(once % max(1, len(kinds)), minlength=len(kinds)))
                held += len(kinds)
                if held > KEPT_PAIRS:
                    keys, counts = ([x] for x in _summed(keys, counts))
                    held = len(keys[0])
                    if held > KEPT_PAIRS // 2:
                        yield rows(keys[0] >> SHIFT, keys[0] & ((1 << SHIFT) - 1), counts[0])
                        keys, counts, held = [], [], 0
        if keys:
            kinds, n = _summed(keys, counts)
            yield rows(kinds >> SHIFT, kinds & ((1 << SHIFT) - 1), n)
        seen = np.flatnonzero(vector)
        yield rows(seen, pair.same[seen], vector[seen])

    return docs.select("text").mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def blocks_of(counts: DataFrame, limit: int = BLOCK_PAIRS) -> list[tuple[int, int]]:
    """Ranges of A ids that hold at most ``limit`` pairs each (an id of more pairs has a range of its own)."""
    sizes = counts.groupBy("a").agg(F.count("*").alias("held")).toArrow().sort_by("a")  # a row for each A id at most
    out: list[tuple[int, int]] = []
    room = 0
    for a, held in zip(sizes.column("a").to_pylist(), sizes.column("held").to_pylist()):
        if not out or room + held > limit:
            out.append((a, a))
            room = 0
        out[-1] = (out[-1][0], a)
        room += held
    return out


def _block(counts: DataFrame, low: int, high: int):
    """Sorted keys of the pairs of these A ids, their counts, and whether a count is its A id's highest."""
    table = counts.where(F.col("a").between(low, high)).toArrow()
    keys = (table.column("a").to_numpy().astype(np.int64) << SHIFT) | table.column("b").to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], table.column("n").to_numpy()[order]
    if not len(keys):
        return keys, n, n == 0
    first = np.concatenate([[True], keys[1:] >> SHIFT != keys[:-1] >> SHIFT])
    return keys, n, np.maximum.reduceat(n, np.flatnonzero(first))[np.cumsum(first) - 1] == n


def _aligned(docs: DataFrame, counts: DataFrame, block: tuple[int, int], files: tuple[str, str, str], carry: list[str]) -> DataFrame:
    """The carried columns, counts of tokens, groups and links, the listing's digest, and n_best and count_sum over the links of one block's A ids."""
    low, high = block
    shared = docs.sparkSession.sparkContext.broadcast(_block(counts, low, high))

    def run(batches):
        found = stretches_of(*files)
        keys, n, is_best = shared.value
        best = total = np.zeros(0, np.int64)  # of each stretch
        for batch in batches:
            for lo, texts in slices(batch):
                if len(found.index) > MAX_STRETCHES:
                    found.clear()
                    best = total = best[:0]
                at, owner = whole(found, *found.of(texts))
                new = found.keys[found.offs[len(best)] :]
                row = np.repeat(np.arange(len(found.listing) - len(best)), np.diff(found.offs[len(best) :]))
                inside = (new >> SHIFT >= low) & (new >> SHIFT <= high)
                place = np.searchsorted(keys, new[inside])
                best, total = (np.concatenate([old, np.bincount(row[inside], weights=values[place], minlength=len(found.listing) - len(old)).astype(np.int64)]) for old, values in ((best, is_best), (total, n)))
                links = np.diff(found.offs)
                sums = [np.bincount(owner, weights=of[at], minlength=len(texts)).astype(np.int64) for of in (found.n_a, found.n_b, found.n_groups, links, best, total)]
                edge = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
                listed = at.tolist()
                digests = [hashlib.sha256(b";".join([found.listing[i] for i in listed[x:y]])).hexdigest() if y > x else "" for x, y in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, len(texts)) for c in carry), *map(pa.array, sums), pa.array(digests, pa.string())], [*carry, *_NUMBERS, "groups_sha256"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(*carry, "text").mapInArrow(run, f"{kinds}, {', '.join(f'{c} long' for c in _NUMBERS)}, groups_sha256 string")


def with_counts(docs: DataFrame, counts: DataFrame, a_file: str, b_file: str, pattern: str, limit: int = BLOCK_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. One block goes through in one pass; several are summed by row, for which rows are numbered and written."""
    files = (a_file, b_file, pattern)
    blocks = blocks_of(counts, limit) or [(0, 0)]
    if len(blocks) == 1:
        return _aligned(docs, counts, blocks[0], files, ["doc_id"])
    numbered = settle(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    parts = [_aligned(numbered, counts, block, files, ["row", "doc_id"]) for block in blocks]
    once = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    out = reduce(DataFrame.unionByName, parts).groupBy(*once).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select("doc_id", *_NUMBERS, "groups_sha256")


def align(docs: DataFrame, a_file: str, b_file: str, pattern: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    counts = settle(pair_counts(docs, a_file, b_file, pattern))
    return with_counts(docs, counts, a_file, b_file, pattern)
