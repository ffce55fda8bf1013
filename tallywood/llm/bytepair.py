"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

Encoding. A text is split by a pattern; every match is transduced on its own. The merges
are compiled into a trie of token bytes and the last merge of each token. A state of the
transducer is (last emitted token, pending bytes): for each pending prefix it holds the
only token that can end there, and for each pending place the trie node of the bytes from
there on. States and transitions are made when some match first needs them, and all
matches of a batch go through them side by side, a byte at a time, in numpy; the missing
transitions of a step are made together. A token is emitted as soon as all continuations
agree on it: a later token can reach back no further than to the first pending place that
still begins some token. Should WIDTH bytes be pending, the match is encoded by the plain
merges instead.

Two neighbouring tokens can stand together only if no merge across their boundary comes
before a merge inside them. That is read off the last merges: the two pieces at the
boundary are undone one after the other, the later merge first, and at each step the pair
at the boundary must not be a merge that would have come earlier.

Decoding. Token bytes are concatenated in pieces; bytes are released through an incremental
UTF-8 state machine that keeps an unfinished character until its next bytes come.
Malformed bytes become U+FFFD by maximal subparts.

Memory is bounded: the tables of states and of whole stretches are emptied when they exceed
their documented sizes; results don't depend on it.

Defined cases: a null text is an empty one and has no ids; null, repeated and large ids are
carried through unchanged; an empty table gives an empty one; an unknown id in decoding is
an error; very long texts need memory in proportion to one text; columns other than doc_id
and text are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import give_back, tidy, worker_tables
from .textscan import SPACE, Piece, _power_tables, mix, pieces

MAX_STATES = 250_000
MAX_MATCHES = 250_000
WIDTH = 16
DECODE_IDS = 1 << 16
PIECE = 1 << 19
_NEVER = np.int64(1 << 40)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class HashTable:
    """int64 keys (not negative) to int32 values in open addressing; lookups and inserts go by arrays."""

    def __init__(self, bits: int):
        self.mask = np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        x = keys * np.int64(0x9E3779B97F4A7C1 | 1)
        return (x ^ (x >> np.int64(29))) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values; -1 where there is none."""
        at = self.slots(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        at, left = self.slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = values[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            left = left[lost[left]]
            at[left] = (at[left] + 1) & self.mask


def merge(ranks: dict[bytes, int], raw: bytes, below: int | None = None) -> list[bytes]:
    """The merges (of a rank under ``below``, where given) applied in order of rank, leftmost first."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Merges:
    """The compiled vocabulary: token bytes, trie, last merges; made once on the driver and sent to the tasks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        n = max(ranks.values()) + 1
        self.bytes_of = [b""] * n
        for raw, rank in ranks.items():
            self.bytes_of[rank] = raw
        self.size = np.array([len(x) for x in self.bytes_of], np.int64)
        # trie: node 0 is the root; child of (node, byte); the token of a node or -1
        nodes, edges, token = {b"": 0}, [], [-1]
        for raw in sorted(ranks):
            for i in range(1, len(raw) + 1):
                if raw[:i] not in nodes:
                    nodes[raw[:i]] = len(token)
                    edges.append((nodes[raw[: i - 1]] << 8 | raw[i - 1], len(token)))
                    token.append(-1)
            token[nodes[raw]] = ranks[raw]
        self.trie = HashTable(max(10, (4 * len(edges)).bit_length()))
        keys, values = (np.array(x) for x in zip(*edges))
        self.trie.put(keys.astype(np.int64), values.astype(np.int32))
        # last merge of each token (itself for single bytes), when it is made, and pairs that merge
        self.left, self.right = np.arange(n), np.arange(n)
        self.time = np.full(n, -1, np.int64)
        reachable = np.zeros(n, bool)
        for raw, rank in ranks.items():
            parts = merge(ranks, raw, rank)
            if len(raw) == 1:
                reachable[rank] = True
            elif len(parts) == 2:
                reachable[rank], self.time[rank] = True, rank
                self.left[rank], self.right[rank] = ranks[parts[0]], ranks[parts[1]]
        self.node_token = np.array(token, np.int32)
        used = self.node_token >= 0
        self.node_token[used] = np.where(reachable[self.node_token[used]], self.node_token[used], -1)
        self.pairs = HashTable(max(10, (8 * n).bit_length()))
        every = [(ranks[raw[:i]] << 24 | ranks[raw[i:]], rank) for raw, rank in ranks.items() for i in range(1, len(raw)) if raw[:i] in ranks and raw[i:] in ranks]
        keys, values = (np.array(x) for x in zip(*every)) if every else (np.zeros(0), np.zeros(0))
        self.pairs.put(keys.astype(np.int64), values.astype(np.int32))
        self.begins = np.concatenate([[0], np.cumsum(self.size)])[:-1]
        self.pool = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def stand(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Can right follow left? A left of -1 is the beginning."""
        good = np.ones(len(left), bool)
        at = np.flatnonzero(left >= 0)
        x, y, limit = left[at].astype(np.int64), right[at].astype(np.int64), np.full(len(at), _NEVER)
        while len(at):
            made = self.pairs.get(x << 24 | y)
            crossed = (made >= 0) & (made < limit)
            good[at[crossed]] = False
            tx, ty = self.time[x], self.time[y]
            go = ~crossed & ((tx >= 0) | (ty >= 0))
            at, x, y, tx, ty = at[go], x[go], y[go], tx[go], ty[go]
            undo_left = tx > ty  # of equal merges the left one comes first, so the right one is the later
            limit = np.where(undo_left, tx, ty + 1)  # and a merge across the boundary comes before an equal one on its right
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        return good


class Transducer:
    """The states that were needed so far, as rows of arrays."""

    def __init__(self, merges: Merges, room: int = MAX_STATES):
        self.m, self.room = merges, room
        self.reset()

    def reset(self) -> None:
        rows = 1 << 12
        self.count = 1
        self.token, self.pending = np.full(rows, -1, np.int32), np.zeros(rows, np.int8)
        self.tail = np.zeros((rows, WIDTH), np.uint8)
        self.node = np.full((rows, WIDTH), -1, np.int32)  # of the bytes from each pending place on; -1: begin no token
        self.last = np.zeros((rows, WIDTH + 1), np.int32)  # token that ends each pending prefix
        self.first = np.zeros((rows, WIDTH + 1), np.int8)  # first cut on the way to each pending prefix
        self.out_at, self.out_n = np.zeros(rows, np.int64), np.zeros(rows, np.int8)
        self.out, self.out_used = np.zeros(1 << 14, np.int32), 0
        self.after = HashTable(16)
        self.moves = 0
        self.entered: dict[bytes, int] = {}

    def _grow(self, need: int) -> None:
        for name in ("token", "pending", "tail", "node", "last", "first", "out_at", "out_n"):
            old = getattr(self, name)
            if len(old) < need:
                new = np.zeros((max(need, 2 * len(old)), *old.shape[1:]), old.dtype)
                new[: len(old)] = old
                setattr(self, name, new)

    def _make(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """States after the given (state, byte); -2 where WIDTH would be exceeded."""
        m, rows = self.m, len(state)
        size = self.pending[state].astype(np.int64)
        result = np.full(rows, -2, np.int64)
        fits = np.flatnonzero(size < WIDTH)
        state, byte, size = state[fits], byte[fits], size[fits]
        rows = len(state)
        if not rows:
            return result
        each, wide = np.arange(rows), int(size.max()) + 1
        token, tail, node = self.token[state], self.tail[state, :wide], self.node[state, :wide]
        last, first = self.last[state, : wide + 1], self.first[state, : wide + 1]
        tail[each, size] = byte
        node[each, size] = 0
        # trie nodes one byte on
        alive = (node >= 0) & (np.arange(wide) <= size[:, None])
        r, k = np.nonzero(alive)
        moved = m.trie.get(node[r, k].astype(np.int64) << 8 | byte[r])
        node[r, k] = moved
        # of the tokens that end here the longest that can stand; exactly one can
        ends = moved >= 0
        r, k = r[ends], k[ends]
        deepest = np.full(rows, WIDTH, np.int64)
        np.minimum.at(deepest, r, k)
        found = m.node_token[node[r, k]]
        r, k, found = r[found >= 0], k[found >= 0], found[found >= 0]
        before = np.where(k > 0, last[r, k], token[r])
        ok = m.stand(before, found)
        r, k, found = r[ok], k[ok], found[ok]
        one, at = np.unique(r, return_index=True)
        if len(one) < rows:
            raise ValueError("bytes without a token")
        size += 1
        last[each, size] = found[at]
        first[each, size] = np.where(k[at] == 0, size, first[each, k[at]])
        # tokens that all ways from the reachable places share
        outs: list[tuple[np.ndarray, np.ndarray]] = []
        place = np.arange(wide + 1)
        check = each
        while len(check):
            inside = (place >= deepest[check][:, None]) & (place <= size[check][:, None])
            f = first[check]
            low, high = np.where(inside, f, np.int8(WIDTH + 1)).min(axis=1), np.where(inside, f, np.int8(0)).max(axis=1)
            agree = (low == high) & (low > 0) & (deepest[check] > 0)
            check, cut = check[agree], low[agree].astype(np.int64)
            if not len(check):
                break
            token[check] = last[check, cut]
            outs.append((check, token[check]))
            shift = np.minimum(np.arange(wide) + cut[:, None], wide)
            pad = lambda x, v: np.concatenate([x[check], np.full((len(check), 1), v, x.dtype)], axis=1)
            tail[check] = np.take_along_axis(pad(tail, 0), shift, axis=1)
            node[check] = np.take_along_axis(pad(node, -1), shift, axis=1)
            last[check, 1:] = np.take_along_axis(last[check][:, 1:], np.minimum(shift, wide - 1), axis=1)
            size[check] -= cut
            deepest[check] -= cut
            here, line = first[check], last[check]
            for j in range(1, int(size[check].max()) + 1):
                back = j - m.size[line[:, j]]
                here[:, j] = np.where(back <= 0, j, here[np.arange(len(check)), np.maximum(back, 0)])
            first[check] = here
        tail[np.arange(wide) >= size[:, None]] = 0
        # equal states are one
        emitted = np.zeros(rows, np.int64)
        for r, _ in outs:
            emitted[r] += 1
        given = np.full(rows, -1, np.int64)
        if outs:
            which = np.flatnonzero(emitted)
            line = np.full((len(which), len(outs)), -1, np.int32)
            spot = np.full(rows, -1)
            spot[which] = np.arange(len(which))
            for j, (r, t) in enumerate(outs):
                line[spot[r], j] = t
            packed = np.concatenate([line.view(np.uint8).reshape(len(which), -1), size[which, None].astype(np.uint8), tail[which]], axis=1)
            names, width = packed.tobytes(), packed.shape[1]
            fresh = []
            new = self.count
            for i, row in enumerate(which.tolist()):
                key = names[i * width : (i + 1) * width].rstrip(b"\x00")
                own = self.entered.get(key)
                if own is None:
                    own = self.entered[key] = new
                    new += 1
                    fresh.append(row)
                given[row] = own
        else:
            fresh, new = [], self.count
        plain = np.flatnonzero(given < 0)
        given[plain] = new + np.arange(len(plain))
        new += len(plain)
        made = np.concatenate([np.array(fresh, np.int64), plain])
        self._grow(new)
        at = given[made]
        self.token[at], self.pending[at], self.out_n[at] = token[made], size[made], emitted[made]
        self.tail[at, :wide], self.node[at, :wide], self.node[at, wide:] = tail[made], node[made], -1
        self.last[at, : wide + 1], self.first[at, : wide + 1] = last[made], first[made]
        total = int(emitted[made].sum())
        if self.out_used + total > len(self.out):
            self.out = np.concatenate([self.out, np.zeros(max(total, len(self.out)), np.int32)])
        self.out_at[at] = self.out_used + np.cumsum(emitted[made]) - emitted[made]
        self.out_used += total
        is_made = np.zeros(rows, bool)
        is_made[made] = True
        for j, (r, t) in enumerate(outs):
            r, t = r[is_made[r]], t[is_made[r]]
            self.out[self.out_at[given[r]] + j] = t
        self.count = new
        result[fits] = given
        return result

    def _follow(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = state << 8 | byte
        found = self.after.get(key).astype(np.int64)
        miss = np.flatnonzero(found == -1)
        if len(miss):
            new, at = np.unique(key[miss], return_inverse=True)
            after = self._make(new >> 8, (new & 255).astype(np.uint8))
            self.moves += len(new)
            if 2 * self.moves > len(self.after.keys):
                old = self.after
                self.after = HashTable(int(4 * self.moves).bit_length())
                held = np.flatnonzero(old.keys >= 0)
                self.after.put(old.keys[held], old.values[held])
            self.after.put(new, after.astype(np.int32))
            found[miss] = after[at]
        return found

    def encode_all(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all one after the other, the number of each)."""
        if self.count > self.room:
            self.reset()
        n = len(raws)
        lens = np.fromiter(map(len, raws), np.int64, n)
        begin = np.cumsum(lens) - lens
        data = np.frombuffer(b"".join(raws), np.uint8)
        order = np.argsort(-lens, kind="stable")
        sorted_lens, at = lens[order], begin[order]
        state = np.zeros(n, np.int64)
        owner, turn, ids = [], [], []
        live = np.arange(n)
        for i in range(int(sorted_lens[0]) if n else 0):
            live = live[: np.searchsorted(live, np.searchsorted(-sorted_lens, -i, "left"))]  # those longer than i
            if not len(live):
                break
            now = self._follow(state[live], data[at[live] + i].astype(np.int64))
            state[live] = now
            live, now = live[now >= 0], now[now >= 0]
            many = self.out_n[now].astype(np.int64)
            gives = np.flatnonzero(many)
            if len(gives):
                many = many[gives]
                inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                ids.append(self.out[np.repeat(self.out_at[now[gives]], many) + inner])
                owner.append(np.repeat(live[gives], many))
                turn.append(np.full(len(inner), i, np.int64) * (WIDTH + 1) + inner)
        # what is pending, read backwards
        done = np.flatnonzero(state >= 0)
        end = self.pending[state[done]].astype(np.int64)
        back = np.int64(1 << 50)
        while True:
            done, end = done[end > 0], end[end > 0]
            if not len(done):
                break
            t = self.last[state[done], end]
            ids.append(t)
            owner.append(done)
            back -= 1
            turn.append(np.full(len(done), back))
            end = end - self.m.size[t]
        for row in np.flatnonzero(state == -2).tolist():
            got = [self.m.ranks[x] for x in merge_long(self.m.ranks, raws[order[row]])]
            keep = [o != row for o in owner]
            owner, turn, ids = ([x[k] for x, k in zip(y, keep)] for y in (owner, turn, ids))
            ids.append(np.array(got, np.int32))
            owner.append(np.full(len(got), row))
            turn.append(np.arange(len(got)))
        if not ids:
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        owner = order[np.concatenate(owner)]
        sort = np.lexsort((np.concatenate(turn), owner))
        return np.concatenate(ids)[sort].astype(np.int64), np.bincount(owner, minlength=n)


def merge_long(ranks: dict[bytes, int], raw: bytes) -> list[bytes]:
    """The merges in order of rank, leftmost first, with a heap of neighbours: for long matches."""
    import heapq

    n = len(raw)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            rank = ranks.get(raw[i : end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    gone = [False] * n
    while heap:
        _, i, cut, stop = heapq.heappop(heap)
        j = after[i]
        if gone[i] or end[i] != cut or j >= n or end[j] != stop:
            continue
        gone[j] = True
        end[i] = stop
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [raw[i : end[i]] for i in range(n) if not gone[i]]


#: Patterns that take at most one blank before a word and whitespace runs whole: no match crosses
#: a single blank between two other characters, so stretches between such blanks are independent.
BLANK_PATTERNS = frozenset({r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""})
_LATIN = np.zeros(256, bool)  # bytes of the letters up to U+024F, but for two signs in between
_LATIN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = True
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


class Memo:
    """Ids of known byte strings, side by side in one array; beyond MAX_MATCHES only those of the last piece stay."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.begin, self.size, self.ids = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, keys: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        at = len(self.begin)
        self.place.update(zip(keys, range(at, at + len(keys))))
        self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(sizes) - sizes])
        self.size, self.ids = np.concatenate([self.size, sizes]), np.concatenate([self.ids, ids])

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the entries one after the other, and the size of each."""
        size = self.size[at]
        return self.ids[np.repeat(self.begin[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))], size

    def trim(self, keys: list[bytes], at: np.ndarray) -> None:
        if len(self.place) > MAX_MATCHES:
            ids, size = self.gather(at)
            self.__init__()
            self.add(keys, ids, size)


class Codec:
    """Encoder and decoder for one vocabulary and one pattern."""

    def __init__(self, merges: Merges, pattern: str):
        self.m, self.transducer, self.split = merges, Transducer(merges), regex.compile(pattern)
        self.by_blanks = pattern in BLANK_PATTERNS
        self.memo = Memo()

    def encode_column(self, column: pa.Array):
        """(first row, ids of a piece's texts one after the other, their offsets by text), piece by piece."""
        for piece in pieces(column, PIECE):
            yield piece.lo, *self._encode_piece(piece)

    def _encode_piece(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        data, offs, n = piece.data, piece.offs, len(piece)
        begin = self._cuts(data, offs)
        if begin is None:
            begin, kinds, where = self._matches(piece, np.arange(n))
        else:
            kinds, where, first = self._distinct(data, begin)
            unsafe = np.flatnonzero(~self._known(kinds, self._plain(data, begin)[first])[where] | self._edges(data, begin))
            if len(unsafe):  # texts with other whitespace go by their matches
                owner = np.searchsorted(offs, begin, "right") - 1
                whole = np.unique(owner[unsafe])
                rest = ~np.isin(owner, whole)
                b2, k2, w2 = self._matches(piece, whole)
                order = np.argsort(np.concatenate([begin[rest], b2]), kind="stable")
                begin = np.concatenate([begin[rest], b2])[order]
                where = np.concatenate([where[rest], w2 + len(kinds)])[order]
                kinds = kinds + k2
                used, where = np.unique(where, return_inverse=True)
                kinds = [kinds[i] for i in used]
        at = np.fromiter(map(self.memo.place.__getitem__, kinds), np.int64, len(kinds))
        ids, size = self.memo.gather(at[where])
        ends = np.concatenate([[0], np.cumsum(size)])
        out = ids, ends[np.searchsorted(begin, offs)]
        self.memo.trim(kinds, at)
        return out

    def _cuts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray | None:
        """Where stretches begin: at each blank and each text."""
        if not self.by_blanks:
            return None
        mark = data == 32
        mark[offs[:-1][np.diff(offs) > 0]] = True
        return np.flatnonzero(mark)

    @staticmethod
    def _edges(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Stretches that are a blank alone, or begin (behind the blank) or end with other ASCII whitespace."""
        end = np.append(begin[1:], len(data))
        inner = np.minimum(begin + (data[begin] == 32), len(data) - 1)
        white = SPACE.copy()
        white[28:32] = True
        return (end - begin == (data[begin] == 32)) | white[data[inner]] | white[data[end - 1]]

    @staticmethod
    def _plain(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Stretches of letters up to U+024F behind their blank: surely one match."""
        other = ~_LATIN[data]
        other[1:] |= ((data[1:] == 0x97) | (data[1:] == 0xB7)) & (data[:-1] == 0xC3)  # the signs of multiplication and division
        other[begin] &= data[begin] != 32
        return np.add.reduceat(other, begin, dtype=np.int64) == 0 if len(begin) else np.zeros(0, bool)

    @staticmethod
    def _distinct(data: np.ndarray, begin: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct stretches, the number of each stretch's, and the first stretch of each; equal hashes are compared by bytes."""
        end = np.append(begin[1:], len(data))
        up, down = _power_tables(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_VALUE[data] * up[: len(data)], out=total[1:], dtype=np.uint64)
            hashes = mix((total[end] - total[begin]) * down[begin])
        _, first, where = np.unique(hashes, return_index=True, return_inverse=True)
        size, of = end - begin, begin[first][where]
        raw = data.tobytes()
        if (size != size[first][where]).any() or not np.array_equal(data, data[np.repeat(of - begin, size) + np.arange(len(data))]):
            kinds: dict[bytes, int] = {}
            where = np.array([kinds.setdefault(raw[a:b], len(kinds)) for a, b in zip(begin.tolist(), end.tolist())])
            return list(kinds), where, first
        return [raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist())], where, first

    def _matches(self, piece: Piece, rows: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Begin, distinct matches and the number of each match's, of the texts in the given rows."""
        kinds: dict[bytes, int] = {}
        where, begin = [], []
        for row in rows.tolist():
            a, b = piece.offs[row], piece.offs[row + 1]
            found = [x.encode("utf-8") for x in self.split.findall(piece.data[a:b].tobytes().decode("utf-8"))]
            size = np.fromiter(map(len, found), np.int64, len(found))
            begin.append(a + np.cumsum(size) - size)
            where += [kinds.setdefault(x, len(kinds)) for x in found]
        self._learn([x for x in kinds if x not in self.memo.place], [])
        return (np.concatenate(begin) if begin else np.zeros(0, np.int64)), list(kinds), np.array(where, np.int64)

    def _known(self, kinds: list[bytes], plain: np.ndarray) -> np.ndarray:
        """Encode the stretches that aren't known yet; False for those with whitespace at their edges."""
        place, find = self.memo.place, self.split.findall
        good = np.ones(len(kinds), bool)
        plain = plain.tolist()
        new = [i for i, raw in enumerate(kinds) if raw not in place]
        one, several = [kinds[i] for i in new if plain[i]], []
        for i in new:
            if plain[i]:
                continue
            raw = kinds[i]
            text = raw.decode("utf-8")
            body = text[1:] if raw[0] == 32 else text
            if not body or body[0].isspace() or body[-1].isspace():
                good[i] = False
                continue
            found = find(text)
            if len(found) == 1:
                one.append(raw)
            else:
                several.append((raw, [x.encode("utf-8") for x in found]))
        self._learn(one, several)
        return good

    def _learn(self, one: list[bytes], several: list[tuple[bytes, list[bytes]]]) -> None:
        """Transduce distinct matches together; the ids of several matches are joined."""
        self.memo.add(one, *self.transducer.encode_all(one))
        if several:
            place = self.memo.place
            new = list({x: None for _, found in several for x in found if x not in place})
            self.memo.add(new, *self.transducer.encode_all(new))
            at = np.array([place[x] for _, found in several for x in found], np.int64)
            ids, size = self.memo.gather(at)
            count = np.fromiter((len(found) for _, found in several), np.int64, len(several))
            self.memo.add([raw for raw, _ in several], ids, np.add.reduceat(size, np.cumsum(count) - count))

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        return [ids[a:b] for _, ids, offs in self.encode_column(pa.array(texts, pa.string())) for a, b in zip(offs, offs[1:])]

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens, one after the other."""
        sizes = self.m.size[ids]
        if len(ids) == 0:
            return b""
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1])) + np.repeat(self.m.begins[ids] - (ends - sizes), sizes)
        return self.m.pool[at].tobytes()

    def decode_stream(self, ids: np.ndarray, machine: Utf8Machine, size: int = DECODE_IDS):
        """Released bytes of the id stream, piece by piece."""
        for lo in range(0, len(ids), size):
            yield machine.release(self.decode_bytes(ids[lo : lo + size]))
        yield machine.rest()

    def decode(self, ids) -> str:
        machine = Utf8Machine()
        return b"".join(self.decode_stream(np.asarray(ids, dtype=np.int64), machine)).decode("utf-8", "replace")


_KIND = np.zeros(256, np.uint8)  # bytes that a character needs behind its first; 8 for a byte that can't begin one
_KIND[0x80:0xC2] = 8
_KIND[0xC2:0xE0] = 1
_KIND[0xE0:0xF0] = 2
_KIND[0xF0:0xF5] = 3
_KIND[0xF5:] = 8
_LOW, _HIGH = np.full(256, 0x80, np.uint8), np.full(256, 0xBF, np.uint8)  # range of the second byte
_LOW[0xE0], _HIGH[0xED], _LOW[0xF0], _HIGH[0xF4] = 0xA0, 0x9F, 0x90, 0x8F


class Utf8Machine:
    """Incremental UTF-8 decoding: release() gives the bytes of finished characters, rest() what never got finished.

    The state is the open character: its bytes so far, how many it still needs and the range
    that the next byte must be in. A stretch whose transitions are all those of well-formed
    text is stepped over in one go: every byte that isn't a first byte must be one that the
    first byte before it asks for, and those must be there. Otherwise the machine goes byte by byte.
    chars counts released characters; a malformed subpart counts as one, U+FFFD.
    """

    def __init__(self):
        self.need, self.low, self.high, self.chars = 0, 0x80, 0xBF, 0
        self.open = bytearray()

    def release(self, raw: bytes) -> bytes:
        """The bytes that are finished by now, malformed ones included."""
        if self.need:
            return self._step(raw)
        data = np.frombuffer(raw, np.uint8)
        high = np.flatnonzero(data >= 0x80)
        if not len(high):
            self.chars += len(data)
            return raw
        need = _KIND[data]
        first = np.flatnonzero((need >= 1) & (need < 8))
        count = need[first].astype(np.int64)
        end = len(data)
        if len(first) and first[-1] + count[-1] >= end:  # the last character isn't finished
            end = int(first[-1])
            first, count = first[:-1], count[:-1]
            high = high[high < end]
        more = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + 1
        follow = np.setdiff1d(high, first, assume_unique=True) if len(high) else high
        second = data[first + 1] if len(first) else data[:0]
        good = len(more) == len(follow) and bool((more == follow).all()) and bool(((data[more] & 0xC0) == 0x80).all())
        if not (good and bool(((second >= _LOW[data[first]]) & (second <= _HIGH[data[first]])).all())):
            return self._step(raw)
        self.chars += end - len(more)
        return raw[:end] + self._step(raw[end:])

    def _step(self, raw: bytes) -> bytes:
        out = bytearray()
        at, n = 0, len(raw)
        while at < n:
            byte = raw[at]
            if not self.need:
                at += 1
                self.need = int(_KIND[byte])
                if self.need in (0, 8):
                    self.need = 0
                    self.chars += 1
                    out.append(byte)
                else:
                    self.open.append(byte)
                    self.low, self.high = int(_LOW[byte]), int(_HIGH[byte])
            elif self.low <= byte <= self.high:
                at += 1
                self.open.append(byte)
                self.need -= 1
                self.low, self.high = 0x80, 0xBF
                if not self.need:
                    self.chars += 1
                    out += self.open
                    self.open.clear()
            else:
                out += self.rest()  # the byte is read again as a first one
        return bytes(out)

    def rest(self) -> bytes:
        """What is open; it is malformed and counts as one character."""
        out = bytes(self.open)
        self.chars += bool(out)
        self.open.clear()
        self.need = 0
        return out

    def feed(self, raw: bytes) -> str:
        return self.release(raw).decode("utf-8", "replace")

    def close(self) -> str:
        return self.rest().decode("utf-8", "replace")


_codecs: dict[tuple, Codec] = worker_tables("bytepair")


def _codec(shared, pattern: str) -> Codec:
    """One codec for each Python worker, vocabulary and pattern, until a task of another operator runs there."""
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value, pattern)
        gc.freeze()  # the tables hold no cycles; going through them again and again costs much
    return _codecs[key]


def _share(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(Merges(read_ranks(path)))  # as large as the vocabulary


def encode_column(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array<int>) of every whole text."""
    kind, shared = docs.schema["doc_id"].dataType.simpleString(), _share(docs, path)

    def run(batches):
        coder = _codec(shared, pattern)
        for batch in batches:
            for lo, ids, offs in coder.encode_column(batch.column("text")):
                column = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(column)), column], ["doc_id", "ids"])
                give_back()

    return docs.select("doc_id", "text").mapInArrow(tidy(run, "bytepair"), f"doc_id {kind}, ids array<int>")


def decode_column(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of every list of ids; a null list gives an empty text."""
    kind, shared = coded.schema["doc_id"].dataType.simpleString(), _share(coded, path)

    def run(batches):
        coder = _codec(shared, pattern)
        for batch in batches:
            texts = [coder.decode([] if x is None else x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(tidy(run, "bytepair"), f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text and decode the ids again, in one pass.

    Columns: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (the bytes that the UTF-8 machine released), n_chars_decoded
    (characters that it released).
    """
    kind, shared = docs.schema["doc_id"].dataType.simpleString(), _share(docs, path)

    def run(batches):
        coder = _codec(shared, pattern)
        for batch in batches:
            for lo, ids, offs in coder.encode_column(batch.column("text")):
                coded = memoryview(ids.astype("<u4").tobytes())
                own, back, chars = [], [], []
                for a, b in zip(offs.tolist(), offs[1:].tolist()):
                    machine, digest = Utf8Machine(), hashlib.sha256()
                    for part in coder.decode_stream(ids[a:b], machine):
                        digest.update(part)
                    own.append(hashlib.sha256(coded[4 * a : 4 * b]).hexdigest())
                    back.append(digest.hexdigest())
                    chars.append(machine.chars)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(own)), pa.array(np.diff(offs)), pa.array(own, pa.string()), pa.array(back, pa.string()), pa.array(chars, pa.int64())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars_decoded"])
                give_back()

    return docs.select("doc_id", "text").mapInArrow(tidy(run, "bytepair"), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars_decoded long")
