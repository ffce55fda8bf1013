"""N-gram Jaccard join with token-combination prefixes.

A document is its set of distinct word shingles. Documents with equal sets form a class
(one node); links between classes are searched with prefixes:

* All shingles have one global order: rare ones by hash, then the listed frequent ones by
  rising frequency. The most frequent of them (in at least 1 / PAIR_SHARE of the
  documents) are in token classes with k = 2, all others in the class with k = 1.
* A set of n shingles has at most t = n - ceil(threshold * n) shingles that a linked set
  lacks. Its prefix is extended until the sum over token classes of max(0, shingles in
  the class - (k - 1)) reaches t + 1. Two linked sets then share k shingles of one class
  within both prefixes, so all single shingles of the first kind and all pairs of the
  second kind are indexed. Frequent shingles alone never bring two documents together.
* For long sets the k = 2 class is split by hash into as many classes as keep the number
  of pairs linear in n; the number follows the size level, and a set is indexed under
  every level that a linked set may have.

Every set also has a bitmap of parities: each bit tells whether an odd number of shingles
falls on it. It has PARITY_BITS bits, or the power of two from the set's size on where
that is more; a longer one is folded to the length of a shorter one. Two sets differ in
at least as many shingles as their bitmaps differ in bits, so most chance candidates are
dropped without their texts, and no link is. BRIEF words of it go along with the postings of
the second round. The others are verified exactly on the whole sets, in two rounds. First every class in a
posting list is compared with the list's hub alone, the class with the fewest rare
shingles and so the one nearest to the middle of a group of near copies; that joins up
large groups at a cost linear in their size. Then only classes that share a posting list and
are still in different components are compared. All pairs that could join two components
have then been verified. Lists are joined by key, never gathered in a task.

Defined cases: null text, empty text and text without words have no shingles, a component
of their own and no links; with fewer words than a shingle the whole sequence is one
shingle; repeated rows are copies of each other and each gives a row; class and shingle
identity is by 64-bit hashes of whole shingles and sets. Rows with a null id take part in
links; a component is named by its least id that isn't null, and only one of null ids alone
has a null name. Rows that share an id link by their own texts. keep_first keeps a component
of null ids too, by one row of it, and each row without words and id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_spread, settle, tidy
from .graph import components
from .textscan import mix, pieces, shingle_set, words

MAX_LISTED = 1 << 17
LISTED_IN_PIECE = 3
PAIR_SHARE = 64
PAIRS_OF = 16
PARITY_BITS = 1024
BRIEF = 8
BROADCAST_NODES = 500_000
_U = np.uint64
_BRIEF = [f"p{i}" for i in range(BRIEF)]


def shingle_sets(column: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) of each text."""
    for piece in pieces(column):
        w = words(piece)
        for row, (a, b) in enumerate(zip(w.offs[:-1].tolist(), w.offs[1:].tolist())):
            yield piece.lo + row, shingle_set(w.hashes[a:b], k)


def frequent_shingles(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Listed shingles (sorted), their ranks by rising frequency, and the rank from which k = 2 holds.

    A shingle is counted in the pieces of text where LISTED_IN_PIECE documents hold it, so
    those in a large share of all documents are found in any partitioning. Any list gives
    the same links; the list only decides how many candidates there are. At most
    MAX_LISTED entries come to the driver.
    """

    def run(batches):
        for batch in batches:
            for piece in pieces(batch.column("text")):
                w = words(piece)
                sets = [shingle_set(w.hashes[a:b], k) for a, b in zip(w.offs[:-1].tolist(), w.offs[1:].tolist())]
                kinds, n = np.unique(np.concatenate(sets), return_counts=True)
                some = n >= LISTED_IN_PIECE
                yield pa.RecordBatch.from_arrays([pa.array(kinds[some].view(np.int64)), pa.array(n[some])], ["h", "n"])

    found = docs.select("text").mapInArrow(tidy(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "h").limit(MAX_LISTED).toArrow()
    total = docs.count()
    h, n = top.column("h").to_numpy().view(_U), top.column("n").to_numpy()
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, n))] = np.arange(len(h))
    order = np.argsort(h)
    return h[order], rank[order], int(len(h) - (n >= max(LISTED_IN_PIECE, total / PAIR_SHARE)).sum())


def allowed(n: int, num: int, den: int) -> int:
    """How many of n shingles a linked set may lack."""
    return n - -(-num * n // den)


def signatures(tokens: np.ndarray, listed: np.ndarray, rank: np.ndarray, cut: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Index keys of a sorted set's prefix, for each the least number of shingles that stand before a shared one, and the number of rare shingles."""
    n = len(tokens)
    need = allowed(n, num, den) + 1
    if len(listed):
        at = np.minimum(np.searchsorted(listed, tokens), len(listed) - 1)
        is_listed = listed[at] == tokens
    else:
        at, is_listed = np.zeros(n, np.int64), np.zeros(n, bool)
    rare = tokens[~is_listed]
    if len(rare) >= need:
        return rare[:need], np.arange(need), len(rare)
    some, ranks = tokens[is_listed], rank[at[is_listed]]
    order = np.argsort(ranks)
    some, ranks = some[order], ranks[order]
    single = np.concatenate([rare, some[ranks < cut]])
    if len(single) >= need:
        return single[:need], np.arange(need), len(rare)
    double = some[ranks >= cut]
    keys, places = [single], [np.arange(len(single))]
    levels = {(-(-num * n // den)).bit_length(), n.bit_length(), (den * n // num).bit_length()}
    for split in sorted({max(1, (1 << level) // (10 * PAIRS_OF)) for level in levels}):
        for key, place in _pairs(double, need - len(single), split):
            keys.append(key)
            places.append(len(single) + place)
    return np.concatenate(keys), np.concatenate(places), len(rare)


def _pairs(double: np.ndarray, need: int, split: int):
    """Pairs within the k = 2 classes of the shortest prefix that gives ``need`` more.

    With one class the first two shared shingles are a pair, so all but one of the shared
    ones stand at or behind its second; with several only the singles are known to stand
    before a shared pair.
    """
    group = (mix(double + _U(split)) % _U(split)).astype(np.int64)
    seen: dict[int, list[int]] = {}
    for token, g in zip(double.tolist(), group.tolist()):
        if need <= 0:
            break
        own = seen.setdefault(g, [])
        need -= bool(own)
        own.append(token)
    for own in seen.values():
        v = np.array(own, _U)
        i, j = np.triu_indices(len(v), 1)
        with np.errstate(over="ignore"):
            yield mix(mix(v[i] + _U(split)) * _U(3) + v[j]), j - 1 if split == 1 else np.zeros(len(j), np.int64)


def parities(tokens: np.ndarray) -> np.ndarray:
    """The set's bitmap as 64-bit words: bit i of 2**m tells whether an odd number of shingles is i modulo 2**m."""
    bits = max(PARITY_BITS, 1 << max(0, len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(_U)


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The bitmap of the same set with ``size`` words."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, size), axis=0)


def apart(x: bytes, y: bytes) -> int:
    """The least number of shingles in which the sets of two bitmaps differ."""
    size = min(len(x), len(y)) // 8
    return int(np.bitwise_count(fold(np.frombuffer(x, _U), size) ^ fold(np.frombuffer(y, _U), size)).sum())


def set_hash(tokens: np.ndarray) -> int | None:
    with np.errstate(over="ignore"):
        return int(mix(np.sum(mix(tokens + _U(len(tokens))), dtype=_U)[None]).view(np.int64)[0]) if len(tokens) else None


def classes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, mark (hash of the text), node (hash of the set; null when empty), n, rare, parity, its short form, keys and places of every document."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(frequent_shingles(docs, k))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        listed, rank, cut = shared.value
        for batch in batches:
            node, size, keys, places, rare, parity, brief = [], [], [], [], [], [], []
            for _, tokens in shingle_sets(batch.column("text"), k):
                size.append(len(tokens))
                node.append(set_hash(tokens))
                own, place, n_rare = signatures(tokens, listed, rank, cut, num, den) if len(tokens) else (tokens, np.zeros(0, np.int64), 0)
                keys.append(own.view(np.int64))
                places.append(place)
                rare.append(n_rare)
                bitmap = parities(tokens)
                parity.append(bitmap.tobytes())
                brief.append(fold(bitmap, BRIEF).view(np.int64))
            short = np.array(brief, np.int64).reshape(-1, BRIEF)
            offs = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            flat, at = (np.concatenate(x).astype(t) if x else np.zeros(0, t) for x, t in ((keys, np.int64), (places, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(rare, pa.int64()), pa.array(parity, pa.binary()), *[pa.array(short[:, i]) for i in range(BRIEF)], pa.ListArray.from_arrays(pa.array(offs), pa.array(flat)), pa.ListArray.from_arrays(pa.array(offs), pa.array(at))], ["doc_id", "mark", "node", "n", "rare", "parity", *_BRIEF, "keys", "places"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).mapInArrow(tidy(run), f"doc_id {kind}, mark long, node long, n long, rare long, parity binary, {', '.join(f'{x} long' for x in _BRIEF)}, keys array<bigint>, places array<int>")


def _room(num: int, den: int):
    """Sizes and places leave room for the overlap that linked sets need."""
    overlap = (num + den) * (F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))) >= num * (F.col("n_a") + F.col("n_b"))
    return overlap & (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)


def possible(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose bitmaps allow a link: |A xor B| <= (den - num) / (den + num) * (|A| + |B|) for linked sets."""

    def check(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            least = np.array([apart(x, y) for x, y in zip(batch.column("parity_a").to_pylist(), batch.column("parity_b").to_pylist())], np.int64)
            total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            keep = pa.array(least * (den + num) <= (den - num) * total)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    side = lambda c: reps.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"parity_{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(tidy(check), "a long, b long")


def _same_row():
    """A row of docs is the one with this id, which may be null, and this hash of its text."""
    return (F.xxhash64("text") == F.col("mark__")) & F.col("doc_id").eqNullSafe(F.col("id__"))


def verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets meet the threshold, as a written table; pairs is one too.

    The text of each compared node is fetched once, turned into its set, and sent to the
    hubs b that it is compared with.
    """
    pairs = settle(possible(pairs, reps, num, den), pairs.count())
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = settle(nodes.join(reps.select("node", F.col("doc_id").alias("id__"), F.col("mark").alias("mark__")), "node"), 2 * pairs.count())
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted.hint("shuffle_hash")

    def make(batches):
        for batch in batches:
            sets = [x for _, x in shingle_sets(batch.column("text"), k)]
            own = pa.array([set_hash(x) == node for x, node in zip(sets, batch.column("node").to_pylist())], pa.bool_())  # equal hashes may bring another text
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "n", "tokens"]).filter(own)

    texts = docs.select("doc_id", "text").join(wanted, _same_row()).select("node", "text")
    sets = settle(texts.mapInArrow(tidy(make), "node long, n long, tokens binary").dropDuplicates(["node"]))

    def check(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            good = []
            for x, y in zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist()):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                same = int((large[at] == small).sum())
                good.append(den * same >= num * (len(x) + len(y) - same))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b")), "b")
    return settle(both.select("a", "b", "tokens_a", "tokens_b").mapInArrow(tidy(check), "a long, b long"), pairs.count())


def linked(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The classes of all rows, one row for each node (least id that isn't null), and labels of the nodes that have links."""
    base = settle(classes(docs, k, num, den))
    first = Window.partitionBy("node").orderBy(F.asc_nulls_last("doc_id"), "mark")
    reps = base.where(F.col("node").isNotNull()).withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    reps = settle(reps)
    postings = reps.select("node", "n", "rare", F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("at"))).alias("post")).select("post.key", "node", "n", "rare", "post.at")
    shared = postings.groupBy("key").agg(F.count("*").alias("held")).where("held > 1").select("key")
    held = settle(postings.join(shared, "key"))
    order = F.shiftleft("rare", 40).bitwiseOR(F.col("node").bitwiseAND((1 << 40) - 1))
    lists = held.groupBy("key").agg(*(F.min_by(x, order).alias(y) for x, y in (("node", "hub"), ("n", "n_b"), ("at", "at_b"))))
    room = _room(num, den)
    with_hub = settle(held.join(lists, "key").where("node <> hub").withColumnsRenamed({"node": "a", "n": "n_a", "at": "at_a", "hub": "b"}).where(room).select("a", "b").distinct(), held.count())
    links = verify(with_hub, reps, docs, k, num, den)
    labels = components(links)
    # classes that share a list and are not joined up yet
    marked = settle(held.join(labels, "node", "left").join(reps.select("node", *_BRIEF), "node").select("key", "node", "n", "at", *_BRIEF, F.coalesce("label", "node").alias("label")))
    mixed = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    open_ = marked.join(mixed, "key")
    side = lambda c: open_.select("key", F.col("node").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "at", "label", *_BRIEF)))
    differ = sum(F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in _BRIEF)
    close = differ * (den + num) <= (den - num) * (F.col("n_a") + F.col("n_b"))
    rest = side("a").join(side("b"), "key").where((F.col("label_a") < F.col("label_b")) & room & close).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    rest = settle(rest.join(with_hub, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = links.unionByName(verify(rest, reps, docs, k, num, den))
        labels = components(links)
    return base, reps, labels


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for every document; linked when den * intersection >= num * union."""
    base, reps, labels = linked(docs, k, num, den)
    own = base.select("doc_id", "node", F.col("n").alias("n_shingles"))
    rows = settle(join_spread(own, labels, "node").withColumn("label", F.coalesce("label", "node")))
    least = reps.select("node", "doc_id").join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("doc_id").alias("least"))
    return join_spread(rows, least, "label").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component (the least id; null ids last), all columns; rows without words all stay."""
    base, reps, labels = linked(docs, k, num, den)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id__"), F.col("mark").alias("mark__"))
    chosen = reps.join(labels, "node", "left").groupBy(F.coalesce("label", "node")).agg(F.min(rank).alias("first")).select("first.id__", "first.mark__", F.lit(False).alias("alone__"))
    wordless = base.where(F.col("node").isNull()).select(F.col("doc_id").alias("id__"), F.col("mark").alias("mark__"), F.lit(True).alias("alone__")).distinct()
    kept = docs.join(settle(chosen.unionByName(wordless)), _same_row())
    kept = kept.withColumn("own__", F.when(F.col("alone__"), F.monotonically_increasing_id()))
    same = Window.partitionBy("id__", "mark__", "own__").orderBy("text")
    return kept.withColumn("place__", F.row_number().over(same)).where("place__ = 1").select(*docs.columns)
