"""Line dedup by a segment-partition edit join, in DataFrame functions alone.

A line is what stands between newlines. Of equal lines, and of lines of MIN_CHARS characters
or more within MAX_EDITS edits, the first in the corpus (by document id, then place) stays; a line
goes when an earlier line is near it, whether or not that one stays itself. Shorter lines go
only where they are repeated exactly (one edit would make any two short words the same), and
lines of whitespace alone are separators and stay.

Each distinct line is split into MAX_EDITS + 1 even segments; two lines within that many
edits share one segment at a place that the lengths and the segment's number allow. So
every line is indexed under (length, segment number, segment), and probes the indexes of
its own and of the smaller lengths with the substrings at those places (multi-match-aware
selection). A pair that shares a key must also agree in its letter and digit parities but for two
for each edit; keys held by many lines are split by parts of those parities, one of which
must be equal, so a frequent segment doesn't bring all its lines together. What remains is
verified by bit-parallel edit distance: a column of the alignment is a word of vertical
differences, of which only the band of the threshold is kept, and one character more of the
other line is a handful of word operations. What both lines begin and end with is taken off before.

Texts move only once more, to take up the places that are dropped: distinct lines travel
as hashes and keys. Only lines that share a key with another are looked up by hash; their parities
are counted then, and not before, since counting letters costs several times what the keys do.

Defined cases: a null text stays null; an empty text is one empty line; repeated lines
within a text are repeats too; rows with the same id are one document, whose lines are
those of all its rows; a null id is a document like others and comes first; a document all of whose lines go
keeps an empty text, or is dropped with drop_empty; an empty table gives an empty one; very long texts are
cut into lines like others; columns named n_lines and n_dropped are replaced by those of this
operator, all others are kept. Line identity is by one 64-bit hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

MAX_EDITS = 1
MIN_CHARS = 20
HOT_KEY = 256
OVER = 1 << 20
BROADCAST_LINES = 500_000
HALVES = 18
LETTERS = "etanoisrhdlu0123456789"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def segments(length: Column, parts: int, i: int) -> tuple[Column, Column]:
    """1-based start and length of segment i (from 0) of an even partition; later segments take the remainder."""
    base, extra = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    plain = parts - extra  # so many segments have the smaller length
    start = F.lit(i) * base + F.greatest(F.lit(i) - plain, F.lit(0)) + 1
    return start.cast("int"), (base + F.when(F.lit(i) >= plain, 1).otherwise(0)).cast("int")


def line_keys(line: Column, length: Column, edits: int) -> list[tuple[Column, bool]]:
    """(key, is it in the index) for all index entries and probes of a line."""
    parts, out = edits + 1, []
    for delta in range(edits + 1):
        size = length - delta
        for i in range(parts):
            start, span = segments(size, parts, i)
            low, high = max(-i, delta - (edits - i)), min(i, delta + (edits - i))
            for shift in range(low, high + 1):
                key = F.xxhash64(size, F.lit(i), F.substring(line, start + shift, span))
                inside = (start + shift >= 1) & (start + shift + span - 1 <= length) & (span >= 1)
                out.append((F.when(inside, key), delta == 0 and shift == 0))
    return out


def parities(line: Column) -> Column:
    """One bit for each letter: is its count odd. Digits are looked for only in lines that have one."""
    bit = lambda k: F.shiftleft((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(LETTERS[k]), F.lit("")))).bitwiseAND(F.lit(1)), k)  # noqa: E731  each is one byte
    some = lambda places: reduce(lambda a, b: a.bitwiseOR(b), [bit(k) for k in places])
    first = LETTERS.index("0")
    return some(range(first)).bitwiseOR(F.when(line.rlike("[0-9]"), some(range(first, len(LETTERS)))).otherwise(0))


def occurrences(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """doc_id, place, line, h1 of the distinct lines of each text that aren't whitespace alone."""
    found = docs.where(F.col("text").isNotNull()).select("doc_id", F.posexplode(F.array_distinct(lines_of(F.col("text")))).alias("place", "line"))
    return found.where((F.length("line") >= min_chars) & counts(F.col("line"))).withColumn("h1", F.xxhash64("line"))


def counts(line: Column) -> Column:
    """Is a line more than whitespace."""
    return line.rlike(r"\S")


def first_lines(docs: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """Each distinct line by hash: first document and place, length, keys k0, k1, ..."""
    rows = occurrences(docs).withColumn("size", F.length("line"))
    keys = line_keys(F.col("line"), F.col("size"), edits)
    long = F.col("size") >= min_chars
    rows = rows.select("h1", "doc_id", "place", "size", *[F.when(long, k).alias(f"k{i}") for i, (k, _) in enumerate(keys)])
    none = F.col("doc_id").isNull()  # a null id comes first
    found = rows.groupBy("h1").agg(F.bool_or(none).alias("none"), F.min("doc_id").alias("low"), F.min_by("place", "doc_id").alias("at"), F.min(F.when(none, F.col("place"))).alias("none_at"), F.min("size").alias("size"), *[F.min(f"k{i}").alias(f"k{i}") for i in range(len(keys))])
    return found.withColumns({"doc_id": F.when(~F.col("none"), F.col("low")), "place": F.when(F.col("none"), F.col("none_at")).otherwise(F.col("at"))}).drop("none", "low", "at", "none_at")


def sharing(lines: DataFrame, edits: int) -> DataFrame:
    """h1, doc_id, place, size, key, indexed and held (by how many) of the keys that several lines hold."""
    marks = [indexed for _, indexed in line_keys(F.lit(""), F.lit(0), edits)]
    entries = F.array(*[F.struct(F.col(f"k{i}").alias("key"), F.lit(m).alias("indexed")) for i, m in enumerate(marks)])
    post = lines.select("h1", "doc_id", "place", "size", F.explode(entries).alias("e")).select("h1", "doc_id", "place", "size", "e.key", "e.indexed").where("key is not null")
    shared = settle(post.groupBy("key").agg(F.count("*").alias("held"), F.count_if("indexed").alias("kept")).where("held > 1 and kept > 0").select("key", "held"))
    return post.join(shared, "key")


def texts_of(docs: DataFrame, wanted: DataFrame, min_chars: int) -> DataFrame:
    """h1, line, odd (its parities) of the wanted lines."""
    small = wanted.count() <= BROADCAST_LINES
    found = occurrences(docs, min_chars).select("h1", "line").join(F.broadcast(wanted) if small else wanted, "h1")
    return found.groupBy("h1").agg(F.min("line").alias("line")).withColumn("odd", parities(F.col("line")))


def candidate_pairs(entries: DataFrame, odd: DataFrame, edits: int) -> DataFrame:
    """later, earlier (h1) of lines that share a key and agree in their parities."""
    parts = 2 * edits + 1
    width = -(-len(LETTERS) // parts)
    part = lambda k: F.shiftright("odd", k * width).bitwiseAND((1 << width) - 1) + k * (1 << width)
    held = entries.join(odd, "h1").withColumn("part", F.explode(F.when(F.col("held") > HOT_KEY, F.array(*[part(k) for k in range(parts)])).otherwise(F.array(F.lit(-1).cast("long")))))
    held = settle(held.drop("held"))
    one = held.select("key", "part", *[F.col(c).alias(f"{c}_a") for c in ("h1", "doc_id", "place", "size", "odd", "indexed")])
    two = held.where("indexed").select("key", "part", *[F.col(c).alias(f"{c}_b") for c in ("h1", "doc_id", "place", "size", "odd")])
    near = (F.col("h1_a") != F.col("h1_b")) & (F.abs(F.col("size_a") - F.col("size_b")) <= edits) & (F.bit_count(F.col("odd_a").bitwiseXOR(F.col("odd_b"))) <= 2 * edits)
    once = (~F.col("indexed_a")) | (F.col("h1_a") < F.col("h1_b"))
    pairs = one.join(two, ["key", "part"]).where(near & once)
    a_later = F.struct("doc_id_a", "place_a", "h1_a") > F.struct("doc_id_b", "place_b", "h1_b")
    return pairs.select(F.when(a_later, F.col("h1_a")).otherwise(F.col("h1_b")).alias("later"), F.when(a_later, F.col("h1_b")).otherwise(F.col("h1_a")).alias("earlier")).distinct()


def near_lines(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """h1 of every line that has an earlier line within ``edits`` edits."""
    both = pairs.join(texts.select(F.col("h1").alias("later"), F.col("line").alias("a")), "later").join(texts.select(F.col("h1").alias("earlier"), F.col("line").alias("b")), "earlier")
    return within(both, "a", "b", edits).select(F.col("later").alias("h1")).distinct()


def shares_pieces(a: Column, b: Column, edits: int) -> Column:
    """Does b hold all but ``edits`` of the even pieces of a: an edit touches one piece at most, so lines within that many edits do."""
    parts = 4 * (edits + 1)
    cut = lambda i: F.floor(i * F.length(a) / parts).cast("int")
    held = [F.when(F.contains(b, F.substring(a, cut(i) + 1, cut(i + 1) - cut(i))), 1).otherwise(0) for i in range(parts)]
    return reduce(lambda x, y: x + y, held) >= parts - edits


def once(value: Column) -> Column:
    """The value, as a row that is generated: a condition on it is not moved to before it, where it would be computed anew for each use."""
    return F.explode(F.array(value))


def differing(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """a__ and b__: what is left of a and b without what they begin and end with alike, which leaves their distance as it is.

    How many characters are alike is found by halves of the shorter length, and may stay some characters short.
    """

    def rest(rows: DataFrame, x: str, y: str) -> DataFrame:
        least = F.least(F.length(x), F.length(y))
        piece = lambda c, n, s: F.substring(F.col(c), n + 1, s)
        alike = F.aggregate(F.array(*[F.shiftright(least, k) for k in range(1, HALVES)]), F.lit(0), lambda n, s: F.when(piece(x, n, s) == piece(y, n, s), n + s).otherwise(n))
        left = lambda c: F.reverse(F.substring(F.col(c), F.col("alike__") + 1, F.length(c)))
        cut = rows.withColumn("alike__", once(alike)).withColumn("rest__", once(F.struct(left(x).alias("a"), left(y).alias("b"))))
        return cut.withColumns({"a__": F.col("rest__.a"), "b__": F.col("rest__.b")}).drop("alike__", "rest__")

    return rest(rest(pairs, a, b), "a__", "b__")  # the second time from the end, which turns them back


def within(pairs: DataFrame, a: str, b: str, edits: int) -> DataFrame:
    """The pairs whose lines (columns a and b) are within ``edits`` edits, by bit-parallel alignment in the band of the threshold.

    Bit k of a word stands for row j - edits + k of the alignment's column j. up and down tell where the distance
    rises and falls to the next row, last is the distance in the band's last row. For each character
    of b: same has a bit for each band row whose character of a is equal; the carries of one addition run
    along matches, which gives the rows that take the diagonal for nothing (flat), and from them the next
    words, shifted by one as the band moves down. Rows behind the end of a match nothing; at the end they
    are taken off again. Once all distances of the band are above the threshold the alignment stands still.
    """
    width = 2 * edits + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    long = lambda x: F.lit(x).cast("long")
    either, both, flip = lambda *w: reduce(lambda x, y: x.bitwiseOR(y), w), lambda x, y: x.bitwiseAND(y), lambda x: F.bitwise_not(x).bitwiseAND(long(full))
    pairs = pairs.where(shares_pieces(F.col(a), F.col(b), edits))
    letters = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    rows = differing(pairs.where(F.abs(F.length(a) - F.length(b)) <= edits), a, b)
    rows = rows.withColumn("a__", once(letters("a__"))).withColumn("b__", once(letters("b__")))

    def let(value: Column, then):
        return F.transform(F.array(value), lambda x: then(x))[0]

    def same(c: Column, j: Column) -> Column:
        hit = lambda k: F.when((j - edits + k >= 0) & (F.get("a__", F.greatest(j - edits + k, F.lit(0))) == c), 1 << k).otherwise(0).cast("long")
        return either(*[hit(k) for k in range(width)])

    def flat(s: Column) -> Column:
        match, up = s["same"], s["up"]
        return both(either((both(match, up) + up).bitwiseXOR(up), match, s["down"]), long(full))

    def words(s: Column) -> Column:
        """flat to the state after the character."""
        right, left = either(s["down"], flip(either(s["flat"], s["up"]))), both(s["flat"], s["up"])
        below = F.shiftright(s["flat"], 1)
        return F.struct(either(left, flip(either(below, right))).alias("up"), both(below, right).alias("down"), (s["last"] + F.when(both(s["flat"], long(top)) == 0, 1).otherwise(0)).alias("last"), (s["j"] + 1).alias("j"))

    def least(s: Column) -> Column:
        """The least distance of the band."""
        bit = lambda word, k: F.shiftright(s[word], k).bitwiseAND(long(1))
        at = [s["last"]]
        for k in range(width - 2, -1, -1):
            at.append(at[-1] - bit("up", k) + bit("down", k))
        return F.least(*at)

    def stopped(s: Column) -> Column:
        """The state, or one far above the threshold where no distance of the band is within it."""
        return F.struct(s["up"].alias("up"), s["down"].alias("down"), F.when(least(s) > edits, long(OVER)).otherwise(s["last"]).alias("last"), s["j"].alias("j"))

    def step(s: Column, c: Column) -> Column:
        keep = lambda x, name, value: F.struct(*[x[n].alias(n) for n in ("up", "down", "last", "j")], value.alias(name))
        return F.when(s["last"] >= OVER, s).otherwise(let(keep(s, "same", same(c, s["j"])), lambda x: let(keep(x, "flat", flat(x)), lambda y: let(words(y), stopped))))

    start = F.struct(long(((1 << (edits + 1)) - 1) << edits).alias("up"), long(0).alias("down"), long(edits).alias("last"), F.lit(0).alias("j"))
    rows = rows.withColumn("end__", once(F.aggregate("b__", start, step)))
    low = F.greatest(F.lit(0), F.least(F.lit(width), F.length(a) - F.length(b) + edits))  # the first bit behind the row wanted
    behind = lambda name: F.bit_count(both(F.col(f"end__.{name}"), long(full >> 1))) - F.bit_count(both(F.col(f"end__.{name}"), F.call_function("shiftleft", long(1), low) - 1))
    return rows.where(F.col("end__.last") - behind("up") + behind("down") <= edits).drop("a__", "b__", "end__")


def dropped_places(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, drop: the lines of each document (as hashes) that occur or come near earlier."""
    lines = settle(first_lines(docs, edits, min_chars))
    entries = settle(sharing(lines, edits))
    texts = settle(texts_of(docs, settle(entries.select("h1").distinct()), min_chars))
    pairs = settle(candidate_pairs(entries, texts.select("h1", "odd"), edits))
    near = settle(near_lines(pairs, texts, edits)).withColumn("near", F.lit(True))
    kept = lines.select("h1", F.col("doc_id").alias("first")).join(near, "h1", "left").select("h1", "first", F.coalesce("near", F.lit(False)).alias("near"))
    rows = occurrences(docs).select("doc_id", "h1").join(kept, "h1")
    return rows.where(F.col("near") | ~F.col("doc_id").eqNullSafe(F.col("first"))).groupBy("doc_id").agg(F.collect_set("h1").alias("drop__"))


def dedup_lines(docs: DataFrame, edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, drop_empty: bool = False) -> DataFrame:
    """All columns of docs with the text rewritten, and n_lines, n_dropped."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    gone = dropped_places(docs, edits, min_chars).withColumnRenamed("doc_id", "id__")
    rows = docs.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id__")), "left").drop("id__")
    every, drop = lines_of(F.col("text")), F.coalesce("drop__", F.array().cast("array<bigint>"))
    mark = lambda x: F.when(counts(x), F.xxhash64(x))
    marks = F.filter(F.transform(every, lambda x: mark(x)), lambda h: h.isNotNull())
    repeated = F.size(F.array_distinct(marks)) != F.size(marks)
    # each line carries its own hash, and separators their place, so that nothing is looked up by line
    entries = F.transform(every, lambda x, i: F.struct(x.alias("line"), mark(x).alias("mark"), F.when(mark(x).isNull(), i).alias("place")))
    once = F.when(repeated, F.array_distinct(entries)).otherwise(entries)
    kept = F.transform(F.filter(once, lambda e: e["mark"].isNull() | ~F.array_contains(drop, e["mark"])), lambda e: e["line"])
    clean = rows.withColumns({"lines__": F.size(every), "kept__": F.when((F.size(drop) == 0) & ~repeated, every).otherwise(kept)})
    none = F.col("text").isNull()
    out = clean.withColumns({"text": F.array_join("kept__", "\n"), "n_lines": F.when(none, 0).otherwise(F.col("lines__")), "n_dropped": F.when(none, 0).otherwise(F.col("lines__") - F.size("kept__"))})
    out = out.select(*names, "n_lines", "n_dropped")
    return out.where((F.col("n_dropped") == 0) | counts(F.col("text"))) if drop_empty else out
