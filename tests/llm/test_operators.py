"""The training-data operators: brute force, exact round trips, held-out accuracy, awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("tallywood.llm")
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tallywood.llm import bytepair, classlm, decontaminate, jaccard, langid, linededup, media, quality, toxicity, urlrules
from tallywood.llm.common import hot_keys, settle
from tallywood.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, line string"


def frame(spark, texts):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, "x") for i, t in enumerate(texts)], DOCS)


def vocabulary(rng, n=60):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n)]


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(5)
    words = vocabulary(rng)
    base = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(12)]
    near = [b.split(" ") for b in base[:4]]
    for w in near:
        w[40] = "changed"
    long = "\n".join(" ".join(rng.choice(words) for _ in range(12)) for _ in range(300))
    return [None, "", " \t\n", "one", "one two", "one two", *base, base[0], *map(" ".join, near), long, "ÄÖ ñ 漢字 😀", base[1] + "\n" + base[2]]


def labels(spark, n):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(n)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_jaccard_against_brute_force(spark, awkward):
    for k, num in ((3, 90), (5, 80), (3, 50)):
        sets = {}
        for i, t in enumerate(awkward):
            w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        label = {i: i for i in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                        label[a] = label[b] = min(label[a], label[b])
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.near_duplicates(frame(spark, awkward), k, num, 100).collect()}
        assert got == {i: (len(s), label[i]) for i, s in sets.items()}


def test_jaccard_prefixes_with_frequent_shingles_lose_no_link():
    rng = np.random.default_rng(1)
    pool = np.sort(rng.integers(1, 1 << 62, 900).astype(np.uint64))
    listed, rank = pool[:400], rng.permutation(400)
    for _ in range(150):
        a = np.unique(rng.choice(pool, rng.integers(3, 300)))
        b = np.unique(np.concatenate([rng.choice(a, max(1, int(len(a) * 0.96)), replace=False), rng.choice(pool, rng.integers(0, 1 + len(a) // 20))]))
        same = len(np.intersect1d(a, b))
        if 100 * same >= 90 * (len(a) + len(b) - same) and not np.array_equal(a, b):
            (ka, pa_, _), (kb, pb, _) = (jaccard.signatures(x, listed, rank, 150, 90, 100) for x in (a, b))
            need = 90 * (len(a) + len(b))
            assert any(190 * min(len(a) - pa_[i], len(b) - pb[j]) >= need for i in range(len(ka)) for j in np.flatnonzero(kb == ka[i]))


def test_line_dedup_against_brute_force(spark, awkward):
    texts = [*awkward, "a line that is long enough to count\nshort\nshort\n\n \n\nshorx", "other short\nshort", "a line that is long enough to coun", "x line that is long enough to count\nother"]

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    seen, want = [], {}
    for i, t in enumerate(texts):
        if t is None:
            want[i] = None
            continue
        kept = []
        for line in t.split("\n"):
            if line.strip():
                if line in seen or (len(line) >= 20 and any(len(x) >= 20 and near(line, x) for x in seen)):
                    continue
                seen.append(line)
            kept.append(line)
        want[i] = "\n".join(kept)
    # a line near an earlier one goes even if that one went: no chains are planted here
    assert {x.doc_id: x.text for x in linededup.dedup_lines(frame(spark, texts)).collect()} == want
    clash = frame(spark, texts).withColumn("n_lines", F.lit("x"))
    assert linededup.dedup_lines(clash).columns.count("n_lines") == 1
    kept = {x.doc_id: x.text for x in linededup.dedup_lines(frame(spark, texts), drop_empty=True).collect()}
    assert kept == {i: t for i, t in want.items() if t == texts[i] or (t or "").strip()}


def test_bit_parallel_distance_against_the_table(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        a = [rng.choice("abcdé漢") for _ in range(rng.choice([1, 2, 5, 12, 40, 90]))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            k, kind = rng.randrange(len(b) + 1), rng.randrange(3)
            b[k : k + (kind > 0)] = [rng.choice("abc漢")] if kind < 2 else []
        rows.append((i, "".join(a), "".join(b)))
    pairs = spark.createDataFrame(rows, "i int, x string, y string").where("y <> ''")
    for edits in (1, 2, 4):
        want = {r.i for r in pairs.where(F.levenshtein("x", "y") <= edits).collect()}
        assert {r.i for r in linededup.within(pairs, "x", "y", edits).collect()} == want


def test_tiling_finds_reordered_passages(spark, awkward):
    item = " ".join(f"w{i}" for i in range(20))
    words = item.split()
    texts = [*awkward, "before " + " ".join(words[10:] + ["gap"] + words[:10]).upper() + " after", " ".join(words[:8])]
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.coverage, x.n_tiles) for x in decontaminate.contaminated(frame(spark, texts), bench).collect()}
    assert got == {(len(awkward), 1): (1.0, 2), (4, 4): (1.0, 1), (5, 4): (1.0, 1)}
    assert decontaminate.keep_clean(frame(spark, texts), bench).count() == len(texts) - 3
    assert decontaminate.contaminated(frame(spark, texts), bench.limit(0)).count() == 0


def test_byte_pairs_equal_the_library(spark, awkward):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bytepair.read_ranks(path), special_tokens={})
    rng = random.Random(2)
    texts = [*awkward, "a" * 3000, " " * 500 + "x", "=-" * 400, *("".join(rng.choice(["a", "The", " the", " ", "\n", "é", "漢", "😀", "12", "'s", "!!", "\xa0", "\t"]) for _ in range(30)) for _ in range(200))]
    got = {x.doc_id: x for x in bytepair.round_trip(frame(spark, texts), path, pattern).collect()}
    for i, t in enumerate(texts):
        ids = own.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest() and got[i].n_chars_decoded == len(t or "")


def test_utf8_machine_in_pieces():
    rng = random.Random(3)
    for _ in range(3000):
        raw = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0xFF, 0xE2, 0x82, 0xAC]) for _ in range(rng.randint(0, 9)))
        machine, cut = bytepair.Utf8Machine(), rng.randint(0, len(raw))
        assert machine.feed(raw[:cut]) + machine.feed(raw[cut:]) + machine.close() == raw.decode("utf-8", "replace")


def test_media_round_trip(spark, awkward):
    for x in media.text_media(frame(spark, awkward)).collect():
        raw = (awkward[x.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    image = np.random.default_rng(0).integers(0, 256, (12, 18, 3)).astype(np.uint8)
    for form in (media.encode_netpbm, media.encode_bmp):
        assert np.array_equal(media.decode(form(image)), image)
    assert np.allclose(media.area_resize(image, 4, 6), image.reshape(4, 3, 6, 3, 3).mean(axis=(1, 3)))
    assert media.decode(b"P6\n9 9\n255\nxx") is None and media.decode(None) is None


def test_url_rules(spark):
    urls = ["http://a.com", "http://A.com/x?q", "https://m.example.com/en/1", "https://www.example.com/en/1#t", "x://b.net/es/", "ftp://q.org/", None, "nothing", "://h.com/"]
    rows = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urlrules.filter_urls(spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")).collect()}
    assert rows[0] == ("a.com", "", None, "allow") and rows[1][:3] == ("a.com", "/x", "com/")
    assert rows[2][2:] == ("example.com/en/", "block") and rows[3][2:] == ("www.example.com/en/", "allow") and rows[4][2:] == ("net/es/", "block")
    assert rows[6] == ("", "", None, "allow") == rows[7] and rows[8][:3] == ("h.com", "/", "com/")


def test_class_model_base_and_mass(spark, awkward):
    got = {x.doc_id: x for x in classlm.score_texts(frame(spark, awkward)).collect()}
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) + [None] for i, t in enumerate(awkward)}
    c = Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
    total, kinds = sum(c.values()), len(c)
    for i, w in tokens.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(c[x] > 0 for x in w), total)
        assert math.isclose(got[i].base_score, sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w), abs_tol=1e-5)
        assert got[i].score <= 0


def test_language_models_tell_languages(spark):
    rng = random.Random(4)
    make = {"xx": "abcde", "yy": "vwxyzé"}
    rows = [(i, " ".join("".join(rng.choice(make[g]) for _ in range(5)) for _ in range(30)), g) for i in range(120) for g in [("xx", "yy")[i % 2]]]
    rows += [(900, None, "xx"), (901, "123 !!", "yy"), (None, "abc", None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    for x, (i, t, g) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0]))):
        assert x.lang_pred == ("und" if t is None or not any(c.isalpha() for c in t) else (g or "xx")) and 0 <= x.score <= 1


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_classifiers_on_awkward_rows(spark, awkward, score):
    out = score(frame(spark, awkward), labels(spark, len(awkward))).collect()
    assert len(out) == len(awkward) and all(0 <= x.score <= 1 for x in out)
    assert [x.held_out for x in sorted(out, key=lambda r: r.doc_id)] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(awkward))]
    none = score(frame(spark, awkward), labels(spark, 3).limit(0)).collect()
    assert len(none) == len(awkward) and score(frame(spark, awkward).limit(0), labels(spark, 3)).count() == 0


@pytest.mark.parametrize("run", [lambda d: jaccard.near_duplicates(d), lambda d: linededup.dedup_lines(d), lambda d: classlm.score_texts(d), lambda d: langid.identify(d), lambda d: media.text_media(d)])
def test_empty_tables(spark, run):
    assert run(frame(spark, ["a"]).limit(0)).count() == 0


def test_jaccard_bitmaps_never_tell_more_than_the_difference():
    rng = np.random.default_rng(5)
    pool = rng.integers(1, 1 << 62, 9000).astype(np.uint64)
    for n, m in ((1, 0), (3, 2), (1025, 900), (5000, 700), (8000, 8000), (1024, 4097)):
        a, b = (np.unique(rng.choice(pool, x)) for x in (n, m))
        x, y = jaccard.parities(a), jaccard.parities(b)
        true = len(np.setxor1d(a, b))
        assert jaccard.apart(x.tobytes(), y.tobytes()) <= true
        assert int(np.bitwise_count(jaccard.fold(x, 2) ^ jaccard.fold(y, 2)).sum()) <= true
        assert jaccard.apart(x.tobytes(), x.tobytes()) == 0


def test_toxicity_keeps_labels_with_their_texts():
    rng = random.Random(8)
    good, bad = vocabulary(rng, 40), ["".join(rng.choice("klmnopqrst") for _ in range(6)) for _ in range(10)]
    texts, marks = [], []
    for i in range(120):
        toxic = rng.random() < 0.5
        texts.append(" ".join([*(rng.choice(good) for _ in range(20)), *([rng.choice(bad)] * 2 if toxic else [])]))
        marks.append(float(toxic))
        if i % 5 == 0:
            texts += [None, "", "", "x"]
            marks += [0.0] * 4
    column = pa.array(texts, pa.string())
    assert [len(r.size) for r in toxicity._training_rows(column)] == [int(bool(t)) + (len((t or "").split()) > 32) for t in texts]
    scores = toxicity.Network().fit(column, np.array(marks)).scores(column)
    full = np.array([bool(t) and len(t) > 1 for t in texts])
    assert ((scores >= 0.5) == np.array(marks))[full].mean() > 0.95


def test_toxicity_trains_on_every_window():
    texts = ["w " * 16 * 300, "one two", "", "v " * 40]
    rows = toxicity._training_rows(pa.array(texts))
    assert [len(r.size) for r in rows] == [299, 1, 0, 2]
    covered = np.zeros(4800, bool)
    for a, n in zip(rows[0].begin, rows[0].size):
        covered[a : a + n] = True
    assert covered.all()
    _, where, begin, size, owner = toxicity._join([rows[0], rows[3]])
    assert begin.tolist()[-2:] == [4800, 4816] and size.tolist()[-2:] == [32, 24] and owner.tolist() == [0] * 299 + [1] * 2
    assert set(where[:4800].tolist()) != set(where[4800:].tolist())


def test_jaccard_with_null_and_repeated_ids(spark):
    rng = random.Random(6)
    words = vocabulary(rng, 400)
    one, two, three, four = (" ".join(rng.choice(words) for _ in range(80)) for _ in range(4))
    near = lambda t: t + " end"
    rows = [(None, one), (4, one), (5, one), (6, near(one)), (None, two), (None, near(two)), (7, three), (7, four), (None, ""), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 7, "x") for i, t in rows], DOCS)
    got = sorted(((x.doc_id, x.component_id) for x in jaccard.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (5, 4), (6, 4), *[(None, None)] * 4, (7, 7), (7, 7), (8, 8)], key=str)
    kept = sorted(((x.doc_id, x.text) for x in jaccard.keep_first(docs).collect()), key=str)
    pair = next(x for x in kept if x[1] in (two, near(two)))
    assert kept == sorted([(4, one), pair, (7, three), (7, four), (None, ""), (None, None), (8, "")], key=str)


def test_small_tables_between_steps_go_to_few_files(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = settle(spark.range(600).selectExpr("id * 3 % 700 as a", "id * 7 % 900 as b"), 600)
        labels = components(edges)
        assert len(edges.inputFiles()) == 1 and len(labels.inputFiles()) == 1
        assert len(hot_keys(spark.range(9000).selectExpr("id % 30 as key"), "key").inputFiles()) == 1
        assert settle(spark.range(5).selectExpr("id % 5 as a").distinct(), 5).count() == 5
        assert len(settle(spark.range(0, 4000, 1, 12), (1 << 16) * 8 + 1).inputFiles()) == 12
        links, label = {(x.a, x.b) for x in edges.collect()}, {x.node: x.label for x in labels.collect()}
        assert all(label[a] == label[b] <= min(a, b) for a, b in links if a != b)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_every_word_is_exchanged_by_itself(spark, monkeypatch):
    rng = random.Random(12)
    monkeypatch.setattr(classlm, "LISTED", 14)  # the others are far more
    heads = ["red", "blue", "one", "two"]
    tails = {g: [f"{rng.randrange(10**6)}{g}ing" for _ in range(16)] for g in "xy"}
    texts = []
    for _ in range(80):
        w = []
        for _ in range(25):
            g = rng.choice("xy")
            w += [heads["xy".index(g)], rng.choice(tails[g]), *([rng.choice(tails[g])] if rng.random() < 0.2 else []), heads[2 + "xy".index(g)]]
        texts.append(" ".join(w))
    docs = frame(spark, [*texts, None, "", "never seen words"])
    docs = docs.unionByName(docs.where("doc_id = 3"))
    model, others = classlm.fit(docs)
    rows = classlm.split(docs, "doc_id").select("row", "doc_id", "text", "train").distinct().collect()
    outside = {x.row: x for x in others.collect()}
    place = {int(h): i for i, h in enumerate(model.vocabulary.hashes)}
    table, cls_of, tokens, lines = np.zeros_like(model.table), {}, Counter(), {}
    for x in rows:
        piece = next(classlm.pieces(pa.array([x.text])))
        rest = iter(outside[x.row].cls if x.row in outside else b"")
        line = []
        for word, h in zip(x.text.lower().split(), classlm.words(piece).hashes.tolist()):
            line.append(int(model.classes[place[h]]) if h in place else next(rest))
            assert cls_of.setdefault(word, line[-1]) == line[-1] or h not in place and word in ("never", "seen", "words")
        assert next(rest, None) is None
        lines[x.doc_id] = line
        times = (1 + (x.doc_id == 3)) * x.train
        for a, b in zip([0, *line], [*line, 0]):
            table[a, b] += times
        for word in [*x.text.lower().split(), None]:
            tokens[word] += times
    assert (table == model.table).all() and table.sum() == model.tokens == sum(tokens.values())
    assert classlm.likelihood(model.table) > classlm.likelihood(model.start)
    seen = [{cls_of[w] for w in tails[g] if tokens[w] > 2} for g in "xy"]
    assert not seen[0] & seen[1]  # all of them end alike
    kinds = Counter(cls_of[w] for w in tokens if w is not None and tokens[w])
    assert model.kinds == sum(n > 0 for n in tokens.values())
    total, n = table.sum(axis=0), 0
    share = (total + 1) / (total.sum() + classlm.CLASSES)
    for x in classlm.score_texts(docs).collect():
        text = next(r.text for r in rows if r.doc_id == x.doc_id)
        line, want = [*lines[x.doc_id], 0], 0.0
        for a, b, word in zip([0, *line], line, [*text.lower().split(), None]):
            want += math.log10((table[a, b] + classlm.STRENGTH * share[b]) / (table[a].sum() + classlm.STRENGTH))
            want += math.log10((tokens[word] + classlm.DELTA) / (total[b] + classlm.DELTA * (kinds[b] + 1))) if b else 0.0
        assert math.isclose(x.score, want, abs_tol=1e-5), (x.doc_id, x.score, want)
        assert x.n_known == sum(tokens[w] > 0 for w in [*text.lower().split(), None])
        n += 1
    assert n == 84
