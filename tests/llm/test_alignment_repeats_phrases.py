"""Operators 11 to 13 against brute force: awkward rows, hot passages, small blocks and shards."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("tallywood.llm")
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tallywood.llm import alignment, phrases, substrings
from tallywood.llm.queries import ALIGN_A, ALIGN_B, BPE_PATTERN

DOCS = "doc_id long, text string, lang string, key long, mark long, n long, words string, row long, a string, phrase string, shard long"


def frame(spark, rows):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, lang, 7, 7, 7, "x", 7, "x", "x", 7) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 4))) for _ in range(40)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts = [None, "", "  \t\n", "one", "Le chat, l'été!", "▁ mark", "a\x00b", "<|endoftext|> x", "  two  blanks ", "ﬁ ｘ"]
    for k in range(60):
        own = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))
        cut = sorted(rng.sample(range(40), 2))
        own = own.replace(" ", rng.choice([" ", " ", " ", "  ", "\n ", " \t", "\u00a0", " \u2003"]), 3)
        texts.append(own + (" " + " ".join(passage.split(" ")[cut[0] : cut[1]]) + "\n" if k % 3 else ", ") + own[: rng.randint(0, 30)])
    texts += [texts[20], texts[20], "a " * 200, "a " * 90 + "b", " ".join(rng.choice(vocabulary) for _ in range(5000)) + " " + passage]
    out = [(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts)]
    return [*out, (None, passage, "en"), (None, None, None), (30, passage + " " + texts[30], "de"), (30, texts[30], "de"), ((1 << 62) + 5, passage, "en")]


def links_of(a, b):
    """[(a index, b index)] of overlapping tokens, by comparing all pairs."""
    spans = []
    for side in (a, b):
        at, own = 0, []
        for raw in side:
            own.append((at, at + len(raw)))
            at += len(raw)
        spans.append(own)
    return [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (x, y) in enumerate(spans[1]) if s < y and x < e], spans


def brute_alignment(rows):
    a_model = Tokenizer.from_file(ALIGN_A)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=ALIGN_B)
    letters = alignment.byte_letters()
    held, seen = [], Counter()
    for doc, text, _ in rows:
        a = a_model.encode(" " + (text or ""), add_special_tokens=False)
        b = b_model.encode(text or "")
        a_raw = [bytes(letters[c] for c in x) for x in a.tokens]
        b_raw = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b_model.id_to_piece, b)]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_raw) != whole or b"".join(b_raw) != whole:
            held.append((doc, [], [], [], [], ""))
            continue
        links, (sa, sb) = links_of(a_raw, b_raw)
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, (_, e) in zip(ids, spans) if low < e <= end) for ids, spans in ((a.ids, sa), (b, sb))))
            low = end
        pairs = [(a.ids[i], b[j]) for i, j in links]
        seen.update(set(pairs))
        held.append((doc, a.ids, b, ends, pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (i, _), n in seen.items():
        best[i] = max(best[i], n)
    return [(doc, len(a), len(b), len(ends), len(pairs), sum(seen[p] == best[p[0]] for p in pairs), sum(seen[p] for p in pairs), digest) for doc, a, b, ends, pairs, digest in held]


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
order = lambda rows: sorted(rows, key=str)


def test_alignment_against_brute_force(spark, rows, monkeypatch):
    short = [(i, t and t[:600], lang) for i, t, lang in rows]
    expected = brute_alignment(short)
    docs = frame(spark, short).repartition(3)
    got = alignment.align(docs, ALIGN_A, ALIGN_B, BPE_PATTERN)
    assert got.columns == NAMES and order(map(tuple, got.collect())) == order(expected)
    files = (ALIGN_A, ALIGN_B, BPE_PATTERN)
    counts = alignment.settle(alignment.pair_counts(docs, *files))
    assert len(alignment.blocks_of(counts, 8)) > 3
    assert order(map(tuple, alignment.with_counts(docs, counts, *files, limit=8).collect())) == order(expected)
    monkeypatch.setattr(alignment, "MAX_STRETCHES", 10)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 200)
    assert order(map(tuple, alignment.align(docs.coalesce(1), *files).collect())) == order(expected)
    assert alignment.align(docs.limit(0), *files).collect() == []


def test_identity_map_is_of_equal_bytes():
    pair = alignment.Pair(ALIGN_A, ALIGN_B, BPE_PATTERN)
    by_bytes = {raw for raw in pair.b_bytes if raw}
    for i, j in enumerate(pair.same.tolist()):
        assert (pair.a_bytes[i] == pair.b_bytes[j]) if j >= 0 else pair.a_bytes[i] not in by_bytes


def brute_repeats(rows, least):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - least + 1) if i is not None else ():
            win = tuple(w[k : k + least])
            first[win] = min(first.get(win, i), i)
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - least + 1) if i is not None else ():
            if first[tuple(w[k : k + least])] < i:
                gone.update(range(k, k + least))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("least,shard", [(13, 50_000), (13, 40), (3, 60), (1, 500)])
def test_repeats_against_brute_force(spark, rows, least, shard):
    docs = frame(spark, rows).repartition(3)
    expected = brute_repeats(rows, least)
    got = substrings.rewritten(docs, substrings.find_repeats(docs, least, shard), True)
    assert order((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()) == order(expected)
    assert {r.words for r in got.collect()} == {"x"} and set(got.columns) == {*docs.columns, "n_words", "n_removed"}
    if least == 13 and shard > 40:
        digests = substrings.repeats(docs)
        assert order(map(tuple, digests.collect())) == order((i, n, r, hashlib.sha256(t.encode()).hexdigest()) for i, n, r, t in expected)
        assert substrings.drop_repeats(docs.limit(0)).collect() == []


def test_automaton_finds_first_owners():
    rng = random.Random(3)
    for least in (1, 2, 4):
        automaton, texts = substrings.SuffixAutomaton(), [[rng.randint(0, 2) for _ in range(rng.randint(0, 30))] for _ in range(12)]
        for owner, text in enumerate(texts):
            automaton.add(text, owner)
        for _ in range(20):
            query = [rng.randint(0, 3) for _ in range(30)]
            for k, state in enumerate(automaton.matches(query, least)):
                win = query[k + 1 - least : k + 1] if k + 1 >= least else None
                owners = [o for o, t in enumerate(texts) if win and any(t[j : j + least] == win for j in range(len(t) - least + 1))]
                assert (automaton.first[state] if state >= 0 else None) == (min(owners) if owners else None)


def brute_collocations(rows, least, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        low = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        longer = Counter()
        for p, n in candidates.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    if j - i < len(p):
                        longer[p[i:j]] = max(longer[p[i:j]], n)
        kept = []
        for p, a in candidates.items():
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if 100 * longer[p] < 50 * a:
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, totals[lang], -score))
    return out


@pytest.mark.parametrize("least,longest,share", [(3, 3, 1 / 8), (2, 4, 1 / 2), (3, 3, 0.0), (4, 3, 1.0), (2, 2, 1 / 8)])
def test_collocations_against_brute_force(spark, rows, monkeypatch, least, longest, share):
    """Whatever the sample proposes, also nothing or everything, the counts are the same."""
    monkeypatch.setattr(phrases, "frequent_phrases", lambda d, m, n, f=phrases.frequent_phrases: f(d, m, n, share))
    docs = frame(spark, rows).repartition(3)
    for top in (2000, 7):
        got = phrases.collocations(docs, least, longest, top)
        assert order(map(tuple, got.collect())) == order(brute_collocations(rows, least, longest, top))
    assert phrases.collocations(docs.limit(0)).collect() == []


def test_a_full_filter_changes_nothing(spark, rows, monkeypatch):
    """The bit table may hold anything by chance: its members' borders are counted and the result stays."""
    table = phrases.bit_table
    monkeypatch.setattr(phrases, "bit_table", lambda x: table(x) | 0xFFFF0000FFFFFFFF)
    got = phrases.collocations(frame(spark, rows), 3)
    assert order(map(tuple, got.collect())) == order(brute_collocations(rows, 3, 3, 2000))


def test_large_counts_stay_exact(spark):
    """Products pass 64 bits."""
    a, left, right = 3_000_000_019, 4_000_000_007, 5_000_000_029
    found = spark.createDataFrame([("en", 0, "", 1 << 40), ("en", 1, "x", left), ("en", 1, "y", right), ("en", 2, "x y", a)], "lang string, size int, phrase string, n long")
    was = phrases.frequent_phrases
    phrases.frequent_phrases = lambda *_: found
    try:
        assert [tuple(r) for r in phrases.collocations(found).collect()] == [("en", 1, "x y", a, left, right, 1 << 40, 1_000_000 * a * a // (left * right))]
    finally:
        phrases.frequent_phrases = was


def test_token_files_are_not_in_the_repository():
    assert os.path.dirname(ALIGN_A) == os.path.dirname(public_tokenizers.path("x"))
