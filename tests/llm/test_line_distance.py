"""Banded bit-parallel edit distance and parities against plain versions."""

import random

import pytest

pytest.importorskip("tallywood.llm")
from pyspark.sql import functions as F

from tallywood.llm import linededup


def test_within_against_levenshtein(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abé") for _ in range(n))
    pairs = [(word(rng.randint(0, 12)), word(rng.randint(0, 12))) for _ in range(150)]
    for _ in range(150):
        a = word(rng.randint(1, 60))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "x"])
        pairs.append((a, "".join(b)))
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    for edits in (1, 2, 4):
        want = {r.i for r in rows.where(F.levenshtein("a", "b") <= edits).collect()}
        assert {r.i for r in linededup.within(rows, "a", "b", edits).collect()} == want


def test_parities(spark):
    lines = ["", "ee t", "007 agents, 2 of 2", "ÉTÉ été", None, "e" * 4001]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", linededup.parities(F.col("line")).alias("odd")).collect()
    assert [r.odd for r in got] == [None if x is None else sum((x.count(c) & 1) << k for k, c in enumerate(linededup.LETTERS)) for x in lines]


def test_only_lines_that_share_a_key_are_looked_up(spark):
    texts = ["a first line that stands alone in here", "one half of this line | and the other", "one half of this line | and thE other", "short", "quite another line, of no half seen"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = linededup.first_lines(docs, 1, linededup.MIN_CHARS)
    assert "odd" not in lines.columns and "replace(" not in lines._jdf.queryExecution().optimizedPlan().toString()
    entries = linededup.sharing(lines, 1)
    found = linededup.texts_of(docs, entries.select("h1").distinct(), linededup.MIN_CHARS)
    assert {r.line for r in found.collect()} == set(texts[1:3])
    assert linededup.candidate_pairs(entries, found.select("h1", "odd"), 1).count() == 1


def test_what_is_alike_is_not_aligned(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abé漢") for _ in range(n))
    pairs = [("", ""), ("", "a"), ("same", "same"), ("aaaa", "aaa"), ("ab" * 50, "ab" * 51)]
    for _ in range(100):
        head, tail = word(rng.randint(0, 300)), word(rng.randint(0, 300))
        pairs.append((head + word(rng.randint(0, 2)) + tail, head + word(rng.randint(0, 2)) + tail))
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = linededup.differing(rows, "a", "b").withColumns({"whole": F.levenshtein("a", "b"), "rest": F.levenshtein("a__", "b__")}).collect()
    assert len(got) == len(pairs) and all(r.whole == r.rest for r in got)
    assert all(r.a__ in r.a and r.b__ in r.b and len(r.a__) - len(r.b__) == len(r.a) - len(r.b) for r in got)
    assert max(len(r.a__) for r in got) <= 2 + 2 * 10
