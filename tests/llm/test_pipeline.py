"""The pipeline end to end on a small made corpus, each effect told apart."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("tallywood.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
import public_tokenizers
import tiktoken

from tallywood.llm import bytepair

DOCS = "doc_id long, text string, lang string, source string, n_chars long, place__ string"


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    good = [prose(rng, words, 90) for _ in range(60)]
    bad = ["#$ %% 99 !! " * 30 + str(i) for i in range(30)]
    item = prose(rng, words, 24)
    parts = item.split(" ")
    line = prose(rng, words, 12)
    rows = [(i, t) for i, t in enumerate(good)] + [(100 + i, t) for i, t in enumerate(bad)]
    rows += [(200, good[0]), (201, good[1] + " end"), (202, good[2] + " " + " ".join(parts[12:] + parts[:12])), (203, line + "\n" + good[3][::-1]), (204, line + "\n" + prose(rng, words, 80)), (205, prose(rng, words, 70) + "\n" + line), (None, None), (206, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], DOCS)
    folder = tmp_path_factory.mktemp("corpus")
    docs.write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i is not None and i < 200], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    return str(folder), dict(rows), line


def test_stages_take_effect_one_after_the_other(spark, corpus):
    folder, texts, line = corpus
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == corpus_pipeline.COLUMNS
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = set(range(60)) - {2}
    assert clean <= set(kept["quality"]) and not set(kept["quality"]) & set(range(100, 130))
    lines = kept["line_dedup"]
    assert lines[203].startswith(line) and line not in lines[204] and line not in lines[205] and 200 not in lines
    near = kept["near_duplicates"]
    assert 1 in near and 201 not in near and {204, 205, 202} <= set(near)
    assert 202 not in kept["decontamination"] and clean <= set(kept["decontamination"])
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytepair.read_ranks(path), special_tokens={})
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == set(kept["decontamination"])
    for r in got:
        ids = own.encode_ordinary(kept["decontamination"][r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_on_an_empty_table(spark, corpus):
    folder, _, _ = corpus
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
