"""Corpus preparation in stages: quality, repeated lines, near duplicates, benchmark passages, token ids.

Each stage is (name, function of (spark, docs, sf_dir)); it works on all rows that the stage
before it kept. All but the last return the columns of documents; other columns are passed over.
Null and repeated ids are rows like others in every stage; an empty table gives an empty one;
texts of any length are taken whole.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywood.llm import bytepair, decontaminate, jaccard, linededup, quality
from tallywood.llm.common import load, shared_folder
from tallywood.llm.queries import BPE_FILE, BPE_PATTERN

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A null text is scored as an empty one; without labels of both kinds all rows get the share of label 1."""
    return quality.keep_quality(docs.select(*COLUMNS), load(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; a document that consists of them goes too. Null texts and empty ones stay; n_chars is that of the new text."""
    out = linededup.dedup_lines(docs.select(*COLUMNS), drop_empty=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the least id: five-word shingles, similarity of 0.8 or more. Texts without words all stay; rows of one id with different texts are judged by their texts."""
    return jaccard.keep_first(docs.select(*COLUMNS), k=5, num=80, den=100)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: half of its words in tiles of five or more, in any order. Without benchmark rows all stay."""
    return decontaminate.keep_clean(docs.select(*COLUMNS), load(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded bytes; a null text has none and the digests of nothing."""
    return bytepair.round_trip(docs, BPE_FILE, BPE_PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_copies),
    ("byte_bpe", encode),
]

#: Quality scores, tilings and byte-pair merges can't be told in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
