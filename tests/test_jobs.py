"""Bulk jobs: a kill after any chunk, resumed without a duplicate; statuses; numbering."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallywood.operators.numbering import numbered
from tallywood.sources import ingest, jobs


@pytest.fixture
def corpus(tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    for i in range(60):
        text = "the same text" if i % 12 == 5 else f"report {i}\nHemoglobin 9.{i} g/dL"
        (folder / ("sub" if i % 2 else "") / f"{i:03d}.txt").write_text(text)
    (folder / "scan.png").write_bytes(b"\x89PNG")
    (folder / "bad.xyz").write_bytes(b"?")
    (folder / "broken.pdf").write_bytes(b"no pdf")
    return folder


@pytest.mark.parametrize("kill", [(), (0, 3)])
def test_a_killed_job_resumes_without_a_duplicate(spark, corpus, tmp_path, kill):
    job, left, seen = str(tmp_path / "job"), list(kill), []

    def after(number):
        seen.append(number)
        now = {r.status: r["count"] for r in jobs.status(spark, job).groupBy("status").count().collect()}
        assert sum(now.values()) == 63 and now.get("PENDING", 0) == max(0, 63 - 10 * (number + 1))  # readable meanwhile
        if number in left:
            left.remove(number)
            raise RuntimeError("killed")

    for _ in range(len(kill) + 1):
        try:
            counts = {r.status: r.n for r in jobs.run_job(spark, str(corpus), job, "j", chunk_files=10, after_chunk=after).collect()}
        except Exception:
            continue
    assert counts == {"INGESTED": 56, "MISSING": 1, "DUPLICATE": 4, "FAILED": 2}
    entries = jobs.ledger(spark, job)
    assert entries.count() == entries.select("job_id", "ordinal").distinct().count() == 63
    stored = jobs.documents(spark, job)
    assert stored.count() == stored.select("sha256").distinct().count() == 57
    assert {r.duplicate_of is not None for r in entries.where("status = 'DUPLICATE'").collect()} == {True}
    assert sorted(set(seen)) == list(range(7))
    again = {r.status: r.n for r in jobs.run_job(spark, str(corpus), job, "j", chunk_files=10).collect()}
    assert again == counts  # nothing is left to do


def test_parsing_keeps_its_statuses(spark, corpus):
    files = ingest.discover(spark, str(corpus)).withColumn("case_id", F.lit("k"))
    parsed = ingest.parse_files(files)
    count = lambda df: {r.status: r["count"] for r in df.groupBy("status").count().collect()}
    assert count(ingest.raw_text(parsed)) == count(parsed) == {"INGESTED": 56, "MISSING": 1, "DUPLICATE": 4, "FAILED": 2}
    assert count(ingest.stored_texts(parsed)) == {"INGESTED": 56, "MISSING": 1}


def test_page_offsets_of_many_pages(spark):
    pages = ["x" * (i % 7) for i in range(300)]
    row = ingest.raw_text(spark.createDataFrame([(pages,)], "pages array<string>")).first()
    assert [row.raw_text[p.start : p.end] for p in row.page_offsets] == pages
    none = ingest.raw_text(spark.createDataFrame([([],)], "pages array<string>")).first()
    assert (none.page_offsets, none.raw_text, none.status) == ([], "", "MISSING")


@pytest.mark.parametrize("group", [None, "g"])
def test_numbers_are_those_of_a_window(spark, group):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), i, rng.random()) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k int, v double").repartition(7)
    window = Window.partitionBy(*([group] if group else [F.lit(1)])).orderBy("k")
    want = {r.k: r.n for r in df.withColumn("n", F.row_number().over(window)).collect()}
    assert {r.k: r.n for r in numbered(df, ["k"], "n", group).collect()} == want
    assert numbered(df.limit(0), ["k"], "n", group).count() == 0
