"""One call from files to all results: counts, resumption, declared stages, a table function as the extractor."""

from datetime import date

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tallywood.operators import audit, pipeline, records
from tallywood.plans.vocabulary import DOCUMENT_CUES, FILE_HINTS, Vocabulary
from tallywood.sources import ingest
from tallywood.sources.tables import settle

REPORTS = {
    "01_lab.txt": "Central Hospital\nPatient: Ann Roe   DOB: 2 March 1980   Sex: F   MRN: A1\nReport Date: 3 Jan 2026\nHemoglobin    9.2 g/dL   (12.0-16.0)\nMCV    68 fL\n",
    "02_lab.txt": "Central Hospital\nPatient: Ann Roe   DOB: 2 March 1980   Sex: F   MRN: A1\nReport Date: 4 Jan 2026\nHemoglobin    12.1 g/dL   (12.0-16.0)\n",
    "03_note.txt": "CONSULTATION NOTE\nPatient: Ann Roe   DOB: 2 March 1980   Sex: F   MRN: A1\nReport Date: 10 Feb 2026\nAssessment\nIron deficiency confirmed.\nsee the CT report for findings.\nPlease repeat CBC in six weeks\nMedication\n1. Ferrous sulphate 200 mg twice daily oral\n    Status: active\n",
    "04_lab.txt": "Central Hospital\nPatient: Ann Roe   DOB: 2 March 1980   Sex: F   MRN: A1\nReport Date: 1 June 2026\nHemoglobin    8.0 g/dL\n",
    "05_copy.txt": None,
    "06_scan.png": "",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("case")
    for name, text in REPORTS.items():
        (folder / name).write_text(REPORTS["01_lab.txt"] if text is None else text or "\x89PNG")
    return ingest.discover(spark, str(folder))


def test_from_files_to_all_results(spark, files, tmp_path):
    concepts = spark.createDataFrame([("718-7", "Hemoglobin", ["hb"]), ("787-2", "MCV", [])], "code string, label string, aliases array<string>")
    go = lambda: pipeline.run_case(spark, files, Vocabulary(), str(tmp_path / "run"), concepts=concepts, cues=DOCUMENT_CUES, hints=FILE_HINTS)
    out = go()
    assert {(r.stage) for r in out["manifest"].collect()} == set(pipeline.STAGES)
    n = {k: df.count() for k, df in out.items() if k not in ("manifest",)}
    assert (n["files"], n["documents"], n["facts"], n["claims"], n["medications"], n["citations"], n["events"], n["patients"]) == (6, 5, 4, 1, 1, 1, 1, 1)
    assert n["numeric_conflicts"] == 1 and n["changes"] >= 1 and n["gaps"] >= 2 and n["timeline"] == 7
    line = {(r.kind, r.display_id): r.status for r in out["timeline"].collect()}
    assert line["observation", "F-001"] == "CONFLICT" and line["claim", "C-001"] == "MISSING" and line["medication", "M-001"] == "DOCUMENTED"
    assert {r.code for r in out["codings"].collect()} == {"718-7", "787-2"}
    assert {(r.kind) for r in out["graph_nodes"].collect()} == {"document", "fact", "claim", "medication", "event"} and out["graph_edges"].where("rel_type = 'CONTAINS'").count() == 7
    assert out["counts"].first().facts == 4 and {r.kind for r in out["open_items"].collect()} == {"conflict", "evidence_gap"}
    again = go()  # nothing is made anew
    assert again["facts"].count() == 4 and again["manifest"].count() == out["manifest"].count()


def test_a_run_goes_on_behind_its_last_stage(spark, files, tmp_path):
    class Broken(pipeline.RuleExtractor):
        def items(self, pages):
            raise RuntimeError("killed")

    folder = str(tmp_path / "run")
    with pytest.raises(RuntimeError):
        pipeline.run_case(spark, files, Vocabulary(), folder, extractor=Broken(None))
    run = pipeline.Run(spark, folder)
    assert [s for s in pipeline.STAGES if run.done(s)] == ["INGEST", "CLASSIFY"]
    with pytest.raises(ValueError):
        run.stage("GUESS", dict)
    with pytest.raises(ValueError):
        run.stage("DETECT_GAPS", dict)

    @udtf(returnType="kind string, name string, value double, unit string, item_date date, date_precision string")
    class Firsts:
        def eval(self, text: str, doc_type: str, doc_date):
            for word in text.split():
                if word == "Hemoglobin":
                    yield "OBSERVATION", "hemoglobin", 1.0, "g/dL", doc_date, "day"

    spark.udtf.register("firsts", Firsts)
    out = pipeline.run_case(spark, files, Vocabulary(), folder, extractor=pipeline.TableExtractor("firsts"))
    assert [(r.concept, r.value) for r in out["facts"].collect()] == [("hemoglobin", 1.0)] * 3 and out["claims"].count() == 0


def test_claims_see_their_own_edges_alone(spark):
    edges = spark.createDataFrame([("SUPPORTS", "1", "1"), ("CONTRADICTS_CLAIM", "2", "1"), ("CONTRADICTS", "3", "1"), ("DUPLICATES", "4", "1")], "rel_type string, from_id string, to_id string")
    got = records.claim_evidence_view(spark.createDataFrame([(1,), (9,)], "claim_id long"), edges)
    assert sorted((r.rel_type, r.fact_id) for r in got.collect()) == [("CONTRADICTS", "2"), ("SUPPORTS", "1")]


def test_nodes_of_two_kinds_with_one_id(spark):
    one = spark.createDataFrame([(1,)], "node_id long")
    contains = spark.createDataFrame([("1", "1", "fact", "claim"), ("1", "7", "fact", "claim")], "from_id string, to_id string, from_type string, to_type string")
    relations = spark.createDataFrame([("MISSING_SUPPORT", "1", "ferritin", "claim", "concept")], "rel_type string, from_id string, to_id string, from_type string, to_type string")
    nodes, edges = audit.graph({"fact": one, "claim": one}, contains, relations)
    assert sorted((r.kind, r.node_id) for r in nodes.collect()) == [("absent_evidence", "ferritin"), ("claim", "1"), ("fact", "1")]
    assert sorted(tuple(r) for r in edges.collect()) == [("CONTAINS", "1", "1", "fact", "claim"), ("MISSING_SUPPORT", "1", "ferritin", "claim", "absent_evidence")]


def test_no_files(spark, files, tmp_path):
    out = pipeline.run_case(spark, files.limit(0), Vocabulary(), str(tmp_path / "none"))
    assert out["facts"].count() == out["timeline"].count() == out["graph_edges"].count() == 0 and out["counts"].first().documents == 0


def test_a_case_reads_each_file_once_and_looks_into_pdfs_alone(spark, tmp_path):
    """The digests and pages are written before copies are looked for; other kinds of files never reach the reader of PDFs."""
    reads = spark.sparkContext.accumulator(0)
    count = F.udf(lambda raw: (reads.add(1), bytes(raw))[1], "binary").asNondeterministic()
    rows = [("a.txt", b"one"), ("b.txt", b"one"), ("c.txt", b"two"), ("d.png", b"x")]
    listed = ingest.described(spark.createDataFrame([(p, b, len(b)) for p, b in rows], "path string, content binary, length long"))
    files = listed.withColumn("case_id", F.lit("case")).withColumn("content", count("content"))
    got = pipeline.ingested(ingest.parse_files(files, settle=settle))
    assert {r.path: r.status for r in got["files"].collect()} == {"a.txt": "INGESTED", "b.txt": "DUPLICATE", "c.txt": "INGESTED", "d.png": "MISSING"}
    assert got["pages"].count() == 3 and reads.value == len(rows)
    assert ingest.pdf_pages.func(pd.Series([None, None]))["error"].isna().all()


def test_a_stage_of_the_audit_reads_what_is_written(spark):
    """Counts come from the written tables, not from the detectors anew."""
    facts = spark.createDataFrame([("p", "hb", 1, date(2026, 1, 1), "day", 9.0, "g/dL", None, None, 1, 1, "x", 0.9)], "subject string, concept string, fact_id long, obs_date date, date_precision string, value double, unit string, value_key string, value_text string, document_id long, page_number int, source_text string, confidence double")
    e = audit.Evidence(
        facts, spark.createDataFrame([], "subject string, entry_id long, item string, record_date date, status string, stop_date date, document_id long, doc_type string"), spark.createDataFrame([], "claim_id long, subject string, claim_type string, claim_date date, document_id long"),
        spark.createDataFrame([], "ref_id long, subject string, kind string, label string, citing_doc long, citing_date date"), spark.createDataFrame([], "document_id long, subject string, kind string, doc_date date, filename string, head string, ordinal long"), spark.createDataFrame([], "event_id long, subject string, label string, event_date date"),
    )
    every = spark.createDataFrame([("p", "hb", "NUMERIC", "1", "2", "UNRESOLVED")] * 7, "subject string, concept string, kind string, left_id string, right_id string, status string")
    assert audit.audit(e, Vocabulary(), {"conflicts": every})["counts"].first().conflicts == 7
