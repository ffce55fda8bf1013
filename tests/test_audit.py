"""The whole audit on a small pre-extracted case with known counts, the registry against a sequential run, files and terms."""

import io
import random
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallywood.functions import terms, text
from tallywood.operators import audit, claims, conflicts, records, registry
from tallywood.plans.vocabulary import Vocabulary
from tallywood.sources import ingest

FACTS = "subject string, concept string, fact_id long, obs_date date, date_precision string, value double, unit string, value_key string, value_text string, document_id long, page_number int, source_text string, confidence double"
#: documents with their dates, and readings (document, date, concept, value) of a made-up case
DAYS = {1: "2026-01-18", 2: "2026-01-20", 3: "2026-02-03", 4: "2026-03-15", 5: "2026-03-18", 6: "2026-04-12", 7: "2026-06-14", 8: "2026-06-15", 9: "2026-06-15", 10: "2026-06-22", 11: "2026-06-28", 12: "2026-06-30"}
PANEL = ("hemoglobin", "rbc", "hematocrit", "mcv", "mch", "mchc", "rdw", "wbc", "platelets")
PANELS = {1: (9.2, 3.6, 29.4, 68, 21, 30.9, 18, 6.3, 390), 4: (10.4, 3.6, 29.4, 72, 23, 30.9, 17.2, 6.3, 410), 7: (8.7, 3.6, 29.4, 66, 20.5, 30.9, 17.2, 6.1, 438)}
QUOTED = [
    (3, 1, {"hemoglobin": 9.2, "mcv": 68, "platelets": 390}), (7, 7, {"creatinine": 0.9, "glucose": 92}), (8, 7, {"hemoglobin": 12.1, "wbc": 11.8, "platelets": 210, "creatinine": 0.9, "glucose": 92}),
    (10, 7, {"hemoglobin": 8.7, "mcv": 66, "creatinine": 0.9}), (11, 7, {"glucose": 92}), (12, 4, {"hemoglobin": 10.4}),
]


@pytest.fixture(scope="module")
def case(spark):
    rows = [(doc, DAYS[doc], c, v) for doc, values in PANELS.items() for c, v in zip(PANEL, values)]
    rows += [(doc, DAYS[of], c, v) for doc, of, values in QUOTED for c, v in values.items()]
    facts = spark.createDataFrame([("p", c, i, date.fromisoformat(day), "day", float(v), "u", None, None, doc, 1, "words", 0.9) for i, (doc, day, c, v) in enumerate(rows, 1)], FACTS)
    docs = spark.createDataFrame([("p", i, date.fromisoformat(d), "LAB_REPORT" if i in PANELS else "NOTE", f"{i:02d}_file.pdf", "", i, "REQUIRES_REVIEW" if i == 6 else "PROCESSED") for i, d in DAYS.items()], "subject string, document_id long, doc_date date, kind string, filename string, head string, ordinal long, processing_status string")
    meds = spark.createDataFrame([("p", i, "iron", date.fromisoformat(DAYS[doc]), status, None, doc, kind) for i, doc, status, kind in ((1, 2, "ACTIVE", "PRESCRIPTION"), (2, 5, "ACTIVE", "PRESCRIPTION"), (3, 8, "ACTIVE", "NOTE"), (4, 9, "NOT_LISTED", "NOTE"))], "subject string, entry_id long, item string, record_date date, status string, stop_date date, document_id long, doc_type string")
    said = [(1, 3, ["mcv", "mch"], None, None, None), (2, 3, ["ferritin", "tsat"], "MISSING_SUPPORT", None, None), (3, 5, [], None, None, None), (4, 8, [], "MISSING_SOURCE", "CT report", None), (8, 10, [], "MISSING_FOLLOWUP", None, "hemoglobin"), (9, 12, ["hemoglobin"], None, None, None)]
    own = spark.createDataFrame([(i, "p", f"claim {i}", date.fromisoformat(DAYS[d]), d, s, None, r, ref, want) for i, d, s, r, ref, want in said], "claim_id long, subject string, claim_text string, claim_date date, document_id long, support array<string>, lookback_days int, gap_rule string, referenced_document string, expected_concept string")
    return facts, docs, meds, own


def test_rule_set_of_records_gives_the_known_counts(spark, case):
    facts, docs, meds, own = case
    none = spark.createDataFrame([], "concept string, abs_limit double, rel_limit double, window_days int")
    changed = audit.record_changes(facts, none)
    numeric = audit.record_numeric_conflicts(facts, none)
    listed = conflicts.same_day_status(meds)
    gaps = audit.record_gaps(own, facts, docs)
    assert facts.count() == 42 and changed.count() == 7 and numeric.count() + listed.count() == 4 and gaps.count() == 3
    assert {x.concept for x in numeric.collect()} == {"hemoglobin", "wbc", "platelets"} and {x.status for x in numeric.collect()} == {"UNRESOLVED"}
    assert {x.gap_type for x in gaps.collect()} == {"MISSING_SUPPORTING_TEST", "MISSING_REFERENCED_DOCUMENT", "MISSING_FOLLOWUP"}
    metrics = records.record_metrics(docs, numeric, gaps, facts=facts).first()
    assert (metrics.documents, metrics.unresolved, metrics.traceability) == (12, 3 + 3 + 1, 100)
    edges = audit.record_edges(facts, own, changed, conflicts.cross_members(_dated(facts, none)), gaps)
    kinds = {x.rel_type: x.n for x in edges.groupBy("rel_type").agg(F.count("*").alias("n")).collect()}
    assert kinds["CHANGED_TO"] == 7 and kinds["SUPPORTS"] == 3 and kinds["MISSING_SUPPORT"] == 3 and kinds["DUPLICATES"] > 0
    line = audit.record_timeline(docs, facts, own, facts.limit(0).select("document_id", "concept"))
    assert line.count() == 12 and line.where("document_id = 5").first().detail == "claim 3"


def _dated(facts, rules):
    from tallywood.operators.episodes import episodes, with_rules

    return episodes(with_rules(facts, rules, 0))


def test_audit_in_one_call(spark, case):
    facts, docs, meds, own = case
    nothing = audit.Evidence(
        facts, meds, own.select("claim_id", "subject", F.when(F.col("claim_id") == 2, "IRON_DEFICIENCY").otherwise("OTHER").alias("claim_type"), "claim_date", "document_id"),
        spark.createDataFrame([(1, "p", "IMAGING_REPORT", "CT report", 8, date(2026, 6, 15))], "ref_id long, subject string, kind string, label string, citing_doc long, citing_date date"), docs,
        spark.createDataFrame([(1, "p", "Repeat CBC", date(2026, 1, 20))], "event_id long, subject string, label string, event_date date"),
    )
    found = audit.audit(nothing, Vocabulary())
    counts = found["counts"].first()
    assert counts.facts == 42 and counts.source_traceability == 1.0 and counts.unresolved == counts.conflicts == found["conflicts"].count()
    assert {(x.claim_id, x.evidence_status) for x in found["claims"].collect() if x.claim_id == 2} == {(2, "NO_LOCATED_EVIDENCE")}
    assert {x.gap_type for x in found["gaps"].collect()} == {"UNSUPPORTED_CLAIM", "MISSING_DOCUMENT"}
    assert {x.outcome for x in found["references"].collect()} == {"MISSING"}
    empty = audit.Evidence(*(t.limit(0) for t in (nothing.facts, nothing.medications, nothing.claims, nothing.references, nothing.documents, nothing.events)))
    assert audit.audit(empty, Vocabulary())["counts"].first().conflicts == 0


def test_null_subjects_meet_each_other(spark):
    facts = spark.createDataFrame([(s, "x", i, date(2024, 1, 1), v, "HIGH" if v > 5 else "LOW", d, 0.9) for s, i, v, d in ((None, 1, 1.0, 1), (None, 2, 9.0, 2), ("p", 3, 1.0, 3))], "subject string, concept string, fact_id long, obs_date date, value double, value_key string, document_id long, confidence double")
    rules = spark.createDataFrame([("x", 1.0, None, 2)], "concept string, abs_limit double, rel_limit double, window_days int")
    for found in (conflicts.numeric_conflicts(facts, rules), conflicts.status_conflicts(facts, rules), conflicts.materiality_pairs(facts, rules)):
        assert [(x.subject, sorted((x.left_id, x.right_id))) for x in found.collect()] == [(None, [1, 2])]
    assert {x.fact_id for x in conflicts.material_members(facts, rules).collect()} == {1, 2}


def test_registry_against_a_sequential_run(spark):
    rng = random.Random(12)
    rows = []
    for i in range(160):
        name = rng.choice([None, "ann lee", "bo ray", "cy doe", "dee fox", "mono", "ann fox"])
        rows.append((i, i, name is not None or rng.random() < 0.7, name, None, None, None, name, rng.choice([None, *[date(1980, 1, k) for k in range(1, 6)]]), rng.choice([None, "F", "M"]), rng.choice([None, None, *[f"M{k}" for k in range(8)]])))
    rows = [(i, o, t, n, str(d) if d else None, s, m, k, d, s, m) for i, o, t, n, _, _, _, k, d, s, m in rows]
    stated = spark.createDataFrame(rows, "document_id long, ordinal long, has_text boolean, raw_name string, raw_dob string, raw_sex string, raw_mrn string, name_key string, dob date, sex string, mrn string")
    known, want = [], {}
    for i, _, has_text, *_rest, key, dob, sex, mrn in rows:
        raw = (key, dob, mrn)
        hits = [p for p in known if mrn and p["mrn"] == mrn]
        both = [p for p in known if key and dob and p["key"] == key and p["dob"] == dob]
        near = [p for p in known if (key and p["key"] == key) or (dob and p["dob"] == dob)]
        if not any(raw):
            basis = "NO_IDENTITY_STATED" if has_text else "NO_READABLE_TEXT"
        elif len(hits) == 1:
            basis = "MRN_EXACT" if not key or not hits[0]["key"] or key == hits[0]["key"] else "MRN_CONFLICT"
        elif key and dob and len(key.split()) < 2:
            basis = "INSUFFICIENT_IDENTITY"
        elif len(both) == 1:
            basis = "AMBIGUOUS" if sex and both[0]["sex"] and sex != both[0]["sex"] else "NAME_DOB_SEX" if sex and both[0]["sex"] else "NAME_DOB"
        elif near or not (mrn or (dob and key and len(key.split()) >= 2)):
            basis = "INSUFFICIENT_IDENTITY"
        else:
            basis = "NO_MATCH"
            known.append({"mrn": mrn, "key": key, "dob": dob, "sex": sex, "ref": f"PT-{len(known) + 1:04d}"})
        ref = hits[0]["ref"] if basis == "MRN_EXACT" else both[0]["ref"] if basis.startswith("NAME") else known[-1]["ref"] if basis == "NO_MATCH" else None
        want[i] = (basis, ref)
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", "/tmp/spark-checkpoint"))
    links, patients = registry.resolve(stated.repartition(5))
    assert {x.document_id: (x.basis, x.patient_ref) for x in links.collect()} == want and patients.count() == len(known)


@pytest.mark.parametrize(("raw", "want"), [("1988-05-15", "1988-05-15"), ("15 May 88", "1988-05-15"), ("May 15, 1988", "1988-05-15"), ("03/04/1988", None), ("25/04/1988", "1988-04-25"), ("04/25/1988", "1988-04-25"), ("soon", None), ("31 Feb 1990", None), (None, None)])
def test_birth_dates(spark, raw, want):
    assert spark.range(1).select(registry.normalise_dob(F.lit(raw).cast("string"), 2026).cast("string")).first()[0] == want


def test_short_numbers(spark):
    values = (9.2, 68.0, 0.0, 1234567.0, 0.00001234, -3.5, 100.0, 0.1 + 0.2, 123456.7)
    got = [x[0] for x in spark.createDataFrame([(v,) for v in values], "v double").select(records.short_number(F.col("v"))).collect()]
    assert got == [f"{v:g}" for v in values]
    assert spark.range(1).select(records.short_number(F.lit(None).cast("double"))).first()[0] is None


def test_directions_and_their_opposites(spark):
    row = spark.range(1).select(*[claims.opposite(F.lit(x)) for x in ("lt", "lte", "gt", "gte", "any")]).first()
    assert list(row) == ["gte", "gt", "lte", "lt", None]


def test_files_archives_and_failures(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, body in (("a.txt", b"one\xff text"), ("b.txt", b"one\xff text"), ("c.png", b"png"), ("d.pdf", b"no pdf"), ("e.doc", b"x"), (".hidden.txt", b"y"), ("Thumbs.db", b"z")):
        (tmp_path / "in" / name).write_bytes(body)
    files = ingest.discover(spark, str(tmp_path / "in")).withColumn("case_id", F.lit("k"))
    parsed = {x.path.rsplit("/", 1)[1]: x for x in ingest.parse_files(files).collect()}
    assert {k: v.status for k, v in parsed.items()} == {"a.txt": "INGESTED", "b.txt": "DUPLICATE", "c.png": "MISSING", "d.pdf": "FAILED", "e.doc": "FAILED"}
    assert parsed["d.pdf"].error and parsed["e.doc"].error == "unsupported suffix"
    job = ingest.plan_job(files, "j").orderBy("ordinal").collect()
    assert [x.ordinal for x in job] == [1, 2, 3, 4, 5] and {x.status for x in job} == {"PENDING"} and [x.path for x in job] == sorted(x.path for x in job)
    assert ingest.page_rows(ingest.parse_files(files)).where("page_number = 1").count() == 3
    sent = files.select("path", "suffix", "supported", "byte_size", "sha256").unionByName(spark.createDataFrame([("x/f.txt", ".txt", True, 0, "0")], "path string, suffix string, supported boolean, byte_size long, sha256 string"))
    refused = {x.path.rsplit("/", 1)[1]: x.refused for x in ingest.accept_uploads(sent, most_bytes=8).collect()}
    assert refused["a.txt"] == "too large" and refused["f.txt"] == "empty file" and refused["c.png"] is None
    (tmp_path / "zip").mkdir()
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("x/one.txt", "hello")
    (tmp_path / "zip" / "a.zip").write_bytes(body.getvalue())
    (tmp_path / "zip" / "bad.gz").write_bytes(b"no archive")
    assert [(x.path.rsplit("!", 1)[1], x.content.decode()) for x in ingest.archive_members(spark, str(tmp_path / "zip")).collect()] == [("x/one.txt", "hello")]


def test_vocabulary_service_states_and_memory(spark):
    assert list(spark.range(1).select(terms.health(F.lit(False), F.lit(200)), terms.health(F.lit(True), F.lit(403)), terms.health(F.lit(True), F.lit(None).cast("int")), terms.health(F.lit(True), F.lit(200))).first()) == ["UNLICENSED", "UNLICENSED", "UNREACHABLE", "ACTIVE"]
    cache = spark.createDataFrame([], "provider string, kind string, phrase string, code string")
    asked = spark.createDataFrame([("A", "t", "x", "ACTIVE"), ("A", "t", "y", "ACTIVE"), ("B", "t", "x", "UNLICENSED")], "provider string, kind string, phrase string, state string")
    answers = spark.createDataFrame([("A", "t", "x", "C1")], "provider string, kind string, phrase string, code string")
    assert {(x.provider, x.phrase, x.code) for x in terms.remember(cache, answers, asked).collect()} == {("A", "x", "C1"), ("A", "y", None)}
    report = terms.resolution_report(spark.createDataFrame([("HIT", "S", "EXACT"), ("ASK", "S", "APPROXIMATE"), ("MISS_KNOWN", None, None)], "state string, system string, match_kind string")).first()
    assert (report.phrases, report.coded, report.assertable, report.by_system) == (3, 2, 1, {"S": 2})


def test_hypothetical_lines(spark):
    assert list(spark.range(1).select(text.hypothetical(F.lit("To exclude infarct")), text.hypothetical(F.lit("No acute infarct"))).first()) == [True, False]
