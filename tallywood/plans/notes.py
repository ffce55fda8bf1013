"""Queries of extraction and the registry over reports written from the given tables, and their SQL.

The tables hold no clinical text, so a report is rendered from each row's values: the query has to read
the values back out of the text, and the SQL takes them from the columns.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import units
from ..functions.text import classify, dated, document_date
from ..operators import extraction, pipeline, registry
from ..sources import ingest
from ..sources.tables import settle, shared_folder
from . import standins as s
from .vocabulary import DOCUMENT_CUES, FILE_HINTS, Vocabulary

THIS_YEAR = 2026
V = Vocabulary()
#: event type, label as printed, unit, concept that must come out
READINGS = (("view", "Hemoglobin", "g/dL", "hemoglobin"), ("click", "M.C.V.", "fL", "mcv"), ("signup", "Ferritin", "ng/mL", "ferritin"), ("purchase", "Glucose", "mg/dL", "glucose"), ("error", "Quartz index", "mmol/L", "unmapped:quartz_index"))
NOTE_CLAIMS = {"1-URGENT": "Iron deficiency confirmed.", "2-HIGH": "Hb stable on prior testing", "3-MEDIUM": "No acute intracranial abnormality"}
UNITS = ("g/dL", "mg/dl", "mmol/L", "fL", "x10^9/L", "10*3/uL", "/min", "mEq/L", "gm/dL", "%", "ng/mL", "bpm", "am")


def _of(column: str, table: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for key, value in table.items():
        out = F.when(F.col(column) == key, value).otherwise(out)
    return out


def _day(column: Column | str) -> Column:
    return F.date_format(F.to_date(column), "d MMM yyyy")


# --- readings in seven layouts --------------------------------------------------------
def reading_pages(spark, d):
    """A page for each event: its value to one decimal under its label, in one of seven layouts."""
    e = s.table(spark, d, "events")
    tenths = F.floor(F.col("value") * 10).cast("long")
    v = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))
    label, unit = _of("event_type", {r[0]: r[1] for r in READINGS}, "?"), _of("event_type", {r[0]: r[2] for r in READINGS}, "?")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    layouts = (
        c(label, "    ", v, " ", unit, "   (1.0-9.5)"), c("Test            Result        Reference\n", label, "      ", v, " ", unit, "      1.0-9.5"), c(label, " | ", v, " | ", unit, " | 1.0-9.5"),
        c(label, " ........ ", v, " ", unit, " L"), c("The patient's ", F.lower(label), " was ", v, " ", unit, " at 10:30 on review."), c(label, "  [Ref: 1.0-9.5]  ", v, " ", unit), c(label, "\t", v, "\t", unit, "\t1.0-9.5"),
    )
    text = F.element_at(F.array(*layouts), (F.col("event_id") % len(layouts) + 1).cast("int"))
    return e.select(F.col("event_id").alias("page_id"), text.alias("text"), F.to_date("ts").alias("page_date"))


def layout_observations(spark, d):
    rows = extraction.attribute_dates(extraction.lines(reading_pages(spark, d)), F.col("page_date"), F.lit("day"))
    found = extraction.observations(rows, V.synonyms(spark), V.units(spark))
    return found.select("page_id", "concept", "match", "value", F.col("unit_canonical").alias("unit"), "dimension", "confidence", "layout", "obs_date", "date_basis")


def measure_spans(spark, d):
    """The words of every measurement's span in its page."""
    pages = reading_pages(spark, d)
    found = extraction.measurements(extraction.lines(pages)).select("page_id", "value", "span_start", "span_end", "flag", "reference_range")
    return found.join(pages.select("page_id", "text"), "page_id").select("page_id", "value", F.substring("text", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")).alias("words"), "flag", "reference_range")


def release_measurements(spark, d):
    """Readings in units that only a loaded release knows: an atom for each nation, of its region's quantity, written and read as XML."""
    n, r = s.table(spark, d, "nation"), s.table(spark, d, "region")
    code = F.concat(F.lit("["), F.lower(F.substring("n_name", 1, 3)), F.col("n_nationkey").cast("string"), F.lit("]"))
    path = os.path.join(shared_folder(spark), f"release-{uuid.uuid4().hex}")
    n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(code.alias("_Code"), F.lower("r_name").alias("property")).write.format("xml").option("rootTag", "root").option("rowTag", "unit").save(path)
    known = units.grammar(extra=units.loaded(units.atoms_of_release(spark, path)))
    c = s.table(spark, d, "customer").join(F.broadcast(n.select("n_nationkey", code.alias("code"))), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows
    text = F.concat(F.lit("Index A    "), F.col("c_custkey").cast("string"), F.lit(".5 "), F.col("code"), F.when(F.col("c_custkey") % 2 == 0, "/L").otherwise(""), F.lit("   (1.0-9.5)"))
    found = extraction.measurements(extraction.lines(c.select(F.col("c_custkey").alias("page_id"), text.alias("text"))), known)
    return found.select("page_id", "label", "value", "unit_canonical", "dimension", "reference_range")


def unit_kinds(spark, d):
    """Normal form, kind and comparison with g/L of a printed unit, for every part."""
    p = s.table(spark, d, "part")
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), (F.col("p_partkey") % len(UNITS) + 1).cast("int"))
    rows = p.select("p_partkey", F.col("p_size").cast("double").alias("v"), unit.alias("printed"))
    known = {"bpm": "/min"}
    u = F.col("printed")
    return rows.select("p_partkey", units.canonical(u, known).alias("unit"), units.dimension(u, known).alias("kind"), units.is_plausible(u).alias("plausible"), units.same_dimension(u, F.lit("g/L")).alias("like_g_per_l"), F.round(units.convert(F.col("v"), u, F.lit("g/L")), 6).alias("in_g_per_l"))


# --- notes ----------------------------------------------------------------------------
def note_pages(spark, d):
    """A consultation note for each order."""
    o = s.table(spark, d, "orders")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    finding = _of("o_orderstatus", {"F": "CT shows no acute infarct", "O": "CT shows acute infarct"}, "To exclude acute infarct")
    status = _of("o_orderstatus", {"F": "stopped", "O": "active"}, "unknown")
    text = F.concat_ws(
        "\n", F.lit("CONSULTATION NOTE"), c("Report Date: ", _day("o_orderdate")), F.lit("Medication"), c("1. Ferrous sulphate ", F.floor("o_totalprice").cast("string"), " mg twice daily oral"),
        c("    Status: ", status, "   Start date: ", _day("o_orderdate")), F.lit("Assessment"), _of("o_orderpriority", NOTE_CLAIMS, "Nothing further."), finding,
        F.when(F.col("o_totalprice") > 150000, "see the CT\nreport for findings.").otherwise("No other study."), F.when(F.col("o_custkey") % 2 == 0, "Please repeat CBC in six weeks").otherwise("No visit is planned"),
    )
    return o.select(F.col("o_orderkey").alias("page_id"), text.alias("text"), F.lit("PRESCRIPTION").alias("doc_type"), F.lit(None).cast("date").alias("doc_date"), F.to_date("o_orderdate").alias("own_date"))


def note_items(spark, d, kind):
    return extraction.extract_pages(note_pages(spark, d), V, (kind,))[kind]


def note_claims(spark, d):
    return note_items(spark, d, "claims").select("page_id", "claim_type", "claim_text", "confidence", F.col("page_date").alias("claim_date"))


def note_medications(spark, d):
    return note_items(spark, d, "medications").select("page_id", "drug_norm", "dose", "unit", "frequency", "route", "status", "start_date", "record_date")


def note_findings(spark, d):
    return note_items(spark, d, "findings").select("page_id", "concept", "value_key", "surface_form")


def note_references(spark, d):
    return note_items(spark, d, "references").select("page_id", "label", "kind")


def note_follow_ups(spark, d):
    return note_items(spark, d, "follow_ups").select("page_id", "label", "detail", F.col("page_date").alias("event_date"))


def note_sections(spark, d):
    found = extraction.sections(extraction.lines(note_pages(spark, d)))
    return extraction.section_map(found).select("page_id", F.element_at("by_role", "IMPRESSION").alias("impression"))


def note_lines(spark, d):
    """Line spans slice back to the lines."""
    pages = note_pages(spark, d)
    rows = extraction.lines(pages).join(pages.select("page_id", "text"), "page_id")
    return rows.groupBy("page_id").agg(F.count("*").alias("n_lines"), F.count_if(F.substring("text", F.col("line_start").cast("int") + 1, (F.col("line_end") - F.col("line_start")).cast("int")) == F.col("line")).alias("n_exact"))


def note_classes(spark, d):
    """Class by cues in the text and hints in the file's name."""
    name = F.concat(F.lit("scan_"), F.lower(F.regexp_replace("o_orderpriority", "^.-", "")), F.lit("_"), F.when(F.col("o_orderstatus") == "F", "lab.pdf").otherwise("rx.pdf"))
    rows = s.table(spark, d, "orders").select("o_orderkey", name.alias("filename"), F.when(F.col("o_orderpriority") == "5-LOW", "").when(F.col("o_orderstatus") == "P", "Dear colleague, the referral").otherwise("text without cues").alias("text"))
    return rows.select("o_orderkey", classify(F.col("text"), DOCUMENT_CUES, filename=F.col("filename"), hints=FILE_HINTS).alias("doc_class"))


def document_dates(spark, d):
    """Labelled dates of documents: the order's, beside an admission and a birth date, in five written forms."""
    o = s.table(spark, d, "orders")
    t = F.to_date("o_orderdate")
    written = F.element_at(F.array(*[F.date_format(t, f) for f in ("d MMMM yyyy", "MMM d, yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "MMMM yyyy")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    label = _of("o_orderstatus", {"F": "Discharge Date: ", "O": "Date: "}, "on ")
    text = F.concat(F.lit("Seen\nAdmission Date: 2 Jan 1990\n"), label, written, F.lit("\nBody of 3 lines"))
    return o.select("o_orderkey", document_date(text).alias("f")).select("o_orderkey", F.col("f.date").alias("doc_date"), F.col("f.precision").alias("precision"), F.col("f.labelled").alias("labelled"))


def attributed_dates(spark, d):
    """Which date a reading belongs to: its row's, its line's, a cited document's, the one before it, or the page's."""
    o = s.table(spark, d, "orders")
    on = _day("o_orderdate")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = {"1-URGENT": c(on, "   Hemoglobin  9.2 g/dL"), "2-HIGH": c("Hemoglobin 9.2 g/dL, dated ", on), "3-MEDIUM": c("CBC dated ", on, " was seen.\nThe cbc gave hemoglobin 9.2 g/dL"), "4-NOT SPECIFIED": c("Sheet dated ", on, " follows\nHemoglobin 9.2 g/dL")}
    text = F.lit("Hemoglobin 9.2 g/dL")
    for key, form in forms.items():
        text = F.when(F.col("o_orderpriority") == key, form).otherwise(text)
    pages = o.select(F.col("o_orderkey").alias("page_id"), text.alias("text"))
    rows = extraction.attribute_dates(extraction.lines(pages), F.lit("2000-01-01").cast("date"), F.lit("day"))
    return extraction.observations(rows, V.synonyms(spark)).select("page_id", "obs_date", "date_basis")


# --- registry -------------------------------------------------------------------------
def _surname(key: Column) -> Column:
    return F.initcap(F.translate(F.lpad(key.cast("string"), 7, "0"), "0123456789", "abcdefghij"))


def _born(key: Column) -> Column:
    return F.date_add(F.lit("1930-01-01").cast("date"), key.cast("int"))


def letter_pages(spark, d):
    """A letter for each customer: letterhead, patient, who asked and who verified."""
    c, n = s.table(spark, d, "customer"), s.table(spark, d, "nation")
    rows = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])  # 25 rows
    text = F.concat_ws(
        "\n", F.concat(F.initcap("n_name"), F.lit(" General Hospital")), F.concat(F.lit("Patient Name: Mr. José "), _surname(F.col("c_custkey")), F.lit("   DOB: "), F.date_format(_born(F.col("c_custkey")), "d MMMM yyyy"), F.lit("   Sex: "), F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("M")),
        F.concat(F.lit("MRN: ab-"), F.col("c_custkey").cast("string"), F.lit(" | Ward 3")), F.concat(F.lit("Verified by: Dr. "), F.initcap(F.lower("c_mktsegment")), F.lit(" Roe, MD")), F.concat(F.lit("Requested by: Dr. Ann "), _surname(F.col("n_nationkey")), F.lit("   Report No: 12")), F.lit("Consultant Cardiologist"),
    )
    return rows.select(F.col("c_custkey").alias("document_id"), F.col("c_custkey").alias("ordinal"), text.alias("text"), F.lit("case").alias("case_id"))


def registry_assertions(spark, d):
    return registry.assertions(letter_pages(spark, d), THIS_YEAR).select("document_id", "name_key", "dob", "sex", "mrn")


def registry_participants(spark, d):
    pages = letter_pages(spark, d)
    issuers = pages.select("document_id", registry.institution(F.col("text")).alias("institution"))
    return registry.participants(pages).join(issuers, "document_id").select("document_id", "role", "raw_text", "name_key", "institution")


def _directory(spark, d):
    pages = letter_pages(spark, d)
    issuers = pages.select("document_id", registry.institution(F.col("text")).alias("institution"))
    return pages, registry.directory(registry.participants(pages), issuers)


def clinic_team(spark, d):
    return registry.care_team(*_directory(spark, d)[1])


def directory_counts(spark, d):
    pages, found = _directory(spark, d)
    return registry.directory_counts(pages, *found)


def directory_pruned(spark, d):
    """Clinicians that letters of customers with a negative balance still refer to."""
    _, (clinicians, seen) = _directory(spark, d)
    kept = seen.join(s.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("document_id")), "document_id", "left_semi")
    return registry.prune(clinicians, "clinician_id", kept).select("display_name", "affiliation")


def statement_pages(spark, d):
    """A page for each order that states its customer's identity more or less fully."""
    o = s.table(spark, d, "orders")
    who = F.concat(F.lit("Patient: Ann "), _surname(F.col("o_custkey")))
    born = F.concat(F.lit("   DOB: "), F.date_format(_born(F.col("o_custkey")), "yyyy-MM-dd"))
    sex = F.concat(F.lit("   Sex: "), F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("M"))
    forms = {"1-URGENT": F.concat(who, F.lit("   MRN: M"), F.col("o_custkey").cast("string")), "2-HIGH": F.concat(who, born, sex), "3-MEDIUM": F.concat(who, born), "4-NOT SPECIFIED": who}
    text = F.lit("A page about no one")
    for key, form in forms.items():
        text = F.when(F.col("o_orderpriority") == key, form).otherwise(text)
    return o.select(F.col("o_orderkey").alias("document_id"), F.col("o_orderkey").alias("ordinal"), text.alias("text"), F.to_date("o_orderdate").alias("doc_date"))


def _resolved(spark, d):
    stated = registry.assertions(statement_pages(spark, d), THIS_YEAR)
    return stated, *registry.resolve(stated, settle=settle)


def registry_links(spark, d):
    return _resolved(spark, d)[1].select("document_id", "status", "basis", "patient_ref", "candidates")


def registry_encounters(spark, d):
    pages = statement_pages(spark, d)
    issuers = s.table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("House "), F.col("o_orderstatus"))).alias("institution"))
    return registry.encounters(_resolved(spark, d)[1], pages, issuers)


def registry_patients(spark, d):
    _, links, patients = _resolved(spark, d)
    items = s.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), _of("l_returnflag", {"R": "facts", "A": "claims"}, "medications").alias("kind"))
    return registry.patient_view(patients, links, items).select("patient_ref", "dob", "sex", "mrn", "documents", "facts", "claims", "medications")


def registry_review(spark, d):
    stated, links, _ = _resolved(spark, d)
    return registry.review_queue(links, stated).groupBy("basis").agg(F.count("*").alias("n"), F.count("raw_name").alias("named"), F.count("raw_mrn").alias("numbered"))


def visit_files(spark, d):
    """A text file for each order: who, when, a reading and a follow-up, in the columns of a file listing."""
    o = s.table(spark, d, "orders").repartition("o_orderkey")  # a small table's few tasks write many pages
    tenths = F.floor(F.col("o_totalprice") / 1000).cast("long")
    text = F.concat_ws(
        "\n", F.concat(F.lit("Patient: Ann "), _surname(F.col("o_custkey")), F.lit("   MRN: M"), F.col("o_custkey").cast("string")), F.concat(F.lit("Report No: "), F.col("o_orderkey").cast("string")), F.concat(F.lit("Report Date: "), _day("o_orderdate")),
        F.concat(F.lit("Hemoglobin    "), F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"), F.lit(" g/dL")), F.when(F.col("o_orderstatus") == "F", "Please repeat CBC in six weeks").otherwise("No visit is planned"),
    )
    rows = o.select(F.concat(F.lit("case/"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.lit(".txt")).alias("path"), text.cast("binary").alias("content"))
    return ingest.described(rows.withColumn("length", F.length("content").cast("long")))


def case_run_timeline(spark, d):
    """All stages from files to the timeline: entries and patients by kind and day."""
    folder = os.path.join(shared_folder(spark), f"run-{uuid.uuid4().hex}")
    out = pipeline.run_case(spark, visit_files(spark, d), V, folder, this_year=THIS_YEAR, cues=DOCUMENT_CUES, hints=FILE_HINTS)
    return out["timeline"].groupBy("kind", "title", "date").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("patients"))


_ALL = (
    case_run_timeline, layout_observations, measure_spans, release_measurements, unit_kinds, note_claims, note_medications, note_findings, note_references, note_follow_ups, note_sections, note_lines, note_classes, document_dates, attributed_dates,
    registry_assertions, registry_participants, clinic_team, directory_counts, directory_pruned, registry_links, registry_encounters, registry_patients, registry_review,
)
QUERIES = {f.__name__: f for f in _ALL}

# --- SQL ------------------------------------------------------------------------------
_case = lambda column, table, other="NULL": f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + f" ELSE {other} END"
_text = lambda x: "'" + x.replace("'", "''") + "'"
_TENTHS = "CAST(floor(value * 10) AS BIGINT)"
_PRINTED = f"({_TENTHS} // 10) || '.' || ({_TENTHS} % 10)"
_UNIT = _case("event_type", {r[0]: _text(r[2]) for r in READINGS})
_SUR = "(upper(substr(translate(lpad(CAST({k} AS VARCHAR), 7, '0'), '0123456789', 'abcdefghij'), 1, 1)) || substr(translate(lpad(CAST({k} AS VARCHAR), 7, '0'), '0123456789', 'abcdefghij'), 2))"
_KEY = "translate(lpad(CAST({k} AS VARCHAR), 7, '0'), '0123456789', 'abcdefghij')"
_LINKS = f"""
o AS (SELECT o_orderkey AS id, o_custkey AS c, CAST(left(o_orderpriority, 1) AS INTEGER) AS p, CAST(o_orderdate AS DATE) AS day, o_orderstatus FROM orders),
f AS (SELECT c, min(id) AS id, arg_min(p, id) AS fp, min(id) AS since FROM o WHERE p <= 3 GROUP BY c),
refs AS (SELECT c, printf('PT-%04d', row_number() OVER (ORDER BY id)) AS ref FROM f),
based AS (
  SELECT o.*, f.fp, CASE
    WHEN p = 5 THEN 'NO_IDENTITY_STATED'
    WHEN f.id IS NULL OR o.id < f.since THEN 'INSUFFICIENT_IDENTITY'
    WHEN o.id = f.since THEN 'NO_MATCH'
    WHEN p = 1 AND fp = 1 THEN 'MRN_EXACT'
    WHEN p = 2 AND fp = 2 THEN 'NAME_DOB_SEX'
    WHEN p IN (2, 3) AND fp IN (2, 3) THEN 'NAME_DOB'
    ELSE 'INSUFFICIENT_IDENTITY' END AS basis
  FROM o LEFT JOIN f ON f.c = o.c),
links AS (
  SELECT b.*, CASE WHEN basis = 'NO_MATCH' THEN 'NEW_PATIENT' WHEN basis IN ('MRN_EXACT', 'NAME_DOB_SEX', 'NAME_DOB') THEN 'LINKED' ELSE 'NEEDS_REVIEW' END AS status,
    CASE WHEN basis IN ('NO_MATCH', 'MRN_EXACT', 'NAME_DOB_SEX', 'NAME_DOB') THEN ref END AS patient_ref,
    CASE WHEN basis = 'INSUFFICIENT_IDENTITY' AND f.id IS NOT NULL AND b.id > f.since THEN ref ELSE '' END AS candidates
  FROM based b LEFT JOIN refs USING (c) LEFT JOIN f ON f.c = b.c)"""

ORACLE_SQL = {
    "case_run_timeline": """
SELECT 'observation' AS kind, 'hemoglobin' AS title, CAST(o_orderdate AS DATE) AS date, count(*) AS n, count(DISTINCT o_custkey) AS patients FROM orders GROUP BY ALL
UNION ALL SELECT 'event', 'Repeat CBC', CAST(o_orderdate AS DATE), count(*), count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL""",
    "layout_observations": f"""
SELECT event_id AS page_id, {_case("event_type", {r[0]: _text(r[3]) for r in READINGS})} AS concept,
  CASE WHEN event_type = 'error' THEN 'UNRECOGNISED' WHEN event_id % 7 = 4 THEN 'CONTAINED' ELSE 'EXACT' END AS match,
  CAST({_TENTHS} / 10.0 AS DOUBLE) AS value, {_UNIT} AS unit, {_case("event_type", {"view": "'mass_per_volume'", "click": "'volume'", "signup": "'mass_per_volume'", "purchase": "'mass_per_volume'", "error": "'amount_per_volume'"})} AS dimension,
  CAST(CASE WHEN event_type = 'error' THEN 0.72 WHEN event_id % 7 = 4 THEN 0.86 WHEN event_id % 7 = 2 THEN 0.88 WHEN event_id % 7 = 3 THEN 0.92 ELSE 0.96 END AS DOUBLE) AS confidence,
  CASE WHEN event_id % 7 = 2 THEN 'COLUMN' ELSE 'ROW' END AS layout, CAST(ts AS DATE) AS obs_date, 'document' AS date_basis
FROM events""",
    "measure_spans": f"""
SELECT event_id AS page_id, CAST({_TENTHS} / 10.0 AS DOUBLE) AS value,
  {_PRINTED} || CASE event_id % 7 WHEN 2 THEN ' | ' WHEN 6 THEN chr(9) ELSE ' ' END || {_UNIT} AS words,
  CASE WHEN event_id % 7 = 3 THEN 'L' END AS flag,
  CASE event_id % 7 WHEN 0 THEN '(1.0-9.5)' WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 'Ref: 1.0-9.5' ELSE '1.0-9.5' END AS reference_range
FROM events""",
    "release_measurements": """
SELECT c_custkey AS page_id, 'Index A' AS label, c_custkey + 0.5::DOUBLE AS value, '[' || lower(substr(n_name, 1, 3)) || n_nationkey || ']' || CASE WHEN c_custkey % 2 = 0 THEN '/L' ELSE '' END AS unit_canonical,
  lower(r_name) || CASE WHEN c_custkey % 2 = 0 THEN '_per_volume' ELSE '' END AS dimension, '(1.0-9.5)' AS reference_range
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "unit_kinds": f"""
WITH u(k, unit, kind, plausible, alike, factor) AS (VALUES
  (0, 'g/dL', 'mass_per_volume', true, true, 10.0), (1, 'mg/dL', 'mass_per_volume', true, true, NULL), (2, 'mmol/L', 'amount_per_volume', true, false, NULL), (3, 'fL', 'volume', true, false, NULL),
  (4, '10*9/L', 'count_per_volume', true, false, NULL), (5, '10*3/uL', 'count_per_volume', true, false, NULL), (6, '/min', 'count_per_time', true, false, NULL), (7, 'meq/L', 'amount_per_volume', true, false, NULL),
  (8, 'g/dL', 'mass_per_volume', true, true, 10.0), (9, '%', 'fraction', true, false, NULL), (10, 'ng/mL', 'mass_per_volume', true, true, NULL), (11, '/min', 'count_per_time', false, false, NULL), (12, 'am', 'length', false, false, NULL))
SELECT p_partkey, unit, kind, plausible, alike AS like_g_per_l, round(CAST(p_size AS DOUBLE) * CAST(factor AS DOUBLE), 6) AS in_g_per_l FROM part JOIN u ON k = p_partkey % {len(UNITS)}""",
    "note_claims": f"""
SELECT o_orderkey AS page_id, {_case("o_orderpriority", {"1-URGENT": "'IRON_DEFICIENCY'", "2-HIGH": "'ANEMIA_STABLE'", "3-MEDIUM": "'NO_ACUTE_FINDING'"})} AS claim_type,
  rtrim({_case("o_orderpriority", {k: _text(v) for k, v in NOTE_CLAIMS.items()})}, '. ') AS claim_text, CAST(0.95 AS DOUBLE) AS confidence, CAST(o_orderdate AS DATE) AS claim_date
FROM orders WHERE o_orderpriority < '4'""",
    "note_medications": """
SELECT o_orderkey AS page_id, 'ferrous sulfate' AS drug_norm, floor(o_totalprice) AS dose, 'mg' AS unit, 'twice daily' AS frequency, 'oral' AS route,
  CASE o_orderstatus WHEN 'F' THEN 'STOPPED' ELSE 'ACTIVE' END AS status, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) AS record_date
FROM orders""",
    "note_findings": """
SELECT o_orderkey AS page_id, 'acute_infarct' AS concept, CASE o_orderstatus WHEN 'F' THEN 'ABSENT' ELSE 'PRESENT' END AS value_key, CASE o_orderstatus WHEN 'F' THEN 'no acute infarct' ELSE 'acute infarct' END AS surface_form
FROM orders WHERE o_orderstatus IN ('F', 'O')""",
    "note_references": "SELECT o_orderkey AS page_id, 'CT report' AS label, 'IMAGING_REPORT' AS kind FROM orders WHERE o_totalprice > 150000",
    "note_follow_ups": "SELECT o_orderkey AS page_id, 'Repeat CBC' AS label, 'repeat CBC in six weeks' AS detail, CAST(o_orderdate AS DATE) AS event_date FROM orders WHERE o_custkey % 2 = 0",
    "note_sections": f"""
SELECT o_orderkey AS page_id,
  concat_ws(chr(10), {_case("o_orderpriority", {k: _text(v) for k, v in NOTE_CLAIMS.items()}, "'Nothing further.'")}, CASE o_orderstatus WHEN 'F' THEN 'CT shows no acute infarct' WHEN 'O' THEN 'CT shows acute infarct' ELSE 'To exclude acute infarct' END,
    CASE WHEN o_totalprice > 150000 THEN 'see the CT' || chr(10) || 'report for findings.' ELSE 'No other study.' END, CASE WHEN o_custkey % 2 = 0 THEN 'Please repeat CBC in six weeks' ELSE 'No visit is planned' END) AS impression
FROM orders""",
    "note_lines": "SELECT o_orderkey AS page_id, CASE WHEN o_totalprice > 150000 THEN 11 ELSE 10 END AS n_lines, CASE WHEN o_totalprice > 150000 THEN 11 ELSE 10 END AS n_exact FROM orders",
    "note_classes": """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderpriority <> '5-LOW' THEN 'REFERRAL' WHEN o_orderstatus = 'F' THEN 'LAB_REPORT' ELSE 'PRESCRIPTION' END AS doc_class FROM orders""",
    "document_dates": """
SELECT o_orderkey,
  CAST(CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 5 = 4 THEN date_trunc('month', CAST(o_orderdate AS DATE)) ELSE CAST(o_orderdate AS DATE) END ELSE DATE '1990-01-02' END AS DATE) AS doc_date,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 5 = 4 THEN 'month' ELSE 'day' END AS precision, true AS labelled
FROM orders""",
    "attributed_dates": """
SELECT o_orderkey AS page_id, CASE WHEN o_orderpriority < '5' THEN CAST(o_orderdate AS DATE) ELSE DATE '2000-01-01' END AS obs_date,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'row' WHEN '3' THEN 'cited' WHEN '5' THEN 'document' ELSE 'attributed' END AS date_basis
FROM orders""",
    "registry_assertions": f"""
SELECT c_custkey AS document_id, array_to_string(list_sort(['jose', {_KEY.format(k="c_custkey")}]), ' ') AS name_key, DATE '1930-01-01' + CAST(c_custkey AS INTEGER) AS dob,
  CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, 'AB' || c_custkey AS mrn
FROM customer""",
    "registry_participants": f"""
WITH r AS (SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS seg, n_name[1] || lower(n_name[2:]) AS nat, {_SUR.format(k="n_nationkey")} AS sur FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey AS document_id, 'PERFORMING' AS role, 'Dr. ' || seg || ' Roe' AS raw_text, array_to_string(list_sort([lower(seg), 'roe']), ' ') AS name_key, nat || ' General Hospital' AS institution FROM r
UNION ALL
SELECT c_custkey, 'ORDERING', 'Dr. Ann ' || sur, array_to_string(list_sort(['ann', lower(sur)]), ' '), nat || ' General Hospital' FROM r""",
    "clinic_team": f"""
WITH r AS (SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS seg, n_name[1] || lower(n_name[2:]) AS nat, {_SUR.format(k="n_nationkey")} AS sur FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'Dr. ' || seg || ' Roe' AS display_name, nat || ' General Hospital' AS affiliation, 'PERFORMING' AS roles, count(*) AS documents FROM r GROUP BY seg, nat
UNION ALL
SELECT 'Dr. Ann ' || sur, NULL, 'ORDERING', count(*) FROM r GROUP BY sur""",
    "directory_counts": "SELECT 'case' AS case_id, count(DISTINCT c_nationkey) AS institutions, count(DISTINCT (c_nationkey, c_mktsegment)) + count(DISTINCT c_nationkey) AS clinicians FROM customer",
    "directory_pruned": f"""
WITH r AS (SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS seg, n_name[1] || lower(n_name[2:]) AS nat, {_SUR.format(k="n_nationkey")} AS sur FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < 0)
SELECT DISTINCT 'Dr. ' || seg || ' Roe' AS display_name, nat || ' General Hospital' AS affiliation FROM r UNION SELECT DISTINCT 'Dr. Ann ' || sur, NULL FROM r""",
    "registry_links": f"WITH {_LINKS} SELECT id AS document_id, status, basis, patient_ref, candidates FROM links",
    "registry_encounters": f"WITH {_LINKS} SELECT patient_ref, day AS occurred_on, CASE WHEN o_orderstatus <> 'P' THEN 'House ' || o_orderstatus END AS institution, count(*) AS documents FROM links WHERE patient_ref IS NOT NULL GROUP BY ALL",
    "registry_patients": f"""
WITH {_LINKS},
items AS (SELECT l_orderkey AS id, count(*) FILTER (l_returnflag = 'R') AS facts, count(*) FILTER (l_returnflag = 'A') AS claims, count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS medications FROM lineitem GROUP BY 1)
SELECT patient_ref, CASE WHEN any_value(fp) <> 1 THEN DATE '1930-01-01' + CAST(c AS INTEGER) END AS dob, CASE WHEN any_value(fp) = 2 THEN CASE WHEN c % 2 = 0 THEN 'F' ELSE 'M' END END AS sex, CASE WHEN any_value(fp) = 1 THEN 'M' || c END AS mrn,
  count(*) AS documents, CAST(coalesce(sum(facts), 0) AS BIGINT) AS facts, CAST(coalesce(sum(claims), 0) AS BIGINT) AS claims, CAST(coalesce(sum(medications), 0) AS BIGINT) AS medications
FROM links LEFT JOIN items USING (id) WHERE patient_ref IS NOT NULL GROUP BY patient_ref, c""",
    "registry_review": f"WITH {_LINKS} SELECT basis, count(*) AS n, count(*) FILTER (p <= 4) AS named, count(*) FILTER (p = 1) AS numbered FROM links WHERE status = 'NEEDS_REVIEW' GROUP BY basis",
}
