"""Queries of the composites, records and listings on the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import terms
from ..operators import audit, claims, conflicts, episodes, records, views
from ..sources import ingest
from . import catalog_sql as q
from . import standins as s

#: claim type, concept, look-back in days, polarity that supports it; and classes of value with theirs
STATUS_RULES = (("signup", "view", 5, True), ("purchase", "click", 4, False))
POLARITY = (("view", "HIGH", True), ("view", "LOW", False), ("click", "HIGH", True), ("click", "MID", False), ("click", "LOW", None))
EXPECTED = (("purchase", 7, "click"), ("signup", 3, "error"))


def _units(spark, d):
    """Facts with a unit by their class of value, a date precision and words."""
    f = s.facts(spark, d)
    return f.withColumns({"unit": F.when(F.col("fact_id") % 3 == 0, "mg").otherwise("g"), "date_precision": F.when(F.col("fact_id") % 10 == 0, "month").otherwise("day"), "value": F.floor(F.col("value") / 5) * 5.0, "value_text": F.lit(None).cast("string"), "page_number": F.lit(1), "source_text": F.col("value_key")})


def _record_claims(spark, d):
    """Signups, purchases and errors as claims that carry their own rules."""
    c = s.claims(spark, d)
    of = lambda **k: F.when(F.col("claim_type") == "signup", F.lit(k["signup"])).when(F.col("claim_type") == "purchase", F.lit(k["purchase"])).otherwise(F.lit(k["error"]))
    support = F.when(F.col("claim_type") == "signup", F.array(F.lit("view"), F.lit("click"))).otherwise(F.array().cast("array<string>"))
    rule = of(signup="MISSING_SUPPORT", purchase="MISSING_FOLLOWUP", error="MISSING_SOURCE")
    return c.withColumns({"support": support, "gap_rule": rule, "lookback_days": F.when(F.col("claim_id") % 2 == 0, 3), "expected_concept": of(signup=None, purchase="error", error=None), "referenced_document": F.when(F.col("claim_type") == "error", F.concat(F.lit("Page "), (F.col("claim_id") % 7).cast("string"))), "claim_text": F.col("claim_type")})


def _documents(spark, d):
    """A document for each subject and day with an event."""
    f = s.facts(spark, d).where("concept = 'view'")
    return f.groupBy("subject", F.col("document_id").alias("document_id")).agg(F.max("obs_date").alias("doc_date")).withColumns({"kind": F.lit("NOTE"), "filename": F.concat(F.lit("page "), (F.col("document_id") % 5).cast("string"), F.lit(".txt"))})


def claim_polarity(spark, d):
    rules = spark.createDataFrame(list(STATUS_RULES), "claim_type string, concept string, lookback_days int, wants boolean")
    polarity = spark.createDataFrame(list(POLARITY), "concept string, value_key string, positive boolean")
    found = claims.status_evidence(s.claims(spark, d), rules, polarity, s.facts(spark, d))
    return found.groupBy("claim_id").agg(F.count_if("supports").alias("n_support"), F.count_if(~F.col("supports")).alias("n_contradict"))


def reference_terms(spark, d):
    """Citations of studies between a customer's orders: kind, term of the label and date decide."""
    o = s.table(spark, d, "orders")
    study = F.element_at(F.array(F.lit("ct"), F.lit("mri"), F.lit("xray")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    day = F.to_date("o_orderdate")
    refs = o.select(F.col("o_orderkey").alias("ref_id"), F.col("o_custkey").alias("subject"), F.lit("SCAN").alias("kind"), F.concat(F.upper(F.element_at(F.array(F.lit("ct"), F.lit("mri"), F.lit("xray")), (F.col("o_orderkey") % 3 + 1).cast("int"))), F.lit(" report")).alias("label"), F.col("o_orderkey").alias("citing_doc"), day.alias("citing_date"))
    docs = o.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("subject"), F.when(F.col("o_orderstatus") == "P", "NOTE").otherwise("SCAN").alias("kind"), day.alias("doc_date"), F.concat(F.lit("file_"), study, F.lit(".txt")).alias("filename"), F.lit("first lines").alias("head"), F.col("o_orderkey").alias("ordinal"))
    return audit.resolve_references(refs, docs, reach_days=200).select("ref_id", "document_id", F.col("days_apart").cast("long").alias("days_apart"), "outcome")


def medication_gaps(spark, d):
    """Latest entries of items that a list of the subject lacks."""
    e = s.facts(spark, d)
    own = F.coalesce("subject", F.lit(0)) * 1000
    meds = e.select("subject", F.col("fact_id").alias("entry_id"), F.col("concept").alias("item"), F.col("obs_date").alias("record_date"), F.when(F.col("value_key") == "LOW", "STOPPED").otherwise("ACTIVE").alias("status"), F.lit(None).cast("date").alias("stop_date"), (own + F.col("document_id")).alias("document_id"), F.when(F.col("document_id") % 4 == 0, "MEDICATION_LIST").otherwise("NOTE").alias("doc_type"))
    return audit.list_conflicts_grouped(meds).select("subject", "list_id", "item", "implicated_id", "n_entries")


def followup_gaps(spark, d):
    e = s.facts(spark, d)
    events = e.where(F.col("concept").isin("signup", "purchase")).select(F.col("fact_id").alias("event_id"), "subject", F.col("concept").alias("label"), F.col("obs_date").alias("event_date"))
    docs = e.select("subject", F.col("concept").alias("kind"), F.col("obs_date").alias("doc_date"))
    expected = spark.createDataFrame(list(EXPECTED), "label string, interval_days int, kind string")
    return audit.followup_gaps(events, docs, expected)


def record_conflicts(spark, d):
    return audit.record_numeric_conflicts(_units(spark, d), s.rules(spark)).select("subject", "concept", "left_id", "right_id", "delta", "episode_start", "episode_end", "materiality_basis", "status")


def record_changes(spark, d):
    return audit.record_changes(_units(spark, d), s.rules(spark))


def record_duplicates(spark, d):
    return records.restated(_units(spark, d))


def record_located(spark, d):
    return audit.located(_record_claims(spark, d).where("size(support) > 0"), s.facts(spark, d))


def record_gaps(spark, d):
    return audit.record_gaps(_record_claims(spark, d), s.facts(spark, d), _documents(spark, d))


def record_metrics(spark, d):
    facts = _units(spark, d)
    docs = s.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "REQUIRES_REVIEW").otherwise("PROCESSED").alias("processing_status"))
    traced = facts.withColumn("document_id", F.when(F.col("fact_id") % 9 != 0, F.col("document_id")))
    return records.record_metrics(docs, record_duplicates(spark, d), record_gaps(spark, d), facts=traced)


def patient_groups(spark, d):
    """Evidence rows by the patient of their document; unresolved documents are one group."""
    items = s.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.lit(None).cast("long").alias("subject"), "l_quantity")
    links = s.table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("patient_ref"))
    return records.to_patients(items, links).groupBy("subject").agg(F.count("*").alias("n_items"), F.round(F.sum("l_quantity"), 3).alias("quantity"))


def provenance_rows(spark, d):
    """Facts that can be traced to source, document and page."""
    x, o = s.table(spark, d, "lineitem"), s.table(spark, d, "orders")
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    facts = x.groupBy(key.alias("fact_id")).agg(F.max(F.when(F.col("l_returnflag") != "N", key)).alias("source_id"), F.lit(1).alias("document_id"))
    sources = x.where("l_returnflag <> 'N'").select(key.alias("source_id"), F.col("l_orderkey").alias("document_id"), F.lit(1).alias("page_number"), F.lit(0).alias("char_start"), F.lit(5).alias("char_end")).distinct()
    docs = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("filename"))
    pages = o.select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("page_number"), F.lit("text").alias("text"))
    return records.with_sources(facts, sources, docs, pages).select("fact_id", "document_id", "filename", "page_text")


def display_text(spark, d):
    """What orders' totals look like in six digits, and labels of their classes."""
    o = s.table(spark, d, "orders")
    rows = o.select("o_orderkey", records.summary_text(F.col("o_totalprice") * 100, F.lit("USD"), F.lit("")).alias("stated"), F.lower(F.regexp_replace("o_orderpriority", "^.-", "")).alias("concept"))
    names = spark.createDataFrame([("urgent", "At once")], "concept string, label string")
    return records.with_labels(rows, names).select("o_orderkey", "stated", "label")


def document_heads(spark, d):
    """Place of each fact in its subject's order, for the first three of each document."""
    f = s.facts(spark, d).withColumn("display_id", F.format_string("F-%03d", "fact_id"))
    return records.placed(f, ["document_id"], records.fact_order()).where("place <= 3").select("document_id", "fact_id", "place")


def case_list(spark, d):
    """Nations as cases, orders as runs; counts of customers and suppliers."""
    n, c, p, o = (s.table(spark, d, t) for t in ("nation", "customer", "supplier", "orders"))
    cases = n.select(F.col("n_nationkey").cast("long").alias("case_id"))
    runs = o.select(F.pmod("o_custkey", F.lit(40)).alias("case_id"), F.when(F.col("o_orderstatus") == "P", "COMPLETE").otherwise("FAILED").alias("status"))
    of = lambda df, k: df.select(F.col(k).cast("long").alias("case_id"))
    return records.case_list(cases, runs, customers=of(c, "c_nationkey"), suppliers=of(p.where("s_acctbal > 0"), "s_nationkey"))


def newest_runs(spark, d):
    runs = s.table(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("run_id"), F.to_date("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("status"))
    return records.newest_run(runs)


def coding_counts(spark, d):
    rows = s.table(spark, d, "part").select(F.col("p_brand").alias("system"), (F.col("p_size") > 20).alias("assertable"))
    return records.codings_by_system(rows)


def document_fact_counts(spark, d):
    return records.documents_with_facts(s.table(spark, d, "orders").select(F.col("o_orderkey").alias("document_id")), s.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id")))


def stage_sizes(spark, d):
    p = s.table(spark, d, "part")
    return records.stage_sizes(s.facts(spark, d), p.select(F.col("p_type").alias("doc_type")), p.select(F.col("p_name").alias("drug_norm")))


def graph_nodes(spark, d):
    """Edges of changes, and a node for what is missing."""
    f = s.facts(spark, d)
    gaps_ = record_gaps(spark, d).where("not_located is not null").select(F.lit("MISSING_SUPPORT").alias("rel_type"), F.col("about_id").alias("from_id"), F.col("not_located").alias("to_id"), F.lit("concept").alias("to_type"))
    contains = f.select(F.concat(F.lit("doc"), F.col("document_id").cast("string")).alias("from_id"), F.col("fact_id").alias("to_id"))
    nodes, edges = audit.graph({"fact": f.select(F.col("fact_id").alias("node_id"))}, contains, gaps_)
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.col("rel_type").alias("kind")).agg(F.count("*").alias("n")))


def failed_items(spark, d):
    """Failed files of each job, in order, by their number."""
    o = s.table(spark, d, "orders")
    ledger = o.select(F.col("o_orderpriority").alias("job_id"), F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderstatus") == "P", "FAILED").otherwise("INGESTED").alias("status"))
    return ingest.failed_items(ledger, limit=20)


def job_chunks(spark, d):
    """What is pending of each job, in chunks of 200."""
    o = s.table(spark, d, "orders")
    manifest = o.select(F.col("o_orderpriority").alias("job_id"), F.col("o_orderkey").alias("ordinal"), F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise("INGESTED").alias("status"))
    return ingest.chunks(manifest).groupBy("job_id", "chunk").agg(F.count("*").alias("n"), F.min("ordinal").alias("first_ordinal"))


def match_kinds(spark, d):
    """Kinds of match that vocabularies of four kinds assert for a phrase."""
    p = s.table(spark, d, "part")
    rows = p.select("p_partkey", F.col("p_name").alias("phrase"), F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" x"))).alias("display"), F.element_at(F.array(*[F.lit(k) for k in terms.PROVIDERS]), (F.col("p_partkey") % 4 + 1).cast("int")).alias("system"), (F.col("p_size") > 25).alias("by_name"))
    kind = terms.match_kind(F.col("system"), F.col("phrase"), F.col("display"), F.col("by_name"))
    return rows.select("p_partkey", kind.alias("match_kind"), terms.assertable(kind).alias("assertable"))


def cache_lookups(spark, d):
    """Phrases of parts against a memory of what was found and what wasn't; the rest is asked."""
    p = s.table(spark, d, "part")
    asked = p.select(F.lit("CORE").alias("provider"), F.lit("term").alias("kind"), F.col("p_name").alias("phrase"))
    cache = p.where("p_size > 30").select(F.lit("CORE").alias("provider"), F.lit("term").alias("kind"), terms.squeeze(F.col("p_name")).alias("phrase"), F.when(F.col("p_size") > 40, F.col("p_brand")).alias("code")).groupBy("provider", "kind", "phrase").agg(F.max("code").alias("code"))
    known, unknown = terms.split_by_cache(asked, cache)
    return known.select("phrase", F.when(F.col("code").isNull(), "MISS_KNOWN").otherwise("HIT").alias("state")).unionByName(unknown.select("phrase", F.lit("ASK").alias("state")))


_ALL = (
    claim_polarity, reference_terms, medication_gaps, followup_gaps, record_conflicts, record_changes, record_duplicates, record_located, record_gaps, record_metrics, patient_groups, provenance_rows, display_text,
    document_heads, case_list, newest_runs, coding_counts, document_fact_counts, stage_sizes, graph_nodes, failed_items, job_chunks, match_kinds, cache_lookups,
)
QUERIES = {f.__name__: f for f in _ALL}

# --- SQL ------------------------------------------------------------------------------
_UNITS = """u AS (
  SELECT * EXCLUDE (value), CAST(floor(value / 5) * 5.0 AS DOUBLE) AS value, CASE WHEN fact_id % 3 = 0 THEN 'mg' ELSE 'g' END AS unit, CASE WHEN fact_id % 10 = 0 THEN 'month' ELSE 'day' END AS date_precision FROM facts)"""
_RECORD_CLAIMS = """rc AS (
  SELECT fact_id AS claim_id, subject, concept AS claim_type, obs_date AS claim_date, CASE WHEN fact_id % 2 = 0 THEN 3 END AS lookback_days FROM facts WHERE concept IN ('signup', 'purchase', 'error')),
asked AS (SELECT rc.*, unnest(['view', 'click']) AS concept FROM rc WHERE claim_type = 'signup'),
loc AS (
  SELECT a.claim_id, a.concept, coalesce(bool_or(b >= 0 AND (lookback_days IS NULL OR b <= lookback_days)), false) AS in_time, coalesce(bool_or(b < 0), false) AS later, min(fact_id) FILTER (b >= 0 AND (lookback_days IS NULL OR b <= lookback_days)) AS first_fact
  FROM (SELECT a.*, f.fact_id, date_diff('day', f.obs_date, a.claim_date) AS b FROM asked a LEFT JOIN facts f ON f.subject IS NOT DISTINCT FROM a.subject AND f.concept = a.concept) a GROUP BY ALL)"""
_RECORD_GAPS = f"""{_RECORD_CLAIMS},
rg AS (
  SELECT claim_id AS about_id, 'MISSING_SUPPORTING_TEST' AS gap_type, string_agg(concept, ',' ORDER BY concept) AS not_located FROM loc WHERE NOT in_time GROUP BY claim_id
  UNION ALL
  SELECT claim_id, 'MISSING_REFERENCED_DOCUMENT', 'Page ' || (claim_id % 7) FROM rc WHERE claim_type = 'error'
    AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.concept = 'view' AND f.subject IS NOT DISTINCT FROM rc.subject AND f.document_id % 5 = rc.claim_id % 7)
  UNION ALL
  SELECT claim_id, 'MISSING_FOLLOWUP', 'error' FROM rc WHERE claim_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.concept = 'error' AND f.subject IS NOT DISTINCT FROM rc.subject AND f.obs_date > rc.claim_date))"""
_RESTATED = "rd AS (SELECT subject, concept, obs_date, fact_id AS other_id, min(fact_id) OVER (PARTITION BY subject, concept, obs_date, value, unit) AS primary_id FROM u QUALIFY fact_id <> primary_id)"

ORACLE_SQL = {
    "claim_polarity": f"""
WITH {q.FACTS},
rule(claim_type, concept, days, wants) AS (VALUES {", ".join(f"('{a}', '{b}', {n}, {str(w).lower()})" for a, b, n, w in STATUS_RULES)}),
pol(concept, value_key, positive) AS (VALUES {", ".join(f"('{a}', '{b}', {'NULL' if p is None else str(p).lower()})" for a, b, p in POLARITY)})
SELECT c.fact_id AS claim_id, count(*) FILTER (positive = wants) AS n_support, count(*) FILTER (positive <> wants) AS n_contradict
FROM facts c JOIN rule r ON r.claim_type = c.concept JOIN facts f ON f.subject IS NOT DISTINCT FROM c.subject AND f.concept = r.concept AND date_diff('day', f.obs_date, c.obs_date) BETWEEN 0 AND days
JOIN pol p ON p.concept = f.concept AND p.value_key = f.value_key AND positive IS NOT NULL GROUP BY 1""",
    "reference_terms": """
WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, ['ct', 'mri', 'xray'][o_orderkey % 3 + 1] AS study, CAST(o_orderdate AS DATE) AS day, o_orderstatus FROM orders),
met AS (
  SELECT r.id AS ref_id, d.id AS document_id, abs(date_diff('day', r.day, d.day)) AS days_apart, r.study = d.study AND abs(date_diff('day', r.day, d.day)) <= 200 AS fits
  FROM o r JOIN o d ON d.c = r.c AND d.id <> r.id AND d.o_orderstatus <> 'P'),
best AS (SELECT ref_id, arg_min(document_id, (days_apart, document_id)) FILTER (fits) AS document_id, min(days_apart) FILTER (fits) AS days_apart FROM met GROUP BY ref_id),
named AS (SELECT DISTINCT c, study FROM o)
SELECT o.id AS ref_id, b.document_id, b.days_apart, CASE WHEN b.document_id IS NOT NULL THEN 'RESOLVED' WHEN b.ref_id IS NULL THEN 'NAMED' ELSE 'MISSING' END AS outcome FROM o LEFT JOIN best b ON b.ref_id = o.id""",
    "medication_gaps": f"""
WITH {q.FACTS},
m AS (SELECT *, coalesce(subject, 0) * 1000 + document_id AS doc FROM facts),
lists AS (SELECT subject, doc, max(obs_date) AS list_date FROM m WHERE document_id % 4 = 0 GROUP BY ALL),
miss AS (
  SELECT m.subject, l.doc AS list_id, m.concept AS item, m.fact_id, m.obs_date FROM m JOIN lists l ON l.subject IS NOT DISTINCT FROM m.subject AND l.doc <> m.doc AND m.obs_date <= l.list_date
  WHERE m.value_key <> 'LOW' AND NOT EXISTS (SELECT 1 FROM m x WHERE x.doc = l.doc AND x.concept = m.concept))
SELECT subject, list_id, item, arg_max(fact_id, (obs_date, fact_id)) AS implicated_id, count(*) AS n_entries FROM miss GROUP BY ALL""",
    "followup_gaps": f"""
WITH {q.FACTS},
want(label, days, kind) AS (VALUES {", ".join(f"('{a}', {n}, '{k}')" for a, n, k in EXPECTED)}),
miss AS (
  SELECT e.subject, e.fact_id, e.obs_date, e.obs_date + days AS due_date, label, kind FROM facts e JOIN want ON label = e.concept
  WHERE e.obs_date + days <= (SELECT max(obs_date) FROM facts) AND NOT EXISTS (SELECT 1 FROM facts x WHERE x.subject IS NOT DISTINCT FROM e.subject AND x.concept = kind AND x.obs_date > e.obs_date))
SELECT subject, arg_min(fact_id, (obs_date, fact_id)) AS about_id, label AS title, arg_min(due_date, (obs_date, fact_id)) AS due_date, 'MISSING_FOLLOW_UP' AS gap_type FROM miss GROUP BY subject, label, kind""",
    "record_changes": f"""
WITH {q.FACTS}, {q.RULES}, {_UNITS},
one AS (SELECT subject AS s, concept AS c, obs_date AS o FROM u GROUP BY ALL HAVING count(DISTINCT (value, unit)) = 1),
reps AS (SELECT u.* FROM u JOIN one ON s IS NOT DISTINCT FROM subject AND c = concept AND o = obs_date QUALIFY row_number() OVER (PARTITION BY subject, concept, obs_date ORDER BY confidence DESC, fact_id DESC) = 1),
steps AS (
  SELECT p.subject, p.concept, lag(fact_id) OVER w AS from_id, fact_id AS to_id, lag(obs_date) OVER w AS from_date, obs_date AS to_date, lag(value) OVER w AS from_value, value AS to_value, lag(unit) OVER w AS from_unit, unit, window_days
  FROM reps p JOIN rules r USING (concept) WINDOW w AS (PARTITION BY p.subject, p.concept ORDER BY obs_date))
SELECT subject, concept, from_id, to_id, from_date, to_date, round(to_value - from_value, 6) AS delta, CASE WHEN to_value > from_value THEN 'INCREASED' ELSE 'DECREASED' END AS direction
FROM steps WHERE from_id IS NOT NULL AND from_value <> to_value AND from_unit = unit AND date_diff('day', from_date, to_date) > window_days""",
    "record_duplicates": f"WITH {q.FACTS}, {_UNITS}, {_RESTATED} SELECT * FROM rd",
    "record_located": f"WITH {q.FACTS}, {_RECORD_CLAIMS} SELECT * FROM loc",
    "record_gaps": f"WITH {q.FACTS}, {_RECORD_GAPS} SELECT * FROM rg",
    "record_metrics": f"""
WITH {q.FACTS}, {_UNITS}, {_RECORD_GAPS}, {_RESTATED},
n AS (SELECT (SELECT count(*) FROM orders) AS documents, (SELECT count(*) FROM facts) AS facts, (SELECT count(*) FROM rd) AS conflicts, (SELECT count(*) FROM rg) AS gaps, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS review, (SELECT count(*) FROM facts WHERE fact_id % 9 <> 0 AND document_id IS NOT NULL) AS good)
SELECT documents, facts, conflicts, gaps, conflicts + gaps + review AS unresolved, CAST(floor(100.0 * good / facts + 0.5) AS BIGINT) AS traceability FROM n""",
    "patient_groups": "SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS subject, count(*) AS n_items, round(sum(l_quantity), 3) AS quantity FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1",
    "provenance_rows": "SELECT DISTINCT l_orderkey * 10 + l_linenumber AS fact_id, l_orderkey AS document_id, o_orderpriority AS filename, 'text' AS page_text FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag <> 'N' AND o_orderstatus <> 'P'",
    "document_heads": f"WITH {q.FACTS} SELECT document_id, fact_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY obs_date, printf('F-%03d', fact_id), fact_id) AS INTEGER) AS place FROM facts QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY obs_date, printf('F-%03d', fact_id), fact_id) <= 3",
    "case_list": """
SELECT CAST(n_nationkey AS BIGINT) AS case_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0) AS suppliers,
  EXISTS (SELECT 1 FROM orders WHERE o_custkey % 40 = n_nationkey AND o_orderstatus = 'P') AS processed
FROM nation""",
    "newest_runs": "SELECT o_custkey AS case_id, max(o_orderkey) AS run_id, any_value(day) AS started_at, arg_max(o_orderstatus, o_orderkey) AS status FROM (SELECT *, CAST(o_orderdate AS DATE) AS day, max(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey) AS last FROM orders) WHERE day = last GROUP BY 1",
    "coding_counts": "SELECT p_brand AS system, count(*) AS total, count(*) FILTER (p_size > 20) AS assertable, count(*) FILTER (p_size <= 20) AS approximate, CAST(row_number() OVER (ORDER BY count(*) DESC, p_brand) AS INTEGER) AS place FROM part GROUP BY 1",
    "document_fact_counts": "SELECT o_orderkey AS document_id, count(l_orderkey) AS n_facts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "stage_sizes": "SELECT 'CLASSIFY' AS stage, count(DISTINCT p_type) AS distinct_values FROM part UNION ALL SELECT 'NORMALIZE', count(DISTINCT event_type) FROM events UNION ALL SELECT 'RESOLVE_ENTITIES', count(DISTINCT p_name) FROM part",
    "graph_nodes": f"""
WITH {q.FACTS}, {_RECORD_GAPS}
SELECT 'fact' AS kind, count(*) AS n FROM facts UNION ALL SELECT 'absent_evidence', count(DISTINCT not_located) FROM rg UNION ALL SELECT 'MISSING_SUPPORT', count(*) FROM rg""",
    "failed_items": "SELECT o_orderpriority AS job_id, o_orderkey AS ordinal, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS INTEGER) AS place FROM orders WHERE o_orderstatus = 'P' QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 20",
    "job_chunks": "SELECT job_id, chunk, count(*) AS n, min(o_orderkey) AS first_ordinal FROM (SELECT o_orderpriority AS job_id, o_orderkey, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 200 AS chunk FROM orders WHERE o_orderstatus = 'O') GROUP BY ALL",
    "match_kinds": """
WITH k AS (SELECT p_partkey, p_partkey % 4 AS s, p_size % 2 = 0 AS same, p_size > 25 AS by_name FROM part),
m AS (SELECT p_partkey, CASE WHEN s = 0 THEN CASE WHEN NOT by_name THEN 'APPROXIMATE' WHEN same THEN 'EXACT' ELSE 'SYNONYM' END WHEN s = 3 THEN CASE WHEN by_name AND same THEN 'EXACT' ELSE 'APPROXIMATE' END WHEN same THEN 'EXACT' ELSE 'APPROXIMATE' END AS match_kind FROM k)
SELECT p_partkey, match_kind, match_kind <> 'APPROXIMATE' AS assertable FROM m""",
    "cache_lookups": """
WITH c AS (SELECT trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS phrase, max(CASE WHEN p_size > 40 THEN p_brand END) AS code FROM part WHERE p_size > 30 GROUP BY 1)
SELECT a.phrase, CASE WHEN c.phrase IS NULL THEN 'ASK' WHEN code IS NULL THEN 'MISS_KNOWN' ELSE 'HIT' END AS state FROM (SELECT DISTINCT trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS phrase FROM part) a LEFT JOIN c USING (phrase)""",
}
