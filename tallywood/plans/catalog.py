"""The registered queries of the engine and their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import identity, terms, text, units
from ..operators import changes, claims, conflicts, episodes, extraction, gaps, views
from ..sources import ingest
from ..sources.tables import shared_folder
from ..streaming.conflicts import streaming_conflicts
from . import audits, notes
from . import catalog_sql as sql
from . import standins as s

#: Cue phrases of document classes in the stand-in corpus.
CUES = {"LICENCE": ("licensed under", "copyright"), "TABLE": (" | ",), "SHOUT": ("!!",)}
MIXED = ("Report date: 14 March 2024.", "Seen Mar 3, 2024 again", "on 2024-02-30 then 2024-02-28", "05/04/2023", "June 2022", "no date")


def episode_clusters(spark, d):
    return episodes.episodes(episodes.with_rules(s.facts(spark, d), s.rules(spark))).select("subject", "concept", "fact_id", "obs_date", F.col("episode").cast("long").alias("episode"))


def materiality_pairs(spark, d):
    return conflicts.materiality_pairs(s.facts(spark, d), s.rules(spark)).withColumn("episode", F.col("episode").cast("long"))


def numeric_conflicts(spark, d):
    return conflicts.numeric_conflicts(s.facts(spark, d), s.rules(spark))


def stream_conflicts(spark, d):
    """The conflicts of episodes that a replay of the events as a stream has closed by its end, three days of lateness allowed."""
    events = spark.readStream.schema(s.table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")  # a stream takes a folder or a pattern
    facts = s.facts_of(events).withColumn("obs_time", F.to_timestamp("obs_date"))
    path = os.path.join(shared_folder(spark), f"stream-{uuid.uuid4().hex}")
    found = streaming_conflicts(facts, s.rules(spark), "3 days")
    found.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/out")


def conflict_edges(spark, d):
    return conflicts.cross_members(episodes.episodes(episodes.with_rules(s.facts(spark, d), s.rules(spark)))).select("left_id", "right_id")


def status_conflicts(spark, d):
    out = conflicts.status_conflicts(s.facts(spark, d), s.rules(spark))
    return out.withColumn("episode", F.col("episode").cast("long"))


def changes_adjacent(spark, d):
    return changes.adjacent_changes(changes.representatives(s.facts(spark, d)), s.rules(spark))


def changes_unambiguous(spark, d):
    return changes.adjacent_changes(changes.unambiguous(s.facts(spark, d)), s.rules(spark))


def duplicates(spark, d):
    coarse = s.facts(spark, d).withColumn("value", F.floor("value").cast("double"))
    return changes.duplicates(coarse)


def series_engine(spark, d):
    return changes.series(s.facts(spark, d))


def series_view(spark, d):
    return changes.series_view(s.facts(spark, d).withColumn("value", F.floor(F.col("value") / 10).cast("double")))


def med_list_antijoin(spark, d):
    e = s.facts(spark, d)
    entries = e.where("concept <> 'view'").select("subject", F.col("fact_id").alias("entry_id"), F.col("concept").alias("item"), F.col("obs_date").alias("record_date"), F.lit("ACTIVE").alias("status"), F.lit(None).cast("date").alias("stop_date"), "document_id")
    lists = e.where("concept = 'view'").groupBy("subject", F.col("document_id").alias("list_id")).agg(F.max("obs_date").alias("list_date"))
    items = e.select("subject", F.col("document_id").alias("list_id"), F.col("concept").alias("item")).distinct()
    own = F.coalesce("subject", F.lit(0)) * 1000
    keyed = lambda x: x.withColumn("list_id", own + F.col("list_id"))
    entries = entries.withColumn("document_id", own + F.col("document_id"))
    return conflicts.list_conflicts(entries, keyed(lists), keyed(items).drop("subject")).select("subject", "list_id", "entry_id", "item")


def claim_status(spark, d):
    return claims.claim_status(s.claims(spark, d), s.requirements(spark), s.facts(spark, d))


def claim_out_of_window(spark, d):
    return claims.out_of_window(s.claims(spark, d), s.requirements(spark), s.facts(spark, d))


def claim_first_support(spark, d):
    return claims.first_support(s.claims(spark, d), s.requirements(spark), s.facts(spark, d))


def gap_unsupported(spark, d):
    return claims.unsupported(claim_status(spark, d), claim_out_of_window(spark, d))


def reference_nearest(spark, d):
    return gaps.nearest_documents(s.citations(spark, d), s.shipments(spark, d))


def reference_unique_match(spark, d):
    return gaps.unique_matches(s.citations(spark, d), s.shipments(spark, d))


def gap_missing_reference(spark, d):
    return gaps.missing_references(reference_nearest(spark, d))


def gap_missing_followup(spark, d):
    e = s.facts(spark, d)
    expected = e.where("concept = 'signup'").select(F.col("fact_id").alias("event_id"), "subject", F.lit("purchase").alias("kind"), F.col("obs_date").alias("event_date"), F.lit(7).alias("interval_days"))
    return gaps.missing_followups(expected, e.select("subject", F.col("concept").alias("kind"), F.col("obs_date").alias("doc_date")))


def _edges(spark, d):
    dup = duplicates(spark, d).select(F.col("other_id").alias("from_id"), F.col("primary_id").alias("to_id"))
    change = changes_adjacent(spark, d).select("from_id", "to_id")
    contain = s.facts(spark, d).select(F.concat(F.lit("doc"), F.col("document_id").cast("string")).alias("from_id"), F.col("fact_id").alias("to_id"))
    return views.edges(DUPLICATES=dup, CHANGED_TO=change, CONTAINS=contain)


def relationship_edges(spark, d):
    return _edges(spark, d)


def graph_edges_valid(spark, d):
    nodes = s.facts(spark, d).where("subject is not null").select(F.col("fact_id").cast("string").alias("node_id"))
    return views.valid_edges(_edges(spark, d), nodes)


def timeline_days(spark, d):
    return views.timeline(s.facts(spark, d), conflicts.material_members(s.facts(spark, d), s.rules(spark)))


def case_summary(spark, d):
    return views.summary(s.facts(spark, d))


def care_team(spark, d):
    c, n, r = (s.table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"], "left").join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"], "left")
    return rows.groupBy("n_name", "r_name").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("roles"), F.count_distinct("c_custkey").alias("n_members"))


def display_numbering(spark, d):
    return views.display_ids(s.facts(spark, d).select("subject", "fact_id", "obs_date", views.confidence_band(F.col("confidence")).alias("band")), "F", "obs_date", "fact_id", group="subject")


def content_dedupe(spark, d):
    docs = s.table(spark, d, "documents").select("source", "doc_id", F.sha2("text", 256).alias("sha256"))
    return ingest.content_dedupe(docs, "source", "sha256", "doc_id")


def raw_offsets(spark, d):
    turns = s.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    raw = ingest.raw_text(turns.select("conv_id", F.transform("t", lambda x: F.coalesce(x["text"], F.lit(""))).alias("pages")))
    return raw.select("conv_id", "text_sha256", F.col("char_count").cast("long").alias("char_count"), F.element_at("page_offsets", -1)["start"].cast("long").alias("last_start"), F.element_at("page_offsets", -1)["end"].cast("long").alias("last_end"), "status")


def classify_cues(spark, d):
    return s.table(spark, d, "documents").select("doc_id", text.classify(F.col("text"), CUES).alias("doc_class"))


def date_extract(spark, d):
    docs = s.table(spark, d, "documents")
    stated = F.element_at(F.array(*[F.lit(x) for x in MIXED]), (F.col("doc_id") % len(MIXED) + 1).cast("int"))
    return docs.select("doc_id", text.parse_date(F.concat(stated, F.lit(" "), F.coalesce("text", F.lit("")))).alias("doc_date"))


def measure_extract(spark, d):
    line = F.concat(F.lit("Hb "), (F.col("doc_id") % 17).cast("string"), F.lit(".5 g/dL; size "), F.col("n_chars").cast("string"), F.lit(" mm "), F.col("text"))
    pages = s.table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), line.alias("text"))
    found = extraction.measurements(extraction.lines(pages)).select(F.col("page_id").alias("doc_id"), "value", F.col("unit_canonical").alias("unit"))
    return found.groupBy("doc_id", "unit").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.round(F.sum(units.convert(F.col("value"), F.col("unit"), F.lit("g/L"))), 6).alias("in_g_per_l"))


def negation_filter(spark, d):
    docs = s.table(spark, d, "documents")
    return docs.select("doc_id", text.mentions(F.col("text"), "the").alias("mentioned"), text.negated(F.col("text"), "the", ("of", "no")).alias("negated"))


def term_search_tiers(spark, d):
    return terms.search(s.table(spark, d, "part").select(F.col("p_name").alias("query")), s.concepts(spark))


def identity_link_rules(spark, d):
    c = s.table(spark, d, "customer")
    key = identity.name_key(identity.fold(F.concat(F.lit("Dr. José "), F.col("c_mktsegment"))))
    stmts = c.select(F.col("c_custkey").alias("stmt_id"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("N"), (F.col("c_custkey") % 40).cast("string"))).alias("mrn"), key.alias("name_key"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey").cast("string")).alias("dob"))
    sup = s.table(spark, d, "supplier")
    seg = F.element_at(F.array(*[F.lit(x) for x in ("building", "household", "machinery")]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    registry = sup.select(F.col("s_suppkey").alias("ref"), F.concat(F.lit("N"), F.col("s_suppkey").cast("string")).alias("mrn"), F.array_join(F.array_sort(F.array(F.lit("jose"), seg)), " ").alias("name_key"), F.col("s_nationkey").cast("string").alias("dob"))
    return identity.link(stmts, registry)


def job_progress(spark, d):
    o = s.table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "F", "INGESTED").when(F.col("o_orderkey") % 7 == 0, "FAILED").otherwise("DUPLICATE")
    return ingest.progress(o.select(F.col("o_orderpriority").alias("job_id"), status.alias("status")))


def bulk_resume(spark, d):
    manifest = s.table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), "o_orderpriority")
    done = s.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("path"))
    return ingest.pending(manifest, done)


_ALL = (episode_clusters, materiality_pairs, numeric_conflicts, stream_conflicts, conflict_edges, status_conflicts, changes_adjacent, changes_unambiguous, duplicates, series_engine, series_view, med_list_antijoin, claim_status, claim_out_of_window, claim_first_support, gap_unsupported, reference_nearest, reference_unique_match, gap_missing_reference, gap_missing_followup, relationship_edges, graph_edges_valid, timeline_days, case_summary, care_team, display_numbering, content_dedupe, raw_offsets, classify_cues, date_extract, measure_extract, negation_filter, term_search_tiers, identity_link_rules, job_progress, bulk_resume)
QUERIES = {f.__name__: f for f in _ALL} | notes.QUERIES | audits.QUERIES

# --- SQL -----------------------------------------------------------------------------
_num = lambda x: "NULL" if x is None else f"CAST({x} AS DOUBLE)"
_RULES = sql.RULES
_REQ = "req(claim_type, concept, op, threshold, lookback_days) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {_num(t)}, {n})" for a, b, c, t, n in s.REQUIREMENTS) + ")"
_FACTS = sql.FACTS
_EPI = f"{_FACTS}, {_RULES}, lagged AS (SELECT f.*, r.abs_limit, r.rel_limit, CASE WHEN lag(obs_date) OVER w IS NULL OR date_diff('day', lag(obs_date) OVER w, obs_date) > window_days THEN 1 ELSE 0 END AS b FROM facts f JOIN rules r USING (concept) WINDOW w AS (PARTITION BY subject, f.concept ORDER BY obs_date, fact_id)), epi AS (SELECT *, CAST(sum(b) OVER (PARTITION BY subject, concept ORDER BY obs_date, fact_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM lagged)"
_MAT = "(abs(a.value - b.value) > 0 AND CASE WHEN a.abs_limit IS NULL AND a.rel_limit IS NULL THEN true ELSE coalesce(abs(a.value - b.value) >= a.abs_limit, false) OR coalesce(abs(a.value - b.value) / greatest(abs(a.value), abs(b.value), 1e-9) >= a.rel_limit, false) END)"
_PAIRS = f"pairs AS (SELECT a.subject, a.concept, a.episode, a.fact_id AS left_id, b.fact_id AS right_id, round(b.value - a.value, 6) AS delta FROM epi a JOIN epi b ON a.subject IS NOT DISTINCT FROM b.subject AND a.concept = b.concept AND a.episode = b.episode AND a.fact_id < b.fact_id AND a.document_id <> b.document_id WHERE {_MAT})"
_REPS = "reps AS (SELECT * FROM facts QUALIFY row_number() OVER (PARTITION BY subject, concept, obs_date ORDER BY confidence DESC, fact_id DESC) = 1)"


def _change(points: str) -> str:
    return f"steps AS (SELECT p.subject, p.concept, lag(fact_id) OVER w AS from_id, fact_id AS to_id, lag(obs_date) OVER w AS from_date, obs_date AS to_date, lag(value) OVER w AS from_value, value AS to_value, window_days FROM {points} p JOIN rules r USING (concept) WINDOW w AS (PARTITION BY p.subject, p.concept ORDER BY obs_date)), changed AS (SELECT subject, concept, from_id, to_id, from_date, to_date, round(to_value - from_value, 6) AS delta, CASE WHEN round(to_value - from_value, 6) > 0 THEN 'INCREASED' ELSE 'DECREASED' END AS direction FROM steps WHERE from_id IS NOT NULL AND from_value <> to_value AND date_diff('day', from_date, to_date) > window_days)"


_DUPS = "dups AS (SELECT subject, concept, obs_date, fact_id AS other_id, primary_id FROM (SELECT *, min(fact_id) OVER (PARTITION BY subject, concept, obs_date, floor(value)) AS primary_id FROM facts) WHERE fact_id <> primary_id)"
_CLAIMS = f"{_FACTS}, {_REQ}, claims AS (SELECT fact_id AS claim_id, subject, concept AS claim_type, obs_date AS claim_date FROM facts WHERE concept IN ('signup', 'purchase', 'error')), ev AS (SELECT c.claim_id, c.subject, r.concept, f.fact_id, f.obs_date, CASE WHEN date_diff('day', f.obs_date, c.claim_date) < 0 THEN 'after_claim' WHEN date_diff('day', f.obs_date, c.claim_date) > r.lookback_days THEN 'before_lookback' ELSE 'in_window' END AS place, CASE r.op WHEN 'lt' THEN f.value < r.threshold WHEN 'lte' THEN f.value <= r.threshold WHEN 'gt' THEN f.value > r.threshold ELSE f.value >= r.threshold END AS supports FROM claims c JOIN req r USING (claim_type) JOIN facts f ON f.subject IS NOT DISTINCT FROM c.subject AND f.concept = r.concept)"
_STATUS = "status AS (SELECT c.claim_id, c.subject, CASE WHEN c.claim_type NOT IN (SELECT claim_type FROM req) THEN 'NOT_ASSESSED' WHEN coalesce(x.k, 0) > 0 THEN 'CONTRADICTING_LOCATED' WHEN coalesce(x.n, 0) > 0 THEN 'SUPPORTING_LOCATED' ELSE 'NO_LOCATED_EVIDENCE' END AS evidence_status, coalesce(x.n, 0) AS n_support, coalesce(x.k, 0) AS n_contradict FROM claims c LEFT JOIN (SELECT claim_id, count(*) FILTER (supports) AS n, count(*) FILTER (NOT supports) AS k FROM ev WHERE place = 'in_window' GROUP BY claim_id) x USING (claim_id))"
_OUT = "outside AS (SELECT claim_id, concept, place, count(*) AS n_facts, min(fact_id) AS first_fact FROM ev WHERE place <> 'in_window' GROUP BY ALL)"
_REFS = "docs AS (SELECT l_orderkey AS subject, CAST(l_linenumber AS BIGINT) AS document_id, CAST(min(l_shipdate) AS DATE) AS doc_date FROM lineitem GROUP BY ALL), met AS (SELECT o_orderkey AS ref_id, document_id, abs(date_diff('day', CAST(o_orderdate AS DATE), doc_date)) AS days_apart FROM orders JOIN docs ON subject = o_orderkey WHERE abs(date_diff('day', CAST(o_orderdate AS DATE), doc_date)) <= 45), near AS (SELECT o.o_orderkey AS ref_id, m.document_id, CAST(m.days_apart AS INTEGER) AS days_apart FROM orders o LEFT JOIN (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY days_apart, document_id) = 1) m ON m.ref_id = o.o_orderkey)"
_EDGES = f"{_FACTS}, {_RULES}, {_REPS}, {_change('reps')}, {_DUPS}, edges AS (SELECT 'DUPLICATES' AS rel_type, CAST(other_id AS VARCHAR) AS from_id, CAST(primary_id AS VARCHAR) AS to_id FROM dups UNION ALL SELECT 'CHANGED_TO', CAST(from_id AS VARCHAR), CAST(to_id AS VARCHAR) FROM changed UNION ALL SELECT 'CONTAINS', 'doc' || document_id, CAST(fact_id AS VARCHAR) FROM facts)"
_CUES = "SELECT doc_id, " + ", ".join(f"({' + '.join(f'CASE WHEN contains(lower(text), {chr(39)}{p}{chr(39)}) THEN 3 ELSE 0 END' for p in ps)}) AS s{i}" for i, ps in enumerate(CUES.values())) + " FROM documents"
_CONCEPTS = "concepts(code, label, aliases) AS (VALUES " + ", ".join(f"('{a}', '{b}', CAST([{', '.join(repr(x) for x in c)}] AS VARCHAR[]))" for a, b, c in s.CONCEPTS) + ")"

_DIFFER = _MAT.replace("a.value", "h").replace("b.value", "v.value").replace("a.", "v.")
_FIRST_FIT = f"""
vals AS (
  SELECT subject, concept, episode, value, any_value(abs_limit) AS abs_limit, any_value(rel_limit) AS rel_limit, min((obs_date, fact_id)) AS first, max(obs_date) AS last_date, count(*) AS n, list(DISTINCT document_id) AS docs
  FROM epi GROUP BY subject, concept, episode, value),
v AS (SELECT *, row_number() OVER (PARTITION BY subject, concept, episode ORDER BY first) AS place FROM vals),
fold AS (
  SELECT subject, concept, episode, place, [value] AS heads, 1 AS g FROM v WHERE place = 1
  UNION ALL
  SELECT v.subject, v.concept, v.episode, v.place,
    CASE WHEN list_position(list_transform(f.heads, lambda h: {_DIFFER}), false) IS NULL THEN list_append(f.heads, v.value) ELSE f.heads END,
    coalesce(list_position(list_transform(f.heads, lambda h: {_DIFFER}), false), len(f.heads) + 1)
  FROM fold f JOIN v ON v.subject IS NOT DISTINCT FROM f.subject AND v.concept = f.concept AND v.episode = f.episode AND v.place = f.place + 1),
placed AS (SELECT v.*, f.g FROM v JOIN fold f ON v.subject IS NOT DISTINCT FROM f.subject AND v.concept = f.concept AND v.episode = f.episode AND v.place = f.place),
groups AS (
  SELECT subject, concept, episode, g, min(first) AS first, max(last_date) AS last_date, CAST(sum(n) AS INTEGER) AS n, arg_min(value, first) AS head, list_distinct(flatten(list(docs))) AS docs
  FROM placed GROUP BY subject, concept, episode, g),
clash AS (
  SELECT a.subject, a.concept, a.episode, a.g AS ga, b.g AS gb, a.first[2] AS left_id, b.first[2] AS right_id, a.head AS left_value, b.head AS right_value, round(b.head - a.head, 6) AS delta,
    a.n AS n_left, b.n AS n_right, least(a.first[1], b.first[1]) AS episode_start, greatest(a.last_date, b.last_date) AS episode_end, 'UNRESOLVED' AS status
  FROM groups a JOIN groups b ON a.subject IS NOT DISTINCT FROM b.subject AND a.concept = b.concept AND a.episode = b.episode AND a.g < b.g
  WHERE len(list_distinct(list_concat(a.docs, b.docs))) >= 2)"""

ORACLE_SQL = {
    "numeric_conflicts": f"WITH RECURSIVE {_EPI}, {_FIRST_FIT} SELECT * EXCLUDE (ga, gb) FROM clash",
    "conflict_edges": f"""WITH RECURSIVE {_EPI}, {_FIRST_FIT},
member AS (SELECT e.fact_id, e.document_id, p.subject, p.concept, p.episode, p.g FROM epi e JOIN placed p ON e.subject IS NOT DISTINCT FROM p.subject AND e.concept = p.concept AND e.episode = p.episode AND e.value = p.value)
SELECT l.fact_id AS left_id, r.fact_id AS right_id FROM clash c
JOIN member l ON l.subject IS NOT DISTINCT FROM c.subject AND l.concept = c.concept AND l.episode = c.episode AND l.g = c.ga
JOIN member r ON r.subject IS NOT DISTINCT FROM c.subject AND r.concept = c.concept AND r.episode = c.episode AND r.g = c.gb
WHERE l.document_id <> r.document_id""",
    "episode_clusters": f"WITH {_EPI} SELECT subject, concept, fact_id, obs_date, episode FROM epi",
    "materiality_pairs": f"WITH {_EPI}, {_PAIRS} SELECT * FROM pairs",
    "status_conflicts": f"WITH {_EPI}, g AS (SELECT subject, concept, episode, value_key, arg_min(fact_id, (obs_date, fact_id)) AS first_id, count(*) AS n, list(DISTINCT document_id) AS docs FROM epi GROUP BY ALL) SELECT a.subject, a.concept, a.episode, a.value_key AS left_key, b.value_key AS right_key, a.first_id AS left_id, b.first_id AS right_id, a.n AS n_left, b.n AS n_right, 'UNRESOLVED' AS status FROM g a JOIN g b ON a.subject IS NOT DISTINCT FROM b.subject AND a.concept = b.concept AND a.episode = b.episode AND a.value_key < b.value_key WHERE len(list_distinct(list_concat(a.docs, b.docs))) >= 2",
    "changes_adjacent": f"WITH {_FACTS}, {_RULES}, {_REPS}, {_change('reps')} SELECT * FROM changed",
    "changes_unambiguous": f"WITH {_FACTS}, {_RULES}, {_REPS}, clear AS (SELECT r.* FROM reps r SEMI JOIN (SELECT subject AS s, concept AS c, obs_date AS o FROM facts GROUP BY ALL HAVING count(DISTINCT value) = 1) x ON r.subject IS NOT DISTINCT FROM x.s AND r.concept = x.c AND r.obs_date = x.o), {_change('clear')} SELECT * FROM changed",
    "duplicates": f"WITH {_FACTS}, {_DUPS} SELECT * FROM dups",
    "series_engine": f"WITH {_FACTS}, {_REPS} SELECT subject, concept, count(*) AS n_points, min(obs_date) AS first_date, max(obs_date) AS last_date, arg_min(value, obs_date) AS first_value, arg_max(value, obs_date) AS last_value, string_agg(CAST(fact_id AS VARCHAR), ',' ORDER BY obs_date) AS points FROM reps GROUP BY ALL HAVING count(*) >= 2",
    "series_view": f"WITH {_FACTS}, g AS (SELECT subject, concept, obs_date, floor(value / 10) AS value, min(fact_id) AS fact_id, list(DISTINCT CAST(document_id AS VARCHAR)) AS d FROM facts GROUP BY ALL) SELECT subject, concept, obs_date, value, fact_id, len(d) AS n_documents, array_to_string(list_sort(d), ',') AS documents FROM g",
    "med_list_antijoin": f"WITH {_FACTS}, lists AS (SELECT subject, document_id, max(obs_date) AS list_date FROM facts WHERE concept = 'view' GROUP BY ALL) SELECT e.subject, coalesce(l.subject, 0) * 1000 + l.document_id AS list_id, e.fact_id AS entry_id, e.concept AS item FROM facts e JOIN lists l ON l.subject IS NOT DISTINCT FROM e.subject AND l.document_id <> e.document_id AND e.obs_date <= l.list_date WHERE e.concept <> 'view' AND NOT EXISTS (SELECT 1 FROM facts x WHERE x.subject IS NOT DISTINCT FROM l.subject AND x.document_id = l.document_id AND x.concept = e.concept)",
    "claim_status": f"WITH {_CLAIMS}, {_STATUS} SELECT * FROM status",
    "claim_out_of_window": f"WITH {_CLAIMS}, {_OUT} SELECT * FROM outside",
    "claim_first_support": f"WITH {_CLAIMS} SELECT claim_id, arg_min(fact_id, (obs_date, fact_id)) AS fact_id FROM ev WHERE place = 'in_window' AND supports GROUP BY claim_id",
    "gap_unsupported": f"WITH {_CLAIMS}, {_STATUS}, {_OUT}, n AS (SELECT claim_id, sum(n_facts) FILTER (place = 'after_claim') AS a, sum(n_facts) FILTER (place = 'before_lookback') AS b FROM outside GROUP BY claim_id) SELECT claim_id, subject, CAST(coalesce(a, 0) AS BIGINT) AS n_after, CAST(coalesce(b, 0) AS BIGINT) AS n_before, 'UNSUPPORTED_CLAIM' AS gap_type FROM status LEFT JOIN n USING (claim_id) WHERE evidence_status = 'NO_LOCATED_EVIDENCE'",
    "reference_nearest": f"WITH {_REFS} SELECT * FROM near",
    "reference_unique_match": f"WITH {_REFS} SELECT o_orderkey AS ref_id, coalesce(n, 0) AS n_candidates, CASE coalesce(n, 0) WHEN 1 THEN 'RESOLVED' WHEN 0 THEN 'NOT_PRESENT' ELSE 'REVIEW_REQUIRED' END AS resolution FROM orders LEFT JOIN (SELECT ref_id, count(*) AS n FROM met GROUP BY 1) ON ref_id = o_orderkey",
    "gap_missing_reference": f"WITH {_REFS} SELECT ref_id, 'MISSING_DOCUMENT' AS gap_type FROM near WHERE document_id IS NULL",
    "gap_missing_followup": f"WITH {_FACTS} SELECT e.fact_id AS event_id, e.subject, e.obs_date + 7 AS due_date, 'MISSING_FOLLOW_UP' AS gap_type FROM facts e WHERE e.concept = 'signup' AND e.obs_date + 7 <= (SELECT max(obs_date) FROM facts) AND NOT EXISTS (SELECT 1 FROM facts d WHERE d.subject IS NOT DISTINCT FROM e.subject AND d.concept = 'purchase' AND d.obs_date > e.obs_date)",
    "relationship_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "graph_edges_valid": f"WITH {_EDGES}, nodes AS (SELECT CAST(fact_id AS VARCHAR) AS id FROM facts WHERE subject IS NOT NULL) SELECT * FROM edges WHERE from_id IN (SELECT id FROM nodes) AND to_id IN (SELECT id FROM nodes)",
    "timeline_days": f"WITH {_EPI}, {_PAIRS}, hit AS (SELECT left_id AS id FROM pairs UNION SELECT right_id FROM pairs) SELECT subject, obs_date, count(*) AS n_entries, count(hit.id) AS n_in_conflict, string_agg(CAST(fact_id AS VARCHAR), ',' ORDER BY fact_id) AS entries FROM facts LEFT JOIN hit ON hit.id = fact_id GROUP BY ALL",
    "case_summary": f"WITH {_FACTS} SELECT count(*) AS n_facts, count(DISTINCT subject) AS n_subjects, count(DISTINCT concept) AS n_concepts, count(DISTINCT document_id) AS n_documents, round(CASE WHEN count(*) = 0 THEN 1.0 ELSE count(document_id) / count(*) END, 6) AS traceability FROM facts",
    "care_team": "SELECT n_name, r_name, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS roles, count(DISTINCT c_custkey) AS n_members FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "display_numbering": f"WITH {_FACTS} SELECT subject, fact_id, obs_date, CASE WHEN confidence >= 0.9 THEN 'High' WHEN confidence >= 0.75 THEN 'Moderate' ELSE 'Low' END AS band, printf('F-%03d', row_number() OVER (PARTITION BY subject ORDER BY obs_date, fact_id)) AS display_id FROM facts",
    "content_dedupe": "SELECT source, doc_id, sha256(text) AS sha256, CASE WHEN doc_id <> min(doc_id) OVER w THEN min(doc_id) OVER w END AS duplicate_of, doc_id <> min(doc_id) OVER w AS is_duplicate FROM documents WINDOW w AS (PARTITION BY source, text)",
    "raw_offsets": "WITH t AS (SELECT conv_id, list(coalesce(text, '') ORDER BY turn, text) AS p FROM conversations GROUP BY conv_id), j AS (SELECT conv_id, p, array_to_string(p, chr(10) || chr(12) || chr(10)) AS raw FROM t) SELECT conv_id, sha256(raw) AS text_sha256, length(raw) AS char_count, length(raw) - length(p[-1]) AS last_start, length(raw) AS last_end, CASE WHEN len(list_filter(p, lambda x: trim(x) <> '')) > 0 THEN 'INGESTED' ELSE 'MISSING' END AS status FROM j",
    "classify_cues": f"WITH c AS ({_CUES}) SELECT doc_id, CASE WHEN greatest(s0, s1, s2) = 0 THEN 'OTHER' WHEN s0 >= s1 AND s0 >= s2 THEN 'LICENCE' WHEN s1 >= s2 THEN 'TABLE' ELSE 'SHOUT' END AS doc_class FROM c",
    "date_extract": "SELECT doc_id, CAST(CASE doc_id % 6 WHEN 0 THEN '2024-03-14' WHEN 1 THEN '2024-03-03' WHEN 2 THEN NULL WHEN 3 THEN '2023-04-05' WHEN 4 THEN '2022-06-01' END AS DATE) AS doc_date FROM documents",
    "measure_extract": "SELECT doc_id, 'g/dL' AS unit, 1 AS n, CAST(doc_id % 17 AS DOUBLE) + 0.5 AS total, round((CAST(doc_id % 17 AS DOUBLE) + 0.5) * 10, 6) AS in_g_per_l FROM documents UNION ALL SELECT doc_id, 'mm', 1, CAST(n_chars AS DOUBLE), NULL FROM documents",
    "negation_filter": "WITH t AS (SELECT doc_id, lower(text) AS x, strpos(lower(text), 'the') AS pos FROM documents) SELECT doc_id, regexp_matches(x, '(^|[^a-z0-9])the($|[^a-z0-9])') AS mentioned, pos > 0 AND regexp_matches(substr(x, greatest(pos - 24, 1), least(24, greatest(pos - 1, 0))), '\\b(of|no)\\b') AS negated FROM t",
    "term_search_tiers": f"WITH {_CONCEPTS}, q AS (SELECT DISTINCT trim(regexp_replace(lower(p_name), '\\s+', ' ', 'g')) AS query FROM part), m AS (SELECT query, code, label, levenshtein(query, lower(label)) AS apart, CASE WHEN query = lower(code) THEN 1 WHEN query = lower(label) THEN 2 WHEN list_contains(aliases, query) THEN 3 WHEN starts_with(lower(label), query) THEN 4 WHEN length(query) >= 4 AND levenshtein(query, lower(label)) <= greatest(1, floor(length(query) * 0.22)) THEN 5 END AS tier FROM q, concepts) SELECT query, code, label, tier, CAST(row_number() OVER (PARTITION BY query ORDER BY tier, apart, code) AS INTEGER) AS place, tier = 5 AS review_required FROM m WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY tier, apart, code) <= 8",
    "identity_link_rules": "WITH st AS (SELECT c_custkey AS stmt_id, CASE WHEN c_custkey % 3 = 0 THEN 'N' || (c_custkey % 40) END AS mrn, array_to_string(list_sort(['jose', lower(c_mktsegment)]), ' ') AS name_key, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_nationkey AS VARCHAR) END AS dob FROM customer), reg AS (SELECT s_suppkey AS ref, 'N' || s_suppkey AS mrn, array_to_string(list_sort(['jose', ['building', 'household', 'machinery'][s_suppkey % 3 + 1]]), ' ') AS name_key, CAST(s_nationkey AS VARCHAR) AS dob FROM supplier), m AS (SELECT st.stmt_id, count(*) AS n, min(reg.ref) AS ref, min(reg.name_key) AS nk FROM st JOIN reg USING (mrn) GROUP BY 1), b AS (SELECT st.stmt_id, count(*) AS n, min(reg.ref) AS ref FROM st JOIN reg USING (name_key, dob) GROUP BY 1), r AS (SELECT st.stmt_id, CASE WHEN m.n = 1 AND st.name_key = m.nk THEN 'MRN' WHEN m.n = 1 THEN 'MRN_CONFLICT' WHEN m.n > 1 THEN 'AMBIGUOUS' WHEN b.n = 1 THEN 'NAME_DOB' WHEN b.n > 1 THEN 'AMBIGUOUS' WHEN st.dob IS NULL THEN 'INSUFFICIENT' ELSE 'NEW_PATIENT' END AS rule, m.ref AS a, b.ref AS c FROM st LEFT JOIN m USING (stmt_id) LEFT JOIN b USING (stmt_id)) SELECT stmt_id, rule, CASE rule WHEN 'MRN' THEN a WHEN 'NAME_DOB' THEN c END AS ref FROM r",
    "job_progress": "WITH l AS (SELECT o_orderpriority AS job_id, CASE WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_orderstatus = 'F' THEN 'INGESTED' WHEN o_orderkey % 7 = 0 THEN 'FAILED' ELSE 'DUPLICATE' END AS status FROM orders) SELECT job_id, count(*) AS total, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'INGESTED') AS ingested, count(*) FILTER (status = 'DUPLICATE') AS duplicate, count(*) FILTER (status = 'FAILED') AS failed, round(100.0 * (count(*) - count(*) FILTER (status = 'PENDING')) / count(*), 1) AS percent FROM l GROUP BY 1",
    "bulk_resume": "SELECT o_orderkey AS path, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
}
ORACLE_SQL["stream_conflicts"] = (
    f"WITH {_EPI}, span AS (SELECT subject, concept, episode, CAST(max(obs_date) + any_value(rules.window_days) + 1 AS DATE) AS shut FROM epi JOIN rules USING (concept) WHERE value IS NOT NULL GROUP BY subject, concept, episode), late AS (SELECT CAST(max(CAST(ts AS DATE)) - 3 AS DATE) AS passed FROM events),\n"
    f"every AS ({ORACLE_SQL['numeric_conflicts']})\n"
    "SELECT every.* REPLACE (CAST(every.subject AS VARCHAR) AS subject) FROM every JOIN span s ON s.subject IS NOT DISTINCT FROM every.subject AND s.concept = every.concept AND s.episode = every.episode, late WHERE s.shut <= late.passed"
)
ORACLE_SQL |= notes.ORACLE_SQL | audits.ORACLE_SQL
