"""The whole audit: from evidence tables to changes, conflicts, claims, gaps, edges, timeline, graph and brief.

Two rule sets share the detectors. "documents" compares values by limits within a window of
days and takes a claim's requirements from a rule table; "records" also asks for equal units
and days stated by the source, has no default window, and takes rules from the claims themselves.
Every conflict stays UNRESOLVED with both sides; what isn't found is "not located".
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import mentions_any
from . import changes, claims, conflicts, gaps, records, views
from .episodes import KEY, episodes, value_groups, with_rules
from .keys import join_on

#: Words of a citation's label that name the kind of document and not the study.
LABEL_WORDS = ("report", "reports", "study", "studies", "scan", "scans", "the", "a", "an", "prior", "previous", "results", "result")


@dataclass
class Evidence:
    """The evidence tables of one audit.

    facts: subject, concept, fact_id, obs_date, date_precision, value, unit, value_key, value_text,
    document_id, page_number, source_text, confidence. medications: subject, entry_id, item, record_date, status,
    stop_date, document_id, doc_type. claims: claim_id, subject, claim_type, claim_date, document_id.
    references: ref_id, subject, kind, label, citing_doc, citing_date. documents: document_id,
    subject, kind, doc_date, filename, head (first lines of its text), ordinal. events: event_id,
    subject, label, event_date.
    """

    facts: DataFrame
    medications: DataFrame
    claims: DataFrame
    references: DataFrame
    documents: DataFrame
    events: DataFrame


# --- references -----------------------------------------------------------------------
def label_terms(label):
    """The words of a citation's label that tell the study, as an array."""
    return F.filter(F.regexp_extract_all(F.lower(label), F.lit("[a-z0-9-]+"), F.lit(0)), lambda w: ~w.isin(*LABEL_WORDS))


def resolve_references(references: DataFrame, documents: DataFrame, reach_days: int = 45) -> DataFrame:
    """Each citation, once for each label and citing document, with the document that answers it.

    A document answers if it is of the cited kind, not the citing one, names a term of the label in
    its file name or first lines, and lies within reach_days (a missing date counts as near); the nearest
    wins, then the earlier ordinal. Where no document of the kind exists at all, a file name that holds
    the label's longest term satisfies the citation without a document. outcome: RESOLVED, NAMED or MISSING.
    """
    once = references.groupBy("subject", "label", "citing_doc").agg(F.min("ref_id").alias("ref_id"))
    refs = references.join(once.select("ref_id"), "ref_id", "left_semi").withColumn("terms", label_terms(F.col("label")))
    own = documents.select("subject", "kind", "document_id", "doc_date", "ordinal", F.concat_ws(" ", F.regexp_replace(F.lower("filename"), "_", " "), F.lower(F.coalesce("head", F.lit("")))).alias("words"))
    met = join_on(refs, own, ["subject", "kind"]).where(~F.col("document_id").eqNullSafe(F.col("citing_doc")))
    far = F.coalesce(F.abs(F.datediff("doc_date", "citing_date")), F.lit(0))
    fits = ((F.size("terms") == 0) | mentions_any(F.col("words"), F.col("terms"))) & (far <= reach_days)
    best = met.groupBy("ref_id").agg(F.min(F.when(fits, F.struct(far.alias("days_apart"), "ordinal", "document_id"))).alias("best"))
    term = F.coalesce(F.try_element_at(F.array_sort("terms", lambda a, b: F.length(b) - F.length(a)), F.lit(1)), F.lower("label"))
    names = documents.select("subject", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("filename"), F.lit("[a-z0-9]+"), F.lit(0)))).alias("term")).distinct()
    named = join_on(refs.select("ref_id", "subject", term.alias("term")), names, ["subject", "term"], "left_semi").select("ref_id", F.lit(True).alias("named"))
    rows = refs.join(best.withColumn("some", F.lit(True)), "ref_id", "left").join(named, "ref_id", "left")
    outcome = F.when(F.col("best").isNotNull(), "RESOLVED").when(F.col("some").isNull() & F.col("named"), "NAMED").otherwise("MISSING")
    return rows.select("ref_id", "subject", "label", F.col("best.document_id").alias("document_id"), F.col("best.days_apart").alias("days_apart"), outcome.alias("outcome"))


# --- medications and follow-ups -------------------------------------------------------
def list_conflicts_grouped(medications: DataFrame, list_types: tuple[str, ...] = ("MEDICATION_LIST",)) -> DataFrame:
    """One conflict for each drug and list that lacks it, with all entries and the latest of them (implicated)."""
    listed = medications.where(F.col("doc_type").isin(*list_types) & F.col("document_id").isNotNull())
    lists = listed.groupBy("subject", F.col("document_id").alias("list_id")).agg(F.max("record_date").alias("list_date"))
    items = listed.select(F.col("document_id").alias("list_id"), "item").distinct()
    found = conflicts.list_conflicts(medications, lists, items)
    rows = found.join(medications.select("entry_id", "record_date"), "entry_id")
    last = F.struct(F.coalesce(F.col("record_date").cast("string"), F.lit("")), "entry_id")
    return rows.groupBy("subject", "list_id", "item").agg(F.max_by("entry_id", last).alias("implicated_id"), F.max("record_date").alias("record_date"), F.count("*").alias("n_entries")).withColumn("status", F.lit(conflicts.UNRESOLVED))


def medication_gaps(grouped: DataFrame) -> DataFrame:
    """One gap for each implicated entry."""
    return grouped.select("subject", F.col("implicated_id").alias("about_id"), F.col("item").alias("title"), F.lit("MEDICATION_DOCUMENTATION_GAP").alias("gap_type")).distinct()


def followup_gaps(events: DataFrame, documents: DataFrame, expectations: DataFrame) -> DataFrame:
    """Follow-ups that are due by the last document's date and have no later document of the expected kind; one for each label and kind."""
    expected = events.join(F.broadcast(expectations), "label", "left").withColumn("interval_days", F.coalesce("interval_days", F.lit(0)))
    horizon = documents.agg(F.max("doc_date")).scalar()
    due = expected.where("event_date is not null").withColumn("due_date", F.date_add("event_date", F.col("interval_days"))).where(F.col("due_date") <= horizon)
    last = documents.groupBy("subject", "kind").agg(F.max("doc_date").alias("last_date"))
    any_last = documents.groupBy("subject").agg(F.max("doc_date").alias("any_date"))
    rows = join_on(join_on(due, last, ["subject", "kind"], "left"), any_last, ["subject"], "left")
    later = F.when(F.col("kind").isNull(), F.col("any_date")).otherwise(F.col("last_date"))
    missing = rows.where(later.isNull() | (later <= F.col("event_date")))
    return missing.groupBy("subject", "label", "kind").agg(F.min(F.struct("event_date", "event_id", "due_date")).alias("first")).select("subject", F.col("first.event_id").alias("about_id"), F.col("label").alias("title"), "first.due_date", F.lit("MISSING_FOLLOW_UP").alias("gap_type"))


# --- the rule set of records ----------------------------------------------------------
def record_numeric_conflicts(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Conflicts where agreeing facts must also have equal units; with the basis of materiality and the episode's ends."""
    rows = episodes(with_rules(records.day_precise(facts), rules, default_window=0))
    own = rows.withColumn("concept", F.concat_ws("\u0001", "concept", F.coalesce("unit", F.lit(""))))
    groups = value_groups(own).withColumns({"unit": F.element_at(F.split("concept", "\u0001"), -1), "concept": F.element_at(F.split("concept", "\u0001"), 1)})
    order = Window.partitionBy(*KEY, "episode").orderBy("first_date", "first_id")
    both = conflicts._between_groups(groups.withColumn("group_no", F.row_number().over(order)))
    limits = rows.groupBy("concept").agg(F.max("abs_limit").alias("abs_limit"), F.max("rel_limit").alias("rel_limit"))
    basis = F.when(F.col("abs_limit").isNull() & F.col("rel_limit").isNull(), "Any documented difference").otherwise(F.concat_ws(" or ", F.concat(records.short_number(F.col("abs_limit")), F.lit(" absolute")), F.concat(records.short_number(F.col("rel_limit") * 100), F.lit("% relative"))))
    return both.join(F.broadcast(limits), "concept").select(
        *KEY, "episode", F.col("left_first_id").alias("left_id"), F.col("right_first_id").alias("right_id"), F.round(F.col("right_head_value") - F.col("left_head_value"), 6).alias("delta"),
        F.least("left_first_date", "right_first_date").alias("episode_start"), F.greatest("left_last_date", "right_last_date").alias("episode_end"), basis.alias("materiality_basis"), F.lit(conflicts.UNRESOLVED).alias("status"),
    )


def record_changes(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Changes between dates that state one value and unit alone, in equal units."""
    rows = records.explicit(facts) if "temporal_status" in facts.columns else facts
    return changes.adjacent_changes(changes.unambiguous(rows.where("value is not null and obs_date is not null")), rules, same_unit=True, default_window=0)


def located(record_claims: DataFrame, facts: DataFrame) -> DataFrame:
    """claim_id, concept, in_time, later: of each concept that a claim rests on, is there a fact up to the claim within its look-back, and one after it.

    record_claims: claim_id, subject, claim_date, support (array), lookback_days (null: any time).
    """
    asked = record_claims.select("claim_id", "subject", "claim_date", "lookback_days", F.explode("support").alias("concept"))
    days = facts.where("obs_date is not null").groupBy("subject", "concept", "obs_date").agg(F.min("fact_id").alias("fact_id"))
    met = join_on(asked, days, ["subject", "concept"], "left")
    back = F.datediff("claim_date", "obs_date")
    inside = (back >= 0) & (F.col("lookback_days").isNull() | (back <= F.col("lookback_days")))
    return met.groupBy("claim_id", "concept").agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("in_time"), F.coalesce(F.bool_or(back < 0), F.lit(False)).alias("later"), F.min(F.when(inside, F.col("fact_id"))).alias("first_fact"))


def record_gaps(record_claims: DataFrame, facts: DataFrame, documents: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """Gaps by the claims' own rules: missing support, source and follow-up; and references without any document.

    record_claims also has gap_rule, referenced_document, expected_concept. Columns: about_id, gap_type, not_located.
    """
    ruled = record_claims.where("gap_rule is not null")
    found = located(ruled.where("gap_rule = 'MISSING_SUPPORT' and claim_date is not null"), facts)
    support = found.where("not in_time").groupBy("claim_id").agg(F.array_join(F.array_sort(F.collect_set("concept")), ",").alias("not_located")).select(F.col("claim_id").alias("about_id"), F.lit("MISSING_SUPPORTING_TEST").alias("gap_type"), "not_located")
    asked = ruled.where("gap_rule = 'MISSING_SOURCE' and referenced_document is not null")
    there = documents.select("subject", "kind", "filename")
    hit = join_on(asked, there, ["subject"], "left_semi", where=(F.col("kind") == "IMAGING_REPORT") | F.contains(F.lower("filename"), F.lower("referenced_document")))
    source = asked.join(hit.select("claim_id"), "claim_id", "left_anti").select(F.col("claim_id").alias("about_id"), F.lit("MISSING_REFERENCED_DOCUMENT").alias("gap_type"), F.col("referenced_document").alias("not_located"))
    wanted = ruled.where("gap_rule = 'MISSING_FOLLOWUP' and expected_concept is not null and claim_date is not null")
    last = facts.groupBy("subject", F.col("concept").alias("expected_concept")).agg(F.max("obs_date").alias("last_date"))
    late = join_on(wanted, last, ["subject", "expected_concept"], "left").where("last_date is null or last_date <= claim_date").select(F.col("claim_id").alias("about_id"), F.lit("MISSING_FOLLOWUP").alias("gap_type"), F.col("expected_concept").alias("not_located"))
    parts = [support, source, late]
    if resolutions is not None:
        parts.append(resolutions.where("resolution = 'NOT_PRESENT'").select(F.col("ref_id").alias("about_id"), F.lit("MISSING_REFERENCED_DOCUMENT").alias("gap_type"), F.lit(None).cast("string").alias("not_located")))
    return reduce(DataFrame.unionByName, parts)


def record_edges(facts: DataFrame, record_claims: DataFrame, changed: DataFrame, contradictions: DataFrame, found_gaps: DataFrame) -> DataFrame:
    """The five kinds of edges of the rule set of records. contradictions: left_id, right_id of members of different documents."""
    ends = lambda df, a, b: df.select(F.col(a).alias("from_id"), F.col(b).alias("to_id"))
    support = located(record_claims.where("claim_date is not null and size(support) > 0"), facts).where("first_fact is not null")
    missing = found_gaps.select(F.col("about_id").alias("from_id"), F.concat_ws(":", F.lit("gap"), "gap_type", "about_id").alias("to_id"))
    return views.edges(DUPLICATES=ends(records.restated(facts), "primary_id", "other_id"), CHANGED_TO=ends(changed, "from_id", "to_id"), CONTRADICTS=ends(contradictions, "left_id", "right_id"), SUPPORTS=ends(support, "first_fact", "claim_id"), MISSING_SUPPORT=missing)


def record_timeline(documents: DataFrame, facts: DataFrame, record_claims: DataFrame, in_conflict: DataFrame) -> DataFrame:
    """One row a document: date, its first facts or else its first claim, and the concepts on which it is in a conflict (document_id, concept)."""
    flags = in_conflict.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("concept")), ",").alias("flags"))
    said = record_claims.groupBy("document_id").agg(F.min_by("claim_text", "claim_id").alias("claim"))
    rows = documents.join(records.first_of_document(facts), "document_id", "left").join(said, "document_id", "left").join(flags, "document_id", "left")
    return rows.select("document_id", "doc_date", F.coalesce("detail", "claim", F.lit("")).alias("detail"), F.coalesce("flags", F.lit("")).alias("flags"))


# --- graph and brief ------------------------------------------------------------------
def graph(nodes: dict[str, DataFrame], contains: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). nodes: kind to a table of node_id; contains and relations: rel_type (CONTAINS where absent), from_id, to_id, and from_type, to_type.

    A node is a kind and an id: fact 1 and claim 1 are two. An end whose type isn't stated is looked up in all kinds by its
    id. A relation to concepts (to_type 'concept') that have no record gets a node absent_evidence, so that what is
    missing can be seen; other relations with an unknown end are left out. edges: rel_type, from_id, to_id, from_type, to_type.
    """
    known = reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), F.col("node_id").cast("string").alias("node_id")) for kind, df in nodes.items()]).distinct()
    typed = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    text = lambda df: df.select("rel_type", F.col("from_id").cast("string").alias("from_id"), F.col("to_id").cast("string").alias("to_id"), typed(df, "from_type").alias("from_type"), typed(df, "to_type").alias("to_type"))
    every = text(contains.withColumn("rel_type", F.lit("CONTAINS"))).unionByName(text(relations))
    absent = every.where("to_type = 'concept'").select(F.lit("absent_evidence").alias("kind"), F.col("to_id").alias("node_id")).distinct()
    absent = absent.join(known.select("node_id").distinct(), "node_id", "left_anti").select("kind", "node_id")
    found = known.unionByName(absent)
    for end in ("from", "to"):
        ids = found.select(F.col("node_id").alias("id__"), F.col("kind").alias("kind__"))
        stated = F.col(f"{end}_type").isNull() | (F.col(f"{end}_type") == F.col("kind__")) | (F.col(f"{end}_type") == "concept")
        every = every.join(ids, (F.col(f"{end}_id") == F.col("id__")) & stated).withColumn(f"{end}_type", F.col("kind__")).drop("id__", "kind__").distinct()
    return found, every.select("rel_type", "from_id", "to_id", "from_type", "to_type")


def brief(unresolved: DataFrame, found_gaps: DataFrame, documents: DataFrame, facts: DataFrame) -> dict[str, DataFrame]:
    """What a reader needs first: open items (conflicts, then gaps) and the index of sources with their facts."""
    open_ = unresolved.where("status = 'UNRESOLVED'").select(F.lit("conflict").alias("kind"), F.concat_ws(":", "concept", F.col("left_id").cast("string"), F.col("right_id").cast("string")).alias("item"))
    missing = found_gaps.select(F.lit("evidence_gap").alias("kind"), F.concat_ws(":", "gap_type", F.col("about_id").cast("string")).alias("item"))
    return {"open_items": open_.unionByName(missing), "source_index": records.documents_with_facts(documents, facts)}


# --- one call -------------------------------------------------------------------------
def audit(e: Evidence, vocabulary, known: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All results of the rule set of documents, by name; nothing is computed until a result is read.

    A subject's claims see its own facts alone; evidence without a subject is compared with its like. counts has one row.
    known: results by name that were written before; what follows from them reads them.
    """
    spark, known = e.facts.sparkSession, known or {}
    of = lambda name, make: known[name] if name in known else make()
    rules, requirements = vocabulary.rules(spark), vocabulary.requirements(spark)
    numeric = of("numeric_conflicts", lambda: conflicts.numeric_conflicts(e.facts, rules))
    status = of("status_conflicts", lambda: conflicts.status_conflicts(e.facts, rules))
    listed = of("medication_conflicts", lambda: list_conflicts_grouped(e.medications))
    side = lambda df, kind, left, right, concept: df.select("subject", F.col(concept).alias("concept"), F.lit(kind).alias("kind"), F.col(left).cast("string").alias("left_id"), F.col(right).cast("string").alias("right_id"), "status")
    every = of("conflicts", lambda: side(numeric, "NUMERIC", "left_id", "right_id", "concept").unionByName(side(status, "STATUS", "left_id", "right_id", "concept")).unionByName(side(listed, "MEDICATION_DOCUMENTATION", "implicated_id", "list_id", "item")))
    changed = of("changes", lambda: changes.adjacent_changes(changes.representatives(e.facts), rules))
    repeated = of("duplicates", lambda: changes.duplicates(e.facts))
    qualitative = claims.status_evidence(e.claims, vocabulary.status_requirements(spark), vocabulary.polarity(spark), e.facts)
    asked = requirements.select("claim_type", "concept", "op", "threshold", "lookback_days").unionByName(vocabulary.status_requirements(spark).select("claim_type", "concept", F.lit("any").alias("op"), F.lit(None).cast("double").alias("threshold"), "lookback_days"))
    evidence = claims.claim_evidence(e.claims, requirements, e.facts.where("value is not null")).select("claim_id", "fact_id", "supports").unionByName(qualitative.select("claim_id", "fact_id", "supports"))
    resolved = of("claims", lambda: claims.status_of(e.claims, asked, evidence))
    outside = of("outside_window", lambda: claims.out_of_window(e.claims, asked, e.facts))
    cited = of("references", lambda: resolve_references(e.references, e.documents))
    text = lambda df, about, kind, title: df.select("subject", F.col(about).cast("string").alias("about_id"), F.lit(kind).alias("gap_type"), title.alias("title"))
    missing = of("gaps", lambda: (
        text(claims.unsupported(resolved, outside), "claim_id", "UNSUPPORTED_CLAIM", F.lit(None).cast("string"))
        .unionByName(text(cited.where("outcome = 'MISSING'"), "ref_id", "MISSING_DOCUMENT", F.col("label")))
        .unionByName(text(medication_gaps(listed), "about_id", "MEDICATION_DOCUMENTATION_GAP", F.col("title")))
        .unionByName(text(followup_gaps(e.events, e.documents, vocabulary.expectations(spark)), "about_id", "MISSING_FOLLOW_UP", F.col("title")))
    ))
    ends = lambda df, a, b: df.select(F.col(a).alias("from_id"), F.col(b).alias("to_id"))
    contradicting = conflicts.cross_members(episodes(with_rules(e.facts, rules)))
    relations = of("relationships", lambda: views.edges(
        DUPLICATES=ends(repeated, "other_id", "primary_id"), CHANGED_TO=ends(changed, "from_id", "to_id"), CHANGED_FROM=ends(changed, "to_id", "from_id"), CONTRADICTS=ends(contradicting, "left_id", "right_id"),
        SUPPORTS=ends(evidence.where("supports"), "fact_id", "claim_id"), CONTRADICTS_CLAIM=ends(evidence.where("not supports"), "fact_id", "claim_id"),
    ))
    counts = records.audit_counts(documents=e.documents, facts=e.facts, claims=e.claims, medications=e.medications, events=e.events, changes=changed, conflicts=every, evidence_gaps=missing, relationships=relations, duplicates=repeated)
    return {
        "changes": changed, "duplicates": repeated, "series": of("series", lambda: changes.series(e.facts)), "numeric_conflicts": numeric, "status_conflicts": status, "medication_conflicts": listed, "conflicts": every,
        "claims": resolved, "outside_window": outside, "references": cited, "gaps": missing, "relationships": relations, "counts": counts,
    }
