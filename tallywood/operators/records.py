"""Records around the evidence: provenance, patients, orders, labels, counts and listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keys import join_on

OPEN_END = "9999-12-31"


# --- filters and predicates -----------------------------------------------------------
def day_precise(facts: DataFrame) -> DataFrame:
    """Numeric facts with a date to the day."""
    return facts.where("value is not null and obs_date is not null and date_precision = 'day'")


def explicit(facts: DataFrame) -> DataFrame:
    """Facts whose date the source states."""
    return facts.where("temporal_status = 'EXPLICIT'")


def traceable(document: Column, page: Column, words: Column) -> Column:
    """Document, page and words are all there."""
    return document.isNotNull() & F.coalesce(page, F.lit(0)).cast("long").between(1, 1 << 40) & (F.coalesce(words, F.lit("")) != "")


def days_apart(a: Column, b: Column, unusable: int = 1_000_000) -> Column:
    """Whole days between two dates; a missing one is far from everything."""
    return F.coalesce(F.abs(F.datediff(a, b)), F.lit(unusable))


# --- display --------------------------------------------------------------------------
def short_number(value: Column) -> Column:
    """Six significant digits without trailing zeros, with an exponent from 1e6 on and below 1e-4."""
    s = F.format_string("%.5e", value)
    power = F.regexp_extract(s, r"e([+-]\d+)$", 1).try_cast("int")
    strip = lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = strip(s.try_cast("double").try_cast("decimal(24,10)").cast("string"))
    far = F.concat(strip(F.regexp_extract(s, r"^([^e]*)", 1)), F.regexp_extract(s, r"(e.*)$", 1))
    return F.when(value.isNull(), None).when(value == 0, "0").when((power >= 6) | (power < -4), far).otherwise(plain)


def summary_text(value: Column, unit: Column, words: Column) -> Column:
    """What a fact states, as text: number and unit, or its words."""
    return F.when(value.isNotNull(), F.trim(F.concat_ws(" ", short_number(value), F.coalesce(unit, F.lit(""))))).otherwise(words)


def with_labels(rows: DataFrame, *tables: DataFrame, key: str = "concept") -> DataFrame:
    """Adds label: that of the first table (concept, label) that knows the concept, else the concept in title case."""
    out = rows
    for k, table in enumerate(tables):
        out = out.join(F.broadcast(table.select(F.col("concept").alias(key), F.col("label").alias(f"label__{k}"))), key, "left")  # literal tables of a rule pack
    names = [F.col(f"label__{k}") for k in range(len(tables))]
    return out.withColumn("label", F.coalesce(*names, F.initcap(F.regexp_replace(key, "_", " ")))).drop(*[f"label__{k}" for k in range(len(tables))])


# --- provenance and patients ----------------------------------------------------------
def with_sources(facts: DataFrame, sources: DataFrame, documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts with source, document and page: only those for which all three are there."""
    s = sources.select("source_id", "document_id", "page_number", "char_start", "char_end")
    d = documents.select("document_id", "filename")
    return facts.drop("document_id").join(s, "source_id").join(d, "document_id").join(pages.select("document_id", "page_number", F.col("text").alias("page_text")), ["document_id", "page_number"])


def provenance(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts with their source where there is one."""
    return facts.join(sources.select("source_id", F.struct("document_id", "page_number", "char_start", "char_end").alias("source")), "source_id", "left")


def to_patients(evidence: DataFrame, links: DataFrame) -> DataFrame:
    """Evidence rows with the patient of their document as subject; those of unresolved documents have a null subject and are one group."""
    return evidence.drop("subject").join(links.select("document_id", F.col("patient_ref").alias("subject")), "document_id", "left")


def link_statements(links: DataFrame, stated: DataFrame) -> DataFrame:
    """Each decision with what the document states."""
    return links.join(stated.drop("ordinal"), "document_id")


#: Edges that run from a fact to a claim, and what they say of it; edges between facts have other names.
CLAIM_EDGES = {"SUPPORTS": "SUPPORTS", "CONTRADICTS_CLAIM": "CONTRADICTS"}


def claim_evidence_view(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """Claims with the facts that support or contradict them: claim_id, rel_type (SUPPORTS or CONTRADICTS), fact_id."""
    said = F.create_map(*[F.lit(x) for pair in CLAIM_EDGES.items() for x in pair])
    rows = edges.where(F.col("rel_type").isin(*CLAIM_EDGES)).select(F.col("to_id").alias("claim_id"), said[F.col("rel_type")].alias("rel_type"), F.col("from_id").alias("fact_id"))
    return claims.select(F.col("claim_id").cast("string").alias("claim_id")).join(rows, "claim_id")


# --- orders ---------------------------------------------------------------------------
def fact_order() -> list[Column]:
    """By date (undated last), display id, id."""
    return [F.coalesce(F.col("obs_date").cast("string"), F.lit(OPEN_END)), F.col("display_id"), F.col("fact_id")]


def change_order() -> list[Column]:
    return [F.col("concept"), F.col("from_date"), F.col("to_date")]


def conflict_order() -> list[Column]:
    return [F.col("concept"), F.col("episode_start")]


def undated_last(column: str) -> list[Column]:
    return [F.asc_nulls_last(column)]


def document_order() -> list[Column]:
    return [F.col("ordinal"), F.col("filename")]


def placed(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Adds place: the position in an order within each group, so that it survives a shuffle."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def newest_run(runs: DataFrame) -> DataFrame:
    """The run of each case that started last."""
    return runs.groupBy("case_id").agg(F.max_by(F.struct(*[F.col(c) for c in runs.columns if c != "case_id"]), F.struct("started_at", "run_id")).alias("r")).select("case_id", "r.*")


def first_of_document(facts: DataFrame, n: int = 3) -> DataFrame:
    """document_id and its first n facts as one line of text."""
    rows = placed(facts.where("document_id is not null"), ["document_id"], [F.col("fact_id")]).where(F.col("place") <= n)
    line = F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(" ", "concept", short_number(F.col("value"))).alias("t")))), lambda x: x["t"])
    return rows.groupBy("document_id").agg(F.array_join(line, " · ").alias("detail"))


# --- counts ---------------------------------------------------------------------------
def counts_by_case(**tables: DataFrame) -> DataFrame:
    """case_id and the number of rows of each named table that has it; 0 where a table has none."""
    parts = [t.groupBy("case_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(name)) for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("case_id").pivot("what", list(tables)).agg(F.sum("n")).na.fill(0)


def case_list(cases: DataFrame, runs: DataFrame, **tables: DataFrame) -> DataFrame:
    """Every case with counts and whether a run of it has been completed."""
    done = runs.where("status = 'COMPLETE'").select("case_id", F.lit(True).alias("processed")).distinct()
    return cases.join(counts_by_case(**tables), "case_id", "left").join(done, "case_id", "left").na.fill(0, list(tables)).withColumn("processed", F.coalesce("processed", F.lit(False)))


def documents_with_facts(documents: DataFrame, facts: DataFrame) -> DataFrame:
    return documents.join(facts.groupBy("document_id").agg(F.count("*").alias("n_facts")), "document_id", "left").na.fill(0, ["n_facts"])


def codings_by_system(codings: DataFrame) -> DataFrame:
    """system, total, assertable, approximate; the most frequent system first by place."""
    sums = codings.groupBy("system").agg(F.count("*").alias("total"), F.count_if("assertable").alias("assertable"), F.count_if(~F.col("assertable")).alias("approximate"))
    return sums.withColumn("place", F.row_number().over(Window.orderBy(F.desc("total"), "system")))  # a row for each system


def stage_sizes(facts: DataFrame, documents: DataFrame, medications: DataFrame) -> DataFrame:
    """Distinct document types, concepts and drugs of each stage of a run."""
    one = lambda df, c, stage: df.agg(F.count_distinct(c).alias("distinct_values")).select(F.lit(stage).alias("stage"), "distinct_values")
    return one(documents, "doc_type", "CLASSIFY").unionByName(one(facts, "concept", "NORMALIZE")).unionByName(one(medications, "drug_norm", "RESOLVE_ENTITIES"))


def audit_counts(**tables: DataFrame) -> DataFrame:
    """One row: the size of each named table, unresolved conflicts, and traceability of facts, claims and medications (0 without any)."""
    sizes = [t.agg(F.count("*").alias("n"), (F.count_if(F.col("document_id").isNotNull()) if "document_id" in t.columns else F.lit(0)).alias("traced"), (F.count_if(F.col("status") == "UNRESOLVED") if name == "conflicts" else F.lit(0)).alias("open")).withColumn("what", F.lit(name)) for name, t in tables.items()]
    rows = reduce(DataFrame.unionByName, sizes)
    evidence = F.col("what").isin("facts", "claims", "medications")
    total, traced = F.sum(F.when(evidence, F.col("n"))), F.sum(F.when(evidence, F.col("traced")))
    return rows.agg(*[F.sum(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in tables], F.sum("open").alias("unresolved"), F.round(F.coalesce(F.try_divide(traced, total), F.lit(0.0)), 6).alias("source_traceability"))


def record_metrics(documents: DataFrame, conflicts: DataFrame, gaps: DataFrame, **evidence: DataFrame) -> DataFrame:
    """The other rule set's metrics: unresolved counts conflicts, gaps and documents under review; traceability in whole percent.

    evidence tables have document_id, page_number and source_text; without any, traceability is 100 if there is a document, else 0.
    """
    size = lambda df, name: df.agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("traced")).withColumn("what", F.lit(name))
    review = size(documents.where("processing_status = 'REQUIRES_REVIEW'"), "review")
    traced = lambda df, name: df.agg(F.count("*").alias("n"), F.count_if(traceable(F.col("document_id"), F.col("page_number"), F.col("source_text"))).alias("traced")).withColumn("what", F.lit(name))
    rows = reduce(DataFrame.unionByName, [size(documents, "documents"), size(conflicts, "conflicts"), size(gaps, "gaps"), review, *[traced(df, name) for name, df in evidence.items()]])
    of = lambda name: F.sum(F.when(F.col("what") == name, F.col("n")).otherwise(0))
    total, good = F.sum(F.when(F.col("what").isin(*evidence), F.col("n")).otherwise(0)), F.sum("traced")
    share = F.when(total > 0, F.floor(100.0 * good / total + 0.5)).when(of("documents") > 0, 100).otherwise(0)
    return rows.agg(of("documents").alias("documents"), *[of(n).alias(n) for n in evidence], of("conflicts").alias("conflicts"), of("gaps").alias("gaps"), (of("conflicts") + of("gaps") + of("review")).alias("unresolved"), share.cast("long").alias("traceability"))


def restated(facts: DataFrame) -> DataFrame:
    """The other rule set's duplicates: equal concept, date, value or words, and unit, dates and units absent on both sides too. The smallest id is the primary."""
    stated = facts.withColumn("stated__", F.coalesce(F.col("value").cast("string"), F.col("value_text")))
    keys = ["subject", "concept", "obs_date", "stated__", "unit"]
    first = stated.groupBy(*keys).agg(F.min("fact_id").alias("primary_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return join_on(stated, first, keys).where("fact_id <> primary_id").select("subject", "concept", "obs_date", F.col("fact_id").alias("other_id"), "primary_id")
