"""References between documents, follow-ups, and the gaps where nothing was located."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keys import join_on


def nearest_documents(references: DataFrame, documents: DataFrame, reach_days: int = 45) -> DataFrame:
    """Each citation's nearest document of its kind and subject within the reach.

    references: ref_id, subject, kind, citing_doc, citing_date; documents: subject, kind,
    document_id, doc_date. A missing date counts as distance 0; ties go to the smaller id.
    A citation without a candidate has a null document.
    """
    met = join_on(references, documents, ["subject", "kind"]).where(~F.col("document_id").eqNullSafe(F.col("citing_doc")))
    far = F.coalesce(F.abs(F.datediff("doc_date", "citing_date")), F.lit(0))
    near = Window.partitionBy("ref_id").orderBy("days_apart", "document_id")
    best = met.withColumn("days_apart", far).where(F.col("days_apart") <= reach_days).withColumn("place", F.row_number().over(near)).where("place = 1")
    return references.select("ref_id").join(best.select("ref_id", "document_id", "days_apart"), "ref_id", "left")


def unique_matches(references: DataFrame, documents: DataFrame, reach_days: int = 45) -> DataFrame:
    """Resolution by the number of candidates: one, none or several (the other rule set)."""
    met = join_on(references, documents, ["subject", "kind"]).where(~F.col("document_id").eqNullSafe(F.col("citing_doc")) & (F.coalesce(F.abs(F.datediff("doc_date", "citing_date")), F.lit(0)) <= reach_days))
    found = met.groupBy("ref_id").agg(F.count("*").alias("n_candidates"))
    n = F.coalesce("n_candidates", F.lit(0))
    return references.select("ref_id").join(found, "ref_id", "left").select("ref_id", n.alias("n_candidates"), F.when(n == 1, "RESOLVED").when(n == 0, "NOT_PRESENT").otherwise("REVIEW_REQUIRED").alias("resolution"))


def missing_references(nearest: DataFrame) -> DataFrame:
    return nearest.where("document_id is null").select("ref_id", F.lit("MISSING_DOCUMENT").alias("gap_type"))


def missing_followups(expected: DataFrame, documents: DataFrame) -> DataFrame:
    """Expected follow-ups that are due by the last known date and have no later document.

    expected: event_id, subject, kind, event_date, interval_days; documents: subject, kind,
    doc_date. The horizon is the last document date of all.
    """
    horizon = documents.agg(F.max("doc_date")).scalar()
    due = expected.withColumn("due_date", F.date_add("event_date", F.col("interval_days"))).where(F.col("due_date") <= horizon)
    later = documents.groupBy("subject", "kind").agg(F.max("doc_date").alias("last_date"))
    return join_on(due, later, ["subject", "kind"], "left").where("last_date is null or last_date <= event_date").select("event_id", "subject", "due_date", F.lit("MISSING_FOLLOW_UP").alias("gap_type"))
