"""Claims and the evidence for them within a look-back; absence is 'not located', never 'false'."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .keys import join_on


def claim_evidence(claims: DataFrame, requirements: DataFrame, facts: DataFrame) -> DataFrame:
    """Each claim with each fact within the look-back of a concept that it requires.

    claims: claim_id, subject, claim_type, claim_date; requirements: claim_type, concept,
    op, threshold, lookback_days (a small literal table); facts as elsewhere. A missing date
    on either side counts as within. Dates meet by buckets as wide as the look-back, so a claim
    isn't compared with a subject's whole history.
    """
    wanted = claims.join(F.broadcast(requirements), "claim_type").withColumn("width", F.greatest(F.col("lookback_days"), F.lit(1)))
    widths = requirements.select("concept", F.greatest(F.col("lookback_days"), F.lit(1)).alias("width")).distinct()
    rows = facts.select("subject", "concept", "fact_id", "obs_date", "value")
    of = lambda date, width: F.floor(F.unix_date(date) / width)
    last, first = of("claim_date", F.col("width")), of(F.date_sub("claim_date", F.col("lookback_days")), F.col("width"))
    dated = wanted.where("claim_date is not null").withColumn("bucket", F.explode(F.sequence(first, last)))
    spread = rows.where("obs_date is not null").join(F.broadcast(widths), "concept").withColumn("bucket", of("obs_date", F.col("width")))
    near = join_on(dated, spread, ["subject", "concept", "width", "bucket"]).where("datediff(claim_date, obs_date) between 0 and lookback_days").drop("bucket")
    undated = join_on(wanted, rows, ["subject", "concept"], where=F.col("claim_date").isNull() | F.col("obs_date").isNull())
    return near.unionByName(undated).withColumn("supports", direction(F.col("op"), F.col("value"), F.col("threshold")))


def status_evidence(claims: DataFrame, requirements: DataFrame, polarity: DataFrame, facts: DataFrame) -> DataFrame:
    """Qualitative evidence: supports where the documented class has the polarity that the claim asks for.

    requirements: claim_type, concept, lookback_days, wants (boolean); polarity: concept,
    value_key, positive (null: the class has none and neither supports nor contradicts).
    """
    asked = requirements.select("claim_type", "concept", "lookback_days", "wants", F.lit("gte").alias("op"), F.lit(1.0).alias("threshold"))
    known = facts.where("value_key is not null").join(F.broadcast(polarity), ["concept", "value_key"])
    met = claim_evidence(claims, asked, known.withColumn("value", F.col("positive").cast("double")))
    return met.where("value is not null").withColumn("supports", (F.col("value") == 1) == F.col("wants"))


def direction(op: Column, value: Column, threshold: Column) -> Column:
    """lt, lte, gt or gte against the threshold; any other word asks for no direction."""
    return F.when(op == "lt", value < threshold).when(op == "lte", value <= threshold).when(op == "gt", value > threshold).when(op == "gte", value >= threshold).otherwise(True)


def opposite(op: Column) -> Column:
    """The direction that contradicts a direction."""
    return F.when(op == "lt", "gte").when(op == "lte", "gt").when(op == "gt", "lte").when(op == "gte", "lt")


def claim_status(claims: DataFrame, requirements: DataFrame, facts: DataFrame, qualitative: DataFrame | None = None) -> DataFrame:
    """Evidence status of every claim; contradicting wins over supporting, both counts stay.

    qualitative: more evidence rows (claim_id, supports), as from status_evidence.
    """
    rows = claim_evidence(claims, requirements, facts).select("claim_id", "supports")
    return status_of(claims, requirements, rows if qualitative is None else rows.unionByName(qualitative.select("claim_id", "supports")))


def status_of(claims: DataFrame, requirements: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence status of every claim from rows (claim_id, supports); a claim without a rule isn't assessed."""
    found = evidence.groupBy("claim_id").agg(F.count_if("supports").alias("n_support"), F.count_if(~F.col("supports")).alias("n_contradict"))
    known = claims.join(F.broadcast(requirements.select("claim_type").distinct().withColumn("assessed", F.lit(True))), "claim_type", "left").join(found, "claim_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    status = F.when(F.col("assessed").isNull(), "NOT_ASSESSED").when(count("n_contradict") > 0, "CONTRADICTING_LOCATED").when(count("n_support") > 0, "SUPPORTING_LOCATED").otherwise("NO_LOCATED_EVIDENCE")
    return known.select("claim_id", "subject", status.alias("evidence_status"), count("n_support").alias("n_support"), count("n_contradict").alias("n_contradict"))


def out_of_window(claims: DataFrame, requirements: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts of required concepts outside the look-back, counted by where they are: after_claim or before_lookback.

    Running counts over the days of each subject and concept, from either end; claims of one type and day share them, and no
    window holds single facts or claims.
    """
    rules = requirements.select("claim_type", "concept", "lookback_days").distinct()
    dated = claims.where("claim_date is not null").select("claim_id", "subject", "claim_type", "claim_date")
    asked = dated.select("subject", "claim_type", "claim_date").distinct().join(F.broadcast(rules), "claim_type")
    none = F.lit(None)
    days = facts.where("obs_date is not null").groupBy("subject", "concept", F.unix_date("obs_date").alias("day")).agg(F.count("fact_id").alias("n"), F.min("fact_id").alias("first"))
    days = days.select("*", none.cast("string").alias("place"), none.cast("string").alias("claim_type"), none.cast("date").alias("claim_date"))
    mark = lambda at, place: asked.select("subject", "concept", at.alias("day"), none.cast("long").alias("n"), none.cast(facts.schema["fact_id"].dataType).alias("first"), F.lit(place).alias("place"), "claim_type", "claim_date")
    line = days.unionByName(mark(F.unix_date("claim_date"), "after_claim")).unionByName(mark(F.unix_date("claim_date") - F.col("lookback_days"), "before_lookback"))
    key = Window.partitionBy("subject", "concept")
    earlier, later = (key.orderBy(day).rangeBetween(Window.unboundedPreceding, -1) for day in (F.asc("day"), F.desc("day")))  # a frame that ends at the last row is summed anew for each row
    over = lambda f, c: F.when(F.col("place") == "after_claim", f(c).over(later)).otherwise(f(c).over(earlier))
    found = line.select("subject", "claim_type", "claim_date", "concept", "place", over(F.sum, "n").alias("n_facts"), over(F.min, "first").alias("first_fact")).where("place is not null and n_facts > 0")
    return join_on(dated, found, ["subject", "claim_type", "claim_date"]).select("claim_id", "concept", "place", "n_facts", "first_fact")


def first_support(claims: DataFrame, requirements: DataFrame, facts: DataFrame) -> DataFrame:
    """The first supporting fact of each claim, by date and id."""
    rows = claim_evidence(claims, requirements, facts).where("supports")
    return rows.groupBy("claim_id").agg(F.min(F.struct("obs_date", "fact_id")).alias("first")).select("claim_id", F.col("first.fact_id").alias("fact_id"))


def unsupported(status: DataFrame, outside: DataFrame) -> DataFrame:
    """One gap for each claim without located evidence, with what was found outside the look-back."""
    notes = outside.groupBy("claim_id").agg(F.sum(F.when(F.col("place") == "after_claim", F.col("n_facts")).otherwise(0)).alias("n_after"), F.sum(F.when(F.col("place") == "before_lookback", F.col("n_facts")).otherwise(0)).alias("n_before"))
    return status.where("evidence_status = 'NO_LOCATED_EVIDENCE'").join(notes, "claim_id", "left").select("claim_id", "subject", F.coalesce("n_after", F.lit(0)).alias("n_after"), F.coalesce("n_before", F.lit(0)).alias("n_before"), F.lit("UNSUPPORTED_CLAIM").alias("gap_type"))
