"""The engine's inputs, mapped from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: concept, abs_limit, rel_limit, window_days, value from which the class is HIGH
RULES = (("view", 20.0, None, 2, 50.0), ("signup", None, 0.5, 1, 50.0), ("click", 15.0, 0.4, 3, 50.0), ("error", 30.0, None, 0, 50.0), ("purchase", None, 0.25, 2, 50.0))
#: claim_type, concept, op, threshold, lookback_days
REQUIREMENTS = (("signup", "view", "gt", 10.0, 5), ("signup", "click", "lte", 200.0, 3), ("purchase", "click", "gte", 5.0, 7))
CONCEPTS = (("C1", "red widget", ("crimson widget",)), ("C2", "blue bolt", ("azure bolt", "bolt blue")), ("C3", "hot gear", ()), ("C4", "small ring", ("tiny ring",)), ("C5", "red bolt", ()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(table(spark, sf_dir, "events"))


def facts_of(e: DataFrame) -> DataFrame:
    """Facts of events, a table or a stream."""
    document = F.get_json_object("props", "$.k").cast("long")
    subject = F.when(F.col("user_id") % 50 != 0, F.col("user_id"))  # the others are not resolved to anyone
    return e.select(subject.alias("subject"), F.col("event_type").alias("concept"), F.col("event_id").alias("fact_id"), F.to_date("ts").alias("obs_date"), "value", F.when(F.col("value") >= 50, "HIGH").when(F.col("value") >= 10, "MID").otherwise("LOW").alias("value_key"), document.alias("document_id"), F.round((F.col("event_id") % 10) / 10, 1).alias("confidence"))


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([r[:4] for r in RULES], "concept string, abs_limit double, rel_limit double, window_days int")


def requirements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(REQUIREMENTS), "claim_type string, concept string, op string, threshold double, lookback_days int")


def concepts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, list(c)) for a, b, c in CONCEPTS], "code string, label string, aliases array<string>")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir).where(F.col("concept").isin("signup", "purchase", "error")).select(F.col("fact_id").alias("claim_id"), "subject", F.col("concept").alias("claim_type"), F.col("obs_date").alias("claim_date"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders cite the shipments of the same order."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("ref_id"), F.col("o_orderkey").alias("subject"), F.lit("SHIPMENT").alias("kind"), F.lit(-1).cast("long").alias("citing_doc"), F.to_date("o_orderdate").alias("citing_date"))


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("d")).select(F.col("l_orderkey").alias("subject"), F.lit("SHIPMENT").alias("kind"), F.col("l_linenumber").cast("long").alias("document_id"), F.to_date("d").alias("doc_date"))
