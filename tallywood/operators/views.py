"""Read models: metrics, timeline, graph edges, directory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(facts: DataFrame) -> DataFrame:
    """Counts of one case's facts and the share that is traceable to a document."""
    traced = F.count_if(F.col("document_id").isNotNull())
    return facts.agg(F.count("*").alias("n_facts"), F.count_distinct("subject").alias("n_subjects"), F.count_distinct("concept").alias("n_concepts"), F.count_distinct("document_id").alias("n_documents"), F.round(F.when(F.count("*") == 0, 1.0).otherwise(traced / F.count("*")), 6).alias("traceability"))


def timeline(facts: DataFrame, conflict_members: DataFrame) -> DataFrame:
    """One row per subject and day: entries in order, and how many of them are in a conflict (fact_id)."""
    marked = facts.join(conflict_members.select("fact_id").distinct().withColumn("hit", F.lit(1)), "fact_id", "left")
    rows = F.array_sort(F.collect_list(F.col("fact_id")))
    return marked.groupBy("subject", "obs_date").agg(F.count("*").alias("n_entries"), F.count("hit").alias("n_in_conflict"), F.array_join(F.transform(rows, lambda x: x.cast("string")), ",").alias("entries"))


def edges(**kinds: DataFrame) -> DataFrame:
    """rel_type, from_id, to_id from named frames with from_id and to_id."""
    parts = [df.select(F.lit(name).alias("rel_type"), F.col("from_id").cast("string"), F.col("to_id").cast("string")) for name, df in kinds.items()]
    return reduce(DataFrame.unionByName, parts)


def valid_edges(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are known nodes (node_id)."""
    ids = nodes.select(F.col("node_id").cast("string")).distinct()
    return found.join(ids.withColumnRenamed("node_id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("node_id", "to_id"), "to_id", "left_semi").select("rel_type", "from_id", "to_id")


def display_ids(rows: DataFrame, prefix: str, *order: str, group: str) -> DataFrame:
    """Numbered ids like F-001 within each group, by a total order."""
    from pyspark.sql.window import Window

    number = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("display_id", F.format_string(prefix + "-%03d", number))


def confidence_band(score):
    return F.when(score >= 0.90, "High").when(score >= 0.75, "Moderate").otherwise("Low")
