"""Changes, duplicates and series over the dates of one subject and concept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .episodes import KEY, with_rules
from .keys import join_on


def representatives(facts: DataFrame) -> DataFrame:
    """One fact per date: the highest confidence, then the highest id."""
    best = Window.partitionBy(*KEY, "obs_date").orderBy(F.desc("confidence"), F.desc("fact_id"))
    return facts.where("value is not null and obs_date is not null").withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def unambiguous(facts: DataFrame) -> DataFrame:
    """Representatives of the dates on which one value (with one unit, where given) alone is stated (the other rule set)."""
    stated = F.struct("value", "unit") if "unit" in facts.columns else F.struct("value")
    one = facts.where("value is not null").groupBy(*KEY, "obs_date").agg(F.count_distinct(stated).alias("kinds")).where("kinds = 1").drop("kinds")
    return join_on(representatives(facts), one, [*KEY, "obs_date"], "left_semi")


def adjacent_changes(points: DataFrame, rules: DataFrame, same_unit: bool = False, default_window: int = 2) -> DataFrame:
    """Differing values of neighbouring dates further apart than the concept's window; with same_unit only of equal units."""
    order = Window.partitionBy(*KEY).orderBy("obs_date")
    before = lambda c: F.lag(c).over(order)
    rows = with_rules(points, rules, default_window).select(*KEY, "window_days", before("fact_id").alias("from_id"), F.col("fact_id").alias("to_id"), before("obs_date").alias("from_date"), F.col("obs_date").alias("to_date"), before("value").alias("from_value"), F.col("value").alias("to_value"), *([before("unit").alias("from_unit"), F.col("unit").alias("to_unit")] if same_unit else []))
    changed = rows.where("from_id is not null and from_value <> to_value and datediff(to_date, from_date) > window_days")
    if same_unit:
        changed = changed.where(F.col("from_unit").eqNullSafe(F.col("to_unit")))
    delta = F.round(F.col("to_value") - F.col("from_value"), 6)
    return changed.select(*KEY, "from_id", "to_id", "from_date", "to_date", delta.alias("delta"), F.when(delta > 0, "INCREASED").otherwise("DECREASED").alias("direction"))


def duplicates(facts: DataFrame) -> DataFrame:
    """Restated facts (same date and value): other_id points to primary_id, the smallest id."""
    same = Window.partitionBy(*KEY, "obs_date", F.round("value", 6))
    return facts.where("value is not null and obs_date is not null").withColumn("primary_id", F.min("fact_id").over(same)).where("fact_id <> primary_id").select(*KEY, "obs_date", F.col("fact_id").alias("other_id"), "primary_id")


def series(facts: DataFrame) -> DataFrame:
    """Series with at least two dates, one representative point a date."""
    points = representatives(facts)
    ends = lambda f, c: f(c, "obs_date")
    return points.groupBy(*KEY).agg(F.count("*").alias("n_points"), F.min("obs_date").alias("first_date"), F.max("obs_date").alias("last_date"), ends(F.min_by, "value").alias("first_value"), ends(F.max_by, "value").alias("last_value"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("obs_date", "fact_id"))), lambda x: x["fact_id"].cast("string")), ",").alias("points")).where("n_points >= 2")


def series_view(facts: DataFrame) -> DataFrame:
    """One point per date and value, so that disagreeing values of a date both stay; with the documents that restate it."""
    return facts.where("value is not null and obs_date is not null").groupBy(*KEY, "obs_date", "value").agg(F.min("fact_id").alias("fact_id"), F.count_distinct("document_id").alias("n_documents"), F.array_join(F.array_sort(F.collect_set(F.col("document_id").cast("string"))), ",").alias("documents"))
