"""Episodes: observations of one subject and concept whose dates follow within a window.

Facts have subject, concept, fact_id, obs_date, value, unit, document_id and confidence;
subject may be null and is then a group of its own. Rules have concept, abs_limit,
rel_limit and window_days and are a small literal table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("subject", "concept")


def with_rules(facts: DataFrame, rules: DataFrame, default_window: int = 2) -> DataFrame:
    """Facts with their concept's limits; an unknown concept has none and the default window."""
    return facts.join(F.broadcast(rules), "concept", "left").withColumn("window_days", F.coalesce("window_days", F.lit(default_window)))


def _of(columns: dict[str, str]) -> Column:
    """Are the named columns equal to those beside them; nulls are equal to each other."""
    out = F.lit(True)
    for a, b in columns.items():
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def episodes(facts: DataFrame, size: str | None = None) -> DataFrame:
    """Dated facts with an episode number per subject and concept: a gap longer than the window starts a new one.

    Only dates decide, so the window runs over a key's distinct dates, and facts take up their
    episode by key and date: a key with many facts is not one task's. size: the name of a column for the number of facts of the episode.
    """
    dated = facts.where(F.col("obs_date").isNotNull())
    order = Window.partitionBy(*KEY).orderBy("obs_date")
    gap = F.datediff("obs_date", F.lag("obs_date").over(order))
    begins = F.when(gap.isNull() | (gap > F.col("window_days")), 1).otherwise(0)
    days = dated.groupBy(*KEY, "obs_date").agg(F.max("window_days").alias("window_days"), F.count("*").alias("n__")).withColumn("begins", begins)
    days = days.withColumn("episode", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    names = {k: f"{k}__" for k in (*KEY, "obs_date")}
    sizes = [F.sum("n__").over(Window.partitionBy(*KEY, "episode")).alias(size)] if size else []
    days = days.select(*[F.col(a).alias(b) for a, b in names.items()], "episode", *sizes)
    return dated.join(days, _of(names)).drop(*names.values())


def material(a: Column, b: Column, abs_limit: Column, rel_limit: Column) -> Column:
    """Do two values differ by the absolute or the relative limit; without limits, at all. Equal values never do."""
    apart = F.abs(a - b)
    scale = F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))
    by_rule = F.coalesce(apart >= abs_limit, F.lit(False)) | F.coalesce(apart / scale >= rel_limit, F.lit(False))
    return (apart > 0) & F.when(abs_limit.isNull() & rel_limit.isNull(), F.lit(True)).otherwise(by_rule)


def _differs(head: float, values: np.ndarray, limit: float | None, share: float | None) -> np.ndarray:
    """material() of one value and many that are not equal to it, for one of two limits at least."""
    with np.errstate(invalid="ignore"):
        apart = np.abs(values - head)
        part = apart / np.maximum(np.maximum(np.abs(values), abs(head)), 1e-9)
    out = np.zeros(len(values), bool)
    for x, least in ((apart, limit), (part, share)):
        if least is not None:
            out |= np.isnan(x) | (x >= least)  # as in Spark, NaN is above all numbers
    return out


class _Fold:
    """First fit over the distinct values of an episode; they may come in several parts."""

    def __init__(self, limit: float | None, share: float | None):
        self.limit, self.share, self.heads, self.count = limit, share, [], 0

    def take(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group number, first value of the group) of each value."""
        if self.limit is None and self.share is None:  # distinct values all differ
            self.count += len(values)
            return np.arange(self.count - len(values), self.count), values
        group = np.full(len(values), -1)
        for g, head in enumerate(self.heads):
            open_ = np.flatnonzero(group < 0)
            group[open_[~_differs(head, values[open_], self.limit, self.share)]] = g
        while (group < 0).any():
            open_ = np.flatnonzero(group < 0)
            fits = ~_differs(values[open_[0]], values[open_], self.limit, self.share)
            fits[0] = True
            group[open_[fits]] = len(self.heads)
            self.heads.append(values[open_[0]])
        return group, np.array(self.heads)[group]


def _changes(column: pa.Array) -> np.ndarray:
    """Is a row's value another than that of the row before it."""
    a, b = column[1:], column[:-1]
    same = pc.fill_null(pc.equal(a, b), False)
    return ~pc.or_(same, pc.and_(a.is_null(), b.is_null())).to_numpy(zero_copy_only=False)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add group_no and head_value to rows sorted by episode and first fact; only the heads of one episode are held."""
    last, fold = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k) for k in (*KEY, "episode")]
        new = np.concatenate([[tuple(k[0].as_py() for k in keys) != last], np.logical_or.reduce([_changes(k) for k in keys])])
        begin = np.unique(np.concatenate([[0], np.flatnonzero(new)]))
        end = np.append(begin[1:], batch.num_rows)
        values = batch.column("value").to_numpy(zero_copy_only=False)
        group, head = np.zeros(len(values), np.int64), values.copy()
        limits = [batch.column(k) for k in ("abs_limit", "rel_limit")]
        for a, b in zip(begin.tolist(), end.tolist()):
            if b - a == 1 and new[a] and b < len(values):
                continue  # an episode of one value
            if new[a]:
                fold = _Fold(*(x[a].as_py() for x in limits))
            group[a:b], head[a:b] = fold.take(values[a:b])
        last = tuple(k[-1].as_py() for k in keys)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group, pa.int32()), pa.array(head, pa.float64())], [*batch.schema.names, "group_no", "head_value"])


def placed_values(facts: DataFrame) -> DataFrame:
    """The distinct values of each episode with their first-fit group.

    Values are taken by their first date and id; each joins the first group whose first value
    it doesn't differ from materially, else starts one. A repeat of a value is always in the
    group of its first occurrence, so distinct values are enough. A long episode is read as a
    sorted stream and never gathered. Facts without a value have no group; NaN is equal to
    itself. Columns: key, episode, value, abs_limit, rel_limit, first_date, first_id,
    last_date, n, low_document, high_document, without (facts with no document), group_no,
    head_value.
    """
    first = F.struct("obs_date", "fact_id")
    some = facts.where(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double"))
    values = some.groupBy(*KEY, "episode", "value").agg(
        F.first("abs_limit").cast("double").alias("abs_limit"), F.first("rel_limit").cast("double").alias("rel_limit"), F.min(first).alias("first"), F.max("obs_date").alias("last_date"),
        F.count("*").alias("n"), F.min("document_id").alias("low_document"), F.max("document_id").alias("high_document"), F.count_if(F.col("document_id").isNull()).alias("without"),
    )
    rows = values.select(*KEY, "episode", "value", "abs_limit", "rel_limit", F.col("first.obs_date").alias("first_date"), F.col("first.fact_id").alias("first_id"), "last_date", "n", "low_document", "high_document", "without")
    rows = rows.repartition(*KEY, "episode").sortWithinPartitions(*KEY, "episode", "first_date", "first_id")
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema)
    return rows.mapInArrow(_place, f"{kinds}, group_no int, head_value double")


def value_groups(facts: DataFrame) -> DataFrame:
    """First-fit groups of agreeing values within each episode, one row per group.

    Columns: key, episode, group_no, head_value, first_id, n (facts), low_document,
    high_document, without (facts with no document), first_date, last_date.
    """
    return placed_values(facts).groupBy(*KEY, "episode", "group_no").agg(
        F.first("head_value").alias("head_value"), F.min_by("first_id", F.struct("first_date", "first_id")).alias("first_id"), F.sum("n").alias("n"), F.min("low_document").alias("low_document"),
        F.max("high_document").alias("high_document"), F.sum("without").alias("without"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"),
    )


def group_members(facts: DataFrame) -> DataFrame:
    """key, episode, group_no, fact_id, document_id of every fact with a value."""
    names = {k: f"{k}__" for k in (*KEY, "episode", "value")}
    placed = placed_values(facts).select(*[F.col(a).alias(b) for a, b in names.items()], "group_no")
    return facts.where(F.col("value").isNotNull()).withColumn("value", F.col("value").cast("double")).join(placed, _of(names)).select(*KEY, "episode", "group_no", "fact_id", "document_id")
