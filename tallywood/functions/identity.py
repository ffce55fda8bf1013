"""Names and the rules that link an identity statement to a registry."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that are no part of a name.
TITLES = ("mr", "mrs", "ms", "miss", "master", "dr", "prof", "sri", "smt", "shri", "baby", "jr", "sr", "ii", "iii", "iv", "md", "mbbs", "do", "phd", "dm", "mch", "frcp", "facs")


@F.pandas_udf(StringType())
def fold(name: pd.Series) -> pd.Series:
    """Letters without accents (compatibility decomposition); null stays null."""
    return name.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def name_key(folded: Column) -> Column:
    """Sorted lower-case words without titles and remarks in brackets."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(folded), r"\([^)]*\)", " "), "[^a-z]+", " ")), " ")
    return F.array_join(F.array_sort(F.filter(words, lambda w: (w != "") & ~w.isin(*TITLES))), " ")


def link(statements: DataFrame, registry: DataFrame) -> DataFrame:
    """Link by number, then by name and birth date; conflicts and several hits are never decided.

    statements: stmt_id, mrn, name_key, dob; registry: ref, mrn, name_key, dob.
    """
    by_number = statements.where("mrn is not null").join(registry.select("mrn", F.col("ref").alias("ref_n"), F.col("name_key").alias("name_n")), "mrn").groupBy("stmt_id").agg(F.count("*").alias("n_mrn"), F.min("ref_n").alias("ref_mrn"), F.min("name_n").alias("name_mrn"))
    by_name = statements.where("dob is not null").join(registry.select("name_key", "dob", F.col("ref").alias("ref_d")), ["name_key", "dob"]).groupBy("stmt_id").agg(F.count("*").alias("n_dob"), F.min("ref_d").alias("ref_dob"))
    rows = statements.join(by_number, "stmt_id", "left").join(by_name, "stmt_id", "left")
    empty = F.col("mrn").isNull() & (F.coalesce("name_key", F.lit("")) == "")
    rule = (
        F.when(empty, "EMPTY").when((F.col("n_mrn") == 1) & ((F.coalesce("name_key", F.lit("")) == "") | (F.col("name_key") == F.col("name_mrn"))), "MRN").when(F.col("n_mrn") == 1, "MRN_CONFLICT").when(F.col("n_mrn") > 1, "AMBIGUOUS")
        .when(F.size(F.split("name_key", " ")) < 2, "INSUFFICIENT").when(F.col("n_dob") == 1, "NAME_DOB").when(F.col("n_dob") > 1, "AMBIGUOUS").when(F.col("dob").isNull(), "INSUFFICIENT").otherwise("NEW_PATIENT")
    )
    rows = rows.withColumn("rule", rule)
    return rows.select("stmt_id", "rule", F.when(F.col("rule") == "MRN", F.col("ref_mrn")).when(F.col("rule") == "NAME_DOB", F.col("ref_dob")).alias("ref"))
