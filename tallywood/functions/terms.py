"""Tiered terminology search: exact code, exact label, alias, prefix, fuzzy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .text import squeeze

TIERS = {1: "EXACT_CODE", 2: "EXACT_LABEL", 3: "ALIAS", 4: "PREFIX", 5: "FUZZY"}
SHARE = 0.22


def _fuzzy(q: DataFrame, c: DataFrame) -> DataFrame:
    """query, code, label, name within the allowed distance: one of distance + 1 segments of the query stands in the name, shifted by no more than the distance."""
    most = F.greatest(F.lit(1), F.floor(F.length("query") * SHARE).cast("int"))
    rows = q.withColumns({"most": most, "n": F.length("query")})
    cut = lambda i: F.floor(i * F.col("n") / (F.col("most") + 1)).cast("int")
    segments = F.transform(F.sequence(F.lit(0), F.col("most")), lambda i: F.struct(cut(i).alias("at"), F.substring(F.col("query"), cut(i) + 1, cut(i + 1) - cut(i)).alias("part")))
    asked = rows.select("query", "most", F.explode(segments).alias("s")).select("query", "most", "s.at", "s.part").where("part <> ''")
    places = F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1)))
    parts = F.flatten(F.transform(places, lambda a: F.transform(places, lambda n: F.struct((a - 1).alias("start"), F.substring(F.col("name"), a, n).alias("part")))))
    held = c.select("code", "label", "name", F.explode(parts).alias("s")).select("code", "label", "name", "s.start", "s.part").distinct()
    met = asked.join(held, "part").where((F.abs(F.col("at") - F.col("start")) <= F.col("most")) & (F.levenshtein("query", "name") <= F.col("most")))
    return met.select("query", "code", "label", "name").distinct()


def search(queries: DataFrame, concepts: DataFrame, limit: int = 8) -> DataFrame:
    """The best concepts for each distinct query text.

    queries: query; concepts: code, label, aliases. Every tier is an equi join, so neither side
    has to be small. Fuzzy matches need four letters and a distance of at most max(1, 22 % of
    the length), and need review.
    """
    q = queries.select(squeeze(F.col("query")).alias("query")).distinct()
    c = concepts.select("code", "label", squeeze(F.col("label")).alias("name"), F.transform("aliases", squeeze).alias("aliases"))
    hit = lambda keys, tier: q.join(c.select("code", "label", "name", keys.alias("query")).where("query <> ''").distinct(), "query").withColumn("tier", F.lit(tier))
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda n: F.substring(F.col("name"), F.lit(1), n)))
    exact = hit(F.lower("code"), 1).unionByName(hit(F.col("name"), 2)).unionByName(hit(F.explode("aliases"), 3)).unionByName(hit(prefixes, 4))
    near = _fuzzy(q.where(F.length("query") >= 4), c).withColumn("tier", F.lit(5))
    met = exact.unionByName(near).groupBy("query", "code", "label", "name").agg(F.min("tier").alias("tier")).withColumn("apart", F.levenshtein("query", "name"))
    best = Window.partitionBy("query").orderBy("tier", "apart", "code")
    return met.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).select("query", "code", "label", "tier", "place", (F.col("tier") == 5).alias("review_required"))


#: Vocabularies whose match kinds are told apart by match_kind.
PROVIDERS = ("RXNORM", "LOINC", "SNOMED", "ICD11")


def match_kind(system: Column, phrase: Column, display: Column, by_name: Column) -> Column:
    """EXACT, SYNONYM or APPROXIMATE for a code that a vocabulary gives for a phrase.

    Drugs: a lookup by name is exact where the preferred name is the phrase, else a synonym, and
    a search is approximate. Observations and findings: exact where the preferred term is the phrase.
    Diagnoses: exact where the lookup was by name and the title, without its markup, is the phrase.
    """
    plain = squeeze(F.regexp_replace(display, "</?em[^>]*>", ""))
    same = plain == squeeze(phrase)
    drug = F.when(~by_name, "APPROXIMATE").when(same, "EXACT").otherwise("SYNONYM")
    return F.when(system == "RXNORM", drug).when(system == "ICD11", F.when(by_name & same, "EXACT").otherwise("APPROXIMATE")).otherwise(F.when(same, "EXACT").otherwise("APPROXIMATE"))


def assertable(kind: Column) -> Column:
    """May a code of this kind of match be asserted; an approximate one never."""
    return kind.isin("EXACT", "SYNONYM")


def health(configured: Column, http_status: Column) -> Column:
    """State of a vocabulary service: UNLICENSED without credentials or when refused, UNREACHABLE without an answer, else ACTIVE."""
    return F.when(~configured | http_status.isin(401, 403), "UNLICENSED").when(http_status.isNull() | (http_status >= 500), "UNREACHABLE").otherwise("ACTIVE")


def split_by_cache(asked: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, to ask) of distinct phrases. cache: provider, kind, phrase, code; a null code says that nothing was found."""
    keys = ["provider", "kind", "phrase"]
    rows = asked.select("provider", "kind", squeeze(F.col("phrase")).alias("phrase")).distinct()
    return rows.join(cache, keys), rows.join(cache, keys, "left_anti")


def remember(cache: DataFrame, answers: DataFrame, asked: DataFrame) -> DataFrame:
    """The cache with answers and, for what was asked in vain, nulls; nothing is remembered of an unlicensed provider (asked.state)."""
    keys = ["provider", "kind", "phrase"]
    misses = asked.where("state = 'ACTIVE'").select(*keys).join(answers, keys, "left_anti").withColumn("code", F.lit(None).cast("string"))
    return cache.unionByName(answers.select(*keys, "code")).unionByName(misses)


def resolve_concept(queries: DataFrame, concepts: DataFrame) -> DataFrame:
    """The best concept of each query; null where there is none or it needs review."""
    best = search(queries, concepts, limit=1)
    rows = queries.select(squeeze(F.col("query")).alias("query")).distinct().join(best, "query", "left")
    return rows.select("query", F.when(~F.col("review_required"), F.col("code")).alias("code"), F.coalesce("review_required", F.lit(True)).alias("review_required"))


def resolution_report(lookups: DataFrame) -> DataFrame:
    """Counters of a resolution run and maps of codes by system and by match kind. lookups: state (HIT, MISS_KNOWN, ASK), system, match_kind (null: not coded)."""
    by = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n"))))
    sums = lookups.agg(F.count("*").alias("phrases"), F.count_if(F.col("state") == "HIT").alias("cache_hits"), F.count_if(F.col("state") == "MISS_KNOWN").alias("known_misses"), F.count_if(F.col("state") == "ASK").alias("asked"), F.count("match_kind").alias("coded"), F.count_if(assertable(F.col("match_kind"))).alias("assertable"), F.count_if(F.col("match_kind") == "APPROXIMATE").alias("approximate"))
    coded = lookups.where("match_kind is not null")
    maps = [coded.groupBy(c).agg(F.count("*").alias("n")).agg(by(c).alias(f"by_{c}")) for c in ("system", "match_kind")]
    return sums.select("*", maps[0].scalar().alias("by_system"), maps[1].scalar().alias("by_match_kind"))
