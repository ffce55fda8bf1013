"""URL filters: rule lists and trust propagated over the graph of hosts.

A rule is (action, host, path). It fits its host and all subdomains if the url's path
starts with the rule's path; the longest rule wins. Urls that no rule fits take the
verdict of their host: personalised PageRank from trusted hosts gives trust, the same on
reversed edges from blocked hosts gives distrust, and a host is blocked when its
distrust exceeds its trust by more than a margin.

Host edges are the absolute and protocol-relative links of the pages. Edges are aggregated
per pair of hosts before anything is shuffled by host, so that one large host costs its
number of distinct neighbours and not its number of pages; its verdict reaches its pages by
a bounded broadcast. With ``family`` an edge between each host and its parent is added, both
ways, where both are known; it is off unless asked for, since no page links there.

Defined cases: a null url or one without "://" has an empty host and path, fits no rule,
and is allowed; null html has no links; tied rules of equal length cannot both fit with
different actions unless the list repeats a rule, and then block wins. Repeated page_ids
give a row each; an empty table gives an empty one; without trusted (blocked) hosts all trust
(distrust) is 0; equal trust and distrust is allowed; urls of any length are read whole; other
columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_spread, settle

#: The rules of the contract: action, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
DAMPING = 0.85
ROUNDS = 100
RESIDUAL = 1e-4
MARGIN = 0.0
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, SMALL), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_name(rule: tuple[str, str, str]) -> str:
    return rule[1] + rule[2]


def fits(rule: tuple[str, str, str], host: Column, path: Column) -> Column:
    _, name, prefix = rule
    return ((host == name) | host.endswith("." + name)) & path.startswith(prefix)


def by_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest fitting rule, else nulls."""
    order = sorted(rules, key=lambda r: (-len(rule_name(r)), r[0] != "block", rule_name(r)))
    pick = lambda value: reduce(lambda rest, r: F.when(fits(r, host, path), F.lit(value(r))).otherwise(rest), reversed(order), F.lit(None).cast("string"))
    return pick(rule_name), pick(lambda r: r[0])


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts, counted over all pages."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    whole = lambda x: F.when(x.startswith("//"), F.concat(F.lit("http:"), x)).otherwise(x)
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link"))
    return found.select("src", host_of(whole(F.col("link"))).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def family_edges(hosts: DataFrame) -> DataFrame:
    """An edge between a host and its parent, both ways, where both are known."""
    up = hosts.select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst")).where("src <> dst")
    pairs = up.join(hosts.select(F.col("host").alias("dst")), "dst", "left_semi").select("src", "dst")
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(1.0))


def propagate(edges: DataFrame, seeds: DataFrame, hosts: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, residual: float = RESIDUAL) -> DataFrame:
    """host, mass: personalised PageRank from the seeds, until a round moves less than ``residual``.

    The mass of hosts without out-edges returns to the seeds, so that all masses sum to 1. Each
    round sends two sums to the driver: what is missing to 1, and how much has moved.
    """
    total = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    moves = settle(edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    n = seeds.count()
    if not n:
        return hosts.withColumn("mass", F.lit(0.0))
    start = settle(hosts.join(seeds.withColumn("seed", F.lit(1.0 / n)), "host", "left").select("host", F.coalesce("seed", F.lit(0.0)).alias("start")))
    rank = start.withColumn("mass", F.col("start"))
    for _ in range(rounds):
        got = rank.join(moves, rank["host"] == moves["src"]).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("mass") * F.col("share")).alias("got"))
        after = settle(rank.withColumnRenamed("mass", "old").join(got, "host", "left").withColumn("mass", F.col("start") * (1 - damping) + damping * F.coalesce("got", F.lit(0.0))))
        missing = F.lit(1.0 - after.agg(F.sum("mass")).first()[0])
        rank = after.select("host", "start", (F.col("mass") + F.col("start") * missing).alias("mass"), "old")
        moved = rank.agg(F.sum(F.abs(F.col("mass") - F.col("old")))).first()[0]
        rank = rank.drop("old")
        if moved < residual:
            break
    return rank.select("host", "mass")


def judge_hosts(pages: DataFrame, rules=RULES, margin: float = MARGIN, family: bool = False) -> DataFrame:
    """host, trust, distrust, host_verdict for every host of the pages.

    Seeds: a host is trusted where rules allow at least as many of its pages as they
    block and at least one, and blocked where they block more than they allow.
    """
    _, action = by_rules(F.col("host"), F.col("path"), rules)
    seen = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    stats = settle(seen.withColumn("action", action).groupBy("host").agg(F.count_if(F.col("action") == "allow").alias("allowed"), F.count_if(F.col("action") == "block").alias("blocked")).where("host <> ''"))
    hosts = stats.select("host")
    found = host_edges(pages)
    edges = settle(found.unionByName(family_edges(hosts)).groupBy("src", "dst").agg(F.sum("weight").alias("weight")) if family else found)
    known = settle(hosts.unionByName(edges.select(F.col("dst").alias("host"))).unionByName(edges.select(F.col("src").alias("host"))).distinct())
    trusted = stats.where("allowed > 0 and allowed >= blocked").select("host")
    blocked = stats.where("blocked > allowed").select("host")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    trust = propagate(edges, trusted, known).withColumnRenamed("mass", "trust")
    distrust = propagate(back, blocked, known).withColumnRenamed("mass", "distrust")
    verdict = F.when(F.col("distrust") > F.col("trust") + margin, "block").otherwise("allow")
    return trust.join(distrust, "host").withColumn("host_verdict", verdict)


def filter_urls(pages: DataFrame, rules=RULES, margin: float = MARGIN, family: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    judged = settle(judge_hosts(pages, rules, margin, family))
    rule, action = by_rules(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("rule", rule).withColumn("action", action)
    out = join_spread(rows, judged, "host")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "host_verdict", F.lit("allow")).alias("verdict"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))
