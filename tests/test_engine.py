"""Detectors on hand-built facts, and the registered queries' contract."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallywood.functions import text
from tallywood.operators import changes, claims, conflicts, episodes, extraction, gaps
from tallywood.plans import catalog
from tallywood.sources import ingest

FACT = "subject string, concept string, fact_id long, obs_date date, value double, value_key string, document_id long, confidence double"
RULES = [("hb", 0.5, None, 2)]


def facts(spark, rows):
    return spark.createDataFrame([("p", "hb", i, d, v, None, doc, 0.9) for i, d, v, doc in rows], FACT)


def rules(spark):
    return spark.createDataFrame(RULES, "concept string, abs_limit double, rel_limit double, window_days int")


def test_changes_over_months(spark):
    rows = [(1, date(2024, 1, 1), 9.2, 1), (2, date(2024, 3, 1), 10.4, 2), (3, date(2024, 6, 1), 8.7, 3)]
    found = changes.adjacent_changes(changes.representatives(facts(spark, rows)), rules(spark)).orderBy("to_date").collect()
    assert [(x.delta, x.direction) for x in found] == [(1.2, "INCREASED"), (-1.7, "DECREASED")]


def test_one_day_apart_is_a_conflict_and_no_change(spark):
    f = facts(spark, [(1, date(2024, 1, 1), 9.2, 1), (2, date(2024, 1, 2), 12.1, 2)])
    assert changes.adjacent_changes(changes.representatives(f), rules(spark)).count() == 0
    found = conflicts.numeric_conflicts(f, rules(spark)).collect()
    assert [(x.left_id, x.right_id, x.status) for x in found] == [(1, 2, "UNRESOLVED")]


def test_same_document_and_equal_values_are_no_conflict(spark):
    assert conflicts.numeric_conflicts(facts(spark, [(1, date(2024, 1, 1), 9.2, 1), (2, date(2024, 1, 1), 12.1, 1)]), rules(spark)).count() == 0
    assert conflicts.numeric_conflicts(facts(spark, [(1, date(2024, 1, 1), 9.2, 1), (2, date(2024, 1, 1), 9.2, 2)]), rules(spark)).count() == 0


def test_groups_are_first_fit_and_order_free(spark):
    rows = [(1, date(2024, 1, 1), 9.0, 1), (2, date(2024, 1, 1), 9.4, 2), (3, date(2024, 1, 2), 9.8, 3), (4, date(2024, 1, 2), 12.0, 4)]
    one = conflicts.numeric_conflicts(facts(spark, rows), rules(spark)).orderBy("left_id", "right_id").collect()
    two = conflicts.numeric_conflicts(facts(spark, rows[::-1]).repartition(3), rules(spark)).orderBy("left_id", "right_id").collect()
    assert one == two and [(x.left_id, x.right_id, x.n_left) for x in one] == [(1, 3, 2), (1, 4, 2), (3, 4, 1)]


@pytest.mark.parametrize(("stated", "want"), [("14 March 2024", "2024-03-14"), ("Mar 3, 2024", "2024-03-03"), ("2024-02-30 and 2024-02-28", None), ("05/04/2023", "2023-04-05"), ("June 2022", "2022-06-01"), ("none", None)])
def test_dates(spark, stated, want):
    assert spark.range(1).select(text.parse_date(F.lit(stated)).cast("string")).first()[0] == want


def test_measurements_in_layouts(spark):
    texts = ("Hemoglobin 9.2 g/dL (12-16)", "Hb | 9.2 g/dL | low", "Hb ..... 9.2 g/dl L", "a hemoglobin of 9.2 g/dl was seen", "at 12:30 g", "range 12-16 g/dL")
    pages = spark.createDataFrame(list(enumerate(texts)), "page_id int, text string")
    found = extraction.measurements(extraction.lines(pages)).orderBy("page_id").collect()
    assert [(x.page_id, x.value, x.unit_canonical) for x in found] == [(i, 9.2, "g/dL") for i in range(4)]


def test_offsets_slice_back(spark):
    row = ingest.raw_text(spark.createDataFrame([(["ab", "", "cdé"],)], "pages array<string>")).first()
    assert [row.raw_text[x.start : x.end] for x in row.page_offsets] == ["ab", "", "cdé"] and row.status == "INGESTED"


def test_nearest_document(spark):
    refs = spark.createDataFrame([(1, "s", "k", 9, date(2024, 1, 10))], "ref_id long, subject string, kind string, citing_doc long, citing_date date")
    docs = spark.createDataFrame([("s", "k", 1, date(2024, 1, 1)), ("s", "k", 2, date(2024, 1, 12)), ("s", "k", 9, date(2024, 1, 10)), ("s", "k", 4, date(2024, 6, 1))], "subject string, kind string, document_id long, doc_date date")
    assert gaps.nearest_documents(refs, docs).first().document_id == 2


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize(("limit", "share"), [(0.5, None), (None, 0.2), (0.5, 0.01), (None, None)])
def test_a_long_episode_is_folded_without_gathering_it(spark, limit, share):
    rng = random.Random(9)
    rows = [(i, date(2020, 1, 1) + timedelta(days=i // 20), round(rng.choice([rng.uniform(1, 4), 2.0]), 2), rng.choice([1, 2, None])) for i in range(8000)]
    rules = spark.createDataFrame([("hb", limit, share, 2)], "concept string, abs_limit double, rel_limit double, window_days int")
    differ = lambda a, b: a != b and ((limit is None and share is None) or (limit is not None and abs(a - b) >= limit) or (share is not None and abs(a - b) / max(abs(a), abs(b)) >= share))
    groups = []
    for row in rows:
        own = next((g for g in groups if not differ(g[0][2], row[2])), None)
        groups.append([row]) if own is None else own.append(row)
    want = sorted((a[0][0], b[0][0], len(a), len(b)) for i, a in enumerate(groups) for b in groups[i + 1 :] if len({x[3] for x in a + b}) > 1)
    found = conflicts.numeric_conflicts(facts(spark, rows), rules)
    assert sorted((x.left_id, x.right_id, x.n_left, x.n_right) for x in found.collect()) == want
    assert "collect_list" not in found._jdf.queryExecution().toString()
    short = rows[:150]
    dated = episodes.episodes(episodes.with_rules(facts(spark, short), rules))
    number = {r.fact_id: r.group_no for r in episodes.group_members(dated).collect()}
    doc = {r[0]: r[3] for r in short}
    edges = {(x.left_id, x.right_id) for x in conflicts.cross_members(dated).collect()}
    both = lambda a, b: len({doc[i] for i in number if number[i] in (number[a], number[b])}) > 1
    assert edges == {(a, b) for a in number for b in number if number[a] < number[b] and None not in (doc[a], doc[b]) and doc[a] != doc[b] and both(a, b)}


def test_date_extract_reads_whole_texts(spark, tmp_path):
    rows = [(5, "x " * 5000 + "on 2021-02-03 here"), (11, "x " * 30), (17, None), (0, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x.doc_date for x in catalog.date_extract(spark, str(tmp_path)).collect()}
    assert got == {5: date(2021, 2, 3), 11: None, 17: None, 0: date(2024, 3, 14)}


def test_facts_outside_the_look_back_are_counted_by_day(spark):
    """As by comparing each claim with each fact; no window sums a frame up to its last row, nor holds a hot subject's facts."""
    rng = random.Random(4)
    day = lambda: date(2024, 1, 1) + timedelta(days=rng.randint(0, 40)) if rng.random() > 0.05 else None
    noted = [(rng.choice(["p", "q", None, None]), rng.choice(["hb", "mcv", "x"]), i, day()) for i in range(400)]
    said = [(i // 2, rng.choice(["p", "r", None]), rng.choice(["low", "high", "free"]), day()) for i in range(120)]
    rules = [("low", "hb", 5), ("low", "hb", 9), ("high", "hb", 0), ("high", "mcv", 12)]
    want = []
    for claim, subject, kind, on in said:
        for _, concept, back in (r for r in rules if r[0] == kind and on):
            apart = [((on - d).days, i) for s, c, i, d in noted if s == subject and c == concept and d]
            for place, met in (("after_claim", [i for n, i in apart if n < 0]), ("before_lookback", [i for n, i in apart if n > back])):
                want += [(claim, concept, place, len(met), min(met))] if met else []
    facts_ = spark.createDataFrame(noted, "subject string, concept string, fact_id long, obs_date date")
    found = claims.out_of_window(spark.createDataFrame(said, "claim_id long, subject string, claim_type string, claim_date date"), spark.createDataFrame(rules, "claim_type string, concept string, lookback_days int"), facts_)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want) and len(want) > 100
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a_large_episode_is_compared_in_blocks(spark):
    """All pairs of an episode that many tasks share; a null subject is one of its own, and no task joins more than a block with a block."""
    rng = random.Random(6)
    rows = [(rng.choice(["p", None]), "hb", i, date(2024, 1, 1) + timedelta(days=i % 3), float(rng.randint(0, 4)), None, rng.choice([1, 2, 3, None]), 0.9) for i in range(120)]
    found = conflicts.materiality_pairs(spark.createDataFrame(rows, FACT), rules(spark), block=10)
    want = sorted((a[2], b[2], round(b[4] - a[4], 6)) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and a[6] and b[6] and a[6] != b[6] and abs(a[4] - b[4]) >= 0.5)
    assert sorted((r.left_id, r.right_id, r.delta) for r in found.collect()) == want and len(want) > 500
    assert "left_block" in found._jdf.queryExecution().optimizedPlan().toString() and found.columns == ["subject", "concept", "episode", "left_id", "right_id", "delta"]
