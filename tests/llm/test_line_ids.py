"""Line dedup: null and repeated ids, ties, empty tables, clashing columns."""

import pytest

pytest.importorskip("tallywood.llm")
from tallywood.llm import linededup

LINE, NEAR = "a line of more than twenty characters", "a line of more than twenty charicters"


def dedup(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, h1 string, n_lines int, place int").repartition(3)
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in linededup.dedup_lines(docs).collect()), key=str)


@pytest.mark.parametrize("line", [LINE, NEAR, "short"])
def test_a_null_id_comes_first(spark, line):
    first = LINE if line == NEAR else line
    assert dedup(spark, [(5, line), (None, first), (-3, "other")]) == [(-3, "other", 1, 0), (5, "", 1, 1), (None, first, 1, 0)]


def test_rows_of_one_id_are_one_document(spark):
    assert dedup(spark, [(7, LINE), (7, LINE + "\nmore"), (8, LINE)]) == [(7, LINE, 1, 0), (7, LINE + "\nmore", 2, 0), (8, "", 1, 1)]
    assert dedup(spark, [(None, LINE), (None, LINE)]) == [(None, LINE, 1, 0)] * 2


def test_nulls_blanks_and_no_rows(spark):
    assert dedup(spark, [(1, None), (2, ""), (3, " \n "), (4, "a\n\na")]) == [(1, None, 0, 0), (2, "", 1, 0), (3, " \n ", 2, 0), (4, "a\n", 3, 1)]
    assert dedup(spark, [(1, LINE)])[:0] == []
