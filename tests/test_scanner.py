"""The unit automaton against a regular expression of the same atoms, and the scanner's fields."""

import pickle
import random
import re

import pytest
from pyspark.sql import functions as F

from tallywood.functions import scanner, units
from tallywood.operators import extraction

ATOMS = "|".join(re.escape(x) for x in sorted(units.forms_of(), key=len, reverse=True))
COUNT = r"(?:[xX×]\s?)?10\s?[*^]\s?-?\d{1,2}"
TERM = rf"(?:{COUNT}|{ATOMS})(?:\s?[*^]\s?-?\d{{1,2}})?"
UNIT = re.compile(rf"{TERM}(?:\s?[/.]\s?{TERM}){{0,3}}", re.A)


def longest(text: str) -> int:
    """By trying every end."""
    return max((k for k in range(1, len(text) + 1) if UNIT.fullmatch(text[:k]) and not re.match(r"[A-Za-z0-9_%]", text[k:])), default=-1)


def test_automaton_against_the_expression():
    rng, grammar = random.Random(4), units.Grammar()
    parts = ["g", "mg", "dL", "l", "mmol", "10", "^", "*", "9", "-", "3", "/", ".", " ", "x", "×", "%", "min", "h", "µ", "U", "mm[Hg]", "q", "  ", "kg", "m", "2", "da", "Pa"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert grammar.longest(text, 0) == longest(text), text
        assert grammar.takes(text) == bool(UNIT.fullmatch(text.strip())), text


@pytest.mark.parametrize(("printed", "spelled", "kind"), [("g/dl", "g/dL", "mass_per_volume"), ("µmol/L", "umol/L", "amount_per_volume"), ("x10^9/L", "10*9/L", "count_per_volume"), ("× 10 ^9 / L", "10*9/L", "count_per_volume"), ("gm/dL", "g/dL", "mass_per_volume"), ("mEq/L", "meq/L", "amount_per_volume"), ("mOsm/kg", "mosm/kg", "amount"), ("/min", "/min", "count_per_time"), ("kg/m^2", "kg/m^2", "mass"), ("fl", "fl", "volume"), ("ul", "uL", "volume"), ("gm", "gm", None), ("blob", "blob", None), ("10*3", "10*3", "count"), ("bpm", "/min", "count_per_time")])
def test_spellings_and_kinds(printed, spelled, kind):
    assert units.grammar({"bpm": "/min"}).read(printed) == (spelled, kind)


def test_a_release_widens_the_grammar(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "release.xml").write_text('<root><base-unit Code="[blob]"><property>blobness</property></base-unit><unit Code="[zap]"><property>zaps</property></unit><unit Code="g"><property>other</property></unit></root>')
    known = units.grammar(extra=units.loaded(units.atoms_of_release(spark, str(tmp_path / "in"))))
    assert known.read("[blob]/L") == ("[blob]/L", "blobness_per_volume") and known.read("g") == ("g", "mass")
    pages = extraction.lines(spark.createDataFrame([(1, "Index 4 [zap] and 5 [blob]/dl")], "page_id int, text string"))
    assert extraction.measurements(pages).count() == 0
    assert [(r.value, r.dimension) for r in extraction.measurements(pages, known).orderBy("value").collect()] == [(4.0, "zaps"), (5.0, "blobness_per_volume")]
    assert pickle.loads(pickle.dumps(known)).read("[zap]") == ("[zap]", "zaps")
    with pytest.raises(ValueError):
        units.loaded(spark.range(9).select(F.col("id").cast("string").alias("code"), F.lit("x").alias("kind")), most=8)


def test_fields_of_a_measurement(spark):
    text = "\n".join(("Analyte        Result       Range", "", "               9.2 g/dL     1.0-9.5", "Hb  9.2 g/dL H | MCV 68 fL", "18 Jan 2026  Hemoglobin  9.2  g/dL", "RBC | 4.5 | 10*12/L | 4-6", "at 10:30 min, 3-5 mg, < 7 mg", "7 mg", None or "", "x" * 30_000 + " 5 mg"))
    rows = spark.createDataFrame([(1, text, "kept"), (2, None, "kept"), (3, "", "kept")], "page_id int, text string, label2 string")
    found = extraction.measurements(extraction.lines(rows)).orderBy("span_start").collect()
    assert [text[r.span_start : r.span_end] for r in found][:5] == ["9.2 g/dL", "9.2 g/dL", "68 fL", "9.2  g/dL", "4.5 | 10*12/L"]
    assert [(r.label, r.layout, r.flag, r.row_date) for r in found[1:5]] == [("Hb", "ROW", "H", None), ("MCV", "ROW", None, None), ("Hemoglobin", "ROW", None, "18 Jan 2026"), ("RBC", "COLUMN", None, None)]
    assert len(found) == 7 and found[5].layout == "COLUMN" and found[6].value == 5.0
    assert extraction.measurements(extraction.lines(rows.limit(0))).count() == 0


def test_lines_without_a_unit_are_not_looked_at(spark):
    assert scanner.beside("nothing 12 here", units.grammar()) == []
    assert spark.range(1).select(scanner.has_measurement(F.lit("Hb 9 g/dL"))).first()[0] is True
