"""Measurements of lines in one Arrow pass: numbers with their unit, what they are called, their range, flag and layout.

Spark deals out the lines and joins what comes of them; here a line is looked at once, from left to
right, and each field of a measurement is made once.
"""

from __future__ import annotations

import itertools
import re
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .units import NOT_ALONE, Grammar, grammar

HEADER_LINES = 4
NEAR_HEADER = 6
FLAG_REACH = 14
#: Labels, and single words, that are never what was measured.
FURNITURE = (
    "page", "report", "report no", "report number", "reg no", "mrn", "uhid", "date", "dated", "sample", "specimen", "collected", "received", "reported", "age", "sex", "gender", "dob", "patient", "name", "ref by", "referred by",
    "doctor", "physician", "consultant", "technician", "lab", "laboratory", "address", "phone", "tel", "email", "invoice", "bill", "barcode", "accession", "case ref", "case", "visit", "encounter", "admission", "discharge",
    "start date", "stop date", "list date", "report date", "printed", "signature", "verified by", "authorised by", "authorized by", "method", "instrument", "analyser", "analyzer", "units", "unit", "reference", "reference range",
    "normal range", "range", "result", "results", "value", "flag", "comment", "comments", "interpretation", "test", "tests", "investigation", "investigations", "parameter",
)
FURNITURE_WORDS = ("page", "mrn", "uhid", "reg", "barcode", "accession", "invoice", "bill", "signature", "technician", "physician", "consultant", "address", "phone", "tel", "email", "printed", "analyser", "analyzer", "instrument")
LINKING = ("by", "on", "at", "no", "number", "id", "of")
#: Forms of reference ranges, flags and dates in a cell.
RANGE = re.compile(r"\(?\s*(?:ref(?:erence)?(?:\s*(?:range|interval|value)s?)?\s*[:=]?\s*)?(?:-?\d+(?:\.\d+)?\s*(?:--|-|–|—|to)\s*-?\d+(?:\.\d+)?|[<>≤≥]\s*-?\d+(?:\.\d+)?)\s*\)?", re.I | re.A)
FLAG = re.compile(r"(?<![A-Za-z])(H{1,2}|L{1,2}|HIGH|LOW|ABN(?:ORMAL)?|CRIT(?:ICAL)?|\*)(?![A-Za-z])")
DATE_CELL = re.compile(r"(?:\d{1,2}[-/\s](?:\d{1,2}|[A-Za-z]{3,9})\.?[-/\s]\d{2,4}|\d{4}-\d{2}-\d{2}|[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4}),?", re.A)
#: A number that is no part of a range, date or clock time and no bound, with the one or two blanks behind it; a number alone; what parts cells.
NUMBER = regex.compile(r"(?<![\w.:/])(?<!\d\s?[-–—])(?<!\d\s{0,2}(?:to|--|-|–|—)\s{0,2})(?<![<>≤≥]\s{0,3})(-?\d{1,7}(?:[.,]\d{1,4})?)[ \t]{1,2}(?=\S)")
BARE_NUMBER = re.compile(r"-?\d{1,7}(?:[.,]\d{1,4})?", re.A)
CELL = re.compile(r"\s{2,}|\t+|\s*\|\s*")
_BRACKETED = re.compile(rf"\[?{RANGE.pattern}\]?", re.I | re.A)
_WORDS = re.compile(r"\S(?:\S|\s(?!\s))*", re.A)
_SPLITTERS = re.compile(r".*(?:[|;,•\t]|\s{2})", re.A | re.S)
_FIELDS = {"label": pa.string(), "value": pa.float64(), "unit": pa.string(), "unit_canonical": pa.string(), "dimension": pa.string(), "reference_range": pa.string(), "flag": pa.string(), "layout": pa.string(), "confidence": pa.float64(), "row_date": pa.string(), "at": pa.int32(), "size": pa.int32()}
_HIT = pa.struct(list(_FIELDS.items()))
_HIT_SQL = "array<struct<label:string,value:double,unit:string,unit_canonical:string,dimension:string,reference_range:string,flag:string,layout:string,confidence:double,row_date:string,at:int,size:int>>"


@lru_cache(100_000)
def clean_label(raw: str) -> str:
    """The wording without bullets, serial numbers and separators."""
    out = re.sub(r"^[\s\-*>•|]+|[\s:\-=.]+$", "", raw, flags=re.A)
    out = re.sub(r"^\d{1,3}[).]\s*", "", out, flags=re.A)
    return re.sub(r"\s{2,}", " ", out, flags=re.A).strip(" :-=.\t|")


@lru_cache(100_000)
def is_furniture(label: str) -> bool:
    """Is a label document furniture, a lone letter or empty."""
    key = re.sub(r"\s{2,}", " ", re.sub("[^a-z ]", "", label.lower()), flags=re.A).strip()
    words = key.split(" ")
    return len(key) < 2 or key in FURNITURE or any(w in FURNITURE_WORDS for w in words) or all(w in FURNITURE or w in LINKING for w in words)


def is_date(cell: str) -> bool:
    return DATE_CELL.fullmatch(cell) is not None


def aligned(header: str, at: int) -> str | None:
    """The cell of a header line that begins nearest to a column, within NEAR_HEADER characters."""
    cells = [(abs(m.start() - at), k, m[0].strip()) for k, m in enumerate(_WORDS.finditer(header))]
    apart, _, cell = min(cells, default=(NEAR_HEADER + 1, 0, ""))
    return cell if apart <= NEAR_HEADER else None


def named(line: str, hit: dict, header: str | None) -> dict:
    """A measurement beside its unit, with its label: what stands left of it, else the header's cell above, else the row's first cell."""
    bare = lambda text: re.sub(r"\s+$", "", _BRACKETED.sub(" ", text), flags=re.A)
    left, tail = bare(line[: hit["at"]]), bare(line[hit["cut"] : hit["at"]])
    label = clean_label(_SPLITTERS.sub("", tail, count=1)) or clean_label(left)
    cells = [m[0] for m in itertools.islice(_WORDS.finditer(line), 1)]
    first = cells[0] if cells else ""
    row_date = first if is_date(first) else label if is_date(label) else None
    if is_date(label):
        second = [m[0] for m in itertools.islice(_WORDS.finditer(left), 1, 2)]
        label = clean_label(second[0]) if second else ""
    layout, cell = "ROW", aligned(header, hit["at"]) if header and is_furniture(label) else None
    if cell is not None:  # a header over the value may name the value: then the row's first cell is what was measured
        layout, label = "COLUMN", clean_label(first) if is_furniture(clean_label(cell)) else clean_label(cell)
    if is_furniture(label):
        label = "" if is_furniture(clean_label(first)) else clean_label(first)
    printed = RANGE.search(line)
    base = 0.85 if layout == "COLUMN" else 0.92 if label else 0.55
    flag = FLAG.search(line[hit["at"] + hit["size"] :][:FLAG_REACH])
    return hit | {"label": label, "row_date": row_date, "layout": layout if label else "INLINE", "reference_range": printed[0].strip() or None if printed else None, "confidence": round(min(0.97, base + 0.04), 2) if printed else base, "flag": flag[1] if flag else None}


def beside(line: str, units: Grammar) -> list[dict]:
    """Numbers with a unit at most two blanks behind; cut is where the measurement before ends (0 if there is none)."""
    out, at, cut = [], 0, 0
    while found := NUMBER.search(line, at):
        end = units.longest(line, found.end())
        if end < 0:
            at = found.start() + 1
            continue
        unit = line[found.end() : end]
        if unit.strip() not in NOT_ALONE:
            spelled, kind = units.read(unit)
            out.append({"at": found.start(), "size": end - found.start(), "cut": cut, "value": float(found[1].replace(",", ".")), "unit": unit, "unit_canonical": spelled, "dimension": kind})
        at = cut = end
    return out


def in_cells(line: str, units: Grammar) -> list[dict]:
    """The measurement of a line of three cells or more whose number and unit have cells of their own, named by the first cell that is neither, nor a date."""
    cells, at = [], 0
    for gap in [*CELL.finditer(line), None]:
        text = line[at : gap.start() if gap else len(line)]
        if text.strip():
            cells.append((at + len(text) - len(text.lstrip()), text.strip()))
        at = gap.end() if gap else len(line)
    if len(cells) < 3:
        return []
    is_unit = lambda c: c not in NOT_ALONE and units.takes(c)
    u = next((k for k, (_, c) in enumerate(cells) if is_unit(c)), 0)
    v = max((k for k in range(u) if BARE_NUMBER.fullmatch(cells[k][1])), default=None)
    if v is None:
        return []
    unit, begin = cells[u][1], cells[v][0]
    words = [c for _, c in cells[:v] if not BARE_NUMBER.fullmatch(c) and not is_unit(c)]
    label = next((clean_label(c) for c in words if not is_date(c)), "")
    if is_furniture(label):
        return []
    spelled, kind = units.read(unit)
    printed = RANGE.search(line, cells[u][0] + len(unit))
    return [{
        "label": label, "value": float(cells[v][1].replace(",", ".")), "unit": unit, "unit_canonical": spelled, "dimension": kind, "reference_range": printed[0].strip() or None if printed else None, "flag": None, "layout": "COLUMN", "confidence": 0.88,
        "row_date": next((c for c in words if is_date(c)), None), "at": begin, "size": cells[u][0] + len(unit) - begin,
    }]


def has_measurement(line: Column) -> Column:
    """Does a line hold a number with its unit beside it."""

    @F.pandas_udf("boolean")
    def run(lines: pd.Series) -> pd.Series:
        units = grammar()
        return lines.map(lambda x: bool(beside(x, units)) if isinstance(x, str) else None).astype(object)

    return run(line)


def scanned(rows: DataFrame, units: Grammar) -> DataFrame:
    """Lines with measurements: their columns and hits. A header is the nearest of the four lines above that is neither blank nor has a number with its unit.

    rows: lines (page_id, line_no, line). Lines in which no digit stands before blanks and a unit's first
    character, and which have no cells beside a digit, are passed over without being looked at.
    """
    page = Window.partitionBy("page_id").orderBy("line_no")
    above = F.array(*[F.lag("line", k).over(page) for k in range(1, HEADER_LINES + 1)])
    rows = rows.withColumn("above__", F.when(F.col("line").rlike(r"\d"), above))
    names = [c for c in rows.columns if c != "above__"]
    first = re.escape("".join(units.firsts))
    near, wide = rf"\d[ \t]{{1,2}}[{first}]", r"\d.*(?:\s\s|\t|\|)|(?:\s\s|\t|\|).*\d"

    def run(batches):
        @lru_cache(10_000)
        def is_data(text: str) -> bool:
            return bool(beside(text, units))

        def header_of(above: list[str | None] | None) -> str | None:
            return next((x for x in above or () if x is not None and x.strip() and not is_data(x)), None)

        for batch in batches:
            line = batch.column("line")
            maybe = pc.match_substring_regex(line, near)
            some = batch.filter(pc.fill_null(pc.or_(maybe, pc.match_substring_regex(line, wide)), False))
            hits, at = [], []
            for k, (text, above) in enumerate(zip(some.column("line").to_pylist(), some.column("above__").to_pylist())):
                if found := beside(text, units):
                    header = header_of(above)
                    found = [named(text, hit, header) for hit in found]
                else:
                    found = in_cells(text, units)
                if found:
                    at.append(k)
                    hits.append([{f: hit[f] for f in _FIELDS} for hit in found])
            kept = some.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), pa.array(hits, pa.list_(_HIT))], [*names, "hits__"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, hits__ {_HIT_SQL}")
