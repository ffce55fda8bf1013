"""Text functions as Column expressions: dates, measurements, cues, negation, labels."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names by number.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"


def _month_number(name: Column) -> Column:
    """Two digits of a month by the first three letters of its name; the name is one of MONTHS' forms."""
    at = F.call_function("locate", F.substring(F.lower(name), 1, 3), F.lit("".join(MONTHS)))
    return F.lpad(F.floor((at + 2) / 3).cast("string"), 2, "0")


def dated(text: Column) -> Column:
    """struct<date, precision> by the first form that gives a real date: d Mon yyyy, Mon d, yyyy, yyyy-mm-dd, d/m/yyyy, Mon yyyy (its first day, precision month)."""

    def made(low: Column, pattern: str, year: int, month: int, day: int | None, named: bool) -> Column:
        part = lambda k: F.regexp_extract(low, pattern, k)
        m = _month_number(part(month)) if named else F.lpad(part(month), 2, "0")
        d = F.lit("01") if day is None else F.lpad(part(day), 2, "0")
        return F.struct(F.concat_ws("-", part(year), m, d).alias("iso"), F.lit("month" if day is None else "day").alias("precision"))

    #: The forms, in their order.
    forms = (
        (rf"\b(\d{{1,2}})\s+{_MONTH}\.?,?\s+(\d{{4}})\b", 3, 2, 1, True),
        (rf"\b{_MONTH}\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b", 3, 1, 2, True),
        (r"\b(\d{4})-(\d{2})-(\d{2})\b", 1, 2, 3, False),
        (r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", 3, 2, 1, False),
        (rf"\b{_MONTH}\.?\s+(\d{{4}})\b", 2, 1, None, True),
    )

    def first(low: Column) -> Column:
        read = F.transform(F.array(*[made(low, *form) for form in forms]), lambda x: F.struct(F.when(x["iso"].rlike(r"^\d{4}-\d{2}-\d{2}$"), x["iso"].try_cast("date")).alias("date"), x["precision"].alias("precision")))
        return F.when(low.isNotNull(), F.get(F.filter(read, lambda x: x["date"].isNotNull()), F.lit(0)))

    return F.get(F.transform(F.array(F.lower(text)), first), F.lit(0))  # the text is made once, not for each part of each form


def parse_date(text: Column) -> Column:
    return dated(text)["date"]


#: Words that label a document's date.
DATE_LABELS = ("report date", "reported on", "date of report", "consultation date", "follow-?up date", "list date", "discharge date", "admission date", "compiled", "sample date", "date")


def document_date(text: Column) -> Column:
    """struct<date, precision, labelled>: the first labelled date, but the last one labelled as report or discharge date where there is one; else the first date of the text."""
    stated = F.regexp_extract_all(text, F.lit(rf"(?i)(?:{'|'.join(DATE_LABELS)})\s*[:\-]\s*[^\n]{{4,40}}"), F.lit(0))
    ranked = F.transform(stated, lambda x, i: F.struct(F.when(F.lower(x).rlike("discharge date|report date"), -i - 1).otherwise(i).alias("rank"), F.lit(True).alias("labelled"), dated(F.regexp_extract(x, r"[:\-]\s*([^\n]*)$", 1)).alias("d")))
    best = F.array_min(F.filter(ranked, lambda x: x["d"].isNotNull()))  # the last strong label, else the first of all
    return F.coalesce(
        F.transform(F.array(best), lambda b: F.when(b.isNotNull(), F.struct(b["d"]["date"].alias("date"), b["d"]["precision"].alias("precision"), F.lit(True).alias("labelled"))))[0],
        F.transform(F.array(dated(text)), lambda a: F.struct(a["date"].alias("date"), F.coalesce(a["precision"], F.lit("unknown")).alias("precision"), F.lit(False).alias("labelled")))[0],
    )


def classify(text: Column, cues: dict[str, tuple[str, ...]], other: str = "OTHER", filename: Column | None = None, hints: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The class with the highest score: 3 for each cue phrase in the text, 2 where the file's name holds a hint of it.

    Ties go to the class named first (those of cues before those of hints alone); no score gives ``other``.
    """
    low, hints = F.lower(text), (hints or {}) if filename is not None else {}
    names = [*cues, *(k for k in hints if k not in cues)]

    def score(k: str) -> Column:
        parts = [F.when(low.contains(p), 3).otherwise(0) for p in cues.get(k, ())]
        if hints.get(k):
            parts.append(F.when(reduce(lambda a, b: a | b, [F.lower(filename).contains(p) for p in hints[k]]), 2).otherwise(0))
        return F.coalesce(reduce(lambda a, b: a + b, parts, F.lit(0)), F.lit(0))

    if not names:
        return F.lit(other)
    scores = {k: score(k) for k in names}
    best = F.greatest(*scores.values()) if len(scores) > 1 else next(iter(scores.values()))
    return reduce(lambda rest, k: F.when((best > 0) & (scores[k] == best), F.lit(k)).otherwise(rest), reversed(names), F.lit(other))


def mentions(text: Column, term: str) -> Column:
    """Whole-word containment among lower-case letters and digits; the term is taken literally."""
    return F.lower(text).rlike(rf"(?<![a-z0-9]){re.escape(term)}(?![a-z0-9])")


def mentions_any(text: Column, terms: Column) -> Column:
    """Is one of the terms (an array column of words) a whole word of the text."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9-]+"), F.lit(0))
    return F.arrays_overlap(F.array_union(words, F.flatten(F.transform(words, lambda w: F.split(w, "-")))), terms)


#: Words that make a statement hypothetical.
HYPOTHETICAL = r"(?i)(?:\b(?:if|should|unless|to (?:exclude|rule out|assess for)|query|consider|suspected|possible|cannot exclude|r/o|rule out|advise|recommend(?:ed)?|plan(?:ned)?\s+for|awaiting|pending)\b|\?)"


def hypothetical(line: Column) -> Column:
    return line.rlike(HYPOTHETICAL)


def negated(text: Column, term: str, words=("no", "not", "without", "denies")) -> Column:
    """Is the first mention preceded by a negation within 24 characters."""
    at = F.locate(term, F.lower(text))
    before = F.substring(F.lower(text), F.greatest(at - 24, F.lit(1)), F.least(F.lit(24), F.greatest(at - 1, F.lit(0))))
    return (at > 0) & before.rlike(rf"\b({'|'.join(words)})\b")


def slug(label: Column, size: int = 48) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, size)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
