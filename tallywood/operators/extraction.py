"""Extraction: pages of text to measurements, observations, claims, medications, findings, references and follow-ups.

All of it is Column expressions over lines. pages: page_id, text, and what the caller carries
along. A line keeps its offsets in the page, so every item can be traced to its words.
Vocabularies (synonyms, claim patterns, phrases) are small literal tables of the caller.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import units
from ..functions.scanner import has_measurement, scanned
from ..functions.text import dated, document_date, hypothetical
from ..sources.tables import settle

#: Words without meaning for a label.
STOPWORDS = (
    "the", "a", "an", "of", "was", "is", "were", "are", "with", "and", "on", "at", "in", "for", "patient", "patients", "his", "her", "their", "s", "shows", "showed", "showing", "noted", "recorded", "reported", "records", "summary",
    "report", "value", "result", "level", "levels", "count", "serum", "plasma", "blood", "whole", "venous", "arterial", "capillary", "total", "measured", "admission", "discharge", "today", "repeat",
)


def lines(pages: DataFrame) -> DataFrame:
    """One row a line: line_no, line, line_start and line_end in the page, and the page's other columns.

    A null text has no lines. Offsets are running sums over a page's lines.
    """
    rest = [c for c in pages.columns if c != "text"]
    rows = pages.where("text is not null").select(*rest, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    return rows.withColumn("line_start", start).withColumn("line_end", F.col("line_start") + F.length("line"))


# --- measurements ---------------------------------------------------------------------
def measurements(rows: DataFrame, grammar: units.Grammar | None = None) -> DataFrame:
    """All measurements of the lines: numbers beside their unit, labelled by place; on lines without such, those whose number and unit have cells of their own.

    rows: lines. Adds label, value, unit, unit_canonical, dimension, span_start, span_end, reference_range, flag, layout,
    confidence and row_date. grammar: the units to be found (units.grammar(), or one with a loaded release's atoms).
    """
    found = scanned(rows, grammar or units.grammar()).select(*rows.columns, F.explode("hits__").alias("hit")).select(*rows.columns, "hit.*")
    return found.withColumns({"span_start": F.col("line_start") + F.col("at"), "span_end": F.col("line_start") + F.col("at") + F.col("size")}).drop("at", "size")


# --- labels ---------------------------------------------------------------------------
def _normal(label: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(label), r"[^a-z0-9 %/\-]", " "), r"\s+", " "), r"^[ \-:]+|[ \-:]+$", "")


def _undotted(label: Column) -> Column:
    """M.C.V. as MCV: up to eight dotted letters in a row."""
    out = label
    for _ in range(3):
        out = F.regexp_replace(out, r"\b([A-Za-z]{1,4})\s*\.\s*(?=[A-Za-z](?:[.\s]|$))", "$1")
    return F.regexp_replace(out, r"\b([A-Za-z]{2,8})\.", "$1")


def _runs(words: Column, longest: int) -> Column:
    """All runs of 1..longest neighbouring words."""
    n = F.size(words)
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.greatest(n, F.lit(1))))
    return F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.struct(F.array_join(F.slice(words, i, k), " ").alias("run"), (i == 1).alias("begins"), (i + k - 1 >= n).alias("ends")))))


def resolve_labels(found: DataFrame, synonyms: DataFrame, longest: int | None = None) -> DataFrame:
    """Adds concept and match to rows with a label.

    synonyms: surface (normalised), concept. A label is EXACT when a synonym is all of it, its
    beginning or its end (dotted abbreviations undotted), CONTAINED when its words but for
    stop words contain one; the longest synonym wins. Others are UNRECOGNISED and get the
    concept unmapped:<slug>, or null where nothing is left. Distinct labels meet the synonyms by equi joins,
    in runs of as many words as the longest synonym has. found is read twice: give a written table where it is dear.
    """
    if longest is None:
        longest = synonyms.agg(F.max(F.size(F.split("surface", " ")))).first()[0] or 1
    labels = found.select("label").distinct()
    normal, undot = _normal(F.col("label")), _normal(_undotted(F.col("label")))
    cut = lambda c: F.filter(F.split(c, r"[^a-z0-9%]+"), lambda w: (w != "") & ~w.isin(*STOPWORDS))
    whole = labels.select("label", F.explode(F.array_union(_runs(F.split(normal, " "), longest), _runs(F.split(undot, " "), longest))).alias("r")).where("r.begins or r.ends").select("label", F.col("r.run").alias("surface"), F.lit(1).alias("rank"))
    inside = labels.select("label", F.explode(_runs(cut(undot), longest)).alias("r")).select("label", F.col("r.run").alias("surface"), F.lit(2).alias("rank"))
    best = F.struct("rank", -F.length("surface"), "surface", "concept")
    hit = whole.unionByName(inside).where("surface <> ''").join(synonyms.select("surface", "concept"), "surface").groupBy("label").agg(F.min(best).alias("b"))
    hit = hit.select(F.col("label").alias("label__"), F.col("b.concept").alias("known"), F.when(F.col("b.rank") == 1, "EXACT").otherwise("CONTAINED").alias("how"))
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.array_join(cut(_normal(_undotted(F.col("label")))), " "), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 48)
    rows = found.join(hit, F.col("label") == F.col("label__"), "left").drop("label__")
    concept = F.coalesce("known", F.when(slug != "", F.concat(F.lit("unmapped:"), slug)))
    return rows.withColumns({"concept": concept, "match": F.coalesce("how", F.lit("UNRECOGNISED"))}).drop("known", "how")


def match_concept(surface: Column, synonyms: dict[str, str]) -> Column:
    """The concept of which a synonym is all of a text, its first or its last words; the longest wins, else null."""
    low = _normal(surface)
    out = F.lit(None).cast("string")
    for words in sorted(synonyms, key=lambda w: (len(w), w)):
        out = F.when((low == words) | low.startswith(words + " ") | low.endswith(" " + words), synonyms[words]).otherwise(out)
    return out


def normalise_unit(value: Column, unit: Column, wanted: Column) -> tuple[Column, Column]:
    """(value, unit) in the concept's unit where an exact factor is known, else as printed."""
    same = F.lower(units.canonical(unit)) == F.lower(units.canonical(wanted))
    scaled = units.convert(value, unit, wanted)
    return F.when(same | wanted.isNull(), value).otherwise(F.coalesce(scaled, value)), F.when(wanted.isNotNull() & (same | scaled.isNotNull()), wanted).otherwise(units.canonical(unit))


def normalise_drug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\s+", " "), r"[.,;:]+$", "")


# --- dates of items -------------------------------------------------------------------
_DATE = r"(\d{1,2}\s+[A-Za-z]{3,9}\.?\s+\d{4}|\d{4}-\d{2}-\d{2})"
ROW_DATE = r"^\s*(\d{1,2}\s+[A-Za-z]{3,9}\.?\s+\d{4})\s{2,}"
DATED = rf"(?i)\bdated\s+{_DATE}"
#: Kinds of documents that a sentence may cite with their date.
CITED = rf"(?i)(?:discharge\s+summary|cbc|complete\s+blood\s+count|consultation(?:\s+note)?|prescription|medication\s+list|referral(?:\s+letter)?|ferritin\s+report|laboratory\s+summary|lab(?:oratory)?\s+report|report)\s+dated\s+(?:\d{{1,2}}\s+[A-Za-z]{{3,9}}\.?\s+\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}})"


def attribute_dates(rows: DataFrame, default: Column, precision: Column) -> DataFrame:
    """Adds obs_date, date_precision and date_basis to lines (with page_id and line offsets) before items are cut from them.

    In order: a date that leads the row; the last "dated" of the line; the date with which the
    page cites the document that the sentence names last; the last "dated" within the 240
    characters before the line; the default.
    """
    page = Window.partitionBy("page_id")
    before = page.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    says = F.lower("line").contains("dated")  # both expressions hold this word
    all_of = lambda pattern, k: F.when(says, F.regexp_extract_all("line", F.lit(pattern), F.lit(k))).otherwise(F.array().cast("array<string>"))
    every = all_of(DATED, 1)
    own = dated(F.try_element_at(every, F.lit(-1)))
    cited = all_of(CITED, 0)
    named = F.transform(cited, lambda x: F.struct(F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"\s+", " "), r" dated .*$", "")).alias("noun"), dated(x).alias("d")))
    rows = rows.withColumn("own__", own)
    near = F.struct(F.col("own__").alias("d"), (F.col("line_start") + F.length(F.substring_index(F.lower("line"), "dated", -1)) * -1 + F.length("line")).alias("at"))
    marked_ = rows.withColumns({"row__": dated(F.nullif(F.regexp_extract("line", ROW_DATE, 1), F.lit(""))), "named__": F.flatten(F.collect_list(named).over(page)), "near__": F.last(F.when(F.col("own__").isNotNull(), near), ignorenulls=True).over(before)})
    low = F.regexp_replace(F.lower("line"), r"\s+", " ")
    hits = F.transform(F.filter("named__", lambda x: x["d"].isNotNull() & F.contains(low, x["noun"])), lambda x: F.struct((F.length(low) - F.length(F.call_function("substring_index", low, x["noun"], F.lit(-1)))).alias("at"), F.length(x["noun"]).alias("n"), x["d"].alias("d")))
    close = F.when(F.col("near__.at") >= F.col("line_start") - 240, F.col("near__.d"))
    basis = F.when(F.col("row__").isNotNull(), "row").when(F.col("own__").isNotNull(), "attributed").when(F.size(hits) > 0, "cited").when(close.isNotNull(), "attributed").otherwise("document")
    best = F.coalesce("row__", "own__", F.array_max(hits)["d"], close, F.struct(default.cast("date").alias("date"), precision.alias("precision")))
    return marked_.withColumns({"obs_date": best["date"], "date_precision": best["precision"], "date_basis": basis}).drop("row__", "own__", "named__", "near__")


# --- items ----------------------------------------------------------------------------
def observations(rows: DataFrame, synonyms: DataFrame, concept_units: DataFrame | None = None, grammar: units.Grammar | None = None) -> DataFrame:
    """Observations of lines that have their dates: labelled measurements with a concept, one for each line and concept.

    Doses (an unrecognised label with a plain amount) are no observations. Confidence is capped
    by how the label was read: 0.86 contained, 0.72 unrecognised, 0.93 in a row with its own date.
    concept_units: concept, wanted.
    """
    found = resolve_labels(settle(measurements(rows, grammar)), synonyms).where("concept is not null")
    found = found.where(~((F.col("match") == "UNRECOGNISED") & units.amount_like(F.col("dimension"))))
    cap = F.when(F.col("match") == "CONTAINED", 0.86).when(F.col("match") == "UNRECOGNISED", 0.72).otherwise(1.0)
    found = found.withColumn("confidence", F.least("confidence", cap, F.when(F.col("date_basis") == "row", 0.93).otherwise(1.0)))
    if concept_units is not None:
        found = found.join(F.broadcast(concept_units.select("concept", "wanted")), "concept", "left")  # the caller's literal table
        value, unit = normalise_unit(F.col("value"), F.col("unit"), F.col("wanted"))
        found = found.withColumns({"value": value, "unit_canonical": unit}).drop("wanted")
    first = Window.partitionBy("page_id", "line_no", "concept").orderBy("span_start")
    return found.withColumn("place__", F.row_number().over(first)).where("place__ = 1").drop("place__")


def claims(rows: DataFrame, patterns: list[tuple[str, str]], with_values: tuple[str, ...] = (), cues: tuple[str, ...] = ("assessment", "impression", "diagnosis", "conclusion", "condition at discharge")) -> DataFrame:
    """Claims of lines: page_id, line_no, claim_type, claim_text, line offsets, confidence.

    patterns: (claim_type, phrase) in order. Each pattern claims at most one line of a page, the
    first that no earlier pattern has claimed; a line that reports a laboratory value is no claim but for
    with_values. Confidence is 0.95 where a cue stands in the line or the 400 characters before it, else 0.82.
    """
    low = F.lower("line")
    listed = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(t).alias("claim_type"), F.lit(p).alias("phrase")) for i, (t, p) in enumerate(patterns)])
    valued = F.col("line").rlike(r"(?i)\b\d+(\.\d+)?\s*(g/dL|fL|pg|ng/mL|mg/dL)\b")
    hits = F.filter(listed, lambda p: F.contains(low, p["phrase"]) & (~valued | p["claim_type"].isin(*with_values) if with_values else ~valued))
    here = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    cue = reduce(lambda a, b: a | b, [low.contains(c) for c in cues])
    seen = F.last(F.when(cue, F.col("line_end")), ignorenulls=True).over(here)
    found = rows.withColumn("confidence", F.when(seen >= F.col("line_start") - 400, 0.95).otherwise(0.82)).withColumn("hit", F.explode(hits)).where(F.trim("line") != "")
    ordered = F.array_sort(F.collect_list(F.struct("hit.k", "line_no", "hit.claim_type", "line", "line_start", "line_end", "confidence")))
    none = F.filter(ordered, lambda x: F.lit(False))
    taken = F.aggregate(ordered, none, lambda out, x: F.when(F.exists(out, lambda y: (y["k"] == x["k"]) | (y["line_no"] == x["line_no"])), out).otherwise(F.array_append(out, x)))
    return found.groupBy("page_id").agg(taken.alias("taken")).select("page_id", F.explode("taken").alias("c")).select("page_id", "c.line_no", "c.claim_type", F.regexp_replace(F.trim("c.line"), r"[. ]+$", "").alias("claim_text"), "c.line_start", "c.line_end", "c.confidence")


#: How medications are written.
_DOSE = r"(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|iu|units?)"
MED_TABLE = rf"(?i)^[ \t]*([A-Za-z][A-Za-z '\-]{{2,38}}?)\s{{2,}}{_DOSE}\s{{2,}}([A-Za-z ]{{2,20}}?)\s{{2,}}([A-Za-z]{{2,12}})\s{{2,}}([A-Za-z]{{3,12}})\s*$"
MED_LINE = rf"(?i)^[ \t]*(?:\d+[.)]\s*)?([A-Za-z][A-Za-z '\-]{{2,38}}?)\s+{_DOSE}(.*)$"
FREQUENCIES = ("once daily", "twice daily", "three times daily", "at night", "as required", "every 8 hours", "every 12 hours", "od", "bd", "tds")
ROUTES = ("oral", "iv", "intravenous", "im", "subcutaneous", "topical")
NOT_DRUGS = (
    "page", "date", "case ref", "reference", "test", "result", "drug", "hemoglobin", "haemoglobin", "mcv", "mch", "mchc", "rdw", "wbc", "rbc", "platelet count", "hematocrit", "hb", "serum ferritin", "serum creatinine", "plt",
    "tlc", "pcv", "glucose", "ferritin", "creatinine",
)


def medications(rows: DataFrame, doc_type: Column, record_date: Column, drug_synonyms: dict[str, str] | None = None) -> DataFrame:
    """Medication entries of lines: table rows, and lines with their indented continuation.

    Without a stated status an entry is ACTIVE in a prescription or a medication list and
    DOCUMENTED elsewhere: the document's role, nothing about the patient.
    """
    page = Window.partitionBy("page_id").orderBy("line_no")
    goes_on = F.col("line").rlike(r"^(?:    |\t)") & (F.trim("line") != "") & ~F.col("line").rlike(r"^\s*(?:\d+[.)]|-{5,})")
    rows = rows.withColumns({"doc_type__": doc_type, "record__": record_date})
    blocks = rows.withColumn("block_no", F.sum(F.when(goes_on, 0).otherwise(1)).over(page))
    text = blocks.groupBy("page_id", "block_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("block"))
    rows = blocks.join(text, ["page_id", "block_no"])
    get = lambda pattern, k: F.regexp_extract("line", pattern, k)
    is_table, is_line = F.col("line").rlike(MED_TABLE), F.col("line").rlike(MED_LINE) & ~F.lower("line").rlike("reference|result|unit  ")
    pick = lambda k: F.when(is_table, get(MED_TABLE, k)).otherwise(get(MED_LINE, k))
    low = F.lower("block")
    first = lambda words, test: F.coalesce(*[F.when(test(w), w) for w in words])
    word = lambda w: low.rlike(rf"\b{w}\b")
    said = F.upper(get(MED_TABLE, 6))
    stated = F.when(is_table, F.when(said.startswith("ACTIV"), "ACTIVE").otherwise(said)).when(word("active"), "ACTIVE").when(low.rlike(r"\b(?:stopped|discontinued|ceased)\b"), "STOPPED")
    norm = normalise_drug(pick(1))
    for surface, name in (drug_synonyms or {}).items():
        norm = F.when(norm == surface, name).otherwise(norm)
    on = lambda label: dated(F.nullif(F.regexp_extract("block", rf"(?i){label} date\s*[:\-]?\s*([^\n]{{4,30}})", 1), F.lit("")))["date"]
    out = rows.where(is_table | is_line).withColumn("drug_norm", norm).where((F.length("drug_norm") >= 3) & ~F.col("drug_norm").isin(*NOT_DRUGS))
    return out.select(
        "page_id", "line_no", "line_start", "line_end", F.trim(pick(1)).alias("drug_name"), "drug_norm", pick(2).cast("double").alias("dose"), F.lower(pick(3)).alias("unit"),
        F.when(is_table, F.trim(get(MED_TABLE, 4))).otherwise(first(FREQUENCIES, low.contains)).alias("frequency"), F.when(is_table, F.lower(get(MED_TABLE, 5))).otherwise(first(ROUTES, word)).alias("route"),
        F.coalesce(stated, F.when(F.col("doc_type__").isin("PRESCRIPTION", "MEDICATION_LIST"), "ACTIVE").otherwise("DOCUMENTED")).alias("status"),
        on("start").alias("start_date"), on("stop(?:ped)?").alias("stop_date"), F.col("record__").alias("record_date"), F.when(is_table, 0.96).otherwise(0.94).alias("confidence"),
    )


def findings(rows: DataFrame, phrases: list[tuple[str, str, str, bool | None]], anchored: tuple[str, ...] = ()) -> DataFrame:
    """Qualitative findings of lines: concept, value_key, surface_form and where it stands.

    phrases: (phrase, concept, value_key, positive). Longer phrases go first and take their
    place; a phrase counts between word bounds alone, an anchored one behind a separator alone,
    a positive one not behind a negation. A hypothetical line states nothing.
    """
    order = sorted(range(len(phrases)), key=lambda i: (-len(phrases[i][0]), i))
    listed = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(phrases[i][0].lower()).alias("phrase"), F.lit(phrases[i][1]).alias("concept"), F.lit(phrases[i][2]).alias("value_key"), F.lit(phrases[i][3]).cast("boolean").alias("positive")) for k, i in enumerate(order)])
    low = F.lower("line")
    met = rows.where(~hypothetical(low)).withColumn("p", F.explode(F.filter(listed, lambda p: F.contains(low, p["phrase"]))))
    pieces = F.split(low, F.concat(F.lit(r"\Q"), F.col("p.phrase"), F.lit(r"\E")), -1)
    step = lambda i: F.length(F.array_join(F.slice(pieces, 1, i), "")) + F.length("p.phrase") * (i - 1)
    met = met.withColumn("pos", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), step)))
    before, after = F.substring(low, F.lit(1), F.col("pos")), F.substring(low, F.col("pos") + F.length("p.phrase") + 1, F.lit(1))
    bounded = ~before.rlike(r"[\p{L}\p{N}]$") & ~after.rlike(r"^[\p{L}\p{N}]")
    anchor = ~F.col("p.phrase").isin(*anchored) | before.rlike(r"[:\-–—|\t]\s*$") if anchored else F.lit(True)
    denied = F.coalesce(F.col("p.positive"), F.lit(False)) & F.substring(before, F.greatest(F.length(before) - 23, F.lit(1)), F.lit(24)).rlike(r"\b(?:no|not|non|without|negative for|free of|absent|denies|unremarkable for|ruled out)\s*$")
    spans = F.array_sort(F.collect_list(F.struct("p.k", "pos", (F.col("pos") + F.length("p.phrase")).alias("end"), "p.concept", "p.value_key")))
    none = F.filter(spans, lambda x: F.lit(False))
    kept = F.aggregate(spans, none, lambda out, x: F.when(F.exists(out, lambda y: (x["pos"] < y["end"]) & (y["pos"] < x["end"])), out).otherwise(F.array_append(out, x)))
    key = ["page_id", "line_no", "line", "line_start", "line_end"]
    good = met.where(bounded & anchor & ~denied).groupBy(*key).agg(kept.alias("kept")).select(*key, F.explode("kept").alias("f"))
    return good.select("page_id", "line_no", "line_start", "line_end", "f.concept", "f.value_key", F.substring("line", F.col("f.pos") + 1, F.col("f.end") - F.col("f.pos")).alias("surface_form"), F.lit(0.92).alias("confidence"))


def _first_matches(pages: DataFrame, patterns: list[tuple]) -> DataFrame:
    """Patterns found in the text with its whitespace flattened: page_id, k, label, kind, detail."""
    flat = F.regexp_replace("text", r"\s+", " ")
    hits = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p[1]).alias("label"), F.lit(p[2] if len(p) > 2 else None).cast("string").alias("kind"), F.regexp_extract(flat, f"(?i){p[0]}", 0).alias("detail")) for k, p in enumerate(patterns)])
    return pages.select("page_id", F.explode(F.filter(hits, lambda h: h["detail"] != "")).alias("h")).select("page_id", "h.*")


def references(pages: DataFrame, patterns: list[tuple[str, str, str | None]]) -> DataFrame:
    """Citations of other documents, one for each label and page. patterns: (expression, label, kind), in order."""
    first = Window.partitionBy("page_id", "label").orderBy("k")
    return _first_matches(pages, patterns).withColumn("place", F.row_number().over(first)).where("place = 1").select("page_id", "label", "kind", "detail")


def follow_ups(pages: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Expected follow-ups, one for each matching pattern of a page. patterns: (expression, label)."""
    return _first_matches(pages, patterns).select("page_id", "label", F.trim("detail").alias("detail"))


#: Roles of narrative sections by words of their heading.
ROLES = (
    ("INDICATION", ("indication", "clinical history", "history", "reason", "clinical details", "referred for", "complaint")), ("TECHNIQUE", ("technique", "protocol", "procedure", "method", "sequences", "contrast", "acquisition", "study")),
    ("COMPARISON", ("comparison", "prior study", "previous study")), ("FINDINGS", ("findings", "observation", "observations", "description", "report", "examination", "gross", "microscopy")),
    ("IMPRESSION", ("impression", "conclusion", "opinion", "summary", "interpretation", "diagnosis", "assessment")), ("RECOMMENDATION", ("recommendation", "advice", "plan", "follow up", "follow-up", "suggestion")),
)


def is_heading(line: Column) -> Column:
    """A short line that isn't a sentence or a data row, in capitals, in title case or with a colon at its end."""
    body = F.trim(F.regexp_replace(F.trim(line), r":+$", ""))
    words = F.split(body, r"\s+")
    shaped = F.trim(line).endswith(":") | ((F.upper(body) == body) & body.rlike(r"\p{L}")) | F.forall(words, lambda w: ~w.rlike(r"^\p{L}") | w.rlike(r"^\p{Lu}"))
    short = (body != "") & (F.length(F.trim(line)) <= 60) & (F.size(words) <= 7)
    return short & ~(body.rlike(r"^\d") & ~F.trim(line).endswith(":")) & ~F.trim(line).endswith(".") & ~has_measurement(line) & shaped


def sections(rows: DataFrame) -> DataFrame:
    """Narrative sections of lines: page_id, section_no, heading, role (OTHER where unknown), body of two words or more."""
    page = Window.partitionBy("page_id").orderBy("line_no")
    head = is_heading(F.col("line"))
    cut = rows.withColumn("head", head).withColumn("section_no", F.sum(F.when(F.col("head"), 1).otherwise(0)).over(page)).where("section_no > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    out = cut.groupBy("page_id", "section_no").agg(F.regexp_replace(F.trim(F.max(F.when(F.col("head"), F.col("line")))), ":+$", "").alias("heading"), F.regexp_replace(body, r"^\n+|\n+$", "").alias("body"))
    low = F.lower("heading")
    role = reduce(lambda rest, r: F.when(reduce(lambda a, b: a | b, [low.contains(c) for c in r[1]]), r[0]).otherwise(rest), reversed(ROLES), F.lit("OTHER"))
    return out.where(F.size(F.split(F.trim("body"), r"\s+")) >= 2).select("page_id", "section_no", "heading", role.alias("role"), "body")


def section_map(found: DataFrame) -> DataFrame:
    """page_id, map of role to its first section's body."""
    first = Window.partitionBy("page_id", "role").orderBy("section_no")
    rows = found.where("role <> 'OTHER'").withColumn("place", F.row_number().over(first)).where("place = 1")
    return rows.groupBy("page_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "body")))).alias("by_role"))


def status_value(concept: Column, stated: Column, values: list[tuple[str, str, str, tuple[str, ...]]]) -> Column:
    """The value_key that a documented value names by key, label or phrase. values: (concept, key, label, phrases)."""
    low = F.lower(F.trim(stated))
    out = F.lit(None).cast("string")
    for name, key, label, phrases in reversed(values):
        out = F.when((concept == name) & low.isin(key.lower(), label.lower(), *[p.lower() for p in phrases]), key).otherwise(out)
    return out


def claim_rule(stated: Column, patterns: list[tuple[str, str]]) -> Column:
    """The type of the first rule whose phrase is contained in a text."""
    low = F.lower(stated)
    return reduce(lambda rest, p: F.when(low.contains(p[1]), p[0]).otherwise(rest), reversed(patterns), F.lit(None).cast("string"))


KINDS = ("observations", "claims", "medications", "findings", "references", "follow_ups")


def extract_pages(pages: DataFrame, vocabulary, kinds: tuple[str, ...] = KINDS) -> dict[str, DataFrame]:
    """The asked kinds of items of pages (page_id, text, doc_type, doc_date).

    A labelled date of the page stands before the document's. vocabulary: see plans.vocabulary.Vocabulary. Where several
    kinds are asked, the pages' dates and the lines are written once and read by each kind.
    """
    spark = pages.sparkSession
    pages = pages.withColumn("found__", document_date(F.col("text")))
    own = F.col("found__.labelled") & F.col("found__.date").isNotNull()
    pages = pages.withColumns({"page_date": F.when(own, F.col("found__.date")).otherwise(F.col("doc_date")), "page_precision": F.when(own, F.col("found__.precision")).otherwise("day")}).drop("found__")
    pages = settle(pages) if len(kinds) > 1 else pages
    rows, kept = settle(lines(pages)) if len(kinds) > 1 else lines(pages), pages.select("page_id", "page_date")
    with_date = lambda df: df.join(kept, "page_id")
    make = {
        "observations": lambda: observations(attribute_dates(rows, F.col("page_date"), F.col("page_precision")), vocabulary.synonyms(spark), vocabulary.units(spark)),
        "claims": lambda: with_date(claims(rows, vocabulary.claim_patterns)),
        "medications": lambda: medications(rows, F.col("doc_type"), F.col("page_date"), vocabulary.drugs),
        "findings": lambda: with_date(findings(rows, vocabulary.phrases, vocabulary.anchored)),
        "references": lambda: with_date(references(pages, vocabulary.references)),
        "follow_ups": lambda: with_date(follow_ups(pages, vocabulary.follow_ups)),
    }
    return {kind: make[kind]() for kind in kinds}
