"""The registry: who a document is about, who took part in it, and where it was issued.

Identity is read from a document's head, compared by folded keys and never guessed:
anything short of a rule is left for review with its candidates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.identity import fold, name_key
from .keys import join_on

#: How a head states identity; the first pattern that gives a value counts.
_END = r"(?:\s{2,}|\||$)"
FIELDS = {
    "raw_name": (rf"patient(?:\s*name)?\s*[:\-]\s*([^\n|]+?){_END}", rf"\bname\s*[:\-]\s*([^\n|]+?){_END}"),
    "raw_dob": (rf"\b(?:dob|d\.o\.b\.?|date of birth)\s*[:\-]\s*([^\n|]+?){_END}",),
    "raw_sex": (r"\b(?:sex|gender)\s*[:\-]\s*([^\n|,]+?)(?:\s{2,}|\||,|$)",),
    "raw_mrn": (rf"\b(?:mrn|m\.r\.n\.?|hospital no|hosp no|uhid|patient id)\s*[:\-]\s*([^\n|]+?){_END}",),
}
#: Labels of roles, the roles that imply where someone works, words of institutions and of document titles.
ROLE_LABELS = (
    ("requested by", "ORDERING"), ("ordered by", "ORDERING"), ("referred by", "REFERRING"), (r"referring(?: physician| doctor)?", "REFERRING"), ("verified by", "PERFORMING"),
    ("reported by", "PERFORMING"), ("performed by", "PERFORMING"), ("consultant", "AUTHORING"), ("seen by", "AUTHORING"), ("attending", "AUTHORING"),
)
AFFILIATING = ("PERFORMING", "AUTHORING")
INSTITUTIONS = ("hospital", "laboratory", "labs", "clinic", "centre", "center", "diagnostics", "diagnostic", "imaging", "genomics", "sciences", "pathology", "institute")
TITLES = ("report", "summary", "note", "notes", "list", "letter", "prescription", "count", "panel", "studies", "record", "referral", "discharge", "consultation")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
HEAD_LINES, LETTERHEAD_LINES = 14, 4


# --- normal forms ---------------------------------------------------------------------
def normalise_dob(raw: Column, this_year: int) -> Column:
    """A date of birth; null where it is ambiguous (both numbers could be the month) or no date. Two-digit years are past ones."""
    s = F.lower(F.trim(raw))
    get = lambda pattern, k: F.regexp_extract(s, pattern, k)
    month = lambda name: reduce(lambda rest, k: F.when(F.substring(name, 1, 3) == MONTHS[k], F.lit(f"{k + 1:02d}")).otherwise(rest), range(12), F.lit(None).cast("string"))

    def year(y: Column) -> Column:
        n = y.try_cast("int")
        return F.when(n >= 100, n).otherwise(F.when(n + 2000 <= this_year, n + 2000).otherwise(n + 1900))

    def made(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), m, F.lpad(d, 2, "0")).try_cast("date")

    iso, dmy = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{1,2})[\s/-]+([a-z]{3,})[\s/-]+(\d{2,4})$"
    mdy, number = r"^([a-z]{3,})[\s/-]+(\d{1,2}),?[\s/-]+(\d{2,4})$", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$"
    a, b = get(number, 1).try_cast("int"), get(number, 2).try_cast("int")
    return (
        F.when(s.rlike(iso), made(get(iso, 1), get(iso, 2), get(iso, 3)))
        .when(s.rlike(dmy) & month(get(dmy, 2)).isNotNull(), made(year(get(dmy, 3)), month(get(dmy, 2)), get(dmy, 1)))
        .when(s.rlike(mdy) & month(get(mdy, 1)).isNotNull(), made(year(get(mdy, 3)), month(get(mdy, 1)), get(mdy, 2)))
        .when(s.rlike(number) & (a > 12) & (b <= 12), made(get(number, 3), F.lpad(get(number, 2), 2, "0"), get(number, 1)))
        .when(s.rlike(number) & (b > 12) & (a <= 12), made(get(number, 3), F.lpad(get(number, 1), 2, "0"), get(number, 2)))
    )


def normalise_sex(raw: Column) -> Column:
    """M, F or O; null where it isn't stated."""
    s = F.lower(F.trim(raw))
    return F.when(s.isin("m", "male", "man", "boy"), "M").when(s.isin("f", "female", "woman", "girl"), "F").when(s.isin("o", "other", "x", "intersex"), "O")


def normalise_mrn(raw: Column) -> Column:
    return F.nullif(F.upper(F.regexp_replace(raw, "[^A-Za-z0-9]", "")), F.lit(""))


# --- what a document states -----------------------------------------------------------
def _head(text: Column, n: int) -> Column:
    return F.slice(F.split(text, r"\r\n|\r|\n", -1), 1, n)


def assertions(first_pages: DataFrame, this_year: int) -> DataFrame:
    """Identity as the first page's head states it, with comparison keys. first_pages: document_id, ordinal, text (null: nothing readable)."""
    head = F.array_join(_head(F.coalesce("text", F.lit("")), HEAD_LINES), "\n")
    value = lambda pattern: F.nullif(F.regexp_replace(F.regexp_extract(head, f"(?im){pattern}", 1), r"^[ \t:\-|]+|[ \t:\-|]+$", ""), F.lit(""))
    raw = {name: F.coalesce(*[value(p) for p in patterns]) for name, patterns in FIELDS.items()}
    rows = first_pages.select("document_id", "ordinal", (F.trim(F.coalesce("text", F.lit(""))) != "").alias("has_text"), *[c.alias(n) for n, c in raw.items()])
    names = rows.select("raw_name").where("raw_name is not null").distinct().select("raw_name", F.nullif(name_key(fold("raw_name")), F.lit("")).alias("name_key"))
    return join_on(rows, names, ["raw_name"], "left").withColumns({"dob": normalise_dob(F.col("raw_dob"), this_year), "sex": normalise_sex(F.col("raw_sex")), "mrn": normalise_mrn(F.col("raw_mrn"))})


def institution(text: Column) -> Column:
    """The issuer named by one of the first lines: a line that names a kind of organisation, holds no colon and is no title."""
    words = lambda x: F.split(F.regexp_replace(F.lower(x), "-", " "), r"\s+")
    named = lambda x: reduce(lambda a, b: a | b, [F.lower(x).contains(h) for h in INSTITUTIONS])
    fits = lambda x: (F.length(x) >= 4) & ~x.contains(":") & x.rlike(r"\p{L}") & ~F.exists(words(x), lambda w: w.isin(*TITLES)) & named(x) & ~F.upper(x).rlike("SYNTHETIC RECORD|NOT A REAL")
    found = F.filter(F.transform(_head(text, LETTERHEAD_LINES), lambda x: F.trim(x)), fits)
    return F.trim(F.regexp_replace(F.try_element_at(found, F.lit(1)), r"(?i)\s*\(synthetic\)\s*$", ""))


def _clinician(raw: Column) -> Column:
    """A name behind a role's label without what follows it on the line; null for a speciality."""
    s = F.element_at(F.split(F.trim(raw), r"\s{2,}|\s\|\s"), 1)
    s = F.element_at(F.split(s, r"(?i)\b(?:report no|reg|modality|date|sample|ref)\b\s*[:.]"), 1)
    s = F.regexp_replace(F.substring_index(s, ",", 1), r"^[ \t:\-.]+|[ \t:\-.]+$", "")
    return F.when(s.rlike("[A-Za-z]{2}") & s.rlike(r"(?i)\b(?:dr|prof|mr|ms|mrs)\b"), s)


def participants(documents: DataFrame) -> DataFrame:
    """Who a document names and in which role, once for each role and name: document_id, ordinal, role, raw_text, name_key."""

    def named(k: int, label: str, role: str) -> Column:
        stated = F.regexp_extract_all("text", F.lit(rf"(?i)\b{label}\s*[:\-]\s*([^\n|]+)"), F.lit(1))
        return F.transform(stated, lambda x: F.struct(F.lit(k).alias("k"), F.lit(role).alias("role"), _clinician(x).alias("raw_text")))

    found = F.flatten(F.array(*[named(k, label, role) for k, (label, role) in enumerate(ROLE_LABELS)]))
    rows = documents.where("text is not null").select("document_id", "ordinal", F.explode(found).alias("p")).select("document_id", "ordinal", "p.k", "p.role", "p.raw_text").where("raw_text is not null")
    names = rows.select("raw_text").distinct().withColumn("name_key", name_key(fold("raw_text")))
    keyed = rows.join(names, "raw_text").where("name_key <> ''")
    return keyed.groupBy("document_id", "ordinal", "role", "name_key").agg(F.min_by("raw_text", F.struct("k", "raw_text")).alias("raw_text"))


# --- resolution -----------------------------------------------------------------------
KEYS = {"mrn": "m", "name_key": "n", "dob": "d"}


def _keyed(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each comparison key that a row states."""
    entries = F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(mark), F.col(c).cast("string"))) for c, mark in KEYS.items()])
    return rows.select(*columns, F.explode(F.filter(entries, lambda x: x.isNotNull())).alias("key"))


def founders(stated: DataFrame, registry: DataFrame | None = None, settle=lambda df: df.checkpoint()) -> DataFrame:
    """The documents from which a patient is created, taken in order of their ordinal.

    A document creates a patient if it states enough (an MRN, or a name of two words with a
    date of birth) and shares no MRN, name or date of birth with a patient that exists by then. That is the
    first-come independent set of documents that share a key. Each round takes the documents
    that come first under all of their keys, then drops those that share a key with one taken;
    only keys travel, and no group of documents is ever gathered.
    """
    words = F.size(F.split("name_key", " "))
    able = F.when(F.col("dob").isNotNull() & F.col("name_key").isNotNull(), words >= 2).otherwise(F.col("mrn").isNotNull())
    left = stated.where(able).select("document_id", "ordinal", *KEYS)
    if registry is not None:
        known = _keyed(registry, "patient_ref").select("key").distinct()
        left = left.join(_keyed(left, "document_id").join(known, "key", "left_semi").select("document_id").distinct(), "document_id", "left_anti")
    left, taken = settle(left), None
    while not left.isEmpty():
        keyed = _keyed(left, "document_id", "ordinal")
        first = keyed.groupBy("key").agg(F.min(F.struct("ordinal", "document_id")).alias("first"))
        waits = keyed.join(first, "key").where(F.struct("ordinal", "document_id") != F.col("first")).select("document_id").distinct()
        new = settle(left.join(waits, "document_id", "left_anti"))
        taken = new if taken is None else taken.unionByName(new)
        gone = keyed.join(_keyed(new, "document_id").select("key").distinct(), "key", "left_semi").select("document_id").distinct()
        left = settle(left.join(gone, "document_id", "left_anti"))
    return stated.limit(0).select("document_id", "ordinal") if taken is None else taken.select("document_id", "ordinal")


def number_refs(rows: DataFrame, prefix: str, order: str, span: int = 100_000) -> DataFrame:
    """Adds patient_ref, numbered by ``order``: counts of spans of it give each span's first number, so no task sorts all rows."""
    bucket = rows.withColumn("span__", F.floor(F.col(order) / span))
    sizes = bucket.groupBy("span__").agg(F.count("*").alias("n"))
    offsets = sizes.withColumn("before__", F.coalesce(F.sum("n").over(Window.orderBy("span__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row for each span
    within = Window.partitionBy("span__").orderBy(order, "document_id")
    out = bucket.join(offsets, "span__").withColumn("number__", F.col("before__") + F.row_number().over(within))
    return out.withColumn("patient_ref", F.format_string(f"{prefix}-%04d", "number__")).drop("span__", "before__", "number__")


def resolve(stated: DataFrame, registry: DataFrame | None = None, settle=lambda df: df.checkpoint()) -> tuple[DataFrame, DataFrame]:
    """(links, patients): every document's decision, and the patients after all of them.

    registry: patient_ref, name_key, dob, sex, mrn of patients known before. Decisions see the patients of earlier
    documents alone. links: document_id, status (LINKED, NEW_PATIENT, NEEDS_REVIEW), basis, patient_ref, candidates.
    """
    stated = settle(stated)
    new = number_refs(stated.join(founders(stated, registry, settle).select("document_id"), "document_id", "left_semi"), "PT", "ordinal")
    fresh = new.select("patient_ref", F.col("raw_name").alias("display_name"), "name_key", "dob", "sex", "mrn", F.col("ordinal").alias("since"), F.col("document_id").alias("founder"))
    patients = fresh if registry is None else fresh.unionByName(registry.withColumns({"since": F.lit(-1).cast("long"), "founder": F.lit(None).cast(stated.schema["document_id"].dataType)}), allowMissingColumns=True)
    patients = settle(patients)
    side = patients.select("patient_ref", *[F.col(c).alias(f"p_{c}") for c in ("name_key", "dob", "sex", "mrn", "since")])
    met = None
    for column in KEYS:
        part = stated.join(side, F.col(column) == F.col(f"p_{column}")).where("p_since < ordinal")
        met = part if met is None else met.unionByName(part)
    met = met.distinct()
    same = lambda c: F.coalesce(F.col(c) == F.col(f"p_{c}"), F.lit(False))
    by_mrn, by_both = same("mrn"), same("name_key") & same("dob")
    only = lambda test, value: F.min(F.when(test, value))
    hits = met.groupBy("document_id").agg(
        F.count_if(by_mrn).alias("n_mrn"), only(by_mrn, F.col("patient_ref")).alias("ref_mrn"), F.max(F.when(by_mrn, F.col("name_key").isNull() | F.col("p_name_key").isNull() | same("name_key"))).alias("mrn_name"),
        F.count_if(by_both).alias("n_both"), only(by_both, F.col("patient_ref")).alias("ref_both"), only(by_both, F.col("p_sex")).alias("both_sex"),
        F.count_if(same("name_key") | same("dob")).alias("n_near"), F.array_join(F.array_sort(F.collect_set("patient_ref")), ",").alias("candidates"),
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = stated.join(hits, "document_id", "left").join(fresh.select(F.col("founder").alias("document_id"), F.col("patient_ref").alias("own")), "document_id", "left")
    empty = F.coalesce("raw_name", "raw_dob", "raw_mrn").isNull()
    full = F.col("name_key").isNotNull() & F.col("dob").isNotNull()
    clash = F.col("sex").isNotNull() & F.col("both_sex").isNotNull()
    basis = (
        F.when(empty & ~F.col("has_text"), "NO_READABLE_TEXT").when(empty, "NO_IDENTITY_STATED")
        .when(n("n_mrn") == 1, F.when(F.col("mrn_name"), "MRN_EXACT").otherwise("MRN_CONFLICT")).when(n("n_mrn") > 1, "AMBIGUOUS")
        .when(full & (F.size(F.split("name_key", " ")) < 2), "INSUFFICIENT_IDENTITY")
        .when(full & (n("n_both") == 1), F.when(clash & (F.col("sex") != F.col("both_sex")), "AMBIGUOUS").when(clash, "NAME_DOB_SEX").otherwise("NAME_DOB"))
        .when(full & (n("n_both") > 1), "AMBIGUOUS").when(n("n_near") > 0, "INSUFFICIENT_IDENTITY").when(F.col("own").isNull(), "INSUFFICIENT_IDENTITY").otherwise("NO_MATCH")
    )
    rows = rows.withColumn("basis", basis)
    linked = F.col("basis").isin("MRN_EXACT", "NAME_DOB_SEX", "NAME_DOB")
    status = F.when(linked, "LINKED").when(F.col("basis") == "NO_MATCH", "NEW_PATIENT").otherwise("NEEDS_REVIEW")
    ref = F.when(F.col("basis") == "MRN_EXACT", F.col("ref_mrn")).when(linked, F.col("ref_both")).when(F.col("basis") == "NO_MATCH", F.col("own"))
    links = rows.select("document_id", "ordinal", status.alias("status"), "basis", ref.alias("patient_ref"), F.when(status == "NEEDS_REVIEW", F.coalesce("candidates", F.lit(""))).otherwise("").alias("candidates"))
    return links, patients


# --- directory ------------------------------------------------------------------------
def directory(parts: DataFrame, issuers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clinicians, appearances) from participants and issuers (document_id, institution).

    A clinician is a name with an affiliation, which performing and authoring roles alone imply
    (the issuer). A name with no affiliation at all is one clinician; mentions without one go to
    the name's first affiliation. appearances: document_id, role, clinician_id; once each.
    """
    affil = F.when(F.col("role").isin(*AFFILIATING), F.col("institution"))
    rows = parts.join(issuers, "document_id", "left").withColumn("affiliation", affil)
    first = rows.where("affiliation is not null").groupBy("name_key").agg(F.min_by("affiliation", F.struct("ordinal", "affiliation")).alias("first"))
    rows = rows.join(first, "name_key", "left").withColumn("affiliation", F.coalesce("affiliation", "first")).drop("first")
    rows = rows.withColumn("clinician_id", F.sha2(F.concat_ws("|", "name_key", F.coalesce("affiliation", F.lit(""))), 256))
    clinicians = rows.groupBy("clinician_id", "name_key", "affiliation").agg(F.min_by("raw_text", F.struct("ordinal", "raw_text")).alias("display_name"))
    return clinicians, rows.select("document_id", "role", "clinician_id").distinct()


def care_team(clinicians: DataFrame, appearances: DataFrame) -> DataFrame:
    """Each clinician with roles and number of documents."""
    sums = appearances.groupBy("clinician_id").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count_distinct("document_id").alias("documents"))
    return clinicians.join(sums, "clinician_id").select("display_name", "affiliation", "roles", "documents")


def directory_counts(documents: DataFrame, clinicians: DataFrame, appearances: DataFrame) -> DataFrame:
    """case_id, institutions, clinicians that its documents name. documents: document_id, case_id."""
    rows = documents.select("document_id", "case_id").join(appearances, "document_id").join(clinicians.select("clinician_id", "affiliation"), "clinician_id", "left")
    return rows.groupBy("case_id").agg(F.count_distinct("affiliation").alias("institutions"), F.count_distinct("clinician_id").alias("clinicians"))


def encounters(links: DataFrame, documents: DataFrame, issuers: DataFrame) -> DataFrame:
    """Contacts: a patient, a date and an institution (none is one too) with the number of documents."""
    rows = links.where("patient_ref is not null").select("document_id", "patient_ref").join(documents.select("document_id", F.col("doc_date").alias("occurred_on")), "document_id").where("occurred_on is not null").join(issuers, "document_id", "left")
    return rows.groupBy("patient_ref", "occurred_on", "institution").agg(F.count_distinct("document_id").alias("documents"))


def match_encounters(documents: DataFrame, known: DataFrame) -> DataFrame:
    """Documents (patient_ref, occurred_on, institution) that fall to a known encounter; an absent institution matches an absent one."""
    return join_on(documents, known, ["patient_ref", "occurred_on", "institution"], "left_semi")


def prune(rows: DataFrame, key: str, *uses: DataFrame) -> DataFrame:
    """The rows that at least one of the tables still refers to."""
    used = reduce(DataFrame.unionByName, [u.select(F.col(key)) for u in uses]).where(F.col(key).isNotNull()).distinct()
    return rows.join(used, key, "left_semi")


def review_queue(links: DataFrame, stated: DataFrame) -> DataFrame:
    """Documents that aren't attached to anyone, with what they state and their candidates."""
    return links.where("status = 'NEEDS_REVIEW'").join(stated.select("document_id", "raw_name", "raw_dob", "raw_sex", "raw_mrn"), "document_id").select("document_id", "basis", "candidates", "raw_name", "raw_dob", "raw_sex", "raw_mrn")


def patient_view(patients: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each patient with linked documents and evidence by kind. evidence: document_id, kind (facts, claims, medications)."""
    per_doc = evidence.groupBy("document_id").pivot("kind", ["facts", "claims", "medications"]).count()
    rows = links.where("patient_ref is not null").join(per_doc, "document_id", "left")
    sums = rows.groupBy("patient_ref").agg(F.count("*").alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("facts", "claims", "medications")])
    return patients.select("patient_ref", "display_name", "dob", "sex", "mrn").join(sums, "patient_ref")
