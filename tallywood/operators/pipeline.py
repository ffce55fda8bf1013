"""One call from files to all results: declared stages whose tables are written, with a manifest.

A stage's tables go to the run's folder and are read from there by the stages behind it; the stage's entry
in the manifest is written last. A run that is started again on its folder reads the stages that have an entry and
makes the others. A stage that isn't declared is an error, and so is one that comes before an earlier one.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.text import classify, document_date
from ..sources import ingest
from ..sources.jobs import _is_there
from ..sources.tables import settle
from . import audit, extraction, records, registry
from .numbering import numbered

#: The stages of a run, in their order.
STAGES = (
    "INGEST", "CLASSIFY", "EXTRACT", "NORMALIZE", "CREATE_FACTS", "CREATE_CLAIMS", "CREATE_EVENTS", "BUILD_REGISTRY", "RESOLVE_ENTITIES", "DETECT_CHANGES", "DETECT_CONFLICTS",
    "RESOLVE_CLAIMS", "BUILD_RELATIONSHIPS", "DETECT_GAPS", "GENERATE_AUDIT", "RESOLVE_TERMINOLOGY",
)
#: What an extractor gives for each item of a page.
ITEM = {
    "kind": "string", "name": "string", "value": "double", "unit": "string", "item_key": "string", "detail": "string", "item_date": "date", "date_precision": "string", "stop_date": "date",
    "char_start": "int", "char_end": "int", "source_text": "string", "confidence": "double",
}
HEAD_CHARS = 400


class Run:
    """The stages of one run in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, *parts: str) -> str:
        return os.path.join(self.folder, *parts)

    def table(self, stage: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(stage, name))

    def done(self, stage: str) -> bool:
        return _is_there(self.spark, self._path("manifest", f"stage={stage}", "_SUCCESS"))

    def manifest(self) -> DataFrame:
        """stage, table_name, rows of the stages that are done."""
        return self.spark.read.schema("table_name string, rows long, stage string").parquet(self._path("manifest"))

    def stage(self, name: str, make: Callable[[], Iterable[tuple[str, DataFrame]] | dict[str, DataFrame]]) -> dict[str, DataFrame]:
        """The stage's tables: read if it is done, else made and written, each before the next is asked for."""
        if name not in STAGES:
            raise ValueError(f"{name} is no declared stage")
        if not self.done(name):
            if any(not self.done(before) for before in STAGES[: STAGES.index(name)]):
                raise ValueError(f"{name} comes before a stage that it needs")
            rows = []
            made = make()
            for table, df in made.items() if isinstance(made, dict) else made:
                df.write.mode("overwrite").parquet(self._path(name, table))
                rows.append((table, self.table(name, table).count()))
            self.spark.createDataFrame(rows, "table_name string, rows long").coalesce(1).write.mode("overwrite").parquet(self._path("manifest", f"stage={name}"))
        return {r.table_name: self.table(name, r.table_name) for r in self.manifest().where(F.col("stage") == name).collect()}  # a few tables


def _items(df: DataFrame, kind: str, **columns) -> DataFrame:
    given = {**columns, "kind": F.lit(kind)}
    return df.select("page_id", *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in ITEM.items()])


class RuleExtractor:
    """Items of pages by the vocabulary's rules, all kinds in one table."""

    def __init__(self, vocabulary):
        self.vocabulary = vocabulary

    def items(self, pages: DataFrame) -> DataFrame:
        found = extraction.extract_pages(pages, self.vocabulary)
        c, span = F.col, {"char_start": F.col("line_start"), "char_end": F.col("line_end")}
        o, m, f, k = found["observations"], found["medications"], found["findings"], found["claims"]
        parts = [
            _items(o, "OBSERVATION", name=c("concept"), value=c("value"), unit=c("unit_canonical"), detail=c("label"), item_date=c("obs_date"), date_precision=c("date_precision"), char_start=c("span_start"), char_end=c("span_end"), source_text=c("line"), confidence=c("confidence")),
            _items(f, "FINDING", name=c("concept"), item_key=c("value_key"), detail=c("surface_form"), item_date=c("page_date"), date_precision=F.lit("day"), source_text=c("surface_form"), confidence=c("confidence"), **span),
            _items(k, "CLAIM", name=c("claim_type"), detail=c("claim_text"), item_date=c("page_date"), date_precision=F.lit("day"), source_text=c("claim_text"), confidence=c("confidence"), **span),
            _items(m, "MEDICATION", name=c("drug_norm"), value=c("dose"), unit=c("unit"), item_key=c("status"), detail=F.concat_ws(" ", "frequency", "route"), item_date=c("record_date"), date_precision=F.lit("day"), stop_date=c("stop_date") if "stop_date" in m.columns else F.lit(None), source_text=c("drug_name"), confidence=F.lit(0.9), **span),
            _items(found["references"], "REFERENCE", name=c("label"), item_key=c("kind"), detail=c("detail"), item_date=c("page_date"), date_precision=F.lit("day"), source_text=c("detail"), confidence=F.lit(0.9)),
            _items(found["follow_ups"], "EVENT", name=c("label"), detail=c("detail"), item_date=c("page_date"), date_precision=F.lit("day"), source_text=c("detail"), confidence=F.lit(0.9)),
        ]
        return reduce(DataFrame.unionByName, parts)


class TableExtractor:
    """Items from a Python table function that the caller has registered: called with text, doc_type and doc_date of each page, it yields columns of ITEM (kind and name at least)."""

    def __init__(self, function: str):
        self.function = function

    def items(self, pages: DataFrame) -> DataFrame:
        found = pages.sparkSession.sql(f"SELECT p.page_id, i.* FROM {{pages}} p, LATERAL {self.function}(p.text, p.doc_type, p.doc_date) i", pages=pages)
        return found.select("page_id", *[(F.col(c) if c in found.columns else F.lit(None)).cast(t).alias(c) for c, t in ITEM.items()])


def ingested(parsed: DataFrame) -> dict[str, DataFrame]:
    """documents (numbered by path) and pages of parsed files; duplicates and failures are in files alone."""
    files = parsed.drop("pages")
    kept = numbered(ingest.stored_texts(parsed).select("path", "suffix", "sha256", "pages", "raw_text", "text_sha256", "char_count", "status"), ["path"], "document_id")
    documents = kept.withColumns({"ordinal": F.col("document_id"), "filename": F.regexp_extract("path", r"([^/]*)$", 1), "page_count": F.size("pages")})
    pages = kept.select("document_id", F.posexplode("pages").alias("page_number", "text")).withColumn("page_number", F.col("page_number") + 1)
    pages = pages.withColumn("page_id", F.concat_ws(":", "document_id", "page_number"))
    return {"files": files, "documents": documents.drop("pages"), "pages": pages}


def run_case(spark: SparkSession, files: DataFrame, vocabulary, folder: str, extractor=None, this_year: int = 2026, concepts: DataFrame | None = None, cues: dict | None = None, hints: dict | None = None) -> dict[str, DataFrame]:
    """All results by name, of files as discover() lists them, from the run's folder.

    extractor: an object whose items(pages) gives the columns of ITEM beside page_id; the vocabulary's rules where
    there is none. pages: page_id, text, doc_type, doc_date. concepts: code, label, aliases of a vocabulary for codings.
    Terminology comes last and only adds: no other result depends on it. Without files every table is empty.
    """
    run, extractor, c = Run(spark, folder), extractor or RuleExtractor(vocabulary), F.col
    got = run.stage("INGEST", lambda: ingested(ingest.parse_files(files.withColumn("case_id", F.lit("case")), settle=settle)))
    documents, pages = got["documents"], got["pages"]
    out = {"files": got["files"], "pages": pages}

    def classified():
        dated = documents.withColumns({"doc_type": classify(c("raw_text"), cues or {}, filename=c("filename"), hints=hints), "found": document_date(c("raw_text"))})
        return {"documents": dated.withColumns({"doc_date": c("found.date"), "head": F.substring("raw_text", 1, HEAD_CHARS)}).drop("found")}

    documents = out["documents"] = run.stage("CLASSIFY", classified)["documents"]
    asked = pages.join(documents.select("document_id", "doc_type", "doc_date"), "document_id").where("trim(text) <> ''")

    def extracted():
        items = extractor.items(asked.select("page_id", "text", "doc_type", "doc_date"))
        return {"items": items.join(pages.select("page_id", "document_id", "page_number"), "page_id")}

    items = out["items"] = run.stage("EXTRACT", extracted)["items"]
    out["concepts"] = run.stage("NORMALIZE", lambda: {"concepts": items.where("kind in ('OBSERVATION', 'FINDING')").groupBy(c("name").alias("concept")).agg(F.count("*").alias("n"))})["concepts"]
    place = ["document_id", "page_number", "char_start", "kind", "name"]
    number = lambda kinds, name: numbered(items.where(c("kind").isin(*kinds)), place, name)
    facts = run.stage("CREATE_FACTS", lambda: {"facts": number(("OBSERVATION", "FINDING"), "fact_id").select(
        "fact_id", F.format_string("F-%03d", "fact_id").alias("display_id"), c("name").alias("concept"), c("item_date").alias("obs_date"), "date_precision", "value", "unit", c("item_key").alias("value_key"),
        F.when(c("kind") == "FINDING", c("detail")).alias("value_text"), "document_id", "page_number", "char_start", "char_end", "source_text", "confidence")})["facts"]
    made = run.stage("CREATE_CLAIMS", lambda: {
        "claims": number(("CLAIM",), "claim_id").select("claim_id", F.format_string("C-%03d", "claim_id").alias("display_id"), c("name").alias("claim_type"), c("detail").alias("claim_text"), c("item_date").alias("claim_date"), "date_precision", "document_id", "page_number", "confidence"),
        "medications": number(("MEDICATION",), "entry_id").select("entry_id", F.format_string("M-%03d", "entry_id").alias("display_id"), c("name").alias("item"), c("value").alias("dose"), "unit", "detail", c("item_key").alias("status"), c("item_date").alias("record_date"), "stop_date", "document_id", "page_number"),
    })
    claims, medications = made["claims"], made["medications"]
    made = run.stage("CREATE_EVENTS", lambda: {
        "events": number(("EVENT",), "event_id").select("event_id", F.format_string("E-%03d", "event_id").alias("display_id"), c("name").alias("label"), c("detail"), c("item_date").alias("event_date"), "document_id", "page_number"),
        "citations": number(("REFERENCE",), "ref_id").select("ref_id", c("item_key").alias("kind"), c("name").alias("label"), c("document_id").alias("citing_doc"), c("item_date").alias("citing_date"), "document_id"),
    })
    events, citations = made["events"], made["citations"]

    def registered():
        stated = settle(registry.assertions(documents.select("document_id", "ordinal", c("raw_text").alias("text"), "doc_date"), this_year))
        links, patients = registry.resolve(stated, settle=settle)
        return {"stated": stated, "links": links, "patients": patients}

    known = run.stage("BUILD_REGISTRY", registered)
    of_patient = lambda df: records.to_patients(df, known["links"])
    resolved = run.stage("RESOLVE_ENTITIES", lambda: {
        "facts": of_patient(facts), "claims": of_patient(claims), "events": of_patient(events), "citations": of_patient(citations).drop("document_id"), "medications": of_patient(medications).join(documents.select("document_id", "doc_type"), "document_id", "left"),
        "documents": of_patient(documents.withColumn("kind", c("doc_type"))), "review": registry.review_queue(known["links"], known["stated"]),
    })
    out |= resolved | {"links": known["links"], "patients": known["patients"]}
    e = audit.Evidence(*(resolved[k] for k in ("facts", "medications", "claims", "citations", "documents", "events")))
    known: dict[str, DataFrame] = {}  # results of the audit that are written

    def parts(stage: str, *groups: tuple[str, ...]) -> dict[str, DataFrame]:
        """A stage of the audit; a group of its tables reads those of the groups and stages before."""

        def made() -> Iterator[tuple[str, DataFrame]]:
            for group in groups:
                found = audit.audit(e, vocabulary, known)
                for name in group:
                    yield name, found[name]
                    known[name] = run.table(stage, name)

        got = run.stage(stage, made)
        known.update(got)
        return got

    out |= parts("DETECT_CHANGES", ("changes", "duplicates", "series"))
    out |= parts("DETECT_CONFLICTS", ("numeric_conflicts", "status_conflicts", "medication_conflicts"), ("conflicts",))
    said = parts("RESOLVE_CLAIMS", ("claims", "outside_window"))
    out["claim_status"], out["outside_window"] = said["claims"], said["outside_window"]
    out |= parts("BUILD_RELATIONSHIPS", ("references", "relationships"))
    out |= parts("DETECT_GAPS", ("gaps",))

    def audited():
        members = out["relationships"].where("rel_type = 'CONTRADICTS'").select(F.explode(F.array(F.col("from_id").cast("long"), F.col("to_id").cast("long"))).alias("fact_id")).distinct()
        nodes, edges = case_graph(out, e)
        return {"counts": audit.audit(e, vocabulary, known)["counts"], "timeline": timeline_rows(e, out["claim_status"], members), "graph_nodes": nodes, "graph_edges": edges, **audit.brief(out["conflicts"], out["gaps"], e.documents.drop("n_facts"), e.facts)}

    out |= run.stage("GENERATE_AUDIT", audited)
    out |= run.stage("RESOLVE_TERMINOLOGY", lambda: {"codings": codings(e, concepts)})
    return out | {"manifest": run.manifest()}


def timeline_rows(e: audit.Evidence, status: DataFrame, in_conflict: DataFrame) -> DataFrame:
    """One row for each dated fact, medication, claim and event: date, kind, entity_id, display_id, title, detail, status, document_id.

    status is CONFLICT for facts in a conflict (fact_id), MISSING for claims without located evidence, else DOCUMENTED. In order: date, display_id.
    """
    hit, c = in_conflict.select("fact_id", F.lit(True).alias("hit")), F.col
    row = lambda df, day, kind, key, title, detail, state: df.where(c(day).isNotNull()).select("subject", c(day).alias("date"), F.lit(kind).alias("kind"), c(key).cast("string").alias("entity_id"), "display_id", title.alias("title"), detail.alias("detail"), state.alias("status"), "document_id")
    documented = F.lit("DOCUMENTED")
    shown = F.trim(F.concat_ws(" ", F.coalesce(records.short_number(c("value")), c("value_text")), "unit"))
    dose = F.concat_ws(" ", F.concat(records.short_number(c("dose")), F.coalesce("unit", F.lit(""))), F.nullif(F.trim("detail"), F.lit("")), F.concat(F.lit("("), F.lower("status"), F.lit(")")))
    said = e.claims.join(status.select("claim_id", "evidence_status"), "claim_id", "left")
    return (
        row(e.facts.join(hit, "fact_id", "left"), "obs_date", "observation", "fact_id", c("concept"), shown, F.when(c("hit"), "CONFLICT").otherwise(documented))
        .unionByName(row(e.medications, "record_date", "medication", "entry_id", c("item"), dose, documented))
        .unionByName(row(said, "claim_date", "claim", "claim_id", c("claim_text"), F.initcap(F.replace(F.lower("evidence_status"), F.lit("_"), F.lit(" "))), F.when(c("evidence_status") == "NO_LOCATED_EVIDENCE", "MISSING").otherwise(documented)))
        .unionByName(row(e.events, "event_date", "event", "event_id", c("label"), c("detail"), documented))
    )


def case_graph(out: dict[str, DataFrame], e: audit.Evidence) -> tuple[DataFrame, DataFrame]:
    """Nodes and typed edges of a case: documents contain their items, facts relate to facts and to claims."""
    ids = {"document": (e.documents, "document_id"), "fact": (e.facts, "fact_id"), "claim": (e.claims, "claim_id"), "medication": (e.medications, "entry_id"), "event": (e.events, "event_id")}
    nodes = {kind: df.select(F.col(key).alias("node_id")) for kind, (df, key) in ids.items()}
    contains = reduce(DataFrame.unionByName, [df.select(F.col("document_id").alias("from_id"), F.col(key).alias("to_id"), F.lit("document").alias("from_type"), F.lit(kind).alias("to_type")) for kind, (df, key) in ids.items() if kind != "document"])
    to_type = F.when(F.col("rel_type").isin(*records.CLAIM_EDGES), "claim").otherwise("fact")
    relations = out["relationships"].withColumns({"from_type": F.lit("fact"), "to_type": to_type})
    return audit.graph(nodes, contains, relations)


def codings(e: audit.Evidence, concepts: DataFrame | None) -> DataFrame:
    """query, code, label, tier of the concepts and drugs of the evidence in a vocabulary; none without one."""
    spark = e.facts.sparkSession
    if concepts is None:
        return spark.createDataFrame([], "query string, code string, label string, tier int, place int, review_required boolean")
    asked = e.facts.where("not startswith(concept, 'unmapped:')").select(F.replace("concept", F.lit("_"), F.lit(" ")).alias("query")).unionByName(e.medications.select(F.col("item").alias("query")))
    return terms.search(asked.distinct(), concepts).where("place = 1")
