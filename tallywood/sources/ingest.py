"""Reading documents, raw text with offsets, content dedupe, and a resumable job ledger."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..operators.keys import join_on
from ..operators.numbering import numbered

#: Fixed value: what stands between the pages of a raw text.
PAGE_BREAK = "\n\f\n"
#: Suffixes that can be read, and files that are no documents.
SUFFIXES = (".pdf", ".txt", ".png", ".jpg", ".jpeg")
HIDDEN = (".ds_store", "thumbs.db", "desktop.ini")


def discover(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, suffix, size, sha256, content of the files below a folder; unsupported ones are kept and marked. Files without a byte are not listed by Spark."""
    return described(spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder))


def described(files: DataFrame) -> DataFrame:
    """path, suffix, supported, byte_size, sha256, content of binary files but hidden ones."""
    name = F.lower(F.regexp_extract("path", r"([^/]*)$", 1))
    suffix = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    kept = files.where(~name.startswith(".") & ~name.isin(*HIDDEN))
    return kept.select("path", suffix.alias("suffix"), suffix.isin(*SUFFIXES).alias("supported"), F.col("length").alias("byte_size"), F.sha2("content", 256).alias("sha256"), "content")


def text_pages(files: DataFrame) -> DataFrame:
    """path, pages: one page of text for .txt, an empty page for images; others have none."""
    text = F.when(F.col("suffix") == ".txt", F.array(F.make_valid_utf8(F.col("content").cast("string")))).when(F.col("suffix").isin(".png", ".jpg", ".jpeg"), F.array(F.lit("")))
    return files.select("path", "sha256", text.alias("pages"))


def raw_text(documents: DataFrame, pages: str = "pages") -> DataFrame:
    """Adds raw_text (pages joined by a page break), page_offsets (start, end of each page), text_sha256, char_count, and status where there is none yet.

    A status that parsing gave (FAILED, DUPLICATE, ...) stays; else it is INGESTED with text and MISSING without.
    """
    step = len(PAGE_BREAK)
    place = "struct<at:int,out:array<struct<start:int,end:int>>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")).cast(place)
    add = lambda s, n: F.struct((s["at"] + n + step).alias("at"), F.array_append(s["out"], F.struct(s["at"].alias("start"), (s["at"] + n).alias("end"))).alias("out")).cast(place)
    joined = F.array_join(pages, PAGE_BREAK)
    offsets = F.aggregate(F.transform(pages, F.length), begin, add, lambda s: s["out"])
    status = F.when(F.exists(pages, lambda p: F.trim(p) != ""), "INGESTED").otherwise("MISSING")
    stated = F.coalesce("status", status) if "status" in documents.columns else status
    return documents.withColumns({"raw_text": joined, "page_offsets": offsets, "text_sha256": F.sha2(joined, 256), "char_count": F.length(joined), "status": stated})


def stored_texts(parsed: DataFrame) -> DataFrame:
    """raw_text of the parsed files that are kept: duplicates and failures stay in the ledger alone."""
    return raw_text(parsed.where(F.col("status").isin("INGESTED", "MISSING")))


def content_dedupe(documents: DataFrame, case: str, digest: str, order: str) -> DataFrame:
    """Adds is_duplicate and duplicate_of: the first document of the case with the same content."""
    first = documents.groupBy(case, digest).agg(F.min(order).alias("first__"))
    rows = join_on(documents, first, [case, digest], "left")
    return rows.withColumns({"duplicate_of": F.when(F.col(order) != F.col("first__"), F.col("first__")), "is_duplicate": F.col(order) != F.col("first__")}).drop("first__")


def pending(manifest: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """What a resumed job has left to do."""
    return manifest.join(done.select(key).distinct(), key, "left_anti")


def progress(ledger: DataFrame) -> DataFrame:
    """Counts by status and percent done of each job."""
    n = lambda s: F.count_if(F.col("status") == s)
    total = F.count("*")
    return ledger.groupBy("job_id").agg(total.alias("total"), n("PENDING").alias("pending"), n("INGESTED").alias("ingested"), n("DUPLICATE").alias("duplicate"), n("FAILED").alias("failed"), F.round(100.0 * (total - n("PENDING")) / total, 1).alias("percent"))


def failed_items(ledger: DataFrame, limit: int = 100) -> DataFrame:
    """The first failed items of each job, by ordinal."""
    order = Window.partitionBy("job_id").orderBy("ordinal")
    return ledger.where("status = 'FAILED'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("status")


def plan_job(files: DataFrame, job_id: str) -> DataFrame:
    """One PENDING item for each file, numbered by path: written before any file is read."""
    rows = files.select("path", "suffix", "supported", "byte_size", "sha256")
    return numbered(rows, ["path"], "ordinal").withColumns({"job_id": F.lit(job_id), "status": F.lit("PENDING")})


def chunks(manifest: DataFrame, size: int = 200) -> DataFrame:
    """Pending items with the number of their chunk, by ordinal within the job."""
    rows = numbered(manifest.where("status = 'PENDING'"), ["ordinal"], "number__", group="job_id")
    return rows.withColumn("chunk", F.floor((F.col("number__") - 1) / size)).drop("number__")


def parse_files(files: DataFrame, case: str = "case_id", settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every file with status, error and pages: FAILED for what can't be read, DUPLICATE for content that the case has, MISSING without text.

    A file that fails is a row and stops nothing. PDF text needs a reader on the workers (pypdf); without it such a file fails with that reason.
    settle: writes the digests and pages before copies are looked for, so that a file is read and parsed once.
    """
    pages = F.when(F.col("suffix") == ".txt", F.array(F.make_valid_utf8(F.col("content").cast("string")))).when(F.col("suffix").isin(".png", ".jpg", ".jpeg"), F.array(F.lit("")))
    rows = files.withColumn("parsed__", F.when(F.col("suffix") == ".pdf", pdf_pages(F.when(F.col("suffix") == ".pdf", F.coalesce("content", F.lit(b""))))).otherwise(F.struct(pages.alias("pages"), F.lit(None).cast("string").alias("error")))).drop("content")
    rows = content_dedupe(settle(rows) if settle else rows, case, "sha256", "path")
    error = F.when(~F.col("supported"), "unsupported suffix").when(F.col("byte_size") == 0, "empty file").otherwise(F.col("parsed__.error"))
    text = F.exists(F.col("parsed__.pages"), lambda p: F.trim(p) != "")
    status = F.when(error.isNotNull(), "FAILED").when(F.col("is_duplicate"), "DUPLICATE").when(text, "INGESTED").otherwise("MISSING")
    return rows.withColumns({"error": error, "status": status, "pages": F.col("parsed__.pages")}).drop("parsed__")


@F.pandas_udf(StructType([StructField("pages", ArrayType(StringType())), StructField("error", StringType())]))
def pdf_pages(content: pd.Series) -> pd.DataFrame:
    """Text of each page, or why there is none; nothing for null, as the files of other kinds are."""

    def read(raw):
        if raw is None:
            return None, None
        try:
            from pypdf import PdfReader

            return [page.extract_text() or "" for page in PdfReader(io.BytesIO(raw)).pages], None
        except Exception as problem:  # whatever is wrong with one file is that file's result
            return None, f"{type(problem).__name__}: {problem}"

    return pd.DataFrame([read(x) for x in content], columns=["pages", "error"])


def page_rows(parsed: DataFrame, key: str = "path") -> DataFrame:
    """key, page_number (from 1), text of the pages of parsed files."""
    return parsed.where("pages is not null").select(key, F.posexplode("pages").alias("page_number", "text")).withColumn("page_number", F.col("page_number") + 1)


def accept_uploads(files: DataFrame, most_bytes: int = 25_000_000) -> DataFrame:
    """Uploads with a name made from their content, or the reason why they are refused."""
    reason = F.when(~F.col("supported"), "unsupported suffix").when(F.col("byte_size") == 0, "empty file").when(F.col("byte_size") > most_bytes, "too large")
    return files.withColumns({"refused": reason, "stored_name": F.when(reason.isNull(), F.concat("sha256", "suffix"))})


def archive_members(spark: SparkSession, folder: str) -> DataFrame:
    """Files inside the zip and tar archives of a folder, in the columns of discover(); each archive is opened by one task."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").rlike(r"\.(zip|tar|tgz|gz)$")).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = list(_members(raw))
                yield pa.RecordBatch.from_pydict({"path": pa.array([f"{path}!{name}" for name, _ in rows], pa.string()), "content": pa.array([body for _, body in rows], pa.binary())})

    return described(found.mapInArrow(run, "path string, content binary").withColumn("length", F.length("content")))


def _members(raw: bytes):
    if zipfile.is_zipfile(io.BytesIO(raw)):
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            yield from ((i.filename, archive.read(i)) for i in archive.infolist() if not i.is_dir())
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(raw)) as archive:
            yield from ((m.name, archive.extractfile(m).read()) for m in archive if m.isfile())
    except tarfile.TarError:
        return  # not an archive after all: it has no members
