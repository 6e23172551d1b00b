"""Validated ingest of files and routing to parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.config import DEFAULTS, Settings
from cartulary.functions.archives import has_zip_member

# Accepted types and the messages of rejections.
MEDIA_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
PARSERS = {"pdf": "pymupdf", "docx": "python-docx"}
PDF_MAGIC = b"%PDF-"
DOCX_MEMBER = b"word/document.xml"


def read_files(spark: SparkSession, path: str, settings: Settings = DEFAULTS) -> DataFrame:
    """``(filename, size_bytes, content)`` of every file under ``path``; those beyond the size limit are never loaded."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = lambda part, content: part.select(F.col("path").alias("filename"), F.col("length").alias("size_bytes"), content)
    limit = F.lit(settings.max_upload_size_bytes)
    small, large = files.filter(F.col("length") <= limit), files.filter(F.col("length") > limit)
    return named(small, F.col("content")).unionByName(named(large, F.lit(None).cast("binary").alias("content")))


def validate_uploads(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Add safe name, extension, media type, size and, for bad files, ``reject_code`` and ``reject_reason``.

    Checks run in order: name, type, size, content. The size limit is inclusive. The size is ``size_bytes`` where
    ``files`` has it, else that of the content. A DOCX file is a ZIP archive that lists the document's part.
    """
    safe = F.regexp_extract(
        F.regexp_replace(F.coalesce("filename", F.lit("")), r"\\", "/"), "([^/]*)/*$", 1
    )
    named = files.withColumn("original_filename", safe).withColumn(
        "extension", F.lower(F.regexp_extract("original_filename", r"[^.].*\.([^.]+)$", 1))
    )
    media = None
    for extension, media_type in MEDIA_TYPES.items():
        hit = F.col("extension") == extension
        media = F.when(hit, media_type) if media is None else media.when(hit, media_type)
    size = F.coalesce("size_bytes", F.octet_length("content")) if "size_bytes" in files.columns else F.octet_length("content")
    sized = named.withColumn("media_type", media).withColumn("size_bytes", F.coalesce(size, F.lit(0)))
    limit = settings.max_upload_size_bytes
    bad_pdf = (F.col("extension") == "pdf") & (F.substring("content", 1, 5) != F.lit(PDF_MAGIC))
    bad_docx = (F.col("extension") == "docx") & ~has_zip_member(F.col("content"), DOCX_MEMBER)
    fail = lambda code, reason: F.struct(F.lit(code).alias("code"), F.lit(reason).alias("reason"))
    problem = (
        F.when(F.coalesce("filename", F.lit("")) == "", fail(422, "A filename is required."))
        .when(F.col("original_filename").isin("", ".", ".."), fail(422, "The filename is invalid."))
        .when(F.col("media_type").isNull(), fail(415, "Only PDF and DOCX files are supported."))
        .when(F.col("size_bytes") > limit, fail(413, f"File size exceeds the {limit // (1024 * 1024)} MB limit."))
        .when(F.col("size_bytes") == 0, fail(422, "The uploaded file is empty."))
        .when(bad_pdf, fail(422, "The file content is not a valid PDF."))
        .when(bad_docx, fail(422, "The file content is not a valid DOCX document."))
    )
    checked = sized.withColumn("__problem", problem)
    return checked.select(
        *[F.col(c) for c in sized.columns],
        F.col("__problem.code").alias("reject_code"),
        F.col("__problem.reason").alias("reject_reason"),
    )


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reject_code").isNull())


def rejected(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("reject_code").isNotNull()).drop("content")


def register_parsers(entries: list[tuple[str, str]]) -> dict[str, str]:
    """``extension -> parser`` from (extension, parser) pairs; registering an extension twice is an error."""
    table: dict[str, str] = {}
    for extension, parser in entries:
        key = extension.lower().lstrip(".")
        if key in table:
            raise ValueError(f"a parser is already registered for .{key}")
        table[key] = parser
    return table


def route_to_parsers(files: DataFrame, parsers: dict[str, str] | None = None) -> DataFrame:
    """Add ``parser`` by extension, or ``error_code`` where none is registered.

    The registry is a handful of constants of the program, so it is broadcast.
    """
    pairs = sorted((PARSERS if parsers is None else parsers).items())
    table = files.sparkSession.createDataFrame(pairs, "extension string, parser string")
    return files.join(F.broadcast(table), "extension", "left").withColumn(
        "error_code", F.when(F.col("parser").isNull(), "unsupported_format")
    )
