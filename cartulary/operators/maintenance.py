"""Failing jobs that have been in progress for too long, and explaining failures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.config import DEFAULTS, Settings

# Codes and messages.
STALE_CODE = "stale_job"
STALE_MESSAGE = "The job was interrupted (worker restart or timeout) and was marked as failed by maintenance."
NO_TEXT_CODE = "no_text_layer"
UNSUPPORTED_CODE = "unsupported_format"
FAILED_CODE = "processing_failed"
USER_MESSAGES = {
    NO_TEXT_CODE: "这份文件没有可以提取的文字层（扫描件或图片版 PDF），暂时无法生成知识结构。请提供可以选中文字的 PDF，或等待 OCR 支持。",
    UNSUPPORTED_CODE: "暂不支持这种文件类型，目前只接受 PDF 和 DOCX。",
}
FALLBACK_MESSAGE = "文档处理失败，请稍后重试。"


def _moment(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now)


def _deadline(now: datetime | Column, settings: Settings) -> Column:
    return _moment(now) - F.make_dt_interval(secs=F.lit(settings.stale_job_timeout_seconds).cast("decimal(18,6)"))


def reap_documents(documents: DataFrame, now: datetime | Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Documents with stale indexing or tree building failed; ``reaped`` marks them."""
    stale = F.col("updated_at") < _deadline(now, settings)
    indexing, building = stale & (F.col("status") == "indexing"), stale & (F.col("tree_status") == "building")
    return documents.select(
        *[c for c in documents.columns if c not in ("status", "tree_status", "error_code", "error_message", "tree_error")],
        F.when(indexing, "failed").otherwise(F.col("status")).alias("status"),
        F.when(indexing, STALE_CODE).otherwise(F.col("error_code")).alias("error_code"),
        F.when(indexing, STALE_MESSAGE).otherwise(F.col("error_message")).alias("error_message"),
        F.when(building, "failed").otherwise(F.col("tree_status")).alias("tree_status"),
        F.when(building, STALE_MESSAGE).otherwise(F.col("tree_error")).alias("tree_error"),
        F.coalesce(indexing | building, F.lit(False)).alias("reaped"),
    )


def reap_questions(questions: DataFrame, now: datetime | Column, settings: Settings = DEFAULTS) -> DataFrame:
    stale = (F.col("created_at") < _deadline(now, settings)) & F.col("status").isin("queued", "running")
    return questions.select(
        *[c for c in questions.columns if c not in ("status", "error_message", "answered_at")],
        F.when(stale, "failed").otherwise(F.col("status")).alias("status"),
        F.when(stale, STALE_MESSAGE).otherwise(F.col("error_message")).alias("error_message"),
        F.when(stale, _moment(now)).otherwise(F.col("answered_at")).alias("answered_at"),
        F.coalesce(stale, F.lit(False)).alias("reaped"),
    )


def reap_counts(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """One row: documents failed, questions failed, total."""
    left = documents.agg(F.count_if(F.col("reaped")).alias("documents_failed"))
    right = questions.agg(F.count_if(F.col("reaped")).alias("questions_failed"))
    both = left.select("documents_failed", F.lit(1).alias("k")).join(
        right.select("questions_failed", F.lit(1).alias("k")), "k"
    )
    return both.select(
        "documents_failed", "questions_failed", (F.col("documents_failed") + F.col("questions_failed")).alias("total")
    )


def document_failures(documents: DataFrame, coverage: DataFrame) -> DataFrame:
    """Failure code and message of every document, null where it can be processed.

    ``documents``: document_id, parser (null when unsupported). ``coverage`` comes from the page statistics.
    """
    joined = documents.join(coverage, "document_id", "left")
    pages = F.coalesce("page_count", F.lit(0))
    empty = F.coalesce("characters", F.lit(0)) == 0
    images = F.coalesce("image_pages", F.lit(0))
    code = (
        F.when(F.col("parser").isNull(), UNSUPPORTED_CODE)
        .when(pages == 0, FAILED_CODE)
        .when(empty, NO_TEXT_CODE)
    )
    message = (
        F.when(F.col("parser").isNull(), "Unsupported document type.")
        .when(pages == 0, "The PDF contains no pages.")
        .when(
            empty & (images > 0),
            F.concat(
                F.lit("The PDF has no extractable text layer: "),
                images.cast("string"),
                F.lit(" of "),
                pages.cast("string"),
                F.lit(" pages are images. Scanned documents require OCR."),
            ),
        )
        .when(
            empty,
            F.concat(F.lit("The PDF has no extractable text layer across "), pages.cast("string"), F.lit(" pages.")),
        )
    )
    return describe_errors(
        joined.select("document_id", code.alias("error_code"), message.alias("error_message"), pages.alias("page_count"), images.alias("image_pages"))
    )


def describe_errors(documents: DataFrame) -> DataFrame:
    """Add ``user_message`` for failed documents."""
    code = F.col("error_code")
    text = F.when(code == NO_TEXT_CODE, USER_MESSAGES[NO_TEXT_CODE]).when(
        code == UNSUPPORTED_CODE, USER_MESSAGES[UNSUPPORTED_CODE]
    )
    return documents.withColumn(
        "user_message", F.when(code.isNotNull(), F.coalesce(text, "error_message", F.lit(FALLBACK_MESSAGE)))
    )
