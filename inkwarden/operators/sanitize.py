"""HTML copies: scan, transform, scan again, and decide."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import htmltext
from .scan import scan_files

COUNTS = "struct<" + ",".join(f"{c}:int" for c in htmltext.COUNTERS) + ">"
PRIVATE_KEY = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----"


def transformed(pages: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """id, text (binary), error and counts of each page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, data in zip(b.iloc[:, 0], b.iloc[:, 1], strict=True):
                try:
                    text, counts = htmltext.transform(bytes(data))
                    out.append((i, text, None, counts))
                except htmltext.Rejected as e:
                    out.append((i, None, e.code, None))
                except TypeError:
                    out.append((i, None, "INPUT_INVALID", None))
            yield pd.DataFrame(out, columns=["id", "text", "error", "counts"])

    return pages.select(F.col(id_col), F.col(content_col).cast("binary")).mapInPandas(run, f"id {kind}, text binary, error string, counts {COUNTS}")


def rejection_col(html: Column) -> Column:
    """The refusal that built-in functions can tell: a style sheet anywhere in otherwise plain markup."""
    return F.when(html.rlike(r"(?i)<style\b"), "UNSUPPORTED_CSS")


def copied(files: DataFrame, id_col: str = "path", content_col: str = "content", name_col: str = "filename") -> DataFrame:
    """id, transformation_status, delivery_status, reason, counts and the hashes of input and output."""
    first = scan_files(files, id_col, content_col, name_col).select("id", F.col("sha256").alias("input_sha256"), F.col("analysis_complete").alias("_in_ok"), "format")
    text = transformed(files, id_col, content_col)
    named = text.filter("text IS NOT NULL").withColumn("_name", F.lit("copy.txt"))
    second = scan_files(named, "id", "text", "_name").select("id", F.col("sha256").alias("output_sha256"), F.col("analysis_complete").alias("_out_ok"), ((F.col("verdict") == "VALID") & (F.col("status") == "ALLOWED") & (F.size("findings") == 0)).alias("_clean"))
    raw = files.select(F.col(id_col).alias("id"), F.col(content_col).cast("binary").cast("string").rlike(PRIVATE_KEY).alias("_secret"))
    rows = first.join(raw, "id").join(text, "id").join(second, "id", "left")
    reason = (
        F.when(~F.col("_in_ok"), "INPUT_INCOMPLETE").when(~F.col("format").isin("html", "htm"), "UNSUPPORTED_TRANSFORMATION").when(F.col("_secret"), "SENSITIVE_CONTENT")
        .when(F.col("error").isNotNull(), F.col("error")).when(~F.col("_out_ok"), "OUTPUT_INCOMPLETE").when(~F.col("_clean"), "OUTPUT_REQUIRES_REVIEW").otherwise("COPY_PASSED_CHECKS")
    )
    rows = rows.withColumn("reason", reason)
    made = F.col("reason").isin("OUTPUT_INCOMPLETE", "OUTPUT_REQUIRES_REVIEW", "COPY_PASSED_CHECKS")
    return rows.select(
        "id", F.when(made, "SANITIZED").otherwise("FAILED").alias("transformation_status"), F.when(F.col("reason") == "COPY_PASSED_CHECKS", "ALLOWED").otherwise("DENIED").alias("delivery_status"),
        "reason", "input_sha256", F.when(made, F.col("output_sha256")).alias("output_sha256"), F.when(made, F.col("counts")).alias("omitted_counts"),
    )


def history(copies: DataFrame, reports: DataFrame) -> DataFrame:
    """Each copy with the reports on its input and its output by their hashes, null where there is none."""
    known = reports.filter(F.col("sha256") != "").groupBy("sha256").agg(F.min("id").alias("report_id"))
    of = lambda side: known.select(F.col("sha256").alias(f"{side}_sha256"), F.col("report_id").alias(f"{side}_report"))
    return copies.join(of("input"), "input_sha256", "left").join(of("output"), "output_sha256", "left")


def omitted(pages: DataFrame) -> DataFrame:
    """Sums of what was left out over :func:`transformed` pages; refused ones count as such."""
    return pages.agg(F.count("*").alias("pages"), F.count("error").alias("refused"), *[F.coalesce(F.sum(f"counts.{c}"), F.lit(0)).alias(c) for c in htmltext.COUNTERS])
