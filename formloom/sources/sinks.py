"""Sinks: JSON documents, CSV reports and split files; writers append or overwrite whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REVIEW_COLUMNS = ["doc_id", "field", "kind", "status", "confidence", "source", "value_preview"]


# The columns of each report, in order.
LAYOUTS = {
    "review": REVIEW_COLUMNS,
    "comparison": ["source_pdf", "classification", "layout_subtype", "extracted_name", "expected_name", "name_match", "extracted_supervision_number", "expected_supervision_number", "number_match", "mismatch_category"],
    "names": ["source_pdf", "classification", "supported_template", "name_backend", "expected_name", "extracted_name", "normalized_expected_name", "normalized_extracted_name", "exact_match", "first_last_match", "token_overlap", "similarity_ratio", "source", "confidence", "candidate_count", "top_candidates"],
    "crops": ["source_pdf", "classification", "name_backend", "expected_name", "extracted_name", "normalized_expected_name", "normalized_extracted_name", "exact_match", "first_last_match", "token_overlap", "similarity_ratio", "source", "confidence", "candidate_count", "top_candidates", "variants"],
    "corpus": ["source_pdf", "page_count", "document_classification", "template", "supported", "name", "idoc_number", "fields_filled", "fields_total", "expected_name", "name_match", "expected_number", "number_match", "error"],
    "live": ["source_pdf", "status", "page_count", "truth_found", "expected_name", "expected_idoc_number", "expected_rso", "predicted_name", "predicted_idoc_number", "predicted_rso", "idoc_match", "rso_match", "truth_name_match_level", "pipeline_name_match_level", "pipeline_match_score", "verification_status", "verification_reason", "extraction_method", "raw_capture", "candidate_count", "top_candidate_number", "top_candidate_name", "error"],
}


def documents(df: DataFrame, path: str) -> DataFrame:
    """One JSON object for each document; returns the manifest: doc_id and the file that holds it."""
    df.write.mode("overwrite").json(path)
    there = df.sparkSession.read.schema(df.select("doc_id").schema).json(path)
    return there.select("doc_id", F.input_file_name().alias("path"))


def report(df: DataFrame, path: str, layout: str | Sequence[str] = "review") -> None:
    """CSV with a header and a layout's order of columns; columns that ``df`` doesn't have are blank."""
    columns = LAYOUTS[layout] if isinstance(layout, str) else layout
    shown = [F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*shown).write.mode("overwrite").option("header", "true").csv(path)


def split_files(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """JSON lines by split, of the columns given or of all."""
    (df.select("split", *columns) if columns else df).write.mode("overwrite").partitionBy("split").json(path)


def manifest(df: DataFrame, path: str) -> None:
    """All rows as one CSV table with a header."""
    df.write.mode("overwrite").option("header", "true").csv(path)


def summary(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def data_uri(content: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.regexp_replace(F.base64(content), r"\s", ""))
