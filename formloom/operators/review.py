"""Review of extracted fields: what a person should look at, and the queues for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names, text

NAME_CONFIDENCE, TEXT_CONFIDENCE = 0.9, 0.8
# Fields that may be blank, and the answers that make others matter.
MAY_BE_BLANK = ["benefits.reinstatement_date", "benefits.previous_benefits_duration", "support.prescribed_medications", "contacts.case_manager_or_po"]
MATTERS_IF = {
    "employment.employer": ["employment.has_employment_upon_release"],
    "employment.employer_phone_or_email": ["employment.has_employment_upon_release"],
    "addictions.date_of_last_use": ["addictions.has_addictions"],
    "housing.transitional_home_name_city": ["housing.previously_in_transitional_home"],
    "history.violent_or_discharge_explanation": ["history.disciplined_or_discharged", "history.violent_crimes_or_dor"],
}


def _with_answers(fields: DataFrame) -> DataFrame:
    """fields (doc_id, field, kind, confidence, source, value, selected, options) with skip: a blank doesn't matter."""
    single = F.when(F.size("selected") == 1, F.element_at("selected", 1))
    needed = sorted({k for keys in MATTERS_IF.values() for k in keys})
    answers = fields.where(F.col("field").isin(needed)).groupBy("doc_id").agg(*(F.bool_or((F.col("field") == k) & (single == "yes")).alias(f"_{i}") for i, k in enumerate(needed)))
    skip = F.col("field").isin(MAY_BE_BLANK)
    for field, keys in MATTERS_IF.items():
        asked = F.lit(False)
        for k in keys:
            asked = asked | F.coalesce(F.col(f"_{needed.index(k)}"), F.lit(False))
        skip = skip | ((F.col("field") == field) & ~asked)
    return fields.join(answers, "doc_id", "left").withColumn("skip", skip).drop(*(f"_{i}" for i in range(len(needed))))


def _status() -> tuple[Column, Column]:
    """(status, severity) of a field's review, null if it needs none."""
    value = text.strip(F.coalesce("value", F.lit("")))
    box = F.col("kind") == "checkbox_group"
    binary = box & (F.array_sort("options") == F.array(F.lit("no"), F.lit("yes")))
    handwritten = F.startswith("source", F.lit("name_crop_")) | (F.col("source") == "page_text_name_regex")
    short = text.token_count(value) < 2
    is_name = F.col("field") == "applicant.name"
    unsure = handwritten | (F.col("confidence") < NAME_CONFIDENCE) | short
    status = (
        F.when(binary & (F.size("selected") > 1), "binary_checkbox_conflict")
        .when(binary & (F.size("selected") == 0), "binary_checkbox_unresolved")
        .when(box, F.lit(None))
        .when((value == "") & F.col("skip"), F.lit(None))
        .when(value == "", "blank_text")
        .when(is_name & unsure, "manual_name_review")
        .when(is_name, F.lit(None))
        .when(F.col("confidence") < TEXT_CONFIDENCE, "low_confidence_text")
    )
    high = (F.col("status") == "blank_text") | ((F.col("status") == "manual_name_review") & (short | (F.col("confidence") < 0.75)))
    return status, F.when(F.col("status").isNotNull(), F.when(high, "high").otherwise("medium"))


def field_reviews(fields: DataFrame) -> DataFrame:
    """fields with skip, status and severity."""
    status, severity = _status()
    return _with_answers(fields).withColumn("status", status).withColumn("severity", severity)


def summary(reviews: DataFrame) -> DataFrame:
    """doc_id, needs_review, high_severity."""
    return reviews.groupBy("doc_id").agg(F.count("status").alias("needs_review"), F.count_if(F.col("severity") == "high").alias("high_severity"))


def review_rows(docs: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row for each finding; docs: doc_id, supported, classification, reason.

    A name that needs review and reads with low confidence has two rows; an unsupported document one.
    """
    value = text.strip(F.coalesce("value", F.lit("")))
    low = (F.col("status") == "manual_name_review") & (F.col("confidence") < TEXT_CONFIDENCE)
    found = F.array_compact(F.array(F.col("status"), F.when(low, "low_confidence_text")))
    shown = F.when(F.col("status") == "binary_checkbox_conflict", F.array_join("selected", ", ")).when(F.col("kind") == "checkbox_group", "").otherwise(text.preview(value))
    rows = reviews.join(docs.where("supported").select("doc_id"), "doc_id", "left_semi").select("doc_id", "field", "kind", "confidence", "source", shown.alias("value_preview"), F.explode(found).alias("status"))
    other = docs.where(~F.col("supported")).select("doc_id", F.lit("__document__").alias("field"), F.lit("document").alias("kind"), F.lit(None).cast("double").alias("confidence"), F.col("classification").alias("source"), F.col("reason").alias("value_preview"), F.lit("unsupported_document").alias("status"))
    return rows.unionByName(other)


VARIANTS = ["tight", "context", "wide"]


def review_queue(crops: DataFrame) -> DataFrame:
    """doc_id with a path for each crop variant (the last one given) and the preferred one: tight, context, wide."""
    wide = crops.groupBy("doc_id").pivot("variant", VARIANTS).agg(F.max_by("path", "ord"))
    return wide.withColumn("preferred", F.coalesce(*VARIANTS))


def apply_queue(queue: DataFrame) -> DataFrame:
    """Approved rows with a path and a label. queue: status, label_text, expected_name, normalized_label, variant paths, path."""
    label = F.coalesce(F.nullif("label_text", F.lit("")), F.nullif("expected_name", F.lit("")), F.lit(""))
    normal = F.coalesce(F.nullif("normalized_label", F.lit("")), names.normalise(label))
    path = F.coalesce(F.nullif("path", F.lit("")), *(F.nullif(v, F.lit("")) for v in VARIANTS))
    out = queue.where(text.review_status(F.col("status")) == "approved").select("doc_id", path.alias("image"), label.alias("label"), normal.alias("normal"))
    return out.where("image is not null and label <> ''")


def select_options(scores: Column, threshold: Column) -> Column:
    """Options whose score reaches the threshold, sorted."""
    return F.array_sort(F.map_keys(F.map_filter(scores, lambda _, v: v >= threshold)))


def variant_priority(variant: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, VARIANTS)), variant), F.lit(0)) - 1, F.lit(99))


def first_by(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a stated order."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_r = 1").drop("_r")
