"""Evaluations from one end to the other: readings of crops, whole batches and failures against truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names, numbers, text
from . import directory, rank, review, verify

CAUSED = ["single_digit_ocr_mismatch", "multi_digit_ocr_mismatch", "expected_present_extracted_blank", "possible_workbook_update_or_document_disagreement"]


def grouped(rows: DataFrame, key: str = "source_pdf", order: str = "ord") -> DataFrame:
    """key, rows: the rows of each non-blank key in their order; the keys are sorted by whoever shows them."""
    each = F.struct(F.col(order).alias("_o"), *(c for c in rows.columns if c not in (key, order)))
    some = rows.where(F.trim(F.coalesce(key, F.lit(""))) != "")
    return some.groupBy(F.trim(key).alias(key)).agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x.dropFields("_o")).alias("rows"))


def filled(fields: DataFrame) -> DataFrame:
    """doc_id, filled, total: fields (doc_id, field, kind, value) with a value; a checkbox group always has one."""
    return fields.groupBy("doc_id").agg(F.count_if((F.col("kind") == "checkbox_group") | (F.coalesce("value", F.lit("")) != "")).alias("filled"), F.count("*").alias("total"))


def crop_manifest(manifest: DataFrame, candidates: DataFrame, split: str | None = None, variants: Sequence[str] = review.VARIANTS) -> DataFrame:
    """One row for each document of a crop manifest: the best name read on its crops against the expected one.

    manifest: source_pdf, variant, split, label_text, expected_name, normalized_label; candidates: source_pdf, variant,
    ord, source, value, confidence, score (what an engine reads on each crop).
    """
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    rows = manifest.where(F.trim(F.coalesce("source_pdf", F.lit(""))) != "").where(clean("variant").isin([v.lower() for v in variants]))
    rows = rows.where(clean("split") == split.strip().lower()) if split else rows
    expected = F.coalesce(F.nullif("label_text", F.lit("")), F.nullif("expected_name", F.lit("")), F.lit(""))
    normal = F.coalesce(F.nullif("normalized_label", F.lit("")), names.normalise(expected))
    place = review.variant_priority(F.col("variant"))
    docs = rows.groupBy("source_pdf").agg(F.min(F.struct(place.alias("p"), expected.alias("e"), normal.alias("n"))).alias("b"), F.array_join(F.array_sort(F.collect_set("variant")), ",").alias("variants"))
    docs = docs.select("source_pdf", F.col("b.e").alias("expected_name"), F.col("b.n").alias("expected_normal"), "variants")
    read = candidates.join(rows.select("source_pdf", "variant").distinct(), ["source_pdf", "variant"], "left_semi")
    # Agreement counts over all crops of a document; of equal candidates the greatest value is taken.
    same = read.groupBy("source_pdf", "value").agg(F.count("*").alias("copies"), F.max(F.struct("score", "confidence")).alias("m"))
    order = F.struct(F.col("copies"), F.col("m.score").alias("score"), F.col("m.confidence").alias("confidence"), F.char_length("value").alias("n"), "value")
    best = same.groupBy("source_pdf").agg(F.max_by(F.struct("value", F.col("m.confidence").alias("confidence")), order).alias("b"), F.sum("copies").alias("candidate_count"))
    out = docs.join(best, "source_pdf", "left").withColumn("extracted_name", F.coalesce("b.value", F.lit("")))
    out = out.withColumn("extracted_normal", names.normalise(F.col("extracted_name")))
    some = F.col("expected_normal") != ""
    return out.select(
        "source_pdf",
        "expected_name",
        "extracted_name",
        "expected_normal",
        "extracted_normal",
        (some & (F.col("extracted_normal") == F.col("expected_normal"))).alias("exact_match"),
        (some & names.first_last_equal(F.col("extracted_normal"), F.col("expected_normal"))).alias("first_last_match"),
        F.when(some, text.overlap(F.col("extracted_normal"), F.col("expected_normal"))).otherwise(0).alias("token_overlap"),
        F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        "variants",
    )


def failed_names(rows: DataFrame, handwritten: str | None = None) -> DataFrame:
    """Rows with a truth whose name isn't read exactly and shares no word with it; of one class only, if given."""
    out = rows.where((F.col("expected_name") != "") & ~F.col("exact_match") & (F.col("token_overlap") == 0))
    return out.where(F.col("classification") == handwritten) if handwritten else out


def failed_numbers(rows: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """Compared rows whose number doesn't match its truth; of the given categories only, if any."""
    out = rows.where(~F.col("number_match") & F.col("source_name").isNotNull())
    return out.where(F.col("category").isin(list(categories))) if categories else out


def failure_analysis(compared: DataFrame, readings: DataFrame, seen: DataFrame) -> DataFrame:
    """doc_id, category, present, expected_n, candidate_n, top_candidate, top_n, label_seen, cause of documents whose number failed.

    compared: truth.compared's rows; readings: doc_id, raw (all strings read for the number); seen: doc_id, seen (the label is on a page).
    """
    from .truth import failure_cause

    # The strings are read and counted once; a document's distinct candidates stand in one row.
    own = F.struct(F.col("n"), *rank.lengths(), F.col("value"))
    read = rank.histogram(readings).groupBy("doc_id").agg(F.count("*").alias("candidate_n"), F.max(own).alias("top"), F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("counts"))
    failed = compared.where(F.col("category").isin(CAUSED)).select("doc_id", "category", "extracted_number", "expected_number")
    out = failed.join(read, "doc_id", "left").join(seen, "doc_id", "left")
    out = out.withColumns({"expected_n": F.try_element_at("counts", F.col("expected_number")), "top_candidate": F.col("top.value"), "top_n": F.col("top.n")})
    present, label = F.col("expected_n").isNotNull(), F.coalesce("seen", F.lit(False))
    return out.select(
        "doc_id",
        "category",
        present.alias("present"),
        F.coalesce("expected_n", F.lit(0)).alias("expected_n"),
        F.coalesce("candidate_n", F.lit(0)).alias("candidate_n"),
        F.coalesce("top_candidate", F.lit("")).alias("top_candidate"),
        F.coalesce("top_n", F.lit(0)).alias("top_n"),
        label.alias("label_seen"),
        failure_cause(F.col("category"), present, F.col("extracted_number"), F.col("expected_number"), label).alias("cause"),
    )


def _joined(c: Column) -> Column:
    return F.array_join(F.slice(c, 1, verify.TRIED), ",")


def batch(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One report row for each document: candidates, directory, name fallback, lookup and tier; unreadable ones are errors.

    docs: doc_id, stem, page_count, method, texts (array of page texts in order), ocr_name, error (null if read);
    rows: directory rows (ord, number, name). The first page with enough text and a number gives the candidates.
    """
    known = directory.directory(rows)
    read = docs.where("error is null").withColumn("name", text.stem_name(F.col("stem")))
    pages = read.select("doc_id", F.posexplode("texts").alias("page", "text"))
    from ..sources.readers import embedded_candidates

    found = embedded_candidates(pages).select("doc_id", F.filter("values", lambda v: numbers.plausible(v)).alias("candidates"))
    none = F.array().cast("array<string>")
    each = read.join(found, "doc_id", "left").withColumn("candidates", F.coalesce("candidates", none)).withColumn("known_as", F.coalesce(F.nullif("name", F.lit("")), "ocr_name"))
    match = directory.best_match(each.select("doc_id", "candidates", F.col("known_as").alias("name")), known).select("doc_id", F.col("number").alias("m"), F.col("method").alias("how"))
    fallback = directory.name_fallback(each.select("doc_id", F.col("known_as").alias("name")), rows, known).select("doc_id", F.col("number").alias("f"))
    j = each.join(match, "doc_id", "left").join(fallback, "doc_id", "left")
    direct, by_name = F.col("m").isNotNull(), F.col("m").isNull() & F.col("f").isNotNull()
    listed = F.when(direct & ~F.array_contains("candidates", F.col("m")), F.concat(F.array("m"), F.col("candidates"))).when(by_name, F.concat(F.array("f"), F.col("candidates"))).otherwise(F.col("candidates"))
    how = F.when(direct, F.concat_ws("+", "method", "how")).when(by_name & (F.size("candidates") == 0), "spreadsheet_name_fallback").when(by_name, F.concat_ws("+", "method", F.lit("name_fallback"))).otherwise(F.col("method"))
    j = j.withColumns({"extraction_method": how, "candidates": listed})
    tier = verify.verify_batch(j.select("doc_id", "candidates", "name"), known, verify.TRIED)
    hits = verify.lookup(j.select("doc_id", "candidates"), known, verify.TRIED).groupBy("doc_id").agg(F.count("*").alias("candidates_found"))
    out = j.join(tier, "doc_id", "left").join(hits, "doc_id", "left").withColumn("candidates_found", F.coalesce("candidates_found", F.lit(0)))
    some = F.size("candidates") > 0
    status = F.when(~some, "no_candidates").when(F.col("candidates_found") == 0, "not_in_database").when(F.col("name_match") == "exact", "verified").when(F.col("name_match") == "partial", "partial_match").otherwise("name_mismatch")
    good = out.select("doc_id", "stem", "page_count", F.col("name").alias("filename_name"), "extraction_method", F.size("candidates").alias("num_candidates"), _joined(F.col("candidates")).alias("candidates"), "candidates_found", F.coalesce("number", F.lit("")).alias("number"), "directory_name", "name_match", status.alias("status"), F.col("status").alias("verification"))
    bad = docs.where("error is not null").select("doc_id", "stem", F.lit(None).cast("int").alias("page_count"), F.lit("").alias("filename_name"), F.lit("").alias("extraction_method"), F.lit(0).alias("num_candidates"), F.lit("").alias("candidates"), F.lit(0).cast("long").alias("candidates_found"), F.lit("").alias("number"), F.lit("").alias("directory_name"), F.lit("none").alias("name_match"), F.lit("error").alias("status"), F.lit("red").alias("verification"))
    return good.unionByName(bad)
