"""Verification: directory hits to green, yellow and red tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from .rank import ranked_hits

#: Candidates that a batch report lists and looks up for a document; everything else looks up all.
TRIED = 6


def lookup(docs: DataFrame, known: DataFrame, tried: int | None = None, *carried: str) -> DataFrame:
    """doc_id, ord, number, directory_name, its normal form and key, and carried columns: all candidates (or the first ``tried``) that the directory has, in order."""
    listed = F.col("candidates") if tried is None else F.slice("candidates", 1, tried)
    # Outer, and a filter of rows: an inner one would have the candidates worked out again to see whether there are any.
    each = docs.select("doc_id", *carried, F.posexplode_outer(listed).alias("ord", "number")).where("number is not null")
    entry = known.select("number", F.col("name").alias("directory_name"), F.col("normal").alias("directory_normal"), F.col("key").alias("directory_key"))
    return each.join(entry, "number").select("doc_id", "ord", "number", "directory_name", "directory_normal", "directory_key", *carried)


def live_status(n_candidates: Column, n_found: Column, n_names: Column, level: Column) -> Column:
    return (
        F.when((n_candidates == 0) | (n_found == 0), "red")
        .when((n_names == 0) | level.isin("weak", "none", "partial"), "yellow")
        .otherwise("green")
    )


def verify_live(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, number, directory_name, match_level, total_found, status of docs (doc_id, candidates, names).

    The closest hit by name is taken; red without hits, yellow without a name or a good match.
    """
    docs = docs.withColumn("_read", names.unique(F.col("names")))
    # The directory is met once: hits are counted where they are ranked.
    best = ranked_hits(lookup(docs, known, None, "_read").withColumnRenamed("_read", "names"), counted=True).where("rank = 1").select("doc_id", "number", "directory_name", "match_level", "found")
    out = docs.join(best, "doc_id", "left").withColumn("total_found", F.coalesce("found", F.lit(0)))
    status = live_status(F.size("candidates"), F.col("total_found"), F.size("_read"), F.coalesce("match_level", F.lit("none")))
    return out.select("doc_id", F.coalesce("number", F.try_element_at("candidates", F.lit(1))).alias("number"), "directory_name", F.coalesce("match_level", F.lit("none")).alias("match_level"), "total_found", status.alias("status"))


def verify_batch(docs: DataFrame, known: DataFrame, tried: int | None = None) -> DataFrame:
    """doc_id, number, directory_name, name_match, status of docs (doc_id, candidates, name): the older policy, of all candidates or the first ``tried``.

    First hit with the same name key, else first that shares a first or last word, else first; no match is red.
    """
    read = docs.withColumn("_n", names.normalise(F.col("name"))).withColumn("_k", names.key_of_normal(F.col("_n")))
    hits = lookup(read, known, tried, "_n", "_k")
    level = names.batch_similarity(F.col("_n"), F.col("directory_normal"), F.col("_k"), F.col("directory_key"))
    rank = F.when(F.col("level") == "exact", 0).when(F.col("level") == "partial", 1).otherwise(2)
    best = hits.withColumn("level", level).groupBy("doc_id").agg(F.min(F.struct(rank.alias("r"), "ord", "number", "directory_name", "level")).alias("b"))
    out = docs.join(best, "doc_id", "left")
    match = F.coalesce("b.level", F.lit("none"))
    status = F.when(match == "exact", "green").when(match == "partial", "yellow").otherwise("red")
    return out.select("doc_id", F.coalesce("b.number", F.try_element_at("candidates", F.lit(1))).alias("number"), F.coalesce("b.directory_name", F.lit("")).alias("directory_name"), match.alias("name_match"), status.alias("status"))


def explained(docs: DataFrame, known: DataFrame) -> DataFrame:
    """verify_live's rows with reason, raw_capture, extraction_method, candidates_tried, matched_name and candidate_results.

    docs: doc_id, candidates, names, raw_capture, extraction_method. candidate_results: the hits in order, scores to three digits.
    """
    read = docs.withColumn("_read", names.unique(F.col("names"))).withColumn("_tried", F.col("candidates"))
    ranked = ranked_hits(lookup(read, known, None, "_read").withColumnRenamed("_read", "names"))
    one = F.struct("rank", "ord", "number", "directory_name", "matched_name", "match_level", F.round("score", 3).alias("score"))
    hits = ranked.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("candidate_results"))
    out = read.join(hits, "doc_id", "left").withColumn("best", F.try_element_at("candidate_results", F.lit(1)))
    found = F.coalesce(F.size("candidate_results"), F.lit(0))
    level, n = F.coalesce("best.match_level", F.lit("none")), F.size("_tried")
    number = F.coalesce("best.number", F.try_element_at("candidates", F.lit(1)))
    start = F.concat(F.lit("Number "), number)
    reason = (
        F.when(n == 0, "No number found in document")
        .when(found <= 0, F.concat(F.lit("Tried "), n.cast("string"), F.lit(" candidate(s), none found in the directory")))
        .when(F.size("_read") == 0, F.concat(start, F.lit(" verified, but no name was read for ranking")))
        .when(level.isin("weak", "none"), F.concat(start, F.lit(" was the closest verified result, but the name match is "), level))
        .when(level == "partial", F.concat(start, F.lit(" selected by closest partial name match")))
        .otherwise(F.concat(start, F.lit(" selected as the closest name match")))
    )
    hit = F.coalesce(F.transform("candidate_results", lambda r: r["number"]), F.array().cast("array<string>"))
    tried = F.transform("_tried", lambda c: F.struct(c.alias("number"), F.array_contains(hit, c).alias("found")))
    total = F.greatest(found, F.lit(0))
    return out.select("doc_id", number.alias("number"), F.col("best.directory_name").alias("directory_name"), level.alias("match_level"), total.alias("total_found"), live_status(n, total, F.size("_read"), level).alias("status"), reason.alias("reason"), "raw_capture", "extraction_method", tried.alias("candidates_tried"), F.col("best.matched_name").alias("matched_name"), F.coalesce("candidate_results", F.array().cast(hits.schema["candidate_results"].dataType)).alias("candidate_results"))


def flag_payload(detected: DataFrame) -> DataFrame:
    """What is told of a detected yes/no flag: detected has doc_id, prediction, method, confidence, yes_score, no_score, page."""
    return detected.select("doc_id", F.col("prediction").alias("decision"), (F.col("prediction") == "yes").alias("flagged"), (F.col("method") == "default").alias("needs_review"), F.col("yes_score").alias("probability_yes"), F.col("no_score").alias("probability_no"), "confidence", "method", "page")


def response(extraction: DataFrame, verification: DataFrame, flags: DataFrame | None = None, crops: DataFrame | None = None) -> DataFrame:
    """One struct for each document; the directory's name, where there is one, is the resolved name, else the first one read.

    extraction: doc_id, filename, page_count, extraction_method, names. flags: flag_payload's rows; crops: doc_id, crop_images (map).
    Both are left out of a document's answer where it has none.
    """
    out = extraction.select("doc_id", "filename", "page_count", F.col("extraction_method").alias("_method"), "names").join(verification, "doc_id", "left")
    for name, table in (("flag", flags), ("crop_images", crops)):
        if table is None:
            out = out.withColumn(name, F.lit(None).cast("string"))
        else:
            out = out.join(table.select("doc_id", (F.struct(*(c for c in table.columns if c != "doc_id")) if name == "flag" else F.col("crop_images")).alias(name)), "doc_id", "left")
    first = F.nullif(F.try_element_at("names", F.lit(1)), F.lit(""))
    directory = F.nullif("directory_name", F.lit(""))
    source = F.when(directory.isNotNull(), "directory").when(first.isNotNull(), "ocr")
    told = [c for c in verification.columns if c != "doc_id"]
    return out.select("doc_id", "filename", "page_count", F.col("_method").alias("method"), F.coalesce(directory, first).alias("resolved_name"), source.alias("resolved_name_source"), F.struct(*told).alias("verification"), "flag", "crop_images")


def method(*flags: tuple[str, Column]) -> Column:
    """Names of the steps that were taken, joined by +."""
    return F.concat_ws("+", *(F.when(c, F.lit(name)) for name, c in flags))
