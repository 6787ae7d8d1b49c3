"""Candidate counting, scoring, consensus and top-k; order columns break every tie."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names, numbers, text

# Words that make a name candidate suspicious.
SUSPICIOUS = ["age", "dob", "ssn", "idoc", "gender", "special", "accommodation"]


def name_score(value: Column, confidence: Column, copies: Column, weight: Column) -> Column:
    """Score of a name candidate: more and longer letter words, agreement and confidence raise it."""
    letters = F.char_length(F.regexp_replace(value, "[^A-Za-z]", ""))
    n = text.token_count(value)
    solid = F.greatest(F.lit(1), F.char_length(F.regexp_replace(value, r"\s+", "")))
    suspicious = F.lower(value).rlike("|".join(SUSPICIOUS))
    minus = lambda condition, points: F.when(condition, points).otherwise(0.0)
    # Points are fixed values.
    return (
        weight
        + F.least(n, F.lit(4)) * 3.0
        + F.when(n >= 2, 4.0).otherwise(-1.0)
        + F.least(letters, F.lit(24)) * 0.18
        + letters / solid * 4.0
        + confidence * 3.0
        + copies * 1.25
        - minus(value.rlike("[0-9]"), 6.0)
        - minus(suspicious, 8.0)
        - minus(F.char_length(value) < 5, 4.0)
    )


def scored_names(candidates: DataFrame, weights: Mapping[str, float], by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """candidates (doc_id, ord, source, value, confidence) with copies and score; ``by``: what a document is told by."""
    weight = F.lit(1.0)
    for source, w in weights.items():
        weight = F.when(F.col("source") == source, w).otherwise(weight)
    counted = candidates.withColumn("copies", F.count("*").over(W.partitionBy(*by, "value")))
    return counted.withColumn("score", name_score(F.col("value"), F.col("confidence"), F.col("copies"), weight))


def ranked_names(candidates: DataFrame, weights: Mapping[str, float], k: int | None = None, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each value of a document (told by the columns ``by``), best first (rank), k at most."""
    # Sums of floats: equal to nine digits is equal.
    best = [F.desc(F.round("score", 9)), F.desc("confidence"), F.desc(F.char_length("value")), F.asc("ord")]
    first = scored_names(candidates, weights, by).withColumn("_r", F.row_number().over(W.partitionBy(*by, "value").orderBy(*best))).where("_r = 1")
    out = first.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*best))).drop("_r")
    return out.where(F.col("rank") <= k) if k else out


def best_name(scored: DataFrame) -> DataFrame:
    """The candidate of most copies, then score, confidence and length, for each document."""
    order = [F.desc("copies"), F.desc("score"), F.desc("confidence"), F.desc(F.char_length("value")), F.asc("ord")]
    return scored.withColumn("_r", F.row_number().over(W.partitionBy("doc_id").orderBy(*order))).where("_r = 1").drop("_r")


def top_listing(ranked: DataFrame, k: int = 8) -> DataFrame:
    """doc_id, value (the best) and candidates (k at most, scores to three digits)."""
    one = F.struct("rank", "source", "value", F.round("confidence", 3).alias("confidence"), F.round("score", 3).alias("score"))
    listed = ranked.where(F.col("rank") <= k).groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("candidates"))
    return listed.select("doc_id", F.element_at("candidates", 1)["value"].alias("value"), "candidates")


def histogram(readings: DataFrame, dates: bool = True) -> DataFrame:
    """doc_id, value, n: how often each candidate number is read; without dates if asked for."""
    found = numbers.candidates(F.col("raw"))
    found = found if dates else F.filter(found, lambda v: ~numbers.looks_like_date(v))
    each = readings.select("doc_id", F.explode_outer(found).alias("value")).where("value is not null")
    return each.groupBy("doc_id", "value").agg(F.count("*").alias("n"))


def lengths(value: str = "value") -> list[Column]:
    """A number's length as it ranks."""
    return [numbers.length_score(F.col(value)).alias("s"), F.char_length(value).alias("l")]


def best_number(counts: DataFrame) -> DataFrame:
    """doc_id, value, n: by length, then count, then value."""
    return counts.groupBy("doc_id").agg(F.max(F.struct(*lengths(), F.col("n"), F.col("value"))).alias("b")).select("doc_id", F.col("b.value").alias("value"), F.col("b.n").alias("n"))


def most_common(counts: DataFrame) -> DataFrame:
    """doc_id, value, n: by count, then length, then value."""
    return counts.groupBy("doc_id").agg(F.max(F.struct(F.col("n"), *lengths(), F.col("value"))).alias("b")).select("doc_id", F.col("b.value").alias("value"), F.col("b.n").alias("n"))


def best_and_voted(counts: DataFrame, votes: str = "n") -> DataFrame:
    """doc_id, value, n (``best_number``) and v, vn (``most_common`` by the column of votes; null without any): both in one pass."""
    vn = F.col(votes)
    both = counts.groupBy("doc_id").agg(F.max(F.struct(*lengths(), F.col("n"), F.col("value"))).alias("b"), F.max(F.when(vn > 0, F.struct(vn.alias("n"), *lengths(), F.col("value")))).alias("c"))
    return both.select("doc_id", "b.value", "b.n", F.col("c.value").alias("v"), F.col("c.n").alias("vn"))


def vote_override(best: DataFrame, voted: DataFrame, few: int = 3, many: int = 6) -> DataFrame:
    """The voted value in place of the best one: as good a length, seldom read against often read."""
    return overridden(best.join(voted.select("doc_id", F.col("value").alias("v"), F.col("n").alias("vn")), "doc_id", "left"), few, many)


def overridden(j: DataFrame, few: int = 3, many: int = 6) -> DataFrame:
    """``vote_override`` of both values in one row (value, n, v, vn)."""
    same = (numbers.length_score(F.col("value")) == numbers.length_score(F.col("v"))) & (F.char_length("value") == F.char_length("v"))
    take = (F.col("v") != F.col("value")) & same & (F.col("n") <= few) & (F.col("vn") >= many)
    return j.select("doc_id", F.when(F.coalesce(take, F.lit(False)), F.col("v")).otherwise(F.col("value")).alias("value"), F.coalesce(take, F.lit(False)).alias("overridden"))


def consensus(best: DataFrame, finer: DataFrame, few: int = 2, many: int = 8) -> DataFrame:
    """The finer reading if its length scores higher, or on a tie if it is read much more often."""
    return replaced(best.join(finer.select("doc_id", F.col("value").alias("v"), F.col("n").alias("vn")), "doc_id", "left"), few, many)


def replaced(j: DataFrame, few: int = 2, many: int = 8) -> DataFrame:
    """``consensus`` of both values in one row (value, n, v, vn)."""
    a, b = F.struct(*lengths("value")), F.struct(*lengths("v"))
    take = (b > a) | ((a == b) & (F.col("v") != F.col("value")) & (F.col("n") <= few) & (F.col("vn") >= many))
    return j.select("doc_id", F.when(F.coalesce(take, F.lit(False)), F.col("v")).otherwise(F.col("value")).alias("value"), F.coalesce(take, F.lit(False)).alias("replaced"))


def shifted_consensus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Most common six-digit value of a's readings that b has too."""
    six = a.where(F.col("value").rlike(r"\A[0-9]{6}\z")).join(b.select("doc_id", "value").distinct(), ["doc_id", "value"], "left_semi")
    return most_common(six)


def one_digit_override(docs: DataFrame) -> DataFrame:
    """docs (.., value, other): other if it differs in one digit."""
    take = (F.char_length("value") == F.char_length("other")) & (numbers.distance(F.col("value"), F.col("other")) == 1)
    return docs.withColumn("value", F.when(F.coalesce(take, F.lit(False)), F.col("other")).otherwise(F.col("value")))


def cascade(candidates: DataFrame) -> DataFrame:
    """doc_id, strategy, method, values: the first strategy that found anything.

    candidates: doc_id, strategy_rank, strategy, values. Every engine's rows are in one table.
    """
    some = candidates.where(F.size("values") > 0).groupBy("doc_id").agg(F.min(F.struct("strategy_rank", "strategy", "values")).alias("b"))
    return some.select("doc_id", "b.strategy", "b.values")


def match_score(hits: DataFrame) -> DataFrame:
    """hits (doc_id, ord, number, directory_name, directory_normal, name_ord, ocr_name, ocr_normal) with the match features of each pair."""
    from ..functions.udfs import name_ratio

    a, b = F.col("ocr_normal"), F.col("directory_normal")
    # In steps: each part is a column that is worked out once, whoever uses it.
    keyed = hits.withColumns({"_a": names.key_of_normal(a), "_b": F.col("directory_key") if "directory_key" in hits.columns else names.key_of_normal(b)})
    parts = names.match_parts(a, b, F.col("_a"), F.col("_b"))
    scored = keyed.withColumns({"_ratio": name_ratio(a, b)} | parts).withColumn("m", names.match_features(a, b, F.col("_ratio")))
    return scored.drop("_a", "_b", "_ratio", *parts)


_FEATURES = ["score", "last_name_match", "first_name_match", "overlap_count", "sequence_ratio"]


def ranked_hits(hits: DataFrame, counted: bool = False) -> DataFrame:
    """Directory hits of each document, best name match first.

    hits: doc_id, ord, number, directory_name, names (array of read names, each normal form counts once); or
    with directory_normal, and names as structs (name, normal) of ``names.unique``, if they are known. A hit takes its best name; without names all hits score 0 and keep their order.
    counted: with found, the rows of hits that a document has.
    """
    if "directory_normal" not in hits.columns:
        hits = hits.withColumn("directory_normal", names.normalise(F.col("directory_name")))
    if hits.schema["names"].dataType.simpleString() == "array<string>":
        hits = hits.withColumn("names", names.unique(F.col("names")))
    own = ["doc_id", "ord", "number", "directory_name", "directory_normal", *(c for c in ("directory_key",) if c in hits.columns)]
    each = hits.select(*own, F.posexplode_outer("names").alias("name_ord", "n"))
    each = each.select(*own, "name_ord", F.coalesce("n.name", F.lit("")).alias("ocr_name"), F.coalesce("n.normal", F.lit("")).alias("ocr_normal"))
    # Both windows stand on one shuffle, by the document, of what is shown.
    m = match_score(each).select("doc_id", "ord", "number", "directory_name", "name_ord", "ocr_name", "m.level", *(f"m.{f}" for f in _FEATURES)).repartition("doc_id")
    if counted:
        m = m.withColumn("found", F.count_if(F.coalesce("name_ord", F.lit(0)) == 0).over(W.partitionBy("doc_id")))
    order = [F.desc(f) for f in _FEATURES]
    best = m.withColumn("_r", F.row_number().over(W.partitionBy("doc_id", "ord").orderBy(*order, F.asc_nulls_last("name_ord")))).where("_r = 1")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(*order, F.asc("ord"))))
    return ranked.select("doc_id", "rank", "ord", "number", "directory_name", F.nullif("ocr_name", F.lit("")).alias("matched_name"), F.col("level").alias("match_level"), *_FEATURES, *(["found"] if counted else []))


def failure_queue(rows: DataFrame, limit: int) -> DataFrame:
    """Failed readings to review first: handwritten, unmatched, dissimilar, unsure; ties by path."""
    order = [
        F.when(F.col("classification") == "housing_application_v1", 0).otherwise(1),
        F.when(~F.col("exact_match"), 0).otherwise(1) + F.when(~F.col("first_last_match"), 0).otherwise(1),
        F.col("token_overlap"),
        F.col("similarity_ratio"),
        F.col("confidence"),
        F.col("source_pdf"),
    ]
    return rows.orderBy(*order).limit(limit)
