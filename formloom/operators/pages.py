"""Recognised pages: lines in reading order, candidates in page text, layout and registration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, numbers, text
from ..functions.pixels import CheckboxTemplate, find_checkbox
from .rank import best_and_voted, overridden

# What ends a name in running text.
NAME_STOPS = [r"ID[O0]C#?", r"Last\s*4\s*digits", "DOB", r"D\.?O\.?B", r"2\.?\s*Gender", "Gender", r"special\s+accommodations"]
# The number's label, and what a candidate token is made of.
NUMBER_LABEL = r"(?i)IDOC#[:\s]*([A-Za-z0-9]{4,10})"
NUMBER_TOKEN = r"[A-Za-z0-9/\\|!&$%()\[\]{}]{4,10}"


def reading_order(lines: Column) -> Column:
    """Recognised lines (array of structs box: array of points x, y; text, score) from top to bottom, then left to right."""
    placed = F.transform(lines, lambda x, i: F.struct(F.array_min(F.transform(x["box"], lambda p: p["y"])).alias("y"), F.array_min(F.transform(x["box"], lambda p: p["x"])).alias("x"), i.alias("i"), x["text"].alias("text"), x["score"].alias("score")))
    return F.array_sort(placed)


def page_text(lines: Column) -> Column:
    """Text of the lines in reading order, one a line."""
    return F.array_join(F.transform(reading_order(lines), lambda x: x["text"]), "\n")


def mean_score(lines: Column) -> Column:
    """Mean confidence of the lines, 0 without any."""
    total = F.aggregate(lines, F.lit(0.0), lambda t, x: t + x["score"])
    return F.when(F.size(lines) > 0, total / F.size(lines)).otherwise(0.0)


def work_order(docs: DataFrame) -> DataFrame:
    """docs (.., digital, page_count, name) in the order of work: digital ones first, then by pages and name."""
    return docs.orderBy(F.desc("digital"), "page_count", "name")


def number_tokens(candidates: Column) -> Column:
    """Tokens of recognised strings that may be a number: of each string the labelled one, then all tokens, in order."""

    def one(c: Column) -> Column:
        labelled = F.filter(F.array(F.regexp_extract(c, NUMBER_LABEL, 1)), lambda x: x != "")
        return F.concat(labelled, F.regexp_extract_all(c, F.lit(NUMBER_TOKEN), F.lit(0)))

    return F.flatten(F.transform(candidates, one))


def page_names(page: Column) -> Column:
    """Name candidates of a page's text, once each in order: between the label and the next question, then what follows a name line."""
    between = F.regexp_extract_all(page, F.lit(rf"(?is)1\.?\s*Name:?\s*(.+?)\s*(?:{'|'.join(NAME_STOPS)})"), F.lit(1))

    def of_lines(lines: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            small = text.compact_text(line)
            named = F.contains(small, F.lit("1name")) | F.startswith(small, F.lit("name"))
            tail = text.strip(F.regexp_replace(line, r"(?i)\A.*?name:?", ""))
            after = F.coalesce(F.try_element_at(lines, i + 2), F.lit(""))
            after = F.when(after.rlike("(?i)gender|dob|ssn|idoc"), "").otherwise(after)
            return F.when(named, F.array(tail, after)).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(lines, one))

    every = F.transform(F.concat(between, text.let(text.lines(page), of_lines)), lambda x: text.clean_capture(x))
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def label_on_any_page(pages: DataFrame, label: str) -> DataFrame:
    """doc_id, seen: whether a compact label stands on any page (doc_id, page, text)."""
    return pages.groupBy("doc_id").agg(F.bool_or(F.contains(text.compact(F.col("text")), F.lit(label))).alias("seen"))


def registration(anchors: DataFrame, references: DataFrame, *order: str) -> DataFrame:
    """doc_id, class, shift_x, shift_y, anchor_count, name_x, has_label, any_anchor and subtype of each document.

    anchors: doc_id, class, key, x, y (found on the page; a row with a null key for a document without any);
    references: class, key, x, y (where they should be: a small table of the form's designer). order: columns of anchors; a document's
    shifts are added in their order, as sums of doubles, and what stands on a threshold, hang on it.
    """

    def mean(c: Column) -> Column:
        if not order:
            return F.coalesce(F.avg(c), F.lit(0.0))
        each = F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(*order, c.alias("v")))))
        return F.when(F.size(each) > 0, F.aggregate(each, F.lit(0.0), lambda t, x: t + x["v"]) / F.size(each)).otherwise(0.0)

    ref = references.select("class", "key", F.col("x").alias("rx"), F.col("y").alias("ry"))
    met = anchors.join(F.broadcast(ref), ["class", "key"], "left")
    out = met.groupBy("doc_id", "class").agg(
        mean(F.when(F.col("rx").isNotNull(), F.col("x") - F.col("rx"))).alias("shift_x"),
        mean(F.when(F.col("ry").isNotNull(), F.col("y") - F.col("ry"))).alias("shift_y"),
        F.count("rx").alias("anchor_count"),
        F.min(F.when(F.col("key") == "name", F.col("x"))).alias("name_x"),
        F.coalesce(F.bool_or(F.col("key") == "idoc_or_le"), F.lit(False)).alias("has_label"),
        (F.count("key") > 0).alias("any_anchor"),
    )
    return out.withColumn("subtype", layout_subtype(*(F.col(c) for c in ("class", "shift_x", "shift_y", "name_x", "has_label", "any_anchor"))))


def layout_subtype(kind: Column, dx: Column, dy: Column, name_x: Column, has_label: Column, any_anchor: Column) -> Column:
    """Layout of a document of a class by its anchors; other classes are their own layout. Thresholds are fixed values."""
    form = (
        F.when(~any_anchor, "form_unanchored")
        .when(F.coalesce(name_x < 0.060, F.lit(False)), "form_left_shifted")
        .when(dy < -0.010, "form_upshifted")
        .when(dx > 0.010, "form_right_shifted")
        .otherwise("form_standard")
    )
    packet = (
        F.when(~has_label, "packet_label_missing")
        .when(dx < -0.010, "packet_left_shifted")
        .when(dx > 0.010, "packet_right_shifted")
        .when(dy > 0.010, "packet_downshifted")
        .otherwise("packet_scanned_standard")
    )
    mail = F.when(~has_label, "email_forward_label_missing").when((F.abs(dx) > 0.010) | (F.abs(dy) > 0.010), "email_forward_shifted").otherwise("email_forward_standard")
    return F.when(kind == "housing_application_v1", form).when(kind == "application_packet", packet).when(kind == "email_forward_application_packet", mail).otherwise(kind)


# Where the packets' number stands, as page fractions, widest box first.
PACKET_BOXES = {
    "email_forward_application_packet": [("fixed_default", 0.15, 0.395, 0.64, 0.47), ("midwide", 0.22, 0.401, 0.56, 0.462), ("tight", 0.30, 0.403, 0.51, 0.456)],
    "application_packet": [("fixed_default", 0.54, 0.29, 0.86, 0.37), ("midwide", 0.60, 0.295, 0.84, 0.36), ("tight", 0.67, 0.305, 0.82, 0.35)],
}


def packet_crops(docs: DataFrame) -> DataFrame:
    """doc_id, crop, box: the packets' number boxes moved by each document's shift; docs: registration's rows."""
    rows = [(c, i, *b) for c, bs in PACKET_BOXES.items() for i, b in enumerate(bs)]
    table = docs.sparkSession.createDataFrame(rows, "class string, pos int, crop string, x1 double, y1 double, x2 double, y2 double")
    met = docs.join(F.broadcast(table), "class")
    return met.select("doc_id", "pos", "crop", boxes.shifted(boxes.box(*(F.col(c) for c in ("x1", "y1", "x2", "y2"))), F.col("shift_x"), F.col("shift_y")).alias("box"))


def packet_number(readings: DataFrame) -> DataFrame:
    """doc_id, value, overridden: the number of a packet from the recognised strings of its crops.

    readings: doc_id, crop, strings (array). The best of all crops' numbers by length, dates left out; the
    most common one takes its place if as long, often read in the default crop and the best one seldom.
    """
    # Filtered in the array, and an outer explode: a filter of rows, or the one that an inner explode brings, would work the values out again.
    read = F.filter(F.transform(number_tokens(F.col("strings")), numbers.normalise), lambda v: (v != "") & ~numbers.looks_like_date(v))
    each = readings.select("doc_id", "crop", F.explode_outer(read).alias("value")).where("value is not null")
    counts = each.groupBy("doc_id", "value").agg(F.count("*").alias("n"), F.count_if(F.col("crop") == "fixed_default").alias("vn"))
    return overridden(best_and_voted(counts, "vn"))


def fields_on_pages(docs: DataFrame, template: DataFrame) -> DataFrame:
    """docs (doc_id, page_count) with each template field whose page they have; the template is small."""
    t = F.broadcast(template)
    return docs.join(t, t["page"] <= docs["page_count"])


def review_crops(reviews: DataFrame, template: DataFrame) -> DataFrame:
    """doc_id, page, box, target: what to cut out for each review row (doc_id, field, page, status, page_count, stem).

    The box of a checkbox group is the union of its options' boxes; fields that the template doesn't
    have, or have no box, and pages beyond the last are left out.
    """
    t = template.select(F.col("key").alias("field"), "box", "boxes")
    met = reviews.join(F.broadcast(t), "field").where("page <= page_count")
    each = F.transform(F.map_values("boxes"), lambda b: boxes.box(b[0], b[1], b[2], b[3]))
    own = boxes.box(*(F.col("box")[i] for i in range(4)))
    box = F.when(F.col("box").isNotNull(), own).when(F.coalesce(F.size("boxes"), F.lit(0)) > 0, boxes.union_of(each))
    name = F.concat(text.path_fragment(F.col("stem")), F.lit("/p"), F.lpad(F.col("page").cast("string"), 2, "0"), F.lit("_"), text.path_fragment(F.col("field")), F.lit("_"), text.path_fragment(F.col("status")), F.lit(".png"))
    return met.select("doc_id", "page", box.alias("box"), name.alias("target")).where("box is not null")


def detected_checkbox(pages: DataFrame, templates: Sequence[CheckboxTemplate], most: int = 4, least: float = 0.55) -> DataFrame:
    """doc_id, prediction, method, confidence, yes_score, no_score, page, crop_box of documents' yes/no checkbox.

    pages: doc_id, page (from 0), raw, h, w (grey); the first ``most`` pages are looked at. The page that a template fits best
    decides, the first of equal ones: yes if its box is darker. Under ``least`` it is no, by default, without a crop box (what
    a reviewer is shown, as page fractions).
    """
    found = pages.where(F.col("page") < most).withColumn("m", find_checkbox(templates)("raw", "h", "w"))
    best = found.groupBy("doc_id").agg(F.max(F.struct(F.col("m.confidence").alias("confidence"), (-F.col("page")).alias("p"), F.col("m.version").alias("version"), F.col("m.yes_score").alias("yes"), F.col("m.no_score").alias("no"), *(F.col(f"m.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))).alias("b"))
    sure = F.col("b.confidence") >= least
    return best.select(
        "doc_id",
        F.when(sure & (F.col("b.yes") > F.col("b.no")), "yes").otherwise("no").alias("prediction"),
        F.when(sure, F.concat(F.lit("template_"), F.col("b.version"))).otherwise("default").alias("method"),
        F.col("b.confidence").alias("confidence"),
        F.when(sure, F.col("b.yes")).otherwise(0.0).alias("yes_score"),
        F.when(sure, F.col("b.no")).otherwise(0.0).alias("no_score"),
        F.when(sure, -F.col("b.p")).otherwise(-1).alias("page"),
        F.when(sure, boxes.box(*(F.col(f"b.{c}") for c in ("x1", "y1", "x2", "y2")))).alias("crop_box"),
    )
