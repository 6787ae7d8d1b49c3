"""Staged extraction: only what a stage leaves open reaches the next, dearer one.

A stage is a function of the open documents; its result is written before the next stage is planned, and the next one
gets what an anti-join with the settled documents leaves. ``rank.cascade`` is for rows of all strategies that are there
already; here a stage whose documents are all settled costs nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers
from ..plans.shared import written
from . import rank
from .pages import number_tokens

#: Reads crops: open documents, resolution and image variants (none: all) in, rows doc_id, ord (of the crop), crop, variant, strings (array) out.
Reader = Callable[[DataFrame, int, Sequence[str]], DataFrame]

# Resolutions of the three readings, and image variants of the third.
PAGE_DPI, FINE_DPI, SHIFTED_DPI = 225, 300, 400
INVERTED, DILATED, BLURRED = "inv", "dilated", "blur"
# What a number may look like in a page's text, how often the label's capture counts, and a token of a finer reading.
LABELLED = r"(?i)IDOC#[:\s]*([A-Za-z0-9]{4,10})"
LABEL_VOTES = 3
FINE_TOKEN = r"[A-Za-z0-9/\\|!&$%()\[\]{}]{4,12}"
VARIANT_TOKEN = r"[A-Za-z0-9/\\|!&$%()\[\]{}]{4,14}"
# The length score of a number that needs no other reading, and votes for one number over another.
SURE, FEW, MANY, FEW_FINE, MANY_FINE = 5, 3, 6, 2, 8
LEFT, RIGHT = "form_left_shifted", "packet_right_shifted"


@dataclass(frozen=True)
class Stage:
    """A step: ``run`` takes open documents (with what earlier stages found) and returns doc_id, value, done and what it likes to pass on."""

    name: str
    run: Callable[[DataFrame], DataFrame]


def escalate(docs: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    """doc_id, value, stage: of each document the value of the stage that settled it, else the last one found, or null.

    docs: doc_id (one row each) and whatever the stages need. A document that a stage doesn't return stays as it was. A
    document that no stage settled has the stage null. Stages end when no document is open.
    """
    asked = docs.columns
    open_docs, settled = docs.withColumn("value", F.lit(None).cast("string")), []
    for stage in stages:
        if open_docs.isEmpty():
            break
        found = written(stage.run(open_docs))
        done = found.where(F.coalesce("done", F.lit(False)))
        settled.append(done.select("doc_id", "value", F.lit(stage.name).alias("stage")))
        left = open_docs.join(done.select("doc_id"), "doc_id", "left_anti")
        known = found.where(~F.coalesce("done", F.lit(False))).drop("done")
        passed = [c for c in left.columns if c not in asked and c not in known.columns]
        new = [c for c in known.columns if c not in ("doc_id", "value")]
        met = left.select(*asked, F.col("value").alias("_before"), *passed, *(F.col(c).alias(f"_old_{c}") for c in left.columns if c not in asked and c in new)).join(known, "doc_id", "left")
        keep = [F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) if f"_old_{c}" in met.columns else F.col(c) for c in new]
        open_docs = written(met.select(*asked, F.coalesce("value", "_before").alias("value"), *passed, *keep))
    out = open_docs.select("doc_id", "value", F.lit(None).cast("string").alias("stage"))
    for part in settled:
        out = out.unionByName(part)
    return out


def _score(value: str = "value") -> Column:
    """What numbers are compared by: the score of their length, then the length; nothing scores as no digits."""
    v = F.coalesce(F.col(value), F.lit(""))
    return F.struct(numbers.length_score(v).alias("s"), F.char_length(v).alias("l"))


def _tokens(strings: DataFrame, tokens: Column, test: Callable[[Column], Column]) -> DataFrame:
    """doc_id, crop, pos, value: normalised tokens that pass a test, in order; strings: doc_id, crop, ord, strings."""
    each = strings.select("doc_id", "crop", "ord", F.posexplode(tokens).alias("k", "token")).withColumn("value", numbers.normalise(F.col("token")))
    return each.where(test(F.col("value"))).select("doc_id", "crop", F.struct("ord", "crop", "k").alias("pos"), "value")


def _counts(tokens: DataFrame, crop: str = "default") -> DataFrame:
    """doc_id, value, n, in_default, first: how often a number is read, in the default crop, and where first."""
    return tokens.groupBy("doc_id", "value").agg(F.count("*").alias("n"), F.count_if(F.col("crop") == crop).alias("in_default"), F.min("pos").alias("first"))


def _by_votes(counts: DataFrame) -> DataFrame:
    """doc_id, voted, voted_n, voted_default: the number of the best length, then of most votes, then the greatest."""
    best = counts.groupBy("doc_id").agg(F.max(F.struct(_score().alias("s"), "n", "value", "in_default")).alias("b"))
    return best.select("doc_id", F.col("b.value").alias("voted"), F.col("b.n").alias("voted_n"), F.col("b.in_default").alias("voted_default"))


def _by_place(counts: DataFrame) -> DataFrame:
    """doc_id, value, n: the number of the best length that is read first."""
    order = F.struct((-numbers.length_score(F.col("value"))).alias("s"), (-F.char_length("value")).alias("l"), F.col("first"))
    best = counts.groupBy("doc_id").agg(F.min_by(F.struct("value", "n"), order).alias("b"))
    return best.select("doc_id", "b.value", "b.n")


def voted_number(tokens: DataFrame) -> DataFrame:
    """doc_id, value: the first number of the best length, or the one of most votes of that length if the first is seldom read and
    the other one often in the default crop."""
    counts = _counts(tokens)
    j = _by_place(counts).join(_by_votes(counts), "doc_id")
    take = (F.col("voted") != F.col("value")) & (_score("voted") == _score()) & (F.col("n") <= FEW) & (F.col("voted_default") >= MANY)
    return j.select("doc_id", F.when(take, F.col("voted")).otherwise(F.col("value")).alias("value"))


def finer_number(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """doc_id, value, done: a finer reading's number of most votes in place of the value so far, if it is longer, or as long and
    read often while that value is seldom read again; docs: doc_id, value."""
    counts = _counts(tokens)
    j = docs.select("doc_id", F.coalesce("value", F.lit("")).alias("value")).join(_by_votes(counts), "doc_id")
    again = counts.select("doc_id", F.col("value").alias("value"), F.col("n").alias("again"))
    j = j.join(again, ["doc_id", "value"], "left")
    often = (F.col("value") != "") & (F.col("voted") != F.col("value")) & (_score("voted") == _score()) & (F.coalesce("again", F.lit(0)) <= FEW_FINE) & (F.col("voted_n") >= MANY_FINE)
    take = (_score("voted") > _score()) | often
    return j.where(take).select("doc_id", F.col("voted").alias("value"), (F.col("voted") != F.col("value")).alias("done"))


def _variant_values(readings: DataFrame) -> DataFrame:
    """doc_id, variant, value: normalised tokens of readings of image variants."""
    tokens = F.flatten(F.transform("strings", lambda x: F.regexp_extract_all(x, F.lit(VARIANT_TOKEN), F.lit(0))))
    return readings.select("doc_id", "variant", F.explode(tokens).alias("raw")).select("doc_id", "variant", numbers.normalise(F.col("raw")).alias("value")).where("value <> ''")


def _strings(readings: DataFrame) -> DataFrame:
    return readings.select("doc_id", "crop", (F.col("ord") + 1).alias("ord"), "strings")


def scanned_number(docs: DataFrame, read: Reader) -> DataFrame:
    """doc_id, value, stage of scanned forms' numbers; docs: doc_id, text (of the first page), subtype (``pages.layout_subtype``).

    1. ``page``: the label's capture in the text and all crops at PAGE_DPI; a six-digit number settles a form, unless
       it is shifted to the left.
    2. ``fine``: the crops of the others at FINE_DPI; a number other than the first stage's settles a form.
    3. ``shifted``: of forms shifted to the left two variants at SHIFTED_DPI; the commonest six-digit number of the first
       that the second has, too.

    A form that nothing settled has its best number so far, or '' if that isn't plausible, and no stage.
    """

    def page(some: DataFrame) -> DataFrame:
        readings = _strings(read(some.select("doc_id"), PAGE_DPI, []))
        told = F.regexp_extract("text", LABELLED, 1)
        label = some.select("doc_id", F.lit("label").alias("crop"), F.lit(0).cast(readings.schema["ord"].dataType).alias("ord"), F.array_repeat(told, LABEL_VOTES).alias("strings")).where(F.element_at("strings", 1) != "")
        strings = label.unionByName(readings)
        best = voted_number(_tokens(strings, number_tokens(F.col("strings")), numbers.plausible))
        out = some.select("doc_id", "subtype").join(best, "doc_id", "left")
        return out.select("doc_id", "value", ((numbers.length_score(F.coalesce("value", F.lit(""))) >= SURE) & (F.coalesce("subtype", F.lit("")) != LEFT)).alias("done"))

    def fine(some: DataFrame) -> DataFrame:
        strings = _strings(read(some.select("doc_id"), FINE_DPI, []))
        tokens = F.flatten(F.transform("strings", lambda x: F.regexp_extract_all(x, F.lit(FINE_TOKEN), F.lit(0))))
        return finer_number(some, _tokens(strings, tokens, numbers.plausible))

    def shifted(some: DataFrame) -> DataFrame:
        left = some.where(F.col("subtype") == LEFT).select("doc_id")
        values = _variant_values(read(left, SHIFTED_DPI, [INVERTED, DILATED]))
        of = lambda v: values.where(F.col("variant") == v).select("doc_id", "value")
        common = rank.shifted_consensus(of(INVERTED).groupBy("doc_id", "value").agg(F.count("*").alias("n")), of(DILATED))
        return common.select("doc_id", "value", F.lit(True).alias("done"))

    out = escalate(docs.select("doc_id", "text", "subtype"), [Stage("page", page), Stage("fine", fine), Stage("shifted", shifted)])
    plain = F.when(F.col("stage").isNotNull() | F.coalesce(numbers.plausible(F.col("value")), F.lit(False)), F.col("value")).otherwise("")
    return out.select("doc_id", plain.alias("value"), "stage")


def packet_override(docs: DataFrame, read: Reader) -> DataFrame:
    """doc_id, value of packets shifted to the right: the commonest six-digit number of the blurred variant at SHIFTED_DPI if one digit
    differs from the six-digit value so far; docs: doc_id, value, subtype. Only those packets are read again."""
    some = docs.where((F.col("subtype") == RIGHT) & (F.char_length("value") == 6))
    values = _variant_values(read(some.select("doc_id"), SHIFTED_DPI, [BLURRED])).where(F.char_length("value") == 6)
    other = rank.most_common(values.groupBy("doc_id", "value").agg(F.count("*").alias("n"))).select("doc_id", F.col("value").alias("other"))
    return rank.one_digit_override(docs.join(other, "doc_id", "left")).select("doc_id", "value")
