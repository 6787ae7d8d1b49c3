"""Identifier candidates from noisy readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, digits, let, only_if

# Characters that recognition confuses with digits, and the digit each stands for.
CONFUSED = r"ILJ/\|![]{}OQDCUSZB&$%GEAHT"
MEANT = "111111111110000052888866447"
# The shorter table for single readings.
CONFUSED_SHORT = r"OoIlLJZSBG/\|!"
MEANT_SHORT = "00111125861111"
#: A reading that stands for itself alone.
PLAIN = r"\A[0-9]{4,8}\z"
#: Score of a number's length.
LENGTH_SCORES = {4: 2, 5: 4, 6: 5, 7: 4, 8: 3}
# What follows the label of a number, and the labels in turn.
CAPTURE = r"([A-Za-z0-9.,\-/\\()\[\]{}!|&$%'\" ]{4,15})"
LABELS = [r"(?i)ID[O0]C\s*#\s*:?\s*", r"(?i)IDOC\s*(?:or\s*LE\s*)?#\s*:?\s*", r"(?i)IDOC\s*Number\s*:?\s*"]


def candidates(c: Column) -> Column:
    """Sorted distinct digit strings of 4 to 8 characters that a reading may stand for.

    Parentheses stand for nothing or for a 1, so a reading with one has two variants, with two four;
    a reading may have two characters that aren't digits, so there are never more.
    """
    raw = F.trim(F.coalesce(c, F.lit("")))
    return F.when(raw.rlike(PLAIN), F.array(raw)).otherwise(_variants(raw))


def _variants(raw: Column) -> Column:
    """``candidates`` of a trimmed reading; each step is worked out once."""
    none = F.array().cast("array<string>")
    # The first parenthesis, then the second, as nothing and as a 1.
    first = lambda x, d: F.regexp_replace(x, r"\A(?<head>[^()]*)[()]", "${head}" + d)

    def numbers(read: Column) -> Column:
        both = F.array(*(first(first(read, a), b) for a in ("", "1") for b in ("", "1")))
        several = F.array_sort(F.array_distinct(F.filter(both, lambda v: v.rlike(PLAIN))))
        return F.when(read.rlike("[()]"), several).when(read.rlike(PLAIN), F.array(read)).otherwise(none)

    def of(kept: Column) -> Column:
        n_digits, n = F.char_length(digits(kept)), F.char_length(kept)
        # What the table doesn't know is dropped.
        read = F.regexp_replace(F.translate(kept, CONFUSED, MEANT), "[^0-9()]", "")
        return F.when((n == 0) | (n_digits < F.greatest(F.lit(3), n - 2)), none).otherwise(let(read, numbers))

    raw = F.when(raw.rlike(r"\A\d+\.0+\z"), F.substring_index(raw, ".", 1)).otherwise(raw)
    return let(F.regexp_replace(F.upper(raw), r"[^A-Z0-9/\\|!&$%()\[\]{}]", ""), of)


def length_score(c: Column) -> Column:
    out = F.lit(0)
    for size, score in LENGTH_SCORES.items():
        out = F.when(F.char_length(c) == size, score).otherwise(out)
    return out


def normalise(c: Column) -> Column:
    """The candidate of best length, the smallest of equals, without leading zeros."""
    raw = F.trim(F.coalesce(c, F.lit("")))
    best = F.array_min(F.transform(_variants(raw), lambda v: F.struct((-length_score(v)).alias("s"), (-F.char_length(v)).alias("n"), v.alias("v"))))["v"]
    return F.regexp_replace(F.when(raw.rlike(PLAIN), raw).otherwise(F.coalesce(best, F.lit(""))), r"\A0+(?=0*[1-9])", "")


def distance(a: Column, b: Column) -> Column:
    """Positions that differ; for unequal lengths the greater length."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    same = F.aggregate(pairs, F.lit(0), lambda t, x: t + x)
    return F.when(F.char_length(a) != F.char_length(b), F.greatest(F.char_length(a), F.char_length(b))).when(F.char_length(a) == 0, 0).otherwise(same)


def looks_like_date(c: Column) -> Column:
    return c.rlike(r"\A[0-9]{4}202[4-7]\z")


def plausible(c: Column) -> Column:
    return c.rlike(r"\A[0-9]{5,6}\z")


def read_digits(c: Column) -> Column:
    """A single reading as 4 to 8 digits, or null."""
    v = F.translate(F.regexp_replace(c, r"[^A-Za-z0-9/\\|!]", ""), CONFUSED_SHORT, MEANT_SHORT)
    return F.when(v.rlike(r"\A[0-9]{4,8}\z"), v)


def loose_id(c: Column) -> Column:
    v = F.regexp_replace(c, "[^A-Za-z0-9-]", "")
    return only_if(v, (F.char_length(v) >= 4) & (F.char_length(digits(v)) >= 3))


def numeric_id(c: Column) -> Column:
    v = F.ltrim(digits(c), F.lit("0"))
    return only_if(v, F.char_length(v).between(5, 6))


def packet_id(c: Column) -> Column:
    v = digits(clean(c))
    return only_if(v, F.char_length(v) >= 4)


def raw_capture(text: Column) -> Column:
    """What follows the first label that matches, or ''."""
    return F.coalesce(*(F.nullif(F.trim(F.regexp_extract(text, p + CAPTURE, 1)), F.lit("")) for p in LABELS), F.lit(""))


def text_candidates(text: Column) -> Column:
    """Numbers of a text: the labelled reading first, then every 5 or 6 digit number, in order, once each."""
    raw = raw_capture(text)
    none = F.array().cast("array<string>")
    single = F.coalesce(F.when(read_digits(raw).isNotNull(), F.array(read_digits(raw))), none)
    labelled = F.when(raw == "", none).when(raw.rlike(r"\A[0-9]{4,8}\z"), F.array(raw)).otherwise(F.when(F.size(candidates(raw)) > 0, candidates(raw)).otherwise(single))
    return F.array_distinct(F.concat(labelled, F.regexp_extract_all(text, F.lit(r"\b(\d{5,6})\b"), F.lit(1))))


def number_and_flag(value: Column, flag: Column) -> Column:
    """struct(number, flagged) of a cell that may hold a flag besides the number, or have it in a column of its own.

    A number is a whole run of digits: one of more than six isn't cut to its first six.
    """
    raw = F.trim(F.coalesce(value, F.lit("")))
    inside = F.contains(F.upper(raw), F.lit("RSO"))
    flagged = inside | (F.upper(F.trim(F.coalesce(flag, F.lit("")))) == "YES")
    first = F.regexp_extract(raw, r"\d{5,}", 0)
    rest = F.btrim(F.trim(F.regexp_replace(raw, r"(?i)RSO\s*/?\s*", "")), F.lit("/"))
    bare = F.when(inside, rest).otherwise(raw)
    number = F.when(inside & (first != ""), normalise(first)).when(F.char_length(digits(bare)) < 5, "").otherwise(normalise(bare))
    return F.struct(number.alias("number"), flagged.alias("flagged"))
