"""Text normalisers and validators: Column to Column, built-in expressions only.

Missing is the empty string, as in the data model; null only where a function says so. Regular
expressions use (?U) where spaces of all of Unicode count.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that never belong to a name.
NAME_STOPWORDS = [
    "name",
    "ame",
    "lame",
    "current",
    "status",
    "please",
    "check",
    "one",
    "relationship",
    "phone",
    "number",
    "include",
    "area",
    "code",
    "gender",
    "dob",
    "idoc",
    "doc",
    "information",
    "lack",
    "due",
    "needs",
    "helps",
    "support",
    "better",
    "reentry",
    "success",
    "special",
    "accommodations",
    "for",
    "your",
    "and",
    "id",
    "ido",
    "idc",
    "ob",
    "oa",
    "ao",
    "ht",
    "qd",
    "fit",
]
# Fragments that mark form text.
NAME_BLOCKED = [
    "inform",
    "ormat",
    "status",
    "relation",
    "phone",
    "number",
    "accommod",
    "support",
    "reentry",
    "success",
    "current",
    "please",
    "check",
    "include",
    "lack",
    "leav",
    "conven",
    "name",
]
# Fixed value: labels that leak into a name; everything from one on is dropped.
NAME_LEAKS = (
    r"(?i)\b(?:ne:?|me:?|Age:?|DOB:?|D\.?O\.?B:?|Last\s*\d+\s*digits?\s*(?:of\s*)?(?:SSN)?:?|IDoc#?:?|ID[O0]C#?:?"
    r"|special\s*accommodations?|of\s*information|Gender:?|Date\s*of\s*Birth:?|Hia\d+)\b.*"
)
NAME_TOKEN = r"[A-Za-z][A-Za-z'.-]*"
# Text that a form prints itself.
PROMPT_MARKERS = [
    "please check",
    "additional information form",
    "housing application",
    "phone number",
    "current status",
    "company:",
    "page 3 of 4",
    "page 4 of 4",
    "v2.0",
    "special accommodations",
    "of information",
    "for your convenience",
]
PROMPT_COMPACT = ["page3of4", "page4of4", "idocdatasensitivityclassification", "pleasecheckboxes"]
# Unicode's line breaks but \n, and its spaces that break no line.
BREAKS = r"[\r\x0B\f\x85\u2028\u2029]"
BLANKS = " \t\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
CITIES = ["Boise", "Nampa", "Caldwell", "Meridian", "Twin Falls", "Pocatello"]


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.char_length(c)


def fold(c: Column) -> Column:
    """A-Z as a-z and all else as it is, so that a search without (?i) finds in it what one with (?i) finds in c."""
    return F.when(is_ascii(c), F.lower(c)).otherwise(F.translate(c, ascii_uppercase, ascii_lowercase))


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean(c: Column) -> Column:
    """Squeezed and stripped."""
    return F.trim(squeeze(c))


def clean_capture(c: Column, edge: str = " _:-") -> Column:
    return F.trim(squeeze(F.btrim(c, F.lit(edge))))


def line_text(c: Column) -> Column:
    """Stripped lines that aren't blank, with a newline between them."""
    return strip(F.regexp_replace(c, r"(?U)\s*\R\s*", "\n"))


def lines(c: Column) -> Column:
    """Stripped lines that aren't blank."""
    # Printable ASCII has one break and one blank, which are found without a regular expression for each line.
    plain = F.transform(F.split(c, "\n"), lambda x: F.trim(x))
    other = F.transform(F.split(F.regexp_replace(c, BREAKS, "\n"), "\n"), lambda x: F.btrim(x, F.lit(BLANKS)))
    return F.filter(F.when(c.rlike(r"[^\n -~]"), other).otherwise(plain), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Blank-separated words; none for an empty string."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def compact_text(c: Column) -> Column:
    """compact that reads 0 as o and keeps slashes."""
    return F.regexp_replace(F.replace(F.lower(c), F.lit("0"), F.lit("o")), "[^a-z0-9/]+", "")


def checkbox_fold(c: Column) -> Column:
    """Check marks as x, without spaces."""
    folded = F.translate(F.replace(F.lower(c), F.lit("0"), F.lit("o")), "口区☑☒α", "xxxxx")
    return F.regexp_replace(folded, r"(?U)\s+", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def only_if(value: Column, condition: Column) -> Column:
    return F.when(condition, value).otherwise(F.lit(""))


def valid_date(c: Column, capture: bool = True) -> Column:
    v = clean_capture(c) if capture else clean(c)
    return only_if(v, v.rlike(r"\A[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\z"))


def valid_age(c: Column) -> Column:
    n = digits(c).try_cast("int")
    return only_if(n.cast("string"), n.between(17, 100))


def valid_last4(c: Column) -> Column:
    return only_if(digits(c), F.char_length(digits(c)) == 4)


def valid_gender(c: Column) -> Column:
    v = F.regexp_replace(F.lower(c), "[^a-z]", "")
    return F.when(v.isin("m", "male"), "Male").when(v.isin("f", "female"), "Female").otherwise("")


def valid_phone(c: Column, least: int = 7, most: int | None = 12) -> Column:
    """Scanned forms take 7 to 12 digits, digital ones 7 or more, packets 10 or more."""
    v = clean_capture(c) if most else clean(c)
    n = F.char_length(digits(v))
    return only_if(v, (n >= least) & (n <= most if most else F.lit(True)))


def valid_email(c: Column) -> Column:
    v = clean(c)
    return only_if(v, v.rlike(r"\A[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\z"))


def valid_city(c: Column, cities: Sequence[str] = CITIES) -> Column:
    """The first city of the list that the text holds: a fixed order."""
    out = None
    for city in cities:
        has = F.contains(F.lower(c), F.lit(city.lower()))
        out = F.when(has, city) if out is None else out.when(has, city)
    return out.otherwise("")


def title(c: Column) -> Column:
    """Every run of letters with one capital, also after - and /."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), lambda x: F.initcap(x)), "")


def valid_county(c: Column) -> Column:
    v = F.replace(clean_capture(c), F.lit("_"), F.lit(""))
    return only_if(title(v), v.rlike(r"\A[A-Za-z /-]{2,40}\z"))


def yes_no(c: Column) -> Column:
    v = F.lower(strip(c))
    return only_if(v, v.isin("yes", "no"))


def preview(c: Column, limit: int = 120) -> Column:
    v = strip(F.replace(c, F.lit("\n"), F.lit(" ")))
    return F.when(F.char_length(v) <= limit, v).otherwise(F.concat(F.substring(v, 1, limit - 3), F.lit("...")))


def path_fragment(c: Column) -> Column:
    """A part of a path: other characters as one underscore each run, none at the ends; item for nothing."""
    bare = F.btrim(F.regexp_replace(F.trim(c), "[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("item"))


def recognised(c: Column, multiline: bool = False) -> Column:
    """Recognised text in normal form: NFKC, straight quotes, runs of blanks squeezed, edges free of blanks and _,-.

    Several lines keep their breaks, two in a row at most.
    """
    from .udfs import nfkc

    v = F.coalesce(nfkc(c), F.lit(""))
    if not multiline:
        return F.btrim(F.regexp_replace(F.replace(v, F.lit("\n"), F.lit(" ")), r"(?U)\s+", " "), F.lit(" _,-"))
    v = F.regexp_replace(F.regexp_replace(v, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.btrim(F.regexp_replace(v, " *\n *", "\n"), F.lit(" _,-\n"))


def flag(c: Column) -> Column:
    """Whether a setting is switched on."""
    return F.lower(F.trim(F.coalesce(c, F.lit("")))).isin("1", "true", "yes", "on")


def format_phone(c: Column) -> Column:
    return F.regexp_replace(c, r"\A(\d{3})(\d{3})(\d{4})\z", "($1) $2-$3")


def token_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(NAME_TOKEN), F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    """Distinct words that two strings share."""
    return F.size(F.array_intersect(tokens(a), tokens(b)))


def is_prompt(c: Column, markers: Sequence[str] = PROMPT_MARKERS) -> Column:
    """Whether text is the form's own; further markers, such as an organisation's name, are a parameter."""
    low, small = F.lower(c), compact(c)
    out = F.lit(False)
    for m in markers:
        out = out | F.contains(low, F.lit(m))
    for m in PROMPT_COMPACT:
        out = out | F.contains(small, F.lit(m))
    return out


def review_status(c: Column) -> Column:
    v = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(v.isin("approved", "ready", "train"), "approved").when(v.isin("skip", "rejected", "ignore"), "skip").otherwise("pending")


def stem_name(c: Column, year_digits: str = "2") -> Column:
    """File stem without its trailing date."""
    return strip(F.regexp_replace(c, rf"\s+\d{{1,2}}-\d{{1,2}}-\d{{{year_digits}}}\z", ""))


def name_value(c: Column) -> Column:
    """The best run of one to four name-like tokens of a captured name.

    Tokens are scored once; windows are compared as (score, earliest start, least width).
    """
    v = strip(F.regexp_replace(c, NAME_LEAKS, ""))
    v = strip(F.regexp_replace(v, r"[Aa]ge\s*:\s*\d.*$", ""))
    v = clean(F.regexp_replace(v, r"[_|]+", " "))
    raw = F.regexp_extract_all(v, F.lit(NAME_TOKEN), F.lit(0))
    stop = F.array(*map(F.lit, NAME_STOPWORDS))
    blocked = "|".join(NAME_BLOCKED)

    def scored(t: Column) -> Column:
        size, low = F.char_length(t), F.lower(t)
        is_stop, is_blocked = F.array_contains(stop, low), low.rlike(blocked)
        score = F.least(size, F.lit(10)) + 3 - F.when(size <= 2, 3).otherwise(0) - F.when(is_stop, 6).otherwise(0) - F.when(is_blocked, 6).otherwise(0)
        return F.struct(t.alias("t"), score.alias("score"), is_stop.alias("stop"), (is_stop | is_blocked).alias("bad"))

    def best(ts: Column) -> Column:
        def windows(start: Column) -> Column:
            def window(width: Column) -> Column:
                w = F.slice(ts, start, width)
                total = F.aggregate(w, F.lit(0), lambda a, x: a + x["score"]) + F.when(width >= 2, 4).otherwise(0)
                total = total + F.when(F.exists(w, lambda x: x["stop"]), 0).otherwise(2)
                return F.struct(total.alias("score"), (-start).alias("s"), (-width).alias("w"))

            return F.transform(F.sequence(F.lit(1), F.least(F.lit(4), F.size(ts) - start + 1)), window)

        top = F.array_max(F.flatten(F.transform(F.sequence(F.lit(1), F.size(ts)), windows)))
        return let(top, lambda t: F.slice(ts, -t["s"], -t["w"]))

    def trimmed(w: Column) -> Column:
        w = F.when((F.size(w) > 2) & (F.char_length(F.element_at(w, 1)["t"]) <= 2), F.slice(w, 2, F.size(w))).otherwise(w)
        return let(w, edges)

    def edges(w: Column) -> Column:
        good = F.filter(F.transform(w, lambda x, i: F.when(~x["bad"], i + 1)), lambda i: i.isNotNull())

        def cut(g: Column) -> Column:
            kept = F.slice(w, F.array_min(g), F.array_max(g) - F.array_min(g) + 1)
            return F.when(F.size(g) > 0, F.array_join(F.transform(kept, lambda x: x["t"]), " ")).otherwise("")

        return let(good, cut)

    def chosen(raw: Column) -> Column:
        return F.when(F.size(raw) > 0, let(F.transform(raw, scored), lambda ts: let(best(ts), trimmed))).otherwise("")

    out = F.regexp_replace(let(raw, chosen), "^[^A-Za-z]+|[^A-Za-z]+$", "")
    return let(out, lambda v: only_if(v, F.char_length(F.regexp_replace(v, "[^A-Za-z]", "")) >= 2))


def field_value(key: Column, value: Column) -> Column:
    """A captured value by the rule of its field; others as captured."""
    return let(clean_capture(value), lambda v: _by_field(key, v))


def _by_field(key: Column, v: Column) -> Column:
    from .numbers import loose_id

    rules: list[tuple[list[str], Column]] = [
        (["applicant.name", "additional_form.name"], name_value(v)),
        (["applicant.idoc_number"], loose_id(v)),
        (["applicant.dob", "signing.application_date", "addictions.date_of_last_use"], valid_date(v)),
        (["applicant.age"], valid_age(v)),
        (["applicant.ssn_last4"], valid_last4(v)),
        (["applicant.gender"], valid_gender(v)),
        (["contacts.personal_phone", "contacts.emergency_phone", "employment.employer_phone_or_email"], valid_phone(v)),
        (["criminal.conviction_county"], valid_county(v)),
    ]
    out = F.when(v == "", "")
    for keys, rule in rules:
        out = out.when(key.isin(keys), rule)
    return out.otherwise(v)
