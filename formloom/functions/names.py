"""Person names: normal form, key and match features."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, strip, tokens

# Short first names and what each stands for. chris is short for christine, so Chris and
# Christopher have different keys.
NICKNAMES = {
    "bob": "robert",
    "bobby": "robert",
    "rob": "robert",
    "robby": "robert",
    "bill": "william",
    "billy": "william",
    "will": "william",
    "willy": "william",
    "willie": "william",
    "jim": "james",
    "jimmy": "james",
    "jamie": "james",
    "joe": "joseph",
    "joey": "joseph",
    "mike": "michael",
    "mikey": "michael",
    "dan": "daniel",
    "danny": "daniel",
    "dave": "david",
    "davey": "david",
    "tom": "thomas",
    "tommy": "thomas",
    "dick": "richard",
    "rick": "richard",
    "ricky": "richard",
    "rich": "richard",
    "steve": "steven",
    "stevie": "steven",
    "tony": "anthony",
    "chris": "christine",
    "matt": "matthew",
    "pat": "patrick",
    "ed": "edward",
    "eddie": "edward",
    "ted": "edward",
    "teddy": "edward",
    "larry": "lawrence",
    "jerry": "gerald",
    "gerry": "gerald",
    "terry": "terrence",
    "terri": "terrence",
    "charlie": "charles",
    "chuck": "charles",
    "chas": "charles",
    "sam": "samuel",
    "sammy": "samuel",
    "jack": "john",
    "johnny": "john",
    "jon": "john",
    "alex": "alexander",
    "al": "albert",
    "ben": "benjamin",
    "benny": "benjamin",
    "ken": "kenneth",
    "kenny": "kenneth",
    "tim": "timothy",
    "timmy": "timothy",
    "brad": "bradley",
    "fred": "frederick",
    "freddy": "frederick",
    "jeff": "jeffrey",
    "greg": "gregory",
    "nick": "nicholas",
    "andy": "andrew",
    "drew": "andrew",
    "ron": "ronald",
    "ronny": "ronald",
    "don": "donald",
    "donny": "donald",
    "liz": "elizabeth",
    "beth": "elizabeth",
    "lizzy": "elizabeth",
    "kathy": "katherine",
    "kate": "katherine",
    "katie": "katherine",
    "katy": "katherine",
    "jenny": "jennifer",
    "jen": "jennifer",
    "sue": "susan",
    "suzy": "susan",
    "pam": "pamela",
    "peggy": "margaret",
    "maggie": "margaret",
    "meg": "margaret",
    "debbie": "deborah",
    "deb": "deborah",
    "barb": "barbara",
    "becky": "rebecca",
    "cindy": "cynthia",
    "sandy": "sandra",
    "mandy": "amanda",
    "vicky": "victoria",
    "vicki": "victoria",
    "cathy": "catherine",
}


def normalise(c: Column) -> Column:
    """First Last order at the first comma, letters and digits only, lower case: words with one space between."""
    turned = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?s)\A([^,]*),(.*)\z", "$2 $1")
    return F.lower(F.trim(F.regexp_replace(turned, "[^A-Za-z0-9]+", " ")))


def canonical_first(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for x in chain.from_iterable(NICKNAMES.items())))
    return F.coalesce(F.try_element_at(known, c), c)


def key(c: Column) -> Column:
    """struct(first, last) of a name of two words or more, else null."""
    return key_of_normal(normalise(c))


def key_of_normal(normal: Column) -> Column:
    """struct(first, last) of a normal form of two words or more, else null."""
    return F.when(F.contains(normal, F.lit(" ")), F.struct(canonical_first(F.substring_index(normal, " ", 1)).alias("first"), F.substring_index(normal, " ", -1).alias("last")))


def unique(found: Column) -> Column:
    """array<struct<name, normal>> of an array of names: the first of each normal form, in order, empty ones left out."""
    forms = F.transform(found, lambda n: F.struct(F.trim(F.coalesce(n, F.lit(""))).alias("name"), normalise(n).alias("normal")))

    def first(forms: Column) -> Column:
        normals = F.transform(forms, lambda x: x["normal"])
        return F.filter(forms, lambda x, i: (x["normal"] != "") & (F.array_position(normals, x["normal"]) == i + 1))

    return F.element_at(F.transform(F.array(forms), first), 1)


def display(c: Column) -> Column:
    """First Last order, case kept."""
    v = F.trim(F.coalesce(c, F.lit("")))
    parts = F.split(v, ",", 2)
    return clean(F.when(F.contains(v, F.lit(",")), F.concat(strip(F.element_at(parts, 2)), F.lit(" "), strip(F.element_at(parts, 1)))).otherwise(v))


def first_last_equal(a: Column, b: Column) -> Column:
    """Same first and same last word of two normal forms."""
    x, y = tokens(a), tokens(b)
    same = (F.try_element_at(x, F.lit(1)) == F.try_element_at(y, F.lit(1))) & (F.try_element_at(x, F.lit(-1)) == F.try_element_at(y, F.lit(-1)))
    return F.coalesce(same, F.lit(False))


def match_parts(a: Column, b: Column, key_a: Column, key_b: Column) -> dict[str, Column]:
    """What ``match_features`` needs of two normal forms and their keys, as columns: each is used several times."""
    x, y = F.split(a, " "), F.split(b, " ")
    alike = (F.size(x) == F.size(y)) & (F.array_sort(F.array_distinct(x)) == F.array_sort(F.array_distinct(y)))
    return {
        "_shared": F.size(F.array_intersect(x, y)),
        "_most": F.greatest(F.size(x), F.size(y), F.lit(1)),
        "_alike": (a == b) | alike,
        "_first": F.coalesce(key_a["first"] == key_b["first"], F.lit(False)),
        "_last": F.coalesce(key_a["last"] == key_b["last"], F.lit(False)),
    }


def match_features(a: Column, b: Column, ratio: Column) -> Column:
    """How well a read name (a) fits a directory name (b), both in normal form, with their ``match_parts`` beside them; ratio: their sequence similarity.

    struct(score, last_name_match, first_name_match, overlap_count, sequence_ratio, level): in this
    order greater means better.
    """
    # Points and thresholds are fixed values.
    shared, same_words, first, last = (F.col(c) for c in ("_shared", "_alike", "_first", "_last"))
    share = shared / F.col("_most")
    add = lambda condition, points: F.when(condition, points).otherwise(0.0)
    score = share * 45.0 + ratio * 35.0 + add(a == b, 45.0) + add(same_words, 30.0) + add(first, 25.0) + add(last, 35.0)
    score = score + add(first & last, 30.0) - add((shared == 0) & ~last, 30.0)
    level = (
        F.when(same_words | (first & last), "exact")
        .when(last & ((shared >= 2) | (ratio >= 0.78)), "strong")
        .when((shared >= 1) | (ratio >= 0.60), "partial")
        .when(score >= 20.0, "weak")
        .otherwise("none")
    )
    empty = (a == "") | (b == "")
    return F.struct(
        F.when(empty, 0.0).otherwise(score).alias("score"),
        (~empty & last).alias("last_name_match"),
        (~empty & first).alias("first_name_match"),
        F.when(empty, 0).otherwise(shared).alias("overlap_count"),
        F.when(empty, 0.0).otherwise(ratio).alias("sequence_ratio"),
        F.when(empty, "none").otherwise(level).alias("level"),
    )


def truth_level(a: Column, b: Column) -> Column:
    """How a predicted normal form fits the expected one."""
    x, y = tokens(a), tokens(b)
    return (
        F.when((a == "") | (b == ""), "none")
        .when(a == b, "exact")
        .when(first_last_equal(a, b), "first_last")
        .when(F.array_sort(x) == F.array_sort(y), "token_reordered")
        .when(F.arrays_overlap(x, y), "partial")
        .otherwise("none")
    )


def batch_similarity(a: Column, b: Column, key_a: Column, key_b: Column) -> Column:
    """exact by key, partial by last or first word, none; over normal forms and their keys. An empty form fits none."""
    either = (F.substring_index(a, " ", -1) == F.substring_index(b, " ", -1)) | (F.substring_index(a, " ", 1) == F.substring_index(b, " ", 1))
    return F.when((a == "") | (b == ""), "none").when(F.coalesce(key_a == key_b, F.lit(False)), "exact").when(F.coalesce(either, F.lit(False)), "partial").otherwise("none")


def evaluation_match(a: Column, b: Column) -> Column:
    """Equal, same words, or same first and last word, of two normal forms that aren't empty."""
    same = (a == b) | (F.array_sort(tokens(a)) == F.array_sort(tokens(b))) | first_last_equal(a, b)
    return (a != "") & (b != "") & same
