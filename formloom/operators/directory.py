"""Joins with a directory of (number, name, ord): exact, by name and within one edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names

LEAST_DIGITS, MOST_DIGITS = 5, 6


def directory(rows: DataFrame) -> DataFrame:
    """number, name, normal, key, ord from rows (ord, number, name): the last row of a number wins."""
    last = rows.where("number is not null and name is not null").groupBy("number").agg(F.max_by("name", "ord").alias("name"), F.max("ord").alias("ord"))
    last = last.withColumn("normal", names.normalise(F.col("name")))
    return last.withColumn("key", names.key_of_normal(F.col("normal")))


def names_index(rows: DataFrame) -> DataFrame:
    """first, last, numbers in load order, with repeats as loaded."""
    keyed = rows.where("number is not null and name is not null").withColumn("k", names.key(F.col("name"))).where("k is not null")
    return keyed.groupBy("k.first", "k.last").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "number"))), lambda x: x["number"]).alias("numbers"))


def by_number(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs (.., number) with directory_name, null if unknown."""
    return docs.join(known.select("number", F.col("name").alias("directory_name")), "number", "left")


def by_name(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs (.., name) with the numbers of its key, an empty array if none."""
    index = names_index(rows)
    keyed = docs.withColumn("_k", names.key(F.col("name")))
    out = keyed.join(index, (F.col("_k.first") == F.col("first")) & (F.col("_k.last") == F.col("last")), "left")
    return out.withColumn("numbers", F.coalesce("numbers", F.array().cast("array<string>"))).drop("_k", "first", "last")


def known_only(docs: DataFrame, known: DataFrame) -> DataFrame:
    return docs.join(known.select("number"), "number", "left_semi")


def unknown_only(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Also the resumable scan: rows whose key isn't in the sink yet."""
    return docs.join(known.select("number"), "number", "left_anti")


#: Digits of a candidate at most; longer ones are no candidates.
LONGEST = 8
#: Of a directory's numbers that aren't digits alone, more, or longer ones, are shuffled instead of sent to the tasks.
BROADCAST_NUMBERS, BROADCAST_DIGITS = 1_200_000, 32
#: A directory's numbers of so many digits at most stand as bits of words of 64: 1.8 million words at most, whatever the directory's size.
DIGITS = r"\A[0-9]{1,8}\z"


def _sent(found: DataFrame) -> DataFrame:
    """Numbers (match), sent to the tasks while they are few and short enough."""
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.max(F.char_length("match")), F.lit(0)).alias("longest")).first()
    return F.broadcast(found) if size["n"] <= BROADCAST_NUMBERS and size["longest"] <= BROADCAST_DIGITS else found


def _code(x: Column) -> Column:
    """A string of digits as a whole number, with a 1 before it that keeps its zeros; null for others."""
    return F.when(x.rlike(DIGITS), F.concat(F.lit("1"), x).cast("long"))


def _words(known: DataFrame) -> DataFrame:
    """word, bits: the codes of the directory's numbers, 64 to a row."""
    codes = known.select(_code(F.col("number")).alias("c")).where("c is not null")
    return codes.groupBy(F.shiftright("c", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(c & 63 as int))")).alias("bits"))


def _known_codes(coded: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of coded (.., code) whose code is a number of the directory."""
    met = coded.withColumn("word", F.shiftright("code", 6)).join(F.broadcast(_words(known)), "word")
    return met.where(F.expr("shiftright(bits, cast(code & 63 as int)) & 1") == 1).drop("word", "bits")


def _code_edits() -> Column:
    """array of (kind, p, d): an edit at the digit that counts p = 10^k."""
    at = [10**k for k in range(LONGEST)]
    each = [("self", 1, 0)] + [("put", p, d) for p in at for d in range(10)] + [("in", p, d) for p in at[:MOST_DIGITS] for d in range(10)] + [("out", p, 0) for p in at] + [("turn", p, 0) for p in at[:-1]]
    kinds = ("self", "put", "in", "out", "turn")
    return F.array(*(F.struct(F.lit(kinds.index(k)).alias("kind"), F.lit(p).cast("long").alias("p"), F.lit(d).cast("long").alias("d")) for k, p, d in each))


def _edited(coded: DataFrame) -> DataFrame:
    """candidate, code of all codes at one edit of coded's, and of its own; each once, as of equal digits beside each other the last is the one put in or left out."""
    each = coded.select("candidate", F.col("code").alias("x"), F.explode(_code_edits()).alias("e")).select("candidate", "x", "e.kind", "e.p", "e.d")
    fits = """CASE kind WHEN 0 THEN true WHEN 1 THEN x >= 10 * p AND (x div p) % 10 <> d
      WHEN 2 THEN x >= p AND x < {longest} AND (p = 1 OR (x div (p div 10)) % 10 <> d)
      WHEN 3 THEN x >= {least} AND x >= 10 * p AND (p = 1 OR (x div (p div 10)) % 10 <> (x div p) % 10)
      ELSE x >= 100 * p AND (x div p) % 10 <> (x div (10 * p)) % 10 END""".format(longest=10**MOST_DIGITS, least=10 ** (LEAST_DIGITS + 1))
    code = """CASE kind WHEN 0 THEN x WHEN 1 THEN x + (d - (x div p) % 10) * p WHEN 2 THEN ((x div p) * 10 + d) * p + x % p
      WHEN 3 THEN (x div (10 * p)) * p + x % p ELSE x + ((x div p) % 10 - (x div (10 * p)) % 10) * 9 * p END"""
    return each.where(fits).select("candidate", F.expr(code).alias("code"))


#: More characters than any string has.
WHOLE = (1 << 31) - 1


def _edits() -> Column:
    """array of (before, digit, turn, rest): keep so many characters, put a digit or turn the next two, go on at the position."""
    one = [(i, d, False, i + 2) for i in range(LONGEST) for d in "0123456789"]  # another digit at i + 1
    one += [(i, d, False, i + 1) for i in range(LONGEST) for d in "0123456789"]  # a digit put in after i
    one += [(i, "", False, i + 2) for i in range(LONGEST)]  # without the digit at i + 1
    one += [(i, "", True, i + 3) for i in range(LONGEST - 1)]  # the two after i turned
    one += [(WHOLE, "", False, WHOLE)]  # itself
    names = ("before", "digit", "turn", "rest")
    return F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, e, strict=True))) for e in one))


def _other_edits(others: DataFrame) -> DataFrame:
    """candidate, match: all strings at one edit of candidates that aren't digits alone, or are too long, and these themselves."""
    x, n = F.col("candidate"), F.char_length("candidate")
    each = others.withColumn("e", F.explode(_edits()))
    fits = (
        F.when(F.col("e.before") == WHOLE, True)
        .when(n > LONGEST, False)
        .when(F.col("e.turn"), n >= F.col("e.before") + 2)
        .when(F.col("e.digit") == "", (n > F.col("e.before")) & (n > LEAST_DIGITS) & (n - 1 >= LEAST_DIGITS))
        .when(F.col("e.rest") == F.col("e.before") + 1, (n >= F.col("e.before")) & (n + 1 <= MOST_DIGITS))
        .otherwise(n > F.col("e.before"))
    )
    turned = F.concat(F.substring(x, F.col("e.before") + 2, F.lit(1)), F.substring(x, F.col("e.before") + 1, F.lit(1)))
    put = F.when(F.col("e.turn"), turned).otherwise(F.col("e.digit"))
    edit = F.concat(F.substring(x, F.lit(1), F.col("e.before")), put, F.substring(x, F.col("e.rest"), F.lit(LONGEST)))
    return each.where(fits).select("candidate", edit.alias("match")).distinct()


def fuzzy(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """candidate, match: known numbers at one substitution, insertion (to 6 digits at most), deletion (from
    over 5 digits, to 5 at least) or swap of neighbours, and the number itself.

    No two numbers are compared, and no edit is shuffled: the edits of each distinct candidate of digits, some 150, are
    made as whole numbers and looked up in the directory's bits, which go to the tasks and have a bound. Candidates that
    aren't digits alone are edited as strings, and numbers that aren't are met by a join.
    """
    # The code is aggregated, so that its filters stand above the one shuffle of the candidates instead of reading them anew.
    each = candidates.where("candidate is not null").groupBy("candidate").agg(F.max(_code(F.col("candidate"))).alias("code"))
    others = _other_edits(each.where("code is null").select("candidate")).withColumn("code", _code(F.col("match")))
    coded = _edited(each.where("code is not null")).unionByName(others.where("code is not null").select("candidate", "code"))
    met = _known_codes(coded, known).select("candidate", F.substring(F.col("code").cast("string"), F.lit(2), F.lit(LONGEST)).alias("match"))
    rest = known.where(~F.col("number").rlike(DIGITS)).select(F.col("number").alias("match"))
    return met.unionByName(others.where("code is null").select("candidate", "match").join(_sent(rest), "match", "left_semi").select("candidate", "match"))


def one_edit(x: Column, y: Column) -> Column:
    """Whether ``fuzzy`` leads from a candidate to a number other than itself."""
    n, m = F.char_length(x), F.char_length(y)
    alike = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(x, F.lit(1), i) == F.substring(y, F.lit(1), i))
    same = F.size(alike) - 1  # characters before the edit
    after = lambda c, k: F.substring(c, same + 1 + k, F.lit(1 << 30))
    digit = lambda at: F.substring(y, at, F.lit(1)).rlike("[0-9]")
    turned = (F.substring(x, same + 1, F.lit(1)) == F.substring(y, same + 2, F.lit(1))) & (F.substring(x, same + 2, F.lit(1)) == F.substring(y, same + 1, F.lit(1))) & (after(x, 2) == after(y, 2))
    changed = digit(same + 1) & (after(x, 1) == after(y, 1))
    one = F.when(n == m, changed | turned).when(m == n + 1, (m <= MOST_DIGITS) & digit(same + 1) & (after(x, 0) == after(y, 1)))
    one = one.when(m == n - 1, (n > LEAST_DIGITS) & (m >= LEAST_DIGITS) & (after(x, 1) == after(y, 0))).otherwise(F.lit(False))
    return (n <= LONGEST) & (x != y) & one


def _left(x: Column) -> Column:
    """What one edit of a candidate leaves as it is: its first half, or its second, or all but the two middle characters, if they are turned."""
    n = F.char_length(x)
    h = F.floor(n / 2).cast("int")
    ends = F.concat(F.lit("t"), F.substring(x, F.lit(1), h - 1), F.substring(x, h + 1, F.lit(1)), F.substring(x, h, F.lit(1)), F.substring(x, h + 2, F.lit(LONGEST)))
    halves = F.array(F.concat(F.lit("a"), F.substring(x, F.lit(1), h)), F.concat(F.lit("z"), F.substring(x, h + 1, F.lit(LONGEST))), ends)
    return F.when(n <= LONGEST, halves)


def _left_of_known(y: Column) -> Column:
    """The parts of a number that candidates with one character less, as many, or one more may share."""
    m = F.char_length(y)
    halves = [F.floor((m + k) / 2).cast("int") for k in (-1, 0, 1)]
    first = [F.concat(F.lit("a"), F.substring(y, F.lit(1), h)) for h in halves]
    # The second half of a candidate of n characters has n - h of them.
    last = [F.concat(F.lit("z"), F.substring(y, m - (m + k - h) + 1, F.lit(1 << 30))) for k, h in zip((-1, 0, 1), halves, strict=True)]
    return F.array_distinct(F.array(*first, *last, F.concat(F.lit("t"), y)))


def best_match(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, number, method of docs (doc_id, candidates array, name).

    First candidate that is known under the name (or under any, without a name), else the first fuzzy
    match under the name, in order of candidates and then of numbers; else null and no_match.
    """
    k = known.select("number", F.col("key").alias("known_key"))
    each = docs.select("doc_id", names.key(F.col("name")).alias("key"), F.posexplode("candidates").alias("pos", "candidate"))
    same = each["key"].isNull() | F.coalesce(each["key"] == k["known_key"], F.lit(False))
    direct = each.join(k, (each["candidate"] == k["number"]) & same).select("doc_id", F.lit(0).alias("phase"), "pos", F.col("candidate").alias("match"))
    # A fuzzy match has the name's key: numbers meet under a key and a part of the number that the edit leaves, never by all edits.
    asked = each.where("key is not null").select("doc_id", "pos", "candidate", F.col("key.first").alias("f"), F.col("key.last").alias("l"), F.explode(_left(F.col("candidate"))).alias("part"))
    there = k.where("known_key is not null").select("number", F.col("known_key.first").alias("f"), F.col("known_key.last").alias("l"), F.explode(_left_of_known(F.col("number"))).alias("part"))
    near = asked.join(there, ["f", "l", "part"]).where(one_edit(F.col("candidate"), F.col("number"))).select("doc_id", F.lit(1).alias("phase"), "pos", F.col("number").alias("match"))
    ranked = direct.unionByName(near).groupBy("doc_id").agg(F.min(F.struct("phase", "pos", "match")).alias("best"))
    method = F.when(F.col("best.phase") == 0, "known_direct").when(F.col("best.phase") == 1, "known_fuzzy_name").otherwise("no_match")
    return docs.select("doc_id").join(ranked, "doc_id", "left").select("doc_id", F.col("best.match").alias("number"), method.alias("method"))


def name_fallback(docs: DataFrame, rows: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, number, directory_name: the first number loaded under the name's key."""
    out = by_name(docs, rows).select("doc_id", F.try_element_at("numbers", F.lit(1)).alias("number"))
    return by_number(out, known).select("doc_id", "number", "directory_name")


def canonical_name(docs: DataFrame, known: DataFrame) -> DataFrame:
    """docs (doc_id, number, name, candidates array) with the directory's spelling where it fits.

    The name is replaced if it is empty or has the directory name's key or normal form; the directory
    name then leads the candidates, which are listed once each, eight at most.
    """
    d = by_number(docs, known).withColumn("display", names.display(F.col("directory_name")))
    a, b = names.normalise(F.col("name")), names.normalise(F.col("display"))
    fits = F.col("directory_name").isNotNull() & (F.col("display") != "") & ((a == "") | (a == b) | F.coalesce(names.key_of_normal(a) == names.key_of_normal(b), F.lit(False)))
    listed = F.slice(F.array_distinct(F.concat(F.array("display"), F.col("candidates"))), 1, 8)
    return d.select("doc_id", "number", F.when(fits, F.col("display")).otherwise(F.col("name")).alias("name"), F.when(fits, listed).otherwise(F.col("candidates")).alias("candidates"), F.coalesce(fits, F.lit(False)).alias("replaced"))


def snapped(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, candidates: known ones as they are, others replaced by their fuzzy matches, unmatched ones last; once each."""
    each = docs.select("doc_id", F.posexplode("candidates").alias("pos", "candidate"))
    # Known ones stay as they are: edits are looked up of the others only.
    each = each.join(known.select(F.col("number").alias("candidate"), F.lit(True).alias("is_known")), "candidate", "left")
    near = fuzzy(each.where("is_known is null"), known).groupBy("candidate").agg(F.array_sort(F.collect_list("match")).alias("matches"))
    to = F.coalesce("matches", F.array("candidate"))
    joined = each.join(near, "candidate", "left").select("doc_id", (F.col("is_known").isNull() & F.col("matches").isNull()).alias("last"), "pos", to.alias("to"))
    out = joined.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("last", "pos", "to"))), lambda x: x["to"]))).alias("candidates"))
    return docs.select("doc_id").join(out, "doc_id", "left").select("doc_id", F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"))


def first_known_names(docs: DataFrame, rows: DataFrame, k: int = 6) -> DataFrame:
    """doc_id, names: those of the directory first, in order, k at most."""
    index = names_index(rows).select("first", "last").withColumn("is_known", F.lit(True))
    each = docs.select("doc_id", F.posexplode("names").alias("pos", "name")).withColumn("_k", names.key(F.col("name")))
    joined = each.join(index, (F.col("_k.first") == F.col("first")) & (F.col("_k.last") == F.col("last")), "left")
    order = F.struct(F.col("is_known").isNull().alias("u"), "pos", "name")
    return joined.groupBy("doc_id").agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["name"])), 1, k).alias("names"))
