r"""Information-theoretic sanitisation of personal data, in DataFrame expressions only.

Base spans are found by the patterns of ``PATTERNS``, per kind leftmost and non-overlapping. They
are written so that Java's matcher neither recurses nor looks at a character twice: possessive
loops, and look-behinds that only let a match start where a run starts or the last match ended.
Offsets (code points) come from the lengths of the matches and of the pieces between them.

The values found are the protected entities. Over the whole corpus, for each entity e and each term
t (a word of ``LETTERS`` letters or more) within ``REACH`` characters of an occurrence of e, the
context that the method counts in,

    disclosure(t, e) = PMI(t; e) / IC(e) = 1 - log(n(t) / n(t, e)) / log(N / n(e))

estimates how strongly t reveals e: n(t, e) counts the occurrences of t in contexts of e, n(e) the
contexts of e, n(t) all occurrences of t and N all text positions, copies included in each. Of terms
that at least ``SUPPORT`` contexts hold (one context tells nothing about the rate at which two words
occur together: every word of it that is rare would count) those of a disclosure of ``REMOVE`` or
more are removed, and from ``GENERALISE`` on they are generalised, within reach of that entity: to
the kind of word that they are by their letters, a name, an acronym or a word. Base spans always stay.

Shuffled are entity contexts, and counts of candidate terms; texts are read in place. Hot entities
are pre-aggregated (distinct contexts and how often they occur) before they meet, and the places of a
hot entity's terms are found where its contexts lie.

Defined results: null text is empty; texts of any length are searched whole; repeated rows get the same
spans; a null doc_id is a value of its own; of spans that overlap, a term's gives way to base ones, and
of base ones the first, then the longer, is replaced (counts and spans list all); an empty table gives
an empty one; further columns are carried by ``sanitise`` and ignored by ``find``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import carrying
from .tables import join_by, written

KINDS = ("email", "ip", "card", "phone", "term")
#: Each finds what the contract's pattern finds; \G stands for the end of the last match.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Runs of digits with single separators; shorter ones than 16 digits can't pass.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't match.
NEEDS = {"email": "@", "ip": ".", "card": "0|1|2|3|4|5|6|7|8|9", "phone": "+"}
#: Single letters, and numbers, are no terms.
LETTERS = 2
TERM = rf"(?<![\p{{L}}\p{{N}}])\p{{L}}{{{LETTERS},}}+(?![\p{{L}}\p{{N}}])"
REACH = 80
SUPPORT = 2
REMOVE, GENERALISE = 0.9, 0.75
#: More candidate terms, or changed documents, than this are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 100_000
SPAN = "struct<start:int,end:int,value:string>"


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all matches, in code points, end exclusive."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), values.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["value"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")).cast(SPAN))
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], one).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.aggregate(both, start, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def term(d: Column, i: Column) -> Column:
        twice = d.cast("int") * (1 + i % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    each = F.transform(F.split(F.reverse(digits), ""), term)
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _test(kind: str) -> Callable[[Column], Column]:
    return lambda s: _passes(kind, s["value"])


def _label(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))


def _mark(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("value"))


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.char_length(_digits(value)).between(16, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.char_length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind; an empty array for a null text."""
    out = {}
    for kind, pattern in PATTERNS.items():
        may = text.rlike("[0-9]{4}|[0-9][ -][0-9]") if kind == "card" else text.contains(NEEDS[kind])
        if kind == "ip":
            may = text.rlike(r"[0-9]\.[0-9]")
        found = F.filter(spans_of(text, pattern), _test(kind))
        out[kind] = F.when(may, found).otherwise(F.array().cast(f"array<{SPAN}>"))
    return out


def _with_base(docs: DataFrame) -> DataFrame:
    """Columns _key (row identity: equal rows share it) and _email.._phone."""
    docs = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("_key", F.struct(F.col("doc_id").alias("id"), F.xxhash64("_text").alias("h")))
    return docs.withColumns({f"_{k}": v for k, v in base_spans(F.col("_text")).items()})


def _contexts(found: DataFrame) -> DataFrame:
    """_key, entity, at (start of the context), context: one row for each occurrence of an entity."""

    def of(kind: str) -> Column:
        normal = F.lower if kind in ("email", "ip") else _digits

        def one(s: Column) -> Column:
            at = F.greatest(s["start"] - REACH, F.lit(0))
            return F.struct(F.concat(F.lit(f"{kind}:"), normal(s["value"])).alias("entity"), at.alias("at"), s["start"].alias("start"), s["end"].alias("end"), F.substring(F.col("_text"), at + 1, s["end"] + REACH - at).alias("context"))

        return F.transform(f"_{kind}", one)

    out = found.withColumn("_found", F.concat(*(of(k) for k in PATTERNS))).select("_key", F.explode("_found").alias("x"), F.char_length("_text").alias("size")).select("_key", "x.*", "size")
    # A word cut at the edge of the context is not a term: blank its characters.
    whole = F.when(F.col("at") > 0, F.expr(r"concat(repeat(' ', char_length(regexp_extract(context, '^[\\p{L}\\p{N}]*', 0))), regexp_replace(context, '^[\\p{L}\\p{N}]*', ''))")).otherwise(F.col("context"))
    out = out.withColumn("context", whole)
    whole = F.when(F.col("at") + F.char_length("context") < F.col("size"), F.expr(r"regexp_replace(context, '[\\p{L}\\p{N}]*$', '')")).otherwise(F.col("context"))
    return out.withColumn("context", whole).drop("size")


def disclosing_terms(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """entity, term, disclosure of the terms that exceed the lower threshold."""
    # Copies of a context are one row with their number: all counts are of occurrences.
    distinct = contexts.groupBy("entity", "context").agg(F.count("*").alias("m"))
    terms = distinct.select("entity", "m", F.transform(F.regexp_extract_all("context", F.lit(TERM), F.lit(0)), F.lower).alias("terms"))
    each = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.array_position("terms", t) == i + 1).alias("first")))
    pairs = terms.select("entity", "m", F.explode(each).alias("t")).groupBy("entity", F.col("t.term").alias("term"))
    pairs = pairs.agg(F.sum("m").alias("n_te"), F.sum(F.when(F.col("t.first"), F.col("m"))).alias("held")).where(F.col("held") >= SUPPORT).drop("held")
    pairs = written(pairs)
    entities = distinct.groupBy("entity").agg(F.sum("m").alias("n_e"))
    wanted = pairs.select("term").distinct()
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # Cut first, then lower-cased, as the terms are: a letter may become two characters, one of which would cut.
    words = docs.select(F.explode(F.transform(F.split("text", r"[^\p{L}\p{N}]+"), F.lower)).alias("term"))
    if few:
        words = words.join(F.broadcast(wanted), "term", "left_semi")
    counts = words.groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("n")).first()["n"]
    ratio = 1 - F.log(F.greatest("n_t", "n_te") / F.col("n_te")) / F.log(F.greatest(F.lit(float(total)) / F.col("n_e"), F.lit(2.0)))
    out = pairs.join(entities, "entity").join(counts, "term").withColumn("disclosure", ratio)
    return out.where(F.col("disclosure") >= GENERALISE).select("entity", "term", "disclosure", "n_te")


def generalised(term: Column) -> Column:
    """The kind of word that stands for a term."""
    return F.when(term.rlike(r"^\p{Lu}{2,}$"), "[ACRONYM]").when(term.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")


def _term_spans(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """_key, _term: the spans of disclosing terms of each document that has any, sorted; value: how it is replaced."""
    pair = F.concat_ws("\0", "entity", "term").alias("pair")
    revealing = written(disclosing_terms(docs, contexts).select(pair, F.col("disclosure").alias("d"), F.col("n_te").alias("n")))
    spots = contexts.select("_key", "entity", "at", F.explode(spans_of(F.col("context"), TERM)).alias("s"), F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    spots = spots.select("_key", "entity", F.lower("s.value").alias("term"), "s.value", (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end"), "e_start", "e_end")
    # The entity's own letters are covered by its base span.
    spots = spots.where((F.col("end") <= F.col("e_start")) | (F.col("start") >= F.col("e_end"))).select("_key", pair, "value", "start", "end")
    hit = join_by(spots, revealing, "pair").groupBy("_key", "start", "end").agg(F.max("d").alias("d"), F.first("value").alias("value"))
    one = F.struct("start", "end", F.when(F.col("d") >= REMOVE, F.lit("")).otherwise(generalised(F.col("value"))).alias("value")).cast(SPAN)
    return written(hit.groupBy("_key").agg(F.sort_array(F.collect_list(one)).alias("_term")))


def _joined(found: DataFrame, term_spans: DataFrame) -> DataFrame:
    if term_spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        term_spans = F.broadcast(term_spans)
    terms = term_spans.select(F.col("_key.id").alias("_id"), F.col("_key.h").alias("_h"), "_term")
    out = found.join(terms, F.col("_key.id").eqNullSafe(F.col("_id")) & (F.col("_key.h") == F.col("_h")), "left")
    # A term span that a base span touches adds nothing.
    base = F.concat(*(F.col(f"_{k}") for k in PATTERNS))
    free = F.filter("_term", lambda t: ~F.exists(base, lambda b: (t["start"] < b["end"]) & (t["end"] > b["start"])))
    return out.withColumn("_term", F.coalesce(free, F.array().cast(f"array<{SPAN}>"))).drop("_id", "_h")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every document."""
    docs = docs.select("doc_id", "text")
    found = _with_base(docs)
    occurrences = F.size(F.concat(*(F.col(f"_{k}") for k in PATTERNS)))
    contexts = written(_contexts(found.where(occurrences > 0)))
    found = _joined(found.select("doc_id", "_key", *(f"_{k}" for k in PATTERNS)), _term_spans(docs, contexts))

    def text(kinds: tuple[str, ...]) -> Column:
        return F.array_join(F.concat(*(F.transform(f"_{k}", _label(k)) for k in kinds)), ",")

    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in PATTERNS]
    return found.select("doc_id", *counts, F.sha2(text(tuple(PATTERNS)), 256).alias("base_sha256"), text(KINDS).alias("spans"), F.size("_term").cast("long").alias("n_term"))


@carrying
def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced by its kind, and disclosing terms generalised or removed; n_chars is made to fit."""
    found = _with_base(docs)
    occurrences = F.size(F.concat(*(F.col(f"_{k}") for k in PATTERNS)))
    contexts = written(_contexts(found.where(occurrences > 0)))
    found = _joined(found, _term_spans(docs.select("doc_id", "text"), contexts))
    marked = [F.transform(f"_{k}", _mark(k)) for k in PATTERNS]
    spans = F.sort_array(F.concat(*marked, F.col("_term")))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("_text"), acc["at"] + 1, s["start"] - acc["at"])
        added = F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, s["value"])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), added.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col("_text"), acc["at"] + 1, F.char_length("_text")))
    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest)
    out = found.withColumn("_clean", F.when(F.size(spans) > 0, clean).otherwise(F.col("text")))
    new = {"text": F.col("_clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.size(spans) > 0, F.char_length("_clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))
