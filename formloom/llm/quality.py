r"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Each rule says when a text fails. A sample of about ``SAMPLE`` rows from all of the table tells its cost
(seconds a row, the least of ``REPEATS`` runs less what a run without a rule takes) and which rows it
rejects; rules are then put in order one by one, each time the one with most rejections per cost among
the rows that those before it leave. They run as one CASE expression, which Spark leaves at the first
rule that fails. The order changes how long it takes and which rule a text with several faults is
charged to, never whether it is kept. The contract's columns are wanted of every row, so they aren't
part of the cascade; rules take them as they are and add what they need besides.

Everything is one narrow projection of whole texts: no shuffle. Repeated five-word windows of a text
are found by a distinct over their 64-bit hashes; only where there are any are the hashes sorted.

Defined results: null, empty and blank texts have no words and fail the base rules (fewer than ten
words); texts of any length are judged whole; repeated rows are judged one by one; rules of equal
rejection per cost stay in the order written here, as do all of them with an empty sample; an empty
table gives an empty one; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SAMPLE = 1_000
REPEATS = 3


def count_of(text: Column, characters: str) -> Column:
    """How many of these ASCII characters a text has: byte scans, cheaper than translate."""
    out = None
    for c in characters:
        n = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
        out = n if out is None else out + n
    return out


def words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text that isn't null."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT, -1))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda x: then(x)), 1)


def repeated_words(windows: Column) -> Column:
    """Words covered by windows that occur twice or more; windows: the hash of the window at each word."""

    def places(order: Column) -> Column:
        # same[i]: equal to the next one. A window repeats if it equals the next or the one before.
        same = F.zip_with(order, F.slice(order, 2, F.size(order)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        both = _let(same, lambda x: F.zip_with(x, F.concat(F.array(F.lit(False)), x), lambda a, b: F.coalesce(a, F.lit(False)) | b))
        kept = F.zip_with(order, F.slice(both, 1, F.size(order)), lambda x, keep: F.when(keep, x["i"]))
        return F.sort_array(F.filter(kept, lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda t, x: t + x)

    order = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _let(_let(order, places), covered)


def _windows(hashes: str, n: str) -> Column:
    at = F.sequence(F.lit(1), F.col(n) - (WINDOW - 1))
    each = F.transform(at, lambda i: F.xxhash64(*(F.element_at(hashes, i + k) for k in range(WINDOW))))
    return F.when(F.col(n) >= WINDOW, each).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, _text and the contract's base columns of every row."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).withColumn("_words", words(F.col("_text")))
    out = out.select("doc_id", "_text", F.size("_words").alias("_n"), F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    out = out.select("doc_id", "_text", "_n", _windows("_hashes", "_n").alias("_windows"))
    repeats = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), repeated_words(F.col("_windows"))).otherwise(F.lit(0).cast("long"))
    lines = lines_with_words(F.col("_text"))
    return out.select(
        "doc_id",
        "_text",
        F.col("_n").cast("long").alias("n_words"),
        (F.char_length("_text") - count_of(F.col("_text"), SPACES)).cast("long").alias("word_chars"),
        count_of(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def rules() -> dict[str, Column]:
    """Name and condition of failing, over the columns of ``measured``."""
    text, n = F.col("_text"), F.col("n_words")
    return {
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 20 * n),
        "symbols": F.col("n_symbols") * 10 > 3 * n,
        "duplicate_lines": F.col("n_dup_lines") * 10 > 3 * F.size(lines_with_words(text)),
        "upper_case": F.regexp_count(text, F.lit(r"\p{Lu}")) * 10 > 6 * F.col("word_chars"),
        "letters": F.regexp_count(text, F.lit(r"[^\p{L}\x20\x09-\x0D]")) * 10 > 5 * F.col("word_chars"),
        "ellipsis": F.size(F.regexp_extract_all(text, F.lit(r"(?m)(?:\.\.\.|…)[ \t]*$"), F.lit(0))) * 10 > 3 * F.size(lines_with_words(text)),
    }


@dataclass(frozen=True)
class Estimate:
    """What a sample tells: seconds a row of each rule, and how many rows fail each set of rules."""

    cost: dict[str, float]
    failing: dict[frozenset[str], int]


def estimate(sample: DataFrame, conditions: Mapping[str, Column]) -> Estimate:
    """Every rule runs by itself over the sample, several times, and all of them together once."""
    sample = sample.persist()
    try:
        n = sample.count()

        def seconds(fails: Column) -> float:
            took = []
            for _ in range(REPEATS if n else 0):
                began = time.perf_counter()
                sample.agg(F.count_if(fails)).first()
                took.append(time.perf_counter() - began)
            return min(took, default=0.0) / max(1, n)

        idle = seconds(F.col("n_words") < 0)
        cost = {name: max(0.0, seconds(fails) - idle) for name, fails in conditions.items()}
        # At most a row for each set of rules.
        sets = sample.groupBy(*(fails.alias(name) for name, fails in conditions.items())).count().collect()
        return Estimate(cost, {frozenset(k for k in conditions if r[k]): r["count"] for r in sets})
    finally:
        sample.unpersist()


def ordered(found: Estimate) -> list[str]:
    """Rules by rejection per cost among the rows that the rules before leave, best first; ties stay in the order given."""
    out, left = [], list(found.cost)
    least = max(1e-12, min((c for c in found.cost.values() if c > 0), default=1e-12))
    while left:
        alive = {s: n for s, n in found.failing.items() if not s & set(out)}
        best = max(left, key=lambda k: sum(n for s, n in alive.items() if k in s) / max(found.cost[k], least))
        out.append(best)
        left.remove(best)
    return out


def cascade(conditions: Mapping[str, Column], order: list[str]) -> Column:
    """Name of the first rule that fails, or null. Later rules aren't evaluated then."""
    out = None
    for name in order:
        out = F.when(conditions[name], F.lit(name)) if out is None else out.when(conditions[name], F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def judge(docs: DataFrame, conditions: Mapping[str, Column] | None = None) -> DataFrame:
    """doc_id, the base columns, base_failed, kept and rejected_by (the rule, ``base``, or null) of every row."""
    conditions = rules() if conditions is None else conditions
    base = measured(docs)
    part = min(1.0, SAMPLE / max(1, docs.count()))
    some = docs.select("doc_id", "text")
    order = ordered(estimate(measured(some.sample(part, seed=5) if part < 1 else some), conditions))
    verdict = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(conditions, order))
    out = base.withColumn("rejected_by", verdict)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i+4], ' ')) AS c FROM g),
p AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM h WHERE c > 1),
r AS (SELECT doc_id, sum(n)::BIGINT AS n FROM p GROUP BY doc_id),
b AS (SELECT w.doc_id, t, ls, len(ws)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(t, '[\p{L}\x20\x09-\x0D]+', '', 'g')) AS others,
             length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS upper_letters,
             len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[ \t]*$'))) AS dots
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR n_symbols * 10 > 3 * n_words
            OR n_dup_lines * 10 > 3 * len(ls) OR upper_letters * 10 > 6 * word_chars OR others * 10 > 5 * word_chars
            OR dots * 10 > 3 * len(ls)) AS kept
FROM f
"""
