"""Page text to fields: captures, blocks, values after labels, whole form parsers, document classes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text

# What a label line of the digital form starts with.
LABELS = [
    "today's date",
    "idoc or le#",
    "name",
    "gender",
    "physical address",
    "city",
    "state",
    "zipcode",
    "e-mail",
    "date of birth",
    "age:",
    "phone number",
    "emergency contact:",
    "name & phone",
    "please select a",
    "preferred city of",
    "have you previously",
    "are you an",
    "alcohol and/or drugs",
    "date of last use",
    "do you have to register",
    "housing needed by",
    "phone:",
    "are you currently",
    "employer:",
    "list any medications",
    "have you been",
    "where you under",
    "list all charges",
    "explain in detail",
    "name of case",
    "will you be on",
    "probation/parole",
    "your signature",
    "date",
    "you can edit this",
]
# yes/no questions of the scanned form, by field: page and compact text of the question.
QUESTIONS = {
    "requirements.sex_offender_registration": (1, "doyouneedtoregisterasasexoffender"),
    "requirements.backup_plan": (1, "isthisabackupplanforaninterstatecompactoranicedetainer"),
    "requirements.children_visitation_required": (1, "isatransitionalhomewithvisitationorovernightstaysforchildrenrequired"),
    "history.disciplined_or_discharged": (1, "haveyoueverbeendisciplinedandinvoluntarilydischargedfromatransitionalhome"),
    "history.violent_crimes_or_dor": (1, "haveyouhadanyviolentcrimesordisciplinaryoffensereportsdorforviolence"),
    "release.on_probation_or_parole": (1, "willyoubeonprobationorparolewhenyouarerelease"),
    "release.parole_hearing_completed": (1, "haveyouhadyourparolehearing"),
    "transportation.vehicle_on_site": (1, "willyouhaveavehicleonsite"),
    "background.served_in_military": (1, "haveyoueverservedinthemilitary"),
    "background.enrolled_at_va": (1, "enrolledattheva"),
    "employment.has_employment_upon_release": (1, "doyouhaveemploymentuponrelease"),
    "support.medical_or_mental_health_support": (2, "doyouneedmedicalormentalhealthsupport"),
    "support.communicable_disease": (2, "doyouhaveanycontagiousorcommunicablediseases"),
    "benefits.plan_to_apply": (2, "doyouplantoapplyforssissdissrbmedicareormedicaid"),
    "addictions.has_addictions": (2, "doyouhaveaddictions"),
    "addictions.under_influence_during_crime": (2, "wereyouundertheinfluenceofdrugsalcoholwhencrimewascommitted"),
    "preferences.faith_based_provider": (2, "wouldyoupreferafaithbasedhousingprovider"),
    "housing.previously_in_transitional_home": (2, "haveyoupreviouslyresidedinatransitionalhome"),
}
# Patterns of the compact text after a question, in order, and the answer of each.
TAIL_ANSWERS = [("y[/x]+n", "yes"), ("yn[/x]+", "no"), ("yn[xk]+", "no"), ("yno(?:if|$)", "no"), ("yyesn", "yes"), ("y$", "yes")]
WINDOW_ANSWERS = [("y[x/.,]+n", "yes"), ("yn[x/.,k]+", "no"), (r"y(?:x|[.,])$", "yes"), ("yn(?:x|[.,k/])+$", "no")]


def capture(c: Column, pattern: str) -> Column:
    """First group of the first match, cleaned; '' without one."""
    return text.clean_capture(F.regexp_extract(c, f"(?im){pattern}", 1))


def capture_between(c: Column, start: str, stop: str) -> Column:
    return text.clean_capture(F.regexp_extract(c, rf"(?is){start}\s*(.*?)\s*{stop}", 1))


def first_index(lines: Column, test) -> Column:
    """Position from 1 of the first line that passes, 0 without one."""
    return F.array_position(F.transform(lines, test), True).cast("int")


def labelled_block(lines: Column, start: str, stop: str) -> Column:
    """From the rest of the first line that starts with ``start`` to the line before one that starts with ``stop``."""
    i = first_index(lines, lambda x: x.rlike(rf"(?i)\A(?:{start})"))
    rest = text.clean_capture(F.regexp_replace(F.try_element_at(lines, F.greatest(i, F.lit(1))), rf"(?i)\A(?:{start})", ""))
    after = F.slice(lines, i + 1, F.size(lines))
    j = first_index(after, lambda x: x.rlike(rf"(?i)\A(?:{stop})"))
    block = F.when(j > 0, F.slice(after, 1, F.greatest(j - 1, F.lit(0)))).otherwise(after)
    return F.when(i > 0, text.clean_capture(F.array_join(F.concat(F.filter(F.array(rest), lambda x: x != ""), block), " "))).otherwise("")


def block_between(lines: Column, start: str, stop: str) -> Column:
    """Lines strictly between two prefixes; none if either is missing."""
    i = first_index(lines, lambda x: F.startswith(x, F.lit(start)))
    after = F.slice(lines, i + 1, F.size(lines))
    j = first_index(after, lambda x: F.startswith(x, F.lit(stop)))
    return F.when((i > 0) & (j > 0), F.slice(after, 1, F.greatest(j - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))


def is_label(line: Column) -> Column:
    return F.lower(line).rlike(rf"\A(?:{_STARTS})")


def prepared(docs: DataFrame) -> DataFrame:
    """docs (.., text) with _text, its lines stripped and without blank ones, _low, folded, and _ascii; worked out once for all fields."""
    return docs.withColumn("_text", text.line_text(F.col("text"))).withColumns({"_low": text.fold(F.col("_text")), "_ascii": text.is_ascii(F.col("_text"))})


_STARTS = "|".join(re.escape(x) for x in LABELS)


def extract_after(c: Column, low: Column, ascii_: Column, label: str, rest: str, flags: str = "i") -> Column:
    """First group of the first match of ``label`` and ``rest`` in c, '' without one.

    low: c folded. label: a pattern of small letters; its first place is looked up in low, where capitals don't count, and the
    match is looked for from there. Java and Spark count places alike in ASCII only; other texts are searched from their start.
    """
    at = F.when(ascii_, F.regexp_instr(low, F.lit(label))).otherwise(1)
    return text.let(at, lambda i: F.when(i > 0, F.regexp_extract(F.substr(c, i), f"(?{flags}){label}{rest}", 1)).when(c.isNotNull(), ""))


def value_after(anchor: str, most: int = 3) -> Column:
    """What stands after the first anchor: the rest of its line, else the next lines, ``most`` at most, up to a label.

    One match over the columns of ``prepared``: no line is looked at twice.
    """
    rest = rf"[^\S\n]*(\S.*|(?:\n(?!{_STARTS}).*){{0,{most}}})"
    return text.clean(extract_after(F.col("_text"), F.col("_low"), F.col("_ascii"), re.escape(anchor.lower()), rest))


def multiline_after(anchor: str, stop: str | None = None) -> Column:
    """The rest of the anchor's line and all lines after it up to one that holds ``stop``; over the columns of ``prepared``."""
    after = extract_after(F.col("_text"), F.col("_low"), F.col("_ascii"), re.escape(anchor.lower()), "(.*)", "is")
    if stop:
        after = F.regexp_replace(after, rf"(?is)\n[^\n]*{re.escape(stop)}.*", "")
    return text.clean(after)


def either(*values: Column) -> Column:
    """First value that is neither null nor '', '' without one; each is worked out once, and only if those before it are missing."""
    out = F.coalesce(values[-1], F.lit(""))
    for v in reversed(values[:-1]):
        out = text.let(v, lambda x, rest=out: F.when(x != "", x).otherwise(rest))
    return out


def _first(found: Column) -> Column:
    """First value that is neither null nor '', '' without one."""
    return F.coalesce(F.try_element_at(F.filter(found, lambda x: x != ""), F.lit(1)), F.lit(""))


def line_after(lines: Column, anchor: str, ignore: Sequence[str] = (), most: int = 4) -> Column:
    """First of the next lines after an anchor's (a pattern) that has none of the ignored words; the first anchor with one decides."""

    def good(x: Column) -> Column:
        return ~reduce(lambda a, b: a | b, (F.contains(F.lower(x), F.lit(w)) for w in ignore), F.lit(False))

    return _first(F.transform(lines, lambda x, i: F.when(x.rlike(anchor), _first(F.filter(F.slice(lines, i + 2, most), good)))))


def bool_by_regex(c: Column, pattern: str) -> Column:
    return text.let(F.regexp_extract(c, f"(?s){pattern}", 1), text.yes_no)


def bool_by_context(lines: Column, anchor: str) -> Column:
    """yes or no, if only one of them stands in an anchor's line and the three after it; the first such anchor decides. Over folded lines."""

    def read(window: Column) -> Column:
        yes, no = window.rlike(r"\byes\b"), window.rlike(r"\bno\b")
        return F.when(yes & ~no, "yes").when(no & ~yes, "no")

    return _first(F.transform(lines, lambda x, i: F.when(x.rlike(anchor), text.let(F.lower(F.array_join(F.slice(lines, i + 1, 4), " ")), read))))


def _answers(c: Column, patterns: Sequence[tuple[str, str]]) -> Column:
    out = None
    for pattern, answer in patterns:
        out = F.when(c.rlike(pattern), answer) if out is None else out.when(c.rlike(pattern), answer)
    return out


def _joined_lines(small: Column) -> Column:
    """Each line's compact text with the next one's."""
    return F.transform(small, lambda x, i: F.concat(x, F.coalesce(F.try_element_at(small, i + 2), F.lit(""))))


def _answer(compact: Column, lines: Column, joined: Column, anchor: Column) -> Column:
    at = F.position(anchor, compact)
    tail = F.substring(compact, at + F.char_length(anchor), F.lit(40))
    k = F.array_position(F.transform(joined, lambda x: F.contains(x, anchor)), True).cast("int")
    window = text.checkbox_fold(F.array_join(F.slice(lines, F.greatest(k, F.lit(1)), 2), " "))
    by_lines = F.when(k > 0, text.let(window, lambda w: _answers(w, WINDOW_ANSWERS).when(w.rlike("y$") & ~F.contains(w, F.lit("n")), "yes")))
    return F.when(at > 0, text.let(tail, lambda t: _answers(t, TAIL_ANSWERS))).otherwise(by_lines)


def binary_answer(page: Column, anchor: Column) -> Column:
    """yes, no or null: the answer to a question in recognised text."""
    lines = text.lines(page)
    return _answer(text.compact_text(page), lines, _joined_lines(F.transform(lines, text.compact_text)), anchor)


def checkbox_overrides(pages: DataFrame) -> DataFrame:
    """doc_id, field, answer of pages (doc_id, page, text) for all questions that have one."""
    spark = pages.sparkSession
    hints = spark.createDataFrame([(k, p, a) for k, (p, a) in QUESTIONS.items()], "field string, page int, anchor string")
    # What all questions of a page look at is worked out once a page.
    out = pages.withColumns({"_compact": text.compact_text(F.col("text")), "_lines": text.lines(F.col("text"))})
    out = out.withColumn("_small", F.transform("_lines", text.compact_text)).withColumn("_joined", _joined_lines(F.col("_small")))
    met = out.join(F.broadcast(hints), "page")
    # In an array of one: a filter of rows would work the answer out again.
    answers = met.select("doc_id", "field", F.explode(F.array(_answer(F.col("_compact"), F.col("_lines"), F.col("_joined"), F.col("anchor")))).alias("answer"))
    return answers.where("answer is not null")


@dataclass(frozen=True)
class Field:
    """How a field of the digital form is read: anchors in turn, the lines it may take, its rule, what is cut from it."""

    name: str
    anchors: tuple[str, ...]
    most: int = 1
    rule: str = ""
    cut: str = ""
    kind: str = "text"


# Anchors of the digital form's fields, the lines each may take and what is cut from it.
DIGITAL_FORM = [
    Field("applicant.name", ("Name",), 1, "name"),
    Field("applicant.idoc_or_le_number", ("IDOC or LE#",), 1, "id"),
    Field("applicant.gender", ("Gender",), 1, "gender"),
    Field("applicant.date_of_birth", ("Date of Birth",), 1, "date"),
    Field("applicant.age", ("Age:",), 1, "age"),
    Field("contacts.phone", ("Phone Number", "Phone:"), 1, "phone"),
    Field("contacts.email", ("E-mail",), 1, "email"),
    Field("contacts.emergency_contact", ("Name & Phone", "Emergency Contact:"), 3),
    Field("housing.preferred_city", ("preferred city of",), 2, "", r"(?i)housing:?\s*"),
    Field("addictions.drug_of_choice", ("Alcohol and/or drugs",), 2, "", r"(?i)of choice\s*"),
    Field("addictions.date_of_last_use", ("Date of last use",), 1, "date"),
    Field("support.prescribed_medications", ("List any medications",), 2, "", r"(?i)you are prescribed:?\s*"),
    Field("employment.currently_employed", ("Are you currently", "employed?"), 2, "bool", kind="checkbox_group"),
    Field("employment.employer", ("Employer:",)),
    Field("criminal.convicted_misdemeanor_or_felony", ("convicted of a", "misdemeanor or"), 2, "bool", kind="checkbox_group"),
    Field("criminal.under_influence_during_crime", ("influence of", "drugs/alcohol when"), 2, "bool", kind="checkbox_group"),
    Field("contacts.case_manager", ("Name of Case",), 2, "", r"(?i)Manager:?\s*"),
    Field("supervision.on_probation_or_parole_while_housed", ("Will you be on", "probation or parole while"), 2, "bool", kind="checkbox_group"),
    Field("supervision.probation_or_parole_officer", ("Probation/Parole",), 2, "", r"(?i)Officer,?\s*if known:?\s*"),
    Field("supervision.reporting_county", ("Name of Idaho County",), 1, "", r"(?i)you will be reporting to:?\s*"),
    Field("requirements.sex_offender_registration", ("sex offender?", "register as a sex offender"), 2, "bool", kind="checkbox_group"),
    Field("history.previously_resided", ("resided at",), 2, "bool", kind="checkbox_group"),
    Field("history.alcoholic_or_addict", ("alcoholic/addict",), 2, "bool", kind="checkbox_group"),
    Field("signing.signature_name", ("Name)", "Your Signature"), 3, "", r"(?i)^\(Type.*?\)\s*"),
]
# Fixed value: words that a name of the digital form doesn't have.
NOT_NAMES = "gender|physical|address|male|female"


def _rule(name: str, v: Column) -> Column:
    if name == "name":
        v = F.when(F.lower(v).rlike(NOT_NAMES), "").otherwise(v)
        return F.trim(F.regexp_replace(v, r"\s*\(.*?\)\s*$", ""))
    rules = {"id": numbers.numeric_id, "gender": lambda c: F.when(F.lower(c).isin("male", "m"), "Male").when(F.lower(c).isin("female", "f"), "Female").otherwise(""), "date": lambda c: text.valid_date(c, False), "age": text.valid_age, "phone": lambda c: text.valid_phone(c, 7, None), "email": text.valid_email, "bool": text.yes_no}
    return rules[name](v) if name else v


def digital_form(docs: DataFrame, fields: Sequence[Field] = DIGITAL_FORM, confidence: float = 0.95) -> DataFrame:
    """doc_id, field, kind, source, value, confidence of docs (doc_id, text, stem): one row for each field.

    A missing name comes from the file stem, a missing signing date from the form's date.
    """
    return unpivot(prepared(docs), _form(fields), "digital_text", confidence)


def form_values(docs: DataFrame, fields: Sequence[Field] = DIGITAL_FORM) -> DataFrame:
    """doc_id, fields (array of field, kind, value): those of ``digital_form``, a document's together in one row."""
    wide, each = _together(prepared(docs), _form(fields))
    return wide.select("doc_id", each.alias("fields"))


def _form(fields: Sequence[Field]) -> dict[str, tuple[str, Column]]:
    """Kind and value of each field of the digital form, over the columns of ``prepared``."""

    def read(f: Field) -> Column:
        each = []
        for anchor in f.anchors:
            v = text.let(value_after(anchor, f.most), lambda c: _rule(f.rule, c))
            each.append(text.strip(F.regexp_replace(v, f.cut, "")) if f.cut else v)
        return either(*each)

    def date(c: Column) -> Column:
        return text.let(c, lambda v: text.valid_date(v, False))

    values = {f.name: (f.kind, read(f)) for f in fields}
    values["housing.needed_by"] = ("text", date(multiline_after("Housing needed by", "Phone")))
    charges = either(multiline_after("EXPLAIN IN DETAIL ALL", "Name of Case"), multiline_after("List all charges", "Name of Case"))
    charges = F.regexp_replace(charges, r"(?i)\s*EXPLAIN IN DETAIL ALL\s*VIOLENT CHARGES:?\s*", "\n")
    values["criminal.charges"] = ("multiline_text", text.strip(F.regexp_replace(text.strip(charges), r"(?i)^VIOLENT CHARGES:?\s*", "")))
    values["signing.application_date"] = ("text", either(date(value_after("Date", 1)), date(value_after("Today's Date", 1))))
    kind, name = values["applicant.name"]
    values["applicant.name"] = (kind, either(name, text.stem_name(F.col("stem"), "2,4")))
    return values


def unpivot(docs: DataFrame, values: dict[str, tuple[str, Column]], source: str, confidence: float) -> DataFrame:
    """One row for each field, from one projection of all of them."""
    # The array is made in the explode: of a column, Spark would first filter documents by its size and work all values out for that.
    wide, each = _together(docs, values)
    long = wide.select("doc_id", F.explode(each).alias("f")).select("doc_id", "f.*")
    return long.select("doc_id", "field", "kind", F.lit(source).alias("source"), "value", F.when(F.col("value") != "", confidence).otherwise(0.0).alias("confidence"))


def _together(docs: DataFrame, values: dict[str, tuple[str, Column]]) -> tuple[DataFrame, Column]:
    """docs with a column for each value, and the array of field, kind and value over them.

    The values are worked out before they stand in the array: within an explode Spark has no generated code for them.
    """
    wide = docs.select("doc_id", *(v.alias(f"_v{i}") for i, (_, v) in enumerate(values.values())))
    each = [F.struct(F.lit(k).alias("field"), F.lit(kind).alias("kind"), F.col(f"_v{i}").alias("value")) for i, (k, (kind, _)) in enumerate(values.items())]
    return wide, F.array(*each)


#: Cities that the packet offers.
PACKET_CITIES = ("Boise", "Caldwell", "Lewiston", "Twin Falls", "Idaho Falls", "Pocatello")


def _optional(docs: DataFrame, name: str) -> Column:
    """A column, '' where it is null or docs don't have it."""
    return F.coalesce(F.col(name), F.lit("")) if name in docs.columns else F.lit("")


def _squeezed_lines(c: Column) -> Column:
    return text.lines(F.regexp_replace(c, r" [ \t]+|\t[ \t]*", " "))


def packet_form(docs: DataFrame, confidence: float = 0.85, checkbox_confidence: float = 0.9) -> DataFrame:
    """The same for the scanned packet of docs (doc_id, text: its first page; page2, page3 and stem, if there are).

    The name is the file stem's, or where there is none what follows the name's label.
    """
    docs = docs.select("doc_id", *(_optional(docs, c).alias(n) for c, n in (("text", "_1"), ("page2", "_2"), ("page3", "_3"), ("stem", "_stem"))))
    # What looks for digits, or for words whose capitals don't count, reads the folded pages.
    docs = docs.withColumns({f"_low{k}": text.fold(F.col(f"_{k}")) for k in (1, 2)} | {f"_ascii{k}": text.is_ascii(F.col(f"_{k}")) for k in (1, 2)})
    docs = docs.withColumns({f"_lines{k}": _squeezed_lines(F.col(f"_low{k}")) for k in (1, 2)})
    p1, p3, low1, low2, l1, l2 = (F.col(c) for c in ("_1", "_3", "_low1", "_low2", "_lines1", "_lines2"))
    both, both_lines = F.concat(low1, F.lit("\n"), low2), F.concat(l1, l2)

    def edged(c: Column) -> Column:
        return F.btrim(text.squeeze(c), F.lit(" _:-"))

    def got(c: Column, pattern: str, flags: str = "") -> Column:
        return edged(F.regexp_extract(c, f"(?{flags}){pattern}" if flags else pattern, 1))

    def as_is(page: int, label: str, rest: str, flags: str = "i") -> Column:
        return edged(extract_after(*(F.col(f"{c}{page}") for c in ("_", "_low", "_ascii")), label, rest, flags))

    def tidy(c: Column) -> Column:
        return F.btrim(text.squeeze(c), F.lit(" _:-.,"))

    def passing(c: Column, pattern: str) -> Column:
        return text.let(tidy(c), lambda v: text.only_if(v, v.rlike(rf"\A{pattern}\z")))

    def date(c: Column) -> Column:
        return passing(c, "[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}")

    def unless(c: Column, pattern: str) -> Column:
        return text.let(c, lambda v: text.only_if(v, ~v.rlike(f"(?i){pattern}")))

    def gender(c: Column) -> Column:
        return text.let(F.lower(text.strip(c)), lambda v: F.when(v.isin("male", "m"), "Male").when(v.isin("female", "f"), "Female").otherwise(""))

    def phone(c: Column) -> Column:
        return text.let(tidy(c), lambda v: text.only_if(v, F.char_length(text.digits(v)) >= 10))

    def yes_no(c: Column, pattern: str, of_lines: Column, anchor: str) -> Column:
        return either(bool_by_regex(c, pattern), bool_by_context(of_lines, anchor))

    until = r"\s*(?:Name of Case Manager|Will you be on probation|I have completed)"
    city = either(got(low1, r"preferred city of\s*(.*?)\s*have you previously", "s"), line_after(l1, "preferred city of", ("housing", "please selecta")))
    # Lines as they are written are made only for documents without a stem.
    first_line = line_after(_squeezed_lines(p1), r"(?i)^name\b", ("gender", "date of birth"))
    # The patterns of the packet's labels, here and below.
    texts = {
        "applicant.name": either(text.stem_name(F.col("_stem")), first_line),
        "applicant.idoc_or_le_number": text.let(got(low1, r"idoc\s*or\s*le\s*#\s*([a-z0-9-]+)"), numbers.packet_id),
        "applicant.gender": gender(line_after(l1, r"^gender:?$", ("name", "please print clearly", "address", "physical address"))),
        "applicant.date_of_birth": date(got(low1, r"date of birth\s*([0-9/.-]+)")),
        "applicant.age": got(low1, r"age:?\s*([0-9]{1,3})"),
        "contacts.phone": phone(got(low1, r"phone(?: number)?:?\s*([0-9() -]{7,})")),
        "contacts.email": passing(as_is(1, "e-?mail", r"\s*([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)"), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
        "contacts.emergency_contact": as_is(1, "emergency contact", r":?\s*([A-Za-z0-9 .()/-]{6,})\s*Name(?:\s*&\s*Phone| and Phone)?"),
        "housing.preferred_city": text.let(tidy(city), lambda v: text.valid_city(v, PACKET_CITIES)),
        "addictions.drug_of_choice": unless(tidy(either(as_is(1, r"drug\(s\) of choice", r":?\s*([^\n]+)"), as_is(2, "alcohol and/or drugs", r"\s*([^\n]+)"))), r"\?"),
        "addictions.date_of_last_use": date(either(got(low1, r"date[- ]of[- ]last[- ]use:?\s*([0-9/.-]+)"), got(low2, r"date of last use\s*([0-9/.-]+)"))),
        "housing.needed_by": date(either(got(low1, r"date housing needed:?\s*([^\n]+)"), got(low2, r"housing needed by\s*([^\n]+)"))),
        "support.prescribed_medications": either(as_is(1, "list any medications you are prescribed", r":?\s*([^\n]+)"), as_is(2, "list any medications", r"\s*([^\n]+)\s*you are prescribed")),
        "contacts.case_manager": unless(either(as_is(2, "name of case", r"\s*Manager:?\s*([^\n]+)"), as_is(2, "name of casemanager", r",? if applicable:?\s*([^\n]+)")), "if applicable|name of case"),
        "supervision.reporting_county": as_is(2, "name of idaho county you will be reporting to", r":?\s*([^\n]+)"),
        "supervision.probation_or_parole_officer": unless(as_is(2, "probation/parole officer", r"(?: Name)?(?:, if known)?:?\s*([^\n]+)"), "name,? ?if known"),
        "signing.signature_name": either(as_is(2, r"your signature \(type name\)", r"\s*([^\n]+)"), as_is(2, "print name", r":?\s*([^\n]+)")),
        "signing.application_date": either(date(got(low1, r"today's date:?\s*([0-9/.-]+)")), date(either(got(low2, r"date\s*([0-9/.-]+)"), got(p3, r"Date\s*([0-9/.-]+)", "i")))),
    }
    blocks = {
        "criminal.charges": as_is(2, "list all charges", rf":?\s*(.*?){until}", "is"),
        "criminal.violent_charge_explanation": as_is(2, "violent charges", rf":?\s*(.*?){until}", "is"),
    }
    boxes = {
        "history.previously_resided": yes_no(low1, r"have you previously\s*(yes|no)\s*resided at", l1, r"previously\s+resided\s+at"),
        "history.alcoholic_or_addict": yes_no(low1, r"are you an\s*(yes|no)\s*alcoholic/addict", l1, "alcoholic/addict"),
        "requirements.sex_offender_registration": yes_no(low2, r"register\s*(yes|no)\s*as a sex offender", l2, r"register\s+as\s+a\s+sex\s+offender"),
        "employment.currently_employed": yes_no(low2, r"currently\s*(yes|no)\s*employed", l2, r"currently\s+employed"),
        "criminal.convicted_misdemeanor_or_felony": yes_no(both, r"convicted of a\s*(yes|no)\s*misdemeanor or\s*felony", both_lines, r"convicted\s+of\s+a\s+misdemeanor\s+or\s+felony"),
        "criminal.under_influence_during_crime": yes_no(low2, r"influence of\s*(yes|no)\s*drugs/alcohol", l2, r"under\s+the\s+influence.*crime\s+was\s+committed|where\s+you\s+under\s+the\s+influence"),
        "supervision.on_probation_or_parole_while_housed": yes_no(low2, r"will you be on\s*(yes|no)\s*probation or parole", l2, r"probation\s+or\s+parole\s+while\s+in\s+housing"),
    }
    values = {k: (kind, v) for kind, group in (("text", texts), ("multiline_text", blocks), ("checkbox_group", boxes)) for k, v in group.items()}
    long = unpivot(docs, values, "raw_text", confidence)
    return long.withColumn("confidence", F.when((F.col("kind") == "checkbox_group") & (F.col("value") != ""), checkbox_confidence).otherwise(F.col("confidence")))


@dataclass(frozen=True)
class Fingerprint:
    """A document class: all of ``needs`` and one of ``any_of`` in a page's compact text."""

    name: str
    needs: tuple[str, ...]
    any_of: tuple[str, ...] = ()
    later_pages: bool = True


#: In order; an organisation's own title can be added as a further fingerprint.
FINGERPRINTS = [
    Fingerprint("housing_application_v1", ("idochousingapplication",), ("cmpocontactemail", "currentstatuspleasecheckone")),
    Fingerprint("digital_application", ("jotform", "applicationforhousing"), later_pages=False),
    Fingerprint("application_packet", ("applicationforhousing",)),
]


def page_class(page: Column, fingerprints: Sequence[Fingerprint] = FINGERPRINTS) -> Column:
    compact, out = text.compact(page), None
    for f in fingerprints:
        has = reduce(lambda a, b: a & b, (F.contains(compact, F.lit(x)) for x in f.needs))
        if f.any_of:
            has = has & reduce(lambda a, b: a | b, (F.contains(compact, F.lit(x)) for x in f.any_of))
        out = F.when(has, f.name) if out is None else out.when(has, f.name)
    return out


def classify(pages: DataFrame, fingerprints: Sequence[Fingerprint] = FINGERPRINTS) -> DataFrame:
    """doc_id, page_count, class, matched_page, supported of pages (doc_id, page, text).

    The first page decides; documents of more than four pages are also known by the first later page that fits.
    """
    later = [f for f in fingerprints if f.later_pages]
    found = pages.select("doc_id", "page", F.when(F.col("page") == 1, page_class(F.col("text"), fingerprints)).otherwise(page_class(F.col("text"), later)).alias("c"))
    n = found.groupBy("doc_id").agg(F.max("page").alias("page_count"), F.min(F.when(F.col("c").isNotNull(), F.struct("page", "c"))).alias("first"))
    known = F.col("first").isNotNull() & ((F.col("first.page") == 1) | (F.col("page_count") > 4))
    return n.select("doc_id", "page_count", F.when(known, F.col("first.c")).otherwise("unknown_document_type").alias("class"), F.when(known, F.col("first.page")).alias("matched_page"), known.alias("supported"))


def bundle_pages(pages: DataFrame, markers: Sequence[str], most: int = 4) -> DataFrame:
    """Pages of bundles (over five pages) that hold a marker, four at most, numbered anew; other documents whole."""
    from pyspark.sql import Window as W

    c = text.compact(F.col("text"))
    marked = pages.withColumn("m", reduce(lambda a, b: a | b, (F.contains(c, F.lit(m)) for m in markers)))
    n = marked.groupBy("doc_id").agg(F.max("page").alias("n"))
    kept = marked.join(n, "doc_id").where((F.col("n") <= 5) | F.col("m"))
    kept = kept.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy("page")))
    return kept.where((F.col("n") <= 5) | (F.col("r") <= most)).select("doc_id", F.when(F.col("n") > 5, F.col("r")).otherwise(F.col("page")).alias("page"), "text")


#: Confidence of what the page's text itself states.
STATED = 0.65
#: What may stand for a field, by precedence.
PRECEDENCE = ["name", "override", "region"]


def assemble(proposals: DataFrame) -> DataFrame:
    """doc_id, field, value, confidence, source: one row for each field that any source proposes.

    proposals: doc_id, field, kind, source (in ``PRECEDENCE``), origin (shown as the source), value, confidence
    and, for checkbox groups of the region, selected and options (arrays) and answer (what the page's text
    says, or null). In turn: the name of the candidate ensemble; what the text states, with a confidence of
    0.65 at least; a checkbox group with yes and no and not one choice takes the text's answer; a region's text
    that the form printed itself is blanked. Then text is put in the form of its field, blanks have confidence 0.
    """
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("source"))
    stated = F.when((F.col("source") == "region") | (F.col("value") != ""), F.struct(rank.alias("r"), "origin", "value", "confidence", "kind", "selected", "options", "answer"))
    found = proposals.groupBy("doc_id", "field").agg(F.min(stated).alias("b"), F.max(F.when(F.col("source") == "region", F.col("confidence"))).alias("seen")).where("b is not null").select("doc_id", "field", "b.*", "seen")
    box = F.col("kind") == "checkbox_group"
    name, override = F.col("r") == 1, F.col("r") == 2
    unclear = box & ~name & ~override & (F.array_sort("options") == F.array(F.lit("no"), F.lit("yes"))) & (F.size("selected") != 1) & F.col("answer").isNotNull()
    printed = ~box & ~name & ~override & text.is_prompt(F.col("value"))
    raw = F.when(unclear, F.col("answer")).when(box & ~override, F.array_join(F.array_sort("selected"), ",")).when(printed, "").otherwise(F.col("value"))
    out = found.withColumn("_raw", raw).withColumn("_v", F.when(box, F.col("_raw")).otherwise(text.field_value(F.col("field"), F.col("_raw"))))
    blanked = ~box & (F.col("_v") == "") & (F.col("_raw") != "")
    confidence = F.when(printed | blanked, 0.0).when(override, F.greatest(F.coalesce("seen", F.lit(0.0)), F.lit(STATED))).otherwise(F.col("confidence"))
    source = F.when(blanked, "normalized_blank").when(printed, "prompt_filtered_blank").when(unclear, "raw_text_checkbox_override").when(override, "raw_text_override").otherwise(F.col("origin"))
    return out.select("doc_id", "field", F.col("_v").alias("value"), confidence.alias("confidence"), source.alias("source"))


def detected_flag(fields: DataFrame, detected: DataFrame, field: str) -> DataFrame:
    """assemble's rows with a field's answer from the detector of its checkbox (doc_id, prediction, confidence, method), where the field is there."""
    d = detected.select("doc_id", F.lit(field).alias("field"), "prediction", F.col("confidence").alias("_c"), F.concat(F.lit("template_"), F.col("method")).alias("_s"))
    joined = fields.join(d, ["doc_id", "field"], "left")
    return joined.select("doc_id", "field", F.coalesce("prediction", "value").alias("value"), F.coalesce("_c", "confidence").alias("confidence"), F.coalesce("_s", "source").alias("source"))


def best_variant(readings: DataFrame) -> DataFrame:
    """doc_id, field, text, confidence: of a field's readings the one with text, then the longest, then the surest, then the first.

    readings: doc_id, field, ord, text, confidence.
    """
    best = F.struct((F.col("text") != "").alias("some"), F.char_length("text").alias("n"), "confidence", (-F.col("ord")).alias("o"), "text")
    return readings.groupBy("doc_id", "field").agg(F.max(best).alias("b")).select("doc_id", "field", "b.text", "b.confidence")


def nested(fields: DataFrame) -> DataFrame:
    """doc_id, extracted: JSON of section to field to value, from dotted field names.

    fields: rows of doc_id, field and value, which meet once by document; or ``form_values``, where a document's stand together.
    """
    if "fields" not in fields.columns:
        fields = fields.groupBy("doc_id").agg(F.collect_list(F.struct("field", "value")).alias("fields"))

    def part(f: Column) -> Column:
        return F.struct(F.substring_index(f["field"], ".", 1).alias("section"), F.substring_index(f["field"], ".", -1).alias("name"), f["value"].alias("value"))

    def of(parts: Column) -> Column:
        sections = F.array_distinct(F.transform(parts, lambda p: p["section"]))
        return F.map_from_entries(F.transform(sections, lambda s: F.struct(s, F.map_from_entries(F.transform(F.filter(parts, lambda p: p["section"] == s), lambda p: F.struct(p["name"], p["value"]))))))

    return fields.select("doc_id", F.to_json(text.let(F.array_sort(F.transform("fields", part)), of)).alias("extracted"))


def text_overrides(docs: DataFrame) -> DataFrame:
    """Fields that the text of the scanned form's first two pages states itself: docs (doc_id, text, and page2, if there is)."""
    docs = docs.select("doc_id", _optional(docs, "text").alias("_1"), _optional(docs, "page2").alias("_2"))
    docs = docs.withColumn("_lines", text.lines(F.col("_2"))).withColumn("_providers", block_between(F.col("_lines"), "27.", "28."))
    p1, p2, named, n = F.col("_1"), F.col("_2"), F.col("_providers"), F.size("_providers")
    last = F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit(""))
    number = capture(p1, r"IDoc#:\s*([^\n]+)")
    # The patterns of this form's labels.
    values = {
        "applicant.idoc_number": number,
        "applicant.dob": capture(p1, r"DOB:\s*([A-Za-z0-9./-]+)"),
        "applicant.age": capture(p1, r"Age:\s*([0-9.]+)"),
        "applicant.ssn_last4": capture(p1, r"Last 4 digits of SSN:\s*([A-Za-z0-9./-]+)"),
        "release.tpd_or_needed_date": capture(p1, r"housing needed:\s*([^\n]+?)\s+Have you had your Parole Hearing"),
        "addictions.drug_of_choice": capture(p2, r"drug\(s\)of Choice:\s*([^\n]+?)\s*Dateoflastuse"),
        "signing.application_date": capture(p2, r"Date:\s*([0-9./-]+)"),
        "additional_form.idoc_number": number,
        "contacts.personal_phone": capture_between(p1, r"3\.\s*Personal Phone Number\s*:?", r"4\."),
        "contacts.emergency_name_relationship": capture_between(p1, r"4\.\s*Emergency Contact Name\s*&\s*Relationship\s*:?", r"5\."),
        "contacts.emergency_phone": capture_between(p1, r"5\.\s*Emergency Contact Phone Number(?:\s*\(include area code\))?\s*:?", r"6\."),
        "criminal.most_recent_convictions": capture_between(p1, r"7\.\s*What was your most recent conviction\(s\)\?", r"8\."),
        "criminal.conviction_county": capture_between(p1, r"8\.\s*What county was the crime committed in\?", r"9\."),
        "support.prescribed_medications": labelled_block(F.col("_lines"), r"21\.\s*List any prescribed medications you currently take\.\s*", r"22\."),
        "addictions.date_of_last_use": capture(p2, r"Date\s*of\s*last\s*use:?\s*([A-Za-z0-9./-]+)"),
        "housing.preferred_providers": text.clean(F.array_join(F.slice(named, 1, F.greatest(n - 1, F.lit(1))), " ")),
        "contacts.case_manager_or_po": text.only_if(last, F.char_length(last) <= 40),
    }
    return unpivot(docs, {k: ("text", v) for k, v in values.items()}, "text_override", 0.65).where("value <> ''")


# Headers that the cells of a detail page's table repeat.
CELL_HEADERS = ["Offense", "Sentencing County", "Case No.", "Status", "Released to Supervision*", "Sentence Satisfaction Date"]


def detail_page(pages: DataFrame, heading: str = "Resident/Client Search") -> DataFrame:
    """page_id, title, n_chars, name, number, status, age, mailing_address, phone, sentences of pages (page_id, html).

    Read in the page's main region only; '' (age: null) where it doesn't say. sentences: rows of the page's
    tables with four cells or more, without the headers that cells repeat.
    """
    from ..functions.udfs import html_page

    p = pages.select("page_id", html_page("html").alias("p"))
    t = F.coalesce("p.region", F.lit(""))
    got = lambda pattern: F.regexp_extract(t, pattern, 1)
    headers = F.array(*map(F.lit, CELL_HEADERS))

    def bare(cell: Column, i: Column) -> Column:
        head = F.try_element_at(headers, i + 1)
        return F.when(F.startswith(cell, head), F.trim(F.substring(cell, F.char_length(head) + 1, F.char_length(cell)))).otherwise(cell)

    def entry(row: Column) -> Column:
        at = lambda i: F.try_element_at(row, F.lit(i))
        return F.struct(at(1).alias("offense"), at(2).alias("county"), at(3).alias("case_number"), at(4).alias("sentence_status"), at(5).alias("released_to_supervision"), at(6).alias("termination_date"))

    rows = F.transform(F.filter("p.rows", lambda r: F.size(r) >= 4), lambda r: F.transform(r, bare))
    sentences = F.transform(F.filter(rows, lambda r: F.element_at(r, 1) != ""), entry)
    # What the region's labels read.
    return p.select(
        "page_id",
        F.col("p.title").alias("title"),
        F.char_length("p.text").alias("n_chars"),
        text.clean(got(rf"(?s){re.escape(heading)}\s+(.+?)\s*IDOC\s*#")).alias("name"),
        got(r"IDOC\s*#:\s*(\d+)").alias("number"),
        text.clean(got(r"(?s)Status:\s*(.+?)(?:Age:|\z)")).alias("status"),
        got(r"Age:\s*(\d+)").try_cast("int").alias("age"),
        text.clean(got(r"(?s)Mailing Address\s*(.+?)\s*Phone Number")).alias("mailing_address"),
        text.format_phone(got(r"Phone Number\s*(\d{7,})")).alias("phone"),
        F.when(F.col("p.region").isNotNull(), sentences).otherwise(F.slice(sentences, 1, 0)).alias("sentences"),
    )
