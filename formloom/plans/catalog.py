"""The query catalogue: each operator applied to its fixture or table, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, names, numbers, splits, text, udfs
from ..operators import directory as dirs
from ..operators import extract, metrics, rank, review, truth, verify
from ..sources import readers, sinks
from ..sources.fixtures import fixture as fx
from ..streaming.incremental import event_counts
from . import oracle as o

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WEIGHTS = {"name_crop_tight": 3.0, "name_crop_wide": 2.0, "page_text": 1.5}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql: its oracle, fixtures in braces."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = o.sql(sql)
        return f

    return add


def joined(c: Column | str) -> Column:
    return F.array_join(c, ",")


def known(s: SparkSession, d: str) -> DataFrame:
    return dirs.directory(fx(s, d, "directory"))


# --- names and numbers ---------------------------------------------------------------------------


@query(f"SELECT ord, {o.norm('name')} AS normal FROM {{directory}}")
def person_name_normalize(s, d):
    return fx(s, d, "directory").select("ord", names.normalise(F.col("name")).alias("normal"))


@query(f"SELECT ord, kf AS key_first, kl AS key_last FROM {o.DIRECTORY}")
def person_name_key(s, d):
    k = names.key(F.col("name"))
    return fx(s, d, "directory").select("ord", k["first"].alias("key_first"), k["last"].alias("key_last"))


@query(f"SELECT doc_id, array_to_string({o.candidates('raw')}, ',') AS found, {o.read_digits('raw')} AS read FROM {{readings}}")
def id_candidates(s, d):
    return fx(s, d, "readings").select("doc_id", joined(numbers.candidates(F.col("raw"))).alias("found"), numbers.read_digits(F.col("raw")).alias("read"))


@query(f"SELECT doc_id, {o.best('c')} AS number FROM (SELECT doc_id, {o.candidates('raw')} AS c FROM {{readings}})")
def id_number_normalize(s, d):
    return fx(s, d, "readings").select("doc_id", numbers.normalise(F.col("raw")).alias("number"))


@query("SELECT doc_id, crop, raw, regexp_full_match(raw, '[0-9]{4}202[4-7]') AS is_date, regexp_full_match(raw, '[0-9]{5,6}') AS plausible FROM {number_readings}")
def id_plausible(s, d):
    return fx(s, d, "number_readings").select("doc_id", "crop", "raw", numbers.looks_like_date(F.col("raw")).alias("is_date"), numbers.plausible(F.col("raw")).alias("plausible"))


@query(f"SELECT doc_id, ({o.distance('number', 'raw')})::BIGINT AS hamming, levenshtein(number, raw)::BIGINT AS edits FROM {{readings}}")
def edit_distance(s, d):
    r = fx(s, d, "readings")
    return r.select("doc_id", numbers.distance(F.col("number"), F.col("raw")).cast("long").alias("hamming"), F.levenshtein("number", "raw").cast("long").alias("edits"))


def _phone_sql(least: int, most: int) -> str:
    v = o.capture("phone_text") if most < 99 else o.clean("phone_text")
    return f"CASE WHEN length({o.digits(v)}) BETWEEN {least} AND {most} THEN {v} ELSE '' END"


_DAY, _MAIL = o.capture("day_text"), o.clean("email_text")
_CITY = " ".join(f"WHEN contains(lower(city_text), '{c.lower()}') THEN '{c}'" for c in ("Boise", "Nampa", "Caldwell", "Meridian", "Twin Falls", "Pocatello"))
_COUNTY = f"replace({o.capture('county_text')}, '_', '')"


@query(
    f"""SELECT doc_id, CASE WHEN regexp_full_match({_DAY}, '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}') THEN {_DAY} ELSE '' END AS day,
 CASE WHEN try_cast({o.digits('age_text')} AS INT) BETWEEN 17 AND 100 THEN try_cast({o.digits('age_text')} AS INT)::VARCHAR ELSE '' END AS age,
 CASE WHEN length({o.digits('last4_text')}) = 4 THEN {o.digits('last4_text')} ELSE '' END AS last4,
 CASE WHEN regexp_replace(lower(gender_text), '[^a-z]', '', 'g') IN ('m', 'male') THEN 'Male' WHEN regexp_replace(lower(gender_text), '[^a-z]', '', 'g') IN ('f', 'female') THEN 'Female' ELSE '' END AS gender,
 {_phone_sql(7, 12)} AS phone_scanned, {_phone_sql(7, 99)} AS phone_digital, {_phone_sql(10, 99)} AS phone_packet,
 CASE WHEN regexp_full_match({_MAIL}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}') THEN {_MAIL} ELSE '' END AS email,
 CASE WHEN regexp_full_match({_COUNTY}, '[A-Za-z /-]{{2,40}}') THEN array_to_string(list_transform(regexp_extract_all({_COUNTY}, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(substr(x, 2))), '') ELSE '' END AS county,
 CASE {_CITY} ELSE '' END AS city FROM {{typed}}"""
)
def validators(s, d):
    c = F.col
    return fx(s, d, "typed").select(
        "doc_id",
        text.valid_date(c("day_text")).alias("day"),
        text.valid_age(c("age_text")).alias("age"),
        text.valid_last4(c("last4_text")).alias("last4"),
        text.valid_gender(c("gender_text")).alias("gender"),
        text.valid_phone(c("phone_text")).alias("phone_scanned"),
        text.valid_phone(c("phone_text"), 7, None).alias("phone_digital"),
        text.valid_phone(c("phone_text"), 10, None).alias("phone_packet"),
        text.valid_email(c("email_text")).alias("email"),
        text.valid_county(c("county_text")).alias("county"),
        text.valid_city(c("city_text")).alias("city"),
    )


@query(
    f"""SELECT doc_id, CASE WHEN length({o.digits('age_text')}) >= 4 THEN {o.digits('age_text')} ELSE '' END AS packet_id,
 CASE WHEN length(ltrim({o.digits('last4_text')}, '0')) BETWEEN 5 AND 6 THEN ltrim({o.digits('last4_text')}, '0') ELSE '' END AS digital_id,
 CASE WHEN length(regexp_replace(last4_text, '[^A-Za-z0-9-]', '', 'g')) >= 4 AND length({o.digits('last4_text')}) >= 3 THEN regexp_replace(last4_text, '[^A-Za-z0-9-]', '', 'g') ELSE '' END AS loose_id,
 coalesce(nullif(trim(regexp_replace(trim(last4_text), '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'item') AS fragment FROM {{typed}}"""
)
def id_validators(s, d):
    c = F.col
    return fx(s, d, "typed").select("doc_id", numbers.packet_id(c("age_text")).alias("packet_id"), numbers.numeric_id(c("last4_text")).alias("digital_id"), numbers.loose_id(c("last4_text")).alias("loose_id"), text.path_fragment(c("last4_text")).alias("fragment"))


@query("SELECT doc_id, name FROM " + o.name_values("{captured}"))
def name_value_clean(s, d):
    return fx(s, d, "captured").select("doc_id", text.name_value(F.col("value")).alias("name"))


_PROMPT = " OR ".join([f"contains(lower(text), {o.lit(m)})" for m in o.PROMPTS] + [f"contains(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), {o.lit(m)})" for m in o.PROMPTS_COMPACT])


@query(
    f"""SELECT doc_id, ({_PROMPT}) AS is_prompt, CASE WHEN length(p) <= 120 THEN p ELSE substr(p, 1, 117) || '...' END AS preview, coalesce(nullif(trim(regexp_replace(trim(source), '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'item') AS fragment
 FROM (SELECT *, trim(replace(text, chr(10), ' ')) AS p FROM documents)"""
)
def prompt_text_filter(s, d):
    t = F.coalesce("text", F.lit(""))
    return fx(s, d, "documents").select("doc_id", text.is_prompt(t).alias("is_prompt"), text.preview(t).alias("preview"), text.path_fragment(F.col("source")).alias("fragment"))


@query(
    """SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''.-]*'))::BIGINT AS n_tokens, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS n_lines,
 length(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'))::BIGINT AS n_compact, md5(regexp_replace(replace(lower(text), '0', 'o'), '[^a-z0-9/]+', '', 'g')) AS compact_md5 FROM documents"""
)
def text_stats(s, d):
    t = F.col("text")
    return fx(s, d, "documents").select("doc_id", text.token_count(t).cast("long").alias("n_tokens"), F.size(text.lines(t)).cast("long").alias("n_lines"), F.char_length(text.compact(t)).cast("long").alias("n_compact"), F.md5(text.compact_text(t).cast("binary")).alias("compact_md5"))


@query(
    r"""SELECT doc_id, regexp_extract(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1) AS email, regexp_extract(text, '(\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4})', 1) AS phone,
 len(regexp_extract_all(text, '\b[0-9]{5,6}\b'))::BIGINT AS n_numbers FROM documents"""
)
def email_phone_extract(s, d):
    t = F.col("text")
    return fx(s, d, "documents").select("doc_id", F.regexp_extract(t, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1).alias("email"), F.regexp_extract(t, r"(\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4})", 1).alias("phone"), F.size(F.regexp_extract_all(t, F.lit(r"\b[0-9]{5,6}\b"), F.lit(0))).cast("long").alias("n_numbers"))


# --- extraction ----------------------------------------------------------------------------------

_LABEL = " OR ".join(f"starts_with(lower(x), {o.lit(x)})" for x in o.LABELS)


def _after_sql(anchor: str, most: int) -> str:
    low = o.lit(anchor.lower())
    i = f"coalesce(list_position(list_transform(L, lambda x: contains(lower(x), {low})), true), 0)"
    rest = o.clean(f"substr(L[greatest({i}, 1)], instr(lower(L[greatest({i}, 1)]), {low}) + {len(anchor)})")
    after = f"L[{i} + 1 : {i} + {most}]"
    j = f"coalesce(list_position(list_transform({after}, lambda x: ({_LABEL})), true), 0)"
    block = f"CASE WHEN {j} > 0 THEN ({after})[1 : {j} - 1] ELSE {after} END"
    return f"CASE WHEN {i} = 0 THEN '' WHEN {rest} <> '' THEN {rest} ELSE {o.clean(f"coalesce(array_to_string({block}, ' '), '')")} END"


def _rule_sql(rule: str, cut: str, v: str) -> str:
    date = f"CASE WHEN regexp_full_match(v, '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}') THEN v ELSE '' END"
    rules = {
        "id": f"CASE WHEN length(ltrim({o.digits('v')}, '0')) BETWEEN 5 AND 6 THEN ltrim({o.digits('v')}, '0') ELSE '' END",
        "gender": "CASE lower(v) WHEN 'male' THEN 'Male' WHEN 'm' THEN 'Male' WHEN 'female' THEN 'Female' WHEN 'f' THEN 'Female' ELSE '' END",
        "date": date,
        "age": f"CASE WHEN try_cast({o.digits('v')} AS INT) BETWEEN 17 AND 100 THEN try_cast({o.digits('v')} AS INT)::VARCHAR ELSE '' END",
        "phone": f"CASE WHEN length({o.digits('v')}) >= 7 THEN v ELSE '' END",
        "email": "CASE WHEN regexp_full_match(v, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') THEN v ELSE '' END",
        "bool": "CASE WHEN lower(v) IN ('yes', 'no') THEN lower(v) ELSE '' END",
        "name": f"CASE WHEN regexp_matches(lower(v), '{o.NOT_NAMES}') THEN '' ELSE trim(regexp_replace(v, '\\s*\\(.*?\\)\\s*$', '')) END",
        "": "v",
    }
    out = f"(SELECT {rules[rule]} FROM (SELECT {v} AS v))"
    return f"trim(regexp_replace({out}, {o.lit(cut)}, '', 'g'))" if cut else out


def _multi_sql(anchor: str, stop: str) -> str:
    """The rest of the anchor's line and the lines up to one that holds the stop."""
    low = o.lit(anchor.lower())
    i = f"coalesce(list_position(list_transform(L, lambda x: contains(lower(x), {low})), true), 0)"
    after = f"L[{i} + 1 :]"
    j = f"coalesce(list_position(list_transform({after}, lambda x: contains(lower(x), {o.lit(stop.lower())})), true), 0)"
    rest = f"substr(L[greatest({i}, 1)], instr(lower(L[greatest({i}, 1)]), {low}) + {len(anchor)})"
    block = f"coalesce(array_to_string(CASE WHEN {j} > 0 THEN ({after})[1 : {j} - 1] ELSE {after} END, ' '), '')"
    return f"CASE WHEN {i} = 0 THEN '' ELSE {o.clean(f"{rest} || ' ' || {block}")} END"


def _form_sql() -> str:
    parts = []
    for name, labels, most, rule, cut, kind in o.FORM:
        each = ", ".join(f"nullif({_rule_sql(rule, cut, _after_sql(label, most))}, '')" for label in labels)
        extra = ", nullif(trim(regexp_replace(stem, '\\s+[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}$', '')), '')" if name == "applicant.name" else ""
        parts.append(f"SELECT doc_id, '{name}' AS field, '{kind}' AS kind, coalesce({each}{extra}, '') AS value FROM l")
    day = "CASE WHEN regexp_full_match({0}, '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}') THEN {0} ELSE '' END"
    parts.append(f"SELECT doc_id, 'housing.needed_by', 'text', {day.format('v')} FROM (SELECT doc_id, {_multi_sql('Housing needed by', 'Phone')} AS v FROM l)")
    charges = f"coalesce(nullif({_multi_sql('EXPLAIN IN DETAIL ALL', 'Name of Case')}, ''), {_multi_sql('List all charges', 'Name of Case')})"
    charges = f"regexp_replace({charges}, '(?i)\\s*EXPLAIN IN DETAIL ALL\\s*VIOLENT CHARGES:?\\s*', chr(10), 'g')"
    parts.append(f"SELECT doc_id, 'criminal.charges', 'multiline_text', trim(regexp_replace(trim({charges}, ' ' || chr(10)), '(?i)^VIOLENT CHARGES:?\\s*', ''), ' ' || chr(10)) FROM l")
    parts.append(f"SELECT doc_id, 'signing.application_date', 'text', coalesce(nullif({day.format('v')}, ''), {day.format('w')}) FROM (SELECT doc_id, {_after_sql('Date', 1)} AS v, {_after_sql("Today's Date", 1)} AS w FROM l)")
    return "WITH l AS (SELECT doc_id, stem, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS L FROM {forms}) " + " UNION ALL ".join(parts)


_FORM = "SELECT doc_id, field, kind, 'digital_text' AS source, value, CASE WHEN value = '' THEN 0.0::DOUBLE ELSE 0.95::DOUBLE END AS confidence FROM (" + _form_sql() + ")"


@query(_FORM)
def form_fields_long(s, d):
    return extract.digital_form(fx(s, d, "forms"))


def _tidy(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'), ' _:-.,')"


def _packet_sql() -> str:
    """The packet's 27 fields, pattern by pattern, in DuckDB's SQL."""

    def got(page: str, pattern: str, flags: str = "i") -> str:
        return rf"trim(regexp_replace(regexp_extract({page}, '(?{flags}){pattern}', 1), '\s+', ' ', 'g'), ' _:-')"

    def either(*values: str) -> str:
        return "coalesce(" + ", ".join(f"nullif({v}, '')" for v in values) + ", '')"

    def passing(value: str, pattern: str) -> str:
        return f"(SELECT CASE WHEN regexp_full_match(v, '{pattern}') THEN v ELSE '' END FROM (SELECT {_tidy(value)} AS v))"

    def day(value: str) -> str:
        return passing(value, "[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}")

    def unless(value: str, pattern: str) -> str:
        return f"(SELECT CASE WHEN regexp_matches(v, '(?i){pattern}') THEN '' ELSE v END FROM (SELECT {value} AS v))"

    def first(found: str) -> str:
        return f"coalesce(list_filter({found}, lambda x: x IS NOT NULL AND x <> '')[1], '')"

    def line_after(anchor: str, ignored: str) -> str:
        return first(f"list_transform(range(1, len(A) + 1), lambda i: CASE WHEN regexp_matches(A[i], '(?i){anchor}') THEN list_filter(A[i + 1 : i + 4], lambda x: NOT regexp_matches(lower(x), '{ignored}'))[1] END)")

    def yes_no(pages_: str, pattern: str, lines: str, anchor: str) -> str:
        said = f"(SELECT CASE WHEN lower(v) IN ('yes', 'no') THEN lower(v) ELSE '' END FROM (SELECT regexp_extract({pages_}, '(?is){pattern}', 1) AS v))"
        window = f"lower(array_to_string({lines}[i : i + 3], ' '))"
        yes, no = rf"regexp_matches({window}, '\byes\b')", rf"regexp_matches({window}, '\bno\b')"
        return either(said, first(f"list_transform(range(1, len({lines}) + 1), lambda i: CASE WHEN regexp_matches({lines}[i], '(?i){anchor}') THEN CASE WHEN {yes} AND NOT {no} THEN 'yes' WHEN {no} AND NOT {yes} THEN 'no' END END)"))

    until = r"\s*(?:Name of Case Manager|Will you be on probation|I have completed)"
    city = either(got("page1", r"preferred city of\s*(.*?)\s*Have you previously", "is"), line_after("preferred city of", "housing|please selecta"))
    cities = " ".join(f"WHEN contains(lower(v), '{c.lower()}') THEN '{c}'" for c in ("Boise", "Caldwell", "Lewiston", "Twin Falls", "Idaho Falls", "Pocatello"))
    number = got("page1", r"IDOC\s*or\s*LE\s*#\s*([A-Za-z0-9-]+)")
    fields = {
        "applicant.name": ("text", either(rf"trim(regexp_replace(stem, '\s+\d{{1,2}}-\d{{1,2}}-\d{{2}}$', ''))", line_after(r"^name\b", "gender|date of birth"))),
        "applicant.idoc_or_le_number": ("text", f"CASE WHEN length({o.digits(number)}) >= 4 THEN {o.digits(number)} ELSE '' END"),
        "applicant.gender": ("text", f"CASE lower(trim({line_after('^gender:?$', 'name|please print clearly|address|physical address')})) WHEN 'male' THEN 'Male' WHEN 'm' THEN 'Male' WHEN 'female' THEN 'Female' WHEN 'f' THEN 'Female' ELSE '' END"),
        "applicant.date_of_birth": ("text", day(got("page1", r"Date of Birth\s*([0-9/.-]+)"))),
        "applicant.age": ("text", got("page1", r"Age:?\s*([0-9]{1,3})")),
        "contacts.phone": ("text", f"(SELECT CASE WHEN length({o.digits('v')}) >= 10 THEN v ELSE '' END FROM (SELECT {_tidy(got('page1', r'Phone(?: Number)?:?\s*([0-9() -]{7,})'))} AS v))"),
        "contacts.email": ("text", passing(got("page1", r"e-?mail\s*([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+)"), r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")),
        "contacts.emergency_contact": ("text", got("page1", r"Emergency Contact:?\s*([A-Za-z0-9 .()/-]{6,})\s*Name(?:\s*&\s*Phone| and Phone)?")),
        "housing.preferred_city": ("text", f"(SELECT CASE {cities} ELSE '' END FROM (SELECT {_tidy(city)} AS v))"),
        "addictions.drug_of_choice": ("text", unless(_tidy(either(got("page1", r"Drug\(s\) of Choice:?\s*([^\n]+)"), got("page2", r"Alcohol and/or drugs\s*([^\n]+)"))), r"\?")),
        "addictions.date_of_last_use": ("text", day(either(got("page1", r"Date[- ]of[- ]Last[- ]Use:?\s*([0-9/.-]+)"), got("page2", r"Date of last use\s*([0-9/.-]+)")))),
        "housing.needed_by": ("text", day(either(got("page1", r"Date Housing Needed:?\s*([^\n]+)"), got("page2", r"Housing needed by\s*([^\n]+)")))),
        "support.prescribed_medications": ("text", either(got("page1", r"List any medications you are prescribed:?\s*([^\n]+)"), got("page2", r"List any medications\s*([^\n]+)\s*you are prescribed"))),
        "contacts.case_manager": ("text", unless(either(got("page2", r"Name of Case\s*Manager:?\s*([^\n]+)"), got("page2", r"Name of CaseManager,? if applicable:?\s*([^\n]+)")), "if applicable|name of case")),
        "supervision.reporting_county": ("text", got("page2", r"Name of Idaho County you will be reporting to:?\s*([^\n]+)")),
        "supervision.probation_or_parole_officer": ("text", unless(got("page2", r"Probation/Parole Officer(?: Name)?(?:, if known)?:?\s*([^\n]+)"), "name,? ?if known")),
        "signing.signature_name": ("text", either(got("page2", r"Your Signature \(Type Name\)\s*([^\n]+)"), got("page2", r"Print Name:?\s*([^\n]+)"))),
        "signing.application_date": ("text", either(day(got("page1", r"Today''s Date:?\s*([0-9/.-]+)")), day(either(got("page2", r"Date\s*([0-9/.-]+)"), got("page3", r"Date\s*([0-9/.-]+)"))))),
        "criminal.charges": ("multiline_text", got("page2", rf"List all charges:?\s*(.*?){until}", "is")),
        "criminal.violent_charge_explanation": ("multiline_text", got("page2", rf"violent charges:?\s*(.*?){until}", "is")),
        "history.previously_resided": ("checkbox_group", yes_no("page1", r"Have you previously\s*(Yes|No)\s*resided at", "A", r"previously\s+resided\s+at")),
        "history.alcoholic_or_addict": ("checkbox_group", yes_no("page1", r"Are you an\s*(Yes|No)\s*alcoholic/addict", "A", "alcoholic/addict")),
        "requirements.sex_offender_registration": ("checkbox_group", yes_no("page2", r"register\s*(Yes|No)\s*as a sex offender", "B", r"register\s+as\s+a\s+sex\s+offender")),
        "employment.currently_employed": ("checkbox_group", yes_no("page2", r"currently\s*(Yes|No)\s*employed", "B", r"currently\s+employed")),
        "criminal.convicted_misdemeanor_or_felony": ("checkbox_group", yes_no("(page1 || chr(10) || page2)", r"convicted of a\s*(Yes|No)\s*misdemeanor or\s*felony", "C", r"convicted\s+of\s+a\s+misdemeanor\s+or\s+felony")),
        "criminal.under_influence_during_crime": ("checkbox_group", yes_no("page2", r"influence of\s*(Yes|No)\s*drugs/alcohol", "B", r"under\s+the\s+influence.*crime\s+was\s+committed|where\s+you\s+under\s+the\s+influence")),
        "supervision.on_probation_or_parole_while_housed": ("checkbox_group", yes_no("page2", r"Will you be on\s*(Yes|No)\s*probation or parole", "B", r"probation\s+or\s+parole\s+while\s+in\s+housing")),
    }
    lines = lambda x: f"list_filter(list_transform(string_split(regexp_replace({x}, '[ \t]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
    each = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS field, '{kind}' AS kind, {v} AS value FROM l" for k, (kind, v) in fields.items())
    return f"WITH l AS (SELECT *, {lines('page1')} AS A, {lines('page2')} AS B, list_concat({lines('page1')}, {lines('page2')}) AS C FROM {{packets}}) SELECT doc_id, field, kind, value, CASE WHEN value = '' THEN 0.0::DOUBLE WHEN kind = 'checkbox_group' THEN 0.9::DOUBLE ELSE 0.85::DOUBLE END AS confidence FROM ({each})"


@query(_packet_sql())
def packet_fields_long(s, d):
    docs = fx(s, d, "packets").select("doc_id", F.col("page1").alias("text"), "page2", "page3", "stem")
    return extract.packet_form(docs).select("doc_id", "field", "kind", "value", "confidence")


def _stated_sql() -> str:
    """The 17 values that the scanned form's first two pages state themselves, in DuckDB's SQL."""

    def got(page: str, pattern: str, flags: str = "im") -> str:
        return o.capture(f"regexp_extract({page}, '(?{flags}){pattern}', 1)")

    def between(page: str, start: str, stop: str) -> str:
        return got(page, rf"{start}\s*(.*?)\s*{stop}", "is")

    at = lambda l, test: f"coalesce(list_position(list_transform({l}, lambda x: {test}), true), 0)"
    label = r"(?i)^21\.\s*List any prescribed medications you currently take\.\s*"
    i = at("L", f"regexp_matches(x, '{label}')")
    after = f"L[{i} + 1 :]"
    j = at(after, "regexp_matches(x, '^22\\.')")
    rest = o.capture(f"regexp_replace(L[greatest({i}, 1)], '{label}', '')")
    block = f"CASE WHEN {j} > 0 THEN ({after})[1 : {j} - 1] ELSE {after} END"
    values = {
        "applicant.idoc_number": got("page1", r"IDoc#:\s*([^\n]+)"),
        "applicant.dob": got("page1", r"DOB:\s*([A-Za-z0-9./-]+)"),
        "applicant.age": got("page1", r"Age:\s*([0-9.]+)"),
        "applicant.ssn_last4": got("page1", r"Last 4 digits of SSN:\s*([A-Za-z0-9./-]+)"),
        "release.tpd_or_needed_date": got("page1", r"housing needed:\s*([^\n]+?)\s+Have you had your Parole Hearing"),
        "addictions.drug_of_choice": got("page2", r"drug\(s\)of Choice:\s*([^\n]+?)\s*Dateoflastuse"),
        "signing.application_date": got("page2", r"Date:\s*([0-9./-]+)"),
        "additional_form.idoc_number": got("page1", r"IDoc#:\s*([^\n]+)"),
        "contacts.personal_phone": between("page1", r"3\.\s*Personal Phone Number\s*:?", r"4\."),
        "contacts.emergency_name_relationship": between("page1", r"4\.\s*Emergency Contact Name\s*&\s*Relationship\s*:?", r"5\."),
        "contacts.emergency_phone": between("page1", r"5\.\s*Emergency Contact Phone Number(?:\s*\(include area code\))?\s*:?", r"6\."),
        "criminal.most_recent_convictions": between("page1", r"7\.\s*What was your most recent conviction\(s\)\?", r"8\."),
        "criminal.conviction_county": between("page1", r"8\.\s*What county was the crime committed in\?", r"9\."),
        "support.prescribed_medications": f"CASE WHEN {i} = 0 THEN '' ELSE {o.capture(f"array_to_string(list_concat(list_filter([{rest}], lambda x: x <> ''), {block}), ' ')")} END",
        "addictions.date_of_last_use": got("page2", r"Date\s*of\s*last\s*use:?\s*([A-Za-z0-9./-]+)"),
        "housing.preferred_providers": o.clean("array_to_string(P[1 : greatest(len(P) - 1, 1)], ' ')"),
        "contacts.case_manager_or_po": "CASE WHEN length(P[-1]) <= 40 THEN P[-1] ELSE '' END",
    }
    i27 = at("L", "starts_with(x, '27.')")
    j28 = at(f"L[{i27} + 1 :]", "starts_with(x, '28.')")
    each = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS field, {v} AS value FROM p" for k, v in values.items())
    return f"""WITH l AS (SELECT *, list_filter(list_transform(string_split(page2, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS L FROM {{scanned}}), p AS (SELECT *, CASE WHEN {i27} > 0 AND {j28} > 0 THEN (L[{i27} + 1 :])[1 : {j28} - 1] ELSE [] END AS P FROM l)
 SELECT doc_id, field, value FROM ({each}) WHERE value <> ''"""


@query(_stated_sql())
def text_overrides(s, d):
    return extract.text_overrides(fx(s, d, "scanned").select("doc_id", F.col("page1").alias("text"), "page2")).select("doc_id", "field", "value")


_HINTS = " UNION ALL ".join("SELECT '{}' AS field, {} AS page, '{}' AS anchor".format(*line.split()) for line in o.QUESTIONS.splitlines())
_TAIL = [("y[/x]+n", "yes"), ("yn[/x]+", "no"), ("yn[xk]+", "no"), ("yno(?:if|$)", "no"), ("yyesn", "yes"), ("y$", "yes")]
_WINDOW = [("y[x/.,]+n", "yes"), ("yn[x/.,k]+", "no"), (r"y(?:x|[.,])$", "yes"), ("yn(?:x|[.,k/])+$", "no")]
_COMPACT = "regexp_replace(replace(lower({}), '0', 'o'), '[^a-z0-9/]+', '', 'g')"


def _answers_sql(x: str, patterns) -> str:
    return " ".join(f"WHEN regexp_matches({x}, {o.lit(p)}) THEN '{a}'" for p, a in patterns)


@query(
    f"""WITH m AS (SELECT p.doc_id, h.field, h.anchor, {_COMPACT.format('p.text')} AS c, list_filter(list_transform(string_split(p.text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS L FROM {{answers}} p JOIN ({_HINTS}) h ON p.page = h.page),
 n AS (SELECT *, instr(c, anchor) AS i, coalesce(list_position(list_transform(range(1, len(L) + 1), lambda k: contains({_COMPACT.format('L[k]')} || coalesce({_COMPACT.format('L[k + 1]')}, ''), anchor)), true), 0) AS k FROM m),
 t AS (SELECT *, substr(c, i + length(anchor), 40) AS tail, regexp_replace(translate(replace(lower(array_to_string(L[greatest(k, 1) : greatest(k, 1) + 1], ' ')), '0', 'o'), '口区☑☒α', 'xxxxx'), '\\s+', '', 'g') AS w FROM n),
 a AS (SELECT doc_id, field, CASE WHEN i > 0 THEN CASE {_answers_sql('tail', _TAIL)} END WHEN k > 0 THEN CASE {_answers_sql('w', _WINDOW)} WHEN regexp_matches(w, 'y$') AND NOT contains(w, 'n') THEN 'yes' END END AS answer FROM t)
 SELECT * FROM a WHERE answer IS NOT NULL"""
)
def binary_answer(s, d):
    return extract.checkbox_overrides(fx(s, d, "answers"))


_C = "regexp_replace(lower(text), '[^a-z0-9]+', '', 'g')"
_CLASS1 = f"CASE WHEN contains({_C}, 'idochousingapplication') AND (contains({_C}, 'cmpocontactemail') OR contains({_C}, 'currentstatuspleasecheckone')) THEN 'housing_application_v1' WHEN contains({_C}, 'jotform') AND contains({_C}, 'applicationforhousing') THEN 'digital_application' WHEN contains({_C}, 'applicationforhousing') THEN 'application_packet' END"
_CLASS2 = _CLASS1.replace(f"WHEN contains({_C}, 'jotform') AND contains({_C}, 'applicationforhousing') THEN 'digital_application' ", "")


@query(
    f"""WITH p AS (SELECT doc_id, page, CASE WHEN page = 1 THEN {_CLASS1} ELSE {_CLASS2} END AS c FROM {{pages}}),
 n AS (SELECT doc_id, max(page) AS page_count, min(page) FILTER (c IS NOT NULL) AS first FROM p GROUP BY doc_id),
 k AS (SELECT *, first IS NOT NULL AND (first = 1 OR page_count > 4) AS supported FROM n)
 SELECT k.doc_id, page_count, CASE WHEN supported THEN min(p.c) ELSE 'unknown_document_type' END AS class, CASE WHEN supported THEN first END AS matched_page, supported
 FROM k LEFT JOIN p ON p.doc_id = k.doc_id AND p.page = k.first AND p.c IS NOT NULL GROUP BY k.doc_id, page_count, supported, first"""
)
def document_classification(s, d):
    return extract.classify(fx(s, d, "pages"))


@query(
    """WITH p AS (SELECT doc_id, page, text, regexp_matches(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), 'the|application') AS m, max(page) OVER (PARTITION BY doc_id) AS n FROM {pages}),
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS r FROM p WHERE n <= 5 OR m)
 SELECT doc_id, (CASE WHEN n > 5 THEN r ELSE page END)::INT AS page, md5(text) AS text_md5 FROM r WHERE n <= 5 OR r <= 4"""
)
def bundle_pages(s, d):
    pages = fx(s, d, "pages").dropDuplicates(["doc_id", "page"])
    return extract.bundle_pages(pages, ["the", "application"]).select("doc_id", F.col("page").cast("int").alias("page"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    f"""WITH f AS (SELECT doc_id, split_part(field, '.', 1) AS section, split_part(field, '.', 2) AS name, value FROM ({_FORM})),
 g AS (SELECT doc_id, section, string_agg('"' || name || '":' || to_json(value)::VARCHAR, ',' ORDER BY name) AS inside FROM f GROUP BY ALL)
 SELECT doc_id, '{{' || string_agg('"' || section || '":{{' || inside || '}}', ',' ORDER BY section) || '}}' AS extracted FROM g GROUP BY doc_id"""
)
def nested_json(s, d):
    return extract.nested(extract.form_values(fx(s, d, "forms")))


_SEL = "CASE answer WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'no,yes' ELSE '' END"
_ASSEMBLED = f"""WITH a AS (SELECT doc_id, field, kind, value, confidence::DOUBLE AS confidence, source, answer, CASE doc_id % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS stated FROM {{fields}}),
 b AS (SELECT doc_id, field, kind, CASE WHEN field = 'release.reason' AND doc_id % 5 = 0 THEN 'Phone Number: see page 3 of 4' ELSE value END AS value, confidence, source, answer, stated FROM a),
 p AS (SELECT *, CASE WHEN field = 'applicant.name' AND doc_id % 2 = 0 AND value <> '' THEN 1 WHEN field IN ('addictions.date_of_last_use', 'employment.employer') AND doc_id % 4 = 0 THEN 2 ELSE 3 END AS r FROM b),
 q AS (SELECT *, kind = 'checkbox_group' AND answer IN (2, 3) AND stated IS NOT NULL AS unclear, r = 3 AND kind <> 'checkbox_group' AND ({_PROMPT.replace("text", "value")}) AS printed,
  CASE WHEN r = 2 THEN CASE field WHEN 'employment.employer' THEN 'Stated employer' ELSE '3/4/' || (1990 + doc_id % 30) END ELSE value END AS v FROM p),
 u AS (SELECT *, CASE WHEN unclear THEN stated WHEN kind = 'checkbox_group' THEN {_SEL} WHEN printed THEN '' ELSE v END AS raw FROM q),
 n AS (SELECT doc_id, name FROM {o.name_values("(SELECT doc_id, trim(regexp_replace(trim(raw, ' _:-'), '\\s+', ' ', 'g')) AS value FROM u WHERE field = 'applicant.name')")}),
 w AS (SELECT u.*, trim(regexp_replace(trim(raw, ' _:-'), '\\s+', ' ', 'g')) AS c, n.name FROM u LEFT JOIN n ON n.doc_id = u.doc_id AND u.field = 'applicant.name'),
 x AS (SELECT *, CASE WHEN kind = 'checkbox_group' THEN raw WHEN c = '' THEN '' WHEN field = 'applicant.name' THEN coalesce(name, '') WHEN field = 'addictions.date_of_last_use' THEN CASE WHEN regexp_full_match(c, '[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}') THEN c ELSE '' END ELSE c END AS value2 FROM w),
 y AS (SELECT *, kind <> 'checkbox_group' AND value2 = '' AND raw <> '' AS blanked FROM x)
 SELECT doc_id, field, value2 AS value, CASE WHEN printed OR blanked THEN 0.0 WHEN r = 2 THEN greatest(confidence, 0.65) ELSE confidence END AS confidence,
  CASE WHEN blanked THEN 'normalized_blank' WHEN printed THEN 'prompt_filtered_blank' WHEN unclear THEN 'raw_text_checkbox_override' WHEN r = 2 THEN 'raw_text_override' ELSE source END AS source FROM y"""


def _proposals(s, d) -> DataFrame:
    """Region readings of the fields fixture, ensemble names, and values and answers that the page's text states."""
    f, i = _fields(s, d), F.col("doc_id")
    printed = F.when((F.col("field") == "release.reason") & (i % 5 == 0), "Phone Number: see page 3 of 4").otherwise(F.col("value"))
    answer = F.when(i % 3 == 0, "yes").when(i % 3 == 1, "no")
    region = f.select("doc_id", "field", "kind", F.lit("region").alias("source"), F.col("source").alias("origin"), printed.alias("value"), "confidence", "selected", "options", answer.alias("answer"))
    name = region.where((F.col("field") == "applicant.name") & (i % 2 == 0)).withColumn("source", F.lit("name"))
    told = F.when(F.col("field") == "employment.employer", "Stated employer").otherwise(F.concat(F.lit("3/4/"), (1990 + i % 30).cast("string")))
    stated = region.where(F.col("field").isin("addictions.date_of_last_use", "employment.employer") & (i % 4 == 0)).withColumns({"source": F.lit("override"), "value": told, "confidence": F.lit(0.0)})
    return region.unionByName(name).unionByName(stated)


@query(_ASSEMBLED)
def field_assembly(s, d):
    return extract.assemble(_proposals(s, d))


@query(f"SELECT doc_id, field, CASE WHEN hit THEN 'yes' ELSE value END AS value, CASE WHEN hit THEN 0.75 ELSE confidence END AS confidence, CASE WHEN hit THEN 'template_V1' ELSE source END AS source FROM (SELECT *, field = 'addictions.has_addictions' AND doc_id % 2 = 1 AS hit FROM ({_ASSEMBLED}))")
def flag_override(s, d):
    docs = fx(s, d, "orders").where(F.col("o_orderkey") % 2 == 1).select(F.col("o_orderkey").alias("doc_id"), F.lit("yes").alias("prediction"), F.lit(0.75).alias("confidence"), F.lit("V1").alias("method")).distinct()
    return extract.detected_flag(extract.assemble(_proposals(s, d)), docs, "addictions.has_addictions")


@query()
def html_detail(s, d):
    return extract.detail_page(s.read.parquet(f"{d}/pages.parquet")).withColumn("sentences", F.size("sentences"))


# --- candidates, consensus, ranking --------------------------------------------------------------

_COUNTS = f"SELECT doc_id, value, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest({o.candidates('raw')}) AS value FROM {{number_readings}}) GROUP BY ALL"
_NODATE = f"SELECT * FROM ({_COUNTS}) WHERE NOT regexp_full_match(value, '[0-9]{{4}}202[4-7]')"
_SL = f"{o.length_score('value')}, length(value)"
_BEST = f"SELECT doc_id, value, n FROM ({_NODATE}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {o.length_score('value')} DESC, length(value) DESC, n DESC, value DESC) = 1"
_COMMON = f"SELECT doc_id, value, n FROM ({_NODATE}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, {o.length_score('value')} DESC, length(value) DESC, value DESC) = 1"


@query(_NODATE)
def candidate_histogram(s, d):
    return rank.histogram(fx(s, d, "number_readings"), dates=False)


@query(_BEST)
def best_candidate(s, d):
    return rank.best_number(candidate_histogram(s, d))


@query(_COMMON)
def most_common_candidate(s, d):
    return rank.most_common(candidate_histogram(s, d))


@query(
    f"""SELECT doc_id, CASE WHEN t THEN v ELSE value END AS value, t AS overridden FROM (SELECT b.doc_id, b.value, c.value AS v, coalesce(c.value <> b.value AND {o.length_score('b.value')} = {o.length_score('c.value')}
 AND length(b.value) = length(c.value) AND b.n <= 3 AND c.n >= 2, false) AS t FROM ({_BEST}) b LEFT JOIN ({_COMMON}) c USING (doc_id))"""
)
def vote_override(s, d):
    return rank.overridden(rank.best_and_voted(candidate_histogram(s, d)), many=2)


@query(
    f"""WITH a AS (SELECT * FROM ({_COUNTS}) WHERE regexp_full_match(value, '[0-9]{{6}}')), b AS (SELECT DISTINCT doc_id, raw AS value FROM {{number_readings}})
 SELECT doc_id, value, n FROM a SEMI JOIN b USING (doc_id, value) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, value DESC) = 1"""
)
def shifted_consensus(s, d):
    r = fx(s, d, "number_readings")
    return rank.shifted_consensus(rank.histogram(r), r.select("doc_id", F.col("raw").alias("value")))


@query(
    f"""WITH s AS (SELECT doc_id, value, n, {o.length_score('value')} AS sc, length(value) AS l FROM ({_BEST})), f AS (SELECT doc_id, value AS v, n AS vn, {o.length_score('value')} AS fsc, length(value) AS fl FROM ({_COMMON}))
 SELECT doc_id, CASE WHEN t THEN v ELSE value END AS value, t AS replaced FROM (SELECT *, coalesce((fsc, fl) > (sc, l) OR (fsc = sc AND fl = l AND v <> value AND n <= 2 AND vn >= 2), false) AS t FROM s LEFT JOIN f USING (doc_id))"""
)
def finer_consensus(s, d):
    return rank.replaced(rank.best_and_voted(candidate_histogram(s, d)), many=2)


_WEIGHT = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"
_SCORED = f"SELECT *, {o.name_value_score('value', 'confidence', 'copies', _WEIGHT)} AS score FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, value) AS copies FROM {{candidates}})"


@query(
    f"""WITH s AS ({_SCORED}), u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, value ORDER BY round(score, 9) DESC, confidence DESC, length(value) DESC, ord) = 1)
 SELECT doc_id, value, source, round(score, 6) AS score, (row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, confidence DESC, length(value) DESC, ord))::INT AS rank FROM u"""
)
def name_candidate_rank(s, d):
    return rank.ranked_names(fx(s, d, "candidates"), WEIGHTS).select("doc_id", "value", "source", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT doc_id, value, copies FROM ({_SCORED}) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY copies DESC, score DESC, confidence DESC, length(value) DESC, ord) = 1")
def best_name_candidate(s, d):
    return rank.best_name(rank.scored_names(fx(s, d, "candidates"), WEIGHTS)).select("doc_id", "value", "copies")


@query(
    f"""WITH s AS ({_SCORED}), u AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, value ORDER BY round(score, 9) DESC, confidence DESC, length(value) DESC, ord) = 1),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, confidence DESC, length(value) DESC, ord) AS r FROM u)
 SELECT doc_id, min_by(value, r) AS value, string_agg(r || '|' || source || '|' || value || '|' || round(confidence * 1000)::BIGINT || '|' || round(score, 1), ';' ORDER BY r) AS candidates FROM k WHERE r <= 8 GROUP BY doc_id"""
)
def top_candidate_listing(s, d):
    listed = rank.top_listing(rank.ranked_names(fx(s, d, "candidates"), WEIGHTS))
    one = lambda x: F.concat_ws("|", x["rank"].cast("string"), x["source"], x["value"], F.round(x["confidence"] * 1000).cast("long").cast("string"), F.round(x["score"], 1).cast("string"))
    return listed.select("doc_id", "value", F.array_join(F.transform("candidates", one), ";").alias("candidates"))


_CASCADE = f"SELECT doc_id, crop % 3 AS k, CASE crop % 3 WHEN 0 THEN 'embedded' WHEN 1 THEN 'crop' ELSE 'page' END AS strategy, crop, {o.candidates('raw')} AS c FROM {{number_readings}}"


@query(f"SELECT doc_id, min_by(strategy, k) AS strategy, min_by(found, k) AS found FROM (SELECT doc_id, k, strategy, array_to_string(list_sort(list_distinct(flatten(list(c)))), ',') AS found FROM ({_CASCADE}) GROUP BY ALL) WHERE found <> '' GROUP BY doc_id")
def strategy_cascade(s, d):
    r = fx(s, d, "number_readings").select("doc_id", (F.col("crop") % 3).alias("strategy_rank"), numbers.candidates(F.col("raw")).alias("c"))
    each = r.groupBy("doc_id", "strategy_rank").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("c")))).alias("values"))
    name = F.element_at(F.array(F.lit("embedded"), F.lit("crop"), F.lit("page")), F.col("strategy_rank") + 1).alias("strategy")
    return rank.cascade(each.select("doc_id", "strategy_rank", name, "values")).select("doc_id", "strategy", joined("values").alias("found"))


# --- directory -----------------------------------------------------------------------------------

_READ = f"(SELECT doc_id, {o.best('c')} AS number, name, ocr_name, sheet_name, c FROM (SELECT *, {o.candidates('raw')} AS c FROM {{readings}}))"


def readings(s, d) -> DataFrame:
    r = fx(s, d, "readings")
    return r.select("doc_id", numbers.normalise(F.col("raw")).alias("number"), numbers.candidates(F.col("raw")).alias("candidates"), "name", "ocr_name", "sheet_name")


@query(f"SELECT r.doc_id, r.number, k.name AS directory_name FROM {_READ} r LEFT JOIN {{directory}} k USING (number)")
def directory_lookup_number(s, d):
    return dirs.by_number(readings(s, d).select("doc_id", "number"), known(s, d)).select("doc_id", "number", "directory_name")


@query(
    f"""SELECT r.doc_id, coalesce(string_agg(k.number, ',' ORDER BY k.ord), '') AS numbers FROM {o.keyed('{readings}', 'sheet_name')} r LEFT JOIN {o.DIRECTORY} k ON r.kf = k.kf AND r.kl = k.kl GROUP BY r.doc_id"""
)
def directory_lookup_name(s, d):
    docs = fx(s, d, "readings").select("doc_id", F.col("sheet_name").alias("name"))
    return dirs.by_name(docs, fx(s, d, "directory")).select("doc_id", joined("numbers").alias("numbers"))


@query(f"SELECT doc_id, number FROM {_READ} WHERE number IN (SELECT number FROM {{directory}})")
def directory_known(s, d):
    return dirs.known_only(readings(s, d).select("doc_id", "number"), known(s, d)).select("doc_id", "number")


@query(f"SELECT doc_id, number FROM {_READ} WHERE number NOT IN (SELECT number FROM {{directory}})")
def directory_unknown(s, d):
    return dirs.unknown_only(readings(s, d).select("doc_id", "number"), known(s, d)).select("doc_id", "number")


_EACH = f"(SELECT doc_id, unnest(c) AS candidate, generate_subscripts(c, 1) AS pos FROM {_READ})"


@query(f"SELECT candidate, match FROM {o.FUZZY % _EACH}")
def directory_fuzzy_match(s, d):
    return dirs.fuzzy(readings(s, d).select(F.explode("candidates").alias("candidate")), known(s, d))


@query(
    f"""WITH r AS (SELECT doc_id, c, kf, kl FROM {o.keyed(_READ, 'name')}), e AS (SELECT doc_id, kf, kl, unnest(c) AS candidate, generate_subscripts(c, 1) AS pos FROM r), z AS {o.FUZZY % _EACH},
 h AS (SELECT e.doc_id, CASE WHEN e.candidate = z.match AND (e.kf IS NULL OR (e.kf = k.kf AND e.kl = k.kl)) THEN 0 WHEN e.kf = k.kf AND e.kl = k.kl THEN 1 END AS phase, pos, z.match FROM e JOIN z USING (candidate) JOIN {o.DIRECTORY} k ON k.number = z.match),
 b AS (SELECT * FROM h WHERE phase IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY phase, pos, match) = 1)
 SELECT r.doc_id, b.match AS number, CASE b.phase WHEN 0 THEN 'known_direct' WHEN 1 THEN 'known_fuzzy_name' ELSE 'no_match' END AS method FROM r LEFT JOIN b USING (doc_id)"""
)
def directory_best_match(s, d):
    return dirs.best_match(readings(s, d).select("doc_id", "candidates", "name"), known(s, d))


@query(
    f"""WITH f AS (SELECT kf, kl, min_by(number, ord) AS number, min_by(name, ord) AS name FROM {o.DIRECTORY} WHERE kf IS NOT NULL GROUP BY ALL)
 SELECT r.doc_id, f.number, f.name AS directory_name FROM {o.keyed('{readings}', 'ocr_name')} r LEFT JOIN f ON r.kf = f.kf AND r.kl = f.kl"""
)
def name_fallback(s, d):
    docs = fx(s, d, "readings").select("doc_id", F.col("ocr_name").alias("name"))
    return dirs.name_fallback(docs, fx(s, d, "directory"), known(s, d))


_SHOWN = o.clean("CASE WHEN contains(k.name, ',') THEN trim(substr(k.name, instr(k.name, ',') + 1)) || ' ' || trim(substr(k.name, 1, instr(k.name, ',') - 1)) ELSE k.name END")


@query(
    f"""WITH r AS (SELECT * FROM {o.keyed(_READ, 'ocr_name')}), j AS (SELECT r.*, {_SHOWN} AS display, k.nn AS dn, k.kf AS df, k.kl AS dl, k.number IS NOT NULL AS hit FROM r LEFT JOIN {o.DIRECTORY} k USING (number)),
 f AS (SELECT *, coalesce(hit AND (nn = '' OR nn = dn OR (kf = df AND kl = dl)), false) AS fits FROM j)
 SELECT doc_id, number, CASE WHEN fits THEN display ELSE ocr_name END AS name, fits AS replaced, CASE WHEN fits AND display <> ocr_name THEN display || '|' || ocr_name ELSE ocr_name END AS candidates FROM f"""
)
def canonical_name(s, d):
    docs = readings(s, d).select("doc_id", "number", F.col("ocr_name").alias("name"), F.array("ocr_name").alias("candidates"))
    out = dirs.canonical_name(docs, known(s, d))
    return out.select("doc_id", "number", "name", "replaced", F.array_join("candidates", "|").alias("candidates"))


@query(
    f"""WITH e AS {_EACH}, z AS (SELECT candidate, list_sort(list(match)) AS ms FROM {o.FUZZY % _EACH} GROUP BY candidate),
 t AS (SELECT doc_id, pos, z.ms IS NULL AS last, unnest(CASE WHEN z.ms IS NULL OR list_contains(z.ms, e.candidate) THEN [e.candidate] ELSE z.ms END) AS v, generate_subscripts(CASE WHEN z.ms IS NULL OR list_contains(z.ms, e.candidate) THEN [e.candidate] ELSE z.ms END, 1) AS i FROM e LEFT JOIN z USING (candidate)),
 u AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY doc_id, v ORDER BY last, pos, i) = 1), g AS (SELECT doc_id, string_agg(v, ',' ORDER BY last, pos, i) AS candidates FROM u GROUP BY doc_id)
 SELECT r.doc_id, coalesce(g.candidates, '') AS candidates FROM {_READ} r LEFT JOIN g USING (doc_id)"""
)
def snap_to_directory(s, d):
    out = dirs.snapped(readings(s, d).select("doc_id", "candidates"), known(s, d))
    return out.select("doc_id", joined("candidates").alias("candidates"))


@query(
    f"""WITH n AS (SELECT doc_id, unnest([ocr_name, name, 'No Body']) AS name, generate_subscripts([1, 2, 3], 1) AS pos FROM {{readings}}), k AS (SELECT DISTINCT kf, kl FROM {o.DIRECTORY} WHERE kf IS NOT NULL),
 j AS (SELECT n.*, k.kf IS NULL AS u FROM {o.keyed('n', 'name')} n LEFT JOIN k ON n.kf = k.kf AND n.kl = k.kl), q AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY u, pos) = 1)
 SELECT doc_id, string_agg(name, '|' ORDER BY u, pos) AS names FROM q GROUP BY doc_id"""
)
def known_names_first(s, d):
    docs = fx(s, d, "readings").select("doc_id", F.array("ocr_name", "name", F.lit("No Body")).alias("names"))
    return dirs.first_known_names(docs, fx(s, d, "directory")).select("doc_id", F.array_join("names", "|").alias("names"))


# --- verification --------------------------------------------------------------------------------


def _candidates(s, d) -> DataFrame:
    r = readings(s, d)
    near = F.array("number", (F.col("number").try_cast("long") + 1).cast("string"), (F.col("number").try_cast("long") + 8).cast("string"))
    return r.select("doc_id", F.filter(near, lambda x: x.isNotNull() & (x != "")).alias("candidates"), F.filter(F.array("ocr_name"), lambda x: x != "").alias("names"), "name")


def _first_pairs(s, d) -> DataFrame:
    """Each directory hit beside the first name read."""
    first = _candidates(s, d).withColumn("ocr_name", F.coalesce(F.try_element_at("names", F.lit(1)), F.lit("")))
    return verify.lookup(first.withColumn("ocr_normal", names.normalise(F.col("ocr_name"))), known(s, d), None, "ocr_name", "ocr_normal")


@query()
def name_match_score(s, d):
    return rank.match_score(_first_pairs(s, d)).select("doc_id", "ord", "number", "m.*")


_HITS = f"""(SELECT e.doc_id, e.pos, e.number, k.nn AS b, k.kf AS bf, k.kl AS bl, e.nn AS a, e.kf AS af, e.kl AS al FROM (SELECT doc_id, nn, kf, kl, unnest(c) AS number, generate_subscripts(c, 1) - 1 AS pos
 FROM {o.keyed(f"(SELECT doc_id, ocr_name, list_filter([number, (try_cast(number AS BIGINT) + 1)::VARCHAR, (try_cast(number AS BIGINT) + 8)::VARCHAR], lambda x: x IS NOT NULL AND x <> '') AS c FROM {_READ})", 'ocr_name')}) e JOIN {o.DIRECTORY} k USING (number))"""


@query(
    f"""SELECT doc_id, pos::INT AS ord, number, a <> '' AND b <> '' AND coalesce(af = bf, false) AS first_name_match, a <> '' AND b <> '' AND coalesce(al = bl, false) AS last_name_match,
 CASE WHEN a = '' OR b = '' THEN 0 ELSE len(list_intersect(list_distinct({o.toks('a')}), list_distinct({o.toks('b')}))) END::INT AS overlap_count FROM {_HITS}"""
)
def name_match_features(s, d):
    """name_match_score without what hangs on the sequence similarity, which SQL can't say."""
    return rank.match_score(_first_pairs(s, d)).select("doc_id", "ord", "number", "m.first_name_match", "m.last_name_match", "m.overlap_count")


@query()
def candidate_rank(s, d):
    # A document's names are made unique once, not for each of its hits.
    return rank.ranked_hits(verify.lookup(_candidates(s, d).withColumn("names", names.unique(F.col("names"))), known(s, d), None, "names"))


@query()
def verification_tier_live(s, d):
    return verify.verify_live(_candidates(s, d).select("doc_id", "candidates", "names"), known(s, d))


_NEAR = f"(SELECT doc_id, name, list_filter([number, (try_cast(number AS BIGINT) + 1)::VARCHAR, (try_cast(number AS BIGINT) + 8)::VARCHAR], lambda x: x IS NOT NULL AND x <> '') AS c FROM {_READ})"


@query(
    f"""WITH r AS (SELECT * FROM {o.keyed(_NEAR, 'name')}), e AS (SELECT doc_id, nn, kf, kl, unnest(c) AS number, generate_subscripts(c, 1) AS pos FROM r),
 h AS (SELECT e.doc_id, e.pos, e.number, k.name AS directory_name, CASE WHEN e.kf = k.kf AND e.kl = k.kl THEN 'exact' WHEN {o.toks('e.nn')}[-1] = {o.toks('k.nn')}[-1] OR {o.toks('e.nn')}[1] = {o.toks('k.nn')}[1] THEN 'partial' ELSE 'none' END AS level FROM e JOIN {o.DIRECTORY} k USING (number)),
 b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE level WHEN 'exact' THEN 0 WHEN 'partial' THEN 1 ELSE 2 END, pos) = 1)
 SELECT r.doc_id, coalesce(b.number, r.c[1]) AS number, coalesce(b.directory_name, '') AS directory_name, coalesce(b.level, 'none') AS name_match, CASE b.level WHEN 'exact' THEN 'green' WHEN 'partial' THEN 'yellow' ELSE 'red' END AS status FROM r LEFT JOIN b USING (doc_id)"""
)
def verification_tier_batch(s, d):
    return verify.verify_batch(_candidates(s, d).select("doc_id", "candidates", "name"), known(s, d))


@query()
def verification_explained(s, d):
    docs = _candidates(s, d).select("doc_id", "candidates", "names", F.concat(F.lit("raw "), "name").alias("raw_capture"), F.lit("embedded").alias("extraction_method"))
    out = verify.explained(docs, known(s, d))
    tried = F.transform("candidates_tried", lambda x: F.concat(x["number"], F.lit("="), x["found"].cast("string")))
    listed = F.transform("candidate_results", lambda x: F.concat_ws("|", x["number"], x["match_level"], x["score"].cast("string")))
    return out.withColumns({"candidates_tried": joined(tried), "candidate_results": F.array_join(listed, ";")})


@query(
    f"""WITH c AS (SELECT doc_id, ocr_name, number, list_filter([number, (try_cast(number AS BIGINT) + 1)::VARCHAR, (try_cast(number AS BIGINT) + 8)::VARCHAR], lambda x: x IS NOT NULL AND x <> '') AS c FROM {_READ}),
 h AS (SELECT doc_id, count(*) AS n, min(k.name) AS sole FROM (SELECT doc_id, unnest(c) AS number FROM c) JOIN {{directory}} k USING (number) GROUP BY doc_id)
 SELECT c.doc_id, 'form ' || c.doc_id || '.pdf' AS filename, CASE WHEN n = 1 THEN sole WHEN n IS NULL THEN nullif(ocr_name, '') END AS resolved_name, CASE WHEN n >= 1 THEN 'directory' WHEN ocr_name <> '' THEN 'ocr' END AS resolved_name_source,
 coalesce(n, 0)::INT AS total_found, CASE WHEN c.doc_id % 4 = 0 THEN 'yes' END AS flag, CASE WHEN c.doc_id % 5 = 0 THEN 'data:image/png;base64,' || base64(encode('crop ' || c.doc_id)) END AS name_crop
 FROM c LEFT JOIN h USING (doc_id) WHERE coalesce(n, 0) <= 1"""
)
def response_assembly(s, d):
    """Answers of documents with one directory hit at most: with several the chosen one hangs on the sequence similarity."""
    c, i = _candidates(s, d), F.col("doc_id")
    docs = c.select("doc_id", F.concat(F.lit("form "), i.cast("string"), F.lit(".pdf")).alias("filename"), F.lit(4).alias("page_count"), F.lit("embedded").alias("extraction_method"), "names", "candidates", F.lit("").alias("raw_capture"))
    told = verify.explained(docs, known(s, d)).where("total_found <= 1")
    detected = docs.where(i % 4 == 0).select("doc_id", F.lit("yes").alias("prediction"), F.lit("template_V1").alias("method"), F.lit(0.9).alias("confidence"), F.lit(0.8).alias("yes_score"), F.lit(0.1).alias("no_score"), F.lit(0).alias("page"))
    crops = docs.where(i % 5 == 0).select("doc_id", F.create_map(F.lit("name_field"), sinks.data_uri(F.concat(F.lit("crop "), i.cast("string")).cast("binary"))).alias("crop_images"))
    out = verify.response(docs.join(told.select("doc_id"), "doc_id", "left_semi"), told, verify.flag_payload(detected), crops)
    return out.select("doc_id", "filename", "resolved_name", "resolved_name_source", "verification.total_found", F.col("flag.decision").alias("flag"), F.try_element_at("crop_images", F.lit("name_field")).alias("name_crop"))


@query("SELECT doc_id, concat_ws('+', CASE WHEN doc_id % 2 = 0 THEN 'embedded' END, CASE WHEN doc_id % 3 = 0 THEN 'known_direct' END, CASE WHEN doc_id % 5 = 0 THEN 'name_fallback' END) AS method FROM (SELECT o_orderkey AS doc_id FROM orders)")
def method_string(s, d):
    i = F.col("o_orderkey")
    return fx(s, d, "orders").select(i.alias("doc_id"), verify.method(("embedded", i % 2 == 0), ("known_direct", i % 3 == 0), ("name_fallback", i % 5 == 0)).alias("method"))


# --- truth ---------------------------------------------------------------------------------------

_CELL = "CASE doc_id % 4 WHEN 0 THEN 'RSO/' || number WHEN 1 THEN number WHEN 2 THEN 'Denied' ELSE number || '.0' END"


def truth_source(s, d) -> DataFrame:
    r = fx(s, d, "readings")
    return r.select(F.col("doc_id").alias("ord"), F.col("sheet_name").alias("name"), F.expr(_CELL).alias("number"), F.when(F.col("doc_id") % 5 == 0, "yes").otherwise("").alias("flag"))


@query(f"SELECT doc_id AS ord, {o.norm('sheet_name')} AS normal, CASE doc_id % 4 WHEN 2 THEN '' ELSE number END AS number, doc_id % 4 = 0 OR doc_id % 5 = 0 AS flagged FROM {{readings}}")
def truth_load(s, d):
    return truth.truth_rows(truth_source(s, d)).select("ord", "normal", "number", "flagged")


_SHEET2 = f"SELECT doc_id + 1 AS ord, {o.norm('sheet_name')} AS normal, CASE WHEN doc_id % 3 = 0 THEN number ELSE (number::BIGINT + 1)::VARCHAR END AS number, 1 AS sheet FROM {{readings}} WHERE doc_id % 2 = 0"


@query(f"SELECT ord, normal, number, sheet FROM (SELECT doc_id AS ord, {o.norm('sheet_name')} AS normal, number, 0 AS sheet FROM {{readings}} WHERE doc_id % 4 <> 2 UNION ALL {_SHEET2}) QUALIFY row_number() OVER (PARTITION BY normal, number ORDER BY sheet, ord) = 1")
def truth_combined(s, d):
    r = fx(s, d, "readings").where("doc_id % 2 = 0")
    other = F.when(F.col("doc_id") % 3 == 0, F.col("number")).otherwise((F.col("number").cast("long") + 1).cast("string"))
    second = r.select((F.col("doc_id") + 1).alias("ord"), F.col("sheet_name").alias("name"), other.alias("number"), F.lit("").alias("flag"))
    return truth.combined(truth_source(s, d), second).select("ord", "normal", "number", "sheet")


def matched(s, d) -> DataFrame:
    r = fx(s, d, "readings")
    docs = r.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("name")).otherwise("scan").alias("stem_name"), F.col("ocr_name").alias("extracted_name"), F.col("raw").alias("extracted_number"))
    return truth.match_truth(docs, truth.truth_rows(truth_source(s, d)))


_TRUTH = f"(SELECT doc_id AS ord, sheet_name, nn, kf, kl, CASE doc_id % 4 WHEN 2 THEN '' ELSE number END AS tnumber FROM {o.keyed('{readings}', 'sheet_name')})"
_MATCHED = f"""t AS (SELECT * FROM {_TRUTH}), c AS (SELECT doc_id, pos, nn, kf, kl FROM {o.keyed("(SELECT doc_id, unnest([CASE WHEN doc_id % 2 = 0 THEN name ELSE 'scan' END, ocr_name]) AS cand, unnest([0, 1]) AS pos FROM {readings})", 'cand')} WHERE nn <> ''),
 once AS (SELECT nn, min(ord) AS ord FROM t GROUP BY nn HAVING count(*) = 1),
 a AS (SELECT doc_id, pos AS phase, 0 AS m, once.ord FROM c JOIN once USING (nn) UNION ALL SELECT c.doc_id, pos + 2, -len(list_intersect({o.toks('c.nn')}, {o.toks('t.nn')})), t.ord FROM c JOIN t ON c.kf = t.kf AND c.kl = t.kl),
 best AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY phase, m, ord) = 1),
 x AS (SELECT r.doc_id, r.ocr_name, r.raw, best.phase, t.sheet_name AS source_name, t.tnumber, t.nn AS tn FROM {{readings}} r LEFT JOIN best USING (doc_id) LEFT JOIN t ON t.ord = best.ord)"""


@query(f"WITH {_MATCHED} SELECT doc_id, phase, source_name, tnumber AS expected_number FROM x")
def truth_match(s, d):
    return matched(s, d).select("doc_id", "phase", "source_name", "expected_number")


_EN, _ON = "coalesce(tnumber, '')", "en"
_NM = f"coalesce(source_name IS NOT NULL AND ({o.norm('ocr_name')} = tn OR {o.first_last(o.norm('ocr_name'), 'tn')}), false)"
_CATEGORY = f"""CASE WHEN source_name IS NULL THEN 'no_ground_truth_row' WHEN NOT name_match THEN 'name_mismatch' WHEN en = '' AND ex = '' THEN 'both_blank' WHEN en = ex THEN 'match' WHEN en = '' THEN 'expected_present_extracted_blank'
 WHEN ex = '' THEN 'expected_blank_extracted_present' WHEN length(en) = length(ex) AND {o.distance('en', 'ex')} = 1 THEN 'single_digit_ocr_mismatch' WHEN abs(length(en) - length(ex)) >= 2 THEN 'possible_workbook_update_or_document_disagreement' ELSE 'multi_digit_ocr_mismatch' END"""
_COMPARED = f"{_MATCHED}, y AS (SELECT *, {o.best('cc')} AS en, coalesce(tnumber, '') AS ex, {_NM} AS name_match FROM (SELECT *, {o.candidates('raw')} AS cc FROM x)), z AS (SELECT *, {_CATEGORY} AS category FROM y)"


@query(f"WITH {_COMPARED} SELECT doc_id, en AS extracted_number, ex AS expected_number, name_match, category FROM z")
def compare_truth(s, d):
    return truth.compared(matched(s, d)).select("doc_id", "extracted_number", "expected_number", "name_match", "category")


@query(f"WITH {_COMPARED} SELECT category, count(*) AS n, min(doc_id) AS first_ord FROM z GROUP BY category")
def category_histogram(s, d):
    return metrics.most_common(compare_truth(s, d), "category", "doc_id")


@query(
    f"""WITH {_COMPARED}, p AS (SELECT *, list_contains(cc, ex) AS present, doc_id % 2 = 0 AS seen FROM z WHERE category IN ('single_digit_ocr_mismatch', 'multi_digit_ocr_mismatch', 'expected_present_extracted_blank', 'possible_workbook_update_or_document_disagreement'))
 SELECT doc_id, category, present, CASE WHEN category = 'possible_workbook_update_or_document_disagreement' THEN 'likely_workbook_or_document_disagreement' WHEN present THEN 'candidate_ranking_issue' WHEN category = 'expected_present_extracted_blank' AND seen THEN 'localization_or_detection_issue'
 WHEN category = 'expected_present_extracted_blank' THEN 'field_missing_or_unreadable_in_document' WHEN en <> '' AND ex <> '' AND length(en) = length(ex) AND {o.distance('en', 'ex')} = 1 THEN 'single_digit_ocr_recognition_issue' ELSE 'ocr_recognition_or_localization_issue' END AS cause FROM p"""
)
def failure_cause(s, d):
    c = truth.compared(matched(s, d)).where(F.col("category").isin("single_digit_ocr_mismatch", "multi_digit_ocr_mismatch", "expected_present_extracted_blank", "possible_workbook_update_or_document_disagreement"))
    c = c.join(readings(s, d).select("doc_id", "candidates"), "doc_id").withColumn("present", F.array_contains("candidates", F.col("expected_number")))
    return c.select("doc_id", "category", "present", truth.failure_cause(F.col("category"), F.col("present"), F.col("extracted_number"), F.col("expected_number"), F.col("doc_id") % 2 == 0).alias("cause"))


_LEVEL = f"""CASE WHEN a = '' OR b = '' THEN 'none' WHEN a = b THEN 'exact' WHEN {o.first_last('a', 'b')} THEN 'first_last' WHEN list_sort({o.toks('a')}) = list_sort({o.toks('b')}) THEN 'token_reordered' WHEN len(list_intersect({o.toks('a')}, {o.toks('b')})) > 0 THEN 'partial' ELSE 'none' END"""


@query(
    f"""SELECT doc_id, {_LEVEL} AS level, a <> '' AND b <> '' AND (a = b OR list_sort({o.toks('a')}) = list_sort({o.toks('b')}) OR {o.first_last('a', 'b')}) AS evaluation_match, len(list_intersect({o.toks('a')}, {o.toks('b')}))::BIGINT AS overlap
 FROM (SELECT doc_id, {o.norm('ocr_name')} AS a, {o.norm('sheet_name')} AS b FROM {{readings}})"""
)
def truth_name_level(s, d):
    r = fx(s, d, "readings").select("doc_id", names.normalise(F.col("ocr_name")).alias("a"), names.normalise(F.col("sheet_name")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return r.select("doc_id", names.truth_level(a, b).alias("level"), names.evaluation_match(a, b).alias("evaluation_match"), text.overlap(a, b).cast("long").alias("overlap"))


# --- review --------------------------------------------------------------------------------------


def _fields(s, d) -> DataFrame:
    f = fx(s, d, "fields")
    none = F.array().cast("array<string>")
    picked = F.when(F.col("answer") == 0, F.array(F.lit("yes"))).when(F.col("answer") == 1, F.array(F.lit("no"))).when(F.col("answer") == 2, F.array(F.lit("yes"), F.lit("no"))).otherwise(none)
    options = F.when(F.col("kind") == "checkbox_group", F.array(F.lit("yes"), F.lit("no"))).otherwise(none)
    return f.select("doc_id", "field", "kind", "value", F.col("confidence").cast("double").alias("confidence"), "source", picked.alias("selected"), options.alias("options"))


_REVIEWED = """a AS (SELECT doc_id, bool_or(field = 'employment.has_employment_upon_release' AND answer = 0) AS emp, bool_or(field = 'addictions.has_addictions' AND answer = 0) AS addi FROM {fields} GROUP BY doc_id),
 f AS (SELECT f.*, f.field = 'contacts.case_manager_or_po' OR (f.field = 'employment.employer' AND NOT emp) OR (f.field = 'addictions.date_of_last_use' AND NOT addi) AS skip, len(regexp_extract_all(value, '[A-Za-z][A-Za-z''.-]*')) < 2 AS short FROM {fields} f JOIN a USING (doc_id)),
 v AS (SELECT *, CASE WHEN kind = 'checkbox_group' THEN CASE answer WHEN 2 THEN 'binary_checkbox_conflict' WHEN 3 THEN 'binary_checkbox_unresolved' END WHEN value = '' THEN CASE WHEN NOT skip THEN 'blank_text' END
 WHEN field = 'applicant.name' THEN CASE WHEN starts_with(source, 'name_crop_') OR confidence < 0.9 OR short THEN 'manual_name_review' END WHEN confidence < 0.8 THEN 'low_confidence_text' END AS status FROM f)"""
_SEVERITY = "CASE WHEN status IS NOT NULL THEN CASE WHEN status = 'blank_text' OR (status = 'manual_name_review' AND (short OR confidence < 0.75)) THEN 'high' ELSE 'medium' END END"


@query(f"WITH {_REVIEWED} SELECT doc_id, field, status, {_SEVERITY} AS severity FROM v")
def field_review(s, d):
    return review.field_reviews(_fields(s, d)).select("doc_id", "field", "status", "severity")


@query(f"WITH {_REVIEWED} SELECT doc_id, count(status) AS needs_review, count(*) FILTER ({_SEVERITY} = 'high') AS high_severity FROM v GROUP BY doc_id")
def review_summary(s, d):
    return review.summary(review.field_reviews(_fields(s, d)))


@query(
    f"""WITH {_REVIEWED}, r AS (SELECT doc_id, field, kind, confidence::DOUBLE AS confidence, source, CASE WHEN status = 'binary_checkbox_conflict' THEN 'yes, no' WHEN kind = 'checkbox_group' THEN '' ELSE value END AS value_preview,
 unnest(list_filter([status, CASE WHEN status = 'manual_name_review' AND confidence < 0.8 THEN 'low_confidence_text' END], lambda x: x IS NOT NULL)) AS status FROM v WHERE doc_id % 9 <> 0)
 SELECT * FROM r UNION ALL SELECT o_orderkey, '__document__', 'document', NULL, 'unknown', 'no fingerprint', 'unsupported_document' FROM orders WHERE o_orderkey % 9 = 0"""
)
def review_rows(s, d):
    docs = fx(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") % 9 != 0).alias("supported"), F.lit("unknown").alias("classification"), F.lit("no fingerprint").alias("reason"))
    return review.review_rows(docs, review.field_reviews(_fields(s, d)))


@query(
    """SELECT doc_id, max_by(path, ord) FILTER (variant = 'tight') AS tight, max_by(path, ord) FILTER (variant = 'context') AS context, max_by(path, ord) FILTER (variant = 'wide') AS wide,
 coalesce(max_by(path, ord) FILTER (variant = 'tight'), max_by(path, ord) FILTER (variant = 'context'), max_by(path, ord) FILTER (variant = 'wide')) AS preferred FROM {crops} GROUP BY doc_id"""
)
def review_queue(s, d):
    return review.review_queue(fx(s, d, "crops"))


@query(
    f"""WITH q AS (SELECT doc_id, max_by(path, ord) FILTER (variant = 'tight') AS tight, max_by(path, ord) FILTER (variant = 'context') AS context, max_by(path, ord) FILTER (variant = 'wide') AS wide FROM {{crops}} GROUP BY doc_id),
 j AS (SELECT q.*, r.ocr_name, r.name FROM q JOIN {{readings}} r USING (doc_id)), l AS (SELECT doc_id, coalesce(tight, context, wide) AS image, coalesce(nullif(ocr_name, ''), name) AS label FROM j WHERE doc_id % 3 IN (0, 1))
 SELECT doc_id, image, label, {o.norm('label')} AS normal FROM l"""
)
def queue_apply(s, d):
    q = review.review_queue(fx(s, d, "crops")).join(fx(s, d, "readings").select("doc_id", F.col("ocr_name").alias("label_text"), F.col("name").alias("expected_name")), "doc_id")
    status = F.when(F.col("doc_id") % 3 == 0, " Approved ").when(F.col("doc_id") % 3 == 1, "train").otherwise("maybe")
    return review.apply_queue(q.withColumns({"status": status, "normalized_label": F.lit(""), "path": F.lit("")}))


@query(
    """SELECT doc_id, classification, token_overlap, similarity_ratio, source_pdf FROM (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0 THEN 'housing_application_v1' ELSE 'application_packet' END AS classification, o_orderkey % 7 = 0 AS exact_match, o_orderkey % 5 = 0 AS first_last_match,
 o_orderkey % 4 AS token_overlap, round(o_totalprice, 0) AS similarity_ratio, 'f' || o_orderkey AS source_pdf FROM orders)
 ORDER BY CASE WHEN classification = 'housing_application_v1' THEN 0 ELSE 1 END, CASE WHEN exact_match THEN 1 ELSE 0 END + CASE WHEN first_last_match THEN 1 ELSE 0 END, token_overlap, similarity_ratio, source_pdf LIMIT 100"""
)
def failure_queue_topk(s, d):
    i = F.col("o_orderkey")
    rows = fx(s, d, "orders").select(
        i.alias("doc_id"), F.when(i % 2 == 0, "housing_application_v1").otherwise("application_packet").alias("classification"), (i % 7 == 0).alias("exact_match"), (i % 5 == 0).alias("first_last_match"),
        (i % 4).alias("token_overlap"), F.round("o_totalprice", 0).alias("similarity_ratio"), F.lit(0.5).alias("confidence"), F.concat(F.lit("f"), i.cast("string")).alias("source_pdf"),
    )
    return rank.failure_queue(rows, 100).select("doc_id", "classification", "token_overlap", "similarity_ratio", "source_pdf")


@query("SELECT doc_id, array_to_string(list_sort(list_filter(['no', 'yes'], lambda k: CASE WHEN k = 'yes' THEN l_tax ELSE l_discount END >= 0.055)), ',') AS selected FROM (SELECT l_orderkey * 10 + l_linenumber AS doc_id, l_tax, l_discount FROM lineitem)")
def checkbox_select(s, d):
    li = fx(s, d, "lineitem")
    scores = F.create_map(F.lit("yes"), F.col("l_tax"), F.lit("no"), F.col("l_discount"))
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), joined(review.select_options(scores, F.lit(0.055))).alias("selected"))


# --- metrics and splits --------------------------------------------------------------------------


@query(
    """WITH n AS (SELECT count(*) AS total_files, count(*) FILTER (status = 'evaluated') AS evaluated_files, count(*) FILTER (status = 'skipped_non_4page') AS skipped_non_4page, count(*) FILTER (status = 'error') AS errors,
 count(*) FILTER (status = 'evaluated' AND truth_found) AS truth_rows_matched, count(*) FILTER (status = 'evaluated' AND predicted_number <> '') AS predicted_found, count(*) FILTER (status = 'evaluated' AND truth_found AND number_match) AS exact_matches,
 count(*) FILTER (status = 'evaluated' AND truth_found AND predicted_number <> '') AS scored_found, count(*) FILTER (status = 'evaluated' AND verification_status = 'green') AS green, count(*) FILTER (status = 'evaluated' AND verification_status = 'yellow') AS yellow,
 count(*) FILTER (status = 'evaluated' AND verification_status = 'red') AS red FROM {outcomes})
 SELECT *, round(coalesce(exact_matches / nullif(truth_rows_matched, 0), 0), 4) AS accuracy_vs_truth, round(coalesce(predicted_found / nullif(evaluated_files, 0), 0), 4) AS found_rate, round(coalesce(exact_matches / nullif(scored_found, 0), 0), 4) AS accuracy_when_found FROM n"""
)
def eval_summary(s, d):
    return metrics.evaluation_summary(fx(s, d, "outcomes"))


@query("SELECT verification_status, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM {outcomes} GROUP BY ALL")
def tier_histogram(s, d):
    return metrics.histogram(fx(s, d, "outcomes"), "verification_status").withColumn("percent", F.round("percent", 6))


@query(
    """WITH c AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM (SELECT l.quality = 1 AS t, d.n_chars > 800 AS p FROM labels l JOIN documents d USING (doc_id)))
 SELECT tp, fp, fn, tn, round((tp + tn)::DOUBLE / greatest(1, tp + tn + fp + fn), 6) AS accuracy, round(tp::DOUBLE / greatest(1, tp + fp), 6) AS precision, round(tp::DOUBLE / greatest(1, tp + fn), 6) AS recall, round(tn::DOUBLE / greatest(1, tn + fp), 6) AS specificity,
 round((tp::DOUBLE / greatest(1, tp + fn) + tn::DOUBLE / greatest(1, tn + fp)) / 2, 6) AS balanced_accuracy,
 round(2 * (tp::DOUBLE / greatest(1, tp + fp)) * (tp::DOUBLE / greatest(1, tp + fn)) / greatest(tp::DOUBLE / greatest(1, tp + fp) + tp::DOUBLE / greatest(1, tp + fn), 1e-8), 6) AS f1,
 round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 6) AS mcc FROM c"""
)
def confusion_metrics(s, d):
    rows = fx(s, d, "labels").join(fx(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 800).alias("predicted"))
    out = metrics.confusion(rows)
    return out.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "specificity", "balanced_accuracy", "f1", "mcc")))


def _pairs(s, d) -> DataFrame:
    r = fx(s, d, "readings")
    return r.select(names.normalise(F.col("sheet_name")).alias("expected"), names.normalise(F.col("ocr_name")).alias("predicted"))


@query(
    f"""SELECT count(*) AS n, round(avg((e = p)::INT), 6) AS exact, round(avg(({o.first_last('e', 'p')})::INT), 6) AS first_last, round(avg(len(list_intersect({o.toks('e')}, {o.toks('p')}))), 6) AS mean_overlap, sum(len({o.toks('e')}))::BIGINT AS words, round(sum(levenshtein(e, p)) / greatest(1, sum(length(e))), 6) AS cer
 FROM (SELECT {o.norm('sheet_name')} AS e, {o.norm('ocr_name')} AS p FROM {{readings}})"""
)
def text_metrics(s, d):
    return metrics.text_metrics(_pairs(s, d)).select("n", "words", *(F.round(c, 6).alias(c) for c in ("exact", "first_last", "mean_overlap", "cer")))


_AS_LETTERS = "array_to_string(list_transform({0}, lambda x: chr(47 + list_position(w, x)::INT)), '')"


@query(
    f"""SELECT round(sum(levenshtein({_AS_LETTERS.format('a')}, {_AS_LETTERS.format('b')})) / sum(len(a)), 9) AS wer FROM (SELECT a, b, list_distinct(list_concat(a, b)) AS w
 FROM (SELECT {o.toks(o.norm('sheet_name'))} AS a, {o.toks(o.norm('ocr_name'))} AS b FROM {{readings}}))"""
)
def word_error_rate(s, d):
    p = _pairs(s, d)
    return p.agg(F.round(F.sum(udfs.word_distance("expected", "predicted")) / F.sum(F.size(text.tokens(F.col("expected")))), 9).alias("wer"))


@query()
def mean_similarity(s, d):
    return _pairs(s, d).agg(F.round(F.avg(udfs.sequence_ratio("predicted", "expected")), 9).alias("mean_ratio"))


@query("SELECT count(*) AS n, round(avg((number = raw)::INT), 6) AS exact, round(avg((number = regexp_replace(raw, '[^0-9]', '', 'g'))::INT), 6) AS digit_exact, round(sum(levenshtein(number, raw)) / greatest(1, sum(length(number))), 6) AS cer FROM {readings}")
def number_metrics(s, d):
    out = metrics.number_metrics(fx(s, d, "readings").select(F.col("number").alias("expected"), F.col("raw").alias("predicted")))
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("exact", "digit_exact", "cer")))


@query(
    """WITH r AS (SELECT CASE WHEN doc_id % 2 = 0 THEN number ELSE name END AS e, CASE WHEN doc_id % 2 = 0 THEN raw ELSE upper(ocr_name) END AS p FROM {readings}), q AS (SELECT e, p, regexp_full_match(e, '[0-9]+') AS d FROM r)
 SELECT count(*) FILTER (d) AS numbers, count(*) FILTER (NOT d) AS names, round(count(*) FILTER (d AND e = p)::DOUBLE / count(*) FILTER (d), 6) AS number_accuracy, round(count(*) FILTER (NOT d AND lower(e) = lower(p))::DOUBLE / count(*) FILTER (NOT d), 6) AS name_accuracy,
 round(sum(levenshtein(lower(e), lower(p))) / greatest(1, sum(length(e))), 6) AS cer FROM q"""
)
def mixed_metrics(s, d):
    even = F.col("doc_id") % 2 == 0
    r = fx(s, d, "readings").select(F.when(even, F.col("number")).otherwise(F.col("name")).alias("expected"), F.when(even, F.col("raw")).otherwise(F.upper("ocr_name")).alias("predicted"))
    return metrics.mixed_metrics(r).select("numbers", "names", *(F.round(c, 6).alias(c) for c in ("number_accuracy", "name_accuracy", "cer")))


def _hex_sql(n: int, key: str = "name") -> str:
    return f"('0x' || substr(sha256({key}), 1, {n}))::BIGINT"


_MD5 = "list_reduce(list_prepend(0, list_transform(string_split(md5(name), ''), lambda c: instr('0123456789abcdef', c) - 1)), lambda a, c: (a * 16 + c) % 100)"


@query(
    f"""SELECT doc_id, CASE WHEN {_hex_sql(2)} < 26 THEN 'test' WHEN {_hex_sql(2)} < 52 THEN 'val' ELSE 'train' END AS by_byte, CASE WHEN {_hex_sql(4)} % 100 < 80 THEN 'train' WHEN {_hex_sql(4)} % 100 < 90 THEN 'val' ELSE 'test' END AS by_percent,
 CASE WHEN {_MD5} < 80 THEN 'train' WHEN {_MD5} < 90 THEN 'val' ELSE 'test' END AS by_md5, ({_hex_sql(8)} % 5)::INT AS fold FROM {{readings}}"""
)
def dataset_splits(s, d):
    n = F.col("name")
    return fx(s, d, "readings").select("doc_id", splits.by_byte(n).alias("by_byte"), splits.by_percent(n).alias("by_percent"), splits.by_md5(n).alias("by_md5"), splits.fold(n).alias("fold"))


@query(
    f"""WITH p AS (SELECT person, ({_hex_sql(8, 'person')} % 5)::INT AS own FROM (SELECT DISTINCT name AS person FROM {{readings}})), f AS (SELECT person, own, unnest(range(0, 5))::INT AS fold FROM p),
 r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY sha256('val_split_' || fold || '_' || person), person) AS r, count(*) OVER (PARTITION BY fold) AS n FROM f WHERE own <> fold)
 SELECT person, fold, CASE WHEN r <= greatest(1, floor(n * 0.12)) THEN 'val' ELSE 'train' END AS part FROM r UNION ALL SELECT person, fold, 'test' FROM f WHERE own = fold"""
)
def fold_validation(s, d):
    return splits.fold_validation(fx(s, d, "readings").select(F.col("name").alias("person")))


@query("SELECT doc_id, quality, round((CASE WHEN quality = 1 THEN 0.6 ELSE 0.4 END)::DOUBLE / count(*) OVER (PARTITION BY quality), 9) AS weight FROM labels")
def sampling_weights(s, d):
    return splits.balance_weights(fx(s, d, "labels"), "quality", 0.6).select("doc_id", "quality", F.round("weight", 9).alias("weight"))


@query("SELECT count(*) AS folds, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m), 0), 6) AS deviation FROM (SELECT user_id % 5 AS f, avg(value) AS m FROM events GROUP BY ALL)")
def kfold_summary(s, d):
    folds = fx(s, d, "events").groupBy(F.col("user_id") % 5).agg(F.avg("value").alias("m"))
    return metrics.fold_summary(folds, "m").select("folds", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("SELECT run, round(e, 6) AS eval_balanced_accuracy, round(t, 6) AS test_balanced_accuracy FROM (SELECT user_id AS run, round(avg(value), 6) AS e, round(max(value), 6) AS t FROM events GROUP BY ALL) ORDER BY e DESC, t DESC, run LIMIT 5")
def leaderboard(s, d):
    runs = fx(s, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.round(F.avg("value"), 6).alias("eval_balanced_accuracy"), F.round(F.max("value"), 6).alias("test_balanced_accuracy"))
    return metrics.leaderboard(runs)


@query("SELECT lr, rank, dropout FROM (SELECT unnest(['1e-4', '3e-4', '1e-3']) AS lr) CROSS JOIN (SELECT unnest([8, 16]) AS rank) CROSS JOIN (SELECT unnest(['0', '0.1']) AS dropout)")
def hp_grid(s, d):
    axis = lambda name, values, kind: s.createDataFrame([(v,) for v in values], f"{name} {kind}")
    return metrics.grid(lr=axis("lr", ["1e-4", "3e-4", "1e-3"], "string"), rank=axis("rank", [8, 16], "int"), dropout=axis("dropout", ["0", "0.1"], "string"))


# --- boxes, pages and sources --------------------------------------------------------------------


def _box() -> Column:
    return boxes.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))


@query("SELECT doc_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM {boxes} GROUP BY doc_id")
def box_union(s, d):
    b = fx(s, d, "boxes").groupBy("doc_id").agg(F.collect_list(_box()).alias("b"))
    return b.select("doc_id", boxes.union_of(F.col("b")).alias("u")).select("doc_id", "u.*")


_PX = "greatest((floor(x1 * 1700) - 4)::INT, 0) AS x1, greatest((floor(y1 * 2200) - 4)::INT, 0) AS y1, least((floor(x2 * 1700) + 4)::INT, 1700) AS x2, least((floor(y2 * 2200) + 4)::INT, 2200) AS y2"


@query(f"SELECT doc_id, k, x1, y1, greatest(x2, x1 + 1) AS x2, greatest(y2, y1 + 1) AS y2 FROM (SELECT doc_id, k, {_PX} FROM {{boxes}})")
def box_pixels(s, d):
    return fx(s, d, "boxes").select("doc_id", "k", boxes.pixels(_box(), F.lit(1700), F.lit(2200), 4).alias("p")).select("doc_id", "k", "p.*")


@query("SELECT doc_id, k, round(a, 9) AS x1, round(b, 9) AS y1, round(greatest(a + 0.01, least(1.0, x2 + 0.05)), 9) AS x2, round(greatest(b + 0.01, least(1.0, y2 - 0.02)), 9) AS y2 FROM (SELECT *, least(greatest(x1 + 0.05, 0.0), 0.98) AS a, least(greatest(y1 - 0.02, 0.0), 0.98) AS b FROM {boxes})")
def box_shift(s, d):
    out = fx(s, d, "boxes").select("doc_id", "k", boxes.shifted(_box(), F.lit(0.2), F.lit(-0.02)).alias("p")).select("doc_id", "k", "p.*")
    return out.select("doc_id", "k", *(F.round(c, 9).alias(c) for c in ("x1", "y1", "x2", "y2")))


TEMPLATE = """fields:
  - {key: applicant.name, page: 1, kind: text, box: [0.1, 0.2, 0.5, 0.25]}
  - {key: release.parole, page: 2, kind: checkbox_group, boxes: {yes: [0, 0, 0.1, 0.1], no: [0.2, 0, 0.3, 0.1]}, threshold: 0.07}
  - {key: release.reason, page: 4, kind: multiline_text, box: [0.3, 0.4, 0.5, 0.6]}
  - {key: support.none, page: 3, kind: text}
"""


@query(
    """SELECT * FROM (VALUES (0, 'applicant.name', 1, 'text', '0.1,0.2,0.5,0.25', '', 0.055::DOUBLE), (1, 'release.parole', 2, 'checkbox_group', NULL, 'no=0.2,0.0,0.3,0.1;yes=0.0,0.0,0.1,0.1', 0.07::DOUBLE),
 (2, 'release.reason', 4, 'multiline_text', '0.3,0.4,0.5,0.6', '', 0.055::DOUBLE), (3, 'support.none', 3, 'text', NULL, '', 0.055::DOUBLE)) t(pos, key, page, kind, box, boxes, threshold)"""
)
def template_fields(s, d):
    t = readers.template(s, TEMPLATE)
    shown = F.transform(F.array_sort(F.map_keys("boxes")), lambda k: F.concat(k, F.lit("="), joined(F.try_element_at("boxes", k).cast("array<string>"))))
    return t.withColumns({"box": joined(F.col("box").cast("array<string>")), "boxes": F.array_join(shown, ";")})


@query("SELECT doc_id, page FROM {pages} WHERE doc_id IN (SELECT doc_id FROM {pages} GROUP BY doc_id HAVING sum(length(trim(text))) > 100)")
def digital_text_scan(s, d):
    return readers.digital(fx(s, d, "pages")).select("doc_id", "page")


@query("SELECT ord, number, name FROM (SELECT doc_id AS ord, CASE doc_id % 4 WHEN 2 THEN NULL ELSE number END AS number, sheet_name AS name FROM {readings}) WHERE number IS NOT NULL")
def directory_sheet(s, d):
    return readers.directory_sheet(truth_source(s, d).select("ord", "name", "number"))


_FORM_TEXT = "'Form IDOC#: ' || raw || chr(10) || 'see ' || number"


@query(f"SELECT doc_id, array_to_string({o.text_numbers('t')}, ',') AS found FROM (SELECT doc_id, {_FORM_TEXT} AS t FROM {{readings}})")
def number_from_text(s, d):
    page = F.concat(F.lit("Form IDOC#: "), "raw", F.lit("\nsee "), "number")
    return fx(s, d, "readings").select("doc_id", joined(numbers.text_candidates(page)).alias("found"))


@query("SELECT doc_id, md5('data:image/png;base64,' || base64(encode(text))) AS uri_md5 FROM documents")
def data_uri(s, d):
    return fx(s, d, "documents").select("doc_id", F.md5(sinks.data_uri(F.col("text").cast("binary")).cast("binary")).alias("uri_md5"))


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resumable_scan(s, d):
    return readers.todo(fx(s, d, "orders").select(F.col("o_orderkey").alias("doc_id")), fx(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id")))


@query()
def unicode_normalise(s, d):
    return fx(s, d, "documents").select("doc_id", F.md5(udfs.nfkc("text").cast("binary")).alias("text_md5"))


# --- extensions: not operators of the form engine ------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def extension_event_counts(s, d):
    return event_counts(fx(s, d, "events"))


def flagship(s: SparkSession, d: str) -> DataFrame:
    """Noisy numbers to candidates, fuzzy directory join, name ranking and tiers."""
    r = readings(s, d)
    snapped = dirs.snapped(r.select("doc_id", "candidates"), known(s, d))
    docs = snapped.join(r.select("doc_id", F.filter(F.array("ocr_name"), lambda x: x != "").alias("names")), "doc_id")
    return verify.verify_live(docs, known(s, d))


QUERIES["flagship_verification"] = flagship


from . import catalog_more, catalog_scans  # noqa: E402, F401  register the rest
