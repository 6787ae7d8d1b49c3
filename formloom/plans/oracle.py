"""Pieces of DuckDB SQL that say independently what the operators compute."""

from __future__ import annotations

from ..sources.fixtures import expand

# Fixed values, written out here once more: what the library has must equal them, not just itself.
NICKNAMES_SQL = """bob robert, bobby robert, rob robert, robby robert, bill william, billy william, will william, willy william, willie william,
 jim james, jimmy james, jamie james, joe joseph, joey joseph, mike michael, mikey michael, dan daniel, danny daniel, dave david, davey david,
 tom thomas, tommy thomas, dick richard, rick richard, ricky richard, rich richard, steve steven, stevie steven, tony anthony, chris christine,
 matt matthew, pat patrick, ed edward, eddie edward, ted edward, teddy edward, larry lawrence, jerry gerald, gerry gerald, terry terrence,
 terri terrence, charlie charles, chuck charles, chas charles, sam samuel, sammy samuel, jack john, johnny john, jon john, alex alexander, al albert,
 ben benjamin, benny benjamin, ken kenneth, kenny kenneth, tim timothy, timmy timothy, brad bradley, fred frederick, freddy frederick, jeff jeffrey,
 greg gregory, nick nicholas, andy andrew, drew andrew, ron ronald, ronny ronald, don donald, donny donald, liz elizabeth, beth elizabeth,
 lizzy elizabeth, kathy katherine, kate katherine, katie katherine, katy katherine, jenny jennifer, jen jennifer, sue susan, suzy susan,
 pam pamela, peggy margaret, maggie margaret, meg margaret, debbie deborah, deb deborah, barb barbara, becky rebecca, cindy cynthia,
 sandy sandra, mandy amanda, vicky victoria, vicki victoria, cathy catherine"""
CONFUSED, MEANT = r"ILJ/\|![]{}OQDCUSZB&$%GEAHT", "111111111110000052888866447"
CONFUSED_SHORT, MEANT_SHORT = r"OoIlLJZSBG/\|!", "00111125861111"
LENGTH_SCORES = {6: 5, 5: 4, 7: 4, 8: 3, 4: 2}
PROMPTS = [
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
PROMPTS_COMPACT = [
    "page3of4",
    "page4of4",
    "idocdatasensitivityclassification",
    "pleasecheckboxes",
]
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
#: Fields of the digital form: name, labels, lines below a label, rule, what is cut off (a pattern) and kind.
FORM = [
    ("applicant.name", ["Name"], 1, "name", "", "text"),
    ("applicant.idoc_or_le_number", ["IDOC or LE#"], 1, "id", "", "text"),
    ("applicant.gender", ["Gender"], 1, "gender", "", "text"),
    ("applicant.date_of_birth", ["Date of Birth"], 1, "date", "", "text"),
    ("applicant.age", ["Age:"], 1, "age", "", "text"),
    ("contacts.phone", ["Phone Number", "Phone:"], 1, "phone", "", "text"),
    ("contacts.email", ["E-mail"], 1, "email", "", "text"),
    ("contacts.emergency_contact", ["Name & Phone", "Emergency Contact:"], 3, "", "", "text"),
    ("housing.preferred_city", ["preferred city of"], 2, "", "(?i)housing:?\\s*", "text"),
    ("addictions.drug_of_choice", ["Alcohol and/or drugs"], 2, "", "(?i)of choice\\s*", "text"),
    ("addictions.date_of_last_use", ["Date of last use"], 1, "date", "", "text"),
    ("support.prescribed_medications", ["List any medications"], 2, "", "(?i)you are prescribed:?\\s*", "text"),
    ("employment.currently_employed", ["Are you currently", "employed?"], 2, "bool", "", "checkbox_group"),
    ("employment.employer", ["Employer:"], 1, "", "", "text"),
    ("criminal.convicted_misdemeanor_or_felony", ["convicted of a", "misdemeanor or"], 2, "bool", "", "checkbox_group"),
    ("criminal.under_influence_during_crime", ["influence of", "drugs/alcohol when"], 2, "bool", "", "checkbox_group"),
    ("contacts.case_manager", ["Name of Case"], 2, "", "(?i)Manager:?\\s*", "text"),
    ("supervision.on_probation_or_parole_while_housed", ["Will you be on", "probation or parole while"], 2, "bool", "", "checkbox_group"),
    ("supervision.probation_or_parole_officer", ["Probation/Parole"], 2, "", "(?i)Officer,?\\s*if known:?\\s*", "text"),
    ("supervision.reporting_county", ["Name of Idaho County"], 1, "", "(?i)you will be reporting to:?\\s*", "text"),
    ("requirements.sex_offender_registration", ["sex offender?", "register as a sex offender"], 2, "bool", "", "checkbox_group"),
    ("history.previously_resided", ["resided at"], 2, "bool", "", "checkbox_group"),
    ("history.alcoholic_or_addict", ["alcoholic/addict"], 2, "bool", "", "checkbox_group"),
    ("signing.signature_name", ["Name)", "Your Signature"], 3, "", "(?i)^\\(Type.*?\\)\\s*", "text"),
]
#: Words that a name of the digital form doesn't have, as a pattern.
NOT_NAMES = "gender|physical|address|male|female"
QUESTIONS = """requirements.sex_offender_registration 1 doyouneedtoregisterasasexoffender
requirements.backup_plan 1 isthisabackupplanforaninterstatecompactoranicedetainer
requirements.children_visitation_required 1 isatransitionalhomewithvisitationorovernightstaysforchildrenrequired
history.disciplined_or_discharged 1 haveyoueverbeendisciplinedandinvoluntarilydischargedfromatransitionalhome
history.violent_crimes_or_dor 1 haveyouhadanyviolentcrimesordisciplinaryoffensereportsdorforviolence
release.on_probation_or_parole 1 willyoubeonprobationorparolewhenyouarerelease
release.parole_hearing_completed 1 haveyouhadyourparolehearing
transportation.vehicle_on_site 1 willyouhaveavehicleonsite
background.served_in_military 1 haveyoueverservedinthemilitary
background.enrolled_at_va 1 enrolledattheva
employment.has_employment_upon_release 1 doyouhaveemploymentuponrelease
support.medical_or_mental_health_support 2 doyouneedmedicalormentalhealthsupport
support.communicable_disease 2 doyouhaveanycontagiousorcommunicablediseases
benefits.plan_to_apply 2 doyouplantoapplyforssissdissrbmedicareormedicaid
addictions.has_addictions 2 doyouhaveaddictions
addictions.under_influence_during_crime 2 wereyouundertheinfluenceofdrugsalcoholwhencrimewascommitted
preferences.faith_based_provider 2 wouldyoupreferafaithbasedhousingprovider
housing.previously_in_transitional_home 2 haveyoupreviouslyresidedinatransitionalhome"""


def sql(text: str) -> str:
    """Fixtures expanded, tables by name."""
    return expand(text, "%s")


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def clean(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def capture(x: str) -> str:
    return clean(f"trim({x}, ' _:-')")


def norm(x: str) -> str:
    v = clean(x)
    turned = f"CASE WHEN contains({v}, ',') THEN trim(substr({v}, instr({v}, ',') + 1)) || ' ' || trim(substr({v}, 1, instr({v}, ',') - 1)) ELSE {v} END"
    return f"lower({clean(f"regexp_replace({turned}, '[^A-Za-z0-9 ]+', ' ', 'g')")})"


def toks(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


NICK = "MAP {" + ", ".join("{}: {}".format(*map(lit, pair.split())) for pair in NICKNAMES_SQL.split(",")) + "}"


def first_key(n: str) -> str:
    """First part of the key of a normal form, null without one."""
    t = f"{toks(n)}[1]"
    return f"CASE WHEN len({toks(n)}) >= 2 THEN coalesce({NICK}[{t}], {t}) END"


def last_key(n: str) -> str:
    return f"CASE WHEN len({toks(n)}) >= 2 THEN {toks(n)}[-1] END"


def keyed(source: str, column: str) -> str:
    """Rows of a source with nn, kf and kl: normal form and key of a column."""
    return f"(SELECT *, {first_key('nn')} AS kf, {last_key('nn')} AS kl FROM (SELECT *, {norm(column)} AS nn FROM {source}))"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def candidates(x: str) -> str:
    raw = rf"CASE WHEN regexp_full_match(trim({x}), '\d+\.0+') THEN split_part(trim({x}), '.', 1) ELSE trim({x}) END"
    kept = rf"regexp_replace(upper({raw}), '[^A-Z0-9/\\|!&$%()\[\]{{}}]', '', 'g')"
    read = f"regexp_replace(translate({kept}, {lit(CONFUSED)}, {lit(MEANT)}), '[^0-9()]', '', 'g')"
    pick = lambda v, d: f"regexp_replace({v}, '[()]', '{d}')"
    all_ = ", ".join(pick(pick(read, a), b) for a in ("", "1") for b in ("", "1"))
    good = f"list_sort(list_distinct(list_filter([{all_}], lambda v: regexp_full_match(v, '[0-9]{{4,8}}'))))"
    return f"CASE WHEN length({kept}) = 0 OR length({digits(kept)}) < greatest(3, length({kept}) - 2) THEN [] ELSE {good} END"


def length_score(x: str) -> str:
    return f"CASE length({x}) " + " ".join(f"WHEN {n} THEN {s}" for n, s in LENGTH_SCORES.items()) + " ELSE 0 END"


def best(list_: str) -> str:
    """Of a list of candidates, by length score, length, value."""
    ranked = f"list_sort(list_transform({list_}, lambda v: (9 - {length_score('v')})::VARCHAR || (9 - length(v))::VARCHAR || v))"
    b = f"coalesce(substr({ranked}[1], 3), '')"
    return f"CASE WHEN ltrim({b}, '0') = '' THEN {b} ELSE ltrim({b}, '0') END"


def read_digits(x: str) -> str:
    v = rf"translate(regexp_replace({x}, '[^A-Za-z0-9/\\|!]', '', 'g'), {lit(CONFUSED_SHORT)}, {lit(MEANT_SHORT)})"
    return f"CASE WHEN regexp_full_match({v}, '[0-9]{{4,8}}') THEN {v} END"


def distance(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) <> length({b}) THEN greatest(length({a}), length({b})) WHEN length({a}) = 0 THEN 0 ELSE hamming({a}, {b}) END"


def first_last(a: str, b: str) -> str:
    return f"coalesce({toks(a)}[1] = {toks(b)}[1] AND {toks(a)}[-1] = {toks(b)}[-1], false)"


def name_value_score(v: str, confidence: str, copies: str, weight: str) -> str:
    n = f"len(regexp_extract_all({v}, '[A-Za-z][A-Za-z''.-]*'))"
    letters = f"length(regexp_replace({v}, '[^A-Za-z]', '', 'g'))"
    return (
        f"({weight} + least({n}, 4) * 3.0::DOUBLE + CASE WHEN {n} >= 2 THEN 4.0 ELSE -1.0 END + least({letters}, 24) * 0.18::DOUBLE"
        f" + {letters}::DOUBLE / greatest(1, length(replace({v}, ' ', ''))) * 4.0 + {confidence} * 3.0::DOUBLE + {copies} * 1.25::DOUBLE"
        f" - CASE WHEN regexp_matches({v}, '[0-9]') THEN 6.0 ELSE 0.0 END"
        f" - CASE WHEN regexp_matches(lower({v}), 'age|dob|ssn|idoc|gender|special|accommodation') THEN 8.0 ELSE 0.0 END"
        f" - CASE WHEN length({v}) < 5 THEN 4.0 ELSE 0.0 END)"
    )


DIRECTORY = keyed("{directory}", "name")
#: candidate, match of a source of candidates: deletion neighbourhoods, then the edit rules.
FUZZY = """(SELECT DISTINCT a.candidate, b.match FROM
 (SELECT candidate, unnest(list_distinct([candidate] || list_transform(range(1, length(candidate) + 1), lambda i: substr(candidate, 1, i - 1) || substr(candidate, i + 1)))) AS d FROM (SELECT DISTINCT candidate FROM %s)) a
 JOIN (SELECT match, unnest(list_distinct([match] || list_transform(range(1, length(match) + 1), lambda i: substr(match, 1, i - 1) || substr(match, i + 1)))) AS d FROM (SELECT DISTINCT number AS match FROM {directory})) b USING (d)
 WHERE damerau_levenshtein(candidate, match) <= 1 AND (length(candidate) = length(match) OR (length(match) = length(candidate) + 1 AND length(match) <= 6)
  OR (length(match) = length(candidate) - 1 AND length(candidate) > 5 AND length(match) >= 5)))"""


def text_numbers(x: str) -> str:
    """Numbers of a text: the labelled reading, then every 5 or 6 digit number, once each in order."""
    capture_ = r"([A-Za-z0-9.,\-/\\()\[\]{}!|&$%''\" ]{4,15})"
    labels = [r"(?i)ID[O0]C\s*#\s*:?\s*", r"(?i)IDOC\s*(?:or\s*LE\s*)?#\s*:?\s*", r"(?i)IDOC\s*Number\s*:?\s*"]
    raw = "coalesce(" + ", ".join(f"nullif(trim(regexp_extract({x}, '{p}{capture_}', 1)), '')" for p in labels) + ", '')"
    c, r = candidates("raw"), read_digits("raw")
    labelled = f"(SELECT CASE WHEN raw = '' THEN [] WHEN regexp_full_match(raw, '[0-9]{{4,8}}') THEN [raw] WHEN len({c}) > 0 THEN {c} WHEN ({r}) IS NOT NULL THEN [{r}] ELSE [] END FROM (SELECT {raw} AS raw))"
    every = rf"list_concat({labelled}, regexp_extract_all({x}, '\b(\d{{5,6}})\b', 1))"
    return f"(SELECT list_filter(l, lambda v, i: list_position(l, v) = i) FROM (SELECT {every} AS l))"


STOPWORDS = "name ame lame current status please check one relationship phone number include area code gender dob idoc doc information lack due needs helps support better reentry success special accommodations for your and id ido idc ob oa ao ht qd fit".split()
BLOCKED = "inform|ormat|status|relation|phone|number|accommod|support|reentry|success|current|please|check|include|lack|leav|conven|name"


def name_values(source: str) -> str:
    """doc_id, name of rows (doc_id, value): the best run of one to four name-like words, as a subquery."""
    leaks = r"(?i)\b(?:ne:?|me:?|Age:?|DOB:?|D\.?O\.?B:?|Last\s*\d+\s*digits?\s*(?:of\s*)?(?:SSN)?:?|IDoc#?:?|ID[O0]C#?:?|special\s*accommodations?|of\s*information|Gender:?|Date\s*of\s*Birth:?|Hia\d+)\b.*"
    v = clean(rf"regexp_replace(trim(regexp_replace(trim(regexp_replace(value, '{leaks}', '')), '[Aa]ge\s*:\s*\d.*$', '')), '[_|]+', ' ', 'g')")
    stop = "[" + ", ".join(map(lit, STOPWORDS)) + "]"
    return f"""(WITH r AS MATERIALIZED (SELECT doc_id, value FROM {source}), t AS (SELECT value, regexp_extract_all({v}, '[A-Za-z][A-Za-z''.-]*') AS ts FROM (SELECT DISTINCT value FROM r)),
 w AS (SELECT value, ts, s, w, ts[s : s + w - 1] AS x FROM (SELECT value, ts, unnest(range(1, len(ts) + 1)) AS s FROM t), (SELECT unnest([1, 2, 3, 4]) AS w) WHERE s + w - 1 <= len(ts)),
 p AS (SELECT *, list_sum(list_transform(x, lambda k: least(length(k), 10) + 3 - CASE WHEN length(k) <= 2 THEN 3 ELSE 0 END - CASE WHEN list_contains({stop}, lower(k)) THEN 6 ELSE 0 END - CASE WHEN regexp_matches(lower(k), '{BLOCKED}') THEN 6 ELSE 0 END))
  + CASE WHEN w >= 2 THEN 4 ELSE 0 END + CASE WHEN len(list_filter(x, lambda k: list_contains({stop}, lower(k)))) = 0 THEN 2 ELSE 0 END AS points FROM w),
 b AS (SELECT value, CASE WHEN len(x) > 2 AND length(x[1]) <= 2 THEN x[2:] ELSE x END AS x FROM p QUALIFY row_number() OVER (PARTITION BY value ORDER BY points DESC, s, w) = 1),
 g AS (SELECT value, x, list_filter(range(1, len(x) + 1), lambda i: NOT list_contains({stop}, lower(x[i])) AND NOT regexp_matches(lower(x[i]), '{BLOCKED}')) AS good FROM b),
 n AS (SELECT value, CASE WHEN len(good) > 0 THEN regexp_replace(array_to_string(x[list_min(good) : list_max(good)], ' '), '^[^A-Za-z]+|[^A-Za-z]+$', '', 'g') ELSE '' END AS name FROM g)
 SELECT r.doc_id, CASE WHEN length(regexp_replace(coalesce(name, ''), '[^A-Za-z]', '', 'g')) >= 2 THEN name ELSE '' END AS name FROM r LEFT JOIN n USING (value))"""
