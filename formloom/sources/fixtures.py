"""Stand-ins for scanned forms, directories and truth sheets, derived from the star-schema tables.

Each is one SELECT in the SQL that Spark and DuckDB share, so both sides of a comparison start from the
same rows. Everything in them is invented.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_NL = "chr(10)"
SQL: dict[str, str] = {}
SQL["people"] = """SELECT o_orderkey AS id, CAST(o_orderkey + 11000 AS STRING) AS number,
 CASE o_orderkey % 8 WHEN 0 THEN 'Bob' WHEN 1 THEN 'Robert' WHEN 2 THEN 'Chris' WHEN 3 THEN 'Christopher'
 WHEN 4 THEN 'Katie' WHEN 5 THEN 'Maria' WHEN 6 THEN 'Jim' ELSE 'Ann' END AS first_name,
 translate(CAST((o_orderkey * 7919) % 100003 AS STRING), '0123456789', 'aeiourstln') AS last_name,
 o_totalprice AS price, o_orderpriority AS priority FROM {orders}"""
SQL["directory"] = """SELECT id AS ord, number, CASE id % 3 WHEN 0 THEN last_name || ', ' || first_name
 WHEN 1 THEN first_name || ' ' || last_name ELSE first_name || ' Q. ' || last_name END AS name FROM {people}"""
SQL["readings"] = """SELECT id AS doc_id, number, CASE id % 7 WHEN 0 THEN number WHEN 1 THEN translate(number, '01258', 'OIZSB')
 WHEN 2 THEN substr(number, 1, 2) || substr(number, 4) WHEN 3 THEN substr(number, 1, 1) || substr(number, 3, 1) || substr(number, 2, 1) || substr(number, 4)
 WHEN 4 THEN 'RSO/' || number WHEN 5 THEN number || '.0' ELSE substr(number, 1, 2) || '(' || substr(number, 3) END AS raw,
 CASE WHEN id % 5 = 0 THEN upper(last_name) || ' ' || first_name WHEN id % 5 = 1 THEN '' WHEN id % 5 = 2 THEN first_name || ' ' || substr(last_name, 1, 2)
 ELSE first_name || ' ' || last_name END AS ocr_name, first_name || ' ' || last_name AS name, last_name || ', ' || first_name AS sheet_name, price FROM {people}"""
SQL["typed"] = """SELECT id AS doc_id, CASE id % 6 WHEN 0 THEN ' 1' || CAST(id % 3 AS STRING) || '/2' || CAST(id % 9 AS STRING) || '/1987 ' WHEN 1 THEN '3-4-99' WHEN 2 THEN '1987-03-04'
 WHEN 3 THEN 'n/a' WHEN 4 THEN '1/2/3' ELSE '12/31/25' END AS day_text, CASE id % 5 WHEN 0 THEN 'Age ' || CAST(id % 120 AS STRING) WHEN 1 THEN '' WHEN 2 THEN '3 4' ELSE CAST(id % 1000 AS STRING) END AS age_text,
 CASE id % 4 WHEN 0 THEN 'xxx-' || CAST(1000 + id % 9000 AS STRING) WHEN 1 THEN '12345' ELSE CAST(id AS STRING) END AS last4_text,
 CASE id % 5 WHEN 0 THEN 'M' WHEN 1 THEN 'female' WHEN 2 THEN 'F.' WHEN 3 THEN 'unknown' ELSE 'MALE ' END AS gender_text,
 CASE id % 4 WHEN 0 THEN '(208) 555-' || CAST(1000 + id % 9000 AS STRING) WHEN 1 THEN '555-1' WHEN 2 THEN '+1 208 555 1234 99' ELSE ': 5551234_' END AS phone_text,
 CASE id % 4 WHEN 0 THEN first_name || '.' || last_name || '@example.org' WHEN 1 THEN 'a@b' WHEN 2 THEN ' x_1@mail.example.com ' ELSE 'none' END AS email_text,
 CASE id % 4 WHEN 0 THEN 'twin-falls' WHEN 1 THEN 'ada COUNTY' WHEN 2 THEN 'x1' ELSE '_canyon / owyhee_' END AS county_text,
 CASE id % 4 WHEN 0 THEN 'Boise or Nampa' WHEN 1 THEN 'near MERIDIAN' WHEN 2 THEN 'elsewhere' ELSE 'twin falls' END AS city_text FROM {people}"""
SQL["captured"] = """SELECT id AS doc_id, CASE id % 8 WHEN 0 THEN first_name || ' ' || last_name WHEN 1 THEN 'Name: ' || first_name || ' ' || last_name || ' Age: 34'
 WHEN 2 THEN '__' || first_name || '_' || last_name WHEN 3 THEN 'ame ' || first_name || ' ' || last_name || ' Gender: M' WHEN 4 THEN 'please check one'
 WHEN 5 THEN '12 34' WHEN 6 THEN first_name || ' de la ' || last_name || ' phone number' ELSE 'Page 3 of 4 ' || last_name END AS value FROM {people}"""
SQL["forms"] = f"""SELECT id AS doc_id, first_name || ' ' || last_name || ' 3-4-25' AS stem,
 'Today''s Date' || {_NL} || '0' || CAST(1 + id % 9 AS STRING) || '/12/2025' || {_NL} || 'IDOC or LE#' || {_NL} || number || {_NL} ||
 CASE WHEN id % 4 = 0 THEN '' ELSE 'Name' || {_NL} || first_name || ' ' || last_name || ' (Child)' || {_NL} END ||
 'Gender' || {_NL} || CASE WHEN id % 2 = 0 THEN 'Male' ELSE 'female' END || {_NL} || 'Date of Birth' || {_NL} || '1/2/1980' || {_NL} ||
 'Age: ' || CAST(10 + id % 100 AS STRING) || {_NL} || 'E-mail' || {_NL} || last_name || '@example.org' || {_NL} || 'Phone Number' || {_NL} ||
 CASE WHEN id % 3 = 0 THEN '12' ELSE '208555' || CAST(1000 + id % 9000 AS STRING) END || {_NL} || 'Employer: ' || priority || {_NL} ||
 'Are you currently' || {_NL} || CASE id % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' ELSE 'maybe' END || {_NL} || 'List any medications' || {_NL} || 'you are prescribed:' || {_NL} || 'none' || {_NL} ||
 'List all charges' || {_NL} || 'theft' || {_NL} || 'fraud ' || number || {_NL} || 'Name of Case' || {_NL} || 'Manager: ' || first_name AS text FROM {{people}}"""
SQL["pages"] = """SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page, CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN 'IDOC Housing Application. Current status: please check one. '
 WHEN conv_id % 5 = 1 AND turn = 0 THEN 'Jotform: Application for Housing ' WHEN conv_id % 5 = 2 AND turn = 0 THEN 'APPLICATION FOR HOUSING '
 WHEN conv_id % 5 = 3 AND turn = 4 THEN 'Application-for-Housing ' ELSE '' END || coalesce(text, '') AS text FROM {conversations}"""
SQL["answers"] = f"""SELECT doc_id, CAST(1 AS INT) AS page, CASE doc_id % 6 WHEN 0 THEN 'Do you need to register as a sex offender? Y/x N' WHEN 1 THEN 'Do you need to register as a sex offender? Y Nx'
 WHEN 2 THEN 'Have you ever served in the military?' || {_NL} || 'Y N' WHEN 3 THEN 'Have you had your parole hearing? y yes n' WHEN 4 THEN 'nothing asked'
 ELSE 'Enrolled at the VA? Y No if so' END || {_NL} || 'Will you have a vehicle on site? Y n/ and so on and on and on and on and on' AS text FROM {{documents}}"""
SQL["candidates"] = """SELECT l_orderkey AS doc_id, (l_linenumber * 1000000 + l_suppkey) * 100000 + l_partkey AS ord,
 CASE l_linenumber % 3 WHEN 0 THEN 'name_crop_tight' WHEN 1 THEN 'name_crop_wide' ELSE 'page_text' END AS source,
 CASE l_partkey % 6 WHEN 0 THEN 'Bob Stone' WHEN 1 THEN 'B0b Stone' WHEN 2 THEN 'Gender M' WHEN 3 THEN 'Ann' WHEN 4 THEN 'Maria del Rio' ELSE 'Bob Stone' END AS value,
 l_discount * 10 AS confidence FROM {lineitem}"""
SQL["number_readings"] = """SELECT l_orderkey AS doc_id, l_linenumber AS crop, CASE l_partkey % 5 WHEN 0 THEN CAST(100000 + l_orderkey AS STRING) WHEN 1 THEN CAST(100000 + l_orderkey AS STRING)
 WHEN 2 THEN translate(CAST(100000 + l_orderkey AS STRING), '0158', 'OISB') WHEN 3 THEN CAST(10000 + l_suppkey AS STRING) ELSE '01012025' END AS raw FROM {lineitem}"""
SQL["fields"] = """SELECT o_orderkey AS doc_id, f.field AS field, f.kind AS kind,
 CASE WHEN f.kind = 'checkbox_group' THEN '' WHEN (o_orderkey + f.n) % 4 = 0 THEN '' WHEN f.n = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Ann' ELSE 'Ann Stone' END ELSE 'text ' || CAST(o_orderkey AS STRING) END AS value,
 CASE WHEN (o_orderkey + f.n) % 3 = 0 THEN 0.95 WHEN (o_orderkey + f.n) % 3 = 1 THEN 0.78 ELSE 0.6 END AS confidence,
 CASE WHEN f.n = 0 AND o_orderkey % 2 = 0 THEN 'name_crop_tight' ELSE 'text' END AS source,
 CASE WHEN f.kind <> 'checkbox_group' THEN -1 ELSE (o_orderkey + f.n) % 4 END AS answer
 FROM {orders} CROSS JOIN (SELECT 0 AS n, 'applicant.name' AS field, 'text' AS kind UNION ALL SELECT 1, 'employment.employer', 'text' UNION ALL SELECT 2, 'employment.has_employment_upon_release', 'checkbox_group'
 UNION ALL SELECT 3, 'addictions.date_of_last_use', 'text' UNION ALL SELECT 4, 'addictions.has_addictions', 'checkbox_group' UNION ALL SELECT 5, 'contacts.case_manager_or_po', 'text' UNION ALL SELECT 6, 'release.reason', 'text') f"""
SQL["crops"] = """SELECT l_orderkey AS doc_id, (l_linenumber * 1000000 + l_suppkey) * 100000 + l_partkey AS ord, CASE l_partkey % 3 WHEN 0 THEN 'tight' WHEN 1 THEN 'context' ELSE 'wide' END AS variant,
 'crops/' || CAST(l_orderkey AS STRING) || '_' || CAST(l_partkey AS STRING) || '.png' AS path FROM {lineitem}"""
SQL["outcomes"] = """SELECT o_orderkey AS doc_id, CASE o_orderkey % 10 WHEN 0 THEN 'error' WHEN 1 THEN 'skipped_non_4page' ELSE 'evaluated' END AS status, o_orderkey % 3 <> 0 AS truth_found,
 CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_orderkey + 11000 AS STRING) END AS predicted_number, o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AS number_match,
 CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'O' THEN 'yellow' ELSE 'red' END AS verification_status FROM {orders}"""
SQL["boxes"] = """SELECT l_orderkey AS doc_id, l_partkey AS k, l_tax AS x1, l_discount AS y1, l_tax + l_quantity / 100 AS x2, l_discount + l_quantity / 200 AS y2 FROM {lineitem}"""

SQL["scanned"] = f"""SELECT id AS doc_id, 'IDoc#: ' || number || {_NL} || 'DOB: 1/' || CAST(1 + id % 28 AS STRING) || '/19' || CAST(60 + id % 40 AS STRING) || ' Age: ' || CAST(20 + id % 50 AS STRING) || {_NL} || 'Last 4 digits of SSN: ' || CAST(1000 + id % 9000 AS STRING) || {_NL} ||
 CASE WHEN id % 3 = 0 THEN 'housing needed: ' || priority || ' Have you had your Parole Hearing' ELSE '' END || {_NL} || '3. Personal Phone Number: 208' || CAST(id AS STRING) || ' 4. Emergency Contact Name & Relationship : ' || first_name || ', aunt' || {_NL} ||
 '5. Emergency Contact Phone Number (include area code) 209' || CAST(id AS STRING) || {_NL} || '6. x' || {_NL} || '7. What was your most recent conviction(s)? theft,' || {_NL} || ' fraud 8. What county was the crime committed in? ' || CASE WHEN id % 4 = 0 THEN 'Ada' ELSE '' END || ' 9. y' AS page1,
 CASE WHEN id % 2 = 0 THEN 'drug(s)of Choice: ' || last_name || ' Dateoflastuse: 3/4/20' || CAST(10 + id % 10 AS STRING) ELSE 'Date of last use 1-2-2019' END || {_NL} || '21. List any prescribed medications you currently take. ' || CASE WHEN id % 3 = 0 THEN '' ELSE first_name END || {_NL} || 'and iron' || {_NL} || '22. z' || {_NL} ||
 CASE WHEN id % 5 = 0 THEN '' ELSE '27. Providers' || {_NL} || 'House ' || first_name || {_NL} || CASE WHEN id % 5 = 1 THEN '' ELSE 'Bob ' || last_name || {_NL} END || '28. w' END || {_NL} || 'Date: ' || CAST(1 + id % 12 AS STRING) || '/8/2025' AS page2 FROM {{people}}"""
SQL["packets"] = f"""SELECT id AS doc_id, CASE WHEN id % 4 = 0 THEN '' ELSE first_name || ' ' || last_name || ' 3-4-25' END AS stem,
 'Today''s Date: ' || CASE WHEN id % 6 = 0 THEN 'none' ELSE '0' || CAST(1 + id % 9 AS STRING) || '/03/2025' END || {_NL} || 'IDOC or LE # ' || number || {_NL} || 'Name' || {_NL} || first_name || ' ' || last_name || {_NL} || 'Gender:' || {_NL} || 'Address' || {_NL} ||
 CASE id % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'f' ELSE 'x' END || {_NL} || 'Date of Birth 1/2/19' || CAST(50 + id % 50 AS STRING) || '.' || {_NL} || 'Age: ' || CAST(10 + id % 100 AS STRING) || {_NL} || 'Phone Number: ' || CASE WHEN id % 2 = 0 THEN '(208) 555-1234' ELSE '555-1234' END || {_NL} || 'E-mail ' || last_name || '@example.org' || {_NL} ||
 'Emergency Contact: Jane Roe 208 555 ' || CAST(1000 + id % 9000 AS STRING) || {_NL} || 'Name & Phone' || {_NL} || 'preferred city of' || {_NL} || CASE id % 5 WHEN 0 THEN 'twin falls' WHEN 1 THEN 'housing: BOISE' ELSE 'elsewhere' END || {_NL} || 'Have you previously' || {_NL} || CASE WHEN id % 2 = 0 THEN 'No' ELSE 'Yes' END || {_NL} || 'resided at the house' || {_NL} ||
 'Are you an ' || CASE WHEN id % 3 = 0 THEN 'Yes' ELSE '' END || ' alcoholic/addict' || {_NL} || 'Drug(s) of Choice: _' || CASE WHEN id % 7 = 0 THEN 'which?' ELSE last_name END || '_' || {_NL} || 'Date of Last Use: 3-4-20' || CAST(10 + id % 10 AS STRING) || {_NL} || CASE WHEN id % 2 = 0 THEN 'Date Housing Needed: 5/6/2025' ELSE '' END || {_NL} || 'List any medications you are prescribed: ' || priority AS page1,
 'register ' || CASE WHEN id % 3 = 0 THEN 'Yes' ELSE 'No' END || ' as a sex offender' || {_NL} || 'Are you currently employed?' || {_NL} || CASE WHEN id % 4 = 0 THEN 'no' WHEN id % 4 = 1 THEN 'yes and no' ELSE 'filler' END || {_NL} || 'filler' || {_NL} || 'filler' || {_NL} || 'convicted of a Yes misdemeanor or' || {_NL} || 'felony' || {_NL} || 'where you under the influence' || {_NL} || CASE WHEN id % 2 = 0 THEN 'yes' ELSE 'no' END || {_NL} || 'filler' || {_NL} || 'filler' || {_NL} ||
 'Will you be on No probation or parole' || {_NL} || 'Housing needed by 7/8/2025' || {_NL} || 'List all charges: theft' || {_NL} || 'fraud ' || number || {_NL} || 'violent charges: none at all' || {_NL} || 'Name of Case Manager: ' || CASE WHEN id % 5 = 0 THEN 'x, if applicable' ELSE first_name END || {_NL} || 'Name of Idaho County you will be reporting to: Ada' || {_NL} || 'Probation/Parole Officer Name, if known: ' || last_name || {_NL} ||
 CASE WHEN id % 2 = 0 THEN 'Your Signature (Type Name) ' ELSE 'Print Name: ' END || first_name AS page2, 'Date 1/' || CAST(1 + id % 28 AS STRING) || '/2025' AS page3 FROM {{people}}"""


def expand(sql: str, leaf: str = "{%s}") -> str:
    """Fixture names in braces as subqueries; tables stay as ``leaf`` has them."""

    def one(m: re.Match) -> str:
        name = m[1]
        return f"({expand(SQL[name], leaf)})" if name in SQL else leaf % name

    return re.sub(r"\{([a-z][a-z_]*)\}", one, sql)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture, or a table, of a data folder."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = expand(SQL[name])
    tables = set(re.findall(r"\{([a-z][a-z_]*)\}", sql))
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})
