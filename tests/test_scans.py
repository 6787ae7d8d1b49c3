"""Workbooks, staged extraction, neighbours of labels, and image operators against brute force."""

import collections
import datetime
import os
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from formloom.operators import neighbours, pages, staged, truth
from formloom.sources import stores, workbook

# --- staged extraction ---------------------------------------------------------------------------


class CountingReader:
    """Stands for an engine: strings by (document, resolution, variant); notes which documents it is asked for."""

    def __init__(self, spark, strings):
        self.spark, self.strings, self.asked = spark, strings, collections.defaultdict(list)

    def __call__(self, docs, dpi, variants):
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        self.asked[dpi] += ids
        rows = [(i, k, crop, variant, found) for i in ids for k, (crop, variant, found) in enumerate(self.strings.get((i, dpi), [])) if not variants or variant in variants]
        return self.spark.createDataFrame(rows, "doc_id long, ord int, crop string, variant string, strings array<string>")


def test_settled_documents_reach_no_later_stage(spark):
    docs = spark.createDataFrame([(1, "IDOC#: 123456", "form_standard"), (2, "", "form_standard"), (3, "", "form_left_shifted"), (4, "", "form_left_shifted"), (5, "", "form_standard"), (6, None, None)], "doc_id long, text string, subtype string")
    strings = {
        (1, 225): [("default", "", ["no number"])],
        (2, 225): [("default", "", ["98765 x"])],
        (2, 300): [("default", "", ["987654"])],
        (3, 225): [("default", "", ["111111"])],
        (3, 300): [("default", "", ["111111"])],
        (3, 400): [("shift", "inv", ["222222", "222222", "333333"]), ("shift", "dilated", ["222222"]), ("shift", "blur", ["444444"])],
        (4, 225): [("default", "", ["55555"])],
        (4, 400): [("shift", "inv", ["222222"]), ("shift", "dilated", ["333333"])],
        (5, 225): [("default", "", ["12345"])],
    }
    read = CountingReader(spark, strings)
    got = {r["doc_id"]: (r["value"], r["stage"]) for r in staged.scanned_number(docs, read).collect()}
    assert got == {1: ("123456", "page"), 2: ("987654", "fine"), 3: ("222222", "shifted"), 4: ("55555", None), 5: ("12345", None), 6: ("", None)}
    assert sorted(read.asked[225]) == [1, 2, 3, 4, 5, 6]
    assert sorted(read.asked[300]) == [2, 3, 4, 5, 6]
    assert sorted(read.asked[400]) == [3, 4]


def test_stages_end_when_nothing_is_open(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")

    def all_done(d):
        return d.select("doc_id", F.lit("x").alias("value"), F.lit(True).alias("done"))

    def never(d):
        raise AssertionError("asked for settled documents")

    assert sorted(tuple(r) for r in staged.escalate(docs, [staged.Stage("a", all_done), staged.Stage("b", never)]).collect()) == [(1, "x", "a"), (2, "x", "a")]


def test_stages_pass_on_what_they_found(spark):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(6)], "doc_id long, text string")

    def one(d):
        return d.where("doc_id < 4").select("doc_id", F.concat("text", F.lit("-1")).alias("value"), (F.col("doc_id") == 0).alias("done"), F.lit(7).alias("n"))

    def two(d):
        assert set(d.columns) == {"doc_id", "text", "value", "n"}
        return d.where("doc_id > 2").select("doc_id", F.concat(F.coalesce("value", F.lit("none")), F.lit("-2")).alias("value"), (F.coalesce("n", F.lit(0)) == 0).alias("done"))

    got = sorted(tuple(r) for r in staged.escalate(docs, [staged.Stage("one", one), staged.Stage("two", two)]).collect())
    assert got == [(0, "t0-1", "one"), (1, "t1-1", None), (2, "t2-1", None), (3, "t3-1-2", None), (4, "none-2", "two"), (5, "none-2", "two")]


def normal(raw):
    """Digits of readings without letters: all that these tests' engine gives."""
    return raw.lstrip("0") or raw if raw.isdigit() and 4 <= len(raw) <= 8 else ""


SCORES = {6: 5, 5: 4, 7: 3, 4: 2, 8: 1}


def score(v):
    from formloom.functions.numbers import LENGTH_SCORES

    return (LENGTH_SCORES.get(len(v), 0), len(v))


def votes(values):
    return collections.Counter(values)


def top(counts):
    return max(counts, key=lambda v: (score(v), counts[v], v))


def brute_scanned(text, subtype, strings):
    """The reference's rule, step by step, over digit readings."""
    plausible = lambda v: bool(re.fullmatch("[0-9]{5,6}", v))
    label = re.search(r"IDOC#[:\s]*([A-Za-z0-9]{4,10})", text or "", re.IGNORECASE)
    read = [("label", [label[1]] * 3)] if label else []
    read += [(crop, found) for crop, _, found in strings.get(225, [])]
    tokens = [(crop, normal(t)) for crop, found in read for x in found for t in re.findall("[A-Za-z0-9]{4,10}", x)]
    tokens = [(c, v) for c, v in tokens if plausible(v)]
    best = ""
    for _, v in tokens:
        if score(v) > score(best):
            best = v
    n, default = votes(v for _, v in tokens), votes(v for c, v in tokens if c == "default")
    if n:
        voted = top(n)
        if voted != best and score(voted) == score(best) and n[best] <= 3 and default[voted] >= 6:
            best = voted
    if score(best)[0] >= 5 and subtype != "form_left_shifted":
        return best
    fine = votes(v for _, _, found in strings.get(300, []) for x in found for v in map(normal, re.findall("[A-Za-z0-9]{4,12}", x)) if plausible(v))
    if fine:
        voted = top(fine)
        if score(voted) > score(best) or (best and voted != best and score(voted) == score(best) and fine[best] <= 2 and fine[voted] >= 8):
            return voted
    if subtype == "form_left_shifted":
        by = {v: [normal(t) for _, w, found in strings.get(400, []) if w == v for x in found for t in re.findall("[A-Za-z0-9]{4,14}", x)] for v in ("inv", "dilated")}
        six = [[v for v in by[k] if len(v) == 6] for k in ("inv", "dilated")]
        common = votes(v for v in six[0] if v in six[1])
        if common:
            return max(common, key=lambda v: (common[v], score(v), v))
    return best if plausible(best) else ""


def test_scanned_numbers_against_the_rule_step_by_step(spark):
    rng = random.Random(8)
    pool = ["123456", "123457", "654321", "12345", "1234", "1234567", "01012025"]
    rows, strings = [], {}
    for i in range(150):
        text = rng.choice(["", None, "IDOC#: 123456 and so on", "idoc# 99999", "IDOC#:12"])
        rows.append((i, text, rng.choice(["form_standard", "form_left_shifted"])))
        for dpi, variants in ((225, [""]), (300, [""]), (400, ["inv", "dilated"])):
            if rng.random() < 0.8:
                some = rng.sample(pool, 2)
                strings[i, dpi] = [(crop, v, [rng.choice(some) for _ in range(rng.choice([0, 1, 4, 9]))]) for crop in ("default", "tight") for v in variants]
    docs = spark.createDataFrame(rows, "doc_id long, text string, subtype string")
    got = {r["doc_id"]: r["value"] for r in staged.scanned_number(docs, CountingReader(spark, strings)).collect()}
    assert got == {i: brute_scanned(t, sub, {d: strings.get((i, d), []) for d in (225, 300, 400)}) for i, t, sub in rows}


def test_packets_are_read_again_only_where_they_may_change(spark):
    docs = spark.createDataFrame([(1, "123456", "packet_right_shifted"), (2, "123456", "packet_right_shifted"), (3, "123456", "packet_scanned_standard"), (4, "12345", "packet_right_shifted"), (5, "", "packet_right_shifted")], "doc_id long, value string, subtype string")
    read = CountingReader(spark, {(1, 400): [("mid", "blur", ["123457 123457", "123456"])], (2, 400): [("mid", "blur", ["654321"])]})
    assert {r["doc_id"]: r["value"] for r in staged.packet_override(docs, read).collect()} == {1: "123457", 2: "123456", 3: "123456", 4: "12345", 5: ""}
    assert set(read.asked[400]) == {1, 2}


# --- neighbours ----------------------------------------------------------------------------------

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


@pytest.mark.parametrize("band", [16.0, 128.0, 5000.0])
def test_neighbours_against_all_pairs(spark, band):
    rng = random.Random(2)
    lines = []
    for d in range(6):
        for k in range(60):
            x, y = rng.uniform(-30, 1600), rng.choice([rng.uniform(0, 2200), 300.0])
            lines.append((d, k, (x, y, x + rng.choice([0.0, 30.0, 400.0]), y + rng.choice([0.0, 0.4, 20.0, 200.0])), rng.choice(["IDOC or LE #", "123456", "ab", "", "a-b-c-d", "word"])))
    df = spark.createDataFrame(lines, f"doc_id long, line long, box {BOX}, text string")
    labels = df.where("line % 5 = 0").select("doc_id", F.col("line").alias("label"), "box")
    want = []
    for d, k, a, _ in lines:
        if k % 5:
            continue
        h = max(1.0, a[3] - a[1])
        for e, m, b, text in lines:
            if e != d:
                continue
            if abs(b[1] - a[1]) <= h * 1.4 and b[0] >= a[2] - 20:
                want.append((d, k, m, True, text))
            elif a[1] <= b[1] <= a[1] + h * 3 and b[0] >= a[0] and re.search("[0-9A-Za-z]{4,}", text):
                want.append((d, k, m, False, text))
    assert sorted(tuple(r) for r in neighbours.beside_or_below(labels, df, band=band).collect()) == sorted(want)
    first = {d: min(k for e, k, _, t in lines if e == d and "idocorle" in re.sub(r"\s+", "", t.lower())) for d in range(6)}
    got = {r["doc_id"]: (r["label"], r["box"]["x1"]) for r in neighbours.first_label(df, "idocorle").collect()}
    assert {d: k for d, (k, _) in got.items()} == first


def test_candidates_of_a_label(spark):
    rows = [(1, 0, (100.0, 100.0, 300.0, 120.0), "IDOC or LE #"), (1, 1, (290.0, 101.0, 400.0, 120.0), "12 34"), (1, 2, (90.0, 130.0, 400.0, 150.0), "left of it 1234"), (1, 3, (100.0, 150.0, 400.0, 170.0), "below 98765"), (1, 4, (100.0, 161.0, 400.0, 170.0), "too far below"), (1, 5, (120.0, 140.0, 130.0, 150.0), "x"), (2, 0, (0.0, 0.0, 1.0, 1.0), "nothing")]
    df = spark.createDataFrame(rows, f"doc_id long, line long, box {BOX}, text string")
    assert [(r["doc_id"], r["strings"]) for r in neighbours.label_candidates(df).collect()] == [(1, ["IDOC or LE #", "12 34", "below 98765"])]
    crop = neighbours.first_label(df, "idocorle").select(neighbours.label_crop(F.col("box"), F.lit(600), F.lit(200)).alias("c")).first()["c"]
    assert tuple(crop) == (60, 70, 600, 200)


def test_anchors_of_lines(spark):
    rng = random.Random(4)
    pool = ["IDOC or LE #", "I.D.O.C. Housing Application", "idoc or le idoc housing application", "1. Name: x", "Name", "2. Gender", "gender", "other", "name idoc or le", ""]
    lines, pagesize = [], []
    for d in range(40):
        pagesize.append((d, "application_packet", 1000, 2000))
        for k in range(rng.randint(0, 8)):
            lines.append((d, k, (float(rng.randint(0, 900)), float(rng.randint(0, 1900)), 950.0, 1950.0), rng.choice(pool)))
    want = []
    for d, kind, w, h in pagesize:
        found = {}
        for e, _, b, text in lines:
            small = "".join(c for c in text.lower() if c.isalnum())
            if e != d:
                continue
            if "idocorle" in small and "idoc_or_le" not in found:
                found["idoc_or_le"] = b
            elif "idochousingapplication" in small and "idoc" not in found:
                found["idoc"] = b
            elif small.startswith(("1name", "name")):
                found.setdefault("name", b)
            elif small.startswith(("2gender", "gender")):
                found.setdefault("gender", b)
        want += [(d, kind, key, b[0] / w, b[1] / h) for key, b in found.items()] or [(d, kind, None, None, None)]
    df = spark.createDataFrame(lines, f"doc_id long, line long, box {BOX}, text string")
    size = spark.createDataFrame(pagesize, "doc_id long, class string, w int, h int")
    got = neighbours.anchors(df, size)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    references = spark.createDataFrame([("application_packet", "name", 0.1, 0.2), ("application_packet", "idoc_or_le", 0.5, 0.3)], "class string, key string, x double, y double")
    assert pages.registration(got, references).count() == 40


# --- workbooks -----------------------------------------------------------------------------------


def test_workbooks_are_read_back(spark, tmp_path):
    rows = [(sheet, k, cells) for sheet, n in (("2025", 40), ("2026", 25), ("Recommendations", 3)) for k, cells in enumerate([["Name", "Supervision #", "RSO"]] + [[f"Näme <{k}> & \"x\"", None if k % 7 == 0 else f" 1234{k} ", *(["yes"] if k % 2 else [])] for k in range(n)])]
    df = spark.createDataFrame(rows, "sheet string, ord long, cells array<string>")
    path = str(tmp_path / "books")
    workbook.write_workbooks(df, path, 1)
    assert len(stores.listed(path, ".xlsx")) == 1 and os.listdir(path) != ["_temporary"]
    back = workbook.workbook(spark, path)
    width = max(len(c) for _, _, c in rows)
    padded = lambda c: [*c, *[None] * (width - len(c))]
    got = sorted((r["sheet"], r["row"], padded(r["cells"])) for r in back.collect())
    assert got == sorted((s, k + 1, padded(c)) for s, k, c in rows)
    assert {tuple(r["header"]) for r in back.collect()} == {("Name", "Supervision #", "RSO")}
    some = workbook.workbook(spark, path, ["2026"], 3, 5)
    assert [r["row"] for r in some.orderBy("row").collect()] == [3, 4, 5]
    assert some.rdd.getNumPartitions() == 1 and back.rdd.getNumPartitions() == 3
    cells = workbook.truth_cells(back, ["2025", "2026"])
    assert cells.count() == 65
    loaded = truth.combined(*(cells.where(F.col("sheet") == s) for s in ("2025", "2026")))
    assert loaded.where("sheet = 0").count() == 34
    assert workbook.directory_cells(back).count() == 65


def raw_book(path, sheets, shared=(), styles="", date1904=False):
    """A workbook written by hand: parts in other places and kinds of cells that our writer doesn't use."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><workbookPr date1904="{int(date1904)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{9 - k}" r:id="x{k}"/>' for k, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="x{k}" Type="t" Target="{"/xl/worksheets/" if k else "worksheets/"}s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        for k, (_, body) in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si>{s}</si>" for s in shared)}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}">{styles}</styleSheet>')


def test_cells_of_every_kind(spark, tmp_path):
    body = (
        '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="AA2"><v>12345</v></c></row>'
        '<row><c><v>1.5</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><f>1</f><v>sum</v></c><c s="1"><v>45000</v></c><c s="2"><v>45000.5</v></c><c s="0"><v>45000</v></c></row><row r="9"/>'
    )
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="171"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs>'
    raw_book(tmp_path / "a.xlsx", [("one", body), ("two & three".replace("&", "&amp;"), "")], ["<t>plain</t>", "<r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh>"], styles)
    got = [(r["sheet"], r["row"], r["header"], r["cells"]) for r in workbook.workbook(spark, str(tmp_path / "a.xlsx")).collect()]
    day = datetime.date(2023, 3, 15)
    assert got == [
        ("one", 2, [], [None, "plain", "rich text", *[None] * 23, "12345"]),
        ("one", 3, [], ["1.5", "TRUE", None, "sum", str(day), f"{day} 12:00:00", "45000"]),
    ]
    raw_book(tmp_path / "late.xlsx", [("s", '<row r="1"><c s="0"><v>0</v></c></row>')], styles='<cellXfs><xf numFmtId="14"/></cellXfs>', date1904=True)
    assert workbook.workbook(spark, str(tmp_path / "late.xlsx")).first()["cells"] == ["1904-01-01"]
    assert workbook.workbook(spark, str(tmp_path)).count() == 3
    assert workbook.workbook(spark, str(tmp_path), ["none"]).count() == 0


def test_headers_choose_columns(spark):
    rows = [("a", ["Last, First Name", "Supervision #"], ["Roe, Ann", "1"]), ("b", ["x name", "RSO", "Name", "Case number"], ["no", "yes", "Bob", "22"]), ("c", ["Number"], ["3"]), ("d", None, ["x"]), ("e", [None, "name"], ["x"])]
    df = spark.createDataFrame([("f", s, 0, 2, h, c) for s, h, c in rows], workbook.SCHEMA)
    got = sorted((r["sheet"], r["name"], r["number"], r["flag"]) for r in workbook.truth_cells(df).collect())
    assert got == [("a", "Roe, Ann", "1", ""), ("b", "Bob", "22", "yes"), ("e", "", "", "")]


def test_columns_of_cells():
    names = [workbook.column_name(k) for k in range(800)]
    assert names[:2] + names[25:28] + names[701:703] == ["A", "B", "Z", "AA", "AB", "ZZ", "AAA"]
    assert [workbook.column_number(f"{n}7") for n in names] == list(range(800))


class Failing(workbook.WorkbookWriter):
    """Writes half of a task's rows, then fails, twice."""

    def fill(self, rows, files, folder):
        return super().fill((r for k, r in enumerate(rows) if k < 3 or self.stop()), files, folder)

    def stop(self):
        raise OSError("lost")


def test_a_task_that_fails_leaves_no_file_and_no_double(tmp_path):
    path = str(tmp_path / "out")
    rows = [{"sheet": "s", "cells": [str(k)]} for k in range(9)]
    job = Failing(path, False)
    for _ in range(2):
        with pytest.raises(OSError, match="lost"):
            job.write(iter(rows))
    done = workbook.WorkbookWriter(path, False)
    done.job = job.job
    done.commit([done.write(iter(rows)), None])
    assert len(stores.listed(path, ".xlsx")) == 1 and os.listdir(path) == [os.path.basename(stores.listed(path, ".xlsx")[0])]
    with workbook.Book(stores.listed(path, ".xlsx")[0]) as book:
        assert [c for _, c in book.rows(book.sheets()[0][1])] == [[str(k)] for k in range(9)]
    other = workbook.WorkbookWriter(path, True)
    other.write(iter(rows))
    other.abort([])
    assert len(os.listdir(path)) == 1
    replaced = workbook.WorkbookWriter(path, True)
    replaced.commit([replaced.write(iter(rows[:1]))])
    assert len(os.listdir(path)) == 1


def test_fuzzy_join_sends_or_shuffles_the_directory(spark, monkeypatch):
    from formloom.operators import directory

    rows = [(str(n),) for n in range(12000, 12400, 3)] + [("123456789012",), ("9" * 40,)]
    known = spark.createDataFrame(rows, "number string")
    candidates = spark.createDataFrame([("12003",), ("12030",), ("1203",), ("120033",), ("123456789012",), ("9" * 40,), ("",), (None,)], "candidate string")
    both = []
    for most in (0, 1_200_000):
        monkeypatch.setattr(directory, "BROADCAST_NUMBERS", most)
        for longest in (32, 64):
            monkeypatch.setattr(directory, "BROADCAST_DIGITS", longest)
            both.append(sorted(tuple(r) for r in directory.fuzzy(candidates, known).collect()))
    assert both[0] == both[1] == both[2] == both[3]
    assert ("123456789012", "123456789012") in both[0] and ("9" * 40, "9" * 40) in both[0] and ("12003", "12003") in both[0]
