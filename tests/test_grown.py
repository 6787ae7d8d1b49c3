"""What larger tables showed: whole numbers, ties, places, and batches of images."""

import contextlib

import pytest
from pyspark.sql import functions as F

from formloom.functions import numbers
from formloom.operators import evaluate
from formloom.plans import catalog
from formloom.sources import readers


@contextlib.contextmanager
def settings(spark, **values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize(("cell", "number"), [("RSO/1000004", "1000004"), ("RSO/ 12345", "12345"), ("RSO 123456/", "123456"), ("1000004.0", "1000004"), ("Denied", "")])
def test_flagged_numbers_are_whole(spark, cell, number):
    row = spark.createDataFrame([(cell,)], "cell string").select(numbers.number_and_flag(F.col("cell"), F.lit("")).alias("c")).first()
    assert row["c"]["number"] == number


def test_directory_numbers_are_whole(spark):
    cells = spark.createDataFrame([(1, "A B", "RSO/1000004"), (2, "C D", "RSO/12345"), (3, "E F", "Denied"), (4, "G H", "1000004.0")], "ord long, name string, number string")
    assert {r["ord"]: r["number"] for r in readers.directory_sheet(cells).collect()} == {1: "1000004", 2: "12345", 4: "1000004"}


def test_equal_crop_names_are_told_apart_by_value(spark):
    manifest = spark.createDataFrame([(f"f{i}", "tight", "train", "", "Ann Roe", "") for i in range(40)], "source_pdf string, variant string, split string, label_text string, expected_name string, normalized_label string")
    names = [f"{c}nn Roe" for c in "ABCDEFGHIJ"]
    read = [(f"f{i}", "tight", k, "crop", names[(i + j) % 10], 0.5, 1.0) for i in range(40) for k, j in enumerate((0, 3, 5))]
    candidates = spark.createDataFrame(read, "source_pdf string, variant string, ord long, source string, value string, confidence double, score double")
    # Partitions that aren't merged: equal candidates of a document meet in any order.
    with settings(spark, **{"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        got = evaluate.crop_manifest(manifest, candidates).collect()
    assert {r["source_pdf"]: r["extracted_name"] for r in got} == {f"f{i}": max(names[(i + j) % 10] for j in (0, 3, 5)) for i in range(40)}


def test_places_of_work_when_partitions_are_merged(spark, tmp_path):
    n = 40_000
    spark.range(n).select(F.col("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    small = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "48k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    with settings(spark, **small):
        got = {r["doc_id"]: r["place"] for r in catalog.QUERIES["work_order"](spark, str(tmp_path)).collect()}
    order = sorted(range(n), key=lambda i: (i % 3 != 0, i % 7, f"f{i}"))
    assert got == {i: k for k, i in enumerate(order)}


def test_images_are_handed_on_in_slices():
    import pyarrow as pa

    from formloom.functions import images
    from formloom.plans import catalog_scans

    texts = ["x" * 2400, None, "", "a"] * 100
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array(texts)], names=["id", "text"])
    got = list(images._slices(iter([batch]), "p", lambda t: [catalog_scans.page_of(t)], ("text",), False))
    assert len(got) > 3 and max(b.nbytes for b in got) < images.SLICE_BYTES + (1 << 20)
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["id"] for r in rows] == list(range(400))
    assert all(len(r["p"]["raw"]) == r["p"]["h"] * r["p"]["w"] == catalog_scans.page_of(t).size for r, t in zip(rows, texts, strict=True))


def test_pages_are_drawn_by_all_tasks(spark):
    from formloom.plans import catalog_scans

    pages = catalog_scans.drawn(spark.createDataFrame([(k, "word " * k) for k in range(50)], "doc_id long, text string").coalesce(1), "text")
    assert pages.rdd.getNumPartitions() > 1 and pages.columns == ["doc_id", "raw", "h", "w"]
    assert {r["doc_id"]: bytes(r["raw"]) for r in pages.collect()} == {k: catalog_scans.page_of("word " * k).tobytes() for k in range(50)}


def test_readings_are_worked_out_once(spark):
    """The regular expressions of a reading stand once in the plan, however many filters and counts use the number."""
    from formloom.operators import pages, rank

    strings = spark.createDataFrame([(1, "fixed_default", ["IDOC# 12(456 x"])], "doc_id long, crop string, strings array<string>")
    plan = pages.packet_number(strings)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1 and "Join" not in plan
    readings = spark.createDataFrame([(1, "12(456"), (1, "123456.0"), (1, "123456"), (1, "01012025"), (2, "0000"), (2, "004321"), (3, "x")], "doc_id long, raw string")
    assert rank.histogram(readings, dates=False)._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert [r["v"] for r in readings.select(numbers.normalise(F.col("raw")).alias("v")).collect()] == ["121456", "123456", "123456", "1012025", "0000", "4321", ""]


def test_best_match_meets_under_the_name_not_by_edits(spark):
    import random

    from formloom.operators import directory

    rng = random.Random(8)
    known = sorted({str(rng.randint(10**(n - 1), 10**(n - 1) + 60)) for n in (5, 6, 7, 8) for _ in range(40)} | {"7", "12a45", "123456789"})
    cands = sorted({str(rng.randint(10**(n - 1), 10**(n - 1) + 60)) for n in (4, 5, 6, 7, 8) for _ in range(25)} | {"", "01000", "10a00", "123456789", "1000"})
    numbers_known = spark.createDataFrame([(i, k, "Ann Roe" if i % 2 else "Bob Stone") for i, k in enumerate(known)], "ord long, number string, name string")
    k = directory.directory(numbers_known)
    docs = spark.createDataFrame([(i, [c], "Ann Roe") for i, c in enumerate(cands)], "doc_id long, candidates array<string>, name string")
    under = {x for i, x in enumerate(known) if i % 2}
    near = {}
    for r in directory.fuzzy(spark.createDataFrame([(c,) for c in cands], "candidate string"), k).collect():
        if r["match"] in under:
            near.setdefault(r["candidate"], []).append(r["match"])
    out = directory.best_match(docs, k)
    got = {r["doc_id"]: (r["number"], r["method"]) for r in out.collect()}
    assert got == {i: (c, "known_direct") if c in near.get(c, []) else (min(near[c]), "known_fuzzy_name") if c in near else (None, "no_match") for i, c in enumerate(cands)}
    assert {m for _, m in got.values()} == {"known_direct", "known_fuzzy_name", "no_match"}
    # Some hundred edits of a candidate were rows of the plan before.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("before") == 0


def test_labels_of_a_name_that_the_sheet_repeats(spark):
    from formloom.operators import datasets

    sheet = spark.createDataFrame([("ann roe", "A1"), ("ann roe", "A2"), ("ann roe", None), ("ann b. roe", "B1"), ("ann b. roe", "B2")], "clean string, label string")
    docs = spark.createDataFrame([(1, "Ann Roe 3-4-25"), (2, "Ann B. Roe 3-4-25"), (3, "Cher 3-4-25"), (4, "No One 3-4-25")], "doc_id long, stem string")
    rows = spark.createDataFrame([(1, "Cher", "12345")], "ord long, name string, number string")
    out = datasets.labelled(docs, rows, sheet)
    got = sorted((r["doc_id"], r["label"]) for r in out.collect())
    # Each label of the whole name as often as the first and last word have one; a missing one takes theirs.
    assert got == sorted([(1, "A1")] * 3 + [(1, "A2")] * 3 + [(1, x) for x in ("A1", "A2", "Ann Roe")] + [(2, "B1")] * 3 + [(2, "B2")] * 3 + [(4, "No One")])
    known = datasets.document_counts(out).collect()
    assert sorted(map(tuple, known)) == sorted(map(tuple, datasets.split_counts(datasets.training_crops(out)).collect()))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")  # rows aren't multiplied below a join


def test_known_candidates_have_no_edits_looked_up(spark, monkeypatch):
    from formloom.operators import directory

    asked, fuzzy = [], directory.fuzzy

    def seen(candidates, known):
        asked.extend(r["candidate"] for r in candidates.select("candidate").collect())
        return fuzzy(candidates, known)

    monkeypatch.setattr(directory, "fuzzy", seen)
    known = spark.createDataFrame([(n,) for n in ("12345", "12346", "22345", "99999")], "number string")
    docs = spark.createDataFrame([(1, ["55555", "12345", "12347"]), (2, ["99999"]), (3, []), (4, ["12345", "22346"])], "doc_id long, candidates array<string>")
    got = {r["doc_id"]: r["candidates"] for r in directory.snapped(docs, known).collect()}
    assert got == {1: ["12345", "12346", "55555"], 2: ["99999"], 3: [], 4: ["12345", "12346", "22345"]}
    assert sorted(asked) == ["12347", "22346", "55555"]


def test_failures_read_each_string_once(spark):
    from formloom.operators import truth

    compared = spark.createDataFrame([(1, "single_digit_ocr_mismatch", "12345", "12346"), (2, "expected_present_extracted_blank", "", "22222"), (3, "match", "1", "1"), (4, "multi_digit_ocr_mismatch", "55555", "55566")], "doc_id long, category string, extracted_number string, expected_number string")
    raws = spark.createDataFrame([(1, "12345"), (1, "12345"), (1, "12346"), (4, "5S555"), (4, "01234567")], "doc_id long, raw string")
    seen = spark.createDataFrame([(2, True)], "doc_id long, seen boolean")
    out = evaluate.failure_analysis(compared, raws, seen)
    got = {r["doc_id"]: tuple(r[c] for c in ("present", "expected_n", "candidate_n", "top_candidate", "top_n", "label_seen", "cause")) for r in out.collect()}
    assert got == {
        1: (True, 1, 2, "12345", 2, False, "candidate_ranking_issue"),
        2: (False, 0, 0, "", 0, True, "localization_or_detection_issue"),
        4: (False, 0, 2, "55555", 1, False, "ocr_recognition_or_localization_issue"),
    }
    assert out._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1  # three times before
    matched = spark.createDataFrame([(1, "A", "A B", "a b", "12(456", "121457"), (2, None, "A B", None, "1", None)], "doc_id long, source_name string, extracted_name string, truth_normal string, extracted_number string, expected_number string")
    failed = truth.compared(matched).where("category = 'single_digit_ocr_mismatch'")
    assert [(r["doc_id"], r["extracted_number"]) for r in failed.collect()] == [(1, "121456")]
    assert failed._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1


def test_truth_meets_by_form_and_key_in_one_join(spark):
    from formloom.operators import truth

    rows = [(1, "Roe, Ann"), (2, "Ann Roe"), (3, "Ann B. Roe"), (4, "Cher"), (5, "Bob Stone"), (6, "Robert X Stone"), (7, "Prince"), (8, "Prince")]
    known = truth.truth_rows(spark.createDataFrame([(i, n, str(10000 + i), "") for i, n in rows], "ord long, name string, number string, flag string"))
    docs = [(1, "scan", "Ann Roe"), (2, "Ann B Roe", "x"), (3, "", "CHER"), (4, "Robert Stone", None), (5, "Prince", ""), (6, "Rob X. Y. Stone", "Cher"), (7, None, "No One")]
    out = truth.match_truth(spark.createDataFrame(docs, "doc_id long, stem_name string, extracted_name string"), known)
    got = {r["doc_id"]: (r["phase"], r["expected_number"]) for r in out.collect()}
    # A form of one row by itself; else the key, with most words shared, then the first row; a single word that is repeated meets none.
    assert got == {1: (3, "10001"), 2: (0, "10003"), 3: (1, "10004"), 4: (2, "10006"), 5: (None, None), 6: (1, "10004"), 7: (None, None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_edits_of_digits_are_looked_up_as_bits(spark):
    import random

    from formloom.operators import directory

    rng = random.Random(5)
    known = {str(rng.randint(10**(n - 1), 10**(n - 1) + 90)) for n in (4, 5, 6, 7, 8) for _ in range(40)} | {"0", "00012", "012345", "99999999", "12a45", "", "123456789", "10-00", "11111", "111111"}
    cands = {str(rng.randint(10**(n - 1), 10**(n - 1) + 90)) for n in (4, 5, 6, 7, 8) for _ in range(20)} | {"", "0", "00012", "0012", "10a00", "12a45", "12b45", "1234567890", "123456789", "11111", "11112", "1x111", "01000"}

    def near(x):
        out = {x}
        n = len(x)
        if n <= 8:
            out |= {x[:i] + d + x[i + 1 :] for i in range(n) for d in "0123456789"}
            out |= {x[:i] + d + x[i:] for i in range(n + 1) for d in "0123456789" if n + 1 <= 6}
            out |= {x[:i] + x[i + 1 :] for i in range(n) if n > 5}
            out |= {x[:i] + x[i + 1] + x[i] + x[i + 2 :] for i in range(n - 1)}
        return out & known

    rows = spark.createDataFrame([(k,) for k in sorted(known)], "number string")
    out = directory.fuzzy(spark.createDataFrame([(c,) for c in sorted(cands)] * 2 + [(None,)], "candidate string"), rows)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == {(c, m) for c in cands for m in near(c)}
    # Some hundred edits of each candidate were told apart by a shuffle before.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan and plan.count("Aggregate [candidate") <= 5


def test_similarity_is_that_of_sequence_matcher():
    import random
    from difflib import SequenceMatcher

    from formloom.functions import udfs

    rng = random.Random(3)
    words = ["".join(rng.choice("abcé ") for _ in range(rng.choice((0, 1, 3, 8, 14, 30)))) for _ in range(300)] + ["ab" * 120, "ba" * 110]
    for a in words:
        b = rng.choice(words)
        assert udfs.similarity(a, b) == SequenceMatcher(None, a, b).ratio(), (a, b)


def test_live_tiers_meet_the_directory_once(spark):
    from formloom.operators import directory, verify

    known = directory.directory(spark.createDataFrame([(1, "12345", "Ann Roe"), (2, "12346", "Stone, Bob"), (3, "12347", "Cher")], "ord long, number string, name string"))
    docs = [(1, ["12346", "12345"], ["ann roe", "ANN  ROE", "Bob Stone"]), (2, ["99999", "12347"], []), (3, ["99999"], ["Cher"]), (4, None, ["Cher"]), (5, [None, "12347"], [None, "cher"])]
    out = verify.verify_live(spark.createDataFrame(docs, "doc_id long, candidates array<string>, names array<string>"), known)
    got = {r["doc_id"]: (r["number"], r["match_level"], r["total_found"], r["status"]) for r in out.collect()}
    assert got[1] == ("12346", "exact", 2, "green") and got[2] == ("12347", "none", 1, "yellow") and got[3] == ("99999", "none", 0, "red") and got[5] == ("12347", "exact", 1, "green")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("max_by(") == 1  # twice before


def test_a_page_is_folded_once_for_all_questions(spark):
    from formloom.operators import extract

    rows = [(1, 1, "Do you need to register as a sex offender? Y/x N\nHave you had your\nparole hearing? y yes n"), (2, 1, "nothing"), (3, 2, "Do you have\naddictions? Y\nno"), (4, 1, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page int, text string")
    out = extract.checkbox_overrides(pages)
    got = sorted((r["doc_id"], r["field"], r["answer"]) for r in out.collect())
    want = []
    for field, (page, anchor) in extract.QUESTIONS.items():
        each = pages.where(F.col("page") == page).select("doc_id", extract.binary_answer(F.col("text"), F.lit(anchor)).alias("a")).where("a is not null")
        want += [(r["doc_id"], field, r["a"]) for r in each.collect()]
    assert got == sorted(want) and got
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^a-z0-9/]+") == 2  # once a page, once a line; again in a filter of each question before


def test_fields_are_worked_out_once_and_labels_found_in_folded_text(spark):
    from formloom.operators import extract

    page = "\U0001f600 naïve\r\nIDOC or LE # 12345\nGENDER: \n Address\nMALE\x85age: 34\nE-Mail Ann@Example.org\nare you AN\nalcoholic/addict no\nList Any Medications you are prescribed: Iron Pill"
    second = "name of case MANAGER: Bo\nLIST ALL CHARGES: Theft\nand Fraud\nWill you be on probation"
    docs = spark.createDataFrame([(1, page, second, None), (2, "IDOC OR LE # 99999\nAge 20", None, ""), (3, None, "DATE 1/2/2025", "Ann Roe 3-4-25")], "doc_id int, text string, page2 string, stem string")
    out = extract.packet_form(docs)
    got = {(r["doc_id"], r["field"]): r["value"] for r in out.collect() if r["value"]}
    assert got == {
        (1, "applicant.idoc_or_le_number"): "12345",
        (1, "applicant.gender"): "Male",
        (1, "applicant.age"): "34",
        (1, "contacts.email"): "Ann@Example.org",
        (1, "support.prescribed_medications"): "Iron Pill",
        (1, "history.alcoholic_or_addict"): "no",
        (1, "contacts.case_manager"): "Bo",
        (1, "criminal.charges"): "Theft and Fraud",
        (2, "applicant.idoc_or_le_number"): "99999",
        (2, "applicant.age"): "20",
        (3, "applicant.name"): "Ann Roe",
        (3, "signing.application_date"): "1/2/2025",
    }
    forms = extract.digital_form(docs)
    for rows, label in ((out, "emergency contact, 0"), (forms, "gender, 0")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        # Before: in the explode, as often as a rule or a choice used the value.
        assert "regexp" not in plan[: plan.index("element_at")] and plan.count(label) == 1


def test_fields_that_stand_together_are_nested_without_a_shuffle(spark):
    import json

    from formloom.operators import extract

    docs = spark.createDataFrame([(1, "Name\nAnn Stone\nAge: 34", None), (2, None, "Bo Roe 3-4-25"), (3, "Name of Case\nManager: \"Q\"\nList all charges\na\nb", "")], "doc_id int, text string, stem string")
    out, rows = extract.nested(extract.form_values(docs)), extract.nested(extract.digital_form(docs))
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (out, rows)]
    assert [p.count("Aggregate") for p in plans] == [0, 1]  # two of rows before
    got = {r["doc_id"]: r["extracted"] for r in out.collect()}
    assert got == {r["doc_id"]: r["extracted"] for r in rows.collect()}
    read = {k: json.loads(v) for k, v in got.items()}
    assert read[1]["applicant"] == {"age": "34", "date_of_birth": "", "gender": "", "idoc_or_le_number": "", "name": "Ann Stone"}
    assert read[2]["applicant"]["name"] == "Bo Roe" and read[3]["applicant"]["name"] == "of Case" and read[2]["criminal"]["charges"] == ""
    assert (read[3]["contacts"]["case_manager"], read[3]["criminal"]["charges"]) == ('"Q"', "a b")
    assert list(read[1]) == sorted(read[1])


def test_all_candidates_are_looked_up(spark):
    from formloom.operators import directory, verify

    known = directory.directory(spark.createDataFrame([(k, str(20000 + k), f"Bob Stone{k}") for k in range(8)] + [(9, "30000", "Ann Roe")], "ord long, number string, name string"))
    listed = [str(20000 + k) for k in range(8)] + ["30000"]
    docs = spark.createDataFrame([(1, listed, ["Ann Roe"], "Ann Roe"), (2, ["1"] * 7 + ["30000"], ["Ann Roe"], "Ann Roe")], "doc_id long, candidates array<string>, names array<string>, name string")
    live = {r["doc_id"]: (r["number"], r["match_level"], r["total_found"], r["status"]) for r in verify.verify_live(docs, known).collect()}
    assert live == {1: ("30000", "exact", 9, "green"), 2: ("30000", "exact", 1, "green")}  # yellow and red before: six were tried
    told = {r["doc_id"]: r for r in verify.explained(docs.withColumns({"raw_capture": F.lit(""), "extraction_method": F.lit("")}), known).collect()}
    assert [x["number"] for x in told[1]["candidates_tried"]] == listed and len(told[1]["candidate_results"]) == 9 and told[2]["status"] == "green"
    assert {r["doc_id"]: r["status"] for r in verify.verify_batch(docs.drop("names"), known).collect()} == {1: "green", 2: "green"}


def test_images_of_one_size_are_worked_on_together():
    import numpy as np

    from formloom.functions import images, pixels
    from formloom.plans import catalog_scans

    rng = np.random.default_rng(5)
    for h, w in ((1, 1), (1, 9), (2, 3), (8, 320), (30, 41), (200, 170)):
        stack = np.where(rng.random((4, h, w)) < 0.2, rng.integers(0, 256, (4, h, w)), 255).astype(np.uint8)
        stack[0], stack[1, h // 2] = 7, 0
        assert pixels.thresholds(stack).tolist() == [pixels.otsu(x) for x in stack]
        for many in (False, True):
            found = images.cleaned(stack, many)  # one image at a time before
            assert found.shape == (4, 2 * h, 2 * w) and all(np.array_equal(a, images.cleaned(x, many)) for a, x in zip(found, stack, strict=True))
        assert all(np.array_equal(images.doubled_bits(x > 99), images.doubled(np.where(x > 99, 255, 0).astype(np.uint8))) for x in stack)
    texts = [None, "", "a", "Ann Roe", "\0 é\n" * 15, "\U0001f600 x" * 30, "word " * 700]
    assert all(a.shape == b.shape and np.array_equal(a, b) for a, b in zip(catalog_scans.pages_of(texts), map(catalog_scans.page_of, texts), strict=True))


def test_name_crops_are_made_in_one_pass(spark):
    from formloom.operators import datasets, ensemble
    from formloom.plans import catalog_scans

    pages = catalog_scans.drawn(spark.createDataFrame([(k, "Ann Roe" * (k % 4) + "x") for k in range(40)], "doc_id long, name string"), "name")
    pages = pages.withColumn("box", F.expr("named_struct('x1', {}d, 'y1', {}d, 'x2', {}d, 'y2', {}d)".format(*datasets.NAME_BOXES["tight"])))
    out = ensemble.name_crops(pages)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Pages were drawn and cut twice before, and went to Python four times.
    assert plan.count("MapInArrow") == 2 and "EvalPython" not in plan and "Union" not in plan
    sizes = {(r["doc_id"], r["source"]): (r["h"], r["w"], len(r["raw"])) for r in out.collect()}
    for (doc, source), (h, w, n) in sizes.items():
        assert n == h * w
        if source.endswith("_prepared"):
            assert (h, w) == tuple(2 * x for x in sizes[doc, source.replace("_prepared", "_raw")][:2])


def test_crop_files_dont_shuffle_pixels(spark, monkeypatch):
    import struct
    import zlib

    import numpy as np

    from formloom.functions import images
    from formloom.plans import catalog_scans
    from formloom.sources import image_files

    seen = []
    write = image_files.write_images
    monkeypatch.setattr(image_files, "write_images", lambda crops, path, **how: (seen.append((crops, how)), write(crops, path, **how)))
    assert all(r["is_png"] for r in catalog.QUERIES["crop_files"](spark, "/root/testdata/sf0.001").collect())
    (crops, how), = seen
    plan = crops._jdf.queryExecution().executedPlan().toString()
    assert how == {"dealt": True} and plan.index("MapInArrow") < plan.index("Exchange") and plan.count("Exchange") == 1
    page = catalog_scans.page_of("A page of two greys has a bit for each pixel")
    file = images.png(page)
    assert struct.unpack(">IIBB", file[16:26]) == (*page.shape[::-1], 1, 3) and file[37:41] == b"PLTE" and file[41:47] == bytes([20] * 3 + [255] * 3)
    at = file.index(b"IDAT")
    lines = np.frombuffer(zlib.decompress(file[at + 4 : at + 4 + struct.unpack(">I", file[at - 4 : at])[0]]), dtype=np.uint8).reshape(len(page), -1)
    assert not lines[:, 0].any() and np.array_equal(np.where(np.unpackbits(lines[:, 1:], axis=1)[:, : page.shape[1]], 255, 20), page)


def test_shifts_are_added_in_the_tables_order(spark, tmp_path):
    import random

    import duckdb

    rng = random.Random(4)
    rows = [(rng.randrange(400) * 4 + 1, rng.choice((0, 2, 2, 2)), rng.randrange(9) / 100, rng.randrange(11) / 100) for _ in range(6000)]
    table = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_tax double, l_discount double")
    table.coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES["layout_registration"]).fetchall()
    # Several tasks read the file; their sums met in any order before.
    with settings(spark, **{"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "0"}):
        got = catalog.QUERIES["layout_registration"](spark, str(tmp_path))
        assert "collect_list" in got._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_training_records_are_lines_of_a_document(spark, tmp_path):
    from formloom.operators import datasets

    sheet = spark.createDataFrame([("ann roe", 'A"1\\ é'), ("ann roe", "A\n2"), ("ann roe", None), ("bob stone", "B1")], "clean string, label string")
    docs = spark.createDataFrame([(1, "Ann Roe 3-4-25", 4), (2, 'Bob "x" Stone 3-4-25', 4), (3, "Cher 3-4-25", 4), (4, "No\tOne/z 3-4-25", 4), (5, "Zed", 3)], "doc_id long, stem string, page_count int")
    rows = spark.createDataFrame([(1, "Cher", "12345"), (2, "Roe, Ann", "54321")], "ord long, name string, number string")
    told = datasets.write_training_set(docs, rows, sheet, f"{tmp_path}/t")
    known = datasets.labelled(datasets.eligible(docs), rows, sheet)
    want = datasets.training_crops(known).select("split", "image", "text", "task")
    got = spark.read.json(f"{tmp_path}/t").select("split", "image", "text", "task")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert told["samples"] == want.count() and told["labelled"] == known.count() and told["names"] == want.where("task = 'name'").count()
    # A record was a row, written by itself, before.
    assert known.select(datasets.record_lines().alias("v")).count() == known.count()


def test_equal_training_records_are_one_row(spark, monkeypatch):
    from formloom.operators import datasets

    monkeypatch.setattr(datasets, "MOST_TIMES", 2)
    sheet = spark.createDataFrame([("ann roe", f"A{k}") for k in range(5)] + [("ann roe", None), ("ann b. roe", "B1"), ("ann b. roe", None)], "clean string, label string")
    docs = spark.createDataFrame([(1, "Ann Roe 3-4-25"), (2, "Ann B. Roe 3-4-25"), (3, "Cher 3-4-25"), (4, "No One 3-4-25"), (5, "Zed")], "doc_id long, stem string")
    rows = spark.createDataFrame([(1, "Cher", "12345")], "ord long, name string, number string")
    found = datasets.counted_labels(docs, rows, sheet).collect()
    got = sorted((r["doc_id"], r["name"], r["number"] or "", r["label"] or "") for r in found for _ in range(r["times"]))
    want = datasets.labelled(docs, rows, sheet).collect()
    assert got == sorted((r["doc_id"], r["name"], r["number"] or "", r["label"] or "") for r in want)
    assert max(r["times"] for r in found) == 2 and len(found) < len(want)  # a row each before
