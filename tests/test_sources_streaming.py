"""Files in and out, resuming, and batch equal to stream."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from formloom.operators import extract
from formloom.plans import engines
from formloom.sources import readers, sinks
from formloom.sources.fixtures import fixture
from formloom.streaming.incremental import incremental, keyed, upsert_missing

FOLDER = "/root/testdata/sf0.001"


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "y.txt").write_bytes(b"no")
    assert [r["length"] for r in readers.files(spark, str(tmp_path)).collect()] == [4]
    assert [r["year"] for r in readers.files_by_year(spark, {2025: str(tmp_path / "a"), 2026: str(tmp_path / "none")}).collect()] == [2025]
    assert readers.files_by_year(spark, {2026: str(tmp_path / "none")}).count() == 0
    (tmp_path / "a" / "empty.pdf").write_bytes(b"")
    found = readers.files(spark, str(tmp_path))
    crops = spark.createDataFrame([(r["path"], k) for k, r in enumerate(found.collect())] + [("gone.pdf", 9)], "path string, k int")
    assert [bytes(r["content"]) for r in readers.crop_files(crops, found).collect()] == [b"%PDF"]


def test_csv_and_splits(spark, tmp_path):
    rows = spark.createDataFrame([(1, "f", "text", "blank_text", 0.5, "s", "a\nb", 1), (2, "", "d", "unsupported_document", None, "s", "", None)], "doc_id int, field string, kind string, status string, confidence double, source string, value_preview string, page int")
    sinks.report(rows, str(tmp_path / "r"), [*sinks.REVIEW_COLUMNS, "page"])
    back = readers.review_csv(spark, str(tmp_path / "r")).collect()
    assert len(back) == 1 and back[0]["page"] == 1
    sinks.split_files(spark.createDataFrame([("i", "train"), ("j", "test"), ("k", "val")], "image string, split string"), str(tmp_path / "s"))
    assert {(r["image"], r["split"]) for r in readers.splits(spark, str(tmp_path / "s")).collect()} == {("i", "train"), ("j", "test"), ("k", "val")}
    manifest = sinks.documents(rows.select("doc_id", "field"), str(tmp_path / "d"))
    assert {r["doc_id"] for r in manifest.collect()} == {1, 2} and all((tmp_path / "d" / r["path"].rsplit("/", 1)[1]).exists() for r in manifest.collect())
    assert spark.read.json(str(tmp_path / "d")).count() == 2


def test_reports_and_templates(spark, tmp_path):
    sinks.report(spark.createDataFrame([("f.pdf", "evaluated", 4)], "source_pdf string, status string, page_count int"), str(tmp_path / "live"), "live")
    back = readers.csv(spark, str(tmp_path / "live"))
    assert back.columns == sinks.LAYOUTS["live"] and len(back.columns) == 23 and back.first()["status"] == "evaluated"
    sinks.manifest(back, str(tmp_path / "m"))
    sinks.summary(spark.createDataFrame([(3, 0.5)], "n int, rate double"), str(tmp_path / "s"))
    assert readers.csv(spark, str(tmp_path / "m")).count() == 1 and spark.read.json(str(tmp_path / "s")).first()["rate"] == 0.5
    as_json = '{"fields": [{"key": "a", "page": 1, "kind": "checkbox_group", "boxes": {"True": [0, 0, 1, 1], "False": [1, 1, 2, 2]}}]}'
    as_yaml = "fields:\n  - key: a\n    page: 1\n    kind: checkbox_group\n    boxes: {yes: [0, 0, 1, 1], no: [1, 1, 2, 2]}\n"
    assert readers.template(spark, as_json).collect() == readers.template(spark, as_yaml).collect()
    assert set(readers.template(spark, as_json).first()["boxes"]) == {"yes", "no"}
    assert readers.sheet_columns(["Last, First Name", "Supervision #", "RSO"]) == ("Last, First Name", "Supervision #", "RSO") and readers.sheet_columns(["x"]) == (None, None, None)


def test_uploads_filter(spark):
    docs = spark.createDataFrame([("a.PDF", 10, 4), ("a.pdf", 10, 5), ("a.txt", 10, 4), ("b.pdf", 60 << 20, 4)], "name string, bytes long, page_count int")
    assert [r["name"] for r in readers.uploads(docs).collect()] == ["a.PDF"]


def test_engines(spark):
    with pytest.raises(ValueError, match="unknown name engine"):
        engines.engine("none:x")
    assert engines.candidates_or_none(spark, None, None).count() == 0


def test_a_path_stands_for_the_model_engine(tmp_path, monkeypatch):
    monkeypatch.setattr(engines, "_ENGINES", {})
    engines.register(engines.MODEL_ENGINE, lambda rest: ("engine", rest))
    assert engines.engine(str(tmp_path)) == ("engine", str(tmp_path)) and engines.engine("trocr:x") == ("engine", "x")
    with pytest.raises(ValueError, match="unknown name engine"):
        engines.engine(str(tmp_path / "none"))


@pytest.mark.parametrize("run", [incremental, keyed, upsert_missing])
def test_batch_equals_stream(spark, tmp_path, run):
    forms = fixture(spark, FOLDER, "forms").where("doc_id < 60")
    source = str(tmp_path / "in")
    plan = lambda docs: extract.digital_form(docs)
    args = (spark, source, forms.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), plan, str(tmp_path / "out"), str(tmp_path / "cp"))
    forms.where("doc_id < 30").write.parquet(source)
    run(*args).awaitTermination()
    forms.where("doc_id >= 30").write.mode("append").parquet(source)
    run(*args).awaitTermination()
    run(*args).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = plan(forms)
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).isEmpty()


@pytest.mark.parametrize("time", [None, "ts"])
def test_keys_come_once(spark, tmp_path, time):
    """Over restarts a key is taken once; with a time the state forgets what is out of its span."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    first = datetime.datetime(2025, 1, 1)

    def run(rows):
        spark.createDataFrame([(i, v, first + datetime.timedelta(days=day)) for i, v, day in rows], "doc_id long, v string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        q = keyed(spark, source, "doc_id long, v string, ts timestamp", lambda d: d.where("v <> 'no'"), sink, str(tmp_path / "cp"), time=time, live="2 days")
        q.awaitTermination()
        return q, sorted(((r["doc_id"], r["v"]) for r in spark.read.parquet(sink).collect()), key=str)

    # A row that the plan leaves out has come, too.
    assert run([(1, "a", 0), (2, "c", 0), (None, "n", 0), (4, "no", 0)])[1] == [(1, "a"), (2, "c"), (None, "n")]
    assert run([(1, "z", 1), (3, "d", 1), (None, "m", 1), (4, "e", 1)])[1] == [(1, "a"), (2, "c"), (3, "d"), (None, "n")]
    run([(9, "far", 30)])
    q, got = run([(1, "again", 30)])
    assert ((1, "again") in got) == (time is not None) and (9, "far") in got
    held = [s["numRowsTotal"] for p in q.recentProgress for s in json.loads(p.json)["stateOperators"]][-1]
    assert held == 2 if time else held == 6


def test_page_text_rules(spark):
    pages = spark.createDataFrame([(1, 1, "short"), (1, 2, "x" * 60 + " 123456 "), (2, 1, "y")], "doc_id int, page int, text string")
    r = readers.embedded_candidates(pages).collect()
    assert [(x["doc_id"], x["page"], x["values"]) for x in r] == [(1, 2, ["123456"])]
    assert readers.digital(pages, 50).select("doc_id").distinct().collect()[0][0] == 1
    assert pages.select(sinks.data_uri(F.lit(b"ab"))).first()[0] == "data:image/png;base64,YWI="
