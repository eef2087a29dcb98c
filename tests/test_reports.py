import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import reports
from ledgerloom.plans.reference import name_review
from ledgerloom.sources.records import read_catalog, read_ids


def test_parameters():
    reports.check_parameters(100, 0.5)
    for bad in ((0, 0), (float("inf"), 1), (100, 100), (100, -1)):
        with pytest.raises(ValueError):
            reports.check_parameters(*bad)


def test_name_review(spark, rows):
    p = spark.createDataFrame([("a", "1", "Cena"), ("a", "Lot 1", "Cena"), ("a", None, "X"), ("b", "1", None)], "k string, lot string, name string")
    g = spark.createDataFrame([("a", "1.", "Price"), ("c", "", "Y")], "k string, lot string, name string")
    assert rows(reports.name_review(p, g, "k", "lot", "name")) == [("a", "1", "Cena x2", "Price"), ("a", "all", "X", None), ("c", "all", None, "Y")]


def test_names_of_the_records(spark, rows, tmp_path):
    body = '{"lots": [{"sequenceNumber": "1", "criterion": [{"winnerCriterionName": "Price"}, {"winnerCriterionName": "Price"}]}, {"criterion": {"winnerCriterionName": "Y"}}]}'
    records = [(1, "a", body), (2, "a", body.replace(": ", ":")), (3, "a", '{"lots": {"sequenceNumber": "1", "criterion": {"winnerCriterionName": "Term"}}}'), (4, "b", "{")]
    spark.createDataFrame(records, "record_id long, eis_id string, body string").write.parquet(f"{tmp_path}/reference_records.parquet")
    spark.createDataFrame([("a", "Lot 1", "Cena"), ("b", None, "X")], "eis_id string, lot string, name string").write.parquet(f"{tmp_path}/worker_criteria.parquet")
    assert rows(name_review(spark, str(tmp_path))) == [("a", "1", "Cena", "Price x2 | Term"), ("a", "all", None, "Y"), ("b", "all", "X", None)]


def test_corrections_and_totals(spark, rows):
    c = spark.createDataFrame([("w", "extract", 1, 1.0), ("w", "Correction", 2, 2.5), ("w", "x", 1, float("nan")), ("v", None, None, None)], "w string, s string, a int, t double")
    assert rows(reports.correction_rows(c, "w", "s", "a", "t")) == [("v", 1, 0, 0, None), ("w", 3, 1, 1, 3.5)]
    assert ("a", "w", 4.0) in rows(reports.stage_totals(c, "w", ["a"]))


def test_artifacts_and_lots(spark, rows):
    r = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    out = reports.with_artifacts(r, {"ocr": spark.createDataFrame([("a",), ("a",)], "k string"), "tables": spark.createDataFrame([("a",), ("b",)], "k string")}, "k")
    assert rows(out, "k", "note") == sorted([("a", None), ("b", "missing: ocr"), (None, "missing: ocr, tables")], key=str)
    c = spark.createDataFrame([(1, "2"), (1, "3"), (1, None), (2, "9")], "f int, lot string")
    t = spark.createDataFrame([(1, "Lot 2"), (2, None)], "f int, task string")
    assert rows(reports.foreign_lots(c, t, "f", "lot", "task")) == [(1, "3")]


def test_columns(spark):
    d = spark.createDataFrame([("n", True, "why"), ("m", True, "why"), ("n", None, "why"), ("n", False, " ")], "n string, a boolean, r string")
    assert [x[0] for x in d.select(reports.decision_problem(F.col("n"), F.lit("n"), F.col("a"), F.col("r"))).collect()] == [None, "other name", "no decision", "no reason"]
    h = spark.createDataFrame([([("edit", " a "), ("reject", ""), ("approve", "b")],)], "h array<struct<type:string,message:string>>")
    assert h.select(reports.feedback_history(F.col("h"))).first()[0] == "1. edit: a\n2. approve: b"


def test_ids_and_catalog(spark, tmp_path):
    (tmp_path / "ids.txt").write_text(" 2\n\n1\n2\n")
    assert [r["eis_id"] for r in read_ids(spark, str(tmp_path / "ids.txt"), ["3", "1"]).orderBy("ord").collect()] == ["3", "1", "2"]
    (tmp_path / "c.json").write_text(json.dumps({"schemes": {"A": {"aliases": ["x y"], "green": True}}, "scheme_cues": ["q"]}))
    c = read_catalog(str(tmp_path / "c.json"))
    assert c.schemes == {"A": ["x y"]} and c.cues == ["q"] and c.markers == {}
