"""Readers and writers of the study's files."""

import json

import pytest
from pyspark.sql import functions as F

from embedaudit.operators import families, matching
from embedaudit.sources import files


def test_manifest(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("case_id\tsex\tage\tdiagnosis\nA-1\tmale\t63\tbenign\nB-2\t\t\t\n")
    rows = files.read_manifest(spark, str(tmp_path / "m.tsv")).orderBy("case_id").collect()
    assert [tuple(r) for r in rows] == [("A-1", "male", 63.0, "benign"), ("B-2", None, None, None)]


def test_metric_names_missing_columns(spark, tmp_path):
    (tmp_path / "m.csv").write_text("model,value\nuni,0.5\n")
    assert files.read_metric(spark, str(tmp_path / "m.csv"), ["model", "value"]).first()["value"] == 0.5
    with pytest.raises(ValueError, match="severity"):
        files.read_metric(spark, str(tmp_path / "m.csv"), ["model", "severity"])


def test_candidates_with_nulls_at_every_level(spark, tmp_path):
    hit = {"file_id": "f", "file_name": "n", "cases": [{"case_id": "c", "primary_site": "Skin", "demographic": {"gender": "male", "race": None}, "diagnoses": [{"age_at_diagnosis": 3650, "primary_diagnosis": "x"}]}]}
    (tmp_path / "c.json").write_text(json.dumps({"data": {"hits": [hit, {"file_id": "g", "cases": []}, {"file_id": "h", "cases": [{"diagnoses": None}]}, {"file_id": "i", "cases": [{"diagnoses": [{"age_at_diagnosis": 0}]}]}]}}))
    rows = files.read_candidates(spark, str(tmp_path / "c.json")).orderBy("seq").collect()
    assert [(r["file_id"], r["site"], r["age"]) for r in rows] == [("f", "Skin", 10.0), ("g", None, None), ("h", None, None), ("i", None, None)]


def test_series_and_results(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"PatientID": "a", "Modality": "SM"}\n{"PatientID": "b", "Modality": "CT"}\n')
    assert [r["PatientID"] for r in files.read_series(spark, str(tmp_path / "s.json")).collect()] == ["a"]
    (tmp_path / "r.json").write_text(json.dumps({"anova_table": {"model": {"F": 2.0}, "cohort": {"F": 3.0}}}))
    got = {r["term"]: json.loads(r["value"]) for r in files.read_results_json(spark, str(tmp_path / "r.json"), "anova_table").collect()}
    assert got == {"model": {"F": 2.0}, "cohort": {"F": 3.0}}


def test_listing_and_corpus(spark, tmp_path):
    for p in ("baseline/a.png", "lighting/p17_Brightness/mild/a.png", "odd/x.png", "lighting/p17_Brightness/mild/note.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"1234")
    rows = files.list_tiles(spark, str(tmp_path)).orderBy("path").collect()
    assert [(r["category"], r["perturbation_id"], r["severity"], r["sample_id"], r["length"]) for r in rows] == [(None, None, None, "a", 4), ("lighting", 17, "mild", "a", 4)]
    assert files.list_files(spark, str(tmp_path)).count() == 4


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.12345678), ("b", None)], "k string, v double")
    for kind in ("parquet", "tsv", "csv"):
        files.write_table(df, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).filter("k = 'a'").first()["v"] == 0.123457
    files.write_results_json(df, str(tmp_path / "json"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "json")).collect()) == ['{"k":"a","v":0.12345678}', '{"k":"b"}']
    files.append_ledger(df, str(tmp_path / "ledger"))
    files.append_ledger(df, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 4
    new = spark.createDataFrame([("a", 1.0), ("c", 2.0)], "k string, v double")
    assert {tuple(r) for r in files.cumulative(df, new, ["k"]).collect()} == {("a", 1.0), ("b", None), ("c", 2.0)}


def test_series_matching_and_family_test(spark):
    cases = spark.createDataFrame([("c1", "male", 60, "benign"), ("c2", "female", 40, "benign")], "case_id string, sex string, age int, diagnosis string")
    series = spark.createDataFrame([("s1", "M", "061Y", "benign"), ("s2", None, "060Y", "malignant"), ("s3", "F", "bad", "benign")], "series_id string, sex string, age string, diagnosis string")
    got = {r["case_id"]: (r["series_id"], r["score"]) for r in matching.match_series(cases, series).collect()}
    assert got == {"c1": ("s1", 1.0), "c2": ("s3", 25.0)}
    rows = [(m, f"t{i}", "solarize", (0.9 if m in ("a", "b") else 0.5) + i / 1000) for m in "abcd" for i in range(12)]
    df = spark.createDataFrame(rows, "model string, sample_id string, condition string, x double")
    r = families.family_condition_test(df, "model", {"a": "one", "b": "one", "c": "two", "d": "two"}, "one", "two", "condition", "solarize", "x").first()
    assert (r["n_a"], r["n_b"]) == (24, 24) and r["p_value"] < 1e-6 and r["observed"] == "one_higher"


def test_tukey_of_two_groups_is_the_t_test(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 4, 5, 6)] + [("b", float(x)) for x in (2, 4, 6, 8, 10, 12)]
    r = families.tukey_hsd(spark.createDataFrame(rows, "g string, x double"), "g", "x").first()
    a = families.one_way_anova(spark.createDataFrame(rows, "g string, x double"), "g", "x").first()
    assert r["difference"] == pytest.approx(3.5) and r["p_value"] == pytest.approx(a["p_value"], abs=2e-4)
    assert F is not None


def test_series_as_lines_and_as_an_array(spark, tmp_path):
    rows = [{"SeriesInstanceUID": str(k), "Modality": "SM" if k % 2 else "CT", "PatientAge": "040Y"} for k in range(6)]
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "array.json").write_text(json.dumps(rows, indent=1))
    read = lambda name, lines: sorted(r["SeriesInstanceUID"] for r in files.read_series(spark, str(tmp_path / name), lines=lines).collect())
    assert read("lines.json", True) == read("array.json", False) == ["1", "3", "5"]
