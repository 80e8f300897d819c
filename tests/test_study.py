"""Studies that are resumed: only what the store lacks is tested, and a family that fails leaves the others alone."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedaudit.operators import study
from embedaudit.sources.scratch import new_path

SEVERITIES = ("mild", "severe")


@pytest.fixture(scope="module")
def cosine(spark):
    rng = np.random.default_rng(7)
    rows = [(m, f"{i}", c, p, s, float(rng.beta(5, 2 + k))) for k, m in enumerate("ab") for c in ("ACC", "GDC") for i in range(9) for p in (1, 2) for s in SEVERITIES]
    return spark.createDataFrame(rows, "model string, sample_id string, cohort string, perturbation_id int, severity string, cosine_similarity double").cache()


def _families():
    by_name = {f.name: f for f in study.study_families(["a", "b"])}
    return [by_name[n] for n in ("cohort_effect", "pairwise_models", "interaction")]


def _log(df):
    return {r["family"]: (r["status"], r["cells"]) for r in df.collect()}


def test_a_second_run_tests_what_is_absent(spark, cosine):
    store, whole = study.ResultStore(spark, new_path(spark, "study")), study.ResultStore(spark, new_path(spark, "study"))
    first = study.resume_study(store, cosine.filter("severity = 'mild'"), cosine, ["a", "b"], only=_families()[:2])
    assert _log(first) == {"cohort_effect": ("done", 4), "pairwise_models": ("done", 2)}
    assert _log(study.resume_study(store, cosine, cosine, ["a", "b"], only=_families())) == {"cohort_effect": ("done", 4), "pairwise_models": ("done", 2), "interaction": ("done", 1)}
    assert _log(study.resume_study(store, cosine, cosine, ["a", "b"], only=_families())) == {n: ("skipped", 0) for n in ("cohort_effect", "pairwise_models", "interaction")}
    study.resume_study(whole, cosine, cosine, ["a", "b"], only=_families())
    keys = {f.name: f.keys for f in _families()}
    rows = [sorted((r["family"], r["cell"], r["p_value"], r["significant"]) for r in study.long_results(study.stored_tables(s, ["a", "b"]), keys).collect()) for s in (store, whole)]
    assert rows[0] == rows[1] and len(rows[0]) == 8 + 4 + 4
    again = study.resume_study(store, cosine.filter("severity = 'mild'"), cosine, ["a", "b"], force=True, only=_families()[:1])
    assert _log(again) == {"cohort_effect": ("done", 4)} and store.read("cohort_effect").count() == 4
    assert [r["run"] for r in store.log().select("run").distinct().orderBy("run").collect()] == [1, 2, 3, 4]


def test_a_family_that_fails_is_a_row_and_is_tried_again(spark, cosine):
    store = study.ResultStore(spark, new_path(spark, "study"))
    good = _families()
    late = dataclasses.replace(good[0], test=lambda rows: good[0].test(rows).withColumn("p_value", F.raise_error(F.lit("no fit")).cast("double")))
    early = dataclasses.replace(good[2], rows=lambda c, k: c.select("absent"))
    log = study.resume_study(store, cosine, cosine, ["a", "b"], only=[late, early, good[1]])
    assert {f: s for f, (s, _) in _log(log).items()} == {"cohort_effect": "failed", "interaction": "failed", "pairwise_models": "done"}
    errors = {r["family"]: r["error"] for r in log.collect()}
    assert errors["pairwise_models"] is None and "absent" in errors["interaction"]
    assert {f: s for f, (s, _) in _log(study.resume_study(store, cosine, cosine, ["a", "b"], only=good)).items()} == {"cohort_effect": "done", "interaction": "done", "pairwise_models": "skipped"}
    with pytest.raises(ValueError, match="no rows of c; there are a, b"):
        study.resume_study(store, cosine, cosine, ["a", "c"])


def test_a_failed_family_gives_no_results(spark, cosine):
    # what was stored of a family before it failed was read as its whole results
    store, good = study.ResultStore(spark, new_path(spark, "study")), _families()
    study.resume_study(store, cosine.filter("severity = 'mild'"), cosine, ["a", "b"], only=good[:1])
    late = dataclasses.replace(good[0], test=lambda rows: good[0].test(rows).withColumn("p_value", F.raise_error(F.lit("no fit")).cast("double")))
    log = study.resume_study(store, cosine, cosine, ["a", "b"], only=[late, good[2]])
    for read in (lambda: study.require_done(log), lambda: study.stored_tables(store, ["a", "b"])):
        with pytest.raises(RuntimeError, match=r"failed: cohort_effect \(.*no fit"):
            read()
    study.require_done(study.resume_study(store, cosine, cosine, ["a", "b"], only=good[:1]))
    assert study.stored_tables(store, ["a", "b"])["cohort_effect"].count() == 8


def test_a_fit_that_cannot_be_made_has_failed(spark, cosine):
    # its row of an error was stored as done, and never tried again
    store, by_name = study.ResultStore(spark, new_path(spark, "study")), {f.name: f for f in study.study_families(["a", "b"])}
    few = lambda name: dataclasses.replace(by_name[name], rows=lambda c, k: c.filter("sample_id = '0' AND cohort = 'ACC' AND perturbation_id = 1 AND severity = 'mild'"))
    none = lambda name: dataclasses.replace(by_name[name], rows=lambda c, k: c.filter("sample_id = 'none'"))
    log = study.resume_study(store, cosine, cosine, ["a", "b"], only=[few("model_effect"), none("perturbation_effect"), none("cohort_effect")])
    assert _log(log) == {n: ("failed", 0) for n in ("model_effect", "perturbation_effect", "cohort_effect")}
    assert "fewer than 3 values" in {r["family"]: r["error"] for r in log.collect()}["model_effect"]
    assert all(store.read(n) is None for n in ("model_effect", "perturbation_effect", "cohort_effect"))
    assert _log(study.resume_study(store, cosine, cosine, ["a", "b"], only=[by_name["model_effect"]])) == {"model_effect": ("done", 1)}


def test_study_results_fails_with_a_family(spark, cosine, monkeypatch):
    # a family that failed was left out, and 0 cells were shown for it
    from embedaudit.plans import cells, registry

    good = {f.name: f for f in study.study_families(["a", "b"])}
    broken = dataclasses.replace(good["interaction"], rows=lambda c, k: c.select("absent"))
    monkeypatch.setattr(cells.study, "PRIMARY", ("a",))
    monkeypatch.setattr(cells.study, "OUTLIER", "b")
    monkeypatch.setattr(cells, "_stored", lambda spark, sf_dir: cosine)
    monkeypatch.setattr(cells, "cka_table_of", lambda spark, sf_dir: cosine)
    monkeypatch.setattr(study, "study_families", lambda *of: [good["cohort_effect"], broken])
    with pytest.raises(RuntimeError, match=r"failed: interaction \(.*absent"):
        registry.queries()["study_results"](spark, "")
