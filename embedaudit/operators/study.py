"""Whole studies: all families of tests for one set of models, kept in a store and resumed, and their summaries.

A family is a set of tests that are corrected together. Its cells are tested in one plan; what the store holds of
them is not tested again, and the correction is made over all that it holds. A family that fails is a row with its
error, and the others go on.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedaudit.functions.rounding import half_away
from embedaudit.functions.text import FAMILIES, p_value_stars
from embedaudit.sources.scratch import written

from . import cells, families, ledgers, stores

CELL = ["model", "perturbation_id", "severity"]
_PAIR = ["model_a", "model_b"]


@dataclasses.dataclass(frozen=True)
class Family:
    """``rows`` takes the metric and CKA tables and gives what is tested, ``test`` tests it; ``keys`` are a cell's, or
    none for one fit over all rows; ``correct`` corrects the family's p-values. With ``counts`` the metric table is that
    of :func:`counts_of`: distinct values with the number of their rows."""

    name: str
    keys: list[str] | None
    rows: Callable[[DataFrame, DataFrame], DataFrame]
    test: Callable[[DataFrame], DataFrame]
    correct: Callable[[DataFrame], DataFrame] = lambda df: df
    counts: bool = False

    def tables(self, cosine: DataFrame, counts: DataFrame, cka: DataFrame) -> DataFrame:
        return self.rows(counts if self.counts else cosine, cka)


def counts_of(cosine: DataFrame) -> DataFrame:
    """The metric table's distinct values in each cell and cohort with their numbers ``n``, written once: what tests of
    two groups need of it."""
    # missing values are left out by the tests: a filter here would work out each similarity again
    return written(cosine.groupBy(*CELL, "cohort", "cosine_similarity").agg(F.count("*").alias("n")), "counts")


def study_families(primary: list[str], outlier: str | None = None) -> list[Family]:
    """The families of a study on similarities and on CKA: the omnibus test, cohorts within cells, the two-way table, the
    mixed model, pairs of primary models; an outlier is compared to each primary model in families of its own, corrected
    by themselves."""
    acc, is_a = F.col("cohort") == "ACC", F.col("is_a")
    mine = lambda t: t.filter(F.col("model").isin(*primary))
    single, whole = (lambda t: cells.cohorts_only(mine(t))), (lambda t: cells.pooled_only(mine(t)))
    cosine, cka = "cosine_similarity", "linear_cka"
    two = lambda keys, metric, side: lambda rows: cells.two_sample_test(rows, keys, metric, side)
    of_counts = lambda keys, side: lambda rows: cells.two_sample_test(rows, keys, cosine, side, weight="n")
    pair, pair_cka = [*_PAIR, "perturbation_id", "severity"], [*_PAIR, "severity"]
    out = [
        Family("model_effect", None, lambda c, k: mine(c), lambda r: families.model_effect(r, "model", cosine)),
        Family("model_effect_cka", None, lambda c, k: whole(k), lambda r: families.model_effect(r, "model", cka)),
        Family("cohort_effect", CELL, lambda c, k: mine(c), of_counts(CELL, acc), cells.adjust_bonferroni, True),
        Family("cohort_effect_cka", ["model", "severity"], lambda c, k: single(k), two(["model", "severity"], cka, acc), cells.adjust_bonferroni),
        Family("interaction", None, lambda c, k: mine(c), lambda r: families.interaction_effect(r, "model", acc, cosine)),
        Family("interaction_cka", None, lambda c, k: single(k), lambda r: families.interaction_effect(r, "model", acc, cka)),
        Family("perturbation_effect", None, lambda c, k: mine(c), lambda r: families.random_intercept(r, "model", "perturbation_id", cosine)),
        Family("perturbation_effect_cka", None, lambda c, k: whole(k), lambda r: families.random_intercept(r, "model", "perturbation_id", cka)),
        Family("pairwise_models", pair, lambda c, k: cells.model_pairs(mine(c), primary), of_counts(pair, is_a), cells.adjust_bonferroni, True),
        Family("pairwise_models_cka", pair_cka, lambda c, k: cells.model_pairs(whole(k), primary), two(pair_cka, cka, is_a), cells.adjust_bonferroni),
    ]
    if outlier:
        out += [
            Family("outlier_effect", pair, lambda c, k: cells.outlier_pairs(c, outlier, primary), of_counts(pair, is_a), cells.adjust_bh, True),
            Family("outlier_effect_cka", pair_cka, lambda c, k: cells.outlier_pairs(cells.pooled_only(k), outlier, primary), two(pair_cka, cka, is_a), cells.adjust_bh),
        ]
    return out


def run_study(cosine: DataFrame, cka: DataFrame, primary: list[str], outlier: str | None = None) -> dict[str, DataFrame]:
    """One table for each family, none of them computed yet and none stored; the metric's values are counted at once."""
    counts = counts_of(cosine)
    return {f.name: f.correct(f.test(f.tables(cosine, counts, cka))) for f in study_families(primary, outlier)}


class ResultStore:
    """Tables of uncorrected results, one for each family, as Parquet in a folder that only grows; and the runs' log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self, name: str) -> DataFrame | None:
        """What is stored of a family, or None."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        there = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)
        return self.spark.read.parquet(f"{self.path}/{name}") if there else None

    def write(self, name: str, df: DataFrame, mode: str = "append") -> None:
        df.write.mode(mode).parquet(f"{self.path}/{name}")

    def log(self) -> DataFrame | None:
        """``run, family, status, cells, error`` of all runs."""
        return self.read("runs")


def resume_study(store: ResultStore, cosine: DataFrame, cka: DataFrame, primary: list[str], outlier: str | None = None, force: bool = False, only: list[Family] | None = None) -> DataFrame:
    """Tests what the store lacks, family by family, and returns this run's log: ``run, family, status, cells, error``.

    ``status``: done with the number of ``cells`` tested (1 for a fit over all), skipped where the store had them all, or
    failed with the error; a failed family is tried again by the next run. A family without cells and a fit that cannot be
    made have failed, too, and nothing of them is stored. With ``force`` families are computed anew and replace what is
    stored. A model that is asked for and absent is an error before anything is tested. :func:`require_done` makes an
    error of failed families.
    """
    ledgers.require_members(cosine, "model", [*primary, *([outlier] if outlier else [])])
    before = store.log()
    run = (before.agg(F.max("run")).first()[0] if before is not None else 0) + 1
    out, counts = [], counts_of(cosine)
    for family in only if only is not None else study_families(primary, outlier):
        try:
            held = None if force else store.read(family.name)
            rows = family.tables(cosine, counts, cka)
            if family.keys is None:
                tested = 0 if held is not None else 1
            else:
                wanted = rows.select(*family.keys).distinct()
                todo = wanted if held is None else ledgers.incremental(wanted, held, family.keys)
                tested = todo.count()
                if held is None and not tested:
                    raise ValueError("no cells to test")
                if held is not None and tested:
                    rows = rows.join(F.broadcast(todo), family.keys, "left_semi")  # a row for each cell of the study
            if tested:
                found = family.test(rows)
                store.write(family.name, found if family.keys else _made(found), "overwrite" if force else "append")
            out.append((run, family.name, "done" if tested else "skipped", tested, None))
        except Exception as error:  # a family of its own: the others go on
            out.append((run, family.name, "failed", 0, f"{type(error).__name__}: {error}"[:300]))
    log = store.spark.createDataFrame(out, "run int, family string, status string, cells long, error string")
    store.write("runs", log)
    return log


def _made(fit: DataFrame) -> DataFrame:
    """A fit's rows, computed; an error where there are none or they tell of one."""
    fit = written(fit, "fit")
    rows = [r.asDict() for r in fit.collect()]  # a row for each term, level or pair of groups
    if not rows:
        raise ValueError("the fit has no rows")
    errors = [r["error"] for r in rows if r.get("error") is not None]
    if errors:
        raise ValueError(errors[0])
    return fit


def require_done(log: DataFrame) -> DataFrame:
    """The log of one run or of all; an error that names the families whose last row there is ``failed``."""
    last = ledgers.latest_per_key(log, "family", F.col("run"))  # a row for each family
    failed = last.filter("status = 'failed'").orderBy("family").collect()
    if failed:
        raise RuntimeError("failed: " + "; ".join(f"{r['family']} ({r['error']})" for r in failed))
    return log


def stored_tables(store: ResultStore, primary: list[str], outlier: str | None = None) -> dict[str, DataFrame]:
    """The store's families, corrected over all that each holds; families without results are left out. A family that
    failed in its last run is an error: what the store holds of it may be a part."""
    log = store.log()
    if log is not None:
        names = [f.name for f in study_families(primary, outlier)]
        require_done(log.filter(F.col("family").isin(names)))
    found = ((f, store.read(f.name)) for f in study_families(primary, outlier))
    return {f.name: f.correct(df) for f, df in found if df is not None}


def long_results(tables: dict[str, DataFrame], keys: dict[str, list[str] | None]) -> DataFrame:
    """``family, cell, p_value, significant`` of all tables; ``cell`` names the tested cell, pair, term or level."""
    parts = []
    for name, table in tables.items():
        of = keys[name] or [c for c in ("group_a", "group_b", "term", "perturbation_id") if c in table.columns]
        flag = next((c for c in ("significant_bonferroni", "significant_fdr_bh") if c in table.columns), None)
        cell = F.concat_ws("|", *(F.col(c).cast("string") for c in of))
        parts.append(table.select(F.lit(name).alias("family"), cell.alias("cell"), F.col("p_value").cast("double").alias("p_value"), (F.col(flag) if flag else F.lit(None).cast("boolean")).alias("significant")))
    return reduce(DataFrame.unionByName, parts)


def summary(study: dict[str, DataFrame]) -> DataFrame:
    """``family, tests, significant, least_p`` of the families that are corrected for their tests."""
    parts = []
    for name, table in study.items():
        flag = next((c for c in ("significant_bonferroni", "significant_fdr_bh") if c in table.columns), None)
        if flag:
            parts.append(table.agg(F.lit(name).alias("family"), F.count("*").alias("tests"), F.count_if(F.col(flag)).alias("significant"), F.round(F.min("p_value"), 7).alias("least_p")))
    return reduce(DataFrame.unionByName, parts)


def model_effect_summary(cosine: DataFrame, cka: DataFrame) -> DataFrame:
    """``model`` with its mean and the omnibus statistic and p, of similarity and of CKA."""

    def part(df: DataFrame, metric: str, name: str) -> DataFrame:
        test = families.model_effect(df, "model", metric).filter("group_a IS NULL").select(F.round("statistic", 4).alias(f"statistic_{name}"), F.round("p_value", 7).alias(f"p_value_{name}"))
        means = df.groupBy("model").agg(F.round(F.avg(metric), 6).alias(f"mean_{name}"))
        return means.crossJoin(F.broadcast(test))  # one row

    return part(cosine, "cosine_similarity", "cosine").join(part(cka, "linear_cka", "cka"), "model")


def held_out_summary(pairs: DataFrame, a: str, b: str, predicted: dict[str, str]) -> DataFrame:
    """``model, n, median_diff, cohens_2g, stars, confirmed``: the paired tests of two conditions, with the label
    predicted for the model's family (else no difference)."""
    family = stores._literals(FAMILIES, F.col("model"))
    label = F.coalesce(stores._literals(predicted, family), F.lit("no_difference"))
    t = families.with_prediction(families.wilcoxon_signed_rank(pairs, ["model"]), f"{a}_higher", f"{b}_higher", "no_difference", label)
    return t.select("model", F.col("n_pairs").alias("n"), (half_away(F.col("median_diff"), 6) + 0.0).alias("median_diff"), half_away(F.col("cohens_2g"), 6).alias("cohens_2g"), p_value_stars(F.col("p_value")).alias("stars"), "confirmed")
