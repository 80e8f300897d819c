"""Whole-fit statistics from sufficient statistics of cells: ANOVA, Kruskal-Wallis, Dunn, regressions, paired tests."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedaudit.functions import tails
from embedaudit.sources.scratch import written

from . import prefix
from .cells import drop_missing, tie_term


#: Differences up to which the signed ranks' distribution is counted out.
EXACT = 50


def group_stats(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    x = F.col(metric).cast("double")
    return drop_missing(df, metric).groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.var_samp(x) * (F.count(x) - 1), F.lit(0.0)).alias("ss"))


def one_way_anova(df: DataFrame, group: str, metric: str) -> DataFrame:
    """One row: ``k, n, f, p_value`` over the groups (null where within-group spread or a second group is missing)."""
    g = group_stats(df, [group], metric)
    s = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("sy"), F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("syy"), F.sum("ss").alias("within"))
    between = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    f = (between / F.nullif(F.col("k") - 1, F.lit(0))) / F.nullif(F.col("within") / F.nullif(F.col("n") - F.col("k"), F.lit(0)), F.lit(0.0))
    return s.select("k", "n", f.alias("f"), tails.f_upper(f, F.col("k") - 1, F.col("n") - F.col("k")).alias("p_value"))


def group_ranks(df: DataFrame, group: str, metric: str) -> DataFrame:
    """``rank_sum`` and ``n`` of each group, with the total size and tie term beside each."""
    # distinct values are read several times, rows once
    values = written(drop_missing(df, metric).groupBy(F.col(metric).cast("double").alias("value"), group).agg(F.count("*").alias("c")), "values")
    distinct = values.groupBy("value").agg(F.sum("c").alias("t"))
    ranked = prefix.before(distinct, "value", "t").select("value", "t", (F.col("before") + (F.col("t") + 1) / 2).alias("mid_rank"))
    ties = ranked.agg(tie_term(F.col("t")).alias("tie_term"), F.sum("t").alias("total"))
    sums = values.join(ranked, "value").groupBy(group).agg(F.sum(F.col("c") * F.col("mid_rank")).alias("rank_sum"), F.sum("c").alias("n"))
    return sums.crossJoin(F.broadcast(ties))  # one row


def kruskal_wallis(df: DataFrame, group: str, metric: str) -> DataFrame:
    """One row: tie-corrected ``h``, ``k`` and ``p_value`` (chi-square with k - 1)."""
    s = group_ranks(df, group, metric).agg(
        F.count("*").alias("k"), F.first("total").cast("double").alias("n"), F.first("tie_term").alias("ties"), F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("rr")
    )
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("rr") - 3 * (n + 1)) / F.nullif(1 - F.col("ties") / (n * n * n - n), F.lit(0.0))
    return s.select("k", h.alias("h"), tails.chi2_upper(h, F.col("k") - 1).alias("p_value"))


def dunn_posthoc(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Pairs of groups a < b: ``z`` of mean ranks (tie-corrected) and p, Bonferroni over the pairs."""
    g = group_ranks(df, group, metric).withColumn("mean_rank", F.col("rank_sum") / F.col("n"))
    a = g.select(F.col(group).alias("group_a"), F.col("mean_rank").alias("r_a"), F.col("n").alias("n_a"), F.col("total").cast("double").alias("total"), "tie_term")
    b = g.select(F.col(group).alias("group_b"), F.col("mean_rank").alias("r_b"), F.col("n").alias("n_b"))
    total = F.col("total")
    spread = F.sqrt((total * (total + 1) / 12 - F.col("tie_term") / (12 * (total - 1))) * (1 / F.col("n_a") + 1 / F.col("n_b")))
    pairs = a.join(b, F.col("group_a") < F.col("group_b")).withColumn("z", (F.col("r_a") - F.col("r_b")) / spread)
    p = F.least(F.lit(1.0), tails.normal_two_sided(F.col("z")) * F.count("*").over(Window.partitionBy()))
    return pairs.select("group_a", "group_b", "z", p.alias("p_value"))


def interaction_effect(df: DataFrame, model: str, cohort: Column, metric: str) -> DataFrame:
    """Two-way ANOVA model x cohort (two cohorts) with Type II sums of squares: a row for each term.

    All sums come from the cells' n, mean and within-cell sum of squares; models without both cohorts are left out.
    """
    rows = df.withColumn("__c", cohort)
    x = F.col(metric).cast("double")
    a, b = F.when(F.col("__c"), x), F.when(~F.col("__c"), x)
    part = lambda v: F.coalesce(F.var_samp(v) * (F.count(v) - 1), F.lit(0.0))
    m = drop_missing(rows, metric).groupBy(model).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("y1"), F.avg(b).alias("y2"), (part(a) + part(b)).alias("rss"))
    m = m.filter("n1 > 0 AND n2 > 0")
    w, d, n = F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2")), F.col("y1") - F.col("y2"), F.col("n1") + F.col("n2")
    mean = (F.col("n1") * F.col("y1") + F.col("n2") * F.col("y2")) / n
    s = m.agg(
        F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(w).alias("w"), F.sum(w * d).alias("wd"), F.sum(w * d * d).alias("wdd"), F.sum("rss").alias("rss"),
        F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.sum(F.col("n1") * F.col("y1")).alias("s1"), F.sum(F.col("n2") * F.col("y2")).alias("s2"), F.sum(n * mean * mean).alias("models"),
        F.sum(F.col("n1") * F.col("y1") ** 2 + F.col("n2") * F.col("y2") ** 2).alias("cells"),
    )
    ss_cohort = F.col("wd") ** 2 / F.col("w")
    ss_inter = F.col("wdd") - ss_cohort
    # residuals of cohort alone, less those of model and cohort without interaction
    cohort_only = F.col("cells") - F.col("s1") ** 2 / F.col("n1") - F.col("s2") ** 2 / F.col("n2")
    model_only = F.col("cells") - F.col("models")
    ss_model = cohort_only - (model_only - ss_cohort)
    df_res = (F.col("n") - 2 * F.col("k")).cast("double")
    term = lambda name, ss, dof: F.struct(F.lit(name).alias("term"), ss.alias("sum_sq"), dof.cast("double").alias("df"))
    k = F.col("k")
    terms = F.array(term("model", ss_model, k - 1), term("cohort", ss_cohort, F.lit(1)), term("model:cohort", ss_inter, k - 1), term("residual", F.col("rss"), df_res))
    out = s.select(F.explode(terms).alias("t"), (F.col("rss") / F.nullif(df_res, F.lit(0.0))).alias("mse"), df_res.alias("df_res")).select("t.*", "mse", "df_res")
    f = F.when(F.col("term") != "residual", F.col("sum_sq") / F.col("df") / F.nullif(F.col("mse"), F.lit(0.0)))
    return out.select("term", "sum_sq", "df", f.alias("f"), tails.f_upper(f, F.col("df"), F.col("df_res")).alias("p_value"))


def effects_by_group(df: DataFrame, group: str, level: str, metric: str, reference: int = 1, tests: int = 54, alpha: float = 0.05) -> DataFrame:
    """Regression of the metric on the level, for each group: difference to the reference level, t and p.

    ``n_tiles`` is the group's number of rows; p is corrected for ``tests`` tests, whatever the number of levels.
    """
    cells = group_stats(df, [group, level], metric)
    whole = cells.groupBy(group).agg(
        F.sum("n").alias("n_tiles"), F.count("*").alias("levels"), F.sum("ss").alias("rss"),
        F.max(F.when(F.col(level) == reference, F.col("mean"))).alias("mean_1"), F.max(F.when(F.col(level) == reference, F.col("n"))).alias("n_1"),
    )
    j = cells.filter(F.col(level) != reference).join(whole, group)
    dof = (F.col("n_tiles") - F.col("levels")).cast("double")
    coef = F.col("mean") - F.col("mean_1")
    t = coef / F.nullif(F.sqrt(F.col("rss") / F.nullif(dof, F.lit(0.0)) * (1 / F.col("n") + 1 / F.col("n_1"))), F.lit(0.0))
    p = tails.student_two_sided(t, dof)
    out = j.select(group, level, "n_tiles", coef.alias("coef"), t.alias("t"), p.alias("p_value"))
    return out.withColumn("p_value_bonferroni", F.least(F.lit(1.0), F.col("p_value") * tests)).withColumn("significant_bonferroni", F.col("p_value") * tests <= alpha)


def _reml(cells: pd.DataFrame, reference: int) -> pd.DataFrame:
    """Fit of a random intercept from sums of cells (group, level, n, mean, ss), balanced or not.

    The variance ratio is found on the profile of the restricted likelihood; all else has a closed form given it.
    """
    levels, groups = sorted(cells["level"].unique()), sorted(cells["group"].unique())
    n, total = np.zeros((len(groups), len(levels))), np.zeros((len(groups), len(levels)))
    for g, l, k, m in cells[["group", "level", "n", "mean"]].itertuples(index=False):
        n[groups.index(g), levels.index(l)] += k
        total[groups.index(g), levels.index(l)] += k * m
    yy, size, p = float((cells["ss"] + cells["n"] * cells["mean"] ** 2).sum()), n.sum(), len(levels)

    def fit(ratio: float):
        shrink = ratio / (1 + ratio * n.sum(1))
        a = np.diag(n.sum(0)) - (n * shrink[:, None]).T @ n
        b = total.sum(0) - (n * (shrink * total.sum(1))[:, None]).sum(0)
        beta = np.linalg.solve(a, b)
        rss = yy - float((shrink * total.sum(1) ** 2).sum()) - float(b @ beta)
        sigma2 = max(rss, 1e-300) / (size - p)
        deviance = (size - p) * math.log(sigma2) + np.log1p(ratio * n.sum(1)).sum() + np.linalg.slogdet(a)[1]
        return deviance, beta, sigma2, np.linalg.inv(a)

    grid = np.linspace(-25, 10, 141)
    found = [fit(math.exp(x))[0] for x in grid]
    k = int(np.argmin(found))
    low, high = grid[max(k - 1, 0)], grid[min(k + 1, len(grid) - 1)]
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(80):
        c, d = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, d) if fit(math.exp(c))[0] < fit(math.exp(d))[0] else (c, high)
    ratio = math.exp((low + high) / 2)
    ratio = 0.0 if fit(0.0)[0] <= fit(ratio)[0] else ratio
    deviance, beta, sigma2, inverse = fit(ratio)
    base = levels.index(reference)
    rows = []
    for j, level in enumerate(levels):
        if j != base:
            se = math.sqrt(max(sigma2 * (inverse[j, j] + inverse[base, base] - 2 * inverse[j, base]), 0.0))
            coef = beta[j] - beta[base]
            z = coef / se if se else None
            rows.append((int(level), float(coef), z, math.erfc(abs(z) / math.sqrt(2)) if z is not None else None, ratio * sigma2, -0.5 * (deviance + (size - p) * (1 + math.log(2 * math.pi))), bool(0 < k < len(grid) - 1 or ratio == 0), None))
    return pd.DataFrame(rows, columns=_MIXED)


_MIXED = ["level", "coef", "z", "p_value", "group_var", "log_likelihood", "converged", "error"]


def random_intercept(df: DataFrame, group: str, level: str, metric: str, reference: int = 1) -> DataFrame:
    """Coefficients of levels against the reference with a random intercept for each group, by restricted maximum
    likelihood; designs need not be balanced. ``coef, z, p_value, group_var, log_likelihood, converged, error``.

    The rows are reduced to n, mean and sum of squares of each cell of the design (models by perturbations), from which
    the fit is made. A fit that cannot be made is one row with its ``error`` and nulls.
    """
    cells = group_stats(df, [group, level], metric).select(F.col(group).alias("group"), F.col(level).alias("level"), "n", "mean", "ss")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        try:
            return _reml(frame, reference)
        except (ValueError, ZeroDivisionError, np.linalg.LinAlgError) as error:
            return pd.DataFrame([(None, None, None, None, None, None, False, f"{type(error).__name__}: {error}"[:200])], columns=_MIXED)

    # one row for each cell of the design, whatever the number of observations
    out = cells.groupBy(F.lit(0).alias("all")).applyInPandas(fit, "level int, coef double, z double, p_value double, group_var double, log_likelihood double, converged boolean, error string")
    return out.withColumnRenamed("level", level)


def model_effect(df: DataFrame, group: str, metric: str, alpha: float = 0.05, least: int = 3) -> DataFrame:
    """The study's omnibus test over groups and, only where its p is below ``alpha``, all pairs of groups.

    Where every group is normal by Shapiro-Wilk: ANOVA and Tukey's pairs; else Kruskal-Wallis and Dunn's. One row for
    the omnibus test (null groups) and one for each pair: ``test_used, status, group_a, group_b, statistic, p_value,
    error``. Fewer than ``least`` values in a group, or a fit without spread, is a row with status ``failed``.
    """
    from .cells import shapiro_wilk

    spark = df.sparkSession
    out = "test_used string, status string, group_a string, group_b string, statistic double, p_value double, error string"
    failed = lambda test, why: spark.createDataFrame([(test, "failed", None, None, None, None, why)], out)
    # a row for each group comes to the driver, to choose the branch
    seen = group_stats(df, [group], metric).join(shapiro_wilk(df, [group], metric), group, "left").select("n", "ss", "sw_p").collect()
    if len(seen) < 2 or min(r["n"] for r in seen) < least:
        return failed(None, f"a group has fewer than {least} values")
    if not any(r["ss"] > 0 for r in seen):
        return failed(None, "no spread within groups")
    normal = all(r["sw_p"] is not None and r["sw_p"] > alpha for r in seen)
    whole, pairs, names = (one_way_anova, tukey_hsd, ("anova", "tukey", "f", "q")) if normal else (kruskal_wallis, dunn_posthoc, ("kruskal_wallis", "dunn", "h", "z"))
    omnibus = whole(df, group, metric).select(F.lit(names[0]).alias("test_used"), F.lit("ok").alias("status"), F.lit(None).cast("string").alias("group_a"), F.lit(None).cast("string").alias("group_b"), F.col(names[2]).alias("statistic"), "p_value", F.lit(None).cast("string").alias("error"))
    omnibus = written(omnibus, "omnibus")  # one row; the pairs' plan is gated by it
    gate = omnibus.filter(F.col("p_value") < alpha).select("status")
    each = pairs(df, group, metric).select(F.lit(names[1]).alias("test_used"), "group_a", "group_b", F.col(names[3]).alias("statistic"), "p_value", F.lit(None).cast("string").alias("error"))
    return omnibus.unionByName(each.crossJoin(F.broadcast(gate)).select(*omnibus.columns))


def paired_conditions(df: DataFrame, keys: list[str], unit: str, condition: str, a: str, b: str, metric: str) -> DataFrame:
    """One row for each unit and key that has both conditions: ``x, y, diff`` in one grouped pass, without a join."""
    value = lambda c: F.max(F.when(F.col(condition) == c, F.col(metric)))
    wide = drop_missing(df, metric).filter(F.col(condition).isin(a, b)).groupBy(*keys, unit).agg(value(a).alias("x"), value(b).alias("y"))
    return wide.filter("x IS NOT NULL AND y IS NOT NULL").withColumn("diff", F.round(F.col("x") - F.col("y"), 9))


def wilcoxon_signed_rank(pairs: DataFrame, keys: list[str], diff: str = "diff", least: int = 10) -> DataFrame:
    """Per key: ``n_pairs, n_pos, n_neg, w`` (the lesser rank sum), ``z``, p, medians and Cohen's 2g.

    Zero differences are dropped before ranking; ties share mid-ranks and correct the variance. Below ``least`` pairs
    there is no test.
    """
    d = F.col(diff)
    pairs = written(pairs, "pairs")  # counted, ranked and selected from
    base = pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.count_if(d > 0).alias("n_pos"), F.count_if(d < 0).alias("n_neg"))
    middle = prefix.medians(pairs, keys, ["x", "y", diff])
    base = base.join(middle.select(*keys, F.col("median_x").alias("median_a"), F.col("median_y").alias("median_b"), F.col(f"median_{diff}").alias("median_diff")), keys, "left")
    values = pairs.filter(d != 0).groupBy(*keys, F.abs(d).alias("v")).agg(F.count_if(d > 0).alias("p"), F.count("*").alias("t"))
    t, mid = F.col("t"), F.col("mid")
    sums = prefix.before(values, "v", "t", keys=keys).withColumn("mid", F.col("before") + (t + 1) / 2).groupBy(*keys).agg(
        F.sum(F.col("p") * mid).alias("plus"), F.sum((t - F.col("p")) * mid).alias("minus"), tie_term(t).alias("ties"), F.sum("t").cast("double").alias("n")
    )
    j = base.join(sums, keys, "left")
    n = F.col("n")
    w = F.least("plus", "minus")
    z = (w - n * (n + 1) / 4) / F.nullif(F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48), F.lit(0.0))
    tested = F.col("n_pairs") >= least
    # counted out for few differences without ties and zeros
    few = (n <= EXACT) & (F.col("ties") == 0) & (n == F.col("n_pairs"))
    g2 = (F.col("n_pos") - F.col("n_neg")) / F.nullif(F.col("n_pos") + F.col("n_neg"), F.lit(0))
    return j.select(
        *keys, "n_pairs", "n_pos", "n_neg", F.when(tested, w).alias("w"), F.when(tested, z).alias("z"), F.when(tested & few, tails.wilcoxon_exact(F.when(tested & few, w), n)).when(tested, tails.normal_two_sided(z)).alias("p_value"),
        "median_a", "median_b", "median_diff", g2.alias("cohens_2g"),
    )


def direction(p: Column, difference: Column, a: str, b: str, none: str, alpha: float = 0.05) -> Column:
    """Label ``a`` or ``b`` where p is below ``alpha`` and the difference is above or below 0, else ``none`` (so also for
    a difference of 0); null without a p."""
    sure = p < alpha
    return F.when(sure & (difference > 0), a).when(sure & (difference < 0), b).when(p.isNotNull(), none)


def with_prediction(tests: DataFrame, a: str, b: str, none: str, predicted: Column, difference: str = "median_diff") -> DataFrame:
    """``observed``, ``predicted`` and ``confirmed``: whether they are one label (null without a test)."""
    seen = tests.withColumn("observed", direction(F.col("p_value"), F.col(difference), a, b, none)).withColumn("predicted", predicted)
    return seen.withColumn("confirmed", F.col("observed") == F.col("predicted"))


def cliffs_delta(u: Column, n_a: Column, n_b: Column) -> Column:
    return 2 * u / (n_a * n_b) - 1


def cliffs_label(delta: Column) -> Column:
    d = F.abs(delta)
    return F.when(d < 0.147, "negligible").when(d < 0.33, "small").when(d < 0.474, "medium").when(d.isNotNull(), "large")


def family_condition_test(df: DataFrame, model: str, family_of: dict[str, str], a: str, b: str, condition: str, value: str, metric: str, least: int = 10, alpha: float = 0.05) -> DataFrame:
    """One condition's similarities pooled by model family and compared: the two-sample test with what it shows.

    ``observed`` is ``<a>_higher``, ``<b>_higher`` or ``no_difference``; below ``least`` values the row is skipped.
    """
    from .cells import two_sample_test

    pairs = [F.lit(x) for item in family_of.items() for x in item]
    rows = df.filter(F.col(condition) == value).withColumn("family", F.element_at(F.create_map(*pairs), F.col(model))).filter(F.col("family").isin(a, b))
    t = two_sample_test(rows, [condition], metric, F.col("family") == a, least)
    seen = direction(F.col("p_value"), F.col("mean_a") - F.col("mean_b"), f"{a}_higher", f"{b}_higher", "no_difference", alpha)
    return t.withColumn("observed", F.when(~F.col("skipped"), seen))


def _range_tail(q: float, k: int, dof: float) -> float:
    """P(studentised range of k means > q) by quadrature over the scale's and the least mean's distribution."""
    z = np.linspace(-8, 8, 801)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    phi = lambda x: 0.5 * np.vectorize(math.erfc)(-x / math.sqrt(2))
    low = phi(z)
    wide = 9 / math.sqrt(2 * dof)  # the scale's spread: its grid follows it
    s = np.linspace(max(1e-4, 1 - wide), 1 + wide, 400)
    log_s = dof / 2 * math.log(dof) - math.lgamma(dof / 2) - (dof / 2 - 1) * math.log(2) + (dof - 1) * np.log(s) - dof * s * s / 2
    # the chance that k values spread no further than w, at each width that the scale makes of q
    inner = np.array([k * np.trapezoid(density * np.maximum(phi(z + w) - low, 0) ** (k - 1), z) for w in q * s])
    return float(min(1.0, max(0.0, 1 - np.trapezoid(np.exp(log_s) * inner, s))))


def tukey_hsd(df: DataFrame, group: str, metric: str, alpha: float = 0.05) -> DataFrame:
    """Pairs of groups a < b: difference of means, p of the studentised range (Tukey-Kramer) and rejection."""
    g = group_stats(df, [group], metric)
    every = Window.partitionBy()
    g = g.withColumn("k", F.count("*").over(every)).withColumn("dof", (F.sum("n").over(every) - F.col("k")).cast("double")).withColumn("mse", F.sum("ss").over(every) / F.nullif(F.col("dof"), F.lit(0.0)))
    a = g.select(F.col(group).alias("group_a"), F.col("mean").alias("m_a"), F.col("n").alias("n_a"), "k", "dof", "mse")
    b = g.select(F.col(group).alias("group_b"), F.col("mean").alias("m_b"), F.col("n").alias("n_b"))
    pairs = a.join(b, F.col("group_a") < F.col("group_b")).withColumn("difference", F.col("m_b") - F.col("m_a"))
    pairs = pairs.withColumn("q", F.abs("difference") / F.nullif(F.sqrt(F.col("mse") / 2 * (1 / F.col("n_a") + 1 / F.col("n_b"))), F.lit(0.0)))

    @F.pandas_udf("double")
    def tail(q: pd.Series, k: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([_range_tail(x, int(n), d) if x == x and x is not None and d > 0 else None for x, n, d in zip(q, k, dof, strict=True)], dtype="float64")

    p = F.nanvl(tail("q", "k", "dof"), F.lit(None).cast("double"))
    return pairs.select("group_a", "group_b", "difference", "q", p.alias("p_value")).withColumn("reject", F.col("p_value") < alpha)
