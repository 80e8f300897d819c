"""SQL text of tail probabilities and test statistics, for the oracles: by quadrature, apart from what Spark evaluates."""

from __future__ import annotations

_STEPS = 4000


def _simpson(f: str, low: str, high: str, steps: int = _STEPS) -> str:
    """Integral of ``f``, SQL text in ``x``, by Simpson's rule."""
    h = f"(({high}) - ({low})) / {float(steps)}::DOUBLE"
    at = f.replace("«x»", f"(({low}) + i * {h})")
    return f"(list_sum(list_transform(range({steps + 1}), lambda i: (CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({at}))) * {h} / 3)"


def normal2(z: str) -> str:
    """Two-sided normal tail."""
    return f"(2 / sqrt(2 * pi()) * {_simpson('exp(-«x» * «x» / 2)', f'abs({z})', f'abs({z}) + 12')})"


def student2(t: str, df: str) -> str:
    """Two-sided tail of Student's t: the density over the angle whose tangent is t / sqrt(df)."""
    scale = f"2 * exp(lgamma((({df}) + 1) / 2) - lgamma(({df}) / 2)) / sqrt(pi())"
    return f"({scale} * {_simpson(f'pow(cos(«x»), ({df}) - 1)', f'atan(abs({t}) / sqrt({df}))', f'least(pi() / 2, atan(abs({t}) / sqrt({df})) + 14 / sqrt({df}))')})"


def f_upper(f: str, a: str, b: str) -> str:
    scale = f"2 * exp(lgamma((({a}) + ({b})) / 2) - lgamma(({a}) / 2) - lgamma(({b}) / 2))"
    return f"({scale} * {_simpson(f'pow(sin(«x»), ({b}) - 1) * pow(cos(«x»), ({a}) - 1)', f'greatest(0.0, asin(sqrt(({b}) / (({b}) + ({a}) * ({f})))) - 14 / sqrt({b}))', f'asin(sqrt(({b}) / (({b}) + ({a}) * ({f}))))')})"


def chi2_upper(x: str, df: str) -> str:
    scale = f"2 / (pow(2, ({df}) / 2.0) * exp(lgamma(({df}) / 2.0)))"
    return f"({scale} * {_simpson(f'pow(«x», ({df}) - 1) * exp(-«x» * «x» / 2)', f'sqrt({x})', f'sqrt({x}) + 12')})"


def _poly(coefficients: list[str], x: str) -> str:
    """Horner's rule, the highest power first."""
    out = coefficients[0]
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c})"
    return out


# The published rational approximations of the normal quantile (AS 241), the highest power first.
_CENTRE = (
    ["2509.0809287301226727", "33430.575583588128105", "67265.770927008700853", "45921.953931549871457", "13731.693765509461125", "1971.5909503065514427", "133.14166789178437745", "3.387132872796366608"],
    ["5226.495278852854561", "28729.085735721942674", "39307.89580009271061", "21213.794301586595867", "5394.1960214247511077", "687.1870074920579083", "42.313330701600911252", "1.0"],
)
_TAIL = (
    ["7.7454501427834140764e-4", "0.0227238449892691845833", "0.24178072517745061177", "1.27045825245236838258", "3.64784832476320460504", "5.7694972214606914055", "4.6303378461565452959", "1.42343711074968357734"],
    ["1.05075007164441684324e-9", "5.475938084995344946e-4", "0.0151986665636164571966", "0.14810397642748007459", "0.68976733498510000455", "1.6763848301838038494", "2.05319162663775882187", "1.0"],
)


def normal_quantile(p: str) -> str:
    """For p between 1e-11 and 1 - 1e-11."""
    q, r, s = f"(({p}) - 0.5)", f"(0.180625 - (({p}) - 0.5) * (({p}) - 0.5))", f"(sqrt(-ln(least(({p}), 1 - ({p})))) - 1.6)"
    doubles = lambda c: [f"{x}::DOUBLE" for x in c]
    centre = f"{q} * {_poly(doubles(_CENTRE[0]), r)} / {_poly(doubles(_CENTRE[1]), r)}"
    tail = f"sign{q} * {_poly(doubles(_TAIL[0]), s)} / {_poly(doubles(_TAIL[1]), s)}"
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {centre} ELSE {tail} END)"


def shapiro(keys: list[str], source: str) -> str:
    """CTEs up to ``sw`` (keys, sw_n, w, sw_p) over ``source`` with the keys and ``x``: Royston's approximation from
    the sorted values and their weights, joined as lists of each group. Groups of 12 values or more."""
    k = ", ".join(keys)
    # Fixed values of the published approximation stand in the two polynomials of u and those of ln n
    return f"""
sw_i AS (SELECT {k}, x, row_number() OVER (PARTITION BY {k} ORDER BY x) AS i, count(*) OVER (PARTITION BY {k}) AS n FROM {source}),
sw_m AS (SELECT *, {normal_quantile('(i - 0.375::DOUBLE) / (n + 0.25::DOUBLE)')} AS m FROM sw_i),
sw_g AS (SELECT {k}, any_value(n) AS n, sum(m * m) AS mm, max(m) AS m1, max(m) FILTER (i = n - 1) AS m2, 1 / sqrt(any_value(n)::DOUBLE) AS u, max(x) - min(x) AS spread, var_samp(x) * (count(*) - 1) AS ss FROM sw_m GROUP BY {k}),
sw_a AS (SELECT *, {_poly(['-2.706056::DOUBLE', '4.434685', '-2.071190', '-0.147981', '0.221157', '0'], 'u')} + m1 / sqrt(mm) AS a1, {_poly(['-3.582633::DOUBLE', '5.682633', '-1.752461', '-0.293762', '0.042981', '0'], 'u')} + m2 / sqrt(mm) AS a2 FROM sw_g),
sw_p AS (SELECT *, sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) AS phi FROM sw_a),
sw_w AS (SELECT {', '.join('r.' + c for c in keys)}, any_value(r.n) AS n, any_value(ss) AS ss,
    sum(r.x * CASE WHEN i = r.n THEN a1 WHEN i = r.n - 1 THEN a2 WHEN i = 1 THEN -a1 WHEN i = 2 THEN -a2 ELSE r.m / phi END) AS top
  FROM sw_m r JOIN sw_p q ON {' AND '.join(f'r.{c} IS NOT DISTINCT FROM q.{c}' for c in keys)} GROUP BY ALL),
sw_z AS (SELECT *, CASE WHEN ss > 1e-20 THEN least(top * top / ss, 1.0) END AS w, ln(n::DOUBLE) AS l FROM sw_w),
sw AS (SELECT {k}, n AS sw_n, w, CASE WHEN w IS NULL THEN NULL WHEN z > 0 THEN {normal2('z')} / 2 ELSE 1 - {normal2('z')} / 2 END AS sw_p FROM (
  SELECT *, (ln(greatest(1 - w, 1e-300)) - {_poly(['0.0038915::DOUBLE', '-0.083751', '-0.31082', '-1.5861'], 'l')}) / exp({_poly(['0.0030302::DOUBLE', '-0.082676', '-0.4803'], 'l')}) AS z FROM sw_z))"""


def two_sample(keys: list[str], source: str, least: int = 3) -> str:
    """CTEs up to ``tested`` over ``source`` with the keys, ``a`` (true for the first group) and ``x``."""
    k = ", ".join(keys)
    join = lambda l, r: " AND ".join(f"{l}.{c} IS NOT DISTINCT FROM {r}.{c}" for c in keys)
    return f"""{shapiro([*keys, 'a'], source)},
ts_m AS (SELECT {k}, count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, CASE WHEN min(x) FILTER (a) = max(x) FILTER (a) THEN min(x) FILTER (a) ELSE avg(x) FILTER (a) END AS mean_a,
    CASE WHEN min(x) FILTER (NOT a) = max(x) FILTER (NOT a) THEN min(x) FILTER (NOT a) ELSE avg(x) FILTER (NOT a) END AS mean_b,
    CASE WHEN min(x) FILTER (a) = max(x) FILTER (a) THEN 0 ELSE var_samp(x) FILTER (a) END AS var_a, CASE WHEN min(x) FILTER (NOT a) = max(x) FILTER (NOT a) THEN 0 ELSE var_samp(x) FILTER (NOT a) END AS var_b FROM {source} GROUP BY {k}),
ts_v AS (SELECT {k}, x, count(*) FILTER (a) AS c_a, count(*) AS c FROM {source} GROUP BY {k}, x),
ts_r AS (SELECT *, sum(c) OVER (PARTITION BY {k} ORDER BY x ROWS UNBOUNDED PRECEDING) - c + (c + 1) / 2.0::DOUBLE AS mid FROM ts_v),
ts_u AS (SELECT {k}, sum(c_a * mid) - sum(c_a) * (sum(c_a) + 1) / 2.0::DOUBLE AS u, sum(c_a)::DOUBLE AS na, sum(c - c_a)::DOUBLE AS nb, sum(c * c * c - c)::DOUBLE AS ties FROM ts_r GROUP BY {k}),
ts_z AS (SELECT *, (greatest(u, na * nb - u) - na * nb / 2 - 0.5) / nullif(sqrt(na * nb / 12 * ((na + nb + 1) - ties / ((na + nb) * (na + nb - 1)))), 0) AS z FROM ts_u),
ts_j AS (SELECT m.*, z.u, z.z, p.sw_p AS sw_a, q.sw_p AS sw_b, var_a / n_a + var_b / n_b AS se FROM ts_m m JOIN ts_z z ON {join('m', 'z')} LEFT JOIN sw p ON {join('m', 'p')} AND p.a LEFT JOIN sw q ON {join('m', 'q')} AND NOT q.a),
ts_d AS (SELECT *, CASE WHEN least(n_a, n_b) < {least} THEN NULL WHEN var_a = 0 AND var_b = 0 AND mean_a = mean_b THEN 'zero_variance_identical' WHEN var_a = 0 AND var_b = 0 THEN 'zero_variance_distinct_constants'
    WHEN coalesce(sw_a > 0.05 AND sw_b > 0.05, false) THEN 'welch_t' ELSE 'mann_whitney_u' END AS test_used, (mean_a - mean_b) / nullif(sqrt(se), 0) AS t,
    se * se / nullif(pow(var_a / n_a, 2) / (n_a - 1) + pow(var_b / n_b, 2) / (n_b - 1), 0) AS df, (mean_a - mean_b) / nullif(sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / nullif(n_a + n_b - 2, 0)), 0) AS d FROM ts_j),
ts_p AS (SELECT *, CASE test_used WHEN 'zero_variance_identical' THEN 1.0 WHEN 'zero_variance_distinct_constants' THEN 0.0 WHEN 'welch_t' THEN {student2('t', 'df')} WHEN 'mann_whitney_u' THEN least(1.0, CASE WHEN z < 0 THEN 2 - {normal2('z')} ELSE {normal2('z')} END) END AS p_value,
    CASE test_used WHEN 'zero_variance_identical' THEN 0.0 WHEN 'zero_variance_distinct_constants' THEN CASE WHEN mean_a > mean_b THEN 'inf' ELSE '-inf' END::DOUBLE WHEN 'welch_t' THEN t WHEN 'mann_whitney_u' THEN u END AS statistic,
    CASE WHEN test_used IS NULL THEN NULL WHEN test_used LIKE 'zero%' THEN 0.0 ELSE coalesce(d, 0) END AS cohens_d FROM ts_d),
tested AS (SELECT {k}, test_used, round(statistic, 4) AS statistic, p_value, round(cohens_d, 5) + 0.0 AS cohens_d, CASE WHEN abs(cohens_d) < 0.2 THEN 'small' WHEN abs(cohens_d) < 0.8 THEN 'medium' WHEN cohens_d IS NOT NULL THEN 'large' END AS effect_size,
  n_a, n_b, CASE WHEN test_used IS NOT NULL THEN round(mean_a, 9) END AS mean_a, CASE WHEN test_used IS NOT NULL THEN round(mean_b, 9) END AS mean_b, CASE WHEN test_used NOT LIKE 'zero%' THEN round(sw_a, 6) END AS shapiro_p_a,
  CASE WHEN test_used NOT LIKE 'zero%' THEN round(sw_b, 6) END AS shapiro_p_b, CASE WHEN test_used IS NOT NULL THEN test_used = 'welch_t' END AS both_groups_normal, test_used IS NULL AS skipped, CASE WHEN test_used IS NULL THEN printf('n_a=%d, n_b=%d: fewer than {least} values', n_a, n_b) END AS reason FROM ts_p)"""


def bonferroni(source: str = "tested") -> str:
    p = f"least(1.0, p_value * (SELECT count(p_value) FROM {source}))"
    return f"SELECT * REPLACE (round(p_value, 7) AS p_value), round({p}, 7) AS p_value_bonferroni, {p} <= 0.05 AS significant_bonferroni FROM {source}"


def benjamini_hochberg(source: str = "tested") -> str:
    return f"""SELECT * EXCLUDE (rk, m, q) REPLACE (round(p_value, 7) AS p_value), round(q, 7) AS p_value_fdr_bh, q <= 0.05 AS significant_fdr_bh FROM (
 SELECT *, CASE WHEN p_value IS NOT NULL THEN least(1.0, min(p_value * m / rk) OVER (PARTITION BY p_value IS NULL ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) END AS q FROM (
 SELECT *, row_number() OVER (PARTITION BY p_value IS NULL ORDER BY p_value) AS rk, count(p_value) OVER () AS m FROM {source}))"""
