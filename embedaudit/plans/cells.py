"""Queries of vectors, metric tables and their statistics, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embedaudit.functions import text
from embedaudit.functions.rounding import half_away
from embedaudit.functions.vectors import cosine, norm
from embedaudit.operators import cells, cka, families, stores
from embedaudit.operators import study as studies
from embedaudit.sources import study
from embedaudit.sources.scratch import new_path, written

from . import sqltail
from .registry import register

CELL = ["model", "perturbation_id", "severity"]

#: The metric table in SQL; ends where a query's own SELECT begins.
BASE_SQL = """
base AS (SELECT ['uni','conch','quilt_llava','gigapath_tile'][m + 1] AS model, CASE WHEN vec_id % 2 = 0 THEN 'ACC' ELSE 'GDC' END AS cohort,
    CASE WHEN vec_id % 2 = 0 THEN 'ACC' ELSE 'GDC' END || '_' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS sample_id,
    list_transform(range(16 * m + 1, 16 * m + 17), lambda j: CAST(embedding[j] AS DOUBLE)) AS v
  FROM embeddings, range(4) t(m)),
pert AS (SELECT model, cohort, sample_id, v, CAST(p AS INTEGER) AS perturbation_id, ['mild','moderate','severe'][s] AS severity,
    CASE WHEN s = 2 AND p IN (3, 17, 18) THEN v ELSE list_transform(range(1, 17), lambda j: v[j] * (1.0::DOUBLE + 0.1::DOUBLE * s * ((5 * p + 3 * j) % 7 - 3) / 3.0::DOUBLE) + 0.02::DOUBLE * s * ((7 * p + 13 * j) % 11 - 5) / 5.0::DOUBLE) END AS w
  FROM base, range(1, 19) a(p), range(1, 4) b(s))"""
METRIC_SQL = f"""WITH {BASE_SQL},
metric AS (SELECT model, sample_id, cohort, perturbation_id, severity,
    round(list_dot_product(v, w) / ((sqrt(list_dot_product(v, v)) + 1e-12) * (sqrt(list_dot_product(w, w)) + 1e-12)), 6) AS cosine_similarity FROM pert)"""
_MOMENTS = """
moments AS (SELECT model, perturbation_id, severity, count(*) FILTER (cohort = 'ACC') AS n_a, count(*) FILTER (cohort = 'GDC') AS n_b,
    avg(cosine_similarity) FILTER (cohort = 'ACC') AS mean_a, avg(cosine_similarity) FILTER (cohort = 'GDC') AS mean_b,
    CASE WHEN count(*) FILTER (cohort = 'ACC') = 1 THEN 0 ELSE var_samp(cosine_similarity) FILTER (cohort = 'ACC') END AS var_a,
    CASE WHEN count(*) FILTER (cohort = 'GDC') = 1 THEN 0 ELSE var_samp(cosine_similarity) FILTER (cohort = 'GDC') END AS var_b
  FROM metric GROUP BY ALL),
effects AS (SELECT *, CASE WHEN psd = 0 THEN 0 ELSE (mean_a - mean_b) / psd END AS d FROM (
    SELECT *, sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / nullif(n_a + n_b - 2, 0)) AS psd FROM moments))"""


_PAIRS = "(VALUES ('conch', 'quilt_llava'), ('conch', 'uni'), ('quilt_llava', 'uni')) p(model_a, model_b)"
_OUTLIERS = "(VALUES ('gigapath_tile', 'uni'), ('gigapath_tile', 'conch'), ('gigapath_tile', 'quilt_llava')) p(model_a, model_b)"
_COHORT_ROWS = "SELECT model, perturbation_id, severity, cohort = 'ACC' AS a, cosine_similarity AS x FROM metric"


def _pair_rows(pairs: str) -> str:
    return f"SELECT model_a, model_b, perturbation_id, severity, model = model_a AS a, cosine_similarity AS x FROM metric JOIN {pairs} ON model IN (model_a, model_b)"


def _acc():
    return F.col("cohort") == "ACC"



def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _tested(df: DataFrame) -> DataFrame:
    """A family's rows with what two engines agree on: probabilities to 7 digits, statistics to 4."""
    digits = {"statistic": 4, "cohens_d": 5, "mean_a": 9, "mean_b": 9, "shapiro_p_a": 6, "shapiro_p_b": 6}
    return df.select(*[(F.round(c, digits.get(c, 7)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _family_sql(keys: list[str], rows: str, end: str, least: int = 3, before: str = METRIC_SQL) -> str:
    return f"{before}, src AS ({rows}), {sqltail.two_sample(keys, 'src', least)} {end}"


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metric table written once: tests pass over it several times, and a filter on a value would find it again."""
    return written(study.cosine_table(spark, sf_dir), "metric")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values of each cell and cohort with their numbers ``n``, for tests of two groups."""
    return studies.counts_of(study.cosine_table(spark, sf_dir))


@register("cosine_table", METRIC_SQL + " SELECT * FROM metric")
def cosine_table(spark, sf_dir):
    return study.cosine_table(spark, sf_dir)


@register("cohort_cells", METRIC_SQL + "," + _MOMENTS + """ SELECT model, perturbation_id, severity, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
 round(d, 4) + 0.0 AS cohens_d, CASE WHEN abs(round(d, 4)) < 0.2 THEN 'small' WHEN abs(round(d, 4)) < 0.8 THEN 'medium' ELSE 'large' END AS effect_size FROM effects""")  # fmt: skip
def cohort_cells(spark, sf_dir):
    m = cells.cell_moments(_stored(spark, sf_dir), CELL, "cosine_similarity", _acc()).withColumn("d", F.round(cells.cohens_d(), 4))
    return m.select(*CELL, "n_a", "n_b", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), F.col("d").alias("cohens_d"), cells.effect_size_label(F.col("d")).alias("effect_size"))


@register("cell_variances", METRIC_SQL + "," + _MOMENTS + " SELECT model, perturbation_id, severity, round(var_a, 9) AS var_a, round(var_b, 9) AS var_b FROM moments")
def cell_variances(spark, sf_dir):
    m = cells.cell_moments(_stored(spark, sf_dir), CELL, "cosine_similarity", _acc())
    return m.select(*CELL, F.round("var_a", 9).alias("var_a"), F.round("var_b", 9).alias("var_b"))


@register("embedding_keys", f"""WITH {BASE_SQL} SELECT model, 'baseline__' || sample_id AS key, CAST(NULL AS INTEGER) AS perturbation_id, CAST(NULL AS VARCHAR) AS severity, sample_id FROM base
 UNION ALL SELECT model, printf('p%02d__%s__%s', perturbation_id, severity, sample_id), perturbation_id, severity, sample_id FROM pert""")  # fmt: skip
def embedding_keys(spark, sf_dir):
    base = study.baselines(spark, sf_dir).select("model", text.make_key(F.lit(None).cast("int"), F.lit(None).cast("string"), F.col("sample_id")).alias("key"))
    pert = study.perturbed(spark, sf_dir).select("model", text.make_key(F.col("perturbation_id"), F.col("severity"), F.col("sample_id")).alias("key"))
    return base.unionByName(pert).withColumn("p", text.parse_key(F.col("key"))).select("model", "key", "p.perturbation_id", "p.severity", "p.sample_id")


@register("vector_norms", f"WITH {BASE_SQL} SELECT model, sample_id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM base")
def vector_norms(spark, sf_dir):
    return study.baselines(spark, sf_dir).select("model", "sample_id", F.round(norm("vector"), 6).alias("norm"))


_PAIRWISE_COSINE = f"""WITH {BASE_SQL} SELECT a.sample_id, a.model AS model_a, b.model AS model_b,
 round(list_dot_product(a.v, b.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-12) * (sqrt(list_dot_product(b.v, b.v)) + 1e-12)), 6) AS similarity
 FROM base a JOIN base b ON a.sample_id = b.sample_id AND a.model < b.model"""


@register("cross_model_cosine", _PAIRWISE_COSINE)
def cross_model_cosine(spark, sf_dir):
    base = study.baselines(spark, sf_dir)
    a = base.select("sample_id", F.col("model").alias("model_a"), F.col("vector").alias("x"))
    b = base.select("sample_id", F.col("model").alias("model_b"), F.col("vector").alias("y"))
    return a.join(b, "sample_id").filter("model_a < model_b").select("sample_id", "model_a", "model_b", F.round(cosine("x", "y"), 6).alias("similarity"))


_CKA = f"""WITH {BASE_SQL},
long AS (SELECT model, perturbation_id, severity, cohort, sample_id, i, v[i] AS x, w[i] AS y FROM pert, range(1, 17) t(i)),
sets AS (SELECT * FROM long UNION ALL SELECT model, perturbation_id, severity, 'POOLED', sample_id, i, x, y FROM long),
c AS (SELECT a.model, a.perturbation_id, a.severity, a.cohort, a.i, b.i AS j, count(*) AS n, covar_pop(a.x, b.y) AS xy, covar_pop(a.x, b.x) AS xx, covar_pop(a.y, b.y) AS yy
  FROM sets a JOIN sets b USING (model, perturbation_id, severity, cohort, sample_id) GROUP BY ALL)
SELECT model, perturbation_id, severity, cohort, max(n) AS n_tiles, round(sum(xy * xy) / sqrt(sum(xx * xx) * sum(yy * yy)), 6) AS linear_cka FROM c GROUP BY ALL"""


def cka_table_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    moments = cka.cross_moments(study.pairs(spark, sf_dir), [*CELL, "cohort"], pooled="cohort", width=study.WIDTH)
    return cka.linear_cka(moments, [*CELL, "cohort"])


@register("cka_table", _CKA)
def cka_table(spark, sf_dir):
    return cka_table_of(spark, sf_dir)


_RANKS = METRIC_SQL + """,
vals AS (SELECT model, perturbation_id, severity, cosine_similarity AS value, count(*) FILTER (cohort = 'ACC') AS c_a, count(*) FILTER (cohort <> 'ACC') AS c_b FROM metric GROUP BY ALL),
ranks AS (SELECT *, sum(c_a + c_b) OVER (PARTITION BY model, perturbation_id, severity ORDER BY value ROWS UNBOUNDED PRECEDING) - (c_a + c_b) + (c_a + c_b + 1) / 2.0 AS mid_rank FROM vals),
sums AS (SELECT model, perturbation_id, severity, CAST(sum(c_a) AS DOUBLE) AS na, CAST(sum(c_b) AS DOUBLE) AS nb, CAST(sum(c_a * mid_rank) AS DOUBLE) AS ra,
    CAST(sum((c_a + c_b) * (c_a + c_b) * (c_a + c_b) - (c_a + c_b)) AS DOUBLE) AS ties FROM ranks GROUP BY ALL),
mw AS (SELECT model, perturbation_id, severity, ra - na * (na + 1) / 2 AS u, na, nb, ties,
    sqrt(na * nb / 12 * ((na + nb + 1) - ties / nullif((na + nb) * (na + nb - 1), 0))) AS spread FROM sums)"""  # fmt: skip


@register("mid_ranks", _RANKS + " SELECT model, perturbation_id, severity, value, c_a, c_b, CAST(mid_rank AS DOUBLE) AS mid_rank FROM ranks")
def mid_ranks(spark, sf_dir):
    return cells.mid_ranks(_stored(spark, sf_dir), CELL, "cosine_similarity", _acc()).select(*CELL, "value", "c_a", "c_b", F.col("mid_rank").cast("double").alias("mid_rank"))


@register("mann_whitney", _RANKS + """ SELECT model, perturbation_id, severity, round(u, 3) AS u,
 round((greatest(u, na * nb - u) - na * nb / 2 - 0.5) / nullif(spread, 0), 6) AS u_z, ties AS tie_term FROM mw""")  # fmt: skip
def mann_whitney(spark, sf_dir):
    m = cells.mann_whitney(_stored(spark, sf_dir), CELL, "cosine_similarity", _acc())
    return m.select(*CELL, F.round("u", 3).alias("u"), F.round("u_z", 6).alias("u_z"), "tie_term")


@register("cliffs_delta", _RANKS + """ SELECT model, perturbation_id, severity, round(2 * u / (na * nb) - 1, 6) AS delta,
 CASE WHEN abs(round(2 * u / (na * nb) - 1, 6)) < 0.147 THEN 'negligible' WHEN abs(round(2 * u / (na * nb) - 1, 6)) < 0.33 THEN 'small'
 WHEN abs(round(2 * u / (na * nb) - 1, 6)) < 0.474 THEN 'medium' ELSE 'large' END AS label FROM mw""")  # fmt: skip
def cliffs_delta(spark, sf_dir):
    r = cells.rank_sums(_stored(spark, sf_dir), CELL, "cosine_similarity", _acc())
    u = F.col("rank_sum_a") - F.col("r_n_a") * (F.col("r_n_a") + 1) / 2
    d = r.withColumn("delta", F.round(families.cliffs_delta(u, F.col("r_n_a"), F.col("r_n_b")), 6))
    return d.select(*CELL, "delta", families.cliffs_label(F.col("delta")).alias("label"))


@register("welch_t", METRIC_SQL + "," + _MOMENTS + """ SELECT model, perturbation_id, severity, round((mean_a - mean_b) / sqrt(sa + sb), 5) AS t,
 round((sa + sb) * (sa + sb) / (sa * sa / (n_a - 1) + sb * sb / (n_b - 1)), 3) AS df FROM (SELECT *, var_a / n_a AS sa, var_b / n_b AS sb FROM moments) WHERE sa + sb > 1e-20""")  # fmt: skip
def welch_t(spark, sf_dir):
    m = cells.cell_moments(_stored(spark, sf_dir), CELL, "cosine_similarity", _acc())
    t, dof = cells.welch_t()
    spread = F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b")
    return m.filter(spread > 1e-20).select(*CELL, F.round(t, 5).alias("t"), F.round(dof, 3).alias("df"))


@register("zero_variance_cells", METRIC_SQL + """, v AS (SELECT model, perturbation_id, severity, min(cosine_similarity) AS lo, max(cosine_similarity) AS hi, count(*) AS n FROM metric GROUP BY ALL)
 SELECT model, perturbation_id, severity, n, CASE WHEN lo = hi THEN 'zero_variance_identical' ELSE 'tested' END AS test_used FROM v""")  # fmt: skip
def zero_variance_cells(spark, sf_dir):
    t = cells.two_sample_test(_counts(spark, sf_dir), CELL, "cosine_similarity", _acc(), weight="n")
    return t.select(*CELL, (F.col("n_a") + F.col("n_b")).alias("n"), F.when(F.col("test_used") == "zero_variance_identical", F.col("test_used")).otherwise("tested").alias("test_used"))


_PAIR_KEYS = ["model_a", "model_b", "perturbation_id", "severity"]


@register("cohort_effect", _family_sql(CELL, _COHORT_ROWS, sqltail.bonferroni()))
def cohort_effect(spark, sf_dir):
    return _tested(cells.adjust_bonferroni(cells.two_sample_test(_counts(spark, sf_dir), CELL, "cosine_similarity", _acc(), weight="n")))


def _p_source(spark, sf_dir):
    t = study.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    return t.select("l_suppkey", "l_returnflag", ((F.col("q").cast("long") * 37 + F.col("l_suppkey") * 11) % 1009 / F.lit(20000.0)).alias("p_value"))


_P_SQL = """WITH p AS (SELECT l_suppkey, l_returnflag, (CAST(q AS BIGINT) * 37 + l_suppkey * 11) % 1009 / 20000.0::DOUBLE AS p_value
  FROM (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY ALL))"""


@register("adjust_bonferroni", _P_SQL + """ SELECT l_suppkey, l_returnflag, round(p_value, 9) AS p_value, round(least(1.0, p_value * count(*) OVER (PARTITION BY l_returnflag)), 9) AS p_value_bonferroni,
 least(1.0, p_value * count(*) OVER (PARTITION BY l_returnflag)) <= 0.05 AS significant_bonferroni FROM p""")  # fmt: skip
def adjust_bonferroni(spark, sf_dir):
    return _rounded(cells.adjust_bonferroni(_p_source(spark, sf_dir), family=["l_returnflag"]), 9)


@register("adjust_bh", _P_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY p_value) AS k, count(*) OVER (PARTITION BY l_returnflag) AS m FROM p),
 a AS (SELECT *, least(1.0, min(p_value * m / k) OVER (PARTITION BY l_returnflag ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
 SELECT l_suppkey, l_returnflag, round(p_value, 9) AS p_value, round(q, 9) AS p_value_fdr_bh, q <= 0.05 AS significant_fdr_bh FROM a""")  # fmt: skip
def adjust_bh(spark, sf_dir):
    return _rounded(cells.adjust_bh(_p_source(spark, sf_dir), family=["l_returnflag"]), 9)


@register("pairwise_models", _family_sql(_PAIR_KEYS, _pair_rows(_PAIRS), sqltail.bonferroni()))
def pairwise_models(spark, sf_dir):
    pairs = cells.model_pairs(_counts(spark, sf_dir), list(study.PRIMARY))
    return _tested(cells.adjust_bonferroni(cells.two_sample_test(pairs, _PAIR_KEYS, "cosine_similarity", F.col("is_a"), weight="n")))


@register("pairwise_moments", METRIC_SQL + """, e AS (SELECT a.model AS model_a, b.model AS model_b, perturbation_id, severity, a.m AS mean_a, b.m AS mean_b, a.n AS n_a, b.n AS n_b
   FROM (SELECT model, perturbation_id, severity, avg(cosine_similarity) AS m, count(*) AS n FROM metric GROUP BY ALL) a
   JOIN (SELECT model, perturbation_id, severity, avg(cosine_similarity) AS m, count(*) AS n FROM metric GROUP BY ALL) b USING (perturbation_id, severity)
   WHERE a.model < b.model AND a.model <> 'gigapath_tile' AND b.model <> 'gigapath_tile')
 SELECT model_a, model_b, perturbation_id, severity, n_a, n_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b FROM e""")  # fmt: skip
def pairwise_moments(spark, sf_dir):
    keys = ["model_a", "model_b", "perturbation_id", "severity"]
    m = cells.cell_moments(cells.model_pairs(_stored(spark, sf_dir), list(study.PRIMARY)), keys, "cosine_similarity", F.col("is_a"))
    return m.select(*keys, "n_a", "n_b", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"))


@register("outlier_effect", _family_sql(_PAIR_KEYS, _pair_rows(_OUTLIERS), sqltail.benjamini_hochberg()))
def outlier_effect(spark, sf_dir):
    pairs = cells.outlier_pairs(_counts(spark, sf_dir), study.OUTLIER, list(study.PRIMARY))
    return _tested(cells.adjust_bh(cells.two_sample_test(pairs, _PAIR_KEYS, "cosine_similarity", F.col("is_a"), weight="n")))


@register("outlier_moments", METRIC_SQL + """, g AS (SELECT model, perturbation_id, severity, avg(cosine_similarity) AS m FROM metric GROUP BY ALL)
 SELECT a.model AS model_a, b.model AS model_b, perturbation_id, severity, round(a.m, 6) AS mean_a, round(b.m, 6) AS mean_b
 FROM g a JOIN g b USING (perturbation_id, severity) WHERE a.model = 'gigapath_tile' AND b.model <> 'gigapath_tile'""")  # fmt: skip
def outlier_moments(spark, sf_dir):
    keys = ["model_a", "model_b", "perturbation_id", "severity"]
    m = cells.cell_moments(cells.outlier_pairs(_stored(spark, sf_dir), study.OUTLIER, list(study.PRIMARY)), keys, "cosine_similarity", F.col("is_a"))
    return m.select(*keys, F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"))


_CKA_METRIC = _CKA.replace("\nSELECT model, perturbation_id", ",\nmetric AS (SELECT model, perturbation_id", 1) + ")"
_CKA_COHORT_ROWS = "SELECT model, severity, cohort = 'ACC' AS a, linear_cka AS x FROM metric WHERE cohort <> 'POOLED'"
_CKA_PAIR_KEYS = ["model_a", "model_b", "severity"]


def _cka_pair_rows(pairs: str) -> str:
    return f"SELECT model_a, model_b, severity, model = model_a AS a, linear_cka AS x FROM metric JOIN {pairs} ON model IN (model_a, model_b) WHERE cohort = 'POOLED'"


@register("cohort_effect_cka", _family_sql(["model", "severity"], _CKA_COHORT_ROWS, sqltail.bonferroni(), before=_CKA_METRIC))
def cohort_effect_cka(spark, sf_dir):
    return _tested(cells.adjust_bonferroni(cells.two_sample_test(cka_table_of(spark, sf_dir).filter("cohort <> 'POOLED'"), ["model", "severity"], "linear_cka", _acc())))


@register("pairwise_models_cka", _family_sql(_CKA_PAIR_KEYS, _cka_pair_rows(_PAIRS), sqltail.bonferroni(), before=_CKA_METRIC))
def pairwise_models_cka(spark, sf_dir):
    pairs = cells.model_pairs(cka_table_of(spark, sf_dir).filter("cohort = 'POOLED'"), list(study.PRIMARY))
    return _tested(cells.adjust_bonferroni(cells.two_sample_test(pairs, _CKA_PAIR_KEYS, "linear_cka", F.col("is_a"))))


@register("outlier_effect_cka", _family_sql(_CKA_PAIR_KEYS, _cka_pair_rows(_OUTLIERS), sqltail.benjamini_hochberg(), before=_CKA_METRIC))
def outlier_effect_cka(spark, sf_dir):
    pairs = cells.outlier_pairs(cka_table_of(spark, sf_dir).filter("cohort = 'POOLED'"), study.OUTLIER, list(study.PRIMARY))
    return _tested(cells.adjust_bh(cells.two_sample_test(pairs, _CKA_PAIR_KEYS, "linear_cka", F.col("is_a"))))


@register("shapiro_wilk", f"{METRIC_SQL}, src AS (SELECT model, perturbation_id, severity, cohort, cosine_similarity AS x FROM metric), {sqltail.shapiro([*CELL, 'cohort'], 'src')} SELECT model, perturbation_id, severity, cohort, sw_n, round(w, 7) AS w, round(sw_p, 7) AS sw_p FROM sw")
def shapiro_wilk(spark, sf_dir):
    w = cells.shapiro_wilk(_stored(spark, sf_dir), [*CELL, "cohort"], "cosine_similarity")
    return _rounded(w, 7)


_ANOVA = """g AS (SELECT {g} AS g, count(*) AS n, avg({x}) AS m, var_samp({x}) * (count(*) - 1) AS ss FROM {t} GROUP BY 1),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS between, sum(ss) AS within FROM g)
SELECT k, CAST(n AS BIGINT) AS n, round(f, 4) AS f, round(«p», 7) AS p_value FROM (SELECT *, between / (k - 1) / (within / (n - k)) AS f FROM s)""".replace("«p»", sqltail.f_upper("f", "k - 1", "CAST(n - k AS DOUBLE)"))


def _anova_sql(group: str, value: str, rows: str) -> str:
    return _ANOVA.replace("{g}", group).replace("{x}", value).replace("{t}", rows)


@register("anova_returnflag", "WITH " + _anova_sql("l_returnflag", "l_extendedprice", "lineitem"))
def anova_returnflag(spark, sf_dir):
    a = families.one_way_anova(study.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice")
    return a.select("k", "n", F.round("f", 4).alias("f"), F.round("p_value", 7).alias("p_value"))


@register("anova_models", METRIC_SQL + ", " + _anova_sql("model", "cosine_similarity", "metric"))
def anova_models(spark, sf_dir):
    a = families.one_way_anova(_stored(spark, sf_dir), "model", "cosine_similarity")
    return a.select("k", "n", F.round("f", 4).alias("f"), F.round("p_value", 7).alias("p_value"))


_KW = """v AS (SELECT {g} AS g, {x} AS value, count(*) AS c FROM {t} GROUP BY ALL), d AS (SELECT value, sum(c) AS t FROM v GROUP BY value),
r AS (SELECT value, t, sum(t) OVER (ORDER BY value ROWS UNBOUNDED PRECEDING) - t + (t + 1) / 2.0::DOUBLE AS mid FROM d),
q AS (SELECT g, sum(c * mid)::DOUBLE AS rs, sum(c)::DOUBLE AS n FROM v JOIN r USING (value) GROUP BY g),
z AS (SELECT sum(t)::DOUBLE AS total, sum(t * t * t - t)::DOUBLE AS ties FROM d)"""
_KW_END = " SELECT k, round(h, 4) AS h, round(" + sqltail.chi2_upper("h", "k - 1") + ", 7) AS p_value FROM (SELECT count(*) AS k, (12 / (max(total) * (max(total) + 1)) * sum(rs * rs / n) - 3 * (max(total) + 1)) / (1 - max(ties) / (max(total) * max(total) * max(total) - max(total))) AS h FROM q, z)"


@register("kruskal_events", "WITH " + _KW.format(g="event_type", x="round(value, 2)", t="events") + _KW_END)
def kruskal_events(spark, sf_dir):
    e = study.table(spark, sf_dir, "events").select("event_type", F.round("value", 2).alias("value"))
    return families.kruskal_wallis(e, "event_type", "value").select("k", F.round("h", 4).alias("h"), F.round("p_value", 7).alias("p_value"))


@register("kruskal_models", METRIC_SQL + ", " + _KW.format(g="model", x="cosine_similarity", t="metric") + _KW_END)
def kruskal_models(spark, sf_dir):
    return families.kruskal_wallis(_stored(spark, sf_dir), "model", "cosine_similarity").select("k", F.round("h", 4).alias("h"), F.round("p_value", 7).alias("p_value"))


@register("dunn_models", METRIC_SQL + ", " + _KW.format(g="model", x="cosine_similarity", t="metric") + """, dz AS (SELECT a.g AS group_a, b.g AS group_b,
 (a.rs / a.n - b.rs / b.n) / sqrt((total * (total + 1) / 12 - ties / (12 * (total - 1))) * (1 / a.n + 1 / b.n)) AS dz FROM q a JOIN q b ON a.g < b.g, z)
 SELECT group_a, group_b, round(dz, 5) AS z, round(least(1.0, count(*) OVER () * """ + sqltail.normal2("dz") + "), 7) AS p_value FROM dz")  # fmt: skip
def dunn_models(spark, sf_dir):
    return families.dunn_posthoc(_stored(spark, sf_dir), "model", "cosine_similarity").select("group_a", "group_b", F.round("z", 5).alias("z"), F.round("p_value", 7).alias("p_value"))


@register("interaction_effect", METRIC_SQL + """,
c AS (SELECT model, cohort, count(*)::DOUBLE AS n, avg(cosine_similarity) AS y, var_samp(cosine_similarity) * (count(*) - 1) AS ss FROM metric GROUP BY ALL),
m AS (SELECT model, a.n AS n1, b.n AS n2, a.y AS y1, b.y AS y2, a.ss + b.ss AS rss, a.n * b.n / (a.n + b.n) AS w, a.y - b.y AS d FROM c a JOIN c b USING (model) WHERE a.cohort = 'ACC' AND b.cohort = 'GDC'),
s AS (SELECT sum(w * d) * sum(w * d) / sum(w) AS ssc, sum(w * d * d) - sum(w * d) * sum(w * d) / sum(w) AS ssi, sum(rss) AS rss, count(*) AS k, sum(n1 + n2) AS n FROM m)
SELECT unnest(['cohort', 'model:cohort', 'residual']) AS term, unnest([round(ssc, 6), round(ssi, 6), round(rss, 6)]) AS sum_sq FROM s""")  # fmt: skip
def interaction_effect(spark, sf_dir):
    out = families.interaction_effect(_stored(spark, sf_dir), "model", _acc(), "cosine_similarity")
    return out.filter("term <> 'model'").select("term", F.round("sum_sq", 6).alias("sum_sq"))


_INTERACTION = METRIC_SQL + """,
c AS (SELECT model, cohort, count(*)::DOUBLE AS n, avg(cosine_similarity) AS y, var_samp(cosine_similarity) * (count(*) - 1) AS ss FROM metric GROUP BY ALL),
m AS (SELECT model, a.n AS n1, b.n AS n2, a.y AS y1, b.y AS y2, a.ss + b.ss AS rss, a.n * b.n / (a.n + b.n) AS w, a.y - b.y AS d FROM c a JOIN c b USING (model) WHERE a.cohort = 'ACC' AND b.cohort = 'GDC'),
s AS (SELECT sum(w * d) * sum(w * d) / sum(w) AS ssc, sum(w * d * d) - sum(w * d) * sum(w * d) / sum(w) AS ssi, sum(rss) AS rss, count(*) AS k, sum(n1 + n2) AS n,
   -- the model's: what is explained beyond cohorts alone
   sum(n1 * y1 * y1 + n2 * y2 * y2) - sum(n1 * y1) * sum(n1 * y1) / sum(n1) - sum(n2 * y2) * sum(n2 * y2) / sum(n2) - (sum(w * d * d) - sum(w * d) * sum(w * d) / sum(w)) AS ssm FROM m),
t AS (SELECT unnest(['model', 'cohort', 'model:cohort', 'residual']) AS term, unnest([ssm, ssc, ssi, rss]) AS ss, unnest([k - 1, 1, k - 1, n - 2 * k])::DOUBLE AS df, rss / (n - 2 * k) AS mse, (n - 2 * k)::DOUBLE AS dof FROM s)
SELECT term, round(ss, 6) AS sum_sq, df, round(f, 3) AS f, round(CASE WHEN f IS NOT NULL THEN """ + sqltail.f_upper("f", "df", "dof") + """ END, 7) AS p_value FROM (SELECT *, CASE WHEN term <> 'residual' THEN ss / df / mse END AS f FROM t)"""  # fmt: skip


@register("interaction_table", _INTERACTION)
def interaction_table(spark, sf_dir):
    out = families.interaction_effect(_stored(spark, sf_dir), "model", _acc(), "cosine_similarity")
    return out.select("term", F.round("sum_sq", 6).alias("sum_sq"), "df", F.round("f", 3).alias("f"), F.round("p_value", 7).alias("p_value"))


@register("effects_by_model", METRIC_SQL + """,
c AS (SELECT model, perturbation_id, count(*) AS n, avg(cosine_similarity) AS y, var_samp(cosine_similarity) * (count(*) - 1) AS ss FROM metric GROUP BY ALL),
w AS (SELECT model, CAST(sum(n) AS BIGINT) AS n_tiles, count(*) AS levels, sum(ss) AS rss, max(y) FILTER (perturbation_id = 1) AS y1, max(n) FILTER (perturbation_id = 1) AS n1 FROM c GROUP BY model)
SELECT model, perturbation_id, n_tiles, round(coef, 6) AS coef, round(tt, 4) AS t, round(p, 7) AS p_value, round(least(1.0, 54 * p), 7) AS p_value_bonferroni FROM (SELECT *, """ + sqltail.student2("tt", "dof") + """ AS p FROM (
  SELECT model, perturbation_id, n_tiles, y - y1 AS coef, (n_tiles - levels)::DOUBLE AS dof, (y - y1) / sqrt(rss / (n_tiles - levels) * (1.0::DOUBLE / n + 1.0::DOUBLE / n1)) AS tt FROM c JOIN w USING (model) WHERE perturbation_id <> 1))""")  # fmt: skip
def effects_by_model(spark, sf_dir):
    e = families.effects_by_group(_stored(spark, sf_dir), "model", "perturbation_id", "cosine_similarity")
    return e.select("model", "perturbation_id", "n_tiles", F.round("coef", 6).alias("coef"), F.round("t", 4).alias("t"), F.round("p_value", 7).alias("p_value"), F.round("p_value_bonferroni", 7).alias("p_value_bonferroni"))


_RANDOM = METRIC_SQL + """, lv AS (SELECT perturbation_id, count(*)::DOUBLE AS n, avg(cosine_similarity) AS y FROM metric GROUP BY 1), gr AS (SELECT model, count(*)::DOUBLE AS n, avg(cosine_similarity) AS y FROM metric GROUP BY 1),
 tt AS (SELECT count(*)::DOUBLE AS n, avg(cosine_similarity) AS y, var_pop(cosine_similarity) * count(*) AS ss FROM metric),
 ms AS (SELECT (ss - (SELECT sum(l.n * (l.y - tt.y) * (l.y - tt.y)) FROM lv l) - (SELECT sum(g.n * (g.y - tt.y) * (g.y - tt.y)) FROM gr g)) / (n - (SELECT count(*) FROM lv) - (SELECT count(*) FROM gr) + 1) AS mse,
   (SELECT sum(g.n * (g.y - tt.y) * (g.y - tt.y)) / (count(*) - 1) FROM gr g) AS msg, n / (SELECT count(*) FROM gr) AS per,
   n - (SELECT count(*) FROM lv) - (SELECT count(*) FROM gr) + 1 AS dfe, (SELECT count(*) FROM gr) - 1 AS dfg FROM tt),
 -- groups that differ no more than their rows do: no variance of their own, and all that is left is one error
 mx AS (SELECT CASE WHEN msg < mse THEN (mse * dfe + msg * dfg) / (dfe + dfg) ELSE mse END AS mse, msg, per, greatest(0.0, (msg - mse) / per) AS group_var FROM ms),
 fx AS (SELECT perturbation_id, y - (SELECT y FROM lv WHERE perturbation_id = 1) AS coef, (y - (SELECT y FROM lv WHERE perturbation_id = 1)) / sqrt(mse * 2 / n) AS z, group_var FROM lv, mx WHERE perturbation_id <> 1)"""


@register("perturbation_effect", _RANDOM + " SELECT perturbation_id, round(coef, 6) AS coef, round(z, 4) AS z, round(" + sqltail.normal2("z") + ", 6) AS p_value, round(group_var, 8) + 0.0 AS group_var FROM fx")
def perturbation_effect(spark, sf_dir):
    """The fit by restricted likelihood; the SQL is the closed form that it has in this balanced table."""
    e = families.random_intercept(_stored(spark, sf_dir), "model", "perturbation_id", "cosine_similarity")
    return e.select("perturbation_id", F.round("coef", 6).alias("coef"), F.round("z", 4).alias("z"), F.round("p_value", 6).alias("p_value"), (F.round("group_var", 8) + 0.0).alias("group_var"))


_RANKED = """, rk AS (SELECT perturbation_id, round(coef, 6) AS coef, """ + sqltail.normal2("z") + """ < 0.05::DOUBLE / 54 AS significant FROM fx UNION ALL SELECT 1, 0.0, NULL)"""


@register("effect_ranking", _RANDOM + _RANKED + " SELECT perturbation_id, coef, significant, CAST(row_number() OVER (ORDER BY coef, perturbation_id) AS INTEGER) AS place FROM rk")
def effect_ranking(spark, sf_dir):
    return _ranking(spark, sf_dir)


def _ranking(spark, sf_dir):
    """Levels in the order of their effects, the reference level with 0 among them; a row for each perturbation."""
    e = families.random_intercept(_stored(spark, sf_dir), "model", "perturbation_id", "cosine_similarity")
    e = e.select("perturbation_id", F.round("coef", 6).alias("coef"), (F.col("p_value") < 0.05 / 54).alias("significant"))
    reference = spark.range(1, 2).select(F.col("id").cast("int").alias("perturbation_id"), F.lit(0.0).alias("coef"), F.lit(None).cast("boolean").alias("significant"))
    return stores.ranked(e.unionByName(reference), "coef", "perturbation_id")


@register("effect_ranking_by_model", _RANDOM + _RANKED + """, pl AS (SELECT perturbation_id, CAST(row_number() OVER (ORDER BY coef, perturbation_id) AS INTEGER) AS place FROM rk),
 mm AS (SELECT model, perturbation_id, avg(cosine_similarity) AS y FROM metric GROUP BY ALL), df AS (SELECT a.model, a.perturbation_id, round(a.y - b.y, 6) + 0.0 AS coef FROM mm a JOIN mm b ON a.model = b.model AND b.perturbation_id = 1)
 SELECT model, perturbation_id, coef, place, CAST(row_number() OVER (PARTITION BY model ORDER BY coef, perturbation_id) AS INTEGER) AS model_place FROM df JOIN pl USING (perturbation_id)""")  # fmt: skip
def effect_ranking_by_model(spark, sf_dir):
    """Each model's effects in the pooled order, and their places in its own."""
    e = families.effects_by_group(_stored(spark, sf_dir), "model", "perturbation_id", "cosine_similarity").select("model", "perturbation_id", (F.round("coef", 6) + 0.0).alias("coef"))
    reference = e.select("model").distinct().select("model", F.lit(1).alias("perturbation_id"), F.lit(0.0).alias("coef"))
    own = stores.ranked(e.unionByName(reference), "coef", "perturbation_id", "model_place", ["model"])
    return own.join(F.broadcast(_ranking(spark, sf_dir).select("perturbation_id", "place")), "perturbation_id")  # a row for each perturbation


def _heat(value):
    return f"""{METRIC_SQL},{_MOMENTS} SELECT perturbation_id, round(max({value}) FILTER (model = 'uni'), 4) + 0.0 AS uni, round(max({value}) FILTER (model = 'conch'), 4) + 0.0 AS conch,
 round(max({value}) FILTER (model = 'quilt_llava'), 4) + 0.0 AS quilt_llava, round(max({value}) FILTER (model = 'gigapath_tile'), 4) + 0.0 AS gigapath_tile FROM effects WHERE severity = 'severe' GROUP BY 1"""


def _matrix(spark, sf_dir, value):
    m = cells.cell_moments(_stored(spark, sf_dir).filter("severity = 'severe'"), CELL, "cosine_similarity", _acc())
    return m.withColumn("v", F.round(value(), 4)).groupBy("perturbation_id").pivot("model", list(study.MODELS)).agg(F.max("v"))


@register("heatmap", _heat("mean_a"))
def heatmap(spark, sf_dir):
    return _matrix(spark, sf_dir, lambda: F.col("mean_a"))


@register("heatmap_b", _heat("mean_b"))
def heatmap_b(spark, sf_dir):
    return _matrix(spark, sf_dir, lambda: F.col("mean_b"))


@register("gap_significance", _family_sql(CELL, _COHORT_ROWS, "SELECT perturbation_id, " + ", ".join(f"bool_or(significant_bonferroni) FILTER (model = '{m}') AS {m}" for m in study.MODELS) + " FROM (" + sqltail.bonferroni() + ") WHERE severity = 'severe' GROUP BY 1"))
def gap_significance(spark, sf_dir):
    """Which gaps of the matrix at one severity are significant, corrected over the whole family."""
    t = cells.adjust_bonferroni(cells.two_sample_test(_counts(spark, sf_dir), CELL, "cosine_similarity", _acc(), weight="n"))
    return t.filter("severity = 'severe'").groupBy("perturbation_id").pivot("model", list(study.MODELS)).agg(F.bool_or("significant_bonferroni"))


@register("difference_heatmap", _heat("(mean_a - mean_b)"))
def difference_heatmap(spark, sf_dir):
    return _matrix(spark, sf_dir, lambda: F.col("mean_a") - F.col("mean_b"))


@register("gap_heatmap", _heat("d"))
def gap_heatmap(spark, sf_dir):
    return _matrix(spark, sf_dir, cells.cohens_d)


_CATEGORY = "CASE WHEN perturbation_id <= 5 THEN 'colour_staining' WHEN perturbation_id <= 10 THEN 'imaging_artefacts' WHEN perturbation_id <= 13 THEN 'geometric' WHEN perturbation_id <= 16 THEN 'resolution_quality' ELSE 'lighting' END"


@register("severity_trend", METRIC_SQL + f""", c AS (SELECT model, perturbation_id, severity, count(*) FILTER (cohort = 'ACC') AS n_a, count(*) FILTER (cohort <> 'ACC') AS n_b, avg(cosine_similarity) FILTER (cohort = 'ACC') AS a, avg(cosine_similarity) FILTER (cohort <> 'ACC') AS b FROM metric GROUP BY ALL),
 f AS (SELECT n_a AS fa, n_b AS fb FROM c ORDER BY model, perturbation_id, severity LIMIT 1), g AS (SELECT {_CATEGORY} AS category, model, severity, round(avg((a * fa + b * fb) / (fa + fb)), 5) AS mean FROM c, f GROUP BY ALL)
 SELECT *, row_number() OVER (ORDER BY list_position(['colour_staining', 'imaging_artefacts', 'geometric', 'resolution_quality', 'lighting'], category), list_position(['uni', 'conch', 'quilt_llava', 'gigapath_tile'], model), list_position(['mild', 'moderate', 'severe'], severity)) AS place FROM g""")
def severity_trend(spark, sf_dir):
    """Pooled means (with the first cell's sizes) by category, model and severity, in the fixed order."""
    m = cells.cell_moments(_stored(spark, sf_dir), CELL, "cosine_similarity", _acc())
    w = stores.with_registry(stores.weighted_mean(m, "mean_a", "mean_b", "n_a", "n_b", fixed_n=CELL))
    g = w.groupBy("category", "model", "severity").agg(F.round(F.avg("weighted_mean"), 5).alias("mean"), F.min("perturbation_id").alias("first"))
    models, severities = stores.cell_order()[0], stores.cell_order()[2]
    # a row for each category, model and severity
    return g.withColumn("place", F.row_number().over(Window.orderBy("first", models, severities))).drop("first")


@register("pairwise_summary", _family_sql(_PAIR_KEYS, _pair_rows(_PAIRS), "SELECT model_a, model_b, round(avg(cohens_d), 5) AS mean_d, round(100.0 * avg(CAST(significant_bonferroni AS DOUBLE)), 4) AS pct_significant FROM (" + sqltail.bonferroni() + ") WHERE NOT skipped GROUP BY ALL"))
def pairwise_summary(spark, sf_dir):
    t = pairwise_models(spark, sf_dir).filter("NOT skipped")
    return t.groupBy("model_a", "model_b").agg(F.round(F.avg("cohens_d"), 5).alias("mean_d"), F.round(F.avg(F.col("significant_bonferroni").cast("double")) * 100, 4).alias("pct_significant"))


@register("tukey_models", METRIC_SQL + """, g AS (SELECT model, avg(cosine_similarity) AS m FROM metric GROUP BY 1)
 SELECT a.model AS group_a, b.model AS group_b, round(b.m - a.m, 6) AS difference FROM g a JOIN g b ON a.model < b.model""")  # fmt: skip
def tukey_models(spark, sf_dir):
    return families.tukey_hsd(_stored(spark, sf_dir), "model", "cosine_similarity").select("group_a", "group_b", F.round("difference", 6).alias("difference"))


# the studentised range: W over a table of widths a hundredth apart, then over the scale's distribution
_TUKEY = """WITH g AS (SELECT c_mktsegment AS g, count(*)::DOUBLE AS n, avg(c_acctbal) AS m, var_samp(c_acctbal) * (count(*) - 1) AS ss FROM customer GROUP BY 1),
e AS (SELECT count(*)::DOUBLE AS k, sum(n) - count(*) AS dof, sum(ss) / (sum(n) - count(*)) AS mse FROM g),
pairs AS (
  SELECT a.g AS group_a, b.g AS group_b, b.m - a.m AS difference, abs(b.m - a.m) / sqrt(mse / 2 * (1 / a.n + 1 / b.n)) AS q, k, dof
  FROM g a JOIN g b ON a.g < b.g, e),
step AS (SELECT i, -8 + i * 0.01::DOUBLE AS z, exp(-(-8 + i * 0.01::DOUBLE) * (-8 + i * 0.01::DOUBLE) / 2) / sqrt(2 * pi()) AS d FROM range(0, 1601) t(i)),
phi AS (SELECT i, d, sum(d) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) * 0.01::DOUBLE - d * 0.005::DOUBLE AS c FROM step),
width AS (
  SELECT j, k * sum(p.d * pow(greatest(0, p.c - coalesce(o.c, 0)), k - 1)) * 0.01::DOUBLE AS w
  FROM range(0, 1601) t(j) JOIN phi p ON true LEFT JOIN phi o ON o.i = p.i - t.j, e GROUP BY j, k),
scale AS (
  SELECT group_a, group_b, q, dof, s, 18 / sqrt(2 * dof) / 400 AS ds,
    exp(dof / 2 * ln(dof) - lgamma(dof / 2) - (dof / 2 - 1) * ln(2) + (dof - 1) * ln(s) - dof * s * s / 2) AS f
  FROM (SELECT *, 1 - 9 / sqrt(2 * dof) + i * 18 / sqrt(2 * dof) / 400 AS s FROM pairs, range(0, 401) t(i)) WHERE s > 0),
met AS (
  SELECT group_a, group_b, sum(f * ds * (a.w + (least(q * s, 15.98) * 100 - floor(least(q * s, 15.98) * 100)) * (b.w - a.w))) AS inside
  FROM scale JOIN width a ON a.j = CAST(floor(least(q * s, 15.98) * 100) AS BIGINT) JOIN width b ON b.j = a.j + 1 GROUP BY ALL)
SELECT group_a, group_b, round(difference, 6) AS difference, round(q, 6) AS q, round(greatest(0, 1 - inside), 3) + 0.0 AS p_value, 1 - inside < 0.05 AS reject FROM pairs JOIN met USING (group_a, group_b)"""


@register("tukey_segments", _TUKEY)
def tukey_segments(spark, sf_dir):
    """Balances of segments, pair by pair, with the range statistic, its p and what it rejects."""
    t = families.tukey_hsd(study.table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal")
    return t.select("group_a", "group_b", F.round("difference", 6).alias("difference"), F.round("q", 6).alias("q"), (F.round("p_value", 3) + 0.0).alias("p_value"), "reject")


# vectors' components are close to normal, so most of these cells take the test for normal groups
_NORMAL = "SELECT j AS component, vec_id % 2 = 0 AS a, round(CAST(embedding[j] AS DOUBLE), 6) AS x FROM embeddings, range(1, 65) t(j)"


@register("welch_cells", _family_sql(["component"], _NORMAL, sqltail.bonferroni(), before="WITH one AS (SELECT 1)"))
def welch_cells(spark, sf_dir):
    """The vectors' components compared between even and odd ids, a test for each component."""
    e = study.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("j", "v"))
    rows = e.select((F.col("j") + 1).cast("long").alias("component"), "vec_id", F.round(F.col("v").cast("double"), 6).alias("x"))
    return _tested(cells.adjust_bonferroni(cells.two_sample_test(rows, ["component"], "x", F.col("vec_id") % 2 == 0)))


_OMNIBUS = ", " + _KW.format(g="model", x="cosine_similarity", t="metric") + """, hh AS (SELECT count(*) AS k, (12 / (max(total) * (max(total) + 1)) * sum(rs * rs / n) - 3 * (max(total) + 1)) / (1 - max(ties) / (max(total) * max(total) * max(total) - max(total))) AS h FROM q, z),
 hp AS (SELECT h, """ + sqltail.chi2_upper("h", "k - 1") + """ AS p FROM hh),
 dz AS (SELECT a.g AS group_a, b.g AS group_b, (a.rs / a.n - b.rs / b.n) / sqrt((total * (total + 1) / 12 - ties / (12 * (total - 1))) * (1 / a.n + 1 / b.n)) AS dz FROM q a JOIN q b ON a.g < b.g, z),
 me AS (SELECT 'kruskal_wallis' AS test_used, 'ok' AS status, NULL AS group_a, NULL AS group_b, round(h, 4) AS statistic, round(p, 7) AS p_value, NULL AS error FROM hp
  UNION ALL SELECT 'dunn', 'ok', group_a, group_b, round(dz, 4), round(least(1.0, (SELECT count(*) FROM dz) * """ + sqltail.normal2("dz") + """), 7), NULL FROM dz WHERE (SELECT p FROM hp) < 0.05)"""


def _omnibus(df):
    return df.withColumn("statistic", F.round("statistic", 4)).withColumn("p_value", F.round("p_value", 7))


@register("model_effect", METRIC_SQL + _OMNIBUS + " SELECT * FROM me")
def model_effect(spark, sf_dir):
    """Models compared; their similarities are far from normal, so by ranks, and pairs only if the whole differs."""
    return _omnibus(families.model_effect(_stored(spark, sf_dir), "model", "cosine_similarity"))


@register("model_effect_cka", _CKA_METRIC + ", metric_cka AS (SELECT model, linear_cka AS cosine_similarity FROM metric WHERE cohort = 'POOLED')" + _OMNIBUS.replace("FROM metric GROUP BY ALL", "FROM metric_cka GROUP BY ALL") + " SELECT * FROM me")
def model_effect_cka(spark, sf_dir):
    return _omnibus(families.model_effect(written(cells.pooled_only(cka_table_of(spark, sf_dir)), "cka"), "model", "linear_cka"))


@register("model_effect_summary", METRIC_SQL + _OMNIBUS + ", ck AS (" + _CKA_METRIC.replace("WITH ", "WITH ", 1) + ", metric_cka AS (SELECT model, linear_cka AS cosine_similarity FROM metric WHERE cohort = 'POOLED')" + _OMNIBUS.replace("FROM metric GROUP BY ALL", "FROM metric_cka GROUP BY ALL") + """
  SELECT model, round(avg(cosine_similarity), 6) AS mean_cka, (SELECT statistic FROM me WHERE group_a IS NULL) AS statistic_cka, (SELECT p_value FROM me WHERE group_a IS NULL) AS p_value_cka FROM metric_cka GROUP BY 1)
 SELECT m.model, round(avg(cosine_similarity), 6) AS mean_cosine, (SELECT statistic FROM me WHERE group_a IS NULL) AS statistic_cosine, (SELECT p_value FROM me WHERE group_a IS NULL) AS p_value_cosine, any_value(mean_cka) AS mean_cka, any_value(statistic_cka) AS statistic_cka, any_value(p_value_cka) AS p_value_cka
 FROM metric m JOIN ck ON ck.model = m.model GROUP BY 1""")
def model_effect_summary(spark, sf_dir):
    """Each model's means with the omnibus tests of similarity and of CKA side by side."""
    return studies.model_effect_summary(_stored(spark, sf_dir), written(cells.pooled_only(cka_table_of(spark, sf_dir)), "cka"))


_FAMILY_SQL = {
    "cohort_effect": ("significant_bonferroni", _family_sql(CELL, _COHORT_ROWS.replace("FROM metric", "FROM metric WHERE model <> 'gigapath_tile'"), sqltail.bonferroni())),
    "pairwise_models": ("significant_bonferroni", _family_sql(_PAIR_KEYS, _pair_rows(_PAIRS), sqltail.bonferroni())),
    "cohort_effect_cka": ("significant_bonferroni", _family_sql(["model", "severity"], _CKA_COHORT_ROWS + " AND model <> 'gigapath_tile'", sqltail.bonferroni(), before=_CKA_METRIC)),
    "pairwise_models_cka": ("significant_bonferroni", _family_sql(_CKA_PAIR_KEYS, _cka_pair_rows(_PAIRS), sqltail.bonferroni(), before=_CKA_METRIC)),
    "outlier_effect": ("significant_fdr_bh", _family_sql(_PAIR_KEYS, _pair_rows(_OUTLIERS), sqltail.benjamini_hochberg())),
    "outlier_effect_cka": ("significant_fdr_bh", _family_sql(_CKA_PAIR_KEYS, _cka_pair_rows(_OUTLIERS), sqltail.benjamini_hochberg(), before=_CKA_METRIC)),
}
_STUDY_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS family, count(*) AS tests, count(*) FILTER ({flag}) AS significant, round(min(p_value), 7) AS least_p FROM ({sql})" for name, (flag, sql) in _FAMILY_SQL.items()
)


def _study(spark, sf_dir):
    """Results of a whole study, in two runs over one store: the first has the mild and moderate cells alone, the second
    tests what it lacked. Fits over all rows are made in the second. A family that fails in either is an error."""
    store = studies.ResultStore(spark, new_path(spark, "study"))
    cosine, cka_of = _stored(spark, sf_dir), written(cka_table_of(spark, sf_dir), "cka")
    of = (list(study.PRIMARY), study.OUTLIER)
    early = [f for f in studies.study_families(*of) if f.name in ("cohort_effect", "outlier_effect_cka")]
    studies.require_done(studies.resume_study(store, cosine.filter("severity <> 'severe'"), cka_of.filter("severity <> 'severe'"), *of, only=early))
    log = studies.require_done(studies.resume_study(store, cosine, cka_of, *of))
    return studies.stored_tables(store, *of), log


@register("run_study", _STUDY_SQL)
def run_study(spark, sf_dir):
    """All families of the primary models with the outlier's apart, and of each: tests, significant ones, least p."""
    return studies.summary(studies.run_study(_stored(spark, sf_dir), written(cka_table_of(spark, sf_dir), "cka"), list(study.PRIMARY), study.OUTLIER))


#: Cells of each family that the second of :func:`_study`'s runs tests.
_LOG = """SELECT 'second run' AS family, family || '|' || cells AS cell, NULL::DOUBLE AS p_value, NULL::BOOLEAN AS significant FROM (VALUES
  ('model_effect', 1), ('model_effect_cka', 1), ('cohort_effect', 54), ('cohort_effect_cka', 9), ('interaction', 1), ('interaction_cka', 1), ('perturbation_effect', 1), ('perturbation_effect_cka', 1),
  ('pairwise_models', 162), ('pairwise_models_cka', 9), ('outlier_effect', 162), ('outlier_effect_cka', 3)) v(family, cells)"""
_LONG = {name: (_FAMILY_SQL[name], keys) for name, keys in (
    ("cohort_effect", CELL), ("pairwise_models", _PAIR_KEYS), ("outlier_effect", _PAIR_KEYS),
    ("cohort_effect_cka", ["model", "severity"]), ("pairwise_models_cka", _CKA_PAIR_KEYS), ("outlier_effect_cka", _CKA_PAIR_KEYS),
)}


def _primary(sql: str, view: str) -> str:
    """A fit's SQL over the primary models of ``view``."""
    head = _CKA_METRIC if "linear_cka" in view else METRIC_SQL
    body = sql[len(METRIC_SQL) :].replace("FROM metric", "FROM fitted")
    return f"WITH fitted AS ({head} {view}){body}"


_FITTED = {
    "": "SELECT * FROM metric WHERE model <> 'gigapath_tile'",
    "_cka": "SELECT model, perturbation_id, severity, cohort, linear_cka AS cosine_similarity FROM metric WHERE cohort = 'POOLED' AND model <> 'gigapath_tile'",
    "_cka_cohorts": "SELECT model, perturbation_id, severity, cohort, linear_cka AS cosine_similarity FROM metric WHERE cohort <> 'POOLED' AND model <> 'gigapath_tile'",
}
_FITS = [
    *((f"model_effect{s}", "concat_ws('|', group_a, group_b)", _primary(METRIC_SQL + _OMNIBUS + " SELECT * FROM me", _FITTED[s])) for s in ("", "_cka")),
    *((f"interaction{s}", "term", _primary(_INTERACTION, _FITTED[v])) for s, v in (("", ""), ("_cka", "_cka_cohorts"))),
    *((f"perturbation_effect{s}", "perturbation_id::VARCHAR", _primary(_RANDOM + " SELECT perturbation_id, " + sqltail.normal2("z") + " AS p_value FROM fx", _FITTED[s])) for s in ("", "_cka")),
]


@register("study_results", " UNION ALL ".join([
    *(f"SELECT '{name}' AS family, concat_ws('|', {', '.join(keys)}) AS cell, round(p_value, 6) AS p_value, {flag} AS significant FROM ({sql})" for name, ((flag, sql), keys) in _LONG.items()),
    *(f"SELECT '{name}' AS family, {cell} AS cell, round(p_value, 6) AS p_value, NULL AS significant FROM ({sql})" for name, cell, sql in _FITS),
    _LOG,
]))
def study_results(spark, sf_dir):
    """Every test of a whole study, of all twelve families, and how many cells of each its second run tested."""
    tables, log = _study(spark, sf_dir)
    keys = {f.name: f.keys for f in studies.study_families(list(study.PRIMARY), study.OUTLIER)}
    second = log.select(F.lit("second run").alias("family"), F.concat_ws("|", "family", "cells").alias("cell"), F.lit(None).cast("double").alias("p_value"), F.lit(None).cast("boolean").alias("significant"))
    # tests show seven digits, of which six stay here; fits of the mixed model are rounded once
    p = F.col("p_value")
    shown = F.when(F.col("family").startswith("perturbation_effect"), p).otherwise(F.round(p, 7))
    return studies.long_results(tables, keys).unionByName(second).withColumn("p_value", half_away(shown, 6))


@register("held_out_summary", METRIC_SQL + """, w AS (SELECT model, sample_id, max(cosine_similarity) FILTER (perturbation_id = 6) AS x, max(cosine_similarity) FILTER (perturbation_id = 7) AS y FROM metric WHERE severity = 'severe' GROUP BY ALL),
 d AS (SELECT model, abs(round(x - y, 9)) AS v, x > y AS up FROM w WHERE x <> y), g AS (SELECT model, v, count(*) AS t, count(*) FILTER (up) AS p FROM d GROUP BY ALL),
 r AS (SELECT *, sum(t) OVER (PARTITION BY model ORDER BY v ROWS UNBOUNDED PRECEDING) - t + (t + 1) / 2.0::DOUBLE AS mid FROM g),
 s AS (SELECT model, least(sum(p * mid), sum((t - p) * mid)) AS st, sum(t)::DOUBLE AS n, sum(t * t * t - t)::DOUBLE AS ties FROM r GROUP BY 1),
 z AS (SELECT model, (st - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s),
 o AS (SELECT model, count(*) AS n, round(median(round(x - y, 9)), 6) + 0.0 AS median_diff, round((count(*) FILTER (x > y) - count(*) FILTER (x < y)) / (count(*) FILTER (x <> y))::DOUBLE, 6) AS cohens_2g FROM w GROUP BY 1),
 q AS (SELECT o.*, """ + sqltail.normal2("z") + """ AS p FROM o JOIN z USING (model))
 SELECT model, n, median_diff, cohens_2g, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars,
  CASE WHEN p < 0.05 AND median_diff > 0 THEN 'p06_higher' WHEN p < 0.05 AND median_diff < 0 THEN 'p07_higher' ELSE 'no_difference' END = CASE WHEN model IN ('uni', 'gigapath_tile') THEN 'p06_higher' ELSE 'no_difference' END AS confirmed FROM q""")  # fmt: skip
def held_out_summary(spark, sf_dir):
    """Each model's paired difference between two conditions, with what its family was predicted to show."""
    rows = _stored(spark, sf_dir).filter("severity = 'severe'").withColumn("condition", F.format_string("p%02d", F.col("perturbation_id")))
    pairs = families.paired_conditions(rows, ["model"], "sample_id", "condition", "p06", "p07", "cosine_similarity")
    return studies.held_out_summary(pairs, "p06", "p07", {"dinov2": "p06_higher"})


_FAMILY = """SELECT 'p07' AS condition, model IN ('uni', 'gigapath_tile') AS a, cosine_similarity AS x FROM metric WHERE perturbation_id = 7"""


@register("family_effect", _family_sql(["condition"], _FAMILY, """SELECT * REPLACE (round(p_value, 7) AS p_value), CASE WHEN skipped THEN NULL WHEN p_value < 0.05 AND mean_a > mean_b THEN 'vision_higher' WHEN p_value < 0.05 AND mean_a < mean_b THEN 'language_higher' ELSE 'no_difference' END AS observed FROM tested""", 10))
def family_effect(spark, sf_dir):
    """One perturbation's similarities pooled by model family and compared."""
    family = {"uni": "vision", "gigapath_tile": "vision", "conch": "language", "quilt_llava": "language"}
    rows = _stored(spark, sf_dir).withColumn("condition", F.format_string("p%02d", F.col("perturbation_id")))
    return _tested(families.family_condition_test(rows, "model", family, "vision", "language", "condition", "p07", "cosine_similarity"))


@register("study_cka_ranks", _CKA.replace("SELECT model, perturbation_id, severity, cohort, max(n)", "SELECT model, severity, count(*) AS n FROM (SELECT model, perturbation_id, severity, cohort, max(n)") + ") WHERE cohort = 'POOLED' GROUP BY ALL")
def study_cka_ranks(spark, sf_dir):
    """Replicates of the CKA tests: one value for each perturbation."""
    return cka_table_of(spark, sf_dir).filter("cohort = 'POOLED'").groupBy("model", "severity").agg(F.count("*").alias("n"))
