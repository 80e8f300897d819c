"""Published results of the audited study: its statistics lead to its p-values, corrections and labels.

Fixed values: all numbers are as the study published them.
"""

import pytest
from pyspark.sql import functions as F

from embedaudit.functions import tails
from embedaudit.operators import cells, families

# F and p of the two-way tables: term's degrees of freedom, residual's, sum of squares, residual's, F, p
ANOVA = [
    (1, 318, 0.1200741082927913, 5.249039809253517, 7.274390712334461, 0.007367317855323909), (2, 318, 0.076791495327208, 5.249039809253517, 2.326110717526159, 0.09933475185056677),
    (2, 318, 0.03651455585483852, 5.249039809253517, 1.1060716991866342, 0.3321255245937547), (1, 318, 0.19188770515557244, 5.851320437756815, 10.428464974457118, 0.0013705254350494251),
    (2, 318, 0.03226801869224098, 5.851320437756815, 0.8768302858547956, 0.41710327367234673), (2, 318, 0.01915164221632058, 5.851320437756815, 0.5204143483145759, 0.5947794990057024),
    (1, 624342, 5.836609153663201, 26848.657472878236, 135.72523080148414, 2.3086469623762954e-31),
]
# H of three models on CKA, and p
KRUSKAL = [(4.9074772968942275, 0.08597156744930427), (11.383837236198827, 0.0033731150374628816)]
# rank sums of 3,854 pairs, p, median difference, 2g
WILCOXON = [(3432065.5, 4.399643515218385e-05), (2828005.0, 1.1193800175504762e-37), (1339442.0, 5.46180376948772e-259)]
# the outlier's family of nine tests: p and corrected p
OUTLIER = [
    (0.21140013326822704, 0.3023281571426018), (0.6236286198474463, 0.6236286198474463), (0.595487718218145, 0.6236286198474463), (0.016907445097637797, 0.07608350293937009), (0.23514412222202363, 0.3023281571426018),
    (0.07384365056328972, 0.14202955846645127), (0.010380447741863226, 0.07608350293937009), (0.07890531025913959, 0.14202955846645127), (0.04128168070817079, 0.12384504212451236),
]
# the cohorts' family of nine tests: p, corrected p, Cohen's d and its label
COHORTS = [
    (0.4963589047945871, 1.0, -0.21263049458605998, "medium"), (0.4960815582924927, 1.0, -0.2046670182154927, "medium"), (0.41979076804604143, 1.0, -0.27639612255912666, "medium"),
    (0.22319125752825608, 1.0, -0.19882791851215326, "small"), (0.6014105444607447, 1.0, -0.14130142226276216, "small"), (0.35064512183188634, 1.0, -0.2002500651669007, "medium"),
    (0.027886264742467463, 0.2509763826822072, -0.6295548888110896, "medium"), (0.14973064243274758, 1.0, -0.5377902718067428, "medium"), (0.07909826263265422, 0.711884363693888, -0.5975732433867403, "medium"),
]


def test_two_way_tables(spark):
    df = spark.createDataFrame([(k, float(a), float(b), s, r) for k, (a, b, s, r, _, _) in enumerate(ANOVA)], "k int, a double, b double, s double, r double")
    f = (F.col("s") / F.col("a")) / (F.col("r") / F.col("b"))
    got = df.select(f.alias("f"), tails.f_upper(f, F.col("a"), F.col("b")).alias("p")).orderBy("k").collect()
    for r, (*_, want, p) in zip(got, ANOVA, strict=True):
        assert r["f"] == pytest.approx(want, rel=1e-9) and r["p"] == pytest.approx(p, rel=1e-6)


def test_omnibus_tests(spark):
    df = spark.createDataFrame([(h,) for h, _ in KRUSKAL], "h double")
    got = [r["p"] for r in df.select(tails.chi2_upper(F.col("h"), F.lit(2)).alias("p"), "h").orderBy("h").collect()]
    assert got == pytest.approx([p for _, p in KRUSKAL], rel=1e-8)


def test_signed_ranks(spark):
    n = 3854.0
    df = spark.createDataFrame([(w,) for w, _ in WILCOXON], "w double")
    z = (F.col("w") - n * (n + 1) / 4) / (n * (n + 1) * (2 * n + 1) / 24) ** 0.5
    got = [r["p"] for r in df.select(tails.normal_two_sided(z).alias("p"), "w").orderBy(F.desc("w")).collect()]
    # a few ties and zeros, which the sums do not tell, move the exponent's last digits
    for p, (_, want) in zip(got, WILCOXON, strict=True):
        assert p == pytest.approx(want, rel=2e-2)


def test_corrections_within_families(spark):
    df = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(OUTLIER)], "k int, p_value double")
    assert [r["p_value_fdr_bh"] for r in cells.adjust_bh(df).orderBy("k").collect()] == pytest.approx([q for _, q in OUTLIER], rel=1e-12)
    df = spark.createDataFrame([(k, p) for k, (p, *_) in enumerate(COHORTS)], "k int, p_value double")
    got = cells.adjust_bonferroni(df).orderBy("k").collect()
    assert [r["p_value_bonferroni"] for r in got] == pytest.approx([q for _, q, *_ in COHORTS], rel=1e-12) and not any(r["significant_bonferroni"] for r in got)


def test_effect_sizes_and_their_labels(spark):
    df = spark.createDataFrame([(k, d) for k, (_, _, d, _) in enumerate(COHORTS)], "k int, d double")
    assert [r["label"] for r in df.select("k", cells.effect_size_label(F.col("d")).alias("label")).orderBy("k").collect()] == [x for *_, x in COHORTS]
    delta = families.cliffs_delta(F.lit(47408640.5), F.lit(7708.0), F.lit(7708.0))
    r = spark.range(1).select(delta.alias("delta"), families.cliffs_label(delta).alias("label"), cells.effect_size_label(F.lit(1.1860222528724034)).alias("size")).first()
    assert round(r["delta"], 3) == 0.596 and (r["label"], r["size"]) == ("large", "large")


def test_ranks_of_two_samples_of_eighteen(spark):
    """A rank sum of 140 without ties: the normal tail with its half step."""
    b = [float(k) for k in range(1, 19)]
    a = [7.01 + k / 100 for k in range(4)] + [8.01 + k / 100 for k in range(14)]
    rows = [("c", True, x) for x in a] + [("c", False, x) for x in b]
    r = cells.two_sample_test(spark.createDataFrame(rows, "k string, a boolean, x double"), ["k"], "x", F.col("a")).first()
    assert (r["test_used"], r["statistic"]) == ("mann_whitney_u", 140.0) and r["p_value"] == pytest.approx(0.4963589047945871, rel=1e-6)


@pytest.mark.parametrize(("q", "groups", "dof", "p"), [(3.877, 3, 10, 0.05), (4.232, 5, 20, 0.05), (3.635, 2, 5, 0.05), (4.646, 10, 60, 0.05), (5.502, 4, 12, 0.01), (3.314, 3, 100_000, 0.05), (6.085, 2, 2, 0.05)])
def test_upper_points_of_the_studentised_range(q, groups, dof, p):
    """Printed tables of the range statistic, to their three decimals; the last but one stands for infinitely many."""
    assert families._range_tail(q, groups, dof) == pytest.approx(p, rel=3e-3)
