"""Queries of the held-out experiment: embedded conditions, the tests of flips and of solarize, and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedaudit.functions.rounding import half_away
from embedaudit.operators import held_out, stores
from embedaudit.sources import study
from embedaudit.sources.scratch import written

from . import sqltail
from .pixels import _TILES
from .registry import register

#: Models without weights: one sees rows alone, one columns alone, the others both.
ADAPTERS = {"uni": stores.profile_model(True, False), "gigapath_tile": stores.grid_mean_model, "conch": stores.profile_model(False, True), "quilt_llava": stores.profile_model(True, True)}

_PIXELS = _TILES[: _TILES.index("cell AS")].rstrip().rstrip(",")
_CHANGED = f"""WITH {_PIXELS},
cond AS (
  SELECT sample_id, condition, list_transform(range(64), lambda i: CASE condition
      WHEN 'flip_h' THEN p0[(i // 8) * 8 + 7 - i % 8 + 1] WHEN 'flip_v' THEN p0[(7 - i // 8) * 8 + i % 8 + 1]
      WHEN 'solarize' THEN CASE WHEN p0[i + 1] < 128 THEN p0[i + 1] ELSE 255 - p0[i + 1] END ELSE p0[i + 1] END) AS q0,
    list_transform(range(64), lambda i: CASE condition
      WHEN 'flip_h' THEN p1[(i // 8) * 8 + 7 - i % 8 + 1] WHEN 'flip_v' THEN p1[(7 - i // 8) * 8 + i % 8 + 1]
      WHEN 'solarize' THEN CASE WHEN p1[i + 1] < 128 THEN p1[i + 1] ELSE 255 - p1[i + 1] END ELSE p1[i + 1] END) AS q1,
    list_transform(range(64), lambda i: CASE condition
      WHEN 'flip_h' THEN p2[(i // 8) * 8 + 7 - i % 8 + 1] WHEN 'flip_v' THEN p2[(7 - i // 8) * 8 + i % 8 + 1]
      WHEN 'solarize' THEN CASE WHEN p2[i + 1] < 128 THEN p2[i + 1] ELSE 255 - p2[i + 1] END ELSE p2[i + 1] END) AS q2
  FROM t, (VALUES ('baseline'), ('flip_h'), ('flip_v'), ('solarize')) v(condition)),
mixed AS (SELECT *, list_transform(range(64), lambda i: (q0[i + 1] + q1[i + 1] + q2[i + 1]) / 765.0::DOUBLE) AS m FROM cond),
seen AS (
  SELECT sample_id, condition, q0, q1, q2,
    list_transform(range(8), lambda r: list_sum(m[r * 8 + 1 : r * 8 + 8]) / 8) AS by_row,
    list_transform(range(8), lambda c: (m[c + 1] + m[c + 9] + m[c + 17] + m[c + 25] + m[c + 33] + m[c + 41] + m[c + 49] + m[c + 57]) / 8) AS by_column
  FROM mixed),
cells AS (
  SELECT sample_id, condition, list_transform(range(48), lambda k: CASE k % 3
      WHEN 0 THEN q0[(k // 12) * 16 + ((k // 3) % 4) * 2 + 1] + q0[(k // 12) * 16 + ((k // 3) % 4) * 2 + 2] + q0[(k // 12) * 16 + ((k // 3) % 4) * 2 + 9] + q0[(k // 12) * 16 + ((k // 3) % 4) * 2 + 10]
      WHEN 1 THEN q1[(k // 12) * 16 + ((k // 3) % 4) * 2 + 1] + q1[(k // 12) * 16 + ((k // 3) % 4) * 2 + 2] + q1[(k // 12) * 16 + ((k // 3) % 4) * 2 + 9] + q1[(k // 12) * 16 + ((k // 3) % 4) * 2 + 10]
      ELSE q2[(k // 12) * 16 + ((k // 3) % 4) * 2 + 1] + q2[(k // 12) * 16 + ((k // 3) % 4) * 2 + 2] + q2[(k // 12) * 16 + ((k // 3) % 4) * 2 + 9] + q2[(k // 12) * 16 + ((k // 3) % 4) * 2 + 10] END / 1020.0::DOUBLE) AS g
  FROM seen),
store AS (
  SELECT 'uni' AS model, condition || '__' || sample_id AS key, sample_id, condition, by_row AS vector FROM seen
  UNION ALL SELECT 'conch', condition || '__' || sample_id, sample_id, condition, by_column FROM seen
  UNION ALL SELECT 'quilt_llava', condition || '__' || sample_id, sample_id, condition, list_concat(by_row, by_column) FROM seen
  UNION ALL SELECT 'gigapath_tile', condition || '__' || sample_id, sample_id, condition, list_concat(g, list_transform(range(16), lambda i: 0.0::DOUBLE)) FROM cells),
sims AS (
  SELECT s.model, s.condition, s.sample_id,
    round(list_dot_product(s.vector, b.vector) / (sqrt(list_dot_product(s.vector, s.vector)) * sqrt(list_dot_product(b.vector, b.vector))), 6) AS similarity
  FROM store s JOIN store b ON s.model = b.model AND s.sample_id = b.sample_id AND b.condition = 'baseline' WHERE s.condition <> 'baseline')"""
_FAMILY = "CASE model WHEN 'uni' THEN 'dinov2' WHEN 'gigapath_tile' THEN 'dinov2' WHEN 'conch' THEN 'clip_cocacontrastive' WHEN 'quilt_llava' THEN 'clip' END"
_FLIPS = _CHANGED + """,
w AS (
  SELECT model, sample_id, max(similarity) FILTER (condition = 'flip_h') AS x, max(similarity) FILTER (condition = 'flip_v') AS y, round(x - y, 9) AS diff
  FROM sims GROUP BY ALL HAVING x IS NOT NULL AND y IS NOT NULL),
g AS (SELECT model, abs(diff) AS v, count(*) AS t, count(*) FILTER (diff > 0) AS p FROM w WHERE diff <> 0 GROUP BY ALL),
r AS (SELECT *, sum(t) OVER (PARTITION BY model ORDER BY v ROWS UNBOUNDED PRECEDING) - t + (t + 1) / 2.0::DOUBLE AS mid FROM g),
s AS (SELECT model, least(sum(p * mid), sum((t - p) * mid)) AS w, sum(t)::DOUBLE AS n, sum(t * t * t - t)::DOUBLE AS ties FROM r GROUP BY 1),
z AS (SELECT model, w, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM s),
o AS (
  SELECT model, count(*) AS n_pairs, count(*) FILTER (diff > 0) AS n_pos, count(*) FILTER (diff < 0) AS n_neg, median(x) AS median_a, median(y) AS median_b, median(diff) AS median_diff,
    (n_pos - n_neg) / nullif(n_pos + n_neg, 0)::DOUBLE AS cohens_2g
  FROM w GROUP BY 1 HAVING count(*) >= 10),
q AS (SELECT o.*, w, z, """ + sqltail.normal2("z") + f""" AS p FROM o JOIN z USING (model)),
flips AS (
  SELECT *, {_FAMILY} AS family, CASE WHEN p < 0.05 AND median_diff > 0 THEN 'hflip_greater' WHEN p < 0.05 AND median_diff < 0 THEN 'vflip_greater' ELSE 'no_significant_difference' END AS observed,
    CASE WHEN {_FAMILY} = 'dinov2' THEN 'hflip_greater' ELSE 'no_significant_difference' END AS predicted, observed = predicted AS confirmed
  FROM q)"""
_SOLARIZED = _CHANGED + f""",
src AS (SELECT condition, model IN ('uni', 'gigapath_tile') AS a, similarity AS x FROM sims WHERE condition = 'solarize'),
{sqltail.two_sample(["condition"], "src", 10)},
u AS (
  SELECT sum(CASE WHEN p.x > q.x THEN 1.0::DOUBLE WHEN p.x = q.x THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS u
  FROM (SELECT x FROM src WHERE a) p, (SELECT x FROM src WHERE NOT a) q),
solarized AS (
  SELECT t.*, 2 * u / (n_a * n_b) - 1 AS cliffs_delta,
    CASE WHEN p_value < 0.05 AND mean_a > mean_b THEN 'dinov2_greater' WHEN p_value < 0.05 AND mean_a < mean_b THEN 'clip_greater' ELSE 'no_significant_difference' END AS observed,
    'dinov2_greater' AS predicted, observed = predicted AS confirmed
  FROM tested t, u WHERE NOT skipped)"""


def _store(spark, sf_dir):
    """Baselines and conditions of all tiles: the flips of some models are embedded first, and a second run adds what
    that store lacks."""
    tiles = written(study.tiles(spark, sf_dir), "tiles")
    some = {m: ADAPTERS[m] for m in ("uni", "conch")}
    first = written(held_out.embedded(tiles, some, conditions=held_out.PAIRED, edge=study.EDGE), "store")
    return first.unionByName(held_out.embedded(tiles, ADAPTERS, first, ("baseline", *held_out.CONDITIONS), study.EDGE))


def _sims(spark, sf_dir):
    return written(held_out.similarities(written(_store(spark, sf_dir), "store")), "similarities")


@register("held_out_store", _CHANGED + " SELECT model, key, list_transform(vector, lambda x: round(x, 6)) AS vector FROM store")
def held_out_store(spark, sf_dir):
    return _store(spark, sf_dir).select("model", "key", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@register("held_out_similarity", _CHANGED + " SELECT * FROM sims")
def held_out_similarity(spark, sf_dir):
    return _sims(spark, sf_dir)


@register("flip_test", _FLIPS + """
SELECT model, family, n_pairs, n_pos, n_neg, round(w, 1) AS w, round(z, 5) AS z, round(p, 7) AS p_value, round(median_a, 6) AS median_a, round(median_b, 6) AS median_b,
  round(median_diff, 6) + 0.0 AS median_diff, round(cohens_2g, 6) AS cohens_2g, observed, predicted, confirmed FROM flips""")  # fmt: skip
def flip_test(spark, sf_dir):
    t = held_out.flip_test(_sims(spark, sf_dir))
    numbers = [F.round("w", 1).alias("w"), F.round("z", 5).alias("z"), F.round("p_value", 7).alias("p_value"), *[(half_away(F.col(c), 6) + 0.0).alias(c) for c in ("median_a", "median_b", "median_diff", "cohens_2g")]]
    return t.select("model", "family", "n_pairs", "n_pos", "n_neg", *numbers, "observed", "predicted", "confirmed")


@register("solarize_test", _SOLARIZED + """
SELECT test_used, round(statistic, 4) AS statistic, round(p_value, 7) AS p_value, round(cohens_d, 5) AS cohens_d, round(cliffs_delta, 6) AS cliffs_delta,
  n_a, n_b, observed, predicted, confirmed FROM solarized""")  # fmt: skip
def solarize_test(spark, sf_dir):
    t = held_out.solarize_test(_sims(spark, sf_dir))
    numbers = [F.round(c, d).alias(c) for c, d in (("statistic", 4), ("p_value", 7), ("cohens_d", 5), ("cliffs_delta", 6))]
    return t.select("test_used", *numbers, "n_a", "n_b", "observed", "predicted", "confirmed")


@register("flip_summary", _FLIPS + """
SELECT model, family, n_pairs AS n, round(median_diff, 6) + 0.0 AS median_diff, round(cohens_2g, 6) AS cohens_2g,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars, confirmed FROM flips""")  # fmt: skip
def flip_summary(spark, sf_dir):
    s = held_out.summary(held_out.flip_test(_sims(spark, sf_dir)))
    return s.withColumn("median_diff", half_away(F.col("median_diff"), 6) + 0.0).withColumn("cohens_2g", half_away(F.col("cohens_2g"), 6))


@register("family_means", _SOLARIZED + """
SELECT 'dinov2' AS family, round(mean_a, 6) AS mean, n_a AS n FROM solarized UNION ALL SELECT 'clip', round(mean_b, 6), n_b FROM solarized""")  # fmt: skip
def family_means(spark, sf_dir):
    return held_out.family_means(held_out.solarize_test(_sims(spark, sf_dir))).withColumn("mean", F.round("mean", 6))


@register("bounded_effects", _FLIPS + "," + _SOLARIZED[len(_CHANGED) + 1 :] + """
SELECT model AS label, 'cohens_2g' AS statistic, round(cohens_2g, 6) AS value FROM flips
UNION ALL SELECT 'dinov2 against clip', 'cliffs_delta', round(cliffs_delta, 6) FROM solarized""")  # fmt: skip
def bounded_effects(spark, sf_dir):
    sims = _sims(spark, sf_dir)
    return held_out.bounded_effects(held_out.flip_test(sims), held_out.solarize_test(sims)).withColumn("value", F.round("value", 6))
