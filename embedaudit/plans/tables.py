"""Queries of the relational operators: predicates, joins, aggregates, windows, matching, ledgers, slides and tiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from embedaudit.functions import text
from embedaudit.functions.rounding import half_away
from embedaudit.operators import families, kernels, ledgers, matching, prefix, slides
from embedaudit.sources import study

from . import sqltail
from .registry import register

T = study.table


def _text(values):
    """Pixels as text, so that engines' results compare as plain values."""
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


@register("keep_members", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')")
def keep_members(spark, sf_dir):
    return T(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderstatus")


@register("require_members", "SELECT m AS missing FROM (VALUES ('click'), ('purchase'), ('refund')) t(m) WHERE m NOT IN (SELECT event_type FROM events WHERE event_type IS NOT NULL)")
def require_members(spark, sf_dir):
    return ledgers.missing_members(T(spark, sf_dir, "events"), "event_type", ["click", "purchase", "refund"])


_CASES = """cust AS (SELECT c_custkey, c_mktsegment AS site, CASE WHEN c_custkey % 17 <> 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'male' ELSE 'female' END END AS sex,
  CASE WHEN c_custkey % 17 <> 0 THEN CAST(floor(abs(c_acctbal) / 100) AS INTEGER) END AS age, CASE WHEN c_custkey % 3 = 0 THEN 'malignant' ELSE 'benign' END AS diagnosis FROM customer),
cases AS (SELECT c_custkey AS case_id, site, sex, age, diagnosis FROM cust WHERE c_custkey % 5 = 0),
cands AS (SELECT c_custkey AS candidate_id, site, sex, age, diagnosis FROM cust WHERE c_custkey % 5 <> 0)"""


@register("exclude_known", f"WITH {_CASES} SELECT candidate_id FROM cands WHERE coalesce(lower(trim(sex)), '') NOT IN ('male')")
def exclude_known(spark, sf_dir):
    known = F.coalesce(F.lower(F.trim("sex")), F.lit("")).isin("male")
    return study.candidates(spark, sf_dir).filter(~known).select("candidate_id")


@register("exclude_strict", f"WITH {_CASES} SELECT candidate_id FROM cands WHERE sex NOT IN ('male')")
def exclude_strict(spark, sf_dir):
    return study.candidates(spark, sf_dir).filter(~F.col("sex").isin("male")).select("candidate_id")


@register("skip_unallocated", "SELECT count(*) FILTER (nullif(trim(o_orderpriority), '') IS NULL OR o_orderkey % 10 = 0) AS skipped, count(*) FILTER (nullif(trim(o_orderpriority), '') IS NOT NULL AND o_orderkey % 10 <> 0) AS kept FROM orders")
def skip_unallocated(spark, sf_dir):
    empty = F.nullif(F.trim("o_orderpriority"), F.lit("")).isNull() | (F.col("o_orderkey") % 10 == 0)
    return T(spark, sf_dir, "orders").agg(F.count_if(empty).alias("skipped"), F.count_if(~empty).alias("kept"))


# cases with the sites of their prefix, and candidates with one site, days and race
_MATCH = """cust AS (
  SELECT c_custkey AS id, CASE WHEN c_custkey % 17 <> 0 THEN CASE WHEN c_nationkey % 2 = 0 THEN 'male' ELSE 'female' END END AS sex,
    CASE WHEN c_custkey % 17 <> 0 THEN abs(c_acctbal) END AS balance, CASE WHEN c_custkey % 3 = 0 THEN 'malignant' ELSE 'benign' END AS diagnosis
  FROM customer),
cases AS (
  SELECT id AS case_id, ['BP', 'BN', 'CP', 'CN', 'RP', 'RN', 'TP', 'TN', 'XX'][1 + (id // 5) % 9] || '-' || id AS code, sex,
    CAST(floor(balance / 100) AS INTEGER) AS age, diagnosis,
    CASE substr(code, 1, 2) WHEN 'BP' THEN ['Breast'] WHEN 'BN' THEN ['Breast'] WHEN 'CP' THEN ['Cervix Uteri'] WHEN 'CN' THEN ['Cervix Uteri'] WHEN 'RP' THEN ['Colon'] WHEN 'RN' THEN ['Colon']
      WHEN 'TP' THEN ['Head and Neck', 'Oral Cavity', 'Oropharynx'] WHEN 'TN' THEN ['Head and Neck', 'Oral Cavity', 'Oropharynx'] END AS sites
  FROM cust WHERE id % 5 = 0),
cands AS (
  SELECT id AS candidate_id, ['Breast', 'Cervix Uteri', 'Colon', 'Head and Neck', 'Oral Cavity', 'Oropharynx', 'Lung'][1 + id % 7] AS site, sex,
    CAST(floor(balance * 3) AS INTEGER) AS age_days, diagnosis,
    CASE WHEN id % 4 = 0 OR (id % 7 = 1 AND coalesce(sex, '') = 'female') OR (id % 7 = 2 AND id % 91 <> 2) THEN ' Black or African American' WHEN id % 4 = 1 THEN 'white' WHEN id % 4 = 2 THEN 'not reported' END AS race
  FROM cust WHERE id % 5 <> 0)"""
#: ``cap`` candidates of a tier are fetched first, 200 when these are used; races are excluded after that.
_LISTED = """,
met AS (
  SELECT c.case_id, d.candidate_id, t.tier, c.age AS case_age, d.age_days, c.diagnosis AS case_diagnosis, d.diagnosis, d.race
  FROM cases c JOIN cands d ON list_contains(c.sites, d.site) JOIN (VALUES (1), (2), (3)) t(tier)
    ON t.tier = 3 OR (c.sex IS NULL OR c.sex = d.sex) AND (t.tier = 2 OR c.age IS NULL
      OR d.age_days BETWEEN CAST(greatest(c.age - 20, 0) * 365 AS BIGINT) AND CAST((c.age + 20) * 365 AS BIGINT))),
fetched AS (SELECT *, row_number() OVER (PARTITION BY case_id, tier ORDER BY candidate_id) AS place FROM met QUALIFY place <= 200),
alive AS (
  SELECT *, min(tier) FILTER (place <= {cap}) OVER (PARTITION BY case_id) AS first_tier, min(tier) OVER (PARTITION BY case_id) AS late_tier
  FROM fetched WHERE coalesce(lower(trim(race)), '') NOT IN ('black or african american', 'african american')),
listed AS (
  SELECT case_id, candidate_id, min(CASE WHEN tier = first_tier AND place <= {cap} THEN tier ELSE 10 + tier END) AS list, any_value(case_diagnosis) AS case_diagnosis, any_value(diagnosis) AS diagnosis,
    any_value(coalesce(abs(nullif(case_age, 0)::DOUBLE - nullif(age_days, 0) / 365.0::DOUBLE), 25.0::DOUBLE)) AS age_delta
  FROM alive WHERE first_tier IS NOT NULL AND (tier = late_tier OR tier = first_tier AND place <= {cap}) GROUP BY case_id, candidate_id),
scored AS MATERIALIZED (
  SELECT case_id, candidate_id, CAST(list % 10 AS INTEGER) AS tier, list > 10 AS retry, age_delta,
    CASE WHEN case_diagnosis IS NOT DISTINCT FROM diagnosis THEN 0.0::DOUBLE ELSE 10.0::DOUBLE END + age_delta AS score
  FROM listed)"""
_TIERED = f"WITH {_MATCH}{_LISTED.replace('{cap}', '100')}"


def _lists(spark, sf_dir, **bounds):
    return matching.wish_lists(study.cases(spark, sf_dir), study.slide_candidates(spark, sf_dir), **bounds)


@register("match_candidates", _TIERED + " SELECT * FROM scored")
def match_candidates(spark, sf_dir):
    return matching.case_pairs(*_lists(spark, sf_dir)).select("case_id", "candidate_id", "tier", "retry", "age_delta", "score")


@register("best_per_case", _TIERED + " SELECT case_id, candidate_id, score FROM scored WHERE NOT retry QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score, candidate_id) = 1")
def best_per_case(spark, sf_dir):
    members, lists = _lists(spark, sf_dir)
    return matching.best_listed(members, lists.filter("NOT retry"))


#: Candidates are wanted ten to a case, so the first 20 of a tier come first and the rest when these are used.
_WANTED = 10
_ASSIGNED = f"WITH RECURSIVE {_MATCH}{_LISTED.replace('{cap}', '20')}" + """,
turn AS MATERIALIZED (SELECT case_id, row_number() OVER (ORDER BY case_id) AS i FROM (SELECT DISTINCT case_id FROM scored)),
wish AS MATERIALIZED (SELECT i, t.case_id, list(candidate_id ORDER BY retry, score, candidate_id) AS w FROM scored JOIN turn t USING (case_id) GROUP BY ALL),
step AS (
  SELECT 0::BIGINT AS i, CAST(NULL AS BIGINT) AS case_id, CAST(NULL AS BIGINT) AS candidate_id, []::BIGINT[] AS used
  UNION ALL
  SELECT w.i, w.case_id, list_filter(w.w, lambda x: NOT list_contains(s.used, x))[1]::BIGINT, list_append(s.used, list_filter(w.w, lambda x: NOT list_contains(s.used, x))[1]::BIGINT)
  FROM step s JOIN wish w ON w.i = s.i + 1),
assigned AS (SELECT case_id, candidate_id FROM step WHERE candidate_id IS NOT NULL)"""


@register("assign_unique", _ASSIGNED + " SELECT case_id, candidate_id FROM assigned")
def assign_unique(spark, sf_dir):
    return matching.assign(*_lists(spark, sf_dir, size=_WANTED))


@register("match_manifest", _ASSIGNED + """
SELECT c.case_id, code, sex, age, diagnosis, a.candidate_id, coalesce('T' || s.tier, 'NONE') AS tier, s.age_delta, s.score,
  CASE WHEN a.candidate_id IS NULL THEN 'NO_MATCH' ELSE 'MATCHED' END AS status
FROM cases c LEFT JOIN assigned a USING (case_id) LEFT JOIN scored s ON s.case_id = a.case_id AND s.candidate_id = a.candidate_id""")  # fmt: skip
def match_manifest(spark, sf_dir):
    lists = _lists(spark, sf_dir, size=_WANTED)
    cases = study.cases(spark, sf_dir).select("case_id", "code", "sex", "age", "diagnosis")
    return matching.match_manifest(cases, *lists, matching.assign(*lists))


@register("grid_pairs", """SELECT vec_id, CAST(p AS INTEGER) AS perturbation_id, ['mild','moderate','severe'][s] AS severity FROM embeddings, range(1, 19) a(p), range(1, 4) b(s)""")
def grid_pairs(spark, sf_dir):
    return T(spark, sf_dir, "embeddings").select("vec_id").crossJoin(F.broadcast(study.grid(spark).select("perturbation_id", "severity")))


@register("pending_work", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def pending_work(spark, sf_dir):
    done = T(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return ledgers.pending(T(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@register("first_available", """SELECT user_id, event_type, event_id FROM events WHERE event_type IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, ts, event_id) = 1""")  # fmt: skip
def first_available(spark, sf_dir):
    priority = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    e = T(spark, sf_dir, "events").filter("event_type IS NOT NULL")
    return ledgers.first_rows(e, ["user_id"], [priority, "ts", "event_id"]).select("user_id", "event_type", "event_id")


@register("latest_per_key", "SELECT user_id AS key, event_id, event_type AS status, value AS size FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, sf_dir):
    return ledgers.latest_per_key(study.ledger(spark, sf_dir), "key", F.col("seq")).select("key", "event_id", "status", "size")


@register("verify_complete", """WITH l AS (SELECT user_id AS key, value AS size FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
 SELECT key, coalesce(found_size > 0 AND (coalesce(size, 0) = 0 OR size = found_size), false) AS complete
 FROM l LEFT JOIN (SELECT user_id AS k, max(value) AS found_size FROM events WHERE event_id % 3 <> 0 GROUP BY 1) ON key = k""")  # fmt: skip
def verify_complete(spark, sf_dir):
    listing = T(spark, sf_dir, "events").filter("event_id % 3 <> 0").groupBy(F.col("user_id").alias("key")).agg(F.max("value").alias("found_size"))
    last = ledgers.latest_per_key(study.ledger(spark, sf_dir), "key", F.col("seq"))
    return ledgers.verify_complete(last, listing, "key").select("key", "complete")


@register("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return T(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@register("manifest_checks", """SELECT count(DISTINCT o_custkey) AS distinct_customers, count(*) - (count(DISTINCT o_custkey) + max(CASE WHEN o_custkey IS NULL THEN 1 ELSE 0 END)) AS duplicates,
 bool_and(coalesce(o_totalprice > 0, true)) AS all_priced, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders""")  # fmt: skip
def manifest_checks(spark, sf_dir):
    return T(spark, sf_dir, "orders").agg(
        F.count_distinct("o_custkey").alias("distinct_customers"), (F.count("*") - (F.count_distinct("o_custkey") + F.max(F.when(F.col("o_custkey").isNull(), 1).otherwise(0)))).alias("duplicates"),
        F.bool_and(F.coalesce(F.col("o_totalprice") > 0, F.lit(True))).alias("all_priced"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"),
    )


@register("status_summary", "SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type <> 'click') AS others, count(*) FILTER (event_type IS NULL) AS unknown FROM events GROUP BY 1")
def status_summary(spark, sf_dir):
    e = F.col("event_type")
    return T(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(e == "click").alias("clicks"), F.count_if(e != "click").alias("others"), F.count_if(e.isNull()).alias("unknown"))


@register("group_medians", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS median_price, round(median(l_quantity), 4) AS median_quantity FROM lineitem GROUP BY 1")
def group_medians(spark, sf_dir):
    m = prefix.medians(T(spark, sf_dir, "lineitem"), ["l_returnflag"], ["l_extendedprice", "l_quantity"])
    return m.select("l_returnflag", F.round("median_l_extendedprice", 4).alias("median_price"), F.round("median_l_quantity", 4).alias("median_quantity"))


@register("pooled_and_by_group", """SELECT l_returnflag, coalesce(l_linestatus, 'POOLED') AS cohort, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem
 GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))""")  # fmt: skip
def pooled_and_by_group(spark, sf_dir):
    # one aggregation of the rows; the pooled cells add up the groups' sums
    part = T(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"))
    sets = part.groupingSets([["l_returnflag"], ["l_returnflag", "l_linestatus"]], "l_returnflag", "l_linestatus").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return sets.select("l_returnflag", F.coalesce("l_linestatus", F.lit("POOLED")).alias("cohort"), "n", F.round(F.col("s") / F.col("n"), 6).alias("mean"))


@register("sample_groups", """SELECT o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':7'), o_orderkey) <= 20""")
def sample_groups(spark, sf_dir):
    h = F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(":7")).cast("binary"))
    by = Window.partitionBy("o_orderstatus").orderBy(h, "o_orderkey")
    return T(spark, sf_dir, "orders").withColumn("k", F.row_number().over(by)).filter("k <= 20").select("o_orderstatus", "o_orderkey")


@register("slot_numbers", "SELECT o_custkey, o_orderkey, o_custkey || '_t' || lpad(CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS VARCHAR), 2, '0') AS slot FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 10")
def slot_numbers(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = T(spark, sf_dir, "orders").withColumn("k", k).filter("k <= 10")
    return o.select("o_custkey", "o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit("_t"), F.lpad((F.col("k") - 1).cast("string"), 2, "0")).alias("slot"))


@register("running_cap", "SELECT event_type, event_id FROM events QUALIFY count(*) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 50")
def running_cap(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    return T(spark, sf_dir, "events").withColumn("n", n).filter("n <= 50").select("event_type", "event_id")


@register("common_keys", "SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders")
def common_keys(spark, sf_dir):
    return T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).intersect(T(spark, sf_dir, "orders").select("o_custkey"))


@register("missing_keys", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def missing_keys(spark, sf_dir):
    return T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")).subtract(T(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_custkey"))


@register("union_rows", "SELECT 'customer' AS kind, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def union_rows(spark, sf_dir):
    c = T(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    s = T(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s)


@register("text_functions", r"""SELECT p_partkey, CASE WHEN contains(p_brand, '-') THEN split_part(p_brand, '-', 1) ELSE '' END AS prefix,
 CASE WHEN regexp_matches(lower(p_type), 'steel|brass') THEN 'metal' WHEN regexp_matches(lower(p_type), 'tin|nickel') THEN 'soft' WHEN p_type IS NULL THEN 'unknown' ELSE 'other' END AS class,
 regexp_replace(p_name, '[<>:"/\\|?* ]', '_', 'g') AS safe, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE NULL END AS years,
 regexp_replace('gs://b/' || p_name, '^gs://', 'https://storage.googleapis.com/') AS url FROM part""")  # fmt: skip
def text_functions(spark, sf_dir):
    rules = (("metal", ("steel", "brass")), ("soft", ("tin", "nickel")))
    age = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit("Y"))).otherwise("n/a")
    return T(spark, sf_dir, "part").select(
        "p_partkey", text.tissue_prefix(F.col("p_brand")).alias("prefix"), text.classify_keywords(F.col("p_type"), rules).alias("class"),
        F.regexp_replace(text.safe_part(F.col("p_name")), " ", "_").alias("safe"), text.series_age(age).cast("int").alias("years"), text.https_of_gs(F.concat(F.lit("gs://b/"), F.col("p_name"))).alias("url"),
    )


@register("p_value_stars", "SELECT o_orderkey, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'n.s.' END AS stars FROM (SELECT o_orderkey, (o_orderkey % 997) / 9970.0::DOUBLE AS p FROM orders)")
def p_value_stars(spark, sf_dir):
    return T(spark, sf_dir, "orders").select("o_orderkey", text.p_value_stars((F.col("o_orderkey") % 997) / F.lit(9970.0)).alias("stars"))


_SLIDES = """s AS (SELECT p_partkey AS slide_id, CASE WHEN p_partkey % 7 <> 0 THEN 0.1::DOUBLE + p_size / 100.0::DOUBLE END AS mpp, CAST(800 + p_size * 40 AS INTEGER) AS width, CAST(600 + p_size * 25 AS INTEGER) AS height FROM part),
a AS (SELECT *, CASE WHEN mpp IS NULL THEN NULL WHEN abs(mpp - 0.5) <= abs(mpp * 4 - 0.5) AND abs(mpp - 0.5) <= abs(mpp * 16 - 0.5) THEN 0 WHEN abs(mpp * 4 - 0.5) <= abs(mpp * 16 - 0.5) THEN 1 ELSE 2 END AS best_level FROM s),
b AS (SELECT *, [1.0, 4.0, 16.0][best_level + 1]::DOUBLE AS down FROM a)"""


@register("audit_slides", f"""WITH {_SLIDES}, c AS (SELECT *, round(mpp * down, 5) AS achieved_mpp FROM b)
 SELECT slide_id, best_level, achieved_mpp, round(abs(achieved_mpp - 0.5), 5) AS mpp_deviation, round(abs(achieved_mpp - 0.5), 5) > 0.05 AS needs_resize, CASE WHEN mpp IS NULL THEN 'MISSING_MPP' ELSE 'OK' END AS status FROM c""")  # fmt: skip
def audit_slides(spark, sf_dir):
    return slides.audit(study.slides(spark, sf_dir)).select("slide_id", "best_level", "achieved_mpp", "mpp_deviation", "needs_resize", "status")


_PLAN = f"""{_SLIDES}, p AS (SELECT slide_id, best_level, round(mpp * down / 0.5, 6) AS scale, CAST(greatest(1, floor(width / down * (mpp * down / 0.5) + 0.5)) AS INTEGER) AS out_width,
  CAST(greatest(1, floor(height / down * (mpp * down / 0.5) + 0.5)) AS INTEGER) AS out_height FROM b WHERE mpp IS NOT NULL)"""


@register("resample_plan", f"WITH {_PLAN} SELECT * FROM p")
def resample_plan(spark, sf_dir):
    return slides.resample_plan(slides.audit(study.slides(spark, sf_dir)))


@register("tile_plan", f"""WITH {_PLAN} SELECT slide_id, CAST(r AS INTEGER) AS tile_row, CAST(c AS INTEGER) AS tile_col, CAST(c * 512 AS INTEGER) AS x, CAST(r * 512 AS INTEGER) AS y,
 CAST(least(512, out_width - c * 512) AS INTEGER) AS valid_width, CAST(least(512, out_height - r * 512) AS INTEGER) AS valid_height, round(c * 512 / scale, 4) AS source_x, round(r * 512 / scale, 4) AS source_y
 FROM (SELECT *, unnest(range(CAST(ceil(out_height / 512.0) AS BIGINT))) AS r FROM p) q, LATERAL (SELECT unnest(range(CAST(ceil(out_width / 512.0) AS BIGINT))) AS c)""")  # fmt: skip
def tile_plan(spark, sf_dir):
    return slides.tile_plan(slides.resample_plan(slides.audit(study.slides(spark, sf_dir))))


_TILES = """tile AS (SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'ACC' ELSE 'GDC' END || '_' || lpad(CAST(vec_id AS VARCHAR), 6, '0') AS sample_id,
  list_transform(range(1, 65), lambda i: CAST(greatest(0, least(255, round(127.5 + 255.0 * CAST(embedding[i] AS DOUBLE)))) AS INTEGER)) AS red FROM embeddings)"""


@register("tile_solarize", f"WITH {_TILES} SELECT sample_id, array_to_string(list_transform(red, lambda v: CASE WHEN v < 128 THEN v ELSE 255 - v END), ',') AS red FROM tile")
def tile_solarize(spark, sf_dir):
    return study.tiles(spark, sf_dir).select("sample_id", _text(kernels.solarize("red")).alias("red"))


@register("tile_flips", f"""WITH {_TILES} SELECT sample_id, array_to_string(list_transform(range(0, 64), lambda i: red[(i // 8) * 8 + (7 - i % 8) + 1]), ',') AS flip_h, array_to_string(list_transform(range(0, 64), lambda i: red[(7 - i // 8) * 8 + i % 8 + 1]), ',') AS flip_v,
 array_to_string(list_transform(range(0, 64), lambda i: red[(i % 8) * 8 + (7 - i // 8) + 1]), ',') AS rotated FROM tile""")  # fmt: skip
def tile_flips(spark, sf_dir):
    return study.tiles(spark, sf_dir).select("sample_id", _text(kernels.flip_h("red")).alias("flip_h"), _text(kernels.flip_v("red")).alias("flip_v"), _text(kernels.rotate90("red")).alias("rotated"))


@register("tile_brightness", f"WITH {_TILES} SELECT sample_id, s, array_to_string(list_transform(red, lambda v: CAST(least(255, floor(v * f + 0.5)) AS INTEGER)), ',') AS red FROM tile, (VALUES ('mild', 0.7::DOUBLE), ('moderate', 1.0::DOUBLE), ('severe', 1.3::DOUBLE)) t(s, f)")
def tile_brightness(spark, sf_dir):
    steps = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(f).alias("f")) for s, f in kernels.BRIGHTNESS.items()])
    t = study.tiles(spark, sf_dir).select("sample_id", "red", F.explode(steps).alias("x"))
    return t.select("sample_id", "x.s", _text(kernels.brightness("red", F.col("x.f"))).alias("red"))


@register("tile_channel_shift", f"WITH {_TILES} SELECT sample_id, CAST(k AS INTEGER) AS shift, array_to_string(list_transform(red, lambda v: CAST(least(255, v + k) AS INTEGER)), ',') AS red FROM tile, (VALUES (5), (15), (30)) t(k)")
def tile_channel_shift(spark, sf_dir):
    t = study.tiles(spark, sf_dir).select("sample_id", "red", F.explode(F.array(F.lit(5), F.lit(15), F.lit(30))).alias("shift"))
    return t.select("sample_id", "shift", _text(kernels.channel_shift("red", F.col("shift"))).alias("red"))


@register("tile_quality", f"""WITH {_TILES}, q AS (SELECT sample_id, red, list_transform(red, lambda v: CASE WHEN v < 128 THEN v ELSE 255 - v END) AS b FROM tile),
 m AS (SELECT sample_id, red, list_avg(list_transform(range(1, 65), lambda i: CAST((red[i] - b[i]) * (red[i] - b[i]) AS DOUBLE))) AS mse, list_avg(list_transform(range(1, 65), lambda i: CAST(abs(red[i] - b[i]) AS DOUBLE))) AS mad,
   list_avg(list_transform(red, lambda v: CAST(v AS DOUBLE))) AS mean FROM q)
 SELECT sample_id, CASE WHEN mse = 0 THEN NULL ELSE round(10 * log10(65025 / mse), 6) END AS psnr, round(mad, 6) AS mean_abs_diff, round(mean, 6) AS mean_intensity,
 round(sqrt(list_avg(list_transform(red, lambda v: (v - mean) * (v - mean)))), 6) AS std_intensity FROM m""")  # fmt: skip
def tile_quality(spark, sf_dir):
    t = study.tiles(spark, sf_dir).withColumn("b", kernels.solarize("red"))
    psnr = kernels.psnr("red", "b")
    return t.select(
        "sample_id", F.when(psnr != float("inf"), F.round(psnr, 6)).alias("psnr"), F.round(kernels.mean_abs_diff("red", "b"), 6).alias("mean_abs_diff"),
        F.round(kernels.mean_intensity("red"), 6).alias("mean_intensity"), F.round(kernels.std_intensity("red"), 6).alias("std_intensity"),
    )


@register("tile_entropy", f"""WITH {_TILES}, c AS (SELECT sample_id, v, count(*) / 64.0::DOUBLE AS p FROM (SELECT sample_id, unnest(red) AS v FROM tile) GROUP BY ALL)
 SELECT sample_id, round(-sum(p * log2(p)), 6) AS entropy FROM c GROUP BY 1""")  # fmt: skip
def tile_entropy(spark, sf_dir):
    return kernels.entropy(study.tiles(spark, sf_dir), "sample_id", "red")


@register("tile_background", f"""WITH {_TILES}, m AS (SELECT sample_id, red, list_avg(list_transform(red, lambda v: CAST(v AS DOUBLE))) AS mean FROM tile)
 SELECT sample_id FROM m WHERE mean > 130 AND sqrt(list_avg(list_transform(red, lambda v: (v - mean) * (v - mean)))) < 32""")  # fmt: skip
def tile_background(spark, sf_dir):
    return study.tiles(spark, sf_dir).filter(kernels.is_background("red", 130, 32)).select("sample_id")


@register("grid_means", f"""WITH {_TILES} SELECT sample_id, c AS cell, round((red[(c // 4) * 16 + (c % 4) * 2 + 1] + red[(c // 4) * 16 + (c % 4) * 2 + 2]
  + red[(c // 4) * 16 + 8 + (c % 4) * 2 + 1] + red[(c // 4) * 16 + 8 + (c % 4) * 2 + 2]) / 4.0::DOUBLE, 4) AS mean FROM tile, (SELECT CAST(unnest(range(0, 16)) AS INTEGER) AS c)""")  # fmt: skip
def grid_means(spark, sf_dir):
    return study.tiles(spark, sf_dir).select("sample_id", F.posexplode(kernels.grid_means("red")).alias("cell", "mean"))


_HELD_OUT = f"""WITH {_TILES}, c AS (SELECT sample_id, red, list_transform(range(0, 64), lambda i: red[(i // 8) * 8 + (7 - i % 8) + 1]) AS h, list_transform(range(0, 64), lambda i: red[(7 - i // 8) * 8 + i % 8 + 1]) AS v FROM tile),
 s AS (SELECT substr(sample_id, 1, 3) AS cohort, round(list_dot_product(list_transform(red, lambda x: x::DOUBLE), list_transform(h, lambda x: x::DOUBLE)) / list_dot_product(list_transform(red, lambda x: x::DOUBLE), list_transform(red, lambda x: x::DOUBLE)), 6) AS x,
   round(list_dot_product(list_transform(red, lambda x: x::DOUBLE), list_transform(v, lambda x: x::DOUBLE)) / list_dot_product(list_transform(red, lambda x: x::DOUBLE), list_transform(red, lambda x: x::DOUBLE)), 6) AS y FROM c),
 d AS (SELECT cohort, abs(round(x - y, 9)) AS v, x > y AS up FROM s WHERE x <> y),
 g AS (SELECT cohort, v, count(*) AS t, count(*) FILTER (up) AS p FROM d GROUP BY ALL),
 r AS (SELECT *, sum(t) OVER (PARTITION BY cohort ORDER BY v ROWS UNBOUNDED PRECEDING) - t + (t + 1) / 2.0::DOUBLE AS mid FROM g),
 w AS (SELECT cohort, sum(p * mid) AS plus, sum((t - p) * mid) AS minus, sum(t)::DOUBLE AS n, sum(t * t * t - t)::DOUBLE AS ties FROM r GROUP BY 1),
 z AS (SELECT *, (least(plus, minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w),
 o AS (SELECT cohort, count(*) AS n_pairs, count(*) FILTER (x > y) AS n_pos, count(*) FILTER (x < y) AS n_neg, round(median(x), 6) AS median_a, round(median(y), 6) AS median_b, round(median(round(x - y, 9)), 6) + 0.0 AS median_diff,
   round((count(*) FILTER (x > y) - count(*) FILTER (x < y)) / (count(*) FILTER (x <> y))::DOUBLE, 6) AS cohens_2g FROM s GROUP BY 1)"""


@register("held_out_pairs", _HELD_OUT + " SELECT cohort, n_pairs, n_pos, n_neg, median_a, median_b, cohens_2g FROM o")
def held_out_pairs(spark, sf_dir):
    w = kernels.held_out_test(study.tiles(spark, sf_dir))
    return w.select("cohort", "n_pairs", "n_pos", "n_neg", *[half_away(F.col(c), 6).alias(c) for c in ("median_a", "median_b", "cohens_2g")])


@register("held_out_test", _HELD_OUT + f""", q AS (SELECT o.*, round(least(plus, minus), 1) AS w, round(z, 5) AS z, {sqltail.normal2("z")} AS p FROM o JOIN z USING (cohort))
 SELECT * EXCLUDE (p), round(p, 7) AS p_value, CASE WHEN p < 0.05 AND median_diff > 0 THEN 'flip_h_higher' WHEN p < 0.05 AND median_diff < 0 THEN 'flip_v_higher' ELSE 'no_difference' END AS observed, 'no_difference' AS predicted,
 CASE WHEN p < 0.05 AND median_diff > 0 THEN 'flip_h_higher' WHEN p < 0.05 AND median_diff < 0 THEN 'flip_v_higher' ELSE 'no_difference' END = 'no_difference' AS confirmed FROM q""")  # fmt: skip
def held_out_test(spark, sf_dir):
    """The paired test with what it shows beside what was predicted for the cohort (no difference)."""
    w = families.with_prediction(kernels.held_out_test(study.tiles(spark, sf_dir)), "flip_h_higher", "flip_v_higher", "no_difference", F.lit("no_difference"))
    return w.select("cohort", "n_pairs", "n_pos", "n_neg", F.round("w", 1).alias("w"), F.round("z", 5).alias("z"), F.round("p_value", 7).alias("p_value"), *[(half_away(F.col(c), 6) + 0.0).alias(c) for c in ("median_a", "median_b", "median_diff", "cohens_2g")], "observed", "predicted", "confirmed")


@register("folder_paths", """WITH RECURSIVE folder(id, path) AS (SELECT r_regionkey, r_name FROM region),
 nation_path AS (SELECT n_nationkey, f.path || '/' || n_name AS path FROM nation JOIN folder f ON f.id = n_regionkey)
 SELECT c_custkey AS file_id, p.path || '/' || c_name AS path FROM customer JOIN nation_path p ON p.n_nationkey = c_nationkey""")  # fmt: skip
def folder_paths(spark, sf_dir):
    """A listing of folders (region over nation) and files (customers), resolved level by level at any depth."""
    region = T(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    nation = T(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent"), F.col("n_name").alias("name"))
    files = T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent"), F.col("c_name").alias("name"))
    return ledgers.folder_paths(region.unionByName(nation), files)


@register("shard", "SELECT o_orderkey FROM orders QUALIFY (row_number() OVER (ORDER BY o_orderkey) - 1) % 4 = 1")
def shard(spark, sf_dir):
    return ledgers.shard(T(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 1, 4)


@register("stream_ledger", "SELECT user_id AS key, event_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_ledger(spark, sf_dir):
    from embedaudit.streaming import ledger_stream

    return ledger_stream.run_in_drops(spark, sf_dir).select("key", "event_id", "status")


@register("corpus_completeness", """SELECT event_type, count(*) AS found, 200 AS expected, CASE WHEN count(*) = 200 THEN 'ok' WHEN count(*) < 200 THEN 'missing' ELSE 'extra' END AS status FROM events GROUP BY 1""")
def corpus_completeness(spark, sf_dir):
    counts = T(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("found")).withColumn("expected", F.lit(200))
    return counts.withColumn("status", F.when(F.col("found") == F.col("expected"), "ok").when(F.col("found") < F.col("expected"), "missing").otherwise("extra"))


@register("level_texts", f"WITH {_SLIDES} SELECT slide_id, printf('%.4f;%.4f;%.4f', mpp, mpp * 4, mpp * 16) AS levels FROM s WHERE mpp IS NOT NULL")
def level_texts(spark, sf_dir):
    s = study.slides(spark, sf_dir).filter("mpp IS NOT NULL")
    return s.select("slide_id", F.array_join(F.transform("levels", lambda d: F.format_string("%.4f", F.col("mpp") * d)), ";").alias("levels"))


@register("weighted_means", """WITH g AS (SELECT l_suppkey, l_returnflag, count(*) FILTER (l_linestatus = 'F') AS n_a, count(*) FILTER (l_linestatus <> 'F') AS n_b,
  coalesce(avg(l_quantity) FILTER (l_linestatus = 'F'), 0) AS a, coalesce(avg(l_quantity) FILTER (l_linestatus <> 'F'), 0) AS b FROM lineitem GROUP BY ALL)
 SELECT l_suppkey, l_returnflag, round((a * n_a + b * n_b) / (n_a + n_b), 6) AS mean FROM g""")  # fmt: skip
def weighted_means(spark, sf_dir):
    f = F.col("l_linestatus") == "F"
    q = F.col("l_quantity")
    g = T(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.count_if(f).alias("n_a"), F.count_if(~f).alias("n_b"), F.coalesce(F.avg(F.when(f, q)), F.lit(0.0)).alias("a"), F.coalesce(F.avg(F.when(~f, q)), F.lit(0.0)).alias("b")
    )
    return g.select("l_suppkey", "l_returnflag", F.round((F.col("a") * F.col("n_a") + F.col("b") * F.col("n_b")) / (F.col("n_a") + F.col("n_b")), 6).alias("mean"))


@register("match_series", f"""WITH {_CASES},
s AS (SELECT s_suppkey AS series_id, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_nationkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex, CAST(floor(abs(s_acctbal) / 100) AS DOUBLE) AS age, CASE WHEN s_suppkey % 2 = 0 THEN 'malignant' ELSE 'benign' END AS diagnosis FROM supplier)
SELECT case_id, series_id, score FROM (SELECT c.case_id, s.series_id, CASE WHEN c.diagnosis = s.diagnosis THEN 0.0::DOUBLE ELSE 10.0::DOUBLE END + coalesce(abs(nullif(c.age, 0) - nullif(s.age, 0)), 25.0::DOUBLE) AS score
  FROM cases c JOIN s ON s.sex IS NULL OR s.sex = c.sex) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score, series_id) = 1""")
def match_series(spark, sf_dir):
    """Suppliers as series: sex by nation's parity, none for every third; ages as the series write them."""
    key = F.col("s_suppkey")
    sex = F.when(key % 3 == 0, F.lit(None)).when(F.col("s_nationkey") % 2 == 0, "M").otherwise("F")
    series = T(spark, sf_dir, "supplier").select(
        key.alias("series_id"), sex.alias("sex"), F.concat(F.lpad(F.floor(F.abs("s_acctbal") / 100).cast("string"), 3, "0"), F.lit("Y")).alias("age"),
        F.when(key % 2 == 0, "malignant").otherwise("benign").alias("diagnosis"),
    )
    return matching.match_series(study.cases(spark, sf_dir), series)


@register("perturb_status", f"WITH {_TILES} SELECT CAST(p AS INTEGER) AS perturbation_id, 'DONE' AS status, 3 * count(*) AS n FROM tile, range(1, 19) a(p) GROUP BY p")
def perturb_status(spark, sf_dir):
    return kernels.perturb(study.tiles(spark, sf_dir), study.grid(spark)).groupBy("perturbation_id", "status").agg(F.count("*").alias("n"))


@register("incremental_cells", """SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_suppkey = l.l_suppkey AND d.l_returnflag = l.l_returnflag AND d.l_quantity > 49)""")
def incremental_cells(spark, sf_dir):
    """Cells that a store of results (here: those with a large order) does not hold yet."""
    rows = T(spark, sf_dir, "lineitem")
    keys = ["l_suppkey", "l_returnflag"]
    return ledgers.pending(rows.select(*keys).distinct(), rows.filter("l_quantity > 49"), keys)
