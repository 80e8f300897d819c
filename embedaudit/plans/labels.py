"""Queries of identifiers, labels, gates, jobs and embedding stores, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from embedaudit.functions import text
from embedaudit.operators import cells, families, kernels, ledgers, slides, stores
from embedaudit.sources import study

from .cells import BASE_SQL, METRIC_SQL
from .registry import register
from .tables import _CASES, _SLIDES, _TILES

T = study.table


def _pick(key, values):
    """One of some texts by a key, in Spark."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(key, F.lit(len(values))).cast("int"))


def _pick_sql(key: str, values) -> str:
    items = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{items}][{key} % {len(values)} + 1]"


def _map_sql(key: str, table: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {key} {whens} END"


_DIAGNOSES = ("Invasive ductal CARCINOMA", "Benign tumour", "Fibroadenoma", "Atypical hyperplasia", "CIN 2", "Healthy tissue", None, "Squamous cells", "Lipoma", "Dysplasia with atypia", "")


@register("diagnosis_class", "SELECT c_custkey, CASE WHEN d IS NULL THEN 'unknown' " + " ".join(f"WHEN regexp_matches(lower(d), '{'|'.join(words)}') THEN '{name}'" for name, words in text.DIAGNOSIS) + f" ELSE 'other' END AS class FROM (SELECT c_custkey, {_pick_sql('c_custkey', _DIAGNOSES)} AS d FROM customer)")
def diagnosis_class(spark, sf_dir):
    c = T(spark, sf_dir, "customer").select("c_custkey", _pick(F.col("c_custkey"), _DIAGNOSES).alias("d"))
    return c.select("c_custkey", text.classify_keywords(F.col("d")).alias("class"))


_PREFIXES = ("BP-", "bn-", "CP", "RN_", "Tp", "TN-", "XX", "B")
_CASE_ID = f"{_pick_sql('c_custkey', _PREFIXES)} || CAST(c_custkey AS VARCHAR)"


@register("case_sites", f"SELECT case_id, {_map_sql('p', {k: ';'.join(v) for k, v in text.SITES.items()})} AS sites, {_map_sql('p', {k: text.ONE_SITE.get(k, v[0]) for k, v in text.SITES.items()})} AS site FROM (SELECT {_CASE_ID} AS case_id, upper(substr({_CASE_ID}, 1, 2)) AS p FROM customer)")
def case_sites(spark, sf_dir):
    c = T(spark, sf_dir, "customer").select(F.concat(_pick(F.col("c_custkey"), _PREFIXES), F.col("c_custkey").cast("string")).alias("case_id"))
    return c.select("case_id", F.array_join(text.site_of_prefix(F.col("case_id")), ";").alias("sites"), text.one_site_of_prefix(F.col("case_id")).alias("site"))


_PROGRAMS = ("TCGA-BRCA", "HCM-CMDC", "cptac-3", "TARGET-AML", "CGCI-BLGSP", "OTHER-X", None)


@register("program_buckets", f"SELECT p_partkey, coalesce({_map_sql('upper(split_part(p, chr(45), 1))', text.BUCKETS)}, '{text.BUCKETS['TCGA']}') AS bucket, 'https://storage.googleapis.com/' || coalesce({_map_sql('upper(split_part(p, chr(45), 1))', text.BUCKETS)}, '{text.BUCKETS['TCGA']}') || '/' || p_partkey AS url FROM (SELECT p_partkey, {_pick_sql('p_partkey', _PROGRAMS)} AS p FROM part)")
def program_buckets(spark, sf_dir):
    p = T(spark, sf_dir, "part").select("p_partkey", text.bucket_of(_pick(F.col("p_partkey"), _PROGRAMS)).alias("bucket"))
    return p.select("p_partkey", "bucket", text.https_of_gs(F.concat(F.lit("gs://"), F.col("bucket"), F.lit("/"), F.col("p_partkey").cast("string"))).alias("url"))


_NAMES = ("a.SVS", "b.tiff", "c.png", "d", "e.svs.part", "f.QPTIFF", "dir.svs/g", "h.mrxs")


@register("slide_files", f"SELECT p_partkey, name FROM (SELECT p_partkey, {_pick_sql('p_partkey', _NAMES)} AS name FROM part) WHERE lower(regexp_extract(name, '\\.([^./]+)$', 1)) IN ({', '.join(repr(e) for e in text.SLIDE_EXTENSIONS)})")
def slide_files(spark, sf_dir):
    return T(spark, sf_dir, "part").select("p_partkey", _pick(F.col("p_partkey"), _NAMES).alias("name")).filter(text.has_extension(F.col("name")))


_LINKS = ("https://drive.google.com/drive/folders/1AbCdEfGhIj?usp=x", "1AbCdEfGhIjKl", "https://drive.google.com/open?id=9ZyXwVu_-T", "short", None)
_HEADERS = ('attachment; filename="a b.svs"', "attachment; filename=c.tiff; size=3", "inline", None, "filename= d.svs ")


@register("link_parts", f"""SELECT o_orderkey, CASE WHEN regexp_full_match(u, '[A-Za-z0-9_-]{{10,}}') THEN u ELSE coalesce(nullif(regexp_extract(u, '/folders/([A-Za-z0-9_-]+)', 1), ''), nullif(regexp_extract(u, '[?&]id=([A-Za-z0-9_-]+)', 1), '')) END AS folder,
 coalesce(nullif(trim(regexp_extract(h, 'filename="?([^";]*)', 1)), ''), 'file-' || o_orderkey) AS name FROM (SELECT o_orderkey, {_pick_sql('o_orderkey', _LINKS)} AS u, {_pick_sql('o_orderkey', _HEADERS)} AS h FROM orders)""")
def link_parts(spark, sf_dir):
    o, key = T(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select("o_orderkey", text.folder_id(_pick(key, _LINKS)).alias("folder"), text.attachment_name(_pick(key, _HEADERS), F.concat(F.lit("file-"), key.cast("string"))).alias("name"))


_SEXES = ("Male", "m", " female", "F", "", "unknown", None)


@register("sex_codes", f"SELECT c_custkey, CASE WHEN s LIKE 'M%' THEN 'male' WHEN length(s) > 0 THEN 'female' END AS sex, CASE WHEN s LIKE 'M%' THEN 'M' WHEN length(s) > 0 THEN 'F' END AS series_sex FROM (SELECT c_custkey, upper(trim({_pick_sql('c_custkey', _SEXES)})) AS s FROM customer)")
def sex_codes(spark, sf_dir):
    c = T(spark, sf_dir, "customer").select("c_custkey", _pick(F.col("c_custkey"), _SEXES).alias("s"))
    return c.select("c_custkey", text.sex_code(F.col("s")).alias("sex"), text.series_sex(F.col("s")).alias("series_sex"))


@register("event_stamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, round(event_id * 131071 / 1048576.0::DOUBLE, 2) AS mb FROM events")
def event_stamps(spark, sf_dir):
    return T(spark, sf_dir, "events").select("event_id", text.utc_iso(F.col("ts")).alias("stamp"), text.megabytes(F.col("event_id") * 131071).alias("mb"))


_JSON = """'{"a": {"b": ' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderkey || '"' END || '}}'"""


@register("nested_values", f"SELECT o_orderkey, coalesce(json_extract_string({_JSON}, '$.a.b'), 'none') AS value, coalesce(json_extract_string({_JSON}, '$.a.c.d'), 'none') AS missing FROM orders")
def nested_values(spark, sf_dir):
    key = F.col("o_orderkey")
    json = F.concat(F.lit('{"a": {"b": '), F.when(key % 3 == 0, "null").otherwise(F.concat(F.lit('"'), key.cast("string"), F.lit('"'))), F.lit("}}"))
    return T(spark, sf_dir, "orders").select("o_orderkey", text.nested_get(json, "a.b", "none").alias("value"), text.nested_get(json, "a.c.d", "none").alias("missing"))


_REGISTRY = "[" + ", ".join(f"'{name}'" for name, _, _ in kernels.REGISTRY.values()) + "]"
_CATEGORIES = "[" + ", ".join(f"'{c}'" for _, c, _ in kernels.REGISTRY.values()) + "]"
_PARAMS = "[" + ", ".join("NULL" if k not in text.PARAMETERS else "[" + ", ".join(f"{float(v)}::DOUBLE" for v in text.PARAMETERS[k]) + "]" for k in range(1, 19)) + "]"
_STEP = "CASE severity WHEN 'mild' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END"


@register("cell_labels", METRIC_SQL + f""", c AS (SELECT model, perturbation_id, severity, count(*) AS n FROM metric GROUP BY ALL)
 SELECT model || printf('__p%02d__', perturbation_id) || severity AS label, 'uni__' || model || printf('__p%02d__', perturbation_id) || severity AS pair_label, printf('%02d. ', perturbation_id) || {_REGISTRY}[perturbation_id] AS name, {_CATEGORIES}[perturbation_id] AS category,
 {_map_sql('model', text.FAMILIES)} AS family, {_PARAMS}[perturbation_id][{_STEP}] AS param, n,
 row_number() OVER (ORDER BY CASE model WHEN 'uni' THEN 1 WHEN 'conch' THEN 2 WHEN 'quilt_llava' THEN 3 ELSE 4 END, perturbation_id, {_STEP}) AS place FROM c""")
def cell_labels(spark, sf_dir):
    """The metric table's cells with their labels, what the registry says of them, and their place in the fixed order."""
    c = study.cosine_table(spark, sf_dir).groupBy("model", "perturbation_id", "severity").agg(F.count("*").alias("n"))
    c = stores.with_registry(c)
    p, s = F.col("perturbation_id"), F.col("severity")
    # a row for each cell of the design
    place = F.row_number().over(Window.orderBy(*stores.cell_order()))
    return c.select(
        text.cell_label(p, s, F.col("model")).alias("label"), text.cell_label(p, s, F.lit("uni"), F.col("model")).alias("pair_label"), text.numbered_name(p, F.col("name")).alias("name"),
        "category", "family", text.param_of(p, s).alias("param"), "n", place.alias("place"),
    )


@register("level_terms", METRIC_SQL + " SELECT DISTINCT 'C(perturbation_id)[T.' || perturbation_id || ']' AS term, perturbation_id AS level, CASE WHEN sample_id LIKE 'ACC_%' THEN 'ACC' ELSE 'GDC' END AS cohort FROM metric")
def level_terms(spark, sf_dir):
    m = study.cosine_table(spark, sf_dir).select(F.concat(F.lit("C(perturbation_id)[T."), F.col("perturbation_id").cast("string"), F.lit("]")).alias("term"), text.cohort_of(F.col("sample_id")).alias("cohort")).distinct()
    return m.select("term", text.parse_term(F.col("term")).alias("level"), "cohort")


_STATUSES = ("MATCHED", " matched ", "NO_MATCH", None)
_URLS = ("https://x/", "http://x/", None, "https://y/", "gs://z/")


@register("ready_rows", f"SELECT c_custkey FROM (SELECT c_custkey, {_pick_sql('c_custkey', _STATUSES)} AS s, {_pick_sql('c_custkey', _URLS)} AS u FROM customer) WHERE upper(trim(s)) = 'MATCHED' AND u LIKE 'https://%'")
def ready_rows(spark, sf_dir):
    key = F.col("c_custkey")
    return T(spark, sf_dir, "customer").filter(text.ready(_pick(key, _STATUSES), _pick(key, _URLS))).select("c_custkey")


_GATED = """g AS (SELECT c_nationkey, c_mktsegment, count(*) FILTER (c_custkey % 4 = 0) AS n_a, count(*) FILTER (c_custkey % 4 <> 0) AS n_b FROM customer GROUP BY ALL)"""


@register("gated_cells", f"WITH {_GATED} SELECT *, least(n_a, n_b) < 3 AS skipped, CASE WHEN least(n_a, n_b) < 3 THEN printf('n_a=%d, n_b=%d: fewer than 3 values', n_a, n_b) END AS reason FROM g")
def gated_cells(spark, sf_dir):
    return cells.min_n_gate(_gated(spark, sf_dir))


def _gated(spark, sf_dir):
    a = F.col("c_custkey") % 4 == 0
    return T(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count_if(a).alias("n_a"), F.count_if(~a).alias("n_b"))


@register("dropped_cells", f"WITH {_GATED} SELECT * FROM g WHERE least(n_a, n_b) >= 3")
def dropped_cells(spark, sf_dir):
    return cells.min_n_gate(_gated(spark, sf_dir), mode="drop")


@register("paired_gate", """WITH s AS (SELECT s_nationkey AS k, round(s_acctbal, 2) - 4000 AS d FROM supplier WHERE round(s_acctbal, 2) <> 4000), g AS (SELECT k, abs(d) AS v, count(*) AS t FROM s GROUP BY ALL)
 SELECT k AS s_nationkey, count(*) AS n_pairs, count(*) >= 10 AS tested FROM s GROUP BY 1""")
def paired_gate(spark, sf_dir):
    """Nations with fewer than ten suppliers get no signed-rank test."""
    pairs = T(spark, sf_dir, "supplier").select("s_nationkey", F.round("s_acctbal", 2).alias("x"), F.lit(4000.0).alias("y")).withColumn("diff", F.col("x") - F.col("y")).filter("diff <> 0")
    w = families.wilcoxon_signed_rank(pairs, ["s_nationkey"])
    return w.select("s_nationkey", "n_pairs", F.col("p_value").isNotNull().alias("tested"))


@register("condition_map", METRIC_SQL + " SELECT model, sample_id, max(cosine_similarity) FILTER (perturbation_id = 1) AS p01, max(cosine_similarity) FILTER (perturbation_id = 17) AS p17, max(cosine_similarity) FILTER (perturbation_id = 18) AS p18 FROM metric WHERE severity = 'severe' GROUP BY ALL")
def condition_map(spark, sf_dir):
    rows = study.cosine_table(spark, sf_dir).filter("severity = 'severe'").withColumn("condition", F.format_string("p%02d", F.col("perturbation_id")))
    return stores.condition_map(rows, ["model", "sample_id"], "condition", ["p01", "p17", "p18"], "cosine_similarity")


@register("slide_notes", f"""WITH {_SLIDES}, n AS (SELECT s.slide_id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE width END AS width, p_size % 7 = 3 AS broken, mpp FROM s JOIN part ON p_partkey = slide_id),
 st AS (SELECT n.slide_id, CASE WHEN n.width IS NULL THEN 'MISSING_FILE' WHEN broken THEN 'OPEN_ERROR' WHEN n.mpp IS NULL THEN 'MISSING_MPP' ELSE 'OK' END AS status, round(n.mpp * down, 5) AS got FROM n JOIN b USING (slide_id))
 SELECT slide_id, status, CASE status WHEN 'MISSING_FILE' THEN 'file not found' WHEN 'OPEN_ERROR' THEN 'could not be opened' WHEN 'MISSING_MPP' THEN 'no resolution in metadata'
  ELSE CASE WHEN round(abs(got - 0.5), 5) > 0.05 THEN printf('no level within tolerance of 0.5 MPP (nearest: %.3f); needs a resize step', got) ELSE '' END END AS notes FROM st""")
def slide_notes(spark, sf_dir):
    size = T(spark, sf_dir, "part").select(F.col("p_partkey").alias("slide_id"), "p_size")
    s = study.slides(spark, sf_dir).join(size, "slide_id")
    s = s.withColumn("width", F.when(F.col("p_size") % 5 != 0, F.col("width"))).withColumn("levels", F.when(F.col("p_size") % 7 != 3, F.col("levels")))
    return slides.audit(s).select("slide_id", "status", "notes")


@register("large_slides", f"WITH {_SLIDES} SELECT slide_id FROM s WHERE width > 1500 AND height > 1500")
def large_slides(spark, sf_dir):
    return slides.large_enough(study.slides(spark, sf_dir), 1500).select("slide_id")


@register("sampled_tiles", f"""WITH {_TILES}, m AS (SELECT CAST(substr(sample_id, 5) AS BIGINT) // 50 AS slide_id, CAST(substr(sample_id, 5) AS BIGINT) % 50 AS place, red, list_avg(list_transform(red, lambda v: CAST(v AS DOUBLE))) AS mean FROM tile),
 good AS (SELECT slide_id, place FROM m WHERE NOT (mean > 130 AND sqrt(list_avg(list_transform(red, lambda v: (v - mean) * (v - mean)))) < 32)),
 tries AS (SELECT slide_id, slot, attempt, CAST('0x' || substr(md5(slide_id || '|' || slot || '|' || attempt || '|7'), 1, 8) AS BIGINT) % 50 AS place FROM (SELECT DISTINCT slide_id FROM m), range(10) a(slot), range(25) b(attempt))
 SELECT slide_id, CAST(slot AS INTEGER) AS slot, CAST(attempt AS INTEGER) AS attempt, place FROM tries JOIN good USING (slide_id, place) QUALIFY row_number() OVER (PARTITION BY slide_id, slot ORDER BY attempt) = 1""")
def sampled_tiles(spark, sf_dir):
    t, number = study.tiles(spark, sf_dir), F.substring("sample_id", 5, 10).cast("long")
    tiles = t.select(F.floor(number / 50).cast("long").alias("slide_id"), (number % 50).alias("place"), kernels.is_background("red", 130, 32).alias("is_background"))
    return slides.sample_tiles(tiles.select("slide_id").distinct().withColumn("places", F.lit(50)), tiles, 10, 7)


_MANIFEST = """m AS (SELECT CAST(c_custkey AS VARCHAR) AS case_id, CASE WHEN c_custkey % 3 <> 0 THEN 'f' || c_custkey END AS file_id, c_name || '.svs' AS file_name FROM customer)"""
_JOBS = _MANIFEST + """, j AS (SELECT case_id AS job_id, 'case' AS kind, 'in/' || case_id || '.svs' AS source, 'out/' || case_id || '.tiff' AS target FROM m
 UNION ALL SELECT file_id, 'control', 'in/' || file_id || '/' || file_name, 'out/' || file_id || '.tiff' FROM m WHERE file_id IS NOT NULL)"""


def _jobs(spark, sf_dir):
    key = F.col("c_custkey")
    m = T(spark, sf_dir, "customer").select(key.cast("string").alias("case_id"), F.when(key % 3 != 0, F.concat(F.lit("f"), key.cast("string"))).alias("file_id"), F.concat("c_name", F.lit(".svs")).alias("file_name"))
    return slides.build_jobs(m, "in", "out")


@register("build_jobs", f"WITH {_JOBS} SELECT * FROM j")
def build_jobs(spark, sf_dir):
    return _jobs(spark, sf_dir)


_LISTED = """l AS (SELECT source AS path, length(job_id) * 100 AS length FROM j WHERE length(job_id) % 2 = 0 OR job_id LIKE '%1' UNION ALL SELECT target, CASE WHEN job_id LIKE '%5' THEN 0 ELSE 7 END FROM j WHERE job_id LIKE '%4' OR job_id LIKE '%5')"""


def _listing(jobs):
    n = F.length("job_id")
    ends = lambda x: F.col("job_id").endswith(x)
    sources = jobs.filter((n % 2 == 0) | ends("1")).select(F.col("source").alias("path"), (n * 100).alias("length"))
    return sources.unionByName(jobs.filter(ends("4") | ends("5")).select(F.col("target").alias("path"), F.when(ends("5"), 0).otherwise(7).alias("length")))


@register("attach_files", f"WITH {_JOBS}, {_LISTED} SELECT job_id, length AS found_size, path IS NOT NULL AS found FROM j LEFT JOIN l ON source = path")
def attach_files(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return slides.attach_files(jobs, "source", _listing(jobs)).select("job_id", "found_size", "found")


@register("resample_report", f"""WITH {_JOBS}, {_LISTED} SELECT job_id, CASE WHEN coalesce(o.length, 0) > 0 THEN 'SKIPPED_EXISTING' WHEN i.path IS NULL THEN 'MISSING_INPUT' WHEN job_id NOT LIKE '%7' THEN 'DONE' ELSE 'ERROR' END AS status
 FROM j LEFT JOIN l i ON source = i.path LEFT JOIN l o ON target = o.path""")
def resample_report(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return slides.resample_report(jobs, _listing(jobs), jobs.select("job_id", (~F.col("job_id").endswith("7")).alias("ok")))


_RESUME = """WITH l AS (SELECT user_id AS key, event_type, value AS size FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
 f AS (SELECT user_id AS k, max(value) AS found FROM events WHERE event_id % 3 <> 0 GROUP BY 1),
 d AS (SELECT key FROM l JOIN f ON k = key WHERE found > 0 AND (coalesce(size, 0) = 0 OR size = found) AND event_type IN ('click', 'view', 'purchase')),
 e AS (SELECT c_custkey AS key, CASE WHEN c_custkey IN (SELECT key FROM d) THEN 'skip' ELSE 'do' END AS action FROM customer)"""


def _resumed(spark, sf_dir, dry_run):
    listing = T(spark, sf_dir, "events").filter("event_id % 3 <> 0").groupBy(F.col("user_id").alias("key")).agg(F.max("value").alias("found_size"))
    log = study.ledger(spark, sf_dir).withColumn("status", F.when(F.col("status").isin("click", "view", "purchase"), "DONE").otherwise("FAILED"))
    expected = T(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return ledgers.resume(expected, log, listing, "key", F.col("seq"), dry_run)


@register("resume", _RESUME + " SELECT key FROM e WHERE action = 'do'")
def resume(spark, sf_dir):
    return _resumed(spark, sf_dir, False)


@register("resume_dry_run", _RESUME + " SELECT key, action FROM e")
def resume_dry_run(spark, sf_dir):
    return _resumed(spark, sf_dir, True)


@register("forced_cells", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def forced_cells(spark, sf_dir):
    rows, keys = T(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"]
    return ledgers.incremental(rows.select(*keys).distinct(), rows.filter("l_quantity > 49"), keys, force=True)


@register("exclude_used", f"WITH {_CASES} SELECT candidate_id FROM cands WHERE candidate_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0 AND o_custkey IS NOT NULL)")
def exclude_used(spark, sf_dir):
    used = T(spark, sf_dir, "orders").filter("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("candidate_id"))
    return ledgers.pending(study.candidates(spark, sf_dir).select("candidate_id"), used, ["candidate_id"])


@register("fixed_weighted_means", """WITH g AS (SELECT l_suppkey, l_returnflag, count(*) FILTER (l_linestatus = 'F') AS n_a, count(*) FILTER (l_linestatus <> 'F') AS n_b,
  coalesce(avg(l_quantity) FILTER (l_linestatus = 'F'), 0) AS a, coalesce(avg(l_quantity) FILTER (l_linestatus <> 'F'), 0) AS b FROM lineitem GROUP BY ALL),
 f AS (SELECT n_a AS fa, n_b AS fb FROM g ORDER BY l_suppkey, l_returnflag LIMIT 1) SELECT l_suppkey, l_returnflag, round((a * fa + b * fb) / (fa + fb), 6) AS mean FROM g, f""")
def fixed_weighted_means(spark, sf_dir):
    """Pooled means with the sizes of the first row for all rows, as the study's figures have them."""
    f, q = F.col("l_linestatus") == "F", F.col("l_quantity")
    g = T(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.count_if(f).alias("n_a"), F.count_if(~f).alias("n_b"), F.coalesce(F.avg(F.when(f, q)), F.lit(0.0)).alias("a"), F.coalesce(F.avg(F.when(~f, q)), F.lit(0.0)).alias("b")
    )
    return stores.weighted_mean(g, "a", "b", "n_a", "n_b", fixed_n=["l_suppkey", "l_returnflag"]).select("l_suppkey", "l_returnflag", F.round("weighted_mean", 6).alias("mean"))


def _channel_sql(ch: int) -> str:
    """Means of a channel's 16 cells, scaled to 0..1; channels are cyclic shifts of the red one."""
    at = lambda r, c: f"red[(((k // 4) * 2 + {r}) * 8 + (k % 4) * 2 + {c} + {ch}) % 64 + 1]"
    return f"({at(0, 0)} + {at(0, 1)} + {at(1, 0)} + {at(1, 1)}) / 1020.0::DOUBLE"


@register("embed_tiles", f"""WITH {_TILES}, e AS (SELECT sample_id, CASE WHEN CAST(substr(sample_id, 5) AS BIGINT) % 3 = 0 THEN 'kept' ELSE 'new' END AS origin,
  CASE WHEN CAST(substr(sample_id, 5) AS BIGINT) % 3 = 0 THEN list_transform(range(64), lambda k: 0.5::DOUBLE) ELSE list_concat(flatten(list_transform(range(16), lambda k: [{', '.join(_channel_sql(c) for c in range(3))}])), list_transform(range(16), lambda k: 0.0::DOUBLE)) END AS v FROM tile)
 SELECT sample_id, origin, array_to_string(list_transform(v, lambda x: printf('%.5f', round(x, 9) + 1e-12)), ',') AS vector FROM e""")
def embed_tiles(spark, sf_dir):
    """Vectors of the tiles that a store does not hold yet, put into it beside those it has."""
    tiles, number = study.tiles(spark, sf_dir), F.substring("sample_id", 5, 10).cast("long")
    store = tiles.filter(number % 3 == 0).select("sample_id", F.lit("kept").alias("origin"), F.array_repeat(F.lit(0.5), 64).alias("vector"))
    new = stores.embed(tiles, stores.grid_mean_model, store, 64).withColumn("origin", F.lit("new"))
    whole = ledgers.upsert(store, new, ["sample_id"])
    return whole.select("sample_id", "origin", F.array_join(F.transform("vector", lambda x: F.format_string("%.5f", F.round(x, 9) + 1e-12)), ",").alias("vector"))


def _hand_sql(expression: str) -> str:
    return f"WITH {_TILES} SELECT sample_id, array_to_string(list_transform(range(64), lambda i: CAST({expression} AS INTEGER)), ',') AS red FROM tile"


@register("composite_white", _hand_sql("floor(red[i + 1] * ((i * 4) / 255.0::DOUBLE) + 255 * (1 - (i * 4) / 255.0::DOUBLE) + 0.5)"))
def composite_white(spark, sf_dir):
    """Tiles whose opacity grows pixel by pixel, on white."""
    t = study.tiles(spark, sf_dir).withColumn("alpha", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * 4))
    return t.select("sample_id", F.array_join(F.transform(kernels.composite_white("red", "alpha"), lambda v: v.cast("string")), ",").alias("red"))


def _cubic_list(size: int, into: int) -> str:
    rows = kernels._cubic_weights(size, into, -0.5, True)
    return "[" + ", ".join("[" + ", ".join(f"{w!r}::DOUBLE" for w in r) + "]" for r in np.asarray(rows).tolist()) + "]"


@register("fit_tiles", f"""WITH {_TILES}, w AS (SELECT {_cubic_list(8, 5)} AS w) SELECT sample_id, array_to_string(list_transform(range(25), lambda i: CAST(greatest(0, least(255, floor(round(
 list_sum(list_transform(range(64), lambda k: w[i // 5 + 1][k // 8 + 1] * w[i % 5 + 1][k % 8 + 1] * red[k + 1])), 6) + 0.5))) AS INTEGER)), ',') AS red FROM tile, w""")
def fit_tiles(spark, sf_dir):
    """Tiles of 8 x 8 fitted to 5 x 5 pixels."""
    return stores.mapped_tiles(study.tiles(spark, sf_dir), lambda x: kernels.fit_tile(x, 5))


@register("fine_rotation", f"""WITH {_TILES}, g AS (SELECT sample_id, red, i, (i // 8) - 3.5::DOUBLE AS dr, (i % 8) - 3.5::DOUBLE AS dc, radians(10.0::DOUBLE) AS a FROM tile, range(64) q(i)),
 p AS (SELECT *, dr * cos(a) + dc * sin(a) + 3.5 AS r, dc * cos(a) - dr * sin(a) + 3.5 AS c FROM g),
 v AS (SELECT sample_id, i, CASE WHEN r < 0 OR r > 7 OR c < 0 OR c > 7 THEN 255 ELSE (1 - (r - floor(r))) * ((1 - (c - floor(c))) * red[CAST(floor(r) * 8 + floor(c) + 1 AS INTEGER)] + (c - floor(c)) * red[CAST(floor(r) * 8 + least(floor(c) + 1, 7) + 1 AS INTEGER)])
   + (r - floor(r)) * ((1 - (c - floor(c))) * red[CAST(least(floor(r) + 1, 7) * 8 + floor(c) + 1 AS INTEGER)] + (c - floor(c)) * red[CAST(least(floor(r) + 1, 7) * 8 + least(floor(c) + 1, 7) + 1 AS INTEGER)]) END AS x FROM p)
 SELECT sample_id, string_agg(CAST(CAST(greatest(0, least(255, floor(round(x, 6) + 0.5))) AS INTEGER) AS VARCHAR), ',' ORDER BY i) AS red FROM v GROUP BY 1""")
def fine_rotation(spark, sf_dir):
    return stores.mapped_tiles(study.tiles(spark, sf_dir), lambda x: kernels.fine_rotation(x, 1))


@register("cohort_rows", f"WITH {BASE_SQL}, c AS (SELECT model, cohort FROM base UNION ALL SELECT model, 'POOLED' FROM base) SELECT model, cohort, count(*) AS n FROM c WHERE cohort <> 'POOLED' GROUP BY ALL")
def cohort_rows(spark, sf_dir):
    return cells.cohorts_only(_with_pooled(spark, sf_dir)).groupBy("model", "cohort").agg(F.count("*").alias("n"))


def _with_pooled(spark, sf_dir):
    b = study.baselines(spark, sf_dir).select("model", "cohort")
    return b.unionByName(b.withColumn("cohort", F.lit("POOLED")))


@register("pooled_rows", f"WITH {BASE_SQL} SELECT model, 'POOLED' AS cohort, count(*) AS n FROM base GROUP BY ALL")
def pooled_rows(spark, sf_dir):
    return cells.pooled_only(_with_pooled(spark, sf_dir)).groupBy("model", "cohort").agg(F.count("*").alias("n"))


@register("tile_completeness", METRIC_SQL + """, f AS (SELECT cohort, count(*) FILTER (NOT (perturbation_id = 5 AND sample_id LIKE '%7')) AS found FROM metric WHERE model = 'uni' GROUP BY 1), e AS (SELECT CASE WHEN vec_id % 2 = 0 THEN 'ACC' ELSE 'GDC' END AS cohort, count(*) * 54 AS expected FROM embeddings GROUP BY 1)
 SELECT cohort, expected, found, CASE WHEN found = expected THEN 'ok' WHEN found < expected THEN 'missing' ELSE 'extra' END AS status FROM e JOIN f USING (cohort)""")
def tile_completeness(spark, sf_dir):
    """Perturbed tiles of each cohort against tiles times the grid's 54 cells, with some left out."""
    listing = study.cosine_table(spark, sf_dir).filter("model = 'uni' AND NOT (perturbation_id = 5 AND sample_id LIKE '%7')")
    return stores.completeness(study.tiles(spark, sf_dir), listing, "cohort", study.grid(spark).count())
