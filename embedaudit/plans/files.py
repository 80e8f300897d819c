"""Queries that write what the tables hold in the study's file forms and read it back, each with SQL of what is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedaudit.functions.rounding import half_away
from embedaudit.operators import kernels, stores
from embedaudit.operators.slides import attach_files
from embedaudit.sources import files, study
from embedaudit.sources.scratch import new_path

from .cells import BASE_SQL, METRIC_SQL
from .registry import register
from .tables import _CASES, _TILES

T = study.table


@register("manifest_file", f"WITH {_CASES} SELECT CAST(case_id AS VARCHAR) AS case_id, sex, CAST(age AS DOUBLE) AS age, diagnosis FROM cases")
def manifest_file(spark, sf_dir):
    """Cases as tab-separated text and back; missing sexes and ages are empty there and null again."""
    path = new_path(spark, "manifest")
    files.write_table(study.cases(spark, sf_dir).select(F.col("case_id").cast("string").alias("case_id"), "sex", F.col("age").cast("double").alias("age"), "diagnosis"), path, "tsv")
    return files.read_manifest(spark, path)


@register("metric_file", METRIC_SQL + " SELECT model, sample_id, perturbation_id, severity, cosine_similarity FROM metric WHERE model = 'uni'")
def metric_file(spark, sf_dir):
    path = new_path(spark, "metric")
    columns = ["model", "sample_id", "perturbation_id", "severity", "cosine_similarity"]
    files.write_table(study.cosine_table(spark, sf_dir).filter("model = 'uni'").select(*columns), path, "csv")
    return files.read_metric(spark, path, columns).select(*columns)


@register("results_file", "SELECT l_suppkey, 'C(perturbation_id)[T.' || l_linenumber || ']' AS term, l_linenumber AS level, count(*) AS n FROM lineitem GROUP BY ALL")
def results_file(spark, sf_dir):
    """Fits as JSON, one a line with sorted keys and a map of terms, and its entries as rows."""
    path = new_path(spark, "results")
    counts = T(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    # a map holds a supplier's seven line numbers at most
    fits = counts.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("C(perturbation_id)[T."), F.col("l_linenumber").cast("string"), F.lit("]")), F.col("n")))).alias("effects"))
    files.write_results_json(fits, path)
    from embedaudit.functions.text import parse_term

    rows = files.read_results_json(spark, path, "effects", key="l_suppkey long")
    return rows.select("l_suppkey", "term", parse_term(F.col("term")).alias("level"), F.col("value").cast("long").alias("n"))


@register("candidate_dump", f"WITH {_CASES} SELECT 'f' || candidate_id AS file_id, CAST(candidate_id AS VARCHAR) AS case_id, site, sex, nullif(age, 0) * 1.0::DOUBLE AS age, diagnosis FROM cands")
def candidate_dump(spark, sf_dir):
    """Candidates as dumps of nested hits, a hundred at most to a line, and flat again."""
    path, c = new_path(spark, "hits"), study.candidates(spark, sf_dir)
    hit = F.struct(F.concat(F.lit("f"), F.col("candidate_id").cast("string")).alias("file_id"), F.array(F.struct(
        F.col("candidate_id").cast("string").alias("case_id"), F.col("site").alias("primary_site"), F.struct(F.col("sex").alias("gender")).alias("demographic"),
        F.array(F.struct((F.col("age") * 365).cast("long").alias("age_at_diagnosis"), F.col("diagnosis").alias("primary_diagnosis"))).alias("diagnoses"),
    )).alias("cases"))
    dumps = c.groupBy(F.floor(F.col("candidate_id") / 100).alias("dump")).agg(F.collect_list(hit).alias("hits"))
    dumps.select(F.to_json(F.struct(F.struct("hits").alias("data"))).alias("value")).write.text(path)
    return files.read_candidates(spark, path, lines=True).select("file_id", "case_id", "site", "sex", "age", "diagnosis")


@register("series_dump", "SELECT CAST(s_suppkey AS VARCHAR) AS series_id, CASE s_suppkey % 3 WHEN 0 THEN 'SM' ELSE 'GM' END AS modality FROM supplier WHERE s_suppkey % 3 <> 2")
def series_dump(spark, sf_dir):
    path, key = new_path(spark, "series"), F.col("s_suppkey")
    modality = F.when(key % 3 == 0, "SM").when(key % 3 == 1, "GM").otherwise("CT")
    T(spark, sf_dir, "supplier").select(key.cast("string").alias("SeriesInstanceUID"), modality.alias("Modality")).write.json(path)
    return files.read_series(spark, path).select(F.col("SeriesInstanceUID").alias("series_id"), F.col("Modality").alias("modality"))


@register("embedding_store", f"WITH {BASE_SQL} SELECT model, printf('p%02d__', perturbation_id) || severity || '__' || sample_id AS key, perturbation_id, severity, sample_id, list_transform(w, lambda x: round(x, 6)) AS embedding FROM pert WHERE model = 'conch'")
def embedding_store(spark, sf_dir):
    """Keyed vectors in a folder for each model; one model's are read, which opens its folder alone."""
    from embedaudit.functions.text import make_key

    path = new_path(spark, "vectors")
    keyed = study.perturbed(spark, sf_dir).select("model", make_key(F.col("perturbation_id"), F.col("severity"), F.col("sample_id")).alias("key"), F.col("vector").alias("embedding"))
    keyed.write.partitionBy("model").parquet(path)
    return files.read_embeddings(spark, path).filter("model = 'conch'").select("model", "key", "perturbation_id", "severity", "sample_id", F.transform("embedding", lambda x: half_away(x, 6)).alias("embedding"))


@register("corpus_folders", f"WITH {_TILES} SELECT list_extract({['colour_staining'] * 5 + ['imaging_artefacts'] * 5 + ['geometric'] * 3 + ['resolution_quality'] * 3 + ['lighting'] * 2}, p) AS category, printf('p%02d_', p) || list_extract({[v[0] for v in kernels.REGISTRY.values()]}, p) AS perturbation, 'mild' AS severity, count(*) AS n, CAST(sum(192) AS BIGINT) AS bytes FROM tile, range(11, 18) g(p) WHERE p IN (11, 17) GROUP BY p")
def corpus_folders(spark, sf_dir):
    """Perturbed tiles written in folders by category, perturbation and severity, and what each folder then holds."""
    path = new_path(spark, "corpus")
    grid = study.grid(spark).filter("perturbation_id IN (11, 17) AND severity = 'mild'")
    files.write_corpus(stores.with_registry(kernels.perturb(study.tiles(spark, sf_dir), grid).withColumn("model", F.lit(None).cast("string"))).drop("model", "family", "status", "notes"), path)
    return spark.read.parquet(path).groupBy("category", "perturbation", "severity").agg(F.count("*").alias("n"), F.sum(F.octet_length("data")).alias("bytes"))


@register("tile_listing", """SELECT DISTINCT c_mktsegment AS category, CAST(c_nationkey AS INTEGER) AS perturbation_id, 'Name' AS name, 'mild' AS severity, 't' || c_nationkey AS sample_id, 1::BIGINT AS length FROM customer
UNION ALL SELECT DISTINCT NULL, NULL, NULL, NULL, 't' || c_nationkey, 1::BIGINT FROM customer""")  # fmt: skip
def tile_listing(spark, sf_dir):
    """One small image file for each segment and nation, and a baseline for each nation, listed at any depth and taken
    apart by its path."""
    path = new_path(spark, "tiles")
    c = T(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey").distinct()
    parts = c.select(F.concat(F.lit("/"), "c_mktsegment", F.format_string("/p%02d_Name/mild/t%d.png", F.col("c_nationkey"), F.col("c_nationkey"))).alias("place"))
    base = c.select(F.format_string("/baseline/t%d.png", F.col("c_nationkey")).alias("place")).distinct()
    files.write_each(parts.unionByName(base), "place", path)
    return files.list_tiles(spark, path).drop("path")


@register("listed_files", "SELECT n_nationkey, n_nationkey % 4 <> 0 AS found, CASE WHEN n_nationkey % 4 <> 0 THEN 1::BIGINT END AS found_size FROM nation")
def listed_files(spark, sf_dir):
    """Expected files against a listing of what is there."""
    root = new_path(spark, "files")
    n = T(spark, sf_dir, "nation").select("n_nationkey", F.format_string("/n/%d.svs", F.col("n_nationkey")).alias("place"))
    files.write_each(n.filter("n_nationkey % 4 <> 0"), "place", root)
    listing = files.list_files(spark, root, "*.svs").withColumn("path", F.regexp_extract("path", r"(/n/\d+\.svs)$", 1))
    return attach_files(n, "place", listing).select("n_nationkey", "found", "found_size")


@register("appended_ledger", "SELECT user_id AS key, event_id, event_type AS status FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def appended_ledger(spark, sf_dir):
    """A log appended to in three runs, and its current state."""
    from embedaudit.operators.ledgers import latest_per_key

    path, log = new_path(spark, "log"), T(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", F.col("event_type").alias("status"))
    for k in range(3):
        files.append_ledger(log.filter(F.col("event_id") % 3 == k), path)
    return latest_per_key(files.read_ledger(spark, path), "key", F.col("event_id"))


@register("sidecar_ledger", "SELECT 'k' || r_regionkey AS key, r_name AS status, CAST(r_regionkey * 10 AS BIGINT) AS size FROM region")
def sidecar_ledger(spark, sf_dir):
    """A JSON map of entries, one for each region, as rows."""
    path = new_path(spark, "sidecar") + ".json"
    r = T(spark, sf_dir, "region")  # five rows
    entries = r.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("k"), F.col("r_regionkey").cast("string")), F.struct(F.col("r_name").alias("status"), (F.col("r_regionkey") * 10).alias("size"))))).alias("m"))
    entries.select(F.to_json("m").alias("value")).coalesce(1).write.text(path)
    return files.read_ledger(spark, path, "status string, size long")


@register("cumulative_summary", "SELECT l_suppkey, l_returnflag, CAST(CASE WHEN l_returnflag = 'R' THEN sum(l_quantity) ELSE count(*) END AS DOUBLE) AS value FROM lineitem GROUP BY l_suppkey, l_returnflag")
def cumulative_summary(spark, sf_dir):
    """A summary of counts, taken over by sums where a later run has them, written whole."""
    path, keys = new_path(spark, "summary"), ["l_suppkey", "l_returnflag"]
    g = T(spark, sf_dir, "lineitem").groupBy(*keys)
    prior, new = g.agg(F.count("*").cast("double").alias("value")), g.agg(F.sum("l_quantity").cast("double").alias("value")).filter("l_returnflag = 'R'")
    files.write_cumulative(prior, new, keys, path)
    return spark.read.parquet(path)


@register("tile_images", f"WITH {_TILES} SELECT sample_id, CAST(8 AS INTEGER) AS height, CAST(8 AS INTEGER) AS width, CAST(1 AS INTEGER) AS channels, array_to_string(red, ',') AS red FROM tile")
def tile_images(spark, sf_dir):
    """Tiles as gray bitmaps, packed many to a file, decoded again."""
    path = new_path(spark, "images")
    t = study.tiles(spark, sf_dir)
    files.write_gray_images(t, "sample_id", "red", 8, path)
    back = files.read_packed(spark, path)
    values = F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: F.conv(F.hex(F.substring(F.col("data"), i, F.lit(1))), 16, 10))
    return back.select(F.regexp_extract("origin", r"([^/]+)\.\w+$", 1).alias("sample_id"), "height", "width", "channels", F.array_join(values, ",").alias("red"))
