"""The study's objects as views of the given tables: vectors, metric tables, tiles, cases, ledgers and slides.

Only integer and rational arithmetic is used, so that two engines agree on every value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedaudit.functions.text import site_of_prefix

from embedaudit.functions.vectors import cosine

MODELS = ("uni", "conch", "quilt_llava", "gigapath_tile")
PRIMARY, OUTLIER = ("uni", "conch", "quilt_llava"), "gigapath_tile"
SEVERITIES = ("mild", "moderate", "severe")
PERTURBATIONS, WIDTH, EDGE = 18, 16, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` before the work of 54 grid cells is done for each: a table of few files keeps all cores
    busy, and joins by these keys find the rows where they are."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _cohort(vec_id: Column) -> Column:
    return F.when(vec_id % 2 == 0, "ACC").otherwise("GDC")


def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``model, sample_id, cohort, vector``: each vector's four slices, one for each model."""
    emb = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    slices = F.array(*[F.struct(F.lit(name).alias("model"), F.slice("embedding", WIDTH * m + 1, WIDTH).cast("array<double>").alias("vector")) for m, name in enumerate(MODELS)])
    sample = F.concat(_cohort(F.col("vec_id")), F.lit("_"), F.lpad(F.col("vec_id").cast("string"), 6, "0"))
    return emb.select(sample.alias("sample_id"), _cohort(F.col("vec_id")).alias("cohort"), F.explode(slices).alias("s")).select("s.model", "sample_id", "cohort", "s.vector")


def grid(spark: SparkSession) -> DataFrame:
    """Perturbation ids and severities: 54 rows."""
    ids = spark.range(1, PERTURBATIONS + 1).select(F.col("id").cast("int").alias("perturbation_id"))
    return ids.select("perturbation_id", F.explode(F.array(*[F.struct(F.lit(k + 1).alias("step"), F.lit(s).alias("severity")) for k, s in enumerate(SEVERITIES)])).alias("x")).select("perturbation_id", "x.step", "x.severity")


def perturbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines stretched and moved by fixed patterns of each grid cell; moderate 3, 17 and 18 leave them as they are."""
    same = (F.col("step") == 2) & F.col("perturbation_id").isin(3, 17, 18)
    moved = F.transform("vector", lambda x, j: x * (F.lit(1.0) + F.lit(0.1) * F.col("step") * ((5 * F.col("perturbation_id") + 3 * (j + 1)) % 7 - 3) / F.lit(3.0)) + F.lit(0.02) * F.col("step") * ((7 * F.col("perturbation_id") + 13 * (j + 1)) % 11 - 5) / F.lit(5.0))
    # the grid has 54 rows whatever the input
    cells = _dealt(baselines(spark, sf_dir), "model", "sample_id").crossJoin(F.broadcast(grid(spark)))
    return cells.select("model", "sample_id", "cohort", "perturbation_id", "severity", F.when(same, F.col("vector")).otherwise(moved).alias("vector"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every perturbed vector with its ``baseline``, joined by model and tile: only baselines are shuffled, once."""
    base = _dealt(baselines(spark, sf_dir), "model", "sample_id").select("model", "sample_id", F.col("vector").alias("baseline"))
    return perturbed(spark, sf_dir).join(base, ["model", "sample_id"])


def cosine_table(spark: SparkSession, sf_dir: str, decimals: int = 6) -> DataFrame:
    """Similarity of every perturbed vector to its baseline."""
    return pairs(spark, sf_dir).select("model", "sample_id", "cohort", "perturbation_id", "severity", F.round(cosine("baseline", "vector"), decimals).alias("cosine_similarity"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, cohort, red, green, blue``: 8 x 8 pixels, three cyclic shifts of the same values."""
    emb = _dealt(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    gray = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.round(F.lit(127.5) + F.lit(255.0) * v.cast("double")).cast("int"))))
    sample = F.concat(_cohort(F.col("vec_id")), F.lit("_"), F.lpad(F.col("vec_id").cast("string"), 6, "0"))
    one = emb.select("vec_id", sample.alias("sample_id"), _cohort(F.col("vec_id")).alias("cohort"), gray.alias("red"))
    shift = lambda k: F.concat(F.slice("red", k + 1, EDGE * EDGE - k), F.slice("red", 1, k))
    return one.withColumn("green", shift(1)).withColumn("blue", shift(2))


def _site(c: DataFrame) -> DataFrame:
    known = F.col("c_custkey") % 17 != 0
    age = F.floor(F.abs("c_acctbal") / 100).cast("int")
    return c.select(
        F.col("c_custkey"), F.col("c_mktsegment").alias("site"), F.when(known, F.when(F.col("c_nationkey") % 2 == 0, "male").otherwise("female")).alias("sex"),
        F.when(known, age).alias("age"), F.when(F.col("c_custkey") % 3 == 0, "malignant").otherwise("benign").alias("diagnosis"),
    )


# what a study's cases and candidates have beside: prefixes with several, one or no site, and few candidates of a site
_PREFIXES = ("BP", "BN", "CP", "CN", "RP", "RN", "TP", "TN", "XX")
_SITES = ("Breast", "Cervix Uteri", "Colon", "Head and Neck", "Oral Cavity", "Oropharynx", "Lung")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, site, sex, age, diagnosis`` and ``code, sites``: every fifth customer."""
    c = _site(table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0")).withColumnRenamed("c_custkey", "case_id")
    prefix = F.get(F.array(*map(F.lit, _PREFIXES)), (F.floor(F.col("case_id") / 5) % len(_PREFIXES)).cast("int"))
    code = F.concat(prefix, F.lit("-"), F.col("case_id").cast("string"))
    return c.withColumn("code", code).withColumn("sites", site_of_prefix(F.col("code")))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``candidate_id, site, sex, age, diagnosis``: the other customers."""
    return _site(table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0")).withColumnRenamed("c_custkey", "candidate_id")


def slide_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``candidate_id, site, sex, age_days, race, diagnosis``: a candidate has one primary site, an age in days, and a
    race where it is known; a site whose candidates of a sex are all excluded, and one that has few left."""
    c = table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 0")
    key, known = F.col("c_custkey"), F.col("c_custkey") % 17 != 0
    sex = F.when(known, F.when(F.col("c_nationkey") % 2 == 0, "male").otherwise("female"))
    site = F.get(F.array(*map(F.lit, _SITES)), (key % len(_SITES)).cast("int"))
    gone = (key % 4 == 0) | ((site == "Cervix Uteri") & (sex == "female")) | ((site == "Colon") & (key % 91 != 2))
    race = F.when(gone, " Black or African American").when(key % 4 == 1, "white").when(key % 4 == 2, "not reported")
    days = F.when(known, F.floor(F.abs("c_acctbal") * 3).cast("int"))
    diagnosis = F.when(key % 3 == 0, "malignant").otherwise("benign")
    return c.select(key.alias("candidate_id"), site.alias("site"), sex.alias("sex"), days.alias("age_days"), race.alias("race"), diagnosis.alias("diagnosis"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key, seq, status, size``: an append-only log, later rows overriding earlier ones of a key."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), F.col("event_id"), F.col("event_type").alias("status"), F.col("value").alias("size"))


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slide_id, tissue, mpp, levels, width, height``; a seventh has no resolution."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    return p.select(
        F.col("p_partkey").alias("slide_id"), F.col("p_brand").alias("tissue"), F.when(F.col("p_partkey") % 7 != 0, F.lit(0.1) + size / F.lit(100.0)).alias("mpp"),
        F.array(F.lit(1.0), F.lit(4.0), F.lit(16.0)).alias("levels"), (F.lit(800) + size * 40).cast("int").alias("width"), (F.lit(600) + size * 25).cast("int").alias("height"),
    )
