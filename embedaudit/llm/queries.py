"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover_tree, exact_dedup, kmeans_tree, media, merkle, mixing, near_dedup, packing, pii, ppm, quality, repeats, toxicity
from .storage import documents, written

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _register(name: str, oracle: str | None = None):
    def add(query):
        _QUERIES[name] = query
        if oracle:
            _ORACLES[name] = oracle
        return query

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_register("op2_exact_dedup", f"""
WITH t AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)""")  # fmt: skip
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir), keep="max")


# quality weights for the mix: labelled good documents come earlier, labelled bad ones later
QUALITY = "1.0 + coalesce(q, 0.5)"


@_register("op8_mixing_targets", r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix'), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)
      / (1.0::DOUBLE + coalesce(q, 0.5::DOUBLE)) AS k
  FROM documents LEFT JOIN (SELECT doc_id AS i, avg(quality)::DOUBLE AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id) ON doc_id = i),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE cap / w >= level),
t AS (SELECT source, source_size, CASE WHEN cap / w >= f.level THEN w * f.level ELSE cap END AS target FROM l, f),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CAST(whole + CASE WHEN size > 0 AND before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END AS INTEGER) AS repeats FROM p)
SELECT doc_id, size, source_size, target, repeats, CAST(repeats * size AS BIGINT) AS taken FROM r""")  # fmt: skip
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    # sizes first: no text goes through a join or a window
    sized = written(documents(spark, sf_dir).select("doc_id", "source", mixing.words(F.col("text")).alias("words")), "sizes")
    mix = mixing.mixed(with_quality(sized, sf_dir), size=F.col("words"), quality=F.expr(QUALITY))
    return mix.select("doc_id", "size", "source_size", "target", "repeats", "taken")


def with_quality(docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the mean of their quality labels as ``q``, null where there is none."""
    labels = documents(docs.sparkSession, sf_dir, "labels").filter("doc_id IS NOT NULL")
    marks = labels.groupBy(F.col("doc_id").alias("__labelled")).agg(F.avg("quality").alias("q"))
    return docs.join(marks, docs["doc_id"] == marks["__labelled"], "left").drop("__labelled")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_register("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), tokenizer_path())


@_register("op9_media_columns")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media.feature_text(media.media_columns(media.store_texts(documents(spark, sf_dir))))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


@_register("op4_pii_surrogates")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.with_surrogates(documents(spark, sf_dir).select("doc_id", "text"), key=pii.session_key(spark))
    return out.select("doc_id", "text", F.size("pii").cast("long").alias("n_entities"), pii.entity_counts().alias("entities"), "pii")


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo; null of a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@_register("op7_toxicity_mil")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, remainder(5) != 0)
    scores = toxicity.with_toxicity(docs.select("doc_id", "text"), model)
    return scores.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


@_register("op10_quality_bytenet")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), documents(spark, sf_dir, "labels")
    net = quality.train(docs, labels, remainder(5) != 0)
    scores = quality.with_quality(docs.select("doc_id", "text"), net)
    return scores.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@_register("op6_suffix_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_spans(documents(spark, sf_dir))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@_register("op3_ppm_scoring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(documents(spark, sf_dir))


@_register("op5_minhash_icws")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(documents(spark, sf_dir))


# SQL would compare all queries with all rows; a test holds recall against brute force
@_register("op11_kmeans_tree")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.neighbours(documents(spark, sf_dir, "embeddings"), "id % 100 = 0", k=10)


def _merkle_levels(name: str, leaves: str, levels: int) -> str:
    """CTEs ``{name}0 .. {name}{levels}``: nodes by level with the digests left and right of each in its run; level k+1
    has the parents of level k, or its node itself where the group has one node."""
    out = []
    for k in range(levels + 1):
        nodes = leaves if k == 0 else f"""
  SELECT grp, idx // 16 AS idx, any_value((total + 15) // 16) AS total,
    CASE WHEN any_value(total) > 1 THEN sha256(string_agg(digest, '' ORDER BY idx)) ELSE any_value(digest) END AS digest
  FROM {name}{k - 1}
  GROUP BY grp, idx // 16"""
        out.append(f"""{name}{k} AS (
  SELECT grp, idx, total, digest,
    coalesce(string_agg(digest, '') OVER (PARTITION BY grp, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(digest, '') OVER (PARTITION BY grp, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM ({nodes}))""")
    return ",\n".join(out)


def _merkle_sql(levels: int = 6, source_levels: int = 3) -> str:
    """The manifest level by level: 16 ** levels rows of a source and 16 ** source_levels sources at most."""
    fields = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars")]
    text, low = "coalesce(strlen(text) || ':' || text, '-')", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    head, body = " || ".join(fields), f"coalesce(strlen({low}) || ':' || {low}, '-')"
    crc = """list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
      lambda a, b: list_reduce([xor(a, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda u, v: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END))"""
    parts = [
        f"""d AS (
  SELECT doc_id, source, sha256({head} || {text}) AS leaf,
    CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN sha256({head} || {body}) ELSE sha256({head} || {text}) END AS seen
  FROM documents)""",
        """o AS (
  SELECT *, coalesce('~' || source, '') AS grp, count(*) OVER (PARTITION BY source) AS total,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM d)""",
        _merkle_levels("a", "SELECT grp, idx, total, leaf AS digest FROM o", levels),
        f"""s AS (
  SELECT grp AS name, digest AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS total FROM a{levels})""",
        _merkle_levels("b", "SELECT '' AS grp, idx, total, subroot AS digest FROM s", source_levels),
        "f0 AS (SELECT doc_id, leaf, grp, idx, seen AS value, '' AS proof FROM o)",
    ]
    for k in range(levels):
        parts.append(f"""f{k + 1} AS (
  SELECT doc_id, leaf, f.grp, f.idx // 16 AS idx, CASE WHEN total > 1 THEN sha256(l || value || r) ELSE value END AS value, proof || l || r AS proof
  FROM f{k} f JOIN a{k} n ON f.grp = n.grp AND f.idx = n.idx)""")
    parts.append(f"g0 AS (SELECT doc_id, leaf, s.subroot, s.idx, value, proof FROM f{levels} f JOIN s ON f.grp = s.name)")
    for k in range(source_levels):
        parts.append(f"""g{k + 1} AS (
  SELECT doc_id, leaf, subroot, g.idx // 16 AS idx, CASE WHEN total > 1 THEN sha256(l || value || r) ELSE value END AS value, proof || l || r AS proof
  FROM g{k} g JOIN b{k} n ON g.idx = n.idx)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, value AS folded_root, value = digest AS verified
FROM g{source_levels}, b{source_levels}"""


@_register("op12_merkle_manifest", _merkle_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return merkle.manifest(docs, changed=F.when(remainder(5) == 0, merkle.lowered(F.col("text"))))


_COMPONENTS = "list_transform(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), lambda x: floor(256 * x))"


@_register("op13_cover_tree", f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_COMPONENTS} AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5""")  # fmt: skip
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    index = cover_tree.indexed(documents(spark, sf_dir, "embeddings"), label=label, component=lambda x: F.floor(256 * x))
    return cover_tree.hard_negatives(index, cover_tree.anchors(index, "id % 100 = 0"))
