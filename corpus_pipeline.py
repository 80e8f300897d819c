"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows of ``docs``. All stages but the last return the
columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedaudit.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from embedaudit.llm.queries import QUALITY, tokenizer_path, with_quality
from embedaudit.llm.storage import documents, written

_ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, written with it: a number means the same row in each later read, however
    the reads are split."""
    return written(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic; it learns from all labelled ones. Empty texts stay."""
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    return toxicity.with_toxicity(docs, model).filter("predicted = 0").select(*docs.columns)


def exact_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that of the least id."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the first."""
    rows = _numbered(docs)
    gone = near_dedup.near_duplicate_classes(rows, _ROW).filter("NOT kept").select(_ROW)
    return rows.join(gone, _ROW, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it. Only ids, sources and sizes are sorted; texts are joined once."""
    rows = _numbered(docs)
    sized = written(rows.select(_ROW, "doc_id", "source", mixing.words(F.col("text")).alias("words")), "sizes")
    taken = mixing.mixed(with_quality(sized, sf_dir), size=F.col("words"), quality=F.expr(QUALITY)).select(_ROW, "repeats")
    return mixing.repeated(rows.join(taken.filter("repeats > 0"), _ROW), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row per piece of a document, with its sequence and place there."""
    return packing.packed_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out), ("exact_dedup", exact_out), ("near_dedup", near_out), ("mixing", mix), ("packing", pack),
]
#: SQL cannot express the first stage's model; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written to the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
