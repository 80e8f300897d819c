"""Ledgers as streams: files of new rows are taken up once, and each key's last row is kept as a state.

A run reads the files that came since the run before, and the state: never the ledger's older files. The state is a
table for each batch, written whole before the stream's checkpoint moves on; a batch that is run again after a failure
reads the state before it and writes the same table again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedaudit.operators.ledgers import latest_per_key
from embedaudit.sources.scratch import new_path

_STATE = "state-"


def _versions(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the batches whose state was written to its end, ascending: at most two of a stream are kept."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(out)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
    done = [n for n in names if n.startswith(_STATE) and system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix(_STATE)) for n in done)


def _order():
    return F.struct("ts", "event_id")


def take_up(spark: SparkSession, source: str, pattern: str, schema, out: str, checkpoint: str) -> int:
    """All files of ``source`` that match and that no earlier run with this checkpoint has seen, merged into the state at
    ``out``; the number of rows read from them."""
    new = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)
    rows = new.select(F.col("user_id").alias("key"), F.col("ts"), F.col("event_id"), F.col("event_type").alias("status"))

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = [v for v in _versions(session, out) if v < number]
        last = latest_per_key(batch, "key", _order())
        if before:
            prior = session.read.schema(last.schema).parquet(f"{out}/{_STATE}{before[-1]}")
            last = latest_per_key(prior.unionByName(last), "key", _order())
        last.write.mode("overwrite").parquet(f"{out}/{_STATE}{number}")
        for old in before[:-1]:  # the one before stays until this batch is committed
            path = session._jvm.org.apache.hadoop.fs.Path(f"{out}/{_STATE}{old}")
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)

    query = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def current(spark: SparkSession, out: str) -> DataFrame:
    """The state: a row for each key, its last one."""
    versions = _versions(spark, out)
    if not versions:
        raise ValueError(f"no state at {out}: nothing was taken up yet")
    return spark.read.parquet(f"{out}/{_STATE}{versions[-1]}")


def run_in_drops(spark: SparkSession, sf_dir: str, drops: int = 2) -> DataFrame:
    """The events table dropped into a folder in several lots, each taken up by a run of its own; the state at the end."""
    folder = new_path(spark, "ledger")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in range(drops):
        events.filter(F.pmod(F.xxhash64("event_id"), F.lit(drops)) == k).write.mode("append").parquet(f"{folder}/source")
        take_up(spark, f"{folder}/source", "*.parquet", events.schema, f"{folder}/state", f"{folder}/checkpoint")
    return current(spark, f"{folder}/state")
