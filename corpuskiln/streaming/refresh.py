"""Structured Streaming: orphan references kept up to date, and windowed counts of arriving chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuskiln import storage
from corpuskiln.operators import orphans

#: Versions of the state that are kept: the newest and the one that a repeated batch reads.
KEPT = 3


def chunk_deltas(chunks: DataFrame) -> DataFrame:
    """The reference and existence deltas of new chunk rows (see operators.orphans); rows with sign -1 take theirs back."""
    sign = (F.col("sign") if "sign" in chunks.columns else F.lit(1)).cast("long").alias("sign")
    rows = chunks.select("*", sign) if "sign" not in chunks.columns else chunks
    refs = rows.select(F.explode("cross_refs").alias("ref"), F.col("ingested_at").alias("at"), "sign").where("ref is not null")
    existing = rows.select(F.col("section_id").alias("key"), F.col("ingested_at").alias("at"), "sign")
    return orphans.deltas(refs, existing, rows.select(F.col("section_id").alias("key")).where("false"))


def edge_deltas(edges: DataFrame) -> DataFrame:
    """The reference deltas of new edge rows."""
    refs = edges.select(F.col("dst").alias("ref"), F.col("seen_at").alias("at"), *(["sign"] if "sign" in edges.columns else []))
    none = edges.select(F.col("dst").alias("key"), F.col("seen_at").alias("at")).where("false")
    return orphans.deltas(refs, none, none.select("key"))


def retired_deltas(retired: DataFrame) -> DataFrame:
    """The deltas of new retirements."""
    none = retired.select(F.col("section_id").alias("key"), F.lit(None).cast("timestamp_ntz").alias("at")).where("false")
    return orphans.deltas(none.withColumnRenamed("key", "ref"), none, retired.select(F.col("section_id").alias("key")))


def _versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n) for n in storage.names(spark, folder) if n.isdigit() and storage.exists(spark, f"{folder}/{n}/_SUCCESS"))


def keep_orphans(spark: SparkSession, arriving: DataFrame, state_folder: str, checkpoint: str, deltas=chunk_deltas) -> StreamingQuery:
    """Merge each batch of rows (chunks; or edges, retirements by their `deltas`) into a table of signed counts; versions are whole folders named by batch.

    A batch that is run again after a failure reads the version before it and
    writes its own anew, so counts are never added twice. Each stream keeps a
    folder of its own, all in storage that the executors share;
    `current_orphans` merges them.
    """

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = _versions(session, state_folder)
        before = max((v for v in known if v < number), default=None)
        parts = [deltas(batch)]
        if before is not None:
            parts.append(session.read.parquet(f"{state_folder}/{before}"))
        orphans.merged(*parts).write.mode("overwrite").parquet(f"{state_folder}/{number}")
        for old in known[: -KEPT]:
            if old < number:
                storage.remove(session, f"{state_folder}/{old}")

    return arriving.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_orphans(spark: SparkSession, *state_folders: str) -> DataFrame:
    """Orphan keys of the newest versions of one or more streams' states together."""
    newest = [spark.read.parquet(f"{folder}/{_versions(spark, folder)[-1]}") for folder in state_folders]
    return orphans.orphan_keys(orphans.merged(*newest))


def arrivals(chunks: DataFrame, time_col: str = "ingested_at", late: str = "35 days", window: str = "7 days") -> DataFrame:
    """window_start, source, n_chunks of a batch or stream, rows later than `late` behind the newest left out of a stream."""
    rows = chunks.withColumn("_at", F.col(time_col).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", window).alias("w"), "source").agg(F.count("*").alias("n_chunks")).select(F.col("w.start").alias("window_start"), "source", "n_chunks")
