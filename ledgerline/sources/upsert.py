"""Requests that are loaded source by source: a table cut by a hash of the id, of which a load rewrites what it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.plans.scratch import cut
from ledgerline.sources.sinks import replace_sources
from ledgerline.streaming.refresh import table_exists

BUCKETS = 64


def merged(rows: DataFrame, rank: list[str], owner: str = "source_id") -> DataFrame:
    """One row an id: the values of its first row by ``rank`` and, as the row must not go while any file carries it, the owner
    of its last load. Any order of loads gives the same values, those of one load of all."""
    values = [c for c in rows.columns if c not in ("id", owner, "load")]
    first = F.min_by(F.struct(*values), F.struct(*rank)).alias("v")
    return rows.groupBy("id").agg(first, F.max_by(F.struct(owner), F.struct("load", owner)).alias("o"), F.max("load").alias("load")).select("id", *(F.col(f"v.{c}").alias(c) for c in values), f"o.{owner}", "load")


def upsert(new: DataFrame, table: str, rank: list[str], load: int, owner: str = "source_id", buckets: int = BUCKETS) -> None:
    """Merges ``new`` (id, owner and values, among them those of ``rank``) into ``table``. Only buckets that ``new`` falls
    into are read and written, so a small load costs little on a large table; the same load again changes nothing."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")
    both = new.withColumn("load", F.lit(load)).select("*", bucket)
    if table_exists(new.sparkSession, table):
        held = new.sparkSession.read.parquet(table)
        touched = [r[0] for r in both.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        both = both.unionByName(held.where(F.col("bucket").isin(touched)))
    out = cut(merged(both.drop("bucket"), rank, owner))  # what is read is written over
    replace_sources(out.select("*", bucket), table, "bucket")


def drop_owner(table: str, spark, gone: list[str], carriers: DataFrame, owner: str = "source_id") -> None:
    """Rows of owners that are gone: those that a live file still carries (``carriers``: id, owner) go over to it, others go."""
    held = spark.read.parquet(table)
    touched = [r[0] for r in held.where(F.col(owner).isin(gone)).select("bucket").distinct().collect()]
    alive = carriers.where(~F.col(owner).isin(gone)).groupBy("id").agg(F.max(owner).alias("_alive"))
    rows = held.where(F.col("bucket").isin(touched)).join(alive, "id", "left")
    lost = F.col(owner).isin(gone)
    kept = cut(rows.where(~lost | F.col("_alive").isNotNull()).withColumn(owner, F.when(lost, F.col("_alive")).otherwise(F.col(owner))).drop("_alive").select(held.columns))
    replace_sources(kept, table, "bucket")
