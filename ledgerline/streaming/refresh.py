"""Incremental refresh: new log files stream in, touched sessions are computed anew, samples are de-duplicated by state.

A file that grows in place is not seen by Spark's file stream; ``refresh_changed`` finds those by fingerprint, in batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.sources.logs import changed_files, fingerprint
from ledgerline.sources.sinks import drop_sources, replace_sources


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Lines of new files below ``path``: path, modified and value."""
    raw = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_batch).format("text").load(path)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), "value")


def recompute_touched(stream: DataFrame, key: str, rebuild: Callable[[DataFrame], DataFrame], table: str, checkpoint: str, seconds: float = 0.5, buckets: int = 64) -> StreamingQuery:
    """Late lines can change how a whole session is put together, so each batch hands the keys it touches to ``rebuild``
    and replaces their part of the table. The table is cut by a hash of the key into ``buckets`` parts, not into a folder
    a key: ``rebuild`` gets all keys of the parts that a batch touches. Running a batch again writes the same parts, so a
    restart repeats nothing."""
    part = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("part")

    def batch(df: DataFrame, _: int) -> None:
        keys = df.select(key, part).distinct()
        if table_exists(df.sparkSession, table):
            held = df.sparkSession.read.parquet(table).select(key, "part").join(keys.select("part").distinct(), "part", "left_semi").select(key, "part")
            keys = keys.union(held).distinct()
        replace_sources(rebuild(keys.select(key)).withColumn("part", part), table, "part")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def table_exists(spark: SparkSession, path: str) -> bool:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root)


def refresh_changed(files: DataFrame, manifest: DataFrame, rebuild: Callable[[DataFrame], DataFrame], table: str) -> tuple[DataFrame, DataFrame]:
    """Batch refresh: rebuilds the sources of files whose size or time changed and those that lost files, and removes the
    rows of sources that have no file any more. Gives the new manifest and the paths that are gone. ``files``: path, size,
    modified and source_id; ``manifest``: path, fingerprint and source_id."""
    marked = files.withColumn("fingerprint", fingerprint(F.col("size"), F.col("modified")))
    new, gone = changed_files(marked, manifest)
    present = marked.select("source_id").distinct()
    fewer = gone.select("source_id").distinct().join(present, "source_id", "left_semi")
    replace_sources(rebuild(new.select("source_id").union(fewer).distinct()), table)
    drop_sources(gone.select("source_id").join(present, "source_id", "left_anti"), table)
    return marked.select("path", "fingerprint", "source_id"), gone.select("path")


def _keep_rises(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps a sample unless it repeats the last kept one or falls within the same limit window."""
    used, resets = state.get if state.exists else (None, None)
    for frame in frames:
        keep = []
        for row in frame.sort_values("ts").itertuples(index=False):
            at = row.resets_at.value
            good = resets != at or row.used > used
            keep.append(good)
            if good:
                used, resets = row.used, at
        yield frame.sort_values("ts")[keep][["account", "ts", "used", "resets_at"]]
    state.update((used, resets))


def rising_samples(samples: DataFrame) -> DataFrame:
    """A stream of rate-limit samples (account, ts, used, resets_at) without repeats and falls. State is two numbers per
    account."""
    return samples.groupBy("account").applyInPandasWithState(_keep_rises, "account string, ts timestamp, used double, resets_at timestamp", "used double, resets long", "append", GroupStateTimeout.NoTimeout)


def windowed_spend(requests: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A stream's cost and requests by window and model; windows close once the watermark has passed them."""
    return requests.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "model").agg(F.sum("cost_usd").alias("cost_usd"), F.count("*").alias("requests"))


def active_spells(requests: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """A stream's spells of activity of each session, which a pause of ``gap`` ends."""
    return requests.withWatermark("timestamp", late).groupBy(F.session_window("timestamp", gap), "session_id").agg(F.count("*").alias("requests"))


def _latch(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Holds the day whose total was complete last; another day starts anew."""
    (held,) = state.get if state.exists else (None,)
    for frame in frames:
        frame = frame.sort_values(["day", "at"])
        done = []
        for day, complete in zip(frame["day"].astype(str), frame["complete"], strict=True):
            if held is None or day > held:
                held = day if complete else held
            done.append(bool(complete) or held == day)
        yield frame.assign(complete=done)[["source", "at", "day", "cost_usd", "complete"]]
    state.update((held,))


def latched_totals(snapshots: DataFrame) -> DataFrame:
    """A stream of snapshots (source, at, day, cost_usd, complete): once a day's total was complete it stays so for that day.
    State is one day a source, so none of it has to time out."""
    return snapshots.groupBy("source").applyInPandasWithState(_latch, "source string, at timestamp, day date, cost_usd double, complete boolean", "held string", "append", GroupStateTimeout.NoTimeout)
