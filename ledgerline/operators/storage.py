"""Storage: sizes of log files, what is safe to delete, and the index against what is on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and endings of files that are never deleted.
BLOCKED_NAMES = ["config.toml", "config.json", "auth.json", ".env", "credentials.json", ".credentials.json"]
BLOCKED_ENDINGS = [".sqlite", ".sqlite3", ".db", ".sqlite-wal", ".sqlite-shm", ".sqlite3-wal", ".sqlite3-shm", ".db-wal", ".db-shm", ".lock"]
ACTIVE_MINUTES = 10
BULK_COUNT, BULK_BYTES = 20, 1_000_000_000


def hard_blocked(path: Column) -> Column:
    name = F.lower(F.regexp_extract(path, "([^/]+)/*$", 1))
    ends = F.lit(False)
    for e in BLOCKED_ENDINGS:
        ends = ends | F.endswith(name, F.lit(e))
    return ends | name.isin(BLOCKED_NAMES)


def classified(files: DataFrame, area: str, home: str, now, indexing: bool = False) -> DataFrame:
    """Adds class (danger, caution, safe or unclassified) and protection (blocked, locked or deletable). ``files``: path,
    indexed and modified; ``area`` and ``home`` are the folders of sessions and of the provider."""
    inside = F.startswith("path", F.lit(area.rstrip("/") + "/"))
    at_home = F.startswith("path", F.lit(home.rstrip("/") + "/"))
    fresh = F.coalesce(F.col("modified") > F.lit(now) - F.expr(f"INTERVAL {ACTIVE_MINUTES} MINUTES"), F.lit(False))
    blocked = hard_blocked(F.col("path")) | F.lit(indexing)
    kind = F.when(blocked, "danger").when(~inside, F.when(at_home, "danger").otherwise("unclassified")).when(fresh | ~F.col("indexed"), "caution").otherwise("safe")
    guard = F.when(blocked, "blocked").when(~inside, F.when(at_home, "blocked").otherwise("locked")).otherwise("deletable")
    return files.withColumns({"class": kind, "protection": guard})


def friction(rows: DataFrame, key: str) -> DataFrame:
    """How hard it should be to delete each selection: high, medium or low."""
    sums = rows.groupBy(key).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.bool_or(~F.col("indexed")).alias("untracked"), F.bool_or(F.col("class") == "caution").alias("careful"), F.bool_and(F.col("protection") == "deletable").alias("deletable"))
    level = F.when(F.col("untracked") | (F.col("files") >= BULK_COUNT) | (F.col("bytes") >= BULK_BYTES), "high").when((F.col("files") > 1) | F.col("careful"), "medium").otherwise("low")
    return sums.withColumn("friction", level)


def folder_sizes(files: DataFrame) -> DataFrame:
    """Bytes and files of each folder, all levels below it counted."""
    parts = F.split(F.regexp_replace("path", "/[^/]*$", ""), "/")
    each = files.select("size", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"), parts.alias("p")).select("size", F.array_join(F.slice("p", 1, F.col("k")), "/").alias("folder"))
    return each.groupBy("folder").agg(F.sum("size").alias("bytes"), F.count("*").alias("files"))


def reconciled(indexed: DataFrame, disk: DataFrame) -> DataFrame:
    """Each path as a session (in both), a remnant (in the index only) or an orphan (on disk only)."""
    a, b = indexed.withColumn("_i", F.lit(True)), disk.withColumn("_d", F.lit(True))
    both = a.join(b, "path", "full_outer")
    state = F.when(F.col("_i") & F.col("_d"), "session").when(F.col("_i"), "remnant").otherwise("orphan")
    return both.withColumn("state", state).drop("_i", "_d")


def matching_rows(rows: DataFrame, query: str) -> DataFrame:
    """Rows whose title, project or branch holds the query; all rows for an empty one."""
    q = query.strip().lower()
    if not q:
        return rows
    found = F.lit(False)
    for c in ("title", "project", "branch"):
        found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))
    return rows.where(found)
