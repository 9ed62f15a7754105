"""The tables behind every report, built from the log files of one source of provider A.

Each table is a DataFrame; ``write`` stores them by source, ``load`` reads them. Nothing passes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.functions.pricing import price, split_cache_writes
from ledgerline.operators import conversation as C
from ledgerline.operators import dedup as D
from ledgerline.operators import search as Q
from ledgerline.plans.scratch import cut
from ledgerline.sources import logs as L
from ledgerline.sources.sinks import replace_sources


@dataclass
class Tables:
    requests: DataFrame  # priced: id, session_id, timestamp, model, speed, tokens, cost_usd
    sessions: DataFrame  # session_id, project, title, visible, started, ended
    steps: DataFrame  # session_id, turn_id, uuid, kind, request_id, text
    turns: DataFrame  # session_id, turn_id, start_time, n_steps, is_sidechain, prompt
    skills: DataFrame  # session_id, turn_id, skill
    lines: DataFrame  # every billable line with its own tokens, for verification
    diagnostics: DataFrame  # rejected lines: path, line, rejection
    postings: DataFrame  # index of prompts, sorted by token: token, doc, n, at
    lengths: DataFrame  # tokens of each indexed prompt: doc, length


def prompts(steps: DataFrame) -> DataFrame:
    """What is searched: doc (session and line), session_id and text."""
    return Q.searchable(steps).select(F.concat_ws(":", "session_id", "uuid").alias("doc"), "session_id", "text")


def _billable_lines(entries: DataFrame) -> DataFrame:
    """Assistant lines with usage, in the order they were read."""
    hour, five = split_cache_writes(F.col("cache_flat"), F.col("cache_1h_sub"), F.col("cache_5m_sub"))
    used = entries.where("type = 'assistant' and has_usage and outcome = 'entry'")
    return used.select(
        F.coalesce("request_id", "uuid").alias("request_id"), "session_id", "uuid", "place", F.col("ts").cast("timestamp_ntz").alias("timestamp"), "model", "speed", "stop_reason", "is_sidechain",
        "input_tokens", "output_tokens", F.lit(0).cast("long").alias("reasoning_tokens"), hour.alias("cache_1h"), five.alias("cache_5m"), "cache_read",
    )


def _owned(best: DataFrame) -> DataFrame:
    """One row per request: requests that several sessions carry go to their owner, with the owner's values. Sidechains
    are no carriers, so a request that is on sidechains only keeps its session."""
    carriers = D.membership(best).select("session_id", "request_id")
    both = best.join(D.owners(carriers), "request_id", "left").where("owner is null or owner = session_id")
    rest = [c for c in best.columns if c != "request_id"]
    first = F.min_by(F.struct(*rest), F.struct("is_sidechain", "session_id", "place")).alias("r")
    return both.groupBy("request_id").agg(first).select(F.col("request_id").alias("id"), *(F.col(f"r.{c}").alias(c) for c in rest))


def build(spark: SparkSession, path: str) -> Tables:
    """Reads the JSONL files below ``path`` (projects / sessions). The decoded lines are written out once, since all
    tables come from them."""
    lines = L.file_roles(L.read_lines(spark, path)).where("role <> 'other'")
    order = F.struct(F.col("role") != "main", "path", "line")
    decoded = L.decode_entries(lines).withColumn("is_subagent", F.col("role") != "main")
    # lines of sub-agents' files come after those of main files; within a session time decides before places do
    decoded = cut(decoded.withColumn("place", F.col("line") + F.when(F.col("is_subagent"), F.lit(1 << 40)).otherwise(0)))
    good = decoded.where("outcome = 'entry'")
    kept = D.drop_replayed_lines(good).select(*good.columns)
    billable = cut(_billable_lines(kept))
    best = D.best_entries(billable, ["session_id", "request_id"])
    requests = price(_owned(best).select("id", "session_id", "timestamp", "model", "speed", "stop_reason", "is_sidechain", "input_tokens", "output_tokens", "reasoning_tokens", "cache_1h", "cache_5m", "cache_read"))

    entries = kept.where("not image_meta").drop("path", "size", "modified", "offset", "outcome", "rejection", "role", "run", "agent", "project", "session", "is_subagent", "line")
    merged = cut(C.merge_messages(entries))
    steps = cut(C.turn_ids(merged, C.parent_links(decoded)))
    turns = C.turns(steps)
    named = X.skill_name(F.col("text"))
    skills = steps.where((F.col("kind") == "prompt") & named.isNotNull()).select("session_id", "turn_id", named.alias("skill")).distinct()

    projects = decoded.where("session_id is not null").groupBy("session_id").agg(F.min_by("project", order).alias("project"))
    lineage = D.lineage(D.membership(best).select("session_id", "request_id")).select("session_id", (~F.col("hidden")).alias("visible"))
    shells = C.titles(C.session_shells(kept)).join(projects, "session_id").join(lineage, "session_id", "left")
    sessions = shells.select("session_id", "project", F.col("shown_title").alias("title"), F.coalesce("visible", F.lit(True)).alias("visible"), "started", "ended", "branch")
    shown = steps.select("session_id", "turn_id", "uuid", "kind", "request_id", "text", "ts", "place")
    postings, lengths = Q.build_index(prompts(shown))
    ordered = postings.repartitionByRange("token").sortWithinPartitions("token", "doc")
    return Tables(requests, sessions, shown, turns, skills, billable, decoded.where("rejection is not null").select("path", "line", "rejection"), ordered, lengths)


def write(tables: Tables, path: str, source: str) -> None:
    for f in fields(tables):
        replace_sources(getattr(tables, f.name).withColumn("source_id", F.lit(source)), f"{path}/{f.name}")


def load(spark: SparkSession, path: str, source: str | None = None) -> Tables:
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return Tables(*(read(f.name) if source is None else read(f.name).where(F.col("source_id") == source) for f in fields(Tables)))
