"""Request de-duplication, shared-request ownership and re-homing.

All of it is keyed: one shuffle on the request key for each rule, no driver state. A hot key costs no more than its own
rows' partial aggregation, because every rule is an aggregate (``max_by`` and friends combine map-side) and not a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_rank(stop_reason: str = "stop_reason", output: str = "output_tokens", inputs: str = "input_tokens", place: str = "place") -> Column:
    """Orders the lines of one request: finished before unfinished, then more output, more input, the earlier line."""
    return F.struct(F.col(stop_reason).isNotNull(), F.coalesce(output, F.lit(0)), F.coalesce(inputs, F.lit(0)), -F.col(place))


def best_entries(lines: DataFrame, keys: list[str], place: str = "place") -> DataFrame:
    """The best line of each key; ``place`` orders the lines as they were read."""
    rest = [c for c in lines.columns if c not in keys]
    best = F.max_by(F.struct(*rest), best_rank(place=place)).alias("_best")
    return lines.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest))


def last_best_entries(lines: DataFrame, keys: list[str], place: str = "place") -> DataFrame:
    """The verifier's variant: of equal lines the later one stays."""
    rest = [c for c in lines.columns if c not in keys]
    rank = F.struct(F.col("stop_reason").isNotNull(), F.coalesce("output_tokens", F.lit(0)), F.coalesce("input_tokens", F.lit(0)), F.col(place))
    return lines.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_best")).select(*keys, *(F.col(f"_best.{c}").alias(c) for c in rest))


def drop_replayed_lines(lines: DataFrame) -> DataFrame:
    """First line of each (session, uuid): main files before sub-agent files, then by path and line."""
    rest = [c for c in lines.columns if c not in ("session_id", "uuid")]
    first = F.min_by(F.struct(*rest), F.struct("is_subagent", "path", "line")).alias("_first")
    return lines.groupBy("session_id", "uuid").agg(first).select("session_id", "uuid", *(F.col(f"_first.{c}").alias(c) for c in rest))


def membership(requests: DataFrame) -> DataFrame:
    """Which session's files carry which request, sidechains left out, with that carrier's own values."""
    return requests.where(~F.col("is_sidechain"))


def owners(carried: DataFrame) -> DataFrame:
    """``carried`` has session_id and request_id. Per shared request: request_id, owner; of its carriers the session
    with most distinct requests, of equal ones the larger id."""
    pairs = carried.select("session_id", "request_id").distinct()
    sizes = pairs.groupBy("session_id").agg(F.count("*").alias("n_requests"))
    ranked = pairs.join(sizes, "session_id").groupBy("request_id").agg(F.max(F.struct("n_requests", "session_id")).alias("top"), F.count("*").alias("carriers"))
    return ranked.where("carriers > 1").select("request_id", F.col("top.session_id").alias("owner"))


def lineage(carried: DataFrame) -> DataFrame:
    """Per session: n_requests, hidden (it owns none of its requests) and canonical (then the highest ranked owner of
    its requests, else itself)."""
    pairs = carried.select("session_id", "request_id").distinct()
    sizes = pairs.groupBy("session_id").agg(F.count("*").alias("n_requests"))
    owned = pairs.join(owners(carried), "request_id", "left").withColumn("owner", F.coalesce("owner", "session_id"))
    ranks = sizes.select(F.col("session_id").alias("owner"), F.col("n_requests").alias("owner_requests"))
    rolled = owned.join(ranks, "owner").groupBy("session_id").agg(F.bool_or(F.col("owner") == F.col("session_id")).alias("owns"), F.max(F.struct("owner_requests", "owner")).alias("leaf"))
    return rolled.join(sizes, "session_id").select("session_id", "n_requests", (~F.col("owns")).alias("hidden"), F.when(F.col("owns"), F.col("session_id")).otherwise(F.col("leaf.owner")).alias("canonical"))


def rehome(carried: DataFrame, values: list[str]) -> DataFrame:
    """One row per request: shared requests take their owner's session and the owner's values, others keep their own."""
    owned = carried.join(owners(carried), "request_id", "left").where("owner is null or owner = session_id")
    first = F.min_by(F.struct("session_id", *values), F.struct("session_id", *values)).alias("_r")
    return owned.groupBy("request_id").agg(first).select("request_id", "_r.session_id", *(F.col(f"_r.{v}").alias(v) for v in values))


def turn_ordinals(turns: DataFrame) -> DataFrame:
    """Number of each turn in its session from 0, by start (null first), then id."""
    order = Window.partitionBy("session_id").orderBy(F.col("start_time").asc_nulls_first(), "turn_id")
    return turns.withColumn("ordinal", F.row_number().over(order) - 1)


def stale_prices(requests: DataFrame, current: int) -> DataFrame:
    """Sessions with a request priced by another version than the current one."""
    return requests.where(F.col("pricing_version").isNull() | (F.col("pricing_version") != current)).select("session_id").distinct()


def prune_candidates(sessions: DataFrame, *children: DataFrame) -> DataFrame:
    """Sessions that none of the child tables (each with session_id) refers to."""
    for child in children:
        sessions = sessions.join(child.where("session_id is not null").select("session_id").distinct(), "session_id", "left_anti")
    return sessions
