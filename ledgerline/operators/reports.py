"""Spend reports: filters, aggregates, top-k and pages over priced requests and sessions.

Every function takes DataFrames and returns one. Bounds that are None add no predicate, so what is there reaches the
Parquet scan. Dollars are sums of doubles; callers round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.periods import BUCKET_KEYS
from ledgerline.functions.pricing import SYNTHETIC, TOKENS, billable


def token_sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOKENS]


def cost_sum(name: str = "cost_usd") -> Column:
    return F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias(name)


def in_range(df: DataFrame, start=None, end=None, column: str = "timestamp") -> DataFrame:
    """Both ends inclusive; None leaves a side open."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start))
    return df if end is None else df.where(F.col(column) <= F.lit(end))


def billed(priced: DataFrame) -> DataFrame:
    return priced.where(billable(F.col("model")))


def with_sessions(priced: DataFrame, sessions: DataFrame, visible: bool = False) -> DataFrame:
    """Requests with their session's columns; of visible sessions only where ``visible``."""
    shown = sessions.where("visible") if visible else sessions
    return priced.join(shown.select("session_id", "project", "title", "started", "ended"), "session_id")


def total_cost(priced: DataFrame) -> DataFrame:
    return priced.agg(cost_sum())


def usage_totals(priced: DataFrame) -> DataFrame:
    """Requests, token sums, context_tokens (all kinds of tokens, reasoning included) and cost."""
    sums = billed(priced).agg(F.count("*").alias("requests"), *token_sums(), cost_sum())
    return sums.withColumn("context_tokens", sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0])))


def project_aggregates(priced: DataFrame, sessions: DataFrame) -> DataFrame:
    both = with_sessions(billed(priced), sessions)
    return both.groupBy(F.coalesce("project", F.lit("Unknown")).alias("project")).agg(F.countDistinct("session_id").alias("sessions"), cost_sum())


def project_model_costs(priced: DataFrame, sessions: DataFrame) -> DataFrame:
    return with_sessions(billed(priced), sessions).groupBy(F.coalesce("project", F.lit("Unknown")).alias("project"), "model").agg(cost_sum())


def model_usage(priced: DataFrame) -> DataFrame:
    return billed(priced).groupBy("model").agg(F.count("*").alias("requests"), F.count_if(F.col("speed") == "fast").alias("fast_requests"), cost_sum())


def usage_buckets(priced: DataFrame, unit: str) -> DataFrame:
    """Cost, requests and tokens by day, hour, week or month; this token count leaves reasoning out."""
    tokens = sum((F.col(c) for c in TOKENS if c != "reasoning_tokens"), F.lit(0).cast("long"))
    return billed(priced).groupBy(BUCKET_KEYS[unit](F.col("timestamp")).alias("bucket")).agg(cost_sum(), F.count("*").alias("requests"), F.sum(tokens).alias("tokens"))


def activity(priced: DataFrame, turns: DataFrame) -> DataFrame:
    """Requests, sessions with a request, and all turns, sidechain ones too. Two aggregates of one row each."""
    counts = billed(priced).agg(F.count("*").alias("requests"), F.countDistinct("session_id").alias("sessions"))
    return counts.withColumn("turns", turns.agg(F.count("start_time")).scalar())


def starts(df: DataFrame, column: str, unit: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(BUCKET_KEYS[unit](F.col(column)).alias("bucket")).agg(F.count("*").alias("starts"))


def skill_requests(skills: DataFrame, steps: DataFrame, priced: DataFrame) -> DataFrame:
    """skills (session, turn, skill) with the requests of their turns. Steps are made distinct by request first, as
    many steps share one request and would count it again."""
    bridge = steps.where("request_id is not null").select("session_id", "turn_id", "request_id").distinct()
    paid = priced.select(F.col("id").alias("request_id"), "model", "cost_usd")
    return skills.join(bridge, ["session_id", "turn_id"], "left").join(paid, "request_id", "left")


def skill_aggregates(skills: DataFrame, steps: DataFrame, priced: DataFrame) -> DataFrame:
    return skill_requests(skills, steps, priced).groupBy("skill").agg(F.countDistinct(F.struct("session_id", "turn_id")).alias("runs"), cost_sum())


def skill_model_costs(skills: DataFrame, steps: DataFrame, priced: DataFrame) -> DataFrame:
    return skill_requests(skills, steps, priced).where(billable(F.col("model"))).groupBy("skill", "model").agg(cost_sum())


def primary_models(costs: DataFrame, key: str) -> DataFrame:
    """The model with the highest cost of each key; of equal ones the first by name."""
    best = F.min(F.struct((-F.col("cost_usd")).alias("c"), "model")).alias("m")
    return costs.groupBy(key).agg(best).select(key, F.col("m.model").alias("primary_model"))


def top_sessions(priced: DataFrame, sessions: DataFrame, n: int) -> DataFrame:
    sums = with_sessions(billed(priced), sessions, visible=True).groupBy("session_id", "title", "project").agg(F.count("*").alias("requests"), cost_sum())
    return sums.orderBy(F.desc("cost_usd"), "session_id").limit(n)


def visible_sessions(priced: DataFrame, sessions: DataFrame) -> DataFrame:
    return with_sessions(billed(priced), sessions, visible=True).agg(F.countDistinct("session_id").alias("sessions"))


def cost_by_model(priced: DataFrame) -> DataFrame:
    """Keeps synthetic models."""
    return priced.where("model is not null").groupBy("model").agg(F.count("*").alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), cost_sum())


def session_usage(priced: DataFrame) -> DataFrame:
    return billed(priced).groupBy("session_id").agg(F.count("*").alias("requests"), *token_sums(), cost_sum())


def session_list(priced: DataFrame, links: DataFrame) -> DataFrame:
    """Per session, from requests or links: cost, models in order of name, tallies of billable and of unpriced requests."""
    tally = priced.groupBy("session_id").agg(
        cost_sum(), F.array_join(F.array_sort(F.collect_set(F.when(F.col("model") != SYNTHETIC, F.col("model")))), ",").alias("models"),
        F.count_if(billable(F.col("model"))).alias("billable"), F.count_if(billable(F.col("model")) & F.col("cost_usd").isNull()).alias("unavailable"),
    )
    agents = links.groupBy("session_id").agg(F.count("*").alias("agents"))
    out = tally.join(agents, "session_id", "full_outer")
    return out.na.fill({"cost_usd": 0.0, "models": "", "billable": 0, "unavailable": 0, "agents": 0})


def filter_options(sessions: DataFrame, priced: DataFrame) -> DataFrame:
    """Distinct projects by name, and models by how many sessions use them, then name: (kind, value, sessions, place)."""
    projects = sessions.where("project is not null").groupBy(F.col("project").alias("value")).agg(F.count("*").alias("sessions")).withColumn("kind", F.lit("project"))
    models = billed(priced).groupBy(F.col("model").alias("value")).agg(F.countDistinct("session_id").alias("sessions")).withColumn("kind", F.lit("model"))
    rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.when(F.col("kind") == "model", -F.col("sessions")), "value"))
    return projects.unionByName(models).withColumn("place", rank).select("kind", "value", "sessions", "place")


def filter_sessions(sessions: DataFrame, priced: DataFrame, project: str | None = None, start=None, end=None, models: list[str] | None = None, text: str | None = None, hits: DataFrame | None = None) -> DataFrame:
    """All given fields must hold; ``text`` holds in the project's label, the title, or as one of the sessions in
    ``hits`` (session_id, from a search). Newest start first."""
    out = in_range(sessions, start, end, "started")
    if project is not None:
        out = out.where(F.col("project") == project)
    if models:
        out = out.join(priced.where(F.col("model").isin(models)).select("session_id").distinct(), "session_id", "left_semi")
    if text:
        label = F.element_at(F.split("project", "/"), -1)
        found = F.contains(F.lower(label), F.lit(text.lower())) | F.contains(F.lower("title"), F.lit(text.lower()))
        if hits is None:
            out = out.where(found)
        else:
            marked = out.join(hits.select("session_id").distinct().withColumn("_hit", F.lit(True)), "session_id", "left")
            out = marked.where(F.coalesce(found, F.lit(False)) | F.coalesce("_hit", F.lit(False))).drop("_hit")
    return out.orderBy(F.desc("started"), "session_id")


def page_by_end(sessions: DataFrame, n: int, before: tuple | None = None) -> DataFrame:
    """The next n + 1 sessions by (end, id) descending after the one at ``before``; the last is the probe for more."""
    out = sessions.where("visible")
    if before:
        t, i = before
        out = out.where((F.col("ended") < F.lit(t)) | ((F.col("ended") == F.lit(t)) & (F.col("session_id") < i)))
    return out.orderBy(F.desc_nulls_last("ended"), F.desc("session_id")).limit(n + 1)


def page_by_ordinal(rows: DataFrame, after: int, n: int) -> DataFrame:
    return rows.where(F.col("ordinal") > after).orderBy("ordinal").limit(n)


def sorted_limited(rows: DataFrame, by: str, n: int | None, key: str) -> DataFrame:
    """A breakdown by cost_usd, count or name."""
    out = rows.orderBy(F.asc(key)) if by == "name" else rows.orderBy(F.desc(by), F.asc(key))
    return out if n is None else out.limit(n)


def latest_periods(buckets: DataFrame, n: int) -> DataFrame:
    """A limit under date order keeps the latest periods, shown in ascending order."""
    return buckets.orderBy(F.desc("bucket")).limit(n).orderBy("bucket")


def group_by_project(sessions: DataFrame) -> DataFrame:
    """Sessions with group_place and place: groups by latest end, the unknown one last; inside a group latest end first."""
    known = F.coalesce("project", F.lit("Unknown"))
    latest = F.max("ended").over(Window.partitionBy("project"))
    own = F.row_number().over(Window.partitionBy("project").orderBy(F.desc_nulls_last("ended"), "session_id"))
    placed = sessions.select("session_id", known.alias("project_name"), "ended", latest.alias("latest"), own.alias("place"), F.col("project").isNull().cast("int").alias("unknown"))
    groups = placed.groupBy("project_name").agg(F.min("unknown").alias("u"), F.max("latest").alias("l")).withColumn("group_place", F.row_number().over(Window.orderBy("u", F.desc("l"), "project_name")))
    return placed.join(groups.select("project_name", "group_place"), "project_name").select("session_id", "project_name", "group_place", "place")


def low_signal(sessions: DataFrame, kept: list[int]) -> DataFrame:
    """hidden: cost is known, not above 0, the session is inactive and not pinned."""
    return sessions.withColumn("hidden", F.col("cost_usd").isNotNull() & (F.col("cost_usd") <= 0) & ~F.col("active") & ~F.col("session_id").isin(kept))


def active(sessions: DataFrame, now, minutes: int = 10) -> DataFrame:
    return sessions.withColumn("active", F.col("ended") > F.lit(now) - F.expr(f"INTERVAL {minutes} MINUTES"))


def coverage(sources: DataFrame) -> DataFrame:
    """Source files by parse state."""
    return sources.groupBy("parse_state").agg(F.count("*").alias("sources"))


def pending(sources: DataFrame, since) -> DataFrame:
    return sources.where(F.col("parse_state").isin("pending", "metadata", "incomplete") & (F.col("modified") >= F.lit(since))).agg(F.count("*").alias("pending"))


def diagnostics_summary(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("category", "severity").agg(F.count("*").alias("n"), F.min("seen").alias("first_seen"))


def recent_turns(turns: DataFrame, sessions: DataFrame, n: int) -> DataFrame:
    """The latest n turns off sidechains of visible sessions."""
    own = turns.where(~F.col("is_sidechain") & F.col("start_time").isNotNull())
    both = own.join(sessions.where("visible").select("session_id", "title"), "session_id")
    return both.orderBy(F.desc("start_time"), "session_id", "turn_id").limit(n)


def primary_sources(files: DataFrame) -> DataFrame:
    """Each session's main file: the newest that is no sub-agent's, of equal ones the first by path."""
    return files.where(~F.col("is_subagent")).groupBy("session_id").agg(F.min_by("path", F.struct(-F.unix_micros(F.col("modified").cast("timestamp")), "path")).alias("path"))


def page_window(total: int, shown: int, step: int = 50) -> tuple[int, int]:
    """How many rows of ``total`` are shown after ``shown`` were asked for, and how many one more page adds."""
    visible = min(total, max(shown, step))
    return visible, min(step, total - visible)
