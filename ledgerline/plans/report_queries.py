"""Queries of spend reports over the driver's tables, with an own formulation in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import periods
from ledgerline.functions.pricing import TOKENS, cache_efficiency, confidence, confidence_of_many
from ledgerline.operators import reports as R
from ledgerline.operators import timeline as T
from ledgerline.plans.adapters import PRICED_SQL, SESSIONS_SQL, STEPS_SQL, priced, read, sessions
from ledgerline.plans.adapters import requests as adapted_requests
from ledgerline.plans.catalog import query

_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in TOKENS)
_COST = "round(coalesce(sum(cost_usd), 0) + 2.5e-10, 4) AS cost_usd"
_BILLED = "billed AS (SELECT * FROM priced WHERE model IS NOT NULL AND model <> '<synthetic>')"
_WITH = f"WITH {PRICED_SQL}, {_BILLED}"
_BOTH = f"{_WITH}, {SESSIONS_SQL}, joined2 AS (SELECT b.*, s.project, s.title, s.visible FROM billed b JOIN sessions s USING (session_id))"
_FROM, _TO = "2024-01-05 00:00:00", "2024-01-20 23:59:59.999"


#: Costs are multiples of 5e-10 dollars, so this keeps the last bits of a sum from deciding how a tie is rounded.
NUDGE = 2.5e-10


def rounded(df, *columns, digits=4):
    return df.withColumns({c: F.round(F.col(c) + NUDGE, digits) for c in columns})


@query("flagship_model_usage", f"{_WITH} SELECT model, count(*) AS requests, CAST(count(*) FILTER (WHERE speed = 'fast') AS BIGINT) AS fast_requests, {_COST} FROM billed GROUP BY model")
def model_usage(spark, sf):
    return rounded(R.model_usage(priced(spark, sf)), "cost_usd")


@query("priced_requests", f"{_WITH} SELECT id, priced_as, round(input_cost + 2.5e-10, 6) AS input_cost, round(output_cost + 2.5e-10, 6) AS output_cost, round(cache_1h_cost + 2.5e-10, 6) AS cache_1h_cost, round(cache_5m_cost + 2.5e-10, 6) AS cache_5m_cost, round(cache_read_cost + 2.5e-10, 6) AS cache_read_cost, round(cost_usd + 2.5e-10, 6) AS cost_usd FROM priced")
def priced_requests(spark, sf):
    legs = ["input_cost", "output_cost", "cache_1h_cost", "cache_5m_cost", "cache_read_cost", "cost_usd"]
    return rounded(priced(spark, sf).select("id", "priced_as", *legs), *legs, digits=6)


@query("request_confidence", f"{_WITH} SELECT CASE WHEN model IS NULL THEN 'unavailable' WHEN model = '<synthetic>' THEN 'notBillable' WHEN cost_usd IS NULL THEN 'unavailable' ELSE 'exact' END AS confidence, count(*) AS n FROM priced GROUP BY 1")
def request_confidence(spark, sf):
    return priced(spark, sf).groupBy(confidence().alias("confidence")).agg(F.count("*").alias("n"))


@query("session_confidence", f"""{_WITH}, t AS (SELECT session_id, count(*) FILTER (WHERE model <> '<synthetic>') AS b, count(*) FILTER (WHERE model <> '<synthetic>' AND cost_usd IS NULL) AS u FROM priced GROUP BY session_id)
SELECT session_id, CASE WHEN b <= 0 THEN 'notBillable' WHEN u = 0 THEN 'exact' WHEN u >= b THEN 'unavailable' ELSE 'partial' END AS confidence FROM t""")
def session_confidence(spark, sf):
    p = priced(spark, sf)
    tally = R.session_list(p, p.select("session_id").where("false"))
    return tally.select("session_id", confidence_of_many(F.col("billable"), F.col("unavailable")).alias("confidence"))


@query("cache_efficiency", f"{_WITH} SELECT id, round(CASE WHEN prompt = 0 THEN NULL ELSE CAST(cache_read AS DOUBLE) / prompt END, 6) AS efficiency FROM priced")
def efficiency(spark, sf):
    return adapted_requests(spark, sf).select("id", F.round(cache_efficiency(), 6).alias("efficiency"))


@query("total_cost", f"WITH {PRICED_SQL} SELECT {_COST} FROM priced")
def total_cost(spark, sf):
    return rounded(R.total_cost(priced(spark, sf)), "cost_usd")


@query("total_cost_in_range", f"WITH {PRICED_SQL} SELECT {_COST} FROM priced WHERE timestamp >= TIMESTAMP '{_FROM}' AND timestamp <= TIMESTAMP '{_TO}'")
def total_cost_in_range(spark, sf):
    """The bounds reach the scan of events: pricing is session-wide, so the range is applied to the priced rows."""
    start, end = periods.resolve(None, since="2024-01-05", until="2024-01-20")
    return rounded(R.total_cost(R.in_range(priced(spark, sf), start, end)), "cost_usd")


@query("usage_totals", f"{_WITH} SELECT count(*) AS requests, {_SUMS}, {_COST}, CAST(coalesce(sum({' + '.join(TOKENS)}), 0) AS BIGINT) AS context_tokens FROM billed")
def usage_totals(spark, sf):
    return rounded(R.usage_totals(priced(spark, sf)), "cost_usd")


@query("project_aggregates", f"{_BOTH} SELECT coalesce(project, 'Unknown') AS project, count(DISTINCT session_id) AS sessions, {_COST} FROM joined2 GROUP BY 1")
def project_aggregates(spark, sf):
    return rounded(R.project_aggregates(priced(spark, sf), sessions(spark, sf)), "cost_usd")


@query("project_model_costs", f"{_BOTH} SELECT coalesce(project, 'Unknown') AS project, model, {_COST} FROM joined2 GROUP BY 1, 2")
def project_model_costs(spark, sf):
    return rounded(R.project_model_costs(priced(spark, sf), sessions(spark, sf)), "cost_usd")


@query("project_primary_models", f"""{_BOTH}, c AS (SELECT coalesce(project, 'Unknown') AS project, model, coalesce(sum(cost_usd), 0) AS cost_usd FROM joined2 GROUP BY 1, 2)
SELECT project, model AS primary_model FROM c QUALIFY row_number() OVER (PARTITION BY project ORDER BY cost_usd DESC, model) = 1""")
def project_primary_models(spark, sf):
    return R.primary_models(R.project_model_costs(priced(spark, sf), sessions(spark, sf)), "project")


def _buckets(unit, sql_key):
    @query(f"usage_by_{unit}", f"{_WITH} SELECT {sql_key} AS bucket, {_COST}, count(*) AS requests, CAST(sum(input_tokens + output_tokens + cache_1h + cache_5m + cache_read) AS BIGINT) AS tokens FROM billed GROUP BY 1")
    def run(spark, sf):
        return rounded(R.usage_buckets(priced(spark, sf), unit), "cost_usd")


_buckets("hour", "strftime(timestamp, '%Y-%m-%d %H')")
_buckets("day", "strftime(timestamp, '%Y-%m-%d')")
_buckets("week", "strftime(date_trunc('week', timestamp), '%Y-%m-%d')")
_buckets("month", "strftime(timestamp, '%Y-%m')")


@query("activity_counts", f"{_WITH}, {STEPS_SQL} SELECT count(*) AS requests, count(DISTINCT session_id) AS sessions, (SELECT count(DISTINCT session_id) FROM billed) AS turns FROM billed")
def activity_counts(spark, sf):
    """Turns of the adapter: a session's first billable request starts its one turn."""
    p = priced(spark, sf)
    started = R.billed(p).groupBy("session_id").agg(F.min("timestamp").alias("start_time"))
    return R.activity(p, started)


@query("session_starts_by_day", f"WITH {SESSIONS_SQL} SELECT strftime(started, '%Y-%m-%d') AS bucket, count(*) AS starts FROM sessions GROUP BY 1")
def session_starts(spark, sf):
    return R.starts(sessions(spark, sf), "started", "day")


@query("top_sessions", f"{_BOTH} SELECT session_id, title, project, count(*) AS requests, {_COST} FROM joined2 WHERE visible GROUP BY 1, 2, 3 ORDER BY coalesce(sum(cost_usd), 0) DESC, session_id LIMIT 20")
def top_sessions(spark, sf):
    return rounded(R.top_sessions(priced(spark, sf), sessions(spark, sf), 20), "cost_usd")


@query("visible_sessions", f"{_BOTH} SELECT count(DISTINCT session_id) AS sessions FROM joined2 WHERE visible")
def visible_sessions(spark, sf):
    return R.visible_sessions(priced(spark, sf), sessions(spark, sf))


@query("cost_by_model", f"WITH {PRICED_SQL} SELECT model, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, {_COST} FROM priced WHERE model IS NOT NULL GROUP BY model")
def cost_by_model(spark, sf):
    return rounded(R.cost_by_model(priced(spark, sf)), "cost_usd")


@query("session_usage", f"{_WITH} SELECT session_id, count(*) AS requests, {_SUMS}, {_COST} FROM billed GROUP BY session_id")
def session_usage(spark, sf):
    return rounded(R.session_usage(priced(spark, sf)), "cost_usd")


@query("session_list", f"""WITH {PRICED_SQL}, {STEPS_SQL},
a AS (SELECT session_id, {_COST}, coalesce(string_agg(DISTINCT CASE WHEN model <> '<synthetic>' THEN model END, ',' ORDER BY CASE WHEN model <> '<synthetic>' THEN model END), '') AS models,
 count(*) FILTER (WHERE model <> '<synthetic>') AS billable, count(*) FILTER (WHERE model <> '<synthetic>' AND cost_usd IS NULL) AS unavailable FROM priced GROUP BY session_id),
b AS (SELECT session_id, count(*) AS agents FROM steps WHERE kind = 'reply' GROUP BY session_id)
SELECT session_id, coalesce(cost_usd, 0.0) AS cost_usd, coalesce(models, '') AS models, coalesce(billable, 0) AS billable, coalesce(unavailable, 0) AS unavailable, coalesce(agents, 0) AS agents FROM a FULL JOIN b USING (session_id)""")
def session_list(spark, sf):
    """Replies stand for sub-agent links, which are counted apart from requests."""
    from ledgerline.plans.adapters import steps

    return rounded(R.session_list(priced(spark, sf), steps(spark, sf).where("kind = 'reply'")), "cost_usd")


@query("filter_options", f"""{_WITH}, {SESSIONS_SQL}, o AS (SELECT 'project' AS kind, project AS value, count(*) AS sessions FROM sessions WHERE project IS NOT NULL GROUP BY project
UNION ALL SELECT 'model', model, count(DISTINCT session_id) FROM billed GROUP BY model)
SELECT kind, value, sessions, CAST(row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN kind = 'model' THEN -sessions END NULLS FIRST, value) AS INTEGER) AS place FROM o""")
def filter_options(spark, sf):
    return R.filter_options(sessions(spark, sf), priced(spark, sf))


@query("filtered_sessions", f"""WITH {PRICED_SQL}, {SESSIONS_SQL} SELECT session_id, project, title, visible, started, ended FROM sessions WHERE project = '/work/p3' AND started >= TIMESTAMP '2024-01-01 00:00:00'
AND session_id IN (SELECT session_id FROM priced WHERE model IN ('gpt-5.5')) AND (contains('p3', 'p3') OR contains(lower(title), 'p3'))""")
def filtered_sessions(spark, sf):
    from datetime import datetime

    return R.filter_sessions(sessions(spark, sf), priced(spark, sf), project="/work/p3", start=datetime(2024, 1, 1), models=["gpt-5.5"], text="P3")


@query("session_page", f"WITH {SESSIONS_SQL} SELECT session_id, project, title, visible, started, ended FROM sessions WHERE visible AND (ended < TIMESTAMP '2024-01-30 12:00:00' OR (ended = TIMESTAMP '2024-01-30 12:00:00' AND session_id < 50)) ORDER BY ended DESC NULLS LAST, session_id DESC LIMIT 26")
def session_page(spark, sf):
    from datetime import datetime

    return R.page_by_end(sessions(spark, sf), 25, (datetime(2024, 1, 30, 12), 50))


@query("step_page", f"WITH {STEPS_SQL} SELECT session_id, uuid, ordinal FROM steps WHERE ordinal > 2 ORDER BY ordinal, session_id LIMIT 30")
def step_page(spark, sf):
    from ledgerline.plans.adapters import steps

    rows = steps(spark, sf).select("session_id", "uuid", "ordinal").where("ordinal > 2")
    return rows.orderBy("ordinal", "session_id").limit(30)


@query("top_models_by_count", f"{_WITH} SELECT model, count(*) AS requests, {_COST} FROM billed GROUP BY model ORDER BY count(*) DESC, model LIMIT 2")
def top_models(spark, sf):
    return rounded(R.sorted_limited(R.model_usage(priced(spark, sf)).drop("fast_requests"), "requests", 2, "model"), "cost_usd")


@query("top_days", f"{_WITH} SELECT strftime(timestamp, '%Y-%m-%d') AS bucket, {_COST} FROM billed GROUP BY 1 ORDER BY round(sum(cost_usd) + 2.5e-10, 4) DESC, bucket LIMIT 5")
def top_days(spark, sf):
    days = rounded(R.usage_buckets(priced(spark, sf), "day").select("bucket", "cost_usd"), "cost_usd")
    return R.sorted_limited(days, "cost_usd", 5, "bucket")


@query("latest_weeks", f"{_WITH} SELECT strftime(date_trunc('week', timestamp), '%Y-%m-%d') AS bucket, {_COST}, count(*) AS requests FROM billed GROUP BY 1 ORDER BY bucket DESC LIMIT 3")
def latest_weeks(spark, sf):
    return rounded(R.latest_periods(R.usage_buckets(priced(spark, sf), "week").drop("tokens"), 3), "cost_usd")


@query("sessions_by_project", f"""WITH {SESSIONS_SQL}, a AS (SELECT session_id, project IS NULL AS u, coalesce(project, 'Unknown') AS project_name, ended, max(ended) OVER (PARTITION BY project) AS latest, row_number() OVER (PARTITION BY project ORDER BY ended DESC NULLS LAST, session_id) AS place FROM sessions)
SELECT session_id, project_name, CAST(dense_rank() OVER (ORDER BY u, latest DESC, project_name) AS INTEGER) AS group_place, CAST(place AS INTEGER) AS place FROM a""")
def sessions_by_project(spark, sf):
    return R.group_by_project(sessions(spark, sf))


@query("low_signal_sessions", f"""WITH {PRICED_SQL}, {SESSIONS_SQL}, c AS (SELECT session_id, sum(cost_usd) AS cost_usd FROM priced GROUP BY session_id)
SELECT session_id, ended > TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 10 MINUTE AS active, cost_usd IS NOT NULL AND cost_usd <= 0 AND NOT (ended > TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 10 MINUTE) AND session_id NOT IN (7, 8) AS hidden FROM sessions LEFT JOIN c USING (session_id)""")
def low_signal(spark, sf):
    from datetime import datetime

    costs = priced(spark, sf).groupBy("session_id").agg(F.sum("cost_usd").alias("cost_usd"))
    marked = R.active(sessions(spark, sf).join(costs, "session_id", "left"), datetime(2024, 1, 30, 23))
    return R.low_signal(marked, [7, 8]).select("session_id", "active", F.coalesce("hidden", F.lit(False)).alias("hidden"))


_SOURCES_SQL = "sources AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'imported' ELSE 'incomplete' END AS parse_state, o_orderdate AS modified FROM orders)"


def _sources(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr("CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'imported' ELSE 'incomplete' END").alias("parse_state"), F.col("o_orderdate").alias("modified"))


@query("source_coverage", f"WITH {_SOURCES_SQL} SELECT parse_state, count(*) AS sources FROM sources GROUP BY 1")
def source_coverage(spark, sf):
    return R.coverage(_sources(spark, sf))


@query("pending_sources", f"WITH {_SOURCES_SQL} SELECT count(*) AS pending FROM sources WHERE parse_state IN ('pending', 'metadata', 'incomplete') AND modified >= TIMESTAMP '1997-01-01 00:00:00'")
def pending_sources(spark, sf):
    from datetime import datetime

    return R.pending(_sources(spark, sf), datetime(1997, 1, 1))


@query("diagnostics_summary", "SELECT event_type AS category, CASE WHEN value < 10 THEN 'info' WHEN value < 50 THEN 'warning' ELSE 'error' END AS severity, count(*) AS n, min(ts) AS first_seen FROM events GROUP BY 1, 2")
def diagnostics_summary(spark, sf):
    rows = read(spark, sf, "events").select(F.col("event_type").alias("category"), F.expr("CASE WHEN value < 10 THEN 'info' WHEN value < 50 THEN 'warning' ELSE 'error' END").alias("severity"), F.col("ts").alias("seen"))
    return R.diagnostics_summary(rows)


@query("recent_diagnostics", "SELECT event_id, event_type AS category, ts AS seen FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_diagnostics(spark, sf):
    return read(spark, sf, "events").select("event_id", F.col("event_type").alias("category"), F.col("ts").alias("seen")).orderBy(F.desc("seen"), F.desc("event_id")).limit(50)


def _skill_tables(spark, sf):
    """A turn per session and day; every fifth session runs a skill in it."""
    p = priced(spark, sf)
    turn = F.date_format("timestamp", "yyyy-MM-dd")
    steps = p.select("session_id", turn.alias("turn_id"), F.col("id").alias("request_id")).unionAll(p.select("session_id", turn.alias("turn_id"), F.col("id").alias("request_id")))
    skills = steps.select("session_id", "turn_id").distinct().select("session_id", "turn_id", F.concat(F.lit("skill-"), (F.col("session_id") % 5).cast("string")).alias("skill"))
    return skills, steps, p


_SKILL_SQL = f"""{_WITH}, sk AS (SELECT DISTINCT session_id, strftime(timestamp, '%Y-%m-%d') AS turn_id, concat('skill-', CAST(session_id % 5 AS VARCHAR)) AS skill FROM priced),
sp AS (SELECT sk.*, p.model, p.cost_usd FROM sk LEFT JOIN priced p ON p.session_id = sk.session_id AND strftime(p.timestamp, '%Y-%m-%d') = sk.turn_id)"""


@query("skill_aggregates", f"{_SKILL_SQL} SELECT skill, count(DISTINCT (session_id, turn_id)) AS runs, {_COST} FROM sp GROUP BY skill")
def skill_aggregates(spark, sf):
    return rounded(R.skill_aggregates(*_skill_tables(spark, sf)), "cost_usd")


@query("skill_model_costs", f"{_SKILL_SQL} SELECT skill, model, {_COST} FROM sp WHERE model IS NOT NULL AND model <> '<synthetic>' GROUP BY skill, model")
def skill_model_costs(spark, sf):
    return rounded(R.skill_model_costs(*_skill_tables(spark, sf)), "cost_usd")


_TURNS_SQL = "turn_t AS (SELECT session_id, min(timestamp) AS start_time FROM billed GROUP BY session_id, strftime(timestamp, '%Y-%m-%d'))"


def _turns(p):
    return R.billed(p).groupBy("session_id", F.date_format("timestamp", "yyyy-MM-dd").alias("d")).agg(F.min("timestamp").alias("start_time"))


def _timeline_sql(unit: str, key: str = "") -> str:
    every = f"every AS (SELECT unnest(generate_series((SELECT min(b) FROM act), (SELECT max(b) FROM act), INTERVAL 1 {unit})) AS bucket)"
    filled = f"""{_WITH}, {SESSIONS_SQL}, {_TURNS_SQL},
act AS (SELECT date_trunc('{unit}', timestamp) AS b, coalesce(cost_usd, 0) AS c, 0 AS s, 0 AS t, 1 AS r, input_tokens + output_tokens + cache_1h + cache_5m + cache_read AS k FROM billed
 UNION ALL SELECT date_trunc('{unit}', started), 0, 1, 0, 0, 0 FROM sessions UNION ALL SELECT date_trunc('{unit}', start_time), 0, 0, 1, 0, 0 FROM turn_t),
{every}, filled AS (SELECT strftime(bucket, '%Y-%m-%d %H') AS bucket, round(coalesce(sum(c), 0) + 2.5e-10, 4) AS cost_usd, CAST(coalesce(sum(s), 0) AS BIGINT) AS sessions, CAST(coalesce(sum(t), 0) AS BIGINT) AS turns, CAST(coalesce(sum(r), 0) AS BIGINT) AS requests, CAST(coalesce(sum(k), 0) AS BIGINT) AS tokens
 FROM every LEFT JOIN act ON act.b = every.bucket GROUP BY 1)"""
    return filled


def _timeline(spark, sf, unit):
    p = priced(spark, sf)
    return T.timeline(p, sessions(spark, sf), _turns(p), unit)


def _shown(df):
    return rounded(df.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH")), "cost_usd")


@query("timeline_by_day", f"{_timeline_sql('day')} SELECT * FROM filled")
def timeline_by_day(spark, sf):
    return _shown(_timeline(spark, sf, "day"))


@query("timeline_by_hour", f"{_timeline_sql('hour')} SELECT * FROM filled")
def timeline_by_hour(spark, sf):
    return _shown(_timeline(spark, sf, "hour"))


_ROLL = "CAST(sum(sessions) AS BIGINT) AS sessions, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens"


@query("timeline_by_week", f"{_timeline_sql('day')} SELECT strftime(date_trunc('week', strptime(bucket, '%Y-%m-%d %H')), '%Y-%m-%d %H') AS bucket, round(sum(cost_usd), 2) AS cost_usd, {_ROLL} FROM filled GROUP BY 1")
def timeline_by_week(spark, sf):
    return rounded(_shown(_timeline(spark, sf, "week")), "cost_usd", digits=2)


@query("timeline_by_month", f"{_timeline_sql('day')} SELECT strftime(date_trunc('month', strptime(bucket, '%Y-%m-%d %H')), '%Y-%m-%d %H') AS bucket, round(sum(cost_usd), 2) AS cost_usd, {_ROLL} FROM filled GROUP BY 1")
def timeline_by_month(spark, sf):
    return rounded(_shown(_timeline(spark, sf, "month")), "cost_usd", digits=2)


@query("period_totals", f"{_timeline_sql('day')}, t AS (SELECT sum(cost_usd) AS c, {_ROLL} FROM filled) SELECT round(c, 2) AS cost_usd, sessions, turns, requests, tokens, round(c / sessions, 3) AS cost_per_session, round(c / turns, 3) AS cost_per_turn FROM t")
def period_totals(spark, sf):
    out = T.period_totals(_timeline(spark, sf, "day")).drop("cost_per_token")
    return out.withColumns({"cost_usd": F.round("cost_usd", 2), "cost_per_session": F.round("cost_per_session", 3), "cost_per_turn": F.round("cost_per_turn", 3)})


@query("daily_changes", f"{_timeline_sql('day')} SELECT bucket, round(CASE WHEN lag(cost_usd) OVER (ORDER BY bucket) <> 0 THEN (cost_usd - lag(cost_usd) OVER (ORDER BY bucket)) / lag(cost_usd) OVER (ORDER BY bucket) * 100 END, 2) AS delta_percent FROM filled")
def daily_changes(spark, sf):
    return T.changes(_shown(_timeline(spark, sf, "day"))).select("bucket", F.round("delta_percent", 2).alias("delta_percent"))


@query("over_budget", f"WITH {PRICED_SQL} SELECT round(coalesce(sum(cost_usd), 0) + 2.5e-10, 4) AS cost_usd, 100.0::DOUBLE AS budget_usd, coalesce(sum(cost_usd), 0) > 100.0 AS over_budget FROM priced")
def over_budget(spark, sf):
    return rounded(R.total_cost(priced(spark, sf)).withColumns({"budget_usd": F.lit(100.0), "over_budget": F.col("cost_usd") > 100.0}), "cost_usd")


@query("recent_turns", f"{_BOTH}, tt AS (SELECT session_id, min(timestamp) AS start_time, strftime(timestamp, '%Y-%m-%d') AS turn_id FROM billed WHERE NOT is_sidechain GROUP BY session_id, strftime(timestamp, '%Y-%m-%d')) SELECT tt.session_id, turn_id, s.title FROM tt JOIN sessions s USING (session_id) WHERE s.visible ORDER BY start_time DESC, tt.session_id, turn_id LIMIT 40")
def recent_turns(spark, sf):
    p = R.billed(priced(spark, sf)).where("not is_sidechain")
    turns = p.groupBy("session_id", F.date_format("timestamp", "yyyy-MM-dd").alias("turn_id")).agg(F.min("timestamp").alias("start_time"), F.lit(False).alias("is_sidechain"))
    return R.recent_turns(turns, sessions(spark, sf), 40).select("session_id", "turn_id", "title")


@query("primary_sources", "SELECT o_custkey AS session_id, CAST(o_orderkey AS VARCHAR) AS path FROM orders WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) = 1")
def primary_sources(spark, sf):
    files = read(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderdate").alias("modified"), (F.col("o_orderstatus") == "P").alias("is_subagent"))
    return R.primary_sources(files)
