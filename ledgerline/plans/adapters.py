"""The driver's tables as the engine's tables. Expressions are read by Spark and by DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import pricing

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"
REQUESTS = {
    "id": "event_id",
    "session_id": "user_id",
    "timestamp": "ts",
    "model": "CASE event_type WHEN 'click' THEN 'claude-opus-4-6' WHEN 'view' THEN 'claude-sonnet-9' WHEN 'purchase' THEN 'gpt-5.5' WHEN 'error' THEN '<synthetic>' ELSE 'unlisted-model' END",
    "speed": "CASE WHEN event_id % 7 = 0 THEN 'fast' ELSE 'standard' END",
    "stop_reason": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'end_turn' END",
    "input_tokens": f"{_K} * 4000",
    "output_tokens": "CAST(floor(value) AS BIGINT)",
    "reasoning_tokens": f"{_K} % 3",
    "cache_1h": f"CASE WHEN event_id % 4 = 0 THEN {_K} * 10 ELSE CAST(0 AS BIGINT) END",
    "cache_5m": f"CASE WHEN event_id % 4 = 0 THEN CAST(0 AS BIGINT) ELSE {_K} * 10 END",
    "cache_read": f"{_K} * 100",
    "is_sidechain": "event_id % 13 = 0",
    "k": _K,
}
SESSIONS = {
    "session_id": "user_id",
    "project": "CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('/work/p', CAST(user_id % 10 AS VARCHAR(9))) END",
    "title": "concat('session ', CAST(user_id AS VARCHAR(9)))",
    "visible": "user_id % 11 <> 0",
}
#: One step per conversation row; parents are the turn before; every fifth assistant row of a conversation was dropped.
STEPS = {
    "session_id": "conv_id",
    "uuid": "conv_id * 1000 + turn",
    "parent_uuid": "CASE WHEN turn = 0 THEN NULL ELSE conv_id * 1000 + turn - 1 END",
    "ordinal": "turn",
    "kind": "CASE role WHEN 'assistant' THEN 'reply' ELSE 'prompt' END",
    "injected": "role = 'system'",
    "text": "text",
}


def _select(columns: dict, table: str, more: str = "") -> str:
    return f"SELECT {', '.join(f'{e} AS {a}' for a, e in columns.items())} FROM {table} {more}"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(*(f"{e.replace('VARCHAR(9)', 'STRING')} AS {a}" for a, e in REQUESTS.items()))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"))
    return users.selectExpr(*(f"{e.replace('VARCHAR(9)', 'STRING')} AS {a}" for a, e in SESSIONS.items()), "started", "ended")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").selectExpr(*(f"{e} AS {a}" for a, e in STEPS.items()))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.price(requests(spark, sf_dir))


# DuckDB's side: the same tables, and an own formulation of pricing.
def _literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)


_RATES = ", ".join(f"({', '.join(map(_literal, row))})" for row in pricing.rate_rows())
_FAMILY = " ".join(f"WHEN starts_with(model, '{p}') THEN '{m}'" for p, m in pricing.NEWEST_BY_PREFIX.items())
REQUESTS_SQL = f"requests AS ({_select(REQUESTS, 'events')})"
SESSIONS_SQL = f"sessions AS ({_select(SESSIONS, '(SELECT user_id, min(ts) AS started, max(ts) AS ended FROM events GROUP BY user_id)').replace(' FROM (SELECT', ', started, ended FROM (SELECT', 1)})"
STEPS_SQL = f"steps AS ({_select(STEPS, 'conversations')})"
RATES_SQL = f"rates(rate_model, r_in, r_out, r_5m, r_1h, r_read, r_fast_in, r_fast_out, r_threshold) AS (VALUES {_RATES})"
PRICED_SQL = f"""{REQUESTS_SQL}, {RATES_SQL},
named AS (SELECT r.*, CASE WHEN model IN (SELECT rate_model FROM rates) THEN model {_FAMILY} END AS priced_as, input_tokens + cache_1h + cache_5m + cache_read AS prompt FROM requests r),
joined AS (SELECT n.*, r.*, coalesce(max(CASE WHEN prompt > r_threshold THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, model), 0) = 1 AS is_long FROM named n LEFT JOIN rates r ON n.priced_as = r.rate_model),
rated AS (SELECT *, CASE WHEN is_long THEN 2.0 ELSE 1.0 END AS up, CASE WHEN is_long THEN 1.5 ELSE 1.0 END AS om,
  CASE WHEN speed = 'fast' THEN r_fast_in ELSE r_in END AS ri, CASE WHEN speed = 'fast' THEN r_fast_out ELSE r_out END AS ro FROM joined),
legs AS (SELECT *, CASE WHEN ri IS NOT NULL THEN input_tokens / 1000000.0::DOUBLE * (ri::DOUBLE * up::DOUBLE) END AS input_cost,
  CASE WHEN ri IS NOT NULL THEN (output_tokens + reasoning_tokens) / 1000000.0::DOUBLE * (ro::DOUBLE * om::DOUBLE) END AS output_cost,
  CASE WHEN ri IS NOT NULL THEN cache_1h / 1000000.0::DOUBLE * (r_1h::DOUBLE * up::DOUBLE) END AS cache_1h_cost,
  CASE WHEN ri IS NOT NULL THEN cache_5m / 1000000.0::DOUBLE * (r_5m::DOUBLE * up::DOUBLE) END AS cache_5m_cost,
  CASE WHEN ri IS NOT NULL THEN cache_read / 1000000.0::DOUBLE * (r_read::DOUBLE * up::DOUBLE) END AS cache_read_cost FROM rated),
priced AS (SELECT *, input_cost + output_cost + cache_1h_cost + cache_5m_cost + cache_read_cost AS cost_usd FROM legs)"""
