"""Queries of the cumulative-counter provider over the driver's events: a user's events are a piece of a session's log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import counters as K
from ledgerline.plans.adapters import read
from ledgerline.plans.catalog import query

_NULL = "CAST(NULL AS STRUCT<input_tokens BIGINT, cached_input_tokens BIGINT, output_tokens BIGINT, reasoning_output_tokens BIGINT, total_tokens BIGINT>)"


def _usage(k: str) -> str:
    return f"named_struct('input_tokens', {k} * 4, 'cached_input_tokens', {k}, 'output_tokens', {k} * 2, 'reasoning_output_tokens', {k} % 2, 'total_tokens', {k} * 6)"


def _events(spark, sf) -> DataFrame:
    """Token events of purchases and views: the running sum of k is the total, every fourth event of a piece repeats the
    total before it, every third reports a last usage only. Clicks are user messages, errors end tasks, sign-ups set a
    turn and model."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("piece"), F.col("event_id").alias("line"), "ts", "event_type", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))
    from pyspark.sql import Window

    order = Window.partitionBy("piece").orderBy("line")
    token = F.col("event_type").isin("purchase", "view")
    n = F.sum(token.cast("int")).over(order)
    held = F.when(token & (n % 4 != 0), F.col("k")).otherwise(0)
    base = e.withColumns({"n": n, "t": F.sum(held).over(order)})
    kind = F.when(token, "token_count").when(F.col("event_type") == "click", "user_message").when(F.col("event_type") == "error", "task_complete").otherwise("turn_context")
    total = F.expr(f"CASE WHEN event_type IN ('purchase', 'view') AND n % 3 <> 0 THEN {_usage('t')} ELSE {_NULL} END")
    last = F.expr(f"CASE WHEN event_type IN ('purchase', 'view') AND n % 3 = 0 THEN {_usage('k')} ELSE {_NULL} END")
    return base.select(
        "piece", "line", "ts", F.lit("event_msg").alias("type"), kind.alias("payload_type"), F.lit(None).cast("string").alias("role"), F.when(kind == "user_message", F.concat(F.lit("say "), F.col("k").cast("string"))).alias("text"),
        F.when(kind == "turn_context", F.concat(F.lit("turn-"), F.col("line").cast("string"))).alias("turn_id"), F.when(kind == "turn_context", F.lit("gpt-5.5")).alias("model"), last.alias("last_usage"), total.alias("total_usage"),
    )


# The fold, with the running total of a piece as a sum since the newest reported one.
_SQL = """e AS (SELECT user_id AS piece, event_id AS line, ts, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, event_type IN ('purchase', 'view') AS tok FROM events),
b AS (SELECT *, sum(CASE WHEN tok THEN 1 ELSE 0 END) OVER (PARTITION BY piece ORDER BY line) AS n FROM e),
c AS (SELECT *, CAST(sum(CASE WHEN tok AND n % 4 <> 0 THEN k ELSE 0 END) OVER (PARTITION BY piece ORDER BY line) AS BIGINT) AS t FROM b),
tokens AS (SELECT piece, line, ts, k, n, CASE WHEN n % 3 <> 0 THEN t END AS total, CASE WHEN n % 3 = 0 THEN k END AS last FROM c WHERE tok),
isl AS (SELECT *, count(total) OVER (PARTITION BY piece ORDER BY line) AS island FROM tokens),
run AS (SELECT *, coalesce(first_value(total) OVER w, 0) AS base, sum(coalesce(last, 0)) OVER w AS added FROM isl WINDOW w AS (PARTITION BY piece, island ORDER BY line)),
known AS (SELECT *, 4 * (base + added) AS after_in, 1 * (base + added) AS after_cached, 2 * (base + added) AS after_out FROM run),
prev AS (SELECT *, lag(base + added) OVER (PARTITION BY piece ORDER BY line) AS before FROM known)"""


@query("running_totals", f"WITH {_SQL} SELECT piece, line, CAST(after_in AS BIGINT) AS input_after, CAST(after_out AS BIGINT) AS output_after FROM known")
def running_totals(spark, sf):
    tokens = _events(spark, sf).where("payload_type = 'token_count'")
    return K.running_totals(tokens).select("piece", "line", F.col("total_after.input_tokens").alias("input_after"), F.col("total_after.output_tokens").alias("output_after"))


# Two usages are equal where their k is, but for reasoning, which goes by parity; so a repeated total is a repeated k.
@query("resolved_usage", f"""WITH {_SQL}, par AS (SELECT *, lag(CASE WHEN total IS NULL THEN NULL ELSE total END) OVER (PARTITION BY piece ORDER BY line) AS lt FROM prev)
SELECT piece, line, CASE WHEN last IS NOT NULL THEN CASE WHEN last > 0 THEN 4 * last END WHEN before IS NULL THEN CASE WHEN total > 0 THEN 4 * total END WHEN total > before THEN 4 * (total - before) END AS fresh FROM par""")
def resolved_usage(spark, sf):
    """The input of each usage; null where an event counts for nothing. Parities can leave a usage of reasoning alone."""
    out = K.resolve_usage(_events(spark, sf).where("payload_type = 'token_count'"))
    return out.select("piece", "line", F.nullif(F.col("usage.input_tokens"), F.lit(0)).alias("fresh"))


@query("carried_turns", """WITH RECURSIVE e AS (SELECT user_id AS piece, event_id AS line, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f(piece, n, line, turn, made) AS (SELECT piece, n, line, CASE event_type WHEN 'signup' THEN concat('turn-', CAST(line AS VARCHAR)) WHEN 'click' THEN 'generated-1' END, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END FROM e WHERE n = 1
 UNION ALL SELECT e.piece, e.n, e.line, CASE event_type WHEN 'signup' THEN concat('turn-', CAST(e.line AS VARCHAR)) WHEN 'error' THEN NULL WHEN 'click' THEN coalesce(f.turn, concat('generated-', CAST(f.made + 1 AS VARCHAR))) ELSE f.turn END,
 CASE WHEN event_type = 'click' AND f.turn IS NULL THEN f.made + 1 ELSE f.made END FROM f JOIN e ON e.piece = f.piece AND e.n = f.n + 1) SELECT piece, line, turn AS current_turn FROM f""")
def carried_turns(spark, sf):
    return K.carried(_events(spark, sf)).select("piece", "line", "current_turn")


def _sessions(spark, sf) -> DataFrame:
    users = read(spark, sf, "events").groupBy(F.col("user_id").alias("piece")).agg(F.min("ts").alias("created"))
    return users.select("piece", F.concat(F.lit("b:"), F.col("piece").cast("string")).alias("session_id"), F.lit("gpt-5").alias("model"), "created", (F.col("piece") % 3 == 0).alias("forked"), (F.col("piece") % 6 == 0).alias("subagent"))


@query("provider_requests", f"""WITH {_SQL}, used AS (SELECT *, CASE WHEN last IS NOT NULL THEN last WHEN before IS NULL THEN total WHEN total > before THEN total - before ELSE 0 END AS u FROM prev)
SELECT piece, count(*) FILTER (WHERE u > 0) AS requests, CAST(sum(3 * u) AS BIGINT) AS input_tokens, CAST(sum(u) AS BIGINT) AS cache_read, CAST(sum(2 * u) AS BIGINT) AS output_tokens FROM used GROUP BY piece""")
def provider_requests(spark, sf):
    """Without forks, whose copied events go by time; tests cover those. A usage of reasoning alone is no row here."""
    known = K.requests(_events(spark, sf), _sessions(spark, sf).withColumn("forked", F.lit(False)))
    return known.where("input_tokens + cache_read > 0").groupBy("piece").agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in ("input_tokens", "cache_read", "output_tokens")))


@query("priced_provider_requests")
def priced_provider_requests(spark, sf):
    """Forks' copied events left out, models carried on from contexts, priced."""
    from ledgerline.functions.pricing import price

    known = K.requests(_events(spark, sf), _sessions(spark, sf)).withColumn("speed", F.lit(None).cast("string"))
    return price(known).select("id", "model", F.round("cost_usd", 6).alias("cost_usd"))


_PARENT_SQL = "s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 AND c_custkey > 1 THEN CAST(floor(c_custkey / 2) AS BIGINT) END AS parent FROM customer)"


@query("identity_roots", f"""WITH RECURSIVE {_PARENT_SQL}, up(id, here, parent) AS (SELECT s.id, s.id, p.id FROM s LEFT JOIN s p ON p.id = s.parent UNION ALL SELECT up.id, s.id, p.id FROM up JOIN s ON s.id = up.parent LEFT JOIN s p ON p.id = s.parent)
SELECT id, max(CASE WHEN parent IS NULL THEN here END) AS root FROM up GROUP BY id""")
def identity_roots(spark, sf):
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 7 <> 0 AND c_custkey > 1 THEN CAST(floor(c_custkey / 2) AS BIGINT) END").alias("parent"))
    return K.identity_roots(rows)


@query("interrupted_turns", "SELECT o_custkey AS session_id, o_orderkey AS turn, o_orderstatus <> 'F' AND lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) IS NOT NULL AS interrupted FROM orders")
def interrupted_turns(spark, sf):
    turns = read(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("turn"), F.col("o_orderdate").alias("start_time"), (F.col("o_orderstatus") == "F").alias("ended"))
    return K.interrupted(turns).select("session_id", "turn", "interrupted")


@query("coalesced_agent_turns", "SELECT o_custkey AS agent_id, arg_min(o_orderkey, epoch(o_orderdate) * 100000000 + o_orderkey) AS turn, bool_or(o_orderstatus = 'P') AS interrupted, count(*) AS n_steps FROM orders GROUP BY 1")
def coalesced_agent_turns(spark, sf):
    turns = read(spark, sf, "orders").select(F.col("o_custkey").alias("agent_id"), F.col("o_orderkey").alias("turn"), F.col("o_orderdate").alias("start_time"), (F.col("o_orderstatus") == "P").alias("interrupted"), F.lit(1).cast("long").alias("n_steps"))
    return K.coalesced_agent_turns(turns).drop("start_time")


@query("child_totals", """WITH c AS (SELECT l_orderkey AS parent_turn, sum(l_linenumber) AS n, bool_and(l_returnflag <> 'R') AS complete FROM lineitem GROUP BY 1)
SELECT o_orderkey AS turn, CAST(1 + coalesce(n, 0) AS BIGINT) AS n, coalesce(complete, true) AS complete FROM orders LEFT JOIN c ON parent_turn = o_orderkey""")
def child_totals(spark, sf):
    parents = read(spark, sf, "orders").select(F.col("o_orderkey").alias("turn"), F.lit(1).cast("long").alias("n"), F.lit(1).cast("long").alias("m"))
    lines = read(spark, sf, "lineitem")
    children = lines.select(F.col("l_orderkey").alias("parent_turn"), F.when(F.col("l_returnflag") != "R", 0).cast("long").alias("m"), F.col("l_linenumber").cast("long").alias("n"))
    return K.child_totals(parents, children, ["m", "n"]).select("turn", "n", "complete")
