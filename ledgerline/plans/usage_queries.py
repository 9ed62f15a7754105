"""Queries of de-duplication, lineage, efficiency and verification over the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ledgerline.operators import dedup as D
from ledgerline.operators import efficiency as E
from ledgerline.operators import storage as S
from ledgerline.operators import verify as V
from ledgerline.plans.adapters import PRICED_SQL, REQUESTS_SQL, priced, read, requests
from ledgerline.plans.catalog import query
from ledgerline.plans.report_queries import NUDGE, rounded

# Every three events are lines of one request.
_LINES_SQL = f"{REQUESTS_SQL}, lines AS (SELECT *, CAST(floor(id / 3) AS BIGINT) AS request_key FROM requests)"


def _lines(spark, sf):
    return requests(spark, sf).withColumns({"request_key": F.floor(F.col("id") / 3), "place": F.col("id")})


@query("best_entries", f"WITH {_LINES_SQL} SELECT session_id, request_key, id, stop_reason, output_tokens, input_tokens FROM lines QUALIFY row_number() OVER (PARTITION BY session_id, request_key ORDER BY stop_reason IS NULL, output_tokens DESC, input_tokens DESC, id) = 1")
def best_entries(spark, sf):
    return D.best_entries(_lines(spark, sf), ["session_id", "request_key"]).select("session_id", "request_key", "id", "stop_reason", "output_tokens", "input_tokens")


@query("last_best_entries", f"WITH {_LINES_SQL} SELECT session_id, request_key, id FROM lines QUALIFY row_number() OVER (PARTITION BY session_id, request_key ORDER BY stop_reason IS NULL, output_tokens DESC, input_tokens DESC, id DESC) = 1")
def last_best_entries(spark, sf):
    return D.last_best_entries(_lines(spark, sf), ["session_id", "request_key"]).select("session_id", "request_key", "id")


@query("replayed_lines", "SELECT user_id AS session_id, CAST(floor(event_id / 4) AS BIGINT) AS uuid, event_id AS line FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(floor(event_id / 4) AS BIGINT) ORDER BY event_id % 2 = 0, event_type, event_id) = 1")
def replayed_lines(spark, sf):
    lines = read(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.floor(F.col("event_id") / 4).alias("uuid"), (F.col("event_id") % 2 == 0).alias("is_subagent"), F.col("event_type").alias("path"), F.col("event_id").alias("line"))
    return D.drop_replayed_lines(lines).select("session_id", "uuid", "line")


@query("membership", f"WITH {REQUESTS_SQL} SELECT session_id, id, input_tokens, output_tokens FROM requests WHERE NOT is_sidechain")
def membership(spark, sf):
    return D.membership(requests(spark, sf)).select("session_id", "id", "input_tokens", "output_tokens")


# An order carries the parts of its lines; a part on many orders is a shared request.
_CARRIED_SQL = """carried AS (SELECT DISTINCT l_orderkey AS session_id, l_partkey AS request_id FROM lineitem),
sizes AS (SELECT session_id, count(*) AS n_requests FROM carried GROUP BY session_id),
shared AS (SELECT request_id, max((n_requests, session_id))[2] AS owner FROM carried JOIN sizes USING (session_id) GROUP BY request_id HAVING count(*) > 1)""".replace("max((n_requests, session_id))[2]", "arg_max(session_id, n_requests * 1000000000000 + session_id)")


def _carried(spark, sf):
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("request_id"))


@query("request_owners", f"WITH {_CARRIED_SQL} SELECT request_id, owner FROM shared")
def request_owners(spark, sf):
    return D.owners(_carried(spark, sf))


@query("session_lineage", f"""WITH {_CARRIED_SQL}, o AS (SELECT c.session_id, coalesce(s.owner, c.session_id) AS owner FROM carried c LEFT JOIN shared s USING (request_id)),
r AS (SELECT o.session_id, bool_or(o.owner = o.session_id) AS owns, arg_max(o.owner, z.n_requests * 1000000000000 + o.owner) AS leaf FROM o JOIN sizes z ON z.session_id = o.owner GROUP BY o.session_id)
SELECT session_id, n_requests, NOT owns AS hidden, CASE WHEN owns THEN session_id ELSE leaf END AS canonical FROM r JOIN sizes USING (session_id)""")
def session_lineage(spark, sf):
    return D.lineage(_carried(spark, sf))


@query("rehomed_requests", f"""WITH {_CARRIED_SQL}, v AS (SELECT l_orderkey AS session_id, l_partkey AS request_id, min(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2)
SELECT v.request_id, v.session_id, quantity FROM v LEFT JOIN shared s USING (request_id) WHERE s.owner IS NULL OR s.owner = v.session_id""")
def rehomed_requests(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("request_id"), F.col("l_quantity").alias("quantity"))
    return D.rehome(rows, ["quantity"])


@query("turn_ordinals", "SELECT o_custkey AS session_id, o_orderkey AS turn_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END NULLS FIRST, o_orderkey) - 1 AS INTEGER) AS ordinal FROM orders")
def turn_ordinals(spark, sf):
    turns = read(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("turn_id"), F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("start_time"))
    return D.turn_ordinals(turns).select("session_id", "turn_id", "ordinal")


@query("stale_prices", "SELECT DISTINCT user_id AS session_id FROM events WHERE event_id % 50 = 0")
def stale_prices(spark, sf):
    rows = requests(spark, sf).withColumn("pricing_version", F.when(F.col("id") % 100 == 0, None).when(F.col("id") % 50 == 0, 1).otherwise(2))
    return D.stale_prices(rows, 2)


@query("prunable_sessions", "SELECT c_custkey AS session_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P') AND c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def prunable_sessions(spark, sf):
    sessions = read(spark, sf, "customer").select(F.col("c_custkey").alias("session_id"))
    return D.prune_candidates(sessions, read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("session_id")), read(spark, sf, "events").select(F.col("user_id").alias("session_id")))


# Sign-ups are rate-limit samples of two accounts, whose windows of five hours the limit is reset in; the rest are costs.
_ACCOUNT = "user_id % 2"
_EFFICIENCY_SQL = f"""WITH {PRICED_SQL},
samples AS (SELECT {_ACCOUNT} AS account, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS used, time_bucket(INTERVAL 5 HOUR, ts, TIMESTAMP '2024-01-01') AS resets_at FROM events WHERE event_type = 'signup'),
costs AS (SELECT session_id % 2 AS account, timestamp AS ts, coalesce(cost_usd, 0) AS c FROM priced WHERE model NOT IN ('<synthetic>', 'unlisted-model')),
marked AS (SELECT *, CASE WHEN lag(resets_at) OVER w IS DISTINCT FROM resets_at THEN 1 ELSE 0 END AS new FROM samples WINDOW w AS (PARTITION BY account ORDER BY ts, used)),
islands AS (SELECT *, sum(new) OVER (PARTITION BY account ORDER BY ts, used) AS island FROM marked),
levels AS (SELECT *, max(used) OVER (PARTITION BY account, island ORDER BY ts, used) AS level FROM islands),
kept AS (SELECT * FROM levels QUALIFY lag(level) OVER (PARTITION BY account, island ORDER BY ts, used) IS NULL OR level - lag(level) OVER (PARTITION BY account, island ORDER BY ts, used) >= 1e-6),
lagged AS (SELECT account, ts, level, lag(ts) OVER w AS p_ts, lag(level) OVER w AS p_level FROM kept WINDOW w AS (PARTITION BY account ORDER BY ts, level)),
pairs AS (SELECT l.account, l.ts, any_value(level - p_level) AS d_limit, sum(c) AS d_cost FROM lagged l JOIN costs c ON c.account = l.account AND c.ts > p_ts AND c.ts <= l.ts
 WHERE level > p_level AND l.ts > p_ts AND epoch(l.ts) - epoch(p_ts) <= 4 * 3600 GROUP BY l.account, l.ts HAVING sum(c) >= 0.001),
ratios AS (SELECT *, d_limit / d_cost AS ratio, CAST(hour(ts) AS INTEGER) AS hour FROM pairs),
mids AS (SELECT account, quantile_cont(ratio, 0.5) AS mid, quantile_cont(1 / ratio, 0.5) AS mid_inverse FROM ratios GROUP BY account)"""
_STATS_SQL = """count(*) AS samples, round(sum(d_cost) + 2.5e-10, 3) AS cost_usd, sum(d_limit) AS limit_used, round(avg(ratio), 2) AS mean_ratio, round(quantile_cont(ratio, 0.9), 2) AS p90_ratio,
round((sum(ratio) + 10 * any_value(mid)) / (count(*) + 10), 2) AS shrunk_ratio, round((sum(1 / ratio) + 10 * any_value(mid_inverse)) / (count(*) + 10), 3) AS dollars_shrunk"""
_HOURS_SQL = f"""hours AS (SELECT ratios.account, hour, {_STATS_SQL} FROM ratios JOIN mids USING (account) GROUP BY 1, 2),
every AS (SELECT account, CAST(h AS INTEGER) AS hour FROM (SELECT DISTINCT account FROM samples), range(24) t(h)),
filled AS (SELECT account, hour, coalesce(samples, 0) AS samples, coalesce(cost_usd, 0) AS cost_usd, coalesce(limit_used, 0) AS limit_used, coalesce(mean_ratio, 0) AS mean_ratio, coalesce(p90_ratio, 0) AS p90_ratio, coalesce(shrunk_ratio, 0) AS shrunk_ratio, coalesce(dollars_shrunk, 0) AS dollars_shrunk FROM every LEFT JOIN hours USING (account, hour))"""


def _samples(spark, sf):
    """Windows of five hours from the first of January 2024."""
    since = F.unix_seconds(F.col("ts").cast("timestamp")) - 1_704_067_200
    start = F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(hours=F.floor(since / 18_000).cast("int") * 5)
    return read(spark, sf, "events").where("event_type = 'signup'").select(F.expr(_ACCOUNT).alias("account"), "ts", F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("used"), start.alias("resets_at"))


def _costs(spark, sf):
    return priced(spark, sf).where("model not in ('<synthetic>', 'unlisted-model')").select((F.col("session_id") % 2).alias("account"), F.col("timestamp").alias("ts"), "cost_usd")


@query("canonical_samples", f"{_EFFICIENCY_SQL} SELECT account, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, level AS used FROM kept")
def canonical_samples(spark, sf):
    return E.canonical(_samples(spark, sf)).select("account", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "used")


@query("ratio_pairs", f"{_EFFICIENCY_SQL} SELECT account, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, d_limit, round(d_cost + {NUDGE}, 5) AS d_cost FROM ratios")
def ratio_pairs(spark, sf):
    pairs = E.ratio_pairs(_samples(spark, sf), _costs(spark, sf))
    return pairs.select("account", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "d_limit", F.round(F.col("d_cost") + NUDGE, 5).alias("d_cost"))


_SHOWN = ["samples", "cost_usd", "limit_used", "mean_ratio", "p90_ratio", "shrunk_ratio", "dollars_shrunk"]


def _hours(spark, sf):
    return E.by_hour_of_day(_samples(spark, sf), _costs(spark, sf))


def _digits(df):
    return df.withColumn("cost_usd", F.round(F.col("cost_usd") + F.when(F.col("samples") > 0, NUDGE).otherwise(0.0), 3)).withColumns({c: F.round(c, d) for c, d in (("mean_ratio", 2), ("p90_ratio", 2), ("shrunk_ratio", 2), ("dollars_shrunk", 3))})


@query("efficiency_by_hour_of_day", f"{_EFFICIENCY_SQL}, {_HOURS_SQL} SELECT * FROM filled")
def efficiency_by_hour_of_day(spark, sf):
    return _digits(_hours(spark, sf).select("account", "hour", *_SHOWN))


_SINCE = "BETWEEN TIMESTAMP '2024-01-23 12:00:00' AND TIMESTAMP '2024-01-30 12:34:00'"
_LAST_SQL = _EFFICIENCY_SQL.replace("WHERE event_type = 'signup')", f"WHERE event_type = 'signup' AND ts {_SINCE})").replace("'unlisted-model'))", f"'unlisted-model') AND timestamp {_SINCE})")
_LAST_SQL = _LAST_SQL.replace("level > p_level AND", f"level - p_level >= {E.MIN_DELTA} AND").replace("CAST(hour(ts) AS INTEGER) AS hour", "date_trunc('hour', ts) AS hour")
_WEEK_SQL = _HOURS_SQL.replace("CAST(h AS INTEGER) AS hour", "h AS hour").replace("range(24) t(h)", "generate_series(TIMESTAMP '2024-01-23 13:00:00', TIMESTAMP '2024-01-30 12:00:00', INTERVAL 1 HOUR) t(h)")


@query("efficiency_by_hour", f"{_LAST_SQL}, {_WEEK_SQL} SELECT account, strftime(hour, '%Y-%m-%d %H') AS hour_start, * EXCLUDE (account, hour) FROM filled")
def efficiency_by_hour(spark, sf):
    """The last 168 hours before a fixed moment; its pairs and statistics are those of the queries above."""
    now = datetime(2024, 1, 30, 12, 34)
    out = E.by_hour(_samples(spark, sf).where(F.col("ts") <= F.lit(now)), _costs(spark, sf).where(F.col("ts") <= F.lit(now)), now)
    return _digits(out.select("account", F.date_format("hour_start", "yyyy-MM-dd HH").alias("hour_start"), *_SHOWN))


@query("efficiency_anomalies", f"""{_EFFICIENCY_SQL}, raw AS (SELECT ratios.account, hour, count(*) AS samples, (sum(ratio) + 10 * any_value(mid)) / (count(*) + 10) AS shrunk FROM ratios JOIN mids USING (account) GROUP BY 1, 2 HAVING count(*) >= 5),
base AS (SELECT account, list_sort(list(shrunk))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS baseline FROM raw GROUP BY account HAVING count(*) >= 3),
tags AS (SELECT account, hour, shrunk / baseline AS times, CASE WHEN shrunk / baseline >= 1.5 THEN 'high' WHEN shrunk / baseline <= 0.6 THEN 'low' END AS direction FROM raw JOIN base USING (account) WHERE baseline > 0),
runs AS (SELECT *, hour - row_number() OVER (PARTITION BY account, direction ORDER BY hour) AS island FROM tags WHERE direction IS NOT NULL)
SELECT account, direction, min(hour) AS start_hour, max(hour) AS end_hour, round(avg(times), 4) AS multiplier FROM runs GROUP BY account, direction, island""")
def efficiency_anomalies(spark, sf):
    return E.anomalies(_hours(spark, sf)).withColumn("multiplier", F.round("multiplier", 4))


@query("limit_severity", """SELECT user_id % 2 AS account, arg_max(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE), ts) AS used,
CASE WHEN arg_max(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE), ts) >= 100 THEN 'exceeded' WHEN arg_max(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE), ts) >= 90 THEN 'critical' WHEN arg_max(CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE), ts) >= 70 THEN 'warning' ELSE 'normal' END AS severity FROM events WHERE event_type = 'signup' GROUP BY 1""")
def limit_severity(spark, sf):
    return E.latest_severity(_samples(spark, sf))


@query("bar_classes", f"""{_EFFICIENCY_SQL}, raw AS (SELECT ratios.account, hour, (sum(1 / ratio) + 10 * any_value(mid_inverse)) / (count(*) + 10) AS d FROM ratios JOIN mids USING (account) GROUP BY 1, 2),
base AS (SELECT account, list_sort(list(d))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS baseline FROM raw GROUP BY account HAVING count(*) >= 3),
every AS (SELECT account, CAST(h AS INTEGER) AS hour FROM (SELECT DISTINCT account FROM samples), range(24) t(h))
SELECT account, hour, CASE WHEN d IS NULL OR baseline IS NULL THEN 'none' WHEN d / baseline >= 1.5 THEN 'lenient' WHEN d / baseline <= 0.6 THEN 'tight' ELSE 'normal' END AS class FROM every LEFT JOIN raw USING (account, hour) LEFT JOIN base USING (account)""")
def bar_classes(spark, sf):
    return E.bar_classes(_hours(spark, sf)).select("account", "hour", "class")


# Verification: the truth recomputed from the lines against the reports' side, which prices session-wide.
_TRUTH_SQL = f"""WITH {PRICED_SQL}, keyed AS (SELECT *, CAST(floor(id / 3) AS BIGINT) AS rk FROM joined),
picked AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY session_id, rk ORDER BY stop_reason IS NULL, output_tokens DESC, input_tokens DESC, id DESC) = 1),
costed AS (SELECT *, CASE WHEN prompt > r_threshold THEN 2.0 ELSE 1.0 END AS up, CASE WHEN prompt > r_threshold THEN 1.5 ELSE 1.0 END AS om, speed = 'fast' AND r_fast_in IS NOT NULL AS fast FROM picked),
legs2 AS (SELECT *, coalesce((input_tokens * CASE WHEN fast THEN r_fast_in ELSE r_in * up END + output_tokens * CASE WHEN fast THEN r_fast_out ELSE r_out * om END + (cache_1h * r_1h + cache_5m * r_5m + cache_read * r_read) * up)::DOUBLE / 1000000.0, 0) AS tc FROM costed),
truth AS (SELECT session_id, count(*) AS requests, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(reasoning_tokens) AS BIGINT) AS reasoning_tokens, CAST(sum(cache_1h) AS BIGINT) AS cache_1h, CAST(sum(cache_5m) AS BIGINT) AS cache_5m, CAST(sum(cache_read) AS BIGINT) AS cache_read, sum(tc) AS cost_usd, count(*) FILTER (WHERE priced_as IS NULL AND model <> '<synthetic>') AS unpriced FROM legs2 GROUP BY session_id)"""


def _truth_lines(spark, sf):
    return requests(spark, sf).withColumns({"request_id": F.floor(F.col("id") / 3), "uuid": F.col("id"), "place": F.col("id")})


@query("session_truth", f"{_TRUTH_SQL} SELECT session_id, requests, input_tokens, output_tokens, cache_read, round(cost_usd + {NUDGE}, 4) AS cost_usd, unpriced FROM truth")
def session_truth(spark, sf):
    return rounded(V.session_truth(_truth_lines(spark, sf)).select("session_id", "requests", "input_tokens", "output_tokens", "cache_read", "cost_usd", "unpriced"), "cost_usd")


def _view(spark, sf):
    """The reports' side: the best line of each request, priced session-wide; sessions divisible by 40 are not there."""
    from ledgerline.functions.pricing import price

    picked = D.best_entries(_lines(spark, sf), ["session_id", "request_key"])
    sums = price(picked).groupBy("session_id").agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in V.COUNTED[1:]), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))
    return sums.where("session_id % 40 <> 0")


_VIEW_SQL = f"""best AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY session_id, rk ORDER BY stop_reason IS NULL, output_tokens DESC, input_tokens DESC, id) = 1),
wide AS (SELECT *, coalesce(max(CASE WHEN prompt > r_threshold THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, model), 0) = 1 AS lng, CASE WHEN speed = 'fast' THEN r_fast_in ELSE r_in END AS vi, CASE WHEN speed = 'fast' THEN r_fast_out ELSE r_out END AS vo FROM best),
view2 AS (SELECT session_id, count(*) AS requests, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(reasoning_tokens) AS reasoning_tokens, sum(cache_1h) AS cache_1h, sum(cache_5m) AS cache_5m, sum(cache_read) AS cache_read,
 coalesce(sum(CASE WHEN vi IS NOT NULL THEN (input_tokens * vi + cache_1h * r_1h + cache_5m * r_5m + cache_read * r_read)::DOUBLE / 1000000.0 * CASE WHEN lng THEN 2.0 ELSE 1.0 END + (output_tokens + reasoning_tokens) * vo::DOUBLE / 1000000.0 * CASE WHEN lng THEN 1.5 ELSE 1.0 END END), 0) AS cost_usd FROM wide WHERE session_id % 40 <> 0 GROUP BY session_id)"""
_DIVERGE_SQL = f"""{_TRUTH_SQL}, {_VIEW_SQL}, shown AS (SELECT * FROM truth WHERE session_id % 37 <> 0),
pairs2 AS (SELECT coalesce(t.session_id, v.session_id) AS session_id, {', '.join(f't.{c}' for c in V.COUNTED)}, t.cost_usd, t.unpriced, v.session_id IS NULL AS missing, t.session_id IS NULL AS unknown, v.session_id IS NULL OR t.session_id IS NULL AS absent, {', '.join(f'v.{c} AS v_{c}' for c in V.COUNTED)}, v.cost_usd AS v_cost FROM shown t FULL JOIN view2 v ON t.session_id = v.session_id),
found AS (SELECT session_id, 'session-missing' AS kind, 'error' AS severity FROM pairs2 WHERE missing UNION ALL SELECT session_id, 'session-unknown', 'error' FROM pairs2 WHERE unknown
 {' '.join(f"UNION ALL SELECT session_id, '{c}-mismatch', 'error' FROM pairs2 WHERE NOT absent AND v_{c} <> {c}" for c in V.COUNTED)}
 UNION ALL SELECT session_id, 'cost-mismatch', 'error' FROM pairs2 WHERE NOT absent AND abs(v_cost - cost_usd) > 0.001
 UNION ALL SELECT session_id, 'unknown-pricing', 'warning' FROM pairs2 WHERE unpriced > 0)"""


def _shown_truth(spark, sf):
    """The truth without the sessions divisible by 37, which only the reports' side has."""
    return V.session_truth(_truth_lines(spark, sf).where("session_id % 37 <> 0"))


@query("divergences", f"{_DIVERGE_SQL} SELECT session_id, kind, severity FROM found")
def divergences(spark, sf):
    return V.divergences(_view(spark, sf), _shown_truth(spark, sf)).select("session_id", "kind", "severity")


@query("verify_report", f"""{_DIVERGE_SQL}, r AS (SELECT session_id, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings FROM found GROUP BY session_id)
SELECT session_id, kinds, errors, warnings, round(coalesce(v_cost, 0) - coalesce(cost_usd, 0) + {NUDGE}, 4) AS delta_usd FROM r JOIN pairs2 USING (session_id)""")
def verify_report(spark, sf):
    truth, view = _shown_truth(spark, sf), _view(spark, sf)
    return rounded(V.report(V.divergences(view, truth), view, truth), "delta_usd")


_FILES_SQL = """files AS (SELECT p_partkey AS id, concat('/home/u/.store/', CASE WHEN p_size % 3 = 0 THEN 'projects/' WHEN p_size % 3 = 1 THEN 'other/' ELSE '../x/' END, replace(p_brand, '#', ''), '/', CAST(p_partkey AS VARCHAR(9)), CASE WHEN p_size % 5 = 0 THEN '.db' ELSE '.jsonl' END) AS path,
 p_size AS size, p_partkey % 4 <> 0 AS indexed FROM part)"""


def _files(spark, sf):
    return read(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.expr("concat('/home/u/.store/', CASE WHEN p_size % 3 = 0 THEN 'projects/' WHEN p_size % 3 = 1 THEN 'other/' ELSE '../x/' END, replace(p_brand, '#', ''), '/', CAST(p_partkey AS STRING), CASE WHEN p_size % 5 = 0 THEN '.db' ELSE '.jsonl' END)").alias("path"),
        F.col("p_size").alias("size"), (F.col("p_partkey") % 4 != 0).alias("indexed"), F.lit(None).cast("timestamp_ntz").alias("modified"), F.regexp_replace("p_brand", "#", "").alias("brand"),
    )


@query("storage_classes", f"""WITH {_FILES_SQL} SELECT id, CASE WHEN path LIKE '%.db' THEN 'danger' WHEN starts_with(path, '/home/u/.store/projects/') THEN CASE WHEN indexed THEN 'safe' ELSE 'caution' END WHEN starts_with(path, '/home/u/.store/') THEN 'danger' ELSE 'unclassified' END AS class FROM files""")
def storage_classes(spark, sf):
    return S.classified(_files(spark, sf), "/home/u/.store/projects", "/home/u/.store", datetime(2024, 1, 1)).select("id", "class")


@query("deletion_friction", f"""WITH {_FILES_SQL}, c AS (SELECT split_part(path, '/', -2) AS brand, size, indexed, starts_with(path, '/home/u/.store/projects/') AND path NOT LIKE '%.db' AS ok, starts_with(path, '/home/u/.store/projects/') AND path NOT LIKE '%.db' AND NOT indexed AS careful FROM files)
SELECT brand, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CASE WHEN bool_or(NOT indexed) OR count(*) >= 20 OR sum(size) >= 1000000000 THEN 'high' WHEN count(*) > 1 OR bool_or(careful) THEN 'medium' ELSE 'low' END AS friction, bool_and(ok) AS deletable FROM c GROUP BY brand""")
def deletion_friction(spark, sf):
    rows = S.classified(_files(spark, sf), "/home/u/.store/projects", "/home/u/.store", datetime(2024, 1, 1))
    return S.friction(rows, "brand").select("brand", "files", "bytes", "friction", "deletable")


@query("folder_sizes", f"""WITH RECURSIVE {_FILES_SQL}, up(folder, size) AS (SELECT regexp_replace(path, '/[^/]*$', ''), size FROM files UNION ALL SELECT regexp_replace(folder, '/[^/]*$', ''), size FROM up WHERE folder <> '')
SELECT folder, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS files FROM up GROUP BY folder""")
def folder_sizes(spark, sf):
    return S.folder_sizes(_files(spark, sf))


@query("storage_reconciled", "SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NOT NULL AND b.path IS NOT NULL THEN 'session' WHEN a.path IS NOT NULL THEN 'remnant' ELSE 'orphan' END AS state FROM (SELECT DISTINCT user_id AS path FROM events) a FULL JOIN (SELECT c_custkey AS path FROM customer) b ON a.path = b.path")
def storage_reconciled(spark, sf):
    return S.reconciled(read(spark, sf, "events").select(F.col("user_id").alias("path")).distinct(), read(spark, sf, "customer").select(F.col("c_custkey").alias("path")))
