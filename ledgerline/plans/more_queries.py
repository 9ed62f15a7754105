"""Queries of smaller functions over the driver's tables: periods, lines, messages, calls, titles, text and sinks."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ledgerline.functions import periods as P
from ledgerline.functions import text as X
from ledgerline.functions.pricing import split_cache_writes
from ledgerline.operators import conversation as C
from ledgerline.operators import counters as K
from ledgerline.operators import efficiency as E
from ledgerline.operators import search as Q
from ledgerline.operators import storage as S
from ledgerline.operators import verify as V
from ledgerline.plans import counter_queries as B
from ledgerline.plans import usage_queries as U
from ledgerline.plans.adapters import PRICED_SQL, priced, read
from ledgerline.plans.catalog import query
from ledgerline.plans.report_queries import NUDGE, rounded
from ledgerline.sources import logs as L
from ledgerline.sources import sinks

_NOW = datetime(2024, 1, 20, 10, 11, 12)
_PERIODS = {"7d": {"last": "7d"}, "2w": {"last": "2w"}, "1m": {"last": "1m"}, "month": {"month": "2024-01"}, "span": {"since": "2024-01-05", "until": "2024-01-10"}, "from": {"since": "2024-01-12"}}


def _between(events, bounds: dict):
    """Rows of events in each of some ranges: name and requests, in one pass."""
    inside = [F.when((F.col("ts") >= F.lit(a) if a else F.lit(True)) & (F.col("ts") <= F.lit(b) if b else F.lit(True)), F.lit(name)) for name, (a, b) in bounds.items()]
    return events.select(F.explode(F.filter(F.array(*inside), lambda x: x.isNotNull())).alias("name")).groupBy("name").agg(F.count("*").alias("requests"))


def _ranges_sql(ranges: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) AS requests FROM events WHERE {when} HAVING count(*) > 0" for name, when in ranges.items())


_AT = "TIMESTAMP '2024-01-20 10:11:12'"


@query("resolved_periods", _ranges_sql({
    "7d": f"ts BETWEEN {_AT} - INTERVAL 7 DAY AND {_AT}", "2w": f"ts BETWEEN {_AT} - INTERVAL 14 DAY AND {_AT}", "1m": f"ts BETWEEN {_AT} - INTERVAL 1 MONTH AND {_AT}",
    "month": "ts >= DATE '2024-01-01' AND ts < DATE '2024-02-01'", "span": "ts >= DATE '2024-01-05' AND ts < DATE '2024-01-11'", "from": "ts >= DATE '2024-01-12'",
}))
def resolved_periods(spark, sf):
    return _between(read(spark, sf, "events"), {name: P.resolve(_NOW, **flags) for name, flags in _PERIODS.items()})


@query("named_ranges", _ranges_sql({
    "today": f"ts BETWEEN TIMESTAMP '2024-01-20' AND {_AT}", "yesterday": "ts >= TIMESTAMP '2024-01-19' AND ts < TIMESTAMP '2024-01-20'", "last24h": f"ts BETWEEN {_AT} - INTERVAL 24 HOUR AND {_AT}",
    "thisWeek": f"ts BETWEEN date_trunc('week', {_AT}) AND {_AT}", "last30days": f"ts BETWEEN {_AT} - INTERVAL 30 DAY AND {_AT}",
}))
def named_ranges(spark, sf):
    return _between(read(spark, sf, "events"), {name: P.named_range(name, _NOW) for name in P.NAMED})


@query("matching_rows", "SELECT c_custkey AS id FROM customer WHERE contains(lower(c_name), '7') OR contains(lower(c_mktsegment), '7') OR contains(concat('b', CAST(c_nationkey AS VARCHAR)), '7')")
def matching_rows(spark, sf):
    rows = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("project"), F.concat(F.lit("B"), F.col("c_nationkey").cast("string")).alias("branch"))
    return S.matching_rows(rows, " 7 ").select("id")


_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"


@query("split_cache_writes", f"""WITH c AS (SELECT event_id AS id, {_K} * 10 AS flat, CASE WHEN event_id % 3 = 0 THEN {_K} END AS h, CASE WHEN event_id % 5 = 0 THEN {_K} * 2 WHEN event_id % 7 = 0 THEN 0 END AS f FROM events)
SELECT id, CAST(CASE WHEN coalesce(h, 0) > 0 OR coalesce(f, 0) > 0 THEN coalesce(h, 0) ELSE 0 END AS BIGINT) AS cache_1h, CAST(CASE WHEN coalesce(h, 0) > 0 OR coalesce(f, 0) > 0 THEN coalesce(f, 0) ELSE flat END AS BIGINT) AS cache_5m FROM c""")
def split_writes(spark, sf):
    k = F.expr(_K)
    rows = read(spark, sf, "events").select(F.col("event_id").alias("id"), (k * 10).alias("flat"), F.when(F.col("event_id") % 3 == 0, k).alias("h"), F.when(F.col("event_id") % 5 == 0, k * 2).when(F.col("event_id") % 7 == 0, 0).cast("long").alias("f"))
    hour, five = split_cache_writes(F.col("flat"), F.col("h"), F.col("f"))
    return rows.select("id", hour.alias("cache_1h"), five.alias("cache_5m"))


# Lines of conversations: assistants stream two lines a message, call a tool at every third line, and stop by turns.
_LINES_SQL = """lines AS (SELECT conv_id AS session_id, conv_id * 1000 + turn AS uuid, turn AS place, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS type, CAST(floor(turn / 4) AS BIGINT) AS mid,
 CASE WHEN turn % 5 = 4 THEN NULL ELSE text END AS text, turn % 3 = 0 AS calls, role <> 'assistant' AND turn % 7 = 2 AS has_result, CASE turn % 4 WHEN 0 THEN 'tool_use' WHEN 1 THEN 'end_turn' WHEN 2 THEN 'max_tokens' END AS stop_reason FROM conversations)"""


def _lines(spark, sf):
    turn, assistant = F.col("turn"), F.col("role") == "assistant"
    tool = F.struct(F.concat(F.lit("t"), turn.cast("string")).alias("id"), F.lit("Read").alias("name"), F.lit("{}").alias("input"))
    result = F.struct(F.concat(F.lit("t"), (turn - 2).cast("string")).alias("tool_use_id"), F.concat(F.lit("agentId: a"), turn.cast("string")).alias("content"), (turn % 2 == 0).alias("is_error"))
    some = lambda when, item: F.when(when, F.array(item)).otherwise(F.slice(F.array(item), 1, 0))
    return read(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), (F.col("conv_id") * 1000 + turn).cast("string").alias("uuid"), F.when(turn > 0, F.col("conv_id") * 1000 + turn - 1).cast("string").alias("parent_uuid"), turn.alias("place"), turn.alias("ts"), F.when(assistant, "assistant").otherwise("user").alias("type"),
        F.concat_ws(":", F.col("conv_id").cast("string"), F.floor(turn / 4).cast("string")).alias("message_id"), F.when(turn % 5 != 4, F.col("text")).alias("text"), F.lit(None).cast("string").alias("thinking"),
        some(turn % 3 == 0, tool).alias("tools"), some(~assistant & (turn % 7 == 2), result).alias("results"), F.array().cast("array<string>").alias("images"),
        F.when(turn % 4 == 0, "tool_use").when(turn % 4 == 1, "end_turn").when(turn % 4 == 2, "max_tokens").alias("stop_reason"), F.concat(F.lit("r"), F.floor(turn / 2).cast("string")).alias("request_id"), turn.alias("turn_id"),
    )


@query("step_kinds", f"""WITH {_LINES_SQL} SELECT session_id, place, CASE WHEN type = 'user' THEN CASE WHEN has_result THEN 'toolResult' ELSE 'prompt' END
 WHEN calls OR coalesce(stop_reason = 'tool_use', false) THEN CASE WHEN coalesce(length(text), 0) > 0 THEN 'thought' ELSE 'toolCall' END WHEN stop_reason = 'end_turn' THEN 'reply' ELSE 'stop' END AS kind FROM lines""")
def step_kinds(spark, sf):
    return _lines(spark, sf).select("session_id", "place", C.step_kind().alias("kind"))


@query("merged_messages", f"""WITH {_LINES_SQL}, g AS (SELECT *, CASE WHEN type = 'assistant' THEN concat('m', CAST(mid AS VARCHAR)) ELSE concat('u', CAST(uuid AS VARCHAR)) END AS grp FROM lines)
SELECT session_id, CAST(min(uuid) AS VARCHAR) AS uuid, nullif(coalesce(string_agg(text, chr(10) ORDER BY place), ''), '') AS text, count(*) FILTER (WHERE calls) AS calls, arg_max(stop_reason, place) AS stop_reason, count(DISTINCT floor(place / 2)) AS requests FROM g GROUP BY session_id, grp""")
def merged_messages(spark, sf):
    merged = C.merge_messages(_lines(spark, sf))
    return merged.select("session_id", "uuid", "text", F.size("tools").cast("long").alias("calls"), "stop_reason", F.size("request_ids").cast("long").alias("requests"))


_CALLS_SQL = f"""{_LINES_SQL}, called AS (SELECT c.session_id, c.place AS call_turn, r.place AS answer FROM lines c LEFT JOIN lines r ON r.session_id = c.session_id AND r.has_result AND r.place - 2 = c.place WHERE c.calls)"""


@query("call_results", f"WITH {_CALLS_SQL} SELECT session_id, concat('t', CAST(call_turn AS VARCHAR)) AS tool_use_id, call_turn, CASE WHEN answer IS NOT NULL THEN concat('agentId: a', CAST(answer AS VARCHAR)) END AS result, answer % 2 = 0 AS is_error FROM called")
def call_results(spark, sf):
    return C.call_results(_lines(spark, sf)).select("session_id", "tool_use_id", "call_turn", "result", "is_error")


@query("agent_links", f"WITH {_CALLS_SQL} SELECT session_id, call_turn, concat('a', CAST(answer AS VARCHAR)) AS agent_id FROM called WHERE answer IS NOT NULL")
def agent_links(spark, sf):
    return C.agent_links(C.call_results(_lines(spark, sf))).select("session_id", "call_turn", "agent_id")


# Shells: users' events as lines of sessions; sign-ups rename a session, clicks are its user's lines.
_SHELL_SQL = """e AS (SELECT user_id AS session_id, event_id AS place, ts, event_type, value FROM events), fu AS (SELECT session_id, min(place) AS u FROM e WHERE event_type = 'click' GROUP BY 1),
t AS (SELECT e.*, concat('title ', CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR)) AS title, u IS NULL OR place < u AS early FROM e LEFT JOIN fu USING (session_id) WHERE event_type = 'signup'),
b AS (SELECT session_id, arg_max(title, place) AS base FROM t WHERE early GROUP BY 1),
ct AS (SELECT session_id, arg_max(title, place) AS custom_title FROM t JOIN (SELECT DISTINCT session_id, base FROM t LEFT JOIN b USING (session_id)) USING (session_id) WHERE NOT early AND title IS DISTINCT FROM base GROUP BY 1)"""


def _shell_lines(spark, sf):
    kind = F.col("event_type")
    return read(spark, sf, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("place"), "ts", F.when(kind == "click", "user").when(kind.isin("view", "purchase"), "assistant").otherwise("other").alias("type"), (kind == "purchase").alias("has_usage"),
        (F.col("event_id") % 13 == 0).alias("is_sidechain"), (F.col("event_id") % 11 == 0).alias("injected"), F.array().cast("array<string>").alias("results"), F.when(kind == "view", F.concat(F.lit("b"), (F.col("event_id") % 4).cast("string"))).alias("branch"),
        F.when(kind == "error", F.concat(F.lit("slug-"), F.col("event_id").cast("string"))).alias("slug"), F.concat(F.lit("say "), F.col("event_id").cast("string")).alias("text"), F.when(kind == "signup", F.concat(F.lit("title "), (F.floor("value") % 3).cast("string"))).alias("custom_title"),
    )


@query("custom_titles", f"WITH {_SHELL_SQL} SELECT * FROM ct")
def custom_titles(spark, sf):
    return C.custom_titles(_shell_lines(spark, sf))


_SHELLS_SQL = f"""{_SHELL_SQL}, sh AS (SELECT user_id AS session_id, min(ts) FILTER (WHERE event_type = 'purchase') AS started, max(ts) FILTER (WHERE event_type = 'purchase') AS ended,
 arg_max(concat('b', CAST(event_id % 4 AS VARCHAR)), event_id) FILTER (WHERE event_type = 'view') AS branch, arg_min(concat('slug-', CAST(event_id AS VARCHAR)), event_id) FILTER (WHERE event_type = 'error') AS slug,
 arg_min(concat('say ', CAST(event_id AS VARCHAR)), event_id) FILTER (WHERE event_type = 'click' AND event_id % 13 <> 0 AND event_id % 11 <> 0) AS first_prompt FROM events GROUP BY user_id)"""


@query("session_shells", f"WITH {_SHELLS_SQL} SELECT sh.session_id, strftime(started, '%Y-%m-%d %H:%M:%S') AS started, strftime(ended, '%Y-%m-%d %H:%M:%S') AS ended, branch, slug, first_prompt, custom_title FROM sh LEFT JOIN ct USING (session_id)")
def session_shells(spark, sf):
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started", "ended")]
    return C.session_shells(_shell_lines(spark, sf)).select("session_id", *shown, "branch", "slug", "first_prompt", "custom_title")


@query("session_titles", f"WITH {_SHELLS_SQL} SELECT sh.session_id, coalesce(custom_title, slug, first_prompt, substr(CAST(sh.session_id AS VARCHAR), 1, 8)) AS shown_title FROM sh LEFT JOIN ct USING (session_id)")
def session_titles(spark, sf):
    return C.titles(C.session_shells(_shell_lines(spark, sf))).select("session_id", "shown_title")


@query("merged_shells", "SELECT o_custkey AS session_id, strftime(min(o_orderdate), '%Y-%m-%d') AS started, strftime(max(o_orderdate + INTERVAL 2 DAY), '%Y-%m-%d') AS ended, arg_min(CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, CASE WHEN o_orderkey % 3 = 0 THEN epoch(o_orderdate) * 10000000 + o_orderkey END) AS first_prompt FROM orders GROUP BY o_custkey")
def merged_shells(spark, sf):
    rows = read(spark, sf, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(0)))
    order = F.struct(F.col("at").alias("at"), F.col("o_orderkey").alias("k"))
    shells = rows.select(F.col("o_custkey").alias("session_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("first_prompt"), order.alias("started"), F.struct((F.col("at") + F.make_dt_interval(days=F.lit(2))).alias("at"), F.col("o_orderkey").alias("k")).alias("ended"))
    day = lambda c: F.date_format(F.col(f"{c}.at"), "yyyy-MM-dd").alias(c)
    return C.merged_shells(shells).select("session_id", day("started"), day("ended"), "first_prompt")


# Tool calls whose arguments hold what the summary shows.
_TOOL = "CASE event_type WHEN 'click' THEN 'Bash' WHEN 'view' THEN 'Read' WHEN 'purchase' THEN 'Grep' WHEN 'signup' THEN 'Skill' ELSE 'Other' END"


@query("tool_summaries", f"SELECT event_id, CASE event_type WHEN 'click' THEN concat('run ', CAST(event_id AS VARCHAR)) WHEN 'view' THEN concat('f', CAST(event_id AS VARCHAR), '.py') WHEN 'purchase' THEN 'a.*b' WHEN 'signup' THEN '/fix' ELSE 'Other' END AS summary, CASE WHEN event_type = 'signup' THEN 'fix' END AS skill FROM events")
def tool_summaries(spark, sf):
    arguments = F.to_json(F.struct(F.concat(F.lit("run "), F.col("event_id").cast("string")).alias("command"), F.concat(F.lit("/a/f"), F.col("event_id").cast("string"), F.lit(".py")).alias("file_path"), F.lit("a.*b").alias("pattern"), F.lit("/fix").alias("skill")))
    rows = read(spark, sf, "events").select("event_id", F.expr(_TOOL).alias("name"), arguments.alias("a"))
    return rows.select("event_id", X.tool_summary(F.col("name"), F.col("a")).alias("summary"), X.tool_skill(F.col("name"), F.col("a")).alias("skill"))


@query("dollar_skills", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'fix-it' WHEN 2 THEN concat('s', CAST(o_custkey AS VARCHAR)) END AS skill FROM orders")
def dollar_skills(spark, sf):
    k, own = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    prompt = F.when(k == 0, F.concat(F.lit("$fix-it the order "), own)).when(k == 1, F.concat(F.lit("costs $12 "), own)).when(k == 2, F.concat(F.lit("# My request for Codex:\n\n[$s"), own, F.lit("](/home/u/skills/x/SKILL.md) go"))).when(k == 3, F.lit("[$no](/home/u/other.md)")).otherwise("$Plain text")
    return read(spark, sf, "orders").select("o_orderkey", X.dollar_skill(prompt).alias("skill"))


@query("parsed_timestamps", "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN epoch_ms(date_trunc('second', ts)) + CASE WHEN event_id % 4 = 1 THEN 250 ELSE 0 END - CASE WHEN event_id % 4 = 2 THEN 7200000 ELSE 0 END END AS ms FROM events")
def parsed_timestamps(spark, sf):
    at = F.date_format(F.date_trunc("second", F.col("ts")), "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(at, F.lit("Z"))).when(k == 1, F.concat(at, F.lit(".250Z"))).when(k == 2, F.concat(at, F.lit("+02:00"))).otherwise("not a time")
    return read(spark, sf, "events").select("event_id", F.unix_millis(L.parse_timestamp(text)).alias("ms"))


@query("snapped_percents", "SELECT event_id, round(value / 7 + 0.00000001, 4) AS used FROM events")
def snapped_percents(spark, sf):
    return read(spark, sf, "events").select("event_id", E.snap(F.col("value") / 7 + 1e-8).alias("used"))


@query("fingerprints", "SELECT event_id, concat(CAST(user_id AS VARCHAR), ':', CAST(epoch_us(ts) AS VARCHAR)) AS fingerprint FROM events")
def fingerprints(spark, sf):
    return read(spark, sf, "events").select("event_id", L.fingerprint(F.col("user_id"), F.col("ts").cast("timestamp")).alias("fingerprint"))


@query("prompt_highlights", "SELECT conv_id, turn, array_to_string([x for x in range(0, length(text)) if substr(lower(text), x + 1, 3) = 'the'], ',') AS starts FROM conversations")
def prompt_highlights(spark, sf):
    found = Q.highlights(F.col("text"), "THE")
    return read(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.transform(found, lambda h: h["start"].cast("string")), ",").alias("starts"))


@query("report_errors", f"{U._DIVERGE_SQL}, r AS (SELECT session_id, count(*) FILTER (WHERE severity = 'error') AS errors FROM found GROUP BY session_id) SELECT session_id, errors FROM r WHERE errors > 0")
def report_errors(spark, sf):
    truth, view = U._shown_truth(spark, sf), U._view(spark, sf)
    return V.at_level(V.report(V.divergences(view, truth), view, truth), "errors").select("session_id", "errors")


@query("missing_requests", "SELECT DISTINCT user_id AS session_id, CAST(CAST(floor(event_id / 3) AS BIGINT) AS VARCHAR) AS request_key FROM events WHERE floor(event_id / 3) % 17 = 0")
def missing_requests(spark, sf):
    picked = V.truth_requests(U._truth_lines(spark, sf))
    view = picked.where("request_id % 17 <> 0").select("session_id", F.col("request_id").cast("string").alias("request_key"))
    return V.missing_requests(view, picked).select("session_id", "request_key")


@query("today_total", f"WITH {PRICED_SQL} SELECT round(coalesce(sum(cost_usd), 0) + {NUDGE}, 4) AS cost_usd, (SELECT count(*) FROM customer WHERE c_custkey < 0) = 0 AS complete FROM priced WHERE timestamp >= TIMESTAMP '2024-01-20' AND model <> '<synthetic>'")
def today_total(spark, sf):
    from ledgerline.operators import timeline as T

    pending = read(spark, sf, "customer").where("c_custkey < 0")
    return rounded(T.today_total(priced(spark, sf), pending, datetime(2024, 1, 20)), "cost_usd")


@query("kept_samples", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20 10:11:12' - INTERVAL 3 DAY")
def kept_samples(spark, sf):
    return E.retained(read(spark, sf, "events"), _NOW, days=3).select("event_id")


_HEAD = "concat('{\"type\":\"', CASE event_type WHEN 'click' THEN 'progress' WHEN 'view' THEN 'file-history-snapshot' ELSE 'user' END, '\"}')"


@query("prefiltered_lines", "SELECT event_id, event_type IN ('click', 'view') AS dropped FROM events")
def prefiltered_lines(spark, sf):
    return read(spark, sf, "events").select("event_id", L.prefiltered(F.expr(_HEAD)).alias("dropped"))


_PATH = "concat('/root/p', CAST(p_size AS STRING), '/s', CAST(p_partkey AS STRING), CASE p_partkey % 4 WHEN 1 THEN '/subagents/agent-x.jsonl' WHEN 2 THEN '/subagents/workflows/w1/agent-y.jsonl' WHEN 3 THEN '/subagents/other.jsonl' ELSE '.jsonl' END)"


@query("file_roles", "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'agent' WHEN 2 THEN 'workflow' WHEN 3 THEN 'other' ELSE 'main' END AS role, concat('p', CAST(p_size AS VARCHAR)) AS project, concat('s', CAST(p_partkey AS VARCHAR)) AS session, CASE p_partkey % 4 WHEN 1 THEN 'x' WHEN 2 THEN 'y' END AS agent FROM part")
def file_roles(spark, sf):
    return L.file_roles(read(spark, sf, "part").select("p_partkey", F.expr(_PATH).alias("path"))).select("p_partkey", "role", "project", "session", "agent")


@query("csv_cells", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, format('{:.6f}', o_totalprice) AS o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN concat('''=', o_orderpriority) ELSE o_orderpriority END AS note FROM orders")
def csv_cells(spark, sf):
    note = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("="), F.col("o_orderpriority"))).otherwise(F.concat(F.lit("\x07"), F.col("o_orderpriority")))
    return sinks.csv_cells(read(spark, sf, "orders").select("o_orderkey", "o_totalprice", note.alias("note")))


@query("json_rows", """SELECT concat('{"c_custkey":', CAST(c_custkey AS VARCHAR), ',"c_name":"', c_name, '","none":null}') AS value FROM customer""")
def json_rows(spark, sf):
    return sinks.json_lines(read(spark, sf, "customer").select("c_name", "c_custkey", F.lit(None).cast("string").alias("none")))


@query("changed_files", "SELECT p_partkey, 'new' AS state FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0 UNION ALL SELECT p_partkey + 1000000000, 'gone' FROM part WHERE p_partkey % 11 = 0")
def changed_files(spark, sf):
    files = read(spark, sf, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("fingerprint"))
    manifest = files.where("path % 5 <> 0").withColumn("fingerprint", F.when(F.col("path") % 7 == 0, -1).otherwise(F.col("fingerprint")))
    manifest = manifest.union(files.where("path % 11 = 0").select((F.col("path") + 1_000_000_000).alias("path"), "fingerprint"))
    new, gone = L.changed_files(files, manifest)
    return new.select(F.col("path").alias("p_partkey"), F.lit("new").alias("state")).union(gone.select("path", F.lit("gone")))


@query("latest_titles", "SELECT user_id AS id, arg_max(concat('t', CAST(event_id AS VARCHAR)), CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1e15 END + floor(event_id / 5) * 1e6 * CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END + event_id) AS title FROM events GROUP BY user_id")
def latest_titles(spark, sf):
    rows = read(spark, sf, "events").select(F.col("user_id").alias("id"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("title"), F.when(F.col("event_id") % 3 != 0, F.floor(F.col("event_id") / 5)).alias("updated_at"), F.col("event_id").alias("line"))
    return L.latest_titles(rows)


# Provider B: truth by a fold, chains, sidechains and shells.
_USED_SQL = f"""{B._SQL}, used AS (SELECT *, CASE WHEN last IS NOT NULL THEN last WHEN before IS NULL THEN total WHEN total > before THEN total - before ELSE 0 END AS u FROM prev),
by_piece AS (SELECT piece, CAST(sum(3 * u) AS BIGINT) AS input_tokens, CAST(sum(u) AS BIGINT) AS cache_read, CAST(sum(2 * u) AS BIGINT) AS output_tokens FROM used GROUP BY piece)"""


def _truth_b(spark, sf):
    return V.counter_truth(B._events(spark, sf).where("payload_type = 'token_count'"))


@query("counter_truth", f"WITH {_USED_SQL} SELECT * FROM by_piece")
def counter_truth(spark, sf):
    return _truth_b(spark, sf).select("piece", "input_tokens", "cache_read", "output_tokens")


@query("counter_divergences", f"WITH {_USED_SQL} SELECT piece AS session_id, CASE WHEN piece % 40 = 0 THEN 'session-missing' ELSE 'session-unknown' END AS kind FROM by_piece WHERE input_tokens > 0 AND (piece % 40 = 0) <> (piece % 37 = 0)")
def counter_divergences(spark, sf):
    """The windows' side lacks pieces divisible by 40, the fold's side those divisible by 37; else both agree."""
    known = K.requests(B._events(spark, sf), B._sessions(spark, sf).withColumn("forked", F.lit(False)))
    sums = known.groupBy(F.col("piece").alias("session_id")).agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in V.COUNTED[1:]))
    view = sums.withColumn("cost_usd", F.lit(0.0)).where("session_id % 40 <> 0")
    none = {"cache_1h": F.lit(0).cast("long"), "cache_5m": F.lit(0).cast("long"), "cost_usd": F.lit(0.0)}
    truth = _truth_b(spark, sf).withColumnRenamed("piece", "session_id").withColumns(none).where("session_id % 37 <> 0 and requests > 0")
    return V.divergences(view, truth).select("session_id", "kind")


_TREE_SQL = """s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 <> 0 AND c_custkey > 1 THEN CAST(floor(c_custkey / 2) AS BIGINT) END AS parent FROM customer),
up(id, here, depth) AS (SELECT id, id, 0 FROM s UNION ALL SELECT up.id, s.parent, depth + 1 FROM up JOIN s ON s.id = up.here WHERE s.parent IS NOT NULL),
tree AS (SELECT id, arg_max(here, depth) AS root, CAST(max(depth) AS BIGINT) AS depth FROM up GROUP BY id)"""


def _tree(spark, sf):
    key = F.col("c_custkey")
    return read(spark, sf, "customer").select(key.alias("id"), F.when((key % 7 != 0) & (key > 1), F.floor(key / 2)).alias("parent"), key.alias("created"))


@query("chain_order", f"WITH RECURSIVE {_TREE_SQL} SELECT id, root, depth FROM tree")
def chain_order(spark, sf):
    return K.chain_order(_tree(spark, sf)).select("id", "root", F.col("depth").cast("long").alias("depth"))


@query("sidechain_sessions", f"WITH RECURSIVE {_TREE_SQL} SELECT s.id, coalesce(s.id <> root AND s.parent = root AND s.id % 3 = 0, false) AS is_sidechain FROM s JOIN tree USING (id)")
def sidechain_sessions(spark, sf):
    """Children divisible by 3 are named by a call of their root."""
    rooted = K.chain_order(_tree(spark, sf)).select("id", "root", "parent")
    links = rooted.where("id % 3 = 0").select("root", F.col("id").alias("child"))
    return K.sidechains(rooted, links.union(links)).select("id", "is_sidechain")


@query("counter_shells", """SELECT user_id AS session_id, strftime(min(ts) FILTER (WHERE event_type = 'purchase'), '%Y-%m-%d %H:%M:%S') AS started, strftime(max(ts) FILTER (WHERE event_type = 'purchase'), '%Y-%m-%d %H:%M:%S') AS ended,
 concat('say ', CAST(arg_min(event_id, event_id) FILTER (WHERE event_type = 'click' AND event_id % 13 <> 0 AND event_id % 4 <> 0) AS VARCHAR)) AS first_prompt FROM events GROUP BY user_id HAVING count(*) FILTER (WHERE event_type = 'purchase') > 0""")
def counter_shells(spark, sf):
    e = read(spark, sf, "events").withColumn("session_id", F.col("user_id"))
    prompts = e.where("event_type = 'click'").select("session_id", F.lit(0).alias("ts"), F.col("event_id").alias("line"), (F.col("event_id") % 13 == 0).alias("is_sidechain"), F.when(F.col("event_id") % 4 == 0, "  ").otherwise(F.concat(F.lit(" say "), F.col("event_id").cast("string"))).alias("text"))
    found = K.shells(e.where("event_type = 'purchase'").select("session_id", F.col("ts").alias("timestamp")), prompts)
    return found.select("session_id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("started", "ended")), F.coalesce("first_prompt", F.lit("say ")).alias("first_prompt"))


@query("linked_agents", "SELECT o_custkey AS child, arg_min(concat('c', CAST(o_orderkey AS VARCHAR)), o_orderkey) AS call_id FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0 AND o_custkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY o_custkey")
def linked_agents(spark, sf):
    o = read(spark, sf, "orders").withColumn("call_id", F.concat(F.lit("c"), F.col("o_orderkey").cast("string"))).withColumn("turn", F.floor(F.col("o_orderkey") / 10))
    calls = o.select("turn", "call_id", F.col("o_orderkey").alias("line"), F.when(F.col("o_orderkey") % 5 == 0, "Agent").otherwise("shell").alias("name"))
    results = o.select("turn", "call_id", (F.col("o_orderkey") % 3 == 0).alias("is_error"), F.concat(F.lit('{"agent_id":"'), F.col("o_custkey").cast("string"), F.lit('"}')).alias("output"))
    children = read(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("child"))
    return K.linked_agents(calls, results, children).select(F.col("child").cast("long").alias("child"), "call_id")


@query("patched_files", "SELECT p_partkey, concat('src/', CAST(p_size AS VARCHAR), '.py', CASE WHEN p_partkey % 2 = 0 THEN concat(',a b/', CAST(p_partkey AS VARCHAR), '.md') ELSE '' END) AS files FROM part")
def patched_files(spark, sf):
    one, two = F.concat(F.lit("*** Update File: src/"), F.col("p_size").cast("string"), F.lit(".py")), F.concat(F.lit("*** Add File: a b/"), F.col("p_partkey").cast("string"), F.lit(".md"))
    patch = F.concat_ws("\n", F.lit("*** Begin Patch"), one, F.lit("+x *** Delete File: no"), F.when(F.col("p_partkey") % 2 == 0, two), one)
    return read(spark, sf, "part").select("p_partkey", F.array_join(K.patched_files(patch), ",").alias("files"))


@query("line_diagnostics", """WITH c AS (SELECT user_id AS piece, CASE event_type WHEN 'error' THEN 'malformed' WHEN 'view' THEN 'unknown-type:odd' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'usage-duplicate' END END AS category FROM events)
SELECT piece, category, count(*) AS n FROM c WHERE category IS NOT NULL GROUP BY piece, category""")
def line_diagnostics(spark, sf):
    e = read(spark, sf, "events").withColumn("piece", F.col("user_id"))
    lines = e.select("piece", (F.col("event_type") == "error").alias("malformed"), F.when(F.col("event_type") == "view", "odd").otherwise("event_msg").alias("type"))
    resolved = e.where("event_type = 'signup'").select("piece", F.when(F.col("event_id") % 2 == 0, "duplicate").alias("skipped"))
    return K.line_diagnostics(lines, resolved)
