"""Queries of conversation assembly, text functions and search over the driver's tables.

A conversation row is a step whose parent is the row before it; users prompt, assistants reply, system rows are injected
prompts. Every fifth row from the fourth on was dropped, so chains hop over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import conversation as C
from ledgerline.operators import search as Q
from ledgerline.operators import verify as V
from ledgerline.plans.adapters import read
from ledgerline.plans.catalog import query

_ENTRIES_SQL = """entries AS (SELECT conv_id AS session_id, conv_id * 1000 + turn AS uuid, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_uuid, turn AS place, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * turn AS ts,
 CASE role WHEN 'assistant' THEN 'reply' ELSE 'prompt' END AS kind, role = 'system' AS injected, turn % 5 = 3 AS dropped, text, length(text) AS size, conv_id % 3 = 0 AND turn % 4 = 2 AS is_sidechain FROM conversations),
steps AS (SELECT * FROM entries WHERE NOT dropped)"""


def _entries(spark, sf) -> DataFrame:
    return read(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("uuid"), F.when(F.col("turn") > 0, F.col("conv_id") * 1000 + F.col("turn") - 1).alias("parent_uuid"), F.col("turn").alias("place"),
        (F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'") + F.make_dt_interval(mins=F.col("turn").cast("int"))).alias("ts"), F.when(F.col("role") == "assistant", "reply").otherwise("prompt").alias("kind"), (F.col("role") == "system").alias("injected"),
        (F.col("turn") % 5 == 3).alias("dropped"), "text", F.length("text").cast("long").alias("size"), ((F.col("conv_id") % 3 == 0) & (F.col("turn") % 4 == 2)).alias("is_sidechain"),
    )


def _assembled(spark, sf) -> DataFrame:
    entries = _entries(spark, sf)
    return C.turn_ids(entries.where("not dropped").drop("dropped"), entries.select("session_id", "uuid", "parent_uuid"))


# The walk goes up one line at a time until it meets a line whose turn is known.
_WALK_SQL = f"""{_ENTRIES_SQL},
starts AS (SELECT s.*, p.kind = 'prompt' AND NOT p.dropped AS below FROM steps s LEFT JOIN entries p ON p.session_id = s.session_id AND p.uuid = s.parent_uuid),
own AS (SELECT session_id, uuid, CASE WHEN kind = 'prompt' AND NOT injected THEN CASE WHEN below THEN parent_uuid ELSE uuid END END AS value FROM starts),
walk(session_id, uuid, here, top, value, n) AS (SELECT session_id, uuid, uuid, uuid, value, 0 FROM own
 UNION ALL SELECT w.session_id, w.uuid, e.parent_uuid, CASE WHEN o.uuid IS NOT NULL THEN o.uuid ELSE w.top END, o.value, n + 1 FROM walk w JOIN entries e ON e.session_id = w.session_id AND e.uuid = w.here LEFT JOIN own o ON o.session_id = w.session_id AND o.uuid = e.parent_uuid WHERE w.value IS NULL AND e.parent_uuid IS NOT NULL),
turned AS (SELECT session_id, uuid, coalesce(max(value), arg_max(top, n)) AS turn_id FROM walk GROUP BY session_id, uuid)"""


@query("turn_assembly", f"WITH RECURSIVE {_WALK_SQL} SELECT session_id, uuid, turn_id FROM turned")
def turn_assembly(spark, sf):
    return _assembled(spark, sf).select("session_id", "uuid", "turn_id")


_TURNS_SQL = f"""{_WALK_SQL}, t AS (SELECT s.*, turned.turn_id FROM steps s JOIN turned USING (session_id, uuid)),
all_turns AS (SELECT session_id, turn_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n_steps, bool_and(is_sidechain) AS is_sidechain, arg_min(text, place) FILTER (WHERE kind = 'prompt') AS prompt, CAST(sum(size) AS BIGINT) AS size FROM t GROUP BY 1, 2)"""


def _turns(spark, sf):
    steps = _assembled(spark, sf)
    full = steps.withColumns({"agent_id": F.lit(None).cast("string"), "is_compact": F.col("injected")})
    return steps, C.turns(full).join(steps.groupBy("session_id", "turn_id").agg(F.sum("size").alias("size")), ["session_id", "turn_id"])


@query("turns", f"WITH RECURSIVE {_TURNS_SQL} SELECT session_id, turn_id, strftime(start_time, '%H:%M') AS started, strftime(end_time, '%H:%M') AS ended, n_steps, is_sidechain, prompt, size FROM all_turns")
def turns(spark, sf):
    return _turns(spark, sf)[1].select("session_id", "turn_id", F.date_format("start_time", "HH:mm").alias("started"), F.date_format("end_time", "HH:mm").alias("ended"), "n_steps", "is_sidechain", "prompt", "size")


@query("compacted_turns", f"WITH RECURSIVE {_TURNS_SQL}, c AS (SELECT session_id, turn_id, arg_min(injected, place) AS is_compact FROM t GROUP BY 1, 2) SELECT session_id, turn_id, n_steps = 1 AND coalesce(lead(is_compact) OVER (PARTITION BY session_id ORDER BY start_time NULLS FIRST, turn_id), false) AS compacted FROM all_turns JOIN c USING (session_id, turn_id)")
def compacted_turns(spark, sf):
    return C.compacted_away(_turns(spark, sf)[1]).select("session_id", "turn_id", "compacted")


@query("previous_turns", f"WITH RECURSIVE {_TURNS_SQL} SELECT session_id, turn_id, lag(turn_id) OVER (PARTITION BY session_id ORDER BY start_time, turn_id) AS previous_turn_id FROM all_turns")
def previous_turns(spark, sf):
    return C.previous_turn(_turns(spark, sf)[1]).select("session_id", "turn_id", "previous_turn_id")


@query("rolled_up_turns", f"""WITH RECURSIVE {_TURNS_SQL}, links AS (SELECT DISTINCT a.session_id, a.turn_id, b.turn_id AS agent_turn, b.size AS s FROM all_turns a JOIN all_turns b ON a.session_id = b.session_id AND b.is_sidechain AND NOT a.is_sidechain)
SELECT session_id, turn_id, CAST(any_value(a.size) + coalesce(sum(s), 0) AS BIGINT) AS total_size FROM all_turns a LEFT JOIN links USING (session_id, turn_id) GROUP BY session_id, turn_id""")
def rolled_up_turns(spark, sf):
    """Every turn of a session calls all its sidechain turns, each of which is an agent of its own."""
    all_turns = _turns(spark, sf)[1].withColumn("agent_id", F.col("turn_id").cast("string"))
    agents = all_turns.where("is_sidechain").select("session_id", "agent_id")
    links = all_turns.where("not is_sidechain").select("session_id", F.col("turn_id").alias("call_turn")).join(agents, "session_id")
    return C.rolled_up(all_turns, links, ["size"]).select("session_id", "turn_id", "total_size")


@query("orphan_lines", f"WITH RECURSIVE {_WALK_SQL} SELECT e.session_id, e.uuid, turned.turn_id FROM entries e JOIN turned ON turned.session_id = e.session_id AND turned.uuid = e.parent_uuid WHERE e.dropped")
def orphan_lines(spark, sf):
    entries = _entries(spark, sf)
    return C.orphan_lines(entries.select("session_id", "uuid", "parent_uuid"), _assembled(spark, sf)).select("session_id", "uuid", "turn_id")


@query("turn_locators", f"WITH RECURSIVE {_WALK_SQL} SELECT session_id, turn_id, uuid, 'step' AS owner FROM turned UNION ALL SELECT e.session_id, turned.turn_id, e.uuid, 'orphan' FROM entries e JOIN turned ON turned.session_id = e.session_id AND turned.uuid = e.parent_uuid WHERE e.dropped")
def turn_locators(spark, sf):
    entries = _entries(spark, sf)
    return C.turn_locators(_assembled(spark, sf), entries.select("session_id", "uuid", "parent_uuid"))


@query("nearest_prompts", f"""WITH RECURSIVE {_ENTRIES_SQL}, up(session_id, uuid, here) AS (SELECT session_id, uuid, uuid FROM entries UNION ALL SELECT u.session_id, u.uuid, e.parent_uuid FROM up u JOIN entries e ON e.session_id = u.session_id AND e.uuid = u.here WHERE e.parent_uuid IS NOT NULL)
SELECT u.session_id, u.uuid, max(CASE WHEN e.kind = 'prompt' AND NOT e.dropped THEN e.uuid END) AS prompt FROM up u JOIN entries e ON e.session_id = u.session_id AND e.uuid = u.here GROUP BY u.session_id, u.uuid""")
def nearest_prompts(spark, sf):
    """Ids grow along a chain, so the nearest prompt is the one with the largest id."""
    entries = _entries(spark, sf)
    return C.nearest_prompts(entries.where("not dropped"), entries.select("session_id", "uuid", "parent_uuid"))


@query("answers", f"WITH {_ENTRIES_SQL} SELECT a.session_id, a.uuid, u.text AS question FROM entries a JOIN entries u ON u.session_id = a.session_id AND u.uuid = a.parent_uuid WHERE a.kind = 'reply' AND u.kind = 'prompt' AND NOT u.injected")
def answers(spark, sf):
    entries = _entries(spark, sf).withColumn("type", F.when(F.col("kind") == "reply", "assistant").when(~F.col("injected"), "user").otherwise("system"))
    return C.question_of_answer(entries).select("session_id", "uuid", "question")


@query("skill_spans", f"""WITH RECURSIVE {_WALK_SQL}, t AS (SELECT s.*, turned.turn_id, s.size % 3 = 0 AS trig FROM steps s JOIN turned USING (session_id, uuid)),
g AS (SELECT *, sum(CASE WHEN trig THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, turn_id ORDER BY place) AS grp FROM t),
h AS (SELECT *, max(CASE WHEN kind = 'reply' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, turn_id, grp ORDER BY place) AS ended FROM g) SELECT session_id, uuid, CASE WHEN grp > 0 AND ended = 0 THEN CAST(grp AS BIGINT) END AS span FROM h""")
def skill_spans(spark, sf):
    return C.skill_spans(_assembled(spark, sf), F.col("size") % 3 == 0).select("session_id", "uuid", "span")


@query("tool_runs", "WITH e AS (SELECT user_id AS session_id, strftime(ts, '%Y-%m-%d') AS turn_id, event_id, ts, CASE WHEN event_type <> 'error' THEN event_type END AS name FROM events), c AS (SELECT *, CASE WHEN lag(name) OVER w IS NOT DISTINCT FROM name AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY session_id, turn_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY session_id, turn_id ORDER BY ts, event_id) AS run FROM c) SELECT session_id, turn_id, name, count(*) AS n_calls FROM r WHERE name IS NOT NULL GROUP BY session_id, turn_id, run, name")
def tool_runs(spark, sf):
    calls = read(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.date_format("ts", "yyyy-MM-dd").alias("turn_id"), "ts", F.col("event_id").alias("place"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("name"))
    return C.tool_runs(calls).drop("run")


@query("model_summary", "WITH u AS (SELECT l_orderkey AS session_id, l_suppkey AS turn_id, l_returnflag AS model, sum(CAST(l_quantity AS BIGINT)) AS used, min(l_linenumber) AS seen FROM lineitem GROUP BY 1, 2, 3) SELECT session_id, turn_id, model AS primary_model, count(*) OVER (PARTITION BY session_id, turn_id) - 1 AS others FROM u QUALIFY row_number() OVER (PARTITION BY session_id, turn_id ORDER BY used DESC, seen, model) = 1")
def model_summary(spark, sf):
    steps = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_suppkey").alias("turn_id"), F.col("l_returnflag").alias("model"), F.col("l_quantity").cast("long").alias("input_tokens"), F.lit(0).alias("output_tokens"), F.col("l_shipdate").alias("_s"), F.lit(0).alias("ts"), F.col("l_linenumber").alias("place"))
    return C.model_summary(steps)


@query("deduped_attachments", "WITH r AS (SELECT l_orderkey % 500 AS session_id, l_suppkey AS turn_id, l_partkey % 20 AS locator, l_shipdate AS kind, l_returnflag AS origin, l_linenumber % 3 AS priority, l_orderkey * 10 + l_linenumber AS pos FROM lineitem) SELECT session_id, turn_id, locator, origin, min(pos) OVER (PARTITION BY session_id, turn_id, locator) AS pos FROM r QUALIFY row_number() OVER (PARTITION BY session_id, turn_id, locator ORDER BY priority DESC, pos, kind, origin) = 1")
def deduped_attachments(spark, sf):
    refs = read(spark, sf, "lineitem").select((F.col("l_orderkey") % 500).alias("session_id"), F.col("l_suppkey").alias("turn_id"), (F.col("l_partkey") % 20).alias("locator"), F.col("l_shipdate").alias("kind"), F.col("l_returnflag").alias("origin"), (F.col("l_linenumber") % 3).alias("priority"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return C.dedup_attachments(refs).drop("kind")


@query("folded_stories", "WITH b AS (SELECT user_id AS session_id, event_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT session_id, event_id AS place, n > 60 AND k > 1 AND k <= n - 3 AS folded FROM b")
def folded_stories(spark, sf):
    blocks = read(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.lit(0).alias("turn_id"), "ts", F.col("event_id").alias("place"))
    return C.story_folds(blocks, most=60).select("session_id", "place", "folded")


@query("first_agents", "SELECT user_id AS session_id, strftime(ts, '%Y-%m-%d') AS turn_id, arg_min(event_type, ts) AS agent_id FROM events WHERE event_id % 13 = 0 GROUP BY 1, 2")
def first_agents(spark, sf):
    steps = read(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.date_format("ts", "yyyy-MM-dd").alias("turn_id"), "ts", F.col("event_id").alias("place"), (F.col("event_id") % 13 == 0).alias("is_sidechain"), F.col("event_type").alias("agent_id"))
    return C.first_agents(steps)


# Text functions, over texts made from the tables so that each pattern occurs.
_PROMPT = "CASE WHEN conv_id % 5 = 0 THEN concat('/skill-', CAST(turn AS {s}), ' ', text) WHEN conv_id % 5 = 1 THEN concat('see @/work/src/file', CAST(turn AS {s}), '.py and /tmp/a.txt. ', text) WHEN conv_id % 5 = 2 AND turn % 2 = 0 THEN 'ok' ELSE text END"
_PROMPTS_SQL = f"prompts AS (SELECT conv_id, turn, {_PROMPT.format(s='VARCHAR')} AS prompt FROM conversations)"


def _prompts(spark, sf):
    return read(spark, sf, "conversations").select("conv_id", "turn", F.expr(_PROMPT.format(s="STRING")).alias("prompt"), "text")


@query("skill_names", f"WITH {_PROMPTS_SQL} SELECT conv_id, turn, nullif(regexp_extract(prompt, '^\\s*/(\\S+)', 1), '') AS skill FROM prompts")
def skill_names(spark, sf):
    return _prompts(spark, sf).select("conv_id", "turn", X.skill_name(F.col("prompt")).alias("skill"))


@query("prompt_previews", f"""WITH {_PROMPTS_SQL}, c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(prompt, '@/work/src/(file[0-9]+\\.py)', '@\\1', 'g'), '[\\n\\r]', ' ', 'g'), ' +', ' ', 'g')) AS t FROM prompts)
SELECT conv_id, turn, CASE WHEN t = '' THEN '(empty)' WHEN length(t) <= 50 THEN t ELSE concat(rtrim(substr(t, 1, 50)), '…') END AS preview FROM c""")
def prompt_previews(spark, sf):
    return _prompts(spark, sf).select("conv_id", "turn", X.preview(F.col("prompt"), F.lit(False), F.lit(False)).alias("preview"))


@query("mentioned_paths", f"WITH {_PROMPTS_SQL} SELECT conv_id, turn, CASE WHEN prompt LIKE 'see @%' THEN concat('/work/src/file', CAST(turn AS VARCHAR), '.py,/tmp/a.txt') ELSE '' END AS paths FROM prompts")
def mentioned_paths(spark, sf):
    return _prompts(spark, sf).select("conv_id", "turn", F.array_join(X.file_paths(F.col("prompt")), ",").alias("paths"))


@query("page_links", "SELECT page_id, array_to_string(list_distinct_in_order, ',') AS links FROM (SELECT page_id, [u[i] for i in range(1, len(u) + 1) if list_position(u, u[i]) = i] AS list_distinct_in_order FROM (SELECT page_id, regexp_extract_all(html, 'https?://[^\\s<>\"'')\\]]+') AS u FROM pages))")
def page_links(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.array_join(X.urls(F.col("html")), ",").alias("links"))


@query("prompt_hints", f"""WITH {_PROMPTS_SQL}, l AS (SELECT conv_id, turn, prompt, lag(prompt) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM prompts),
f AS (SELECT conv_id, turn, prompt, trim(split_part(ltrim(prev, chr(10)), chr(10), 1)) AS line FROM l)
SELECT conv_id, turn, CASE WHEN line IS NOT NULL THEN CASE WHEN length(line) <= 60 THEN line ELSE concat(rtrim(substr(line, 1, 60)), '…') END END AS hint FROM f WHERE prompt = 'ok'""")
def prompt_hints(spark, sf):
    rows = _prompts(spark, sf).withColumnRenamed("conv_id", "session_id").withColumn("start_time", F.col("turn")).withColumn("turn_id", F.col("turn"))
    known = C.previous_turn(rows, "prompt")
    return known.where("prompt = 'ok'").select(F.col("session_id").alias("conv_id"), "turn", X.prompt_hint(F.col("prompt"), F.col("previous_prompt")).alias("hint"))


@query("formatted_numbers", """SELECT o_orderkey, CASE WHEN floor(o_totalprice) < 1000 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) WHEN floor(o_totalprice) < 1000000 THEN format('{:.1f}k', floor(o_totalprice) / 1000) ELSE format('{:.1f}M', floor(o_totalprice) / 1000000) END AS compact,
CASE WHEN o_totalprice / 10000 < 0.0005 THEN '<$0.001' WHEN o_totalprice / 10000 < 1 THEN format('${:.3f}', o_totalprice / 10000) WHEN o_totalprice / 10000 < 100 THEN format('${:.2f}', o_totalprice / 10000) ELSE format('${:.0f}', o_totalprice / 10000) END AS cost FROM orders""")
def formatted_numbers(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", X.compact_number(F.floor("o_totalprice")).alias("compact"), X.compact_cost(F.col("o_totalprice") / 10000).alias("cost"))


@query("project_labels", "SELECT c_custkey, regexp_extract(c_name, '([^-#]+)$', 1) AS dashed, concat('x', CAST(c_nationkey AS VARCHAR)) AS pathed, concat('/home/u', CAST(c_custkey AS VARCHAR), '/_work') AS decoded FROM customer")
def project_labels(spark, sf):
    rows = read(spark, sf, "customer")
    return rows.select("c_custkey", X.project_label(F.regexp_replace("c_name", "#", "-")).alias("dashed"), X.project_label(F.concat(F.lit("/a/b/x"), F.col("c_nationkey").cast("string"))).alias("pathed"), X.decoded_path(F.concat(F.lit("-home-u"), F.col("c_custkey").cast("string"), F.lit("--work"))).alias("decoded"))


_WORDS = "[x for x in string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') if x <> '']"


@query("search_index", f"SELECT token, count(*) AS docs, CAST(sum(n) AS BIGINT) AS uses FROM (SELECT conv_id, turn, token, count(*) AS n FROM (SELECT conv_id, turn, unnest({_WORDS}) AS token FROM conversations) GROUP BY 1, 2, 3) GROUP BY token")
def search_index(spark, sf):
    docs = read(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("doc"), "text")
    return Q.build_index(docs)[0].groupBy("token").agg(F.count("*").alias("docs"), F.sum("n").alias("uses"))


@query("search_matches", f"SELECT doc_id FROM documents WHERE len([y for y in {_WORDS} if starts_with(y, 'the')]) > 0 AND len([y for y in {_WORDS} if starts_with(y, 'and')]) > 0")
def search_matches(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    return Q.matches(docs, "the and").select(F.col("doc").alias("doc_id"))


_RANKED_SQL = f"""WITH w AS (SELECT doc_id AS doc, {_WORDS} AS t FROM documents), c AS (SELECT doc, t, len(t) AS n, len([y for y in t if starts_with(y, 'the')]) AS a, len([y for y in t if starts_with(y, 'and')]) AS b FROM w),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE b > 0) AS db FROM c),
r AS (SELECT doc, t, list_position([starts_with(y, 'the') for y in t], true) AS p, 0.0::DOUBLE + ln((docs - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE) + 1) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) + ln((docs - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE) + 1) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) AS score FROM c, s WHERE a > 0 AND b > 0)
SELECT doc, round(score, 4) AS score, array_to_string(t[greatest(p - 4, 1):greatest(p - 4, 1) + 7], ' ') AS snippet FROM r ORDER BY r.score DESC, doc LIMIT 500"""


@query("search_ranked", _RANKED_SQL)
def search_ranked(spark, sf):
    """Top 500 by bm25; tied scores order by id."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("doc"), "text")
    return Q.ranked(docs, "the and").select("doc", F.round("score", 4).alias("score"), "snippet")


@query("search_by_index", _RANKED_SQL.replace("documents", "(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)"))
def search_by_index(spark, sf):
    """The same over conversations, whose postings are read by the terms' prefixes."""
    docs = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text")
    postings, lengths = Q.build_index(docs)
    return Q.index_ranked(postings, lengths, docs, "the and").select("doc", F.round("score", 4).alias("score"), "snippet")


@query("search_sessions", f"SELECT conv_id AS session_id, count(*) AS hits FROM conversations WHERE len([y for y in {_WORDS} if starts_with(y, 'th')]) > 0 GROUP BY conv_id")
def search_sessions(spark, sf):
    docs = read(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("doc"), F.col("conv_id").alias("session_id"), "text")
    return Q.matches(docs, "th").groupBy("session_id").agg(F.count("*").alias("hits"))


@query("prompt_contains", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the')")
def prompt_contains(spark, sf):
    return read(spark, sf, "conversations").where(X.contains_query(F.col("text"), " THE ")).select("conv_id", "turn")


@query("rejection_counts", "SELECT CASE WHEN event_type = 'view' THEN 'unknown-type' WHEN event_type = 'error' THEN 'malformed' ELSE 'filtered' END AS category, count(*) AS n, CASE WHEN event_type = 'view' THEN 'warning' WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity FROM events WHERE event_type IN ('view', 'error', 'signup') GROUP BY event_type")
def rejection_counts(spark, sf):
    rows = read(spark, sf, "events").select(F.expr("CASE event_type WHEN 'view' THEN 'unknown-type:x' WHEN 'error' THEN 'malformed' WHEN 'signup' THEN 'filtered' END").alias("rejection"), F.lit("f").alias("path"), F.col("event_id").alias("line"))
    return V.rejection_counts(rows).drop("latest")


@query("line_depths", f"WITH {_ENTRIES_SQL} SELECT session_id, uuid, CAST(row_number() OVER (PARTITION BY session_id ORDER BY place) - 1 AS BIGINT) AS depth FROM entries")
def line_depths(spark, sf):
    """A conversation is one chain here, so a line's depth is its number."""
    return C.depths(_entries(spark, sf).select("session_id", "uuid", "parent_uuid"))


@query("attachments", f"WITH {_PROMPTS_SQL} SELECT conv_id AS session_id, turn, unnest([concat('/work/src/file', CAST(turn AS VARCHAR), '.py'), '/tmp/a.txt']) AS locator, 'prompt-mention' AS origin FROM prompts WHERE prompt LIKE 'see @%'")
def attachments(spark, sf):
    """Every row as a prompt of its own turn; tests cover images, tools and replies."""
    rows = _prompts(spark, sf)
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    steps = rows.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_id"), F.col("turn").alias("uuid"), F.lit(0).alias("ts"), F.lit(0).alias("place"), F.lit("prompt").alias("kind"), F.col("prompt").alias("text"),
        empty("string").alias("images"), empty("struct<id:string,name:string,input:string>").alias("tools"), empty("struct<tool_use_id:string,content:string,is_error:boolean>").alias("results"),
    )
    return C.attachments(steps).select("session_id", F.col("turn_id").alias("turn"), "locator", "origin")
