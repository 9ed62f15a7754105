"""Queries over log files that Spark writes from the driver's tables: heads, appended files, samples, repeated pieces, and
provider B's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.pricing import GPT
from ledgerline.operators import conversation as C
from ledgerline.operators import counters as K
from ledgerline.operators import diagnostics as D
from ledgerline.operators import search as Q
from ledgerline.operators import timeline as T
from ledgerline.operators import verify as V
from ledgerline.operators import workflows as W
from ledgerline.plans import counter_tables
from ledgerline.plans.adapters import PRICED_SQL, priced, read
from ledgerline.plans.catalog import query
from ledgerline.plans.conversation_queries import _WORDS
from ledgerline.plans.report_queries import NUDGE
from ledgerline.sources import tail
from ledgerline.sources.logs import clipped, file_roles, line_at, read_lines
from ledgerline.sources.upsert import upsert

HEAD_BYTES = 2000


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one the cluster names; one of our own only where driver and executors are one machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    base = base.rstrip("/")
    return f"{base if ':' in base else 'file://' + base}/{uuid.uuid4().hex}"


_LINE = """concat('{"type":"user","uuid":"u', event_id, '","sessionId":"s', user_id, '","timestamp":"2024-01-01T00:00:00Z","message":{"role":"user","content":"', event_type, ' ', event_id, '"}}')"""


def _written(lines: DataFrame, path: str, mode: str = "append") -> None:
    """One file a bucket, its lines by event."""
    lines.repartition(16, "bucket").sortWithinPartitions("bucket", "event_id").select("bucket", "value").write.mode(mode).partitionBy("bucket").text(path)


def _event_lines(spark, sf) -> DataFrame:
    return read(spark, sf, "events").selectExpr(f"{_LINE} AS value", "user_id % 16 AS bucket", "event_id")


_BUCKET = "CAST(regexp_extract(path, 'bucket=([0-9]+)', 1) AS BIGINT) AS bucket"


@query("head_metadata", f"""WITH l AS (SELECT user_id % 16 AS bucket, event_id, user_id, event_type, sum(strlen({_LINE}) + 1) OVER (PARTITION BY user_id % 16 ORDER BY event_id) AS ends FROM events)
SELECT bucket, concat('s', arg_min(user_id, event_id)) AS session_id, arg_min(concat(event_type, ' ', event_id), event_id) AS first_prompt, count(*) AS lines, CAST(max(ends) AS BIGINT) AS bytes FROM l WHERE ends <= {HEAD_BYTES} GROUP BY bucket""")
def head_metadata(spark, sf):
    """What the first bytes of each file say of its session, and how much of it they hold."""
    path = shared_folder(spark)
    _written(_event_lines(spark, sf), path)
    heads = tail.read_heads(spark, path, "*.txt", HEAD_BYTES)
    size = heads.groupBy("path").agg(F.count("*").alias("lines"), F.max(F.col("offset") + F.octet_length("value") + 1).alias("bytes"))
    return tail.head_metadata(heads).join(size, "path").selectExpr(_BUCKET, "session_id", "first_prompt", "lines", "bytes")


@query("tailed_lines", f"SELECT user_id % 16 AS bucket, count(*) AS lines, CAST(sum(strlen({_LINE}) + 1) AS BIGINT) AS bytes FROM events GROUP BY 1")
def tailed_lines(spark, sf):
    """All lines of growing logs as a stream gives them, in two runs over one checkpoint, between which files come."""
    path = shared_folder(spark)
    lines = _event_lines(spark, sf)
    for part in (lines.where("event_id % 3 = 0"), lines.where("event_id % 3 <> 0")):
        _written(part, f"{path}/logs")
        stream = tail.tailed(spark, f"{path}/logs", "*.txt").select("path", "offset", F.octet_length("value").alias("size"))
        stream.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/table").selectExpr(_BUCKET, "size").groupBy("bucket").agg(F.count("*").alias("lines"), F.sum(F.col("size") + 1).cast("long").alias("bytes"))


@query("tailed_samples", "SELECT account, count(*) AS samples, round(sum(used), 2) AS used FROM (SELECT DISTINCT event_type AS account, ts, value AS used FROM events) GROUP BY account")
def tailed_samples(spark, sf):
    """The table of rate-limit samples after its log was read twice from where the call before had stopped."""
    path = shared_folder(spark)
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    lines = read(spark, sf, "events").select(F.to_json(F.struct(stamp.alias("ts"), F.col("event_type").alias("account"), F.col("value").alias("used"))).alias("value"), (F.col("user_id") % 16).alias("bucket"), "event_id")
    for part in (lines.where("event_id % 2 = 0"), lines.where("event_id % 2 = 1")):
        _written(part, f"{path}/log")
        tail.append_samples(spark, f"{path}/log", f"{path}/table", f"{path}/check", "*.txt")
    return spark.read.parquet(f"{path}/table").groupBy("account").agg(F.count("*").alias("samples"), F.round(F.sum("used"), 2).alias("used"))


@query("repeated_spans", """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS m FROM events),
p AS (SELECT user_id, coalesce(list(event_type ORDER BY event_id) FILTER (2 * n <= m), []) AS a, coalesce(list(event_type ORDER BY event_id) FILTER (2 * n > m), []) AS b FROM e GROUP BY user_id),
o AS (SELECT user_id, b, max(k) AS k FROM (SELECT *, unnest(range(1, least(len(a), len(b)) + 1)) AS k FROM p) WHERE a[len(a) - k + 1:len(a)] = b[1:k] GROUP BY user_id, b)
SELECT CAST(user_id AS VARCHAR) AS session_id, CAST(1 AS BIGINT) AS piece_no, CAST(k AS INTEGER) AS n FROM o WHERE k < len(b) AND list_contains(b[1:k], 'purchase')""")
def repeated_spans(spark, sf):
    """A user's events as two pieces: how many of the second's first types are the first's last ones."""
    by_user = Window.partitionBy("user_id")
    e = read(spark, sf, "events").withColumn("n", F.row_number().over(by_user.orderBy("event_id"))).withColumn("m", F.count("*").over(by_user))
    keys = e.select(
        F.col("user_id").cast("string").alias("session_id"), F.when(2 * F.col("n") > F.col("m"), 1).otherwise(0).cast("long").alias("piece_no"), F.col("event_id").alias("line"), F.lit(None).cast("string").alias("turn_id"),
        F.lit(False).alias("prelude"), (F.col("event_type") == "purchase").alias("token"), F.xxhash64("event_type").alias("k0"),
    )
    return K.repeated_spans(keys, ["k0"])


def _rollouts(spark, sf) -> DataFrame:
    """Lines of provider B from events: a user is a chain whose totals add up the k of purchases and views. Every fifth user's
    log goes on in a second file that repeats the first from its last token event on; users of 7n + 3 are sub-agents of the
    user before, whose log they start with and whose total they go on from after a prompt of their own."""
    e = read(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"))
    own = Window.partitionBy("user_id").orderBy("event_id")
    e = e.withColumn("k", F.when(F.col("event_type").isin("purchase", "view"), F.col("k")).otherwise(0)).withColumns({"t": F.sum("k").over(own), "n": F.row_number().over(own), "m": F.count("*").over(Window.partitionBy("user_id"))})
    child = F.col("user_id") % 7 == 3
    parents = e.select((F.col("user_id") + 1).alias("user_id"), "event_id", "ts", "event_type", "k", "t", "n").where(child)
    users = e.select("user_id").distinct()
    top = parents.groupBy("user_id").agg(F.max("t").alias("top"))
    copied = parents.join(users, "user_id").select("user_id", F.lit("a").alias("file"), "n", "ts", "event_type", "event_id", "t")
    grown = e.join(top, "user_id", "left").withColumn("t", F.col("t") + F.when(child, F.coalesce("top", F.lit(0))).otherwise(0))
    half = F.floor(F.col("m") / 2)
    grown = grown.withColumn("again", F.max(F.when((F.col("n") <= half) & F.col("event_type").isin("purchase", "view"), F.col("n"))).over(Window.partitionBy("user_id")))
    two = (F.col("user_id") % 5 == 0) & ~child & ~((F.col("user_id") + 1) % 7 == 3) & F.col("again").isNotNull()
    start = 1 << 30  # a child's own lines come after those it copied
    place = F.when(child, F.col("n") + start + 1).otherwise(F.col("n"))
    first = grown.where(~two | (F.col("n") <= half)).select("user_id", F.lit("a").alias("file"), place.alias("n"), "ts", "event_type", "event_id", "t")
    second = grown.where(two & (F.col("n") >= F.col("again"))).select("user_id", F.lit("b").alias("file"), "n", "ts", "event_type", "event_id", "t")
    body = copied.unionByName(first).unionByName(second)
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    total = F.struct((F.col("t") * 4).alias("input_tokens"), F.col("t").alias("cached_input_tokens"), (F.col("t") * 2).alias("output_tokens"), F.lit(0).alias("reasoning_output_tokens"), (F.col("t") * 6).alias("total_tokens"))
    token = F.to_json(F.struct(stamp.alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(total.alias("total_token_usage")).alias("info")).alias("payload")))
    said = F.to_json(F.struct(stamp.alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.lit("user_message").alias("type"), F.concat_ws(" ", "event_type", "event_id").alias("message")).alias("payload")))
    piece = F.concat(F.lit("/logs/"), "user_id", "file", F.lit(".jsonl"))
    lines = body.select(piece.alias("piece"), F.col("n").alias("line"), F.when(F.col("event_type").isin("purchase", "view"), token).otherwise(said).alias("value"))
    name = F.col("user_id").cast("string")
    parent = F.when(child, F.struct(F.struct(F.struct((F.col("user_id") - 1).cast("string").alias("parent_thread_id")).alias("thread_spawn")).alias("subagent")))
    created = F.when(F.col("file") == "a", "2024-01-01T00:00:00Z").otherwise("2024-01-02T00:00:00Z")
    files = body.select("user_id", "file").distinct()
    heads = files.select(piece.alias("piece"), F.lit(-2).cast("long").alias("line"), F.to_json(F.struct(created.alias("timestamp"), F.lit("session_meta").alias("type"), F.struct(name.alias("id"), F.lit("/work/b").alias("cwd"), parent.alias("source")).alias("payload"))).alias("value"))
    models = files.select(piece.alias("piece"), F.when(child, start).otherwise(-1).cast("long").alias("line"), F.lit('{"type":"turn_context","payload":{"model":"gpt-5"}}').alias("value"))
    task = files.where(child).select(piece.alias("piece"), F.lit(start + 1).cast("long").alias("line"), F.concat(F.lit('{"type":"event_msg","payload":{"type":"user_message","message":"task '), "user_id", F.lit('"}}')).alias("value"))
    return lines.select("piece", F.col("line").cast("long").alias("line"), "value").unionByName(heads).unionByName(models).unionByName(task)


_IN, _READ, _OUT = GPT["gpt-5"]
_SESSIONS_SQL = f"""WITH e AS (SELECT user_id, CASE WHEN event_type IN ('purchase', 'view') THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) ELSE 0 END AS k FROM events),
r AS (SELECT CASE WHEN user_id % 7 = 3 AND user_id - 1 IN (SELECT user_id FROM events) THEN user_id - 1 ELSE user_id END AS root, k FROM e)
SELECT concat('b:', root) AS session_id, count(*) AS requests, CAST(sum(3 * k) AS BIGINT) AS input_tokens, CAST(sum(k) AS BIGINT) AS cache_read, CAST(sum(2 * k) AS BIGINT) AS output_tokens,
round(sum(3 * k) * {_IN} / 1e6 + sum(k) * {_READ} / 1e6 + sum(2 * k) * {_OUT} / 1e6 + 1e-9, 6) AS cost_usd FROM r WHERE k > 0 GROUP BY root"""
_SUMS = ["input_tokens", "cache_read", "output_tokens"]


@query("provider_b_sessions", _SESSIONS_SQL)
def provider_b_sessions(spark, sf):
    """Usage and cost of sessions, from files with copies of roots and repeated pieces."""
    paid = counter_tables.Parts(spark, "", _rollouts(spark, sf)).requests
    return paid.groupBy("session_id").agg(F.count("*").alias("requests"), *(F.sum(c).alias(c) for c in _SUMS), F.round(F.sum("cost_usd") + 1e-9, 6).alias("cost_usd"))


@query("provider_b_truth", _SESSIONS_SQL)
def provider_b_truth(spark, sf):
    """The same by the verifier's own rules."""
    truth = V.counter_session_truth(counter_tables.Parts(spark, "", _rollouts(spark, sf)).lines)
    return truth.select("session_id", "requests", *_SUMS, F.round(F.col("cost_usd") + 1e-9, 6).alias("cost_usd"))


@query("provider_b_prompts", """WITH e AS (SELECT user_id, event_type, event_id FROM events WHERE event_type NOT IN ('purchase', 'view'))
SELECT concat('b:', CASE WHEN user_id % 7 = 3 AND user_id - 1 IN (SELECT user_id FROM events) THEN user_id - 1 ELSE user_id END) AS session_id, concat_ws(' ', event_type, event_id) AS text FROM e
UNION ALL SELECT DISTINCT concat('b:', CASE WHEN user_id - 1 IN (SELECT user_id FROM events) THEN user_id - 1 ELSE user_id END), concat('task ', user_id) FROM events WHERE user_id % 7 = 3""")
def provider_b_prompts(spark, sf):
    """Prompts of sessions, each once however many files hold it."""
    return counter_tables.Parts(spark, "", _rollouts(spark, sf)).steps.where("kind = 'prompt'").select("session_id", "text")


_ISSUES_SQL = "SELECT concat('s', user_id) AS session_id, CASE event_type WHEN 'error' THEN 'line-rejected' ELSE 'missing-usage' END AS kind, event_id AS line, CASE event_type WHEN 'error' THEN 'error' ELSE 'warning' END AS severity FROM events WHERE event_type IN ('error', 'signup') AND user_id % 9 <> 0 UNION ALL SELECT DISTINCT concat('f', user_id), 'source-rejected', CAST(NULL AS BIGINT), 'error' FROM events WHERE user_id % 9 = 0"


@query("line_issues", _ISSUES_SQL)
def line_issues(spark, sf):
    e = read(spark, sf, "events")
    lines = e.selectExpr("CASE WHEN user_id % 9 <> 0 THEN concat('s', user_id) END AS session_id", "concat('/logs/f', user_id, '.jsonl') AS path", "event_id AS line", "CASE WHEN event_type = 'error' THEN 'malformed' END AS rejection", "CASE event_type WHEN 'signup' THEN 'missing' WHEN 'click' THEN 'duplicate' END AS skipped")
    return V.line_issues(lines).drop("detail")


_CONVERSATIONS = "(SELECT conv_id * 1000 + turn AS doc_id, conv_id, text FROM conversations)"
_PHRASE_SQL = f"""WITH w AS (SELECT doc_id AS doc, conv_id, {_WORDS} AS t FROM {_CONVERSATIONS}), c AS (SELECT doc, conv_id, t, len(t) AS n, len([y for y in t if starts_with(y, 'an')]) AS a, len([i for i in range(1, len(t)) if t[i] = 'the' and starts_with(t[i + 1], 'an')]) AS m FROM w),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (WHERE a > 0) AS da FROM c),
r AS (SELECT doc, conv_id, t, list_position([starts_with(y, 'an') for y in t], true) AS p, ln((docs - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE) + 1) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) AS score FROM c, s WHERE m > 0),
h AS (SELECT doc, conv_id, score, array_to_string(t[greatest(p - 4, 1):greatest(p - 4, 1) + 7], ' ') AS snippet FROM r ORDER BY r.score DESC, doc LIMIT 500)"""


def _phrase_hits(spark, sf) -> DataFrame:
    docs = read(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), F.col("conv_id").alias("session_id"), "text")
    postings, lengths = Q.build_index(docs)
    return Q.index_ranked(postings, lengths, docs, "the-an")


@query("search_phrase_by_index", f"{_PHRASE_SQL} SELECT doc, round(score, 4) AS score, snippet FROM h")
def search_phrase_by_index(spark, sf):
    """A phrase whose last word is a prefix, by places in the index."""
    return _phrase_hits(spark, sf).select("doc", F.round("score", 4).alias("score"), "snippet")


@query("search_session_hits", f"{_PHRASE_SQL} SELECT conv_id AS session_id, count(*) AS hits, arg_min(snippet, (-score, doc)) AS snippet FROM h GROUP BY conv_id")
def search_session_hits(spark, sf):
    """Hits by session with the snippet of the best."""
    return Q.session_hits(_phrase_hits(spark, sf))


_CATEGORY = "CASE event_type WHEN 'error' THEN 'malformed' WHEN 'view' THEN 'unknown-type' WHEN 'click' THEN 'filtered' WHEN 'signup' THEN 'bad-timestamp' ELSE 'agent-orphan' END"


@query("recent_issues", f"""WITH i AS (SELECT {_CATEGORY} AS category, user_id AS path, event_id AS line FROM events)
SELECT category, CASE category WHEN 'malformed' THEN 'error' WHEN 'bad-timestamp' THEN 'error' ELSE 'warning' END AS severity, nth, path, line FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY path DESC, line DESC) AS INTEGER) AS nth FROM i WHERE category <> 'filtered') WHERE nth <= 20""")
def recent_issues(spark, sf):
    """The latest 20 issues of each category, cut on each task before they are shuffled."""
    issues = read(spark, sf, "events").selectExpr(f"{_CATEGORY} AS category", "props AS detail", "user_id AS path", "event_id AS line")
    return D.recent(issues).drop("detail")


@query("issue_counts", f"SELECT {_CATEGORY} AS category, count(*) AS n, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'error' WHEN 'click' THEN 'info' ELSE 'warning' END AS severity FROM events GROUP BY event_type")
def issue_counts(spark, sf):
    return D.counts(read(spark, sf, "events").selectExpr(f"{_CATEGORY} AS category"))


@query("workflow_links", """WITH m AS (SELECT l_orderkey AS run, l_partkey AS agent, min(l_linenumber) AS position FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1, 2),
f AS (SELECT DISTINCT l_orderkey AS run, l_suppkey AS agent FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT o_custkey AS session_id, concat('c', o_orderkey) AS tool_use_id, concat('a', agent) AS agent_id, position, CASE WHEN o_orderkey % 4 = 0 THEN 'by metadata' ELSE 'by text' END AS summary
FROM orders JOIN (SELECT run, agent, position FROM m UNION ALL SELECT run, agent, NULL FROM f) x ON x.run = o_orderkey WHERE o_orderkey % 3 <> 0""")
def workflow_links(spark, sf):
    """Orders launch runs; even ones have metadata that names parts as agents, odd ones files that name suppliers."""
    orders, items = read(spark, sf, "orders"), read(spark, sf, "lineitem")
    text = F.concat(F.lit("Task ID: t"), "o_orderkey", F.lit("\nSummary: by text\nTranscript dir: /p/s/subagents/workflows/"), F.col("o_orderkey").cast("string"))
    called = orders.where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("session_id"), F.concat(F.lit("c"), "o_orderkey").alias("tool_use_id"), F.col("o_orderkey").cast("string").alias("call_uuid"), F.lit("t").alias("call_turn"), text.alias("result"))
    even = items.where("l_orderkey % 2 = 0").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("index"), F.concat(F.lit("a"), "l_partkey").alias("agentId"))).alias("workflowProgress"))  # an order's few lines
    body = F.to_json(F.struct(F.concat(F.lit("t"), "l_orderkey").alias("taskId"), F.when(F.col("l_orderkey") % 4 == 0, "by metadata").alias("summary"), "workflowProgress"))
    folder = lambda key: F.concat(F.lit("/p/s/subagents/workflows/"), key.cast("string"))
    meta = W.metadata(even.select(F.concat(folder(F.col("l_orderkey")), F.lit("/run.json")).alias("path"), body.alias("value")))
    files = file_roles(items.where("l_orderkey % 2 = 1").select(F.concat(folder(F.col("l_orderkey")), F.lit("/agent-a"), "l_suppkey", F.lit(".jsonl")).alias("path")))
    return W.workflow_links(called, meta, files).select("session_id", "tool_use_id", "agent_id", "position", "summary")


@query("upserted_requests", """SELECT CAST(floor(event_id / 3) AS BIGINT) AS id, arg_min(user_id, (event_id % 2 = 0, user_id, event_id)) AS session_id, arg_min(value, (event_id % 2 = 0, user_id, event_id)) AS cost_usd, max(CASE WHEN event_id % 10 >= 4 THEN 2 ELSE 1 END) AS source_id FROM events GROUP BY 1""")
def upserted_requests(spark, sf):
    """Two overlapping loads into one table: values of the first row by rank, owned by the last load that carries them."""
    table = shared_folder(spark)
    rows = read(spark, sf, "events").selectExpr("CAST(floor(event_id / 3) AS BIGINT) AS id", "user_id AS session_id", "value AS cost_usd", "event_id % 2 = 0 AS is_sidechain", "event_id AS place")
    for load, part in ((1, rows.where("place % 10 < 7")), (2, rows.where("place % 10 >= 4"))):
        upsert(part.withColumn("source_id", F.lit(load)), table, ["is_sidechain", "session_id", "place"], load)
    return spark.read.parquet(table).select("id", "session_id", "cost_usd", "source_id")


@query("latched_totals", "SELECT event_id, bool_or(event_type = 'purchase') OVER (PARTITION BY user_id % 10, CAST(ts AS DATE) ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS complete FROM events")
def latched_totals(spark, sf):
    """Whether a day's total is shown as complete, by a batch over all snapshots."""
    e = read(spark, sf, "events").select((F.col("user_id") % 10).alias("source"), F.col("event_id").alias("at"), F.to_date("ts").alias("day"), F.col("value").alias("cost_usd"), (F.col("event_type") == "purchase").alias("complete"))
    return T.latched(e).select(F.col("at").alias("event_id"), "complete")


_AGGREGATES_SQL = f"""{PRICED_SQL}, t AS (SELECT session_id, concat(CASE WHEN is_sidechain THEN 'side-' ELSE 'd' END, strftime(timestamp, '%Y-%m-%d')) AS turn_id, strftime(timestamp, '%Y-%m-%d') AS day, * EXCLUDE (session_id) FROM priced),
m AS (SELECT session_id, turn_id, day, any_value(is_sidechain) AS side, model, sum(input_tokens) + sum(output_tokens) AS used, min(timestamp) AS seen, sum(output_tokens) AS output_tokens, coalesce(sum(input_cost), 0) AS input_cost, coalesce(sum(cache_read_cost), 0) AS cache_read_cost FROM t GROUP BY 1, 2, 3, model),
s AS (SELECT session_id, turn_id, day, any_value(side) AS side, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, sum(input_cost) AS input_cost, sum(cache_read_cost) AS cache_read_cost, string_agg(model, ',' ORDER BY used DESC, seen, model) AS models FROM m GROUP BY 1, 2, 3)
SELECT a.session_id, a.turn_id, a.output_tokens, round(a.input_cost + {NUDGE}, 4) AS input_cost, a.models, CAST(a.output_tokens + coalesce(b.output_tokens, 0) AS BIGINT) AS total_output_tokens, round(a.cache_read_cost + coalesce(b.cache_read_cost, 0) + {NUDGE}, 4) AS total_cache_read_cost
FROM s a LEFT JOIN s b ON b.session_id = a.session_id AND b.day = a.day AND b.side AND NOT a.side"""


@query("turn_aggregates", f"WITH {_AGGREGATES_SQL}")
def turn_aggregates(spark, sf):
    """A user's day is a turn that calls the day's sidechain turn: tokens, cost legs and models, own and with sub-agents."""
    p = priced(spark, sf)
    day = F.date_format("timestamp", "yyyy-MM-dd")
    named = p.withColumn("turn_id", F.concat(F.when(F.col("is_sidechain"), "side-").otherwise("d"), day)).withColumn("day", day)
    turns = named.groupBy("session_id", "turn_id").agg(F.first("is_sidechain").alias("is_sidechain"), F.first(F.when(F.col("is_sidechain"), F.col("day"))).alias("agent_id"))
    links = turns.where("not is_sidechain").select("session_id", F.col("turn_id").alias("call_turn"), F.substring("turn_id", 2, 10).alias("agent_id"))
    links = links.join(turns.select("session_id", "agent_id"), ["session_id", "agent_id"], "left_semi")
    out = C.turn_aggregates(named.select("session_id", "turn_id", F.col("id").alias("request_id")), p, turns, links)
    money = lambda c: F.round(F.col(c) + NUDGE, 4).alias(c)
    return out.select("session_id", "turn_id", "output_tokens", money("input_cost"), F.array_join("models", ",").alias("models"), "total_output_tokens", money("total_cache_read_cost"))


@query("raw_lines_at", f"SELECT user_id % 16 AS bucket, {_LINE} AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 16 ORDER BY event_id) = 3")
def raw_lines_at(spark, sf):
    """The raw line of a locator: each file's third."""
    path = shared_folder(spark)
    _written(_event_lines(spark, sf), path)
    lines = read_lines(spark, path, "*.txt")
    return line_at(lines, lines.select("path").distinct().withColumn("line", F.lit(2).cast("long"))).selectExpr(_BUCKET, "value")


@query("clipped_texts", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE left(text, 40) END AS text FROM conversations")
def clipped_texts(spark, sf):
    """Texts other than prompts cut, as for sources that are read for their usage only."""
    return clipped(read(spark, sf, "conversations").withColumn("type", F.col("role")), 40).select("conv_id", "turn", "text")
