"""Issues by category, workflow fan-out, merges of loads, the day latch."""

import random
from datetime import date, datetime

from pyspark.sql import functions as F

from ledgerline.operators import diagnostics as D
from ledgerline.operators import timeline as T
from ledgerline.operators import workflows as W
from ledgerline.sources import upsert as U
from ledgerline.sources.logs import decode_entries, file_roles
from ledgerline.streaming import refresh


def test_workflow_links(spark):
    text = 'Started.\nTask ID: k1\nRun ID: run-1 \nSummary: by text\nTranscript dir: /r/p/s/subagents/workflows/run-1\nscriptPath: "/x.js"'
    called = spark.createDataFrame(
        [("s", "t1", "u1", "turn", text), ("s", "t2", "u2", "turn", "Transcript dir: /r/p/s/subagents/workflows/run-2/"), ("s", "t3", "u3", "turn", "Task ID: k3"), ("s", "t4", "u4", "turn", "nothing"), ("s", "t5", "u5", "turn", None), ("s", "t6", "u9", "later", "Run ID: run-1")],
        "session_id string, tool_use_id string, call_uuid string, call_turn string, result string",
    )
    files = file_roles(spark.createDataFrame([(f"file:/r/p/s/subagents/workflows/{x}",) for x in ("run-1/agent-zz.jsonl", "run-2/agent-b.jsonl", "run-2/agent-a.jsonl", "run-1/run.json")], "path string"))
    meta = W.metadata(
        spark.createDataFrame(
            [("/r/p/s/subagents/workflows/run-1/run.json", '{"runId":"run-1","taskId":"k1","workflowName":"build","status":"done","workflowProgress":[{"index":2,"agentId":"m2"},{"index":1,"agentId":"m1"},{"index":3}],"more":[1]}'), ("/r/p/s/subagents/workflows/run-3/m.json", '{"taskId":"k3","summary":"by file","workflowProgress":[{"agentId":"q"}]}'), ("/x.json", "{bad")],
            "path string, value string",
        )
    )
    got = sorted((r["tool_use_id"], r["agent_id"], r["position"], r["workflow"], r["summary"]) for r in W.workflow_links(called, meta, files).collect())
    assert got == [("t1", "m1", 1, "build", "by text"), ("t1", "m2", 2, "build", "by text"), ("t2", "a", None, None, None), ("t2", "b", None, None, None), ("t3", "q", 0, None, "by file")]


def test_issues(spark):
    line = lambda **x: __import__("json").dumps(x)
    base = {"uuid": "u", "sessionId": "s", "timestamp": "2024-01-01T00:00:00Z"}
    rows = [
        "{bad", line(type="odd", **base), line(type="user", message={"content": []}, **base), line(type="assistant", message={"stop_reason": "strange", "content": [{"type": "novel"}, {"type": "tool_use", "id": "1", "name": "Weird", "input": {}}]}, **base),
        line(type="user", message={"content": [{"type": "image", "source": {"media_type": "image/png"}}]}, **base), line(type="user", uuid="u", timestamp="x", message={"content": "y"}),
    ]
    entries = decode_entries(spark.createDataFrame([("f", k, v) for k, v in enumerate(rows)], "path string, line long, value string"))
    issues = D.entry_issues(entries)
    assert sorted((r["category"], r["detail"], r["line"]) for r in issues.collect()) == [("empty-user", "", 2), ("inline-image", "1", 4), ("malformed", "", 0), ("missing", "sessionId", 5), ("unknown-block", "novel", 3), ("unknown-stop-reason", "strange", 3), ("unknown-tool", "Weird", 3), ("unknown-type", "odd", 1)]
    assert {r["category"]: (r["n"], r["severity"]) for r in D.counts(issues).collect()}["missing"] == (1, "error")


def test_latest_issues_are_bounded_before_the_shuffle(spark):
    issues = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "malformed").when(F.col("id") % 3 == 1, "filtered").otherwise("unknown-type").alias("category"), F.lit("d").alias("detail"), F.lit("f").alias("path"), F.col("id").alias("line"))
    got = D.recent(issues, 4)
    assert sorted((r["category"], r["nth"], r["line"]) for r in got.collect()) == [("malformed", 1, 4998), ("malformed", 2, 4995), ("malformed", 3, 4992), ("malformed", 4, 4989), ("unknown-type", 1, 4997), ("unknown-type", 2, 4994), ("unknown-type", 3, 4991), ("unknown-type", 4, 4988)]
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_agent_and_drift_issues(spark):
    called = spark.createDataFrame([("s", "t1", "Agent", "ok"), ("s", "t2", "Agent", "no id"), ("s", "t3", "Read", "x")], "session_id string, tool_use_id string, name string, result string")
    links = spark.createDataFrame([("s", "t1", "main", "a"), ("s", "t9", "side", "gone")], "session_id string, tool_use_id string, call_turn string, agent_id string")
    turns = spark.createDataFrame([("s", "main", False, None), ("s", "side", True, "a")], "session_id string, turn_id string, is_sidechain boolean, agent_id string")
    files = spark.createDataFrame([("/f", "s", "s"), ("/g", "s", "t")], "path string, session string, said string")
    assert sorted((r["category"], r["detail"]) for r in D.agent_issues(called, links, turns, files).collect()) == [("agent-depth", "gone"), ("agent-orphan", "gone"), ("agent-session", "t"), ("agent-without-id", "t2")]
    found = spark.createDataFrame([("s", "cost-mismatch", "error"), ("s", "requests-mismatch", "error"), ("s", "unknown-pricing", "warning")], "session_id string, kind string, severity string")
    assert sorted(r["category"] for r in D.drift_issues(found).collect()) == ["cost-drift", "truth-drift"]


def test_loads_in_any_order_are_one_build(spark, tmp_path):
    r = random.Random(3)
    schema = "id string, session_id string, is_sidechain boolean, place long, cost_usd double, source_id string"
    rows = [(f"r{r.randrange(40)}", f"s{r.randrange(5)}", r.random() < 0.3, k, float(k), "x") for k in range(90)]
    loads = {"a": [x[:5] + ("a",) for x in rows[:60]], "b": [x[:5] + ("b",) for x in rows[40:]]}
    rank = ["is_sidechain", "session_id", "place"]
    shown = lambda path: sorted(tuple(x[c] for c in ("id", "session_id", "is_sidechain", "place", "cost_usd")) for x in spark.read.parquet(path).collect())
    results = []
    for n, order in enumerate((["a", "b"], ["b", "a"], ["a", "b", "b"])):
        path = str(tmp_path / f"t{n}")
        for k, name in enumerate(order):
            U.upsert(spark.createDataFrame(loads[name], schema), path, rank, k, buckets=8)
        results.append(shown(path))
    full = str(tmp_path / "full")
    U.upsert(spark.createDataFrame([x[:5] + ("all",) for x in rows], schema), full, rank, 0, buckets=8)
    assert results[0] == results[1] == results[2] == shown(full) and len(results[0]) == len({x[0] for x in rows})
    # only touched buckets are written; the last load owns what it carries
    path = str(tmp_path / "t0")
    spark.catalog.refreshByPath(path)
    before = {x["id"]: x["load"] for x in spark.read.parquet(path).collect()}
    U.upsert(spark.createDataFrame([("new", "s", False, 0, 0.0, "c")], schema), path, rank, 9, buckets=8)
    spark.catalog.refreshByPath(path)
    after = {x["id"]: (x["load"], x["source_id"]) for x in spark.read.parquet(path).collect()}
    assert {k: v[0] for k, v in after.items() if k != "new"} == before and after["new"] == (9, "c")
    # a source goes: what another file carries goes over to it
    U.drop_owner(path, spark, ["b"], spark.createDataFrame([(x[0], n) for n, part in loads.items() for x in part], "id string, source_id string"))
    spark.catalog.refreshByPath(path)
    assert {x["id"] for x in spark.read.parquet(path).collect()} == {x[0] for x in loads["a"]} | {"new"}


def snapshot(source, day, minute, complete):
    return (source, datetime(2024, 1, day, 0, minute), date(2024, 1, day), 1.0 * minute, complete)


SCHEMA = "source string, at timestamp, day date, cost_usd double, complete boolean"


def test_a_days_total_stays_complete_over_restarts(spark, tmp_path):
    parts = [[snapshot("a", 1, 1, False), snapshot("a", 1, 2, True), snapshot("b", 1, 1, False)], [snapshot("a", 1, 3, False), snapshot("b", 1, 2, False)], [snapshot("a", 2, 1, False), snapshot("a", 2, 2, True), snapshot("a", 2, 3, False)]]
    got = []

    def take(df, _):
        got.extend((r["source"], r["day"].day, r["at"].minute, r["complete"]) for r in df.collect())

    for part in parts:  # a query of its own each, from one checkpoint
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = refresh.latched_totals(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
        run = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert run.awaitTermination(100)
    want = sorted((r["source"], r["day"].day, r["at"].minute, r["complete"]) for r in T.latched(spark.createDataFrame(sum(parts, []), SCHEMA)).collect())
    assert sorted(got) == want
    assert [x[3] for x in want] == [False, True, True, False, True, True, False, False]


def test_workflow_metadata_is_parsed_once(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    call = spark.createDataFrame([("s", "c", "u", "t", "Task ID: t1\nTranscript dir: /p/s/subagents/workflows/r1")], "session_id string, tool_use_id string, call_uuid string, call_turn string, result string")
    lines = spark.createDataFrame([("/p/s/subagents/workflows/r1/run.json", '{"taskId": "t1", "workflowProgress": [{"index": 1, "agentId": "a1"}]}')], "path string, value string")
    files = spark.createDataFrame([], "path string, role string, run string, agent string")
    meta = W.metadata(lines.withColumn("value", F.udf(counted, "string").asNondeterministic()("value")))
    assert [r["agent_id"] for r in W.workflow_links(call, meta, files).collect()] == ["a1"]
    assert seen.value == 1
